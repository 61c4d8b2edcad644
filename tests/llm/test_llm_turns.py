"""Conversation repair against an exhaustive search, hard negatives against plain loops, and the word encoder against its library."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import pytest

from lodestone.llm import hard_negatives, turn_repair
from lodestone.llm.turn_repair import damaged, repair, repaired_turns

SOLID = r"[^\x20\x09-\x0D]"
FOLLOWS = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.findall(SOLID, text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) by looking at every way there is: states after each turn, with up to two insertions in between."""
    flags = faults(rows)
    ways = {("", "", ()): 0}  # last initial, audit, lines: cost
    due = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def inserted(ways):
        out = dict(ways)
        for _ in range(2):
            for (last, audit, lines), cost in list(out.items()):
                key = (due[last][0], audit + "I", (*lines, f"{due[last]}:"))
                out[key] = min(out.get(key, 10**9), cost + 3)
        return out

    for (role, text), flag in zip(rows, flags, strict=True):
        after = {}
        for (last, audit, lines), cost in inserted(ways).items():
            options = [(last, "D", lines, 4)]
            if flag not in ("blank", "duplicate"):
                more = 3 * (flag == "truncated")
                if (last, role[:1]) in FOLLOWS:
                    options.append((role[:1], "K", (*lines, f"{role}:{text}"), more))
                options.append((due[last][0], "R", (*lines, f"{due[last]}:{text}"), 3 + more))
            for state, edit, new, price in options:
                key = (state, audit + edit, new)
                after[key] = min(after.get(key, 10**9), cost + price)
        # of one state only those that may still win: at most nine dearer than the best
        least = {}
        for (state, _, _), cost in after.items():
            least[state] = min(least.get(state, 10**9), cost)
        ways = {k: c for k, c in after.items() if c <= least[k[0]]}
    ends = [(c, k[1], k[2]) for k, c in inserted(ways).items() if k[0] in ("", "a")]
    return min(ends)


def expected(turns):
    """By conversation what ``repair`` has to say."""
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, " " if t[2] is None else t[2], " " if t[3] is None else t[3]))
        rows = [(" " if r is None else r, " " if x is None else x) for _, _, r, x in own]
        flags, numbers = faults(rows), [t[1] for t in own if t[1] is not None]
        cost, audit, lines = cheapest(rows)
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, flags.count("blank"), flags.count("duplicate"), flags.count("truncated"),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def conversations(seed, many, most):
    rng = random.Random(seed)
    turns = []
    for conv in range(many):
        for place in range(rng.randint(1, most)):
            turn = rng.choice([None, rng.randint(0, most), place, place, place])
            if turns and rng.random() < 0.2:
                turns.append(turns[-1])
                continue
            turns.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "usher"]), rng.choice(["Yes.", "yes. ", "No", "", None, " \n", "Why?\t", f"é {rng.randint(0, 9)}!", " "])))
    return turns


SCHEMA = "conv_id long, turn long, role string, text string"


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize(("turns", "block", "fan"), [(4096, 1024, 32), (2, 2, 2)])
def test_repair_equals_exhaustive_search(spark, monkeypatch, turns, block, fan):
    for name, value in (("TURNS", turns), ("BLOCK", block), ("FAN", fan)):
        monkeypatch.setattr(turn_repair, name, value)
    rows = [*conversations(1, 60, 9), *((None, k, "user", "So.") for k in range(3)), (999, 2**62 + 9, "user", "a."), (999, -(2**62), "user", "b.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = expected(rows)
    want[999] = (None, *want[999][1:])  # wider than a long
    assert got(repair(df)) == want
    lines = {}
    for r in repaired_turns(df).orderBy("place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(lines.get(k, [])).encode()).hexdigest() == v[-1] for k, v in want.items())


def test_damage_and_dropped_conversations(spark):
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("system", "Be good."), ("user", "Hi!"), ("assistant", None), (None, "x.y?")])]
    rows += [(100 + k, 0, "user", "Alone.") for k in range(60)]
    spoilt = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        spoilt += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS there", "1 AS conv", "2 AS cost")
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: empty for c, *_ in rows} | expected(spoilt)
    assert empty in want.values() and got(repair(damaged(df), there="there")) == want
    assert repair(df.limit(0)).count() == 0 and repaired_turns(df.limit(0)).count() == 0


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "TURNS", 500)
    turns = [(1, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(3000)] + [(2, 0, "system", "s.")]
    found = got(repair(spark.createDataFrame(turns, SCHEMA)))
    assert found[1][:7] == (0, 0, 0, 0, 0, 0, "K" * 3000)
    assert found[1][7] == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in turns[:3000]).encode()).hexdigest()
    assert found[2][5:7] == (4, "D")


def hard_by_loops(rows, positives=5, negatives=5):
    """rows: (id, label, whole vector)."""
    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = []
    for i, label, v in rows:
        if i % 100:
            continue
        every = sorted(((-score(v, w), j, m) for j, m, w in rows if j != i or m != label))
        for s, j, _ in [e for e in every if e[2] == label and e[1] != i][:positives]:
            good = [e for e in every if e[2] != label and 80 * -s <= 100 * -e[0] <= 100 * -s][:negatives]
            out += [(i, j, k + 1, e[1], -s, -e[0]) for k, e in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize("large", [False, True])
def test_hard_negatives_equal_loops(spark, monkeypatch, large):
    from pyspark.sql import functions as F

    if large:
        monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 16)
        monkeypatch.setattr(hard_negatives, "SCORES", 100)
    rng = random.Random(3)
    rows = []
    for i in range(-100, 400):
        v = [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 0.7]) for _ in range(4)]
        rows.append((i, rng.randrange(4) if i else 0, v if i % 9 else [*v, *v][: rng.randint(0, 8)]))
    rows += [(700, 1, [1e9, -1e9]), (800, 2, [2e9, 1.5]), (900, 1, [1e300]), (901, 2, [1e300]), (902, 1, [-1e300])]
    odd = [(None, 1, [1.0]), (100, None, [1.0]), (200, 1, None), (200, 1, [1.0, None]), (200, 1, [float("nan")]), (300, 2, [float("inf")])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, label int, embedding array<double>").selectExpr("*", "'x' AS id", "1 AS v", "2 AS rank").repartition(5)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("id") % 100 == 0).collect())
    whole = [(i, label, [int(Fraction(x) * 256 // 1) for x in v]) for i, label, v in rows]
    clip = lambda n: max(1 - 2**63, min(2**63 - 1, n))
    want = [(*r[:4], clip(r[4]), clip(r[5])) for r in hard_by_loops(whole)]
    near = lambda x: [r for r in x if max(abs(r[4]), abs(r[5])) < 2**62]
    assert near(got) == near(want) and len(near(want)) > 50
    assert hard_negatives.hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0
