"""The Jaccard join, decontamination and quality rules against brute force."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import ngram_jaccard
from lodestone.llm.components import components
from lodestone.llm.decontamination import clean, contamination
from lodestone.llm.ngram_jaccard import near_duplicates, one_of_each
from lodestone.llm.quality_rules import SCALE, THRESHOLD, judge, ratios, trusted
from lodestone.llm.signature_tree import Groups, Similarity, bitmap, join_all, width

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = r"[^\x20\x09-\x0D]+"


def variant(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.randint(1, 5)):
            docs.append(" ".join(variant(rng, base, rng.choice([0, 0, 1, 2, 5]))))
        docs.append(" ".join(base[: max(5, int(len(base) * rng.choice([0.8, 0.85, 0.9])))]))
        docs.append(" ".join([*base, *passage]))
    docs += [None, "", " \n ", "one", "ONE", "one two", "a b c d", "a b c d e", "A b c d e", "x " * 300, "x " * 900, docs[0], docs[0].upper()]
    docs.append(" ".join(rng.choice(vocabulary) for _ in range(30000)))
    return docs


def sets(texts, k=5):
    out = []
    for t in texts:
        w = re.findall(SPACED, (t or "").translate(AZ))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    return out


def brute(ids, own):
    label = {k: k for k in range(len(ids))}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(own)):
        for b in range(a):
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                label[root(a)] = root(b)
    least = collections.defaultdict(list)
    for k in range(len(ids)):
        least[root(k)].append(ids[k])
    return [min(least[root(k)]) for k in range(len(ids))]


def test_components_equal_brute_force(spark):
    docs = corpus()
    ids = random.Random(5).sample(range(10_000), len(docs))
    df = spark.createDataFrame([(i, t, 0, 7) for i, t in zip(ids, docs, strict=True)], "doc_id long, text string, cls int, key int").repartition(5)
    own = sets(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == {i: (len(s), c) for i, s, c in zip(ids, own, brute(ids, own), strict=True)}


def test_threshold_is_exact(spark):
    base = [f"t{k}" for k in range(104)]  # 100 shingles
    cut = lambda n: " ".join(base[: n + 4])
    df = spark.createDataFrame([(1, cut(100)), (2, cut(80)), (3, cut(79)), (4, cut(63))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}  # 79 meets 80, not 100
    assert {r.doc_id: r.component_id for r in near_duplicates(df.where("doc_id <> 2")).collect()} == {1: 1, 3: 3, 4: 4}


def test_many_near_copies(spark):
    rng = random.Random(2)
    base = [f"b{k}" for k in range(150)]
    rows = [(k, " ".join(variant(rng, base, 1))) for k in range(600)] + [(k, " ".join(base)) for k in range(600, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r.component_id for r in near_duplicates(df).collect()} == {0}


@pytest.mark.parametrize("early", [2, 1 << 20])
def test_order_of_hashes_does_not_matter(spark, monkeypatch, early):
    monkeypatch.setattr(ngram_jaccard, "EARLY", early)
    docs = corpus(7)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    own = sets(docs)
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == dict(enumerate(brute(list(range(len(docs))), own)))


def test_jaccard_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None), (None, None)], "doc_id int, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7), (None, 0, None)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0
    kept = [(r.doc_id, r.text) for r in one_of_each(df).collect()]
    assert sorted(kept, key=str) == sorted([(5, "a b c d e f"), (7, None), (None, None)], key=str)


def test_one_of_each_keeps_columns(spark):
    docs = corpus(4)
    df = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(docs)], "doc_id long, text string, lang string, key string")
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(list(range(len(docs))), sets(docs))))


def test_signature_tree_finds_every_link():
    rng = np.random.default_rng(3)
    own = []
    for _ in range(60):
        base = rng.integers(0, 2**63, int(rng.choice([3, 40, 63, 65, 130, 500, 1100])), dtype=np.uint64)
        for _ in range(4):
            keep = rng.random(len(base)) > rng.choice([0.02, 0.08, 0.12])
            own.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, int(0.06 * len(base)) + 1, dtype=np.uint64)])))
    like, groups = Similarity(80, 100), Groups()
    same = lambda i, j: like.overlap(len(np.intersect1d(own[i], own[j])), len(own[i]), len(own[j]))
    join_all(np.arange(len(own)), np.array([len(s) for s in own]), [bitmap(s, width(len(s))) for s in own], like, groups, same)
    want = brute(list(range(len(own))), [set(s.tolist()) for s in own])
    assert groups.roots(np.arange(len(own))).tolist() == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (99, 100), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {99: 99, 100: 99}
    assert components(edges.limit(0)).count() == 0


def windows(words, n=13):
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))


def contaminated(text, items):
    w, hit, found = words_of(text), set(), []
    for item, t in items.items():
        every = windows(words_of(t))
        n = min(13, len(words_of(t)))
        at = [i for i in range(len(w) - n + 1) if n and tuple(w[i : i + n]) in every]
        hit |= {i + j for i in at for j in range(n)}
        found += [str(item)] * bool(at)
    return len(w), len(hit), sorted(found)


def decontamination_tables():
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(60)]
    long = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: " ".join(long(rng.choice([13, 14, 40, 100]))) for k in range(12)} | {20: "Short item, of five!", 21: "single", 22: "the the the the the the the the the the the the the the", 23: "", 24: None, 30: "É à ü Straße " * 4}
    docs = []
    for k in range(12):
        w = words_of(items[k])
        for size in (12, 13, 20, len(w)):
            at = rng.randrange(max(1, len(w) - size + 1))
            docs.append(" ".join([*long(rng.randint(0, 30)), *w[at : at + size], *long(rng.randint(0, 500))]))
    docs += ["x Short ITEM -- of\nfive? y", "short item of", "single", "Single!" * 3, "the " * 12, "the " * 40, None, "", "...", items[30], items[30].lower(), " ".join(long(9000)) + " " + items[2], items[1] + " " + items[1] + " " + items[3]]
    return docs, items


def test_contamination_equals_brute_force(spark):
    docs, items = decontamination_tables()
    rows = [(k, t, "clash") for k, t in enumerate(docs)] + [(0, docs[0], "again"), (None, items[3], "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item string").repartition(4)
    bench = spark.createDataFrame([*items.items(), (None, docs[5]), (3, items[3])], "item_id long, text string")
    got = contamination(df, bench).collect()
    want = []
    for i, t, _ in rows:
        n, hit, found = contaminated(t, items)
        want.append((str(i), n, hit, len(found), found, hit > 0 and 20 * hit >= n))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in got) == sorted(want)
    kept = clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if not w[5])


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(docs.limit(0), bench).count() == 0
    row = contamination(docs, bench.limit(0)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)


RULE_TEXTS = [None, "", " ", "a", "a b c a b c", "x " * 60, "l1\nl1\n\n \nl2\nl1", "é# ü* $a &|<>%", "a b c d a b c e a b", "w " * 3, "\t\x0b\x0c\r a b  "]


@pytest.mark.parametrize("extra", [0, 1])
def test_rule_counts_equal_brute_force(spark, extra):
    rng = random.Random(extra)
    texts = RULE_TEXTS + [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 300))).replace("a b", "\n") for _ in range(40)] + [" ".join(rng.choice("abcdefghijklmnopqrst") * 2 for _ in range(20000))]
    df = spark.createDataFrame([(k, t, "clash", "c") for k, t in enumerate(texts)], "doc_id long, text string, kept string, n_words string")
    got = {r.doc_id: r for r in judge(df, np.zeros(8, np.int64)).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        w = re.findall(SPACED, t)
        count = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if count[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(SPACED, x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed), (k, t[:50])
        assert r.kept == (not failed)


def test_ratio_is_the_log_likelihood_ratio(spark):
    good, bad = "alpha beta gamma delta " * 20, "### *** ### *** " * 20
    df = spark.createDataFrame([(1, good), (2, good), (3, bad), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (9, 1)], "doc_id long, quality int")
    table = ratios(df, trusted(df, labels), buckets=1 << 12)
    got = {r.doc_id: r for r in judge(df, table, most_repeats=100).collect()}
    assert got[1].kept and got[2].kept and not got[3].kept and not got[4].kept
    raw, target = np.log((40 + 1) / (240 + (1 << 12))), np.log((40 + 1) / (160 + (1 << 12)))
    single = round((target - raw) * 1000)
    assert single in table[: 1 << 12]
    assert got[1].llr > 0 > got[3].llr and math.isfinite(got[3].llr)
    assert not ratios(df, df.limit(0)).any()
    filtered = judge(df, table, most_repeats=100).where("kept").select("doc_id", "text")
    assert filtered.count() == 2


def bucketed(text, n):
    """The buckets of a text's tokens and of its pairs, by Spark's hash worked out in Python."""
    tokens = regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+", text or "")

    def hashed(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return (seed - (seed >> 63 << 64)) % n

    return [hashed(a) for a in tokens] + [n + hashed(a, b) for a, b in itertools.pairwise(tokens)]


def log_ratios(trusted_rows, every, n):
    def logs(rows):
        c = collections.Counter(b for r in rows for b in r)
        sums = [sum(v for k, v in c.items() if k // n == half) for half in (0, 1)]
        return [math.log((c[k] + 1) / (sums[k // n] + n)) for k in range(2 * n)]

    return [round((a - b) * SCALE) for a, b in zip(logs(trusted_rows), logs(every), strict=True)]


def test_verdicts_equal_brute_force(spark):
    """The ratio and the verdict of odd and of random texts."""
    rng = random.Random(12)
    words = [f"w{k}é" for k in range(40)] + ["###", "!?", "Ünï", "12"]
    texts = [None, "", " \n", "#", "one", "one two", "\U0001f642 \U0001f642!", "a" * 5000] + [" ".join(rng.choice(words[: rng.choice([5, 44])]) for _ in range(rng.choice([3, 60, 200]))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(0, 88, 2)], "doc_id long, quality int")
    n = 1 << 10
    buckets = [bucketed(t, n) for t in texts]
    ratio = log_ratios([buckets[k] for k in range(0, 88, 2) if k % 3 == 0], buckets, n)
    got = {r.doc_id: r for r in judge(df, ratios(df, trusted(df, labels), buckets=n)).collect()}
    verdicts = set()
    for k, own in enumerate(buckets):
        llr = sum(ratio[b] for b in own) / max(len(own), 1) / SCALE
        assert abs(got[k].llr - llr) < 1e-9
        assert got[k].kept == (not got[k].base_failed and llr >= THRESHOLD)
        verdicts.add((got[k].kept, got[k].base_failed))
    assert len(verdicts) >= 2


def test_rules_on_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert judge(df, ratios(df, df)).count() == 0
    assert judge(df.withColumn("x", F.lit(1)), np.zeros(4, np.int64), columns=["doc_id"]).columns[0] == "doc_id"


@pytest.mark.parametrize("classes, shingles", [(3, 300), (7, 2000)])
def test_blocks_lose_no_link(spark, monkeypatch, classes, shingles):

    monkeypatch.setattr(ngram_jaccard, "BLOCK_CLASSES", classes)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SHINGLES", shingles)
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    docs = [" ".join([f"d{k}x{j}" for j in range(20)] + passage) for k in range(12)]  # alike only in part
    for size in (40, 90):
        base = [f"b{size}x{k}" for k in range(size)]
        docs += [" ".join(variant(rng, base, rng.choice([0, 1, 1, 2]))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert got == dict(enumerate(brute(list(range(len(docs))), sets(docs))))


@pytest.mark.parametrize("rounds", [1, 3])
def test_frequent_hashes_are_put_last(spark, monkeypatch, rounds):
    """Passages that many different texts share, and a large group of near copies, beside other near copies."""
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(50)]
    own = [[f"d{k}x{j}" for j in range(rng.choice([30, 80, 130]))] for k in range(30)]
    docs = [" ".join(w[: len(w) // 2] + passage + w[len(w) // 2 :]) for w in own]
    docs += [" ".join(variant(rng, docs[k].split(), 1)) for k in range(0, 30, 3)]
    docs += [" ".join(variant(rng, passage, n)) for n in (0, 0, 1, 1, 2)]  # little but the passage
    base = [f"b{k}" for k in range(90)]
    docs += [" ".join(variant(rng, base, rng.choice([0, 1, 1, 2]))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(ngram_jaccard, "LEAST", 1)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_CLASSES", 6)
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", 1 << 9)
    monkeypatch.setattr(ngram_jaccard, "ROUNDS", rounds)
    turns, sketch = [], ngram_jaccard._sketches
    monkeypatch.setattr(ngram_jaccard, "_sketches", lambda *a: turns.append(a[3]) or sketch(*a))
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert got == dict(enumerate(brute(list(range(len(docs))), sets(docs))))
    assert len(turns[0]) == 0 < len(turns[1])


def test_passages_no_longer_deal_out_every_text(spark, monkeypatch):
    passage = [f"p{k}" for k in range(40)]
    docs = [" ".join([f"d{k}x{j}" for j in range(200)] + passage) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    monkeypatch.setattr(ngram_jaccard, "LEAST", 1)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_CLASSES", 10)
    dealt, live = [], ngram_jaccard._candidates
    monkeypatch.setattr(ngram_jaccard, "_candidates", lambda rows, *a: dealt.extend(r["count"] for r in rows.groupBy("token").count().collect()) or live(rows, *a))
    assert {r.component_id for r in near_duplicates(df).collect()} == set(range(40))
    assert max(dealt, default=0) <= 10
