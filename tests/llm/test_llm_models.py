"""The trained models: language model, classifiers, licence scans and the pipeline."""

import collections
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lm_scoring, recurrent
from lodestone.llm.license_scan import TEMPLATES, full_texts, licences
from lodestone.llm.lm_scoring import lm_scores
from lodestone.llm.queries import QUERIES
from lodestone.llm.quality_classifier import FEATURES, fit_additive, fit_quality, score_quality, text_features
from lodestone.llm.arrays import Words, slices, text_bytes
from lodestone.llm.toxicity import OrdinalModel, features, fit_ordinal, fit_toxicity, severities

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(i):
    return zlib.crc32(str(i).encode())


def held(n, r):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == r


# arrays


def test_words_do_not_cross_rows():
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array(["ab", "cd e", None, "", " f ", "ab"])})
    raw, at = text_bytes(batch.column("text"))
    words = Words(raw, at)
    assert [bytes(raw[a:b]) for a, b in zip(words.start, words.end, strict=True)] == [b"ab", b"cd", b"e", b"f", b"ab"]
    assert np.diff(words.first).tolist() == [1, 2, 0, 0, 1, 1]
    h = words.hashes()
    assert h[0] == h[4] and len(set(h.tolist())) == 4
    assert sum(p.num_rows for p in slices(batch, "text", 3)) == 6
    tail = batch.slice(4)
    assert np.diff(text_bytes(tail.column("text"))[1]).tolist() == [3, 2]


# language model


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in recurrent.initial(rng.integers(1, 9, 10).astype(float), 4, 4).items()}
    inputs, targets, begins = rng.integers(0, 10, (5, 3)), rng.integers(0, 10, (5, 3)), np.zeros((5, 3), bool)
    begins[2, 1], targets[4, 2] = True, -1
    h = rng.normal(0, 0.5, (3, 4))
    d, _, _ = recurrent.gradients(w, h, inputs, targets, begins)
    for k in w:
        at = tuple(rng.integers(0, n) for n in w[k].shape) if k != "x" else (inputs[1, 0], 2)
        loss = []
        for e in (1e-5, -1e-5):
            w[k][at] += e
            loss.append(recurrent.gradients(w, h, inputs, targets, begins)[2])
            w[k][at] -= e
        assert math.isclose((loss[0] - loss[1]) / 2e-5 / (targets >= 0).sum(), d[k][at], rel_tol=1e-4, abs_tol=1e-8)


def test_likelihoods_sum_to_one_and_carry_states():
    rng = np.random.default_rng(1)
    w = recurrent.initial(np.array([3.0, 2, 1, 4, 1, 2]), 6, 3)
    every = [np.array([a, b]) for a in range(6) for b in range(6)]
    assert math.isclose(np.exp(recurrent.log_likelihoods(w, every, 0)).sum(), 1, rel_tol=1e-5)
    docs = [rng.integers(0, 5, n) for n in (0, 1, 7, 100, 33)]
    whole, small = recurrent.log_likelihoods(w, docs, 0, 1000), recurrent.log_likelihoods(w, docs, 0, 3)
    assert np.allclose(whole, small, rtol=1e-4) and whole[0] == 0


def test_training_learns_an_order():
    docs = [np.array([1, 2, 3, 4] * 30 + [0]) for _ in range(40)]
    w = recurrent.initial(np.array([1.0, 30, 30, 30, 30]), 16, 3)
    before = recurrent.log_likelihoods(w, docs[:1], 0)[0]
    for _ in range(4):
        w, n = recurrent.train(w, docs, 0)
    assert n == 40 * 121 and recurrent.log_likelihoods(w, docs[:1], 0)[0] > 0.4 * before
    assert recurrent.train(w, [], 0)[1] == 0


def naive_log10(w, symbols):
    """One symbol after another, by the formulas of a gated unit and of two softmaxes, in double precision."""
    w = {k: v.astype(np.float64) for k, v in w.items()}
    n, members, h, before, total = len(w["u"]), w["mb"].shape[1], np.zeros(len(w["u"])), 0, 0.0
    soft = lambda a: np.exp(a) / np.exp(a).sum()
    for s in symbols:
        x, u = w["x"][before] + w["b"], h @ w["u"]
        z, r = (1 / (1 + np.exp(-(x[k : k + n] + u[k : k + n]))) for k in (0, n))
        h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :])
        g, m = divmod(s, members)
        total += math.log10(soft(h @ w["g"] + w["gb"])[g] * soft(h @ w["m"][g] + w["mb"][g])[m])
        before = s
    return total


@pytest.mark.parametrize("frequent", [lm_scoring.FREQUENT, 7])
def test_scores_equal_brute_force(spark, monkeypatch, frequent):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["The", "the", "a", "ab,", "x" * 99, "é", f"w{rng.randrange(80)}"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", " \n", "the " * 700, texts[3], texts[3]]
    rows = [(k, t, 0.5, 1) for k, t in enumerate(texts)] + [(5, texts[5], 0.1, 2), (None, "the a", 0.1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, key int").repartition(3)
    held_back, made, train = {}, [], lm_scoring._trained
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 5)
    monkeypatch.setattr(lm_scoring, "Classes", type("Kept", (lm_scoring.Classes,), {"__init__": lambda self, *a: (made.append(self), lm_scoring.Classes.__mro__[1].__init__(self, *a))[1]}))
    monkeypatch.setattr(lm_scoring, "_trained", lambda *a: held_back.update(w=train(*a)) or held_back["w"])
    got = lm_scores(df, held(7, 2), frequent=frequent).collect()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ)), "\n"]
    out = lambda i: i is not None and crc(i) % 7 == 2
    c = collections.Counter(w for i, t, *_ in rows if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))
    want = sorted((str(i), out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(base(t), 6)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    # the model's score: class by class as the network says, then within the class by counts
    classes, w = made[-1], held_back["w"]
    hashes = {}
    for t in {x for _, t, *_ in rows for x in tokens(t)} - {"\n"}:
        raw = np.frombuffer(t.encode(), np.uint8)
        _, (h, _), (tail, _), _ = next(lm_scoring._tokens(iter([pa.record_batch({"text": pa.array([t])})])))
        hashes[t] = int(classes.symbol(np.array([h]).view(np.int64), np.array([int(tail)]))[0])
        assert len(raw)
    hashes["\n"] = 0
    of, kinds = collections.Counter(), collections.Counter()
    for word, k in c.items():
        of[hashes[word]] += k
        kinds[hashes[word]] += 1
    assert len(classes.words) == 5
    by = {str(r.doc_id) + str(r.n_tokens): r.score for r in got}
    for i, t, *_ in rows:
        symbols = [hashes[x] for x in tokens(t)]
        inner = sum(math.log10((c[x] + 1) / (of[hashes[x]] + kinds[hashes[x]] + 1)) for x in tokens(t))
        assert math.isclose(by[str(i) + str(len(symbols))], naive_log10(w, symbols) + inner, rel_tol=1e-4)
    assert lm_scores(df.limit(0), held(7, 2)).count() == 0


def test_averages_meet_in_a_tree(spark, monkeypatch):
    none = np.zeros(0, np.int64)
    df = spark.createDataFrame([(f"a b{k} " * (1 + k),) for k in range(9)], "text string").repartition(9)
    weights, got = recurrent.initial(np.ones(1 + lm_scoring.TAIL_CLASSES), 4, 23), []
    for many in (2, 100):
        monkeypatch.setattr(lm_scoring, "AVERAGED", many)
        got.append(lm_scoring._trained(df, lm_scoring.Frequent(none.view(np.uint64), none, none), 0, weights))
    assert all(np.allclose(got[0][k], got[1][k], atol=1e-5) and not np.allclose(got[0][k], weights[k]) for k in ("u", "mb"))


def test_network_learns_from_every_training_row(spark, monkeypatch):
    trained, rows = [], [(k, f"w{k} " * (1 + k % 5), 0) for k in range(40)] + [(40 + k, "same text", 0) for k in range(20)] + [(None, "no id", 0)]
    monkeypatch.setattr(lm_scoring, "_trained", lambda df, known, heads, weights: trained.extend(r.text for r in df.collect()) or weights)
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    lm_scores(df, held(7, 2))
    assert sorted(trained) == sorted(t for i, t, _ in rows if i is None or crc(i) % 7 != 2)


def test_training_in_pieces_counts_all_tokens(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LEARN_TOKENS", 50)
    seen, train = [], recurrent.train
    monkeypatch.setattr(recurrent, "train", lambda w, documents, start: seen.append(sum(map(len, documents))) or train(w, documents, start))
    batch = pa.record_batch({"text": pa.array(["a b c " * 20] * 7)})

    class Rows:
        rdd = spark.sparkContext.parallelize([], 1)

        def mapInArrow(self, run, kind):
            self.out = list(run(iter([batch] * 3)))
            return spark.createDataFrame([(r["task"], r["n"], r["w"]) for b in self.out for r in b.to_pylist()], kind)

    none = np.zeros(0, np.int64)
    lm_scoring._trained(rows := Rows(), lm_scoring.Frequent(none.view(np.uint64), none, none), 0, recurrent.initial(lm_scoring.Classes(none, none, none, []).n, 4, 23))
    assert sum(seen) == 21 * 61 and len(seen) > 3 and rows.out[0].column("n").to_pylist() == [21 * 61]


def test_model_beats_counts_on_held_out_rows(spark):
    got = QUERIES["op3_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# classifiers


def test_features_of_each_text_alone():
    texts = ["One two.\nOne two.\nÉa 12 ###", "", "a a a a a a", "x | y | z!!"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    every = text_features(raw, at)
    for k, t in enumerate(texts):
        own = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(every[k], text_features(own, np.array([0, len(own)]))[0])
    assert not every[1].any() and every[2, FEATURES.index("echo")] == 1 and every[0, FEATURES.index("same_lines")] > 0.5


def test_additive_model_finds_main_and_pair_effects():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 5))
    main, pair = (x[:, 0] > 0.5).astype(float), ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    assert ((fit_additive(x, main).score(x) > 0.5) == main).mean() > 0.98
    model = fit_additive(x, pair)
    assert (1, 2) in model.pairs and ((model.score(x) > 0.5) == pair).mean() > 0.9
    assert np.allclose(fit_additive(x[:0], main[:0]).score(x), 0.5)
    assert len(np.unique(fit_additive(x, np.ones(len(x))).score(x))) == 1


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality_classifier"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([r.predicted for r in rows if r.quality]) > 0.97
    assert got.count() == 1000


def plain_features(text):
    """The features of one text, character by character and word by word."""
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    if not words:
        return [0.0] * len(FEATURES) if not data else None
    n, lines = len(words), [[w for w in re.split(rb"[\x20\x09-\x0D]+", line) if w] for line in data.split(b"\n")]
    count = lambda test: sum(map(test, data))
    upper, lower = count(lambda c: 65 <= c <= 90), count(lambda c: 97 <= c <= 122)
    own = [line for line in data.split(b"\n") if line]
    twice = lambda xs: sum(xs.count(x) > 1 for x in xs) / len(xs) if len(xs) > 1 else 0.0
    threes = [tuple(words[k : k + 3]) for k in range(n - 2)]
    assert lines
    return [
        math.log1p(n), sum(map(len, words)) / n, upper / max(upper + lower, 1), count(lambda c: c in b"#*$%&|<>") / n, count(lambda c: c == 124) / n, count(lambda c: c == 33) / n, count(lambda c: c in b".,;:?") / n,
        count(lambda c: 48 <= c <= 57) / n, count(lambda c: c >= 192) / n, data.count(b"\n") / n, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(n - 1, 1), twice(threes), twice(own), math.log1p(n / max(1, len(own))),
    ]


def test_quality_scores_equal_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels, ~held(5, 0))
    rows = score_quality(docs, model).collect()
    assert len(model.pairs) == 5 and len(rows) == 200
    for r in rows:
        x = plain_features(r.text)
        if x is None:
            continue
        place = [sum(c <= v for c in cuts) for v, cuts in zip(x, model.cuts, strict=True)]
        total = model.base + sum(t[k] for t, k in zip(model.tables, place, strict=True)) + sum(g[place[i], place[j]] for (i, j), g in zip(model.pairs, model.grids, strict=True))
        assert math.isclose(r.score, 1 / (1 + math.exp(-total)), abs_tol=1e-9), r.doc_id


def test_repeated_ids_are_learnt_once(spark):
    texts = [(k, f"text number {k} ") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(texts, "doc_id long, text string")
    often = once.unionByName(spark.createDataFrame([(7, "zzz later text")] * 500 + texts[:3], "doc_id long, text string"))
    a, b = (fit_quality(df, labels, F.lit(True)) for df in (once, often))
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))
    a, b = (fit_toxicity(df, labels, F.lit(True)) for df in (once, often))
    assert np.array_equal(a.names, b.names) and np.array_equal(a.weights, b.weights)


def test_quality_odd_rows(spark):
    df = spark.createDataFrame([(1, "fine text here", "c"), (None, None, "d"), (2, "", "e"), (2, "", "e"), (3, "x" * 300000, "f")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (9, 1)], "doc_id long, quality int")
    model = fit_quality(df, labels, F.lit(True))
    got = score_quality(df, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == 5
    assert score_quality(df.limit(0), fit_quality(df.limit(0), labels.limit(0), F.lit(True))).count() == 0


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(4)
    n = 3000
    x = rng.random(n) * 6
    grade = np.digitize(x + rng.logistic(0, 0.3, n), [2, 4])
    weights, cuts = fit_ordinal(np.arange(n), np.zeros(n, int), x, grade, 1, 2)
    assert weights[0] > 0 and np.allclose(cuts / weights[0], [2, 4], atol=0.2)
    above = OrdinalModel(np.zeros(1, np.uint64), weights, cuts).above(weights[0] * np.array([0.0, 3, 6]))
    assert (np.diff(above, axis=1) <= 0).all() and np.round(above.sum(1)).tolist() == [0, 1, 2]


def test_toxicity(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        text = [rng.choice(words) for _ in range(40)] + [rng.choice(["IDIOT!", "scum,", "moron"]) for _ in range(rng.randint(2, 9) * toxic)]
        rng.shuffle(text)
        rows.append((k, " ".join(text), 1.0))
        labels.append((k, int(toxic)))
    rows += [(None, "idiot idiot scum", 1.0), (1000, None, 1.0), (1001, "", 1.0), (1001, "", 1.0), (1002, "w1 " * 90000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, severity double")
    model = fit_toxicity(df, spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int"), ~held(5, 0))
    got = severities(df, model)
    assert got.count() == len(rows)
    test = [r for r in got.collect() if r.doc_id is not None and r.doc_id < 600 and crc(r.doc_id) % 5 == 0]
    assert all(r.toxic == (r.doc_id % 6 == 0) for r in test)
    by = {r.doc_id: r for r in got.collect()}
    assert by[None].toxic and by[None].severity > 0.9 and not by[1000].toxic and not by[1002].toxic
    none = fit_toxicity(df, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"), F.lit(True))
    assert severities(df, none).where("toxic").count() == 0
    assert severities(df.limit(0), none).count() == 0


def test_severities_equal_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels, ~held(5, 0))
    weight = dict(zip(model.names.tolist(), model.weights.tolist(), strict=True))
    text = {r.doc_id: r.text for r in docs.collect()}
    known = {}
    for r in severities(docs, model).collect():
        seen = collections.Counter()
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text[r.doc_id] or "").translate(AZ).encode()):
            if w not in known:
                known[w] = features(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0].tolist()
            seen.update(known[w])
        linear = sum(weight[f] * math.log1p(n) for f, n in seen.items() if f in weight)
        above = [1 / (1 + math.exp(min(50, max(-50, cut - linear)))) for cut in model.thresholds]
        chance = [a - b for a, b in zip([1, *above], [*above, 0], strict=True)]
        assert math.isclose(r.severity, sum(above), abs_tol=1e-9) and math.isclose(r.score, above[0], abs_tol=1e-9) and r.toxic == (above[0] >= 0.35)
        assert r.grade == max(chance.index(max(chance)), int(r.toxic))


# licences


def test_licences(spark):
    mit = next(t for n, t in TEMPLATES if n == "MIT")
    gpl = next(t for n, t in TEMPLATES if n == "GPL-3.0")
    rows = [
        (1, "repo/LICENSE", f"Copyright\n{gpl}\n"), (2, "repo/src/a.c", "int main"), (3, "repo/src/b.c", f"// {mit.upper()}\nint x"), (4, "repo/lib/COPYING.txt", mit), (5, "repo/lib/deep/er/x.py", "import os"),
        (6, "other/x.py", "text about a license"), (7, None, mit), (8, None, None), (9, "x", ""), (10, "repo/libx/y", None), (10, "repo/libx/y", None), (11, "/LICENSE", "no such words"), (12, "repo/lib/LICENSE.md", gpl),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, licence string").repartition(3)
    got = {r.doc_id: (r.own_licence, r.licence, r.inherited_from) for r in licences(df).collect()}
    assert got == {
        1: ("GPL-3.0", "GPL-3.0", None), 2: (None, "GPL-3.0", "repo"), 3: ("MIT", "MIT", None), 4: ("MIT", "MIT", None), 5: (None, "MIT", "repo/lib"), 6: (None, None, None),
        7: ("MIT", "MIT", None), 8: (None, None, None), 9: (None, None, None), 10: (None, "GPL-3.0", "repo"), 11: (None, None, None), 12: ("GPL-3.0", "GPL-3.0", None),
    }
    assert licences(df).count() == len(rows) and licences(df.limit(0)).count() == 0
    assert {r.line for r in licences(df.where("doc_id = 1")).collect()} == {2}


def test_cosine_by_hand(spark):
    df = spark.createDataFrame([(1, "a", "alpha beta"), (2, "b", "alpha beta gamma"), (3, "c", "delta")], "doc_id long, path string, text string")
    got = {r.doc_id: r.cosine for r in licences(df, [("X", "alpha beta")], least=0.1).collect()}
    idf = lambda n: math.log(4 / (1 + n)) + 1
    assert got[1] == 1.0 and got[3] is None
    assert math.isclose(got[2], math.sqrt(2) * idf(2) / math.sqrt(2 * idf(2) ** 2 + idf(1) ** 2), rel_tol=1e-9)


def test_wrapped_headers_and_whole_licence_files(spark):
    gpl, bsd = (textwrap.wrap(next(t for n, t in TEMPLATES if n == m and len(t) > 90), 72) for m in ("GPL-3.0", "BSD-3-Clause"))
    assert len(gpl) == 4 and len(bsd) == 2
    whole = dict(full_texts())
    rows = [
        (1, "g/a.c", "/* tool\n * Copyright someone\n *\n" + "\n".join(f" * {x}" for x in gpl) + "\n */\nint main"), (2, "b/LICENSE", "\n".join(f"# {x}" for x in bsd)), (3, "b/src/x.go", "package x"),
        (4, "a/LICENSE", whole["Apache-2.0"]), (5, "a/deep/er/y.py", "import os"), (6, "c/COPYING", "Ours alone\n" + whole["GPL-3.0"]), (7, "c/z.c", "int z"), (8, "d/readme.txt", whole["CC0-1.0"]),
        (9, "e/LICENSE.txt", whole["BSD-2-Clause"].replace("<copyright holder>", "Jo Doe")), (10, "f/w.py", "\n\n".join(f"# {w}" for w in " ".join(bsd).split())), (11, "h/v.py", gpl[0] + "\n" + "unlike words of some other matter that no licence has ever used before or since" + "\n" + gpl[1]),
        (12, "i/COPYING", whole["GPL-2.0"]), (13, "j/LICENSE", "the\n" * 5000), (14, "k/m.c", f"// ({bsd[0]}\n// {bsd[1]})"), *((20 + k, f"p/{k}", f"file number {k} of a folder") for k in range(30)),
    ]
    got = {r.doc_id: (r.own_licence, r.licence, r.inherited_from, r.line) for r in licences(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(3)).collect() if r.doc_id < 20}
    assert got == {
        1: ("GPL-3.0", "GPL-3.0", None, 4), 2: ("BSD-3-Clause", "BSD-3-Clause", None, 1), 3: (None, "BSD-3-Clause", "b", None), 4: ("Apache-2.0", "Apache-2.0", None, got[4][3]), 5: (None, "Apache-2.0", "a", None),
        6: ("GPL-3.0", "GPL-3.0", None, 1), 7: (None, "GPL-3.0", "c", None), 8: (None, None, None, None), 9: ("BSD-2-Clause", "BSD-2-Clause", None, 1), 10: ("BSD-3-Clause", "BSD-3-Clause", None, 1), 11: (None, None, None, None),
        12: ("GPL-2.0", "GPL-2.0", None, 1), 13: (None, None, None, None), 14: ("BSD-3-Clause", "BSD-3-Clause", None, 1),
    }


def test_titles_tell_full_texts_apart(spark):
    """An AGPL text, of which no full text is known, is all but a GPL text; its title is its own."""
    gpl = dict(full_texts())["GPL-3.0"].split("\n")
    agpl = ["                    GNU AFFERO GENERAL PUBLIC LICENSE", "                       Version 3, 19 November 2007", *gpl[2:]]
    rows = [(1, "a/COPYING", "\n".join(agpl)), (2, "a/x.c", "int x"), (3, "b/COPYING", "\n".join(gpl)), (4, "c/COPYING", "\n\n".join(["Ours", *agpl])), *((20 + k, f"p/{k}", f"file number {k}") for k in range(30))]
    got = {r.doc_id: r.licence for r in licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4)} == {1: "AGPL-3.0", 2: "AGPL-3.0", 3: "GPL-3.0", 4: "GPL-3.0"}


def test_licences_of_one_family_are_told_apart(spark):
    rows = [(k, f"d{k}/a.c", "/*\n * A tool.\n" + "\n".join(f" * {x}" for x in textwrap.wrap(t, 60)) + "\n */\nint main;") for k, (_, t) in enumerate(TEMPLATES)]
    got = {r.doc_id: r.own_licence for r in licences(spark.createDataFrame(rows + [(100 + k, f"q/{k}", f"file {k} of other words") for k in range(30)], "doc_id long, path string, text string")).collect()}
    assert {k: got[k] for k in range(len(TEMPLATES))} == {k: n for k, (n, _) in enumerate(TEMPLATES)}


def test_runs_equal_every_run_by_brute_force(spark):
    rng = random.Random(8)
    known = [("X", "a b c d e f g"), ("Y", "f g h i"), ("Z", "a j")]
    texts = ["\n".join(" ".join(rng.choice("abcdefghijqrstuv") for _ in range(rng.choice([0, 1, 1, 2, 3]))) for _ in range(rng.randint(1, 14))) for _ in range(120)]
    df = spark.createDataFrame([(k, f"p/{k}", t) for k, t in enumerate(texts)], "doc_id long, path string, text string").repartition(3)
    got = {r.doc_id: (r.own_licence, r.cosine and round(r.cosine, 9)) for r in licences(df, known, least=0.7).collect()}
    terms = {n: set(t.split()) for n, t in known}
    idf = lambda w: math.log(121 / (1 + sum(w in t.split() for t in texts))) + 1 if any(w in s for s in terms.values()) else math.log(121 / 2) + 1
    weight = {w: idf(w) for w in "abcdefghijqrstuv"}
    size = lambda s: math.sqrt(sum(weight[w] ** 2 for w in s))
    for k, t in enumerate(texts):
        lines = t.split("\n")
        runs = [s for i in range(len(lines)) for j in range(i, len(lines)) if (s := set(" ".join(lines[i : j + 1]).split()))]
        best = {n: max((round(size(s & x) ** 2 / size(s) / size(x), 9) for s in runs), default=0) for n, x in terms.items()}
        name = max(sorted(best), key=best.get)
        assert got[k][1] == (best[name] if best[name] >= 0.7 else None), (k, t)
        assert got[k][0] is None or best[got[k][0]] == best[name]


# pipeline


def test_pipeline_stages(spark, sf_dir, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.count() <= before
            before = docs.count()
    assert docs.count() == before
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    first = spark.read.parquet(f"{tmp_path}/0")
    assert first.join(labels, "doc_id", "left_semi").count() >= 0.97 * labels.count()
    assert sorted(map(str, pipeline.run(spark, sf_dir).collect())) == sorted(map(str, docs.collect()))
