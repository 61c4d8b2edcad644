"""The pipeline against a plain version of each of its stages."""

import base64
import collections
import hashlib
import re

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from test_llm_models import held, plain_features
from test_llm_pairs import SPACED, brute, bucketed, contaminated, log_ratios, sets

from lodestone.llm.quality_classifier import fit_quality, score_quality
from lodestone.llm.quality_rules import BUCKETS, SCALE, THRESHOLD


def base_failed(text):
    w = re.findall(SPACED, text or "")
    grams = list(zip(w, w[1:], w[2:], strict=False))
    count = collections.Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    return len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_pipeline_equals_plain_stages(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    read = lambda t: pq.read_table(f"{sf_dir}/{t}.parquet").to_pylist()
    docs, labels, items = read("documents"), read("labels"), {r["item_id"]: r["text"] for r in read("benchmark")}

    # quality classifier: the model is learnt by the stage's own function, its scores are worked out here
    frames = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")]
    model = fit_quality(*frames, ~held(5, 0))
    theirs = {r.doc_id: r.predicted for r in score_quality(frames[0], model).collect()}

    def predicted(r):
        x = plain_features(r["text"])
        if x is None:
            return theirs[r["doc_id"]]
        place = [sum(c <= v for c in cuts) for v, cuts in zip(x, model.cuts, strict=True)]
        total = model.base + sum(t[k] for t, k in zip(model.tables, place, strict=True)) + sum(g[place[i], place[j]] for (i, j), g in zip(model.pairs, model.grids, strict=True))
        return int(1 / (1 + 2.718281828459045**-total) >= 0.3)

    left = [r for r in docs if predicted(r)]
    assert 0 < len(left) < len(docs)

    # quality rules, over what the classifier has left
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    buckets = {r["doc_id"]: bucketed(r["text"], BUCKETS) for r in left}
    ratio = log_ratios([buckets[i] for i in buckets if i in good], buckets.values(), BUCKETS)
    llr = {i: sum(ratio[b] for b in own) / max(len(own), 1) / SCALE for i, own in buckets.items()}
    left = [r for r in left if not base_failed(r["text"]) and llr[r["doc_id"]] >= THRESHOLD]

    # one document of each group of near duplicates, that of the least id
    ids = [r["doc_id"] for r in left]
    least = dict(zip(ids, brute(ids, sets([r["text"] for r in left])), strict=True))
    left = [r for r in left if least[r["doc_id"]] == r["doc_id"]]

    # benchmark passages
    def clean(text):
        n, hit, _ = contaminated(text, items)
        return not (hit and 20 * hit >= n)

    left = [r for r in left if clean(r["text"])]

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for r in left:
        coded = library.encode_ordinary(r["text"])
        want.add((r["doc_id"], len(coded), hashlib.sha256(",".join(map(str, coded)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    got = pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20
