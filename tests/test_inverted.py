"""The inverted index against BM25 over the texts."""

import random

from lodestone.operators.inverted import InvertedIndex
from lodestone.operators.retrieval import bm25


def test_search_equals_bm25(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{min(int(rng.paretovariate(0.8)), 50)}" for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = {k: text(rng.randint(0, 30)) for k in range(80)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    queries = spark.createDataFrame([(q, text(6)) for q in range(12)] + [(99, "nowhere"), (98, None)], "query_id int, text string")
    index = InvertedIndex.create(spark, str(tmp_path / "index"), frame(docs).schema["doc_id"].dataType, 4)
    assert index.search(queries, 5).count() == 0
    rows = lambda df: {(r.query_id, r.doc_id): (round(r.score, 6), r["rank"]) for r in df.collect()}
    assert index.add(frame(docs)) == 80
    first, version = rows(index.search(queries, 5)), index.documents.snapshot().version
    assert first == rows(bm25(frame(docs), queries, 5)) and len(first) > 40
    # some change, some come, some go; what is the same is not cut up again
    changed = {3: text(20), 4: "", 5: docs[5], 200: text(10), 201: None}
    assert index.add(frame(changed)) == 4 and index.add(frame(changed)) == 0
    index.remove(frame({7: "", 8: ""}))
    docs = {k: v for k, v in (docs | changed).items() if k not in (7, 8)}
    want = rows(bm25(frame(docs), queries, 5))
    assert rows(index.search(queries, 5)) == want
    assert rows(index.search(queries, 5, version)) == first
    before = index.postings.read().count()
    index.compact()
    assert rows(index.search(queries, 5)) == want and index.postings.read().count() < before
    index.add(frame({3: docs[3] + " more", 9: docs[9]}))
    index.add(frame({3: docs[3]}))  # back to a text that is posted already
    assert rows(index.search(queries, 5)) == want
