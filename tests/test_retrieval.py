import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.functions import tables
from lodestone.operators import catalog, jobs, metrics, retrieval, validation, vectors
from lodestone.operators.embedding import embed, hashed_vector
from lodestone.plans.ingestion import ingest
from lodestone.sources.files import checked_uploads

MUTEX = "# Synchronization\n## Mutex\nA mutex protects a shared counter between threads.\n## Barrier\nA barrier makes threads wait for each other.\n"
PIPES = "# Pipes\n## Pipe\nA pipe connects two processes.\n"


@pytest.fixture(scope="module")
def ingested(spark):
    rows = [("m", "OS", "text/markdown", MUTEX), ("p", "OS", "text/markdown", PIPES), ("x", "OS", "text/plain", " \n"), ("z", "OS", None, "a")]
    files = spark.createDataFrame([(a, b, c, bytearray(d.encode())) for a, b, c, d in rows], "document_id string, course_id string, media_type string, content binary")
    return ingest(files, 400, 50, 256)


def test_ingest(ingested):
    status = {r.document_id: (r.ingestion_status, r.error_code, r.chunk_count) for r in ingested.documents.collect()}
    assert status == {"m": ("indexed", None, 2), "p": ("indexed", None, 1), "x": ("failed", "EMPTY_DOCUMENT", 0), "z": ("failed", "UNSUPPORTED_DOCUMENT_FORMAT", 0)}
    assert [r.section_path for r in ingested.chunks.where("document_id = 'm'").orderBy("chunk_index").collect()] == [["Synchronization", "Mutex"], ["Synchronization", "Barrier"]]
    assert {r.collection: r.records for r in vectors.collection_counts(ingested.vectors).collect()} == {"OS--hashing-bow-256": 3}


def test_dense_retrieval_over_ingested(spark, ingested):
    documents = ingested.documents.withColumn("filename", F.concat("document_id", F.lit(".md"))).withColumn("knowledge_base_role", F.when(F.col("document_id") == "m", "primary").otherwise("supplementary"))
    queries = spark.createDataFrame([(1, hashed_vector("mutex shared counter", 256).tolist()), (2, hashed_vector("pipe between processes", 256).tolist())], "query_id int, embedding array<double>")
    got = retrieval.dense(ingested.vectors, documents, ingested.chunks, queries, 2).orderBy("query_id", "rank").collect()
    assert "protects a shared counter" in got[0].content and (got[0].query_id, got[0].rank) == (1, 1)
    assert all(abs(r.score - (r.similarity - 0.05 * (r.knowledge_base_role == "supplementary"))) < 1e-9 for r in got)
    only = retrieval.dense(ingested.vectors, documents, ingested.chunks, queries, 5, "mandatory").collect()
    assert {r.document_id for r in only} == {"m"}


def test_penalty_puts_primary_first(spark):
    df = spark.createDataFrame([("a", 0.80, "primary"), ("b", 0.82, "supplementary")], "id string, s double, role string")
    assert [r.id for r in df.orderBy(retrieval.rank_score(F.col("s"), F.col("role")).desc()).collect()] == ["a", "b"]


def test_nearest_is_exact_and_breaks_ties(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", [2.0, 0.0]), ("z", [0.0, 0.0])]
    table = spark.createDataFrame(rows, "record_id string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([("q", [3.0, 0.0]), ("o", [0.0, 0.0])], "query_id string, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.record_id, r.distance) for r in vectors.nearest(table, queries, 3).collect()}
    assert [got["q", k][0] for k in (1, 2, 3)] == ["a", "d", "c"]
    assert got["o", 1] == ("a", 1.0)
    assert vectors.nearest(table, queries, 0).count() == 0
    assert vectors.nearest(table, queries.limit(0), 2).count() == 0


def test_distance_sql(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r.d for r in df.selectExpr(vectors.cosine_distance("a", "b") + " AS d").collect()]
    assert abs(got[0] - (1 - math.sqrt(0.5))) < 1e-12 and got[1] == 1.0


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "d"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([("q", "A a"), ("n", "zzz")], "query_id string, text string")
    got = retrieval.bm25(docs, queries, 5).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 2] and {r.query_id for r in got} == {"q"}
    one = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, id long, rank int")
    two = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "query_id string, id long, rank int")
    fused = retrieval.fuse([one, two], 3, "id").orderBy("rank").collect()
    assert [r.id for r in fused] == [2, 1, 3] and abs(fused[0].score - (1 / 61 + 1 / 62)) < 1e-9


def test_graded_ranking(spark):
    grades = spark.createDataFrame([("q", i, g) for i, g in zip("ABCDE", (3, 3, 2, 1, 0), strict=True)] + [("none", "A", 0)], "query_id string, item string, grade int")
    ranking = spark.createDataFrame([("q", i, k) for k, i in enumerate("EDACB", 1)], "query_id string, item string, rank int")
    got = {(r.query_id, r.k): r for r in metrics.ranking_measures(ranking, grades, [1, 2, 3, 4, 5]).collect()}
    assert [round(got["q", k].precision, 9) for k in range(1, 6)] == [0, 0, round(1 / 3, 9), 0.5, 0.6]
    assert [round(got["q", k].recall, 9) for k in range(1, 6)] == [0, 0, round(1 / 3, 9), round(2 / 3, 9), 1]
    dcg, ideal = (sum((2**g - 1) / math.log2(k + 1) for k, g in enumerate(order, 1)) for order in ((0, 1, 3, 2, 3), (3, 3, 2, 1, 0)))
    assert math.isclose(got["q", 5].dcg, dcg) and math.isclose(got["q", 5].idcg, ideal) and math.isclose(got["q", 5].ndcg, dcg / ideal)
    assert (got["none", 1].precision, got["none", 1].recall, got["none", 1].ndcg) == (0.0, None, None)


def test_nearest_rank(spark):
    df = spark.createDataFrame([("k", float(v)) for v in range(1, 12)] + [("one", 5.0)], "key string, v double")
    for share in (0.0, 0.25, 0.5, 0.95, 1.0):
        exact = sorted(range(1, 12))[round(share * 10)]
        a = {r.key: r.p for r in df.groupBy("key").agg(metrics.nearest_rank(F.col("v"), share).alias("p")).collect()}
        b = {r.key: r.value for r in metrics.nearest_rank_by(df, "key", "v", share).collect()}
        assert a == b == {"k": float(exact), "one": 5.0}


def test_trace_summary(spark):
    rows = [("a", "succeeded", 3, 10.0, 1.0), ("b", "failed", 0, 30.0, None), ("c", "succeeded", 4, 20.0, 0.0)]
    got = metrics.trace_summary(spark.createDataFrame(rows, "file string, status string, chunk_count int, upload_ms double, processing_s double"))
    assert [r.file for r in metrics.trace_failures(spark.createDataFrame(rows, "file string, status string, chunk_count int, upload_ms double, processing_s double")).collect()] == ["b"]
    got = got.first()
    assert (got.documents, got.indexed, got.failed, got.chunks, got.upload_ms_median, got.upload_ms_p95, got.processing_s_median, got.processing_s_total) == (3, 2, 1, 7, 20.0, 30.0, 1.0, 1.0)


def test_catalog_filters(spark):
    bases = spark.createDataFrame([("k1", "OS", "primary"), ("k2", "OS", "supplementary"), ("k3", "DB", "primary")], "knowledge_base_id string, course_id string, knowledge_base_role string")
    docs = spark.createDataFrame([(str(k), b, '{"topic": %s}' % t, s) for k, (b, t, s) in enumerate([("k1", '"x"', "indexed"), ("k1", "null", "failed"), ("k2", '"x"', "indexed"), ("k3", '"y"', "queued")])], "document_id string, knowledge_base_id string, metadata string, ingestion_status string")
    count = lambda **f: catalog.total(docs, bases, catalog.document_filter(**f)).first().total
    assert [count(), count(course="OS"), count(roles=["primary"]), count(roles=[]), count(topic="x"), count(topic="x", roles=["supplementary"], status="indexed")] == [4, 3, 3, 0, 2, 1]
    with pytest.raises(ValueError):
        catalog.page(docs, bases, docs, F.lit(True), 101, 0)


def test_jobs(spark):
    jobs_ = spark.createDataFrame([("a", "retrieval", None, "c"), ("b", "retrieval", "d", None), ("c", "document_ingestion", "d", None), ("e", "document_ingestion", "d", "c")], "job_id string, job_type string, document_id string, course_id string")
    assert {r.job_id: r.error_code for r in jobs.dispatch(jobs_).collect()} == {"a": None, "b": "VALIDATION_FAILED", "c": None, "e": "VALIDATION_FAILED"}
    rows, log = jobs.submit(jobs_, F.current_timestamp())
    assert {r.event_type for r in log.collect()} == {"job.queued"} and {r.status for r in rows.collect()} == {"queued"}
    log = spark.createDataFrame([(1, "a", "job.queued"), (2, "a", "job.started"), (3, "c", "job.started"), (4, "c", "job.failed")], "log_id long, job_id string, event_type string").withColumn("recorded_at", F.timestamp_seconds("log_id"))
    assert {r.job_id: r.status for r in jobs.job_states(log).collect()} == {"a": "running", "c": "failed"}
    assert sorted(r.job_id for r in jobs.pending(jobs_, log).collect()) == ["a", "b", "e"]
    done = spark.createDataFrame([("a", "retrieval", None, None), ("c", "retrieval", "X", "bad")], "job_id string, job_type string, error_code string, error_message string").withColumn("recorded_at", F.current_timestamp())
    assert [(r.event_type, r.level, r.message) for r in jobs.outcome_log(done).orderBy("job_id").collect()] == [("job.succeeded", "info", "retrieval succeeded"), ("job.failed", "error", "bad")]


def test_validation_edges(spark):
    a = spark.createDataFrame([("x", ["s1", "s2"]), ("y", ["s1"])], "assignment_id string, sections array<string>")
    assert [(r.assignment_id, r.missing) for r in validation.missing_sections(a, ["s2", "s1"]).collect()] == [("y", ["s2"])]
    c = spark.createDataFrame([("x", True, "pending")], "assignment_id string, mandatory boolean, verdict string")
    assert {r.assignment_id: r.exportable for r in validation.assignment_states(a, c).collect()} == {"x": False, "y": True}


def test_upload_checks(spark):
    rows = [("a.md", b"x"), ("a.pdf", b"nope"), ("a.pdf", b"%PDF-1"), ("a.txt", b""), ("a.exe", b"x"), ("big.md", b"x" * 99), ("c\\d.md", b"y"), ("a.md", None)]
    df = spark.createDataFrame([(k, n, c if c is None else bytearray(c)) for k, (n, c) in enumerate(rows)], "k int, filename string, content binary")
    got = checked_uploads(df, 50).orderBy("k").collect()
    assert [r.error_code for r in got] == [None, "UNSUPPORTED_DOCUMENT_FORMAT", None, "EMPTY_DOCUMENT", "UNSUPPORTED_DOCUMENT_FORMAT", "DOCUMENT_TOO_LARGE", None, "EMPTY_DOCUMENT"]
    assert got[6].filename == "d.md" and got[0].storage_uri == f"{got[0].checksum_sha256[:2]}/{got[0].checksum_sha256}.md"


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([(k % 20, float(k % 5)) for k in range(100)], "request_id long, value double")
    a, b = metrics.bootstrap_interval(df).first(), metrics.bootstrap_interval(df.repartition(3)).first()
    assert a == b and a.low <= a["mean"] <= a.high


@pytest.mark.parametrize("request_", [("", "x", 5), ("a b", "x", 5), ("OS", "", 5), ("OS", "x" * 2001, 5), ("OS", "x", 0), ("OS", "x", 51), ("OS", "x", 5, "other")])
def test_requests_out_of_bounds(request_):
    with pytest.raises(ValueError):
        retrieval.check_request(*request_)


def test_request_within_bounds():
    retrieval.check_request("OS-2026", "named pipe", 50, "mandatory")


def test_nearest_in_blocks_equals_one_block(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(f"r{k}", [rng.gauss(0, 1) for _ in range(5)]) for k in range(300)] + [("n", None), ("z", [0.0] * 5)]
    table = spark.createDataFrame(rows, "record_id string, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(40)], "query_id int, embedding array<double>")
    whole = sorted(map(tuple, vectors.nearest(table, queries, 7).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 6)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 50 * 8 * 5)
    monkeypatch.setattr(vectors, "DISTANCES", 100)
    assert sorted(map(tuple, vectors.nearest(table, queries, 7).collect())) == whole and len(whole) == 280


def test_bm25_equals_all_scores(spark):
    import random

    rng = random.Random(4)
    words = [f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(150)]
    asked = [(q, " ".join(rng.choice(words) for _ in range(rng.randint(1, 15)))) for q in range(25)]
    got = retrieval.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id int, text string"), 5).collect()
    sets = {k: t.split() for k, t in docs}
    average = sum(map(len, sets.values())) / len(sets)
    for q, text in asked:
        scores = {}
        for w in set(text.split()):
            df = sum(w in t for t in sets.values())
            for k, t in sets.items():
                if f := t.count(w):
                    scores[k] = scores.get(k, 0) + math.log(1 + (150 - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / average))
        best = sorted(((-round(s, 9), k) for k, s in scores.items()))[:5]
        mine = sorted((-r.score, r.doc_id) for r in got if r.query_id == q)
        assert [k for _, k in mine] == [k for _, k in best] and all(abs(a[0] - b[0]) < 1e-6 for a, b in zip(mine, best, strict=True))


def test_ranks_of_large_groups(spark, monkeypatch):
    import random
    import statistics

    rng = random.Random(5)
    groups = {"even": [rng.random() for _ in range(500)], "heavy": [10 ** rng.uniform(-300, 300) for _ in range(301)], "same": [2.5] * 40, "one": [-1.0], "ends": [float("-inf"), 0.0, 1.0, float("inf")], "few": [1.0, 1.0, 3.0, 3.0]}
    rows = [(k, v) for k, own in groups.items() for v in own] + [("even", None), ("even", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "key string, v double")
    monkeypatch.setattr(metrics, "RANGES", 8)
    assert {r.key: r.m for r in metrics.median_by(df, "key", "v", "m").collect()} == {k: statistics.median(v) for k, v in groups.items()}
    assert {r.key: r.value for r in metrics.nearest_rank_by(df, "key", "v", 0.95).collect()} == {k: sorted(v)[round(0.95 * (len(v) - 1))] for k, v in groups.items()}


def test_graph_of_large_contexts(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CONTEXT_BLOCK", 3)
    rows = [("big", f"e{k}") for k in range(11)] + [("small", "e1"), ("small", "e2"), ("small", "e2")]
    edges, vertices = retrieval.cooccurrence(spark.createDataFrame(rows, "c string, e string"), "c", "e")
    assert {(r.a, r.b): r.weight for r in edges.collect()} == {(a, b): 1 + (a == "e1" and b == "e2") for a in sorted({e for _, e in rows}) for b in sorted({e for _, e in rows}) if a < b}
    assert {r.entity: (r.degree, r.strength) for r in vertices.collect()}["e1"] == (10, 11)


def test_bm25_cuts_each_text_once(spark):
    long = " ".join(f"word{k % 977}" for k in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, "word1 word2"), (3, None), (3, "word5"), (3, "word5 word5")], "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS score")
    asked = spark.createDataFrame([(1, "word1 WORD5 word976"), (2, ""), (3, "nowhere"), (4, None)], "query_id int, text string")
    began = time.monotonic()
    got = {(r.query_id, r.doc_id): r["rank"] for r in retrieval.bm25(docs, asked, 5).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (1, 3)] and time.monotonic() - began < 60
    plan = docs.select("doc_id", F.explode(S.postings(F.col("text"))).alias("p")).select("doc_id", "p.*")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "regexp_extract_all" not in above and plan.count("regexp_extract_all") == below.count("regexp_extract_all") >= 1
    assert retrieval.bm25(docs.limit(0), asked, 5).count() == retrieval.bm25(docs, asked.limit(0), 5).count() == 0


@pytest.mark.parametrize("n", [2, 64, 1000])
def test_single_precision_loses_no_neighbour(n):
    """Copies, near copies and zero vectors, against all distances in full."""
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n, 16))
    base[n // 2 :] = base[: n - n // 2] * (1 + 1e-8 * rng.normal(size=(n - n // 2, 16)))
    base[0] = 0
    asked = np.concatenate([base[:40], rng.normal(size=(20, 16))])
    part = pa.RecordBatch.from_pydict({"query_id": list(range(len(asked))), "e": asked.tolist()})
    lists = lambda m: vectors._matrix(pa.array(m.tolist()))
    records, unit = rng.permutation(n), lists(base)
    got = pa.Table.from_batches(vectors._best_of(part, records, unit, unit.astype(np.float32), 3)).to_pylist()
    distance = np.round(1 - lists(asked) @ unit.T, 9)
    for q, d in enumerate(distance):
        want = np.lexsort((records, d))[:3]
        mine = [r for r in got if r["query_id"] == q]
        assert [r["record"] for r in mine] == records[want].tolist() and np.allclose([r["distance"] for r in mine], d[want], atol=2e-9)


def test_vectors_and_fragments_are_handed_over_in_small_batches(spark):
    for begin in (lambda: embed(spark.range(600).select(F.concat(F.lit("a b w"), "id").alias("text")), "text").count(), lambda: tables.register(spark)):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        begin()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    rows = embed(spark.range(600).select("id", F.concat(F.lit("a b w"), "id").alias("text")), "text").collect()
    assert len(rows) == 600 and all(np.array_equal(r.embedding, hashed_vector(r.text)) for r in rows)


def test_pairs_of_queries_and_documents_are_not_shuffled(spark):
    from lodestone.operators import retrieval

    docs, queries = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string"), spark.createDataFrame([(7, "b a")], "query_id long, text string")
    found = retrieval.bm25(docs, queries, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(query_id" in plan
    assert not [line for line in plan.splitlines() if "hashpartitioning(query_id" in line and "doc_id" in line]
    assert [(r.doc_id, r["rank"]) for r in found.orderBy("rank").collect()] == [(1, 1), (2, 2)]
