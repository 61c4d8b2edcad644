import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators.embedding import hashed_vector, model_id, token_hash, words
from lodestone.sources.extract import normalized


def values(spark, f, rows, kind="string"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, v {kind}")
    return [r.o for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def test_normalize_agrees_with_python(spark):
    spaces = "".join(map(chr, [9, 11, 12, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    texts = ["a  \r\nb\r\n\r\n\r\n\r\nc\x00\n\n", f"x{spaces}\ny{spaces}", "é\r\rz", "", "\n\n", " a", "é \n\n\n\ń", None]
    assert values(spark, S.normalize_text, texts) == [t if t is None else normalized(t) for t in texts]


def test_media_types(spark):
    names = ["a.md", "b.MARKDOWN", "c.txt", "d.html", "e.HTM", "f.pdf", "g.exe", ".md", "md", "x/y.v1.txt"]
    md, txt, html = "text/markdown", "text/plain", "text/html"
    assert values(spark, S.media_type, names) == [md, md, txt, html, html, "application/pdf", None, None, None, txt]


def test_safe_filenames(spark):
    assert values(spark, S.safe_filename, ["a\\b\\c.md", "/x/y/", "", "z" * 600, "p.txt"]) == ["c.md", "y", "document", "z" * 512, "p.txt"]


def test_collection_names(spark):
    f = lambda c: S.collection_name(c, F.lit(model_id(256)))
    assert values(spark, f, ["OS 2026/27", "--a--", "łą"]) == ["OS-2026-27--hashing-bow-256", "a----hashing-bow-256", "hashing-bow-256"]
    assert values(spark, lambda c: S.collection_name(c, F.lit("")), ["a"]) == ["col-a-x"]


def test_document_types_and_topics(spark):
    assert values(spark, S.document_type, ["L1_Tutorial_X.md", "L1_Sample_Task_1.md", "Test_Task_2.md", "L0_Introduction.md"]) == ["tutorial", "sample_task", "test_task", "lab_task"]
    assert values(spark, S.topic_line, ["x\n*Topic:  Pipes and FIFOs *  \ny", "no topic", "*Topic: a*b*"]) == ["Pipes and FIFOs", None, "a*b"]


def test_json_merge(spark):
    f = lambda c: S.json_merge(c, F.lit('{"b": null, "c": [1]}'))
    got = values(spark, f, ['{"a": 1, "b": 2}', None])
    assert got[0] == '{"a":1,"b":null,"c":[1]}' and got[1] == '{"b":null,"c":[1]}'


def test_request_ids_and_statuses(spark):
    got = values(spark, lambda c: S.request_id(c, F.lit("x")), ["ok_-1", "bad id", "a" * 65, None])
    assert got[0] == "ok_-1" and all(len(g) == 20 and g.startswith("req_") for g in got[1:])
    assert values(spark, S.http_status, ["NOT_FOUND", "EMBEDDING_FAILED", "x"]) == [404, 502, 400]


def test_embedding_text_and_tokens(spark):
    df = spark.createDataFrame([(["A", "B"], "t"), ([], "u"), (None, "v")], "p array<string>, c string")
    assert [r.o for r in df.select(S.embedding_text(F.col("p"), F.col("c")).alias("o")).collect()] == ["A > B\n\nt", "u", "v"]
    assert values(spark, S.tokens, ["Ćma x_1 - 22"]) == [["ćma", "x_1", "22"]]


@pytest.mark.parametrize("token, value", [("mutex", 6154955811550567704), ("pipe", 4814430497980130154), ("semaphore", 2948783508604524428), ("żółć", 249135343502042546)])
def test_token_hashes(token, value):
    assert token_hash(token) == value


def test_hashed_vectors():
    v = hashed_vector("mutex mutex pipe", 256)
    assert abs(float(v @ v) - 1) < 1e-12 and v[24] < 0 and v[106] < 0 and v[24] < v[106]
    assert not hashed_vector("", 16).any() and not hashed_vector(None, 16).any()
    positive = next(w for w in map(str, range(99)) if token_hash(w) >> 63)
    assert hashed_vector(positive, 64).max() == 1.0


def test_seconds_between(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS a, timestamp'2024-01-01 00:00:01.5' AS b, cast(null AS timestamp) AS n")
    row = df.select(S.seconds_between(F.col("a"), F.col("b")).alias("x"), S.seconds_between(F.col("a"), F.col("n")).alias("y")).first()
    assert (row.x, row.y) == (1.5, None)


def test_words_of_ascii_texts_are_those_of_others():
    for text in ("".join(map(chr, range(128))), "One two_2\tTHREE\x1cfour\n-", ""):
        assert words(text) == words(text + " é")[: -1] == [w.lower() for w in re.findall(r"\w+", text)]
    assert words("İx ΣΑΣ") == ["i̇x", "σας"]
