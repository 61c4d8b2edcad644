"""Every query of the subpackage over odd tables and empty ones."""

import pytest

from lodestone.llm.queries import QUERIES

ODD = [
    (1, "plain words that say nothing much " * 12, "en", "src1", 1), (1, "plain words that say nothing much " * 12, "en", "src1", 1), (None, "plain words that say nothing much " * 12, None, None, None),
    (2, None, "en", "src2", None), (3, "", None, "src3", 0), (4, "\n\t ", "de", None, 3), (5, "x" * 100_000, "fr", "a/b", 100_000), (6, "word " * 20_000, "es", "src4", 5), (7, "Released under the MIT License.\nidiot scum", "en", "src0", 9),
    (8, "🙂 é <|endoftext|> ### | !!", "en", "src0", 9), (2**62, "far id", "en", "src0", 9), (-5, "negative id", "en", "src0", 9),
]


def write(spark, folder, keep):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'clash' AS score", "1 AS n_tokens", "'x' AS host", "2 AS label", "'y' AS id", "0 AS key")
    tables = {
        "documents": docs, "labels": spark.createDataFrame([(1, 1, 0), (1, 0, 1), (7, 0, 1), (None, 1, 1), (8, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int").selectExpr("*", "'z' AS text", "0 AS y"),
        "benchmark": spark.createDataFrame([(1, "plain words"), (1, "plain words"), (None, "word"), (3, None), (4, "")], "item_id long, text string").selectExpr("*", "'i' AS item"),
        "embeddings": spark.createDataFrame([(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, None, 1), (200, [0.5], None), (7, [float("nan")], 1), (3, [1.0, None], 2), (None, [1.0], 2), (5, [], 1), (6, [1.1, 2.0], 2), (8, [1.0, 2.0, 9.0], 1)], "vec_id long, embedding array<float>, label int").selectExpr("*", "'c' AS id", "0 AS rank", "1 AS block"),
        "conversations": spark.createDataFrame([(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, None, None), (None, 1, "assistant", "x"), (2, 2**62, "", "y"), (3, 0, "system", "z" * 100_000 + "!")], "conv_id long, turn long, role string, text string").selectExpr("*", "'t' AS there", "0 AS conv", "1 AS cost"),
        "pages": spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None), (2, ""), (3, "x://" + "a." * 200 + "org/fr/" + "b/" * 200)], "page_id long, url string").selectExpr("*", "'v' AS verdict", "'r' AS rule", "'' AS html"),
    }
    for name, df in tables.items():
        (df if keep else df.limit(0)).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    odd, empty = str(tmp_path_factory.mktemp("odd")), str(tmp_path_factory.mktemp("empty"))
    write(spark, odd, True)
    write(spark, empty, False)
    return odd, empty


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty_tables(name, spark, folders):
    odd, empty = folders
    rows = QUERIES[name](spark, odd).collect()
    # the anchor 0 has label 2 then, its one positive is 6, and 8 is near that
    assert len(rows) == {"op8_url_filters": 5, "op12_hard_negatives": 1, "op13_turn_repair": 4}.get(name, len(ODD))
    assert not QUERIES[name](spark, empty).collect()
    again = QUERIES[name](spark, odd).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_pipeline_over_odd_and_empty_tables(spark, folders):
    pipeline = pytest.importorskip("corpus_pipeline")
    odd, empty = folders
    assert not pipeline.run(spark, empty).collect()
    assert len(pipeline.run(spark, odd).collect()) <= len(ODD)
