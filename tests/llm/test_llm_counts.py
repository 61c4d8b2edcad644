"""Token counts, byte-level BPE and URL filters against the libraries and by hand."""

import base64
import hashlib
import random
import time

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe
from lodestone.llm.queries import ORACLES, QUERIES, RULES
from lodestone.llm.token_counts import MergeCounter, token_counts
from lodestone.llm.url_filters import url_verdicts

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "\n\n  x", "a<|endoftext|>b <|endoftext|>", "aaaa" * 500, "ab" * 999, "don't we'll I'M", "日本語 🙂 é e\u0301", "\u00a0\u2003x\u3000", "x" * 20000, "1234 5678 9", "a" * 7 + "\t\r\n" * 9]


def texts(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab eaAtht'sé ñ日🙂\n\t 12<|>.") for _ in range(rng.randint(0, 90))) for _ in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, t, "clash", 1) for k, t in enumerate(ODD + texts(100))] + [(None, "no id", "clash", 2), (3, "again", "clash", 3), (3, "again", "clash", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library():
    own, lib = MergeCounter(JSON), library()
    every = [t or "" for t in ODD] + texts()
    assert own.count(every) == [len(e.ids) for e in lib.encode_batch(every, add_special_tokens=False)]


def test_counts_of_rows(frame):
    lib = library()
    got = token_counts(frame, JSON, limit=20).collect()
    rows = frame.collect()
    assert len(got) == len(rows)
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((g.doc_id is None, g.doc_id or 0, g.n_bytes, g.n_tokens) for g in got) == want
    assert all(g.over_limit == (g.n_tokens > 20) for g in got)
    assert token_counts(frame.limit(0), JSON).count() == 0


def test_unsupported_files_are_refused():
    with pytest.raises(ValueError):
        MergeCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_round_trip(frame):
    lib = tiktoken_encoding()
    got = byte_bpe.round_trip(frame, RANKS, public_tokenizers.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in frame.collect():
        ids = lib.encode_ordinary(r.text or "")
        want.append((r.doc_id is None, r.doc_id or 0, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert sorted((g.doc_id is None, g.doc_id or 0, g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in got) == sorted(want)


def test_encode_offsets_and_decode(frame):
    coded = byte_bpe.encode(frame.where("doc_id < 60"), RANKS, public_tokenizers.PATTERN)
    lib = tiktoken_encoding()
    texts_ = {r.doc_id: r.text or "" for r in frame.where("doc_id < 60").collect()}
    for r in coded.collect():
        if r.doc_id == 3:
            continue
        text = texts_[r.doc_id]
        assert list(r.ids) == lib.encode_ordinary(text)
        for i, a, b in zip(r.ids, r.starts, r.ends, strict=True):
            assert 0 <= a < b <= len(text)
            assert lib.decode_single_token_bytes(i) in text[a:b].encode()
    back = {r.doc_id: (bytes(r.decoded), r.decoded_text) for r in byte_bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect() if r.doc_id != 3}
    assert all(back[k] == (t.encode(), t) for k, t in texts_.items() if k != 3)


def test_split_characters_decode_to_bytes(spark):
    own = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    half = own.encode("🙂")[0][:1]
    row = byte_bpe.decode(spark.createDataFrame([(1, half)], "doc_id long, ids array<int>"), RANKS, public_tokenizers.PATTERN).first()
    assert bytes(row.decoded) == own.decode(half) and "\ufffd" in row.decoded_text


URLS = [
    ("https://a.example.net/en/1", "allow", "example.net/en/"), ("https://a.example.net/fr/1", "block", "net/"), ("http://EXAMPLE.NET/en/?q", "allow", "example.net/en/"),
    ("http://notexample.net/en/", "block", "net/"), ("http://x.org/fr/a", "allow", "org/fr/"), ("http://x.org/fr", "allow", None), ("http://x.net", "allow", None),
    ("http://x.net?a=/", "allow", None), ("http://example.com/de/", "block", "example.com/de/"), ("http://example.com/DE/", "allow", None), ("no scheme", "allow", None),
    (None, "allow", None), ("", "allow", None), ("x://", "allow", None), ("http://h/a://b.net/", "allow", None), ("http://.net/x", "block", "net/"), ("http://a..net//", "block", "net/"),
    ("http://" + "a." * 300 + "net/" + "b/" * 300, "block", "net/"),
]


def test_url_verdicts(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, u, "clash", "clash", "u") for k, (u, _, _) in enumerate(URLS)] + [(0, URLS[0][0], "x", "y", "z")], "page_id long, url string, host string, verdict string, u string")
    got = url_verdicts(pages, rules).collect()
    assert len(got) == len(URLS) + 1
    assert [(r.verdict, r.rule) for r in sorted(got, key=lambda r: r.page_id)][1:] == [(v, r) for _, v, r in URLS]
    assert url_verdicts(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_verdicts(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_block_wins_between_equal_rules(spark):
    rules = spark.createDataFrame([("a", "/", "allow"), ("A", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    assert url_verdicts(spark.createDataFrame([("x://a/",)], "url string"), rules).first().verdict == "block"


def test_any_path_and_long_urls(spark):
    rules = spark.createDataFrame([("a.net", "/ab", "block"), ("net", "", "block"), ("b.a.net", "/abc/d", "allow"), ("a", ".net/x", "block"), ("", "/", "block"), ("x.org", None, "block")], "host string, path string, verdict string")
    urls = ["h://a.net/abz", "h://b.a.net/abc/de", "h://b.a.net/abc", "h://c.net", "h://net/", "h://x.org/", "h://a/.net/x", "h://a.net/" + "/" * 100_000, "h://" + "a." * 50_000 + "a.net/ab" + "/" * 50_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    got = {r.page_id: r.rule for r in url_verdicts(df, rules).collect()}
    assert got == {0: "a.net/ab", 1: "b.a.net/abc/d", 2: "a.net/ab", 3: "net", 4: "net", 5: None, 6: None, 7: "net", 8: "a.net/ab"}
    assert time.time() - began < 30


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(9)
    name = lambda n: ".".join(rng.choice(["a", "b", "net"]) for _ in range(rng.randint(1, n)))
    rules = list({(name(3), rng.choice(["", "/", "/a", "/a/", "/ab", "/a/b/"])): rng.choice(["block", "allow"]) for _ in range(25)}.items())
    urls = [f"s://{name(4)}/{''.join(rng.choice('ab/') for _ in range(rng.randint(0, 6)))}" for _ in range(300)]
    got = {r.url: (r.rule, r.verdict) for r in url_verdicts(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string")).collect()}
    for u in urls:
        host, path = u[4:].split("/", 1)
        fit = [(len(h + p), h + p, v) for (h, p), v in rules if ("." + host).endswith("." + h) and ("/" + path).startswith(p)]
        assert got[u] == (max(fit)[1:] if fit else (None, "allow")), u


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()[list(want.columns)]
    rows = lambda f: sorted(tuple(map(str, r)) for r in f.astype(object).where(f.notna(), None).values.tolist())
    assert rows(got) == rows(want)


def test_remainders_are_crc32(spark):
    import zlib

    df = spark.range(50).select(F.crc32(F.col("id").cast("string").cast("binary")).alias("c"), "id")
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in df.collect())


def test_many_shapes_of_rules(spark):
    """5,000 rules of 1,000 shapes against trying each, and in about the time that a few rules take."""
    rng = random.Random(9)
    name = lambda n: ".".join(rng.choice(["a", "b", "net"]) for _ in range(n))
    path = lambda n: "/" + "".join(rng.choice("ab") for _ in range(n))
    rules = {(name(1 + k % 5), path(k // 5 % 200)): rng.choice(["allow", "block"]) for k in range(5000)}
    assert len({(h.count("."), len(p)) for h, p in rules}) == 1000
    urls = [f"s://{name(rng.randint(1, 6))}{path(rng.randint(0, 250))}" for _ in range(200)]
    urls += [f"s://x.{h}{p}{path(3)}" for h, p in rng.sample(sorted(rules), 200)]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    as_rules = lambda chosen: spark.createDataFrame([(h, p, v) for (h, p), v in chosen], "host string, path string, verdict string")

    def timed(chosen):
        began = time.monotonic()
        return {r.url: r.rule for r in url_verdicts(frame, as_rules(chosen)).collect()}, time.monotonic() - began

    few = list(rules.items())[:4]
    timed(few)
    _, short = timed(few)
    got, long = timed(list(rules.items()))
    for u in urls:
        host, _, rest = u[4:].partition("/")
        fits = [h + p for h, p in rules if ("/" + rest).startswith(p) and f".{host}".endswith(f".{h}")]
        assert got[u] == max(fits, key=lambda r: (len(r), r), default=None)
    assert long < 2 * short + 5
