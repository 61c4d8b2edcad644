"""The word encoder against the tokenizers library."""

import hashlib
import random
import re

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lodestone.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def texts():
    rng = random.Random(4)
    vocab = list(Tokenizer.from_file(PATH).get_vocab())
    out = [None, "", " \n\t\x0b\x85\xa0　 ", "<|endoftext|>", "a<|startoftext|><|endoftext|> b<|endoftex", "<|ENDOFTEXT|>", "\x00<|endoftext|>", "\x00a \x01\x1c\x1f", "I'LL they've 'S ''d don’t", "ΑΣ ΣΣ Σ İI ǅ ß ẞ", "é ́ Å Å ﬁ ² ½ Ⅷ ٣", "x" * 30_000, "abab" * 5_000, "zażółć🙂 " * 50]
    out += ["".join(t.replace("</w>", " ") for t in rng.choices(vocab, k=40)) for _ in range(200)]
    out += ["".join(rng.choices("aabcdeeehilnorstt' .!?0123ÄéßñçΣσςжЯ中カ가🙂\ǹ", k=rng.randint(1, 300))) for _ in range(400)]
    out += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0x3000), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(60)) for _ in range(300)]
    return out


def test_equals_the_library(library):
    own = word_bpe.WordCodec(PATH)
    for text in texts():
        want = library.encode(text or "", add_special_tokens=False).ids
        assert own.encode(text) == want, text[:100]
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)
        assert own.digests([text]) == [(len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(own.decode(want).encode()).hexdigest())]
    assert own.failed and own.held > own.failed


def test_verification_is_needed_and_right(library):
    """Words for which the longest tokens are not those of merging, and all pairs of tokens of some words."""
    own = word_bpe.WordCodec(PATH)
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghilmnoprstuvy", k=rng.randint(1, 14))) for _ in range(20_000)]
    assert own.ids(words) == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert 1_000 < own.failed < 19_000
    assert own.exact(own.inner[list(b"")].tolist()) == []


def test_every_sure_character(library):
    """Python and the library normalise and cut the characters of ``_SURE`` alike."""
    own = word_bpe.WordCodec(PATH)
    sure = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not word_bpe._UNSURE.match(chr(c))]
    assert len(sure) > 30_000
    for c in sure:
        text = f"A{c}B!{c}1 {c}́"
        assert own.words(text) == [w for w, _ in own.cut(own.normalized(text))], hex(ord(c))


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in word_bpe.round_trip(docs, PATH).collect()}
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(rows) == len(table)
    for r in table:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert tuple(rows[r["doc_id"]])[1:] == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    some = docs.limit(30)
    coded = word_bpe.encode(some, PATH)
    assert {r.doc_id: r.ids for r in coded.collect()} == {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in some.collect()}
    decoded = {r.doc_id: r.decoded for r in word_bpe.decode(coded, PATH).collect()}
    assert all(re.sub("</w>| ", "", decoded[r.doc_id]) for r in some.collect() if r.text.strip())


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="supported"):
        word_bpe.WordCodec(public_tokenizers.path("byte_bpe_50k.json"))
