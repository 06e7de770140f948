"""The tokenization automaton against the tokenizers library, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from swathkit.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
CODEC = bpe.codec(bpe.vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_text(library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = library.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text).tolist() == ids
    assert CODEC.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_hard_texts(library):
    rng = random.Random(4)
    texts = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "x" * 5000, " " * 3000, "\n\n \t a", "it's we'll I'd", " 　x", "日本語テキスト", "👩‍👩‍👧‍👦", "1234567890" * 30, "\x00\x01"]
    texts += ["".join(rng.choice("abcdefg hijTHE'sz.\n") for _ in range(400)) for _ in range(100)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert CODEC.encode(t).tolist() == ids and CODEC.decode(ids) == t


def test_whole_table(spark, data, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op3_bpe(spark, data).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "n"), (2, "", "n"), (None, "hi there", "n"), (3, "a" * 200_000, "n"), (3, "a" * 200_000, "n")], "doc_id long, text string, n_tokens string")
    got = bpe.encode(df, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] == len(r["ids"]), r["decoded"][:8]) for r in got) == [(0, True, "hi there"), (1, True, ""), (2, True, ""), (3, True, "a" * 8), (3, True, "a" * 8)]
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0


def test_long_documents_come_in_parts(spark, monkeypatch):
    """One batch of 2,000 long documents is told in several record batches, whole, and the memory of words is bounded."""
    words = [f"w{k} " for k in range(4000)]
    rows = [(k, "".join(random.Random(k).choices(words, k=800))) for k in range(2000)]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH)
    texts = dict(rows)
    sizes = []
    for r in got.toLocalIterator():
        assert r["decoded"] == texts.pop(r["doc_id"]) and len(r["ids"]) == r["n_tokens"]
        sizes.append(r["n_tokens"])
    assert not texts and sum(sizes) > bpe.FLUSH_TOKENS
    monkeypatch.setattr(bpe, "CACHE_BYTES", 100_000)
    known = bpe.Memory(CODEC._word)
    for w in words:
        assert known[w].tolist() == CODEC.automaton.encode_word(w.encode())
    assert len(known) + len(known.old) < 2 * 100_000 / bpe.ENTRY_BYTES + 2
