"""Importance resampling: composed CRCs against those of spelled-out n-grams, all rows against a plain version, edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from swathkit.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, most):
    words = words_of(text)
    return [zlib.crc32(" ".join(words[k : k + n]).encode()) for n in range(1, most + 1) for k in range(len(words) - n + 1)]


def plain(docs, target, most=1, buckets=10_000, least=20, percent=10):
    s, t = (Counter(f % buckets for text in texts for f in features(text, most)) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = features(text, most)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x % buckets] for x in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab9é漢"), min_size=1, max_size=70), max_size=9), st.integers(1, 5))
def test_crcs_are_composed(words, most):
    text = " ,".join(words)
    got = [int(x) for run in importance.ngram_crcs(*importance.Words().of(text.encode()), most, importance.Shifts()) for x in run]
    assert got == features(text, most)


def test_words_are_split_at_any_length(monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 7)
    monkeypatch.setattr(importance, "KNOWN_BYTES", 300)
    text = "Ünder A-Z Words, " + "x" * 9000 + " 12\x007é… " + "long9" * 3
    crcs, lengths = importance.Words().of(text.encode())
    assert crcs.tolist() == [zlib.crc32(w.encode()) for w in words_of(text)] and lengths.tolist() == [len(w.encode()) for w in words_of(text)]


def test_shift_of_long_words():
    a, lengths = np.array([zlib.crc32(b"head"), 5, 0], np.uint32), np.array([100_000, 1, 0])
    got = importance.Shifts()(a, lengths)
    assert int(got[0]) ^ zlib.crc32(b"t" * 100_000) == zlib.crc32(b"head" + b"t" * 100_000) and got[2] == 0


ROWS = [(k, f"common words number {k % 7} " + "benchmark passage alpha " * (k % 5 + 1) + "filler text here " * (k % 3 + 1)) for k in range(120)]
ROWS += [(200, None), (201, ""), (202, "..."), (3, ROWS[3][1]), (3, ROWS[3][1]), (None, "w " * 40), (203, "ALPHA beta " * 30_000)]
TARGET = ["benchmark passage alpha", None, "", "alpha alpha beta"]


@pytest.mark.parametrize("most", [1, 3])
def test_rows_equal_the_plain_version(spark, most):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, rank string, bucket int")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.resample(docs, target, most=most, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(ROWS, TARGET, most, percent=30)))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(ROWS[:30], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert sorted(map(tuple, importance.resample(some, none).collect()), key=repr) == sorted(plain(ROWS[:30], []), key=repr)


def test_query_over_the_table(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").select("text").collect()]
    got = queries.op12_importance_resampling(spark, data).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(docs, target), key=repr)
