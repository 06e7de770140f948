"""Benchmark decontamination with an FM-index for each training shard.

A task gathers its documents into shards of about ``SHARD_WORDS`` words. Of a shard, the runs of consecutive benchmark
words that are long enough for a test phrase are indexed (nothing else can hold one): suffixes are sorted by prefix
doubling, the Burrows-Wheeler transform goes into a wavelet matrix, and suffix positions are kept at every
``SAMPLE``-th place and at the start of each run. All test phrases are searched backwards at once through the ranks;
their occurrences are located by walking to a kept position; and their spans are merged for each document. Documents
are not shuffled.

The benchmark is split by a hash of the item id into blocks of at most about ``BLOCK_BYTES``, each broadcast on its
own; the documents pass the blocks one after another.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 8 << 20
SAMPLE = 16
SEARCHED = 1 << 18  # phrases at once

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z in lower case: runs of ASCII letters, digits and characters beyond ASCII."""
    return (text or "").encode().translate(_TABLE).split()


class Wavelet:
    """A wavelet matrix over small whole numbers: ``rank(c, i)`` counts ``c`` among the first ``i``, for arrays at once."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels = []
        for level in range(self.bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.zeros(len(bit) // 64 * 8 + 8, np.uint8)
            part = np.packbits(bit, bitorder="little")
            packed[: len(part)] = part
            blocks = packed.view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)])
            self.levels.append((blocks, before, len(bit) - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        blocks, before, _ = self.levels[level]
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[i >> 6] + np.bitwise_count(blocks[i >> 6] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        low = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            zeros = self.levels[level][2]
            one = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = self._ones(level, low), self._ones(level, i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low


class FMIndex:
    """An FM-index of runs of positive numbers, each run ended by a 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        order = self._sorted(text)
        self.bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.wavelet = Wavelet(self.bwt, sigma)
        start = np.concatenate([[True], text[:-1] == 0])
        held = start | (np.arange(n) % SAMPLE == 0)
        self.held = held[order]
        self.place = order

    @staticmethod
    def _sorted(text: np.ndarray) -> np.ndarray:
        """The suffixes in order; ends of runs differ from each other, so suffixes of different runs do too."""
        n = len(text)
        ends = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        step = 1
        order = np.argsort(rank, kind="stable")
        while True:
            sorted_rank = rank[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], sorted_rank[1:] != sorted_rank[:-1]]))
            if step > n or new[order[-1]] == n - 1:
                return order
            after = np.zeros(n, np.int64)
            after[: n - step] = new[step:] + 1
            rank = new * (n + 1) + after
            order = np.argsort(rank, kind="stable")
            step *= 2

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row of ``phrases``, by backward search."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.bwt), np.int64)
        live = np.arange(len(phrases))
        for at in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, at]
            low[live] = self.first[c] + self.wavelet.rank(c, low[live])
            high[live] = self.first[c] + self.wavelet.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffixes, by steps back to a kept position."""
        out = np.zeros(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            there = self.held[at]
            out[live[there]] = self.place[at[there]] + steps
            live, at = live[~there], at[~there]
            c = self.bwt[at]
            at = self.first[c] + self.wavelet.rank(c, at)
            steps += 1
        return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of true values begin and end."""
    padded = np.zeros(len(mask) + 2, np.int8)
    padded[1:-1] = mask
    edge = np.diff(padded)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Phrases:
    """The windows of a block of items, as numbers of words, by length: for each length the different windows, and the
    items of each between two offsets."""

    def __init__(self, items: list[tuple[str, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item, text in items:
            words = words_of(text)
            codes = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words))
            by_size[min(len(codes), WINDOW)].append((number[item], codes))
        self.by_length = [(length, *self._windows(length, by_size[length])) for length in sorted(by_size) if length]
        self.shortest = self.by_length[0][0] if self.by_length else 0

    @staticmethod
    def _windows(length: int, items: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(codes, length) for _, codes in items])
        owner = np.repeat(np.array([k for k, _ in items], np.int32), [len(codes) - length + 1 for _, codes in items])
        order = np.lexsort((owner, *windows.T))
        windows, owner = windows[order], owner[order]
        new = np.concatenate([[True], (windows[1:] != windows[:-1]).any(axis=1)])
        kept = new | np.concatenate([[True], owner[1:] != owner[:-1]])  # an item is told once for each window
        return windows[new], np.append(np.flatnonzero(new[kept]), kept.sum()), owner[kept]

    def codes_of(self, words: list[bytes]) -> np.ndarray:
        """The numbers of a document's words; 0 for words that no item has."""
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))

    def find(self, texts: list[np.ndarray]) -> list[tuple[list[tuple[int, int]], list[str]]]:
        """For each document of a shard, given by the numbers of its words, the merged spans of hit words (first, last + 1)
        and the items that occur."""
        out: list[tuple[list[tuple[int, int]], list[str]]] = [([], []) for _ in texts]
        lengths = np.array([len(x) for x in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        if not self.by_length or not lengths.sum():
            return out
        codes = np.zeros(starts[-1], np.int32)
        for x, at in zip(texts, starts):
            codes[at : at + len(x)] = x
        begin, end = runs(codes != 0)
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        if not len(begin):
            return out
        size = end - begin + 1  # with the 0 that ends a run
        shift = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        origin = np.arange(len(shift)) + shift
        text = codes[origin].astype(np.int64)
        index = FMIndex(text, len(self.vocabulary) + 1)
        hits: list[tuple[np.ndarray, int]] = []
        items_of: dict[int, set[int]] = defaultdict(set)
        for length, phrases, offset, owners in self.by_length:
            for base in range(0, len(phrases), SEARCHED):
                low, high = index.search(phrases[base : base + SEARCHED])
                count = high - low
                which = np.repeat(np.arange(len(low)), count)
                if not len(which):
                    continue
                rows = np.arange(len(which)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count) + low[which]
                at = origin[index.locate(rows)]
                hits.append((at, length))
                doc = np.searchsorted(starts, at, side="right") - 1
                for d, w in np.unique(np.stack([doc, which + base], 1), axis=0):
                    items_of[int(d)].update(owners[offset[w] : offset[w + 1]].tolist())
        if not hits:
            return out
        level = np.zeros(len(codes) + 1, np.int32)
        for at, length in hits:
            np.add.at(level, at, 1)
            np.add.at(level, at + length, -1)
        for a, b in zip(*runs(np.cumsum(level)[:-1] > 0)):
            d = int(np.searchsorted(starts, a, side="right") - 1)
            out[d][0].append((int(a - starts[d]), int(b - starts[d])))
        for d, found in items_of.items():
            out[d][1].extend(self.names[k] for k in sorted(found))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (and what lies between them)."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """The items in blocks of bounded size, each read when it is asked for, and whether it is the last one; items without
    id or text take no part. There is one block at least."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    if n > 1:  # written once, and read a block at a time
        items = common.materialize(items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")).repartition("block"))
    for k in range(n):
        yield [(r["item"], r["text"]) for r in (items.where(F.col("block") == k) if n > 1 else items).collect()], k == n - 1


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """The rows of ``docs`` with n_words, hit_spans (merged word offsets, end exclusive), hit_items (sorted ids); with
    ``cut``, instead of these three the texts without the hit spans.

    A null text has no words. Columns of those names in ``docs`` are replaced; all others are kept. Repeated rows
    are marked alike; an empty benchmark marks nothing. Blocks of the benchmark pass one after another, the documents
    being written between them, so that a task runs one search at a time.
    """
    spark = docs.sparkSession
    common.by_bytes(spark)
    kept = [c for c in docs.columns if c not in ("n_words", "hit_spans", "hit_items")]
    plain = docs.select(*kept).schema
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    docs = docs.select(*kept, F.lit(None).cast("long").alias("n_words"), F.array().cast(spans_type).alias("hit_spans"), F.array().cast("array<string>").alias("hit_items"))
    schema = docs.schema
    n = len(kept)
    for block, last in benchmark_blocks(benchmark, block_bytes=block_bytes):
        held, name = spark.sparkContext.broadcast(block), ("benchmark", uuid.uuid4().hex)

        def batches(it: Iterator[pa.RecordBatch], held=held, name=name, cut=cut and last) -> Iterator[pa.RecordBatch]:
            phrases = common.kept(name, lambda: Phrases(held.value))  # once in a worker, not in each of its tasks
            for batch in it:
                at = batch.schema.get_field_index(text_col)
                texts, start, size = [], 0, 0
                column = batch.column(at)
                for k in range(len(batch)):
                    texts.append(phrases.codes_of(words_of(column[k].as_py())))
                    size += len(texts[-1])
                    if size >= SHARD_WORDS or k == len(batch) - 1:
                        found = marked(batch.slice(start, k + 1 - start), texts, phrases)
                        yield cut_out(found, at) if cut else found
                        texts, start, size = [], k + 1, 0
                        del found
                del batch, column  # before the next is read
                common.give_back()

        def marked(batch: pa.RecordBatch, texts: list[np.ndarray], phrases: Phrases) -> pa.RecordBatch:
            spans, items = [], []
            for (s, i), old_s, old_i in zip(phrases.find(texts), batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist()):
                s = merged([*s, *((x["start"], x["end"]) for x in old_s)]) if old_s else s
                spans.append([{"start": a, "end": b} for a, b in s])
                items.append(sorted({*i, *old_i}))
            new = [pa.array([len(x) for x in texts], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([*batch.columns[:n], *new], names=batch.schema.names)

        def cut_out(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
            spans, texts = batch.column(n + 1), batch.column(at)
            if any(len(s) for s in spans):
                told = [without_spans(t.as_py(), [(x["start"], x["end"]) for x in s.as_py()]) if len(s) else t.as_py() for t, s in zip(texts, spans)]
                texts = pa.array(told, texts.type)
            return pa.RecordBatch.from_arrays([texts if k == at else batch.column(k) for k in range(n)], names=kept)

        docs = docs.mapInArrow(batches, plain if cut and last else schema)
        if not last:
            docs = common.materialize(docs)
    return docs


def leak_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``."""
    found = find_benchmark(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), benchmark)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the hit spans cut out of the texts; clean rows and all other columns stay as they are."""
    columns = docs.columns
    # Columns are numbered meanwhile, so that none is taken for one that the search adds.
    numbered = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    found = find_benchmark(numbered, benchmark, f"c{columns.index(text_col)}", cut=True)
    return found.toDF(*columns)


def brute_force(docs: list[tuple[object, str | None]], items: list[tuple[str, str]]) -> list[tuple]:
    """What ``leak_report`` must return, by comparing every window in turn; for tests."""
    windows: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - WINDOW + 1) if w else 0):
            windows[tuple(w[k : k + WINDOW])].add(str(item))
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
