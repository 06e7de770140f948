"""Language-model scoring with a log-bilinear model, trained in numpy by noise-contrastive estimation.

Corpus statistics are exact: every training token is counted and shuffled by itself. The commonest ``HEAD`` tokens are
broadcast with their counts (a fixed bound); counts of all others reach the documents by a shuffled join on their
64-bit hashes.

The model predicts one of ``SYMBOLS`` symbols from the two before it: the commonest words (and the end of a text) have
a symbol of their own, all other words share ``BUCKETS`` symbols by their first and last characters, and inside a
bucket a word has its share of add-one counts, with one unseen word in each. The score of symbol ``w`` after ``v``
and ``u`` is ``A[v].Q[w] + B[u].Q[w] + b[w]``. Each partition of the corpus trains a copy on all its training
texts (shared noise words, AdaGrad); the copies are averaged, each symbol's rows by how often a copy met it, in two
levels of groups. Training runs ``ROUNDS`` rounds from the averages.

Scores are normalised exactly: with ``exp(A Q' + b)`` and ``exp(B Q')`` as matrices, one batched product gives the sum
over all symbols for every pair of context symbols, so a token's log-probability takes three table lookups.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HEAD = 1 << 18
SYMBOLS = 2048
BUCKETS = 256
WIDTH = 32
ROUNDS = 1
BATCH = 1024
NOISE = 64
RATE = 0.15
LEAST_TARGETS = 2_000_000
MOST_PASSES = 5
BLOCKS = 16
END = b""

_HASH_SEED = 42  # of Spark's xxhash64


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and the end."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def bucket_of(token: bytes) -> int:
    return zlib.crc32(token[:1] + token[-2:]) % BUCKETS


def in_training(parts: int = 7, left_out: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts != left_out, F.lit(True))


def token_counts(docs: DataFrame) -> DataFrame:
    """token (binary), c for all rows of ``docs``; each Arrow batch is counted before the shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            count: Counter = Counter()
            for text in batch.column(0):
                count.update(tokens(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["token", "c"])

    return docs.select("text").mapInArrow(batches, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The head of the counts, and the symbol of every token."""

    def __init__(self, head: list[tuple[bytes, int]], mass: dict[int, float], total: int, distinct: int):
        words = [x for x in head if x[0] != END][: SYMBOLS - BUCKETS - 1]
        own = {END: 0} | {w: k + 1 for k, (w, _) in enumerate(words)}
        counts = dict(head)
        counts.setdefault(END, 0)
        self.index = {w: k for k, w in enumerate(counts)}
        self.symbol = np.array([own.get(w, SYMBOLS - BUCKETS + bucket_of(w)) for w in counts], np.int32)
        self.log_c = np.log10(np.array([c + 1.0 for c in counts.values()]))
        self.known = np.array([c > 0 for c in counts.values()])
        self.total, self.distinct = total, distinct
        self.log_mass = np.array([math.log10(mass.get(b, 0.0) + 1.0) for b in range(BUCKETS)])
        frequency = np.ones(SYMBOLS)
        for w, k in own.items():
            frequency[k] = counts.get(w, 0) + 1.0
        for b in range(BUCKETS):
            frequency[SYMBOLS - BUCKETS + b] = mass.get(b, 0.0) + 1.0
        self.share = frequency / frequency.sum()

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The head number (-1: not in the head) and the symbol of each word; the words that aren't in the head."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        symbol = self.symbol[at]
        out = np.flatnonzero(at < 0)
        rest = [words[k] for k in out]
        if rest:
            crc, low = zlib.crc32, SYMBOLS - BUCKETS
            symbol[out] = [low + crc(w[:1] + w[-2:]) % BUCKETS for w in rest]
        return at, symbol, rest


def learn_counts(training: DataFrame, head: int = HEAD) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and a table of all counts (token, c, h: Spark's 64-bit hash of the token)."""
    counts = common.materialize(token_counts(training).withColumn("h", F.xxhash64("token")))
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    by_count = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    least = by_count.select("c", F.sum("n").over(_falling()).alias("above")).where(F.col("above") <= head).agg(F.min("c")).first()[0]
    top = sorted(((bytes(r["token"]), r["c"]) for r in counts.where(F.col("c") >= (least if least is not None else 1 << 62)).select("token", "c").collect()), key=lambda x: (-x[1], x[0]))
    own = {w for w, _ in [x for x in top if x[0] != END][: SYMBOLS - BUCKETS - 1]} | {END}
    first = F.concat(F.substring("token", 1, 1), F.expr("CASE WHEN length(token) < 2 THEN token ELSE substring(token, -2, 2) END"))
    all_mass = counts.groupBy((F.crc32(first) % BUCKETS).alias("b")).agg(F.sum(F.col("c") + 1).alias("m")).collect()
    mass = {r["b"]: float(r["m"]) for r in all_mass}
    for w, c in top:
        if w in own:
            mass[bucket_of(w)] = mass.get(bucket_of(w), 0.0) - (c + 1)
    return Vocabulary(top, mass, total or 0, distinct), counts


def _falling():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)


def start_model(share: np.ndarray, seed: int = 9) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: (rng.normal(size=(SYMBOLS, WIDTH)) * 0.15).astype(np.float32)
    return {"A": draw(), "B": draw(), "Q": draw(), "b": np.log(share).astype(np.float32)[:, None]}


class Trainer:
    """Noise-contrastive estimation on streams of symbols."""

    def __init__(self, model: dict[str, np.ndarray], share: np.ndarray, seed: int, rate: float):
        self.m = {k: v.copy() for k, v in model.items()}
        self.square = {k: np.full((SYMBOLS, 1), 0.01, np.float32) for k in model}
        self.rng = np.random.default_rng(seed)
        self.cumulative = np.cumsum(share)
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.seen = np.zeros(SYMBOLS)
        self.rate = rate

    def _add(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        """One AdaGrad step on the rows of a table, gradients of a row summed first."""
        order = np.argsort(rows.astype(np.int16), kind="stable")
        sorted_rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
        own = sorted_rows[first]
        g = np.add.reduceat(grad[order], first)
        self.square[name][own] += (g**2).mean(1, keepdims=True)
        self.m[name][own] += self.rate * g / np.sqrt(self.square[name][own])

    def learn(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        """Contexts (two before, one before) and targets; few targets are gone through several times."""
        self.seen += np.bincount(w, minlength=SYMBOLS)
        order = np.concatenate([self.rng.permutation(len(w)) for _ in range(max(1, min(MOST_PASSES, LEAST_TARGETS // len(w))))])
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            x, y, z = u[own], v[own], w[own]
            noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), SYMBOLS - 1)
            m = self.m
            h, q, qn = m["A"][y] + m["B"][x], m["Q"][z], m["Q"][noise]
            good = 1 / (1 + np.exp(np.clip((h * q).sum(1) + m["b"][z, 0] - self.log_noise[z], -30, 30)))
            bad = -1 / (1 + np.exp(-np.clip(h @ qn.T + (m["b"][noise, 0] - self.log_noise[noise]), -30, 30)))
            dh = good[:, None] * q + bad @ qn
            rows = np.concatenate([z, noise])
            self._add("Q", rows, np.concatenate([good[:, None] * h, bad.T @ h]))
            self._add("b", rows, np.concatenate([good, bad.sum(0)])[:, None])
            self._add("A", y, dh)
            self._add("B", x, dh)


def streams(texts, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and targets of texts; before a text stand two ends."""
    parts = [vocabulary.look_up(tokens(t.as_py()))[1] for t in texts]
    w = np.concatenate(parts)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]
    v = np.concatenate([[0], w[:-1]])
    v[starts] = 0
    u = np.concatenate([[0], v[:-1]])
    u[starts] = 0
    return u, v, w


def train_round(training: DataFrame, vocabulary, model: dict[str, np.ndarray], share: np.ndarray, round_: int) -> dict[str, np.ndarray]:
    """One pass over all training texts: copies by partition, averaged by symbol."""
    spark = training.sparkSession
    fan = max(1, math.isqrt(training.rdd.getNumPartitions()))
    start = spark.sparkContext.broadcast(model)
    size = SYMBOLS // BLOCKS
    names = list(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        trainer = Trainer(start.value, share, part + 1000 * round_, RATE / (1 + round_))
        for batch in it:
            if len(batch):
                trainer.learn(*streams(batch.column(0), vocabulary.value))
        if trainer.seen.any():
            rows = np.concatenate([trainer.m[k] for k in names], axis=1)
            blocks = [slice(k * size, (k + 1) * size) for k in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([part % fan] * BLOCKS, pa.int32()), pa.array([trainer.seen[s].tobytes() for s in blocks], pa.binary()), pa.array([rows[s].astype(np.float32).tobytes() for s in blocks], pa.binary())],
                names=["block", "part", "seen", "model"],
            )

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, total = np.zeros(size), np.zeros((size, 3 * WIDTH + 1))
        for s, m in zip(pdf["seen"], pdf["model"]):
            s = np.frombuffer(s) + 1e-3
            seen += s
            total += s[:, None] * np.frombuffer(m, np.float32).reshape(size, -1)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [0], "seen": [seen.tobytes()], "model": [(total / seen[:, None]).astype(np.float32).tobytes()]})

    schema = "block int, part int, seen binary, model binary"
    copies = training.select("text").mapInArrow(batches, schema)
    means = copies.groupBy("block", "part").applyInPandas(average, schema).groupBy("block").applyInPandas(average, schema)
    got = {r["block"]: r["model"] for r in means.collect()}
    if not got:
        return model
    rows = np.concatenate([np.frombuffer(got[k], np.float32).reshape(size, -1) for k in range(BLOCKS)])
    cuts = np.cumsum([model[k].shape[1] for k in names])[:-1]
    return {k: x.copy() for k, x in zip(names, np.split(rows, cuts, axis=1))}


_tables: dict[int, tuple] = {}


def log_tables(model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores after the last symbol, after the one before it, biases and the normaliser for each pair (natural logs)."""
    one, two, b = model["A"] @ model["Q"].T, model["B"] @ model["Q"].T, model["b"][:, 0]
    top1, top2 = (one + b).max(1, keepdims=True), two.max(1, keepdims=True)
    z = np.log(np.exp(one + b - top1) @ np.exp(two - top2).T) + top1 + top2.T
    return one, two, b, z


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Null texts count as empty: one token, the end. A null doc_id belongs to the training rows. Repeated rows repeat.
    Without training rows every count is 0.
    """
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    training = docs.where(in_training())
    vocabulary, counts = learn_counts(training)
    share = vocabulary.share
    held = spark.sparkContext.broadcast(vocabulary)
    model = start_model(share)
    for r in range(ROUNDS):
        model = train_round(training, held, model, share, r)
    ready = spark.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = held.value
        one, two, bias, z = log_tables(ready.value)
        low, log10e = SYMBOLS - BUCKETS, math.log10(math.e)
        for batch in it:
            n, known, base, score, tail_h, tail_n = [], [], [], [], [], []
            for text in batch.column(1):
                at, w, rest = voc.look_up(tokens(text.as_py()))
                v = np.concatenate([[0], w[:-1]])
                u = np.concatenate([[0], v[:-1]])
                lm = (one[v, w] + two[u, w] + bias[w] - z[v, u]).sum(dtype=np.float64) * log10e
                inside = at >= 0
                log_c = voc.log_c[at[inside]]
                shared = w >= low
                lm += log_c[shared[inside]].sum() - voc.log_mass[w[shared] - low].sum()
                count = Counter(rest)
                n.append(len(w))
                known.append(int(voc.known[at[inside]].sum()))
                base.append(float(log_c.sum()))
                score.append(float(lm))
                tail_h.append(np.array([xxhash.xxh64_intdigest(t, _HASH_SEED) for t in count], np.uint64).view(np.int64))
                tail_n.append(np.fromiter(count.values(), np.int32, len(count)))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in tail_h])]).astype(np.int32))
            flat = lambda parts, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts).astype(kind)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score), flat(tail_h, np.int64), flat(tail_n, np.int32)],
                names=["doc_id", "row_id", "n_tokens", "n_known", "base", "score", "tail_h", "tail_n"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    first = docs.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(batches, f"doc_id {id_type}, row_id long, n_tokens long, n_known long, base double, score double, tail_h array<long>, tail_n array<int>")
    first = common.materialize(first)
    tail = first.select("row_id", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("t")).select("row_id", F.col("t.tail_h").alias("h"), F.col("t.tail_n").alias("n"))
    found = tail.join(counts.select("h", "c"), "h").groupBy("row_id").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("log_c"))
    log_all = math.log10(vocabulary.total + vocabulary.distinct + 1)
    log_c = F.coalesce("log_c", F.lit(0.0))
    return first.join(found, "row_id", "left").select(
        "doc_id", (~in_training()).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base") + log_c - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), (F.col("score") + log_c).alias("score"),
    )
