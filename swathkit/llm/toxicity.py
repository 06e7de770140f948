"""Toxic spans and document scores by a linear-chain conditional random field.

The field has two states (clean, toxic) over the tokens of a text; a token speaks through its word and its leading
characters, so a word that was never seen still counts by its stem. Labels come for whole documents. On a bounded
sample of labelled rows (``SAMPLE_BYTES`` of text, as labels occur), a token of a toxic document is labelled toxic if
its word or stem is significantly commoner in toxic documents (a G test on document counts); all others are clean.
Weights are trained on these tokens by AdaGrad with gradients from forward-backward. Marginals of a text are summed up
to its largest and their sum, which a logistic curve, fitted on the part of the sample that the field has not seen,
turns into the score. Scoring reads whole texts in Arrow batches and shuffles nothing.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_BYTES = 16 << 20
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 19
STEMS = (3, 4, 5, 6, 7)
SIGNIFICANCE = 18.0
EPOCHS = 3
CHUNK_TOKENS = 400_000
WORD_CACHE = 300_000

_EDGE = "".join(chr(c) for c in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), *range(161, 192), *range(0x2010, 0x2040)])


def features(word: str) -> tuple[int, ...]:
    """The hashed features of a token: its word without outer punctuation, and its leading characters."""
    bare = word.strip(_EDGE)
    n, h = len(bare), xxhash.xxh32_intdigest
    return (h(bare, 1) % BUCKETS, *[h(bare[:k], 2) % BUCKETS for k in STEMS if n > k])


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Ragged:
    """Token arrays of several texts laid out by position: texts by falling length, so those still open are a prefix."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        n = lengths[self.order]
        longest = int(n[0]) if len(n) else 0
        self.open = np.searchsorted(-n, -np.arange(longest), side="left")
        self.base = np.concatenate([[0], np.cumsum(self.open)]).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        rank = np.repeat(np.argsort(self.order, kind="stable"), lengths)
        position = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
        self.at = self.base[position] + rank  # where each token, in reading order, is kept
        self.last = n - 1

    def steps(self) -> Iterator[tuple[int, int, int]]:
        for t in range(len(self.open)):
            yield t, int(self.base[t]), int(self.open[t])


def forward_backward(x: np.ndarray, lengths: np.ndarray, jump: np.ndarray, pairs: bool = False):
    """Marginals of the toxic state for every token, in reading order; with ``pairs``, also the summed pair marginals.

    ``x``: log-odds of each token; ``jump``: 2 x 2 log weights of state changes.
    """
    lay = Ragged(lengths)
    e = np.empty(len(x))
    e[lay.at] = np.exp(np.clip(x, -30, 30))
    (t00, t01), (t10, t11) = np.exp(jump)
    a = np.empty(len(x))  # forward probability of toxic
    p = None
    for t, at, n in lay.steps():
        if t == 0:
            one, zero = e[at : at + n], np.ones(n)
        else:
            p = p[:n]
            one, zero = e[at : at + n] * (t01 + p * (t11 - t01)), t00 + p * (t10 - t00)
        p = one / (one + zero)
        a[at : at + n] = p
    m = np.empty(len(x))
    total = np.zeros((2, 2))
    b = np.empty(0)  # backward probability of toxic, of the texts that are open
    for t in range(len(lay.open) - 1, -1, -1):
        at, n = int(lay.base[t]), int(lay.open[t])
        now = np.full(n, 0.5)
        if len(b):
            k = len(b)
            nxt = e[lay.base[t + 1] : lay.base[t + 1] + k] * b
            rest = 1 - b
            one, zero = t10 * rest + t11 * nxt, t00 * rest + t01 * nxt
            now[:k] = one / (one + zero)
            if pairs:
                q = a[at : at + k]
                w = np.stack([(1 - q) * t00 * rest, (1 - q) * t01 * nxt, q * t10 * rest, q * t11 * nxt])
                total += (w / w.sum(0)).sum(1).reshape(2, 2)
        q = a[at : at + n]
        one, zero = q * now, (1 - q) * (1 - now)
        m[at : at + n] = one / (one + zero)
        b = now
    marginals = m[lay.at]
    return (marginals, total) if pairs else marginals


@dataclass
class Field:
    """Weights of features, of state changes, and of the curve from marginals to a score."""

    weights: np.ndarray
    bias: float
    jump: np.ndarray
    curve: np.ndarray

    def __post_init__(self):
        self.plain = array("f", self.weights.astype(np.float32))

    def log_odds(self, word: str) -> float:
        return self.bias + sum([self.plain[f] for f in features(word)])

    def curve_input(self, marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """1, the log-odds of the largest marginal, and the log of one plus their sum; those of an empty text are of a clean one."""
        out = np.tile([1.0, -8.0, 0.0], (len(lengths), 1))
        ends = np.cumsum(lengths)
        full = np.flatnonzero(lengths)
        if len(full):
            top = np.clip(np.maximum.reduceat(marginals, (ends - lengths)[full]), 0.000335, 1 - 0.000335)
            out[full, 1] = np.log(top / (1 - top))
            out[full, 2] = np.log1p(np.add.reduceat(marginals, (ends - lengths)[full]))
        return out

    def scores(self, marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve_input(marginals, lengths) @ self.curve)))


def fit(texts: list[str], toxic: list[int], seed: int = 3) -> Field:
    """Train on labelled texts; with one label only, every score is that label's share."""
    y_doc = np.array(toxic, np.int64)
    share = (y_doc.sum() + 0.5) / (len(y_doc) + 1)
    if not len(y_doc) or y_doc.min() == y_doc.max():
        return Field(np.zeros(BUCKETS, np.float32), -8.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0]))
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in tokens(t)], np.int64) for t in texts]
    own = [features(w) for w in number]
    of_word = np.repeat(np.arange(len(own)), [len(x) for x in own])
    feature = np.array([f for x in own for f in x], np.int64)
    begins = np.concatenate([[0], np.cumsum([len(x) for x in own])])[:-1]
    held = rng.random(len(docs)) < 0.25 if len(docs) >= 40 else np.zeros(len(docs), bool)
    train = np.flatnonzero(~held)

    # Labelled tokens: significance of features by documents.
    count = np.zeros((2, BUCKETS))
    for d in train:
        words = np.unique(docs[d])
        mark = np.isin(of_word, words) if len(words) > 5000 else None
        f = np.unique(feature[mark]) if mark is not None else np.unique(np.concatenate([feature[begins[w] : begins[w] + len(own[w])] for w in words])) if len(words) else np.zeros(0, np.int64)
        count[y_doc[d], f] += 1
    n1 = max(1, y_doc[train].sum())
    prior = n1 / len(train)
    both = count.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (count[1] * np.log(count[1] / (both * prior)) + np.where(count[0] > 0, count[0] * np.log(count[0] / (both * (1 - prior))), 0))
    odds = (count[1] + 0.5) / (n1 + 1) / ((count[0] + 0.5) / (len(train) - n1 + 1))
    telling = (np.nan_to_num(g) >= SIGNIFICANCE) & (odds >= 6)
    word_telling = np.bitwise_or.reduceat(telling[feature], begins) if len(own) else np.zeros(0, bool)

    # Weights.
    weights, jump, bias = np.zeros(BUCKETS), np.zeros((2, 2)), -4.0
    square, jump_square, bias_square = np.full(BUCKETS, 1e-6), np.full((2, 2), 1e-6), 1e-6
    by_length = train[np.argsort([len(docs[d]) for d in train], kind="stable")]
    batches = [x for k in range(0, len(by_length), 48) if len(x := [d for d in by_length[k : k + 48] if len(docs[d])])]
    for epoch in range(EPOCHS):
        for k in rng.permutation(len(batches)):
            chosen = batches[k]
            lengths = np.array([len(docs[d]) for d in chosen])
            words = np.concatenate([docs[d] for d in chosen])
            label = word_telling[words] & np.repeat(y_doc[chosen] == 1, lengths)
            used, back = np.unique(words, return_inverse=True)
            x = np.add.reduceat(weights[feature], begins)[used][back] + bias if len(used) > len(own) // 4 else np.array([weights[feature[begins[w] : begins[w] + len(own[w])]].sum() for w in used])[back] + bias
            marginals, expected = forward_backward(x, lengths, jump, pairs=True)
            slope = label - marginals
            per_word = np.bincount(back, slope, len(used))
            sizes = np.array([len(own[w]) for w in used])
            f = np.concatenate([feature[begins[w] : begins[w] + len(own[w])] for w in used])
            grad = np.bincount(f, np.repeat(per_word, sizes), BUCKETS) - 1e-4 * weights
            square += grad**2
            weights += 0.5 * grad / np.sqrt(square)
            bias_square += slope.sum() ** 2
            bias += 0.5 * slope.sum() / np.sqrt(bias_square)
            inner = np.ones(len(words), bool)
            inner[np.cumsum(lengths) - 1] = False
            seen = np.bincount(2 * label[:-1][inner[:-1]].astype(int) + label[1:][inner[:-1]], minlength=4).reshape(2, 2)
            slope2 = seen - expected
            jump_square += slope2**2
            jump += 0.1 * slope2 / np.sqrt(jump_square)
    field = Field(weights.astype(np.float32), float(bias), jump, np.array([-4.0, 1.0, 0.0]))

    # The curve.
    used = np.flatnonzero(held) if held.any() and len(set(y_doc[held])) == 2 else np.arange(len(docs))
    per_word = np.add.reduceat(field.weights[feature].astype(np.float64), begins) + bias if len(own) else np.zeros(0)
    rows = []
    for k in range(0, len(used), 256):
        part = used[k : k + 256]
        lengths = np.array([len(docs[d]) for d in part])
        words = np.concatenate([docs[d] for d in part]) if len(part) else np.zeros(0, np.int64)
        rows.append(field.curve_input(forward_backward(per_word[words], lengths, jump), lengths))
    z, y, c = np.concatenate(rows), y_doc[used], field.curve
    ridge, middle = np.array([1e-3, 0.02, 0.02]), np.array([0, 0.5, 0.5])
    loss = lambda c: np.logaddexp(0, -(2 * y - 1) * (z @ c)).sum() + (ridge * (c - middle) ** 2).sum() / 2
    for _ in range(60):  # Newton's method, with shorter steps where they don't help
        p = 1 / (1 + np.exp(-(z @ c)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * (c - middle))
        while np.abs(step).max() > 1e-6 and loss(c + step) > loss(c):
            step = step / 2
        c = c + step
    field.curve = c
    return field


def labelled_sample(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_bytes: int = SAMPLE_BYTES, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample: ids by a hash, as long as the bytes of their texts fit.

    Of an id with several texts the shortest counts, of equally short ones the first in order, so no id brings more
    than one row to the driver, however often it is repeated; of several labels the toxic one counts. Rows without an id, or
    with a label other than 0 and 1, take no part; null texts count as empty. Without labelled rows both lists are empty.
    """
    known = labels.select(labels[id_col].alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(train)
    texts = docs.select(docs[id_col].alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sized = texts.groupBy("doc_id").agg(F.min(F.octet_length("text")).alias("bytes")).join(known, "doc_id")
    chosen = sized.orderBy(F.xxhash64("doc_id"), "bytes").limit(sample_rows).collect()
    ids, room = set(), sample_bytes
    for r in chosen:
        if r["bytes"] <= room:
            room -= r["bytes"]
            ids.add(r["doc_id"])
    toxic = {r["doc_id"]: r["toxic"] for r in chosen}
    if not ids:
        return [], []
    few = docs.sparkSession.createDataFrame([(i,) for i in ids], texts.select("doc_id").schema)
    shortest = F.min(F.struct(F.octet_length("text").alias("bytes"), "text"))["text"]
    got = {r["doc_id"]: r["text"] for r in texts.join(F.broadcast(few), "doc_id", "left_semi").groupBy("doc_id").agg(shortest.alias("text")).collect()}
    order = sorted(got)
    return [got[i] for i in order], [toxic[i] for i in order]


def is_held_out(parts: int = 5):
    """Whether a row's label must not be learnt from: CRC-32 of its doc_id as text leaves no remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, **names) -> Field:
    return fit(*labelled_sample(docs, labels, ~is_held_out(), **names))


class _Odds(dict):
    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, word: str) -> float:
        if len(self) >= WORD_CACHE:
            self.clear()
        found = self[word] = self.field.log_odds(word)
        return found


def tag(docs: DataFrame, field: Field, text_col: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with toxicity (double) and, if asked for, toxic_spans: character offsets of tokens whose marginal is at least half.

    Null texts count as empty and get the score of a text without toxic tokens. All columns are kept, but for those
    of the new names, which are replaced.
    """
    columns = [c for c in docs.columns if c not in ("toxicity", "toxic_spans")]
    docs = docs.select(columns)
    common.by_bytes(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(field)
    at = columns.index(text_col)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        model = held.value
        odds = _Odds(model)
        for batch in it:
            lengths, parts = np.zeros(len(batch), np.int64), []
            for k, text in enumerate(batch.column(at)):
                words = tokens(text.as_py())
                lengths[k] = len(words)
                parts.append(np.fromiter(map(odds.__getitem__, words), np.float32, len(words)))
            score = np.empty(len(batch))
            found: list = [[] for _ in range(len(batch) * spans)]
            order, start, size = np.argsort(-lengths, kind="stable"), 0, 0
            for k in range(len(order)):
                size += lengths[order[k]]
                if size >= CHUNK_TOKENS or k == len(order) - 1:
                    own = order[start : k + 1]
                    m = forward_backward(np.concatenate([parts[d] for d in own]).astype(np.float64), lengths[own], model.jump)
                    score[own] = model.scores(m, lengths[own])
                    if spans:
                        starts = np.concatenate([[0], np.cumsum(lengths[own])])
                        for hit in np.flatnonzero(m >= 0.5):
                            d = int(np.searchsorted(starts, hit, side="right") - 1)
                            found[own[d]].append(int(hit - starts[d]))
                    start, size = k + 1, 0
            new = [pa.array(score)]
            if spans:
                for d, hits in enumerate(found):
                    if hits:
                        places = [x.span() for x in re.finditer(r"\S+", batch.column(at)[d].as_py())]
                        found[d] = [{"start": places[h][0], "end": places[h][1]} for h in hits if h < len(places)]
                new.append(pa.array(found, span_type))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*columns, "toxicity", *["toxic_spans"] * spans])
            del parts, found, new, batch  # not held while the next batch is awaited
        odds.clear()
        common.give_back()

    schema = docs.withColumn("toxicity", F.lit(0.0)).schema
    if spans:
        schema = docs.selectExpr("*", "cast(0 AS double) AS toxicity", "cast(NULL AS array<struct<start: int, end: int>>) AS toxic_spans").schema
    return docs.mapInArrow(batches, schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; the field learns from labels of rows not held out.

    Null texts count as empty, a null id is not held out, repeated rows are scored each, an empty table gives no rows; without
    labels every text gets the same score. Other columns are ignored.
    """
    field = train(docs, labels)
    rows = tag(docs.select("doc_id", "text"), field, spans=False)
    return rows.select("doc_id", is_held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those whose score is at least half; all columns stay. Nulls, repeated rows and empty tables as in ``score``."""
    field = train(docs, labels)
    return tag(docs, field, spans=False).where("toxicity < 0.5").select(docs.columns)
