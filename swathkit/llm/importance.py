"""Target-distribution importance resampling over hashed n-grams, with CRC combination algebra.

An n-gram's bucket is the CRC-32 of its words joined by spaces. Each word's CRC is computed once; a longer n-gram's is
composed from that of the shorter one and the next word's: appending k bytes is a linear map of the CRC register over GF(2), a
32 x 32 bit matrix that depends on k alone, and the maps of 1, 2, 4, ... bytes are squares of one another. So no n-gram is
ever spelled out, and a run of n words costs two table-driven maps, whatever its length.

Two passes over the documents: bucket counts (summed in each task before the only shuffle, of at most ``buckets`` rows a task),
then weights. The table of gains has ``buckets`` numbers and is the only broadcast. The draw needs the order of the scores:
rows of four numbers are sorted by ranges (``operators.ranking``), so no task holds them all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranking
from . import common

BUCKETS = 10_000
MOST_BUCKETS = 1 << 20
CHUNK = 1 << 20
KNOWN_BYTES = 16 << 20
POLYNOMIAL = 0xEDB88320

#: A-Z become a-z, bytes that are in no word become spaces; all bytes of other than ASCII characters are in words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _image(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


class Shifts:
    """What appending zero bytes does to CRCs: for 1, 2, 4, ... bytes a matrix, as four tables of 256 images."""

    def __init__(self):
        bit = [POLYNOMIAL, *(1 << k for k in range(31))]  # one zero bit
        for _ in range(3):
            bit = [_image(bit, c) for c in bit]
        self._matrix, self.tables = bit, []

    def table(self, k: int) -> np.ndarray:
        """The tables of 2 ** k bytes."""
        while len(self.tables) <= k:
            m = self._matrix
            self.tables.append(np.array([[_image(m, byte << (8 * place)) for byte in range(256)] for place in range(4)], np.uint32))
            self._matrix = [_image(m, c) for c in m]
        return self.tables[k]

    def __call__(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The CRCs after so many zero bytes each, less those of the zeros themselves."""
        out, k, most = crcs.copy(), 0, int(lengths.max(initial=0))
        while most >> k:
            hit = np.flatnonzero((lengths >> k) & 1)
            if len(hit):
                t, c = self.table(k), out[hit]
                out[hit] = t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]
            k += 1
        return out


class Words(dict):
    """CRCs of words, computed once; what is held is bounded in bytes."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        crc = zlib.crc32(word)
        if self.held > KNOWN_BYTES:
            self.clear()
            self.held = 0
        self.held += len(word) + 100
        self[word] = crc
        return crc

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """CRC and length of each word of a text, which is split a chunk at a time, between words."""
        crcs, lengths, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while at < len(text):
            end = at + CHUNK
            part = text[at:end].translate(_FOLD)
            while end < len(text) and part[-1] != 32:  # to the end of the word that is cut
                more = text[end : end + 4096].translate(_FOLD)
                space = more.find(b" ")
                part += more if space < 0 else more[: space + 1]
                end += len(more) if space < 0 else space + 1
            words = part.split()
            crcs.append(np.fromiter(map(self.__getitem__, words), np.uint32, len(words)))
            lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
            at = end
        return np.concatenate(crcs), np.concatenate(lengths)


def ngram_crcs(crcs: np.ndarray, lengths: np.ndarray, most: int, shifts: Shifts) -> Iterator[np.ndarray]:
    """For n = 1 to ``most``, the CRC-32 of every run of n words joined by one space, composed from the words' CRCs."""
    run = crcs
    yield run
    if most > 1:
        after_space = shifts(np.full(len(crcs), zlib.crc32(b" "), np.uint32), lengths) ^ crcs  # of a space and the word
    for n in range(2, most + 1):
        if len(run) < 2:
            return
        run = shifts(run[:-1], lengths[n - 1 :] + 1) ^ after_space[n - 1 :]
        yield run


def _check(most: int, buckets: int) -> None:
    if most < 1 or not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"at least one word a run and 1 to {MOST_BUCKETS} buckets")


def bucket_counts(df: DataFrame, text_col: str = "text", most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n of all runs of 1 to ``most`` words of a table of texts; buckets without a run are left out, null texts have none."""
    _check(most, buckets)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words, shifts = np.zeros(buckets, np.int64), Words(), Shifts()
        for batch in it:
            for text in batch.column(0).cast(pa.binary()):
                for crcs in ngram_crcs(*words.of(text.as_py() or b""), most, shifts):
                    total += np.bincount(crcs % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])
        common.give_back()

    counted = df.select(df[text_col].cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket floor(1000 ln of how much commoner it is in the target), smoothed by one; from bucket counts."""
    spark = source.sparkSession
    totals = [df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] for df in (source, target)]
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") + 1.0 for c in ("s", "t"))
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    ratio = t * F.lit(float(totals[0] + buckets)) / (s * F.lit(float(totals[1] + buckets)))
    out = np.zeros(buckets, np.int64)
    for row in both.select("bucket", F.floor(F.log(ratio) * 1000.0).alias("gain")).collect():  # as many rows as buckets
        out[row["bucket"]] = row["gain"]
    return out


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of the gains of all its runs) of each row; without words all are 0."""
    kept = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    id_type, buckets = kept.schema["doc_id"].dataType.simpleString(), len(gain)
    _check(most, buckets)
    shipped = docs.sparkSession.sparkContext.broadcast(gain.tobytes())

    def weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words, shifts = np.frombuffer(shipped.value, np.int64), Words(), Shifts()
        for batch in it:
            n_words, n, total = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                crcs, lengths = words.of(text.as_py() or b"")
                runs = [(len(run), int(table[run % buckets].sum())) for run in ngram_crcs(crcs, lengths, most, shifts)]
                n_words.append(len(crcs))
                n.append(sum(x for x, _ in runs))
                total.append(sum(x for _, x in runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n, total))], names=["doc_id", "n_words", "n_features", "weight"])
        common.give_back()

    return kept.mapInArrow(weigh, f"doc_id {id_type}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", *, most: int = 1, buckets: int = BUCKETS, seed: int | str = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row: rank 1, 2, ... for those drawn, null for the others.

    The score is the weight plus 1000 times a Gumbel variate that the id decides, rounded down, so the highest scores are
    a sample without replacement in proportion to exp(weight / 1000). Of the N rows with at least ``least_words`` words,
    floor(``percent`` * N / 100) are drawn; ties go to smaller ids, a null id comes first and is written as nothing in the
    hash. Null and empty texts have no features and weight 0. Repeated rows count, weigh and are drawn each. An empty
    table gives no rows, an empty target makes every gain that of a uniform one. Other columns are ignored.
    """
    source_n, target_n = (common.materialize(bucket_counts(df, c, most, buckets)) for df, c in ((docs, text_col), (target, target_col)))
    gain = gains(source_n, target_n, buckets)
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.log(-F.log((hashed + 0.5) / 4294967296.0)) * -1000.0)
    rows = common.materialize(weights(docs, gain, id_col, text_col, most).withColumn("score", F.col("weight") + gumbel))
    common.discard(source_n, target_n)
    fit = rows.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    placed = ranking.numbered(fit, [F.desc("score"), F.asc_nulls_first("doc_id")], "rank", common.materialize)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = placed.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
