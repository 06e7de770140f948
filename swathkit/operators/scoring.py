"""The model boundary: scores in, classes out; and what is done with overlapping scores.

Models run in Arrow batches behind ``Scorer``: anything with ``predict(array of patches) -> array of scores``. A linear
head in numpy ships with the library; other frameworks plug in the same way and load once in a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Scorer(Protocol):
    def predict(self, patches: np.ndarray) -> np.ndarray:
        """Class scores (n, classes) or (n, classes, cells) of patches (n, values)."""


class LinearHead:
    """scores = weights . values + bias."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = np.asarray(weights, float), np.asarray(bias, float)

    def predict(self, patches: np.ndarray) -> np.ndarray:
        return patches @ self.weights.T + self.bias


def argmax(scores: Column | str) -> Column:
    """The place (from 0) of the largest score, the first one of equals."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def softmax(scores: Column | str) -> Column:
    s = F.col(scores) if isinstance(scores, str) else scores
    top = F.array_max(s)
    raised = F.transform(s, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def linear_head(values: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """A linear head as a column expression: one dot product for each class."""
    rows = [F.aggregate(F.zip_with(values, F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) + F.lit(float(c)) for w, c in zip(weights, bias)]
    return F.array(*rows)


def predict_patches(patches: DataFrame, make: Callable[[], Scorer], batch: int = 16, id_col: str = "patch_id", data_col: str = "data") -> DataFrame:
    """patch_id, code, score: the class of the largest softmax for every patch, in batches of the model's size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in frames:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                scores = model.predict(np.stack(part[data_col].to_numpy()))
                p = np.exp(scores - scores.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "code": p.argmax(1).astype(np.int32), "score": p.max(1)})

    return patches.select(id_col, data_col).mapInPandas(run, f"{id_col} long, code int, score double")


def predict_multimodal(patches: DataFrame, make: Callable[[], Scorer], batch: int = 16) -> DataFrame:
    """As ``predict_patches`` for rows of (patch_id, modality, data): modalities that not every patch has are left out, the rest concatenated by name."""
    total = patches.select("patch_id").distinct().count()
    kept = patches.groupBy("modality").agg(F.countDistinct("patch_id").alias("n")).where(F.col("n") == total).select("modality")
    rows = patches.join(kept, "modality", "left_semi").groupBy("patch_id").agg(F.array_sort(F.collect_list(F.struct("modality", "data"))).alias("m"))
    return predict_patches(rows.select("patch_id", F.flatten(F.transform("m", lambda x: x["data"])).alias("data")), make, batch)


def predict_cells(patches: DataFrame, make: Callable[[], Scorer], width: int, batch: int = 256) -> DataFrame:
    """patch_id, r, c, code, p: the class map of every patch and the largest softmax of each cell; the model is asked once for ``batch`` patches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in frames:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                sizes = part["data"].map(len).to_numpy()
                scores = model.predict(np.concatenate(part["data"].to_numpy())[:, None])  # each cell is a sample of its own
                p = np.exp(scores - scores.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                at = np.arange(len(p)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pd.DataFrame({"patch_id": np.repeat(part["patch_id"].to_numpy(), sizes), "r": (at // width).astype(np.int32), "c": (at % width).astype(np.int32), "code": p.argmax(1).astype(np.int32), "p": p.max(1)})

    return patches.select("patch_id", "data").mapInPandas(run, "patch_id long, r int, c int, code int, p double")


def mosaic_best(df: DataFrame, cell: list[str], code: str, p: str, order: str) -> DataFrame:
    """Overlaps resolved: of each cell, the class of the surest patch, of equals the first one's. Any order of rows gives the same."""
    return df.groupBy(*cell).agg(F.max_by(code, F.struct(F.col(p), -F.col(order))).alias(code), F.max(p).alias(p))


def blend(df: DataFrame, cell: list[str], cls: str, p: str, w: str) -> DataFrame:
    """Overlaps blended: weighted mean score of each class, then the best class (ties: the lowest)."""
    mean = df.groupBy(*cell, cls).agg((F.sum(F.col(p) * F.col(w)) / F.greatest(F.sum(w), F.lit(1e-8))).alias("score"))
    return mean.groupBy(*cell).agg(F.max(F.struct("score", (-F.col(cls)).alias("k"))).alias("b")).select(*cell, (-F.col("b.k")).alias(cls), F.col("b.score").alias("score"))


def early_stop(df: DataFrame, run: str, epoch: str, metric: str, patience: int) -> DataFrame:
    """Adds best (so far before this epoch), improved and waited (epochs since the last gain), and stopped (waited reached patience by then)."""
    before = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("best", F.max(metric).over(before)).withColumn("improved", F.col("best").isNull() | (F.col(metric) > F.col("best")))
    out = out.withColumn("waited", F.col(epoch) - F.max(F.when(F.col("improved"), F.col(epoch))).over(upto))
    return out.withColumn("stopped", F.max("waited").over(upto) >= patience)


def best_prefix(names: DataFrame, wanted: DataFrame, prefixes: list[str]) -> DataFrame:
    """The prefix under which most names are wanted ones, of equals the first."""
    spark = names.sparkSession
    p = spark.createDataFrame(list(enumerate(prefixes)), "place int, prefix string")
    cut = names.join(F.broadcast(p), F.col("name").startswith(F.col("prefix"))).select("place", "prefix", F.expr("substring(name, length(prefix) + 1)").alias("name"))
    n = cut.join(wanted, "name", "left_semi").groupBy("place", "prefix").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "place").limit(1).select("prefix", "n")


def best_file(files: DataFrame, priority: tuple[str, ...] = ("ckpt", "pth", "pt", "bin", "safetensors")) -> DataFrame:
    """Of each model, the weight file of the first extension in the list; ties by name."""
    place = F.array_position(F.array(*[F.lit(x) for x in priority]), F.substring_index("file", ".", -1))
    w = Window.partitionBy("model").orderBy("_place", "file")
    return files.withColumn("_place", place).where("_place > 0").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("model", "file")
