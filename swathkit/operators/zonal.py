"""Zonal statistics, label statistics and accuracy metrics: partial aggregation on small keys, then joins with class tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import storage


def _all():
    """One window over all rows: only ever over one row for each class."""
    return Window.partitionBy()


def landcover(df: DataFrame, code: str, classes: DataFrame, cell_area: float = 0.04) -> DataFrame:
    """code, n_pixels, proportion (%), surface_ha and the class's attributes; null cells count for nothing."""
    n = df.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n_pixels"))
    shares = n.select("code", "n_pixels", F.round(F.col("n_pixels") * 100.0 / F.sum("n_pixels").over(_all()), 2).alias("proportion"), F.round(F.col("n_pixels") * F.lit(cell_area) / 10000, 4).alias("surface_ha"))
    return shares.join(classes, "code", "left")


def zonal(df: DataFrame, code: str, value: str, digits: int = 1) -> DataFrame:
    """code, v_mean, v_min, v_max, v_sd, n of a value by class, over cells where both are known."""
    known = df.where(F.col(code).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(F.col(code).alias("code")).agg(*[F.round(f(value), digits).alias(n) for n, f in (("v_mean", F.avg), ("v_min", F.min), ("v_max", F.max), ("v_sd", F.stddev_samp))], F.count(F.lit(1)).alias("n"))


BINS = 4096


def quantiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """group, q: the exact quantiles of a value in each group, between neighbours by linear interpolation.

    Each wanted rank is closed in by counting: the values between the ends of its interval are counted in ``BINS`` bins,
    and the bin that holds the rank, from its least to its greatest value, is the next interval, until both are one value. A
    task holds no group; a round shuffles at most ``BINS`` counts for each interval and task, and a dozen rounds
    tell any two doubles apart. ``df`` is read once a round, so it should be a table, or cheap. Rows with a null group, or a
    value that is null or no number, take no part; a group without others has no row.
    """
    v = F.col(value).cast("double")
    known = df.where(F.col(group).isNotNull() & v.isNotNull() & ~F.isnan(v)).select(F.col(group).alias("g"), v.alias("v"))
    size = storage.written(known.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "sizes")
    at = F.explode(F.array(*[F.lit(float(p)) for p in shares]))
    wanted = size.select("g", "n", "low", "high", at.alias("p")).withColumn("at", (F.col("n") - 1) * F.col("p"))
    ranks = F.explode(F.array(F.floor("at"), F.ceil("at")))
    state = storage.written(wanted.select("g", ranks.alias("k"), "low", "high", F.lit(0).cast("long").alias("below")).distinct(), "ranks")
    while not (open_ := state.where("low < high")).isEmpty():
        intervals = open_.select("g", "low", "high").distinct()
        width = F.col("high") - F.col("low")
        place = F.when(width < float("inf"), (F.col("v") - F.col("low")) / width).otherwise((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2))
        inside = known.join(intervals, "g").where(F.col("v").between(F.col("low"), F.col("high")))
        counted = inside.groupBy("g", "low", "high", F.least(F.floor(place * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("c").over(Window.partitionBy("g", "low", "high").orderBy("bin")) - F.col("c")
        chosen = open_.join(counted.withColumn("before", before), ["g", "low", "high"]).withColumn("before", F.col("below") + F.col("before"))
        chosen = chosen.where((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("c"))).select("g", "k", F.col("least").alias("low"), F.col("most").alias("high"), F.col("before").alias("below"))
        state = storage.written(state.where("low = high").unionByName(chosen), "ranks")
    found = state.select("g", "k", F.col("low").alias("x"))
    ends = wanted.select("g", "p", "at", F.floor("at").alias("k")).join(found, ["g", "k"]).withColumnRenamed("x", "a").withColumn("k", F.ceil("at")).join(found, ["g", "k"])
    part = F.col("at") - F.floor("at")
    q = F.when(part == 0, F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("x"))
    return ends.groupBy(F.col("g").alias(group)).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", q.alias("q")))), lambda e: e["q"]).alias("q"))


def quartiles(df: DataFrame, code: str, value: str) -> DataFrame:
    """code, q1, q2, q3 and the class's place by median (ties by code)."""
    q = quantiles(df, code, value, [0.25, 0.5, 0.75]).select(F.col(code).alias("code"), *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)])
    return q.withColumn("place", F.row_number().over(Window.orderBy("q2", "code")))  # one row a class


def confusion(df: DataFrame, ref: str, pred: str, n_classes: int) -> DataFrame:
    """ref, pred, n over cells where both are known and in 0..n_classes-1."""
    inside = F.col(ref).between(0, n_classes - 1) & F.col(pred).between(0, n_classes - 1)
    return df.where(inside).groupBy(F.col(ref).alias("ref"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_totals(spark, matrix: DataFrame, n_classes: int) -> DataFrame:
    """code, tp, n_ref, n_pred for every class, from a confusion table."""
    long = matrix.select(F.explode(F.array(F.struct(F.col("ref").alias("code"), F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("r"), F.lit(0).cast("long").alias("p")), F.struct(F.col("pred").alias("code"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("r"), F.col("n").alias("p")))).alias("x")).select("x.*")
    sums = long.groupBy("code").agg(F.sum("tp").alias("tp"), F.sum("r").alias("n_ref"), F.sum("p").alias("n_pred"))
    return spark.range(n_classes).select(F.col("id").cast("int").alias("code")).join(sums, "code", "left").na.fill(0, ["tp", "n_ref", "n_pred"])


def iou_raster(totals: DataFrame) -> DataFrame:
    """code, iou (null for a class in neither), accuracy and m_iou (mean over the classes that occur)."""
    union = F.col("n_ref") + F.col("n_pred") - F.col("tp")
    iou = totals.withColumn("iou", F.when(union > 0, F.col("tp") / union))
    return iou.select("code", F.round(F.col("iou") * 100, 2).alias("iou_pct"), F.round(F.sum("tp").over(_all()) / F.sum("n_ref").over(_all()), 6).alias("accuracy"), F.round(F.avg("iou").over(_all()), 6).alias("m_iou"))


def iou_segmentation(totals: DataFrame) -> DataFrame:
    """code, iou (0 for a class in neither, which counts) and m_iou."""
    iou = F.col("tp") / F.greatest(F.col("n_ref") + F.col("n_pred") - F.col("tp"), F.lit(1))
    return totals.select("code", F.round(iou, 6).alias("iou"), F.round(F.avg(iou).over(_all()), 6).alias("m_iou"))


def f1_macro(totals: DataFrame) -> DataFrame:
    """The mean F1 of the classes that are predicted and present with some hit; 0 if there are none."""
    p, r = F.col("tp") / F.nullif("n_pred", F.lit(0)), F.col("tp") / F.nullif("n_ref", F.lit(0))
    f1 = F.when((F.col("n_pred") > 0) & (F.col("n_ref") > 0) & (F.col("tp") > 0), 2 * p * r / (p + r))
    return totals.agg(F.round(F.coalesce(F.avg(f1), F.lit(0.0)), 6).alias("f1_macro"))


def balanced_accuracy(df: DataFrame, ref: str, pred: str) -> DataFrame:
    """The mean recall over the classes that occur as labels."""
    recall = df.where(F.col(ref).isNotNull()).groupBy(ref).agg(F.avg(F.coalesce((F.col(ref) == F.col(pred)).cast("double"), F.lit(0.0))).alias("recall"))
    return recall.agg(F.round(F.avg("recall"), 6).alias("balanced_accuracy"))


def class_weights(spark, counts: DataFrame, n_classes: int, how: str, clamp: float = 20.0) -> DataFrame:
    """code, weight from (code, n). inverse: 1 / n, summing to the number of classes; balanced: total / (classes * n), 1 for
    an absent class, summing likewise; clamped: total / (classes * n), at most ``clamp``. An absent class counts as 1."""
    w = spark.range(n_classes).select(F.col("id").cast("int").alias("code")).join(counts, "code", "left").na.fill(0, ["n"])
    total, seen = F.sum("n").over(_all()), F.greatest("n", F.lit(1))
    raw = {"inverse": F.lit(1.0) / seen, "balanced": F.when(F.col("n") > 0, total / (n_classes * F.col("n"))).otherwise(1.0), "clamped": F.least(F.lit(clamp), total / (n_classes * seen))}[how]
    w = w.withColumn("raw", raw)
    weight = F.col("raw") if how == "clamped" else F.col("raw") / F.sum("raw").over(_all()) * n_classes
    return w.select("code", F.round(weight, 6).alias("weight"))


def share(n: Column, by: list[str] | None = None) -> Column:
    return n / F.sum(n).over(Window.partitionBy(*(by or [])))
