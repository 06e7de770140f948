"""Class algebra: joins with class tables, reclassification, rule-based correction, label aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import BROADLEAF, CONIFER, LANDCOVER_LUT, NON_FOREST, TFV_PREFIXES


def join_class(df: DataFrame, classes: DataFrame, code: str = "code") -> DataFrame:
    """Attributes of a class table (fixed, under 30 rows); codes that it lacks keep their row, with nulls."""
    return df.join(classes, code, "left")


def forest_type_class(code: Column | str) -> Column:
    """Class of a forest-type code by its prefix, after trimming and upper-casing; any other code, or null, is non-forest."""
    tidy = F.upper(F.trim(F.col(code) if isinstance(code, str) else code))
    out = F.lit(NON_FOREST)
    for cls, prefixes in TFV_PREFIXES.items():
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | tidy.startswith(p)
        out = F.when(hit, F.lit(cls)).otherwise(out)
    return out


def landcover_code(output: Column | str, n_classes: int = 19) -> Column:
    """Land-cover code of a model output; models of 15 classes count from 1."""
    c = F.col(output) if isinstance(output, str) else output
    if n_classes == 15:
        return c + 1
    return F.get(F.array(*[F.lit(x) for x in LANDCOVER_LUT]), c)


def reindex_present(df: DataFrame, code: str) -> DataFrame:
    """code, position (from 1) of the codes that occur."""
    return df.select(code).where(F.col(code).isNotNull()).distinct().withColumn("position", F.dense_rank().over(Window.orderBy(code)))


def constrained(seg: Column, cover: Column, keep_unclassified: bool = False) -> Column:
    """A segmentation class corrected by land cover: no forest outside of the wooded covers, conifer cover turns
    broadleaf classes into pine, broadleaf cover turns conifer classes into other broadleaf."""
    wooded = (13, 14, 15, 0) if keep_unclassified else (13, 14, 15)
    return F.when(cover.isNotNull() & ~cover.isin(*wooded), F.lit(NON_FOREST)).when((cover == 14) & seg.isin(*BROADLEAF), F.lit(3)).when((cover == 13) & seg.isin(*CONIFER), F.lit(8)).otherwise(seg)


def constraint_report(df: DataFrame, seg: str = "seg", cover: str = "flair") -> DataFrame:
    """item, n, pct: what the correction does to the cells where both are known, as six rows from one aggregation."""
    s, c = F.col(seg), F.col(cover)
    both = s.isNotNull() & c.isNotNull()
    counts = df.agg(
        F.count_if(both).alias("valid"), F.count_if(both & ~c.isin(13, 14, 15) & (s != NON_FOREST)).alias("non_forest"), F.count_if(both & (c == 14) & s.isin(*BROADLEAF)).alias("conifer"),
        F.count_if(both & (c == 13) & s.isin(*CONIFER)).alias("broadleaf"), F.count_if(both & (c == 0)).alias("unclassified"),
    ).withColumn("unchanged", F.expr("valid - non_forest - conifer - broadleaf"))
    names = ("valid", "non_forest", "conifer", "broadleaf", "unclassified", "unchanged")
    long = counts.select("valid", F.expr(f"stack({len(names)}, {', '.join(f"'{n}', {n}" for n in names)}) AS (item, n)"))
    return long.select("item", "n", F.round(F.lit(100.0) * F.col("n") / F.nullif("valid", F.lit(0)), 2).alias("pct"))


def spectral_class(red: Column, green: Column, blue: Column, nir: Column) -> Column:
    """Threshold classes from vegetation index and brightness; the last rule that holds decides, so only 10, 4, 6 and 7 occur."""
    ndvi, bright = (nir - red) / (nir + red + F.lit(1e-8)), (red + green + blue) / 3
    return F.when(ndvi < -0.1, F.lit(7)).when(ndvi > 0.1, F.lit(10)).when(bright <= 100, F.lit(6)).when(bright > 100, F.lit(4)).otherwise(F.lit(0))


def dominant_label(df: DataFrame, sample: str, weight: str, groups: DataFrame, key: str, cls: str = "code", default: int = 0) -> DataFrame:
    """Per sample, the class with the largest summed weight (ties: the lowest); items without a class count for nothing, and
    a sample of only such items gets the default."""
    sums = df.join(groups, key).groupBy(sample, cls).agg(F.sum(weight).alias("w"))
    best = sums.groupBy(sample).agg(F.max(F.struct("w", (-F.col(cls)).alias("k"))).alias("best")).select(sample, (-F.col("best.k")).alias(cls))
    return df.select(sample).distinct().join(best, sample, "left").na.fill({cls: default})
