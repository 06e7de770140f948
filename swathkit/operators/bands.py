"""Band math on wide cell tables: one row for each cell, one column for each band. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized_difference(a: Column | str, b: Column | str, eps: float = 1e-8) -> Column:
    """(a - b) / (a + b + eps): a zero sum gives 0, not null."""
    a, b = _col(a), _col(b)
    return (a - b) / (a + b + F.lit(eps))


def savi(nir: Column | str, red: Column | str, soil: float = 0.5, eps: float = 1e-8) -> Column:
    nir, red = _col(nir), _col(red)
    return (nir - red) / (nir + red + F.lit(soil) + F.lit(eps)) * F.lit(1.0 + soil)


def band_ratio(a: Column | str, b: Column | str, eps: float = 1e-10) -> Column:
    return _col(a) / (_col(b) + F.lit(eps))


def vegetation_mask(nir: Column | str, red: Column | str, threshold: float = 0.3) -> Column:
    return normalized_difference(nir, red) >= F.lit(threshold)


def decibels(v: Column | str) -> Column:
    """10 log10(v); null where v is not positive."""
    v = _col(v)
    return F.when(v > 0, F.log10(v) * 10)


def clamp(v: Column | str, low: float, high: float) -> Column:
    """v held between two bounds; null stays null."""
    v = _col(v)
    return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))


def finite(v: Column | str) -> Column:
    v = _col(v)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def zscore(v: Column | str, mean: float, std: float, eps: float = 1e-8) -> Column:
    return (_col(v) - F.lit(mean)) / (F.lit(std) + F.lit(eps))


def stack_bands(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Two aligned cell tables side by side, bands in the given order."""
    return left.join(right, keys).select(*keys, *columns)


def select_channels(df: DataFrame, keys: list[str], channels: list[str], known: tuple[str, ...] = ("DSM", "DTM", "SLOPE", "ASPECT", "TPI", "TWI")) -> DataFrame:
    """One to six elevation channels, by name in any case; an unknown name is an error."""
    names = [c.upper() for c in channels]
    unknown = [c for c in names if c not in known]
    if unknown or not 0 < len(names) <= 6:
        raise ValueError(f"unknown channels {unknown}" if unknown else "one to six channels are needed")
    return df.select(*keys, *names)


def reorder(bands: Column | str, order: list[int]) -> Column:
    """Elements of a band array in another order (from 0)."""
    return F.array(*[F.get(_col(bands), F.lit(i)) for i in order])


def to_unit_range(v: Column | str, largest: Column | str, kind: Column | str) -> Column:
    """Values of a sensor type as 0..1: 8 bits by 255, 16 bits by 65,535, others by 255 if the largest is over 1.5."""
    v, largest, kind = _col(v), _col(largest), _col(kind)
    return v / F.when(kind == "uint8", 255.0).when(kind == "uint16", 65535.0).when(largest > 1.5, 255.0).otherwise(1.0)


def reorder_infrared(bands: Column | str) -> Column:
    """Colour-infrared (NIR, R, G) as R, G, 0, NIR; a single band four times; others as they are."""
    b = _col(bands)
    zero = F.get(b, F.lit(0)) * 0
    return F.when(F.size(b) == 3, F.array(F.get(b, F.lit(1)), F.get(b, F.lit(2)), zero, F.get(b, F.lit(0)))).when(F.size(b) == 1, F.array_repeat(F.get(b, F.lit(0)), 4)).otherwise(b)


def scale_by_max(v: Column | str, group: list[str], factor: float) -> Column:
    """v / factor where the largest of the group is over 1, else v."""
    top = F.max(_col(v)).over(Window.partitionBy(*group))
    return _col(v) / F.when(top > 1, F.lit(factor)).otherwise(F.lit(1.0))


def scale_min_max(v: Column | str, group: list[str]) -> Column:
    """(v - min) / (max - min) of the group; 0 where all are equal."""
    w = Window.partitionBy(*group)
    low, high = F.min(_col(v)).over(w), F.max(_col(v)).over(w)
    return F.when(high > low, (_col(v) - low) / (high - low)).otherwise(F.lit(0.0))


def band_statistics(df: DataFrame, bands: list[str], digits: int = 2) -> DataFrame:
    """band, v_min, v_max, v_mean, v_sd of the finite values of each band."""
    long = df.select(F.expr(f"stack({len(bands)}, {', '.join(f"'{b}', {b}" for b in bands)}) AS (band, v)"))
    return long.where(finite("v")).groupBy("band").agg(*[F.round(f("v"), digits).alias(n) for n, f in (("v_min", F.min), ("v_max", F.max), ("v_mean", F.avg), ("v_sd", F.stddev_samp))])


def histogram(df: DataFrame, value: str, bins: int = 50, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """bin (1..bins, the last with its upper bound) and n of the finite values between the bounds."""
    at = F.least(F.lit(bins), F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int") + 1)
    return df.where(finite(value) & F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
