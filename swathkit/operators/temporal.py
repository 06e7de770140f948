"""Scene catalogs and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dims import SEASONS


def filter_cloud(scenes: DataFrame, most: float = 30.0) -> DataFrame:
    """Scenes of known cloud cover up to ``most``."""
    return scenes.where(F.col("cloud").isNotNull() & (F.col("cloud") <= most))


def filter_orbit(scenes: DataFrame, orbit: str = "both") -> DataFrame:
    return scenes if orbit.lower() == "both" else scenes.where(F.lower("orbit") == orbit.lower())


def date_ranges(spark: SparkSession, years: list[int], season: str | tuple[int, int]) -> DataFrame:
    """annee, start_date, end_date (as text) of a season of each year; the last month counts to its last day."""
    return season_ranges(spark.createDataFrame([(v,) for v in years], "annee int"), season)


def season_ranges(years: DataFrame, season: str | tuple[int, int]) -> DataFrame:
    """``years`` (with annee) with start_date and end_date (as text) of a season; the last month counts to its last day."""
    first, last = SEASONS[season] if isinstance(season, str) else season
    return years.withColumns({"start_date": F.make_date("annee", F.lit(first), F.lit(1)).cast("string"), "end_date": F.last_day(F.make_date("annee", F.lit(last), F.lit(1))).cast("string")})


def best_scenes(scenes: DataFrame, group: list[str], n: int = 1) -> DataFrame:
    """The ``n`` scenes of least cloud in each group; ties by id."""
    w = Window.partitionBy(*group).orderBy("cloud", "scene_id")
    return scenes.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def top_scenes(scenes: DataFrame, months: tuple[int, int], n: int = 3, most: float = 30.0) -> DataFrame:
    """The best scenes of each tile and year inside a season; where a season has none, of the whole year."""
    own = filter_cloud(scenes, most).withColumn("annee", F.year("ts"))
    season = own.where(F.month("ts").between(*months))
    rest = own.join(season.select("tile_id", "annee").distinct(), ["tile_id", "annee"], "left_anti")
    return best_scenes(season.unionByName(rest), ["tile_id", "annee"], n)


def nearest_scenes(scenes: DataFrame, wanted: DataFrame, days: int = 30, months: tuple[int, int] = (6, 9), strict: float = 20.0, relaxed: float = 30.0, order: list[str] | None = None) -> DataFrame:
    """For each wanted (tile_id, day): the clearest scene near that day and how it was found. tile_id, day, scene_id, cloud, step.

    Step 1 takes scenes up to ``days`` away; step 2, where a tile has none (or ``day`` is null), those of the season
    ``months`` of ``day``'s year (without a day: of the latest year in the catalogue); both hold clouds to ``strict``. Step 3
    takes any scene of that year, with clouds up to ``relaxed``. Within a step the clearest comes first, ties by id (or what
    ``order`` says); scenes of unknown cloud cover never count. One join on tile and year (a scene meets the days of its own and the neighbouring
    years only), one window a wanted day. Wanted days for which nothing is found have no row; repeated ones count once.
    """
    known = filter_cloud(scenes, relaxed).withColumns({"_on": F.to_date("ts"), "_year": F.year("ts")})
    asked = wanted.select("tile_id", F.col("day").cast("date").alias("day")).distinct()
    if not asked.where("day IS NULL").isEmpty():
        latest = known.agg(F.max("_year")).first()[0]
        asked = asked.withColumn("_of", F.coalesce(F.year("day"), F.lit(latest).cast("int")))
    else:
        asked = asked.withColumn("_of", F.year("day"))
    years = F.array_distinct(F.filter(F.array(F.col("_of"), F.year(F.date_sub("day", days)), F.year(F.date_add("day", days))), lambda y: y.isNotNull()))
    met = asked.withColumn("_year", F.explode(years)).join(known, ["tile_id", "_year"])
    own, clear = F.col("_year") == F.col("_of"), F.col("cloud") <= strict
    near = F.coalesce(F.abs(F.datediff("_on", "day")) <= days, F.lit(False))
    step = F.when(near & clear, 1).when(own & clear & F.month("_on").between(*months), 2).when(own, 3)
    first = Window.partitionBy("tile_id", "day", "_of").orderBy("step", *(order or ["cloud", "scene_id"]))
    return met.withColumn("step", step).where("step IS NOT NULL").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("tile_id", "day", "scene_id", "cloud", "step")


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, m2 (the sum of squared distances from the mean) of the known values: a state that ``merge_moments`` adds up."""
    n = F.count(value)
    return df.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * n).alias("m2"))


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The moments of several parts as those of all their values: means weighted by counts, m2 with what the means differ.

    Parts are whatever ``moments`` or an earlier merge gave, in any order; parts of no value change nothing.
    """
    own = parts.where("n > 0")
    whole = own.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    apart = F.col("mean") - F.col("_mean")
    met = own.select(*keys, "n", "mean", "m2").join(whole, keys)
    return met.groupBy(*keys, "_mean").agg(F.sum("n").alias("n"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2")).select(*keys, "n", F.col("_mean").alias("mean"), "m2")


def median_composite(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The exact median of the known values of each cell."""
    return df.groupBy(*keys).agg(F.median(value).alias(value))


def masked_mean(df: DataFrame, keys: list[str], value: str, cloud: str = "cloud", most: int = 50) -> DataFrame:
    """The mean of the values under the cloud limit; 0 for a cell without any."""
    clear = F.col(cloud) < most
    total = F.sum(F.when(clear, F.col(value)).otherwise(0.0))
    return df.groupBy(*keys).agg((total / F.greatest(F.count_if(clear), F.lit(1))).alias(value))


def parse_years(text):
    """Years of "2021:2024" (a range) or "2022,2023" (a list)."""
    ends = F.transform(F.split(text, ":"), lambda x: F.try_to_number(F.trim(x), F.lit("9999")).cast("int"))
    return F.when(F.contains(text, F.lit(":")), F.sequence(F.element_at(ends, 1), F.element_at(ends, 2))).otherwise(F.transform(F.split(text, ","), lambda x: F.try_to_number(F.trim(x), F.lit("9999")).cast("int")))
