"""Month grids, as-of snapshots and popularity series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depweave.functions import semver

#: The study's months.
FIRST, LAST = "2010-11-01", "2018-04-01"


def calendar(spark: SparkSession, first: str = FIRST, last: str = LAST) -> DataFrame:
    """First days of all months."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))


def _candidates(versions: DataFrame) -> DataFrame:
    """The first release by time, and all that are no pre-release."""
    first = F.row_number().over(Window.partitionBy("package").orderBy("release_time", semver.key(F.col("version"))))
    good = versions.where(semver.is_semver(F.col("version"))).withColumn("first", first)
    return good.where((F.col("first") == 1) | (semver.prerelease(F.col("version")) == "")).select("package", "version", "release_time", F.struct(semver.key(F.col("version")).alias("k"), "release_time", "version").alias("best"))


def latest_version(versions: DataFrame, when: str) -> DataFrame:
    """As of strictly before a time; `unreleased` for packages without a version by then."""
    found = _candidates(versions).where(F.col("release_time") < F.lit(when).cast("timestamp")).groupBy("package").agg(F.max("best").alias("b"))
    return versions.select("package").distinct().join(found, "package", "left").select("package", F.coalesce("b.version", F.lit("unreleased")).alias("version"))


def monthly_versions(versions: DataFrame, first: str = FIRST, last: str = LAST) -> DataFrame:
    """Each package's version at each month, `unreleased` before the first: one running maximum, no range join."""
    step = _candidates(versions).withColumn("month", F.greatest(F.add_months(F.trunc("release_time", "MM"), 1), F.lit(first).cast("date")))
    best = step.where(F.col("month") <= F.lit(last).cast("date")).groupBy("package", "month").agg(F.max("best").alias("b"))
    span = versions.select("package").distinct().select("package", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))
    run = F.max("b").over(Window.partitionBy("package").orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return span.join(best, ["package", "month"], "left").withColumn("b", run).select("package", "month", F.coalesce("b.version", F.lit("unreleased")).alias("version"))


def timeline(versions: DataFrame, members: DataFrame, first: str = FIRST, last: str = LAST) -> DataFrame:
    """T4: package, month, version and its sorted items."""
    items = members.groupBy("package", "version").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return monthly_versions(versions, first, last).join(items, ["package", "version"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def cube(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """Rows month, package, item of monthly versions."""
    return snapshots.join(members.select("package", "version", "item").distinct(), ["package", "version"]).select("month", "package", "item")


def slice_at(rows: DataFrame, month: str) -> DataFrame:
    """Partition pruning on a table kept by month."""
    return rows.where(F.col("month") == F.lit(month).cast("date"))


def inverted(rows: DataFrame) -> DataFrame:
    """Item, with those that hold it."""
    return rows.select("month", F.col("item").alias("package"), F.col("package").alias("item"))


def maintained_intervals(changes: DataFrame, first: str = FIRST) -> DataFrame:
    """Months [start, stop) in which a name maintains a package; a year before the grid counts as its start."""
    m = F.greatest(F.trunc("release_time", "MM"), F.lit(first).cast("date"))
    last_of_month = changes.withColumn("month", m).groupBy("name", "package", "month").agg(F.max_by(F.col("change") != "REMOVED", F.struct("release_time", "version", "change")).alias("on"))
    w = Window.partitionBy("name", "package").orderBy("month")
    return last_of_month.withColumn("stop", F.lead("month").over(w)).where("on").select("name", "package", F.col("month").alias("start"), "stop")


def maintained_packages(changes: DataFrame, first: str = FIRST, last: str = LAST) -> DataFrame:
    """Name, month, package."""
    end = F.coalesce(F.add_months("stop", -1), F.lit(last).cast("date"))
    rows = maintained_intervals(changes, first).withColumn("end", F.least(end, F.lit(last).cast("date"))).where("start <= end")
    return rows.select("name", F.explode(F.sequence("start", "end", F.expr("interval 1 month"))).alias("month"), "package")


def maintainer_counts(changes: DataFrame, first: str = FIRST, last: str = LAST) -> DataFrame:
    """Packages of each name at each month: +1 for ADDED or INITIAL, -1 for REMOVED, summed on the calendar."""
    delta = F.when(F.col("change") == "REMOVED", -1).otherwise(1)
    steps = changes.withColumn("month", F.greatest(F.trunc("release_time", "MM"), F.lit(first).cast("date"))).groupBy("name", "month").agg(F.sum(delta).alias("d"))
    grid = steps.select("name").distinct().select("name", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))
    run = F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy("name").orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(steps, ["name", "month"], "left").select("name", "month", run.alias("count"))


def average_by_year(downloads: DataFrame, years: list[int]) -> DataFrame:
    """Mean of the rows that are there, overall and by year; 0 without rows."""
    of = [F.coalesce(F.avg(F.when(F.year("day") == y, F.col("downloads"))), F.lit(0.0)).alias(f"year{y}") for y in years]
    return downloads.groupBy("package").agg(F.coalesce(F.avg("downloads"), F.lit(0.0)).alias("overall"), *of)


def average_by_month(downloads: DataFrame, first: str | None = None) -> DataFrame:
    """Runs of rows with one month number; the first month is always there."""
    w = Window.partitionBy("package").orderBy("day")
    new = F.when(F.month("day") != F.lag(F.month("day")).over(w), 1).otherwise(0)
    runs = downloads.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("package", "run").agg(F.trunc(F.min("day"), "MM").alias("month"), F.avg("downloads").alias("average")).drop("run")
    if first is None:
        return out
    head = downloads.groupBy("package").agg(F.trunc(F.min("day"), "MM").alias("m")).where(F.col("m") > F.lit(first).cast("date")).select("package", F.lit(first).cast("date").alias("month"), F.lit(0.0).alias("average"))
    return out.unionByName(head)


def first_day_series(downloads: DataFrame) -> DataFrame:
    """Downloads on the first of each month until the first gap."""
    firsts = downloads.where(F.dayofmonth("day") == 1).withColumn("k", F.row_number().over(Window.partitionBy("package").orderBy("day")))
    start = F.min("day").over(Window.partitionBy("package"))
    return firsts.withColumn("s", start).where(F.months_between("day", "s").cast("int") == F.col("k") - 1).select("package", F.col("day").alias("month"), "downloads")


def download_rows(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON documents of downloads to rows."""
    schema = "struct<package:string,downloads:array<struct<downloads:bigint,day:string>>>"
    return raw.select(F.from_json(value, schema).alias("j")).select("j.package", F.explode("j.downloads").alias("d")).select("package", F.to_date("d.day").alias("day"), "d.downloads")


def as_of(entities: DataFrame, events: DataFrame, key: str, at: str, time: str, value: list[str]) -> DataFrame:
    """For each entity row the last event at or before its time: one union and one window, no range join."""
    left = entities.select(key, F.col(at).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(events.schema[v].dataType).alias(v) for v in value], F.struct(*entities.columns).alias("_row"))
    right = events.select(key, F.col(time).alias("_t"), F.lit(0).alias("_side"), *value, F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(key).orderBy("_t", "_side", *value).rowsBetween(Window.unboundedPreceding, 0)
    seen = left.unionByName(right).select("_side", "_row", *[F.last(F.when(F.col("_side") == 0, F.struct(*value)), ignorenulls=True).over(w).alias("_v")])
    return seen.where("_side = 1").select("_row.*", *[F.col(f"_v.{v}").alias(v) for v in value])


def first_months(rows: DataFrame) -> DataFrame:
    """The first month of each item."""
    return rows.groupBy("item").agg(F.min("month").alias("first"))


def cumulative_items(rows: DataFrame, months: DataFrame) -> DataFrame:
    """Items first seen strictly before each month: counts by first month, summed over the calendar."""
    new = first_months(rows).groupBy(F.col("first").alias("month")).agg(F.count("*").alias("n"))
    both = months.select("month", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")).unionByName(new.select("month", "n", F.lit(False).alias("asked")))
    by = both.groupBy("month").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    run = F.sum("n").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1))
    return by.withColumn("count", F.coalesce(run, F.lit(0))).where("asked").select("month", "count")
