"""Change histories of packages from their versions (C1-C11). All shuffle once, by package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions import semver


def _by_version() -> Window:
    return Window.partitionBy("package").orderBy(semver.key(F.col("version")), "version")


def kept(versions: DataFrame, cutoff: str | None) -> DataFrame:
    """Versions that parse and are not after the cutoff; nth counts all that parse, from 0, o the kept ones from 1."""
    good = versions.where(semver.is_semver(F.col("version"))).withColumn("nth", F.row_number().over(_by_version()) - 1)
    good = good if cutoff is None else good.where(F.col("release_time") <= F.lit(cutoff).cast("timestamp"))
    return good.withColumn("o", F.row_number().over(Window.partitionBy("package").orderBy("nth")))


def rejected(versions: DataFrame) -> DataFrame:
    """Versions that don't parse."""
    return versions.where(~semver.is_semver(F.col("version")))


def hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def version_changes(versions: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Package, version, version_prev, version_diff, time_diff (hours, may be negative), release_time."""
    w = Window.partitionBy("package").orderBy("o")
    prev = F.lag("version").over(w)
    return kept(versions, cutoff).select(
        "package", "version", F.coalesce(prev, F.lit("")).alias("version_prev"), F.when(prev.isNull(), "publish").otherwise(semver.diff(prev, F.col("version"))).alias("version_diff"),
        F.coalesce(hours(F.col("release_time"), F.lag("release_time").over(w)), F.lit(0.0)).alias("time_diff"), "release_time",
    )


def version_changes_closed(versions: DataFrame, cutoff: str) -> DataFrame:
    """C1 and one closing row a package, a day after the cutoff."""
    rows = version_changes(versions, cutoff)
    end = F.lit(cutoff).cast("timestamp") + F.expr("interval 1 day")
    last = rows.groupBy("package").agg(F.max_by(F.struct("version", "release_time"), semver.key(F.col("version"))).alias("l"))
    closing = last.select("package", F.lit("artificial").alias("version"), F.col("l.version").alias("version_prev"), F.lit("none").alias("version_diff"), hours(end, F.col("l.release_time")).alias("time_diff"), end.alias("release_time"))
    return rows.unionByName(closing)


def sorted_changes(changes: DataFrame) -> DataFrame:
    """C3."""
    return changes.orderBy("package", semver.key(F.col("version")), "version")


def version_counts(changes: DataFrame) -> DataFrame:
    """C4: counts and averages between; the tail after the last major (minor) is not counted.

    A publish counts as its first number that isn't 0."""
    v = F.col("version")
    first = F.when(semver.part(v, 1) > 0, "major").when(semver.part(v, 2) > 0, "minor").when(semver.part(v, 3) > 0, "patch")
    e = changes.withColumn("e", F.when(F.col("version_diff") == "publish", first).otherwise(F.col("version_diff"))).withColumn("p", F.row_number().over(_by_version()))
    whole = Window.partitionBy("package")
    e = e.withColumn("major_p", F.max(F.when(F.col("version_diff") == "major", F.col("p"))).over(whole)).withColumn("minor_p", F.max(F.when(F.col("version_diff") == "minor", F.col("p"))).over(whole))
    n = lambda c: F.count_if(c).cast("double")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    major, minor, patch = (F.col("e") == x for x in ("major", "minor", "patch"))
    before_major, before_minor = (F.coalesce(F.col("p") < F.col(x), F.lit(False)) for x in ("major_p", "minor_p"))
    return e.groupBy("package").agg(
        F.count_if(major).alias("major"), F.count_if(minor).alias("minor"), F.count_if(patch).alias("patch"),
        ratio(n(minor & before_major), n(major)).alias("avg_minor_between_major"), ratio(n(patch & before_major), n(major)).alias("avg_patch_between_major"), ratio(n(patch & before_minor), n(minor)).alias("avg_patch_between_minor"),
    )


def set_changes(kept_versions: DataFrame, members: DataFrame) -> DataFrame:
    """What enters, changes and leaves between consecutive versions.

    kept_versions(package, version, o, initial, release_time); members(package, version, item, value). A value ''
    counts as absent for the next version. Rows: package, item, value, value_prev, change, version, release_time.
    """
    ends = kept_versions.groupBy("package").agg(F.max("o").alias("last"))
    rows = members.join(kept_versions, ["package", "version"]).join(ends, "package")
    w = Window.partitionBy("package", "item").orderBy("o")
    o, v = F.col("o"), F.col("value")
    rows = rows.withColumn("po", F.lag("o").over(w)).withColumn("pv", F.lag("value").over(w)).withColumn("no", F.lead("o").over(w))
    enters = F.col("po").isNull() | (F.col("po") < o - 1) | (F.col("pv") == "")
    change = F.when(enters, F.when(F.col("initial"), "INITIAL").otherwise("ADDED")).when(F.col("pv") != v, "UPDATED")
    now = rows.withColumn("change", change).where("change is not null").select("package", "item", "value", F.when(enters, "").otherwise(F.col("pv")).alias("value_prev"), "change", "version", "release_time")
    gone = rows.where((v != "") & (F.col("no").isNull() | (F.col("no") > o + 1)) & (o < F.col("last"))).select("package", "item", v.alias("value_prev"), (o + 1).alias("o"))
    gone = gone.join(kept_versions.select("package", "o", "version", "release_time"), ["package", "o"]).select("package", "item", F.lit("").alias("value"), "value_prev", F.lit("REMOVED").alias("change"), "version", "release_time")
    return now.unionByName(gone)


def dependency_changes(versions: DataFrame, dependencies: DataFrame, cutoff: str | None = None) -> DataFrame:
    """dependencies(package, version, item, value). INITIAL only at the first of all versions."""
    return set_changes(kept(versions, cutoff).withColumn("initial", F.col("nth") == 0), dependencies)


def license_changes(licenses: DataFrame, cutoff: str | None = None) -> DataFrame:
    """licenses(package, version, release_time, license). The very first version is the base and gives no row."""
    w = Window.partitionBy("package").orderBy("o")
    before = F.coalesce(F.lag("license").over(w), F.lit(""))
    rows = kept(licenses, cutoff).withColumn("license_from", before).where((F.col("nth") > 0) & (F.col("license_from") != F.col("license")))
    return rows.select("package", "version", "license_from", F.col("license").alias("license_to"), F.concat("license_from", F.lit("->"), "license").alias("change"), "release_time")


def maintainer_changes_by_version(versions: DataFrame, maintainers: DataFrame, cutoff: str | None = None) -> DataFrame:
    """maintainers(package, version, item)."""
    return set_changes(kept(versions, cutoff).withColumn("initial", F.col("nth") == 0), maintainers.withColumn("value", F.lit("x"))).select("package", "item", "change", "version", "release_time")


def maintainer_changes_by_time(versions: DataFrame, maintainers: DataFrame, cutoff: str | None = None) -> DataFrame:
    """In time order; maintainers(package, version, pos, item). INITIAL is the first person of the first release
    alone; the others of that release are ADDED."""
    times = kept(versions, cutoff).withColumn("o", F.row_number().over(Window.partitionBy("package").orderBy("release_time", "nth"))).withColumn("initial", F.lit(False))
    rows = set_changes(times, maintainers.select("package", "version", "item", F.lit("x").alias("value")))
    first = times.where("o = 1").join(maintainers, ["package", "version"]).groupBy("package").agg(F.min_by("item", "pos").alias("founder"), F.first("version").alias("version"))
    rows = rows.join(first, ["package", "version"], "left")
    return rows.select("package", "item", F.when((F.col("change") == "ADDED") & (F.col("item") == F.col("founder")), "INITIAL").otherwise(F.col("change")).alias("change"), "version", "release_time")


def license_versions(licenses: DataFrame, cutoff: str | None = None) -> DataFrame:
    """C9."""
    return kept(licenses, cutoff).select("package", "version", "release_time", "license")


def time_order(versions: DataFrame) -> DataFrame:
    """Rank by time, ties by version."""
    return versions.withColumn("rank", F.row_number().over(Window.partitionBy("package").orderBy("release_time", semver.key(F.col("version")), "version")))


def state_before(changes: DataFrame, when: str) -> DataFrame:
    """C11: whether each (package, item) is present just before a time, and its last version value."""
    past = changes.where(F.col("release_time") < F.lit(when).cast("timestamp"))
    order = F.struct("release_time", "version", "change")
    return past.groupBy("package", "item").agg((F.max_by("change", order) != "REMOVED").alias("present"), F.max_by("value", order).alias("value"))
