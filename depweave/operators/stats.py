"""Statistics over series, vulnerabilities, files and dependencies (A1-A15), and histograms and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions import semver

from . import bitsets, closure

_ALL = (Window.unboundedPreceding, 0)


def active(series: DataFrame) -> DataFrame:
    """Rows of series(key, month, count) from a key's first positive count on."""
    w = Window.partitionBy("key").orderBy("month").rowsBetween(*_ALL)
    return series.withColumn("_on", F.max((F.col("count") > 0).cast("int")).over(w)).where("_on = 1").drop("_on")


def active_mean(series: DataFrame, months: DataFrame) -> DataFrame:
    """A1, A4: mean over active keys for every month of the calendar, 0 without any."""
    mean = active(series).groupBy("month").agg(F.avg("count").alias("value"))
    return months.join(mean, "month", "left").select("month", F.coalesce("value", F.lit(0.0)).alias("value"))


def monthly_diffs(series: DataFrame) -> DataFrame:
    """A3: difference to the month before of active keys; the first is the count itself."""
    w = Window.partitionBy("key").orderBy("month")
    return active(series).select("key", "month", (F.col("count") - F.coalesce(F.lag("count").over(w), F.lit(0))).cast("double").alias("diff"))


def diff_lists(series: DataFrame) -> DataFrame:
    """A3 as one sorted list a key, empty for keys that never are active."""
    lists = monthly_diffs(series).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("month", "diff"))).alias("diffs"))
    return series.select("key").distinct().join(lists, "key", "left").withColumn("diffs", F.coalesce("diffs", F.array().cast("array<struct<month:date,diff:double>>")))


def extreme_diffs(series: DataFrame, n: int = 20) -> DataFrame:
    """A2: the n largest decreases and increases of each month."""
    d = monthly_diffs(series)
    down = d.withColumn("rank", F.row_number().over(Window.partitionBy("month").orderBy("diff", "key"))).withColumn("side", F.lit("decrease"))
    up = d.withColumn("rank", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("diff"), "key"))).withColumn("side", F.lit("increase"))
    return down.where(F.col("rank") <= n).unionByName(up.where(F.col("rank") <= n))


def january_logs(series: DataFrame) -> DataFrame:
    """A5: log10 of positive January counts, descending by year."""
    rows = series.where((F.month("month") == 1) & (F.col("count") > 0)).select(F.year("month").alias("year"), "key", F.log10(F.col("count").cast("double")).alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("value"), "key")))


def active_quartiles(series: DataFrame) -> DataFrame:
    """Box plot numbers of active keys by month."""
    q = F.percentile("count", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return active(series).groupBy("month").agg(q.alias("q")).select("month", *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def degree_averages(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """By month dependencies, released packages, and mean out and in degree; null without packages."""
    n = packages.select("month", "package").distinct().groupBy("month").agg(F.count("*").alias("packages"))
    e = edges.join(packages.select("month", F.col("package").alias("dst")).distinct(), ["month", "dst"], "left_semi").groupBy("month").agg(F.count("*").alias("ins"))
    o = edges.groupBy("month").agg(F.count("*").alias("dependencies"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return n.join(o, "month", "left").join(e, "month", "left").select("month", "packages", z("dependencies").alias("dependencies"), F.try_divide(z("dependencies"), F.col("packages")).alias("average_out"), F.try_divide(z("ins"), F.col("packages")).alias("average_in"))


def vulnerable_dependencies(packages: DataFrame, edges: DataFrame, vulnerable: DataFrame) -> DataFrame:
    """Direct dependencies of a package, how many are vulnerable, and whether it is itself."""
    flag = vulnerable.select(F.col("package").alias("dst"), F.lit(1).alias("v")).distinct()
    by = edges.join(flag, "dst", "left").groupBy("src").agg(F.count("*").alias("package_cost"), F.count("v").alias("vulnerability_cost"))
    own = flag.select(F.col("dst").alias("package"), F.lit(True).alias("is_vulnerable"))
    z = lambda c, d: F.coalesce(c, F.lit(d))
    return packages.select("package").distinct().join(by.withColumnRenamed("src", "package"), "package", "left").join(own, "package", "left").select("package", z("is_vulnerable", False).alias("is_vulnerable"), z("vulnerability_cost", 0).alias("vulnerability_cost"), z("package_cost", 0).alias("package_cost"))


def vulnerable_dates(vulnerabilities: DataFrame, versions: DataFrame, no_start: str = "2018-03-31", no_end: str = "2018-04-02") -> DataFrame:
    """Release times of the first versions, in version order, that the vulnerable and the patched range hold."""
    rows = vulnerabilities.join(versions, "package", "left")
    k, t = semver.key(F.col("version")), F.col("release_time")
    hit = lambda r: F.min_by(F.when(semver.satisfies(F.col("version"), F.col(r)), t), F.when(semver.satisfies(F.col("version"), F.col(r)), k))
    return rows.groupBy("id", "package").agg(F.coalesce(hit("vulnerable_versions"), F.lit(no_start).cast("timestamp")).alias("vulnerable_date"), F.coalesce(hit("patched_versions"), F.lit(no_end).cast("timestamp")).alias("patched_date"))


def vulnerable_reach(details: DataFrame, reach: DataFrame, months: DataFrame) -> DataFrame:
    """A10: by month vulnerabilities that are open (strictly inside their dates) and have a reach, and the union's size.

    Open months are enumerated from each vulnerability's own dates: no range join."""
    begin, end = F.add_months(F.trunc("vulnerable_date", "MM"), 1), F.trunc(F.col("patched_date") - F.expr("interval 1 microsecond"), "MM")
    open_ = details.withColumn("b", begin).withColumn("e", end).where("b <= e").select("id", "package", F.explode(F.sequence("b", "e", F.expr("interval 1 month"))).alias("month"))
    keys = ["package", "month"] if "month" in reach.columns else ["package"]  # a reach that is the same in all months
    rows = open_.join(reach.select(F.col("src").alias("package"), *keys[1:], "dst"), keys)
    by = rows.groupBy("month").agg(F.countDistinct("id").alias("open"), F.countDistinct("dst").alias("count"))
    return months.join(by, "month", "left").select("month", F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("count", F.lit(0)).alias("count"))


def vulnerable_reach_of(details: DataFrame, edges: DataFrame, months: DataFrame) -> DataFrame:
    """A10 from edges(src, dst) that are the same in all months, without pairs where the graph is within bitsets.EDGES: months are bits."""
    g = bitsets.graphs(edges)
    if g is None:
        return vulnerable_reach(details, closure.reach(edges), months)
    begin, end = F.add_months(F.trunc("vulnerable_date", "MM"), 1), F.trunc(F.col("patched_date") - F.expr("interval 1 microsecond"), "MM")
    found = details.select("id", "package", F.unix_date(begin).alias("b"), F.unix_date(end).alias("e")).where("b <= e").distinct()
    points = [r[0] for r in months.where("month = trunc(month, 'MM')").select(F.unix_date("month").alias("p")).distinct().orderBy("p").collect()]
    by = months.sparkSession.createDataFrame(bitsets.interval_unions(g, found, points), "p int, open long, count long").select(F.date_from_unix_date("p").alias("month"), "open", "count")
    return months.join(by, "month", "left").select("month", F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("count", F.lit(0)).alias("count"))


def file_totals(files: DataFrame, least: int = 0) -> DataFrame:
    """Totals by file class above a least, descending; files(package, class, n)."""
    return files.groupBy("class").agg(F.sum("n").alias("total")).where(F.col("total") > least).orderBy(F.desc("total"), "class")


def file_shares(files: DataFrame) -> DataFrame:
    """Share of each class in its package."""
    return files.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("package")))


def share_deciles(shares: DataFrame, classes: list[str]) -> DataFrame:
    """Packages by class and int(share * 10); packages without a class count in bucket 0, by subtraction."""
    wanted = shares.where(F.col("class").isin(classes)).groupBy("class", F.floor(F.col("share") * 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    names = shares.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    total = shares.agg(F.countDistinct("package").alias("all"))
    have = wanted.groupBy("class").agg(F.sum("n").alias("have"))
    rest = F.broadcast(names).join(have, "class", "left").crossJoin(F.broadcast(total)).select("class", F.lit(0).alias("bucket"), (F.col("all") - F.coalesce("have", F.lit(0))).alias("n"))
    return wanted.unionByName(rest).groupBy("class", "bucket").agg(F.sum("n").alias("n")).where("n > 0")


def class_counts(packages: DataFrame, files: DataFrame, name: str = "binary") -> DataFrame:
    """Files of one class in each package, 0 without."""
    return packages.select("package").distinct().join(files.where(F.col("class") == name).groupBy("package").agg(F.sum("n").alias("n")), "package", "left").select("package", F.coalesce("n", F.lit(0)).alias("n"))


def used_ratio(results: DataFrame) -> DataFrame:
    """Share of declared dependencies that are part of a used module's name; -1 stays out: null without any."""
    hit = F.filter("dependencies", lambda d: F.exists("used", lambda u: F.contains(u, d)))
    return results.select("package", F.size("dependencies").alias("declared"), F.try_divide(F.size(hit), F.size("dependencies")).alias("ratio"))


def decade_buckets(x: Column) -> Column:
    """V1: 0, 1 to 5 singly, 6-9, 10-99, 100-999, 1000-9999, more."""
    return F.when(x <= 5, x.cast("int").cast("string")).when(x < 10, "6-9").when(x < 100, "10-99").when(x < 1000, "100-999").when(x < 10000, "1000-9999").otherwise("10000+")


def cost_buckets(x: Column) -> Column:
    """V2: 0, 1-9, 10-99, 100-999, 1000-9999, more."""
    return F.when(x < 1, "0").when(x < 10, "1-9").when(x < 100, "10-99").when(x < 1000, "100-999").when(x < 10000, "1000-9999").otherwise("10000+")


def cost_histogram(df: DataFrame, column: str) -> DataFrame:
    """V2."""
    return df.groupBy(cost_buckets(F.col(column)).alias("bucket")).agg(F.count("*").alias("n"))


def used_histogram(results: DataFrame) -> DataFrame:
    """V5: packages by the tenth that their share of used dependencies falls in; those that declare none are left out."""
    return results.where(F.col("ratio").isNotNull()).groupBy(F.floor(F.col("ratio") * 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(decade_buckets(F.col(column)).alias("bucket")).agg(F.count("*").alias("n"))


def doane_histogram(df: DataFrame, column: str) -> DataFrame:
    """V1: bins by Doane's rule from count and skewness; one bin for a constant, no skewness below three rows."""
    x = F.col(column).cast("double")
    s = df.agg(F.count(x).alias("n"), F.skewness(x).alias("g"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    sigma = F.sqrt(6.0 * (F.col("n") - 2) / ((F.col("n") + 1.0) * (F.col("n") + 3)))
    skew = F.when((F.col("n") < 3) | F.isnan("g"), 0.0).otherwise(F.coalesce(F.try_divide(F.abs("g"), sigma), F.lit(0.0)))
    bins = F.when(F.col("hi") <= F.col("lo"), 1).otherwise(F.ceil(1 + F.log2(F.col("n").cast("double")) + F.log2(1 + skew)).cast("int"))
    s = s.select("lo", "hi", bins.alias("bins"))
    part = F.coalesce(F.try_divide(x - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    at = F.least(F.col("bins") - 1, F.floor(part * F.col("bins")).cast("int"))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(s)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def positive_mean(rows: DataFrame, key: str, value: str) -> DataFrame:
    """V3: mean of positive values; keys without any have none."""
    return rows.where(F.col(value) > 0).groupBy(key).agg(F.avg(value).alias("mean"))


def saving(usage: DataFrame, cost: DataFrame, most: float = 0.1) -> DataFrame:
    """V4: by package the sum of cost + 1 over dependencies that are used, but up to a share; 0 for others."""
    little = usage.where((F.col("share") > 0) & (F.col("share") <= most)).join(cost.select(F.col("src").alias("dst"), "count"), "dst", "left")
    found = little.groupBy("package").agg(F.sum(F.coalesce("count", F.lit(0)) + 1).alias("saving"))
    return usage.select("package").distinct().join(found, "package", "left").select("package", F.coalesce("saving", F.lit(0)).alias("saving"))


def top_modules(uses: DataFrame, modules: DataFrame) -> DataFrame:
    """V6: packages that use each known module, 0 for unused ones."""
    by = uses.select("package", "module").distinct().groupBy("module").agg(F.count("*").alias("n"))
    return modules.join(by, "module", "left").select("module", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "module")


def share_of(series: DataFrame, totals: DataFrame) -> DataFrame:
    """V7."""
    return series.join(totals, "month").select("month", F.try_divide(F.col("value"), F.col("total")).alias("share"))


def spearman(pairs: DataFrame) -> DataFrame:
    """V9: rank correlation of x and y by key, ties by average rank; null where either is constant."""
    def rank(c: str) -> Column:
        w = Window.partitionBy("key").orderBy(c)
        return F.rank().over(w) + (F.count("*").over(Window.partitionBy("key", c)) - 1) / 2.0

    r = F.corr("rx", "ry")
    return pairs.withColumn("rx", rank("x")).withColumn("ry", rank("y")).groupBy("key").agg(F.when(F.isnan(r), None).otherwise(r).alias("rho"))


def boosts(diffs: DataFrame, least: float = 1000.0, inclusive: bool = False) -> DataFrame:
    """Pairs of the last spike and the fall that ends it; diffs(key, t, diff). Steps of just `least` count if inclusive."""
    d = F.col("diff")
    up, down = (d >= least, d <= -least) if inclusive else (d > least, d < -least)
    w = Window.partitionBy("key").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    rows = diffs.withColumn("spike", F.max(F.when(up, F.col("t"))).over(w)).withColumn("fall", F.max(F.when(down, F.col("t"))).over(w))
    return rows.where(down & F.col("spike").isNotNull() & (F.col("fall").isNull() | (F.col("fall") <= F.col("spike")))).select("key", "spike", F.col("t").alias("fall"))


def boost_factors(series: DataFrame, found: DataFrame) -> DataFrame:
    """How far the value after the first fall is from the trend before its spike, as a share of that; shares of 1
    and more are dropped, as is a trend of 0; series(key, t, value)."""
    first = found.groupBy("key").agg(F.min(F.struct("fall", "spike")).alias("b")).select("key", "b.spike", "b.fall")
    trend = series.join(first, "key").where("t < spike").groupBy("key", "fall").agg(F.regr_slope("value", "t").alias("m"), F.regr_intercept("value", "t").alias("c"))
    after = series.join(trend, "key").where("t = fall").withColumn("expected", F.col("m") * F.col("t") + F.col("c")).where("expected <> 0")
    return after.select("key", "fall", ((F.col("value") - F.col("expected")) / F.col("expected")).alias("factor")).where("factor < 1")


def usage_bars(layer_counts: DataFrame) -> DataFrame:
    """From layers: direct, first, first two, indirect, total."""
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    layer = F.col("layer")
    return layer_counts.agg(s(layer == 1).alias("direct"), s(layer == 2).alias("second"), s(layer <= 2).alias("first_two"), s(layer > 1).alias("indirect"), s(layer > 0).alias("total"))


def strict_tags(tags: DataFrame, column: str = "tag") -> DataFrame:
    """Tags that are strict versions, with the numbers they sort by."""
    n = F.transform(F.split(F.regexp_extract(column, r"^v?(\d+\.\d+\.\d+)$", 1), r"\."), lambda x: x.try_cast("int"))
    return tags.where(F.col(column).rlike(r"^v?\d+\.\d+\.\d+$")).withColumn("numbers", n)


def lifetime_deciles(series: DataFrame) -> DataFrame:
    """Sums over ten equal slices of a key's values, whose edges may share one; series(key, i from 0, value)."""
    n = F.count("*").over(Window.partitionBy("key"))
    rows = series.withColumn("n", n).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(9))))
    inside = (F.col("i") >= F.floor(F.col("s") * F.col("n") / 10)) & (F.col("i") < F.ceil((F.col("s") + 1) * F.col("n") / 10))
    return rows.where(inside).groupBy("key", F.col("s").alias("slice")).agg(F.sum("value").alias("value"))


def slice_means(slices: DataFrame) -> DataFrame:
    """Mean by slice, without NaN."""
    return slices.where(~F.isnan(F.col("value").cast("double"))).groupBy("slice").agg(F.avg("value").alias("mean"))


def usage_per_size(uses: DataFrame, lines: DataFrame, by_repository: bool = False) -> DataFrame:
    """uses(month, repo, name, n) per 1000 lines, or per repository, of the same month."""
    size = lines.groupBy("month").agg((F.sum("lines") / 1000.0).alias("kloc"), F.countDistinct("repo").alias("repos"))
    total = uses.groupBy("month", "name").agg(F.sum("n").alias("n"), F.countDistinct("repo").alias("users"))
    return total.join(F.broadcast(size), "month").select("month", "name", "n", "users", F.try_divide(F.col("n").cast("double"), F.col("repos").cast("double") if by_repository else F.col("kloc")).alias("rate"))


def two_sets(uses: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """By month uses of names of two sets."""
    return uses.groupBy("month").agg(F.sum(F.when(F.col("name").isin(first), F.col("n")).otherwise(0)).alias("first"), F.sum(F.when(F.col("name").isin(second), F.col("n")).otherwise(0)).alias("second"))


def platform_class(uses: DataFrame, node: list[str], browser: list[str]) -> DataFrame:
    """Repositories of a month by what they use: node, browser, mixed, none."""
    flags = uses.groupBy("month", "repo").agg(F.bool_or(F.col("name").isin(node)).alias("a"), F.bool_or(F.col("name").isin(browser)).alias("b"))
    kind = F.when(F.col("a") & F.col("b"), "mixed").when(F.col("a"), "node").when(F.col("b"), "browser").otherwise("none")
    return flags.groupBy("month", kind.alias("platform")).agg(F.count("*").alias("n"))


def presence(rows: DataFrame) -> DataFrame:
    """By month repositories that have each name."""
    return rows.select("month", "repo", "name").distinct().groupBy("month", "name").agg(F.count("*").alias("n"))


def cumulative_reach(reach: DataFrame, months: DataFrame) -> DataFrame:
    """V8: packages that vulnerabilities have reached in any month before each; reach(month, package)."""
    from .timeline import cumulative_items

    return cumulative_items(reach.select(F.col("package").alias("item"), "month"), months)


def vulnerable_use(dependencies: DataFrame, calls: DataFrame) -> DataFrame:
    """By month repositories with a vulnerable dependency, and those that also call what is vulnerable;
    dependencies(month, repo), calls(month, repo)."""
    have = dependencies.select("month", "repo").distinct()
    do = calls.select("month", "repo", F.lit(1).alias("called")).distinct()
    return have.join(do, ["month", "repo"], "left").groupBy("month").agg(F.count("*").alias("dependent"), F.count("called").alias("calling"))


def lines_of(lines: DataFrame, repo) -> DataFrame:
    """Thousands of lines of one repository by month; lines(month, repo, lines)."""
    return lines.where(F.col("repo") == F.lit(repo)).groupBy("month").agg((F.sum("lines") / 1000.0).alias("kloc"))


def top_by_year(counts: DataFrame, n: int) -> DataFrame:
    """The n largest counts of each year, ties by name; counts(year, name, count)."""
    order = Window.partitionBy("year").orderBy(F.desc("count"), "name")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def side_by_side(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two series (month, value) on all months of either."""
    return first.withColumnRenamed("value", "first").join(second.withColumnRenamed("value", "second"), "month", "full")
