"""Call graph from analysis results (P1-P10), patterns over it (N1-N10), API statistics.

A graph is a dict of DataFrames: nodes package, module, function, class and edges requires_module,
requires_package, contains_module, contains_function, contains_class, contains_class_function, call.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.functions.normalize import is_local_import, main_module, package_of, strip_newlines

CALLS = "array<struct<fromModule:string,fromFunction:string,receiver:string,className:string,modules:array<string>,toFunction:string,args:array<string>,isLocal:boolean>>"
EXPORTS = "array<struct<type:string,id:string,args:array<string>,bundleType:string,file:string,isDefault:boolean,local:string>>"
DYNAMIC = "array<struct<Name:string,InternalName:string,Locations:array<struct<File:string,Index:int>>>>"
IMPORTS = "array<struct<id:string,fromModule:string,moduleName:string,bundleType:string,imported:string>>"


def parsed(results: DataFrame, schema: str) -> DataFrame:
    """results(package, result JSON) to rows with their position; results that are no list go to failed()."""
    good = results.where(F.trim("result").startswith("["))
    return good.select("package", F.posexplode(F.from_json("result", schema)).alias("pos", "x")).select("package", "pos", "x.*")


def failed(results: DataFrame) -> DataFrame:
    return results.where(~F.coalesce(F.trim("result").startswith("["), F.lit(False)))


def has_modules(modules: Column) -> Column:
    """A list that isn't empty and holds no ''."""
    return F.coalesce((F.size(modules) > 0) & ~F.array_contains(modules, ""), F.lit(False))


def valid_calls(calls: DataFrame) -> DataFrame:
    """P2."""
    return calls.where((F.col("toFunction") != "") & ~F.coalesce(F.col("fromModule").contains("node_modules"), F.lit(False)))


def remembered_modules(calls: DataFrame) -> DataFrame:
    """The latest valid modules of a receiver up to a call, in call order."""
    from pyspark.sql import Window

    w = Window.partitionBy("package", "fromModule", "receiver").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("remembered", F.last(F.when(has_modules(F.col("modules")), F.col("modules")), ignorenulls=True).over(w))


def export_names(dynamic: DataFrame, main: str = "index") -> DataFrame:
    """Local function ids and the exported ids that stand for them; a later entry wins."""
    each = dynamic.select("package", "pos", "Name", "InternalName", F.explode_outer("Locations").alias("l"))
    module = main_module(F.coalesce("l.File", F.lit(main)))
    local = F.concat_ws("|", "package", module, F.when(F.col("InternalName") != "", F.col("InternalName")).otherwise(F.col("Name")))
    rows = each.select(local.alias("local"), F.concat_ws("|", "package", module, "Name").alias("exported"), "pos")
    return rows.groupBy("local").agg(F.max_by("exported", F.struct("pos", "exported")).alias("exported"))


def _ids(*parts: Column | str) -> Column:
    return strip_newlines(F.concat_ws("|", *parts))


def build(calls: DataFrame, packages: DataFrame, exports: DataFrame) -> dict[str, DataFrame]:
    """Nodes and edges of valid calls; packages(name, main); exports(local, exported).

    One pass over the calls makes six kinds of rows; duplicates go when a table is made. Nodes with one id keep
    their least properties."""
    calls = valid_calls(calls)
    calls = calls.withColumn("_many", has_modules(F.col("modules")))
    each = calls.withColumn("m", F.explode_outer(F.when(F.col("_many"), F.col("modules"))))
    each = each.withColumn("req", package_of(F.col("m"))).join(packages.select(F.col("name").alias("req"), "main"), "req", "left")
    path = F.when(F.col("m").contains("/") & (F.col("m") != F.col("req")), F.substring(F.col("m"), F.length("req") + 2, F.lit(1 << 30)))
    each = each.withColumn("main", F.coalesce(F.regexp_replace(path, r"\.[^./]*$", ""), main_module(F.col("main"))))
    cls, local, this = F.coalesce("className", F.lit("")) != "", F.coalesce("isLocal", F.lit(False)), F.coalesce("receiver", F.lit("")) == "this"
    branch = (
        F.when(F.col("m").isNotNull(), F.when(is_local_import(F.col("m")), 1).when(cls, 2).otherwise(3)).when(local | this, 4).when(cls, 5).otherwise(6)
    )
    b = each.withColumn("b", branch)
    to_module = F.when(F.col("b") == 1, _ids("package", "m")).when(F.col("b").isin(2, 3), _ids("req", "main")).when(F.col("b") == 4, _ids("package", "fromModule"))
    to_class = F.when(F.col("b") == 2, _ids("req", "main", "className")).when(F.col("b") == 5, F.col("className"))
    to = F.when(F.col("b").isin(1, 3, 4), F.concat_ws("|", to_module, strip_newlines(F.col("toFunction")))).when(F.col("b").isin(2, 5), F.concat_ws("|", to_class, strip_newlines(F.col("toFunction")))).otherwise(strip_newlines(F.col("toFunction")))
    b = b.select("package", "b", "m", "req", "toFunction", "isLocal", "fromModule", "fromFunction", to_module.alias("tm"), to_class.alias("tc"), to.alias("to"), _ids("package", "fromModule").alias("fm"), _ids("package", "fromModule", "fromFunction").alias("ff"))
    names = exports.select("local", "exported")
    b = b.join(names.select(F.col("local").alias("ff"), F.col("exported").alias("fe")), "ff", "left").join(names.select(F.col("local").alias("to"), F.col("exported").alias("te")), "to", "left")
    b = b.withColumn("from_id", F.coalesce("fe", "ff")).withColumn("to_id", F.when(F.col("b").isin(1, 3, 4), F.coalesce("te", "to")).otherwise(F.col("to")))
    actual = F.lit("actualExport")
    by_call = F.when(F.col("te").isNotNull(), actual).when(F.coalesce("isLocal", F.lit(False)), "local").otherwise("export")
    kind = F.when(F.col("b").isin(1, 3), by_call).when(F.col("b").isin(2, 5), "class").when(F.col("b") == 4, F.when(F.col("te").isNotNull(), actual).otherwise("unknown")).otherwise("export")
    from_kind = F.when(F.col("fe").isNotNull(), actual).otherwise("unknown")
    union = lambda *xs: reduce(DataFrame.unionByName, xs)
    pick = lambda cond, **cols: b.where(cond).select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in cols.items()])
    every, m = F.lit(True), F.col("b")
    least = lambda df, key: df.groupBy(key).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias("p")).select(key, "p.*")
    functions = union(pick(every, id="from_id", name="fromFunction", type=from_kind), pick(every, id="to_id", name="toFunction", type=kind))
    modules = union(pick(every, id="fm", name="fromModule"), pick(m.isin(1, 2, 3), id="tm", name="m"))
    return {
        "package": union(pick(every, id="package"), pick(m.isin(2, 3), id="req")).distinct(),
        "module": least(modules, "id"),
        "function": least(functions, "id"),
        "class": pick(m.isin(2, 5), id="tc").distinct(),
        "requires_module": pick(m.isin(1, 2, 3), src="fm", dst="tm").distinct(),
        "requires_package": pick(m.isin(2, 3), src="package", dst="req").distinct(),
        "contains_module": union(pick(every, src="package", dst="fm"), pick(m.isin(2, 3), src="req", dst="tm")).distinct(),
        "contains_function": union(pick(every, src="fm", dst="from_id"), pick(m.isin(1, 3, 4), src="tm", dst="to_id")).distinct(),
        "contains_class": pick(m == 2, src="tm", dst="tc").distinct(),
        "contains_class_function": pick(m.isin(2, 5), src="tc", dst="to_id").distinct(),
        "call": pick(every, src="from_id", dst="to_id").distinct(),
    }


def merged(graph: dict[str, DataFrame], renames: DataFrame) -> dict[str, DataFrame]:
    """Contracts functions onto their exported ids; renames(local, exported), differing names."""
    names = renames.where("local <> exported").groupBy("local").agg(F.min("exported").alias("exported"))

    def swap(df: DataFrame, column: str) -> DataFrame:
        return df.join(names.withColumnRenamed("local", column), column, "left").withColumn(column, F.coalesce("exported", column)).drop("exported")

    out = dict(graph)
    out["function"] = swap(graph["function"], "id").groupBy("id").agg(F.min(F.struct("name", "type")).alias("p")).select("id", "p.*")
    for edge, columns in (("call", ("src", "dst")), ("contains_function", ("dst",)), ("contains_class_function", ("dst",))):
        out[edge] = reduce(swap, columns, graph[edge]).select("src", "dst").distinct()
    return out


def sound(graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Edges without an end in the node tables go."""
    ends = {"requires_module": ("module", "module"), "requires_package": ("package", "package"), "contains_module": ("package", "module"), "contains_function": ("module", "function"), "contains_class": ("module", "class"), "contains_class_function": ("class", "function"), "call": ("function", "function")}
    semi = lambda e, side, n: e.join(graph[n].select(F.col("id").alias(side)), side, "left_semi")
    return graph | {k: semi(semi(graph[k], "src", a), "dst", b).select("src", "dst") for k, (a, b) in ends.items()}


def dependency_graph(dependencies: dict[str, DataFrame], authors: DataFrame, maintainers: DataFrame) -> dict[str, DataFrame]:
    """P10: packages and people with edges (src, dst, kind) of every kind of dependency."""
    edges = reduce(DataFrame.unionByName, [d.select(F.col("package").alias("src"), F.col("name").alias("dst"), F.lit(k).alias("kind")) for k, d in dependencies.items()]).distinct()
    person = lambda df, kind: df.where("name <> ''").select(F.col("name").alias("src"), F.col("package").alias("dst"), F.lit(kind).alias("kind")).distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return {"package": nodes, "depends": edges, "author": person(authors, "author"), "maintainer": person(maintainers, "maintainer")}


def functions_of_type(graph: dict[str, DataFrame], kind: str = "actualExport") -> DataFrame:
    """N1."""
    return graph["function"].where(F.col("type") == kind)


def all_packages(graph: dict[str, DataFrame]) -> DataFrame:
    """N2, S25."""
    return graph["package"].select("id")


def call_counts(graph: dict[str, DataFrame]) -> DataFrame:
    """Calls of every function, 0 without."""
    n = graph["call"].groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("calls"))
    return graph["function"].select("id").join(n, "id", "left").select("id", F.coalesce("calls", F.lit(0)).alias("calls"))


def calling_packages(graph: dict[str, DataFrame]) -> DataFrame:
    """Function id and each package with a function that calls it."""
    held = graph["contains_function"].select(F.col("src").alias("module"), F.col("dst").alias("f")).join(graph["contains_module"].select(F.col("src").alias("package"), F.col("dst").alias("module")), "module").select("f", "package").distinct()
    return graph["call"].join(held.withColumnRenamed("f", "src"), "src").select(F.col("dst").alias("id"), "package").distinct()


def required_packages(graph: dict[str, DataFrame]) -> DataFrame:
    """N5."""
    return graph["requires_package"].select(F.col("src").alias("package"), F.col("dst").alias("required")).distinct()


def exported_functions(graph: dict[str, DataFrame], packages: DataFrame, heuristic: bool = False) -> DataFrame:
    """Functions whose id begins with `package|main` (so `main2` too): of type actualExport, or called more than once.

    The package part is an equi-join; only the module's prefix is compared."""
    f = graph["function"].withColumn("package", F.split("id", r"\|")[0])
    f = f.join(call_counts(graph), "id").where("calls > 1") if heuristic else f.where(F.col("type") == "actualExport")
    start = F.concat_ws("|", "package", main_module(F.col("main")))
    return f.join(packages.select(F.col("name").alias("package"), "main"), "package").where(F.startswith("id", start)).select("package", "id")


def api_size(graph: dict[str, DataFrame], packages: DataFrame) -> DataFrame:
    """Exported functions of a package; by the heuristic where none are known."""
    gather = lambda df: df.groupBy("package").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    a, h = gather(exported_functions(graph, packages)), gather(exported_functions(graph, packages, True)).withColumnRenamed("ids", "more")
    none = F.array().cast("array<string>")
    out = packages.select(F.col("name").alias("package")).distinct().join(a, "package", "left").join(h, "package", "left")
    return out.select("package", F.coalesce("ids", "more", none).alias("exported_functions")).withColumn("size", F.size("exported_functions"))


def api_usage(graph: dict[str, DataFrame]) -> DataFrame:
    """Calls and calling packages of exported functions."""
    by = calling_packages(graph).groupBy("id").agg(F.sort_array(F.collect_set("package")).alias("packages"))
    out = functions_of_type(graph).select("id").join(call_counts(graph), "id").join(by, "id", "left").withColumn("packages", F.coalesce("packages", F.array().cast("array<string>")))
    return out.select(F.col("id").alias("function"), F.col("calls").alias("call_count"), F.size("packages").alias("packages_count"), "packages")


def export_usage(graph: dict[str, DataFrame], packages: DataFrame) -> DataFrame:
    """Share of a required package's exports that a package calls; -1 where it has none."""
    size = api_size(graph, packages).select(F.col("package").alias("required"), "size", F.explode_outer("exported_functions").alias("id"))
    used = calling_packages(graph).join(size.select("required", "id").where("id is not null"), "id").groupBy("package", "required").agg(F.countDistinct("id").alias("used"))
    pairs = required_packages(graph).join(size.select("required", "size").distinct(), "required", "left").join(used, ["package", "required"], "left")
    n = F.coalesce("size", F.lit(0))
    return pairs.select("package", "required", F.when(n == 0, -1.0).otherwise(F.coalesce("used", F.lit(0)) / n).alias("share"))


def with_dependents(graph: dict[str, DataFrame], versions: DataFrame) -> DataFrame:
    """Name and version of packages that others depend on, of any kind but development; without a version: none."""
    used = graph["depends"].where("kind <> 'devDependencies'").select(F.col("dst").alias("name")).distinct()
    return versions.where("version is not null").join(used, "name", "left_semi").select("name", "version")


def call_chains(graph: dict[str, DataFrame], length: int, function: str | None = None, builtin: bool = False) -> DataFrame:
    """Chains f1 <- f2 <- ... of a length whose neighbours are in different packages; builtin: f1 may be in any."""
    e = graph["call"].withColumn("ps", F.split("src", r"\|")[0]).withColumn("pd", F.split("dst", r"\|")[0])
    now = e.select(F.col("dst").alias("f1"), F.col("src").alias("f2"), F.col("ps").alias("p"), (F.col("ps") != F.col("pd")).alias("far"))
    now = now if builtin else now.where("far")
    now = now.drop("far") if function is None else now.drop("far").where(F.col("f1") == function)
    for i in range(3, length + 1):
        step = e.where("ps <> pd").select(F.col("dst").alias(f"f{i - 1}"), F.col("src").alias(f"f{i}"), F.col("ps").alias("p"))
        now = now.drop("p").join(step, f"f{i - 1}")
    return now.select(*[f"f{i}" for i in range(1, length + 1)])
