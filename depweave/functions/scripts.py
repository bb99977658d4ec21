"""JavaScript sources as rows (J1, J2, J8-J12): imports by a tokenizer, declared against used dependencies.

Sources are read as text, never run. What needs scope resolution (exports, call sites) is not covered here;
results of such analyses are read by depweave.operators.callgraph.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normalize import is_local_import, package_of

TOKEN = re.compile(r"""(?P<skip>//[^\n]*|/\*.*?\*/|\s+)|(?P<str>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`)|(?P<id>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>\.\.\.|=>|[=!<>]=+|.)""", re.S)


def tokens(source: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m[0]) for m in TOKEN.finditer(source) if m.lastgroup != "skip"]


def imports(source: str) -> list[tuple[str, str, str, str]]:
    """(id, module, bundle type, imported) of `require` and `import` forms, in order."""
    t, out, seen = tokens(source), [], set()
    text = lambda i: t[i][1] if 0 <= i < len(t) else ""
    kind = lambda i: t[i][0] if 0 <= i < len(t) else ""
    i = 0
    while i < len(t):
        if text(i) == "require" and text(i + 1) == "(" and kind(i + 2) == "str" and text(i + 3) == ")" and text(i - 1) != ".":
            module, j, member = text(i + 2)[1:-1], i + 4, []
            while text(j) == "." and kind(j + 1) == "id":
                member.append(text(j + 1))
                j += 2
            k = i - 1
            left = []
            if text(k) == "=":
                k -= 1
                if text(k) == "}":  # destructured names
                    while k >= 0 and text(k) != "{":
                        k -= 1
                    names = [x for a, x in t[k + 1 : i - 1] if a == "id"]
                    out += [(x, module, "commonjs", x) for x in names]
                    left = None
                else:
                    while kind(k) == "id" or text(k) == ".":
                        left.insert(0, text(k))
                        k -= 1
                        if kind(k) == "id" and text(k + 1) != ".":
                            break
            if left:
                out.append(("".join(x for x in left if x not in ("var", "let", "const")), module, "commonjs", ".".join(member)))
            elif left is not None and module not in seen:
                out.append(("@side-effect", module, "commonjs", ""))
            seen.add(module)
            i = j
            continue
        if text(i) == "import" and text(i - 1) != "." and text(i + 1) not in ("(", "."):
            if kind(i + 1) == "str":
                out.append(("@side-effect", text(i + 1)[1:-1], "es6", ""))
            else:
                j = i + 1
                while j < len(t) and not (text(j) == "from" and kind(j + 1) == "str") and text(j) != ";":
                    j += 1
                if text(j) == "from":
                    module, part, k, inside = text(j + 1)[1:-1], t[i + 1 : j], 0, False
                    while k < len(part):
                        a, x = part[k]
                        if x == "{":
                            inside = True
                        elif x == "}":
                            inside = False
                        elif x == "*" and k + 2 < len(part):
                            out.append((part[k + 2][1], module, "es6", ""))
                            k += 2
                        elif a == "id" and x != "type":
                            if inside and k + 2 < len(part) and part[k + 1][1] == "as":
                                out.append((part[k + 2][1], module, "es6", x))
                                k += 2
                            else:
                                out.append((x, module, "es6", x if inside else ""))
                        k += 1
                    i = j + 1
        i += 1
    return out


def is_source(path: str, head: str = "") -> bool:
    """.js, .ts, .jsx, or a node script without an extension; not in folders of dependencies."""
    if re.search(r"(^|/)(node_modules|bower_components)(/|$)", path):
        return False
    return path.endswith((".js", ".ts", ".jsx")) or ("." not in path.rsplit("/", 1)[-1] and head.startswith("#!") and "node" in head.split("\n", 1)[0])


def import_rows(files: DataFrame) -> DataFrame:
    """files(package, path, source) to package, id, fromModule, moduleName, bundleType, imported. A source
    that can't be read gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, path.rsplit(".", 1)[0], m, k, x) for p, path, s in zip(b["package"], b["path"], b["source"], strict=True) if s and path and is_source(path, s[:80]) for i, m, k, x in imports(s)]
            yield pd.DataFrame(rows, columns=["package", "id", "fromModule", "moduleName", "bundleType", "imported"])

    return files.select("package", "path", "source").mapInPandas(run, "package string, id string, fromModule string, moduleName string, bundleType string, imported string")


def production_files(packed: DataFrame, tests: DataFrame) -> DataFrame:
    """Packed files that are no tests."""
    return packed.join(tests.select("path"), "path", "left_anti")


def used_dependencies(manifests: DataFrame, rows: DataFrame) -> DataFrame:
    """Declared (regular, peer, optional) and imported modules; used: modules, not local, that begin with a declared name.

    manifests(package, dependencies, peerDependencies, optionalDependencies: arrays)."""
    found = rows.groupBy("package").agg(F.sort_array(F.collect_set(F.when(F.col("bundleType") == "commonjs", F.col("moduleName")))).alias("required"), F.sort_array(F.collect_set(F.when(F.col("bundleType") == "es6", F.col("moduleName")))).alias("imported"))
    none = F.array().cast("array<string>")
    declared = F.array_distinct(F.concat(*[F.coalesce(c, none) for c in ("dependencies", "peerDependencies", "optionalDependencies")]))
    out = manifests.withColumn("declared", declared).join(found, "package", "left").select("package", F.col("declared").alias("dependencies"), F.coalesce("required", none).alias("required"), F.coalesce("imported", none).alias("imported"))
    return out.withColumn("used", F.filter(F.array_union("required", "imported"), lambda m: ~is_local_import(m) & F.exists("dependencies", lambda d: m.startswith(d))))


def imported_packages(rows: DataFrame) -> DataFrame:
    return rows.where(~is_local_import(F.col("moduleName"))).select("package", package_of(F.col("moduleName")).alias("name")).distinct()


def manifest_of(files: DataFrame) -> DataFrame:
    """A package's manifest: package/package.json, package.json, else the first one by path; a BOM is dropped."""
    from pyspark.sql import Window

    rank = F.when(F.col("path") == "package/package.json", 0).when(F.col("path") == "package.json", 1).otherwise(2)
    rows = files.where(F.col("path").rlike(r"(^|/)package\.json$")).withColumn("r", F.row_number().over(Window.partitionBy("package").orderBy(rank, "path")))
    return rows.where("r = 1").select("package", "path", F.regexp_replace("source", "^﻿", "").alias("source"))


#: Analyses by name: files(package, path, source) to rows.
ANALYSES: dict[str, Callable[[DataFrame], DataFrame]] = {"imports": import_rows}


def analyse(files: DataFrame, name: str) -> DataFrame:
    """One plan from files to rows; errors of a file stay with it."""
    return ANALYSES[name](files)
