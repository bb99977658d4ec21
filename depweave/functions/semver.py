"""Semantic versions as Spark columns: parsing, total order, difference classes (F13, F14) and ranges."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATTERN = r"^(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"


def is_semver(v: Column) -> Column:
    return F.coalesce(v.rlike(PATTERN), F.lit(False))


def part(v: Column, i: int) -> Column:
    """1-3: major, minor, patch; null where v is no version."""
    return F.regexp_extract(v, PATTERN, i).try_cast("long")


def prerelease(v: Column) -> Column:
    return F.regexp_extract(v, PATTERN, 4)


def build(v: Column) -> Column:
    return F.regexp_extract(v, PATTERN, 5)


def key(v: Column) -> Column:
    """orders by precedence: numbers, then a release over its pre-releases, then their identifiers
    (numeric below alphanumeric, a shorter list first). Build metadata doesn't count."""
    ids = F.filter(F.split(prerelease(v), r"\."), lambda x: x != "")
    one = F.transform(ids, lambda x: F.struct((~x.rlike(r"^\d+$")).alias("alpha"), F.when(x.rlike(r"^\d+$"), x.try_cast("long")).alias("num"), F.when(~x.rlike(r"^\d+$"), x).alias("str")))
    return F.when(is_semver(v), F.struct(part(v, 1).alias("major"), part(v, 2).alias("minor"), part(v, 3).alias("patch"), (prerelease(v) == "").alias("release"), one.alias("ids")))


def diff(a: Column, b: Column) -> Column:
    """class of the step from a to b; the first that holds of downgrade, build, prerelease, major, minor, patch, equal."""
    moved = prerelease(a) != prerelease(b)
    leaves = (prerelease(a) != "") & (prerelease(b) == "")  # a pre-release becomes a release
    zero = lambda *parts: F.greatest(*[part(b, i) for i in parts], F.lit(0)) == 0
    return (
        F.when(key(a) > key(b), "downgrade")
        .when(build(a) != build(b), "build")
        .when(moved & (prerelease(b) != ""), "prerelease")
        .when((part(a, 1) != part(b, 1)) | (leaves & zero(2, 3)), "major")
        .when((part(a, 2) != part(b, 2)) | (leaves & zero(3)), "minor")
        .when((part(a, 3) != part(b, 3)) | leaves, "patch")
        .otherwise("equal")
    )


def _parse(v: str) -> tuple | None:
    m = re.match(r"^\s*[v=]*\s*(\d+)\.(\d+)\.(\d+)(?:-?([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$", v or "")
    if not m:
        return None
    pre = tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in (m[4] or "").split(".") if x)
    return int(m[1]), int(m[2]), int(m[3]), not pre, pre


def intervals(text: str) -> list[list[tuple[str, tuple]]]:
    """A range as alternatives of comparators: `||`, spaces, hyphens, x, caret and tilde."""
    out = []
    for alternative in re.split(r"\s*\|\|\s*", text.strip()):
        comparators: list[tuple[str, tuple]] = []
        hyphen = re.match(r"^\s*(\S+)\s+-\s+(\S+)\s*$", alternative)
        tokens = [f">={hyphen[1]}", f"<={hyphen[2]}"] if hyphen else re.findall(r"(?:[<>=!~^]+\s*)?[^\s<>=!~^]+", alternative)
        for token in tokens:
            m = re.match(r"^(<=|>=|<|>|!=|==?|\^|~>?|)\s*v?([0-9xX*]+)(?:\.([0-9xX*]+))?(?:\.([0-9xX*]+))?(?:-([0-9A-Za-z.-]+))?(?:\+\S+)?$", token)
            if not m:
                return []
            nums = [None if x is None or x in "xX*" else int(x) for x in m.group(2, 3, 4)]
            wild = next((i for i, x in enumerate(nums) if x is None), 3)
            low = tuple(x or 0 for x in nums[:wild]) + (0,) * (3 - wild)
            pre = tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in (m[5] or "").split(".") if x) if wild == 3 else ()
            at = lambda v, p=(): (*v, not p, p)
            bump = lambda i: at((*low[:i], low[i] + 1, *(0,) * (2 - i)), ((-1, 0, ""),))
            op = m[1]
            if op == "^":
                first = next((i for i in range(min(wild, 3)) if low[i]), min(wild, 3) - 1)
                comparators += [(">=", at(low, pre)), ("<", bump(max(first, 0)))] if wild else []
            elif op.startswith("~"):
                comparators += [(">=", at(low, pre)), ("<", bump(min(1, max(wild - 1, 0))))] if wild else []
            elif wild == 3:
                comparators.append((op if op not in ("", "==") else "=", at(low, pre)))
            elif wild == 0:
                continue
            elif op in ("", "=", "=="):
                comparators += [(">=", at(low)), ("<", bump(wild - 1))]
            elif op in (">", "<="):
                comparators.append((">=" if op == ">" else "<", bump(wild - 1)))
            else:
                comparators.append((op, at(low)))
        out.append(comparators)
    return out


TESTS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


def satisfies_one(version: str | None, range_text: str | None, node: bool = False) -> bool | None:
    """Whether a version lies in a range. node: a pre-release counts only beside one of the same numbers."""
    v = _parse(version) if version else None
    if v is None or range_text is None:
        return None
    for comparators in intervals(range_text):
        if all(TESTS[op](v, x) for op, x in comparators) and not (node and v[4] and not any(x[4] and x[:3] == v[:3] and x[4] != ((-1, 0, ""),) for _, x in comparators)):
            return True
    return False


def _key_of(v: tuple) -> Column:
    """A parsed version as key() has it; the mark below all pre-releases is an empty list of them."""
    ids = [i for i in v[4] if i[0] >= 0]
    one = [F.struct(F.lit(i[0] == 1).alias("alpha"), F.lit(i[1] if i[0] == 0 else None).cast("long").alias("num"), F.lit(i[2] if i[0] == 1 else None).cast("string").alias("str")) for i in ids]
    listed = F.array(*one) if one else F.array().cast("array<struct<alpha:boolean,num:bigint,str:string>>")
    return F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(v[:3], ("major", "minor", "patch"), strict=True)], F.lit(bool(v[3])).alias("release"), listed.alias("ids"))


def in_range(version: Column, text: str, node: bool = False) -> Column:
    """F15 (node: F16) with a range that is known: parsed once, compared by key(); null for what is no version."""
    k = key(version)
    inside = F.lit(False)
    for comparators in intervals(text):
        ok = F.lit(True)
        for op, x in comparators:
            c = _key_of(x)
            ok = ok & {"<": k < c, "<=": k <= c, ">": k > c, ">=": k >= c, "=": k == c, "!=": k != c}[op]
        if node:
            beside = [x for _, x in comparators if x[4] and x[4] != ((-1, 0, ""),)]
            same = [(part(version, 1) == x[0]) & (part(version, 2) == x[1]) & (part(version, 3) == x[2]) for x in beside]
            near = F.lit(False)
            for m in same:
                near = near | m
            ok = ok & ((prerelease(version) == "") | near)
        inside = inside | ok
    return F.when(is_semver(version), inside)


@F.pandas_udf(T.BooleanType())
def satisfies(version: pd.Series, range_text: pd.Series) -> pd.Series:
    """comparators, `||` and wildcards."""
    return pd.Series([satisfies_one(v, r) for v, r in zip(version, range_text, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def node_satisfies(version: pd.Series, range_text: pd.Series) -> pd.Series:
    """F16: caret, tilde, x-ranges and the pre-release rule of the node dialect."""
    return pd.Series([satisfies_one(v, r, True) for v, r in zip(version, range_text, strict=True)], dtype=object)
