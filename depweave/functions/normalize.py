"""Scalar rules over loosely typed metadata (F1-F12, F17-F31). Union fields are VARIANT columns."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a time that is missing or can't be read.
SENTINEL = "1970-01-01 00:00:01"


def kind(v: Column) -> Column:
    """STRING, OBJECT, ARRAY, VOID, ... of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def text_at(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "string")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def version_ref(v: Column) -> Column:
    """a string stands for itself, an object for its `version`, else ''."""
    return F.when(kind(v) == "STRING", text_at(v)).when(kind(v) == "OBJECT", F.coalesce(text_at(v, "$.version"), F.lit(""))).otherwise("")


def _type_of(x: Column, nested: bool) -> Column:
    plain = F.when(kind(x) == "STRING", text_at(x)).when((kind(x) == "OBJECT") & (kind(F.try_variant_get(x, "$.type", "variant")) == "STRING"), text_at(x, "$.type"))
    return F.coalesce(plain, text_at(x, "$.type.type")) if nested else plain


def license_text(v: Column, nested: bool = False) -> Column:
    """F2; nested: F3. Types of a list are joined with '|'; one that is skipped at the end leaves its '|'."""
    types = F.transform(_list(v), lambda x: _type_of(x, nested))
    n = F.size(types)
    joined = F.aggregate(F.transform(types, lambda t, i: F.when(t.isNull(), "").otherwise(F.concat(t, F.when(i < n - 1, "|").otherwise("")))), F.lit(""), lambda a, t: F.concat(a, t))
    return F.when(kind(v) == "STRING", text_at(v)).when(kind(v) == "ARRAY", joined).when(kind(v) == "OBJECT", F.coalesce(_type_of(v, nested), F.lit(""))).otherwise("")


def license_of(license_: Column, licenses: Column) -> Column:
    """the one field, else the other."""
    return F.coalesce(F.nullif(license_text(license_), F.lit("")), license_text(licenses, True))


def person_name(s: Column) -> Column:
    """letters and spaces at the start, without spaces at the end."""
    return F.rtrim(F.regexp_extract(s, r"(^[a-zA-Z\s]+)", 1))


def _person(name: Column, email: Column, url: Column) -> Column:
    none = F.lit("")
    return F.struct(F.coalesce(name, none).alias("name"), F.coalesce(email, none).alias("email"), F.coalesce(url, none).alias("url"))


def people(v: Column) -> Column:
    """null, string, list or object to an array of persons; an object without a name gives its key "0", three deep."""
    def one(x: Column, depth: int) -> Column:
        whole = _person(text_at(x, "$.name"), text_at(x, "$.email"), text_at(x, "$.url"))
        inner = one(F.try_variant_get(x, "$.0", "variant"), depth - 1) if depth else whole
        unnamed = (F.coalesce(text_at(x, "$.name"), F.lit("")) == "") & F.try_variant_get(x, "$.0", "variant").isNotNull()
        return F.when(kind(x) == "STRING", _person(person_name(text_at(x)), F.lit(""), F.lit(""))).when(unnamed, inner).otherwise(whole) if depth else whole

    empty = F.array().cast("array<struct<name:string,email:string,url:string>>")
    return F.when(kind(v) == "ARRAY", F.transform(_list(v), lambda x: one(x, 3))).when(kind(v).isin("STRING", "OBJECT"), F.array(one(v, 3))).otherwise(empty)


def author_text(v: Column) -> Column:
    """a list's names are joined with commas, one at the end too."""
    names = F.transform(_list(v), lambda x: F.when(kind(x) == "STRING", text_at(x)).otherwise(F.coalesce(text_at(x, "$.name"), F.lit(""))))
    return F.when(kind(v) == "STRING", text_at(v)).when(kind(v) == "ARRAY", F.concat(F.array_join(names, ","), F.lit(","))).when(kind(v) == "OBJECT", F.coalesce(text_at(v, "$.name"), F.lit(""))).otherwise("")


def main_text(v: Column) -> Column:
    """F8: string; list with a comma at the end; map as `Key: k Value: v , ` in key order."""
    entries = F.array_sort(F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), text_at(e["value"]).alias("value"))))
    shown = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("Key: "), e["key"], F.lit(" Value: "), e["value"], F.lit(" , "))), "")
    return F.when(kind(v) == "STRING", text_at(v)).when(kind(v) == "ARRAY", F.concat(F.array_join(F.transform(_list(v), lambda x: text_at(x)), ","), F.lit(","))).when(kind(v) == "OBJECT", shown).otherwise("")


def time_of(v: Column) -> Column:
    """an RFC 3339 string, or an object's `time`; the sentinel for what can't be read and for epoch 0."""
    s = F.when(kind(v) == "STRING", text_at(v)).when(kind(v) == "OBJECT", text_at(v, "$.time"))
    t = F.try_to_timestamp(s)
    return F.when(t.isNull() | (F.unix_seconds(t) == 0), F.lit(SENTINEL).cast("timestamp")).otherwise(t)


def parsed_times(times: Column) -> Column:
    """a map of variants to times."""
    return F.transform_values(times, lambda _, v: time_of(v))


def day(s: Column) -> Column:
    """fails on what is no day."""
    return F.to_date(s, "yyyy-MM-dd")


def average(a: Column, b: Column) -> Column:
    """0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def is_local_import(path: Column) -> Column:
    """F17."""
    return path.isin(".", "..") | path.startswith("/") | path.startswith("./") | path.startswith("../")


def is_submodule(declared: Column, module: Column) -> Column:
    """by prefix alone, so `foo` holds `foobar`."""
    return F.exists(declared, lambda d: module.startswith(d))


def package_of(module: Column) -> Column:
    """the first path segment, two for a scope."""
    return F.when(module.startswith("@"), F.array_join(F.slice(F.split(module, "/"), 1, 2), "/")).otherwise(F.split(module, "/")[0])


def main_module(main: Column) -> Column:
    """without the last extension and leading dots and slashes; '' is `index`."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(main, F.lit("")), r"\.[^./]*$", ""), r"^[./]+", "")
    return F.when(bare == "", "index").otherwise(bare)


def trim_extension(s: Column, extension: Column) -> Column:
    """drops every occurrence."""
    return F.when(extension == "", s).otherwise(F.replace(s, extension, F.lit("")))


def strip_newlines(s: Column) -> Column:
    """F22."""
    return F.replace(s, F.lit("\n"), F.lit(""))


@F.pandas_udf(T.StringType())
def content_class(content: pd.Series) -> pd.Series:
    """Of bytes without an extension: binary if a zero byte or broken UTF-8 shows in the first 8 kB, else text."""
    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        head = bytes(b[:8192])
        return "binary" if b"\0" in head or head.decode(errors="ignore").encode() != head and len(b) <= 8192 else "text"

    return content.map(one)


def file_class(path: Column, content: Column | None = None) -> Column:
    """the last extension; without one, by content."""
    extension = F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    return F.when(extension != "", extension).otherwise(content_class(content) if content is not None else F.lit(None))


def tarball_path(name: Column, version: Column) -> Column:
    """two one-letter folders; a scope's slash becomes an underscore."""
    flat = F.replace(name, F.lit("/"), F.lit("_"))
    second = F.coalesce(F.nullif(F.substring(name, 2, 1), F.lit("")), F.lit("_"))
    return F.concat(F.substring(name, 1, 1), F.lit("/"), second, F.lit("/"), flat, F.lit("-"), version, F.lit(".tgz"))


def url_name(name: Column) -> Column:
    """§1.4: a scoped name in a URL."""
    return F.replace(name, F.lit("/"), F.lit("%2f"))


def intact(content: Column, shasum: Column) -> Column:
    """F25."""
    return F.sha1(content) == shasum


def log_shift(x: Column) -> Column:
    """F26."""
    return F.log10(x + F.lit(0.01))


def name_version(file: Column) -> Column:
    """split at the last dash before `.tgz`."""
    p = r"^(?:.*/)?([^/]*)-([^-]*)\.tgz$"
    return F.struct(F.regexp_extract(file, p, 1).alias("name"), F.regexp_extract(file, p, 2).alias("version"))


def reach_label(layer: Column, package: Column, via: Column) -> Column:
    """F30."""
    return F.format_string("%02d_%s_%s", layer, package, via)


def type_histogram(df: DataFrame, column: str) -> DataFrame:
    """F31."""
    return df.groupBy(F.schema_of_variant(column).alias("type")).count()


@F.pandas_udf(T.StringType())
def gunzip(value: pd.Series) -> pd.Series:
    """The text of a gzip document; null for an empty one."""
    return value.map(lambda b: gzip.decompress(bytes(b)).decode() if b is not None and len(b) else None)


@F.pandas_udf(T.BinaryType())
def gzipped(value: pd.Series) -> pd.Series:
    return value.map(lambda s: gzip.compress(s.encode(), mtime=0) if s is not None else None)
