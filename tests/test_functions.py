"""Golden tables of the scalar rules."""

import gzip

import pytest
from pyspark.sql import functions as F

from depweave.functions import normalize, scripts, semver

DIFFS = [
    ("0.0.1", "1.0.0", "major"), ("0.0.1", "0.1.0", "minor"), ("0.0.1", "0.0.2", "patch"), ("0.0.1-foo", "0.0.1-foo.bar", "prerelease"), ("0.10.0", "1.0.0-rc.1", "prerelease"), ("1.0.0-rc.3", "1.0.0", "major"),
    ("1.8.6-beta", "1.8.6", "patch"), ("1.8.0-beta", "1.8.0", "minor"), ("1.1.2-beta.0", "1.1.2", "patch"), ("0.0.1", "0.0.1+foo.bar", "build"), ("0.0.1+foo.bar", "0.0.1", "build"), ("0.0.1", "0.0.1", "equal"), ("0.0.2", "0.0.1", "downgrade"),
]


def test_semver_diff_and_order(spark):
    rows = spark.createDataFrame(DIFFS, "a string, b string, want string")
    assert rows.where(semver.diff(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    order = ["0.1.10", "0.9.0-beta.2", "0.9.0-beta.8", "0.9.0-beta.10", "1.1.0-beta.2", "2.1.4"]
    got = spark.createDataFrame([(v,) for v in reversed(order)], "v string").orderBy(semver.key(F.col("v"))).collect()
    assert [r.v for r in got] == order
    bad = spark.createDataFrame([("1.2",), ("x",), (None,)], "v string")
    assert bad.where(semver.is_semver(F.col("v"))).count() == 0


@pytest.mark.parametrize(
    ("version", "text", "node", "want"),
    [
        ("1.2.3", ">=1.0.0 <2.0.0", False, True), ("2.0.0", ">=1.0.0 <2.0.0", False, False), ("3.1.0", "<1.0.0 || >=3.0.0", False, True), ("1.4.9", "1.4.x", False, True), ("1.5.0", "1.4.x", False, False),
        ("1.9.0", "^1.2.3", True, True), ("2.0.0", "^1.2.3", True, False), ("0.2.9", "^0.2.3", True, True), ("0.3.0", "^0.2.3", True, False), ("0.0.4", "^0.0.3", True, False), ("1.2.9", "~1.2.3", True, True), ("1.3.0", "~1.2.3", True, False),
        ("1.3.0-beta", "^1.2.3", True, False), ("1.2.3-beta.2", ">=1.2.3-beta.1", True, True), ("5.0.0", "*", True, True), ("1.5.0", "1.2.3 - 1.6.0", True, True), ("v1.2.3", "=1.2.3", True, True), ("bad", "*", True, None),
    ],
)
def test_ranges(version, text, node, want):
    assert semver.satisfies_one(version, text, node) is want


def test_variant_rules(spark):
    def one(column, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("v", F.try_parse_json("t"))
        return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]

    assert one(normalize.version_ref, '"1.0"', '{"version": "2"}', "{}", "[1]", "3") == ["1.0", "2", "", "", ""]
    assert one(normalize.license_text, '"MIT"', '["MIT", {"type": "BSD"}]', '["MIT", 3]', '{"type": "ISC"}', "7") == ["MIT", "MIT|BSD", "MIT|", "ISC", ""]
    assert one(lambda v: normalize.license_text(v, True), '[{"type": {"type": "X"}}]') == ["X"]
    people = one(normalize.people, '"Ann Lee <a@b>"', '["rreverser"]', '[{"name": "Bo", "email": "e"}]', '{"name": "", "0": {"name": "In"}}', "null", "5")
    assert [[p.name for p in x] for x in people] == [["Ann Lee"], ["rreverser"], ["Bo"], ["In"], [], []]
    assert one(normalize.author_text, '"A"', '["A", "B"]', '{"name": "C"}', "null") == ["A", "A,B,", "C", ""]
    assert one(normalize.main_text, '"a.js"', '["a", "b"]', '{"b": "2", "a": "1"}') == ["a.js", "a,b,", "Key: a Value: 1 , Key: b Value: 2 , "]
    times = one(lambda v: normalize.time_of(v).cast("string"), '"2017-05-01T00:00:00.000Z"', '{"time": "2016-01-01T10:00:00Z"}', '"x"', "null", '"1970-01-01T00:00:00Z"')
    assert times == ["2017-05-01 00:00:00", "2016-01-01 10:00:00", *["1970-01-01 00:00:01"] * 3]


def test_text_rules(spark):
    def one(column, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]

    assert one(normalize.person_name, "rreverser", "Aadit M Shah (https://x) <y>", "9user") == ["rreverser", "Aadit M Shah", ""]
    assert one(normalize.package_of, "aws-sdk/clients/s3", "aws-sdk", "@storybook/react/views/data", "@storybook/react") == ["aws-sdk", "aws-sdk", "@storybook/react", "@storybook/react"]
    assert one(normalize.main_module, "./lib/aws.js", "", None, "dist/client/index.js", "index.min.js") == ["lib/aws", "index", "index", "dist/client/index", "index.min"]
    assert one(lambda t: normalize.tarball_path(t, F.lit("1.0.0")), "lodash", "@angular/core") == ["l/o/lodash-1.0.0.tgz", "@/a/@angular_core-1.0.0.tgz"]
    assert one(normalize.is_local_import, ".", "..", "/a", "./a", "../a", "a", ".a") == [True] * 5 + [False] * 2
    assert one(lambda t: normalize.trim_extension(t, F.lit(".js")), "a.js.js") == ["a"]
    assert [tuple(x) for x in one(normalize.name_version, "a/b/left-pad-1.0.0.tgz", "x-1.0.0-rc.1.tgz")] == [("left-pad", "1.0.0"), ("x-1.0.0", "rc.1")]
    blob = spark.createDataFrame([(gzip.compress(b"hello"),), (b"",), (None,)], "b binary")
    assert [r[0] for r in blob.select(normalize.gunzip("b")).collect()] == ["hello", None, None]
    files = spark.createDataFrame([("a/b.min.js", b""), ("bin/x", b"\x00\x01"), ("bin/y", b"text")], "p string, c binary")
    assert [r[0] for r in files.select(normalize.file_class(F.col("p"), F.col("c"))).collect()] == [".js", "binary", "text"]


def test_imports():
    source = """
    // require('no')
    var foo = require('foo'), b = require("bar").part.x;
    require('side'); const {p, q} = require('pq'); x.require('not'); obj.y = require('z');
    """
    assert scripts.imports(source) == [("foo", "foo", "commonjs", ""), ("b", "bar", "commonjs", "part.x"), ("@side-effect", "side", "commonjs", ""), ("p", "pq", "commonjs", "p"), ("q", "pq", "commonjs", "q"), ("obj.y", "z", "commonjs", "")]
    es = "import 'a'; import d from 'b'; import {x, y as z} from \"c\"; import * as n from 'd'; import e, {f} from './g';"
    assert scripts.imports(es) == [("@side-effect", "a", "es6", ""), ("d", "b", "es6", ""), ("x", "c", "es6", "x"), ("z", "c", "es6", "y"), ("n", "d", "es6", ""), ("e", "./g", "es6", ""), ("f", "./g", "es6", "f")]
    assert scripts.is_source("a/b.ts") and not scripts.is_source("node_modules/x.js") and scripts.is_source("bin/run", "#!/usr/bin/env node\n")


def test_used_dependencies(spark):
    files = spark.createDataFrame([("p", "package/i.js", "var a = require('foo/lib'); import b from './c'; require('oauth')"), ("p", "package/package.json", "﻿{}"), ("p", "x/package.json", "{1}")], "package string, path string, source string")
    manifest = spark.createDataFrame([("p", ["foo"], ["oaut"], None)], "package string, dependencies array<string>, peerDependencies array<string>, optionalDependencies array<string>")
    got = scripts.used_dependencies(manifest, scripts.analyse(files, "imports")).first()
    assert sorted(got.used) == ["foo/lib", "oauth"] and got.imported == ["./c"] and got.dependencies == ["foo", "oaut"]
    assert scripts.manifest_of(files).first().source == "{}"
