import json
import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.functions import hashes
from graphloom.operators import parts
from graphloom.sources import packages as p

yaml = pytest.importorskip("yaml")


def write(root, name, text):
    f = root / name
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_text(text)


def test_manifests(spark, tmp_path):
    write(tmp_path, "pubspec.yaml", "name: app\npublish_to: none\ndependencies:\n  http: ^1.0.0\n  core:\n    path: packages/core\ndev_dependencies:\n  test: any\ndependency_overrides:\n  http:\n  app: any\n")
    write(tmp_path, "packages/core/pubspec.yaml", "name: core\n")
    write(tmp_path, "build/x/pubspec.yaml", "name: built\n")
    write(tmp_path, "pubspec.lock", "packages:\n  http:\n    version: 1\n")
    pk, dep = p.manifests(spark, str(tmp_path))
    assert sorted((r.root, r.name, r.application) for r in pk.collect()) == [("", "app", True), ("packages/core", "core", False)]
    assert {(r.section, r.dep, r.source) for r in dep.collect()} >= {("dependencies", "http", "hosted"), ("dependencies", "core", "path"), ("dev_dependencies", "test", "hosted")}
    assert {(r.dep, r.reason) for r in p.misconfigured_overrides(dep).collect()} == {("http", "empty"), ("app", "self")}
    assert p.locked(str(tmp_path)) == {"http"} and p.locked(str(tmp_path / "packages")) is None
    assert p.package_above(str(tmp_path / "packages/core/lib"))[0] == str(tmp_path / "packages/core")
    files = spark.createDataFrame([("lib/a",), ("packages/core/lib/b",)], "path string")
    assert [r.path for r in p.workspace_scope(files, pk, ["core"]).collect()] == ["packages/core/lib/b"]
    assert [r.path for r in p.workspace_scope(files, pk, ["*", "!core"]).collect()] == ["lib/a"]
    with pytest.raises(p.ConfigError):
        p.workspace_scope(files, pk, ["none"])
    with pytest.raises(p.ConfigError):
        p.parse_yaml("a: 1\na: 2")


def test_config_and_packs(spark, tmp_path):
    write(tmp_path, "graphloom.jsonc", '{"rules": {} // c\n}')
    assert p.load_config(str(tmp_path), {"rules"}) == {"rules": {}}
    with pytest.raises(p.ConfigError):
        p.load_config(str(tmp_path), {"other"})
    write(tmp_path, "t.toml", "a = 1")
    assert p.load_config(str(tmp_path), {"a"}, str(tmp_path / "t.toml")) == {"a": 1}
    rules = p.policy_rules(spark, [{"name": "x", "rules": [{"id": "r", "kind": "banned-call", "patterns": ["print", "debug*"]}]}])
    assert rules.count() == 2
    with pytest.raises(p.ConfigError):
        p.policy_rules(spark, [{"name": "x", "rules": [{"kind": "banned-call"}]}])
    count = lambda *n: p.preset_rules(spark, list(n)).count()
    assert [count(n) for n in p.PRESETS] == [10, 9, 15, 8] and count("layered", "hexagonal") == 12


def test_version_control(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init", "-q")
    write(tmp_path, "a.dart", "one\ntwo\n")
    git("add", ".")
    git("commit", "-qm", "x")
    write(tmp_path, "a.dart", "one\nnew\ntwo\n")
    write(tmp_path, "b.dart", "x")
    assert sorted(r.path for r in p.changed_files(spark, str(tmp_path), "HEAD").collect()) == ["a.dart", "b.dart"]
    assert sorted(map(tuple, p.changed_lines(spark, str(tmp_path), "HEAD").collect())) == [("a.dart", 2), ("b.dart", 1)]
    assert [tuple(r) for r in p.files_at(spark, str(tmp_path), "HEAD").collect()] == [("a.dart", "one\ntwo\n")]
    assert [r.path for r in p.tracked_files(spark, str(tmp_path)).collect()] == ["a.dart"]


def test_needed_packages(spark, tmp_path):
    graph = spark.createDataFrame([("app", "a"), ("a", "b"), ("x", "y")], "name string, dependency string")
    assert sorted(r.name for r in p.needed_packages(graph, "app").collect()) == ["a", "b"]
    write(tmp_path, ".dart_tool/package_config.json", json.dumps({"packages": [{"name": "a", "rootUri": "../"}]}))
    assert p.package_config(spark, str(tmp_path)).first().name == "a"


def test_parts(spark):
    part_rows = [("lib/l", "lib/p1", 0), ("lib/l", "lib/p2", 1), ("lib/m", "lib/p1", 2), ("lib/l", "lib/p3", 3), ("lib/l", "lib/p4", 4), ("lib/l", "lib/gone", 5)]
    files = [("lib/l", "ll", None, None), ("lib/m", None, None, None), ("lib/p1", None, "l", "lib/l"), ("lib/p2", None, None, None), ("lib/p3", None, "zz", None), ("lib/p4", None, "m", "lib/m"), ("lib/o", None, "l", "lib/l")]
    got = parts.part_problems(spark.createDataFrame(part_rows, "library string, part string, ord int"), spark.createDataFrame(files, "path string, library_name string, part_of string, part_of_uri string"))
    assert sorted((r.part, r.library, r.reason) for r in got.collect()) == [("lib/o", "lib/l", "orphan"), ("lib/p1", "lib/m", "duplicate-owner"), ("lib/p2", "lib/l", "missing-part-of"), ("lib/p3", "lib/l", "name-mismatch"), ("lib/p4", "lib/l", "uri-mismatch")]


def test_copies_and_boundaries(spark):
    rows = [(1, "app", "v1", "a", 1, 5), (1, "app", "v2", "a", 1, 5), (2, "app", "v1", "a", 1, 5), (2, "lib", "z", "a", 1, 5)]
    inst = spark.createDataFrame(rows, "gid int, identity string, root string, path string, start_line int, end_line int")
    assert [r.gid for r in parts.mirrored(inst).collect()] == [1]
    assert sorted((r.gid, r.root) for r in parts.canonical_copies(inst).collect()) == [(1, "v1"), (2, "v1"), (2, "z")]
    pairs = spark.createDataFrame([("b", "model", "m", 1, 20), ("b", "entity", "e", 1, 20)], "boundary string, side string, path string, start_line int, end_line int")
    inst = spark.createDataFrame([(1, "m", 2, 6), (1, "e", 3, 7), (2, "m", 2, 6), (2, "x", 3, 7)], "gid int, path string, start_line int, end_line int")
    assert [r.gid for r in parts.mapping_boundaries(inst, pairs).collect()] == [1]


def test_credits_and_exposure(spark):
    refs = spark.createDataFrame([("f", "size"), ("f", "userProvider")], "path string, name string")
    members = spark.createDataFrame([("size", "Ext")], "name string, owner string").unionByName(parts.provider_names(spark.createDataFrame([("User",)], "name string")))
    assert sorted(r.name for r in parts.credited(refs, members).collect()) == ["Ext", "User", "size", "userProvider"]
    e = spark.createDataFrame([("l", False, None, "A", "x", "x"), ("l", False, None, "A", "y", "y"), ("l", False, "p", "A", "z", "z")], "library string, exported boolean, prefix string, name string, supplier string, declaring string")
    assert [(r.name, r.suppliers) for r in parts.name_exposure(e).collect()] == [("A", 2)]


def test_hashes(spark):
    assert f"{hashes.fnv64(b'a'):016x}" == "af63dc4c8601ec8c"
    values = [b"", b"a", b"foobar", b"a" * 40]
    assert hashes.fnv64_many(values).tolist() == [hashes.fnv64(v) for v in values]
    df = spark.createDataFrame([("p", 3, "s"), ("p", None, None)], "path string, line bigint, symbol string")
    got = df.select(hashes.stable_id("path", "line", "symbol").alias("i"), hashes.finding_fingerprint(F.col("path")).alias("f")).collect()
    assert got[0].i == f"{hashes.fnv64(b'p' + (3).to_bytes(8, 'little') + b's'):016x}" and got[1].f == f"finding:{hashes.fnv64(b'p'):016x}"
