from pyspark.sql import functions as F

from graphloom.operators import graph as g
from graphloom.sources import dart

SOURCE = r'''
library app.main;
import 'dart:io';
import 'a.dart' if (dart.library.io) 'io.dart' if (x.y == 'z') 'z.dart' as p show A, B hide C;
export "src/b.dart" hide D;
part 'main.g.dart';

/* block /* nested */ class Hidden {} */
// class Also {}
const limit = 3, other = 'a $limit ${p.A.name(limit)}';
typedef Cb = void Function(int);
enum Color { red, green(1), blue; const Color([this.n = 0]); final int n; }
mixin M on Base {}
extension Ext on String { int get size => length; }

@Route(path: '/x')
class Page<T extends Object> extends Base<T> with M, N implements p.I {
  Page(this.id, {required this.name}) : super(id);
  Page.named() : id = 0, name = '';
  factory Page.of(Map<String, int> m) => Page(m['id']!, name: '');
  final int id;
  String name = 'x', tail = 'y';
  int? maybe;
  int get twice => id * 2;
  set twice(int v) { name = '$v'; }
  bool operator ==(Object o) => o is Page && o.id == id || false;
  static Future<void> load(int n) async {
    if (n > 0 && n < 5 && n != 3) {
      for (final i in [1, 2]) {
        if (i == n) continue;
      }
    } else if (n == 0) {
      print(n > 1 ? 'a' : 'b');
    }
    final f = (int z) { if (z > 0) return 1; return 0; };
    switch (n) { case 1: break; case 2: break; default: break; }
    try { await f(1); } on Exception catch (e) { rethrow; }
    int? q = maybeOf(n) ?? 3;
    GoRoute(path: '/users/:id', name: 'user', builder: (c) => Page(1, name: ''));
  }
}

void main(List<String> args) => runApp(Page(1, name: args.first));
int _hidden = 0;
'''


def test_directives():
    d = dart.facts(SOURCE)["directives"]
    assert [(x["kind"], x["uri"], x["variable"], x["expected"], x["ordinal"]) for x in d] == [
        ("import", "dart:io", None, None, 0), ("import", "a.dart", None, None, 0), ("import", "io.dart", "dart.library.io", "true", 1), ("import", "z.dart", "x.y", "z", 2),
        ("export", "src/b.dart", None, None, 0), ("part", "main.g.dart", None, None, 0),
    ]
    assert d[1]["prefix"] == "p" and d[1]["combinators"] == [{"kind": "show", "names": ["A", "B"]}, {"kind": "hide", "names": ["C"]}]
    f = dart.facts("part of 'main.dart';\nint x = 1;")
    assert f["part_of"] == "main.dart" and dart.facts(SOURCE)["library"] == "app.main"


def test_declarations_and_members():
    f = dart.facts(SOURCE)
    assert f["complete"]
    assert [(x["kind"], x["name"]) for x in f["declarations"]] == [("variable", "limit"), ("variable", "other"), ("type-alias", "Cb"), ("enum", "Color"), ("mixin", "M"), ("extension", "Ext"), ("class", "Page"), ("function", "main"), ("variable", "_hidden")]
    got = {(m["owner"], m["kind"], m["name"]) for m in f["members"]}
    assert {("Color", "enum-constant", "red"), ("Color", "enum-constant", "green"), ("Color", "enum-constant", "blue"), ("Color", "field", "n"), ("Ext", "getter", "size")} <= got
    assert {("Page", "constructor", "Page"), ("Page", "constructor", "named"), ("Page", "constructor", "of"), ("Page", "field", "id"), ("Page", "field", "name"), ("Page", "field", "tail"), ("Page", "field", "maybe"), ("Page", "getter", "twice"), ("Page", "setter", "twice"), ("Page", "operator", "=="), ("Page", "method", "load")} <= got
    assert sorted((s["clause"], s["name"]) for s in f["supertypes"] if s["owner"] == "Page") == [("extends", "Base"), ("implements", "p.I"), ("with", "M"), ("with", "N")]


def test_complexity():
    f = {x["symbol"]: (x["cyclomatic"], x["cognitive"]) for x in dart.facts(SOURCE)["functions"]}
    # if, &&, && (a chain: one), for, if, else-if, ternary, two cases, catch, ??
    assert f["Page.load"][0] == 12
    assert f["<closure>"] in [(2, 1), (1, 0)] and f["main"] == (1, 0) and f["Page.=="][0] == 3
    one = dart.facts("void f(a) { if (a) { while (a) { if (a) {} } } }")["functions"][0]
    assert (one["cyclomatic"], one["cognitive"]) == (4, 1 + 2 + 3)


def test_references_calls_routes_literals():
    f = dart.facts(SOURCE)
    refs = {(r["qualifier"], r["name"]) for r in f["refs"]}
    assert {("A", "name"), ("p", "A"), (None, "limit"), (None, "runApp"), ("args", "first")} <= refs
    assert {"runApp", "maybeOf", "print", "p.A.name", "GoRoute"} <= {c["callee"] for c in f["calls"]}
    assert [(r["route_class"], r["route_path"], r["name"]) for r in f["routes"]] == [("GoRoute", "/users/:id", "user")]
    assert "a $limit ${p.A.name(limit)}" in {x["value"] for x in f["literals"]}
    assert ("<shorthand>", "red") in {(r["qualifier"], r["name"]) for r in dart.facts("Color c = .red;")["refs"]}
    byte = dart.facts("var é = 'ü'; var b = x;")["refs"]
    assert all(r["line"] == 1 for r in byte)


def test_broken_sources_are_marked():
    for bad in ("class A {", "void f() { (", "'open", "}"):
        assert not dart.facts(bad)["complete"]
    assert dart.facts("")["complete"]


def test_project_end_to_end(spark):
    files = [
        ("lib/main.dart", "import 'src/a.dart';\nimport 'package:app/src/b.dart';\nimport 'gone.dart';\nimport 'dart:io';\nvoid main() { usedA(); }"),
        ("lib/src/a.dart", "import '../main.dart';\nvoid usedA() {}\nvoid unusedA() {}"),
        ("lib/src/b.dart", "class B {}"),
        ("lib/src/dead.dart", "class Dead {}"),
    ]
    x = dart.extract(spark.createDataFrame(files, "path string, source string")).cache()
    edges, missing = dart.edges(x, "app")
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("lib/main.dart", "lib/src/a.dart"), ("lib/main.dart", "lib/src/b.dart"), ("lib/src/a.dart", "lib/main.dart")]
    assert [r.uri for r in missing.collect()] == ["gone.dart"]
    reached = g.reachable(edges, spark.createDataFrame([("lib/main.dart",)], "n string"))
    assert [r.path for r in g.dead(x.select("path"), reached, "path").collect()] == ["lib/src/dead.dart"]
    assert sorted(r.node for r in g.cycles(edges).collect()) == ["lib/main.dart", "lib/src/a.dart"]
    from graphloom.operators import symbols as y

    declared = dart.fact(x, "declarations")
    counts = y.reference_counts(dart.fact(x, "refs"), reached.withColumnRenamed("node", "path"), ["name"])
    unused = y.unreferenced(declared.where(F.col("path").startswith("lib/src/")), counts, ["name"])
    assert sorted(r.name for r in unused.collect()) == ["B", "Dead", "unusedA"]
    x.unpersist()
