from graphloom.operators import detectors as d
from graphloom.operators import inventory
from graphloom.sources import dart

SOURCE = r"""
// const apiKey = 'ghp_abcdefghijklmnopqrstuvwxyz';
const apiKey = 'ghp_abcdefghijklmnopqrstuvwxyz';
const password = 'your-password-here1';
const authToken = 'a8f3k2m9x7q1z';
final fire = 'AIzaSyA1234567890abcdefghijklmnop';
client.get('http://api.example.org/v1');
client.get('http://localhost:8080');
final u = Uri.http('x', '/');
client.badCertificateCallback = (c, h, p) => true;
client.badCertificateCallback = (c, h, p) => false;
client.badCertificateCallback = check;
c.setJavaScriptMode(JavaScriptMode.unrestricted);
Process.run('ls', ['-l']);
Process.run('sh', ['-c', cmd]);
Process.start(program, args);
db.rawQuery('select * from t where id = $id');
db.rawQuery('select * from t where id = ?', [id]);
prefs.setString('auth_token', t);
final nonce = Random().nextInt(9);
final rng = Random();
final sessionId = rng.nextInt(5);
"""


def test_categories(spark):
    files = spark.createDataFrame([("a", SOURCE)], "path string, source string")
    found, blind = d.security(files)
    got = sorted((r.line, r.category) for r in found.collect())
    assert got == [(3, "hardcoded-secret"), (5, "hardcoded-secret"), (6, "firebase-api-key"), (7, "insecure-transport"), (9, "insecure-transport"), (10, "tls-bypass"), (13, "webview-risk"), (15, "process-execution"), (16, "process-execution"), (17, "raw-sql"), (19, "plain-secret-storage"), (20, "weak-randomness")]
    assert sorted((r.line, r.category) for r in blind.collect()) == [(12, "tls-bypass"), (22, "weak-randomness")]
    per = {(r.category, r.sink): (r.confidence, r.n_occurrences) for r in inventory.grouped(found, ["category", "sink"]).collect()}
    assert per["hardcoded-secret", "forge-token"] == ("high", 1)


def test_widgets(spark):
    src = "class A extends StatelessWidget { Widget build(c) => B(); }\nclass B extends StatelessWidget {}\nclass Base extends StatefulWidget {}\nclass Sub extends Base {}\nclass _P extends HookWidget {}\nvoid main() { A(); Sub(); }"
    x = dart.extract(spark.createDataFrame([("a", src)], "path string, source string"))
    sup = dart.fact(x, "supertypes")
    w = d.widget_classes(sup)
    assert {(r.widget, r.kind, r.private) for r in w.collect()} == {("A", "stateless", False), ("B", "stateless", False), ("Base", "stateful", False), ("_P", "hook", True)}
    assert [r.widget for r in d.unrendered(w, dart.fact(x, "calls"), sup).collect()] == ["_P"]


def test_guards_and_params(spark):
    rows = [("f", 1, 0, 1, True, False, False), ("f", 1, 1, 2, False, True, False), ("f", 1, 2, 3, False, False, True), ("f", 2, 0, 5, True, False, False), ("f", 2, 1, 6, False, False, True), ("f", 3, 0, 8, True, False, False)]
    s = spark.createDataFrame(rows, "path string, block int, pos int, line int, awaits boolean, guards boolean, uses boolean")
    assert [r.line for r in d.mounted_guards(s).collect()] == [5]
    p = spark.createDataFrame([("f", "W", "key", 1, 0), ("f", "W", "a", 1, 5), ("f", "W", "b", 2, 0), ("f", "W", "b", 3, 0)], "path string, owner string, name string, line int, col int")
    r = spark.createDataFrame([("f", "W", "a")], "path string, owner string, name string")
    assert [(x.name, x.line) for x in d.unused_params(p, [r]).collect()] == [("b", 2)]


def test_mixed_route_style(spark):
    calls = spark.createDataFrame([("a", "context.go", 3), ("a", "print", 4)], "path string, callee string, line int")
    routes = lambda *c: spark.createDataFrame([(x,) for x in c], "route_class string")
    assert [r.line for r in d.mixed_route_style(routes("GoRoute", "TypedGoRoute"), calls).collect()] == [3]
    assert d.mixed_route_style(routes("GoRoute"), calls).count() == 0


def test_every_literal_of_a_line_counts(spark):
    key = "ghp_abcdefghijklmnopqrstuvwxyz"
    lines = [f"prefs.setString('api_key', '{key}');", f"m = {{'token': \"{key}\"}};", f"headers['Authorization'] = '{key}';", f"f('', 'your-password', '{key}');", f"f(\"it's\", '{key}');", "m = {'token': 'a8f3k2m9x7q1z'};", "f(token: 'short', id: 'device-12345678');"]
    files = spark.createDataFrame([("a", "\n".join(lines))], "path string, source string")
    assert sorted((r.line, r.confidence) for r in d.hardcoded_secrets(files).collect()) == [(1, "high"), (2, "high"), (3, "high"), (4, "high"), (5, "high"), (6, "medium")]
