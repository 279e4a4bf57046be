import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as s
from graphloom.operators import clones, findings, health, program, runtime
from graphloom.operators import joins as j
from graphloom.operators import symbols as y
from graphloom.sources import readers, writers


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first().v


def test_duplication_threshold_is_strict(spark):
    lines = spark.createDataFrame([("a", i) for i in range(1, 11)], "path string, line bigint")
    group = spark.createDataFrame([([("a", 1, 1)],)], "instances array<struct<path:string,start_line:bigint,end_line:bigint>>")
    assert clones.stats(lines, group, 1000).first().exceeded is False
    got = clones.stats(lines, group, 999).first()
    assert (got.duplicated_bp, got.exceeded) == (1000, True)


def test_two_files_of_five_lines(spark):
    text = "int a = 1;\nint b = 2;\nint c = 3;\nint d = 4;\nreturn a + b;"
    files = spark.createDataFrame([("x/a", text), ("x/b", text)], "path string, source string")
    lines = clones.normalised_lines(files, "strict")
    groups = clones.groups(clones.windows(lines, 5, 10))
    assert [len(r.instances) for r in groups.collect()] == [2]
    got = clones.stats(lines, groups).first()
    assert (got.analyzed_lines, got.duplicated_lines, got.duplicated_bp) == (10, 10, 10000)
    assert clones.groups(clones.windows(lines, 5, 10), skip_local=True).count() == 0


def test_renamed_identifiers_are_semantic_clones(spark):
    a = "\n".join(f"final {v} = compute({v}, {i});" for i, v in enumerate("abcdefghi"))
    b = "\n".join(f"final {v} = compute({v}, {i});" for i, v in enumerate("qrstuvwxy"))
    files = spark.createDataFrame([("a", a), ("b", b)], "path string, source string")
    got = lambda mode: [r.line_count for r in clones.groups(clones.windows(clones.normalised_lines(files, mode), 9, 20)).collect()]
    assert got("semantic") == [9] and got("strict") == []


def greedy(groups):
    kept = []
    for g in groups:
        if not any(all(any(p == q and a <= d and c <= b for q, c, d in k) for p, a, b in g) for k in kept):
            kept.append(g)
    return kept


def test_collapse_is_the_plain_loop(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(60):
        inst = sorted({(rng.choice("abcdef"), a, a + rng.randint(1, 6)) for a in rng.sample(range(60), rng.choice([2, 2, 3]))})
        rows.append((f"t{i:02}", inst, 50, 5 + i % 3, f"dup:{i:08x}"))
    g = spark.createDataFrame(rows, "text string, instances array<struct<path:string,start_line:bigint,end_line:bigint>>, token_count bigint, line_count bigint, fingerprint string")
    ranked = sorted(rows, key=lambda r: (-len(r[1]), -r[3], r[1][0][0], r[1][0][1], r[4], r[0]))
    want = greedy([r[1] for r in ranked])
    got = sorted([tuple(i) for i in r.instances] for r in clones.collapse(g).collect())
    assert got == sorted(want)


def test_crap_and_percent(spark):
    lit = lambda x: F.lit(x).cast("bigint")
    assert one(spark, s.crap(lit(4), lit(0), lit(4))) == 20
    assert one(spark, s.crap(lit(4), lit(4), lit(4))) == 4
    assert one(spark, s.crap(lit(3), lit(1), lit(3))) == 6  # 9 * 8/27 up to 3, and 3
    assert one(spark, s.crap(lit(2_000), lit(0), lit(3_000))) == 4_002_000
    assert one(spark, s.percent(lit(1), lit(8))) == 13
    f = spark.createDataFrame([("lib/main.dart", "f", 1, 6, 4)], "path string, symbol string, line bigint, end_line bigint, cyclomatic bigint")
    lcov = readers.lcov(readers.text_lines(spark.createDataFrame([("l", "SF:lib/main.dart\nDA:2,0\nDA:3,0\nDA:4,0\nDA:5,0\nend_of_record\n")], "path string, source string")))
    got = health.crap_scores(f, lcov).first()
    assert (got.crap, got.covered_lines, got.executable_lines) == (20, 0, 4)


def test_lcov_rows_outside_a_record_are_errors(spark):
    bad = spark.createDataFrame([("l", "DA:1,1")], "path string, source string")
    with pytest.raises(Exception, match="before SF"):
        readers.lcov(readers.text_lines(bad)).collect()


def test_traffic_shares(spark):
    calls = spark.createDataFrame([("a", 1, "f", 90), ("b", 1, "g", 9), ("c", 1, "h", 1)], "path string, line bigint, symbol string, invocations bigint")
    f = spark.createDataFrame([], "path string, symbol string, line bigint, end_line bigint, cyclomatic bigint")
    callers = spark.createDataFrame([], "node string, n_callers bigint")
    got = runtime.importance(runtime.observations(calls), f, callers, runtime.total_of(calls)).orderBy(F.desc("score"), "path").collect()
    assert [(r.path, r.score) for r in got] == [("a", 63), ("b", 6), ("c", 0)]
    hot = spark.createDataFrame([("a", 1, "f", 20)], "path string, line bigint, symbol string, invocations bigint")
    e = spark.createDataFrame([("x", "a")], "src string, dst string")
    assert runtime.blast_radius(hot, hot, e, runtime.total_of(hot), 10).first().risk == "medium"


def test_history_deltas(spark, tmp_path):
    p = tmp_path / "h.jsonl"
    p.write_text('{"timestamp":"1","surfaced":1,"resolved":1,"suppressed":0}\nnot json\n{"timestamp":"2","surfaced":3,"resolved":3,"suppressed":1}\n')
    assert [r.surfaced for r in readers.impact_history(spark, str(p)).orderBy("timestamp").collect()] == [1, 3]


def test_paths_and_routes(spark):
    rows = [("a/./b/../c", "a/c"), ("../x", "../x"), ("/a/../../b", "/b"), ("a/../..", ".."), ("", "")]
    df = spark.createDataFrame(rows, "p string, want string")
    assert [(r.want, r.got) for r in df.select("want", s.normalized_path(F.col("p")).alias("got")).collect()] == [(w, w) for _, w in rows]
    assert one(spark, s.route_key(F.lit("users//:id/x/"))) == "/users/:/x"
    assert one(spark, s.fnv32(F.lit("abc"))) == "0541574b"
    assert one(spark, s.fnv32(F.lit(""))) == f"{2216829733:08x}"
    for raw, want in [("a%20b.dart", "a b.dart"), ("a+b.dart", "a+b.dart"), ("%ff.dart", "%ff.dart"), ("100%.dart", "100%.dart")]:
        assert one(spark, readers.percent_decoded(F.lit(raw))) == want
    for url, want in [("package:app/src/a.dart", "lib/src/a.dart"), ("org-dartlang-app:///lib/a.dart", "lib/a.dart"), ("file:///r/a.dart", "/r/a.dart"), ("https://h/x/lib/b.dart", "lib/b.dart"), ("https://h/b.dart", None), ("a.js", None)]:
        assert one(spark, readers.runtime_path(F.lit(url))) == want


def test_globs(spark):
    for pattern, value, want in [("lib/*.dart", "lib/a/b.dart", True), ("a?c", "abc", True), ("a.c", "abc", False), ("*", "", True), ("x[ab]", "xb", True)]:
        import re

        assert bool(re.match(s.glob_regex(pattern), value)) is want
        if "[" not in pattern:
            assert one(spark, s.glob_match(F.lit(value), F.lit(pattern))) is want


def test_prefix_rules_go_by_component(spark):
    e = spark.createDataFrame([("lib/domain/a", "lib/ui/b"), ("lib/domains/a", "lib/ui/b")], "src string, dst string")
    rule = spark.createDataFrame([("lib/domain", "lib/ui")], "rule_from string, rule_disallow string")
    assert [r.src for r in j.prefix_rules(e, rule).collect()] == ["lib/domain/a"]


def test_owner_sections_and_last_match(spark):
    text = "# c\n* @all\n[Team]\nlib/*.dart @a @b\nlonely\n"
    rules = readers.codeowners(readers.text_lines(spark.createDataFrame([("o", text)], "path string, source string")))
    got = {r.pattern: (r.owners, r.section) for r in rules.collect()}
    assert got == {"*": (["@all"], None), "lib/*.dart": (["@a", "@b"], "Team")}
    files = spark.createDataFrame([("lib/a.dart",), ("x",)], "path string")
    won = j.last_match(files, rules, s.glob_match(F.col("path"), F.col("pattern")), ["path"], "ord")
    assert {r.path: r.owners for r in won.collect()} == {"lib/a.dart": ["@a", "@b"], "x": ["@all"]}


def test_diff(spark):
    text = "--- a/x\n+++ b/lib/x.dart\n@@ -1,2 +5,3 @@\n keep\n+new\n-old\n keep\n+new2\n\\ No newline\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n"
    got = readers.diff_lines(readers.text_lines(spark.createDataFrame([("d", text)], "path string, source string")))
    assert sorted(map(tuple, got.collect())) == [("lib/x.dart", 6), ("lib/x.dart", 8)]


def test_show_after_hide(spark):
    combs = F.array(F.struct(F.lit("hide").alias("kind"), F.array(F.lit("A")).alias("names")), F.struct(F.lit("show").alias("kind"), F.array(F.lit("A")).alias("names")))
    assert one(spark, s.visible_last_show_wins(F.lit("A"), combs)) is True
    assert one(spark, s.visible_all(F.lit("A"), combs)) is False
    assert one(spark, s.extension_visible(F.lit("A"), combs, F.lit("p"))) is False


def test_conditional_import(spark):
    b = spark.createDataFrame([("f", 1, 0, 0, None, None), ("f", 1, 0, 1, "io", "true"), ("f", 1, 0, 2, "js", "false")], "path string, line int, col int, ordinal int, variable string, expected string")
    env = lambda rows: spark.createDataFrame(rows, "variable string, value string")
    pick = lambda rows: sorted(r.ordinal for r in y.selected_branches(b, env(rows)).collect())
    assert pick([("io", "true")]) == [1]
    assert pick([("io", "no")]) == [2]  # an absent variable equals false
    assert pick([("io", "no"), ("js", "true")]) == [0]
    assert pick([]) == [0, 1, 2]


def test_suppression_comment_grammar(spark):
    text = "a\n// lint-ignore-next-line dead-file, cycle-x -- because\n// lint-ignore-next-line\n"
    got = readers.suppression_comments(readers.text_lines(spark.createDataFrame([("p", text)], "path string, source string"))).orderBy("line").collect()
    assert [(r.line, r.rules, r.reason) for r in got] == [(2, ["dead-file", "cycle-x"], "because"), (3, [], None)]


def finding(spark, rows):
    return spark.createDataFrame(rows, "rule_id string, kind string, severity string, message string, path string, line bigint, col bigint, safe_to_delete boolean, files array<string>, fingerprint string")


def test_sinks(spark, tmp_path):
    f = finding(spark, [("r/b", "b", "error", "<m>", "p", 2, 0, True, ["q"], "fp"), ("r/a", "a", "warning", "n", "p", 1, 0, False, [], None)])
    report = json.loads(writers.json_report(f, findings.summary(f, ["a"])).first().report)
    assert [x["rule_id"] for x in report["findings"]] == ["r/a", "r/b"] and report["summary"] == {"findings": 2, "a": 1}
    log = json.loads(writers.sarif(f, "t").first().sarif)
    assert [r["ruleId"] for r in log["runs"][0]["results"]] == ["r/a", "r/b"] and len(log["runs"][0]["tool"]["driver"]["rules"]) == 2
    assert "&lt;m&gt;" in writers.html_report(f).first().html
    writers.write_baseline(f, str(tmp_path / "b"), "1", "t")
    known = readers.baseline(spark, str(tmp_path / "b"), "1")
    assert findings.except_baseline(f, known).count() == 0
    with pytest.raises(ValueError):
        readers.baseline(spark, str(tmp_path / "b"), "2")


def test_edits_go_from_the_bottom(spark, tmp_path):
    rows = [("remove-line", "a", 2, True), ("remove-line", "a", 4, True), ("delete-file", "b", 1, True), ("remove-line", "b", 1, True), ("remove-line", "a", 1, False)]
    plan = writers.edit_plan(spark.createDataFrame(rows, "action string, path string, line bigint, safe_to_delete boolean"), ["remove-line", "delete-file"]).collect()
    assert [(r.action, r.path, r.line) for r in plan] == [("delete-file", "b", 1), ("remove-line", "a", 4), ("remove-line", "a", 2)]
    (tmp_path / "a").write_text("1\n2\n3\n4")
    (tmp_path / "b").write_text("x")
    done = writers.apply_edits(str(tmp_path), [(r.action, r.path, r.line, str(r.line)) for r in plan] + [("remove-line", "a", 1, "other")])
    assert [d[2] for d in done] == ["deleted", "removed", "removed", "stale"] and (tmp_path / "a").read_text() == "1\n3"


def test_program_rules(spark):
    call = {"rows": lambda n=3: spark.range(n).select(F.col("id"), (F.col("id") % 2).alias("odd"))}
    p = {"steps": [{"id": "a", "call": "rows", "arguments": {"n": 9}}, {"id": "b", "select": {"from": "a", "where": {"equals": {"odd": 1}}, "fields": ["id"], "limit": 2}}], "return": "b"}
    assert program.run(p, call).count() == 2
    assert len(program.result_rows(program.run(p, call))) == 2
    for bad in ({"steps": [], "return": "a"}, {**p, "return": "z"}, {"steps": [{"id": "a", "call": "rows", "select": {"from": "a"}}], "return": "a"}, {"steps": [{"id": "a", "call": "rows"}] * 2, "return": "a"}, {"steps": [{"id": str(i), "call": "rows"} for i in range(9)], "return": "1"}):
        with pytest.raises(program.ProgramError):
            program.run(bad, call)


def test_program_keeps_all_rows_that_match(spark):
    """No limit is no limit, and one of more than a hundred rows is taken at its word."""
    call = {"rows": lambda: spark.range(1000).select(F.col("id"), (F.col("id") % 2).alias("odd"))}
    pick = lambda **more: {"steps": [{"id": "a", "call": "rows"}, {"id": "b", "select": {"from": "a", "where": {"equals": {"odd": 1}}, **more}}], "return": "b"}
    assert program.run(pick(), call).count() == 500
    assert program.run(pick(limit=300), call).count() == 300


def test_json_comments():
    assert json.loads(readers.without_json_comments('{"a": "//x", /* c */ "b": 1 // d\n}')) == {"a": "//x", "b": 1}


def test_watch_gives_the_batch_result(spark, tmp_path):
    from graphloom.streaming.watch import watch

    root = tmp_path / "src"
    root.mkdir()
    (root / "a.dart").write_text("one\ntwo")
    (root / "build").mkdir()
    (root / "build" / "x.dart").write_text("skipped")
    seen = []
    for k in range(2):
        q = watch(spark, str(root), str(tmp_path / "cp"), lambda f: f.select("path", F.size(F.split("source", "\n")).alias("n")), lambda df, _: seen.append(sorted(map(tuple, df.collect()))))
        q.awaitTermination()
        (root / "b.dart").write_text("x")
    assert seen == [[("a.dart", 2)], [("a.dart", 2), ("b.dart", 1)]]


def test_default_levels_and_aliases(spark):
    kinds = spark.createDataFrame([("code-duplication",), ("private-widget-class",), ("dead-file",)], "kind string")
    assert {r.name: r.level for r in findings.default_levels(kinds).collect()} == {"code-duplication": "warn", "private-widget-class": "off", "dead-file": "error"}
    assert {"unused-dev-deps", "unused-dev-dependencies", "all"} <= set(findings.rule_aliases("x/unused-dev-dependency"))
    assert {"process-exec", "process-execution"} <= set(findings.rule_aliases("x/security-process-execution"))


@pytest.mark.parametrize("small", [10, 0])
def test_suppressed_groups_follow_from_pairs(spark, small):
    """2 goes by 1; 3 stays, as 2 is gone; 4 goes by 3, and 5 by 1, though 4 is gone."""
    ruled = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 4), (5, 1), (6, 5)], "gid long, by long")
    assert sorted(r.gid for r in clones.suppressed(ruled, small).collect()) == [2, 4, 5]
