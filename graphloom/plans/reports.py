"""Report queries: events are findings, in order of time the base and the current run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import findings as f
from graphloom.plans.registry import query
from graphloom.session import table

_COLS = """'scan/' || event_type AS rule_id, CASE WHEN event_type = 'click' THEN 'high-complexity' ELSE event_type END AS kind,
  CASE WHEN event_type IN ('error', 'click') THEN 'error' ELSE 'warning' END AS severity, 'm' || (event_id % 7) AS message, 'lib/u' || user_id || '.dart' AS path,
  event_id % 40 AS line, event_id % 11 AS col, event_id % 13 = 0 AS safe_to_delete, ['lib/u' || (user_id * 3 % 50) || '.dart'] AS files,
  CASE WHEN event_type = 'view' THEN 'p' || (user_id % 20) END AS fingerprint, 's' || (event_id % 5) AS symbol"""
_ID = """CASE WHEN fingerprint IS NOT NULL THEN rule_id || '|' || fingerprint WHEN kind = 'high-complexity' THEN rule_id || '|' || kind || '|' || path || '|' || symbol
  ELSE rule_id || '|' || kind || '|' || path || '|' || array_to_string(files, ',') || '|' || message END"""
FIND = f"""cur AS (SELECT *, {_ID} AS identity FROM (SELECT {_COLS} FROM events WHERE event_id % 2 = 1)),
base AS (SELECT *, {_ID} AS identity FROM (SELECT {_COLS} FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 0))"""
DIR = """dirs AS (SELECT DISTINCT 'lib/u' || user_id || '.dart' AS path, event_id % 40 AS line, CASE WHEN user_id % 3 = 0 THEN ['all'] WHEN user_id % 3 = 1 THEN ['error', 'scan/view'] ELSE ['purchase'] END AS rules,
  CASE WHEN user_id % 2 = 0 THEN 'why' END AS reason FROM events WHERE event_id % 50 = 3)"""


def findings_of(spark: SparkSession, sf_dir: str, base: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.where("event_id % 2 = 0 AND user_id % 3 != 0") if base else e.where("event_id % 2 = 1")
    t, i, u = F.col("event_type"), F.col("event_id"), F.col("user_id")
    file = lambda x: F.concat(F.lit("lib/u"), x.cast("string"), F.lit(".dart"))
    return e.select(
        F.concat(F.lit("scan/"), t).alias("rule_id"), F.when(t == "click", "high-complexity").otherwise(t).alias("kind"), F.when(t.isin("error", "click"), "error").otherwise("warning").alias("severity"),
        F.concat(F.lit("m"), (i % 7).cast("string")).alias("message"), file(u).alias("path"), (i % 40).alias("line"), (i % 11).alias("col"), (i % 13 == 0).alias("safe_to_delete"),
        F.array(file(u * 3 % 50)).alias("files"), F.when(t == "view", F.concat(F.lit("p"), (u % 20).cast("string"))).alias("fingerprint"), F.concat(F.lit("s"), (i % 5).cast("string")).alias("symbol"),
    )


def directives_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    lit = lambda *x: F.array(*map(F.lit, x))
    rules = F.when(u % 3 == 0, lit("all")).when(u % 3 == 1, lit("error", "scan/view")).otherwise(lit("purchase"))
    return table(spark, sf_dir, "events").where("event_id % 50 = 3").select(F.concat(F.lit("lib/u"), u.cast("string"), F.lit(".dart")).alias("path"), (F.col("event_id") % 40).alias("line"), rules.alias("rules"), F.when(u % 2 == 0, "why").alias("reason")).distinct()


def scope_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(50).where("id % 4 = 0").select(F.concat(F.lit("lib/u"), F.col("id").cast("string"), F.lit(".dart")).alias("path"))


_SCOPE = "scope AS (SELECT 'lib/u' || id || '.dart' AS path FROM range(50) r(id) WHERE id % 4 = 0)"

@query("suppressions", f"""WITH {FIND}, {DIR},
m AS (SELECT c.*, EXISTS (SELECT 1 FROM dirs d WHERE d.path = c.path AND c.line = d.line + 1 AND (list_contains(d.rules, 'all') OR list_has_any(d.rules, [c.rule_id, c.kind, split_part(c.rule_id, '/', 2)]))) AS gone FROM cur c),
s AS (SELECT d.path, d.line, d.rules FROM dirs d WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE d.path = c.path AND c.line = d.line + 1 AND (list_contains(d.rules, 'all') OR list_has_any(d.rules, [c.rule_id, c.kind, split_part(c.rule_id, '/', 2)])))),
n AS (SELECT s.path, s.line, arg_min(c.line, (abs(c.line - s.line), c.line)) AS nearest FROM s LEFT JOIN cur c ON c.path = s.path AND (list_contains(s.rules, 'all') OR list_has_any(s.rules, [c.rule_id, c.kind, split_part(c.rule_id, '/', 2)])) GROUP BY 1, 2)
SELECT rule_id, kind, path, line, message, severity FROM m WHERE NOT gone
UNION ALL SELECT 'stale-suppression', 'stale-suppression', path, line, 'unused; nearest ' || coalesce(CAST(nearest AS VARCHAR), 'none'), 'error' FROM n
UNION ALL SELECT 'missing-suppression-reason', 'missing-suppression-reason', path, line, 'no reason', 'error' FROM dirs WHERE reason IS NULL""")
def suppressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.suppress(findings_of(spark, sf_dir), directives_of(spark, sf_dir), True).select("rule_id", "kind", "path", "line", "message", "severity")


@query("union_findings", f"WITH {FIND} SELECT rule_id, path, line, col, message FROM cur UNION ALL SELECT rule_id, path, line, col, message FROM base")
def union_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.union_all([findings_of(spark, sf_dir), findings_of(spark, sf_dir, True)]).select(f.ORDER).orderBy(*f.ORDER)


@query("scope_findings", f"WITH {FIND}, {_SCOPE} SELECT rule_id, path, line, message FROM cur WHERE path IN (SELECT path FROM scope) OR files[1] IN (SELECT path FROM scope)")
def scope_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.in_scope(findings_of(spark, sf_dir), scope_of(spark, sf_dir)).select("rule_id", "path", "line", "message")


@query("scope_intersect", f"WITH {FIND}, {_SCOPE} SELECT path FROM cur INTERSECT SELECT path FROM base INTERSECT SELECT path FROM scope")
def scope_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_of(spark, sf_dir).select("path").intersect(findings_of(spark, sf_dir, True).select("path")).intersect(scope_of(spark, sf_dir))


def _levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("scan/view", "error"), ("signup", "off"), ("high-complexity", "warn")], "name string, level string")


@query("rule_severities", f"""WITH {FIND} SELECT rule_id, kind, path, line, CASE WHEN rule_id = 'scan/view' THEN 'error' WHEN kind = 'high-complexity' THEN 'warning' WHEN kind = 'error' THEN 'warning' ELSE severity END AS severity FROM cur WHERE kind <> 'signup'""")
def rule_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.apply_rules(findings_of(spark, sf_dir), _levels(spark), ["error"]).select("rule_id", "kind", "path", "line", "severity")


@query("verdict", f"WITH {FIND} SELECT CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'fail' WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END AS verdict, count(*) AS findings FROM cur")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.verdict(findings_of(spark, sf_dir))


@query("summary_counters", f"WITH {FIND} SELECT count(*) AS findings, count(*) FILTER (kind = 'error') AS error, count(*) FILTER (kind = 'view') AS view, count(*) FILTER (kind = 'high-complexity') AS high_complexity FROM cur")
def summary_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.summary(findings_of(spark, sf_dir), ["error", "view", "high-complexity"])


@query("baseline_identities", f"WITH {FIND} SELECT identity, min(rule_id) AS rule_id, min(kind) AS kind, min(path) AS path FROM base GROUP BY identity")
def baseline_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.baseline(findings_of(spark, sf_dir, True))


@query("baseline_except", f"WITH {FIND} SELECT identity, rule_id, path, line FROM cur WHERE identity NOT IN (SELECT identity FROM base)")
def baseline_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = f.baseline(findings_of(spark, sf_dir, True))
    return f.except_baseline(findings_of(spark, sf_dir), known).select("identity", "rule_id", "path", "line")


@query("regression_delta", f"""WITH {FIND}, c AS (SELECT rule_id, count(*) AS n FROM cur WHERE line < 30 GROUP BY 1), b AS (SELECT rule_id, count(*) AS n FROM base WHERE col < 9 AND kind <> 'error' GROUP BY 1),
j AS (SELECT coalesce(c.rule_id, b.rule_id) AS rule_id, coalesce(c.n, 0) AS current, coalesce(b.n, 0) AS baseline FROM c FULL JOIN b ON b.rule_id = c.rule_id)
SELECT *, current - baseline AS delta, baseline + (baseline * 2500 + 9999) // 10000 AS allowed, current > baseline + (baseline * 2500 + 9999) // 10000 AS regressed FROM j""")
def regression_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    cur = f.rule_counts(findings_of(spark, sf_dir).where("line < 30"))
    return f.regression(cur, f.rule_counts(findings_of(spark, sf_dir, True).where("col < 9 AND kind != 'error'")), 2500)


_ATTR = f"""{FIND}, {_SCOPE},
a AS (SELECT *, CASE WHEN identity NOT IN (SELECT identity FROM base) AND (path IN (SELECT path FROM scope) OR files[1] IN (SELECT path FROM scope)) THEN 'introduced' ELSE 'pre_existing' END AS bucket FROM cur),
g AS (SELECT bucket, count(*) AS findings, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (safe_to_delete) AS safe_to_delete FROM a GROUP BY bucket),
x AS (SELECT bucket, path FROM a UNION SELECT bucket, files[1] FROM a)"""


@query("audit_attribution", f"WITH {_ATTR} SELECT g.*, (SELECT count(*) FROM x WHERE x.bucket = g.bucket) AS files FROM g")
def audit_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.attribution(findings_of(spark, sf_dir), scope_of(spark, sf_dir), f.baseline(findings_of(spark, sf_dir, True)))


@query("risk_score", f"""WITH {_ATTR} SELECT CAST(least(100, sum(CASE bucket WHEN 'introduced' THEN errors * 30 + warnings * 15 + safe_to_delete * 10 ELSE errors * 10 + warnings * 4 + safe_to_delete * 2 END)) AS BIGINT) AS risk_score,
  CASE WHEN sum(CASE bucket WHEN 'introduced' THEN errors ELSE 0 END) > 0 THEN 'fail' ELSE 'warn' END AS risk_level FROM g""")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.risk(audit_attribution(spark, sf_dir))


@query("reconcile_review", f"""WITH {FIND}, a AS (SELECT DISTINCT rule_id || path AS fingerprint FROM cur WHERE line < 20), b AS (SELECT DISTINCT rule_id || path AS fingerprint FROM base WHERE line > 10)
SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, CASE WHEN b.fingerprint IS NULL THEN 'new' WHEN a.fingerprint IS NULL THEN 'stale' ELSE 'kept' END AS state FROM a FULL JOIN b ON a.fingerprint = b.fingerprint""")
def reconcile_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("rule_id", "path").alias("fingerprint")
    return f.reconcile(findings_of(spark, sf_dir).where("line < 20").select(key), findings_of(spark, sf_dir, True).where("line > 10").select(key))


@query("changed_line_gate", f"""WITH {FIND}, o AS (SELECT rule_id, list_sort(list(DISTINCT {{'path': path, 'line': line}})) AS occurrences FROM cur GROUP BY rule_id),
k AS (SELECT rule_id, list_filter(occurrences, lambda x: x.line % 5 = 0 AND x.path <= 'lib/u2') AS occurrences FROM o)
SELECT rule_id, len(occurrences) AS n, occurrences[1].path AS path, occurrences[1].line AS line FROM k WHERE len(occurrences) > 0""")
def changed_line_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings_of(spark, sf_dir)
    grouped = rows.groupBy("rule_id").agg(F.array_sort(F.collect_set(F.struct("path", "line"))).alias("occurrences"))
    lines = rows.where("line % 5 = 0 AND path <= 'lib/u2'").select("path", "line")
    return f.keep_occurrences(grouped, lines, ["rule_id"]).select("rule_id", F.size("occurrences").cast("bigint").alias("n"), "path", "line")


@query("decision_surface", f"""WITH {FIND}, d AS (SELECT 'd' || path AS id, CASE kind WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END AS priority, path, line FROM cur),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority DESC, path, line) AS r FROM d) SELECT DISTINCT id, CAST(priority AS BIGINT) AS priority, path, line FROM o WHERE r = 1 ORDER BY priority DESC, path, line LIMIT 12""")
def decision_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first decision of each id, the most pressing twelve."""
    p = F.when(F.col("kind") == "error", 3).when(F.col("kind") == "purchase", 2).otherwise(1).cast("bigint")
    rows = findings_of(spark, sf_dir).select(F.concat(F.lit("d"), "path").alias("id"), p.alias("priority"), "path", "line")
    return f.first_per_key(rows, ["id"], [F.desc("priority"), "path", "line"], 12)


@query("check_report", f"""WITH {FIND}, {DIR}, {_SCOPE},
m AS (SELECT c.*, EXISTS (SELECT 1 FROM dirs d WHERE d.path = c.path AND c.line = d.line + 1 AND (list_contains(d.rules, 'all') OR list_has_any(d.rules, [c.rule_id, c.kind, split_part(c.rule_id, '/', 2)]))) AS gone FROM cur c)
SELECT rule_id, kind, path, line, message, CASE WHEN rule_id = 'scan/view' THEN 'error' WHEN kind = 'high-complexity' THEN 'warning' WHEN kind = 'error' THEN 'warning' ELSE severity END AS severity FROM m
WHERE NOT gone AND (path IN (SELECT path FROM scope) OR files[1] IN (SELECT path FROM scope)) AND kind <> 'signup' AND identity NOT IN (SELECT identity FROM base)
UNION ALL SELECT * FROM (WITH s AS (SELECT d.path, d.line, d.rules FROM dirs d WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE d.path = c.path AND c.line = d.line + 1 AND (list_contains(d.rules, 'all') OR list_has_any(d.rules, [c.rule_id, c.kind, split_part(c.rule_id, '/', 2)])))),
n AS (SELECT s.path, s.line, arg_min(c.line, (abs(c.line - s.line), c.line)) AS nearest FROM s LEFT JOIN cur c ON c.path = s.path AND (list_contains(s.rules, 'all') OR list_has_any(s.rules, [c.rule_id, c.kind, split_part(c.rule_id, '/', 2)])) GROUP BY 1, 2)
SELECT 'stale-suppression', 'stale-suppression', path, line, 'unused; nearest ' || coalesce(CAST(nearest AS VARCHAR), 'none'), 'error' FROM n WHERE path IN (SELECT path FROM scope))""")
def check_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline in its order."""
    cur = findings_of(spark, sf_dir)
    known = f.baseline(findings_of(spark, sf_dir, True))
    out = f.assemble([cur], directives_of(spark, sf_dir), scope_of(spark, sf_dir), _levels(spark), ["error"], known)
    return out.select("rule_id", "kind", "path", "line", "message", "severity")
