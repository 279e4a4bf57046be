"""Sinks: JSON, SARIF and HTML reports, baselines, and plans of safe edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.findings import ORDER, baseline

REPORT_VERSION = "1"


def json_report(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """One row with the whole report as JSON. Reports are for people, so of bounded size; larger ones are written as rows by ``write_rows``."""
    rows = findings.select(F.struct(*findings.columns).alias("f")).agg(F.array_sort(F.collect_list("f"), lambda a, b: _compare(a, b)).alias("findings"))
    one = summary.select(F.struct(*summary.columns).alias("summary")).crossJoin(rows)
    return one.select(F.to_json(F.struct(F.lit(REPORT_VERSION).alias("schema_version"), "summary", "findings")).alias("report"))


def _compare(a, b):
    out = F.lit(0)
    for c in reversed(ORDER):
        out = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(out)
    return out


def sarif(findings: DataFrame, tool: str) -> DataFrame:
    """One row with a SARIF 2.1.0 log: rules once, results in order, fingerprints kept."""
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), (F.col("col") + 1).alias("startColumn")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))
    results = findings.select(F.struct(*ORDER).alias("k"), result.alias("r")).agg(F.array_sort(F.collect_list(F.struct("k", F.to_json("r").alias("r")))).alias("rs"))
    rules = findings.select("rule_id").distinct().agg(F.array_sort(F.collect_list(F.struct(F.col("rule_id").alias("id")))).alias("rules"))
    # results are JSON already: they are placed as they are
    both = results.crossJoin(rules)
    head = F.to_json(F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver")))
    body = F.array_join(F.transform("rs", lambda x: x["r"]), ",")
    return both.select(F.concat(F.lit('{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":'), head, F.lit(',"results":['), body, F.lit("]}]}")).alias("sarif"))


def escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_report(findings: DataFrame) -> DataFrame:
    """One row with a page of the findings by kind, all texts escaped."""
    item = F.concat(F.lit("<li><code>"), escaped(F.col("path")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("-")), F.lit("</code> "), escaped(F.coalesce("message", F.lit(""))), F.lit("</li>"))
    rows = findings.withColumn("item", item).groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line", "item"))), lambda x: x["item"]), "").alias("items"))
    part = F.concat(F.lit("<h2>"), escaped(F.col("kind")), F.lit(" ("), F.col("n").cast("string"), F.lit(")</h2><ul>"), "items", F.lit("</ul>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", part.alias("p")))), lambda x: x["p"]), "")
    return rows.agg(F.concat(F.lit("<!doctype html><meta charset=utf-8><title>Report</title>"), body).alias("html"))


def write_rows(findings: DataFrame, path: str) -> None:
    """All findings as JSON lines, in order over the files."""
    findings.orderBy(*ORDER).write.mode("overwrite").json(path)


def write_baseline(findings: DataFrame, path: str, version: str, tool: str) -> None:
    """Identities as one JSON document, sorted, each once."""
    rows = baseline(findings).agg(F.array_sort(F.collect_list(F.struct("identity", "rule_id", "kind", "path"))).alias("findings"))
    rows.select(F.lit(version).alias("schema_version"), F.lit(tool).alias("tool"), "findings").coalesce(1).write.mode("overwrite").json(path)


def edit_plan(findings: DataFrame, actions: list[str]) -> DataFrame:
    """Safe edits in the order in which they can be applied: files that go first, then lines from the bottom up.

    ``action`` is delete-file, remove-line or remove-dependency. Lines of files
    that go are dropped, as are repeated edits.
    """
    rank = F.when(F.col("action") == "delete-file", 0).when(F.col("action") == "remove-line", 1).otherwise(2)
    c = findings.where(F.col("action").isin(*actions) & F.col("safe_to_delete")).select("action", "path", "line", rank.alias("rank")).distinct()
    gone = c.where("action = 'delete-file'").select("path").distinct()
    return c.where("action = 'delete-file'").unionByName(c.where("action != 'delete-file'").join(gone, "path", "left_anti").select(c.columns)).orderBy("rank", "path", F.desc("line"))


def apply_edits(root: str, plan: list[tuple[str, str, int, str]]) -> list[tuple[str, int, str]]:
    """Apply planned edits (action, path, line, expected text) to a folder on the driver.

    Each line is read again first; an edit whose text has changed is refused.
    """
    import os

    out = []
    for action, path, line, expected in plan:
        full = os.path.join(root, path)
        if not os.path.isfile(full):
            out.append((path, line, "missing"))
            continue
        with open(full, encoding="utf-8") as f:
            lines = f.read().split("\n")
        if action == "delete-file":
            os.remove(full)
            out.append((path, line, "deleted"))
        elif line < 1 or line > len(lines) or lines[line - 1] != expected:
            out.append((path, line, "stale"))
        else:
            del lines[line - 1]
            with open(full, "w", encoding="utf-8") as f:
                f.write("\n".join(lines))
            out.append((path, line, "removed"))
    return out
