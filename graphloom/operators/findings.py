"""The findings pipeline: union, suppress, scope, rules, baselines, attribution.

A finding is a row of rule_id, kind, severity, message, path, line, col,
safe_to_delete, files (array) and fingerprint. The order of the steps is part of
the meaning: suppression comes before scope, scope before rules, rules before
baselines, baselines before gates; ``assemble`` keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import allowed_increase

#: Kinds that warn, or are off, unless a rule says otherwise; the others are errors.
DEFAULT_WARN = ["unused-dependency-override", "dev-dependency-in-production", "code-duplication", "unused-widget-param", "unrendered-widget", "raw-flutter-style-value", "near-duplicate-theme-token", "unused-theme-extension-token"]
DEFAULT_OFF = ["private-widget-class", "widget-top-level-function-boundary", "missing-context-mounted-after-await"]
ORDER = ["rule_id", "path", "line", "col", "message"]


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def identity(columns: list[str]) -> Column:
    """What makes a finding the same finding: its fingerprint; for complexity the
    rule, kind, path and symbol, so that it survives moved lines; else rule, kind,
    path, files and message. Line numbers are in none."""
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    symbol = F.col("symbol") if "symbol" in columns else F.lit(None).cast("string")
    files = F.array_join("files", ",") if "files" in columns else F.lit("")
    by_print = F.concat(c("rule_id"), F.lit("|"), F.col("fingerprint"))
    by_symbol = F.concat_ws("|", c("rule_id"), c("kind"), c("path"), F.coalesce(symbol, F.lit("")))
    by_text = F.concat_ws("|", c("rule_id"), c("kind"), c("path"), F.coalesce(files, F.lit("")), c("message"))
    return F.when(F.col("fingerprint").isNotNull(), by_print).when(F.col("kind").isin("high-complexity", "high-cyclomatic-complexity", "high-cognitive-complexity"), by_symbol).otherwise(by_text)


def default_levels(kinds: DataFrame) -> DataFrame:
    """name and level of finding kinds without any configuration."""
    level = F.when(F.col("name").isin(*DEFAULT_WARN), "warn").when(F.col("name").isin(*DEFAULT_OFF), "off").otherwise("error")
    return kinds.select(F.col("kind").alias("name")).distinct().withColumn("level", level)


def rule_aliases(rule: str) -> list[str]:
    """Names that a rule or directive may use for a rule id: the id, its tail, the tail
    without a family prefix, plurals and short forms of dependency rules, and all."""
    tail = rule.rsplit("/", 1)[-1].lower()
    names = [rule, tail, tail.removeprefix("security-")]
    if tail.endswith("dependency"):
        names += [tail[:-1] + "ies", tail.removesuffix("dependency") + "deps"]
    if tail.startswith("dev-dependency-"):
        names += [tail.replace("dependency", "dependencies"), tail.replace("dependency", "deps")]
    if tail.endswith("execution"):
        names.append(tail.removeprefix("security-").removesuffix("ution"))
    return list(dict.fromkeys([*names, "all"]))


def suppress(findings: DataFrame, directives: DataFrame, require_reasons: bool = False) -> DataFrame:
    """Findings without those that a directive on the line before names; stale
    directives and, if wanted, ones without a reason become findings.

    ``directives`` has path, line, rules (array; ``all`` or empty covers every
    rule) and reason.
    """
    names = F.transform(F.array("rule_id", "kind", F.element_at(F.split("rule_id", "/"), -1)), lambda x: F.lower(x))
    covers = (F.size("d.rules") == 0) | F.array_contains("d.rules", "all") | F.arrays_overlap(F.col("d.rules"), names)
    met = (F.col("f.path") == F.col("d.path")) & (F.col("f.line") == F.col("d.line") + 1) & covers
    d = directives.withColumn("_d", F.struct("path", "line"))
    kept = findings.alias("f").join(d.alias("d"), met, "left_anti")
    used = findings.alias("f").join(d.alias("d"), met).select(F.col("d.path").alias("path"), F.col("d.line").alias("line")).distinct()
    stale = directives.join(used, ["path", "line"], "left_anti")
    # The nearest line where the rule still fires, the lower one on ties.
    near = stale.alias("d").join(findings.alias("f"), (F.col("f.path") == F.col("d.path")) & covers, "left")
    near = near.groupBy("d.path", "d.line").agg(F.min_by("f.line", F.struct(F.abs(F.col("f.line") - F.col("d.line")), "f.line")).alias("nearest"))
    rows = near.select(F.lit("stale-suppression").alias("rule_id"), F.lit("stale-suppression").alias("kind"), "path", "line", F.concat(F.lit("unused; nearest "), F.coalesce(F.col("nearest").cast("string"), F.lit("none"))).alias("message"))
    out = union_all([kept, rows.withColumn("severity", F.lit("error"))])
    if require_reasons:
        bare = directives.where("reason IS NULL OR trim(reason) = ''")
        out = union_all([out, bare.select(F.lit("missing-suppression-reason").alias("rule_id"), F.lit("missing-suppression-reason").alias("kind"), "path", "line", F.lit("no reason").alias("message"), F.lit("error").alias("severity"))])
    return out


def in_scope(findings: DataFrame, scope: DataFrame) -> DataFrame:
    """Findings that touch the scope by path or by one of their files."""
    paths = scope.select("path").distinct()
    direct = findings.join(paths, "path", "left_semi")
    # Which lists of files touch the scope is found once a list, so that no row needs a made-up key.
    lists = findings.select("files").where(F.size("files") > 0).distinct()
    hit = lists.select("files", F.explode("files").alias("path")).join(paths, "path", "left_semi").select("files").distinct()
    rest = findings.join(paths, "path", "left_anti").join(hit, "files", "left_semi")
    return direct.select(findings.columns).unionByName(rest.select(findings.columns))


def apply_rules(findings: DataFrame, levels: DataFrame, default_warn: list[str]) -> DataFrame:
    """Severities by rule: ``off`` drops, ``warn`` and ``error`` rewrite.

    ``levels`` has name and level; a finding matches by rule_id or kind, the rule
    first. Without any configured level the builders' severities stay.
    """
    by_rule = levels.select(F.col("name").alias("rule_id"), F.col("level").alias("_r"))
    by_kind = levels.select(F.col("name").alias("kind"), F.col("level").alias("_k"))
    any_level = F.broadcast(levels.agg((F.count("*") > 0).alias("_any")))
    out = findings.join(F.broadcast(by_rule), "rule_id", "left").join(F.broadcast(by_kind), "kind", "left").crossJoin(any_level)
    default = F.when(F.col("_any") & F.col("kind").isin(*default_warn), "warning").otherwise(F.col("severity"))
    level = F.coalesce("_r", "_k")
    out = out.where(F.coalesce(level != "off", F.lit(True)))
    severity = F.when(level == "warn", "warning").when(level == "error", "error").otherwise(default)
    return out.withColumn("severity", severity).select(*findings.columns)


def verdict(findings: DataFrame) -> DataFrame:
    """One row: fail if any error, warn if any finding, else pass."""
    v = F.when(F.count_if(F.col("severity") == "error") > 0, "fail").when(F.count("*") > 0, "warn").otherwise("pass")
    return findings.agg(v.alias("verdict"), F.count("*").alias("findings"))


def summary(findings: DataFrame, kinds: list[str]) -> DataFrame:
    """One row: a counter a kind, all in one aggregation."""
    return findings.agg(F.count("*").alias("findings"), *(F.count_if(F.col("kind") == k).alias(k.replace("-", "_")) for k in kinds))


def baseline(findings: DataFrame) -> DataFrame:
    """Identities to save, one row each, in order."""
    return findings.withColumn("identity", identity(findings.columns)).groupBy("identity").agg(F.min("rule_id").alias("rule_id"), F.min("kind").alias("kind"), F.min("path").alias("path"))


def except_baseline(findings: DataFrame, known: DataFrame) -> DataFrame:
    return findings.withColumn("identity", identity(findings.columns)).join(known.select("identity").distinct(), "identity", "left_anti")


def rule_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("n"))


def regression(current: DataFrame, base: DataFrame, basis_points: int = 0, absolute: int = 0) -> DataFrame:
    """Counts by rule against a base's; regressed if above what is allowed."""
    zero = F.lit(0).cast("bigint")
    both = current.withColumnRenamed("n", "current").join(base.withColumnRenamed("n", "baseline"), "rule_id", "full").withColumns({"current": F.coalesce("current", zero), "baseline": F.coalesce("baseline", zero)})
    allowed = F.col("baseline") + absolute + allowed_increase(F.col("baseline"), F.lit(basis_points))
    return both.withColumns({"delta": F.col("current") - F.col("baseline"), "allowed": allowed.cast("bigint"), "regressed": F.col("current") > allowed})


def attribution(findings: DataFrame, changed: DataFrame, known: DataFrame) -> DataFrame:
    """Introduced against pre-existing: counts and distinct files of both buckets, two rows at most."""
    f = findings.withColumn("_i", identity(findings.columns)).withColumn("_files", F.array_distinct(F.concat(F.array("path"), F.coalesce("files", F.array().cast("array<string>")))))
    base = known.select(F.col("identity").alias("_i")).distinct().withColumn("_old", F.lit(True))
    lists = f.select("_files").distinct()
    touched = lists.select("_files", F.explode("_files").alias("path")).join(changed.select("path").distinct(), "path", "left_semi").select("_files").distinct()
    f = f.join(base, "_i", "left").join(touched.withColumn("_new", F.lit(True)), "_files", "left")
    bucket = F.when(F.col("_old").isNull() & F.col("_new").isNotNull(), "introduced").otherwise("pre_existing")
    f = f.withColumn("bucket", bucket)
    counts = f.groupBy("bucket").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("safe_to_delete")).alias("safe_to_delete"))
    files = f.select("bucket", F.explode("_files").alias("x")).where("x != ''").distinct().groupBy("bucket").agg(F.count("*").alias("files"))
    return counts.join(files, "bucket", "left").withColumn("files", F.coalesce("files", F.lit(0).cast("bigint")))


WEIGHTS = {"introduced": (30, 15, 10), "pre_existing": (10, 4, 2)}


def risk(attributed: DataFrame) -> DataFrame:
    """One row: score up to 100 and level."""
    points = None
    for bucket, (e, w, s) in WEIGHTS.items():
        part = F.when(F.col("bucket") == bucket, F.col("errors") * e + F.col("warnings") * w + F.col("safe_to_delete") * s).otherwise(0)
        points = part if points is None else points + part
    new_errors = F.coalesce(F.sum(F.when(F.col("bucket") == "introduced", F.col("errors"))), F.lit(0))
    level = F.when(new_errors > 0, "fail").when(F.coalesce(F.sum("findings"), F.lit(0)) > 0, "warn").otherwise("pass")
    return attributed.agg(F.least(F.lit(100), F.coalesce(F.sum(points), F.lit(0))).cast("bigint").alias("risk_score"), level.alias("risk_level"))


def reconcile(wanted: DataFrame, posted: DataFrame) -> DataFrame:
    """Fingerprints to post, kept and stale: a full outer join."""
    a, b = wanted.select("fingerprint").distinct().withColumn("_a", F.lit(True)), posted.select("fingerprint").distinct().withColumn("_b", F.lit(True))
    state = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "stale").otherwise("kept")
    return a.join(b, "fingerprint", "full").select("fingerprint", state.alias("state"))


def keep_occurrences(findings: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Findings with the occurrences on given lines alone, anchored at the first kept; those without any go.

    ``occurrences`` is an array of (path, line); ``keys`` tell findings apart.
    """
    o = findings.select(*keys, F.posexplode("occurrences").alias("_p", "_o")).select(*keys, "_p", "_o", F.col("_o.path").alias("path"), F.col("_o.line").alias("line"))
    kept = o.join(lines.select("path", "line").distinct(), ["path", "line"], "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_o"))).alias("_k"))
    out = findings.drop("occurrences").join(kept, keys).withColumn("occurrences", F.expr("transform(_k, x -> x._o)"))
    first = F.element_at("occurrences", 1)
    return out.withColumns({"path": first["path"], "line": first["line"]}).drop("_k")


def first_per_key(rows: DataFrame, keys: list[str], order: list, most: int | None = None) -> DataFrame:
    """First row a key, then at most ``most`` rows in order: a decision list."""
    w = Window.partitionBy(*keys).orderBy(*order)
    one = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return one.orderBy(*order).limit(most) if most is not None else one


def assemble(parts: list[DataFrame], directives: DataFrame, scope: DataFrame | None, levels: DataFrame, default_warn: list[str], known: DataFrame | None) -> DataFrame:
    """All steps in their order, sorted as a report is."""
    out = suppress(union_all(parts), directives)
    if scope is not None:
        out = in_scope(out, scope)
    out = apply_rules(out, levels, default_warn)
    if known is not None:
        out = except_baseline(out, known)
    return out.orderBy(*ORDER)
