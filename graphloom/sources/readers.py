"""Readers of the formats that analyses take in, each as a typed table.

Text formats come as lines (source, n, text): ``text_lines`` makes them from a
folder, and every parser takes such a table, so that tests and streams can feed
it as well. Parsers work line by line with windows over one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SKIPPED = (".dart_tool", ".git", ".idea", ".pub-cache", "build", "target")


def source_tree(spark: SparkSession, root: str, glob: str = "*.dart", ignored: list[str] | None = None) -> DataFrame:
    """files(path, source) under a folder, tool folders and ignored globs left out.

    The path filters stand before anything that looks at the text, and paths are
    relative to the root.
    """
    from graphloom.functions.scalars import glob_regex

    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    full = F.col("_metadata.file_path")
    base = root if "://" in root else "file:" + root
    path = F.regexp_replace(F.regexp_replace(full, "^" + base.replace("file:", "file:/*/").rstrip("/").replace("//", "/") + "/", ""), "^/+", "")
    rows = raw.select(path.alias("path"), F.col("value").alias("source"))
    rows = rows.where(~F.exists(F.split("path", "/"), lambda s: s.isin(*SKIPPED)))
    for g in ignored or []:
        rows = rows.where(~F.col("path").rlike(glob_regex(g)))
    return rows


def text_lines(files: DataFrame) -> DataFrame:
    """Lines of files(path, source): source, n (from 1) and text."""
    return files.select(F.col("path").alias("source"), F.posexplode(F.split("source", "\r?\n")).alias("_n", "text")).select("source", (F.col("_n") + 1).cast("bigint").alias("n"), "text")


def _running(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).over(Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))


def lcov(lines: DataFrame) -> DataFrame:
    """line_coverage(path, line, hits): DA rows of SF records; lines that repeat add their hits."""
    t = F.trim("text")
    rows = lines.withColumn("t", t).withColumn("rec", _running(F.col("t").startswith("SF:")))
    sf = F.last(F.when(F.col("t").startswith("SF:"), F.trim(F.substring("t", 4, 1 << 20))), True).over(Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    ended = F.last(F.when(F.col("t") == "end_of_record", True).when(F.col("t").startswith("SF:"), False), True).over(Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"path": sf, "over": F.coalesce(ended, F.lit(True))}).where(F.col("t").startswith("DA:"))
    fields = F.split(F.substring("t", 4, 1 << 20), ",")
    bad = F.raise_error(F.concat(F.lit("DA record before SF at line "), F.col("n").cast("string")))
    rows = rows.withColumn("path", F.when(F.col("over"), bad.cast("string")).otherwise(F.col("path")))
    return rows.groupBy("path", F.get(fields, F.lit(0)).cast("bigint").alias("line")).agg(F.sum(F.get(fields, F.lit(1)).cast("bigint")).alias("hits"))


def codeowners(lines: DataFrame) -> DataFrame:
    """Rules in order: ord, pattern, owners and section; later rules win."""
    w = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    t = F.trim("text")
    head = F.when(t.startswith("["), F.trim(F.regexp_extract(t, r"^\[([^\]]*)\]", 1)))
    rows = lines.withColumn("t", t).where("t != '' AND NOT startswith(t, '#')").withColumn("head", F.when(head != "", head))
    rows = rows.withColumn("section", F.last("head", True).over(w)).where("head IS NULL")
    parts = F.split("t", r"\s+")
    return rows.select(F.col("n").alias("ord"), F.get(parts, F.lit(0)).alias("pattern"), F.slice(parts, 2, 1 << 20).alias("owners"), "section").where(F.size("owners") > 0)


def diff_lines(lines: DataFrame) -> DataFrame:
    """(path, line) of every added line of unified diffs."""
    w = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("text")
    token = F.trim(F.get(F.split(F.trim(F.substring("text", 5, 1 << 20)), "\t"), F.lit(0)))
    path = F.regexp_replace(F.regexp_replace(token, "^[ab]/", ""), r"^\./", "")
    file_line = t.startswith("+++ ")
    rows = lines.withColumn("file", F.when(file_line, F.when(token.isin("/dev/null", ""), "").otherwise(F.replace(path, F.lit("\\"), F.lit("/")))))
    start = F.regexp_extract("text", r"^@@ [^+]*\+(\d+)", 1)
    hunk = t.startswith("@@ ") & (start != "")
    rows = rows.withColumns({"path": F.last("file", True).over(w), "mark": F.when(hunk, start.cast("bigint")).when(file_line, F.lit(-1))})
    rows = rows.withColumn("from", F.last("mark", True).over(w)).withColumn("block", F.sum(F.when(F.col("mark").isNotNull(), 1).otherwise(0)).over(w))
    body = rows.where("mark IS NULL AND from >= 0 AND path != ''")
    step = F.when(F.col("text").startswith("-") | F.col("text").startswith("\\"), 0).otherwise(1)
    before = Window.partitionBy("source", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("from") + F.coalesce(F.sum(step).over(before), F.lit(0))
    return body.withColumn("line", at.cast("bigint")).where(F.col("text").startswith("+")).select("path", "line").distinct()


def percent_decoded(value: Column) -> Column:
    """``%xx`` decoded as bytes; a text that isn't UTF-8 afterwards stays as it was. A plus stays a plus."""
    decoded = F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    bad = decoded.isNull() | F.contains(decoded, F.lit("�"))
    return F.when(bad, value).otherwise(decoded)


def runtime_path(url: Column) -> Column:
    """Project path of a runtime URL, null if it is no source file."""
    u = percent_decoded(url)
    in_lib = F.split(u, "/lib/")
    path = (
        F.when(u.startswith("package:") & u.contains("/"), F.concat(F.lit("lib/"), F.regexp_extract(u, r"^package:[^/]*/(.*)$", 1)))
        .when(u.startswith("org-dartlang-app:///"), F.regexp_replace(F.substring(u, 21, 1 << 20), "^/+", ""))
        .when(u.startswith("file://"), F.substring(u, 8, 1 << 20))
        .when(u.rlike("^https?://"), F.when(F.size(in_lib) > 1, F.concat(F.lit("lib/"), F.get(in_lib, F.lit(1)))))
        .otherwise(F.when(~u.startswith("package:"), u))
    )
    return F.when(u.contains(".dart"), path)


_V8 = "array<struct<url:string,functions:array<struct<functionName:string,ranges:array<struct<startOffset:bigint,endOffset:bigint,count:bigint>>>>>>"
_ISTANBUL = "map<string,struct<path:string,s:map<string,bigint>,f:map<string,bigint>,fnMap:map<string,struct<name:string,decl:struct<start:struct<line:bigint>>,loc:struct<start:struct<line:bigint>>>>>>"


def runtime_format(content: Column) -> Column:
    """v8, istanbul or null, by shape."""
    v8 = F.get_json_object(content, "$.result").startswith("[") | (F.ltrim(content).startswith("[") & F.get_json_object(content, "$[0].functions").isNotNull())
    some = F.map_values(F.from_json(content, _ISTANBUL))
    return F.when(v8, "v8").when(F.exists(some, lambda e: e["s"].isNotNull() | e["fnMap"].isNotNull()), "istanbul")


def v8_coverage(docs: DataFrame, content: str = "content") -> DataFrame:
    """runtime calls(path, line, symbol, invocations) of V8 coverage: a function's largest range count."""
    scripts = F.coalesce(F.from_json(F.get_json_object(content, "$.result"), _V8), F.from_json(F.col(content), _V8))
    rows = docs.select(F.explode(scripts).alias("s")).select(runtime_path(F.col("s.url")).alias("path"), F.explode("s.functions").alias("f")).where("path IS NOT NULL")
    n = F.array_max(F.transform("f.ranges", lambda r: F.coalesce(r["count"], F.lit(0).cast("bigint"))))
    rows = rows.select("path", F.get("f.ranges", F.lit(0))["startOffset"].alias("line"), F.nullif(F.col("f.functionName"), F.lit("")).alias("symbol"), n.alias("invocations"))
    return rows.where("invocations > 0")


def istanbul_coverage(docs: DataFrame, content: str = "content") -> DataFrame:
    """Functions with calls, and a file-level row for what statements count above them."""
    rows = docs.select(F.explode(F.from_json(F.col(content), _ISTANBUL)).alias("key", "e")).select(runtime_path(F.coalesce("e.path", "key")).alias("path"), "e").where("path IS NOT NULL")
    zero = F.lit(0).cast("bigint")
    total = lambda m: F.aggregate(F.coalesce(F.map_values(m), F.array().cast("array<bigint>")), zero, lambda a, x: a + F.coalesce(x, zero))
    fns = rows.select("path", "e", F.explode("e.f").alias("id", "invocations")).where("invocations > 0")
    meta = F.try_element_at("e.fnMap", F.col("id"))
    fns = fns.select("path", F.coalesce(meta["decl"]["start"]["line"], meta["loc"]["start"]["line"]).alias("line"), F.nullif(meta["name"], F.lit("")).alias("symbol"), "invocations")
    files = rows.select("path", F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("string").alias("symbol"), F.greatest(total("e.s"), total("e.f")).alias("invocations"), total("e.f").alias("own"))
    rest = files.where("invocations > own").select("path", "line", "symbol", (F.col("invocations") - F.col("own")).alias("invocations"))
    return fns.unionByName(rest)


def impact_history(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines history; malformed lines are skipped."""
    schema = "timestamp string, surfaced bigint, resolved bigint, suppressed bigint, contained_commits bigint"
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").where("timestamp IS NOT NULL")


def baseline(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Saved identities of a baseline of a schema version; another version is an error."""
    schema = "schema_version string, tool string, findings array<struct<identity:string,rule_id:string,fingerprint:string,kind:string,path:string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    found = raw.select("schema_version").first()
    if found is None or found[0] != version:
        raise ValueError(f"baseline of version {found and found[0]}, {version} expected")
    return raw.select(F.explode("findings").alias("f")).select("f.*")


def without_json_comments(text: str) -> str:
    """JSON without // and /* */ comments; those inside strings stay."""
    out, i, quoted = [], 0, False
    while i < len(text):
        c = text[i]
        if quoted:
            out.append(c)
            if c == "\\" and i + 1 < len(text):
                i += 1
                out.append(text[i])
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
            out.append(c)
        elif text.startswith("//", i):
            while i < len(text) and text[i] != "\n":
                i += 1
            continue
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
            continue
        else:
            out.append(c)
        i += 1
    return "".join(out)


def suppression_comments(lines: DataFrame, tool: str = "lint") -> DataFrame:
    """Next-line directives: path, line, rules (empty: every rule) and reason.

    ``// <tool>-ignore-next-line rule-a, rule-b -- reason``
    """
    pattern = rf"//\s*{tool}-ignore-next-line\b\s*([^-]*(?:-(?!-)[^-]*)*)(?:--\s*(.*))?$"
    rules = F.filter(F.transform(F.split(F.regexp_extract("text", pattern, 1), r"[,\s]+"), lambda r: F.lower(F.trim(r))), lambda r: r != "")
    reason = F.nullif(F.trim(F.regexp_extract("text", pattern, 2)), F.lit(""))
    return lines.where(F.col("text").rlike(pattern)).select(F.col("source").alias("path"), F.col("n").alias("line"), rules.alias("rules"), reason.alias("reason"))
