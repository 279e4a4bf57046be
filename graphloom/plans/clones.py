"""Clone queries over documents as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalars import fnv32
from graphloom.operators import clones as c
from graphloom.plans.registry import query
from graphloom.session import table

MIN_LINES, MIN_TOKENS = 2, 30

_LINES = r"""s AS (SELECT 'd/' || (doc_id % 50) || '/' || doc_id AS path, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
t AS (SELECT path, CAST(line AS BIGINT) AS line, trim(regexp_replace(regexp_replace(raw, '//.*$', ''), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') AS text FROM s),
l AS (SELECT *, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY path ORDER BY line) - 1 AS pos FROM t WHERE text <> '')"""
_WIN = f"""{_LINES},
a AS (SELECT *, sum(tokens) OVER (PARTITION BY path ORDER BY pos) AS upto FROM l),
p AS (SELECT x.path, x.pos, min(y.pos) AS last FROM a x JOIN a y ON y.path = x.path AND y.pos >= x.pos + {MIN_LINES - 1} AND y.upto - x.upto + x.tokens >= {MIN_TOKENS} GROUP BY 1, 2),
w AS (SELECT p.path, min(a.line) AS start_line, max(a.line) AS end_line, count(*) AS line_count, CAST(sum(a.tokens) AS BIGINT) AS token_count, string_agg(a.text, chr(10) ORDER BY a.pos) AS text
  FROM p JOIN a ON a.path = p.path AND a.pos BETWEEN p.pos AND p.last GROUP BY p.path, p.pos)"""
_GROUPS = f"""{_WIN},
g AS (SELECT text, list_sort(list(DISTINCT {{'path': path, 'start_line': start_line, 'end_line': end_line}})) AS instances, max(token_count) AS token_count, max(line_count) AS line_count FROM w GROUP BY text HAVING count(DISTINCT (path, start_line)) >= 2)"""


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), (d % 50).cast("string"), F.lit("/"), d.cast("string")).alias("path"), F.col("text").alias("source"))


def groups_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.groups(c.windows(c.normalised_lines(files_of(spark, sf_dir)), MIN_LINES, MIN_TOKENS))


@query("normalized_lines", f"WITH {_LINES} SELECT path, line, tokens, pos, md5(text) AS text_md5 FROM l")
def normalized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.normalised_lines(files_of(spark, sf_dir)).select("path", "line", "tokens", "pos", F.md5("text").alias("text_md5"))


@query("clone_windows", f"WITH {_WIN} SELECT path, start_line, end_line, line_count, token_count, md5(text) AS text_md5 FROM w")
def clone_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = c.windows(c.normalised_lines(files_of(spark, sf_dir)), MIN_LINES, MIN_TOKENS)
    return w.select("path", "start_line", "end_line", "line_count", "token_count", F.md5("text").alias("text_md5"))


@query("clone_groups", f"WITH {_GROUPS} SELECT md5(text) AS text_md5, len(instances) AS n_instances, token_count, line_count, instances[1].path AS first_path, instances[1].start_line AS first_line FROM g")
def clone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.element_at("instances", 1)
    return groups_of(spark, sf_dir).select(F.md5("text").alias("text_md5"), F.size("instances").cast("bigint").alias("n_instances"), "token_count", "line_count", first["path"].alias("first_path"), first["start_line"].alias("first_line"))


@query("duplication_stats", f"""WITH {_GROUPS}, i AS (SELECT unnest(instances) AS i FROM g), x AS (SELECT DISTINCT l.path, l.line FROM l JOIN i ON l.path = i.path AND l.line BETWEEN i.start_line AND i.end_line)
SELECT a AS analyzed_lines, d AS duplicated_lines, n AS clone_groups, d * 10000 // a AS duplicated_bp, d * 10000 > a * 500 AS exceeded FROM (SELECT count(*) AS a FROM l), (SELECT count(*) AS d FROM x), (SELECT count(*) AS n FROM g)""")
def duplication_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.stats(c.normalised_lines(files_of(spark, sf_dir)), groups_of(spark, sf_dir), 500)


@query("clone_collapse")
def clone_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy and in order, so no SQL; tests compare it with the plain loop."""
    return c.collapse(groups_of(spark, sf_dir)).select("fingerprint", F.size("instances").cast("bigint").alias("n_instances"), "line_count", "token_count")


@query("clone_trace", f"WITH {_GROUPS} SELECT md5(text) AS text_md5, len(instances) AS n_instances FROM g WHERE len(list_filter(instances, lambda i: i.path = 'd/1/1' AND 1 BETWEEN i.start_line AND i.end_line)) > 0")
def clone_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.at_line(groups_of(spark, sf_dir), "d/1/1", 1).select(F.md5("text").alias("text_md5"), F.size("instances").cast("bigint").alias("n_instances"))


@query("fingerprint32", """SELECT c_custkey, 'dup:' || lower(printf('%08x', list_reduce(list_prepend(CAST(2216829733 AS BIGINT), list_transform(range(1, len(c_name) + 1), lambda i: CAST(ascii(c_name[i]) AS BIGINT))), lambda a, x: (xor(a, x) * 435) & 4294967295))) AS fingerprint FROM customer""")
def fingerprint32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("dup:"), fnv32(F.col("c_name"))).alias("fingerprint"))
