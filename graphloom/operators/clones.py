"""Clone detection over normalised lines.

``lines`` has path, pos (0-based order of the kept lines), line (1-based in the
source), text (normalised) and tokens.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import div, fnv32
from graphloom.operators.graph import SMALL, in_one_task
from graphloom.session import cut

MODES = ("strict", "mild", "weak", "semantic")


def normalised(line: Column, mode: str) -> Column:
    """A line's text under a mode: strict keeps it, mild trims and collapses white
    space, weak replaces string and number literals, semantic also names."""
    out = line
    if mode != "strict":
        out = F.trim(F.regexp_replace(F.regexp_replace(out, r"//.*$", ""), r"\s+", " "))
    if mode in ("weak", "semantic"):
        out = F.regexp_replace(F.regexp_replace(out, r"\"[^\"]*\"|'[^']*'", "STR"), r"\b[0-9][0-9A-Fa-fxX._]*\b", "NUM")
    if mode == "semantic":
        out = F.regexp_replace(out, r"\b(?!STR\b|NUM\b)[A-Za-z_][A-Za-z_0-9]*\b", "ID")
    return out


def normalised_lines(files: DataFrame, mode: str = "mild") -> DataFrame:
    """Lines of each file that are not blank once normalised, numbered from 0, with
    their number of tokens (runs of word characters, and single others)."""
    rows = files.select("path", F.posexplode(F.split("source", "\n")).alias("_n", "_t")).select("path", (F.col("_n") + 1).cast("bigint").alias("line"), normalised(F.col("_t"), mode).alias("text")).where("text != ''")
    tokens = F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")).cast("bigint")
    pos = (F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1).cast("bigint")
    return rows.withColumns({"tokens": tokens, "pos": pos})


def windows(lines: DataFrame, min_lines: int = 5, min_tokens: int = 50) -> DataFrame:
    """For each first line the shortest run with enough lines and tokens.

    Sums of tokens up to each line are increasing, so the end is found by a binary
    search in the file's own array of sums: no pairs of lines are formed.
    """
    upto = F.sum("tokens").over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    per = lines.withColumn("upto", upto).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "upto", "text"))).alias("l"))
    per = per.withColumn("s", F.expr("concat(array(0L), transform(l, x -> x.upto))")).withColumn("n", F.size("l"))
    # Steps of a binary search, as many as an int has bits and no more than the file needs.
    find = """transform(sequence(0, n - 1), i -> named_struct('i', i, 'e', greatest(i + {ml}, aggregate(sequence(1, 31), named_struct('lo', i, 'hi', n + 1),
        (a, k) -> CASE WHEN a.hi - a.lo <= 1 THEN a
                       WHEN s[(a.lo + a.hi) div 2] - s[i] >= {mt} THEN named_struct('lo', a.lo, 'hi', CAST((a.lo + a.hi) div 2 AS INT))
                       ELSE named_struct('lo', CAST((a.lo + a.hi) div 2 AS INT), 'hi', a.hi) END, a -> a.hi))))""".format(ml=min_lines, mt=min_tokens)
    ends = per.withColumn("w", F.explode(F.expr(find))).where("w.e <= n")
    return ends.select(
        "path", F.expr("l[w.i].line").alias("start_line"), F.expr("l[w.e - 1].line").alias("end_line"), F.expr("CAST(w.e - w.i AS BIGINT)").alias("line_count"),
        F.expr("s[w.e] - s[w.i]").alias("token_count"), F.expr("array_join(transform(slice(l, w.i + 1, w.e - w.i), x -> x.text), '\n')").alias("text"),
    )


def groups(found: DataFrame, min_occurrences: int = 2, skip_local: bool = False) -> DataFrame:
    """Windows of one text, grouped by the text itself: a group is its instances in order.

    Only texts that occur often enough are gathered; a text is met by its hash,
    and the text is part of the key, so hashes that agree by chance stay apart.
    """
    keyed = found.withColumn("_h", F.xxhash64("text"))
    per = keyed.groupBy("_h", "text").agg(
        F.array_sort(F.collect_set(F.struct("path", "start_line", "end_line"))).alias("instances"), F.max("token_count").alias("token_count"), F.max("line_count").alias("line_count"),
    ).where(F.size("instances") >= min_occurrences)
    if skip_local:
        parents = F.array_distinct(F.transform("instances", lambda i: F.regexp_replace(i["path"], "/[^/]*$", "")))
        per = per.where(F.size(parents) >= 2)
    return per.drop("_h").withColumn("fingerprint", F.concat(F.lit("dup:"), fnv32(F.col("text"))))


def ordered(group: DataFrame) -> list[Column]:
    """Most instances, most lines, first path, first line, fingerprint; the text ends all ties."""
    first = F.element_at("instances", 1)
    return [F.size("instances").desc(), F.col("line_count").desc(), first["path"], first["start_line"], F.col("fingerprint"), F.col("text")]


def collapse(group: DataFrame) -> DataFrame:
    """Greedy suppression in order: a group goes if one kept group overlaps all its instances.

    The groups that would suppress another, if kept, are those before it that overlap all its
    instances. They are found by equality of lines: of two ranges that overlap, one holds the
    first line of the other. What is kept then follows from these pairs of groups alone.
    """
    # Ids of sorted partitions grow in the sort's order; written down, they stay what they are.
    g = cut(group.orderBy(*ordered(group)).withColumn("gid", F.monotonically_increasing_id()))
    inst = cut(g.select("gid", F.size("instances").alias("n"), F.posexplode("instances").alias("i", "r")).select("gid", "n", "i", "r.*"))
    starts = inst.select("path", F.col("start_line").alias("line"), *[F.col(c).alias(f"{c}_s") for c in ("gid", "n", "i")])
    within = inst.select("path", F.explode(F.sequence("start_line", "end_line")).alias("line"), "gid", "n", "i")
    met = within.join(starts, ["path", "line"]).where("gid != gid_s")
    own = lambda later: [F.when(later, F.col(c)).otherwise(F.col(f"{c}_s")).alias(c) for c in ("gid", "n", "i")]
    pairs = met.select(F.least("gid", "gid_s").alias("by"), *own(F.col("gid") > F.col("gid_s"))).distinct()
    ruled = cut(pairs.groupBy("gid", "by").agg(F.count("*").alias("met"), F.first("n").alias("n")).where("met = n").select("gid", "by"))
    return g.join(suppressed(ruled), "gid", "left_anti").drop("gid")


def suppressed(ruled: DataFrame, small: int = SMALL) -> DataFrame:
    """The ``gid`` that go, of pairs of a group and an earlier one, ``by``, that rules it out if kept: by one task, or beyond ``small`` pairs by rounds."""
    if ruled.limit(small + 1).count() <= small:

        def walk(columns):
            gid, by = (c.to_numpy() for c in columns)
            order = np.lexsort((by, gid))
            gone: set[int] = set()
            for lo in range(0, len(order), 1 << 18):
                some = order[lo : lo + (1 << 18)]
                for a, b in zip(gid[some].tolist(), by[some].tolist()):
                    if b not in gone:
                        gone.add(a)
            return [pa.array(sorted(gone), pa.int64())]

        return in_one_task([ruled], "gid bigint", walk)
    out, left = [], ruled
    while True:
        # An earlier group that nothing can rule out any more is kept, and what it rules out goes.
        kept = left.select("by").distinct().join(left.select(F.col("gid").alias("by")).distinct(), "by", "left_anti")
        gone = cut(left.join(kept, "by", "left_semi").select("gid").distinct())
        if gone.isEmpty():
            return reduce(DataFrame.unionByName, out, gone)
        out.append(gone)
        left = cut(left.join(gone, "gid", "left_anti").join(gone.select(F.col("gid").alias("by")), "by", "left_anti").select("gid", "by"))


def stats(lines: DataFrame, group: DataFrame, threshold_bp: int = 0) -> DataFrame:
    """Analysed and duplicated (distinct) lines, basis points rounded down, and the gate: strictly above."""
    analysed = lines.agg(F.count("*").alias("analyzed_lines"))
    covered = group.select(F.explode("instances").alias("i")).select("i.*").distinct()
    dup = covered.select("path", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    dup = dup.join(lines.select("path", "line"), ["path", "line"], "left_semi").agg(F.count("*").alias("duplicated_lines"))
    both = analysed.crossJoin(dup).crossJoin(group.agg(F.count("*").alias("clone_groups")))
    n = F.when(F.col("analyzed_lines") > 0, F.col("analyzed_lines")).otherwise(1)
    wide = F.col("duplicated_lines").cast("decimal(30,0)") * 10000 > F.col("analyzed_lines").cast("decimal(30,0)") * threshold_bp
    return both.withColumns({"duplicated_bp": div(F.col("duplicated_lines") * 10000, n), "exceeded": wide})


def at_line(group: DataFrame, path: str, line: int) -> DataFrame:
    """Groups with an instance that spans a line of a file."""
    return group.where(F.exists("instances", lambda i: (i["path"] == path) & F.lit(line).between(i["start_line"], i["end_line"])))

