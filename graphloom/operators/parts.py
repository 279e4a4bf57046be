"""Part files, copied packages, mapper boundaries and credited references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def part_problems(parts: DataFrame, files: DataFrame) -> DataFrame:
    """Parts against what they say they are part of; a row a problem.

    ``parts`` has library, part and ord; ``files`` has path, library_name, part_of
    (a uri or name, null if none) and part_of_uri (resolved, null if by name).
    The first owner of a part, in order, keeps it.
    """
    first = F.row_number().over(Window.partitionBy("part").orderBy("ord", "library"))
    p = parts.withColumn("_n", first)
    lib = files.select(F.col("path").alias("library"), F.col("library_name").alias("_name"))
    own = files.select(F.col("path").alias("part"), "part_of", "part_of_uri", F.lit(True).alias("_there"))
    both = p.join(lib, "library", "left").join(own, "part", "left")
    reason = (
        F.when(F.col("_there").isNull(), None).when(F.col("part_of").isNull(), "missing-part-of").when(F.trim("part_of") == "", "empty-part-of")
        .when(F.col("_n") > 1, "duplicate-owner").when(F.col("part_of_uri").isNotNull() & (F.col("part_of_uri") != F.col("library")), "uri-mismatch")
        .when(F.col("part_of_uri").isNull() & ~F.col("part_of").eqNullSafe(F.col("_name")), "name-mismatch")
    )
    bad = both.withColumn("reason", reason).where("reason IS NOT NULL").select("part", "library", "reason")
    orphans = files.where("part_of IS NOT NULL").select(F.col("path").alias("part"), F.col("part_of_uri").alias("library")).join(parts.select("part").distinct(), "part", "left_anti")
    return bad.unionByName(orphans.withColumn("reason", F.lit("orphan")).select("part", "library", "reason"))


def canonical_copies(instances: DataFrame) -> DataFrame:
    """Instances of copied packages: those of every copy but the first are taken for the first's.

    ``instances`` has gid, identity (of the package), root, path (below the root),
    start_line and end_line. Copies line up if they have the same layout: the n-th
    instance of each is the same one.
    """
    order = Window.partitionBy("gid", "identity", "root").orderBy("path", "start_line", "end_line")
    n = instances.withColumn("rn", F.row_number().over(order))
    layout = n.groupBy("gid", "identity", "root").agg(F.array_sort(F.collect_list(F.struct("path", "start_line", "end_line"))).alias("layout"))
    first = layout.groupBy("gid", "identity", "layout").agg(F.min("root").alias("canonical"))
    roots = layout.join(first, ["gid", "identity", "layout"]).select("gid", "identity", "root", "canonical")
    return n.join(roots, ["gid", "identity", "root"]).select("gid", "identity", F.col("canonical").alias("root"), "path", "start_line", "end_line").distinct()


def mirrored(instances: DataFrame) -> DataFrame:
    """Groups that lie in several copies of one package and nowhere else."""
    per = instances.groupBy("gid").agg(F.count_distinct("identity").alias("i"), F.count_distinct("root").alias("r"))
    return per.where("i = 1 AND r > 1").select("gid")


def mapping_boundaries(instances: DataFrame, pairs: DataFrame) -> DataFrame:
    """Groups all of whose instances lie in one model and entity pair's ranges, with some in both.

    ``pairs`` has boundary, side (model or entity), path, start_line, end_line.
    """
    met = instances.alias("i").join(pairs.alias("b"), (F.col("i.path") == F.col("b.path")) & (F.col("i.start_line") >= F.col("b.start_line")) & (F.col("i.end_line") <= F.col("b.end_line")))
    per = met.groupBy("i.gid", "b.boundary").agg(F.count_distinct(F.struct("i.path", "i.start_line")).alias("n"), F.bool_or(F.col("b.side") == "model").alias("m"), F.bool_or(F.col("b.side") == "entity").alias("e"))
    total = instances.groupBy("gid").agg(F.count_distinct(F.struct("path", "start_line")).alias("all"))
    return per.join(total, "gid").where("n = all AND m AND e").select("gid").distinct()


def credited(references: DataFrame, members: DataFrame) -> DataFrame:
    """References to members of an owner count for the owner too: extension members, generated providers.

    ``members`` has name and owner.
    """
    extra = references.join(members.select("name", "owner").distinct(), "name").withColumn("name", F.col("owner")).select(references.columns)
    return references.unionByName(extra)


def provider_names(declarations: DataFrame) -> DataFrame:
    """Generated provider names of annotated declarations: lower camel, with ``Provider``."""
    lower = F.concat(F.lower(F.substring("name", 1, 1)), F.expr("substring(name, 2)"))
    return declarations.select(F.explode(F.array(F.concat(lower, F.lit("Provider")), F.concat(lower, F.lit("NotifierProvider")))).alias("name"), F.col("name").alias("owner"))


def name_exposure(exports: DataFrame) -> DataFrame:
    """Names that a library's importers get from several declarations, by namespace (re-exported or not, prefix).

    ``exports`` has library, exported, prefix, name, supplier and declaring.
    """
    per = exports.groupBy("library", "exported", "prefix", "name").agg(F.count_distinct("supplier").alias("suppliers"), F.count_distinct("declaring").alias("declaring"))
    return per.where("suppliers > 1 AND declaring > 1")
