"""Graphs around many concepts at once: one frontier of (root, node) rows for all roots, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.sources.shared import fresh_dir

NODE = "root string, iri string, depth int, phase string, pos long, more boolean"


def _first(df: DataFrame, keys: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of each key; the limit works before the shuffle, so that a hot key sends no more than this from each task."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def _steps(df: DataFrame, src: str, dst: str, order: Column, most: int) -> DataFrame:
    """(src, dst, ord): the first ``most`` distinct neighbours of each node."""
    named = df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), order.cast("long").alias("ord")).where("src IS NOT NULL AND dst IS NOT NULL")
    return _first(named.groupBy("src", "dst").agg(F.min("ord").alias("ord")), ["src"], [F.asc_nulls_last("ord"), "dst"], most)


def entity_graphs(
    spark: SparkSession, edges: DataFrame, see_also: DataFrame, roots: DataFrame, branch_roots: DataFrame | None = None, ancestors: int = 50, depth: int = 2, max_nodes: int = 200, related: int = 5
) -> DataFrame:
    """(root, iri, depth, phase, root_type, truncated) around each of ``roots`` (iri), breadth first.

    Ancestors up to the top (negative depth), descendants down to ``depth``, up to ``related`` related concepts of each node
    found (depth 0), and their ancestors. A node keeps the depth of its first discovery. Of a root no more than ``max_nodes``
    nodes stay, in order of the node that finds them, of the edge and of the name; ``truncated`` says that there were more.
    ``root_type`` of a node among ``branch_roots`` (iri; by default what has children and no parent) is ``ultimate`` if it is
    the root itself or above it, else ``ancillary``; null for other nodes.

    Each level is a join of the frontier with the edges, an anti-join with the nodes found, and a rank by root; it is written
    to the shared folder, so that there is a job for each level and not for each root, and nothing but counts reaches the
    driver. A node's neighbours are cut to ``2 * max_nodes + 1`` first: at most ``max_nodes`` of them can be known already, so
    later ones are never among those kept and more than those kept are left to tell that some are missing. Joins are sorted:
    by the size of its file, in which names repeat, a level would be sent to all tasks through the driver. Null ids are
    left out, repeated roots and edges count once, cycles end at nodes found before, and no roots give no rows.
    """
    base, room = fresh_dir(spark, "graphs"), 2 * max_nodes + 1
    up = _steps(edges, "child", "parent", F.col("ord"), room)
    down = _steps(edges, "parent", "child", F.lit(0), room)
    beside = _steps(see_also, "src", "dst", F.col("ord"), related)
    for name, step in (("up", up), ("down", down), ("beside", beside)):
        step.write.parquet(f"{base}/{name}")
    up, down, beside = (spark.read.schema("src string, dst string, ord long").parquet(f"{base}/{name}") for name in ("up", "down", "beside"))
    paths: list[str] = []

    def found() -> DataFrame:
        return spark.read.schema(NODE).parquet(*paths)

    def keep(rows: DataFrame) -> int:
        """Write a level; how many nodes it has."""
        path = f"{base}/level-{len(paths)}"
        rows.write.parquet(path)
        paths.append(path)
        return spark.read.schema(NODE).parquet(path).count()

    def level(at: DataFrame, step: DataFrame, d: int, phase: str) -> int:
        known = found()
        size = known.groupBy("root").agg(F.count("*").alias("n"))
        new = at.select("root", "pos", F.col("iri").alias("src")).join(step.hint("merge"), "src").groupBy("root", F.col("dst").alias("iri")).agg(F.min(F.struct("pos", "ord")).alias("o"))
        new = new.join(known.select("root", "iri").hint("merge"), ["root", "iri"], "left_anti")
        first = Window.partitionBy("root").orderBy("o", "iri")
        ranked = new.withColumn("k", F.row_number().over(first)).where(F.col("k") <= max_nodes + 1).join(size.hint("merge"), "root")
        # the row after the last one kept says that there were more; it is a row without a node
        over = F.col("k") + F.col("n") > max_nodes
        rows = ranked.where(F.col("k") + F.col("n") <= max_nodes + 1)
        iri = F.when(~over, F.col("iri"))
        return keep(rows.select("root", iri.alias("iri"), F.lit(d).alias("depth"), F.lit(phase).alias("phase"), (F.col("n") + F.col("k")).cast("long").alias("pos"), over.alias("more")))

    def walk(start: DataFrame, step: DataFrame, levels: int, sign: int, phase: str) -> None:
        at = start
        for d in range(1, levels + 1):
            if not level(at, step, sign * d, phase):
                break
            at = spark.read.schema(NODE).parquet(paths[-1]).where("iri IS NOT NULL")

    focus = roots.select(F.col("iri").alias("root")).where("root IS NOT NULL").distinct()
    keep(focus.select("root", F.col("root").alias("iri"), F.lit(0).alias("depth"), F.lit("focus").alias("phase"), F.lit(1).cast("long").alias("pos"), F.lit(False).alias("more")))
    start = spark.read.schema(NODE).parquet(paths[0])
    walk(start, up, max(ancestors, 50), -1, "ancestor")
    walk(start, down, depth, 1, "descendant")
    if level(found().where("iri IS NOT NULL"), beside, 0, "related"):
        walk(spark.read.schema(NODE).parquet(paths[-1]).where("iri IS NOT NULL"), up, 50, -1, "related_ancestor")
    tops = branch_roots if branch_roots is not None else edges.select(F.col("parent").alias("iri")).distinct().join(edges.select(F.col("child").alias("iri")).hint("merge"), "iri", "left_anti")
    cut = found().where("more").select("root").distinct().withColumn("truncated", F.lit(True))
    nodes = found().where("iri IS NOT NULL").join(tops.select("iri").where("iri IS NOT NULL").distinct().withColumn("top", F.lit(True)).hint("merge"), "iri", "left").join(cut.hint("merge"), "root", "left")
    kind = F.when(F.col("top"), F.when(F.col("phase").isin("focus", "ancestor"), "ultimate").otherwise("ancillary"))
    return nodes.select("root", "iri", "depth", "phase", kind.alias("root_type"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


def graph_edges(nodes: DataFrame, edges: DataFrame, see_also: DataFrame, depth: int = 2, related: int = 5) -> DataFrame:
    """(root, source, target, kind) between the ``nodes`` of ``entity_graphs``: ``subClassOf`` from parent to child, where the walk went up from the
    child or down from the parent, and ``seeAlso`` in order of the two names, from what was found before related nodes were."""
    ends = nodes.select("root", "iri", "depth", "phase")
    upward = ends.where("phase <> 'descendant'").select("root", F.col("iri").alias("child")).join(edges.select("child", "parent"), "child")
    downward = ends.where((F.col("phase").isin("focus", "descendant")) & (F.col("depth") < depth)).select("root", F.col("iri").alias("parent")).join(edges.select("child", "parent"), "parent")
    tree = upward.select("root", F.col("parent").alias("source"), F.col("child").alias("target")).union(downward.select("root", F.col("parent").alias("source"), F.col("child").alias("target")))
    near = ends.where(~F.col("phase").isin("related", "related_ancestor")).select("root", F.col("iri").alias("src")).join(_steps(see_also, "src", "dst", F.col("ord"), related).select("src", "dst"), "src")
    beside = near.select("root", F.least("src", "dst").alias("source"), F.greatest("src", "dst").alias("target"))
    both = tree.withColumn("kind", F.lit("subClassOf")).unionByName(beside.withColumn("kind", F.lit("seeAlso"))).distinct()
    for end in ("source", "target"):
        both = both.join(ends.select("root", F.col("iri").alias(end)), ["root", end], "left_semi")
    return both.select("root", "source", "target", "kind")
