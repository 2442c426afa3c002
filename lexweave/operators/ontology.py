"""Ontology tables: label indexes, branches, hierarchy and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.sources.shared import fresh_dir, kept, sized

TYPE_RANK = {"preferred": 0, "alternative": 1, "hidden": 2, "translation": 3}


def concept_projection(concepts: DataFrame) -> DataFrame:
    """preferred_label is the label, else the skos one; alt_pref keeps the skos one only if it differs without regard to case."""
    return concepts.select(
        "iri", F.coalesce("label", "pref_label").alias("preferred_label"), F.when(F.lower("pref_label") != F.lower("label"), F.col("pref_label")).alias("alt_pref"), "definition", "branch", "deprecated"
    )


def label_rows(concepts: DataFrame, labels: DataFrame) -> DataFrame:
    """(iri, label_key, label_type, type_rank, ord) of live concepts."""
    own = concepts.where("NOT deprecated").select("iri", "label", F.lit("preferred").alias("label_type"), "ord")
    other = labels.join(concepts.where("NOT deprecated").select("iri", "ord"), "iri").select("iri", "label", "label_type", "ord")
    rank = F.create_map(*[x for k, v in TYPE_RANK.items() for x in (F.lit(k), F.lit(v))])
    return own.unionByName(other).select("iri", F.lower("label").alias("label_key"), "label_type", rank[F.col("label_type")].alias("type_rank"), "ord")


def label_winner(rows: DataFrame) -> DataFrame:
    """One concept for each label: best type; of one type the last concept wins."""
    best = F.min_by(F.struct("iri", "label_type"), F.struct(F.col("type_rank"), -F.col("ord"), F.col("iri")))
    return rows.groupBy("label_key").agg(best.alias("w")).select("label_key", "w.iri", "w.label_type")


def label_all(rows: DataFrame) -> DataFrame:
    """All concepts of each label, each with its best type."""
    w = Window.partitionBy("label_key", "iri").orderBy("type_rank", "ord")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("label_key", "iri", "label_type")


def property_labels(properties: DataFrame) -> DataFrame:
    """Labels of properties: prefix cut, camel case spaced, lower case; preferred before alternative; withdrawn ones left out."""
    clean = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, "^[a-z]+:", ""), "([a-z])([A-Z])", "$1 $2"))
    live = properties.where(~F.col("label").startswith("DEPRECATED") & ~F.col("label").startswith("ZZZ:"))
    rows = live.select("iri", clean(F.col("label")).alias("label_key"), F.lit(0).alias("r")).unionByName(
        live.where("alt_label IS NOT NULL").select("iri", clean(F.col("alt_label")).alias("label_key"), F.lit(1).alias("r"))
    )
    return rows.groupBy("label_key").agg(F.min(F.struct("r", "iri")).alias("m")).select("label_key", "m.iri", F.when(F.col("m.r") == 0, "preferred").otherwise("alternative").alias("label_type"))


def branch_counts(concepts: DataFrame) -> DataFrame:
    return concepts.where("branch IS NOT NULL AND NOT deprecated").groupBy("branch").agg(F.count("*").alias("n_concepts"))


ROOT = "lex:root"
#: Most levels of a hierarchy that is walked to its end.
MOST_LEVELS = 100


def below_counts(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, n_below, deepest): ways down from each node, and the longest of them; levels carry a count for each node, not its ways."""
    base, levels, d = fresh_dir(spark, "below"), [], 1
    at, n = kept(edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n")), f"{base}/1")
    while n:
        if d > MOST_LEVELS:
            raise ValueError(f"more than {MOST_LEVELS} levels: the edges have a cycle")
        levels.append(at.select("node", "n", F.lit(d).alias("depth")))
        d += 1
        up = edges.join(sized(at.select(F.col("node").alias("child"), "n"), n), "child").groupBy(F.col("parent").alias("node")).agg(F.sum("n").alias("n"))
        at, n = kept(up, f"{base}/{d}")
    out = levels[0] if levels else at.select("node", "n", F.lit(0).alias("depth"))
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.groupBy("node").agg(F.sum("n").alias("n_below"), F.max("depth").alias("deepest"))


def _nearest_top(spark: SparkSession, concepts: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """(iri, branch_root, depth): breadth first from the children of the root down; a node first met at a level has its nearest one there, the first by name."""
    base = fresh_dir(spark, "branches")
    inner, _ = kept(edges.select(F.col("parent").alias("iri")).where("iri IS NOT NULL").distinct(), f"{base}/inner")
    tops = edges.where((F.col("parent") == ROOT) & F.col("child").isNotNull()).select(F.col("child").alias("iri")).distinct()
    at, n = kept(tops.select("iri", F.col("iri").alias("branch_root"), F.lit(0).alias("depth")), f"{base}/0")
    found = at
    for d in range(1, most + 1):
        if not n:
            break
        going, n = kept(at.join(inner.hint("merge"), "iri", "left_semi").select(F.col("iri").alias("parent"), "branch_root"), f"{base}/going-{d}")
        new = edges.where("child IS NOT NULL").join(sized(going, n), "parent").groupBy(F.col("child").alias("iri")).agg(F.min("branch_root").alias("branch_root"))
        at, n = kept(new.join(found.select("iri").hint("merge"), "iri", "left_anti").select("iri", "branch_root", F.lit(d).alias("depth")), f"{base}/{d}")
        found = found.unionByName(at)
    return concepts.select("iri").distinct().join(found.hint("merge"), "iri").select("iri", "branch_root", "depth")


def _one_up(edges: DataFrame, best: DataFrame, rows: int) -> DataFrame:
    """(child, parent, depth, path): the longest way of the parent, and a step more."""
    own = best.select(F.col("iri").alias("parent"), F.col("depth").alias("_d"), F.col("path").alias("_p"))
    met = edges.select("child", "parent").join(sized(own, rows), "parent", "left")
    return met.select("child", "parent", (F.coalesce("_d", F.lit(0)) + 1).alias("depth"), F.concat("_p", F.lit(" > "), "child").alias("path"))


def _longest(rows: DataFrame, up: DataFrame) -> DataFrame:
    """(iri, depth, path) of ``rows`` (iri): the longest of their ways up, the last by name; those without a way are their own."""
    most = up.groupBy(F.col("child").alias("iri")).agg(F.max(F.struct("depth", "path")).alias("m"))
    met = rows.join(most.hint("merge"), "iri", "left")
    return met.select("iri", F.coalesce("m.depth", F.lit(0)).alias("depth"), F.when(F.col("m").isNull(), F.col("iri")).otherwise(F.col("m.path")).alias("path"))


def _inner_paths(spark: SparkSession, edges: DataFrame, first: DataFrame, steps: int) -> tuple[DataFrame, int]:
    """(iri, depth, path) of all nodes that have children, and how many: the longest way up by ``first`` of at most ``steps`` steps."""
    base = fresh_dir(spark, "paths")
    inner, n = kept(edges.select(F.col("parent").alias("iri")).where("iri IS NOT NULL").distinct(), f"{base}/inner")
    up, _ = kept(first.select("child", "parent").join(sized(inner.select(F.col("iri").alias("child")), n), "child", "left_semi"), f"{base}/up")
    best = inner.select("iri", F.lit(0).alias("depth"), F.col("iri").alias("path"))
    for k in range(1, steps + 1):
        best, _ = kept(_longest(inner, _one_up(up, best, n)), f"{base}/{k}")
        if (best.agg(F.max("depth")).first()[0] or 0) < k:
            break
    return best, n


def hierarchy(spark: SparkSession, kind: str, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """branch: nearest child of the root above, up to 20 steps; path: first-parent path from the root; paths: one path for each parent; both up to 9 steps.

    Nodes with children are walked first, level by level, and written; the others, most of an ontology, are one step more.
    """
    if kind == "branch":
        return _nearest_top(spark, concepts, edges)
    first = edges.where("ord = 0")
    if kind == "path":
        first = first.where(F.col("child") != ROOT)
        best, n = _inner_paths(spark, edges, first, 8)
        return _longest(concepts.select("iri").distinct(), _one_up(first, best, n))
    best, n = _inner_paths(spark, edges, first, 8)
    return _one_up(edges, best, n).select(F.col("child").alias("iri"), F.col("parent").alias("via"), "path").distinct()


def concept_detail(concepts: DataFrame, edges: DataFrame, see_also: DataFrame) -> DataFrame:
    """Children, parents, siblings (children of the first parent) and related concepts of each concept, as sorted lists.

    A concept's siblings are its parent's list without its own name, which is cut out where it stands, so that a parent's
    children meet their list and not each other. Lists are joined last, since siblings are as long for each child as all of them.
    """
    sort = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    pairs = edges.select("parent", "child").distinct()
    lists = pairs.groupBy("parent").agg(sort("child").alias("children"))
    parents = pairs.groupBy(F.col("child").alias("iri")).agg(sort("parent").alias("parents"))
    related = see_also.groupBy(F.col("src").alias("iri")).agg(sort("dst").alias("related"))
    first = edges.where("ord = 0 AND parent IS NOT NULL AND child IS NOT NULL").groupBy(F.col("child").alias("iri")).agg(F.min("parent").alias("parent"), F.min("parent").eqNullSafe(F.max("parent")).alias("one"))
    # Of a concept with several first parents the siblings are joined one by one.
    several = first.where("NOT one").select("iri").join(edges.where("ord = 0").select(F.col("child").alias("iri"), "parent"), "iri")
    mixed = several.join(pairs.select("parent", F.col("child").alias("other")), "parent").where("iri <> other").groupBy("iri").agg(sort("other").alias("mixed"))
    before = Window.partitionBy("parent").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("child") + 1).over(before), F.lit(0)).cast("int")
    placed = pairs.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", F.col("child").alias("iri"), at.alias("at")).join(first.where("one").select("iri", "parent").hint("merge"), ["iri", "parent"])
    out = concepts.select("iri", F.substring_index("iri", "/", -1).alias("iri_hash"))
    for t in (parents, related, mixed, placed.withColumnRenamed("parent", "_first")):
        out = out.join(t.hint("merge"), "iri", "left")
    out = out.join(lists.withColumnRenamed("parent", "iri").hint("merge"), "iri", "left")
    out = out.join(lists.select(F.col("parent").alias("_first"), F.col("children").cast("binary").alias("_all")).hint("merge"), "_first", "left")
    size, end = F.octet_length("_all"), F.col("at") + F.octet_length("iri")
    head = F.substring(F.col("_all"), F.lit(1), F.greatest(F.when(end == size, F.col("at") - 1).otherwise(F.col("at")), F.lit(0)))
    own = F.concat(head, F.substring(F.col("_all"), end + 2, size)).cast("string")
    out = out.select("iri", "iri_hash", "children", "parents", F.coalesce("mixed", own).alias("siblings"), "related")
    return out.na.fill("", ["children", "parents", "siblings", "related"])


def by_label(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, iri) of the concepts that have the query as a label, whatever its case; ``rows`` as of ``label_rows``."""
    asked = queries.select("query", F.lower(F.trim("query")).alias("label_key")).distinct()
    return asked.join(rows.select("label_key", "iri").distinct(), "label_key").select("query", "iri").distinct()


#: Characters by which a query meets the labels that begin with it.
PREFIX_KEY = 64


def by_prefix(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, label_key, iri) of the labels that begin with the query, of any length: an equi-join on its first characters, then the whole query is compared.

    Only distinct labels are dealt by their beginnings; their concepts come last. Both
    joins are sorted: what a label gives in rows is far more than its table's size says, too much for a driver to send around.
    """
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length("label_key"), F.lit(PREFIX_KEY))), lambda n: F.substring("label_key", F.lit(1), n))
    known = rows.where("label_key <> ''").select("label_key", "iri").distinct()
    begun = known.select("label_key").distinct().select("label_key", F.explode(starts).alias("start"))
    asked = queries.select("query", F.lower(F.trim("query")).alias("whole")).distinct().withColumn("start", F.substring("whole", 1, PREFIX_KEY))
    met = asked.join(begun.hint("merge"), "start").where(F.col("label_key").startswith(F.col("whole"))).select("query", "label_key")
    return met.join(known.hint("merge"), "label_key").select("query", "label_key", "iri")


def batch_detail(concepts: DataFrame, edges: DataFrame, see_also: DataFrame, iris: DataFrame, most: int = 100) -> DataFrame:
    """Details of up to ``most`` distinct concepts (iri), the first by name; unknown ones are left out.

    Only the edges that these details need are put together: those at the concepts, and those below their first parents.
    """
    base = fresh_dir(iris.sparkSession, "batch")
    asked, _ = kept(iris.select("iri").distinct().orderBy("iri").limit(most), f"{base}/asked")
    own = lambda df, c: df.join(F.broadcast(asked.withColumnRenamed("iri", c)), c, "left_semi")
    firsts = own(edges.where("ord = 0"), "child").select("parent")
    above, n = kept(firsts.unionByName(asked.select(F.col("iri").alias("parent"))).where("parent IS NOT NULL").distinct(), f"{base}/above")
    at = own(edges, "child").unionByName(edges.join(sized(above, n), "parent", "left_semi").select(*edges.columns)).select("child", "parent", "ord").distinct()
    return concept_detail(own(concepts, "iri"), at, own(see_also, "src"))


def entity_graph(spark: SparkSession, edges: DataFrame, see_also: DataFrame, root: str, ancestors: int = 50, depth: int = 2, max_nodes: int = 200, related: int = 5) -> DataFrame:
    """(iri, depth, phase, truncated) around a concept, breadth first: ancestors up to the root (negative depth), descendants up to
    ``depth``, up to ``related`` related concepts of each node found (depth 0), and their ancestors.

    A node keeps the depth of its first discovery. No more than ``max_nodes`` are kept; ``truncated`` says that there were more.
    Levels are joined and cut in Spark; the driver holds the nodes kept, at most ``max_nodes``.
    """
    found: dict[str, tuple[int, str]] = {root: (0, "focus")}
    truncated = False
    up = edges.select(F.col("child").alias("src"), F.col("parent").alias("dst"), "ord")
    down = edges.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(0).alias("ord"))
    first = Window.partitionBy("src").orderBy("ord", "dst")
    beside = see_also.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= related).select("src", "dst", "ord")

    def level(at: list[str], step: DataFrame) -> list[str]:
        """New neighbours, in order of the node that finds them, of the edge and of the name."""
        nonlocal truncated
        where = spark.createDataFrame(list(enumerate(at)), "pos int, src string")
        new = where.join(step, "src").where(~F.col("dst").isin(*found)).groupBy("dst").agg(F.min(F.struct("pos", "ord")).alias("o")).orderBy("o", "dst")
        got = [r.dst for r in new.limit(max_nodes - len(found) + 1).collect()]
        truncated = truncated or len(got) > max_nodes - len(found)
        return got[: max_nodes - len(found)]

    def walk(start: list[str], step: DataFrame, levels: int, sign: int, phase: str) -> None:
        at = start
        for k in range(1, levels + 1):
            at = level(at, step)
            if not at:
                break
            found.update({iri: (sign * k, phase) for iri in at})

    walk([root], up, max(ancestors, 50), -1, "ancestor")
    walk([root], down, depth, 1, "descendant")
    near = level(list(found), beside)
    found.update({iri: (0, "related") for iri in near})
    if near:
        walk(near, up, 50, -1, "related_ancestor")
    return spark.createDataFrame([(iri, d, phase, truncated) for iri, (d, phase) in found.items()], "iri string, depth int, phase string, truncated boolean")
