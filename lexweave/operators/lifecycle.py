"""Feedback analytics and annotation lifecycle: every change gives a new snapshot of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rating_totals(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count("*").alias("total"), *[F.count_if(F.col("rating") == r).alias(r) for r in ("up", "down", "dismissed")])


def by_stage(feedback: DataFrame) -> DataFrame:
    f = feedback.withColumn("stage", F.coalesce("stage", F.lit("overall")))
    return f.groupBy("stage").pivot("rating", ["up", "down", "dismissed"]).count().na.fill(0)


def top_rated(feedback: DataFrame, rating: str, n: int = 10) -> DataFrame:
    """Most often so rated labels, with the concept seen last; ties by first appearance."""
    c = feedback.where(F.col("rating") == rating).groupBy("label").agg(F.count("*").alias("n"), F.max_by("iri", F.struct("created_at", "id")).alias("iri"), F.min("id").alias("first_id"))
    return c.orderBy(F.desc("n"), "first_id").limit(n)


def recent(feedback: DataFrame, n: int = 20) -> DataFrame:
    return feedback.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return old.unionByName(new).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def promote(concepts: DataFrame, ann_id: str, k: int) -> DataFrame:
    """Swap rank ``k`` of an annotation (ann_id, rank, iri, state) with rank 0."""
    mine = F.col("ann_id") == ann_id
    rank = F.when(mine & (F.col("rank") == k), 0).when(mine & (F.col("rank") == 0), k).otherwise(F.col("rank"))
    return concepts.withColumn("rank", rank.cast("int")).withColumn("state", F.when(mine & (F.col("rank") == 0), "confirmed").when(mine & (F.col("rank") == k), "backup").otherwise(F.col("state")))


def cascade_promote(concepts: DataFrame, old_iri: str, new_iri: str) -> DataFrame:
    """In each annotation whose first concept is ``old_iri`` and which has ``new_iri`` as a backup, the two swap ranks."""
    has = concepts.groupBy("ann_id").agg(F.max(F.when((F.col("rank") == 0) & (F.col("iri") == old_iri), 1)).alias("a"), F.min(F.when((F.col("rank") > 0) & (F.col("iri") == new_iri), F.col("rank"))).alias("b"))
    hit = has.where("a = 1 AND b IS NOT NULL").select("ann_id", "b")
    out = concepts.join(hit, "ann_id", "left")
    rank = F.when(F.col("rank") == F.col("b"), 0).when(F.col("b").isNotNull() & (F.col("rank") == 0), F.col("b")).otherwise(F.col("rank"))
    return out.withColumn("new_rank", rank.cast("int")).select("ann_id", F.col("new_rank").alias("rank"), "iri", F.when(F.col("b").isNotNull() & (F.col("new_rank") == 0), "confirmed").when(F.col("b").isNotNull() & (F.col("new_rank") == F.col("b")), "backup").otherwise(F.col("state")).alias("state"))


def set_state(annotations: DataFrame, hit: Column, state: str) -> DataFrame:
    return annotations.withColumn("state", F.when(hit, state).otherwise(F.col("state")))


def job_sweep(jobs: DataFrame, now: Column, stale_minutes: int, retention_days: int) -> DataFrame:
    """Jobs after a sweep: running ones without change for too long fail, old ones go."""
    done = F.col("status").isin("completed", "failed", "pending")
    stale = ~done & (F.col("updated_at") < now - F.make_interval(mins=F.lit(stale_minutes)))
    out = jobs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))
    return out.where(F.col("updated_at") >= now - F.make_interval(days=F.lit(retention_days)))


def llm_prices(models: DataFrame) -> DataFrame:
    """Price per node of 800 input and 200 output tokens; a model id is also listed without its provider prefix unless that exists."""
    priced = models.select("model_id", F.round(F.col("input_price") * 800 + F.col("output_price") * 200, 10).alias("price"))
    bare = priced.where(F.col("model_id").contains("/")).select(F.regexp_replace("model_id", "^[^/]*/", "").alias("model_id"), "price").groupBy("model_id").agg(F.min("price").alias("price"))
    return priced.unionByName(bare.join(priced.select("model_id"), "model_id", "left_anti"))


def lineage(before: DataFrame, after: DataFrame, action: str) -> DataFrame:
    """(ann_id, iri, action, detail) for each concept of an annotation (ann_id, rank, iri, state) that a change has moved or re-stated."""
    old = before.select("ann_id", "iri", F.col("rank").alias("r0"), F.col("state").alias("s0")).distinct()
    new = after.select("ann_id", "iri", F.col("rank").alias("r1"), F.col("state").alias("s1")).distinct()
    kept = old.join(new, (old["ann_id"] == new["ann_id"]) & (old["iri"] == new["iri"]) & (old["r0"] == new["r1"]) & (old["s0"] == new["s1"]), "left_semi").select("ann_id", "iri", F.col("r0").alias("r1"), F.col("s0").alias("s1"))
    moved = new.join(kept, ["ann_id", "iri", "r1", "s1"], "left_anti")
    return moved.select("ann_id", "iri", F.lit(action).alias("action"), F.concat(F.lit("rank "), "r1", F.lit(", "), "s1").alias("detail"))


def lineage_of(events: DataFrame, ann_id: str) -> DataFrame:
    """Events (ann_id, seq, ...) of one annotation in order."""
    return events.where(F.col("ann_id") == ann_id).orderBy("seq")


def feedback_lines(feedback: DataFrame) -> DataFrame:
    """(id, value): a JSON line for each entry; null fields are left out."""
    return feedback.select("id", F.to_json(F.struct("id", "job_id", "rating", "stage", "iri", "label", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))).alias("value"))


def area_summary(concepts: DataFrame, most: int = 30) -> DataFrame:
    """(doc_id, summary) of (doc_id, ord, label, branch, definition): ``label [branch]`` by count, first seen on ties, up to ``most``, each with
    the first 60 characters of its first definition and its count if it has several."""
    key = F.concat("label", F.lit(" ["), F.coalesce("branch", F.lit("")), F.lit("]"))
    given = F.when(F.length("definition") > 0, F.struct("ord", "definition"))
    c = concepts.withColumn("key", key).groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min("ord").alias("ord"), F.min(given)["definition"].alias("d"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "ord", "key")
    top = c.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    short = F.concat(F.regexp_replace(F.substring("d", 1, 60), r"\s+$", ""), F.when(F.length("d") > 60, "...").otherwise(""))
    shown = F.concat("key", F.coalesce(F.concat(F.lit(" \u2014 "), short), F.lit("")), F.when(F.col("n") > 1, F.concat(F.lit(" (x"), "n", F.lit(")"))).otherwise(""))
    return top.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", shown.alias("s")))), lambda x: x["s"]), ", ").alias("summary"))


def areas(found: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, area, confidence, rank) of the areas that are sure enough, the surest first."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "area")
    return found.where(F.col("confidence") >= least).withColumn("rank", F.row_number().over(w))


def document_fields(elements: DataFrame) -> DataFrame:
    """(doc_id, page_count) of elements (doc_id, page): one more than the last page, as pages are counted there."""
    return elements.where("page IS NOT NULL").groupBy("doc_id").agg((F.max("page") + 1).cast("int").alias("page_count"))
