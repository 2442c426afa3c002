"""The progressive pipeline: a stream of documents whose stages write preliminary rows first, then what becomes of them.

Each stage of a micro-batch is a table of its own, ``<base>/<stage>/batch=<number>``. A table counts once Spark has marked it
as complete. A batch that is repeated after a stop skips the stages that are complete and writes the others anew, so it
changes nothing that a reader has seen; the stream's checkpoint tells it which files the batch holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexweave.operators import document_patterns, reconcile, ruler
from lexweave.sources.shared import exists

#: A stage makes its rows from the documents and the tables of the stages before it.
Stage = tuple[str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]]


def enrichment_stages(known: DataFrame, alternatives: DataFrame, identify: Callable[[DataFrame], DataFrame]) -> list[Stage]:
    """identified, preliminary, concepts, states, annotations.

    known: ruler patterns; alternatives: (iri, label, seq); identify: documents to concepts (doc_id, concept_text, iri, confidence, ord) of a model.
    """

    def preliminary(docs: DataFrame, made: dict[str, DataFrame]) -> DataFrame:
        first = ruler.preliminary(docs, known).drop("match_type").withColumn("source", F.lit("entity_ruler"))
        spans = document_patterns.concept_spans(docs, made["identified"])
        own = document_patterns.annotation_id("doc_id", "start", "end", "iri")
        second = spans.select(own.alias("ann_id"), "doc_id", "start", "end", "text", "iri", "confidence", F.lit("preliminary").alias("state"), F.lit("llm").alias("source"))
        return reconcile.merge_preliminary(first, second)

    def concepts(docs: DataFrame, made: dict[str, DataFrame]) -> DataFrame:
        by_ruler = made["preliminary"].where("source = 'entity_ruler'").select("doc_id", F.col("text").alias("concept_text"), "iri", "confidence", F.col("start").alias("ord"))
        return reconcile.reconcile(by_ruler, made["identified"])

    def states(docs: DataFrame, made: dict[str, DataFrame]) -> DataFrame:
        return reconcile.annotation_states(made["preliminary"], made["concepts"])

    def annotations(docs: DataFrame, made: dict[str, DataFrame]) -> DataFrame:
        resolved = made["concepts"].where("iri <> ''").select("doc_id", F.col("text").alias("concept_text"), "iri", "confidence", F.lit(0).alias("ord"))
        return document_patterns.annotate(docs, resolved, alternatives, made["states"])

    return [("identified", lambda docs, made: identify(docs)), ("preliminary", preliminary), ("concepts", concepts), ("states", states), ("annotations", annotations)]


def run_batch(docs: DataFrame, batch: int, base: str, stages: list[Stage]) -> None:
    """All stages of one batch, those left out whose tables are complete."""
    spark, made = docs.sparkSession, {}
    for name, make in stages:
        path = f"{base}/{name}/batch={batch}"
        if not exists(spark, f"{path}/_SUCCESS"):
            make(docs, made).write.mode("overwrite").parquet(path)
        made[name] = spark.read.parquet(path)


def start(docs: DataFrame, base: str, checkpoint: str, stages: list[Stage]) -> StreamingQuery:
    """The stream over what is there and what has come since the checkpoint."""
    return docs.writeStream.foreachBatch(lambda rows, batch: run_batch(rows, batch, base, stages)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark: SparkSession, base: str, stage: str) -> DataFrame:
    """Rows of a stage over all batches."""
    return spark.read.parquet(f"{base}/{stage}").drop("batch")
