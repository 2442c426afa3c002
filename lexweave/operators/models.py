"""Model-backed operators: a pluggable provider runs over rows in Arrow batches; a failed row gives an error, not a failed job.

Prompts are string columns, answers are parsed by SQL functions; only the call itself is Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A provider takes a prompt and returns text; it is pickled to executors.
Provider = Callable[[str], str]
_PROVIDERS: dict[str, Callable[[], Provider]] = {}


def register_provider(name: str, make: Callable[[], Provider]) -> None:
    _PROVIDERS[name] = make


def provider_maker(name: str) -> Callable[[], Provider]:
    """What makes the provider; it goes to executors, where the registry may lack a caller's own entries."""
    if name not in _PROVIDERS:
        raise ValueError(f"unknown provider: {name}")
    return _PROVIDERS[name]


def get_provider(name: str) -> Provider:
    return provider_maker(name)()


def echo_provider() -> Provider:
    """A deterministic stand-in: names every capitalised word of the prompt's text as a concept."""

    def answer(prompt: str) -> str:
        words = dict.fromkeys(w.strip(".,;:!?") for w in prompt.rpartition("TEXT:")[2].split() if w[:1].isupper())
        return "```json\n" + json.dumps({"concepts": [{"text": w, "confidence": round(min(0.95, 0.4 + len(w) / 20), 2)} for w in words if w]}) + "\n```"

    return answer


def failing_provider() -> Provider:
    def answer(prompt: str) -> str:
        raise RuntimeError("no model")

    return answer


register_provider("echo", echo_provider)
register_provider("failing", failing_provider)


def complete(prompts: DataFrame, provider: str, tries: int = 2) -> DataFrame:
    """(key, answer, error) of (key, prompt), both strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = make()
        for batch in batches:
            answers, errors = [], []
            for prompt in batch.column("prompt").to_pylist():
                answer, error = None, None
                for _ in range(tries):
                    try:
                        answer, error = ask(prompt or ""), None
                        break
                    except Exception as e:  # noqa: BLE001  a provider may raise anything; the row says what
                        error = f"{type(e).__name__}: {e}"[:200]
                answers.append(answer), errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(answers, pa.string()), pa.array(errors, pa.string())], ["key", "answer", "error"])

    make = provider_maker(provider)
    return prompts.select(F.col("key").cast("string").alias("key"), "prompt").mapInArrow(run, "key string, answer string, error string")


def unfenced(answer: Column) -> Column:
    """The JSON inside a fenced answer, or the answer itself."""
    inner = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(F.length(inner) > 0, inner).otherwise(answer)


def concept_prompt(text: Column) -> Column:
    return F.concat(F.lit("List the concepts of the text as JSON.\nTEXT:\n"), text)


def identify_concepts(chunks: DataFrame, provider: str) -> DataFrame:
    """(doc_id, chunk_index, concept_text, confidence): a chunk whose call fails gives none."""
    keyed = chunks.withColumn("key", F.concat_ws(":", "doc_id", "chunk_index"))
    answers = complete(keyed.select("key", concept_prompt(F.col("text")).alias("prompt")), provider)
    shape = "struct<concepts: array<struct<text: string, confidence: double>>>"
    found = answers.where("answer IS NOT NULL").select("key", F.explode(F.from_json(unfenced(F.col("answer")), shape)["concepts"]).alias("c"))
    part = F.split("key", ":")
    sure = F.least(F.greatest(F.coalesce("c.confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return found.select(part[0].cast("long").alias("doc_id"), part[1].cast("int").alias("chunk_index"), F.col("c.text").alias("concept_text"), sure.alias("confidence"))


def best_concepts(found: DataFrame) -> DataFrame:
    """Surest row of each (doc_id, lower text)."""
    return found.groupBy("doc_id", F.lower("concept_text").alias("label_key")).agg(F.max("confidence").alias("confidence"))


def rerank(concepts: DataFrame, answers: DataFrame) -> DataFrame:
    """Concepts (text, iri, confidence) blended half and half with scores from an answer {"scores": [{text, iri, score}]}, clamped."""
    shape = "struct<scores: array<struct<text: string, iri: string, score: double>>>"
    s = answers.select(F.explode(F.from_json(unfenced(F.col("answer")), shape)["scores"]).alias("s")).select(F.col("s.text").alias("text"), F.col("s.iri").alias("iri"), F.least(F.greatest("s.score", F.lit(0.0)), F.lit(1.0)).alias("score"))
    s = s.groupBy("text", "iri").agg(F.max("score").alias("score"))
    return concepts.join(s, ["text", "iri"], "left").withColumn("confidence", F.when(F.col("score").isNotNull(), F.round(0.5 * F.col("confidence") + 0.5 * F.col("score"), 4)).otherwise(F.col("confidence"))).drop("score")


def branch_detail(concepts: DataFrame, by_branch: int = 8, budget: int = 8000) -> DataFrame:
    """(branch, line): up to ``by_branch`` concepts of each branch as prompt lines, as long as their running length fits the budget."""
    w = Window.partitionBy("branch").orderBy("label", "iri")
    lines = concepts.where("branch IS NOT NULL").withColumn("k", F.row_number().over(w)).where(F.col("k") <= by_branch)
    grouped = lines.groupBy("branch").agg(F.concat(F.lit("- "), F.first("branch"), F.lit(": "), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "label"))), lambda x: x["label"]), ", ")).alias("line"))
    total = F.sum(F.length("line")).over(Window.orderBy("branch").rowsBetween(Window.unboundedPreceding, 0))  # one row for each branch
    return grouped.withColumn("total", total).where(F.col("total") <= budget).select("branch", "line")
