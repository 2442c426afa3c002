"""Labels within a few edits of a query: an index of grams with their places, a count filter, then the edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Length of grams, and grams of a query that a label has to share.
GRAM, SHARED = 3, 2


def edits_of(length: Column, most: int = 2) -> Column:
    """Edits that a query of this length may have: one for each three characters, up to ``most``."""
    return F.least(F.floor(length / 3), F.lit(most)).cast("int")


def _grams(c: Column) -> Column:
    """(gram, at) of a text with ends filled by control characters, which labels do not have."""
    filled = F.concat(F.lit("\u0001" * (GRAM - 1)), c, F.lit("\u0002" * (GRAM - 1)))
    return F.transform(F.sequence(F.lit(1), F.length(c) + (GRAM - 1)), lambda i: F.struct(F.substring(filled, i, F.lit(GRAM)).alias("gram"), i.alias("at")))


def fuzzy_labels(queries: DataFrame, labels: DataFrame, most: int = 2, top: int | None = 25) -> DataFrame:
    """(query, label_key, iri, distance, score, rank) of the labels within ``edits_of`` the query, the nearest first; ``top`` None: all.

    ``queries``: query; ``labels``: label_key, iri. Case and outer blanks of a query do not count. An edit touches at most
    GRAM of the grams and moves the others by at most one place, so of any ``GRAM * edits + SHARED`` grams of the query a
    label within that distance holds SHARED, each moved by at most ``edits`` places. The rarest of the query's grams are
    taken; one row for each place where a gram may be meets the index by equality, pairs that share fewer than SHARED are
    left out, and the others are measured by a distance that stops at the bound. Queries of three characters and more have
    so many grams; shorter ones have to be equal, and share all of theirs. Null and empty queries and labels find nothing.

    The index has a row for each character of a label; counts of grams are a table that is joined. No list of labels is
    met by all queries: a frequent gram is taken only by a query that has no rarer ones, and its rows are split by the
    runtime where they skew. ``score`` is 100 times the share of characters that need no edit.
    """
    known = labels.select("label_key", "iri").where("label_key IS NOT NULL AND label_key <> '' AND iri IS NOT NULL").distinct()
    texts = known.select("label_key").distinct()
    index = texts.select("label_key", F.explode(_grams(F.col("label_key"))).alias("g")).select("label_key", "g.gram", "g.at")
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    asked = queries.select("query", F.lower(F.trim("query")).alias("q")).where("q <> ''").distinct()
    words = asked.select("q").distinct().withColumn("edits", edits_of(F.length("q"), most))
    grams = words.select("q", "edits", F.explode(_grams(F.col("q"))).alias("g")).select("q", "edits", "g.gram", "g.at").join(counts, "gram", "left")
    rarest = Window.partitionBy("q").orderBy(F.coalesce("n", F.lit(0)), "at")
    probes = grams.withColumn("k", F.row_number().over(rarest)).where((F.col("k") <= F.col("edits") * GRAM + SHARED) & F.col("n").isNotNull())
    places = F.sequence(F.col("at") - F.col("edits"), F.col("at") + F.col("edits"))
    probes = probes.select("q", "edits", "gram", "k", F.explode(places).alias("at"))
    met = probes.join(index, ["gram", "at"]).where(F.abs(F.length("q") - F.length("label_key")) <= F.col("edits"))
    pairs = met.groupBy("q", "edits", "label_key").agg(F.count_distinct("k").alias("shared")).where(F.col("shared") >= SHARED)
    near = pairs.withColumn("distance", F.levenshtein("q", "label_key", most)).where((F.col("distance") >= 0) & (F.col("distance") <= F.col("edits")))
    score = F.round(100 * (1 - F.col("distance") / F.greatest(F.length("q"), F.length("label_key"))), 4)
    found = near.select("q", "label_key", "distance", score.alias("score")).join(known, "label_key").join(asked, "q")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", F.desc("score"), "label_key", "iri")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("query", "label_key", "iri", "distance", "score", "rank")
