"""Ontology search: content words, bidirectional overlap, graduated relevance, ancestors, resolution once per distinct text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.sources.shared import fresh_dir, kept, sized

#: Words that carry no content in a query.
STOP = (
    "a an the of and or in for to with by on at is are was were be been being not no has have had do does did this that it its their other such than"
    " law legal type types general"
).split()


def content_words(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP)))


def _common_prefix(a: Column, b: Column) -> Column:
    most = F.least(F.length(a), F.length(b))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)), i).otherwise(n))


def _credit(a: Column, b: Column) -> Column:
    """1 for equal words, .8 if one starts the other, .7 for a long common start."""
    least = F.least(F.length(a), F.length(b))
    stem = _common_prefix(a, b)
    return (
        F.when(a == b, 1.0)
        .when((least >= 3) & (F.startswith(a, b) | F.startswith(b, a)), 0.8)
        .when((least >= 5) & (stem >= 4) & (stem / least >= 0.7), 0.7)
        .otherwise(0.0)
    )


def _one_way(source: Column, target: Column) -> Column:
    each = F.transform(source, lambda s: F.array_max(F.transform(target, lambda d: _credit(s, d))))
    return F.aggregate(each, F.lit(0.0), lambda t, x: t + x) / F.size(source)


def word_overlap(query: Column, target: Column) -> Column:
    """Mean best credit of the query's words, or .75 of the reverse if the target has two words or more."""
    reverse = F.when(F.size(target) >= 2, _one_way(target, query) * 0.75).otherwise(0.0)
    return F.when((F.size(query) == 0) | (F.size(target) == 0), 0.0).otherwise(F.greatest(_one_way(query, target), reverse))


def relevance(pairs: DataFrame) -> DataFrame:
    """``pairs`` (query, label, pref_label, definition, synonyms) with ``score`` from 0 to 99.

    Exact labels score by word count; else the best of label, preferred label and synonyms, raised a little by the definition.
    """
    q = F.lower(F.trim("query"))
    label, pref, text = F.lower("label"), F.lower("pref_label"), F.lower("definition")
    words = pairs.withColumns(
        {
            "_q": q, "_qw": content_words(F.col("query")), "_lw": content_words(F.col("label")), "_pw": content_words(F.coalesce("pref_label", F.lit(""))),
            "_dw": content_words(F.coalesce("definition", F.lit(""))), "_sw": F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), content_words),
        }
    )
    q = F.col("_q")
    n = F.size(F.split(q, r"\s+"))
    by_words = word_overlap(F.col("_qw"), F.col("_lw")) * 88
    inside = F.when((F.length(q) >= 4) & label.contains(q), 85.0).when((F.length(label) >= 4) & q.contains(label) & (F.length(label) / F.length(q) > 0.3), 78.0).otherwise(0.0)
    pref_score = F.when(pref.isNull() | (pref == ""), 0.0).when(q == pref, 90.0).when((F.length(q) >= 4) & pref.contains(q), 84.0).otherwise(word_overlap(F.col("_qw"), F.col("_pw")) * 86)
    syn_score = F.coalesce(F.array_max(F.transform("_sw", lambda s: word_overlap(F.col("_qw"), s) * 82)), F.lit(0.0))
    def_score = F.when(text.isNull(), 0.0).otherwise(F.greatest(F.when(text.contains(q), 60.0).otherwise(0.0), word_overlap(F.col("_qw"), F.col("_dw")) * 55))
    scored = words.withColumns({"_l": F.greatest(inside, by_words), "_p": pref_score, "_s": syn_score, "_d": def_score})
    primary = F.greatest("_l", "_p", "_s")
    final = F.when(primary > 0, primary + F.least(F.col("_d") * 0.12, F.lit(8.0))).otherwise(F.col("_d"))
    exact = F.when(n >= 3, 97.0).when(n == 2, 92.0).otherwise(82.0)
    score = F.when(F.coalesce(F.col("label"), F.lit("")) == "", 0.0).when(q == label, exact).otherwise(F.round(F.least(final, F.lit(99.0)), 1))
    return scored.withColumn("score", score).drop("_q", "_qw", "_lw", "_pw", "_dw", "_sw", "_l", "_p", "_s", "_d")


def search_terms(c: Column, expansions: dict[str, list[str]] | None = None) -> Column:
    """The phrase, its shorter runs with content words, its words by length, expansions; each once."""
    words = F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")
    n = F.size(words)
    sizes = F.when(n > 2, F.reverse(F.sequence(F.lit(2), n - 1))).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    runs = F.filter(runs, lambda r: F.size(content_words(r)) > 0)
    single = F.array_sort(F.transform(F.filter(content_words(c), lambda w: F.length(w) >= 3), lambda w: F.struct((-F.length(w)).alias("k"), w.alias("w"))))
    more = F.array().cast("array<string>")
    for word, extra in (expansions or {}).items():
        more = F.when(F.array_contains(words, word), F.concat(more, F.array(*[F.lit(f"{word} {e}") for e in extra]))).otherwise(more)
    return F.array_distinct(F.concat(F.array(F.lower(F.trim(c))), runs, F.transform(single, lambda s: s["w"]), more))


def _grams(c: Column, sizes: tuple[int, ...]) -> Column:
    """All runs of so many characters."""

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))

    return F.array_distinct(F.concat(*[runs(n) for n in sizes]))


def candidates(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """(term, iri) pairs that can score: all of them, by an equi-join, so that the ontology is not scanned for each term.

    Words have credit only if they are equal or begin with the same three letters (w); a label, preferred label or
    definition that holds the whole term holds its first three characters (g); a label that the term holds begins with
    three characters of it (l). ``concepts``: iri, label, pref_label, definition, synonyms.
    """
    key = lambda kind, c: F.transform(c, lambda v: F.concat(F.lit(kind), v))
    stem = lambda c: F.transform(content_words(c), lambda w: F.substring(w, 1, 3))
    none = F.array().cast("array<string>")
    q, label = F.lower(F.trim("term")), F.lower(F.coalesce("label", F.lit("")))
    asked = F.concat(key("w", stem(q)), key("g", F.array(F.substring(q, 1, 3))), key("l", _grams(q, (3,))))
    held = [F.lower(F.coalesce(c, F.lit(""))) for c in ("label", "pref_label", "definition")]
    words = F.concat_ws(" ", *held, F.array_join(F.coalesce("synonyms", none), " "))
    known = F.concat(key("w", stem(words)), *[key("g", _grams(c, (1, 2, 3))) for c in held], key("l", F.array(F.substring(label, 1, 3))))
    left, n = kept(terms.select("term").distinct().select("term", F.explode(F.array_distinct(asked)).alias("key")), fresh_dir(terms.sparkSession, "terms"))
    return concepts.select("iri", F.explode(F.array_distinct(known)).alias("key")).join(sized(left, n), "key").select("term", "iri").distinct()


def with_synonyms(concepts: DataFrame, labels: DataFrame) -> DataFrame:
    syn = labels.groupBy("iri").agg(F.sort_array(F.collect_set("label")).alias("synonyms"))
    return concepts.where("NOT deprecated").join(syn, "iri", "left").select("iri", "label", "pref_label", "definition", "synonyms", "branch")


def wordings(concepts: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(iri, wording) and (wording, label, pref_label, definition, synonyms), both written: concepts that read the same have one wording, so that it is scored once.

    A wording is a digest of all that is said of a concept; one that stands in several rows has several texts.
    """
    said = ["label", "pref_label", "definition", "synonyms"]
    spark, base = concepts.sparkSession, fresh_dir(concepts.sparkSession, "wordings")
    texts = with_synonyms(concepts, labels).where("iri IS NOT NULL").groupBy("iri").agg(F.sort_array(F.collect_set(F.struct(*said))).alias("texts"))
    texts.select("iri", F.sha2(F.to_json("texts"), 256).alias("wording"), "texts").write.parquet(base)
    every = spark.read.parquet(base)
    once = every.groupBy("wording").agg(F.first("texts").alias("texts")).select("wording", F.explode("texts").alias("t")).select("wording", *[f"t.{c}" for c in said])
    return every.select("iri", "wording"), kept(once, f"{base}-texts")[0]


def wording_scores(queries: DataFrame, texts: DataFrame, threshold: float = 30.0, expansions: dict[str, list[str]] | None = None) -> DataFrame:
    """(query, wording, score), written, from ``threshold`` on; a query also scores by its expansions (a word of it and what is said of it), and the best counts."""
    known = texts.withColumnRenamed("wording", "iri")
    more = F.array().cast("array<string>")
    for word, extra in (expansions or {}).items():
        more = F.when(F.array_contains(content_words(F.col("query")), word), F.concat(more, F.array(*[F.lit(f"{word} {e}") for e in extra]))).otherwise(more)
    terms = queries.select("query").distinct().select("query", F.explode(F.array_distinct(F.concat(F.array("query"), more))).alias("term"))
    met = candidates(terms, known).join(known, "iri").withColumnRenamed("term", "query")
    scored = relevance(met).where(F.col("score") >= threshold).select(F.col("query").alias("term"), F.col("iri").alias("wording"), "score")
    return kept(terms.join(scored, "term").groupBy("query", "wording").agg(F.max("score").alias("score")), fresh_dir(queries.sparkSession, "scores"))[0]


def scores(queries: DataFrame, concepts: DataFrame, labels: DataFrame, threshold: float = 30.0, expansions: dict[str, list[str]] | None = None) -> DataFrame:
    """(query, iri, score) from ``threshold`` on, as ``wording_scores`` has them for what is said of the concept."""
    members, texts = wordings(concepts, labels)
    return members.join(wording_scores(queries, texts, threshold, expansions), "wording").select("query", "iri", "score")


def above(found: DataFrame, members: DataFrame, edges: DataFrame, threshold: float = 30.0, least: float = 50.0, depth: int = 3, keep: float = 0.85) -> DataFrame:
    """(query, iri, score): first-parent ancestors of good hits (query, wording, score) that are no hits themselves, for ``keep`` of the score a level.

    Of all hits below an ancestor the best counts, so that each level carries one score for it and not its hits.
    """
    base, first = fresh_dir(found.sparkSession, "above"), edges.where("ord = 0").select(F.col("child").alias("iri"), "parent")
    ways = members.join(first.hint("merge"), "iri").select("wording", "parent").distinct()
    at, n = kept(found.where(F.col("score") >= least).join(ways, "wording").groupBy("query", F.col("parent").alias("iri")).agg(F.max("score").alias("s")), f"{base}/1")
    levels = [at.select("query", "iri", (F.col("s") * keep).alias("score"))]
    for d in range(2, depth + 1):
        at, n = kept(first.join(sized(at, n), "iri").groupBy("query", F.col("parent").alias("iri")).agg(F.max("s").alias("s")), f"{base}/{d}")
        levels.append(at.select("query", "iri", (F.col("s") * keep**d).alias("score")))
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    ups, n = kept(every.where(F.col("score") >= threshold).groupBy("query", "iri").agg(F.round(F.max("score"), 1).alias("score")), f"{base}/best")
    own = members.join(sized(ups.select("query", "iri"), n), "iri").join(found.select("query", "wording"), ["query", "wording"], "left_semi").select("query", "iri")
    return ups.join(own, ["query", "iri"], "left_anti")


def search(queries: DataFrame, concepts: DataFrame, labels: DataFrame, edges: DataFrame | None = None, threshold: float = 30.0, top: int = 5, expansions: dict[str, list[str]] | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(query, iri, score, rank): best ``top`` concepts of each query; concepts of excluded branches are left out.

    Concepts of one wording score alike, so only the first ``top`` of them by name can be among the best.
    """
    members, texts = wordings(concepts, labels)
    found = wording_scores(queries, texts, threshold, expansions)
    barred = concepts.where(F.col("deprecated") | F.coalesce(F.col("branch").isin(*excluded), F.lit(False)) if excluded else F.col("deprecated")).select("iri")
    each = Window.partitionBy("wording").orderBy("iri")
    firsts = members.join(barred.hint("merge"), "iri", "left_anti").withColumn("_k", F.row_number().over(each)).where(F.col("_k") <= top).drop("_k")
    rows = found.join(firsts, "wording").select("query", "iri", "score")
    if edges is not None:
        rows = rows.unionByName(above(found, members, edges, threshold).join(barred.hint("merge"), "iri", "left_anti").select("query", "iri", "score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "iri")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def ranked_by_branch(asked: DataFrame, hits: DataFrame, concepts: DataFrame, most: int = 5) -> DataFrame:
    """(text, branch, iri, score, rank) of (text, branch): hits whose branch has the hinted one in its name come first, then by score."""
    named = hits.select(F.col("query").alias("text"), "iri", "score").join(concepts.select("iri", F.coalesce("branch", F.lit("")).alias("own")), "iri")
    hint = F.lower(F.coalesce("branch", F.lit("")))
    away = F.when((hint != "") & ~F.lower("own").contains(hint), 1).otherwise(0)
    w = Window.partitionBy("text", "branch").orderBy(away, F.desc("score"), "iri")
    return asked.distinct().join(named, "text").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("text", "branch", "iri", "score", "rank")


def resolve(mentions: DataFrame, hits: DataFrame, concepts: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """``mentions`` (ord, text, branch, confidence, iri) with ``resolved`` (iri or null) and ``final`` (its confidence).

    Each (lower text, lower branch) is resolved once, by its first mention: to that mention's own concept if it is known, with its
    confidence; else to the best hit (of lower text), with .6 of the score and .4 of its confidence. Later mentions get the same.
    """
    keyed = mentions.withColumns({"_t": F.lower("text"), "_b": F.lower(F.coalesce("branch", F.lit("")))})
    first = keyed.groupBy("_t", "_b").agg(F.min_by(F.struct("iri", "confidence"), "ord").alias("m")).select("_t", "_b", "m.iri", "m.confidence")
    live = concepts.select(F.col("iri").alias("_known"), F.coalesce("branch", F.lit("")).alias("_own"))
    best = ranked_by_branch(first.select(F.col("_t").alias("text"), F.col("_b").alias("branch")), hits, concepts, 1)
    best = best.select(F.col("text").alias("_t"), F.col("branch").alias("_b"), F.col("iri").alias("_hit"), (F.col("score") / 100).alias("_score"))
    out = first.join(live.select(F.col("_known").alias("iri"), F.lit(True).alias("_direct")), "iri", "left").join(best, ["_t", "_b"], "left")
    chosen = F.when(F.col("_direct"), F.col("iri")).otherwise(F.col("_hit"))
    blended = F.when(F.col("_direct"), F.col("confidence")).when((F.col("_score") > 0) & (F.col("confidence") > 0), 0.6 * F.col("_score") + 0.4 * F.col("confidence")).otherwise(F.col("_score"))
    out = out.select("_t", "_b", chosen.alias("resolved"), F.round(blended, 4).alias("final")).join(live, F.col("resolved") == F.col("_known"), "left")
    barred = F.col("_own").isin(*excluded) if excluded else F.lit(False)
    out = out.where(F.col("resolved").isNotNull() & ~F.coalesce(barred, F.lit(False))).select("_t", "_b", "resolved", "final")
    return keyed.join(out, ["_t", "_b"], "left").drop("_t", "_b")


def resolution(reconciled: DataFrame, ruler: DataFrame, llm: DataFrame, hits: DataFrame, concepts: DataFrame, excluded: tuple[str, ...] = (), virtual: dict[str, str] | None = None, most: int = 5) -> DataFrame:
    """(doc_id, text, iri, confidence, branch, source, backups) of three mention tables (doc_id, ord, text, branch, confidence, iri).

    A document's reconciled mentions are taken, or if it has none, the ruler's and those of the model's whose text is new.
    Branches that stand for others are replaced; up to ``most`` - 1 further hits that are not the concept itself are backups.
    """
    own = lambda df, name: df.withColumn("source", F.lit(name))
    rest = own(ruler, "entity_ruler").join(reconciled.select("doc_id").distinct(), "doc_id", "left_anti")
    seen = rest.select("doc_id", F.lower("text").alias("_t")).distinct()
    new = own(llm, "llm").join(reconciled.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("_t", F.lower("text"))
    new = new.join(seen, ["doc_id", "_t"], "left_anti")
    new = new.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "_t").orderBy("ord"))).where("_k = 1").drop("_k", "_t")
    every = own(reconciled, "reconciled").unionByName(rest).unionByName(new)
    done = resolve(every.withColumn("ord", F.struct("doc_id", "ord")), hits, concepts, excluded).where("resolved IS NOT NULL")
    shown = F.coalesce(F.col("_branch"), F.col("branch"))
    named = done.join(concepts.select(F.col("iri").alias("resolved"), F.col("branch").alias("_branch")), "resolved", "left").withColumn("shown", shown)
    for name, target in (virtual or {}).items():
        named = named.withColumn("shown", F.when(F.col("shown") == name, target).otherwise(F.col("shown")))
    more = ranked_by_branch(done.select(F.lower("text").alias("text"), F.lower(F.coalesce("branch", F.lit(""))).alias("branch")), hits, concepts, most)
    barred = concepts.where(F.col("branch").isin(*excluded)).select("iri") if excluded else concepts.where("false").select("iri")
    more = more.join(barred, "iri", "left_anti").groupBy("text", "branch").agg(F.sort_array(F.collect_list(F.struct("rank", "iri"))).alias("others"))
    key = [F.lower("text").alias("_t"), F.lower(F.coalesce("branch", F.lit(""))).alias("_b")]
    out = named.select("*", *key).join(more.select(F.col("text").alias("_t"), F.col("branch").alias("_b"), "others"), ["_t", "_b"], "left")
    backups = F.filter(F.transform(F.coalesce("others", F.array().cast("array<struct<rank: int, iri: string>>")), lambda o: o["iri"]), lambda i: i != F.col("resolved"))
    return out.select("doc_id", "text", F.col("resolved").alias("iri"), F.col("final").alias("confidence"), F.col("shown").alias("branch"), "source", F.array_join(backups, ",").alias("backups"))
