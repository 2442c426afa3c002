"""A small ontology of our own, as rows that Spark and SQL both see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (iri, label, preferred label, definition, branch, deprecated, ord)
CONCEPTS = [
    ("lex:root", "thing", None, None, None, False, 0),
    ("lex:rule", "rule", "Rule", "A rule that binds people.", "Rules", False, 1),
    ("lex:and", "and", "And", "A word that joins.", "Rules", False, 2),
    ("lex:that", "that", None, "A word that points at a thing.", "Rules", False, 3),
    ("lex:of_the", "of the", "Of The", "Two words of the text.", "Rules", False, 4),
    ("lex:place", "place", "Place", "Where a rule applies.", "Places", False, 5),
    ("lex:de_la", "de la", None, "Where the thing is from.", "Places", False, 6),
    ("lex:und", "und", "Und", "Joins places and words.", "Places", False, 7),
    ("lex:in_the", "in the", None, "Inside of the place.", "Places", False, 8),
    ("lex:actor", "actor", "Actor", "One who acts under a rule.", "Actors", False, 9),
    ("lex:he", "he", None, "One of the actors.", "Actors", False, 10),
    ("lex:que", "que", None, "Which actor it is.", "Actors", False, 11),
    ("lex:the", "the", "The", "The most frequent word.", "Actors", False, 12),
    ("lex:old", "tion", None, "A withdrawn entry.", "Actors", True, 13),
    ("lex:act", "act", "Act", "What an actor does in a place.", "Acts", False, 14),
    ("lex:is", "is", None, "The act of being.", "Acts", False, 15),
    ("lex:is_the", "is the", None, "Being the thing.", "Acts", False, 16),
    ("lex:are", "are", None, "The act of being many.", "Acts", False, 17),
]
#: (iri, label, type): type is alternative, hidden or translation
LABELS = [
    ("lex:and", "et", "translation"), ("lex:and", "with", "alternative"), ("lex:that", "this", "alternative"), ("lex:of_the", "of", "hidden"),
    ("lex:und", "die", "alternative"), ("lex:de_la", "la", "alternative"), ("lex:place", "la", "hidden"), ("lex:he", "are", "alternative"),
    ("lex:the", "le", "translation"), ("lex:the", "der", "translation"), ("lex:que", "los", "alternative"), ("lex:is", "est", "translation"),
    ("lex:in_the", "in", "alternative"), ("lex:act", "and", "hidden"), ("lex:old", "ing", "alternative"), ("lex:rule", "of the", "alternative"),
]
#: (child, parent, ord)
EDGES = [
    ("lex:rule", "lex:root", 0), ("lex:place", "lex:root", 0), ("lex:actor", "lex:root", 0), ("lex:act", "lex:root", 0),
    ("lex:and", "lex:rule", 0), ("lex:that", "lex:rule", 0), ("lex:of_the", "lex:that", 0), ("lex:of_the", "lex:and", 1), ("lex:de_la", "lex:place", 0),
    ("lex:und", "lex:place", 0), ("lex:in_the", "lex:und", 0), ("lex:in_the", "lex:of_the", 1), ("lex:he", "lex:actor", 0), ("lex:que", "lex:actor", 0),
    ("lex:the", "lex:he", 0), ("lex:is", "lex:act", 0), ("lex:is_the", "lex:is", 0), ("lex:is_the", "lex:the", 1), ("lex:are", "lex:act", 0), ("lex:old", "lex:act", 0),
]
#: (src, dst, ord)
SEE_ALSO = [("lex:and", "lex:und", 0), ("lex:the", "lex:that", 0), ("lex:is", "lex:are", 0), ("lex:he", "lex:que", 0)]
#: (iri, label, alternative label, domain, range, inverse)
PROPERTIES = [
    ("lex:p1", "lex:hasPlace", "is in", "lex:actor", "lex:place", "lex:p2"), ("lex:p2", "lex:placeOf", None, "lex:place", "lex:actor", "lex:p1"),
    ("lex:p3", "DEPRECATED joins", "joins", "lex:rule", "lex:rule", None), ("lex:p4", "lex:actsUnder", "with", "lex:actor", "lex:rule", None),
]

TABLES = {
    "concepts": ("iri string, label string, pref_label string, definition string, branch string, deprecated boolean, ord int", CONCEPTS),
    "labels_in": ("iri string, label string, label_type string", LABELS),
    "edges": ("child string, parent string, ord int", EDGES),
    "see_also": ("src string, dst string, ord int", SEE_ALSO),
    "properties_in": ("iri string, label string, alt_label string, domain_iri string, range_iri string, inverse_of string", PROPERTIES),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def sql_rows(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def sql_table(name: str, schema: str | None = None, rows: list[tuple] | None = None) -> str:
    """``name AS (VALUES ...)`` as a common table expression, with the types of the Spark schema."""
    if schema is None:
        schema, rows = TABLES[name]
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    cols = [c.strip().split() for c in schema.split(",")]
    casts = ", ".join(f"CAST({c} AS {kinds[k]}) AS {c}" for c, k in cols)
    return f"{name} AS (SELECT {casts} FROM (VALUES {sql_rows(rows)}) AS t({', '.join(c for c, _ in cols)}))"
