"""Tunables of the enrichment operators."""

CHUNK_CHARS, CHUNK_OVERLAP = 3000, 200
RULER_ONLY_MIN = 0.60
BOOST = 0.05
REJECT_BELOW = 0.20
POS_PENALTY = 0.15
LOW_CONFIDENCE = 0.80
RATE_MAX, RATE_WINDOW_S = 200, 60
STALE_MINUTES, RETENTION_DAYS = 30, 30
#: Dictionaries up to so many bytes of labels go to executors as an automaton; larger ones use the anchor join.
AUTOMATON_BYTES = 64_000_000
