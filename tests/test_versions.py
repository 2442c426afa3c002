"""The commit log, two writers of the ontology and of the annotations, merges of changes."""

import pytest

from lexweave.sources import annotation_table as A
from lexweave.sources import commit_log, ontology_store


def test_an_entry_is_made_once(spark, tmp_path):
    base = str(tmp_path / "x")
    assert commit_log.entries(spark, base) == [] and commit_log.last(spark, base) is None
    commit_log.append(spark, base, 0, {"a": 1})
    with pytest.raises(commit_log.Conflict):
        commit_log.append(spark, base, 0, {"a": 2})
    commit_log.append(spark, base, 1, {"a": 3})
    (tmp_path / "x" / "log" / f"{2:020d}.json").write_text('{"a"')  # a writer that has not come to its end
    assert commit_log.entries(spark, base) == [(0, {"a": 1}), (1, {"a": 3})] and commit_log.last(spark, base) == (1, {"a": 3})
    assert commit_log.entries(spark, base, 0) == [(1, {"a": 3})]


def test_two_publishers(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "store")
    tables = [{"concepts": spark.createDataFrame([(f"x{k}", "a")], "iri string, label string")} for k in range(3)]
    first = ontology_store.publish(spark, base, tables[0])
    real, other = commit_log.append, []

    def late(spark_, base_, number, entry):
        if not other:  # another publisher comes first, once
            other.append(1)
            monkeypatch.setattr(commit_log, "append", real)
            other.append(ontology_store.publish(spark, base, tables[2]))
            monkeypatch.setattr(commit_log, "append", late)
        real(spark_, base_, number, entry)

    monkeypatch.setattr(commit_log, "append", late)
    mine = ontology_store.publish(spark, base, tables[1])
    assert [v for _, v, _ in ontology_store.log(spark, base)] == [first, other[1], mine] and ontology_store.current(spark, base) == mine
    assert ontology_store.rollback(spark, base) == other[1]
    assert [n for n, _, _ in ontology_store.log(spark, base)] == [0, 1, 2, 3]


ACTIONS = "seq bigint, ann_id string, action string, k int"


def table(spark, base, n=40):
    A.create(spark, base, spark.createDataFrame([(f"a{k}", ["p", "q", "r"][: k % 4], "confirmed", None) for k in range(n)] + [("a1", ["p"], "confirmed", None)], A.ROWS))


def state(spark, base, version=None):
    return {r.ann_id: (r.concepts, r.state, r.dismissed_seq) for r in A.read(spark, base, version).collect()}


def test_changes_and_outcomes(spark, tmp_path):
    base = str(tmp_path / "t")
    table(spark, base)
    todo = [
        (1, "a3", "promote", 2), (2, "a3", "promote", 0), (3, "a3", "promote", 3), (4, "a3", "promote", -1), (5, "a3", "promote", None), (6, "a3", "reject", None), (7, "a3", "reject", None), (8, "a3", "restore", None),
        (9, "a3", "restore", None), (10, "a3", "promote", 1), (11, "gone", "reject", None), (12, "a0", "promote", 0), (13, "a2", "reject", None), (14, "a2", "burn", None), (15, None, "reject", None),
    ]
    before = state(spark, base)
    assert A.change(spark, base, lambda rows: spark.createDataFrame(todo[::-1], ACTIONS)) == 1
    got = state(spark, base)
    assert got["a3"] == (["q", "p", "r"][:0] or ["q", "r", "p"], "confirmed", None) and got["a2"] == (["p", "q"], "rejected", 13)
    assert {k: v for k, v in got.items() if k not in ("a3", "a2")} == {k: v for k, v in before.items() if k not in ("a3", "a2")} and len(got) == 40
    assert state(spark, base, 0) == before
    said = [r.outcome for r in A.outcomes(spark, base).orderBy("seq").collect()]
    assert said == ["promoted", "already_primary", "bad_index", "bad_index", "bad_index", "rejected", "already_rejected", "restored", "not_rejected", "promoted", "not_found", "bad_index", "rejected", "unknown_action", "not_found"]
    entry = commit_log.last(spark, base)[1]
    old = commit_log.entries(spark, base)[0][1]["buckets"]
    assert all(entry["buckets"][b] == w for b, w in old.items() if int(b) not in entry["touched"])  # other buckets have not been written
    assert A.change(spark, base, lambda rows: spark.createDataFrame([], ACTIONS)) == 1


@pytest.mark.parametrize("same", [True, False])
def test_two_writers(spark, tmp_path, monkeypatch, same):
    base = str(tmp_path / "t")
    table(spark, base)
    bucket = {r.ann_id: r.b for r in A.read(spark, base).select("ann_id", A.bucket_of().alias("b")).collect()}
    mine = "a3"
    theirs = "a3" if same else next(a for a in bucket if bucket[a] != bucket[mine])
    real, calls = commit_log.append, []

    def late(spark_, base_, number, entry):
        if "other" not in calls:
            calls.append("other")
            A.change(spark, base, lambda rows: spark.createDataFrame([(1, theirs, "reject", None)], ACTIONS))
        real(spark_, base_, number, entry)

    def make(rows):
        calls.append("make")
        return spark.createDataFrame([(2, mine, "reject", None)], ACTIONS)

    monkeypatch.setattr(commit_log, "append", late)
    assert A.change(spark, base, make) == 2
    assert calls.count("make") == (2 if same else 1)  # only a bucket that both touch makes a writer begin again
    got = state(spark, base)
    assert got[mine][1] == got[theirs][1] == "rejected"
    said = {(r.seq, r.outcome) for r in A.outcomes(spark, base).collect()}
    assert said == ({(1, "rejected"), (2, "already_rejected")} if same else {(1, "rejected"), (2, "rejected")})


def test_changes_by_concept(spark, tmp_path):
    base = str(tmp_path / "t")
    table(spark, base, 8)
    A.change(spark, base, A.promote_everywhere("p", "r", 1, ["a3"]))
    assert state(spark, base)["a3"][0] == ["r", "q", "p"] and state(spark, base)["a7"][0] == ["p", "q", "r"]
    A.change(spark, base, A.reject_everywhere("p", 2))
    assert sorted(k for k, v in state(spark, base).items() if v[1] == "rejected") == ["a1", "a2", "a5", "a6", "a7"]
    assert A.change(spark, base, A.reject_everywhere("p", 3)) == 2  # nothing left to do: no version


def test_empty_table(spark, tmp_path):
    base = str(tmp_path / "t")
    with pytest.raises(ValueError):
        A.read(spark, base) if commit_log.last(spark, base) else A.read(spark, base, 0)
    A.create(spark, base, spark.createDataFrame([], A.ROWS))
    assert state(spark, base) == {}
    A.change(spark, base, lambda rows: spark.createDataFrame([(1, "x", "reject", None)], ACTIONS))
    assert state(spark, base) == {} and [r.outcome for r in A.outcomes(spark, base).collect()] == ["not_found"]


def test_prefixes_of_any_length(spark):
    from lexweave.operators import ontology

    label = "a long label " * 8
    rows = spark.createDataFrame([(label.strip(), "x"), (label[:64] + "z", "y"), ("a", "z")], "label_key string, iri string")
    asked = spark.createDataFrame([(label[:n],) for n in (1, 63, 64, 66, 80)] + [("A",), (label + "more",), (None,)], "query string")
    got = {}
    for r in ontology.by_prefix(asked, rows).collect():
        got.setdefault(r.query, set()).add(r.iri)
    assert got == {"a": {"x", "y", "z"}, "A": {"x", "y", "z"}, label[:63]: {"x", "y"}, label[:64]: {"x", "y"}, label[:66]: {"x"}, label[:80]: {"x"}}
