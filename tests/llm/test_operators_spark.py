"""The training-data operators on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns, against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import bpe, chat_format, decontaminate, html_text, jaccard_join, line_dedup, quality_classifier, quality_rules, suffix_dedup, token_counts
from lexweave.llm.common import Scratch, components
from tests.duck import connect, rows

DOC = "doc_id bigint, text string"
R = random.Random(11)
WORDS = ["".join(R.choice("abcdeé") for _ in range(R.randint(2, 6))) for _ in range(300)]


def sentence(n: int, r: random.Random = R) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


def fixture() -> list[tuple]:
    """Texts, exact copies, near copies, shared passages, repeated lines, odd rows."""
    r, out = random.Random(5), []
    base = ["\n".join(sentence(r.randint(8, 40), r) for _ in range(r.randint(1, 5))) for _ in range(25)]
    passage = sentence(60, r)
    for k, t in enumerate(base):
        out.append((k, t))
        if k % 5 == 0:
            out.append((100 + k, t))
        if k % 3 == 0:
            w = t.split(" ")
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            out.append((200 + k, " ".join(w)))
        if k % 4 == 0:
            out.append((300 + k, sentence(20, r) + "\n" + passage + "\n" + sentence(20, r)))
    group = sentence(50, r).split(" ")
    for k in range(30):
        w = list(group)
        w[r.randrange(50)] = r.choice(WORDS)
        out.append((400 + k, " ".join(w)))
    return [*out, (900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one two"), (905, "ONE two"), (906, "x" * 3000), (907, "y " * 2000), (908, "😀 " * 30), (909, "😀 " * 30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), DOC).repartition(3).cache()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)] + [(30 + k, 31 + k) for k in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src bigint, dst bigint"), Scratch(spark, "t"), "t").collect()}
    assert got == {**{k: 1 for k in (1, 2, 3, 7, 8, 9)}, 20: 20, 21: 20, **{30 + k: 30 for k in range(41)}}


@pytest.mark.parametrize("words, percent", [(4, 85), (2, 60)])
def test_jaccard_join(spark, docs, words, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs.withColumn("n", F.lit(1)), Scratch(spark, "t"), words, percent).collect()}
    sets = {}
    for i, t in fixture():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_cross_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 3)
    sign = jaccard_join.signature(__import__("numpy").arange(5, dtype="uint64") << __import__("numpy").uint64(20))
    rows_ = [(7, k, 5, 1, k % 2, bytearray(sign)) for k in range(10)]
    got = jaccard_join.cross_pairs(spark.createDataFrame(rows_, "token bigint, node bigint, n bigint, shared bigint, component bigint, sign binary"), 85).collect()
    assert sorted((r.x, r.y) for r in got) == [(a, b) for a in range(10) for b in range(a + 1, 10) if a % 2 != b % 2]


@pytest.mark.parametrize("length, gram, shard", [(200, 64, 1_000_000), (40, 16, 2000), (40, 16, 150)])
def test_suffix_dedup(spark, docs, monkeypatch, length, gram, shard):
    monkeypatch.setattr(suffix_dedup, "RANGE", 500 if shard < 1000 else 2_000_000)
    data = [*fixture(), (0, fixture()[0][1]), (None, fixture()[3][1])]  # a repeated row, a copy without an id
    df = spark.createDataFrame(data, DOC).withColumn("key", F.lit("clash"))
    got = suffix_dedup.remove_repeats(df.select("doc_id", "text"), Scratch(spark, "t"), length, gram, shard)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect())
    assert got == Counter((i, *row) for (i, _), row in zip(data, suffix_dedup.brute_force([(t or "").encode() for _, t in data], length), strict=True))


def test_line_dedup(spark):
    r, data = random.Random(7), []
    pool = [sentence(r.randint(5, 15), r) for _ in range(25)]
    for k in range(30):
        lines = []
        for _ in range(r.randint(1, 6)):
            line = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                at = r.randrange(len(line))
                line[at : at + r.randint(0, 1)] = r.choice(["", "z", "é"])
            lines.append(r.choice(["", "  "]) + "".join(line) + r.choice(["", " "]))
        data.append((k, "\n".join([*lines, "short"])))
    data += [(900, None), (901, ""), (902, "\n\n"), (903, "x" * 25 + "\n"), (904, "😀" * 25 + "\n" + "😀" * 26)]
    df = spark.createDataFrame(data, DOC).withColumn("kept", F.lit("clash")).withColumn("line", F.lit(3))
    got = {x.doc_id: (x.n_lines, x.n_removed, x.kept, x.line) for x in line_dedup.dedup_lines(df, Scratch(spark, "t")).collect()}
    seen: list[str] = []
    classes: dict[str, int] = {}
    texts = [(i, k, v.strip(" \t\n\x0b\x0c\r")) for i, t in data for k, v in enumerate((t or "").split("\n"))]
    texts = [x for x in texts if len(x[2]) >= line_dedup.MIN_CHARS]
    for t in sorted({t for *_, t in texts}):
        near = {classes[s] for s in seen if line_dedup.edit_distance(s, t, 2) <= 2}
        classes[t] = min(near, default=len(classes))
        for s in seen:
            if classes[s] in near:
                classes[s] = classes[t]
        seen.append(t)
    first, gone = set(), defaultdict(set)
    for i, k, t in texts:
        if classes[t] in first:
            gone[i].add(k)
        first.add(classes[t])
    for i, t in data:
        lines = (t or "").split("\n")
        assert got[i] == (len(lines), len(gone[i]), "\n".join(v for k, v in enumerate(lines) if k not in gone[i]), 3)


def test_short_lines(spark, tmp_path):
    data = [(1, " Les.\n\nAnd ornd.\nLes. "), (2, "Les.\nLesx.\n\n"), (3, "And ornd."), (4, "a line of twenty or more characters\nLes."), (5, "a line of twenty or more charakters\n \nw")]
    spark.createDataFrame(data, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    kept = {1: " Les.\n\nAnd ornd.", 2: "Lesx.\n\n", 3: "", 4: "a line of twenty or more characters", 5: " \nw"}
    got = {x.doc_id: (x.n_removed, x.kept_sha256) for x in line_dedup.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {k: (n, hashlib.sha256(kept[k].encode()).hexdigest()) for k, n in ((1, 1), (2, 1), (3, 1), (4, 1), (5, 1))}


def test_line_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    texts = spark.createDataFrame([(k, "common start of a line " + "ab"[k % 2] * 3) for k in range(12)], "line bigint, content string")
    met = texts.select(F.lit(1).cast("bigint").alias("segment"), "line", F.lit(True).alias("indexed"))
    scratch = Scratch(spark, "t")
    got = {r.node: r.component for r in components(line_dedup.near_lines(met, texts, 2, scratch), scratch, "t").collect()}
    assert got == {k: k % 2 for k in range(12)}


def test_decontamination(spark):
    r = random.Random(3)
    items = [(k, sentence(r.randint(15, 50), r)) for k in range(12)]
    data, want = [], set()
    for k in range(60):
        text = sentence(r.randint(60, 400), r).split(" ")
        if k % 4 == 0:
            item, words = items[k // 4 % 12][0], items[k // 4 % 12][1].split(" ")
            if k % 8 == 0:  # in other words, in part
                words = [w if r.random() > 0.12 else r.choice(WORDS) for w in words]
            at = r.randrange(len(text))
            text[at:at] = words
            want.add((k, item))
        data.append((k, " ".join(text).capitalize()))
    data += [(900, None), (901, ""), (902, "one"), (903, items[0][1]), (None, "null id")]
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (None, "no id")], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(spark.createDataFrame(data, DOC), bench, Scratch(spark, "t")).collect()}
    assert len(want & got) >= 0.9 * len(want) and (903, 0) in got and len(got - want - {(903, 0)}) == 0


def test_decontamination_goes_by_its_cosine(spark):
    """No window reaches a cosine of 2, every one reaches -2: the default gate loses few of the pairs that all windows give."""
    r = random.Random(4)
    items = [(k, sentence(n, r)) for k, n in enumerate([6, 9, 18, 18, 40])]
    data = [(k, " ".join([sentence(r.randint(0, 30), r), items[k % 5][1], sentence(r.randint(0, 30), r)]).strip()) for k in range(25)]
    df, bench = spark.createDataFrame(data, DOC), spark.createDataFrame(items, "item_id bigint, text string")
    found = lambda **kw: {(x.doc_id, x.item_id) for x in decontaminate.contaminated(df, bench, Scratch(spark, "t"), **kw).collect()}
    assert found(cosine=2.0) == set()
    every, gated = found(cosine=-2.0), found()
    assert {(k, k % 5) for k in range(25)} <= every and gated <= every and len(gated) >= 0.95 * len(every)


def test_quality_rules_and_sql(spark, data, tmp_path):
    rows_ = [*fixture(), (910, "The same eight words are in this line now. " * 9), (911, "### $$$ %%%\n### $$$ %%%\n" * 9), (900, None)]
    spark.createDataFrame(rows_, DOC).withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    got = quality_rules.op8_quality_rules(spark, str(tmp_path)).toPandas()
    c = connect("/nowhere")
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(got) == rows(c.sql(quality_rules.OP8_SQL).df()) and len(got) == len(rows_)
    clash = quality_rules.apply_rules(spark.createDataFrame([(1, "a", 5, True)], "doc_id bigint, text string, n_words int, kept boolean")).first()
    assert clash.n_words == 1 and clash.kept is False


def test_quality_classifier(spark, data):
    d, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    out = quality_classifier.op4_quality_classifier(spark, data)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "boolean", "double", "int"] and out.count() == d.count()
    marked = out.join(labels, "doc_id").toPandas()
    assert (marked.predicted == marked.quality).mean() > 0.9 and marked.score.between(0, 1).all()
    model = quality_classifier.fit(d, labels.limit(0))
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (None, "x", 0.2)], "doc_id bigint, text string, score double")
    assert [r.score for r in quality_classifier.with_scores(odd, model).collect()] == [0.5, 0.5, 0.5]
    assert quality_classifier.quality_stage(spark, d, data).columns == d.columns


def test_chat_format(spark):
    r = random.Random(1)
    data = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice([None, "", "a <|im_end|>\n", "é😀 <\\|", sentence(5, r)])) for c in range(12) for t in range(r.randint(1, 6))]
    data += [(None, 0, "user", "x"), (50, None, "assistant", "y"), (50, 1, "assistant", "y"), (50, 1, "assistant", "y")]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").withColumn("rendered", F.lit(1))
    got = {x.conv_id: tuple(x)[1:] for x in chat_format.conversation_digests(chat_format.render_messages(chat_format.as_events(df))).collect()}
    by = defaultdict(list)
    for c, t, role, text in data:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        learnt = "".join(x[3] for x in turns if x[2] == "assistant")
        want = hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert got[c][:4] == (len(turns), want, len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    whole = {x.conv_id: x for x in chat_format.format_conversations(chat_format.as_events(df)).collect()}
    for c in by:
        assert len(whole[c].formatted) == got[c][4]
        assert chat_format.unescape("".join(whole[c].formatted[s.start : s.end] for s in whole[c].loss_spans)) == "".join(x[3] for x in sorted(by[c]) if x[2] == "assistant")
    assert chat_format.conversation_digests(chat_format.render_messages(chat_format.as_events(df.limit(0)))).count() == 0


def test_html_templates(spark):
    """Brute force over plain strings: boxes on enough distinct pages of a host go, in articles and outside, others stay."""
    r = random.Random(6)
    boxes = [f"Box {k} since 19{k:02d}" for k in range(8)]
    data, parts = [], {}
    for k in range(60):
        host = r.choice("aab")
        own = [f"Story {k} " + sentence(12, r) for _ in range(3)]
        shown = [x for x in boxes if r.random() < 0.5]
        parts[k] = (host, own, shown)
        body = "".join(f"<p>{x}</p>" for x in own[:2]) + "".join(f"<div><span>{x}</span></div>" for x in shown) + f"<div>{own[2]}</div>"
        data.append((k, f"http://{host}.example/{k}", f"<html><body>{f'<article>{body}</article>' if k % 2 else body}</body></html>"))
    copies = [(200 + k, "http://c.example/x", data[0][2]) for k in range(12)]  # one page often is one page
    odd = [(99, "http://d.example/", data[1][2]), (100, None, None), (101, "", ""), (102, "http://a.example/", "<p>" + "long " * 40_000 + "</p>")]
    df = spark.createDataFrame([*data, *copies, *odd, odd[0]], "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    got = defaultdict(list)
    for x in html_text.extract(df, Scratch(spark, "t")).collect():
        got[x.page_id].append(x.text)
    n_pages = Counter(h for h, _, _ in parts.values())
    n_pages["a"] += 1
    for k, (host, own, shown) in parts.items():
        gone = {x for x in boxes if (n := sum(h == host and x in s for h, _, s in parts.values())) >= max(html_text.LEAST, html_text.ROOT * n_pages[host] ** 0.5)}
        assert gone and got[k] == ["\n".join([*own[:2], *(x for x in shown if x not in gone), own[2]])]
    whole = lambda k: "\n".join([*parts[k][1][:2], *parts[k][2], parts[k][1][2]])
    assert all(got[200 + k] == [whole(0)] for k in range(12)) and got[99] == [whole(1)] * 2
    assert got[100] == got[101] == [""] and got[102] == [("long " * 40_000).strip()]


def test_html_marked_and_plain_boxes(spark):
    """A marked box that three pages of a large host share is template; a plain one needs more; marked ones that are new go besides."""
    n = 40
    menu = lambda k: f'<nav><ul><li><a href="/{k}">Menu {k % 13}</a></li></ul></nav>'  # noqa: E731  each of 13 on three or four pages
    rare, plain, often = '<div class="advert"><p>Buy it</p></div>', "<div><p>Seen thrice</p></div>", "<div><p>Seen often</p></div>"
    pages = {}
    for k in range(n):
        body = f"<p>Story {k} of this very page, which goes on for a while.</p>" + (plain if k < 3 else "") + (often if k % 2 else "")
        pages[k] = f'<html><body>{menu(k)}{rare if k == 7 else ""}<div>{body}</div><footer>Page {k}</footer></body></html>'
    df = spark.createDataFrame([(k, "http://h.example/", h) for k, h in pages.items()], "page_id bigint, url string, html string")
    got = {x.page_id: x for x in html_text.extract(df, Scratch(spark, "t")).collect()}
    for k in range(n):
        want = [f"Story {k} of this very page, which goes on for a while.", *(["Seen thrice"] if k < 3 else [])]
        assert got[k].text == "\n".join(want)
        assert got[k].n_template == len(f"Menu {k % 13}") + (len("Seen often") if k % 2 else 0)
    found = {x for r in html_text.templates(df).collect() for x in r.template}
    boxes = {t for k in range(n) for t, marked in html_text.Page(pages[k]).boxes().items() if marked}
    assert found & boxes and len(found - boxes) == 2  # the menus, and the plain box with its paragraph


def test_token_count_cache(spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library, cache = Tokenizer.from_file(P.path(token_counts.TOKENIZER)), str(tmp_path / "cache")
    data = [*fixture(), (950, "Two  words\n"), (951, "Two words"), (951, "Two words"), (952, "<|endoftext|> x")]
    df = spark.createDataFrame(data, DOC).withColumn("digest", F.lit("clash"))
    for _ in range(2):
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.digest) for r in token_counts.count_tokens(df, P.path(token_counts.TOKENIZER), cache).collect())
        want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048, "clash") for i, t in data)
        assert got == want
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count()  # nothing is encoded twice


def test_bpe(spark):
    import public_tokenizers as P
    import tiktoken

    data = [*fixture(), (900, None)]
    df = spark.createDataFrame(data, DOC).withColumn("ids", F.lit("clash"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.RANKS)), special_tokens={})
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in bpe.encode(df, P.path(bpe.RANKS), P.PATTERN).collect())
    assert got == Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in data)
    one = {r.doc_id: r for r in bpe.encode_digests(df, P.path(bpe.RANKS), P.PATTERN).collect()}
    assert one[903].n_tokens == 1 and one[901].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_tables(spark, tmp_path):
    import public_tokenizers as P

    none = spark.createDataFrame([], DOC)
    assert jaccard_join.near_duplicates(none, Scratch(spark, "t")).count() == 0
    assert suffix_dedup.remove_repeats(none, Scratch(spark, "t")).count() == 0
    assert line_dedup.dedup_lines(none, Scratch(spark, "t")).count() == 0
    assert bpe.encode_digests(none, P.path(bpe.RANKS), P.PATTERN).count() == 0
    assert token_counts.count_tokens(none, P.path(token_counts.TOKENIZER), str(tmp_path / "c")).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string"), Scratch(spark, "t")).count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([], "item_id bigint, text string"), Scratch(spark, "t")).count() == 0


def test_compiled_score_is_the_model(spark, data):
    """The native expression gives the ensemble's own prediction, also for empty and long texts; repeated rows change no fit."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{data}/labels.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 200_000), (-4, "the cat " * 30_000), (-4, "the cat " * 30_000), (None, "a b")], DOC)
    model = quality_classifier.fit(docs, labels)
    assert model.rules and quality_classifier.fit(docs.unionByName(docs), labels.unionByName(labels)) == model
    every = docs.unionByName(odd)
    stats = quality_classifier.with_statistics(every).select("doc_id", *[v.alias(k) for k, v in quality_classifier.features().items()])
    rows_ = stats.collect()
    scores = model.predict(__import__("numpy").array([tuple(r)[1:] for r in rows_], float))
    want = sorted((r[0] is None, r[0] or 0, round(float(p), 9)) for r, p in zip(rows_, scores, strict=True))
    got = sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 9)) for r in quality_classifier.with_scores(every, model).collect())
    assert got == want
    none = quality_classifier.fit(docs.limit(0), labels)
    assert [r.score for r in quality_classifier.with_scores(odd, none).collect()] == [0.5] * 6 and quality_classifier.with_scores(docs.limit(0), model).count() == 0


def test_decontamination_against_all_pairs(spark):
    """Every window of every document against every item, in plain Python, as the module states it; odd rows and clashing columns besides."""
    import numpy as np

    r = random.Random(14)
    items = [(k, sentence(r.choice([8, 15, 30, 60]), r)) for k in range(10)]
    data = []
    for k in range(40):
        words = sentence(r.randint(0, 200), r).split()
        if k % 2:
            own = [w if r.random() > r.choice([0, 0.1, 0.4]) else r.choice(WORDS) for w in items[k % 10][1].split()]
            at = r.randint(0, len(words))
            words[at:at] = own
        data.append((k, " ".join(words)))
    data += [(3, data[3][1]), (None, items[0][1]), (900, None), (901, ""), (902, "w " * 60_000 + items[1][1])]
    df = spark.createDataFrame(data, DOC).withColumn("item_id", F.lit(1)).withColumn("cosine", F.lit("clash"))
    got = Counter((x.doc_id, x.item_id) for x in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id bigint, text string"), Scratch(spark, "t")).collect())
    step, share, most = decontaminate.STEP, decontaminate.COMMON, decontaminate.ANSWER
    column = __import__("pyarrow").array([t for _, t in data], "string")
    idf = decontaminate.idf_of(*decontaminate.passage_counts(df))
    want = Counter()
    for row, (i, _) in enumerate(data):
        h, _ = decontaminate.terms_of(column.slice(row, 1))
        for item, text in items:
            asked, _ = decontaminate.terms_of(__import__("pyarrow").array([text]))
            distinct = np.unique(asked)
            rare = distinct[np.argsort(-idf[decontaminate.slot(distinct)], kind="stable")[: decontaminate.RARE]]
            size = step * (-(-len(asked) // step) + 1)
            ends = [at for at in range(0, len(h), step) if at == 0 or at + size - step < len(h)]
            if any(np.isin(rare, w := h[at : at + size]).sum() >= most * len(rare) and decontaminate.common_words(asked, w) >= share * len(asked) for at in ends):
                want[i, item] += 1
    assert got == want and sum(want.values()) > 15


def test_bounded_batches(spark):
    from lexweave.llm.common import small_batches

    small_batches(spark, 2000, 1 << 20)

    def sizes(batches):
        for b in batches:
            yield type(b).from_pydict({"n": [b.num_rows]})

    rows_ = spark.range(64).select(F.repeat(F.lit("x"), 200_000).alias("text")).coalesce(1).mapInArrow(sizes, "n bigint").collect()
    small_batches(spark)
    assert sum(r.n for r in rows_) == 64 and max(r.n for r in rows_) <= 8


ODD = [(None, "no id " * 30), (9001, None), (9002, ""), (9003, " \n\t "), (9004, "word"), (9005, "the long text has some words in it " * 6000)]


def test_pipeline(spark, data, tmp_path):
    """``run`` over the documents with nulls, empty and long texts and repeated rows added, and over an empty table."""
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame(ODD, DOC).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text")})
    whole = docs.unionByName(odd.select([F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])).unionByName(docs.limit(3))
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    whole.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns, name
        now = Scratch(spark, "t").save(out, name)
        kept.append(now.count())
    assert whole.count() >= kept[0] >= kept[1] >= kept[2] >= kept[3] > 50
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.RANKS)), special_tokens={})
    want = Counter((r.doc_id, len(library.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in now.collect())
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
    # Each stage is what its operator says of its own input: no line, near copy or benchmark text is left among what stays.
    texts = {(r.doc_id, r.text or "") for r in now.where("doc_id IS NOT NULL").collect()}  # rows that share a doc_id are one document
    lines = Counter(v.strip() for _, text in texts for v in text.split("\n") if v.strip())
    assert max(lines.values()) == 1
    assert not set(now.select("doc_id").join(decontaminate.contaminated(now, spark.read.parquet(f"{data}/benchmark.parquet"), Scratch(spark, "t")), "doc_id").collect())
    whole.where("false").withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "none/documents.parquet"))
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(str(tmp_path / f"none/{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_decontamination_is_fitted_on_all_passages(spark):
    # More distinct passages than the 20,000 that an earlier form took; copies, in other orders too, are one.
    texts = [f"a{i} b{i % 7} c" for i in range(21_000)] + [f"c a{i} b{i % 7}" for i in range(500)] + [None, ""]
    every = decontaminate.passages_of(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOC))
    rows = decontaminate.fit_rows(every)
    assert rows.count() == 21_000
    df, passages = decontaminate.counts_of(every)
    assert passages == 21_500 and df.sum() <= 3 * 21_500 and df.max() >= 21_500


def test_latent_basis_holds_its_block_once_on_the_driver(spark):
    # F1: collected rows and a QR of the whole block in double precision came to several times the block.
    every = decontaminate.passages_of(spark.createDataFrame([(i, sentence(60)) for i in range(400)], DOC))
    idf = decontaminate.idf_of(*decontaminate.counts_of(every))
    tracemalloc.start()
    basis = decontaminate.latent_basis(decontaminate.fit_rows(every), idf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(basis.T @ basis - np.eye(basis.shape[1])).max() < 1e-5
    assert peak < 5 * 4 * decontaminate.TERMS * (decontaminate.RANK + decontaminate.SPARE)
