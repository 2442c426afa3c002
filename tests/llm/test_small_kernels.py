"""Kernels of the training-data operators against plain Python; no Spark."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from lexweave.llm import bpe, chat_format, decontaminate, html_text, jaccard_join, line_dedup, quality_classifier, suffix_dedup, token_counts
from lexweave.llm import chunks as bpe_chunks
from lexweave.llm.common import arrow_bytes, byte_slices, span_hashes, word_hashes, word_spans

TEXTS = [
    "", "a b c", "  lead", "trail  ", "x\n\n y\n", "I'm don't <|endoftext|> ok", "A" * 300 + " " + "ab" * 400, "\x1c a \x1c!\x1c b", "é́ ́x", "a  b　c", "voilà monde à", "\r\n\r\na\r\n",
    "Σας ΣΑΣ H̱", "😀😀 🤖 漢字 かな", "tab\tsep  two", "0123 456.78", None, "\x85a\x85 b\xa0c", "word " * 500,
]


def test_word_spans_and_hashes():
    raw, off = arrow_bytes(pa.array(TEXTS))
    start, end, row = word_spans(raw, off)
    got = [(int(r), raw[a:b].tobytes().decode()) for a, b, r in zip(start, end, row, strict=True)]
    assert got == [(i, w) for i, t in enumerate(TEXTS) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    h = span_hashes(raw, start, end)
    assert len(set(h.tolist())) == len({w for _, w in got})
    assert [b for _, b in byte_slices(pa.array(TEXTS), 10)][-1] == len(TEXTS)


def test_words_that_meet_as_polynomials():
    """A word of the doubling sequence and its complement have equal polynomials modulo 2**64 under any odd multiplier."""
    for n in (256, 1024, 4096):
        word = np.array([97 + bin(i).count("1") % 2 for i in range(n)], np.uint8)
        raw, start, end = np.append(word, 195 - word), np.array([0, n]), np.array([n, 2 * n])
        assert len(set(word_hashes(raw, start, end).tolist())) == 2
        pair = pa.array([word.tobytes().decode(), (195 - word).tobytes().decode()])
        assert len(set(line_dedup.line_keys(pair, start, end).tolist())) == 2
    raw, off = arrow_bytes(pa.array(TEXTS))
    start, end, _ = word_spans(raw, off)
    words = [raw[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    by_hash = {}
    for w, h in zip(words, word_hashes(raw, start, end).tolist(), strict=True):
        assert by_hash.setdefault(w, h) == h
    assert len(set(by_hash.values())) == len(by_hash)


def test_spread_of_anchors():
    """Whatever is dealt, a task that sees a part of an anchor's contexts knows that there are others, and each settled place has a copy."""
    r = np.random.default_rng(3)
    for _ in range(30):
        n = int(r.integers(1, 60))
        h, ctx = r.integers(0, 6, n).astype(np.uint64), r.integers(0, 4, n).astype(np.uint64)
        key, pos = np.arange(n), np.zeros(n, np.int64)
        rows, dealt, kind = suffix_dedup.spread(h, ctx, key, pos)
        assert sorted(rows[kind != suffix_dedup.WITNESS].tolist()) == list(range(n))
        for k, d, w in zip(rows, dealt, kind, strict=True):
            same = (h == h[k]) & (ctx == ctx[k])
            several = len(set(ctx[h == h[k]].tolist())) > 1
            if w == suffix_dedup.SETTLED:
                assert same.sum() > 2
            elif w == suffix_dedup.BY_ANCHOR:
                assert d == h[k] and not several
            elif w == suffix_dedup.WITNESS:
                assert d == h[k] and several
            else:
                assert several and len(set(dealt[(kind == w) & (h[rows] == h[k]) & (ctx[rows] == ctx[k])].tolist())) == 1
        assert all((kind[h[rows] == v] == suffix_dedup.WITNESS).sum() in (0, 2) for v in set(h.tolist()))


def test_bpe_equals_library():
    tiktoken = pytest.importorskip("tiktoken")
    own = bpe.codec(P.path(bpe.RANKS), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice("abn 'st\n\té1.,") for _ in range(r.randint(0, 60))) for _ in range(300)]
    ids, id_off, decoded, off = bpe.encode_column(pa.array(texts), own)
    for k, t in enumerate(texts):
        assert ids[id_off[k] : id_off[k + 1]].tolist() == library.encode_ordinary(t or "")
        assert bytes(decoded[off[k] : off[k + 1]]) == (t or "").encode()


def test_bpe_of_long_pieces():
    """Pieces of any length take the recursive query, also where many pairs of one rank meet or make pairs of lower rank."""
    tiktoken = pytest.importorskip("tiktoken")
    own = bpe.codec(P.path(bpe.RANKS), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(8)
    texts = ["a" * 5000, "ab" * 700, "the" * 300, "mississippi" * 60, "aaaab" * 200, "=" * 2000, "漢字かな" * 300, "".join(r.choice("abcdeEX") for _ in range(600)), "q" * 97 + "z" * 300]
    ids, id_off, decoded, off = bpe.encode_column(pa.array(texts), own)
    for k, t in enumerate(texts):
        assert ids[id_off[k] : id_off[k + 1]].tolist() == library.encode_ordinary(t)
        assert bytes(decoded[off[k] : off[k + 1]]).decode() == t


def test_bpe_order_of_merges():
    """A vocabulary in which a merge makes a pair of lower rank: one by one and all at once differ, and one by one is right."""
    tiktoken = pytest.importorskip("tiktoken")
    import base64
    import tempfile

    words = [*(bytes([b]) for b in range(256)), b"xy", b"ya", b"yab", b"xyab", b"xyaba", b"ab", b"aba"]
    with tempfile.NamedTemporaryFile("wb", suffix=".tiktoken") as f:
        f.write(b"".join(base64.b64encode(w) + b" %d\n" % k for k, w in enumerate(words)))
        f.flush()
        own = bpe.Codec(f.name, P.PATTERN)
    library = tiktoken.Encoding("odd", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(9)
    texts = ["xyabab", "xyabxyab", "abababxyabababxyab", *("".join(r.choice("xyab") for _ in range(r.randint(2, 40))) for _ in range(400))]
    got = own.encode_pieces([t.encode() for t in dict.fromkeys(texts)])
    assert all(got[t.encode()] == library.encode_ordinary(t) for t in texts)


def test_token_counts_equal_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path(token_counts.TOKENIZER)
    library = tokenizers.Tokenizer.from_file(path)
    normal = [re.sub(r"[\x09-\x0D\x20]+", " ", t or "").strip(" ") for t in TEXTS]
    assert token_counts.text_counts(pa.array(normal), path).tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]


def test_shingles():
    rows = ["a b c d e", "A b", "", None, "x", "a b c d a b c d"]
    sets = list(jaccard_join.shingle_sets(pa.array(rows), 4))
    assert [len(s) for s in sets] == [2, 1, 0, 0, 1, 4]
    again = list(jaccard_join.shingle_sets(pa.array(["a  B"]), 4))
    assert again[0].tolist() == sets[1].tolist()


def test_signature_bound():
    r = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 1 << 30, 200).astype(np.uint64) << np.uint64(20)) for _ in range(2))
        b = np.unique(np.append(b[:50], a[:120]))
        x, y = (np.frombuffer(jaccard_join.signature(s), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_suffix_array_and_prefixes():
    r = random.Random(5)
    for size in (1, 2, 30, 300):
        body = bytes(r.choice(b"ab") for _ in range(size))
        a = np.frombuffer(body, np.uint8)
        order = suffix_dedup.suffix_array(a)
        assert order.tolist() == sorted(range(size), key=lambda i: body[i:])
        lcp = suffix_dedup.common_prefixes(a, order, np.array([0]), 40)
        for k in range(1, size):
            x, y = body[order[k - 1] :], body[order[k] :]
            n = next((i for i in range(min(len(x), len(y), 40)) if x[i] != y[i]), min(len(x), len(y), 40))
            assert lcp[order[k]] == n


def test_anchors_depend_on_strings_only():
    r = random.Random(6)
    common = bytes(r.choice(b"abcdef ") for _ in range(90))
    texts = [bytes(r.choice(b"abcdef ") for _ in range(n)) + common for n in (0, 13, 200)]
    raw, off = arrow_bytes(pa.array(texts))
    row, at, h, _ = suffix_dedup.anchors(raw, off, 60, 16)
    inside = [{(int(p - off[k + 1]), int(x)) for p, x in zip(at[row == k], h[row == k], strict=True) if p - off[k + 1] >= -60} for k in range(3)]
    for k in range(3):  # the last string of 60 bytes is shared, so its anchor is
        assert inside[0] & inside[k]


def test_cut():
    assert suffix_dedup.cut(b"abcdefgh", [(1, 3), (2, 4), (6, 99)]) == (8, 5, 2, b"aef")
    assert suffix_dedup.cut(b"", []) == (0, 0, 0, b"")


def test_edit_distance():
    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j + 1] + 1, q[j] + 1, p[j] + (x != y)))
            p = q
        return p[-1]

    r = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(r.choice("abé") for _ in range(r.randint(0, 9))) for _ in range(2))
        for most in (1, 2, 3):
            assert line_dedup.edit_distance(a, b, most) == min(plain(a, b), most + 1)


def test_common_subsequence():
    a = np.array([1, 2, 3, 4, 5], np.uint64)
    assert decontaminate.common_words(a, np.array([9, 1, 3, 2, 5], np.uint64)) == 3
    assert decontaminate.common_words(a, a) == 5 and decontaminate.common_words(a, a[:0]) == 0


def test_chat_escape_is_reversible():
    r = random.Random(2)
    for _ in range(2000):
        s = "".join(r.choice("<|\\a>\n") for _ in range(r.randint(0, 12)))
        assert chat_format.unescape(chat_format.escape(s)) == s and "<|" not in chat_format.escape(s)
        assert chat_format.unescape_role(chat_format.escape_role(s)) == s and "\n" not in chat_format.escape_role(s)


def test_chat_fold():
    events = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "he"), (1, 1, 2, "delta", "assistant", "llo"), (1, 1, 6, "regenerate", "assistant", ""), (1, 1, 7, "delta", "assistant", "new"),
        (1, 2, 3, "message", "user", "gone"), (1, 2, 8, "message", "user", "stays"), (1, 2, 9, "edit", "user", "edited"), (2, None, None, None, None, None),
    ]
    assert list(chat_format.fold(iter(events))) == [(1, "user", "hi"), (1, "assistant", "new"), (1, "user", "edited"), (2, "", "")]
    assert list(chat_format.fold(iter([]))) == []


def test_chat_fold_is_a_replay():
    """Random logs replayed event by event in order of sequence, with the whole conversation at hand."""
    r = random.Random(12)
    for _ in range(400):
        log = [(1, r.randint(0, 3), seq, r.choice(["message", "message", "delta", "delta", "edit", "regenerate", "typing", None]), r.choice(["user", "assistant"]), r.choice("abcd")) for seq in range(r.randint(0, 14))]
        turns = {}
        for _, turn, _, kind, role, text in log:
            own = turns.setdefault(turn, [])
            if kind == "typing":
                continue
            if (kind or "message") == "message":
                own.append([role, text])
                continue
            if not own:
                own.append([role, ""])
            own[-1][1] = own[-1][1] + text if kind == "delta" else text
            if kind == "regenerate":
                for later in [t for t in turns if t > turn]:
                    del turns[later]
        want = [(1, role, text) for turn in sorted(turns) for role, text in turns[turn]]
        assert list(chat_format.fold(iter(sorted(log, key=lambda e: (e[1], e[2]))))) == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body><nav><ul><li><a href=x>menu</a></li></ul></nav>
<header><h1>Site</h1></header><!-- c <p>no</p> --><div class="ad">buy</div><aside>side</aside><div id="cookie-notice">cookies</div><article><header><h1>Title &amp;amp; more</h1><p>by line</p></header>
<p><b>First.<br><p>Second  one&nbsp;here &lt;ok&gt; &#233;<div class="share">share</div><ul><li>x<li>y</ul><form><p>mail</p></form><table><tr><td>1<td>2</table>loose</article><section class="comments"><p>reader</p></section><footer>f</footer>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == "Title &amp; more\nFirst.\nSecond one here <ok> é\nx\ny\n1\n2\nloose"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("<p>a<p>b < c") == "a\nb < c"
    assert html_text.main_text('<body><div class="x"><p>one</p></div><p title="a>b">two</p>') == "one\ntwo"
    boxes = html_text.Page("<body><div><p>tpl</p></div><p>own is longer</p></body>").boxes()
    assert html_text.main_text("<body><div><p>tpl</p></div><p>mine is long</p></body>", boxes) == "mine is long"


def test_html_marks():
    text = html_text.main_text
    assert text('<div class="layout no-sidebar"><p>Real text.</p></div><div class="sidebar-left"><p>side</p></div>') == "Real text."
    assert text('<div id="page-with-sidebar"><article><p>Real text.</p></article></div>') == "Real text."
    assert text('<div class="menu"><article><p>Real text.</p></article></div><p>other</p>') == "Real text."  # a wrong name above the article
    assert text('<div class="banner"><p>All there is.</p></div>') == "All there is."
    assert text('<article><p>Text.</p><div class="related-posts"><p>no</p></div></article><div class="comments"><article><p>reader</p></article></div>') == "Text."
    assert text("<p>a<b>b<p>c</b>d</i></td>e") == "ab\ncde"
    assert text('<p>one <span class="ad">buy</span>two</p><p hidden>no</p><p style="display: none">no</p>') == "one two"
    assert text('<article><p>We <a class="share-link">quote</a> it</p><span class="share">Share</span></article>') == "We quote it"
    assert text("<ul><li>x<ul><li>y</ul><li>z</ul><table><tr><td>1<td><p>2<tr><td>3</table>") == "x\ny\nz\n1\n2\n3"


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x", "<b>" * 60_000 + "x</i></b>" * 9, "<p><b>" * 20_000 + "x", "<table><tr><td>" * 9_000 + "x", '<span class="ad">' * 20_000 + "</b>" * 50_000, "<ul><li>" * 9_000 + "x" + "</li></ul>" * 9_000, "a < b " * 90_000])
def test_html_in_linear_time(page):
    import time

    began = time.time()
    read = html_text.Page(page)
    read.text(read.cut({1})[0])
    assert time.time() - began < 3


def test_rules_separate():
    r = np.random.default_rng(0)
    x = r.random((600, len(quality_classifier.NAMES)))
    y = ((x[:, 2] < 0.3) | ((x[:, 4] > 0.6) & (x[:, 1] > 0.5))).astype(float)
    model = quality_classifier.fit_rules(x[:400], y[:400])
    assert ((model.predict(x[400:]) >= 0.5) == (y[400:] == 1)).mean() > 0.93
    assert len(model.rules) < 200 and model.describe()
    assert quality_classifier.fit_rules(x[:0], y[:0]).predict(x[:2]).tolist() == [0.5, 0.5]
    assert quality_classifier.fit_rules(x[:9], np.ones(9)).predict(x[:2]).min() > 0.5


def test_statistics_have_names_of_their_own():
    from lexweave.llm.text_stats import COUNTS

    assert len(COUNTS) == len(set(COUNTS))


def test_digest_helper():
    assert token_counts.version_of(P.path(token_counts.TOKENIZER)) == hashlib.sha256(open(P.path(token_counts.TOKENIZER), "rb").read()).hexdigest()


def test_products_with_passages():
    rng = np.random.default_rng(3)
    slots = [np.sort(rng.integers(0, 50, n)).astype("<u2") for n in rng.integers(1, 48, 21)]
    idf = rng.random(decontaminate.TERMS).astype(np.float32)
    x = np.zeros((len(slots), decontaminate.TERMS), np.float32)
    for k, own in enumerate(slots):
        np.add.at(x[k], own, idf[own])
        x[k] /= np.linalg.norm(x[k])
    column = pa.array([s.tobytes() for s in slots], pa.binary())
    basis, signs = rng.random((decontaminate.TERMS, 5)).astype(np.float32), decontaminate.signs_of(np.arange(21, dtype=np.uint64), 80)
    assert set(np.unique(signs)) == {-1, 1} and np.linalg.matrix_rank(signs) == 21
    for right, whole in ((basis, True), (signs, False)):
        out = np.zeros((decontaminate.TERMS, right.shape[1]), np.float32)
        decontaminate.add_products(out, column, idf, right, whole)
        assert np.allclose(out, x.T @ (x @ right if whole else right), atol=1e-4)


def test_bpe_cuts_before_marks():
    """Marks after letters begin a chunk, so that a word is encoded once whatever follows it; the pieces stay those of the pattern."""
    import tiktoken

    rng = random.Random(9)
    texts = ["don't, won't. caf\u00e9's na\u00efve; gro\u00df'll a\u00d7b\u00f7c a\u00d7. b\u00f7, (x) 'tis x's-y", "\u00e9", "\u00df.", "", None, "a.", ".a", "\u00c3.", "e\u0301. \u0160."]
    texts += ["".join(rng.choice("ab\u00e9\u00df\u00e0\u00c5\u00d7\u00f7\u00a0\u0160\u20ac\u2003\u3000 \n\t.,'s!1") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    raw, off = arrow_bytes(pa.array(["gro\u00df gro\u00df, gro\u00df. word word, word. word's"]))
    chunks, _ = bpe_chunks.distinct_chunks(raw, bpe_chunks.piece_cuts(raw, off))
    assert chunks == [t.encode() for t in ("gro\u00df", " gro\u00df", ",", ".", " word", "'s")]
    own = bpe.codec(P.path(bpe.RANKS), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.RANKS)), special_tokens={})
    ids, id_off, decoded, off = bpe.encode_column(pa.array(texts), own)
    for k, t in enumerate(texts):
        assert ids[id_off[k] : id_off[k + 1]].tolist() == library.encode_ordinary(t or ""), t
        assert decoded[off[k] : off[k + 1]].tobytes() == (t or "").encode()


def test_suffix_kernels_in_stretches(monkeypatch):
    """Hashes and minima do not depend on the stretches that they are made in; leading zero bytes are exact next to powers of two."""
    rng = np.random.default_rng(8)
    raw, values = rng.integers(97, 100, 2000).astype(np.uint8), rng.integers(0, 1 << 62, 2000).astype(np.uint64)
    seen = []
    for stretch in (1 << 15, 7, 64, 1999):
        monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
        seen.append((suffix_dedup.gram_hashes(raw, 16)[:1985].tolist(), suffix_dedup.window_minima(values, 45)[:1956].tolist()))
    assert all(s == seen[0] for s in seen) and seen[0][1] == [int(values[i : i + 45].min()) for i in range(1956)]
    x = [0, *sorted({min(max((1 << k) + d, 0), (1 << 64) - 1) for k in range(65) for d in (-2, -1, 0, 1, 2)})]
    assert suffix_dedup.leading_zero_bytes(np.array(x, np.uint64)).tolist() == [(64 - v.bit_length()) // 8 for v in x]


def test_bpe_gives_back_what_a_task_needed(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    made, texts = [], [f"zqxv{k:03d} wörter {k}" * 40 for k in range(50)]
    encode = bpe.encode_column
    monkeypatch.setattr(bpe, "SLICE", 2000)
    monkeypatch.setattr(bpe, "encode_column", lambda column, own: made.append(column.nbytes) or encode(column, own))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    run = lambda: b"".join(decoded.tobytes() for _, _, _, decoded, _ in bpe.coded_slices(iter([batch]), "text", P.path(bpe.RANKS), P.PATTERN))
    own = bpe.codec(P.path(bpe.RANKS), P.PATTERN)
    assert run() == "".join(texts).encode() and len(made) > 10
    assert own.open is None and len(own.memo)
    own.memo = bpe.Memo()  # a later task opens the database again
    assert run() == "".join(texts).encode() and own.open is None


def test_decontamination_windows_are_sums_of_blocks():
    rng = np.random.default_rng(3)
    rows = np.array([1, 5, 2, 9, 1, 30])
    row = np.repeat(np.arange(len(rows)), rows)
    end = np.searchsorted(row, row, "right")
    first = np.append(True, row[1:] != row[:-1])
    blocks = rng.standard_normal((len(row), 4))
    sums = np.vstack([np.zeros((1, 4)), np.cumsum(blocks, 0), np.repeat(blocks.sum(0)[None], 9, 0)])
    for n in (0, 1, 31, 32, 33, 100):
        x = rng.standard_normal((n, 4))
        held = x.copy()
        decontaminate.running_sums(held)
        np.testing.assert_allclose(held, np.cumsum(x, 0), atol=1e-12)
    for size in (1, 2, 7, 9):
        for a in range(0, len(row), 11):
            at = np.arange(a, min(a + 11, len(row)))
            stop, v = decontaminate.window_sums(sums, at, size, end, first[at])
            assert (stop == np.minimum(at + size, end[at])).all()
            for k in np.flatnonzero((stop - at == size) | first[at]):
                np.testing.assert_allclose(v[k], blocks[at[k] : stop[k]].sum(0), rtol=1e-5, atol=1e-5)


def test_orthonormal_in_place():
    r = np.random.default_rng(4)
    full = r.normal(size=(500, 7)).astype(np.float32)
    flat = full.copy()
    flat[:, 4] = flat[:, 0]
    top = np.zeros((500, 7), np.float32)
    top[3, 2] = 5
    for z, rank in ((full, 7), (flat, 6), (top, 1), (np.eye(500, 7, dtype=np.float32), 7), (full[:9], 7), (full[:7], 7)):
        q = z.copy()
        decontaminate.orthonormal(q)
        assert q.dtype == np.float32 and np.abs(q.T @ q - np.eye(7)).max() < 1e-5
        assert np.abs(q @ (q.T @ z) - z).max() < 1e-4 and np.linalg.matrix_rank(z) == rank  # z is in its span
        if rank == 7:  # but for signs, columns are those of a QR of the whole
            assert np.abs(np.abs((q * np.linalg.qr(z)[0]).sum(0)) - 1).max() < 1e-4
