"""Source divergence, tokenizer alignment and language identification against brute force, on small tables with odd rows."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tablescope.llm import alignment, divergence, string_kernel

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
ODD = "doc_id bigint, text string, lang string, source string, n_a string, block int, held_out int, lang_pred string, item string, value string, id string"


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


# --- source divergence -------------------------------------------------------------------------


def labelled(seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(260):
        lang, source = rng.choice(["en", "fr", "", None]), rng.choice(["a", "b", "cé", "d", "e", "", None])
        text = " ".join(f"{rng.choice(['W', 'w', 'É'])}{'abcdefghij'[int(rng.paretovariate(0.6)) % 10]}{'xyz'[rng.randrange(3)] * rng.randint(0, 3)}" for _ in range(rng.randint(0, 40)))
        rows.append((rng.randrange(100), text, lang, source))
    rows += [(1, None, "en", "only null"), (2, "12 34 .", "en", "no terms"), (3, "alone", "xx", "one"), (4, "", "xx", "two"), (5, "z" * 3000 + " wa", "en", "a")]
    rows += [(6, "same text", "en", "b")] * 3 + [(None, "wa wb", "fr", "a")]
    return rows


def divergences(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", collections.Counter(TERM.findall(lowered(text or "")))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in d[2])
        kept = sorted(t for t in df if df[t] >= min_docs)
        v = len(kept)
        share = lambda c, total: 1 + 10**9 * (c + 1) // (total + v)
        counts = {s: collections.Counter() for s in {d[1] for d in mine}}
        for _, s, c in mine:
            counts[s].update({t: n for t, n in c.items() if df[t] >= min_docs})
        whole = sum(counts.values(), collections.Counter())
        p = {s: {t: share(c[t], sum(c.values())) for t in kept} for s, c in counts.items()}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in counts:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or k <= top:
                        out.add((lang, s, part, item, value, k))
    return out


@pytest.mark.parametrize("blocks", [{}, {"group_block": 2, "term_block": 5}, {"group_block": 3, "term_block": 4, "small": 0, "top_terms": 4}])
def test_divergence(spark, blocks, monkeypatch):
    monkeypatch.setattr(divergence, "TABLE_TERMS", 50)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 40)
    monkeypatch.setattr(divergence, "SALT_ROWS", 7)
    rows = labelled()
    got = divergence.divergence(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), **blocks).collect()
    want = divergences(rows, top=blocks.get("top_terms", 200))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r.part == "pair" and r.value == 0 for r in got)  # a language without kept terms


def test_shares_stay_exact():
    c, total = np.array([10**15, 3, 0]), np.array([7 * 10**15, 10, 0])
    got = divergence._shares(c, total, 5)
    assert got.tolist() == [1 + 10**9 * (int(a) + 1) // (int(b) + 5) for a, b in zip(c, total)]


def test_terms_are_the_pattern():
    text = "".join(map(chr, [*range(1, 256), 0x212A, 0x4E00, 0x1F600])) * 2 + "\x00Ab-cD"
    assert [t.decode() for piece in divergence._terms(text.encode()) for t in piece] == [lowered(t) for t in TERM.findall(text)]


# --- tokenizer alignment --------------------------------------------------------------------------


TEXTS = [
    "Plain words, two of them", "", None, " ", "\n\n  indented\ttext \r\n", "naïve façade — “quoted” 中文字符 日本", "a▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "emoji 👩‍👩‍👧 and é",
    "a" * 700, "   leading", "trailing   ", "x y　z", "Plain words, two of them", "1234567890 3.14159", "\x00 nul", "don't won't I'll", "ß" * 50, " word" * 300, "﻿bom", "​zero",
]


@pytest.fixture(scope="module")
def coders():
    return alignment.Coders(open(alignment.TOKENIZER_A, "rb").read(), open(alignment.TOKENIZER_B, "rb").read())


def spelled(coders):
    """Token bytes of both, worked out anew."""
    visible = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD) and not 0x7F <= b <= 0xA0]
    table = {chr(b): b for b in visible}
    for k, b in enumerate(b for b in range(256) if b not in visible):
        table[chr(256 + k)] = b
    return lambda k: bytes(table[c] for c in coders.a.id_to_token(k)), lambda k: (lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())(coders.b.id_to_piece(k))


def alignments(coders, rows):
    bytes_a, bytes_b = spelled(coders)
    docs = []
    for i, text in rows:
        a = coders.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = coders.b.encode(text or "")
        a_bytes, b_bytes = [bytes_a(x) for x in a], [bytes_b(x) for x in b]
        if not text or not b"".join(a_bytes) == (" " + text).encode() == b"".join(b_bytes):
            docs.append((i, [], [], []))
            continue
        ends = [list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes)]
        groups, i0, j0 = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            i1, j1 = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append((a[i0:i1], b[j0:j1]))
            i0, j0 = i1, j1
        docs.append((i, a, b, groups))
    count = collections.Counter(p for *_, groups in docs for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    top = {}
    for (x, _), n in count.items():
        top[x] = max(n, top.get(x, 0))
    out = []
    for i, a, b, groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), sha, text))
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


@pytest.mark.parametrize("size", [8_000_000, 300])
def test_alignment(spark, coders, size, monkeypatch):
    monkeypatch.setattr(alignment, "STEP_BYTES", 600)
    rng = random.Random(1)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again")]
    rows += [(100 + k, " ".join(rng.choice(["the", "Haus", "ñandú", "x1", "été,", "zzzqqq", "\n"]) for _ in range(rng.randint(1, 60)))) for k in range(60)]
    want = alignments(coders, rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = alignment.aligned(docs, block_bytes=size, groups=True)
    assert sorted(map(repr, [tuple(r[c] for c in COLUMNS) for r in got.collect()])) == sorted(map(repr, want))
    assert sum(1 for w in want if not w[1]) >= 3 and any(len(g.split("|")[0].split(",")) > 1 for w in want for g in w[8].split(";"))


def test_windows_cut_at_anchors_only(coders):
    """Windows are looked up again, and joined they are the groups of the whole text."""
    block = alignment.Block(coders, 0, True)
    text = "the house and the house and the garden"
    block.add([1], [text.encode()])
    assert len(block.windows) < len(text.split()) and block.rows[0][8] == alignments(coders, [(1, text)])[0][8]


# --- language ------------------------------------------------------------------------------------------


WORDS = {
    "en": "the of and to in that was his he it with is for as had you not be her on at by which have or from this him but all".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "ру": "и в не на я что тот быть с а весь это как она по но они к у ты из мы за вы так же от сказать этот который".split(),
}


def spoken(n=240):
    rng = random.Random(2)
    return [(k, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(6, 60))).capitalize() + rng.choice([".", "!", " 12"]), lang) for k, lang in ((k, rng.choice(list(WORDS))) for k in range(n))]


def test_language(spark):
    rows = spoken() + [(1000, None, "en"), (1001, "12 ... ²½ 3", "en"), (1002, "", "de"), (1003, "который сказать", None), (None, "the of and", "en"), (5, "und nicht", "de"), (5, "und nicht", "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = string_kernel.identified(docs, sample_rows=60, landmarks=24).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows if lang}
    out = [r for r in got if r.held_out and r.doc_id in truth and (r.doc_id or 0) < 1000]
    assert len(out) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and by_id[1003].lang_pred == "ру"
    assert all(0 <= r.score <= 1 for r in got)
    blind = docs.selectExpr("doc_id", "text", "if(crc32(string(doc_id)) % 5 = 0, 'xx', lang) AS lang")  # held-out labels are not read
    other = {(r.doc_id, r.lang_pred, r.score) for r in string_kernel.identified(blind, sample_rows=60, landmarks=24).collect()}
    assert other == {(r.doc_id, r.lang_pred, r.score) for r in got}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in got)


def grams(text):
    padded = [f" {w} " for w in re.findall(r"[^\W\d_]+", text.lower())]
    return {w[i : i + n] for w in padded for n in (1, 2, 3) for i in range(len(w) - n + 1)} - {" "}


def test_kernel_and_regression_against_brute_force():
    rows = spoken(60)
    code = lambda t: string_kernel.Presence([t]).codes
    for _, t, _ in rows:
        assert len(code(t)) == len(grams(t))
    names = sorted(WORDS, key=str.encode)
    state = string_kernel.fitted([(lang, code(t).astype(np.int64).tobytes()) for _, t, lang in rows], names, landmarks=12, ridge=0.01)
    model = string_kernel.Classifier(state)
    chosen = [t for name in names for t in [t for _, t, lang in rows if lang == name][:4]]
    kernel = lambda x, y: len(grams(x) & grams(y)) / (len(grams(x)) * len(grams(y))) ** 0.5
    new = [t for _, t, _ in spoken(80)[60:]]
    want = np.array([[kernel(x, y) for y in chosen] for x in new])
    assert np.allclose(model.kernel(string_kernel.Presence(new)), want)
    # ridge regression in the landmarks' span, solved another way: augmented least squares on whitened features
    whole = np.array([[kernel(t, y) for y in chosen] for _, t, _ in rows])
    s, u = np.linalg.eigh(np.array([[kernel(x, y) for y in chosen] for x in chosen]))
    features = whole @ u / np.sqrt(s)
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for *_, lang in rows])
    f0, y0 = features.mean(0), y.mean(0)
    stacked = np.vstack([features - f0, (0.01 * len(rows)) ** 0.5 * np.eye(12)])
    beta = np.linalg.lstsq(stacked, np.vstack([y - y0, np.zeros((12, 3))]), rcond=None)[0]
    assert np.allclose(model.scores(string_kernel.Presence(new)), (want @ u / np.sqrt(s) - f0) @ beta + y0, atol=1e-6)


def test_blocks_do_not_change_scores(spark, monkeypatch):
    docs = spark.createDataFrame(spoken(120), "doc_id bigint, text string, lang string")
    want = string_kernel.identified(docs, sample_rows=40, landmarks=12).collect()
    monkeypatch.setattr(string_kernel, "BLOCK_ROWS", 3)
    assert sorted(string_kernel.identified(docs.repartition(5), sample_rows=40, landmarks=12).collect()) == sorted(want)


# --- odd tables ------------------------------------------------------------------------------------------


CALLS = {"divergence": divergence.divergence, "alignment": alignment.aligned, "language": string_kernel.identified}


@pytest.mark.parametrize("name", list(CALLS))
def test_odd_tables(spark, name):
    rows = [(i, t, lang, s, *["x", 1, 2, "y", "z", "v", "w"]) for i, t, lang, s in labelled()]
    docs = spark.createDataFrame(rows, ODD)
    got = CALLS[name](docs).collect()
    assert got and (name == "divergence" or sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows))
    assert CALLS[name](docs.where("false")).collect() == []
    nulls = CALLS[name](docs.selectExpr("doc_id", "cast(null AS string) AS text", "cast(null AS string) AS lang", "cast(null AS string) AS source")).collect()
    assert len(nulls) == (0 if name == "divergence" else len(rows))


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "the house " * 150_000, "en", "a"), (2, "das haus " * 10, "de", "b"), (3, "the garden", "en", "a"), (4, "der garten", "de", "b")], "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id: r.n_groups for r in alignment.aligned(docs).collect()}[1] > 300_000
    assert {r.lang_pred for r in string_kernel.identified(docs).collect()} <= {"en", "de"}
    assert [r.value for r in divergence.divergence(docs, min_docs=1).collect() if r.part == "pair"] == []


def test_ranks_give_the_tokenizers_ids(coders):
    """A run by ranks against the tokenizer itself: every code point in several places, runs, white space, joined vocabulary entries."""
    assert coders.ranked is not None
    rng = random.Random(4)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    body = ["".join(f"a{c}b {c}{c} 1{c}2 {c}\n .{c}" for c in points[at : at + 64]) for at in range(0, len(points), 64)][: 0x3400 // 64] + ["".join(points[at : at + 64]) for at in range(0x3400, len(points), 64 * 9)]
    blanks = [c for c in points if c.isspace()] + ["a", "1", ".", "'s"]
    body += ["".join(rng.choice(blanks) for _ in range(200)) for _ in range(300)] + [c * n for c in "aex =-_0é" for n in (2, 17, 100, 1001)]
    entries = [t for t in (coders.a.decode([k]) for k in range(50256)) if "�" not in t]
    body += ["".join(rng.choice(entries) for _ in range(300)) for _ in range(400)]
    want = [e.ids for e in coders.a.encode_batch_fast([" " + t for t in body], add_special_tokens=False)]
    assert coders.encoded(body)[0] == want


def test_other_vocabularies_are_not_run_by_ranks(coders):
    import json

    config = json.load(open(alignment.TOKENIZER_A))
    config["model"]["merges"].reverse()
    assert alignment.ranked(config) is None
    blank = " " * 60_000 + "x" + "\n" * 70_000
    assert coders.encoded([blank])[0] == [coders.a.encode(" " + blank, add_special_tokens=False).ids]


# --- main text of pages with known stories ----------------------------------------------------------------


def built_page(seed):
    """A page around a known story: nested or flat, with or without class names, end tags and an article element."""
    import html as escape

    rng = random.Random(seed)
    words = "river council harbour & engine <north> winter é market signal \"quoted\" letter".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    story = [" ".join(sentence(rng.randint(8, 16)) for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(4, 9))]
    story.insert(rng.randrange(1, len(story)), "Yes.")
    head = sentence(5)
    closed = rng.random() < 0.6
    inline = lambda t: escape.escape(t).replace("Winter", "<em>Winter</em>").replace(" signal", " <a href='/x'>signal</a>")
    body = "".join(f"<p>{inline(p)}{'</p>' if closed else ''}\n" for p in story)
    body = f"<h1>{escape.escape(head)}</h1>\n{body}"
    for _ in range(rng.randint(0, 5)):
        body = f"<div>{body}</div>"
    wrap = rng.choice(["article", "main", "div", "section"])
    menu = "".join(f"<li><a href='/{i}'>Menu {i}</a></li>" for i in range(6))
    comments = "<div class='comments'><p>A reader says that this is a comment which is as long as a paragraph of the story may be.</p></div>"
    page = (
        f"<!doctype html><html><head><title>{head}</title><style>p {{ color: red }}</style></head><body><header><p>The paper of the town</p></header>"
        f"<nav><ul>{menu}</ul></nav><{wrap}>{body}</{wrap}>{comments if rng.random() < 0.7 else ''}"
        f"<aside><p>Also read this other story of ours, it is quite long for a teaser and has a link.</p></aside>"
        f"<form><label>Mail</label><input name=m></form><footer><p>All rights reserved by the paper of the town, since a long time ago.</p></footer>"
        f"<script>var p = '<p>{'x' * 300}</p>';</script></body></html>"
    )
    return page, "\n".join([head, *story])


@pytest.mark.parametrize("seed", range(40))
def test_known_stories(seed):
    from tablescope.llm import html_text

    page, story = built_page(seed)
    assert html_text.main_text(page) == story


def test_time_is_linear_in_depth():
    import time

    from tablescope.llm import html_text

    def seconds(n):
        page = "<div>" * n + "<p>Some text of a story that is long enough to count.</p>" * n + "</span>" * n
        at = time.process_time()
        assert html_text.main_text(page).count("\n") == n - 1
        return time.process_time() - at

    seconds(500)
    assert seconds(16_000) < 12 * max(seconds(4_000), 0.02)


def test_marked_inline_elements_and_notices_in_plain_boxes():
    from tablescope.llm import html_text

    story = "A paragraph of the story that is long enough to count as text."
    assert html_text.main_text(f"<article><p>{story[:20]}<span class='ad'>Buy <b>now</b></span>{story[20:]}<i hidden>x</i></p></article>") == story
    assert html_text.main_text(f"<article><p><span class=ad>Buy<p>{story}</article>") == story
    plain = f"<body><div>{f'<p>{story}</p>' * 5}</div><div>We use cookies to make this site better.</div></body>"
    assert html_text.main_text(plain) == "\n".join([story] * 5)


@pytest.mark.parametrize("column", ["html"])
def test_pages_of_odd_tables(spark, column):
    from pyspark.sql import functions as F

    from tablescope.llm import html_text

    rows = [(1, None), (2, ""), (3, "<p>One</p>"), (3, "<p>One</p>"), (None, "<b>x"), (4, "<div>" * 3000), (5, "a" * 200_000)]
    pages = spark.createDataFrame([(i, h, "t", 1) for i, h in rows], f"page_id long, {column} string, text string, n_chars int")
    got = pages.withColumn("main", html_text.extracted(F.col(column))).collect()
    assert sorted((str(r.page_id), r.main) for r in got) == sorted((str(i), {"<p>One</p>": "One", "<b>x": "x"}.get(h, h if h and h[0] == "a" else "")) for i, h in rows)
    assert pages.where("false").withColumn("main", html_text.extracted(F.col(column))).collect() == []
