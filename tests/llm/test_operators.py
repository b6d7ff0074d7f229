"""Dealt operators against brute force, on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import tempfile
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.llm import chunks, common, decontamination, html_text, jaccard_join, line_dedup, lm_scoring, mixing, passage_dedup, quality_rules, suffix_dedup, warc

BLANKS = " \t\n\x0b\x0c\r"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages and lines, odd white space, long, short, empty and null texts, repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 160), 3000) for _ in range(12)]
    shared = prose(rng, 60, 3000)
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(12, 60):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["x1", "x2", "É", "zz"])
        if rng.random() < 0.4:
            at = rng.randrange(len(words))
            words[at:at] = shared.split(" ")
        rows.append((i, " ".join(words)))
    line = "This Line is common, and long enough"
    rows += [(60 + i, f"{prose(rng, 8)}\n  {line}\t\n{prose(rng, 9)}\n{line.upper() if i % 2 else line}\nshort") for i in range(6)]
    rows += [(70, ""), (71, None), (72, " \t\n "), (73, "one"), (74, "two words"), (75, "a b c"), (76, "A b C"), (77, "a " * 300), (78, "a" * 500), (79, "aé" * 400)]
    rows += [(80, prose(rng, 6000, 50_000)), (81, base[0] + "\x0b" + base[1]), (82, base[2]), (82, base[2]), (None, base[3]), (None, None), (-7, base[4])]
    rng.shuffle(rows)
    return rows


ROWS = corpus()
UNIQUE = [r for r in ROWS if r[0] is not None and r[0] != 82] + [(82, next(t for i, t in ROWS if i == 82))]


@pytest.fixture(scope="module")
def make(spark):
    def table(rows):
        return spark.createDataFrame(rows, "doc_id bigint, text string")

    return table


@pytest.fixture()
def small_chunks(monkeypatch):
    """Several chunks even of a small table."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 9_000)
    monkeypatch.setitem(chunks.Chunks.__init__.__kwdefaults__, "chunk_bytes", 9_000)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


# --- line dedup ----------------------------------------------------------------------


def test_lines(make):
    holders = collections.defaultdict(list)
    key = lambda line: lowered(line.strip(BLANKS))
    for i, text in UNIQUE:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(i)
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(make(UNIQUE)).collect()}
    assert len(got) == len(UNIQUE)
    dropped = 0
    for i, text in UNIQUE:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))
        dropped += len(lines) - len(kept)
    assert dropped > 5


# --- substring dedup --------------------------------------------------------------------


@pytest.mark.parametrize("several", [False, True])
def test_passages(make, several, request):
    if several:
        request.getfixturevalue("small_chunks")
    seen, want = set(), {}
    for i, text in sorted(UNIQUE):
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        want[i] = (" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone))
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in passage_dedup.remove_repeated_passages(make(UNIQUE)).collect()}
    assert got == want and sum(x[2] for x in want.values()) > 1000


def test_occurrences_in_shards(monkeypatch):
    monkeypatch.setattr(passage_dedup, "SHARD", 3)
    coded = chunks.Coded([b"a b c d e a b c", b"c d e a b", b"x a b c"])
    found = passage_dedup._occurrences(coded, np.array([0, 1, 2, 3, 13]), 3)
    spelled = [w for s in coded.split for w in s]
    wanted = {tuple(spelled[i : i + 3]) for i in (0, 1, 2, 3, 13)}
    inside = coded.starts(3)
    assert found.tolist() == [i for i in inside.tolist() if tuple(spelled[i : i + 3]) in wanted]


@pytest.mark.parametrize("several", [False, True])
def test_bytes(make, several, request):
    if several:
        request.getfixturevalue("small_chunks")
    seen, want = set(), {}
    for i, text in sorted(UNIQUE):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        spans = sum(1 for x, y in zip(b"\0" + gone, gone) if y and not x)
        want[i] = (bytes(x for x, g in zip(b, gone) if not g), len(b), sum(gone), spans)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeated_bytes(make(UNIQUE)).collect()}
    assert got == want and sum(x[2] for x in want.values()) > 5000


def test_bytes_of_spans_that_overlap_themselves(make):
    """A span that starts again a few bytes on is a repeat wherever in its chunk it lies, also without another copy."""
    rng, rows = random.Random(3), []
    for i in range(300):
        unit = bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 50)))
        body = (unit * 150)[: 100 + len(unit) + rng.randint(0, 3)]
        rows.append((i, prose(rng, rng.randint(0, 9), 10**9) + f"<{i}>" + body.decode() + f"<{i}/>"))
    seen, want = set(), {}
    for i, text in rows:
        b = text.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        want[i] = (bytes(x for x, g in zip(b, gone) if not g), sum(gone))
    assert all(n for _, n in want.values())
    assert {r.doc_id: (bytes(r.kept), r.n_removed) for r in suffix_dedup.remove_repeated_bytes(make(rows)).collect()} == want


def test_anchors_depend_on_the_span_alone():
    """The place of a span's anchor, counted from its start, is that of the same span elsewhere, also across blocks."""
    rng = np.random.default_rng(2)
    unit = rng.integers(97, 123, 37, np.uint8)
    data = np.concatenate([rng.integers(97, 99, 65_400, np.uint8), np.tile(unit, 12), np.full(400, 97, np.uint8), rng.integers(97, 99, 70_000, np.uint8)])
    starts, head, place, keys = suffix_dedup._anchored(data, np.full(len(data), len(data)), 100)
    sizes = np.diff(head, append=len(starts))
    hashes, off = suffix_dedup.gram_hashes(data, 50), np.repeat(place, sizes) - starts
    assert ((off >= 0) & (off <= 50)).all() and (np.diff(place) > 0).all()
    assert (hashes[place] >> np.uint64(16) == keys >> np.uint64(16)).all()
    known = {}
    for s, o, k in zip(starts.tolist(), off.tolist(), np.repeat(keys, sizes).tolist()):
        assert known.setdefault(data[s : s + 100].tobytes(), (o, k)) == (o, k)


@pytest.mark.parametrize("span", [7, 30, 100])
def test_suffix_ranks(span):
    """Ranks follow the first ``span`` bytes, the end before any byte; suffixes told apart are not sorted again."""
    rng = random.Random(span)
    texts = [prose(rng, rng.randint(1, 12), 400).encode() for _ in range(300)] + [b"a" * k for k in (1, 5, 10, 20, 45, 80, 100, 101, 130)]
    texts += [b"", bytes(range(256)), b"\xff" * 12, b"\0" * 12, b"a" * 44 + b"b"]
    sizes = np.array([len(t) for t in texts])
    ends, seen, sort = np.repeat(np.cumsum(sizes), sizes), [], suffix_dedup._sorted
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suffix_dedup, "_sorted", lambda keys, bits: seen.append(len(keys)) or sort(keys, bits))
        ranks = suffix_dedup._suffix_ranks(np.frombuffer(b"".join(texts), np.uint8), ends, span)
    head = [t[i : i + span] for t in texts for i in range(len(t))]
    number = {h: k for k, h in enumerate(sorted(set(head)))}
    assert np.unique(ranks, return_inverse=True)[1].tolist() == [number[h] for h in head]
    assert ranks.min() > 0 and ranks.max() <= len(ranks)
    assert sum(seen) < 3 * len(ranks) if span > 7 else len(seen) == 2


def test_anchors_take_little_memory():
    """Hashes are made block by block: a few bytes for each byte of text, however long it is."""
    data = np.random.default_rng(5).integers(97, 123, 2_000_000, np.uint8)
    ends = np.full(len(data), len(data))
    tracemalloc.start()
    suffix_dedup._anchored(data, ends, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * len(data)


@pytest.mark.parametrize("trial", range(40))
def test_parse_order(trial):
    rng = random.Random(trial)
    span, alphabet = rng.choice([20, 30, 100]), rng.choice([b"a", b"ab", "abcdefgh é".encode(), bytes(range(256))])
    base = [bytes(rng.choices(alphabet, k=rng.randint(1, 600))) for _ in range(4)]
    texts = []
    for _ in range(rng.randint(1, 12)):
        b, c = rng.choice(base), rng.choice(base)
        i = rng.randint(0, len(b))
        texts.append(b[i : rng.randint(i, len(b))] + bytes(rng.choices(alphabet, k=rng.randint(1, 3))) + c[: rng.randint(0, len(c))])
    seen, want = set(), []
    for t in texts:
        for i in range(len(t)):
            k = t[i : i + span] if i + span <= len(t) else None
            want.append(k is not None and k in seen)
            seen.add(k)
    sizes = np.array([len(t) for t in texts])
    got = suffix_dedup.repeats(np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.cumsum(sizes), sizes), span)
    assert got.tolist() == want


# --- near duplicates ------------------------------------------------------------------------


def sets_of(rows, n):
    out = {}
    for i, text in rows:
        w = words(lowered(text or ""))
        out[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def components_of(sets, percent):
    name = {i: i for i in sets}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                name[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("length, percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard(make, length, percent):
    want = components_of(sets_of(UNIQUE, length), percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(make(UNIQUE), length=length, percent=percent).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 5


def test_jaccard_of_a_large_group(make, monkeypatch, small_chunks):
    """One group of near copies, whose shingles are all frequent, some without a direct link to the group's centre."""
    monkeypatch.setattr(jaccard_join, "RARE", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(2)
    base = [f"u{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(0, 120, 3), rng.randint(0, 9)):
            w[at] = f"v{rng.randint(0, 2)}"
        rows.append((i, " ".join(w)))
    want = components_of(sets_of(rows, 3), 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(make(rows)).collect()}
    assert got == want and len({c for _, c in want.values()}) > 3


def test_one_of_each_keeps_columns(spark):
    rows = [(1, "a b c d e f g", "en", 1), (2, "a b c d e f g", "fr", 2), (3, "other words stand here in a row", None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string, __id int")
    assert sorted(map(str, jaccard_join.one_of_each(docs).collect())) == sorted(map(str, docs.where("doc_id <> 2 or doc_id is null").collect()))


# --- decontamination -----------------------------------------------------------------------------


def brute_hits(docs, items, threshold, overlap):
    index = decontamination.Index([(i, t) for i, t in items if len(decontamination.terms(t)) >= 8])
    found = set()
    for d, text in docs:
        t = [x for w in (text or "").split() for x in decontamination.terms(w)]
        for p in range(0, max(1, len(t)), index.longest):
            here = t[p : p + 2 * index.longest]
            for at, item in enumerate(index.ids):
                score = sum(x for w in set(here) if w in index.number for i, x in zip(index.items[index.number[w]], index.impacts[index.number[w]]) if i == at)
                shares = [len([g for g in half if any(tuple(here[i : i + len(g)]) == g for i in range(len(here)))]) / len(half) if half else 1.0 for half in index.halves[at]]
                if score >= threshold - 1e-9 and min(shares) >= overlap:
                    found.add((d, item))
    return found


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, " ".join(prose(rng, rng.randint(4, 12), 300).capitalize() + "." for _ in range(rng.randint(1, 3)))) for i in range(40)] + [(40, None), (41, ""), (42, "Too short.")]
    docs = [(i, prose(rng, rng.randint(0, 300), 300)) for i in range(60)] + [(90, None), (91, "")]
    for i in range(60, 85):
        item = rng.choice(items[:40])[1]
        cut = item if i % 3 else " ".join(item.split()[: len(item.split()) // 2])
        docs.append((i, f"{prose(rng, rng.randint(0, 90), 300)}\n{cut.upper() if i % 2 else cut}  {prose(rng, rng.randint(0, 90), 300)}"))
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = brute_hits(docs, items, 0.7, 0.8)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 10


@pytest.mark.parametrize("trial", range(20))
def test_block_max_search(trial, monkeypatch):
    rng = random.Random(trial)
    monkeypatch.setattr(decontamination, "BLOCK", 3)
    index = decontamination.Index([(i, prose(rng, rng.randint(3, 20), 40)) for i in range(60)])
    query = rng.sample(range(len(index.number)), min(len(index.number), 12))
    threshold = rng.choice([0.1, 0.3, 0.6])
    scores = collections.Counter()
    for t in query:
        for i, x in zip(index.items[t], index.impacts[t]):
            scores[i] += x
    want = {i: s for i, s in scores.items() if s >= threshold}
    got = dict(index.search(query, threshold))
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in got)


def test_decontamination_in_shards(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_ITEMS", 2)
    monkeypatch.setattr(decontamination, "ITEM_WORDS", 20)
    items = [(i, " ".join(f"t{i}x{j}" for j in range(25))) for i in range(5)]
    docs = [(i, f"before {items[i][1]} after") for i in range(5)] + [(9, "nothing here")]
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items, min_words=5).collect()} == {(i, i) for i in range(5)}
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, items, min_words=5).collect()] == [9]


def test_short_items_are_found_whole(spark):
    items = [(1, "Who wrote it? Ada."), (2, "Yes."), (3, "one two three four five six seven"), (4, "... ?"), (5, None), (6, "who wrote it? Bob"), (7, " ".join(f"long{i}" for i in range(12)))]
    docs = [(1, "before who WROTE it, ada after"), (2, "who wrote it"), (3, "ada who wrote it"), (4, "yes"), (5, "one two three four five six x seven"), (6, "a one two three four five six seven"), (7, items[6][1] + " yes"), (8, None), (9, "who wrote"), (10, "it ada")]
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contaminated(docs, items, short=True).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (4, 2), (6, 3), (7, 2), (7, 7)]
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()) == [2, 3, 5, 8, 9, 10]


def test_long_items_are_verified_whole(spark):
    """A piece, or the item's last word, is not the item; the whole item is found, also with some words changed."""
    words = [f"t{j}" for j in range(400)] + ["common"]
    changed = ["x" if j % 100 == 7 else w for j, w in enumerate(words)]
    docs = [(1, "a common word"), (2, "before " + " ".join(words) + " after"), (3, " ".join(words[:220])), (4, " ".join(f"y{j}" for j in range(1000)) + " " + " ".join(changed)), (5, " ".join(words[201:]))]
    docs, items = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(words)), (2, "some other item " * 4)], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontamination.contaminated(docs, items).collect()}
    assert sorted(got) == [2, 4] and math.isclose(got[2].score, 1.0) and got[2].question_overlap == got[2].answer_overlap == 1.0
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, items).orderBy("doc_id").collect()] == [1, 3, 5]


# --- mixing --------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["big"] * 8 + ["mid"] * 3 + ["tiny"] + [None])) for i in range(1500)]
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s] += len(words(t))
    total = sum(tokens.values())
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), max_repeats=3.0, block_tokens=5000).collect()
    # brute force exponent: the repeats of the smallest source against the largest are 3
    big, least = max(tokens.values()), min(tokens.values())
    a = 1 - math.log(3) / math.log(big / least)
    z = sum((t / total) ** a for t in tokens.values())
    for s, t in tokens.items():
        own = [r for r in got if r.source == s]
        assert math.isclose(own[0].weight, (t / total) ** a / z, rel_tol=1e-6)
        passes = (big / t) ** (1 - a)
        placed = sum(r.n_tokens for r in own)
        assert passes * t - 1e-6 <= placed <= passes * t + 61
        assert {r.doc_id for r in own if r.epoch == 0} == {i for i, _, x in rows if x == s}
        assert all(n <= math.ceil(passes - 1e-6) for n in collections.Counter(r.doc_id for r in own).values())
    blocks = collections.defaultdict(list)
    for r in got:
        blocks[r.block].append(r)
    for b, held in blocks.items():
        assert sorted(r.position for r in held) == list(range(len(held)))
        if b < max(blocks) - 1:
            for s in tokens:
                assert abs(sum(r.n_tokens for r in held if r.source == s) - 5000 * next(r.weight for r in got if r.source == s)) <= 61


def test_exponent_for_entropy(spark):
    shares = spark.createDataFrame([("a", 800), ("b", 150), ("c", 50), ("d", 0)], "__s string, tokens bigint")
    a = mixing.exponent(shares, target_entropy=0.9)

    def entropy(a):
        q = [x**a for x in (0.8, 0.15, 0.05)]
        return -sum(x / sum(q) * math.log(x / sum(q)) for x in q) / math.log(3)

    assert entropy(a) >= 0.9 - 1e-9 and entropy(a + 1e-6) < 0.9 + 1e-6
    assert mixing.exponent(shares.where("tokens < 0")) == 1.0
    assert mixing.exponent(shares.where("tokens = 800")) == 0.0


# --- language model ----------------------------------------------------------------------------------


def test_scores(make):
    got = {r.doc_id: r for r in lm_scoring.scored(make(UNIQUE)).collect()}
    tokens = {i: words(lowered(t or "")) + [" "] for i, t in UNIQUE}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = collections.Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    known = {w for w, c in counts.items() if c >= 2}
    pairs, triples = collections.Counter(), collections.Counter()
    texts = [["<s>", *tokens[i]] for i in tokens if not held[i]]
    for s in texts:
        pairs.update(p for p in zip(s, s[1:]) if (p[0] in known or p[0] == "<s>") and p[1] in known)
    pairs = {p: c for p, c in pairs.items() if c >= 2}
    for s in texts:
        triples.update(t for t in zip(s, s[1:], s[2:]) if t[:2] in pairs and t[1:] in pairs)
    triples = {t: c for t, c in triples.items() if c >= 2}
    one = lambda w: (counts[w] + 0.1) / (n + 0.1 * (v + 1))
    after = lambda a: len(texts) if a == "<s>" else counts[a]

    def two(a, w):
        if (a, w) in pairs:
            return (pairs[a, w] - 0.5) / after(a)
        seen = [(b, c) for (x, b), c in pairs.items() if x == a]
        return one(w) * (1 - sum((c - 0.5) / after(a) for _, c in seen)) / (1 - sum(one(b) for b, _ in seen))

    def three(a, b, w):
        if (a, b, w) in triples:
            return (triples[a, b, w] - 0.5) / pairs[a, b]
        seen = [(x, c) for (p, q, x), c in triples.items() if (p, q) == (a, b)]
        weight = (1 - sum((c - 0.5) / pairs[a, b] for _, c in seen)) / (1 - sum(two(b, x) for x, _ in seen)) if seen else 1
        return weight * two(b, w)

    assert len(got) == len(UNIQUE)
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10(one(x)) for x in w), rel_tol=1e-9)
        if len(w) < 500:
            s = ["<s>", *w]
            want = math.log10(two("<s>", w[0])) + sum(math.log10(three(*t)) for t in zip(s, s[1:], s[2:]))
            assert math.isclose(r.score, want, rel_tol=1e-9)


def test_pieces_make_no_difference(monkeypatch):
    rng = random.Random(1)
    seq = np.array([-1 if x == 5 else x for x in (rng.randint(0, 5) for _ in range(400))])
    pairs = np.unique([rng.randint(0, 4) * 6 + rng.randint(0, 4) for _ in range(12)])
    triples = np.unique([p * 6 + q % 6 for p in pairs for q in pairs if p % 6 == q // 6])
    a = lm_scoring.Automaton(np.full(5, 100), 10, 600, 6, pairs, np.full(len(pairs), 20), triples, np.full(len(triples), 3))
    lengths = np.array([1, 9, 250, 140])
    want = a.traverse(seq, lengths)
    monkeypatch.setattr(lm_scoring, "PIECE", 3)
    assert np.allclose(a.traverse(seq, lengths), want)


@pytest.mark.parametrize("min_count", [1, 2, 3])
def test_scores_do_not_depend_on_chunks(make, monkeypatch, min_count):
    table = make(ROWS)
    order = lambda rows: sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))
    want = order(lm_scoring.scored(table, min_count=min_count).collect())
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 9_000)
    got = order(lm_scoring.scored(table, min_count=min_count).collect())
    assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_rare_grams_stay_in_a_large_corpus(make):
    """Words, pairs and triples seen twice among six million tokens."""
    trained = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10][:32]
    rows = [(i, "a " * 200_000) for i in trained[2:]] + [(i, "rare words stand") for i in trained[:2]]
    got = {r.doc_id: r.score for r in lm_scoring.scored(make(rows)).where(F.col("doc_id").isin(trained[:2])).collect()}
    want = math.log10(1.5 / 32) + 3 * math.log10(1.5 / 2)
    assert all(math.isclose(got[i], want, rel_tol=1e-9) for i in trained[:2]), (got, want)


def test_rounds_of_scores_take_little_room(spark, tmp_path, monkeypatch):
    """What is kept between the rounds, over a text with many rare words."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"word{int(rng.paretovariate(0.7)) % 50_000}" for _ in range(400))) for i in range(500)]
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 200_000)
    for module in lm_scoring, common:
        monkeypatch.setattr(module, "scratch_path", lambda spark, name: tempfile.mkdtemp(prefix=name, dir=tmp_path) + "/kept")
    lm_scoring.scored(spark.createDataFrame(rows, "doc_id bigint, text string"))
    kept, size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")), sum(len(t) for _, t in rows)
    assert 0 < kept < 0.3 * size, kept / size  # 0.38 when weights were kept as doubles and keys were hashes


def test_scores_of_many_pairs_with_one_next_word(make):
    """Twelve thousand pairs that all end their texts: their triples differ in the number of the pair alone."""
    many, each = 3000, 4
    distinct = [f"u{i} v{(i * each + t) % many}" for i in range(many) for t in range(each)]
    trained = [i for i in range(40_000) if zlib.crc32(str(i).encode()) % 10][: 2 * len(distinct)]
    got = lm_scoring.scored(make(list(zip(trained, distinct * 2)))).collect()
    want = math.log10((2 * each - 0.5) / len(trained)) + math.log10(1.5 / (2 * each)) + math.log10(1.5 / 2)
    assert len(got) == len(trained) and np.allclose([r.score for r in got], want, rtol=1e-9)


@pytest.mark.parametrize("bits", [24, 33, 46, 63, 64])
def test_keys_of_scores_are_mixed_one_to_one(bits):
    some = np.random.default_rng(1).integers(0, 2**bits, 50_000, np.uint64)
    codes = np.unique(np.concatenate([some, np.arange(50_000, dtype=np.uint64), np.uint64(2**bits - 1) - np.arange(50_000, dtype=np.uint64)]))
    keys = np.unique(lm_scoring._spread(codes, bits))
    assert len(keys) == len(codes)
    assert (lm_scoring._ungapped(lm_scoring._gaps(keys)) == keys).all()
    assert np.bincount((keys >> np.uint64(61)).astype(int), minlength=8).min() > len(keys) / 16


def test_numbers_of_scores_come_back():
    for numbers in ([], [0], [7, 0, 2**40, 2**64 - 1, 1]):
        assert lm_scoring._unpacked(lm_scoring._packed(np.array(numbers, np.uint64))).tolist() == numbers


# --- pages -----------------------------------------------------------------------------------------------


PAGE = """<html><head><title>T</title><style>p {}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a>One</a><a>Two</a></nav>
<div class="cookie-notice">We use cookies on this site to make it better for you and everyone, accept them please.</div>
<div id="wrap"><div class="text"><h1>Title here</h1><p>A long paragraph of words that goes\n on and on &amp; tells a story, with <a href=x>links</a> inside of it.</p><p>Short.</p>
<div class="ad">Buy now the best product in the world, it is cheap and good for all.</div><script>if (a < b) { "</p>" }</script>
<p>Another long paragraph that goes on &eacute;v&#101;n longer<br>than the first one did, which is fine.</p><ul><li>item one<li>item two</ul></div>
<aside>Side bar text that is long enough to be a paragraph of its own, but is not content.</aside></div>
<section class="comments"><h2>Comments</h2><article><p>I think this is a great article, thanks for writing it, greetings from Spain.</p></article></section>
<form><label>Name</label><input name=a></form><footer>Copyright</footer></body></html>"""
TEXT = """Title here
A long paragraph of words that goes on and on & tells a story, with links inside of it.
Short.
Another long paragraph that goes on éven longer than the first one did, which is fine.
item one
item two"""


def test_main_text(spark):
    article = f"<body><nav>Menu</nav><article>{'<p><b>Only.<br><p>More of it</p>'}</article><div>{'Elsewhere. ' * 9}</div><foo"
    pages = [(1, PAGE), (2, article), (3, ""), (4, None), (5, "<!-- x"), (6, "plain words"), (7, PAGE.replace("Short.", "Long. " * 50_000))]
    got = {r.page_id: r.text for r in spark.createDataFrame(pages, "page_id bigint, html string").select("page_id", html_text.extracted(F.col("html")).alias("text")).collect()}
    assert got == {1: TEXT, 2: "Only.\nMore of it", 3: "", 4: "", 5: "", 6: "plain words", 7: TEXT.replace("Short.", " ".join(["Long."] * 50_000))}


def test_warc(spark):
    big, other = "<p>" + "é" * 600, "x" * 999
    pages = [(1, "http://www.B.example.com:80/a?x=1", big), (2, "https://a.example.org", big), (3, None, big), (4, "http://b.example.com/a", other), (5, "http://b.example.com/a", other),
             (6, "bad url://[", None), (7, "http://b.example.com/a", ""), (8, "http://t\tab.example/é\n", "a\r\n\r\nb"), (None, "http://n.example", "n"), (9, "http://b.example.com/a", "y" * 200_000), (9, "http://b.example.com/a", "y" * 200_000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    folder, captures, parts = warc.written(df)
    got = warc.fetched(folder, parts, df).collect()
    assert len(got) == len(pages) == captures.count()
    for i, url, html in pages:
        body = (html or "").encode()
        r = [x for x in got if x.page_id == i][0]
        refers = 3 if i in (1, 2) else None
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(body), hashlib.sha1(body).hexdigest())
        assert (r.record_type, r.refers_to) == ("revisit" if refers else "response", refers)
        assert (bytes(r.payload) if r.payload is not None else None) == (None if refers else body)
    assert warc.fetched(folder, parts, spark.createDataFrame([("http://none.example", 1), ("http://b.example.com/a", 4)], "url string, page_id bigint")).count() == 1


def test_url_keys():
    assert [warc.url_key(u) for u in ("http://www.Example.com/A?b=1#c", "https://x.y.example.org:8443", "example.com/p", "", None)] == [
        "com,example)/A?b=1", "org,example,y,x:8443)/", "com,example)/p", ")", ")"]


def test_index_over_several_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "PART_LINES", 20)
    pages = [(i, f"http://h{i % 7}.example.com/{'same' if i % 3 else i}", f"page {i}") for i in range(100)] + [(500, "http://h1.example.com/same", "again")] * 30
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    folder, _, parts = warc.written(df)
    assert parts.count() > 1
    got = warc.fetched(folder, parts, df).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == sorted((i, h) for i, _, h in pages)


# --- quality ---------------------------------------------------------------------------------------------


def test_statistics(make):
    got = quality_rules.statistics(make(UNIQUE)).collect()
    assert len(got) == len(UNIQUE)
    texts = dict(UNIQUE)
    for r in got:
        w, text = words(texts[r.doc_id]), texts[r.doc_id] or ""
        lines = [x for x in text.split("\n") if words(x)]
        triples = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_outliers(spark):
    rng = random.Random(6)
    clean = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.randint(100, 99999)}" + rng.choice(["", "", "", ","]) for _ in range(rng.randint(80, 200))), "en", rng.choice("pqr")) for i in range(600)]
    junk = [(1000 + i, " ".join(f"{rng.randint(100, 99999)}{rng.choice(['###', '$$$', '%%%'])}" for _ in range(120)), "en", "p") for i in range(40)]
    few = [(2000 + i, clean[i][1], None, None) for i in range(5)] + [(3000, None, None, "p"), (3001, "", "en", "p")]
    docs = spark.createDataFrame(clean + junk + few, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.keep_documents(docs).collect()}
    assert kept == {r[0] for r in clean + few[:5]}


def test_scatter_against_numpy(spark):
    """The whole sample's Cholesky factor and distances, as the steps compute them."""
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6)) * 64) / 64
    names = [f"__{a}" for a in quality_rules.AXES]
    rows = spark.createDataFrame([("c", *map(float, r)) for r in x], "__cell string, " + ", ".join(f"`{n}` double" for n in names))
    first = quality_rules._first_estimate(rows)
    step = quality_rules._concentrated(rows, first)
    d0 = np.array([r["__d2"] for r in quality_rules._measured(rows, first).collect()])
    scale = (np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349
    floor = np.array(list(quality_rules.FLOOR.values()))
    assert np.allclose(d0, (((x - np.median(x, axis=0)) ** 2) / (scale**2 + floor**2)).sum(axis=1))
    bins = np.floor(np.log2(np.maximum(d0, 2.0**-10)) * quality_rules.BINS_PER_DOUBLING)
    cut = np.sort(bins)[math.ceil(0.75 * 500) - 1]
    near = x[bins <= cut]
    cov = quality_rules.consistency(0.75, 6) * np.cov(near.T, bias=True) + np.diag(floor**2)
    e = x - near.mean(axis=0)
    got = np.array([r["__d2"] for r in quality_rules._measured(rows, step).collect()])
    assert np.allclose(got, (e @ np.linalg.inv(cov) * e).sum(axis=1))


# --- odd tables ---------------------------------------------------------------------------------------------


ODD = "doc_id bigint, text string, lang string, source string, n_lines string, key int, id string, component_id string, chunk string, dropped_id string, n_words string, __id string, __cell string"
CALLS = {
    "lines": lambda d, s: line_dedup.drop_repeated_lines(d),
    "passages": lambda d, s: passage_dedup.remove_repeated_passages(d),
    "bytes": lambda d, s: suffix_dedup.remove_repeated_bytes(d),
    "jaccard": lambda d, s: jaccard_join.jaccard_components(d),
    "one_of_each": lambda d, s: jaccard_join.one_of_each(d),
    "leaks": lambda d, s: decontamination.drop_contaminated(d, s.createDataFrame([(1, None), (2, "a b c d e f g h i j")], "item_id int, text string")),
    "mixing": lambda d, s: mixing.mixture(d),
    "scores": lambda d, s: lm_scoring.scored(d),
    "quality": lambda d, s: quality_rules.judged(d),
    "keep": lambda d, s: quality_rules.keep_documents(d, cutoff=1e9),
}


@pytest.mark.parametrize("name", list(CALLS))
def test_odd_tables(spark, name):
    """Nulls in any column, repeated rows, clashing names: no row is lost but by the rule; empty tables give no rows."""
    rows = [(i, t, *[None] * 11) for i, t in ROWS]
    docs = spark.createDataFrame(rows, ODD)
    got = CALLS[name](docs, spark).collect()
    if name in ("lines", "passages", "bytes", "jaccard", "scores", "quality", "mixing"):
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    else:
        assert {r.doc_id for r in got} <= {r[0] for r in rows} and len(got) > 5
    if name in ("lines", "one_of_each", "leaks", "keep"):
        assert set(docs.columns) <= set(got[0].asDict())
    assert CALLS[name](docs.where("false"), spark).collect() == []


def test_articles_need_the_votes():
    story = [f"Paragraph {i} of the story, which goes on for long enough to be told from a menu or a teaser line." for i in range(8)]
    teasers = "".join(f"<article><a href=x>Other story {i} has a teaser that is rather long too, but it is one</a></article>" for i in range(2))
    page = "<html><body><div>" + "".join(f"<p>{x}</p>" for x in story) + f"</div>{teasers}</body></html>"
    assert set(story) <= set(html_text.main_text(page).split("\n"))
    page = "<html><body><nav><a>One</a></nav>" + "".join(f"<article><p>{x}</p></article>" for x in story) + "</body></html>"
    assert html_text.main_text(page).split("\n") == story


def test_silent_elements_end():
    story = "A paragraph of the story that is long enough to be told from the rest of the page."
    for page in (f"<html><head><title>T</title><meta name=a><p>{story}</p>", f"<head><title>T</title><body><p>{story}</p></body>", f"<div><svg class=icon /><p>{story}</p></div>",
                 f"<div><div><button>Buy</div><p>{story}</p></div>", f"<div><p><button>Buy</p><p>{story}</p></div>"):
        assert html_text.main_text(page) == story, page
    assert html_text.main_text(f"<div><svg><g><svg/></g><text>no</text></svg><p>{story}</p></div>") == story


def test_marked_wrappers_of_the_story():
    story = [f"Paragraph {i} of the story, which goes on for long enough to be told from a menu or a teaser line." for i in range(8)]
    page = "<body><nav>One</nav>" + "".join(f'<div class="elementor-widget-container"><p>{x}</p></div>' for x in story) + "<p>Short end</p></body>"
    assert set(story) <= set(html_text.main_text(page).split("\n"))
    page = f'<body><div class="text"><p>{"</p><p>".join(story)}</p></div><div class="widget"><p>{story[0].upper()}</p></div></body>'
    assert html_text.main_text(page).split("\n") == story


def test_pipeline_drops_documents_emptied_by_line_dedup(spark):
    import corpus_pipeline

    copy = "This line is long enough to be dropped\nand so is this one, which follows it\n"
    rows = [(i, copy) for i in range(5)] + [(5, copy + "own"), (6, ""), (7, None), (8, " \n"), (9, "short")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert {i: (t or "").strip() for i, t in got.items()} == {5: copy + "own", 6: "", 7: "", 8: "", 9: "short"}


def bm25_hits(docs, items, threshold, overlap):
    """Scores by a BM25 of its own: passages of twice the longest item, half a step apart."""
    split = {i: re.findall(r"\w+", (t or "").lower()) for i, t in items}
    split = {i: w for i, w in split.items() if len(w) >= 8}
    n, mean, step = len(split), sum(map(len, split.values())) / len(split), max(map(len, split.values()))
    df = collections.Counter(w for words in split.values() for w in set(words))
    texts, out = dict(items), {}

    def impact(i, w):
        f = split[i].count(w)
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(split[i]) / mean))

    for d, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        for p in range(0, len(words) // step * step + 1, step):
            here = words[p : p + 2 * step]
            for i, mine in split.items():
                score = sum(impact(i, w) for w in set(mine) & set(here)) / sum(impact(i, w) for w in set(mine))
                shares = []
                for half in decontamination.halves(texts[i]):
                    grams = {tuple(half[k : k + 5]) for k in range(max(1, len(half) - 4))} if half else set()
                    sizes = {len(g) for g in grams}
                    seen = {tuple(here[k : k + m]) for m in sizes for k in range(len(here) - m + 1)}
                    shares.append(len(grams & seen) / len(grams) if grams else 1.0)
                if score >= threshold - 1e-9 and min(shares) >= overlap:
                    out[d, i] = max(out.get((d, i), (0.0,)), (score, *shares))
    return out


@pytest.mark.parametrize("size", [4, 20_000])
def test_scores_do_not_depend_on_shards(spark, monkeypatch, size):
    monkeypatch.setattr(decontamination, "SHARD_ITEMS", size)
    rng = random.Random(12)
    items = [(i, " ".join(prose(rng, rng.randint(5, 12), 60).capitalize() + "." for _ in range(2))) for i in range(12)] + [(40, None), (41, "Too short"), (42, "")]
    docs = [(i, prose(rng, rng.randint(0, 120), 60)) for i in range(30)]
    docs += [(50 + i, f"{prose(rng, 20, 60)} {rng.choice(items[:12])[1]} {prose(rng, rng.randint(0, 60), 60)}") for i in range(25)]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for threshold, overlap in ((0.7, 0.8), (0.4, 0.0)):
        got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in decontamination.contaminated(*frames, threshold=threshold, overlap=overlap).collect()}
        want = bm25_hits(docs, items, threshold, overlap)
        assert got.keys() == want.keys() and len(want) > 15
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_links_of_an_id_with_several_texts(make, small_chunks):
    """All texts of an id are its own: what links with either is in its component; rows without an id stay alone."""
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(1, x), (1, y), (2, x + " more"), (3, y + " more"), (4, z), (5, y), (5, z), (9, "alone here"), (None, x), (None, z), (7, x), (7, x)]
    got = jaccard_join.jaccard_components(make(rows), length=3, percent=90).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 1), (9, 9), (None, None)}


def test_rows_of_one_id_are_spread(make):
    """With no id, or one id, rows go to as many chunks as wanted."""
    for i in (None, 5):
        corpus = chunks.Chunks(make([(i, f"text {k} " * 40) for k in range(200)]), "doc_id", "text", chunk_bytes=3000)
        assert corpus.n >= 20 and corpus.table.select("chunk").distinct().count() >= 0.9 * corpus.n


@pytest.mark.parametrize("call", ["passages", "bytes"])
def test_repeats_of_rows_without_an_id(make, small_chunks, call):
    """Rows of one id in several chunks: of each passage one copy is kept, whichever chunk comes first."""
    rng = random.Random(7)
    shared = [prose(rng, 50, 100_000) for _ in range(3)]
    rows = [(None, f"{prose(rng, 60, 100_000)} {shared[k % 3]} {prose(rng, 60, 100_000)}") for k in range(60)]
    run = passage_dedup.remove_repeated_passages if call == "passages" else suffix_dedup.remove_repeated_bytes
    kept = [r[1] if isinstance(r[1], str) else bytes(r[1]).decode() for r in run(make(rows)).collect()]
    for passage in shared:
        middle = " ".join(passage.split()[20:30])
        assert sum(middle in t for t in kept) == 1


def _factor_of(x, near, floor):
    cov = quality_rules.consistency(0.75, 6) * np.cov(x[near].T, bias=True) + np.diag(floor**2)
    return x[near].mean(axis=0), cov


def test_least_determinant_against_numpy(spark):
    """The estimate of a cell with a fifth of outliers: the least determinant over three starts, steps as by hand."""
    rng = np.random.default_rng(3)
    clean = rng.normal(size=(480, 6)) @ rng.normal(size=(6, 6))
    x = np.round(np.vstack([clean, clean[:120] * 0.05 + 12 * np.sign(rng.normal(size=(120, 6)))]) * 64) / 64
    names = [f"__{a}" for a in quality_rules.AXES]
    rows = spark.createDataFrame([("c", *map(float, r)) for r in x], "__cell string, " + ", ".join(f"`{n}` double" for n in names))
    floor = np.array(list(quality_rules.FLOOR.values()))
    m, scale = np.median(x, axis=0), np.sqrt(((np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349) ** 2 + floor**2)
    z = (x - m) / scale
    u = z / np.sqrt((z**2).sum(axis=1, keepdims=True) + 1e-12)
    shapes = [np.diag(scale**2 - floor**2), np.round(np.corrcoef(np.tanh(z).T), 6) * np.outer(scale, scale), np.round(6 * u.T @ u / len(x), 6) * np.outer(scale, scale)]
    starts = quality_rules._starts(rows, quality_rules._first_estimate(rows))
    log_det = {r.start: r.d for r in starts.select("start", quality_rules._log_determinant().alias("d")).collect()}
    found = []
    for k, shape in enumerate(shapes):
        mean, cov = m, shape + np.diag(floor**2)
        assert log_det[k] == pytest.approx(np.linalg.slogdet(cov)[1], abs=1e-4)
        for step in range(quality_rules.STEPS):
            d = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1)
            bins = np.floor(np.log2(np.maximum(d, 2.0**-10)) * quality_rules.BINS_PER_DOUBLING)
            mean, cov = _factor_of(x, bins <= np.sort(bins)[math.ceil(0.75 * len(x)) - 1], floor)
            if step + 1 == quality_rules.TRIAL_STEPS:
                found.append((np.linalg.slogdet(cov)[1], k))
    got = quality_rules._estimated(rows)
    least = got.select(quality_rules._log_determinant().alias("d")).collect()[0].d
    assert least <= min(found)[0] + 1e-6
    distance = np.array([r["__d2"] for r in quality_rules._measured(rows, got).select("__d2").collect()])
    assert distance[480:].min() > 40 and (distance[:480] < 40).mean() > 0.97
