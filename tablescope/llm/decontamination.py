"""Benchmark decontamination: training passages against an index of test items.

Method: the items form a BM25 inverted index, its postings cut into blocks that know their largest impact.  Every
passage of every document is a query; block-max WAND finds all items that score above the threshold (impacts are divided
by the item's score for its own text, so the threshold is a share of it).  A hit counts once both halves of the item, the
question (all sentences but the last) and the answer (the last one), overlap the passage in five-word shingles.

Passages have twice the words of the longest item and step by half, so an item's text always lies whole in one passage.
Passages in which no item can reach the threshold, given its rare terms there and all of its frequent ones, are found for
a whole batch at once and left before the traversal.

The index is sent to the tasks in shards of about ``SHARD_ITEMS`` items, dealt by a hash, of at most ``ITEM_WORDS`` words each;
more items mean more passes over the documents, one after the other.  What scores depend on beyond an item (how many items hold
a term, their number and mean length, the length of passages) is counted over all items by Spark first, so hits and scores are
the same however the items are dealt.  The driver holds one shard at a time.  Longer items are searched as pieces of equal size; where one is found, the whole item is
scored and its question and answer compared in the passages of twice the item's words around it.  Terms are words of letters
and digits in lower case.  Items with fewer than ``min_words`` terms share too few terms to be ranked: with ``short`` they
are found where a document has all of their terms, question and answer, one after the other, by a trie over the
documents' terms; without it they are not searched.  Null texts have no terms.  Equal items are each found; rows with the same id report one best row for each item.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

SHARD_ITEMS = 20_000
ITEM_WORDS = 400
BLOCK = 16  # postings per block
SHINGLE = 5
RARE = 32  # postings up to which a term counts as rare
PIECE_BYTES, MOST_WORDS = 2_000_000, 400_000  # text handled at once, written words remembered
_TERM = re.compile(r"\w+")


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


def shingles(words: list) -> set[tuple]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def halves(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: all sentences but the last, and the last; one sentence is cut in the middle."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n", text) if _TERM.search(p)]
    if len(parts) > 1:
        return terms(" ".join(parts[:-1])), terms(parts[-1])
    words = terms(text)
    return words[: len(words) // 2], words[len(words) // 2 :]


def pieces(words: list) -> list[list]:
    """An item's terms, cut into as few equal pieces as ``ITEM_WORDS`` allows."""
    n = max(1, -(-len(words) // ITEM_WORDS))
    return [words[k * len(words) // n : (k + 1) * len(words) // n] for k in range(n)]


class Statistics(NamedTuple):
    """Of all items, whatever their shard: pieces, their mean and largest number of terms, and how many hold a term."""

    n: int
    mean: float
    longest: int
    holders: dict[str, int]

    @classmethod
    def of(cls, docs: list[list[str]]) -> Statistics:
        holders = Counter(w for words in docs for w in set(words))
        return cls(len(docs), sum(map(len, docs)) / max(1, len(docs)), max(map(len, docs), default=1), holders)


class Index:
    """Postings of one shard: per term, item numbers, impacts and block maxima.  Made of plain lists, sets and dicts."""

    def __init__(self, items: list[tuple[object, str]], k1: float = 1.2, b: float = 0.75, short: list[tuple[object, str]] = (), known: Statistics | None = None):
        self.ids, docs, self.halves, self.whole = [], [], [], []
        for i, t in items:
            words, both = terms(t), tuple(map(shingles, halves(t)))
            cut = pieces(words)
            whole = [len(words), {}, len(docs)] if len(cut) > 1 else None  # terms, raw impact of each, first piece
            for piece in cut:
                self.ids.append(i)
                docs.append(piece)
                self.halves.append(both)
                self.whole.append(whole)
        all_n, mean, self.longest, holders = known or Statistics.of(docs)
        n = len(docs)
        counts: dict[str, dict[int, int]] = {}
        for at, words in enumerate(docs):
            for w in words:
                counts.setdefault(w, {}).setdefault(at, 0)
                counts[w][at] += 1
        impact = {
            w: {at: math.log(1 + (all_n - holders[w] + 0.5) / (holders[w] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(docs[at]) / mean)) for at, f in of.items()}
            for w, of in counts.items()
        }
        own = [0.0] * n
        for w, of in impact.items():
            for at, x in of.items():
                own[at] += x
                if self.whole[at]:
                    self.whole[at][1][w] = self.whole[at][1].get(w, 0.0) + x
        self.number = {w: k for k, w in enumerate(impact)}
        self.items, self.impacts, self.block_max, self.term_max = [], [], [], []
        for of in impact.values():
            at = sorted(of)
            x = [of[i] / own[i] for i in at]
            self.items.append(at)
            self.impacts.append(x)
            self.block_max.append([max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)])
            self.term_max.append(max(x))
        self.ranked = len(self.number)  # terms from here on are those of short items alone, without postings
        self.short_ids, self.short = [i for i, _ in short], [[self.number.setdefault(w, len(self.number)) for w in terms(t)] for _, t in short]

    @classmethod
    def again(cls, state: dict) -> Index:
        """The index of a sent state, in a task."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        index.arrays()
        return index

    def arrays(self) -> None:
        """Postings as arrays, for the bound on whole batches of passages; made where they are used."""
        import numpy as np

        sizes = [len(x) for x in self.items]
        self.posting_ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
        self.posting_item = np.array([i for x in self.items for i in x], dtype=np.int64)
        self.posting_impact = np.array([i for x in self.impacts for i in x])
        self.rare = np.array([*(n <= RARE for n in sizes), *[False] * (len(self.number) - self.ranked), False])  # the last one for number -1
        frequent = np.repeat(~self.rare[: self.ranked], sizes)
        self.frequent_share = np.bincount(self.posting_item[frequent], self.posting_impact[frequent], len(self.ids))
        # the trie of short items: by depth, sorted keys of (node above, term), and the items that end at each node
        nodes, self.trie = {(): 0}, []
        for depth in range(1, max(map(len, self.short), default=0) + 1):
            heads = sorted({(nodes[tuple(w[: depth - 1])], w[depth - 1], tuple(w[:depth])) for w in self.short if len(w) >= depth})
            nodes |= {head: k for k, (_, _, head) in enumerate(heads)}
            ends = [[] for _ in heads]
            for k, w in enumerate(self.short):
                if len(w) == depth:
                    ends[nodes[tuple(w)]].append(k)
            self.trie.append((np.array([above * len(self.number) + t for above, t, _ in heads], dtype=np.int64), ends))

    def search(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) with score at or above the threshold, by block-max WAND."""
        end, found = len(self.ids), []
        cursors = [[self.items[t][0], 0, t] for t in query]  # item, place, term
        while True:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, (item, _, t) in enumerate(cursors):
                if item == end:
                    break
                bound += self.term_max[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # the blocks that hold the pivot item
            bound, after = 0.0, end
            for _, place, t in cursors[: pivot + 1]:
                p = bisect_left(self.items[t], item, place)
                if p < len(self.items[t]):
                    bound += self.block_max[t][p // BLOCK]
                    last = min(len(self.items[t]), (p // BLOCK + 1) * BLOCK)
                    after = min(after, self.items[t][last] if last < len(self.items[t]) else end)
            if bound < threshold:  # no item before the first block end can reach it
                if pivot + 1 < len(cursors):
                    after = min(after, cursors[pivot + 1][0])
                self._forward(cursors[: pivot + 1], max(after, item + 1))
            elif cursors[0][0] == item:
                score = sum(self.impacts[t][place] for _, place, t in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                self._forward(cursors[: pivot + 1], item + 1)
            else:
                self._forward(cursors[: pivot + 1], item)

    def _forward(self, cursors: list[list[int]], to: int) -> None:
        for c in cursors:
            if c[0] < to:
                c[1] = bisect_left(self.items[c[2]], to, c[1])
                c[0] = self.items[c[2]][c[1]] if c[1] < len(self.items[c[2]]) else len(self.ids)


class _Words:
    """Codes of written words, and the term numbers (-1 outside the index) that each code stands for."""

    def __init__(self, index: Index):
        self.number, self.codes, self.flat, self.starts = index.number, {}, [], [0]

    def code(self, word: bytes) -> int:
        found = self.codes.get(word)
        if found is None:
            found = self.codes[word] = len(self.codes)
            self.flat += [self.number.get(t, -1) for t in terms(word.decode("utf-8", "replace"))]
            self.starts.append(len(self.flat))
        return found

    def terms_of(self, coded: list[list[int]]):
        """For texts as lists of codes: term numbers in order, and the end of each text in them."""
        import numpy as np

        starts, flat = np.asarray(self.starts), np.asarray(self.flat, dtype=np.int64)
        codes = np.concatenate([np.asarray(c, dtype=np.int64) for c in coded])
        n = (starts[1:] - starts[:-1])[codes]
        ends = np.cumsum(n)
        at = np.arange(n.sum()) - np.repeat(ends - n, n) + np.repeat(starts[codes], n)
        sizes = np.cumsum([len(c) for c in coded])
        return flat[at], np.concatenate([[0], ends])[sizes]


def _open_passages(index: Index, numbers, ends, threshold: float):
    """(text, passage) pairs in which some item can reach the threshold: its frequent terms as if all were there, and
    those of its rare terms (up to ``RARE`` postings) that are.  Passage p has the terms from p * step on, 2 * step of them."""
    import numpy as np

    step, n = index.longest, len(ends)
    lengths = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(n), lengths)
    base = np.concatenate([[0], np.cumsum(lengths // step + 1)])  # first passage of each text
    place = np.flatnonzero(index.rare[numbers] & (numbers >= 0))
    number, text, at = numbers[place], text[place], place - (ends - lengths)[text[place]]
    order = np.lexsort((at, number, text))
    previous = np.full(len(place), -1, dtype=np.int64)
    same = (number[order][1:] == number[order][:-1]) & (text[order][1:] == text[order][:-1])
    previous[order[1:][same]] = at[order[:-1][same]]
    keys, weights = [], []
    for shift in (0, 1):
        p = at // step - shift
        first = (p >= 0) & (previous < p * step)  # a term counts once in a passage
        t, p = number[first], p[first] + base[text[first]]
        m = index.posting_ends[t + 1] - index.posting_ends[t]
        posting = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(index.posting_ends[t], m)
        keys.append(np.repeat(p, m) * len(index.ids) + index.posting_item[posting])
        weights.append(index.posting_impact[posting])
    pairs, where = np.unique(np.concatenate(keys), return_inverse=True)
    reach = np.bincount(where, np.concatenate(weights), len(pairs)) + index.frequent_share[pairs % max(1, len(index.ids))]
    found = np.unique(pairs[reach >= threshold] // max(1, len(index.ids)))
    owner = np.searchsorted(base, found, side="right") - 1
    if index.frequent_share.max(initial=0.0) >= threshold:  # an item of frequent terms alone: every passage is open
        owner = np.repeat(np.arange(n), np.diff(base))
        found = np.arange(base[-1])
    return owner, found - base[owner]


def _short_hits(index: Index, numbers, ends) -> set[tuple]:
    """(text, short item) pairs in which the text has the item's terms one after the other."""
    import numpy as np

    found, node, at = set(), np.zeros(len(numbers), dtype=np.int64), np.arange(len(numbers))
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    for depth, (keys, items) in enumerate(index.trie):
        inside = at + depth < ends[text[at]]
        at, node = at[inside], node[inside]
        known = numbers[at + depth] >= 0
        at, node = at[known], node[known]
        key = node * len(index.number) + numbers[at + depth]
        node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[node] == key
        at, node = at[hit], node[hit]
        last = np.array([bool(x) for x in items])[node]
        for k, n in np.unique(np.stack([text[at[last]], node[last]]), axis=1).T.tolist():
            found |= {(k, i) for i in items[n]}
    return found


def _whole_hits(index: Index, at: int, words: list[str], start: int, stop: int, threshold: float, overlap: float, seen: tuple):
    """Score and overlaps of the whole item of piece ``at`` in its own passages that meet ``start`` to ``stop``."""
    n, impact, first = index.whole[at]
    for q in range(max(0, start // n - 1), min(stop, len(words)) // n + 1):
        if (seen[0], first, q) in seen[1]:
            continue
        seen[1].add((seen[0], first, q))
        here = words[q * n : (q + 2) * n]
        score = sum(impact.get(w, 0.0) for w in set(here)) / sum(impact.values())
        if score < threshold - 1e-9:
            continue
        sizes = {len(g) for half in index.halves[at] for g in half}
        grams = {tuple(here[i : i + m]) for m in sizes for i in range(len(here) - m + 1)}
        shares = [len(half & grams) / len(half) if half else 1.0 for half in index.halves[at]]
        if min(shares) >= overlap:
            yield score, *shares


def _best_hits(body: list[bytes], index: Index, words: _Words, threshold: float, overlap: float) -> list[tuple]:
    """(text, item id, score, question overlap, answer overlap): the best passage of each text for each item."""
    split = [t.split() for t in body]
    coded = [list(map(words.codes.get, t)) for t in split]
    numbers, ends = words.terms_of([list(map(words.code, t)) if None in c else c for c, t in zip(coded, split)])
    best: dict[tuple, tuple] = {}
    step, ready, judged = index.longest, (-1, []), set()
    for k, p in zip(*(x.tolist() for x in _open_passages(index, numbers, ends, threshold - 1e-9))):
        begin = int(ends[k - 1]) if k else 0
        query = sorted(t for t in set(numbers[begin + p * step : min(begin + (p + 2) * step, int(ends[k]))].tolist()) if 0 <= t < index.ranked)
        found = index.search(query, threshold - 1e-9)
        if not found:
            continue
        if ready[0] != k:
            ready = k, [t for w in split[k] for t in terms(w.decode("utf-8", "replace"))]
        for at, _ in found:
            if index.whole[at]:
                for hit in _whole_hits(index, at, ready[1], p * step, (p + 2) * step, threshold, overlap, (k, judged)):
                    best[k, index.whole[at][2]] = max(best.get((k, index.whole[at][2]), (0.0,)), hit)
        found = [x for x in found if not index.whole[x[0]]]
        here = ready[1][p * step : (p + 2) * step]
        sizes = {len(g) for at, _ in found for half in index.halves[at] for g in half}
        grams = {tuple(here[i : i + n]) for n in sizes for i in range(len(here) - n + 1)}
        for at, score in found:
            shares = [len(half & grams) / len(half) if half else 1.0 for half in index.halves[at]]
            if min(shares) >= overlap:
                best[k, at] = max(best.get((k, at), (0.0,)), (score, *shares))
    hits = [(k, index.ids[at], *score) for (k, at), score in best.items()]
    return hits + [(k, index.short_ids[at], 1.0, 1.0, 1.0) for k, at in sorted(_short_hits(index, numbers, ends))]


def _search(shard, threshold: float, overlap: float):
    def run(batches):
        import pyarrow as pa

        index = Index.again(shard.value)
        words = _Words(index)
        for batch in batches:
            ids, body, found, first, size = batch.column(0), texts(batch.column(1)), [], 0, 0
            for k, text in enumerate(body):
                size += len(text)
                if size >= PIECE_BYTES or k + 1 == len(body):
                    found += [(first + h[0], *h[1:]) for h in _best_hits(body[first : k + 1], index, words, threshold, overlap)]
                    first, size = k + 1, 0
                    if len(words.codes) > MOST_WORDS:
                        words = _Words(index)
            columns = [pa.array([h[i] for h in found], pa.float64()) for i in (2, 3, 4)]
            rows = pa.array([h[0] for h in found], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array([h[1] for h in found], run.kind), *columns], ["id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def _counted(min_words: int):
    """Rows ``(shard, term, pieces that hold it)``, and for each shard without a term: pieces, their terms, the longest."""

    def run(batches):
        import pyarrow as pa

        holders, sizes = Counter(), {}
        for batch in batches:
            for shard, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms(t)
                for piece in pieces(words) if len(words) >= min_words else ():
                    holders.update((shard, w) for w in set(piece))
                    n, total, longest = sizes.get(shard, (0, 0, 0))
                    sizes[shard] = n + 1, total + len(piece), max(longest, len(piece))
        rows = [(k, w, n, 0, 0) for (k, w), n in holders.items()] + [(k, None, *v) for k, v in sizes.items()]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for at in range(0, len(rows), 100_000):
            columns = zip(*rows[at : at + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["shard", "term", "n", "total", "longest"])

    return run


def contaminated(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", *,
    threshold: float = 0.7, overlap: float = 0.8, min_words: int = 8, short: bool = False,
) -> DataFrame:
    """Rows ``(id, item_id, score, question_overlap, answer_overlap)``, one for each document and item found in it."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kinds = docs.schema[id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    kind = f"id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double"
    narrow = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    listed = stored(items.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).where("t IS NOT NULL"), "items")
    shards = max(1, math.ceil(listed.count() / SHARD_ITEMS))
    listed = listed.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(shards)))
    rows = listed.select("shard", "t").mapInArrow(_counted(min_words), "shard bigint, term string, n bigint, total bigint, longest bigint")
    counts = stored(rows.groupBy("shard", "term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("longest").alias("longest")), "item-terms")
    sizes = counts.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.max("longest"), F.lit(1))).first()
    holders = counts.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    passes = []
    for k in range(shards):
        mine = counts.where((F.col("shard") == k) & F.col("term").isNotNull()).select("term")
        known = dict(holders.join(mine, "term").collect()) if shards > 1 else dict(holders.collect())
        known = Statistics(sizes[0], sizes[1] / max(1, sizes[0]), sizes[2], known)
        held = sorted(((r.i, r.t) for r in listed.where(F.col("shard") == k).select("i", "t").collect()), key=lambda x: (x[1], str(x[0])))
        long = [(i, t) for i, t in held if len(terms(t)) >= min_words]
        phrases = [(i, t) for i, t in held if 0 < len(terms(t)) < min_words] if short else []
        sent = spark.sparkContext.broadcast(Index(long, short=phrases, known=known).__dict__)
        run = _search(sent, threshold, overlap)
        run.kind = to_arrow_type(items.schema[item_id].dataType)
        found = narrow.mapInArrow(run, kind)
        if shards > 1:  # one index at a time, here and in the executors
            found = stored(found, "item-hits")
            sent.unpersist()
        passes.append(found)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return reduce(DataFrame.union, passes).groupBy("id", "item_id").agg(best).select(F.col("id").alias(id), F.col("item_id"), "best.*")


def drop_contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no item, short ones too, was found, with their own columns."""
    found = contaminated(docs, items, id, text, **{"short": True} | options).select(F.col(id).alias("__id")).distinct()
    return docs.join(found, docs[id].eqNullSafe(found["__id"]), "left_anti")
