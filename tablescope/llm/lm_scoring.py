"""Language-model scoring with a weighted backoff automaton.

Words, pairs and triples of words are counted over all training documents; pairs and triples seen ``min_count`` times are
the model's arcs, at every size of the corpus.  The model is never in one place.  Documents are dealt to chunks, which
code their words once, and the chunks ask buckets of keys in four rounds:

1. how often the corpus holds each of the chunk's words, told apart by 64-bit hashes; a word of ``min_count`` gets a number,
2. how often it holds the pairs of such words; their keys are the two numbers, mixed one-to-one, and arcs get numbers,
3. how often it holds the triples whose two pairs are arcs, by the number of the first pair and that of the last word,
4. what the sums over the arcs of the chunk's contexts are, from which the backoff weights follow.  A bucket names the first
   of the chunks that hold an arc as its owner; a chunk sends, for each context, the sums over the arcs that it owns, and
   the bucket adds them up.

Keys go in ascending order as gaps, and numbers in planes of their bytes, compressed.  Answers are kept by chunk beside the
chunk's codes, so a later round moves neither.

With these answers a chunk builds the part of the automaton that its own texts can reach, whose size is that of the
chunk, and traverses it.  A context or n-gram that a third of all documents hold costs a bucket one entry per chunk.

States are the contexts: none, a word, two words.  An arc of a seen n-gram has its discounted probability; a state without
an arc for the next word follows its failure arc, which costs the context's backoff weight and leads to the shorter
context.  At the root every word has the smoothed unigram probability (c + 0.1) / (N + 0.1 * (V + 1)), also one that no
training document has; so probabilities of each context sum to one over known words and one unknown word.

A text is one traversal from the state "begin" to the token "end".  Traversals go in step over many texts at once; long
texts are entered again every ``PIECE`` tokens by reading the two tokens before, after which the state is the same.

Null or empty text is the end token alone.  Null ids count as the empty text for the split.  Repeated rows are scored each.
Without training documents N and V are 0 and all tokens have the same probability.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import chunks as C
from .common import total_bytes

MIN_COUNT = 2
DISCOUNT = 0.5
PIECE = 64
CHUNK_BYTES = 6_000_000  # text of a chunk
END = b" "  # no word has a blank
PAIR_CONTEXTS = 1 << 24  # first bucket of questions for pairs as contexts; those for words begin at 0
CODED = "chunk int, training bigint, rows binary, codes binary, hashes binary"
ANSWER = "chunk int, bucket int, said binary, ranks binary, n bigint, v bigint, most bigint"


def held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


class Texts(C.Chunks):
    """Chunks of rows with an id of any type, words as codes; rows are dealt by id and text, so null ids do not meet in
    one chunk.  The table has one row for each chunk."""

    def __init__(self, docs: DataFrame, id: str, text: str):
        spark = docs.sparkSession
        rows, size = total_bytes(docs, text)
        self.size, self.n = size, max(1, math.ceil(size / CHUNK_BYTES), math.ceil(rows / 200_000))
        body = F.col(text).cast("string")
        narrow = docs.select(F.pmod(F.xxhash64(F.col(id), body), F.lit(self.n)).cast("int").alias("chunk"), F.col(id).alias("id"), held_out(F.col(id)).alias("held_out"), body.alias("text"))
        self.tasks = min(self.n, max(1, math.ceil(size / C.TASK_BYTES)))
        self.table = self.kept(narrow.repartition(self.tasks, "chunk").groupBy("chunk").applyInArrow(_coded, CODED), "lm-chunks")

    def kept(self, rows: DataFrame, name: str) -> DataFrame:
        """A table that later rounds read chunk by chunk without moving it; ``rows`` are dealt by chunk."""
        spark, table = rows.sparkSession, f"lm_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").option("compression", "none").option("path", scratch_path(spark, name))
        writer.bucketBy(self.tasks, "chunk").saveAsTable(table)
        return spark.table(table)


def _packed(numbers) -> bytes:
    """First bytes of all numbers, then second bytes and so on, compressed: small counts and gaps take a part of their room."""
    import numpy as np
    import pyarrow as pa

    numbers = np.ascontiguousarray(numbers, "<u8")
    width = (int(numbers.max(initial=1)).bit_length() + 7) // 8
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(numbers).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(numbers) else b"")


def _unpacked(data: bytes):
    import numpy as np
    import pyarrow as pa

    width, n = data[0], int.from_bytes(data[1:9], "little")
    numbers = np.zeros((n, 8), np.uint8)
    if n:
        numbers[:, :width] = np.frombuffer(pa.decompress(memoryview(data)[9:], decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return numbers.view("<u8").ravel()


def _gaps(numbers) -> bytes:
    """Ascending numbers, by their differences."""
    import numpy as np

    numbers = np.asarray(numbers, np.uint64)
    return _packed(np.diff(numbers, prepend=np.zeros(1, np.uint64)))


def _ungapped(data: bytes):
    import numpy as np

    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _spread(codes, bits: int):
    """One-to-one on numbers of ``bits`` bits: evenly dealt keys, in the top bits of 64."""
    import numpy as np

    low = np.uint64(64 - bits)
    x = (codes.astype(np.uint64) << low) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(bits // 2) >> low << low
    return x * np.uint64(0xC4CEB9FE1A85EC53)


def _sent(chunk: int, first: int, bucket, keys, extra) -> list[tuple]:
    """Messages for keys that ascend within their buckets; ``extra`` has a row for each of the numbers that go with a key."""
    import numpy as np

    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=2**62)).tolist() if len(keys) else [0]
    return [(chunk, first + int(bucket[i]), _gaps(keys[i:j]), _packed(extra[:, i:j].ravel())) for i, j in zip(edges, edges[1:])]


def _asked(chunk: int, keys, bits: int, counts) -> list[tuple]:
    """How often do all chunks hold these keys, of which this one has ``counts``?"""
    import numpy as np

    order = np.argsort(keys)
    return _sent(chunk, 0, (keys[order] >> np.uint64(64 - bits)).astype(np.int64), keys[order], counts[order][None])


def _round(corpus: Texts, name: str, ask, judge) -> DataFrame:
    """``judge(keys, extra, order, starts)`` gets all entries of a bucket, the order that sorts them by key and the starts of
    equal keys in it; it returns one row or more of numbers with one for each entry, which of them have ranks, these, and
    the bucket's ``n, v, most``.  The answers are kept as a column of the chunks' table; the shuffle files of the round
    before can go, and the next one needs their room."""
    import gc

    def run(table):
        import numpy as np

        table = table.sort_by("chunk")
        chunks, buckets = table.column("chunk").to_pylist(), table.column("bucket").to_pylist()
        parts = [_ungapped(x) for x in table.column("keys").to_pylist()]
        more = [_unpacked(x).reshape(-1, len(p)) for x, p in zip(table.column("extra").to_pylist(), parts)]
        keys, extra = np.concatenate(parts), np.concatenate(more, axis=1)
        order = np.argsort(keys)
        ranked = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        said, kept, ranks, *numbers = judge(keys, extra, order, starts)
        back, rows = np.empty(len(order), np.int64), []
        back[order] = np.arange(len(order))
        end = 0
        for c, b, p in zip(chunks, buckets, parts):
            at, end = back[end : end + len(p)], end + len(p)
            rows.append((c, b, _packed(said[:, at].ravel()), _gaps(ranks[at[kept[at]]]), *numbers))
            numbers[:2] = 0, 0  # those of the bucket are told once
        return C.as_table(rows, ANSWER)

    spark = corpus.table.sparkSession
    answers = corpus.map(lambda table, _: C.as_table(ask(table), C.MESSAGE), C.MESSAGE).groupBy("bucket").applyInArrow(run, ANSWER)
    listed = F.collect_list(F.struct("bucket", "said", "ranks")).alias(name)
    done = corpus.kept(answers.repartition(corpus.tasks, "chunk").groupBy("chunk").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.max("most").alias("most"), listed), f"lm-{name}")
    corpus.table = corpus.table.join(done.select("chunk", name).hint("merge"), "chunk", "left")  # both lie by chunk: nothing is moved
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return done


def _said(table, name: str, first: int = 0):
    """Answers to the questions of one kind in the order of their keys, and for those with ranks their ranks and buckets."""
    import numpy as np

    answers = table.column(name)[0].as_py() or []
    rows = sorted((x["bucket"] - first, x["said"], x["ranks"]) for x in answers if first <= x["bucket"] < first + (1 << 24))
    ranks = [_ungapped(r) for _, _, r in rows]
    none = np.zeros(0, np.uint64)
    return (
        [_unpacked(s) for _, s, _ in rows],
        np.concatenate([none, *ranks]),
        np.repeat(np.array([b for b, _, _ in rows], np.uint64), [len(r) for r in ranks]))


def _totals(min_count: int, words: bool):
    """Twice the sum of the chunks' counts, one more for the owner; 0 for pairs and triples that are no arcs.  Keys with
    ``min_count`` are numbered."""

    def judge(keys, extra, order, starts):
        import numpy as np

        n = np.add.reduceat(extra[0][order], starts)
        kept = n >= min_count
        sizes = np.diff(starts, append=len(order))
        said = np.repeat(np.where(kept | words, n * np.uint64(2), np.uint64(0)), sizes)
        first = order == np.repeat(np.minimum.reduceat(order, starts), sizes)  # the first chunk is the owner, however often this is run
        said += (first & np.repeat(kept, sizes)).astype(np.uint64)
        return said[None], np.repeat(kept, sizes), np.repeat(np.cumsum(kept) - kept, sizes), int(n.sum()), int((n > 0).sum()), int(kept.sum())

    return judge


def _sums(keys, extra, order, starts):
    import numpy as np

    none = np.zeros(len(order), np.int64)
    return np.repeat(np.add.reduceat(extra[:, order], starts, axis=1), np.diff(starts, append=len(order)), axis=1), none > 0, none, 0, 0, 0


def _weight(seen, lower):
    """Backoff weight, as log10, of contexts whose arcs have the probability ``seen``, and ``lower`` in the shorter context."""
    import numpy as np

    return np.log10(np.maximum(1 - seen, 1e-12) / np.maximum(1 - lower, 1e-12))


def _coded(table):
    """A chunk's texts one after the other as words and end; codes are given as words are met, END first."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    body = pc.fill_null(table.column("text").combine_chunks(), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(body))  # also empty words, at blanks on the ends
    words, at = pc.list_flatten(split), pc.list_parent_indices(split)
    filled = pc.greater(pc.binary_length(words), 0)
    words, n = words.filter(filled).dictionary_encode(), np.bincount(at.filter(filled).to_numpy(), minlength=len(body)) + 1
    known = [END, *words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)]
    codes, inside = np.zeros(n.sum(), np.uint64), np.ones(n.sum(), bool)
    inside[np.cumsum(n) - 1] = False
    codes[inside] = words.indices.to_numpy() + 1
    held = table.column("held_out")
    rows = pa.table([table.column("id"), held, pa.array(n, pa.int64())], names=["id", "held_out", "n_tokens"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_table(rows)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    training = held.to_pylist().count(False)
    return C.as_table([(table.column("chunk")[0].as_py(), training, sink.getvalue().to_pybytes(), _packed(codes), hashes.tobytes())], CODED)


class Part:
    """A chunk's texts one after the other as begin, words, end; with answers, their words, pairs and triples."""

    def __init__(self, table):
        import numpy as np
        import pyarrow as pa

        self.table, self.chunk = table, table.column("chunk")[0].as_py()
        self.rows = pa.ipc.open_stream(table.column("rows")[0].as_py()).read_all()
        self.hashes = np.frombuffer(table.column("hashes")[0].as_py(), np.uint64)
        n = self.rows.column("n_tokens").to_numpy()
        self.lengths, begin = n + 1, len(self.hashes)
        self.k = begin + 1
        self.seq = np.full(self.lengths.sum(), begin)
        self.text = np.repeat(np.arange(len(n)), self.lengths)
        word = np.ones(len(self.seq), bool)
        word[np.cumsum(self.lengths) - self.lengths] = False
        self.seq[word] = _unpacked(table.column("codes")[0].as_py())
        self.training = ~np.array(self.rows.column("held_out").to_pylist(), bool)[self.text]
        self.words = np.bincount(self.seq[self.training], minlength=self.k)[:begin]  # counts in this chunk's training texts

    def counted(self, bits: int, begins: int, min_count: int, width: int) -> None:
        """Corpus counts and numbers of words; the pairs that could be arcs."""
        import numpy as np

        begin, order = self.k - 1, np.argsort(self.hashes)
        said, ranks, buckets = _said(self.table, "words")
        self.words = np.empty(begin, np.int64)
        self.words[order] = np.concatenate(said) >> np.uint64(1)
        self.known = order[self.words[order] >= min_count]  # in the order of their buckets and ranks
        self.word_buckets, self.word_ranks = buckets, ranks
        self.number = np.zeros(self.k, np.uint64)  # begin is 0
        self.number[self.known] = np.uint64(1) + (ranks << np.uint64(bits) | buckets)
        often = np.append(self.words, begins) >= min_count
        fits = often[self.seq]
        self.inside = np.flatnonzero((self.seq[1:] != begin) & fits[:-1] & fits[1:])
        self.pairs, self.pair_at = np.unique(self.seq[self.inside] * self.k + self.seq[self.inside + 1], return_inverse=True)
        self.pair_counts = np.bincount(self.pair_at[self.training[self.inside]], minlength=len(self.pairs))
        self.pair_keys = _spread(self.number[self.pairs // self.k] << np.uint64(width) | self.number[self.pairs % self.k], 2 * width)

    def paired(self, bits: int, width: int, word_width: int) -> None:
        """The pairs that are arcs, their corpus counts and numbers; the triples that could be."""
        import numpy as np

        order = np.argsort(self.pair_keys)
        parts, ranks, buckets = _said(self.table, "pairs")
        said, number = np.empty(len(order), np.uint64), np.zeros(len(order), np.uint64)
        said[order] = np.concatenate([*parts, np.zeros(0, np.uint64)])
        arc = said > 0
        number[order[arc[order]]] = ranks << np.uint64(bits) | buckets
        place = np.full(len(self.seq), -1)  # the arc that begins at a token
        place[self.inside] = np.where(arc, np.cumsum(arc) - 1, -1)[self.pair_at]
        self.pairs, self.pair_number, said = self.pairs[arc], number[arc], said[arc]
        self.pair_order = (np.cumsum(arc) - 1)[order[arc[order]]]  # by buckets and ranks
        self.pair_buckets, self.pair_ranks = buckets, ranks
        self.pair_counts, self.own_pairs = (said >> np.uint64(1)).astype(np.int64), (said & np.uint64(1)).astype(float)
        at = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0))
        triples, triple_at = np.unique(place[at] * self.k + self.seq[at + 2], return_inverse=True)
        self.triple_counts = np.bincount(triple_at[self.training[at]], minlength=len(triples))
        self.head, self.last = triples // self.k, triples % self.k
        self.triple_keys = _spread(self.pair_number[self.head] << np.uint64(word_width) | self.number[self.last], width + word_width)

    def completed(self) -> None:
        """The triples that are arcs, and their corpus counts."""
        import numpy as np

        said = np.empty(len(self.triple_keys), np.uint64)
        said[np.argsort(self.triple_keys)] = np.concatenate([*_said(self.table, "triples")[0], np.zeros(0, np.uint64)])
        arc = said > 0
        self.head, self.last, said = self.head[arc], self.last[arc], said[arc]
        self.triple_counts, self.own_triples = (said >> np.uint64(1)).astype(np.int64), (said & np.uint64(1)).astype(float)

    def contexts(self, sums) -> list[tuple]:
        """Questions for the sums over the arcs of contexts, with those over the arcs that this chunk owns."""
        import numpy as np

        words = np.append(self.k - 1, self.known)
        buckets, ranks = np.append(0, self.word_buckets.astype(np.int64)), np.append(np.uint64(0), self.word_ranks + np.uint64(1))
        return [
            *_sent(self.chunk, 0, buckets, ranks, sums[:, words]),
            *_sent(self.chunk, PAIR_CONTEXTS, self.pair_buckets.astype(np.int64), self.pair_ranks, sums[:, self.k + self.pair_order])]

    def summed(self):
        import numpy as np

        sums = np.zeros((3, self.k + len(self.pairs)), np.uint64)
        for first, contexts in (0, np.append(self.k - 1, self.known)), (PAIR_CONTEXTS, self.k + self.pair_order):
            sums[:, contexts] = np.concatenate([*(x.reshape(3, -1) for x in _said(self.table, "sums", first)[0]), np.zeros((3, 0), np.uint64)], axis=1)
        return sums

    def automaton(self, begins: int, total: int, distinct: int, sums=None) -> Automaton:
        return Automaton(self.words, begins, total, distinct, self.pairs, self.pair_counts, (self.head, self.last), self.triple_counts, sums)


def sums_of(counts, pairs, pair_counts, which, last, triple_counts, own_pairs, own_triples):
    """Of each context (words, begin, pairs): its owned arcs, their counts, and the counts of the arcs for the same words in
    the shorter context.  Whole numbers, so the chunks' sums add up to the same in any order."""
    import numpy as np

    k = len(counts) + 1
    a, b = pairs // k, pairs % k
    shorter = pair_counts[np.searchsorted(pairs, b[which] * k + last)] if len(which) else np.zeros(0)
    add = lambda at, x, n: np.bincount(at, x * np.ones(len(at)), n)
    words = [add(a, own_pairs * x, k) for x in (1.0, pair_counts, counts[b])]
    return np.stack([np.concatenate([w, add(which, own_triples * x, len(pairs))]) for w, x in zip(words, (1.0, triple_counts, shorter))]).astype(np.uint64)


class Automaton:
    """Arcs sorted by (state, word), failure arcs, weights as log10.

    Counts are those of the corpus; words, pairs and triples may be a part of the model, then ``sums`` has those over all arcs
    of its contexts (words, begin, pairs).  Triples are ``pair code * k + word`` or (places of pairs, words)."""

    def __init__(self, counts, begins: int, total: int, distinct: int, pairs, pair_counts, triples, triple_counts, sums=None):
        import numpy as np

        words = len(counts)
        self.k = k = words + 1
        z = total + 0.1 * (distinct + 1)
        p1 = (counts + 0.1) / z
        before = np.append(counts, begins).astype(float)  # how often a word (or begin) is followed by something
        a, b = pairs // k, pairs % k
        p2 = (pair_counts - DISCOUNT) / before[a]
        which, c = triples if isinstance(triples, tuple) else (np.searchsorted(pairs, triples // k), triples % k)
        p3 = (triple_counts - DISCOUNT) / pair_counts[which]
        shorter = np.searchsorted(pairs, b[which] * k + c)  # the pair of a triple's last two words
        n = 1 + k + len(pairs)
        if sums is None:
            sums = sums_of(counts, pairs, pair_counts, which, c, triple_counts, 1.0, 1.0)
        arcs, own, lower = sums.astype(float)  # of each context: its arcs, their counts, and those of the arcs in the shorter context
        seen = (own - DISCOUNT * arcs) / np.maximum(np.concatenate([before, pair_counts]), 1)
        lower = np.concatenate([(lower[:k] + 0.1 * arcs[:k]) / z, (lower[k:] - DISCOUNT * arcs[k:]) / np.maximum(before[b], 1)])
        self.weight = np.concatenate([[0.0], _weight(seen, lower)])
        self.fail = np.concatenate([np.zeros(1 + k, np.int64), 1 + b])
        self.arc = np.concatenate([np.arange(words), (1 + a) * k + b, (1 + k + which) * k + c])
        self.next = np.concatenate([1 + np.arange(words), np.arange(1 + k, n), 1 + k + shorter]).astype(np.int32)
        self.log = np.concatenate([np.log10(p1), np.log10(p2), np.log10(p3)])
        self.some = np.bincount(self.arc // k, minlength=n) > 0  # states with arcs
        order = np.argsort(self.arc)
        self.arc, self.next, self.log = self.arc[order], self.next[order], self.log[order]
        self.to_root = self.weight + self.weight[self.fail]  # of all failure arcs from a state
        self.to_root[0] = 0.0
        self.log1 = np.log10(p1)

    def traverse(self, seq, lengths):
        """Log10 probability of each text; a word of -1 costs the way to the root alone."""
        import numpy as np

        first = np.cumsum(lengths) - lengths
        pieces = np.maximum(1, -(-(lengths - 1) // PIECE))
        text = np.repeat(np.arange(len(lengths)), pieces)
        part = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = first[text] + 1 + part * PIECE
        stop = np.minimum(start + PIECE, (first + lengths)[text])
        state = np.where(part == 0, self.k, 0)  # begin, or nothing
        total = np.zeros(len(text))
        for t in range(-2, PIECE):
            live = np.flatnonzero((start + t < stop) & ((part > 0) | (t >= 0)))
            if not len(live):
                continue
            word, at, sum_ = seq[start[live] + t], state[live], np.zeros(len(live))
            out = word < 0
            sum_[out] += self.to_root[at[out]]
            at[out] = 0
            open_ = np.flatnonzero(~out)
            while len(open_):
                root = at[open_] == 0  # has an arc for each word, in their order
                done, open_ = open_[root], open_[~root]
                sum_[done] += self.log1[word[done]]
                at[done] = 1 + word[done]
                some = self.some[at[open_]]
                asked, failed = open_[some], open_[~some]
                key = at[asked] * self.k + word[asked]
                order = np.argsort(key)  # neighbours are found in one place
                asked, key = asked[order], key[order]
                spot = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
                hit = self.arc[spot] == key
                done, spot = asked[hit], spot[hit]
                sum_[done] += self.log[spot]
                at[done] = self.next[spot]
                open_ = np.concatenate([failed, asked[~hit]])
                sum_[open_] += self.weight[at[open_]]
                at[open_] = self.fail[at[open_]]
            state[live] = at
            if t >= 0:
                total[live] += sum_
        return np.bincount(text, total, len(lengths))


def scored(docs: DataFrame, id: str = "doc_id", text: str = "text", *, min_count: int = MIN_COUNT) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row; scores are log10 probabilities."""
    min_count = max(1, min_count)
    corpus = Texts(docs, id, text)
    begins = corpus.table.agg(F.coalesce(F.sum("training"), F.lit(0))).first()[0]
    word_bits, pair_bits, triple_bits = corpus.bits(0.02), corpus.bits(0.1), corpus.bits(0.06)
    width = lambda counts, bits: max(12, ((counts.agg(F.max("most")).first()[0] or 0) << bits).bit_length())  # noqa: E731  bits of a number

    def words(table):
        part = Part(table)
        return _asked(part.chunk, part.hashes, word_bits, part.words)

    counts = _round(corpus, "words", words, _totals(min_count, True))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    word_width = width(counts, word_bits)

    def pairs(table):
        part = Part(table)
        part.counted(word_bits, begins, min_count, word_width)
        return _asked(part.chunk, part.pair_keys, pair_bits, part.pair_counts)

    pair_width = width(_round(corpus, "pairs", pairs, _totals(min_count, False)), pair_bits)

    def triples(table):
        part = Part(table)
        part.counted(word_bits, begins, min_count, word_width)
        part.paired(pair_bits, pair_width, word_width)
        return _asked(part.chunk, part.triple_keys, triple_bits, part.triple_counts)

    _round(corpus, "triples", triples, _totals(min_count, False))

    def contexts(table):
        part = Part(table)
        part.counted(word_bits, begins, min_count, word_width)
        part.paired(pair_bits, pair_width, word_width)
        part.completed()
        return part.contexts(sums_of(part.words, part.pairs, part.pair_counts, part.head, part.last, part.triple_counts, part.own_pairs, part.own_triples))

    _round(corpus, "sums", contexts, _sums)

    def scores(table, _):
        import numpy as np
        import pyarrow as pa

        part = Part(table)
        part.counted(word_bits, begins, min_count, word_width)
        part.paired(pair_bits, pair_width, word_width)
        part.completed()
        automaton = part.automaton(begins, total, distinct, part.summed())
        word = part.seq < part.k - 1
        of, seq, n = part.text[word], part.seq[word], len(part.lengths)
        known = np.bincount(of[part.words[seq] > 0], minlength=n)
        return pa.table(
            [part.rows.column("id"), part.rows.column("held_out"), pa.array(part.lengths - 1), pa.array(known.astype(np.int64)), pa.array([total] * n, pa.int64()),
             pa.array(np.bincount(of, automaton.log1[seq], n)), pa.array(automaton.traverse(part.seq, part.lengths))],
            names=[id, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id].dataType.simpleString()
    return corpus.map(scores, f"`{id}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
