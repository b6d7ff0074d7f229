"""Cross-tokenizer alignment by whitespace-token anchors.

Every text is encoded whole by two tokenizers: A, a byte-level BPE, gets a space and the text, B, a piece model, adds that
space itself.  Where the ids of A's vocabulary are its merge ranks, as in all vocabularies of its kind, A runs on ranks, which
gives the same ids in a quarter of the time (``Coders``).  Both token sequences then spell the same bytes; where they do not, the text has no tokens.  Byte offsets at
which tokens of both end cut a text into groups.  Instead of walking every text, it is cut into windows at its anchors: offsets
where both sequences end a token and both next tokens begin with a space.  What a window holds (groups, links, their
spelling) depends on its token ids alone, so it is worked out once per pair of id tuples (packed, 32 bits an id)
and looked up from then on.

A link is an occurrence pair of an A and a B token in one group.  Corpus-wide counts of linked id pairs go three ways:

1. a task goes through its texts in blocks of ``BLOCK_BYTES`` and writes, for each document, its distinct pairs as numbers
   of the block, and for each block its distinct pairs with the number of documents that hold them;
2. the blocks' pairs are summed by Spark, and each pair learns whether it is its A id's highest (one row per A id, at most
   the vocabulary, is broadcast);
3. the counts return to the blocks by pair, one row for each block that holds it, and the blocks' documents sum them up.

A pair that every document holds costs one row for each block.  No text is shuffled.

Null and empty texts, and texts that do not survive either tokenizer byte for byte, have no tokens: all numbers 0, no
groups.  Every row is a document of its own, also with a repeated or null id; repeated rows count twice.  An empty table
gives an empty result; other columns are not looked at; a statistic whose name the id column has gets a "_" behind it.
One text is held in memory by one task with its tokens, about 60 bytes for each of its bytes.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections import Counter
from itertools import chain
from json import loads

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, texts, unused

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 8_000_000  # text of a block
STEP_BYTES = 500_000  # text that is encoded at once
#: -1 and -2, which stand between the 32-bit ids of A and those of B in a packed group, and after it.  Ids are below 2^24, so
#: neither is found anywhere else when looked for from the left.
BETWEEN, AFTER = b"\xff\xff\xff\xff", b"\xfe\xff\xff\xff"
#: The fixed pattern by which byte-level vocabularies cut text before merging.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK_RUN = 50_000  # runs of so many blanks are left to the other library, as their end is found by going back step by step
LONG_BLANKS = re.compile(r"\s{%d}" % BLANK_RUN)
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def ranked(config: dict):
    """The byte-level BPE of a tokenizer file run by ranks, or None if its ids are not the ranks of its merges.

    A merge's id is then the number of merges before it plus 256, so merging the pair with the smallest id is merging by rank.
    """
    import tiktoken

    model, cut, spelled = config["model"], config["pre_tokenizer"] or {}, byte_level()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    vocabulary = model["vocab"]
    fits = model["type"] == "BPE" and not config["normalizer"] and not any(model.get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
    fits = fits and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    fits = fits and all(vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)) and {vocabulary.get(c) for c in spelled} == set(range(256))
    if not fits:
        return None
    special = {t["content"] for t in config["added_tokens"]}
    ranks = {bytes(map(spelled.__getitem__, entry)): k for entry, k in vocabulary.items() if entry not in special}
    return tiktoken.Encoding("ranked", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})


class Coders:
    """Both tokenizers, from the contents of their files, and the bytes of every id."""

    def __init__(self, json: bytes, model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(json.decode())
        self.a.encode_special_tokens = True
        self.ranked = ranked(loads(json))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        spelled, special = byte_level(), {k: v.content for k, v in self.a.get_added_tokens_decoder().items()}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (1 + max(entries.values(), default=-1))
        for entry, k in entries.items():
            self.bytes_a[k] = special[k].encode() if k in special else bytes(map(spelled.__getitem__, entry))
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]

    def encoded(self, body: list[str]) -> tuple[list, list]:
        spaced = [" " + t for t in body]
        slow = [k for k, t in enumerate(spaced) if self.ranked is None or (len(t) > BLANK_RUN and LONG_BLANKS.search(t))]
        plain = dict(zip(slow, self.a.encode_batch_fast([spaced[k] for k in slow], add_special_tokens=False)))
        a = [plain[k].ids if k in plain else self.ranked.encode_ordinary(t) for k, t in enumerate(spaced)]
        return a, self.b.encode(body, num_threads=1)


class Block:
    """Windows met so far, by their id tuples, and the id pairs that they link, numbered as they come."""

    def __init__(self, coders: Coders, number: int, spell: bool):
        import numpy as np

        self.coders, self.number, self.spell = coders, number, spell
        self.sizes = [np.array([len(x) for x in y], np.int64) for y in (coders.bytes_a, coders.bytes_b)]
        self.marked = [np.array([x[:1] == b" " for x in y]) for y in (coders.bytes_a, coders.bytes_b)]
        self.windows: dict[bytes, int] = {}
        self.spelling: list[str] = []
        self.groups, self.starts = array("q"), array("q", [0])  # of each window
        self.known: dict[bytes, int] = {}  # groups, likewise
        self.group_spelling: list[str] = []
        self.pair, self.times, self.pair_starts = array("q"), array("q"), array("q", [0])  # of each group
        self.links = array("q")
        self.pairs: dict[int, int] = {}
        self.rows: list[tuple] = []
        self.held: list = []  # numbers of the pairs of each document
        self.bytes = 0

    def group(self, key: bytes) -> int:
        """Number of a group that was not met before: its spelling, links, and the linked pairs with how often each is linked."""
        a, b = (array("i", ids).tolist() for ids in key.split(BETWEEN))
        many = Counter(b).items()
        for x, m in Counter(a).items():
            for y, n in many:
                self.pair.append(self.pairs.setdefault(x << 32 | y, len(self.pairs)))
                self.times.append(m * n)
        self.pair_starts.append(len(self.pair))
        self.links.append(len(a) * len(b))
        number = self.known[key] = len(self.group_spelling)
        self.group_spelling.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
        return number

    def window(self, key: bytes) -> int:
        known, group, numbers = self.known, self.group, []
        for part in key.split(AFTER)[:-1]:
            k = known.get(part)
            numbers.append(group(part) if k is None else k)
        number = self.windows[key] = len(self.spelling)
        spelling = self.group_spelling
        self.spelling.append(";".join([spelling[k] for k in numbers]))
        self.groups.extend(numbers)
        self.starts.append(len(self.groups))
        return number

    def add(self, ids: list, raw: list[bytes]) -> None:
        self.bytes += sum(map(len, raw))
        coded = list(zip(*self.coders.encoded([t.decode() for t in raw]))) if raw else []
        spell_a, spell_b = self.coders.bytes_a.__getitem__, self.coders.bytes_b.__getitem__
        good = [bool(t) and b"".join(map(spell_a, a)) == b" " + t == b"".join(map(spell_b, b)) for t, (a, b) in zip(raw, coded)]
        for doc in self._documents([c for c, g in zip(coded, good) if g], [i for i, g in zip(ids, good) if g]):
            self.rows.append(doc)
        self.rows += [(i, 0, 0, 0, 0, "", b"", b"", "" if self.spell else None) for i, g in zip(ids, good) if not g]

    def _documents(self, coded: list[tuple[list, list]], ids: list):
        import numpy as np

        if not coded:
            return
        n_a, n_b = (np.array([len(c[k]) for c in coded]) for k in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(c[k] for c in coded), np.int64, n.sum()) for k, n in enumerate((n_a, n_b)))
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        # groups end where tokens of both do; anchors are those ends before space-marked tokens of both, and the ends of
        # documents (equal in both, as verified)
        at = np.searchsorted(end_b, end_a, side="right") - 1
        i = np.flatnonzero((at >= 0) & (end_b[at] == end_a))
        to_a, to_b = i + 1, at[i] + 1
        next_a, next_b = np.append(a, a[-1])[to_a], np.append(b, b[-1])[to_b]
        last = np.cumsum(n_a)
        anchor = np.flatnonzero(self.marked[0][next_a] & self.marked[1][next_b] | np.isin(to_a, last)) + 1
        edge = np.searchsorted(to_a[anchor - 1], last) + 1  # windows up to the end of each document
        # all groups one after the other, ids of A, BETWEEN, ids of B, AFTER; a window's key is a stretch of it
        size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        offset = np.concatenate([[0], np.cumsum(size_a + size_b + 2)])
        packed = np.empty(offset[-1], np.int32)
        packed[np.arange(len(a)) + np.repeat(offset[:-1] - to_a + size_a, size_a)] = a
        packed[np.arange(len(b)) + np.repeat(offset[:-1] + size_a + 1 - to_b + size_b, size_b)] = b
        packed[offset[:-1] + size_a], packed[offset[1:] - 1] = -1, -2
        packed, cuts = packed.tobytes(), (4 * offset[np.append(0, anchor)]).tolist()
        keys = [packed[x:y] for x, y in zip(cuts, cuts[1:])]
        met = list(map(self.windows.get, keys))
        for k in [k for k, w in enumerate(met) if w is None]:
            w = self.windows.get(keys[k])
            met[k] = self.window(keys[k]) if w is None else w
        doc = np.repeat(np.arange(len(coded)), np.diff(edge, prepend=0))
        group, of = _spread(np.array(met), self.starts, self.groups)
        doc = doc[of]
        links = np.frombuffer(self.links, np.int64)[group]
        first = np.searchsorted(doc, np.arange(len(coded)))
        n_groups, n_links = np.diff(first, append=len(doc)), np.add.reduceat(links, first)
        pair, of = _spread(group, self.pair_starts, self.pair)
        times, _ = _spread(group, self.pair_starts, self.times)
        key = doc[of] << 32 | pair
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        times, key = np.add.reduceat(times[order], heads), key[heads]
        cut = np.searchsorted(key >> 32, np.arange(len(coded) + 1))
        pair = (key & 0xFFFFFFFF).astype(np.uint32)
        self.held.append(pair)
        begin = np.concatenate([[0], edge[:-1]])
        for k, i in enumerate(ids):
            text = ";".join([self.spelling[x] for x in met[begin[k] : edge[k]]])
            mine = slice(cut[k], cut[k + 1])
            sha = hashlib.sha256(text.encode()).hexdigest()
            yield (i, int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), sha, pair[mine].tobytes(), times[mine].tobytes(), text if self.spell else None)

    def written(self, id_type, schema):
        """The block's documents, and one row with its pairs and the number of documents that hold each."""
        import numpy as np
        import pyarrow as pa

        held = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        rows = [(self.number, *r, None) for r in self.rows]
        rows.append((self.number, None, 0, 0, 0, 0, None, None, np.bincount(held, minlength=len(keys)).astype(np.int64).tobytes(), None, keys.tobytes()))
        kinds = [pa.int64(), id_type, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema)


def _spread(which, starts: array, values: array):
    """The stretches of ``values`` that ``which`` names, one after the other, and the place in ``which`` that each is of."""
    import numpy as np

    starts, values = np.frombuffer(starts, np.int64), np.frombuffer(values, np.int64)
    first, n = starts[which], starts[which + 1] - starts[which]
    of = np.repeat(np.arange(len(which)), n)
    return values[np.arange(len(of)) + (first - np.cumsum(n) + n)[of]], of


def _blocks(batches, files, block_bytes: int, spell: bool, names: list[str]):
    from pyspark import TaskContext

    # the windows of a block are many small tuples without cycles; going over them again and again takes a fifth of the time
    gc.disable()
    coders, done, block, kind = None, 0, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        coders = coders or Coders(*files.value)
        ids, raw, kind = batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(0).type
        at = 0
        while at < len(raw):
            block = block or Block(coders, TaskContext.get().partitionId() << 32 | done, spell)
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= STEP_BYTES) and to - at < 5000:
                size += len(raw[to])
                to += 1
            block.add(ids[at:to], raw[at:to])
            at = to
            if block.bytes >= block_bytes or len(block.rows) >= 100_000:
                yield block.written(kind, names)
                block, done = None, done + 1
    if block:
        yield block.written(kind, names)
    gc.enable()


def _pairs(batches):
    """Rows ``(block, place, a, b, docs)`` of the blocks' pairs."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for number, keys, docs in zip(*(batch.column(k).to_pylist() for k in range(3))):
            k, n = np.frombuffer(keys, np.int64), np.frombuffer(docs, np.int64)
            for at in range(0, len(k), 100_000):
                some = slice(at, at + 100_000)
                columns = np.full(len(k[some]), number), np.arange(len(k))[some].astype(np.int32), (k[some] >> 32).astype(np.int32), (k[some] & 0xFFFFFFFF).astype(np.int32), n[some]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "place", "a", "b", "docs"])


def _summed(docs, answers, names: list[str]):
    """Documents of a block with the sums over their links; ``answers`` has a count and a mark for each pair of the block."""
    import numpy as np
    import pyarrow as pa

    place = answers.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = answers.column("count").to_numpy(), answers.column("best").to_numpy(zero_copy_only=False)
    sums = []
    for pairs, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist()):
        k, n = np.frombuffer(pairs, np.uint32), np.frombuffer(times, np.int64)
        sums.append((int((n * best[k]).sum()), int((n * count[k]).sum())))
    kept = docs.drop_columns(["block", "pairs", "times"])
    columns = [kept.column(k) for k in range(kept.num_columns)] + [pa.array(x, pa.int64()) for x in (zip(*sums) if sums else ([], []))]
    return pa.table(columns, names=names)


def aligned(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B,
    block_bytes: int = BLOCK_BYTES, groups: bool = False,
) -> DataFrame:
    """One row per document: the id, token, group and link numbers, ``n_best``, ``count_sum`` and the digest of the groups;
    with ``groups``, the groups themselves as ``a1,a2|b1;a3|b2,b3``."""
    spark = docs.sparkSession
    with open(tokenizer_a, "rb") as one, open(tokenizer_b, "rb") as two:
        files = spark.sparkContext.broadcast((one.read(), two.read()))  # two vocabulary files, a few MB whatever the corpus
    narrow = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    number, string, binary = T.LongType(), T.StringType(), T.BinaryType()
    kinds = {"block": number, "id": narrow.schema["id"].dataType} | dict.fromkeys(NUMBERS, number)
    kinds |= {"groups_sha256": string, "pairs": binary, "times": binary, "groups": string, "keys": binary}
    schema = T.StructType([T.StructField(k, v) for k, v in kinds.items()])
    names = list(kinds)
    blocks = stored(narrow.mapInArrow(lambda batches: _blocks(batches, files, block_bytes, groups, names), schema), "alignment-blocks")
    pairs = stored(blocks.where("keys IS NOT NULL").select("block", "keys", "times").mapInArrow(_pairs, "block bigint, place int, a int, b int, docs bigint"), "alignment-pairs")
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")), "alignment-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # at most one row for each id of A
    rated = counts.join(F.broadcast(highest), "a").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    answers = pairs.select("block", "place", "a", "b").join(rated, ["a", "b"]).select("block", "place", "count", "best")
    rows = blocks.where("keys IS NULL").drop("keys", *([] if groups else ["groups"]))
    out = [*[c for c in rows.columns if c not in ("block", "pairs", "times")], "n_best", "count_sum"]
    result = T.StructType([T.StructField(c, kinds.get(c, number)) for c in out])
    done = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda x, y: _summed(x, y, out), result)
    renamed = dict(zip(out[1:], unused(docs.select(id), *out[1:])))
    return done.select(F.col("id").alias(id), *[F.col(c).alias(n) for c, n in renamed.items()])
