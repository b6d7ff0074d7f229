"""Questions about keys of the whole corpus, asked by chunks of documents and answered by buckets of keys.

Documents are dealt to chunks by a hash of their id and text, so that rows of one id, or of none, do not meet, and stored as a table bucketed by chunk (one shuffle of the texts;
every later pass reads a chunk in one place without moving it).  A chunk states its distinct keys, sorted, cut into
buckets by their top bits, as one packed array per bucket.  A bucket meets each key once per chunk, however often the
chunk holds it, and answers with one byte per key in the order asked.  So a key that a third of all documents hold costs
a bucket one entry per chunk, and no row per occurrence is shuffled.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import texts, total_bytes

CHUNK_BYTES = 6_000_000  # text of a chunk
TASK_BYTES = 12_000_000  # text of the chunks that one task goes through
BUCKET_KEYS = 1_000_000  # keys that a bucket sees, on average
NO_ID = -(2**63)  # stands for a null id, before all others
MESSAGE = "chunk int, bucket int, keys binary, extra binary"
ANSWER = "chunk int, bucket int, keys binary"


class Chunks:
    def __init__(self, docs: DataFrame, id: str, text: str, *, chunk_bytes: int = CHUNK_BYTES):
        spark = docs.sparkSession
        rows, size = total_bytes(docs, text)
        self.size, self.n = size, max(1, math.ceil(size / chunk_bytes), math.ceil(rows / 200_000))
        name = f"chunks_{uuid.uuid4().hex}"
        narrow = docs.select(F.pmod(F.xxhash64(F.col(id), F.col(text).cast("string")), F.lit(self.n)).cast("int").alias("chunk"), F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
        # chunks fall into the table's buckets by their hash, as they do in the shuffle: one task writes a bucket
        tasks = min(self.n, max(1, math.ceil(size / TASK_BYTES)))
        writer = narrow.repartition(tasks, "chunk").write.format("parquet").option("compression", "zstd").option("path", scratch_path(spark, "chunks"))
        writer.bucketBy(tasks, "chunk").saveAsTable(name)
        self.table = spark.table(name)

    def bits(self, keys_per_byte: float) -> int:
        """Top bits that number the buckets."""
        return min(24, max(3, math.ceil(math.log2(max(1.0, self.size * keys_per_byte / BUCKET_KEYS)))))

    def map(self, run, schema: str) -> DataFrame:
        """``run(docs, answers)`` for each chunk; both are Arrow tables, the second without rows."""
        return self.table.groupBy("chunk").applyInArrow(lambda t: run(t, None), schema)

    def map_with(self, answers: DataFrame, run, schema: str) -> DataFrame:
        return self.table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def in_order(table):
    """Ids and texts (bytes) of a chunk, by id, then text; a null id comes first."""
    ids = [NO_ID if x is None else x for x in table.column("id").to_pylist()]
    rows = sorted(zip(ids, texts(table.column("text"))))
    return [i for i, _ in rows], [t for _, t in rows]


def asked(chunk: int, keys, bits: int, extra=None, short: bool = False) -> list[tuple]:
    """Messages for sorted distinct ``keys`` (uint64); ``short`` keeps the 32 bits below the bucket's, for questions in
    which a rare false yes does no harm."""
    import numpy as np

    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=2**62)) if len(keys) else np.zeros(1, np.int64)
    sent = (keys >> np.uint64(32 - bits)).astype(np.uint32) if short else keys
    return [
        (chunk, int(bucket[i]), sent[i:j].tobytes(), None if extra is None else extra[i:j].tobytes())
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())
    ]


def as_table(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def answered(messages: DataFrame, judge, *, short: bool = False, extra: str | None = None, kind: str = "u1") -> DataFrame:
    """``judge(keys, extra, order, starts)`` gets all entries of a bucket, the order that sorts them by key and the starts
    of equal keys in it; it returns one number of ``kind`` per entry of that order."""

    def run(table):
        import numpy as np

        table = table.sort_by("chunk")  # equal keys are met in the order of their chunks
        chunks, buckets = table.column("chunk").to_pylist(), table.column("bucket").to_pylist()
        parts = [np.frombuffer(x, np.uint32 if short else np.uint64) for x in table.column("keys").to_pylist()]
        keys = np.concatenate(parts)
        more = np.concatenate([np.frombuffer(x, extra) for x in table.column("extra").to_pylist()]) if extra else None
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        said = np.empty(len(keys), kind)
        said[order] = judge(keys, more, order, starts)
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return as_table([(c, b, said[e - len(p) : e].tobytes()) for c, b, p, e in zip(chunks, buckets, parts, ends)], ANSWER)

    return messages.where("bucket >= 0").groupBy("bucket").applyInArrow(run, ANSWER)


def recurring(keys, extra, order, starts):
    """1 where more than one chunk, or one chunk more than once (``extra`` counts), holds the key."""
    import numpy as np

    n = np.diff(starts, append=len(order)) if extra is None else np.add.reduceat(extra[order].astype(np.int64), starts)
    return np.repeat((n > 1).astype(np.uint8), np.diff(starts, append=len(order)))


def earlier_elsewhere(keys, extra, order, starts):
    """1 where another chunk holds the key in a document with a smaller id (``extra``: the chunk's smallest), or with the
    same id, of which the rows are taken by chunk."""
    import numpy as np

    sizes = np.diff(starts, append=len(order))
    low = extra[order] == np.repeat(np.minimum.reduceat(extra[order], starts), sizes)
    before = np.cumsum(low) - low  # entries at the minimum so far
    return (~low | (before > np.repeat(before[starts], sizes))).astype(np.uint8)


def said(answers, first: int = 0, kind: str = "u1"):
    """A chunk's answers, in the order of its sorted keys; those of buckets from ``first`` on."""
    import numpy as np

    rows = sorted((b, x) for b, x in zip(answers.column("bucket").to_pylist(), answers.column("keys").to_pylist()) if b >= first)
    return np.frombuffer(b"".join(x for _, x in rows), kind)


def mixed(x):
    """Spread the bits of uint64 hashes."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Coded:
    """Words of a chunk's texts, one after the other, as codes, with a 64-bit hash for each code."""

    def __init__(self, body: list[bytes]):
        import numpy as np
        import xxhash

        split = [t.split() for t in body]
        self.lengths = np.array([len(w) for w in split], dtype=np.int64)
        self.ends = np.cumsum(self.lengths)
        words = [w for s in split for w in s]
        known = {w: k for k, w in enumerate(dict.fromkeys(words))}
        self.codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
        self.doc = np.repeat(np.arange(len(body)), self.lengths)
        self.split = split

    def grams(self, n: int):
        """Hash of the n words from each word on (also across texts; callers use those inside)."""
        import numpy as np

        h = self.hashes[self.codes]
        size = max(0, len(h) - n + 1)
        a = np.zeros(size, np.uint64)
        for k in range(n):
            a = a * np.uint64(0x9E3779B97F4A7C15) + h[k : k + size]
        return mixed(a)

    def starts(self, n: int):
        """Where n words of one text begin."""
        import numpy as np

        at = np.arange(max(0, len(self.codes) - n + 1))
        return at[self.ends[self.doc[at]] - at >= n]
