"""N-gram Jaccard join by token-combination prefixes: documents whose shingle sets are alike, as components.

1. Shingles of all documents are hashed to 64 bits; chunks ask how many documents hold each (``chunks``).  A shingle that
   one document holds cannot be shared, so a document links with none unless its recurring shingles reach the similarity.
   Documents that pass are stored with their recurring shingles, rare ones first; equal sets become one class.
2. Extended prefixes: with ``need`` shared shingles at least, two sets share ``k`` of their first ``size - need + k``, in
   one common order.  With k = 2 a class is indexed under each rare shingle of its prefix and under each pair of frequent
   ones.  For sets beyond ``LONG`` shingles k = 1 (pairs grow with the square of the prefix); sets near that length are
   indexed both ways.
3. Verification in two rounds, as only components are asked for.  First every key's members are checked against one
   member, the one with the largest recurring share.  Keys whose members are then in one component are done.  In the
   others, members outside the key's largest component are checked against all members of other components, in blocks of
   ``BLOCK`` by ``BLOCK`` rows.  Members whose recurring shingles cannot suffice for any partner's size are left out.

No pair is written but links that hold, and those only as a spanning forest of each block.

``100 * shared >= percent * union`` links.  Null or empty texts have an empty set and link with nothing; fewer words than
a shingle make one shingle of all.  Rows with one id are one document with all links of their texts; each reports the size of its
own set.  Each row with a null id is a document that is reported without component and links with nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import components, stored

RARE = 24  # answer for about 64 documents: shingles up to it are indexed alone
LONG = 500
BLOCK = 128
SETS = "id bigint, n_shingles bigint, set_a bigint, set_b bigint, recurring binary, ranks binary"


def _shingled(body: list[bytes], length: int):
    """Document number and hash of each distinct shingle, by document, then hash."""
    import numpy as np

    words = C.Coded([t.lower() for t in body])
    starts = words.starts(length)
    keys, docs = words.grams(length)[starts], words.doc[starts]
    short = np.flatnonzero((words.lengths > 0) & (words.lengths < length))
    if len(short):
        import hashlib

        whole = [hashlib.blake2b(b" ".join(words.split[d]), digest_size=8, person=b"whole").digest() for d in short]
        keys, docs = np.concatenate([keys, np.frombuffer(b"".join(whole), np.uint64)]), np.concatenate([docs, short])
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])[: len(keys)]
    return docs[new], keys[new]


def _holders(keys, extra, order, starts):
    """0 for a key of one document, else 4 * log2 of the number of documents, at most 255."""
    import numpy as np

    n = np.add.reduceat(extra[order].astype(np.int64), starts)
    return np.repeat(np.where(n > 1, np.minimum(255, 4 * np.log2(n)), 0).astype(np.uint8), np.diff(starts, append=len(order)))


def shingle_sets(docs: DataFrame, id: str, text: str, *, length: int, percent: int) -> DataFrame:
    """``SETS`` rows: size of every document's set; recurring shingles, rare first, of those that can link."""
    corpus = C.Chunks(docs, id, text)
    bits = corpus.bits(0.16)

    def state(table, _):
        import numpy as np

        keys, counts = np.unique(_shingled(C.in_order(table)[1], length)[1], return_counts=True)
        return C.as_table(C.asked(table.column("chunk")[0].as_py(), keys, bits, np.minimum(counts, 65535).astype(np.uint16), short=True), C.MESSAGE)

    def settle(table, answers):
        import numpy as np

        ids, body = C.in_order(table)
        docs, keys = _shingled(body, length)
        ranks = C.said(answers)[np.unique(keys, return_inverse=True)[1]] if len(keys) else np.zeros(0, np.uint8)
        ends = np.cumsum(np.bincount(docs, minlength=len(ids)))
        spread, rows, begin = C.mixed(keys), [], 0
        for i, end in zip(ids, ends.tolist()):
            n, i = end - begin, None if i == C.NO_ID else i
            held = np.flatnonzero(ranks[begin:end]) + begin
            if i is not None and n and 100 * len(held) >= percent * n:
                held = held[np.lexsort((keys[held], ranks[held]))]
                sums = [int(x[begin:end].sum(dtype=np.uint64).astype(np.int64)) for x in (keys, spread)]
                rows.append((i, n, *sums, keys[held].tobytes(), ranks[held].tobytes()))
            else:
                rows.append((i, n, None, None, None, None))
            begin = end
        return C.as_table(rows, SETS)

    asked = corpus.map(state, C.MESSAGE)
    return stored(corpus.map_with(C.answered(asked, _holders, short=True, extra="u2"), settle, SETS), "shingle-sets")


def reach(n: int, recurring: int, percent: int) -> int:
    """Largest size of a set that a set of ``n`` can link with, as they share its recurring shingles at most."""
    return recurring * (100 + percent) // percent - n


def _keys(percent: int):
    def of(n: int, ranks, tokens) -> list[int]:
        import numpy as np

        unique, need, keys = n - len(tokens), -(-percent * n // 100), []
        for k in (1, 2):
            if (k == 2 and n * percent > 100 * LONG) or (k == 1 and 100 * n < percent * LONG) or need < k:
                continue
            prefix = slice(0, max(0, n - need + k - unique))
            head, rank = tokens[prefix], ranks[prefix]
            frequent = C.mixed(head[rank > RARE] + np.uint64(k))
            keys += C.mixed(head[rank <= RARE]).astype(np.int64).tolist()
            if k == 1:
                keys += frequent.astype(np.int64).tolist()
            else:
                a, b = np.triu_indices(len(frequent), 1)
                keys += C.mixed(frequent[a] + frequent[b] * np.uint64(2)).astype(np.int64).tolist()
        return keys

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, n, tokens, ranks in zip(*(c.to_pylist() for c in batch.columns)):
                found = set(of(n, np.frombuffer(ranks, np.uint8), np.frombuffer(tokens, np.uint64)))
                rows += [(k, i, n, reach(n, len(tokens) // 8, percent), len(tokens) / 8 / n) for k in found]
            kinds = (pa.int64(),) * 4 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["key", "id", "n", "most", "share"])

    return run


def _links(percent: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            shared = [len(np.intersect1d(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), assume_unique=True)) for s, t in zip(x, y)]
            keep = [100 * s >= percent * (p + q - s) for s, p, q in zip(shared, n, m)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep) if k], pa.int64()) for c in (a, b)], ["a", "b"])

    return run


def _block_links(percent: int):
    """Links of a block of a key's minority members with a block of all its members, as a spanning forest of components."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        rows: dict = {}
        for i, *row in zip(*(table.column(c).to_pylist() for c in ("id", "minor", "component", "n", "recurring"))):
            if i not in rows or row[0]:
                rows[i] = row
        ids = np.array(sorted(rows), np.int64)
        minor, parts, sizes = (np.array([rows[i][k] for i in ids.tolist()], np.int64) for k in range(3))
        sets = [np.frombuffer(rows[i][3], np.uint64) for i in ids.tolist()]
        token = np.unique(np.concatenate(sets), return_inverse=True)[1]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        few = np.flatnonzero(minor)
        several = np.flatnonzero(np.bincount(token) > 1)  # tokens that more than one row has
        column = np.full(token.max(initial=-1) + 1, -1)
        column[several] = np.arange(len(several))
        column, shared = column[token], np.zeros((len(few), len(ids)), np.float32)
        for lo in range(0, len(several), 20_000):
            here = (column >= lo) & (column < lo + 20_000)
            held = np.zeros((len(ids), min(20_000, len(several) - lo)), np.float32)
            held[owner[here], column[here] - lo] = 1
            shared += held[few] @ held.T
        shared = shared.astype(np.int64)
        good = (100 * shared >= percent * (sizes[few, None] + sizes[None, :] - shared)) & (parts[few, None] != parts[None, :])
        found = []
        for i, j in zip(*np.nonzero(good)):
            p, q = parts[few[i]], parts[j]
            if p != q:
                found.append((ids[few[i]], ids[j]))
                parts[parts == q] = p
        return pa.table([pa.array([int(f[k]) for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text", *, length: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id``, the smallest id that links lead to (its own if none)."""
    spark = docs.sparkSession
    sets = shingle_sets(docs, id, text, length=length, percent=percent)
    able = sets.where("recurring is not null")
    same = ["n_shingles", "set_a", "set_b"]
    classes = able.groupBy(*same).agg(F.min("id").alias("least")).withColumn("class", F.monotonically_increasing_id())
    classes = stored(classes, "set-classes")  # numbers are given once
    member = stored(able.select("id", *same).join(classes, same).select("id", "class").distinct(), "set-members")
    heads = able.join(classes.withColumnRenamed("least", "id"), [*same, "id"]).dropDuplicates(["class"])
    heads = stored(heads.select(F.col("class").alias("id"), F.col("n_shingles").alias("n"), "recurring", "ranks"), "set-heads")
    # an id with several texts joins their classes
    first = member.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z").select("id", "a")
    joined = member.join(first, "id").where(F.col("a") < F.col("class")).select("a", F.col("class").alias("b"))

    keyed = heads.select("id", "n", "recurring", "ranks").mapInArrow(_keys(percent), "key bigint, id bigint, n bigint, most bigint, share double")
    keyed = stored(keyed, "set-keys")
    centres = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("least"), F.max("most").alias("top"), F.max(F.struct("share", "n", "id", "most")).alias("c"))
    centres = stored(centres.where("held > 1").select("key", "least", "top", F.col("c.id").alias("centre"), F.col("c.n").alias("m"), F.col("c.most").alias("m_most")), "set-centres")
    # members of keys that two or more have, and whose sizes leave them a partner there
    shared = stored(keyed.join(centres, "key").where("most >= least and n <= top"), "set-shared")
    close = (100 * F.col("n") >= percent * F.col("m")) & (100 * F.col("m") >= percent * F.col("n")) & (F.col("n") <= F.col("m_most")) & (F.col("m") <= F.col("most"))
    pairs = shared.where((F.col("id") != F.col("centre")) & close).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    x = heads.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("recurring").alias("x"))
    y = heads.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("recurring").alias("y"))
    links = stored(pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(_links(percent), "a bigint, b bigint"), "set-links")
    parts = stored(components(spark, links.union(joined), "set"), "set-parts")

    # keys whose members are still in several components, one of those with the same members
    open_ = shared.select("key", "id", "n").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = stored(open_, "set-open")
    mark = [F.sum("held").alias("held"), F.max(F.struct("held", "component")).alias("major"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("parts")]
    hashes = [F.sum(F.shiftright(F.xxhash64(F.lit(k), "id"), 24)).alias(c) for k, c in ((1, "x"), (2, "y"))]  # 40 bits: no overflow below 2 ** 23 members
    several = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("held"), *hashes).groupBy("key").agg(*mark).where("parts > 1")
    several = several.groupBy("held", "x", "y", "major").agg(F.min("key").alias("key"))
    several = stored(several.select(
        "key", F.col("major.component").alias("major"), F.ceil((F.col("held") - F.col("major.held")) / BLOCK).cast("int").alias("minors"),
        F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks")), "set-several")
    rows = open_.join(several, "key")
    place = lambda k, n: F.pmod(F.xxhash64(F.lit(k), "id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_member = F.transform(every("minors"), lambda i: F.struct(i.alias("i"), place(3, "blocks").alias("j"), F.lit(0).alias("minor")))
    as_minor = F.transform(every("blocks"), lambda j: F.struct(place(4, "minors").alias("i"), j.alias("j"), F.lit(1).alias("minor")))
    roles = F.when(F.col("component") == F.col("major"), as_member).otherwise(F.concat(as_member, as_minor))
    rows = rows.select("key", "id", "component", F.explode(roles).alias("at"))
    rows = rows.join(heads.select("id", "n", "recurring"), "id").select("key", "at.i", "at.j", "at.minor", "id", "component", "n", "recurring")
    more = rows.groupBy("key", "i", "j").applyInArrow(_block_links(percent), "a bigint, b bigint")
    stars = parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    parts = components(spark, stars.union(more), "set")

    placed = classes.select("class", "least").join(parts.select(F.col("node").alias("class"), "component"), "class", "left")
    placed = placed.withColumn("component", F.coalesce("component", "class"))
    least = placed.groupBy("component").agg(F.min("least").alias("__component"))
    found = member.join(placed.join(least, "component"), "class").select(F.col("id").alias("__id"), "__component").distinct()
    done = sets.select("id", "n_shingles").join(found, sets["id"] == found["__id"], "left")
    return done.select(F.col("id").alias(id), "n_shingles", F.coalesce("__component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", *, length: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id names their component, with their own columns."""
    parts = jaccard_components(docs.select(id, text), id, text, length=length, percent=percent)
    others = parts.where(F.col(id) != F.col("component_id")).select(F.col(id).alias("__id")).distinct()
    return docs.join(others, docs[id].eqNullSafe(others["__id"]), "left_anti")
