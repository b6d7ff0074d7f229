"""Line dedup: lines that many documents share go, except in one document.

Method: explode the lines, hash their normalised form, count documents per hash, drop the lines of hashes over the
threshold, reassemble by position.  What is exploded and shuffled is sixteen bytes of hash and the document id; texts
meet the hashes to drop in one join by document.

A line's key is the line without the blanks ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case.  Keys shorter than
``min_chars`` code points are never dropped.  Each row counts as a document; of several rows with the keeping id all keep
the line.  Null text is one empty line; null ids count as a document each and only keep lines if no other id holds them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, stored, texts, unused

_BLANKS = BLANKS.encode()


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Sixteen bytes for a line that can be dropped, else None."""
    key = line.strip(_BLANKS).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _keys(min_chars: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, seen, counts = batch.column(0), [], []
            for text in texts(batch.column(1)):
                found = {line_key(x, min_chars) for x in text.split(b"\n")} - {None}
                seen += found
                counts.append(len(found))
            pairs = np.frombuffer(b"".join(seen), dtype="<i8").reshape(-1, 2)
            rows = np.repeat(np.arange(len(counts)), counts)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), ids.take(pa.array(rows))], ["h1", "h2", "id"])

    return run


def _kept(min_chars: int):
    kind = "struct<text: binary, n_lines: bigint, n_dropped: bigint>"

    @F.arrow_udf(kind)
    def kept(column, drops):
        import pyarrow as pa

        out, total, gone = [], [], []
        for text, drop in zip(texts(column), drops.to_pylist()):
            lines = text.split(b"\n")
            drop = {x["h1"].to_bytes(8, "little", signed=True) + x["h2"].to_bytes(8, "little", signed=True) for x in drop or ()}
            rest = [x for x in lines if line_key(x, min_chars) not in drop] if drop else lines
            out.append(b"\n".join(rest))
            total.append(len(lines))
            gone.append(len(lines) - len(rest))
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["text", "n_lines", "n_dropped"])

    return kept


def drop_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", *, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` with shortened ``text`` and ``n_lines`` (before), ``n_dropped``; columns of these names are replaced."""
    kind = docs.schema[id].dataType.simpleString()
    key, gone, kept = unused(docs, "dropped_id", "dropped_keys", "kept_lines")
    lines = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_keys(min_chars), f"h1 bigint, h2 bigint, id {kind}")
    shared = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    shared = stored(shared, "shared-lines")  # a side of its own, so that a very common line's rows can be split over tasks
    drops = (
        lines.join(shared, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias(key))
        .agg(F.collect_set(F.struct("h1", "h2")).alias(gone))
    )
    done = docs.join(drops, docs[id].eqNullSafe(drops[key]), "left").withColumn(kept, _kept(min_chars)(F.col(text).cast("string"), gone))
    return done.withColumns({
        text: F.col(kept)["text"].cast("string"), "n_lines": F.col(kept)["n_lines"], "n_dropped": F.col(kept)["n_dropped"],
    }).drop(key, gone, kept)
