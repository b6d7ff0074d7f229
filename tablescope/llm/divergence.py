"""Source divergence audit: how far the sources of a language differ in their terms, by a cube of partial sums.

Each source of a language has a smoothed share ``p = 1 + floor(10^9 (c + 1) / (N + V))`` for each kept term: ``c`` its
occurrences there, ``N`` their sum, ``V`` the number of kept terms, those in at least ``min_docs`` documents of the language.
The divergence of a source from another is the sum over all kept terms of ``floor((p - q)^2 / q)``.

Pairs of sources by terms are a cube for each language, cut along its three axes.  Sources fall into blocks by a hash, terms
too; a cell (source block, source block, term block) gets the counts of its term block in its two source blocks, so a count is
sent to as many cells as there are source blocks.  A cell computes both directions for its pairs of sources over the terms that
occur in either block, and states how many those were.  Partial sums are added along the term axis; terms that a pair's cells
did not see have the share of a count of 0 in both, one value per pair, and are added as a product.  So a cell's memory is
``2 * GROUP_BLOCK * TERM_BLOCK`` shares, whatever the corpus, and the work grows with sources x sources x terms as the result
demands.  All numbers are 64-bit integers; shares are divided in three steps of 1000, so counts up to 9 * 10^15 are exact.

A word that a third of all rows hold is counted within tasks first and is one row per task and source from then on.  Rows
that join the numbers of their source get them by broadcast up to ``SMALL`` sources, beyond that salted.

Null text, language and source count as ''.  Each row is a document, repeated rows and ids too.  Texts are cut at a letter's
end while they are read, so a very long one needs memory for its distinct terms only.  Sources without terms take part
with counts of 0; a language without kept terms has divergences of 0.  An empty table gives an empty result; columns other than
the three are not looked at.  Equal values are ranked by item.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, texts

GROUP_BLOCK = 16  # sources of a block, on average
TERM_BLOCK = 16_384  # terms of a block, on average
TABLE_TERMS = 400_000  # counts that a task holds before it passes them on
PIECE_BYTES = 1_000_000  # text that is cut into terms at once
SMALL = 50_000  # sources whose numbers are broadcast; about 100 bytes each
SALT_ROWS = 200_000  # counts of a source in one task where they are not

#: Bytes that are letters A-Z become small, other ASCII bytes that are no letters end a term.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def _terms(text: bytes):
    """Terms of a text, in pieces that end where a term does."""
    folded, at = text.translate(FOLD), 0
    while len(folded) - at > PIECE_BYTES:
        cut = folded.find(b" ", at + PIECE_BYTES)
        if cut < 0:
            break
        yield folded[at:cut].split()
        at = cut
    yield folded[at:].split()


def _counted(batches):
    """Rows ``(lang, source, term, n, docs)`` of a task, and one without a term for each of its sources."""
    import pyarrow as pa

    def flushed(tables):
        for (lang, source), (n, docs) in tables.items():
            words = list(n)
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                columns = [lang] * len(some), [source] * len(some), pa.array(some, pa.binary()).cast(pa.string()), [n[w] for w in some], [docs[w] for w in some]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["lang", "source", "term", "n", "docs"])

    seen, tables, size = set(), {}, 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
            seen.add((lang, source))
            if (lang, source) not in tables:
                tables[lang, source] = Counter(), Counter()
            n, docs = tables[lang, source]
            before, mine = len(n), set()
            for piece in _terms(text):
                n.update(piece)
                mine.update(piece)
            docs.update(mine)
            size += len(n) - before
            if size > TABLE_TERMS:
                yield from flushed(tables)
                tables, size = {}, 0
    yield from flushed(tables)
    if seen:
        langs, sources = zip(*seen)
        none = pa.nulls(len(seen), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(sources), none, *[pa.array([0] * len(seen))] * 2], names=["lang", "source", "term", "n", "docs"])


def _share(c: str, total: str, v: str) -> Column:
    """``1 + floor(10^9 (c + 1) / (total + v))`` within 64 bits, three digits at a time: c + 1 is at most total + v."""
    whole, rest = "0L", f"({c} + 1)"
    for _ in range(3):
        whole, rest = f"({whole} * 1000 + ({rest} * 1000) div ({total} + {v}))", f"(({rest} * 1000) % ({total} + {v}))"
    return F.expr(f"{whole} + 1")


def _shares(c, total, v):
    """The same for arrays."""
    rest, d, whole = c + 1, total + v, 0
    for _ in range(3):
        part = rest * 1000
        whole, rest = whole * 1000 + part // d, part % d
    return whole + 1


def _cell(key, counts, sources):
    """Partial divergences of the pairs of a cell's two source blocks over the terms that either holds."""
    import numpy as np
    import pyarrow as pa

    lang, i, j, _ = (k.as_py() for k in key)
    names, blocks = sources.column("source").to_pylist(), sources.column("block").to_pylist()
    place = {s: k for k, s in enumerate(names)}
    total = np.array(sources.column("total").to_pylist(), np.int64)[:, None]
    v = sources.column("v")[0].as_py()
    terms = counts.column("term").dictionary_encode().combine_chunks() if counts.num_rows else None
    width = len(terms.dictionary) if counts.num_rows else 0
    c = np.zeros((len(names), width), np.int64)
    if width:
        c[[place[s] for s in counts.column("source").to_pylist()], terms.indices.to_numpy()] = counts.column("n").to_numpy()
    p = _shares(c, total, v) if width else c
    zero = _shares(np.zeros_like(total), total, v)[:, 0] if v else np.zeros(len(names), np.int64)
    rows = []
    one, two = ([k for k, b in enumerate(blocks) if b == x] for x in (i, j))
    for g in one:
        others = [k for k in two if k != g]
        if not others:
            continue
        gap = p[others] - p[g]
        gap *= gap
        there = (gap // p[others]).sum(1).tolist()
        back = (gap // p[g]).sum(1).tolist() if i != j else None
        for k, h in enumerate(others):
            z = int(zero[g] - zero[h])
            rows.append((lang, names[g], names[h], there[k], width, z * z // int(zero[h]) if v else 0, v))
            if back:
                rows.append((lang, names[h], names[g], back[k], width, z * z // int(zero[g]) if v else 0, v))
    kinds = [pa.string()] * 3 + [pa.int64()] * 4
    columns = zip(*rows) if rows else [[]] * 7
    return pa.table([pa.array(x, t) for x, t in zip(columns, kinds)], names=["lang", "source", "item", "value", "seen", "rest", "v"])


class Counts:
    """Stored counts of kept terms by language and source, and the numbers of every source."""

    def __init__(self, docs: DataFrame, *, text: str, lang: str, source: str, min_docs: int):
        blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        narrow = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), F.col(text).cast("string").alias("text"))
        raw = narrow.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
        counts = stored(raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
        terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        kept = stored(terms.where(F.col("docs") >= min_docs).drop("docs"), "divergence-terms")
        self.kept = stored(counts.drop("docs").join(kept, ["lang", "term"]), "divergence-kept")
        present = counts.where("term IS NULL").select("lang", "source")
        totals = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
        sizes = present.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
        numbers = present.join(totals, ["lang", "source"], "left").join(sizes.join(langs, "lang", "left"), "lang")
        self.sources = stored(numbers.fillna(0, ["total", "rows", "v", "lang_total"]), "divergence-sources")
        self.n_sources, self.largest = self.sources.agg(F.count(F.lit(1)), F.max("rows")).first()

    def with_numbers(self, small: int = SMALL) -> DataFrame:
        """Kept counts with the numbers of their source: broadcast while there are few sources, else salted by term."""
        numbers = self.sources.drop("rows")
        if self.n_sources <= small:
            return self.kept.join(F.broadcast(numbers), ["lang", "source"])
        salts = 1 + self.largest // SALT_ROWS
        numbers = numbers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return self.kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(numbers, ["lang", "source", "salt"]).drop("salt")


def divergence(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3, top_terms: int = 200,
    group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK, small: int = SMALL,
) -> DataFrame:
    """Rows ``(lang, source, part, item, value, rank)``: the divergences of each source from every other of its language
    (``pair``), and the ``top_terms`` terms that a source has more of than its language (``term``)."""
    counts = Counts(docs, text=text, lang=lang, source=source, min_docs=min_docs)
    whole = counts.with_numbers(small)

    p, q = _share("n", "total", "v"), _share("lang_n", "lang_total", "v")
    more = whole.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    more = more.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))

    def placed(df: DataFrame) -> DataFrame:
        n = F.ceil(F.col("sources") / group_block).cast("int")
        df = df.withColumn("block", F.pmod(F.xxhash64("source"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        return df.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")

    slices = F.greatest(F.lit(1), F.ceil(F.col("v") / term_block)).cast("int")
    cells = placed(whole).withColumn("k", F.pmod(F.xxhash64("term"), slices).cast("int")).select("lang", "i", "j", "k", "source", "term", "n")
    members = placed(counts.sources).withColumn("k", F.explode(F.sequence(F.lit(0), slices - 1))).select("lang", "i", "j", "k", "source", "block", "total", "v")
    axes = ["lang", "i", "j", "k"]
    partial = cells.groupBy(*axes).cogroup(members.groupBy(*axes)).applyInArrow(_cell, "lang string, source string, item string, value bigint, seen bigint, rest bigint, v bigint")
    pairs = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("rest").alias("rest"), F.max("v").alias("v"))
    pairs = pairs.select("lang", "source", "item", (F.col("value") + (F.col("v") - F.col("seen")) * F.col("rest")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    out = ranked(pairs).withColumn("part", F.lit("pair")).unionByName(ranked(more).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
