"""Language identification by a string kernel.

The kernel of two texts is the number of character n-grams (1 to 3 characters, a blended spectrum) that both hold, divided
by the root of the product of how many each holds.  N-grams are taken from the lower-cased letter runs of the whole text, each with a
blank on both sides; each counts once, however often it occurs (presence).  Landmarks, whole texts of every language, span a
Nyström feature space: the kernel to the landmarks, whitened by their own kernel matrix.  In it one ridge regression per
language (1 for its texts, -1 for others, one-versus-rest) is fitted in closed form.

Scoring a block of texts is two matrix products: presence of the landmarks' n-grams (texts x n-grams) by their occurrence in
the landmarks (n-grams x landmarks), then the scaled kernel by the regressions (landmarks x languages).

Training: at most ``SAMPLE_ROWS`` distinct texts, equal numbers for each language, those with the smallest hashes of
their text among all training rows, so copies of one text do not fill the sample; languages beyond
``MAX_LANGUAGES`` by number of rows are not learned.  These bounds hold for the fit alone; every row is scored, over its whole text.

The language is never an input of a prediction, nor are other columns.  Null texts and texts without a letter (Unicode L) get
``und`` and a score of 0, as does every text if nothing was learned.  Other scores are the winner's regression value, moved
from -1..1 to 0..1 and cut there.  Ties go to the language that is smaller by its bytes.  Repeated rows are each scored; a null
id counts as the empty text in the split.  A text needs memory for its distinct words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored, texts, unused

SAMPLE_ROWS = 4_000
MAX_LANGUAGES = 400
LANDMARKS = 256  # in all; two for each language at least
RIDGE = 1e-3  # share of the number of training texts
BLOCK_ROWS, BLOCK_BYTES = 64, 400_000  # texts of one matrix product
LONG = 1_000_000  # characters from which words are read one by one

RUN = re.compile(r"[^\W\d_]+")
LETTERS = 3  # characters of the longest n-gram; their code points share 63 bits


def words_of(text: str) -> set[str]:
    """Distinct runs of letters, lower-cased."""
    lower = text.lower()
    found = set(RUN.findall(lower)) if len(lower) < LONG else {m.group() for m in RUN.finditer(lower)}
    odd = [w for w in found if not w.isalpha()]  # numerals such as superscripts are in the pattern's class
    found.difference_update(odd)
    for w in odd:
        found.update("".join(c if c.isalpha() else " " for c in w).split())
    return found


class Presence:
    """Which n-grams the texts of a block hold: ``codes`` of the columns and a matrix of texts x columns."""

    def __init__(self, body: list[str]):
        import numpy as np

        held = [words_of(t) for t in body]
        number: dict[str, int] = {}
        use = [number.setdefault(w, len(number)) for words in held for w in words]
        doc = np.repeat(np.arange(len(body)), [len(w) for w in held])
        chars = np.frombuffer("".join(f" {w} " for w in number).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(w) + 2 for w in number], np.int64)
        word = np.repeat(np.arange(len(number)), size)
        codes, owner = [], []
        for n in range(1, LETTERS + 1):
            gram = np.zeros(max(0, len(chars) - n + 1), np.int64)
            for k in range(n):
                gram |= chars[k : k + len(gram)] << (21 * k)
            inside = word[: len(gram)] == word[n - 1 : n - 1 + len(gram)]
            inside &= gram != 32
            codes.append(gram[inside])
            owner.append(word[: len(gram)][inside])
        self.codes, column = np.unique(np.concatenate(codes), return_inverse=True)
        owner = np.concatenate(owner)
        column = column[np.argsort(owner, kind="stable")]
        n = np.bincount(owner, minlength=len(number))
        first = np.cumsum(n) - n
        use = np.array(use, np.int64)
        m = n[use]
        place = np.repeat(first[use] - np.cumsum(m) + m, m) + np.arange(m.sum())
        self.matrix = np.zeros((len(body), len(self.codes)), np.float32)
        self.matrix[np.repeat(doc, m), column[place]] = 1
        self.sizes = self.matrix.sum(1, dtype=np.float64)


class Classifier:
    """``codes`` (sorted), ``held`` (n-grams x landmarks, 0 or 1), ``scale`` (landmarks), ``weights``, ``bias``, ``languages``."""

    def __init__(self, state: tuple):
        self.codes, self.held, self.scale, self.weights, self.bias, self.languages = state

    def kernel(self, some: Presence):
        import numpy as np

        at = np.searchsorted(self.codes, some.codes)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == some.codes
        shared = some.matrix[:, known] @ self.held[at[known]].astype(np.float32)
        return shared / np.sqrt(np.maximum(some.sizes, 1))[:, None] * self.scale

    def scores(self, some: Presence):
        return self.kernel(some) @ self.weights + self.bias


def fitted(rows: list[tuple[str, bytes]], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple:
    """State of a classifier from training texts: their language and the codes of their n-grams."""
    import numpy as np

    grams = [np.frombuffer(g, np.int64) for _, g in rows]
    label = np.array([languages.index(name) for name, _ in rows])
    each = max(2, landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(label == k)[:each] for k in range(len(languages))])
    codes = np.unique(np.concatenate([grams[k] for k in chosen]))
    held = np.zeros((len(codes), len(chosen)), np.uint8)
    for c, k in enumerate(chosen):
        held[np.searchsorted(codes, grams[k]), c] = 1
    scale = 1 / np.sqrt(np.maximum(held.sum(0, dtype=np.float64), 1))
    kernel = np.zeros((len(rows), len(chosen)))
    wide = held.astype(np.float32)
    for k, g in enumerate(grams):
        at = np.searchsorted(codes, g)
        at[at == len(codes)] = 0
        kernel[k] = wide[at[codes[at] == g]].sum(0) / np.sqrt(max(len(g), 1)) * scale
    values, vectors = np.linalg.eigh(kernel[chosen])
    strong = values > 1e-6 * values[-1]
    whiten = vectors[:, strong] / np.sqrt(values[strong])
    feature = kernel @ whiten
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    middle, mean = feature.mean(0), target.mean(0)
    centred = feature - middle
    normal = centred.T @ centred + ridge * len(rows) * np.eye(centred.shape[1])
    beta = np.linalg.solve(normal, centred.T @ (target - mean))
    return codes, held, scale, whiten @ beta, mean - middle @ beta, languages


def _blocks(body: list):
    """Slices of at most ``BLOCK_ROWS`` texts and, but for a single text, ``BLOCK_BYTES``."""
    at = 0
    while at < len(body):
        to, size = at, 0
        while to < len(body) and to - at < BLOCK_ROWS and (to == at or size + len(body[to]) <= BLOCK_BYTES):
            size += len(body[to])
            to += 1
        yield slice(at, to)
        at = to


def _grams(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        langs, body = batch.column(0).to_pylist(), texts(batch.column(1))
        out = []
        for lang, t in zip(langs, body):
            p = Presence([t.decode()])
            if len(p.codes):
                out.append((lang, p.codes.astype(np.int64).tobytes()))
        columns = list(zip(*out)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary())], names=["lang", "grams"])


def learned(docs: DataFrame, train: Column, *, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple | None:
    """A classifier's state from the rows of ``train`` with a language and a letter, or None without any."""
    body = F.col(text).cast("string")
    rows = docs.where(train & F.col(lang).isNotNull() & body.rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(body).alias("h"), body.alias("text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h", 0.02).alias("texts"))
    common = counts.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not common:
        return None
    each = max(2, sample_rows // len(common))
    names = sorted((r.lang for r in common), key=str.encode)
    # of a language with many texts, only about twice the wanted number have hashes that small
    ends = [(r.lang, min(2**63 - 1, int(2**64 * (2 * each + 50) / max(1, r.texts)) - 2**63)) for r in common]
    top = F.broadcast(docs.sparkSession.createDataFrame(ends, "lang string, top bigint"))
    order = Window.partitionBy("lang").orderBy("h")
    least = rows.join(top, "lang").where("h <= top").select("lang", "h").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= each)
    keys = stored(least.select("lang", "h"), "language-sample")
    sample = rows.join(F.broadcast(keys), ["lang", "h"]).select("lang", "text", "h")  # at most SAMPLE_ROWS keys
    grams = sample.dropDuplicates(["lang", "h"]).orderBy("lang", "h").select("lang", "text").mapInArrow(_grams, "lang string, grams binary")
    found = [(r.lang, bytes(r.grams)) for r in grams.collect()]
    held = {name for name, _ in found}
    return fitted(found, [n for n in names if n in held], landmarks, ridge) if found else None


def identified(docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, **options) -> DataFrame:
    """Rows ``(id, held_out, lang_pred, score)``; rows whose ``crc32`` of the id as text is 0 modulo ``folds`` are not learned from."""
    out = crc32_out(F.col(id), folds)
    state = learned(docs, ~out, text=text, lang=lang, **options)
    model = docs.sparkSession.sparkContext.broadcast(state)  # n-grams of at most LANDMARKS texts or two per language

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = Classifier(model.value) if model.value else None
        for batch in batches:
            body = [t.decode() for t in texts(batch.column(2))]
            names, scores = ["und"] * len(body), np.zeros(len(body))
            for at in _blocks(body) if known else ():
                some = Presence(body[at])
                value = np.round(known.scores(some), 9)
                best = value.argmax(1)
                for k in np.flatnonzero(some.sizes > 0).tolist():
                    names[at.start + k] = known.languages[best[k]]
                    scores[at.start + k] = min(1.0, max(0.0, (value[k, best[k]] + 1) / 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], names=[*batch.schema.names[:2], "lang_pred", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    done = docs.select(F.col(id).alias("id"), out.alias("held_out"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    names = unused(docs.select(id), "held_out", "lang_pred", "score")
    return done.toDF(id, *names)


def crc32_out(id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % folds == 0
