"""One query per operator and the SQL that checks those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, divergence, html_text, jaccard_join, line_dedup, lm_scoring, mixing, passage_dedup, quality_rules, string_kernel
from . import suffix_dedup, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the library from where it lies; a cluster gets it by ``--py-files``."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH"))))
    return spark


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: run(importable(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op7_line_dedup", f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split),
keyed AS (SELECT doc_id, line, pos, translate(trim(line, {BLANK}), {LOWER}) AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT y.doc_id, y.line, y.pos, s.k IS NOT NULL AND s.keeper <> y.doc_id AS gone FROM keyed y LEFT JOIN shared s ON y.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op7_line_dedup(spark, sf_dir):
    done = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"), min_docs=3, min_chars=20)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    done = quality_rules.judged(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query("op4_benchmark_decontamination")
def op4_benchmark_decontamination(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontamination.contaminated(docs, items, short=True)


@query("op5_source_mixing")
def op5_source_mixing(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents", "doc_id", "text", "source"), max_repeats=4.0, block_tokens=1_000_000)


@query("op8_passage_dedup")
def op8_passage_dedup(spark, sf_dir):
    done = passage_dedup.remove_repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"), window=20)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"), length=3, percent=90)


@query("op1_warc", """
WITH heads AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
keepers AS (SELECT d, n, max(page_id) AS keeper FROM heads WHERE n >= 1000 GROUP BY d, n)
SELECT h.page_id, h.n AS payload_bytes, h.d AS payload_digest,
  CASE WHEN k.keeper <> h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.keeper <> h.page_id THEN k.keeper END AS refers_to
FROM heads h LEFT JOIN keepers k ON h.d = k.d AND h.n = k.n
""")
def op1_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    folder, captures, parts = warc.written(pages)
    return warc.fetched(folder, parts, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_html_extraction")
def op2_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    done = pages.withColumn("text", html_text.extracted(F.col("html"))).drop("html")
    return done.withColumn("n_chars", F.length("text").cast("bigint"))


@query("op6_lm_scoring")
def op6_lm_scoring(spark, sf_dir):
    return lm_scoring.scored(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    done = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents", "doc_id", "text"), span=100)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_source_divergence", rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
cnt AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
lang_cnt AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM cnt GROUP BY lang, term),
size AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM lang_cnt GROUP BY lang),
grp AS (SELECT d.lang, d.source, coalesce((SELECT sum(n) FROM cnt c WHERE c.lang = d.lang AND c.source = d.source), 0)::HUGEINT AS total
    FROM (SELECT DISTINCT lang, source FROM d) d),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + s.v) AS p
    FROM grp g JOIN size s USING (lang) JOIN kept k USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 1)) // (total + v) AS q FROM lang_cnt JOIN size USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM terms),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS k FROM ranked)
SELECT lang, source, part, item, value::BIGINT AS value, k::INTEGER AS rank FROM numbered WHERE part = 'pair' OR k <= 200
""")
def op11_source_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents", "text", "lang", "source"), min_docs=3, top_terms=200)


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark, sf_dir):
    return alignment.aligned(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op13_language_id")
def op13_language_id(spark, sf_dir):
    return string_kernel.identified(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), folds=5)


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
