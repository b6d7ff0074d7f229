"""The pipeline: every stage on what its predecessor kept, against brute force, and the whole on odd tables."""

import collections
import random

import pytest
from test_operators import brute_hits, components_of, lowered, sets_of, words

import corpus_pipeline


def prose(rng, n):
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __id string, n_words string"
ITEMS = [(k, f"{prose(random.Random(k), 14).capitalize()}? {prose(random.Random(90 + k), 9).capitalize()}.") for k in range(6)] + [(7, None), (8, "")]


def corpus():
    """Clean documents of some length, exact and near copies, a common line, benchmark items, junk that the base rule rejects."""
    rng = random.Random(21)
    # the line dedup keeps a shared line in its largest id only; clean lines are long and their own
    body = lambda: "\n".join(prose(rng, rng.randint(25, 40)) for _ in range(rng.randint(3, 6)))
    rows = [(k, body()) for k in range(60)]
    rows += [(100 + k, rows[k][1].replace("\n", " ", 1) + f" extra{k}") for k in range(12)]  # near copies with lines of their own
    rows += [(200 + k, f"{body()}\nThis line stands in many documents of this corpus.") for k in range(8)]
    rows += [(300 + k, f"{body()}\n{ITEMS[k % 6][1]}\n{body()}") for k in range(7)]
    rows += [(400, "too few words"), (401, "again and " * 200), (402, None), (403, ""), (404, " \n\t ")]
    rows += [(500 + k, rows[3][1]) for k in range(3)]  # exact copies
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a"] * 5 + ["b", None]), None if t is None else len(t), "x", None) for i, t in rows] + [(None, rows[5][1], "en", "a", 1, None, None)] * 2


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Rows after each stage, each written and read again as the next one's documents."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [[(r.doc_id, r.text) for r in df.collect()] if k < 4 else df.collect() for k, df in enumerate(out)], [df.columns for df in out]


def test_stages_keep_columns(stages):
    assert all(columns == [f.split()[0] for f in SCHEMA.split(", ")] for columns in stages[1][:4])


def test_quality(stages):
    """The base rule by hand; a cell of few rows has no outliers but by a pool of 100."""
    sound = []
    for i, t, *_ in corpus():
        w = words(t)
        triples = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w):
            sound.append((i, t))
    assert sorted(map(str, stages[0][0])) == sorted(map(str, sound))


def test_lines(stages):
    before, after = stages[0][0], stages[0][1]
    holders = collections.defaultdict(list)  # every row counts; rows without an id keep a line only if no other has it
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in before:
        for k in {key(line) for line in t.split("\n")}:
            holders[k].append(i)
    want = []
    for i, t in before:
        kept = [x for x in t.split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)], key=lambda d: -1 if d is None else d) == i]
        if len(kept) == len(t.split("\n")) or words("\n".join(kept)):
            want.append((i, "\n".join(kept)))
    assert sorted(map(str, after)) == sorted(map(str, want)) and len(after) < len(before)


def test_near_duplicates(stages):
    before, after = stages[0][1], stages[0][2]
    found = components_of(sets_of([(i, t) for i, t in before if i is not None], 5), 80)
    assert sorted(str(i) for i, _ in after) == sorted(str(i) for i, _ in before if i is None or found[i][1] == i)
    assert set(after) <= set(before)
    assert len(before) - len(after) >= 3


def test_decontamination(stages):
    before, after = stages[0][2], stages[0][3]
    gone = {d for d, _ in brute_hits([x for x in before if x[0] is not None], ITEMS[:6], 0.7, 0.8)}
    assert sorted(str(i) for i, _ in after) == sorted(str(i) for i, _ in before if i not in gone)
    assert set(after) <= set(before) and len(gone) >= 3


def test_mixing(stages):
    before, after = stages[0][3], stages[0][4]
    copies = collections.Counter(r.doc_id for r in after)
    assert set(copies) == {i for i, _ in before} and max(copies.values()) <= 4 * max(1, sum(i is None for i, _ in before))
    assert len({(r.block, r.position) for r in after}) == len(after)


def test_run_and_empty_tables(spark, folder, stages, tmp_path):
    got = corpus_pipeline.run(spark, folder)
    assert sorted((str(r.doc_id), r.epoch) for r in got.collect()) == sorted((str(r.doc_id), r.epoch) for r in stages[0][4])
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
