"""Near-duplicates by similarity, against brute force and on odd inputs; the pipeline's stage that uses them."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeknit.llm import similar

SCHEMA = "doc_id long, text string"


def sets(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def by_force(rows, similarity=0.8):
    """The smallest id that links reach, for each id."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    words = [(i, (t or "").lower().split(), sets(t)) for i, t in rows]
    for n, (i, v, a) in enumerate(words):
        for j, w, b in words[:n]:
            if v == w or a and b and len(a & b) >= similarity * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def texts(seed, groups, copies, words=120, most=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            copy = list(base)
            for at in rng.sample(range(words), rng.randint(0, most)):
                copy[at] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out, 1))


def found(spark, rows):
    got = similar.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    return {r.doc_id: r.component_id for r in got}, got


def test_many_small_groups(spark):
    rows = texts(1, 60, 4)
    got, _ = found(spark, rows)
    want = by_force(rows)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert all(want[got[i]] == want[i] for i in want)  # no link that brute force hasn't


def test_dense_group_and_short_texts_are_exact(spark):
    rng = random.Random(8)
    rows = texts(2, 1, 300, 150, 4) + [(1000 + i, t) for i, t in texts(3, 40, 1)]
    for i in range(150):  # a word more, or one changed, in texts of 5 to 40 words: many at the border of the similarity
        base = [f"s{i}-{k}" for k in range(rng.randint(5, 40))]
        other = [*base, "more"] if i % 2 else [*base[:-1], "other"]
        rows += [(2000 + 2 * i, " ".join(base)), (2001 + 2 * i, " ".join(other))]
    got, _ = found(spark, rows)
    want = by_force(rows)
    small = [i for i in want if i >= 2000]
    assert sum(want[i] != i for i in small) > 50
    assert all(got[i] == want[i] for i in want)


def test_odd_rows(spark):
    long = " ".join(f"x{i % 9001}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (5, "ONE  two"), (None, "one two"), (None, "alone here"), (7, long), (8, long + " end"), (9, "one three")]
    _, got = found(spark, rows)
    assert len(got) == len(rows)
    pairs = sorted((r.doc_id or 0, r.component_id or 0) for r in got)
    assert pairs == [(0, 0), (0, 4), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (7, 7), (8, 7), (9, 9)]
    assert similar.similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert similar.similar_documents(spark.createDataFrame([(1, None), (2, None)], SCHEMA)).count() == 2


@pytest.mark.parametrize("extra", ["key", "component_id"])
def test_pipeline_keeps_one_of_each_group(spark, extra):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "something else altogether"), (None, "a b c d e f g"), (None, "only here"), (3, "something else altogether"), (3, "the same id with another text"), (None, "only  HERE")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long")).withColumn(extra, F.lit(5))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert sorted((r.doc_id or 0, r.text.lower().replace("  ", " ")) for r in kept.collect()) == [(0, "only here"), (1, "a b c d e f g"), (3, "something else altogether"), (3, "the same id with another text")]


@pytest.mark.parametrize("buckets", [8, similar.BUCKETS])
def test_rare_shingles_of_near_copies_are_not_looked_up(spark, monkeypatch, buckets):
    """A group of near copies sends on its rarest shingles only, however few buckets put them in order; the links are those of brute force."""
    monkeypatch.setattr(similar, "BUCKETS", buckets)
    rows = texts(4, 1, 200, 100, 8) + [(1000 + i, t) for i, t in texts(5, 20, 3, 40, 1)]
    sets_ = similar.staged(similar.signatures(spark.createDataFrame(rows, SCHEMA)).select("key", "parts").dropDuplicates(["key"]), "sets")
    rare = similar.rare_parts(sets_, 0.8)
    assert "Join" not in rare._jdf.queryExecution().executedPlan().toString()
    assert 0 < rare.count() < 0.25 * sum(len(r.parts) for r in sets_.collect())
    monkeypatch.setattr(similar, "FEW", 10**6)  # all texts are compared by their sets
    got, _ = found(spark, rows)
    assert got == by_force(rows)
