"""Each stage of the corpus pipeline, and all of them, on odd rows, against what plain Python expects."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

pytest.importorskip("public_tokenizers")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "what is the capital of the far land beyond the seven blue hills and rivers"


def sentences(rng, n=12):
    words = ["river", "stone", "house", "green", "walked", "slowly", "over", "the", "bridge", "and", "looked", "at", "old", "trees", "while", "rain", "fell", "softly"]
    return " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(5, 9))).capitalize() + "." for _ in range(n))


def junk(rng):
    return " ".join(rng.choice(["BUY!!", "NOW!!", "WIN!!", "CASH!!", "FREE!!"]) for _ in range(40))


def corpus():
    rng = random.Random(12)
    rows = [(i, sentences(rng)) for i in range(20)] + [(100 + i, junk(rng)) for i in range(20)]
    rows += [(200, sentences(rng) + " " + ITEM), (201, sentences(rng) + " Write to jane@example.com today."), (202, rows[0][1] + " One more."), (203, rows[1][1]), (203, rows[1][1]), (None, sentences(rng)), (204, None), (205, "")]
    return [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]


def write(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    labels = [(i, 1, 0) for i in range(16)] + [(100 + i, 0, 0) for i in range(16)] + [(None, 0, 0), (3, None, 0)]
    return write(spark, tmp_path_factory.mktemp("corpus"), corpus(), labels, [(1, ITEM), (2, None), (None, "a b"), (3, "")])


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("nothing"), [], [], [])


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit("other") for c in ("score", "spans", "t1", "row", "fp", "words", "__th", "n_words")})


def test_quality_stage(spark, folder, nothing):
    got = corpus_pipeline.keep_quality(spark, docs_of(spark, folder), folder)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    ids = [r.doc_id for r in got.collect()]
    assert not [i for i in ids if i is not None and 100 <= i < 120]
    assert {*range(20), 200, 201, 202, None} <= set(ids) and ids.count(203) == 2
    assert corpus_pipeline.keep_quality(spark, docs_of(spark, folder), nothing).count() == len(corpus())  # no labels, no judgement


def test_decontamination_stage(spark, folder, nothing):
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs_of(spark, folder), folder).collect()]
    assert sorted(map(str, got)) == sorted(str((i, t)) for i, t, *_ in corpus() if i != 200)
    assert corpus_pipeline.drop_contaminated(spark, docs_of(spark, folder), nothing).count() == len(corpus())


def test_personal_data_stage(spark, folder):
    got = {(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.redact(spark, docs_of(spark, folder), folder).collect()}
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    want = [(i, t and email.sub("[EMAIL]", t)) for i, t, *_ in corpus()]
    assert got == {(i, t, None if t is None else len(t)) for i, t in want}


def test_token_stage(spark, folder):
    import public_tokenizers
    import tiktoken

    from lakeknit.llm import bpe

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))).rank, special_tokens={})
    got = sorted(str((r.doc_id, r.n_tokens)) for r in corpus_pipeline.encode(spark, docs_of(spark, folder), folder).collect())
    assert got == sorted(str((i, len(encoding.encode_ordinary(t or "")))) for i, t, *_ in corpus())


def test_run(spark, folder, nothing):
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    got = [r.doc_id for r in corpus_pipeline.run(spark, folder).collect()]
    assert len(got) == len(set(got))
    # 202 and 203 repeat 0 and 1; 200 is contaminated; of the texts without words, one may stay.
    assert {*range(20), 201, None} <= set(got) and not set(got) & {200, 202, 203, 205, *range(100, 120)}
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_quality_learns_in_a_task(spark, folder, monkeypatch):
    """No text comes to the driver, and the model is the one of the rows chosen."""
    import numpy as np

    from lakeknit.llm import common, quality

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").withColumn("__fit_chars", F.length("text"))
    want = quality.Neighbours(common.fit_sample(rows, "quality", F.lit(True), "doc_id", "text", quality.TRAIN_PER_CLASS))
    collect, seen = type(docs).collect, []
    monkeypatch.setattr(type(docs), "collect", lambda self: seen.append(self.columns) or collect(self))
    got = quality.fit(docs, labels, F.lit(True))
    assert seen == [["model"]]
    asked = [r.text.encode() for r in docs.filter("text IS NOT NULL").orderBy("doc_id").limit(200).toLocalIterator()]
    assert np.allclose(got.scores(asked), want.scores(asked), atol=1e-3) and not got.empty and got.prior == want.prior and got.axes.shape == want.axes.shape
    empty = quality.fit(docs, labels, F.lit(False))
    assert empty.empty and empty.scores([b"x"]) == [0.5]
