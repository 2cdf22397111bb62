"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lakeknit.llm import bpe, decontaminate, fingerprints, langid, pii, quality, simhash, substrings, toxicity, urls

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")
LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (2, ""), (3, None), (None, "a b c d e f"), (None, None), (4, LONG), (5, "\u00e9t\u00e9 \U0001f600 'S\u2003x"), (6, "   \n\t "), (7, "9" * 30_000), (8, "a" * 30_000)]
CLASH = ["score", "n_words", "spans", "fp", "words", "ids", "component_id", "fingerprint", "part", "kind", "th", "lang_pred", "k", "item_id", "host", "__rid", "__t"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit("other") for c in CLASH})


@pytest.fixture(scope="module")
def models():
    lang = langid.Mixture([("en", "the cat is on the mat and the dog"), ("fr", "le chat est sur la table et le chien")])
    good = [(1, f"This is a fine sentence number {i}. It goes on and ends.") for i in range(20)]
    bad = [(0, "BUY!! NOW!! " * (3 + i)) for i in range(20)]
    tox = [(1, f"word{i} you idiot and more text{i}") for i in range(20)] + [(0, f"word{i} a kind and calm text{i}") for i in range(40)]
    return lang, quality.Neighbours(good + bad), toxicity.Machine(tox)


def operators(models, spark):
    lang, qual, tox = models
    items = spark.createDataFrame([(1, "a b c d e f"), (2, None), (None, "a b c"), (3, "")], "item_id long, text string")
    trees = pii.fit(spark)
    return {
        "substrings": lambda d: substrings.dedup_substrings(d),
        "simhash": lambda d: simhash.near_duplicates(d),
        "quality": lambda d: quality.classify(d, qual),
        "pii": lambda d: pii.find(d, trees).select("doc_id", pii.written(F.col("base")), pii.written(F.col("spans")), pii.redacted(F.col("text"), F.col("spans")).alias("red")),
        "fingerprints": lambda d: fingerprints.compare_neighbours(d),
        "digests": lambda d: fingerprints.fingerprint_documents(d),
        "groups": lambda d: fingerprints.exact_groups(d),
        "toxicity": lambda d: toxicity.classify(d, tox),
        "language": lambda d: langid.identify(d, lang),
        "tokens": lambda d: bpe.round_trips(d, RANKS),
        "encode": lambda d: bpe.encode_documents(d, RANKS),
        "decontaminate": lambda d: decontaminate.decontaminate(d, items),
    }


NAMES = ["substrings", "simhash", "quality", "pii", "fingerprints", "digests", "groups", "toxicity", "language", "tokens", "encode", "decontaminate"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(spark, docs, models, name):
    got = operators(models, spark)[name](docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS)
    same = {str(r[1:]) for r in got if r.doc_id == 1}
    assert len(same) == 1 or name == "fingerprints"  # equal rows, equal results, but for what follows them


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, docs, models, name):
    assert operators(models, spark)[name](docs.filter("false")).count() == 0


def test_models_without_rows():
    assert quality.Neighbours([]).scores([b"x", None]) == [0.5, 0.5]
    assert toxicity.Machine([]).scores([b"x"])[0] < 0.5
    assert langid.Mixture([]).predict(b"abc") == ("und", 0.0)


def test_language_edges(models):
    lang = models[0]
    assert lang.predict(b"") == ("und", 0.0)
    assert lang.predict("12 !? \u2014".encode()) == ("und", 0.0)
    assert lang.predict("le chien est sur la table".encode())[0] == "fr"


def test_quality_and_toxicity_edges(models):
    _, qual, tox = models
    a, b, c, d = qual.scores([b"This is a fine sentence. It ends.", b"SELL!! NOW!! SELL!! NOW!!", None, b""])
    assert a > 0.5 > b and c == d
    for t in (b"you are an idiot", b"you are an i d i o t", b"an id.iot here", b"what an i*d*i*o*t"):
        assert tox.scores([t])[0] >= 0.5, t
    assert tox.scores([b"a calm and kind word"])[0] < 0.5


def test_null_text_is_an_empty_one(spark, docs):
    rows = {r.doc_id: r for r in bpe.round_trips(docs, RANKS).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert rows[3].n_tokens == rows[2].n_tokens == 0 and rows[3].ids_sha256 == rows[2].ids_sha256 == nothing
    prints = {r.doc_id: r.fp for r in simhash.fingerprints(docs).collect()}
    assert prints[2] == prints[3] == prints[6] == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.com/en/x?y"), (2, None), (3, "no url"), (4, "http://bad.org"), (4, "http://bad.org"), (None, "HTTP://x.bad.org/p/q#f"), (5, "http://www.example.com/en/"), (6, "x://net/es/"), (7, "http://ok.org/deep/a/b")], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("entry", F.lit(2))
    listed = spark.createDataFrame([("bad.org/",), ("ok.org/deep/",), (None,)], "url string")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    got = {}
    for r in urls.judge(pages, rules, listed).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("a.example.com", "/en/x", "example.com/en/", "block")]
    assert got[2] == got[3] == [("", "", None, "allow")]
    assert got[4] == [("bad.org", "", None, "block")] * 2
    assert got[None] == [("x.bad.org", "/p/q", None, "block")]
    assert got[5][0][2:] == ("www.example.com/en/", "allow") and got[6][0][2:] == ("net/es/", "block") and got[7][0][3] == "block"
    assert urls.judge(pages.filter("false"), rules, listed).count() == 0
    assert urls.judge(pages, rules, listed.filter("false")).filter("verdict = 'block'").count() == 2


def test_urls_by_canonical_form(spark):
    deep = "http://" + "s." * 40 + "long.org/" + "f/" * 3000 + "x"
    blocked = ["http://z.a.b.c.d.e.example.org/q", "http://x.org/1/2/3/4/p.html", "http://user@bad.org/x", "http://bad.org:80/x", "http://BAD.org./x", "http://bad.org//x/../y", "http://x.org/1/2/0/../3/4/p", "http://p.org/page.html?q", deep]
    allowed = ["http://a.b.c.d.f.example.org/q", "http://x.org/1/2/3/p.html", "http://notbad.org/x", "http://x.org/1/2/3/4/../p", "http://p.org/page.html/x", "http://p.org/", "http://@", "http://...", "http://:80/", "://"]
    listed = [("https://a.b.c.d.e.example.org/", 1), ("x.org/1/2/3/4/", 2), ("bad.org", 3), ("bad.org/", 4), ("http://p.org/page.html#top", 5), ("", 6), (None, 7), ("s.long.org/f/f/", 8)]
    entries = spark.createDataFrame(listed, "url string, entry int").withColumns({c: F.lit("x") for c in ("block", "mask", "host", "h")})
    pages = spark.createDataFrame(list(enumerate(blocked + allowed)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, [], entries).collect()}
    assert [u for i, u in enumerate(blocked) if got[i] != "block"] == []
    assert [u for i, u in enumerate(allowed) if got[i + len(blocked)] != "allow"] == []


def test_bloom_filter_grows_with_the_list(spark):
    entries = urls.listed_entries(spark.range(3000).selectExpr("concat('h', id, '.org/') AS url"))
    blocks = urls.filter_blocks(3000)
    sieve = {r.block: r["mask"] for r in urls.bloom(entries, blocks).collect()}
    ask = spark.range(3000, 9000).selectExpr("concat('h', id, '.org/') AS entry")
    passed = sum((sieve.get(r.b, 0) & r.m) == r.m for r in ask.select(urls._block(F.col("entry"), blocks).alias("b"), urls._mask(F.col("entry")).alias("m")).collect())
    assert passed < 0.1 * 6000


def test_staging_trims_the_driver(spark, monkeypatch):
    """What the driver's threads have freed goes back to the system whenever a table is staged; a JVM that can't do so isn't asked for more."""
    from lakeknit.llm import common
    from lakeknit.sources import staging

    done = []
    monkeypatch.setattr(staging, "trim", lambda s, own=staging.trim: done.append(own(s)))
    assert common.staged(spark.range(3), "three").count() == 3
    assert done == [True]
