"""Near-copies, URL reputation, revisits, co-training, the pipeline and the registered queries."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from checks import compare
from kinfold.llm import circulant_minhash, cotraining, queries, revisits, url_reputation

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(docs):
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, sa) in enumerate(sets):
        for b, sb in sets[:k]:
            if sa and sb and 100 * len(sa & sb) >= 85 * len(sa | sb):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {(i, len(shingles(t)), root(i) if i is not None else None) for i, t in docs}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


def test_near_copies(spark, monkeypatch):
    """A source with many edited copies, of which few link to each other; chains; blocks smaller than the group."""
    monkeypatch.setattr(circulant_minhash, "BLOCK", 16)
    rng = random.Random(6)
    source = [f"s{i}" for i in range(150)]
    texts = [" ".join(source)] + [edited(rng, source, rng.choice([1, 2, 3, 5, 8])) for _ in range(60)]
    chain = [f"c{i}" for i in range(200)]
    for k in range(8):
        texts.append(" ".join(chain[k * 4 : k * 4 + 120]))
    texts += [" ".join(f"u{i}_{k}" for k in range(rng.randint(1, 30))) for i in range(20)]
    texts += [texts[3], texts[3].upper(), texts[3], None, "", " \n", "one", "ONE", "one two", "a b c d", "a b  c\td"]
    ids = list(range(10, 10 + len(texts)))
    rng.shuffle(ids)
    docs = [*zip(ids, texts, strict=True), (500, texts[70]), (500, texts[70]), (None, texts[0])]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("mine"))
    got = circulant_minhash.near_copies(rows).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(docs)
    assert len(got) == len(docs) and all(r.kept == (r.doc_id in (None, r.component_id)) for r in got)
    left = circulant_minhash.drop_near_copies(rows)
    assert left.columns == rows.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in got if r.kept}
    assert circulant_minhash.near_copies(rows.limit(0)).collect() == []


def test_near_copies_of_the_pipeline(spark):
    """The stage links from 0.8 on, op4 from 0.85: of a pair between, the stage keeps one document."""
    words = [f"p{i}" for i in range(120)]
    texts = [" ".join(words[:100]), " ".join(words[9:109]), " ".join(words[:100]).replace("p60 ", "q "), " ".join(words[13:113])]
    sets = [shingles(t) for t in texts]
    alike = [len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
    assert 0.8 <= alike[0] < 0.85 <= alike[1] and alike[2] < 0.8
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[0].replace("p", "o")), (4, texts[3].replace("p", "o"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()} == {1, 3, 4}
    assert {r.doc_id for r in circulant_minhash.drop_near_copies(docs).collect()} == {1, 2, 3, 4}


def test_urls(spark):
    cases = [
        ("http://a.net/x", "a.net", "/x", "net/", "block"),
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("http://a.net?x=/y", "a.net", "", None, "allow"),
        ("a.net/x", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("x://u@h.co.uk:80/p\nq", "u@h.co.uk:80", "/p\nq", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] + [(0, cases[0][0])], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.url_verdicts(pages, labels).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert url_reputation.url_verdicts(pages.limit(0), labels).collect() == []


def test_reputation_shrinks(spark):
    """Much bad evidence blocks a host; a host with one bad page is judged by its domain."""
    rows, labels = [], []
    for host, n, bad in (("bad.a.com", 60, 55), ("good.b.com", 60, 2), ("one.b.com", 1, 1), ("new.a.com", 1, 0), ("fine.c.com", 200, 5)):
        for k in range(n):
            rows.append((len(rows), f"http://{host}/{k}"))
            labels.append((len(labels), 0 if k < bad else 1, None))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    hosts = {r.host: r for r in url_reputation.host_reputation(pages, known).collect()}
    assert hosts["bad.a.com"].low > url_reputation.MAX_BAD > hosts["one.b.com"].low
    assert hosts["one.b.com"].mean < 1 and hosts["new.a.com"].mean > hosts["fine.c.com"].mean


def test_revisits(spark):
    full, seen = 200, 304
    rows = [
        (1, "http://www.A.com/x/?b=2&a=1&utm_source=z#f", 10, full, {"ETag": '"1"', "Content-Type": "html", "Date": "d1"}),
        (2, "https://a.com/x?a=1&b=2", 20, full, {"etag": '"2"', "X": "y"}),
        (3, "http://a.com/x?a=1&b=2", 15, seen, {"ETag": 'W/"1"', "Date": "d3", "X-Bad": "no"}),
        (4, "http://a.com/x?a=1&b=2", 30, seen, {"ETag": '"1"'}),
        (5, "http://a.com/x?a=1&b=2", 30, seen, None),
        (6, "http://a.com/x?a=1&b=2", 10, seen, {}),
        (7, "http://b.com/", 99, seen, {}),
        (8, None, 99, seen, {}),
        (9, "http://a.com/x?a=1&b=2", None, seen, {}),
        (10, "http://a.com/x?a=1&b=2", 20, full, {"etag": '"3"'}),
        (11, "http://a.com/x?a=1&b=2", 50, 404, {}),
    ]
    schema = "record_id long, url string, time long, status int, headers map<string,string>"
    captures = spark.createDataFrame(rows, schema).repartition(4)
    got = {r.record_id: (r.source_id, r.outcome, r.headers) for r in revisits.resolve_revisits(captures).collect()}
    assert got == {
        3: (1, "resolved", {"etag": 'W/"1"', "content-type": "html", "date": "d3"}),
        4: (10, "changed", None),
        5: (10, "unchecked", {"etag": '"3"'}),
        **{k: (None, "orphan", None) for k in (6, 7, 8, 9)},
    }
    assert revisits.resolve_revisits(captures.limit(0)).collect() == []


def test_revisits_of_a_hot_url(spark):
    """One URL over all range partitions: the last full response is carried across them."""
    rows = [(i, "http://a.com/", i, 200 if i % 500 == 0 else 304, {}) for i in range(3000)]
    captures = spark.createDataFrame(rows, "record_id long, url string, time long, status int, headers map<string,string>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.record_id: r.source_id for r in revisits.latest_full(captures.withColumn("canonical", F.lit("a"))).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: i // 500 * 500 for i in range(3000) if i % 500}


def test_co_training(spark):
    docs, labels, pages = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels", "pages"))
    train = labels.filter("doc_id % 3 <> 0")
    scores = cotraining.quality_scores(docs.withColumn("score", F.lit("x")), train, pages)
    held = scores.join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    right = [r.kept == (r.quality == 1 and r.toxic == 0) for r in held]
    assert scores.count() == 10_000 and sum(right) / len(right) > 0.93
    none = cotraining.quality_scores(docs.limit(20), labels.limit(0))
    assert all(r.kept and r.score == 0.5 for r in none.collect())
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "", "en", None, 0)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert cotraining.quality_scores(odd, train.limit(0), pages).count() == 2


def test_co_training_learns_from_all_unlabelled(spark):
    """A source that only unlabelled documents have is known to the metadata view by what the text view says of them."""
    rng = random.Random(8)

    def text(good):
        words = "clear plain useful careful" if good else "spam junk casino click"
        return " ".join(rng.choice([rng.choice(words.split()), f"w{rng.randrange(40)}"]) for _ in range(60))

    rows = [(i, text(i % 2), "en", ("a", "b")[i % 2] if rng.random() < 0.8 else "c", 300) for i in range(400)]
    rows += [(i, text(i % 2), "en", "c", 300) for i in range(400, 600)]
    rows += [(i, text(0), "en", "rare", 300) for i in range(600, 640)] + [(i, text(1), "en", "fine", 300) for i in range(640, 680)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in cotraining.quality_scores(docs, labels).collect()}
    assert len(got) == len(rows) and all(r.kept == (i >= 640 or (i < 600 and i % 2 == 1)) for i, r in got.items())
    assert got[600].metadata_score < 0.3 and got[640].metadata_score > 0.7


def test_pipeline(spark):
    docs = queries.table(spark, SF, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns, name
        assert kept.count() <= before.count()
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert 100 < len(texts) < 200
    pieces = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(texts)
    out = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert out.count() == 0


@pytest.mark.parametrize("key", sorted(__spark_entry__.llm_oracle.all_sql()))
def test_registered_queries(spark, key, monkeypatch):
    monkeypatch.setattr(compare, "all_queries", __spark_entry__.queries)
    monkeypatch.setattr(compare, "all_sql", __spark_entry__.oracle_sql)
    assert compare.compare(spark, compare.duck(SF), SF, key) is None
