"""Toxicity, quality, the pipeline: held-out accuracy, brute force, odd rows."""

import random

import numpy as np
import pytest

import corpus_pipeline
from panelcast.llm import quality, toxicity
from panelcast.llm.common import held_out, table

BAD = ["grob", "gemein", "fies"]


def labelled(seed, n=400):
    rnd = random.Random(seed)
    plain = [a + b + c for a in "bdfghk" for b in "aeiou" for c in "lmnrs"]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        toxic, good = int(rnd.random() < 0.3), int(rnd.random() < 0.7)
        if toxic:
            for _ in range(rnd.randint(2, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD) + rnd.choice(["", "er", "es"]))
        rows.append((i, " ".join(words if good else [w + "!!" for w in words])))
        labels.append((i, good, toxic))
    return rows, labels


ODD = [(1000, None), (1001, ""), (1002, "bal " * 20_000), (None, "bal bem"), (1003, "\n\t"), (1003, "\n\t")]


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = labelled(1)
    docs = spark.createDataFrame([(*r, "x") for r in rows + ODD], "doc_id long, text string, toxicity string")
    odd = [(None, 1, 1), (3, None, None), (1000, None, 1), (5000, 1, 1)]
    return docs, spark.createDataFrame(labels + odd, "doc_id long, quality int, toxic int"), {x[0]: x for x in labels}


def test_toxicity_on_held_out_rows(tables):
    docs, labels, truth = tables
    got = toxicity.scored(docs, toxicity.fit(docs, labels), into="t").select("doc_id", held_out().alias("h"), "t.score").collect()
    assert len(got) == 406 and all(0 <= r["score"] <= 1 for r in got)
    asked = [(r["score"] >= 0.5) == bool(truth[r["doc_id"]][2]) for r in got if r["h"] and r["doc_id"] in truth]
    assert len(asked) > 40 and np.mean(asked) >= 0.95
    assert all(r["score"] < 0.5 for r in got if r["doc_id"] is None or r["doc_id"] >= 1000)


def test_few_toxic_examples_teach_rare_words(spark):
    """At the least size the toxicity stage drops the documents that hold insults, and no other."""
    at = "/root/testdata/sf0.001"
    docs = table(spark, at, "documents")
    left = {r[0] for r in corpus_pipeline.drop_toxic(spark, docs, at).select("doc_id").collect()}
    assert {r[0] for r in docs.select("doc_id").collect()} - left == {21, 33, 35, 81, 129, 169, 171, 186}


def test_chance_is_that_of_all_terms_alike():
    assert toxicity.beyond_chance([(3, 3, 4), (3, 1, 300), (3, 0, 700), (1, 1, 150), (1, 0, 850)], 0.1) == [(3, 3)]
    assert toxicity.beyond_chance([(3, 3, 2), (3, 1, 30_000), (3, 0, 70_000)], 0.1) == []
    assert toxicity.beyond_chance([], 0.1) == toxicity.beyond_chance([(1, 1, 5)], 1.0) == []


def test_neighbours_are_the_nearest(tables):
    """Cosines of the index against all examples compared one by one."""
    docs, labels, _ = tables
    model = toxicity.fit(docs, labels)
    n, blocks = len(model.count), model.index.n_blocks
    dense = np.zeros((n, len(model.idf)))
    for cell in range(len(model.idf) * blocks):
        at = slice(model.index.starts[cell], model.index.starts[cell + 1])
        dense[model.index.items[at], cell // blocks] = model.index.weights[at]
    for text in ["grob bal", "gemeiner fieses grob", "bem", "", "fies fies fies grober"]:
        key = model.key(text)
        at, weight = model.vector(key)
        full = np.round(dense[:, at] @ weight, 9)
        items, cosines = model.nearest(key)
        order = np.lexsort((np.arange(n), -full))
        last = full[order][np.searchsorted(np.cumsum(model.count[order]), toxicity.NEIGHBOURS)]
        want = {int(i) for i in order if full[i] >= last and full[i] > 0}
        assert set(items.tolist()) == want and np.allclose(full[items], cosines)


def test_quality_on_held_out_rows(tables):
    docs, labels, truth = tables
    got = quality.scored(docs, quality.fit(docs, labels), into="toxicity").select("doc_id", held_out().alias("h"), "toxicity").collect()
    assert len(got) == 406 and all(0 <= r[2] <= 1 for r in got)
    asked = [(r[2] >= 0.3) == bool(truth[r[0]][1]) for r in got if r["h"] and r[0] in truth]
    assert np.mean(asked) >= 0.95


def test_context_sums_are_those_of_a_loop():
    rng = np.random.default_rng(1)
    rows, documents = rng.integers(0, quality.ROWS, 200).astype("i4"), np.repeat([0, 1, 2], [90, 1, 109])
    places, signs = quality.index_vectors()
    want = np.zeros((quality.ROWS, quality.WIDTH))
    for i in range(200):
        for j in range(max(0, i - quality.REACH), min(200, i + quality.REACH + 1)):
            if i != j and documents[i] == documents[j]:
                np.add.at(want[rows[i]], places[rows[j]], signs[rows[j]])
    assert np.array_equal(quality.context_sums(rows, documents, places, signs), want)


def test_repeated_ids_are_learned_from_once(spark, monkeypatch):
    """However many texts an id has, the examples stay bounded by the number of ids."""
    rows, labels = labelled(2, 60)
    docs = spark.createDataFrame(rows + [(1, f"text {i}") for i in range(50)] + [(1, None)], "doc_id long, text string")
    seen = []
    whole = quality.QualityModel.__init__
    monkeypatch.setattr(quality.QualityModel, "__init__", lambda self, v, x, y: (seen.append(len(y)), whole(self, v, x, y))[1])
    quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert seen == [docs.select("doc_id").distinct().where(~held_out()).count()]


def test_learning_from_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(0 <= r["t"]["score"] <= 1 for r in toxicity.scored(docs, toxicity.fit(docs, none), into="t").collect())
    assert all(0 <= r["q"] <= 1 for r in quality.scored(docs, quality.fit(docs, none), into="q").collect())
    empty = docs.limit(0)
    assert toxicity.scored(empty, toxicity.fit(empty, none)).count() == 0
    assert quality.scored(empty, quality.fit(empty, none)).count() == 0


def test_pipeline_stages(spark, sf):
    """Each stage on what the one before it kept: decisions take effect, other rows and all columns stay."""
    docs = table(spark, sf, "documents").withColumn("spans", docs_extra()).withColumn("blob", docs_extra())
    odd = docs.limit(1).selectExpr("9000001L as doc_id", "cast(null as string) as text", "lang", "source", "n_chars", "spans", "blob")
    docs = docs.unionByName(odd)
    kept = docs.select("doc_id").collect()
    for (name, stage), column in zip(corpus_pipeline.STAGES[:4], range(4), strict=True):
        after = corpus_pipeline.materialized(stage(spark, docs, sf), f"test-{name}")
        assert after.columns == docs.columns and after.count() <= docs.count()
        assert after.where("doc_id = 9000001").count() == 1
        if column == 3:
            assert after.count() == docs.count() and after.where("text like '%[secret]%'").count() > 0
        docs = after
    assert 0.5 * len(kept) < docs.count() < len(kept)
    last = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert last.count() == docs.count() and last.where("not decoded_ok").count() == 0


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_near_copies_keep_one(spark, sf):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "a"), (3, text + " eleven", "b"), (3, text + " eleven", "b"), (9, text.upper(), "c"), (None, text, "d"),
            (20, None, "e"), (21, "", "f"), (22, "", "g"), (30, "all of it is quite another text", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, sf).collect()), key=str)
    assert got == sorted([(3, text + " eleven", "b"), (20, None, "e"), (21, "", "f"), (22, "", "g"), rows[-1]], key=str)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), sf).count() == 0
