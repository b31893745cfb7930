"""The findings of round three: what the join asks of the driver, and what the search for leaks costs."""

import cProfile
import pstats
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_matching import corpus, similar

from panelcast.llm import decontaminate, prefix_join
from panelcast.llm.common import counted


def test_the_join_asks_few_queries_of_the_driver(spark, monkeypatch):
    """Each query keeps threads and memory of the driver for a while; sizes are seen while tables are written."""
    monkeypatch.setattr(prefix_join, "BUCKET", 3)
    monkeypatch.setattr(prefix_join, "LEAST_COUNT", 2)
    monkeypatch.setattr(prefix_join, "ROUNDS", 1)
    monkeypatch.setattr(prefix_join, "FEW", 2)
    rows = corpus(2, 6, 25, words=30, edits=2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    context = spark.sparkContext
    context.setJobGroup("few-queries", "the join")
    try:
        got = prefix_join.near_duplicates(docs).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == similar(rows)
    # 111 jobs; with counts and marks of their own there were 182.
    assert len(context.statusTracker().getJobIdsForGroup("few-queries")) <= 130


@pytest.mark.parametrize("rows", [0, 7])
def test_counted_sees_what_is_written(spark, rows):
    for df in (spark.range(rows), spark.createDataFrame([(i,) for i in range(rows)], "id long").where("id >= 0").distinct()):
        out, seen = counted(df, "counted", total=F.sum("id"))
        assert seen == {"rows": rows, "total": 21 if rows else None} and out.count() == rows


def leak_index(rnd, vocabulary, n=60):
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 90))) + rnd.choice([".", "? b."])) for i in range(n)]
    cut = [decontaminate.words(t) for _, t in items]
    return items, decontaminate.LeakIndex(items, Counter(w for x in cut for w in set(x)), n, sum(map(len, cut)) / n)


def test_texts_are_searched_together(spark):
    """80,000 words take some 70,000 calls, most of them to verify what was retrieved; it was over a million."""
    rnd, vocabulary = random.Random(5), [f"w{i}" for i in range(400)]
    _, index = leak_index(rnd, vocabulary)
    texts = pd.Series([" ".join(rnd.choice(vocabulary) for _ in range(400)) for _ in range(200)])
    search = decontaminate._leaks_of(index).func
    search(texts)
    profile = cProfile.Profile()
    profile.runcall(search, texts)
    assert pstats.Stats(profile).total_calls < 150_000


def test_a_slice_finds_what_each_text_alone_finds(monkeypatch):
    """Against each passage's scores by the definition; also with slices cut short, empty texts and one long one."""
    rnd, vocabulary = random.Random(6), [f"w{i}" for i in range(60)]
    items, index = leak_index(rnd, vocabulary)
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 500))) + " " + rnd.choice([*items, (0, "")])[1] for _ in range(80)]
    texts = [None, *texts[:9], "", None, " ", *texts[9:], " ".join(texts), ""]
    asked, chunk = [decontaminate.words(t) for t in texts], index.chunk
    got, want = index.retrieve(asked), {}
    for k, tokens in enumerate(asked):
        for p in range(-(-len(tokens) // chunk)):
            terms = decontaminate.np.array(sorted({index.terms[w] for w in tokens[p * chunk:(p + 2) * chunk] if w in index.terms}))
            scores = [x for b in range(index.index.n_blocks) for x in index.index.scores(b, terms, decontaminate.np.ones(len(terms)))] if len(terms) else []
            best = {}
            for entry, score in enumerate(scores):
                if score >= decontaminate.MIN_SCORE:
                    best[int(index.owner[entry])] = max(best.get(int(index.owner[entry]), 0.0), float(score))
            if best:
                want[k, p] = best
    assert len(want) > 40 and got == want
    whole = index.leaks(texts)
    monkeypatch.setattr(decontaminate, "WORDS_AT_A_TIME", 700)
    monkeypatch.setattr(decontaminate, "TERMS_AT_A_TIME", 1)
    assert index.leaks(texts) == whole == [index.leaks([t])[0] for t in texts] and sum(map(len, whole)) > 40


def test_words_of_latin_texts_are_those_of_any_text():
    for i in range(256):
        sign = chr(i)
        for text in (sign, f"a{sign}B", f"{sign} {sign}{sign}c"):
            assert decontaminate.words(text) == decontaminate.words(f"{text} \u20ac") == decontaminate._SPACED.findall(text.lower())
