"""Prefix join, vector index, URL filter: against brute force, and odd rows."""

import math
import random

import pytest

from panelcast.llm import components, prefix_join, url_filter, vector_index


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def word_sets(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def similar(texts):
    """Components by comparing all pairs."""
    sets = {i: word_sets(t) for i, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and (sets[a] & sets[b])
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in roots(sets, links).items()}


def corpus(seed, families, copies, words=60, edits=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(families):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, words))]
        for _ in range(rnd.randint(1, copies)):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                own += passage
            texts.append(" ".join(own))
    rnd.shuffle(texts)
    return list(enumerate(texts))


def joined(spark, rows):
    docs = frame(spark, rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in prefix_join.near_duplicates(docs).collect()}


def test_prefix_join_is_brute_force(spark):
    rows = corpus(1, 25, 9) + [(900, None), (901, ""), (902, " \n\t "), (903, "a b"), (904, "A\tB"), (905, "ab"),
                               (906, "é È a b c d"), (907, "é È A b c d"), (908, "x\u00a0y"), (909, "z " * 30_000)]
    assert joined(spark, rows) == similar(rows)


def test_prefix_join_with_frequent_shingles_and_many_rounds(spark, monkeypatch):
    """Short lists and buckets drive all entries through dealing, rounds and the last comparison."""
    monkeypatch.setattr(prefix_join, "BUCKET", 3)
    monkeypatch.setattr(prefix_join, "LEAST_COUNT", 2)
    monkeypatch.setattr(prefix_join, "ROUNDS", 1)
    monkeypatch.setattr(prefix_join, "FEW", 2)
    rows = corpus(2, 6, 25, words=30, edits=2)
    assert joined(spark, rows) == similar(rows)


def test_prefix_join_odd_tables(spark):
    empty = frame(spark, [], "doc_id long, text string")
    assert prefix_join.near_duplicates(empty).count() == 0
    rows = [(1, "one two three four five six", 7), (1, "one two three four five six", 8), (None, "one two three four five six", 9),
            (None, "only here are these five words", 9)]
    docs = frame(spark, rows, "doc_id long, text string, component_id int")
    got = sorted(map(tuple, prefix_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 2, None)], key=str)


def vectors(seed, families, copies, size=8):
    rnd = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [rnd.gauss(0, 1) for _ in range(size)]
        label = rnd.randint(0, 2)
        for _ in range(rnd.randint(1, copies)):
            noise = rnd.choice([0.0, 0.02, 0.1, 0.3])
            rows.append((len(rows), rnd.choice([label, label, 1]), [x + rnd.gauss(0, noise) for x in base]))
    return rows


def cosine_links(rows):
    def good(r):
        v = r[2]
        return r[0] is not None and r[1] is not None and v and all(
            x is not None and math.isfinite(x) for x in v) and any(v)

    fine, found = [r for r in rows if good(r)], []
    for a in fine:
        for b in fine:
            if a[0] < b[0] and a[1] == b[1] and len(a[2]) == len(b[2]):
                dot = sum(x * y for x, y in zip(a[2], b[2], strict=True))
                if dot / math.sqrt(sum(x * x for x in a[2]) * sum(x * x for x in b[2])) >= 0.98:
                    found.append((a[0], b[0]))
    return found


@pytest.mark.parametrize("block", [1_500, 4])
def test_vector_index_finds_the_links(spark, monkeypatch, block):
    monkeypatch.setattr(vector_index, "BLOCK", block)
    rows = vectors(3, 60, 12)
    got = vector_index.near_duplicates(frame(spark, rows, "vec_id long, label int, embedding array<double>")).collect()
    links = cosine_links(rows)
    near = roots([r[0] for r in rows], links)
    found = sum(r["n_links"] for r in got)
    assert found <= 2 * len(links) and found >= 0.9 * 2 * len(links)
    assert all(r["component_id"] >= near[r["vec_id"]] and r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert sum(r["component_id"] == near[r["vec_id"]] for r in got) >= 0.9 * len(rows)


def test_vector_index_exact(spark):
    """Every cell that can hold a partner is visited: no link is lost. One component is a vector, too."""
    rows = vectors(4, 60, 12) + [(5000, 7, [1.0]), (5001, 7, [3.0]), (5002, 7, [-2.0]), (5003, 7, [0.0])]
    table = frame(spark, rows, "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_index.near_duplicates(table, exact=True).collect()}
    links = cosine_links(rows)
    near, n = roots([r[0] for r in rows], links), {}
    for pair in links:
        for i in pair:
            n[i] = n.get(i, 0) + 1
    assert got == {r[0]: (n.get(r[0], 0), near[r[0]]) for r in rows} and got[5001] == (1, 5000)


def test_vector_index_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (3, 1, [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, 0, None), (6, 0, [0.0, 0.0]),
            (7, 0, [nan, 1.0]), (8, 0, [inf, 1.0]), (9, 0, [None, 1.0]), (10, 0, []), (11, 0, [1.0, 0.0, 0.0]),
            (12, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0])]
    table = frame(spark, [(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, n_links string")
    got = sorted(map(tuple, vector_index.near_duplicates(table).collect()))
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (12, 3, 1, False), *alone])
    empty = frame(spark, [], "vec_id long, label int, embedding array<float>")
    assert vector_index.near_duplicates(empty).count() == 0


def test_components(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)]
    got = {r[0]: r[1] for r in components.components(frame(spark, links, "a long, b long")).collect()}
    want = roots({x for e in links for x in e}, links)
    assert got == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in links)}
    assert components.components(frame(spark, [], "a long, b long")).count() == 0


URLS = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.NET/en/x?y#z", "http://a.example.net/en/", "http://example.net",
        "http://example.net/fr/1", "http://sub.example.com/de/4", "http://example.com/de", "http://x.org/fr/1", "http://net/x",
        "http://notnet/x", "http://bad.tld//p/?b=2&utm_source=q&a=1", "http://www.bad.tld:80/p?a=1&b=2#f", "http://good.tld/p"]


def test_url_filter(spark):
    pages = frame(spark, [(i, u, "keep out") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    listed = frame(spark, [("https://bad.tld/p/?a=1&b=2",), (None,), ("",)], "url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(pages, listed).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("www.example.net", "/en/x", "example.net/en/", "allow"), 5: ("a.example.net", "/en/", "example.net/en/", "allow"),
        6: ("example.net", "", None, "allow"), 7: ("example.net", "/fr/1", "net/", "block"),
        8: ("sub.example.com", "/de/4", "example.com/de/", "block"), 9: ("example.com", "/de", None, "allow"),
        10: ("x.org", "/fr/1", "org/fr/", "allow"), 11: ("net", "/x", "net/", "block"), 12: ("notnet", "/x", None, "allow"),
        13: ("bad.tld", "//p/", None, "block"), 14: ("www.bad.tld:80", "/p", None, "block"), 15: ("good.tld", "/p", None, "allow")}


def test_bloom_filter_passes_every_listed_url(spark, monkeypatch):
    urls = spark.range(3_000).selectExpr("concat('http://h', id % 50, '.tld/p', id) as url")
    listed = urls.where("crc32(url) % 3 = 0")
    want = {r[0] for r in listed.select(url_filter.canonical("url")).collect()}
    assert {r[0] for r in url_filter.listed_urls(urls, listed).collect()} == want
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", 0)
    assert {r[0] for r in url_filter.listed_urls(urls, listed).collect()} == want
    assert url_filter.listed_urls(urls, listed.limit(0)).count() == 0
