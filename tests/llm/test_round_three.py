"""Chat formatting, resampling, clustering: brute force, round trips, odd rows."""

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelcast.llm import chat_format as C
from panelcast.llm import ptolemaic as P
from panelcast.llm import resampling as R

BITS = [*C.CONTROLS, "\\", "<", "[", ">", "|", "s", "/s>", "\n", "é", "turn|>", "<\\", "SYS>>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=8).map("".join))
def test_escapes_are_reversible_and_hide_controls(text):
    hidden = C.escaped(text)
    assert C.unescaped(hidden) == text and not any(c in hidden for c in C.CONTROLS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb\\", "</s>", ""]),
                          st.lists(st.sampled_from(BITS + ["@image", "@audio", "@video"]), max_size=6)), max_size=4))
def test_parts_are_read_back(turns):
    flat = C.Flattener()
    for role, bits in turns:
        flat.turn(role, [{"kind": b[1:], "ref": f"r{b}"} if b[0] == "@" else {"kind": "text", "text": b} for b in bits])
    kinds = {"@image": "image", "@audio": "audio", "@video": "other"}
    for (role, bits), (seen, parts) in zip(turns, C.read(flat.formatted), strict=True):
        assert seen == role
        want = "".join(f"\0{kinds[b]}\0" if b in kinds else b for b in bits)
        assert "".join(p if k == "text" else f"\0{k}\0" for k, p in parts) == want
    learned = "".join(b for role, bits in turns if role == "assistant" for b in bits if b[0] != "@")
    assert "".join(C.unescaped(flat.formatted[s["start"]:s["end"]]) for s in flat.spans) == learned
    places = [flat.formatted[a["at"]:].startswith((C.OTHER, *C.PLACEHOLDERS.values())) for a in flat.attachments]
    assert all(places) and len(places) == sum(b[0] == "@" for _, bits in turns for b in bits)


def expected(rows):
    """Digest by conversation of (conv_id, turn, role, text), without the operator."""
    out = {}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    for conv, turns in by.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned),
                     hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_conversations_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE_CHARS", 300)
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(BITS) * 3) for c in range(40) for t in range(rnd.randint(1, 5))]
    # A third of all rows in one conversation, repeated turns, nulls everywhere, one very long text.
    rows += [(50, t, "assistant", f"text {t} </s>") for t in range(120)] + [(50, 7, "user", "again")] * 2
    rows += [(2**62 + 1, 0, "user", "ids are exact"), (None, 1, "user", "x"), (None, None, None, None), (60, None, "assistant", "n"), (60, 0, "assistant", None),
             (61, 0, "assistant", "é" * 100_000)]
    rnd.shuffle(rows)
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, spans string")
    pieces = C.formatted(table.repartition(5))
    got = {r["conv_id"]: r for r in C.digests(pieces).collect()}
    want = expected(rows)
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == want
    sizes = {}
    for r in pieces.collect():
        sizes.setdefault(r["conv_id"], []).append(len(r["formatted"]))
    assert {k: sum(v) for k, v in sizes.items()} == {k: r["formatted_chars"] for k, r in got.items()}
    assert len(sizes[50]) > 5
    none = C.formatted(table.limit(0))
    assert none.count() == 0 and C.digests(none).count() == 0


def test_attachments_of_a_column_of_parts(spark):
    parts = [[("text", "see ", None, None, None, None, None), ("text", "this", None, None, None, None, None),
              ("image", None, "a.png", 56, 29, None, None), None, ("audio", None, "b.wav", None, None, 1.5, None),
              ("document", None, None, None, None, None, 3), ("video", None, "c", None, None, None, None)], None]
    rows = [(1, i, "assistant", "plain", p) for i, p in enumerate(parts)]
    table = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, content {C.PARTS}")
    got = C.formatted(table, "content").first()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got["attachments"]] == [
        ("image", "a.png", 4), ("audio", "b.wav", 38), ("document", None, 1800), ("video", "c", 1)]
    assert [got["formatted"][s["start"]:s["end"]] for s in got["spans"]] == ["see this", "plain"]
    assert got["formatted"] == ("<|turn|>assistant\nsee this<|image|><|audio|><|document|><|attachment|><|end|>\n"
                                "<|turn|>assistant\nplain<|end|>\n")


def drawn(docs, target):
    """The contract's rows, by plain Python."""
    def found(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [crc32(" ".join(words[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    s, t = [0] * 10000, [0] * 10000
    for side, texts in ((s, [x[1] for x in docs]), (t, target)):
        for text in texts:
            for b in found(text)[1]:
                side[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    rows = []
    for doc, text in docs:
        n, f = found(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((doc, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    ranks = {}
    for i, r in enumerate(able[: 5 * len(able) // 100], 1):
        ranks.setdefault(r, []).append(i)
    return sorted(((r[0], r[2], r[3], r[4], (ranks.get(r) or [None]).pop(0) if ranks.get(r) else None) for r in rows), key=str)


@pytest.mark.parametrize("pivots", [1, 3, 16])
def test_draw_equals_brute_force(spark, monkeypatch, pivots):
    monkeypatch.setattr(R, "PIVOTS", pivots)
    rnd = random.Random(3)
    words = ["Wort", "é", "日本", "x1", "Den", "und", "or"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", ".", "--"])) for i in range(300)]
    docs += [(7, "Wort und " * 30)] * 40 + [(None, "den or " * 12), (2**62 + 1, "den or " * 12), (400, None), (401, ""), (402, "wort " * 30_000)]
    target = ["den und wort", "x1 é", None]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    got = R.resampled(table, spark.createDataFrame([(t,) for t in target], "text string"))
    rows = [tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    want = drawn(docs, target)
    assert sorted(rows, key=str) == want
    assert sorted(r[4] for r in rows if r[4]) == list(range(1, 1 + max(r[4] or 0 for r in want)))


@pytest.mark.parametrize("size", [7, 50, 2_000_000])
def test_features_of_texts_in_slices(monkeypatch, size):
    """Words and runs across the ends of slices, words longer than a slice, texts without words."""
    monkeypatch.setattr(R, "SLICE", size)
    rnd = random.Random(1)
    texts = [None, b"", b"A b", b"one two three four five", b"x" * 700 + b" y " + b"z" * 300, b"...  "]
    texts += [b" ".join(bytes(rnd.choice(b"abcXYZ\xc3.,-") for _ in range(rnd.choice([1, 2, 3, 9, 40, 300])))
                        for _ in range(rnd.randint(0, 30))) for _ in range(100)]
    words, found = {}, {}
    for before, word, owner, bucket in R.features(texts):
        for i in word:
            words[before + i] = words.get(before + i, 0) + 1
        for i, b in zip(owner, bucket, strict=True):
            found.setdefault(before + i, []).append(b)
    for i, text in enumerate(texts):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or b"").lower())
        runs = [crc32(b" ".join(w[j:j + n])) % 10000 for n in (1, 2, 3) for j in range(len(w) - n + 1)]
        assert words.get(i, 0) == len(w) and sorted(found.get(i, [])) == sorted(runs)


def test_nothing_to_draw_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    few = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert R.resampled(empty, empty).count() == 0
    assert [r["rank"] for r in R.resampled(few, empty).collect()] == [None, None]


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else c
                   for i, c in enumerate(centers)]
    rows = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {c: sum(d for _, n, d in rows if n == c) for _, c, _ in rows}
    sha = {c: hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest() for c in inertia}
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in rows), key=str)


def vectors(seed, n, spread=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, spread, (12, 64))
    return [(i, [float(x) for x in (middles[i % 12] + rng.normal(0, 0.1, 64)).astype("f4")]) for i in range(n)]


@pytest.mark.parametrize("n", [5, 300])
def test_clusters_equal_brute_force(spark, n):
    rows = vectors(1, n)
    same = rows[0][1]
    rows += [(1000 + i, same) for i in range(100)] if n > 5 else []
    rows += [(2**62 + 1, rows[2][1]), (2000, None), (2001, [1.0] * 63), (2002, [None] + [1.0] * 63), (2003, [float("nan")] * 64), (None, rows[1][1]),
             (2004, [float("inf")] + [0.0] * 63), (3, rows[3][1])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(3)
    got = [tuple(r)[:6] for r in P.clustered(table).collect()]
    assert sorted(got, key=str) == plain_clusters(rows)


def test_no_vectors_and_huge_ones(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert P.clustered(empty).count() == 0
    huge = spark.createDataFrame([(i, [1e30 * (-1) ** i] * 64) for i in range(50)], "vec_id long, embedding array<float>")
    got = P.clustered(huge, k=1).collect()
    assert len(got) == 50 and all(0 <= r["distance"] <= 2**62 and r["inertia"] == 2**63 - 1 for r in got)


def test_bounds_hold_and_spare_work():
    rows = np.floor(np.array([v for _, v in vectors(2, 600)]) * 256).astype("i8")
    now = P.Round(rows[:40], P.chosen_pivots(rows[:40]))
    cached = np.sqrt(P.squares(rows, P.chosen_pivots(rows[:40])).astype("f8"))
    exact = P.squares(rows, now.centroids)
    assert (now.bounds(cached) <= exact).all()
    number, found = now.nearest(rows, cached)
    assert (found == exact.min(1)).all() and (number == exact.argmin(1)).all()
    assert now.measured < 0.5 * exact.size
