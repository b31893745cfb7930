"""Benchmark decontamination: block-max BM25 over the test items, every passage of every document a query."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import blockmax
from panelcast.llm.common import materialized, send_code, small, strings

SHINGLE = 5
#: Items of fewer words than SHINGLE, but of so many, are searched as exact phrases.
PHRASE = 3
#: Items of one index; more items are searched index after index.
ITEMS_PER_INDEX = 500
#: A passage is two neighbouring chunks of so many words, or of as many as the longest item has.
CHUNK = 64
#: BM25 of a passage over BM25 of the item itself, from which on an item is retrieved.
MIN_SCORE = 0.5
#: Share of the item's or its question's shingles found in the passage, from which on it counts as leaked.
MIN_OVERLAP = 0.5
K1, B = 1.2, 0.75
#: Items in a block of the index.
BLOCK = 4
#: Texts are searched together up to so many words, passages up to so many of their terms.
WORDS_AT_A_TIME, TERMS_AT_A_TIME = 20_000, 4_096
#: Names that no table should have.
TEXT, FOUND_HERE = "_panelcast_text", "_panelcast_leaks"
FOUND = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,overlap:double>>"

#: Letters of scripts that put no spaces between words: Thai to Myanmar, Khmer, kana, Han. Each is a word here.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORD = re.compile(rf"(?=\w)[{_ALONE}]|(?:(?![{_ALONE}])\w)+")
_SPACED = re.compile(r"\w+")
_LONE = re.compile(f"[{_ALONE}]")
#: The first 256 signs, those of no word as space.
_LATIN = bytes(i if _SPACED.match(chr(i)) else 32 for i in range(256))
_END = re.compile(r"(?<=[.?!])\s+|(?<=[。？！｡])\s*")


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case; a letter of a script without spaces stands alone."""
    text = (text or "").lower()
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        pass
    return (_WORD if _LONE.search(text) else _SPACED).findall(text)


def shingles(tokens: list[str]) -> set[tuple[str, ...]]:
    if len(tokens) < SHINGLE:
        return {tuple(tokens)} if tokens else set()
    return set(zip(*(tokens[i:] for i in range(SHINGLE)), strict=False))


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The words of an item: its last sentence is the answer; of a single sentence, the last quarter is."""
    parts = [w for w in map(words, _END.split(text or "")) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    whole = parts[0] if parts else []
    cut = max(1, len(whole) * 3 // 4)
    return whole[:cut], whole[cut:]


class LeakIndex:
    """Items as BM25 impacts divided by the item's own score, so that an exact copy scores 1 for each item. The
    questions are entries of their own beside the whole items, so that one is retrieved however long its answer is."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float):
        self.phrases: dict[int, dict[tuple[str, ...], list[int]]] = {}
        for item, text in items:
            if len(phrase := tuple(words(text))) < SHINGLE:
                self.phrases.setdefault(len(phrase), {}).setdefault(phrase, []).append(item)
        items = [x for x in items if len(words(x[1])) >= SHINGLE]
        # Items that share frequent words, such as those of one language, stand together: their blocks bound well.
        items = sorted(items, key=lambda x: (sorted(set(words(x[1])), key=lambda t: (-df[t], t))[:3], x))
        self.ids = [i for i, _ in items]
        parts = [question_and_answer(t) for _, t in items]
        tokens = [q + a for q, a in parts]
        self.chunk = max([CHUNK, *map(len, tokens)])
        self.sets = [(shingles(q), shingles(a), shingles(w)) for (q, a), w in zip(parts, tokens, strict=True)]
        self.terms = {t: i for i, t in enumerate(sorted({t for w in tokens for t in w}))}
        terms, owners, weights = [], [], []
        entries = [(k, w) for k, (q, _) in enumerate(parts) for w in (tokens[k], q) if w is not q or len(q) >= SHINGLE]
        self.owner = np.array([k for k, _ in entries], "i8")
        for k, (_, w) in enumerate(entries):
            tf = Counter(w)
            impact = [math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1)
                      / (n + K1 * (1 - B + B * len(w) / mean_words)) for t, n in tf.items()]
            terms += [self.terms[t] for t in tf]
            owners += [k] * len(tf)
            weights += [x / sum(impact) for x in impact]
        self.index = blockmax.BlockMaxIndex(terms, owners, weights, max(1, len(self.terms)), len(entries), BLOCK)

    def retrieve(self, texts: list[list[str]]) -> dict[tuple[int, int], dict[int, float]]:
        """(text, passage number) -> {item: score} for all scores of MIN_SCORE or more, the larger one of an item and
        its question. A block of entries is scored only where the sum of its largest impacts over the passage reaches that."""
        sizes = np.fromiter(map(len, texts), "i8", len(texts))
        at = np.fromiter(map(self.terms.get, chain.from_iterable(texts), repeat(-1)), "i8", sizes.sum())
        # Chunks are numbered through all texts; a passage has the number of its first.
        chunks = -(-sizes // self.chunk)
        base = np.cumsum(chunks) - chunks
        place = np.flatnonzero(at >= 0)
        text = np.repeat(np.arange(len(texts)), sizes)[place]
        chunk, term = (place - (np.cumsum(sizes) - sizes)[text]) // self.chunk, at[place]
        n, later = len(self.terms), chunk > 0
        pairs = (base[text] + chunk) * n + term
        pairs = np.concatenate([pairs, pairs[later] - n])
        pairs.sort()
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        passage, term = pairs // max(1, n), pairs % max(1, n)
        first = np.flatnonzero(np.diff(passage, prepend=-1))
        last = np.append(first[1:], len(pairs))
        found: dict[tuple[int, int], dict[int, float]] = {}
        begin = 0
        while begin < len(first):
            end = max(begin + 1, int(np.searchsorted(last, first[begin] + TERMS_AT_A_TIME, "right")))
            low, high = first[begin], last[end - 1]
            got = self.index.passing(term[low:high], first[begin:end] - low, last[begin:end] - low, MIN_SCORE)
            for query, entry, score in zip(*(x.tolist() for x in got), strict=True):
                number = int(passage[first[begin + query]])
                # Texts without words have no chunks: the last one that starts here or before is meant.
                text = int(np.searchsorted(base, number, "right")) - 1
                items, item = found.setdefault((text, number - int(base[text])), {}), int(self.owner[entry])
                items[item] = max(items.get(item, 0.0), score)
            begin = end
        return found

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float, float]]]:
        """(item_id, score, question, answer and whole overlap) of each item that a passage holds, of each text."""
        found = []
        cut, held = [], 0
        for text in texts:
            cut.append(words(text))
            held += len(cut[-1])
            if held >= WORDS_AT_A_TIME:
                found += self._leaks(cut)
                cut, held = [], 0
        return found + self._leaks(cut)

    def _leaks(self, texts: list[list[str]]) -> list[list[tuple[int, float, float, float, float]]]:
        best: list[dict[int, tuple[float, float, float, float]]] = [{} for _ in texts]
        for (text, passage), items in self.retrieve(texts).items():
            have = shingles(texts[text][passage * self.chunk:(passage + 2) * self.chunk])
            for k, score in items.items():
                q, a, whole = (len(s & have) / len(s) if s else 0.0 for s in self.sets[k])
                if max(whole, q) >= MIN_OVERLAP:
                    best[text][k] = max(best[text].get(k, (0.0,)), (whole, score, q, a))
        found = [[(self.ids[k], s, q, a, whole) for k, (whole, s, q, a) in sorted(x.items())] for x in best]
        for size, phrases in self.phrases.items():
            for tokens, out in zip(texts, found, strict=True):
                held = {p for p in zip(*(tokens[i:] for i in range(size)), strict=False) if p in phrases}
                out += [(item, 1.0, 1.0, 1.0, 1.0) for item in sorted(i for p in held for i in phrases[p])]
        return found


def indexes(benchmark: DataFrame, items_per_index: int = ITEMS_PER_INDEX):
    """The number of indexes over ``benchmark`` (item_id, text), each of a bounded number of items, and the function
    that builds one of them by its number, so that the caller holds no more than it uses.

    Document frequencies are those of all items of SHINGLE words or more, letters in scripts without spaces. Items of
    fewer than PHRASE words are no evidence and are left out; repeated rows count once. An empty benchmark gives no
    index."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct()

    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([words(x) for x in strings(texts)], dtype=object)

    items = items.withColumn("words", F.pandas_udf(cut, "array<string>")("text")).where(F.size("words") >= PHRASE)
    items = materialized(items, "benchmark-items")
    every, n_items, mean_words = items.agg(F.count("*"), F.count_if(F.size("words") >= SHINGLE), F.avg(
        F.when(F.size("words") >= SHINGLE, F.size("words")))).first()
    df = items.where(F.size("words") >= SHINGLE).select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").count()
    shards = -(-every // items_per_index)
    items = items.withColumn("shard", F.pmod(F.xxhash64("text", "item_id"), F.lit(max(1, shards))))

    def build(shard: int) -> LeakIndex:
        own = items.where(F.col("shard") == shard)
        terms = own.select(F.explode("words").alias("term")).distinct().join(df, "term").collect()
        rows = own.select("item_id", "text").collect()
        return LeakIndex([tuple(r) for r in rows], {r["term"]: r["count"] for r in terms}, n_items, mean_words or 1.0)

    return shards, build


def _leaks_of(index: LeakIndex):
    names = ("item_id", "score", "question_overlap", "answer_overlap", "overlap")

    def leaks(texts: pd.Series) -> pd.Series:
        found = [[dict(zip(names, r, strict=True)) for r in x] for x in index.leaks(strings(texts))]
        return pd.Series(found, dtype=object)

    # Marked so that a filter on the result never makes it run twice.
    return F.pandas_udf(leaks, FOUND).asNondeterministic()


def with_leaks(docs: DataFrame, benchmark: DataFrame, items_per_index: int = ITEMS_PER_INDEX,
               into: str = "leaks") -> DataFrame:
    """``docs`` with an array column ``into``: the items whose text its whole text holds, with BM25 score and the
    shares of question, answer and whole item found in one passage.

    Every passage of two chunks is a query, and each item lies wholly inside one; all items above MIN_SCORE are
    verified. An item of PHRASE words or more, but fewer than SHINGLE, is found where its words stand in a row. Null and empty texts, and an empty benchmark, give an empty array. With one index rows never meet one
    another. More are built, searched and let go one after the other, each in a pass that writes what it found by
    the text's hash; the driver and a worker hold one."""
    send_code(__name__, blockmax.__name__)
    shards, build = indexes(benchmark, items_per_index)
    none = F.array().cast(FOUND)
    if shards <= 1:
        return docs.withColumn(into, _leaks_of(build(0))("text") if shards else none)
    passes = []
    for shard in range(shards):
        one = docs.select(F.sha2("text", 256).alias(TEXT), _leaks_of(build(shard))("text").alias(into))
        passes.append(materialized(one.where(F.size(into) > 0).select(TEXT, F.explode(into).alias("leak")), "leaks"))
    held = reduce(DataFrame.unionByName, passes).distinct().groupBy(TEXT).agg(F.array_sort(F.collect_list("leak")).alias(FOUND_HERE))
    rows = docs.withColumn(TEXT, F.sha2("text", 256)).join(small(materialized(held, "leaks")), TEXT, "left")
    return rows.withColumn(into, F.coalesce(FOUND_HERE, none)).drop(TEXT, FOUND_HERE)


def leaked_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and leaked item: doc_id, item_id, score and the overlaps."""
    pairs = with_leaks(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("leaks").alias("leak"))
    return pairs.select("doc_id", "leak.*")
