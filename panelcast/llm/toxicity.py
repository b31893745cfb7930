"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max index, votes weighted by distance."""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import blockmax
from panelcast.llm.common import held_out, materialized, send_code, strings

#: At most so many labelled rows are examples, chosen by a hash of their id.
MAX_EXAMPLES = 20_000
#: Terms the vectors are made of: those that tell the labels apart best.
MAX_TERMS = 2_000
#: A term of so many texts counts where its chi-square statistic is far beyond chance, over all the terms there are.
MIN_DOCS = 8
MIN_CHI2 = 40.0
#: A rarer or weaker term of toxic texts counts where chance explains at most this share of the terms like it.
MAX_CHANCE = 0.5
#: Starts of words that are terms too, so that inflected forms share one.
STARTS = (4, 5, 6)
#: The entry that every text has.
COMMON = 3.0
NEIGHBOURS = 25
SCORE = "score double, neighbours array<bigint>, terms array<string>"

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters of the whole text, in lower case."""
    return _WORD.findall((text or "").lower())


def terms_of(text: str | None) -> list[str]:
    """The words of a text, and the starts of the longer ones, marked by ``~``."""
    found = words(text)
    return found + [w[:n] + "~" for w in found if len(w) > STARTS[0] for n in STARTS if len(w) > n]


def sketch(text: str | None) -> int:
    """The smallest hash among the five-word shingles: mostly the same for near copies."""
    found = words(text)
    parts = found if len(found) < 5 else [" ".join(found[i:i + 5]) for i in range(len(found) - 4)]
    return min((crc32(p.encode("utf-8", "replace")) for p in parts), default=-1)


class ToxicityModel:
    """Distinct example vectors over the chosen terms, their label counts, and a calibration.

    A vector holds (1 + ln tf) * idf of each chosen term and a constant, COMMON, that every text has, at
    length 1: a text with one such term is so told from one with many, and texts without any are alike. The
    neighbours of a text are the nearest vectors until NEIGHBOURS examples are reached; those tied with the last share
    the votes that are left, so that order never matters. Labels vote with weight cosine / (1.05 - cosine).
    """

    def __init__(self, names: list[str], idf: np.ndarray, examples: list[tuple[int, int, Counter]]):
        self.names, self.terms = names, {t: i for i, t in enumerate(names)}
        self.idf = np.append(idf, COMMON)
        groups: dict[tuple, list] = {}
        for doc_id, label, counts in examples:
            group = groups.setdefault(tuple(sorted(counts.items())), [0, 0, []])
            group[0] += 1
            group[1] += label
            group[2].append(doc_id)
        self.count = np.array([g[0] for g in groups.values()], "f8")
        self.ones = np.array([g[1] for g in groups.values()], "f8")
        self.base = (self.ones.sum() + 0.5) / (self.count.sum() + 1)
        self.ids = [sorted(g[2])[:3] for g in groups.values()]
        parts = [self.vector(key) for key in groups]
        sizes = [len(p[0]) for p in parts]
        self.index = blockmax.BlockMaxIndex(
            np.concatenate([p[0] for p in parts]) if parts else [], np.repeat(np.arange(len(parts)), sizes),
            np.concatenate([p[1] for p in parts]) if parts else [], len(names) + 1, len(parts))
        self.slope, self.shift = 1.0, 0.0
        self._calibrate(list(groups))

    def vector(self, key) -> tuple[np.ndarray, np.ndarray]:
        at = np.array([t for t, _ in key] + [len(self.names)], "i8")
        weight = (1 + np.log(np.array([n for _, n in key] + [1], "f8"))) * self.idf[at]
        return at, weight / np.sqrt((weight * weight).sum())

    def nearest(self, key, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Example vectors with their cosines, best first; ``without``: one example of that vector is left out."""
        at, weight = self.vector(key)
        bounds = self.index.bounds(at, weight)
        items, cosines, last = np.zeros(0, "i8"), np.zeros(0), 0.0
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= 0 or bounds[block] < last:
                break
            got = self.index.scores(block, at, weight)
            keep = np.flatnonzero((got > 0) & (got >= last))
            items = np.concatenate([items, keep + block * self.index.block])
            cosines = np.concatenate([cosines, np.round(got[keep], 9)])
            order = np.lexsort((items, -cosines))
            items, cosines = items[order], cosines[order]
            reached = np.cumsum(self.count[items] - (items == without))
            if len(reached) and reached[-1] >= NEIGHBOURS:
                last = cosines[np.searchsorted(reached, NEIGHBOURS)] - 1e-9
                items, cosines = items[cosines >= last], cosines[cosines >= last]
        return items, cosines

    def vote(self, key, without: tuple[int, int] | None = None) -> tuple[float, np.ndarray]:
        """The smoothed share of toxic labels around a vector. ``without``: (vector, label) of an example that is
        not to vote for itself."""
        items, cosines = self.nearest(key, without[0] if without else -1)
        weight = cosines / (1.05 - cosines)
        count, ones = self.count[items].copy(), self.ones[items].copy()
        if without:
            count[items == without[0]] -= 1
            ones[items == without[0]] -= without[1]
        tied = cosines <= cosines.min(initial=1.0)
        room = NEIGHBOURS - count[~tied].sum()
        weight = np.where(tied, weight * min(1.0, room / max(count[tied].sum(), 1e-9)), weight)
        return float(((weight * ones).sum() + self.base) / ((weight * count).sum() + 1)), items

    def _calibrate(self, keys) -> None:
        """Fit score = logistic(slope * logit(vote) + shift) on every example's vote without itself."""
        rows = [(k, y, n, i) for i, k in enumerate(keys)
                for y, n in ((0, self.count[i] - self.ones[i]), (1, self.ones[i])) if n > 0]
        if len({r[1] for r in rows}) < 2:
            return
        p = np.clip([self.vote(k, (i, y))[0] for k, y, _, i in rows], 1e-4, 1 - 1e-4)
        x, y, n = np.log(p / (1 - p)), np.array([r[1] for r in rows], "f8"), np.array([r[2] for r in rows], "f8")
        design, beta = np.column_stack([x, np.ones(len(x))]), np.array([1.0, 0.0])
        for _ in range(50):
            s = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            slope = (design * (n * (s - y))[:, None]).sum(0) + 0.1 * (beta - [1.0, 0.0])
            curve = (design * (n * s * (1 - s))[:, None]).T @ design + 0.1 * np.eye(2)
            step = np.linalg.solve(curve, slope)
            beta = beta - step / max(1.0, 2 * np.abs(step).max())
        if np.isfinite(beta).all() and beta[0] > 0:
            self.slope, self.shift = map(float, beta)

    def key(self, text: str | None) -> tuple:
        get = self.terms.get
        return tuple(sorted(Counter(t for t in map(get, terms_of(text)) if t is not None).items()))

    def score(self, key) -> tuple[float, list[int], list[str]]:
        """Calibrated score, ids of the nearest examples, the terms of the text that count."""
        vote, items = self.vote(key)
        vote = min(max(vote, 1e-4), 1 - 1e-4)
        score = 1 / (1 + math.exp(-self.slope * math.log(vote / (1 - vote)) - self.shift))
        return score, [d for i in items[:3] for d in self.ids[i]][:3], [self.names[t] for t, _ in key]


def beyond_chance(cells: list[tuple[int, int, int]], share: float) -> list[tuple[int, int]]:
    """(n, ones) of terms that stand in n examples, ones of them toxic, more often than chance makes them.

    ``cells``: (n, ones, number of terms). For each n the terms with as many toxic examples or more are counted
    and compared with what a binomial draw would give of all terms of that n. It draws at the toxic share, or
    that of all places of rare terms if larger, as toxic texts may be longer. No count is fixed, so a few
    examples do where the terms are few, and more are asked where there are many."""
    rare = [(n, k, c) for n, k, c in cells if n < MIN_DOCS]
    share = max(share, sum(k * c for _, k, c in rare) / max(1, sum(n * c for n, _, c in rare)))
    by_n: dict[int, dict[int, int]] = {}
    for n, k, c in cells:
        by_n.setdefault(n, {})[k] = c
    out, odds = [], (math.log(share), math.log1p(-share)) if 0 < share < 1 else None
    for n, k, _ in cells if odds else ():
        if k / n >= (1 + share) / 2:
            tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * odds[0] + (n - i) * odds[1])
                       for i in range(k, n + 1))
            if tail * sum(by_n[n].values()) <= MAX_CHANCE * sum(c for i, c in by_n[n].items() if i >= k):
                out.append((n, k))
    return out


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> ToxicityModel:
    """Learn from labelled rows that are not held out; at most ``max_examples``, a documented bound, chosen by a
    hash of the id; of those that are near copies by their sketch, one is kept, so that a copied text doesn't
    vote many times. Several labels of one id count as their largest; null labels and ids are left out.

    Terms are kept where their texts' share of toxic ones is far from the overall one, halfway to all or to none,
    and by chi-square or, for toxic ones however rare, by ``beyond_chance``. They and their document frequencies are counted in Spark; only the chosen terms and the examples' counts
    of them, both bounded, reach the driver. Without examples every text scores the same 0.5 or so."""
    send_code(__name__, blockmax.__name__)
    chosen = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    examples = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_examples rows of two numbers
    def sketches(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch(t) for t in strings(texts)], dtype="i8")

    examples = examples.withColumn("sketch", F.pandas_udf(sketches, "long")("text")).groupBy("sketch", "label").agg(
        F.min_by(F.struct("doc_id", "text"), "doc_id").alias("one"))
    examples = materialized(examples.select("one.*", "label"), "toxic-examples")

    def counted(frames):
        df, ones = Counter(), Counter()
        for frame in frames:
            for text, label in zip(strings(frame["text"]), frame["label"], strict=True):
                seen = set(terms_of(text))
                df.update(seen)
                if label:
                    ones.update(seen)
        yield pd.DataFrame({"term": pd.Series(list(df), dtype=object), "n": list(df.values()), "ones": [ones[t] for t in df]})

    total, positive = examples.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = positive / total if total else 0.0
    spread = max(share * (1 - share), 1e-9)
    chi2 = (F.col("ones") - F.col("n") * share) ** 2 / (F.col("n") * spread) / (1 - F.col("n") / (total + 1))
    terms = materialized(examples.select("text", "label").mapInPandas(counted, "term string, n long, ones long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("ones").alias("ones")), "toxic-terms")
    strong = (F.col("n") >= MIN_DOCS) & (chi2 >= MIN_CHI2)
    far = (F.col("ones") / F.col("n") >= (1 + share) / 2) | (F.col("ones") / F.col("n") <= share / 2)
    weak = terms.where(~strong).groupBy("n", "ones").count().collect()
    more = [n * (total + 1) + k for n, k in beyond_chance([tuple(r) for r in weak], share)]
    terms = terms.where(far & (strong | (F.col("n") * (total + 1) + F.col("ones")).isin(more)))
    best = terms.orderBy(F.desc(chi2), "term").limit(max_terms).collect()
    names = sorted(r["term"] for r in best)
    at, seen = {t: i for i, t in enumerate(names)}, {r["term"]: r["n"] for r in best}
    idf = np.array([math.log(1 + total / seen[t]) for t in names])

    def vectors(frames):
        for frame in frames:
            found = [Counter(t for t in map(at.get, terms_of(x)) if t is not None)
                     for x in strings(frame["text"])]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"],
                                "terms": [list(c) for c in found], "counts": [list(c.values()) for c in found]})

    rows = examples.mapInPandas(vectors, "doc_id long, label int, terms array<int>, counts array<int>").collect()
    return ToxicityModel(names, idf, [(r[0], r[1], Counter(dict(zip(r[2], r[3], strict=True)))) for r in rows])


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``into`` (score, neighbours, terms) from the whole text.

    Null and empty texts, and ones without a known term, get the score of examples that have none either.
    Rows never meet one another: no shuffle, and repeated rows score alike."""
    send_code(__name__, blockmax.__name__)

    @F.pandas_udf(SCORE)
    def toxicity(texts: pd.Series) -> pd.DataFrame:
        known, out = {}, []
        for x in strings(texts):
            key = model.key(x)
            if key not in known:
                known[key] = model.score(key)
            out.append(known[key])
        return pd.DataFrame(out, columns=["score", "neighbours", "terms"])

    return docs.withColumn(into, toxicity(F.col(text)))
