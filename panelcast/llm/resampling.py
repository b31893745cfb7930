"""Importance resampling towards a target distribution: hashed n-gram weights, then a distributed quickselect."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import by_number, by_text, materialized, send_code
from panelcast.operators.ranking import global_rank

BUCKETS, LONGEST = 10_000, 3
#: Documents with fewer words are not drawn; so many of a hundred of the others are.
MIN_WORDS, PERCENT = 20, 5
SEED = 42
#: Random pivots of a round of the selection, by which the rows left fall to about a tenth.
PIVOTS = 16

# Bytes of words are digits, letters and all of other scripts; A-Z become a-z, the rest become spaces.
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_PLAIN = bytes(b if b in _WORD else 32 for b in bytes(range(256)).lower())
#: Bytes of text that are cut into words at a time.
SLICE = 2_000_000
#: Longer words are hashed one by one.
_SHORT = 32


def _steps() -> np.ndarray:
    """What crc32 makes of a state and one byte, by the byte's exclusive or with the state."""
    c = np.arange(256, dtype="u4")
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1)
    return c


def _shifts() -> np.ndarray:
    """By number of bytes n < 256 and place j: what n zero bytes make of each value of byte j of a crc."""
    out = np.empty((256, 4, 256), "u4")
    out[0] = np.arange(256, dtype="u4")[None, :] << (8 * np.arange(4, dtype="u4"))[:, None]
    for n in range(1, 256):
        out[n] = _STEP[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


_STEP = _steps()
_SHIFT = _shifts().reshape(-1)


def _joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The crc of two byte strings in a row, from both crcs and the length of the second."""
    first, left = first.copy(), length.copy()
    while True:
        at = np.minimum(left, 255) << 10
        first = (_SHIFT[at + (first & 255)] ^ _SHIFT[at + 256 + ((first >> 8) & 255)]
                 ^ _SHIFT[at + 512 + ((first >> 16) & 255)] ^ _SHIFT[at + 768 + (first >> 24)])
        left = left - np.minimum(left, 255)
        if not left.any():
            return first ^ second


def _words(plain: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, crc) of the words of a text that is already plain."""
    text = np.frombuffer(plain, "u1")
    edge = np.flatnonzero(np.diff((text != 32).view("i1"), prepend=0, append=0))
    start, length = edge[::2], edge[1::2] - edge[::2]
    crc = np.full(len(start), 0xFFFFFFFF, "u4")
    # Words by length, so that those still going are always the last ones.
    most = np.minimum(length, _SHORT).astype("u1")
    order = np.argsort(most, kind="stable")
    at, of, c = start[order], most[order], crc[order]
    for i in range(int(of[-1]) if len(of) else 0):
        go = np.searchsorted(of, i, side="right")
        c[go:] = _STEP[(c[go:] ^ text[at[go:] + i]) & 255] ^ (c[go:] >> 8)
    crc[order] = ~c
    for i in np.flatnonzero(length > _SHORT):
        crc[i] = crc32(plain[start[i]:start[i] + length[i]])
    return start, length, crc


def _slices(texts) -> Iterator[tuple[bytes, np.ndarray]]:
    """Plain bytes of some texts in a row, or of a part of a long one, that end where no word does, and the end of
    each text in them; a text that goes on has no end there."""
    held, ends, size = [], [], 0
    for value in texts:
        plain = (value or b"").translate(_PLAIN) + b" "
        while len(plain) > SLICE:
            # Up to the last space, or behind the first one after a word that is longer than all of it.
            cut = 1 + (plain.rfind(b" ", 0, SLICE) if b" " in plain[:SLICE] else plain.index(b" ", SLICE))
            if cut == len(plain):
                break
            yield b"".join([*held, plain[:cut]]), np.array(ends, "i8")
            held, ends, size, plain = [], [], 0, plain[cut:]
        held.append(plain)
        size += len(plain)
        ends.append(size)
        if size > SLICE:
            yield b"".join(held), np.array(ends, "i8")
            held, ends, size = [], [], 0
    if held:
        yield b"".join(held), np.array(ends, "i8")


def features(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For texts in UTF-8, slice by slice: (number of texts before, text of each word, text of each feature, bucket of
    each feature), texts counted from the first of the slice. Words and their runs of up to LONGEST words are hashed
    for a slice at once; the last words of a text that goes on are carried over."""
    before, tail = 0, (np.zeros(0, "i8"), np.zeros(0, "u4"))
    for plain, ends in _slices(texts):
        start, length, crc = _words(plain)
        text = np.searchsorted(ends, start, side="right")
        own = len(tail[0])  # words of this text that were counted before
        length, crc = np.concatenate([tail[0], length]), np.concatenate([tail[1], crc])
        every = np.concatenate([np.zeros(own, "i8"), text])
        spaced = ~crc
        spaced = ~(_STEP[(spaced ^ np.uint32(32)) & 255] ^ (spaced >> 8))  # the word and a space
        run, size, found, owner = crc, length, [crc[own:]], [text]
        for n in range(2, LONGEST + 1):
            # A run is its first word, a space and the run of n - 1 words behind it.
            run, size = run[1:], size[1:]
            here = every[: len(run)]
            run = _joined(spaced[: len(run)], run, size)
            size = size + 1 + length[: len(size)]
            new = np.flatnonzero(here == every[n - 1:])
            new = new[new + n > own]
            found.append(run[new])
            owner.append(here[new])
        yield before, text, np.concatenate(owner), np.concatenate(found) % BUCKETS
        before += len(ends)
        going = every == len(ends)
        tail = length[going][1 - LONGEST:], crc[going][1 - LONGEST:]


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n) over the features of all rows: a task adds up its rows and hands over one number per bucket."""
    send_code(__name__)

    def counted(frames):
        total = np.zeros(BUCKETS, "i8")
        for frame in frames:
            for _, _, _, bucket in features(frame["text"]):
                total += np.bincount(bucket, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    parts = texts.select(F.col(text).cast("binary").alias("text")).mapInPandas(counted, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket, in thousandths of a natural logarithm, from the counts of both sides. BUCKETS
    numbers reach the driver, whatever the input."""
    every = source.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    both = every.join(source.select("bucket", F.col("n").alias("s")), "bucket", "left").join(
        target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0)
    frame = both.orderBy("bucket").toPandas()
    s, t = frame["s"].to_numpy("f8"), frame["t"].to_numpy("f8")
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype("i8")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel number of each id, in thousandths, from a hash of seed and id; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighted(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row: the array of gains is indexed by the features' buckets."""
    send_code(__name__)

    def scored(frames):
        for frame in frames:
            out = np.zeros((3, len(frame) + 1), "i8")
            for before, word, owner, bucket in features(frame["text"]):
                n = int(max(word.max(initial=0), owner.max(initial=0))) + 1
                out[0, before:before + n] += np.bincount(word, minlength=n)
                out[1, before:before + n] += np.bincount(owner, minlength=n)
                # Sums of whole numbers far below 2 to the 53.
                out[2, before:before + n] += np.bincount(owner, gain[bucket], n).astype("i8")
            made = pd.DataFrame(out[:, : len(frame)].T, columns=["n_words", "n_features", "weight"])
            made.insert(0, "doc_id", frame["doc_id"].to_numpy(object))
            yield made

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    made = by_text(rows, "doc_id").mapInPandas(scored, "doc_id string, n_words long, n_features long, weight long")
    return by_number(made, "doc_id")


#: The fields of a key and their types, in the order of the draw.
KEY = [("score", "long"), ("no_id", "boolean"), ("doc_id", "long"), ("n_features", "long"), ("weight", "long"), ("row", "long")]


def draw_key() -> Column:
    """What the draw is ordered by, ascending. ``row`` tells rows apart that are equal in all else."""
    return F.struct((-F.col("score")).alias("score"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "n_features",
                    "weight", "row")


def kth_key(rows: DataFrame, k: int):
    """The k-th smallest (k from 1 on) of the keys of ``rows``, whose column ``key`` holds no key twice.

    Each round takes PIVOTS keys at random out of the bracket left, counts the rows below, at and above each in one
    pass, exactly, and goes on between the two pivots that enclose the k-th. It ends where a pivot is the k-th, at
    the latest when all keys left are pivots. The driver holds the pivots of a round and their counts."""
    low = high = None
    below = 0  # keys that are smaller than all of the bracket
    for turn in itertools.count():
        left = rows
        if low is not None:
            left = left.where(F.col("key") > low)
        if high is not None:
            left = left.where(F.col("key") < high)
        dice = F.xxhash64(F.lit(turn), "key.row")
        chosen = left.orderBy(dice, "key.row").limit(PIVOTS).select("key")
        pivots = [tuple(r[0]) for r in chosen.orderBy("key").collect()]
        literal = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(p, KEY, strict=True)])
                   for p in pivots]
        counts = left.agg(*[F.count_if(F.col("key") < p) for p in literal],
                          *[F.count_if(F.col("key") == p) for p in literal]).first()
        less, same = counts[: len(pivots)], counts[len(pivots):]
        low_at = None
        for i, pivot in enumerate(pivots):
            if below + less[i] < k <= below + less[i] + same[i]:
                return literal[i]
            if below + less[i] + same[i] < k:
                low, low_at = literal[i], i
        after = 0 if low_at is None else low_at + 1
        if after < len(pivots):
            high = literal[after]
        if low_at is not None:
            below += less[low_at] + same[low_at]


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
              seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``documents`` (doc_id, text), drawn towards
    the texts of ``target``; other columns are left out.

    Of the N rows of ``min_words`` words or more, the floor(percent * N / 100) of the highest score are drawn and
    ranked from 1 on, the others have no rank. Ties go to the smaller doc_id, null ids last, then to the smaller
    n_features and weight; repeated rows are rows of their own, each with a rank. Null and empty texts have no
    features, weight 0 and are never drawn. Without target texts, all buckets count as equally likely there. An
    empty table gives no rows."""
    gain = gains(bucket_counts(documents), bucket_counts(target))
    rows = weighted(documents, gain).withColumns(
        {"score": F.col("weight") + noise(F.col("doc_id"), seed), "row": F.monotonically_increasing_id()})
    # Five numbers a document; read once in each round.
    rows = materialized(rows, "weights")
    able = rows.where(F.col("n_words") >= min_words)
    out = ["doc_id", "n_features", "weight", "score"]
    k = percent * able.count() // 100
    if k == 0:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    last = kth_key(able.select(draw_key().alias("key")), k)
    drawn = F.coalesce((F.col("n_words") >= min_words) & (draw_key() <= last), F.lit(False))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row")]
    ranked = global_rank(rows.where(drawn), order, "rank")
    rest = rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*out, "rank").unionByName(rest.select(*out, "rank"))
