"""N-gram Jaccard join: documents of one prefix and size are a group; prefixes filter, members are verified."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import counted, materialized, send_code, small, strings
from panelcast.llm.components import components

WORDS = 5
#: Two sets link when 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Shingles that a task sees in several documents are counted; the most frequent ones, so many, come last in the
#: order of shingles. The list bounds what is broadcast; it moves work, never results.
FREQUENT, LEAST_COUNT = 200_000, 8
#: So many of the most frequent words are told from rare ones, of those met so often among BATCH words.
FREQUENT_WORDS, LEAST_WORDS = 50_000, 8
#: Shingles counted at a time.
BATCH = 1_000_000
#: Documents handed over at a time.
AT_A_TIME = 500
#: Shingles with more entries than FEW are compared by hubs first; those with more than BUCKET in several buckets.
FEW, BUCKET = 16, 2_000
#: At most so many rounds compare the sets of a bucket with its hub, while a round links a tenth of what the first
#: did. What is left is compared in pairs.
ROUNDS, WORTH = 8, 0.1
#: Sets of one side are broadcast, one after the other, in slices of about so many shingles (12 MB), if so many slices
#: are enough; else both sides are shuffled.
BROADCAST_SHINGLES, SLICES = 1_500_000, 16

FEATURES = "doc_id long, n long, f1 long, f2 long, g1 long, g2 long, common int, prefix array<bigint>"
SETS = "doc_id long, f1 long, f2 long, tokens array<bigint>"


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lowered; words are separated by space and the signs 9 to 13."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, found), "u8", len(found))


def mixed_shingles(words: np.ndarray) -> np.ndarray:
    """The hash of each five words in a row; of fewer words, the one hash of all; of none, none."""
    size = min(WORDS, len(words))
    if not size:
        return words
    mixed = np.full(len(words) - size + 1, size, "u8")
    for i in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - size + 1 + i]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, ascending; without words, or for null, there are none."""
    return np.unique(mixed_shingles(word_hashes(text)))


def _levels(values: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The level of each value that is listed, else 0."""
    listed, level = known
    if not len(listed):
        return np.zeros(len(values), "u1")
    place = np.searchsorted(listed, values)
    place[place == len(listed)] = 0
    return np.where(listed[place] == values, level[place], 0).astype("u1")


def ordered_shingles(text: str | None, frequent: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles ascending, their order from rare to frequent, and which are listed as frequent.

    First come those that are not listed, before them those with a rare word: the level of a shingle's rarest
    word tells how likely other texts hold it by chance. Then the hash decides."""
    words = word_hashes(text)
    own, at = np.unique(mixed_shingles(words), return_index=True)
    if not len(own):
        return own, at, at.astype(bool)
    rarity = _levels(words, frequent["words"])
    size = min(WORDS, len(words))
    lowest = rarity[:len(words) - size + 1].copy()
    for i in range(1, size):
        np.minimum(lowest, rarity[i:len(words) - size + 1 + i], out=lowest)
    listed = _levels(own, frequent["shingles"])
    return own, np.lexsort((own, lowest[at], listed)), listed > 0


def prefix_length(n: int) -> int:
    """Sets of enough overlap share one of their first so many members, in any common order."""
    return n - -(-SIMILARITY * n // 100) + 1


def _parts(frames):
    """The frames in parts of few documents, so that what is made of them stays small."""
    for frame in frames:
        for at in range(0, len(frame), AT_A_TIME):
            yield frame.iloc[at:at + AT_A_TIME]


def _two(data: bytes) -> tuple[int, int]:
    raw = np.frombuffer(xxhash.xxh3_128_digest(data), "i8")
    return int(raw[0]), int(raw[1])


def frequent_items(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Shingles and words met most often, at most FREQUENT and FREQUENT_WORDS: (hash ascending, level), the level
    being one and the logarithm of the count.

    Every task reads all its documents, of equal sets one, and counts words, and shingles that several of them
    hold; Spark adds the counts. A shingle of d documents over t tasks is met twice somewhere once d is a few
    times the root of t, so what stays uncounted is rare. Only these bounded lists reach the driver."""

    def counted(frames):
        seen, parts, held = set(), [], 0

        def flush():
            out = []
            for kind, which, least in (("shingles", 0, 2), ("words", 1, LEAST_WORDS)):
                token, count = np.unique(np.concatenate([p[which] for p in parts]), return_counts=True)
                often = count >= least
                out.append(pd.DataFrame({"kind": kind, "token": token[often].view("i8"), "n": count[often]}))
            return pd.concat(out)

        for part in _parts(frames):
            for text in strings(part["text"]):
                words = word_hashes(text)
                own = np.unique(mixed_shingles(words))
                mark = xxhash.xxh3_64_intdigest(own.tobytes())
                if mark in seen:
                    continue
                seen.add(mark)
                parts.append((own, words))
                held += len(words)
                if held >= BATCH:
                    yield flush()
                    seen, parts, held = set(), [], 0
        if parts:
            yield flush()

    counts = docs.select("text").mapInPandas(counted, "kind string, token long, n long")
    counts = materialized(counts.groupBy("kind", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT),
                          "frequent")
    out = {}
    for kind, most in (("shingles", FREQUENT), ("words", FREQUENT_WORDS)):
        best = counts.where(F.col("kind") == kind).orderBy(F.desc("n"), "token").limit(most).toArrow()
        token, count = best["token"].to_numpy().astype("i8").view("u8"), best["n"].to_numpy()
        order = np.argsort(token)
        out[kind] = token[order], (1 + np.floor(np.log2(count[order]))).astype("u1")
    return out


def features(docs: DataFrame, frequent: dict) -> DataFrame:
    """Of every document: the size of its set, fingerprints of set (f1, f2) and prefix (g1, g2), and the prefix.

    The first ``common`` members of the prefix are not listed as frequent."""

    def described(frames):
        for part in _parts(frames):
            rows = []
            for doc, text in zip(part["doc_id"], strings(part["text"]), strict=True):
                own, order, listed = ordered_shingles(text, frequent)
                n = len(own)
                order = order[:prefix_length(n)] if n else order
                prefix = own[order].view("i8")
                rows.append((None if pd.isna(doc) else int(doc), n, *_two(own.tobytes()), *_two(prefix.tobytes()),
                             int((~listed[order]).sum()), prefix))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")], dtype=object)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(described, FEATURES)


def _bounds(na: str, nb: str) -> tuple[str, str]:
    """SQL of the least overlap of two linking sets of these sizes, and of the members they then share among their
    first ones: with ``most`` and ``least`` from here, sets that link share at least ``least`` members among their
    first n - most + least, whatever their order."""
    most = f"((({na}) + ({nb})) * {SIMILARITY} + {99 + SIMILARITY}) div {100 + SIMILARITY}"
    prefix = [f"({n}) - (({n}) * {SIMILARITY} + 99) div 100 + 1" for n in (na, nb)]
    least = f"least({prefix[0]} - ({na}) + {most}, {prefix[1]} - ({nb}) + {most})"
    return most, least


def _sized(na: str, nb: str) -> str:
    return f"100 * least({na}, {nb}) >= {SIMILARITY} * greatest({na}, {nb})"


def _shared_early(a: str, b: str, first: bool = False) -> str:
    """SQL: whether a shared shingle is among the first members, of both sets, that must share some (with ``first``,
    among those that must share one), and both have so many entries that they can share enough."""
    most, least = _bounds(f"{a}n", f"{b}n")
    some = 1 if first else least
    early = f"{a}pos < {a}n - {most} + {some} and {b}pos < {b}n - {most} + {some}"
    return f"({a}w > 1 or ({early} and least({a}all, {b}all) >= {least}))"


def _entries(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, entries, large), ``large`` marked for broadcast if it is small. Vertices are the distinct sets: v, doc, n, f1, f2 and their group. Entries are
    (token, v, n, pos, w, all) of all shingles in the prefixes of two or more groups, each of weight 1; of groups
    with several members, one more shingle stands for the whole prefix and has its weight. ``all`` is the weight of
    all entries of a set. Of shingles with more than FEW entries, ``large`` tells into how many buckets they go.

    The prefix of a group is dealt out once, however many documents share it. Frequent shingles need no count;
    the rare ones are counted by a window, whose partitions they keep small."""
    full = rows.where("n > 0")
    vertices = materialized(full.groupBy("f1", "f2", "n", "g1", "g2").agg(
        F.min("row").alias("v"), F.min_by("doc_id", "row").alias("doc")), "sets")
    groups, of = counted(vertices.groupBy("n", "g1", "g2").agg(F.min("v").alias("g"), F.count("*").alias("members")),
                         "groups")
    heads = small(groups.select(F.col("g").alias("row")), of["rows"])
    one = full.select("row", "n", "common", "prefix").join(heads, "row", "left_semi")
    dealt = one.select(F.col("row").alias("g"), "n", "common", F.posexplode("prefix").alias("pos", "token"))
    rare = dealt.where("pos < common").withColumn("groups", F.count("*").over(Window.partitionBy("token")))
    shared = rare.where("groups > 1").drop("groups").unionAll(dealt.where("pos >= common")).drop("common")
    shared = materialized(shared, "shared")
    # Two members of a group share all of the prefix; nothing more need be known of them.
    many = groups.where("members > 1").select(
        F.col("g1").alias("token"), "g", "n", F.lit(0).alias("pos"), (F.col("n") + 1).alias("w"))
    members = groups.select("n", "g1", "g2", "g").join(vertices, ["n", "g1", "g2"]).select("g", "v")
    entries = shared.select("token", "g", "n", "pos", F.lit(1).cast("long").alias("w")).unionAll(many)
    entries = materialized(entries.join(members, "g").select("token", "v", "n", "pos", "w"), "dealt")
    weights, of = counted(entries.groupBy("v").agg(F.sum("w").alias("all")), "weights")
    entries = materialized(entries.join(small(weights, of["rows"]), "v"), "entries")
    large = entries.groupBy("token").agg(F.count("*").alias("rows")).where(F.col("rows") > FEW)
    large, of = counted(large.select("token", F.ceil(F.col("rows") / BUCKET).alias("buckets")), "large")
    return vertices, entries, small(large, of["rows"])


def _star_pairs(entries: DataFrame, turn: int) -> DataFrame:
    """(a, b): pairs of a set b with a hub a, of another component, of one of b's large buckets, if their prefixes
    share enough to link. The hub of a bucket is, by a hash of the turn, one of those with the most entries in
    large buckets for their size, as texts have that differ least from their copies; entries of a frequent shingle
    are dealt into several buckets, whose hubs are compared in turn with one of them. A set has no more hubs than
    its prefix has members, mostly a few."""
    open_ = entries.withColumn("bucket", F.pmod(F.xxhash64("v", F.lit(turn)), "buckets"))
    hub = F.min(F.struct(F.col("edge"), F.xxhash64("v", F.lit(turn)).alias("o"), "v", "n", "c"))
    open_ = open_.withColumn("h", hub.over(Window.partitionBy("token", "bucket")))
    tops = open_.where("buckets > 1 and v = h.v").withColumn("h", hub.over(Window.partitionBy("token")))
    pairs = open_.unionAll(tops).where("h.c != c").where(_sized("n", "h.n")).groupBy(
        F.col("h.v").alias("a"), F.col("v").alias("b")).agg(F.max("w").alias("w"))
    # At most a prefix of tokens each.
    own = entries.groupBy("v").agg(F.first("n").alias("n"), F.first("all").alias("all"), F.collect_list("token").alias("t"))
    for end in "ab":
        pairs = pairs.join(own.toDF(end, f"{end}n", f"{end}all", f"{end}t"), end)
    # Entries outside of large buckets may be shared too; the rest of each is room for that.
    shared = "size(array_intersect(at, bt)) + least(aall - size(at), ball - size(bt))"
    return pairs.where(f"w > 1 or {shared} >= {_bounds('an', 'bn')[1]}").select("a", "b")


def _rest_pairs(few: DataFrame, many: DataFrame) -> DataFrame:
    """(a, b): all pairs in different components whose prefixes share enough to link.

    Of shingles with few entries, all pairs of a list; of the others, the members of the largest component are not
    compared with one another, and Spark splits the join where a bucket is large."""
    item = F.struct("v", "n", "pos", "w", "c", "all")
    lists = few.groupBy("token").agg(F.array_sort(F.collect_list(item)).alias("s")).where("size(s) > 1")
    inner = (f"transform(filter(s, y -> y.v > x.v and y.c != x.c and {_sized('x.n', 'y.n')} and "
             f"{_shared_early('x.', 'y.')}), y -> struct(x.v as a, y.v as b, x.n as an, y.n as bn, x.w as w))")
    listed = lists.select(F.explode(F.expr(f"flatten(transform(s, x -> {inner}))")).alias("p")).select("p.*")
    counts = many.groupBy("token", "c").agg(F.count("*").alias("rows"))
    most = counts.groupBy("token").agg(F.max_by("c", F.struct("rows", "c")).alias("most"), F.count("*").alias("parts"))
    most, of = counted(most.where("parts > 1").drop("parts"), "most")
    open_ = many.join(small(most, of["rows"]), "token")
    names = ("v", "n", "pos", "w", "c", "all")
    minor = open_.where("c != most").select("token", *[F.col(x).alias("a" + x) for x in names])
    every = open_.select("token", (F.col("most") == F.col("c")).alias("major"), *[F.col(x).alias("b" + x) for x in names])
    # Linking sets share one of their very first members; two minor members meet from both sides, one counts.
    met = minor.join(every, (minor["token"] == every["token"]) & F.expr(
        "ac != bc and (major or av < bv) and " + _sized("an", "bn") + " and " + _shared_early("a", "b", first=True)))
    low = "av < bv"
    met = met.selectExpr("least(av, bv) as a", "greatest(av, bv) as b", f"if({low}, an, bn) as an", f"if({low}, bn, an) as bn",
                         "if(aw > 1, aw, 0) as w").distinct()
    # The members shared in large buckets are counted from the lists of both sets.
    own, of = counted(many.groupBy("v").agg(F.collect_list("token").alias("t")), "lists", held=F.sum(F.size("t")))
    held = of["held"] or 0
    pairs = listed.unionAll(met).groupBy("a", "b", "an", "bn").agg(F.sum("w").alias("shared"))
    for end in "ab":
        lists = own.toDF(end, f"{end}t")
        pairs = pairs.join(F.broadcast(lists) if held <= BROADCAST_SHINGLES else lists, end, "left")
    shared = "shared + if(at is null or bt is null, 0, size(array_intersect(at, bt)))"
    return pairs.where(f"{shared} >= {_bounds('an', 'bn')[1]}").select("a", "b")


def _verified(pairs: DataFrame, rows: int, docs: DataFrame, vertices: DataFrame) -> tuple[DataFrame, int]:
    """Those of so many pairs whose sets overlap enough, by their exact intersection, and their number. The sets of
    these pairs alone are read again from their texts; those of the hubs are broadcast, in slices, if their counted
    shingles are few."""
    ends = pairs.select(F.col("a").alias("v"), F.lit(True).alias("hub")).unionAll(pairs.select("b", F.lit(False)))
    ids, of = counted(ends.groupBy("v").agg(F.max("hub").alias("hub")), "ids")
    wanted, of = counted(vertices.join(small(ids, of["rows"]), "v"), "wanted", held=F.sum(F.when(F.col("hub"), F.col("n"))))
    sets = materialized(_sets(docs, wanted, of["rows"]), "tokens")
    hubs = sets.where("hub").select(F.col("v").alias("a"), F.col("tokens").alias("a_tokens"))
    both = sets.select(F.col("v").alias("b"), F.col("tokens").alias("b_tokens")).join(small(pairs, rows), "b")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    size = F.size("a_tokens") + F.size("b_tokens")
    enough = 100 * common >= SIMILARITY * (size - common)
    slices = max(1, -(-(of["held"] or 0) // BROADCAST_SHINGLES))
    if slices > SLICES:
        links, of = counted(both.join(hubs, "a").where(enough).select("a", "b"), "links")
        return links, of["rows"]
    place, met, made = F.pmod(F.xxhash64("a"), F.lit(slices)), [], 0
    for i in range(slices):
        # One slice at a time is held.
        part = both.where(place == i).join(F.broadcast(hubs.where(place == i)), "a").where(enough).select("a", "b")
        part, of = counted(part, "links")
        met, made = [*met, part], made + of["rows"]
    return reduce(DataFrame.unionAll, met), made


def _sets(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """(v, hub, tokens) of the so many wanted vertices, read again from their texts."""

    def again(frames):
        for part in _parts(frames):
            rows = []
            for doc, text in zip(part["doc_id"], strings(part["text"]), strict=True):
                own = shingles(text)
                rows.append((None if pd.isna(doc) else int(doc), *_two(own.tobytes()), own.view("i8")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SETS.split(", ")], dtype=object)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(small(wanted.select("doc"), rows), F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi")
    return texts.mapInPandas(again, SETS).join(small(wanted.select("v", "hub", "doc", "f1", "f2"), rows), ["f1", "f2"]).where(
        F.col("doc").eqNullSafe(F.col("doc_id"))).select("v", "hub", "tokens")


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, linked): one row per document (doc_id, n, f1, f2), and (v, c) with f1, f2 for every distinct set.

    Exact: two sets of enough overlap share a shingle of their prefixes, so they meet in a bucket. There each
    set is first compared with the bucket's hub, some rounds long; sets found linked need no more comparing.
    At last all pairs of a bucket that are still in different components, and whose sizes and shared prefix allow
    a link, are compared. So copies and near copies cost about one comparison each, and no link between
    components is lost.
    """
    send_code(__name__)
    rows = materialized(features(docs, frequent_items(docs)).withColumn("row", F.monotonically_increasing_id()),
                        "shingled")
    vertices, entries, large = _entries(rows)
    many = materialized(entries.join(large, "token"), "many")
    # In tenths of its prefix, how much of a set is in no large bucket.
    inner = many.groupBy("v", "n").agg(F.count("*").alias("here")).select(
        "v", F.floor(10 - 10 * F.col("here") * 100 / ((100 - SIMILARITY) * F.col("n") + 100)).alias("edge"))
    inner, of = counted(inner, "edges")
    many = materialized(many.join(small(inner, of["rows"]), "v"), "many")
    few = entries.join(large, "token", "left_anti")
    links, labels, known, first, turn = None, None, None, None, 0 if of["rows"] else ROUNDS

    def labelled(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("c", F.col("v"))
        return rows.join(known, "v", "left").withColumn("c", F.coalesce("component", "v")).drop("component")

    while True:
        last = turn >= ROUNDS
        found = _rest_pairs(labelled(few), labelled(many)) if last else _star_pairs(labelled(many), turn)
        found, of = counted(found.select("a", "b"), "pairs")
        made = 0
        if of["rows"]:
            new, made = _verified(found, of["rows"], docs, vertices)
        if made:
            links = new if links is None else links.unionAll(new)
            labels, of = counted(components(links), "labels")
            known = small(labels.select(F.col("id").alias("v"), "component"), of["rows"])
        if last:
            break
        first = made if first is None else first
        turn = turn + 1 if made > 0 and made >= WORTH * first else ROUNDS
    linked = vertices.select("v", "f1", "f2")
    if labels is None:
        return rows, linked.withColumn("c", F.col("v"))
    return rows, linked.join(labels.withColumnRenamed("id", "v"), "v", "left").select(
        "v", "f1", "f2", F.coalesce("component", "v").alias("c"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text; other columns are left out).

    ``component_id`` is the smallest doc_id that links reach, the row's own included. Null, empty and wordless
    texts have empty sets and link with nothing, not even one another. Equal sets link, so repeated rows share
    a component; a null id never is a component's smallest unless all of it are null. An empty table gives none.
    """
    rows, linked = similar_sets(docs)
    thin = rows.select("doc_id", "n", "f1", "f2", "row")
    placed = thin.join(linked.select("f1", "f2", "c"), ["f1", "f2"], "left")
    placed = materialized(placed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("c")).alias("c")), "placed")
    least = placed.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    out = placed.where("c is not null").join(least, "c").select("doc_id", "n", "component_id").unionAll(
        placed.where("c is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
