"""Secret scans over an incremental ledger of content-addressed blobs. SQL functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import materialized

#: A private key: from BEGIN to the END line with no five dashes between; where that is missing, BEGIN, header lines
#: and the base64 lines that follow, of which the last may be short. Line ends may be written as backslash and n.
#: Loops are possessive, so that a text of any length takes no stack and is passed once.
_KEY, _GAP, _LONG = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----", r"""(?:\s|\\[nrt]|[>"'#*])""", r"[A-Za-z0-9+/]{24,}+={0,2}+"
PEM = (rf"-----BEGIN {_KEY}(?:(?:[^-]|-(?!----))*+-----END {_KEY}"
       rf"|(?:{_GAP}*+[A-Z][A-Za-z-]*+:[^\r\n\\]*+)*+(?:{_GAP}*+{_LONG})++"
       rf"(?:{_GAP}*+(?<=[\nnr])[A-Za-z0-9+/]++={{0,2}}+(?=[ \t]*+(?:[\r\n\\\"']|\Z)))?)?")
#: Fixed values: (kind, version, pattern, group that is measured, least length of it). The first three are the
#: base kinds, in their order; a changed pattern takes a new version, which scans all blobs again for it.
RULES = (
    ("assign", 1, r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", 1, r"[0-9a-f]+", 0, 16),
    ("github", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("pem", 2, PEM, 0, 1),
)
BASE = ("assign", "access", "hex")
#: A single character class is matched with its least length at once: the maximal runs are the same.
FAST = {"hex": r"[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}", "github": r"gh[pousr]_[A-Za-z0-9]{36,}"}
SPANS = "array<struct<start:bigint,end:bigint>>"
#: Spans of all blobs together are broadcast up to this number.
BROADCAST_SPANS = 200_000
#: Names that no table should have.
BLOB, FOUND, KNOWN = "_panelcast_blob", "_panelcast_found", "_panelcast_known"
LEDGER = f"blob binary, kind string, version int, spans {SPANS}"


def blob_of(text: Column) -> Column:
    """The address of a text: its SHA-256. A null text is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, kind, version, spans) of every blob (blob, text) and rule, spans empty where nothing is found.

    Spans are those of the leftmost non-overlapping matches in the whole text, in code points, end exclusive;
    matches whose measured group is too short are dropped. A text is cut at the matches; the running lengths
    of the pieces give the places, by a window over the matches of one blob and kind. Only blobs that match
    are cut, and only their cuts are shuffled. A column KNOWN of ``blobs`` has a bit for each rule, in their order,
    that is not to be scanned for.
    """
    text, none = F.col("text"), F.array().cast("array<struct<piece:int,match:int,group:int>>")
    found = []
    for i, (kind, version, pattern, group, least) in enumerate(rules):
        p = F.lit(FAST.get(kind, pattern))
        whole = F.regexp_extract_all(text, p, F.lit(0))
        parts = F.transform(
            F.arrays_zip(F.split(text, FAST.get(kind, pattern), -1).alias("p"), whole.alias("m"),
                         F.regexp_extract_all(text, p, F.lit(group)).alias("g")),
            lambda x: F.struct(F.length(x["p"]).alias("piece"), F.length(x["m"]).alias("match"),
                               F.length(x["g"]).alias("group")))
        cut = F.when(text.rlike(FAST.get(kind, pattern)), parts).otherwise(none)
        entry = F.struct(F.lit(kind).alias("kind"), F.lit(version).alias("version"), F.lit(least).alias("least"),
                         cut.alias("parts"))
        found.append(F.when(F.col(KNOWN).bitwiseAND(1 << i) == 0, entry) if KNOWN in blobs.columns else entry)
    found = F.filter(F.array(*found), lambda x: x.isNotNull())
    cuts = materialized(blobs.select("blob", found.alias("found")), "secret-cuts")
    cuts = cuts.select("blob", F.explode("found").alias("f")).select("blob", "f.*")
    clean = cuts.where(F.size("parts") == 0).select("blob", "kind", "version", F.array().cast(SPANS).alias("spans"))
    rows = cuts.selectExpr("blob", "kind", "version", "least", "posexplode(parts) as (i, part)")
    places = "over (partition by blob, kind order by i)"
    rows = rows.selectExpr(
        "blob", "kind", "version", "least", "part.match as m", "part.`group` as g",
        f"sum(part.piece) {places} + sum(coalesce(part.match, 0)) {places} as stop")
    span = F.struct((F.col("stop") - F.col("m")).alias("start"), F.col("stop").alias("end"))
    rows = rows.groupBy("blob", "kind", "version").agg(
        F.array_sort(F.collect_list(F.when(F.col("g") >= F.col("least"), span))).alias("spans"))
    return clean.unionAll(rows)


def update_ledger(texts: DataFrame, ledger: DataFrame | None = None, rules=RULES, text: str = "text") -> DataFrame:
    """The rows to append to the ledger: every (blob, kind, version) of ``texts`` that ``ledger`` lacks, scanned.

    ``texts`` may hold every historical version of every file; equal contents are one blob, collapsed before the
    shuffle. Blobs that the ledger knows under the present version of each rule are not read again, and a new
    rule version scans for that rule alone."""
    blobs = texts.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return scan(blobs, rules)
    bits = reduce(lambda other, i: F.when(_present(rules[i:i + 1]), F.lit(1 << i)).otherwise(other), range(len(rules)), F.lit(0))
    known = ledger.where(_present(rules)).groupBy("blob").agg(F.bit_or(bits).alias(KNOWN))
    known = known.withColumnRenamed("blob", BLOB)
    rest = blobs.join(known, F.col("blob") == F.col(BLOB), "left").select("blob", "text", F.coalesce(KNOWN, F.lit(0)).alias(KNOWN))
    return scan(rest.where(F.col(KNOWN) != (1 << len(rules)) - 1), rules)


def _present(rules) -> Column:
    """Whether a row of a ledger is of one of the rules in its present version."""
    return reduce(or_, [(F.col("kind") == r[0]) & (F.col("version") == r[1]) for r in rules])


def spans_by_blob(ledger: DataFrame, rules=RULES) -> DataFrame:
    """(blob, s): for each blob with findings under the present versions of the rules, its spans as structs
    (start, place, kind, end), by start, then by the place of the rule. Written, as two joins may read it, and
    marked for broadcast while its blobs and spans, counted first, are few."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r[0], i)])
    spans = ledger.where(_present(rules) & (F.size("spans") > 0)).select("blob", "kind", F.explode("spans").alias("s"))
    spans = spans.select("blob", F.struct(F.col("s.start").alias("start"), order[F.col("kind")].alias("place"), "kind",
                                          F.col("s.end").alias("end")).alias("s"))
    held = materialized(spans.groupBy("blob").agg(F.array_sort(F.collect_list("s")).alias("s")), "secret-spans")
    return F.broadcast(held) if (held.agg(F.sum(F.size("s"))).first()[0] or 0) <= BROADCAST_SPANS else held


def findings(texts: DataFrame, ledger: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``texts`` without their text, with what the ledger holds on it under the present versions of the rules:
    columns n_assign, n_access, n_hex, base_sha256, spans.

    Spans read ``kind:start:end``, by start, then by the order of the rules, joined by commas; base_sha256 is the
    lower-case hex SHA-256 of those of the base kinds. Null and empty texts, and clean ones, have no spans and
    the hash of the empty text. Only blobs with findings meet the texts, so a blob with many paths costs no more."""
    base = F.filter("s", lambda x: x["place"] < len(BASE))

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    count = [F.expr(f"cast(size(filter(s, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    held = spans_by_blob(ledger, rules).select(
        F.col("blob").alias(BLOB), *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
    rows = texts.withColumn(BLOB, blob_of(F.col(text))).drop(text).join(held, BLOB, "left").drop(BLOB)
    return rows.fillna(0, [f"n_{k}" for k in BASE]).withColumns({
        "base_sha256": F.coalesce("base_sha256", F.sha2(F.lit(""), 256)), "spans": F.coalesce("spans", F.lit(""))})


def redacted(texts: DataFrame, ledger: DataFrame, rules=RULES, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``texts`` with every found span in the text replaced by ``mark``; spans that overlap or touch are one.
    Clean, null and empty texts stay as they are."""
    held = spans_by_blob(ledger, rules).select(F.col("blob").alias(BLOB), F.col("s").alias(FOUND))
    rows = texts.withColumn(BLOB, blob_of(F.col(text))).join(held, BLOB, "left")
    out = F.expr(f"""aggregate({FOUND}, named_struct('at', 0L, 'out', ''), (a, x) -> named_struct(
        'at', greatest(a.at, x.end),
        'out', if(x.start > a.at or a.at = 0,
                  concat(a.out, substring(`{text}`, cast(a.at + 1 as int), cast(x.start - a.at as int)), '{mark}'), a.out)),
        a -> concat(a.out, substring(`{text}`, cast(a.at + 1 as int), length(`{text}`))))""")
    return rows.withColumn(text, F.when(F.col(FOUND).isNotNull(), out).otherwise(F.col(text))).drop(BLOB, FOUND)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scanned(texts: DataFrame, rules=RULES) -> DataFrame:
    """``findings`` of ``texts`` (doc_id, text) from a ledger built for them and written to the shared folder in two
    steps, as two deliveries would: rows of even doc_id first, then of all rows the blobs that the written ledger lacks."""
    first = materialized(update_ledger(texts.where("doc_id % 2 = 0"), None, rules), "secret-ledger")
    ledger = first.unionByName(materialized(update_ledger(texts, first, rules), "secret-ledger"))
    return findings(texts, ledger, rules)
