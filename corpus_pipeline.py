"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import decontaminate, pieces, prefix_join, secret_ledger, toxicity
from panelcast.llm.common import counted, materialized, small, table, text_batches

#: From this score on a document is rejected as toxic.
TOXIC = 0.5
#: A name that no table should have.
MARK = "_panelcast_mark"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the columns stay. Null and empty texts score like texts without any of the
    terms that tell labels apart, so they stay. Rows never meet: repeated rows share their fate."""
    model = toxicity.fit(docs, table(text_batches(spark), sf_dir, "labels"))
    return toxicity.scored(docs, model, into=MARK).where(F.col(MARK)["score"] < TOXIC).drop(MARK)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Rows of one id are one document: it stays if any of its texts is its group's smallest, then with one row for
    each different text. Rows without an id count as one document too, which stays if a group has no other id.
    Empty texts are in no group and stay."""
    text_batches(spark)
    placed = prefix_join.near_duplicates(docs)
    ids = placed.groupBy("doc_id").agg(
        F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"), F.count("*").alias("rows"))
    ids, of = counted(ids.where("not kept or rows > 1").withColumnRenamed("doc_id", MARK), "ids", kept=F.count_if("kept"))
    stay = of["kept"] or 0
    gone, repeated = small(ids.where("not kept").select(MARK), of["rows"] - stay), small(ids.where("kept").select(MARK), stay)
    same = docs["doc_id"].eqNullSafe(F.col(MARK))
    left = docs.join(gone, same, "left_anti")
    once = left.join(repeated, same, "left_anti")
    more = left.join(repeated, same, "left_semi").withColumn(MARK, F.sha2(F.coalesce("text", F.lit("")), 256))
    return once.unionByName(more.dropDuplicates(["doc_id", MARK]).drop(MARK))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go. Null and empty texts hold none. Repeated rows share their fate."""
    found = decontaminate.with_leaks(docs, table(text_batches(spark), sf_dir, "benchmark"), into=MARK)
    return found.where(F.size(MARK) == 0).drop(MARK)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark, and n_chars, where there is such a column, follows. All
    documents stay; clean, null and empty texts as they are."""
    ledger = materialized(secret_ledger.update_ledger(docs.select("text")), "secret-ledger")
    out = secret_ledger.redacted(docs.withColumn(MARK, F.col("text")), ledger)
    if "n_chars" in docs.columns:
        new = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text") != F.col(MARK), new).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, decoded_ok of every document left; null and empty texts have no ids."""
    text_batches(spark)
    # Workers that have run the stages before hold memory of theirs.
    return pieces.encoded(docs, pieces.load(), remembered=250_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: A learned model and the pieces of a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order, from the table ``documents`` to the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
