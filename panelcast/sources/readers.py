"""Readers of landed files. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.numeric import nan_to_null
from panelcast.operators.assemble import derive_demographics
from panelcast.operators.validate import REQUIRED_COLUMNS, require_columns
from panelcast.sources import schemas
from panelcast.sources.reference_data import entity_dimension


def no_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the first line with any text of every file under ``path``."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("i"),
    )
    # A file is cut into blocks; within the first, ids follow the lines.
    first = lines.where((F.col("start") == 0) & (F.trim("value") != "")).groupBy("file")
    return first.agg(F.min_by("value", "i").alias("line"))


def _value(name: str, kind: T.DataType) -> Column:
    """Text as a value; whole numbers may be written with a decimal point. What doesn't parse is null."""
    text = F.trim(F.col(f"`{name}`"))
    if isinstance(kind, T.IntegralType):
        real = text.try_cast("double")
        return F.coalesce(text.try_cast(kind), F.when(real == F.floor(real), real.try_cast(kind)))
    return text.try_cast(kind)


def read_csv_by_name(
    spark: SparkSession, path: str, schema: str, required: list[str]
) -> DataFrame:
    """CSV files with headers: the columns of ``schema``, found by name, and the ``file`` of each row.

    The files may order their columns differently, leave out columns (null) and hold others (ignored). A header
    without the ``required`` columns is an error. Only the different headers reach the driver; where there are
    several, a row finds its own through the name of its file.
    """
    fields = T.StructType.fromDDL(schema).fields
    first = _first_lines(spark, path)
    headers = sorted(first.groupBy("line").agg(F.min("file").alias("file")).collect(), key=lambda r: r["line"])
    if not headers:
        return spark.createDataFrame([], f"{schema}, file string")
    every = []
    for header in headers:
        names = [n.strip().lstrip("\ufeff") for n in next(csv.reader([header["line"]]))]
        missing = [c for c in required if c not in names]
        if missing:
            raise ValueError(f"{header['file']} lacks the columns {missing}")
        every.append(names)
    # Positions of one header are safe; a name that comes twice counts where it is first.
    columns = [f"_{i}" for i in range(max(map(len, every)))]
    raw = spark.read.schema(", ".join(f"{c} string" for c in columns)).option("header", True).csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"))
    number = F.lit(0)
    if len(headers) > 1:
        known = spark.createDataFrame([(r["line"], i) for i, r in enumerate(headers)], "line string, _header int")
        raw = raw.join(first.join(F.broadcast(known), "line").select("file", "_header"), "file")
        number = F.col("_header")

    def cell(field: T.StructField) -> Column:
        made = F.lit(None).cast(field.dataType)
        for at in {names.index(field.name) for names in every if field.name in names}:
            own = [i for i, names in enumerate(every) if field.name in names and names.index(field.name) == at]
            made = F.when(number.isin(own), _value(f"_{at}", field.dataType)).otherwise(made)
        return made.alias(field.name)

    return raw.select(*map(cell, fields), "file")


def read_panel(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = schemas.PANEL) -> DataFrame:
    """The panel; CSV columns by name, those that are absent null, a file without the key an error."""
    if fmt == "csv":
        return no_nan(read_csv_by_name(spark, path, schema, ["province", "year", "week"]).drop("file"))
    return no_nan(spark.read.schema(schema).format(fmt).load(path))


def read_yearly_cases(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Weekly cases landed as one folder or file per year, tagged with the year.

    The year is that of a ``year`` column in the file, else of a ``year=`` folder, else the first four-digit
    number in the file name.
    """
    schema = schemas.CASES + ", year int"
    if fmt == "csv":
        raw = read_csv_by_name(spark, path, schema, ["province", "week", "cases"])
    else:
        raw = spark.read.schema(schema).format(fmt).load(path).select("*", F.col("_metadata.file_path").alias("file"))
    year = [
        F.regexp_extract("file", pattern, 1).try_cast("int")
        for pattern in (r"/year=([0-9]{4})/[^/]*$", r"((?:19|20)[0-9]{2})[^/]*$")
    ]
    return raw.withColumn("year", F.coalesce("year", *year)).drop("file")


def read_climate(
    spark: SparkSession, path: str, entity: str | None = None, weeks: int | None = None
) -> DataFrame:
    """Weekly climate JSON, one ``province=`` folder per entity.

    ``entity`` prunes to one folder; ``weeks`` keeps the last n weeks up to the
    latest date that has landed.
    """
    df = no_nan(spark.read.schema(schemas.CLIMATE + ", province string").json(path))
    if entity is not None:
        df = df.where(F.col("province") == entity)
    if weeks is not None:
        last = df.agg(F.max("date")).scalar()
        df = df.where(F.col("date") > F.date_sub(last, 7 * weeks))
    return df


def read_demographics(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Demographics JSON, or the built-in table where none has landed."""
    if path is None:
        columns = [c.split()[0] for c in schemas.DEMOGRAPHICS.split(", ")]
        return derive_demographics(entity_dimension(spark).select(*columns))
    return derive_demographics(spark.read.schema(schemas.DEMOGRAPHICS).json(path))


def unpivot_months(lines: DataFrame, value: str = "value", name: str = "enso_index") -> DataFrame:
    """Text lines ``year v1 .. v12`` to (year, month, value).

    Lines with fewer than 13 tokens, a non-numeric year (the header), and
    values that do not parse are left out.
    """
    tokens = lines.select(F.split(F.trim(value), r"\s+").alias("t")).where(F.size("t") >= 13)
    long = tokens.select(
        F.get("t", F.lit(0)).try_cast("int").alias("year"),
        F.posexplode(F.slice("t", 2, 12)).alias("i", "text"),
    )
    return long.select(
        "year", (F.col("i") + 1).cast("int").alias("month"), F.col("text").try_cast("double").alias(name)
    ).where(F.col("year").isNotNull() & F.col(name).isNotNull())


def read_monthly_text(spark: SparkSession, path: str, name: str = "enso_index") -> DataFrame:
    return unpivot_months(spark.read.text(path), "value", name)


def concat_sources(frames: list[DataFrame]) -> DataFrame:
    """Stack frames by column name; absent columns are null, duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_upload_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, records that hold a value of the wrong type, as JSON).

    Only ``.csv`` files with the required columns in the header are accepted.
    Values are read as text and cast here, so that what counts as broken does
    not depend on which columns a query goes on to use.
    """
    if not path.rstrip("/").endswith(".csv"):
        raise ValueError("only .csv uploads are accepted")
    raw = require_columns(spark.read.option("header", True).csv(path), REQUIRED_COLUMNS)
    types = {f.name: f.dataType for f in T.StructType.fromDDL(schemas.UPLOAD).fields}
    names = [c for c in types if c in raw.columns]
    typed = {c: F.trim(c).try_cast(types[c]) for c in names}
    broken = reduce(
        lambda a, b: a | b, [F.col(c).isNotNull() & typed[c].isNull() for c in names]
    )
    good = raw.where(~broken).select(*[typed[c].alias(c) for c in names])
    bad = raw.where(broken).select(F.to_json(F.struct(*raw.columns)).alias("record"))
    return no_nan(good), bad


def read_upload_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, records that don't parse, as they came).

    Each file holds one JSON list of records, or one record per line; its first sign tells which. Files of lines
    are split among tasks; a list is one JSON value and so is read as a whole.
    """
    listed = _first_lines(spark, path).where(F.ltrim("line").startswith("[")).select("file")
    # Files of one upload each, to be read as a whole: a reader takes their names.
    lists = [r["file"] for r in listed.collect()]
    lines = spark.read.text(path).where(F.trim("value") != "")
    if lists:
        lines = lines.select("value", F.col("_metadata.file_path").alias("file")).join(listed, "file", "left_anti").select("value")
        whole = spark.read.text(lists, wholetext=True)
        items = F.from_json("value", "array<string>")
        # A list that doesn't parse is one broken record.
        lines = lines.unionAll(whole.select(F.explode(F.coalesce(items, F.array("value"))).alias("value")))
    kind = schemas.UPLOAD + ", _broken string"
    parsed = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.select("value", parsed.alias("r"))
    broken = F.col("r").isNull() | F.col("r._broken").isNotNull()
    good = rows.where(~broken).select("r.*").drop("_broken")
    return no_nan(good), rows.where(broken).select(F.col("value").alias("record"))


def parse_json(column: Column, schema: str = schemas.UPLOAD) -> Column:
    return F.from_json(column, schema)


def read_latest_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
