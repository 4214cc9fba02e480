"""JSON-lines records and review sheets in CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from steadycast.operators.features import require_columns
from steadycast.operators.reviews import REVIEW_COLUMNS

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON object per line; a malformed line stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_with_rejects(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Well-formed records, and the text of the lines that are not JSON objects."""
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.withColumn("r", F.from_json("value", wide, options))
    is_object = F.ltrim("value").startswith("{") & F.col(f"r.{CORRUPT}").isNull()
    good = parsed.where(is_object).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    return good, parsed.where(~is_object).select(F.col("value").alias("line"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One record per line; null fields are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_review_csv(spark: SparkSession, path: str, columns: Sequence[str] = REVIEW_COLUMNS) -> DataFrame:
    """Review rows with every value as text; required columns must be in the header."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    # No inference: all values stay text. Blank cells become empty text, not null.
    found = reader.option("inferSchema", False).csv(path)
    require_columns(found.columns, list(columns), f"review sheet {path}")
    return found.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def write_review_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """Review rows as CSV with quotes doubled and white space kept.

    Prompts share most of their text: ``gzip`` stores a large sheet in a small part of its bytes. Sheets
    of many lines a cell are never split for reading, so nothing is lost by it.
    """
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    writer.options(**kept, compression=compression).csv(path)
