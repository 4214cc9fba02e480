"""Wide scenario tables: tab-separated files whose names carry the scenario."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from steadycast.functions.scalar import number_or_null
from steadycast.operators.reshape import loss_column, mos_column
from steadycast.params import RESOLUTION_BY_BITRATE

# Fixed value: the form of a scenario file name.
FILE_NAME = r"^MOS_BS_(\d+)_([A-Za-z]+)_PRB_(\d+)\.tsv$"
BASE_COLUMNS = ["User_ID", "Timestamp", "Tput", "Latitude", "Longitude"]


def path_parts(path: Column, patterns: Mapping[str, str]) -> dict[str, Column]:
    """First group of each pattern."""
    return {name: F.regexp_extract(path, pattern, 1) for name, pattern in patterns.items()}


def scenario_columns(file_name: Column) -> dict[str, Column]:
    """Station, mobility and resource setting; a name of another form stops the job."""
    refused = F.raise_error(F.concat(F.lit("unexpected scenario file name: "), file_name))

    def part(k: int, to: str) -> Column:
        text = F.regexp_extract(file_name, FILE_NAME, k)
        return F.when(file_name.rlike(FILE_NAME), text.cast(to)).otherwise(refused.cast(to))

    return {"base_station": part(1, "long"), "mobility": part(2, "string"), "prb": part(3, "long")}


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one file of the set."""
    first = spark.read.text(path).limit(1).first()
    if first is None:
        raise FileNotFoundError(f"no rows under {path}")
    return first[0].rstrip("\r\n").split("\t")


def read_scenarios(
    spark: SparkSession,
    path: str,
    bitrates: Sequence[int] = tuple(RESOLUTION_BY_BITRATE),
    resolutions: Mapping[int, str] = RESOLUTION_BY_BITRATE,
    glob: str = "*.tsv",
) -> DataFrame:
    """One lazy scan over all scenario files.

    Every cell is read as text against the file header, then only the needed columns are
    cast, so unused columns are never parsed. A bad time or number stops the job; NaN
    becomes null.
    """
    files = f"{path.rstrip('/')}/{glob}" if "*" not in path else path
    try:
        names = header(spark, files)
    except AnalysisException as error:
        raise FileNotFoundError(f"no scenario files match {files}") from error
    values = [c for b in bitrates for c in (loss_column(b, resolutions), mos_column(b))]
    missing = [c for c in [*BASE_COLUMNS, *values] if c not in names]
    if missing:
        raise ValueError(f"scenario files lack columns: {', '.join(missing)}")
    schema = StructType([StructField(n, StringType()) for n in names])
    raw = (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(files)
    )
    scenario = scenario_columns(F.col("_metadata.file_name"))
    return raw.select(
        *[c.alias(n) for n, c in scenario.items()],
        F.col("User_ID").cast("long").alias("User_ID"),
        F.to_timestamp("Timestamp").alias("Timestamp"),
        *[number_or_null(F.col(c)).alias(c) for c in ["Tput", "Latitude", "Longitude", *values]],
    )
