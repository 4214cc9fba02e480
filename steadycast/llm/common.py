"""Helpers shared by the corpus operators."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from steadycast.session import run_dir

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, keeps columns apart.

    The files stay until the folder of ``spark.checkpoint.dir`` is cleaned, as the caller may
    still be reading from them.
    """
    path = run_dir(df.sparkSession, f"llm-{purpose}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nullable(df: DataFrame) -> StructType:
    """The schema of ``df`` with nulls allowed everywhere, for rows that pass through Python."""
    return StructType([StructField(f.name, f.dataType, True, f.metadata) for f in df.schema.fields])


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a fresh copy."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    x ^= x >> np.uint64(33)
    return x


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    limit = 1 << 19

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = zlib.crc32(word) << 32 | zlib.crc32(word, 0x9E3779B9)
        if len(word) > 8:  # two chained crcs are linear in each other; fold in the ends
            value ^= int.from_bytes(word[:8], "little") * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
            value ^= int.from_bytes(word[-8:], "little") * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF
        else:
            value ^= int.from_bytes(word, "little") * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        self[word] = value
        return value
