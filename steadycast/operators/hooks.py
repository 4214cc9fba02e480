"""Hooks for user code: models, calibrators and explanation clients.

These are the only places where rows go through Python, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from steadycast.operators.features import require_columns


def score_with(df: DataFrame, model: Any, features: Sequence[str], output: str) -> DataFrame:
    """Score with an object that has ``predict_proba(frame) -> (n, 2)``."""
    require_columns(df.columns, list(features), "user model")
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            given = np.asarray(model.predict_proba(batch[names]), dtype=float)
            if given.shape != (len(batch), 2):
                raise ValueError(f"predict_proba returned shape {given.shape} for {len(batch)} rows")
            p = given[:, 1]
            if not np.isfinite(p).all() or (p < 0).any() or (p > 1).any():
                raise ValueError("predict_proba returned values outside [0, 1]")
            yield batch.assign(**{output: p})

    schema = StructType([*df.schema.fields, StructField(output, DoubleType())])
    return df.mapInPandas(run, schema)


def calibrate_with(calibrator: Any, probability: str) -> Column:
    """Column of an object that has ``predict(probabilities)``, clipped to [0, 1]."""

    @F.pandas_udf(DoubleType())
    def run(p: pd.Series) -> pd.Series:
        return pd.Series(np.clip(np.asarray(calibrator.predict(p.to_numpy()), dtype=float), 0.0, 1.0))

    return run(F.col(probability))


def complete_with(prompts: DataFrame, generate_json: Callable[[str], str], output: str = "explanation") -> DataFrame:
    """Fill the explanation from a client function of the prompt.

    A failed call is a rejected case, not a failed job: it gives null, and the failure is kept
    in ``<output>_error``, so that failures can be counted and told apart.
    """
    error = f"{output}_error"
    kept = prompts.drop(output, error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, failures = [], []
            for prompt in batch["prompt"]:
                try:
                    texts.append(generate_json(prompt))
                    failures.append(None)
                except Exception as failure:
                    texts.append(None)
                    failures.append(f"{type(failure).__name__}: {failure}")
            yield batch.assign(**{output: texts, error: failures})

    schema = StructType([*kept.schema.fields, StructField(output, StringType()), StructField(error, StringType())])
    return kept.mapInPandas(run, schema)
