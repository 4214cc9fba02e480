"""Probability models with Spark ML: imputation, weights, fitting, scoring, importance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steadycast.operators import bagging
from steadycast.operators.features import (
    CATEGORICAL_FEATURES,
    CROSS_LAYER_FEATURES,
    NETWORK_FEATURES,
    require_columns,
)
from steadycast.operators.ranks import approximate_quantiles, exact_quantiles
from steadycast.params import ROW_KEY, ModelParams
from steadycast.session import shared_dir

TARGET = "future_poor_qoe"
FILLED = "__f_"
NUMERIC_FEATURES = [c for c in CROSS_LAYER_FEATURES if c not in CATEGORICAL_FEATURES]


def median_table(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Median per numeric column, from one unpivot; one row per column."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    find = exact_quantiles if exact else approximate_quantiles
    return find(df.select(F.inline(cells)), "value", {"median": 0.5}, ["column"]).select("column", "median")


def medians(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, float]:
    """Medians as driver values, one number per column; 0 for a column without values."""
    found = {r["column"]: r["median"] for r in median_table(df, columns, exact).collect()}
    return {c: found.get(c) if found.get(c) is not None else 0.0 for c in columns}


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value of a column; equal counts take the smallest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.col("rows").desc(), F.col(column)).limit(1)


def class_weights(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Balanced weight n / (2 * n_class) per class."""
    per_class = df.groupBy(F.col(target).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    # A window over two rows.
    total = F.sum("rows").over(Window.partitionBy(F.lit(0)))
    return per_class.select("label", "rows", (total / (2 * F.col("rows"))).alias("weight"))


def with_weights(df: DataFrame, target: str = TARGET) -> tuple[DataFrame, int]:
    """Add label and balanced weight; also return the number of rows."""
    found = {r["label"]: r for r in class_weights(df, target).collect()}
    if set(found) != {0, 1}:
        raise ValueError("training rows need both classes")
    label = F.col(target).cast("int")
    weight = F.when(label == 1, found[1]["weight"]).otherwise(found[0]["weight"])
    rows = found[0]["rows"] + found[1]["rows"]
    return df.withColumns({"label": label.cast("double"), "weight": weight}), rows


def laid_out(df: DataFrame, partitions: int, keys: Sequence[str] = ROW_KEY) -> DataFrame:
    """Fixed layout before fitting: histograms and bootstraps depend on row placement.

    Keys are unique per row, so partitions are even. Zero partitions means the session's
    number of shuffle partitions.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)


def filler(numeric: dict[str, float], categorical: dict[str, str]) -> SQLTransformer:
    """A stage that fills missing values with stored medians and modes."""
    parts = [
        f"coalesce(nanvl(cast(`{c}` as double), cast(null as double)), cast('{v!r}' as double)) AS `{FILLED}{c}`"
        for c, v in numeric.items()
    ]
    for c, v in categorical.items():
        text = str(v).replace("\\", "\\\\").replace("'", "\\'")
        parts.append(f"coalesce(`{c}`, '{text}') AS `{FILLED}{c}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def logistic_stages(fill: dict[str, float], rows: int, params: ModelParams = ModelParams()) -> list:
    """Filled, scaled network features and a logistic regression with C = 1.

    The penalty of the reference objective is one over the summed weights, which the
    balanced weights make equal to the number of rows.
    """
    return [
        filler(fill, {}),
        VectorAssembler(inputCols=[FILLED + c for c in fill], outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__features", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="__features", labelCol="label", weightCol="weight",
            predictionCol="__d", rawPredictionCol="__m", probabilityCol="__p",
            regParam=1.0 / rows, elasticNetParam=0.0, standardization=False,
            maxIter=params.max_iter, tol=1e-8,
        ),
    ]


def forest_stages(
    numeric: dict[str, float], categorical: dict[str, str], params: ModelParams = ModelParams()
) -> list:
    """Filled features, one-hot categories (unknown is all zeros) and a random forest."""
    indexers, encoders, encoded = [], [], []
    for c in categorical:
        indexers.append(
            StringIndexer(
                inputCol=FILLED + c, outputCol=f"__i_{c}", handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
        # The last slot is the unknown one.
        encoders.append(OneHotEncoder(inputCol=f"__i_{c}", outputCol=f"__e_{c}", dropLast=True))
        encoded.append(f"__e_{c}")
    return [
        filler(numeric, categorical),
        *indexers,
        *encoders,
        VectorAssembler(inputCols=[FILLED + c for c in numeric] + encoded, outputCol="__features"),
        RandomForestClassifier(
            featuresCol="__features", labelCol="label", weightCol="weight",
            predictionCol="__d", rawPredictionCol="__m", probabilityCol="__p",
            numTrees=params.trees, maxDepth=params.depth, minInstancesPerNode=params.leaf,
            subsamplingRate=params.sample_share, featureSubsetStrategy="sqrt",
            maxBins=params.max_bins, seed=params.seed, maxMemoryInMB=params.memory_mb,
            # A row's node in every tree is kept from level to level, so no level walks the trees from the root again.
            cacheNodeIds=True,
        ),
    ]


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """The frame, held while several passes over it run, so that it is not shuffled and sorted for each."""
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def fit_logistic(
    train: DataFrame, params: ModelParams = ModelParams(), exact: bool = True, fill: dict[str, float] | None = None
) -> PipelineModel:
    """Network-only logistic regression on training rows; ``fill`` holds medians found before."""
    require_columns(train.columns, NETWORK_FEATURES, "logistic regression")
    weighted, rows = with_weights(train)
    fill = fill or medians(train, NETWORK_FEATURES, exact)
    ready = laid_out(weighted.select(*ROW_KEY, "label", "weight", *NETWORK_FEATURES), params.fit_partitions)
    with kept(ready):
        return Pipeline(stages=logistic_stages({c: fill[c] for c in NETWORK_FEATURES}, rows, params)).fit(ready)


def fit_forest(
    train: DataFrame, params: ModelParams = ModelParams(), exact: bool = True, fill: dict[str, float] | None = None
) -> PipelineModel:
    """Cross-layer random forest on training rows; ``fill`` holds medians found before.

    With ``own_weights`` each tree weighs the classes by its own bootstrap; else one weight holds for
    all trees, which are then trained together in far fewer passes over the rows.
    """
    require_columns(train.columns, CROSS_LAYER_FEATURES, "random forest")
    weighted, _ = with_weights(train)
    # Node ids are cut from their lineage by checkpoints.
    shared_dir(train.sparkSession)
    modes = {}
    for c in CATEGORICAL_FEATURES:
        row = most_frequent(train, c).first()
        modes[c] = row[c] if row else ""
    keep = dict.fromkeys([*ROW_KEY, "label", "weight", *CROSS_LAYER_FEATURES])
    ready = laid_out(weighted.select(*keep), params.fit_partitions)
    fill = fill or medians(train, NUMERIC_FEATURES, exact)
    stages = forest_stages({c: fill[c] for c in NUMERIC_FEATURES}, modes, params)
    with kept(ready):
        if not params.own_weights:
            return Pipeline(stages=stages).fit(ready)
        prepared = Pipeline(stages=stages[:-1]).fit(ready)
        vectors = bagging.with_draws(prepared.transform(ready), params).select("__features", "label", bagging.DRAWS).checkpoint()
    return PipelineModel([*prepared.stages, bagging.fit_trees(vectors, params)])


def score(model: Transformer, df: DataFrame, output: str) -> DataFrame:
    """Add the probability of the positive class."""
    scored = model.transform(df)
    scored = scored.withColumn(output, vector_to_array("__p")[1])
    return scored.drop(*[c for c in scored.columns if c.startswith("__")])


def feature_importance(model: PipelineModel, sample: DataFrame) -> DataFrame:
    """Importance per model input, highest first; one row per input."""
    names = model.transform(sample.limit(0)).schema["__features"].metadata["ml_attr"]["attrs"]
    ordered = sorted((a["idx"], a["name"]) for group in names.values() for a in group)
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(n.replace(FILLED, "").replace("__e_", ""), float(weights[i])) for i, n in ordered]
    out = sample.sparkSession.createDataFrame(rows, "feature string, importance double")
    return out.orderBy(F.col("importance").desc(), "feature")


def top_features(importance: DataFrame, k: int = 20) -> DataFrame:
    """The k most important inputs."""
    return importance.orderBy(F.col("importance").desc(), "feature").limit(k)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
