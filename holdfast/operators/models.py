"""Training of the classifiers on a frame of id, target and numeric input columns."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    Imputer,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.config import (
    BINARY_COLUMNS,
    CATEGORICAL_COLUMNS,
    ID,
    MODEL_SEED,
    MODELS,
    NUMERIC_COLUMNS,
    TARGET,
)
from holdfast.functions.numbers import quoted
from holdfast.ledger import Ledger
from holdfast.operators import forests
from holdfast.operators.comparison import RUN_COLUMNS
from holdfast.operators.encoding import feature_names, fit_dictionary
from holdfast.operators.forests import ForestModel
from holdfast.operators.metrics import METRICS, classification_metrics
from holdfast.workspace import materialise, new_path

log = logging.getLogger(__name__)

WEIGHT = "class_weight"
INPUTS = "inputs"
CHECKPOINT_ROUNDS = 10
TREE_MEMORY_MB = 1024
BINS = 32
# Models are fitted on all labelled rows. Up to so many of them, parts hold PART_ROWS rows; the rows beyond come in
# larger parts, GROUP_PART_ROWS each.
FIT_ROWS = 1_000_000
# Rows per part of the rows a model is fitted on. Sampling in training goes by part, so the number and content
# of parts follow from the number of rows and their ids, not from how the table happens to be stored. Every part
# sends counts for every node of a level of a forest, so many small parts cost more than the rows in them.
PART_ROWS = 62_500
# Models trained at the same time.
SIDE_BY_SIDE = 6
# Beyond one part, a forest is fitted in groups of about so many trees, so many groups at the same time, each on fewer
# and larger parts. Trees do not depend on each other, but every level of a fit sends the counts of all its nodes from
# every part and ends on the driver; groups keep the cores busy meanwhile and send less in all.
TREES_TOGETHER = 25
GROUPS_SIDE_BY_SIDE = 8
GROUP_PART_ROWS = 250_000
# Tasks that the trees of a group are grown in.
GROUP_SHARES = 3
# Bytes of the codes of all rows that a task may hold while it grows trees.
TASK_CELLS = 256_000_000
# Seeds of groups lie apart, as every part adds its number to the seed.
GROUP_SEEDS = 1000
DOT, SAFE_DOT = ".", "\u2024"


@dataclass(frozen=True)
class Run:
    """One trained model with its figures on the test rows."""

    name: str
    model: PipelineModel
    metrics: dict[str, float | None]
    run_id: str
    settings: dict
    importance: dict[str, float] | None
    #: Scored test rows, stored; a run taken from the ledger has none.
    scored: DataFrame | None = None


def class_counts(df: DataFrame) -> dict[int, int]:
    """Rows per class; two classes, so two rows reach the driver."""
    rows = df.where(f"{TARGET} IN (0, 1)").groupBy(TARGET).count().collect()
    return {row[TARGET]: row["count"] for row in rows}


def balanced_weights(df: DataFrame, counts: Mapping[int, int] | None = None) -> DataFrame:
    """Add the row weight n / (classes · n_class), which gives every class the same total."""
    counts = counts or class_counts(df)
    total = sum(counts.values())
    cases = " ".join(
        f"WHEN {TARGET} = {c} THEN {total / (len(counts) * n)!r}D" for c, n in counts.items()
    )
    return df.withColumn(WEIGHT, F.expr(f"CASE {cases} END"))


def majority_class(df: DataFrame) -> int:
    """The most frequent class, the smaller one on a tie."""
    counts = class_counts(df)
    return min(counts, key=lambda c: (-counts[c], c))


def baseline_majority(train: DataFrame) -> PipelineModel:
    """A model that always predicts the most frequent class."""
    return majority_model(majority_class(train))


def majority_model(c: int) -> PipelineModel:
    statement = f"SELECT *, {float(c)}D AS prediction, {float(c)}D AS score FROM __THIS__"
    return PipelineModel([SQLTransformer(statement=statement)])


def estimator(settings: Mapping, rows: int, bins: int = BINS):
    """The MLlib estimator for one entry of :data:`~holdfast.config.MODELS`.

    ``bins`` is at least the number of values of the largest categorical input.
    """
    common = {"featuresCol": INPUTS, "labelCol": TARGET}
    if settings.get("balanced"):
        common["weightCol"] = WEIGHT
    if settings["kind"] == "logistic":
        # The usual unit penalty on the summed loss is 1/n on MLlib's mean loss.
        return LogisticRegression(
            maxIter=settings["iterations"], regParam=1.0 / max(rows, 1), standardization=False,
            **common,
        )
    trees = {
        "maxDepth": settings["depth"],
        "seed": MODEL_SEED,
        "maxMemoryInMB": TREE_MEMORY_MB,
        "checkpointInterval": CHECKPOINT_ROUNDS,
    }
    if settings["kind"] == "forest":
        # A node of at least min_split rows may be split; MLlib bounds the children instead.
        leaf = max(settings.get("min_split", 2) // 2, 1)
        # The node a row has reached in each tree is kept with the row. Otherwise every level walks every row
        # through all trees from their roots, which takes most of the time of deep ones.
        return RandomForestClassifier(
            numTrees=settings["trees"], minInstancesPerNode=leaf, maxBins=bins, cacheNodeIds=True, **common, **trees,
        )
    if settings["kind"] == "boosting":
        return GBTClassifier(
            maxIter=settings["rounds"],
            stepSize=settings["rate"],
            subsamplingRate=settings.get("row_share", 1.0),
            featureSubsetStrategy=str(settings.get("column_share", "all")),
            maxBins=bins,
            **common,
            **trees,
        )
    raise ValueError(f"unknown kind of model: {settings['kind']}")


def fit_parts(rows: int, most: int = FIT_ROWS) -> int:
    """Parts in which the first ``most`` of ``rows`` rows are fitted on."""
    return max(1, -(-min(rows, most) // PART_ROWS))


def _more_parts(rows: int) -> int:
    """Parts for the rows beyond ``FIT_ROWS``."""
    return -(-max(rows - FIT_ROWS, 0) // GROUP_PART_ROWS)


def whole_parts(rows: int) -> int:
    """Parts in which all of ``rows`` rows are fitted on, unless the caller has a number of its own."""
    return fit_parts(rows) + _more_parts(rows)


def fit_rows(df: DataFrame, rows: int, most: int | None = None, parts: int | None = None) -> DataFrame:
    """The rows to fit on, all of them, in an order and in parts that follow from their ids and their number alone.

    Without ids a hash of the row stands for one. ``rows`` is their number. No model is fitted on less; a caller that
    wants about ``most`` rows, each class in proportion, has to say so.
    """
    own = ID if ID in df.columns else f"xxhash64({', '.join(map(quoted, df.columns))})"
    keyed = df.withColumn("_place", F.expr(f"xxhash64({MODEL_SEED}, {own})"))
    if most is not None and rows > most:
        keyed = keyed.where(f"pmod(_place, {rows}) < {most}")
        parts = parts or fit_parts(rows, most)
    others = [quoted(c) for c, kind in df.dtypes if kind != "vector"]
    return keyed.repartition(parts or whole_parts(rows), "_place").sortWithinPartitions("_place", *others).drop("_place")


def tree_groups(settings: Mapping, rows: int) -> list[int]:
    """Trees of each group a forest is fitted in; one group where one part holds all rows, or parts are set."""
    trees = settings["trees"]
    groups = 1 if settings.get("parts") or fit_parts(rows) == 1 else -(-trees // TREES_TOGETHER)
    return [trees // groups + (i < trees % groups) for i in range(groups)]


def group_parts(rows: int) -> int:
    """Parts in which a group of trees is fitted on the first ``FIT_ROWS`` of ``rows`` rows; never all rows in one."""
    return max(2, -(-min(rows, FIT_ROWS) // GROUP_PART_ROWS))


def fit_grouped(settings: Mapping, rows: DataFrame, total: int, bins: int = BINS) -> ForestModel | RandomForestClassificationModel:
    """Fit a forest on stored vectors in several groups of trees side by side, each on all rows.

    Where the codes of all rows fit into a task, its groups of trees are grown there. Beyond, MLlib fits each group.
    """
    metadata = rows.schema[INPUTS].metadata
    first = rows.select(F.size(vector_to_array(INPUTS))).first()
    category = forests.categories(metadata, first[0])
    if total * len(category) * (1 if bins <= 256 else 2) <= TASK_CELLS:
        return grown_forest(settings, rows, total, category, bins)
    groups = tree_groups(settings, total)
    parts = group_parts(total) + _more_parts(total)

    def one(i: int) -> RandomForestClassificationModel:
        forest = estimator({**settings, "trees": groups[i]}, total, bins).setSeed(MODEL_SEED + GROUP_SEEDS * i)
        return forest.fit(fit_rows(rows, total, parts=parts))

    with ThreadPoolExecutor(GROUPS_SIDE_BY_SIDE) as pool:
        fitted = list(pool.map(inheritable_thread_target(rows.sparkSession)(one), range(len(groups))))
    return joined_forest(estimator(settings, total, bins), fitted)


def grown_forest(settings: Mapping, rows: DataFrame, total: int, category: Sequence[bool], bins: int) -> ForestModel:
    """A forest whose groups of trees are each grown in one task, which holds the codes of all rows."""
    spark = rows.sparkSession
    own = [ID] if ID in rows.columns else []
    limits = forests.bounds(rows, INPUTS, category, total, bins)
    weights = [F.max(F.when(F.col(TARGET) == c, F.col(WEIGHT) if WEIGHT in rows.columns else F.lit(1.0))) for c in (0, 1)]
    by_class = tuple(w if w is not None else 1.0 for w in rows.agg(*weights).first())
    codes = materialise(forests.coded(rows, INPUTS, own, TARGET, limits, category, bins), "codes")
    groups, folder = tree_groups(settings, total), new_path(spark, "forest")
    parts = group_parts(total) + _more_parts(total)

    shares = []
    for i, n in enumerate(groups):
        # In shares, as a few long tasks would leave cores idle at the end.
        ordered, cut = fit_rows(codes, total, parts=parts), [n * k // GROUP_SHARES for k in range(GROUP_SHARES + 1)]
        shares += [(ordered, range(sum(groups[:i]) + a, sum(groups[:i]) + b)) for a, b in zip(cut, cut[1:]) if a < b]

    def one(share: tuple[DataFrame, range]) -> str:
        ordered, numbers = share
        path = f"{folder}/trees={numbers.start}"
        forests.grown(
            ordered, TARGET, total, numbers, by_class, category, bins, settings["depth"],
            max(settings.get("min_split", 2) // 2, 1), forests.inputs_drawn(len(category)), MODEL_SEED,
        ).write.parquet(path)
        return path

    with ThreadPoolExecutor(GROUPS_SIDE_BY_SIDE) as pool:
        paths = list(pool.map(inheritable_thread_target(spark)(one), shares))
    table = spark.read.schema(forests.TREES).parquet(*paths)
    return ForestModel(
        numTrees=settings["trees"], featuresCol=INPUTS, bins=bins, limits=limits, category=list(category)
    ).over(table)


def joined_forest(
    whole: RandomForestClassifier, forests: Sequence[RandomForestClassificationModel]
) -> RandomForestClassificationModel:
    """One forest of the trees of all, in their order, with the settings of ``whole``."""
    context = SparkContext.getOrCreate()
    package = context._jvm.org.apache.spark.ml.classification
    trees = [tree for forest in forests for tree in forest._java_obj.trees()]
    array = context._gateway.new_array(package.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    first = forests[0]
    model = package.RandomForestClassificationModel(whole.uid, array, first.numFeatures, first.numClasses)
    joined = whole._copyValues(RandomForestClassificationModel(model))
    joined._transfer_params_to_java()
    return joined


def _safe(name: str) -> str:
    """MLlib reads a dot in a name as a field of a structure."""
    return name.replace(DOT, SAFE_DOT)


def _without_dots(names: Sequence[str]) -> list[SQLTransformer]:
    dotted = [f"{quoted(c)} AS {quoted(_safe(c))}" for c in names if DOT in c]
    return [SQLTransformer(statement=f"SELECT *, {', '.join(dotted)} FROM __THIS__")] if dotted else []


@dataclass(frozen=True)
class Vectors:
    """Training rows with their inputs as one vector, stored once for all models; and how to make the vector."""

    rows: DataFrame
    counts: dict[int, int]
    stages: list
    fingerprint: str


def vector_table(train: DataFrame) -> Vectors:
    """All labelled rows as ``id, target, inputs``, written to a table.

    The fingerprint tells whether two tables hold the same rows.
    """
    counts = class_counts(train)
    total = sum(counts.values())
    inputs = feature_names(train)
    stages = [*_without_dots(inputs), VectorAssembler(inputCols=[_safe(c) for c in inputs], outputCol=INPUTS)]
    own = [ID] if ID in train.columns else []
    rows = fit_rows(train.where(f"{TARGET} IS NOT NULL").select(*own, TARGET, *[quoted(c) for c in inputs]), total)
    for stage in stages:
        rows = stage.transform(rows)
    stored = materialise(rows.select(*own, TARGET, INPUTS), "vectors")
    content = F.xxhash64(*own, TARGET, vector_to_array(INPUTS)).cast("decimal(20,0)")
    n, checksum = stored.agg(F.count(F.lit(1)), F.sum(content)).first()
    return Vectors(stored, counts, stages, f"{n}:{checksum}:{','.join(inputs)}")


def fit_vectors(settings: Mapping, vectors: Vectors) -> PipelineModel:
    """Fit one entry of the model table on the stored vectors."""
    counts, total = vectors.counts, sum(vectors.counts.values())
    if settings["kind"] == "majority":
        return majority_model(min(counts, key=lambda c: (-counts[c], c)))
    rows = balanced_weights(vectors.rows, counts) if settings.get("balanced") else vectors.rows
    if settings["kind"] == "forest" and len(tree_groups(settings, total)) > 1:
        return PipelineModel([*vectors.stages, fit_grouped(settings, rows, total)])
    # Order and parts of the table do not outlive storing.
    ordered = fit_rows(rows, total, parts=settings.get("parts"))
    return PipelineModel([*vectors.stages, estimator(settings, total).fit(ordered)])


def fit_model(settings: Mapping, train: DataFrame) -> PipelineModel:
    """Fit one entry of the model table on the training rows."""
    if settings["kind"] == "majority":
        return baseline_majority(train)
    return fit_vectors(settings, vector_table(train))


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str] = (ID,)) -> DataFrame:
    """``keep…, prediction, score``: predicted class and probability of dropping out."""
    scored = model.transform(df)
    if "score" not in scored.columns:
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    return scored.select(*keep, F.col("prediction").cast("int").alias("prediction"), "score")


def predictions(model: PipelineModel, name: str, test: DataFrame) -> DataFrame:
    """Test rows with label and prediction, as the metrics expect them."""
    return predict(model, test, [ID, TARGET]).select(
        F.lit(name).alias("model"), ID, F.col(TARGET).alias("label"), "prediction", "score"
    )


def feature_importance(model: PipelineModel) -> dict[str, float] | None:
    """Importance per input column: of the trees, or the size of the coefficient."""
    fitted = model.stages[-1]
    assemblers = [s for s in model.stages if isinstance(s, VectorAssembler)]
    if hasattr(fitted, "featureImportances"):
        values = fitted.featureImportances.toArray()
    elif hasattr(fitted, "coefficients"):
        values = abs(fitted.coefficients.toArray())
    else:
        return None
    names = [c.replace(SAFE_DOT, DOT) for c in assemblers[0].getInputCols()]
    return {c: round(float(v), 6) for c, v in zip(names, values)}


def importance_table(spark: SparkSession, runs: Sequence[Run]) -> DataFrame:
    """``model, feature, importance`` of the runs that have one."""
    rows = [
        (run.name, feature, value)
        for run in runs for feature, value in (run.importance or {}).items()
    ]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def train_single(
    name: str, train: DataFrame, test: DataFrame, settings: Mapping | None = None, vectors: Vectors | None = None
) -> Run:
    """Fit one model, time it and measure it on the test rows, which are scored once and stored."""
    settings = dict(settings or MODELS[name])
    started = time.time()
    model = fit_vectors(settings, vectors) if vectors else fit_model(settings, train)
    train_time = round(time.time() - started, 3)
    started = time.time()
    scored = materialise(predictions(model, name, test), "scored")
    measured = classification_metrics(scored).first()
    metrics = {m: measured[m] for m in METRICS}
    metrics["train_time_s"] = train_time
    metrics["inference_time_ms"] = round((time.time() - started) * 1000, 3)
    return Run(
        name, model, metrics, f"{name}-{uuid.uuid4().hex}", settings, feature_importance(model), scored
    )


def recorded_run(
    ledger: Ledger, name: str, train: DataFrame, test: DataFrame, settings: Mapping, vectors: Vectors
) -> Run:
    """The run that the ledger has for these rows and settings, or else a new one, recorded once its model is stored."""
    wanted = json.loads(json.dumps({"settings": dict(settings), "input": vectors.fingerprint}))
    entry = ledger.get(name)
    if entry and {k: entry.get(k) for k in wanted} == wanted:
        log.info("%s was trained before", name)
        model = PipelineModel.load(entry["model_uri"])
        return Run(name, model, entry["metrics"], entry["run_id"], entry["settings"], entry["importance"])
    run = train_single(name, train, test, settings, vectors)
    uri = f"{ledger.folder}/models/{run.run_id}"
    run.model.write().save(uri)
    total = sum(vectors.counts.values())
    ledger.put(name, {
        **wanted, "run_id": run.run_id, "model_uri": uri, "metrics": run.metrics, "importance": run.importance,
        "class_counts": {str(c): n for c, n in vectors.counts.items()}, "parts": settings.get("parts") or whole_parts(total),
        "inputs": feature_names(train), "trained_at": time.time(),
    })
    return run


def train_all(
    train: DataFrame, test: DataFrame, models: Mapping[str, Mapping] = MODELS, strict: bool = True,
    folder: str | None = None, side_by_side: int = SIDE_BY_SIDE,
) -> list[Run]:
    """Train every model of the table, several at a time, from one stored table of vectors.

    With a ``folder`` each finished model is recorded there, so that a run that broke off goes on with the models
    that are missing. All are tried; then a failed one is an error, as the ranking would otherwise choose from an
    incomplete list. Without ``strict`` it is logged and left out, which :func:`run_states` shows.
    """
    spark = train.sparkSession
    vectors = vector_table(train)
    ledger = Ledger(spark, folder) if folder else None

    def one(item: tuple[str, Mapping]) -> Run | Exception:
        name, settings = item
        try:
            if ledger:
                return recorded_run(ledger, name, train, test, settings, vectors)
            return train_single(name, train, test, settings, vectors)
        except Exception as error:
            log.exception("training of %s failed", name)
            return error

    with ThreadPoolExecutor(side_by_side) as pool:
        results = list(pool.map(inheritable_thread_target(spark)(one), models.items()))
    failed = {name: error for name, error in zip(models, results) if isinstance(error, Exception)}
    if failed and strict:
        raise RuntimeError(f"training failed: {', '.join(failed)}") from next(iter(failed.values()))
    return [run for run in results if isinstance(run, Run)]


def run_states(
    spark: SparkSession, runs: Sequence[Run], models: Mapping[str, Mapping] = MODELS
) -> DataFrame:
    """``model, status`` for every configured model."""
    done = {run.name for run in runs}
    rows = [(name, "trained" if name in done else "failed") for name in models]
    return spark.createDataFrame(rows, "model string, status string")


def runs_table(spark: SparkSession, runs: Sequence[Run]) -> DataFrame:
    """One row per run, as the comparison expects them."""
    schema = T.StructType([
        T.StructField(c, T.StringType() if c in ("model", "run_id") else T.DoubleType())
        for c in RUN_COLUMNS
    ])
    rows = [
        (run.name, *[run.metrics.get(c) for c in RUN_COLUMNS[1:-1]], run.run_id) for run in runs
    ]
    return spark.createDataFrame(rows, schema)


# The served model works on raw columns, so that a request needs no fitted features.

SERVED_NUMERIC = NUMERIC_COLUMNS
SERVED_TEXT = (*CATEGORICAL_COLUMNS, *BINARY_COLUMNS)
SERVED = MODELS["random_forest_v2"]


def train_raw_balanced(train: DataFrame, settings: Mapping = SERVED) -> PipelineModel:
    """Random forest on raw columns: text as codes, missing numbers as medians, no target input.

    ``train`` holds numbers for the numeric columns, text for all others and a 0/1 target.
    """
    numbers = [c for c in SERVED_NUMERIC if c in train.columns]
    texts = [c for c in SERVED_TEXT if c in train.columns]
    if TARGET in (*numbers, *texts):
        raise ValueError("the target must not be an input")
    codes = [f"{c}_code" for c in texts]
    filled = [f"{c}_filled" for c in numbers]
    counts = class_counts(train)
    total = sum(counts.values())
    labels = fit_dictionary(train, texts)
    stages = [
        Imputer(strategy="median", inputCols=numbers, outputCols=filled),
        StringIndexerModel.from_arrays_of_labels(
            [list(labels.values[c]) for c in texts], texts, codes, "keep"
        ),
        VectorAssembler(inputCols=[*filled, *codes], outputCol=INPUTS),
    ]
    # A code for each known value, and one for all others.
    bins = max([BINS, *[len(v) + 1 for v in labels.values.values()]])
    rows = balanced_weights(train.where(f"{TARGET} IS NOT NULL"), counts)
    own = [ID] if ID in train.columns else []
    ordered = fit_rows(rows.select(*own, TARGET, WEIGHT, *numbers, *texts), total)
    if len(tree_groups(settings, total)) == 1:
        return Pipeline(stages=[*stages, estimator(settings, total, bins)]).fit(ordered)
    prepared = Pipeline(stages=stages).fit(ordered)
    vectors = prepared.transform(rows.select(*own, TARGET, WEIGHT, *numbers, *texts)).select(*own, TARGET, WEIGHT, INPUTS)
    stored = materialise(vectors.withMetadata(INPUTS, _named_values(vectors.schema[INPUTS].metadata)), "served_vectors")
    return PipelineModel([*prepared.stages, fit_grouped(settings, stored, total, bins)])


def _named_values(metadata: dict) -> dict:
    """PySpark fills up lists of labels to one length with nulls, and no table with these in its schema can be written."""
    for column in metadata["ml_attr"]["attrs"].get("nominal", []):
        # Longer than any label, so none is named twice.
        filler = "_" * max(len(value or "") for value in column["vals"])
        column["vals"] = [f"{filler}_{i}" if value is None else value for i, value in enumerate(column["vals"])]
    return metadata


def served_inputs(model: PipelineModel) -> dict[str, str]:
    """Raw columns the served model reads, with their type."""
    numbers = next(s for s in model.stages if s.hasParam("inputCols") and s.hasParam("missingValue"))
    texts = next(s for s in model.stages if s.hasParam("stringOrderType"))
    return {
        **{c: "double" for c in numbers.getInputCols()},
        **{c: "string" for c in texts.getInputCols()},
    }
