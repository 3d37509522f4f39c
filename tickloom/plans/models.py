"""Model fitting and scoring on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.combine import few_values
from tickloom.operators.ranks import exact_quantiles
from tickloom.operators.splits import chronological_split, split_ranges
from tickloom.plans import evaluation
from tickloom.plans.dataset import BUCKET_FEATURES, feature_columns
from tickloom.session import cut_lineage


class _WinsorParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to clip", TypeConverters.toListString)
    lowerBounds = Param(Params._dummy(), "lowerBounds", "lower bounds", TypeConverters.toListFloat)
    upperBounds = Param(Params._dummy(), "upperBounds", "upper bounds", TypeConverters.toListFloat)


class WinsorModel(Model, _WinsorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Clips each column to its fitted bounds; nulls stay null."""

    def _transform(self, df: DataFrame) -> DataFrame:
        bounds = zip(self.getOrDefault("inputCols"), self.getOrDefault("lowerBounds"), self.getOrDefault("upperBounds"))
        clipped = {
            c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))).alias(c) for c, lo, hi in bounds
        }
        return df.select(*[clipped.get(c, F.col(c)) for c in df.columns])


class Winsorizer(Estimator, _WinsorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits quantile bounds per column, ignoring NaN.

    `exact=False` takes the bounds from Spark's quantile sketch in one pass over all columns.
    """

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = (), lower: float = 0.005, upper: float = 0.995, exact: bool = False):
        super().__init__()
        self.quantiles, self.exact = [lower, upper], exact
        self._set(inputCols=list(inputCols))

    def _fit(self, df: DataFrame) -> WinsorModel:
        cols = self.getOrDefault("inputCols")
        if self.exact:
            bounds = [exact_quantiles(df, c, self.quantiles) for c in cols]
        else:
            clean = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
            bounds = clean.approxQuantile(list(cols), self.quantiles, 1e-4)
        lows = [float(b[0]) if b and b[0] is not None else float("-inf") for b in bounds]
        highs = [float(b[1]) if b and b[1] is not None else float("inf") for b in bounds]
        return WinsorModel()._set(inputCols=list(cols), lowerBounds=lows, upperBounds=highs)


class FillMode(Estimator, _WinsorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Most frequent value of each text column, for its nulls."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = ()):
        super().__init__()
        self._set(inputCols=list(inputCols))

    def _fit(self, df: DataFrame) -> FillModeModel:
        cols = self.getOrDefault("inputCols")
        row = df.agg(*[F.mode(c).alias(c) for c in cols]).first()
        return FillModeModel(inputCols=list(cols), fills=[str(row[c]) if row[c] is not None else "missing" for c in cols])


class FillModeModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    inputCols = Param(Params._dummy(), "inputCols", "columns to fill", TypeConverters.toListString)
    fills = Param(Params._dummy(), "fills", "value per column", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] = (), fills: Sequence[str] = ()):
        super().__init__()
        self._set(inputCols=list(inputCols), fills=list(fills))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.fillna(dict(zip(self.getOrDefault("inputCols"), self.getOrDefault("fills"))))


@dataclass
class ModelSpec:
    """One model: its kind, task and settings."""

    kind: str
    task: str
    params: dict = field(default_factory=dict)
    scaled: bool = False


# The baseline models and their settings.
BASELINES = {
    "linear_regression": ModelSpec("linear", "regression", {}, True),
    "ridge_regression": ModelSpec("linear", "regression", {"regParam": 1.0, "elasticNetParam": 0.0}, True),
    "logistic_regression": ModelSpec("logistic", "classification", {"maxIter": 1000}, True),
    "sgd_logistic_classifier": ModelSpec("logistic", "classification", {"maxIter": 1000, "regParam": 0.0001}, True),
    "gaussian_nb_classifier": ModelSpec("gaussian_nb", "classification", {}, True),
    "random_forest_classifier": ModelSpec("forest", "classification", {"numTrees": 100, "maxDepth": 8, "minInstancesPerNode": 50}),
    "random_forest_regressor": ModelSpec("forest", "regression", {"numTrees": 100, "maxDepth": 8, "minInstancesPerNode": 50}),
    "boosted_classifier": ModelSpec("boosted", "classification", {"maxIter": 300, "stepSize": 0.03, "maxDepth": 4}),
    "boosted_regressor": ModelSpec("boosted", "regression", {"maxIter": 300, "stepSize": 0.03, "maxDepth": 4}),
}


def is_categorical(name: str, kind: T.DataType) -> bool:
    return name in BUCKET_FEATURES or isinstance(kind, T.StringType)


def preprocessing(
    schema: T.StructType, features: Sequence[str], scaled: bool, winsor: tuple[float, float] | None = None
) -> list:
    """Stages that turn the features into the vector `features`.

    Numbers: median for nulls, optional clipping, optional standardising. Categories: most
    frequent value for nulls, one-hot with unseen values ignored.
    """
    kinds = {f.name: f.dataType for f in schema}
    texts = [c for c in features if is_categorical(c, kinds[c])]
    numbers = [c for c in features if c not in texts]
    stages: list = []
    inputs = []
    if numbers:
        filled = [f"__n_{c}" for c in numbers]
        stages.append(Imputer(strategy="median", inputCols=numbers, outputCols=filled))
        if winsor:
            stages.append(Winsorizer(inputCols=filled, lower=winsor[0], upper=winsor[1]))
        stages.append(VectorAssembler(inputCols=filled, outputCol="__numbers", handleInvalid="keep"))
        if scaled:
            stages.append(StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True))
        inputs.append("__scaled" if scaled else "__numbers")
    if texts:
        indexed, hot = [f"__i_{c}" for c in texts], [f"__h_{c}" for c in texts]
        stages.append(FillMode(inputCols=texts))
        stages.append(StringIndexer(inputCols=texts, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="keep", dropLast=True))
        inputs += hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return stages


def estimator(spec: ModelSpec, seed: int, weight: str | None):
    """The learner of a spec, reading `features` and `label`."""
    common = {"featuresCol": "features", "labelCol": "label", **({"weightCol": weight} if weight else {}), **spec.params}
    classify = spec.task == "classification"
    if spec.kind == "linear":
        return LinearRegression(**common)
    if spec.kind == "logistic":
        return LogisticRegression(**common)
    if spec.kind == "gaussian_nb":
        return NaiveBayes(modelType="gaussian", **common)
    if spec.kind == "forest":
        return (RandomForestClassifier if classify else RandomForestRegressor)(seed=seed, **common)
    if spec.kind == "boosted":
        return PerClassBoosting(seed=seed, **common) if classify else GBTRegressor(seed=seed, **common)
    raise ValueError(f"unknown model kind {spec.kind!r}")


def balanced_weights(df: DataFrame, label: str, name: str = "class_weight") -> DataFrame:
    """`rows / (classes * rows of the class)` per row; classes are few, so the counts are literals."""
    counts = {r[label]: r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == F.lit(value), F.lit(total / (len(counts) * n))).otherwise(weight)
    return df.withColumn(name, weight)


class PerClassModel(Model):
    """Boosted models of one class against the rest; probabilities are scaled to a sum of one."""

    def __init__(self, models: Sequence[Model]):
        super().__init__()
        self.models = list(models)

    @property
    def featureImportances(self):
        total = sum(m.featureImportances.toArray() for m in self.models)
        return Vectors.dense(total / (total.sum() or 1.0))

    def _transform(self, df: DataFrame) -> DataFrame:
        for i, model in enumerate(self.models):
            scored = model.setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__g").transform(df)
            df = scored.withColumn(f"__p{i}", vector_to_array("__p")[1]).drop("__p", "__r", "__g")
        each = [F.col(f"__p{i}") for i in range(len(self.models))]
        total = F.greatest(reduce(lambda a, b: a + b, each), F.lit(1e-300))
        chances = F.array(*[p / total for p in each]) if len(each) > 1 else F.array(F.lit(1.0) - each[0], each[0])
        best = (F.array_position(chances, F.array_max(chances)) - 1).cast("double")
        out = df.withColumn("__chances", chances).withColumns({"probability": array_to_vector("__chances"), "prediction": best})
        return out.drop("__chances", *[f"__p{i}" for i in range(len(self.models))])


class PerClassBoosting(Estimator):
    """Gradient-boosted trees for any number of classes 0, 1, ...: one model for two, else one for each class."""

    def __init__(self, **settings):
        super().__init__()
        self.settings = settings

    def _fit(self, df: DataFrame) -> PerClassModel:
        label = self.settings.get("labelCol", "label")
        last = int(df.agg(F.max(label)).first()[0] or 0)
        targets = [1] if last <= 1 else range(last + 1)
        rows = df.persist()
        models = [GBTClassifier(**self.settings).fit(rows.withColumn(label, (F.col(label) == F.lit(float(k))).cast("double"))) for k in targets]
        rows.unpersist()
        return PerClassModel(models)


@dataclass
class Fitted:
    """A fitted pipeline with what is needed to score and explain it."""

    name: str
    task: str
    target: str
    model: PipelineModel
    features: list[str]
    classes: list = field(default_factory=list)

    @property
    def positive_index(self) -> int:
        return self.classes.index(evaluation.positive_class(self.classes))


def _as_text(df: DataFrame, features: Sequence[str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*[F.col(c).cast("string").alias(c) if c in features and is_categorical(c, kinds[c]) else F.col(c) for c in df.columns])


def fit_model(
    train: DataFrame,
    target: str,
    spec: ModelSpec,
    name: str = "model",
    features: Sequence[str] | None = None,
    seed: int = 42,
    weight: str | None = None,
    winsor: tuple[float, float] | None = None,
    balanced: bool = True,
) -> Fitted:
    """Fit one model; rows without target are dropped."""
    names = list(features or feature_columns(train.schema))
    rows = _as_text(train.where(F.col(target).isNotNull()), names)
    classes: list = []
    stages = preprocessing(rows.schema, names, spec.scaled, winsor)
    if spec.task == "classification":
        classes = sorted(few_values(rows, target, 1000))
        label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target)).cast("double") - 1.0
        if weight is None and balanced and spec.kind == "logistic":
            rows, weight = balanced_weights(rows, target), "class_weight"
    else:
        label = F.col(target).cast("double")
    needed = [*names, *([weight] if weight else [])]
    fitted = Pipeline(stages=[*stages, estimator(spec, seed, weight)]).fit(rows.select(*needed, label.alias("label")))
    return Fitted(name, spec.task, target, fitted, names, classes)


def score(df: DataFrame, model: Fitted, output: str) -> DataFrame:
    """`output` holds the positive-class probability, or the prediction of a regression."""
    scored = model.model.transform(_as_text(df, model.features)).select(
        *df.columns, F.col("prediction").alias("__prediction"), *(["probability"] if model.task == "classification" else [])
    )
    if model.task == "regression":
        return scored.withColumn(output, F.col("__prediction")).drop("__prediction")
    value = vector_to_array("probability")[model.positive_index]
    return scored.withColumn(output, value).drop("probability", "__prediction")


def predict_class(df: DataFrame, model: Fitted, output: str = "prediction_class") -> DataFrame:
    """The predicted class in its original value, and its probability as confidence."""
    scored = model.model.transform(_as_text(df, model.features))
    values = F.array(*[F.lit(c) for c in model.classes])
    confidence = F.array_max(vector_to_array("probability"))
    return scored.select(*df.columns, F.get(values, F.col("prediction").cast("int")).alias(output), confidence.alias("prediction_confidence"))


def feature_importance(model: Fitted, df: DataFrame) -> DataFrame:
    """(feature, importance), largest first: tree importances or mean absolute coefficients."""
    learner = model.model.stages[-1]
    spark = df.sparkSession
    if hasattr(learner, "featureImportances"):
        values = learner.featureImportances.toArray().tolist()
    elif hasattr(learner, "coefficientMatrix"):
        values = abs(learner.coefficientMatrix.toArray()).mean(axis=0).tolist()
    elif hasattr(learner, "coefficients"):
        values = abs(learner.coefficients.toArray()).tolist()
    else:
        return spark.createDataFrame([], "feature string, importance double")
    schema = model.model.transform(_as_text(df, model.features).limit(1)).schema["features"].metadata.get("ml_attr", {})
    names = {a["idx"]: a.get("name", str(a["idx"])) for group in schema.get("attrs", {}).values() for a in group}
    rows = [(names.get(i, f"feature_{i}").removeprefix("__n_").removeprefix("__h_"), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def train_baselines(
    df: DataFrame, target_reg: str = "y_reg_10s", target_cls: str = "y_cls_10s", models: Sequence[str] = ("logistic_regression",),
    purge_ms: int = 0, embargo_ms: int = 0, seed: int = 42, weight: str | None = None, winsor: tuple[float, float] | None = None,
) -> tuple[dict[str, Fitted], DataFrame, DataFrame]:
    """Fit the named baselines on the training split; returns models, split rows and split ranges."""
    rows = cut_lineage(chronological_split(df, purge_ms=purge_ms, embargo_ms=embargo_ms), "split-rows")  # read once for each fit
    train = rows.where("split = 'train'")
    fitted = {}
    for name in models:
        spec = BASELINES[name]
        target = target_reg if spec.task == "regression" else target_cls
        fitted[name] = fit_model(train, target, spec, name, feature_columns(df.schema), seed, weight, winsor)
    return fitted, rows, split_ranges(rows)


def evaluate_models(
    test: DataFrame, models: dict[str, Fitted], target_reg: str = "y_reg_10s", target_cls: str = "y_cls_10s"
) -> DataFrame:
    """One row per model with its metrics on `test`."""
    out = None
    for name, model in models.items():
        if model.task == "regression":
            scored = score(test, model, "prediction")
            one = evaluation.regression_metrics(scored, target_reg, "prediction").select(
                F.lit(name).alias("model"), F.lit(model.task).alias("task"), "mae", "rmse",
                *[F.lit(None).cast("double").alias(c) for c in ("precision_macro", "recall_macro", "f1_macro")],
            )
        else:
            one = evaluation.macro_scores(predict_class(test, model), target_cls, "prediction_class").select(
                F.lit(name).alias("model"), F.lit(model.task).alias("task"), *[F.lit(None).cast("double").alias(c) for c in ("mae", "rmse")],
                "precision_macro", "recall_macro", "f1_macro",
            )
        out = one if out is None else out.unionByName(one)
    return out


