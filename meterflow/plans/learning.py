"""Tree regressions with Spark ML: one pooled model over all entities, whose index is a feature, or one for each of a few; scoring and
persistence."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.operators import windows
from meterflow.operators.upsert import exists
from meterflow.plans import forecast
from meterflow.sources.sinks import scratch_folder

# Sizes of the two ensembles and the least rows of a series.
FOREST = {"numTrees": 30, "maxDepth": 6, "minInstancesPerNode": 2, "seed": 42}
BOOSTED = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42}
LEAST_TRAIN, LEAST_TEST = 100, 24


def pipeline(features: list[str], label: str, entity: str = "equipment_id", kind: str = "forest", **changes) -> Pipeline:
    """Entity index, feature vector and regression. Entities past the bins of a tree are told apart by their other features."""
    index = StringIndexer(inputCol=entity, outputCol="entity_index", handleInvalid="keep")
    vector = VectorAssembler(inputCols=[*features, "entity_index"], outputCol="features")
    made = RandomForestRegressor(**(FOREST | changes)) if kind == "forest" else GBTRegressor(**(BOOSTED | changes))
    return Pipeline(stages=[index, vector, made.setLabelCol(label).setFeaturesCol("features").setPredictionCol("raw_prediction").setMaxBins(128)])


def split(df: DataFrame, keys: list[str], ts: str, least_train: int = LEAST_TRAIN, least_test: int = LEAST_TEST) -> DataFrame:
    return windows.chronological_split(df, keys, [ts], 0.8, least_train, least_test)


def random_split(df: DataFrame, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows at random for training and for the test, where their order in time does not matter."""
    train, test = df.randomSplit([share, 1 - share], seed)
    return train, test


def predict(model: PipelineModel, df: DataFrame, name: str = "prediction") -> DataFrame:
    """Predictions, not below 0."""
    return model.transform(df).withColumn(name, F.greatest("raw_prediction", F.lit(0.0))).drop("raw_prediction", "features", "entity_index")


def train_and_evaluate(df: DataFrame, features: list[str], label: str, keys: list[str], ts: str, kind: str = "forest", **changes) -> tuple[PipelineModel, DataFrame]:
    """The model of the first 80 % of each series, and its metrics on the rest by entity."""
    marked = split(df, keys, ts)
    model = pipeline(features, label, keys[-1], kind, **changes).fit(marked.filter("is_train"))
    return model, forecast.evaluate(predict(model, marked.filter("NOT is_train")), keys, label, "prediction")


#: Models that are trained one by one at most, and how many of them at a time.
MOST_MODELS, AT_ONCE = 500, 4


class ByEntity:
    """Rows that are stored once, a folder for each entity, so that an entity's job reads its own files and no other."""

    def __init__(self, rows: DataFrame, key: str, folder: str):
        self.spark, self.key, self.folder, self.schema = rows.sparkSession, key, folder, rows.schema
        rows.repartition(key).write.mode("overwrite").partitionBy(key).parquet(folder)
        found = [r[key] for r in self.all().select(key).distinct().orderBy(key).limit(MOST_MODELS + 1).collect()]
        if len(found) > MOST_MODELS:
            raise ValueError(f"more than {MOST_MODELS} entities: use the pooled model")
        self.entities = found

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def of(self, entity) -> DataFrame:
        return self.all().filter(F.col(self.key).eqNullSafe(F.lit(entity)))

    def each(self, work) -> dict:
        """work(entity, its rows) for all entities, some at a time, each in a scheduler pool of its own if the session shares fairly."""

        def one(entity):
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"model-{entity}")
            return work(entity, self.of(entity))

        with ThreadPool(AT_ONCE) as pool:
            return dict(zip(self.entities, pool.map(inheritable_thread_target(self.spark)(one), self.entities)))


def train_each(df: DataFrame, features: list[str], label: str, key: str, ts: str, kind: str = "forest", store: str | None = None, **changes) -> tuple[dict, DataFrame]:
    """A model of its own for each entity's first 80 %, by entity, and all metrics on the rest; entities with too few rows have none.

    The rows are worked out once and stored by entity (in the folder store, or in the shared one); every model is a job of its own on its
    entity's files: right for a plant's units, not for millions of entities, which the pooled model is for.
    """
    marked = split(df, [key], ts).select(*dict.fromkeys([key, label, *features, "is_train"]))
    rows = ByEntity(marked, key, store or scratch_folder(df.sparkSession, "training"))
    models = rows.each(lambda _, own: pipeline(features, label, key, kind, **changes).fit(own.filter("is_train")))
    tested = [predict(model, rows.of(e).filter("NOT is_train")).select(key, label, "prediction") for e, model in models.items()]
    none = rows.all().limit(0).select(key, label, F.lit(0.0).alias("prediction"))
    return models, forecast.evaluate(reduce(DataFrame.unionByName, tested, none), [key], label, "prediction")


#: Rows of the registry of models.
REGISTRY = "entity string, version bigint, kind string, label string, features array<string>, path string, registered_at timestamp"


class ModelStore:
    """Models in a folder, with a registry that tells each entity's versions, features and path.

    A version shows when all its models are written, as their rows come last and together. An entity keeps its last version until a newer one
    has it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def registry(self) -> DataFrame:
        path = f"{self.root}/registry"
        return self.spark.read.schema(REGISTRY).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], REGISTRY)

    def current(self) -> DataFrame:
        """Each entity's latest row."""
        return windows.latest_per_key(self.registry(), ["entity"], ["version"])

    def publish(self, models: dict, features: list[str], label: str, kind: str) -> int:
        """Save models by entity as a new version; its number."""
        version = (self.registry().agg(F.max("version")).first()[0] or 0) + 1
        rows = []
        for i, (entity, model) in enumerate(models.items()):
            path = f"{self.root}/models/{version}/{i}"
            save(model, path)
            rows.append((entity, version, kind, label, features, path, datetime.now()))
        self.spark.createDataFrame(rows, REGISTRY).coalesce(1).write.mode("append").parquet(f"{self.root}/registry")
        return version

    def score(self, df: DataFrame, key: str, name: str = "prediction", store: str | None = None) -> DataFrame:
        """df's rows with their entity's current model's prediction and version; rows of entities without a model have NULLs."""
        known = {r["entity"]: r for r in self.current().collect()}  # at most MOST_MODELS for each version
        rows = ByEntity(df, key, store or scratch_folder(self.spark, "scoring"))
        out = []
        for entity in rows.entities:
            own = rows.of(entity)
            if entity in known:
                features = known[entity]["features"]
                own = predict(load(known[entity]["path"]), own.na.fill(0.0, features), name).withColumn("model_version", F.lit(known[entity]["version"]))
            else:
                own = own.withColumns({name: F.lit(None).cast("double"), "model_version": F.lit(None).cast("bigint")})
            out.append(own)
        none = rows.all().limit(0).withColumns({name: F.lit(None).cast("double"), "model_version": F.lit(None).cast("bigint")})
        return reduce(DataFrame.unionByName, out, none)


def run(mode: str, models: ModelStore, hours: DataFrame, label: str = "supply_kwh", key: str = "equipment_id", ts: str = "stat_hour", kind: str = "boosted", n: int = 24, **changes) -> tuple[DataFrame | None, DataFrame | None]:
    """(held-out metrics, forecast of the next n hours). Mode ``train`` trains and registers a model for each unit, ``predict`` scores by the
    registered ones, ``both`` does one after the other; what a mode does not make is None."""
    if mode not in ("train", "predict", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    features, metrics, ahead = forecast.features(hours), None, None
    if mode in ("train", "both"):
        rows = forecast.training_features(hours.filter(F.col(label).isNotNull()), label, ts)
        trained, metrics = train_each(rows, features, label, key, ts, kind, **changes)
        models.publish(trained, features, label, kind)
    if mode in ("predict", "both"):
        future = forecast.future_features(hours, n=n).na.fill(0.0, features)
        ahead = models.score(future, key)
    return metrics, ahead


def importances(model: PipelineModel, features: list[str], spark, most: int = 8) -> DataFrame:
    """The features that matter most, and all of that as JSON."""
    ranked = sorted(zip([*features, "entity_index"], model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: -x[1])[:most]
    rows = spark.createDataFrame(ranked, "feature string, importance double")
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("less"), "feature")))).alias("top_features"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
