"""Connections and models by name (U1, U2), and their calls from DataFrames and SQL.

A connection names an endpoint and the Spark setting that holds its secret; the secret is read on the
driver when a call is planned and is never part of a definition, a plan's text or a table. A model names its
connection, its task and a ``client``: a module-level function (endpoint, secret, options) that returns a function from a list of
inputs to a list of answers. A Python worker makes one client a model and keeps it for all its tasks.

``answered`` calls the model once per distinct input and keeps the answers in a table, keyed by the
SHA-256 of model, options and input: a job that is run again, and a stage that is computed again after an executor was
lost, reads them. Only a task that fails before its own answers are written asks again, at most ``rows_per_task`` inputs.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwall.session import scratch_path

TASKS = {"text_generation": "string", "embedding": "array<float>"}
ROWS_PER_TASK, BATCH = 2_000, 64


@dataclasses.dataclass(frozen=True)
class Connection:
    name: str
    endpoint: str
    secret_conf: str | None = None           # the setting that holds the secret

    def secret(self, spark: SparkSession) -> str | None:
        if self.secret_conf is None:
            return None
        value = spark.conf.get(self.secret_conf, None)
        if value is None:
            raise ValueError(f"connection {self.name}: {self.secret_conf} is not set")
        return value


@dataclasses.dataclass(frozen=True)
class Model:
    name: str
    connection: str
    task: str
    client: Callable[[str, str | None, dict], Callable[[list], list]]
    options: dict[str, Any] = dataclasses.field(default_factory=dict)

    def __post_init__(self):
        if self.task not in TASKS:
            raise ValueError(f"model {self.name}: the task is one of {sorted(TASKS)}")


class Registry:
    """Definitions by name. A name is taken once; ``replace`` is asked for, as in ``CREATE OR REPLACE``."""

    def __init__(self):
        self.connections: dict[str, Connection] = {}
        self.models: dict[str, Model] = {}

    def create_connection(self, connection: Connection, replace: bool = False) -> None:
        self._put(self.connections, connection, replace)

    def create_model(self, model: Model, replace: bool = False) -> None:
        if model.connection not in self.connections:
            raise KeyError(f"model {model.name}: no connection {model.connection}")
        self._put(self.models, model, replace)

    def drop_connection(self, name: str) -> None:
        users = sorted(m.name for m in self.models.values() if m.connection == name)
        if users:
            raise ValueError(f"connection {name} is used by {', '.join(users)}")
        del self.connections[name]

    def drop_model(self, name: str) -> None:
        del self.models[name]

    @staticmethod
    def _put(where: dict, it, replace: bool) -> None:
        if it.name in where and not replace:
            raise ValueError(f"{it.name} exists")
        where[it.name] = it

    def call(self, spark: SparkSession, name: str) -> Callable[[list], list]:
        """What workers run: inputs to answers, null for null; the client is made on first use in each worker."""
        if name not in self.models:
            raise KeyError(f"no model {name}")
        m = self.models[name]
        c = self.connections[m.connection]
        return _Call(m, c.endpoint, c.secret(spark))


_clients: dict[str, Callable[[list], list]] = {}


class _Call:
    def __init__(self, model: Model, endpoint: str, secret: str | None):
        self.model, self.endpoint, self.secret = model, endpoint, secret

    def __repr__(self) -> str:                # never the secret
        return f"call of {self.model.name}"

    def __call__(self, inputs: list) -> list:
        m = self.model
        key = json.dumps([m.name, m.client.__module__, m.client.__qualname__, self.endpoint, self.secret, m.options], sort_keys=True, default=str)
        if key not in _clients:
            _clients[key] = m.client(self.endpoint, self.secret, m.options)
        asked = [i for i, x in enumerate(inputs) if x is not None and x == x]
        out: list = [None] * len(inputs)
        for lo in range(0, len(asked), BATCH):
            some = asked[lo:lo + BATCH]
            answers = _clients[key]([inputs[i] for i in some])
            if len(answers) != len(some):
                raise ValueError(f"{m.name} gave {len(answers)} answers to {len(some)} inputs")
            for i, a in zip(some, answers):
                out[i] = a
        return out


def answers_path(spark: SparkSession, model: Model) -> str:
    return scratch_path(spark, "answers", model.name)


def answered(df: DataFrame, input_col: str, out_col: str, registry: Registry, name: str, rows_per_task: int = ROWS_PER_TASK,
             path: str | None = None) -> DataFrame:
    """``df`` with the model's answer to ``input_col``; rows with a null input or answer drop (inner lateral, as in SQL).

    Equal inputs are asked once. Answers of earlier runs, below ``path``, are taken as they are; it must not be
    written by two jobs at once."""
    spark = df.sparkSession
    call, model = registry.call(spark, name), registry.models[name]
    kind, path = TASKS[model.task], path or answers_path(spark, model)
    schema = f"_key string, _answer {kind}"
    salt = F.lit(json.dumps([model.name, registry.connections[model.connection].endpoint, model.options], sort_keys=True, default=str))
    keyed = df.withColumn("_key", F.sha2(F.concat_ws("\x00", salt, F.col(input_col)), 256)).where(F.col(input_col).isNotNull())
    spark.createDataFrame([], schema).write.mode("append").parquet(path)      # so that the folder is there to read
    have = spark.read.schema(schema).parquet(path)
    ask = keyed.select("_key", F.col(input_col).alias("_input")).dropDuplicates(["_key"]).join(have, "_key", "left_anti")
    n = ask.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_key": b["_key"], "_answer": pd.Series(call(b["_input"].tolist()), dtype=object, index=b.index)})

    if n:
        ask.repartition(max(1, -(-n // rows_per_task)), "_key").mapInPandas(run, schema).write.mode("append").parquet(path)
    said = spark.read.schema(schema).parquet(path).where("_answer is not null").dropDuplicates(["_key"])
    return keyed.join(said, "_key").select(*df.columns, F.col("_answer").alias(out_col))


def register_sql(spark: SparkSession, registry: Registry) -> None:
    """``ai_complete_by(model, prompt)`` and ``ml_predict_by(model, text)`` in SQL: the model is named in the query, as a literal or a
    column; the names are those that the registry holds now. An unknown name, or a model of the other task, fails."""
    calls = {name: (m.task, registry.call(spark, name)) for name, m in registry.models.items()}

    def function(task: str):
        def run(names: pd.Series, inputs: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(inputs), dtype=object)
            for name in names.dropna().unique():
                if calls.get(name, (None,))[0] != task:
                    raise KeyError(f"no {task} model {name}")
                at = (names == name).to_numpy().nonzero()[0]
                for i, a in zip(at, calls[name][1](inputs.iloc[at].tolist())):
                    out.iat[i] = a
            return out
        return F.pandas_udf(run, T._parse_datatype_string(TASKS[task])).asNondeterministic()

    spark.udf.register("ai_complete_by", function("text_generation"))
    spark.udf.register("ml_predict_by", function("embedding"))
