"""Connections and models by name: clients a worker, calls an input, secrets, SQL."""

import os
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.errors import PythonException

from pitwall.operators import ai, models
from pitwall.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])          # the clients below reach the workers without this file


def counting(endpoint, secret, options):
    """A client that leaves a file for itself and for each input that it is asked."""
    open(f"{endpoint}/client-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

    def call(inputs):
        for _ in inputs:
            open(f"{endpoint}/asked-{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return [None if x == "mute" else f"{options['mark']}{x}{len(secret or '')}" for x in inputs]
    return call


def bow(endpoint, secret, options):
    return ai.hashed_bow


def short(endpoint, secret, options):
    return lambda inputs: inputs[1:]


def _registry(folder, **options):
    r = models.Registry()
    r.create_connection(models.Connection("local", str(folder), "pitwall.test.secret"))
    r.create_connection(models.Connection("open", "none"))
    r.create_model(models.Model("talk", "local", "text_generation", counting, {"mark": ">", **options}))
    r.create_model(models.Model("vec", "open", "embedding", bow))
    return r


def _left(folder, kind):
    return [f for f in os.listdir(folder) if f.startswith(kind)]


@pytest.fixture
def secret(spark):
    spark.conf.set("pitwall.test.secret", "abc")
    yield
    spark.conf.unset("pitwall.test.secret")


def test_one_call_an_input_one_client_a_worker_and_none_again(spark, tmp_path, secret):
    r, path = _registry(tmp_path), scratch_path(spark, f"answers-{uuid.uuid4().hex}")
    rows = [(i, ["a", "b", "c", None, "mute", ""][i % 6]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, prompt string").repartition(4)
    got = sorted(map(tuple, models.answered(df, "prompt", "answer", r, "talk", rows_per_task=2, path=path).collect()))
    assert got == sorted((i, p, f">{p}3") for i, p in rows if p not in (None, "mute"))
    asked, workers = _left(tmp_path, "asked"), {f.split("-")[1] for f in _left(tmp_path, "client")}
    assert len(asked) == 5                                        # distinct inputs that aren't null
    assert len(_left(tmp_path, "client")) == len(workers)         # no worker made two
    again = models.answered(df, "prompt", "answer", r, "talk", path=path)
    assert sorted(map(tuple, again.collect())) == got and len(_left(tmp_path, "asked")) == 5
    more = models.answered(df.union(spark.createDataFrame([(99, "new")], df.schema)), "prompt", "answer", r, "talk", path=path)
    assert more.count() == len(got) + 1 and len(_left(tmp_path, "asked")) == 6
    # other options are another model's answers
    other = models.answered(df, "prompt", "answer", _registry(tmp_path, mark="#"), "talk", path=path)
    assert {x.answer[0] for x in other.collect()} == {"#"}


def test_names_in_sql(spark, tmp_path, secret):
    models.register_sql(spark, _registry(tmp_path))
    spark.createDataFrame([("talk", "x"), ("talk", None)], "m string, p string").createOrReplaceTempView("asked_by_name")
    got = spark.sql("SELECT p, ai_complete_by(m, p) a, ml_predict_by('vec', p) v FROM asked_by_name").collect()
    by = {r.p: r for r in got}
    assert by["x"].a == ">x3" and by[None].a is None and by[None].v is None
    assert by["x"].v == pytest.approx(ai.hashed_bow(["x"])[0].tolist())
    for bad in ("'vec'", "'nobody'"):
        with pytest.raises(PythonException):
            spark.sql(f"SELECT ai_complete_by({bad}, p) FROM asked_by_name").collect()


def test_definitions(spark, tmp_path, secret):
    r = _registry(tmp_path)
    with pytest.raises(ValueError):
        r.create_connection(models.Connection("open", "x"))
    r.create_connection(models.Connection("open", "x"), replace=True)
    with pytest.raises(KeyError):
        r.create_model(models.Model("m", "nowhere", "embedding", bow))
    with pytest.raises(ValueError):
        models.Model("m", "open", "guessing", bow)
    with pytest.raises(ValueError):
        r.drop_connection("open")
    r.drop_model("vec")
    r.drop_connection("open")
    with pytest.raises(KeyError):
        r.call(spark, "vec")
    spark.conf.unset("pitwall.test.secret")
    with pytest.raises(ValueError):
        r.call(spark, "talk")
    spark.conf.set("pitwall.test.secret", "abc")
    assert "abc" not in repr(r.call(spark, "talk"))


def test_a_client_that_answers_too_little_fails(spark):
    r = models.Registry()
    r.create_connection(models.Connection("c", "e"))
    r.create_model(models.Model("short", "c", "text_generation", short))
    df = spark.createDataFrame([("a",), ("b",)], "p string")
    with pytest.raises(Exception, match="answers"):
        models.answered(df, "p", "o", r, "short", path=scratch_path(spark, f"answers-{uuid.uuid4().hex}")).collect()
    empty = models.answered(df.limit(0), "p", "o", r, "short", path=scratch_path(spark, f"answers-{uuid.uuid4().hex}"))
    assert empty.collect() == []
