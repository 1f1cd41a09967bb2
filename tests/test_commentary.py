import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwall.functions import exprs as X
from pitwall.operators import ai, commentary
from pitwall.sources import decode


def _wire(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, arrival long")


def test_decode_null_rules_and_default_type(spark):
    vals = [
        '{"id":"c1","message":"m","timestamp":1704067200000,"type":"warning"}',
        '{"id":null,"message":"m","timestamp":1,"type":"info"}',
        '{"id":"c3","message":null,"timestamp":1,"type":"info"}',
        '{"id":"c4","message":"m","timestamp":null,"type":"info"}',
        '{"id":"c5","message":"m","timestamp":2,"type":null}',
        '{"id":"c6","message":"m","timestamp":3}',
        '{"id":"c7", broken',
        None,
    ]
    out = {r.id: r for r in decode.commentary(_wire(spark, vals)).collect()}
    assert set(out) == {"c1", "c5", "c6"}
    assert out["c5"].type == "info" and out["c6"].type == "info" and out["c1"].type == "warning"
    assert out["c1"].ts == dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("message,name,expected", [
    ("Ada Quill takes the lead", "Ada Quill", True),
    ("Quill takes the lead", "Ada Quill", False),      # last name only: the first is required too
    ("QUILL and ADA", "ada quill", True),             # case-insensitive, any order
    ("nothing here", "Ada Quill", False),
    ("", "Ada Quill", True),                          # empty message: shown
    ("anything", "", True),                           # no driver selected
    ("anything", None, True),
    ("quillon", "Quill", True),                       # single token, substring match
])
def test_mentions(spark, message, name, expected):
    df = spark.createDataFrame([(message,)], "message string")
    got = df.select(X.mentions("message", F.lit(name).cast("string")).alias("m")).collect()[0].m
    assert got is expected


def test_generate_id_prompt_type(spark):
    ts = dt.datetime(2024, 1, 1, 0, 0, 5, 250000)
    rows = [(1, ts, "r", "Ada Quill", 1), (2, ts, "r", "Ben Marsh", 3), (3, ts, "r", "Cy Rowe", 4)]
    p = spark.createDataFrame(rows, "arrival long, ts timestamp, race_id string, driver_name string, position int")
    out = {r.arrival: r for r in commentary.generate(p).collect()}
    assert out[1].id == "comment-1704067205-Ada_Quill"
    assert (out[1].type, out[2].type, out[3].type) == ("highlight", "warning", "info")
    assert out[1].timestamp == 1704067205250
    assert out[1].message == "Ada Quill is running P1!" and len(out[1].message) <= 80
    prompt = p.select(X.commentary_prompt("driver_name", "position").alias("p")).collect()[0].p
    assert prompt == "Driver: Ada Quill, Position: 1. Generate exciting F1 commentary. Keep it under 80 characters."


def test_batch_model_and_inner_lateral_semantics(spark):
    calls = ai.ModelSpec("echo", "text_generation", ai.T.StringType(),
                         batch_fn=lambda xs: [None if x.endswith("2") else x.upper() for x in xs])
    df = spark.createDataFrame([("a1",), ("a2",)], "p string")
    out = ai.complete(df, "p", "c", calls).collect()
    assert [(r.p, r.c) for r in out] == [("a1", "A1")]     # a null completion drops the row


def test_template_python_and_column_forms_agree(spark):
    prompts = ["Driver: X Y, Position: 7. tail", "garbage", None]
    df = spark.createDataFrame([(p,) for p in prompts], "p string")
    col = [r.c for r in df.select(ai.template_completion(F.col("p")).alias("c")).collect()]
    py = ai.template_completion_batch(prompts)
    assert col[0] == py[0] == "X Y is running P7!"


def test_dedupe_first_by_arrival_and_recent(spark):
    rows = [("c1", "first", 1), ("c1", "second", 2), ("c2", "x", 3)]
    df = spark.createDataFrame(rows, "id string, message string, arrival long")
    d = {r.id: r.message for r in commentary.dedupe(df).collect()}
    assert d == {"c1": "first", "c2": "x"}
    assert [r.arrival for r in commentary.recent(df, 2).collect()] == [3, 2]


def test_embed_whole_text_normalised(spark):
    long_text = " ".join(["alpha"] * 5000 + ["omega"])
    df = spark.createDataFrame([(1, long_text), (2, None), (3, "")], "i long, t string")
    got = {r.i: r.e for r in ai.embed(df, "t", "e").collect()}
    v = got[1]
    assert len(v) == ai.EMBED_DIM and abs(sum(x * x for x in v) - 1.0) < 1e-5
    expect = ai.hashed_bow([long_text])[0]
    assert max(abs(a - b) for a, b in zip(v, expect)) == 0     # the last word counts too
    assert got[2] is None


def test_sql_lateral_forms(spark):
    ai.register_table_functions(spark)
    spark.createDataFrame([("Ada Quill", 1), ("Ben Marsh", 4)], "driver_name string, position int") \
        .createOrReplaceTempView("lateral_positions")
    got = spark.sql("""
        SELECT driver_name, ai_result.commentary FROM lateral_positions,
        LATERAL ai_complete_tf(CONCAT('Driver: ', driver_name, ', Position: ', CAST(position AS STRING),
                                      '. Generate exciting F1 commentary. Keep it under 80 characters.')) AS ai_result
    """).collect()
    assert sorted((r.driver_name, r.commentary) for r in got) == [
        ("Ada Quill", "Ada Quill is running P1!"), ("Ben Marsh", "Ben Marsh is running P4!")]
    emb = spark.sql("SELECT q, embedding FROM VALUES ('Comments about a driver') AS t(q), LATERAL ml_predict_tf(q)")
    assert len(emb.collect()[0].embedding) == ai.EMBED_DIM


def test_model_is_called_once_a_row(spark):
    calls = spark.sparkContext.accumulator(0)

    def fn(xs):
        calls.add(len(xs))
        return [None if x.endswith("2") else x for x in xs]

    df = spark.createDataFrame([(f"p{i}",) for i in range(20)], "prompt string").repartition(2)
    model = ai.ModelSpec("m", "text_generation", T.StringType(), batch_fn=fn)
    assert len(ai.complete(df, "prompt", "out", model).collect()) == 18 and calls.value == 20


def test_sql_form_refuses_a_model_it_cannot_run(spark):
    model = ai.ModelSpec("m", "text_generation", T.StringType(), column_fn=F.upper)
    with pytest.raises(ValueError):
        ai.register_sql_functions(spark, model)
