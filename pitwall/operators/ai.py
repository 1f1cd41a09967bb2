"""Model calls: text completion and text embedding.

A model is a ``ModelSpec``. Two kinds of implementation are accepted:

* ``column_fn``: a pure column expression (runs in the JVM, no Python worker). The
  offline defaults are of this kind.
* ``batch_fn``: ``list[str] -> list`` called on Arrow batches inside ``mapInPandas`` /
  a pandas UDF, one client per Python worker; for remote model services. Calls may repeat
  when a task is retried, so services with side effects should be idempotent.

The lateral ``AI_COMPLETE`` / ``ML_PREDICT`` table-function forms map to
``register_table_functions`` (Arrow Python UDTFs for ``LATERAL`` in SQL), to
``register_sql_functions`` (pandas UDFs for SQL projections) and to the DataFrame
functions ``complete`` / ``embed`` below (the fast path).
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
import string
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwall.functions import exprs as X

COMPLETION_MAX_CHARS = 80          # the prompt asks for under 80 characters
EMBED_DIM = 64


@dataclasses.dataclass(frozen=True)
class ModelSpec:
    name: str
    task: str                                   # "text_generation" | "embedding"
    output_type: T.DataType
    column_fn: Callable[[Column], Column] | None = None
    batch_fn: Callable[[list], list] | None = None
    params: dict[str, Any] = dataclasses.field(default_factory=dict)


def template_completion(prompt: Column) -> Column:
    """Offline text generation: reads the driver and position back from the prompt
    (plain substring scans: the name between 'Driver: ' and ', Position: ', the position
    up to the next '.')."""
    name = F.substring_index(F.substring_index(prompt, X.PROMPT_MID, 1), X.PROMPT_HEAD, -1)
    pos = F.substring_index(F.substring_index(prompt, X.PROMPT_MID, -1), ".", 1)
    return F.substring(F.concat(name, F.lit(" is running P"), pos, F.lit("!")), 1, COMPLETION_MAX_CHARS)


def template_completion_batch(prompts: list) -> list:
    """The same template for the SQL function form (Python batches)."""
    out = []
    for p in prompts:
        if p is None:
            out.append(None)
            continue
        name = p.split(X.PROMPT_MID, 1)[0].rsplit(X.PROMPT_HEAD, 1)[-1]
        pos = p.rsplit(X.PROMPT_MID, 1)[-1].split(".", 1)[0]
        out.append(f"{name} is running P{pos}!"[:COMPLETION_MAX_CHARS])
    return out


#: A token: letters and digits of ASCII, and everything beyond ASCII (the same in every engine).
TOKEN = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
_TOKEN = re.compile(TOKEN)
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
#: One character for each of the buckets that a token's MD5 names.
_BUCKETS = _UPPER + _LOWER + string.digits + "+/"


def hashed_bow(texts: list, dim: int = EMBED_DIM) -> list:
    """Offline embedding in Python (for SQL functions): hashed bag of words over the whole text, L2-normalised."""
    lower = str.maketrans(_UPPER, _LOWER)
    out = []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        v = np.zeros(dim, dtype=np.float64)
        for tok in _TOKEN.findall(t.translate(lower)):
            v[hashlib.md5(tok.encode("utf-8")).digest()[0] % dim] += 1.0
        nrm = np.sqrt((v * v).sum())
        out.append((v / nrm).astype(np.float32) if nrm > 0 else v.astype(np.float32))
    return out


def hashed_bow_column(text: Column) -> Column:
    """The same embedding as one column expression: the text becomes one character per token (its
    bucket), a component is how often its character occurs, over the norm of all. Whole texts, no Python.

    Each step is bound by a lambda over a one-element array, so that no step is evaluated again where it is used twice."""
    tokens = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TOKEN), F.lit(0))
    bucket = lambda t: F.conv(F.substring(F.md5(t), 1, 2), 16, 10).cast("int") % EMBED_DIM
    marks = F.array_join(F.transform(tokens, lambda t: F.substring(F.lit(_BUCKETS), bucket(t) + 1, F.lit(1))), "")
    count = lambda s: F.array(*[(F.length(s) - F.length(F.replace(s, F.lit(c)))).cast("double") for c in _BUCKETS[:EMBED_DIM]])
    counts = F.transform(F.array(marks), lambda s: F.when(s.isNotNull(), count(s)))
    normed = F.transform(counts, lambda c: F.struct(c.alias("c"), F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)).alias("n")))
    unit = F.transform(normed, lambda z: F.transform(z["c"], lambda x: F.when(z["n"] > 0, x / z["n"]).otherwise(0.0).cast("float")))
    return F.element_at(unit, 1)


COMMENTARY_MODEL = ModelSpec("commentary_generator", "text_generation", T.StringType(),
                             column_fn=template_completion, params={"max_tokens": 20000})
EMBED_MODEL = ModelSpec("query_embed", "embedding", T.ArrayType(T.FloatType()), batch_fn=hashed_bow, column_fn=hashed_bow_column)


def complete(df: DataFrame, prompt_col: str, out_col: str = "commentary",
             model: ModelSpec = COMMENTARY_MODEL) -> DataFrame:
    """One completion per row (inner lateral: rows whose call returns null drop)."""
    if model.column_fn is not None:
        res = df.withColumn(out_col, model.column_fn(F.col(prompt_col)))
    else:
        fn = model.batch_fn

        @F.pandas_udf(T.StringType())
        def call(s: pd.Series) -> pd.Series:
            return pd.Series(fn(s.tolist()), dtype=object)

        # nondeterministic: the null filter below must not call the model once more
        res = df.withColumn(out_col, call.asNondeterministic()(F.col(prompt_col)))
    return res.where(F.col(out_col).isNotNull())


def embed(df: DataFrame, text_col: str, out_col: str = "embedding",
          model: ModelSpec = EMBED_MODEL) -> DataFrame:
    """One embedding per row: in the JVM where the model has such a form, else on Arrow batches."""
    if model.column_fn is not None:
        return df.withColumn(out_col, model.column_fn(F.col(text_col)))
    fn = model.batch_fn

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def call(s: pd.Series) -> pd.Series:
        return pd.Series(fn(s.tolist()), dtype=object)

    return df.withColumn(out_col, call.asNondeterministic()(F.col(text_col)))


def _batches(model: ModelSpec) -> Callable[[list], list]:
    """The Python form of a model for SQL functions."""
    if model.batch_fn is not None:
        return model.batch_fn
    if model.column_fn is template_completion:
        return template_completion_batch
    raise ValueError(f"model {model.name} is a column expression only; SQL functions need a batch_fn")


def register_sql_functions(spark: SparkSession, completion: ModelSpec = COMMENTARY_MODEL,
                           embedding: ModelSpec = EMBED_MODEL) -> None:
    """Expose the models to SQL as ``ai_complete(prompt)`` and ``ml_predict(text)``."""
    comp = _batches(completion)

    @F.pandas_udf(T.StringType())
    def ai_complete(s: pd.Series) -> pd.Series:
        return pd.Series(comp(s.tolist()), dtype=object)

    emb = _batches(embedding)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def ml_predict(s: pd.Series) -> pd.Series:
        return pd.Series(emb(s.tolist()), dtype=object)

    spark.udf.register("ai_complete", ai_complete.asNondeterministic())
    spark.udf.register("ml_predict", ml_predict.asNondeterministic())


def register_table_functions(spark: SparkSession, completion: ModelSpec = COMMENTARY_MODEL,
                             embedding: ModelSpec = EMBED_MODEL) -> None:
    """The lateral table-function forms for SQL (J1, J2, B8):

    ``SELECT ... FROM positions, LATERAL ai_complete_tf(prompt) AS ai_result(commentary)``
    ``SELECT query, embedding FROM queries, LATERAL ml_predict_tf(query)``

    Arrow-batched Python UDTFs; a row whose call yields nothing drops (inner lateral).
    The DataFrame functions ``complete`` / ``embed`` are the faster path.
    """
    comp = _batches(completion)
    emb = _batches(embedding)

    @F.udtf(returnType="commentary: string", useArrow=True)
    class AiCompleteTF:
        def eval(self, prompt):
            out = comp([prompt])[0]
            if out is not None:
                yield (out,)

    @F.udtf(returnType="embedding: array<float>", useArrow=True)
    class MlPredictTF:
        def eval(self, text):
            out = emb([text])[0]
            if out is not None:
                yield ([float(x) for x in out],)

    spark.udtf.register("ai_complete_tf", AiCompleteTF)
    spark.udtf.register("ml_predict_tf", MlPredictTF)
