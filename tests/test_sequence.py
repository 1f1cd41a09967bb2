"""The chunked ordered-window helpers equal plain windows, also for a hot key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitwall.operators import sequence


def _data(spark):
    rng = random.Random(2)
    rows = []
    for i in range(2000):
        k = "hot" if rng.random() < 0.6 else (None if rng.random() < 0.1 else f"k{rng.randrange(5)}")
        rows.append((i, k, rng.randrange(0, 400), rng.randrange(-50, 50)))
    return spark.createDataFrame(rows, "off long, k string, t long, v long")


def test_previous_equals_lag(spark):
    df = _data(spark)
    got = sequence.previous(df, ["k"], ["off"], sequence.offset_chunk("off", 37), ["v", "t"])
    w = Window.partitionBy("k").orderBy("off")
    ref = df.select("*", F.lag("v").over(w).alias("prev_v"), F.lag("t").over(w).alias("prev_t"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, ref.collect()), key=str)


def test_prefix_sums_rows_and_range(spark):
    df = _data(spark)
    sums = {"s": F.col("v"), "c": F.lit(1)}
    got_rows = sequence.prefix_sums(df, ["k"], ["t", "off"], sequence.time_chunk("t", 23), sums)
    got_range = sequence.prefix_sums(df, ["k"], ["t"], sequence.time_chunk("t", 23), sums, range_order=True)
    w = Window.partitionBy("k")
    fr = w.orderBy("t", "off").rowsBetween(Window.unboundedPreceding, -1)
    fg = w.orderBy("t").rangeBetween(Window.unboundedPreceding, -1)

    def ref(frame):
        return df.select("*", F.coalesce(F.sum("v").over(frame), F.lit(0)).alias("s"),
                         F.coalesce(F.count(F.lit(1)).over(frame), F.lit(0)).alias("c"))

    def norm(d):
        return sorted(((r.off, int(r.s), int(r.c)) for r in d.collect()))

    assert norm(got_rows) == norm(ref(fr))
    assert norm(got_range) == norm(ref(fg))


def test_time_chunks_do_not_depend_on_the_number_of_keys(spark):
    rows = [(k, t * 10) for k, n in (("hot", 200), ("cold", 5), (None, 3)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, ms long")
    few = sequence.balanced_time_chunk(df, ["k"], "ms", 20)
    many = sequence.balanced_time_chunk(df, ["k"], "ms", 20, max_keys=1)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert few.where("k = 'hot'").select("_tchunk").distinct().count() >= 10
