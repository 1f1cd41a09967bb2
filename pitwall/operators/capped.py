"""Per-race list capped at ``cap`` drivers, folded chunk by chunk with repair.

An update of a listed driver keeps its slot; a new driver is appended; beyond ``cap`` the oldest slot
goes. The list depends on the order of all messages, so a race is cut into chunks of arrival offsets,
each folded by itself:

1. one pass over the messages: every (race, chunk) becomes a summary row with its driver names in
   order of first appearance, the sequence of drivers (repeats in a row dropped) and the end of its fold from an empty list;
2. a chain over the summaries guesses each chunk's starting list: while nothing is evicted,
   names are simply appended; a chunk with more drivers than the cap ends as its fold from an empty list did;
3. every chunk is folded from its guess, all at once;
4. repair: a chunk whose start differs from the end of the chunk before it is folded again, until none
   differs. Every round settles at least the first wrong chunk of each race; lists meet again after some evictions,
   so that usually none or one is needed. The result is exact however good the guesses were.

A race's messages are never in one task, whatever its size; the chain sees one row a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwall.session import stored

CAP = 10                      # entries kept per race (fixed value of the behaviour)
CHUNK = 1 << 20               # arrival offsets per chunk
_SUMMARY = "rk string, chunk long, names array<string>, seq binary, own array<string>"
_FOLDED = "rk string, chunk long, start array<string>, `end` array<string>"


def race_key(race="race_id"):
    """The race as a key that is never null."""
    return F.coalesce(F.concat(F.lit("r"), F.col(race)), F.lit("-"))


def race_of(rk):
    return F.when(rk != "-", F.substring(rk, 2, 1 << 30))


def fold(names, slots: list, cap: int) -> list:
    """The list after ``names`` came in one by one (``slots`` is changed)."""
    held = set(slots)
    for d in names:
        if d not in held:
            slots.append(d)
            held.add(d)
            if len(slots) > cap:
                held.discard(slots.pop(0))
    return slots


def _ordered(t: pa.Table) -> pa.Table:
    return t.sort_by([("arrival", "ascending"), ("driver_name", "ascending")])


def _summarise(cap: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        code = pc.dictionary_encode(_ordered(t).column("driver_name").combine_chunks())
        at = code.indices.to_numpy().astype("<i4")
        names = code.dictionary.to_pylist()
        seq = at[np.concatenate([[True], at[1:] != at[:-1]])]
        own = [names[i] for i in fold(seq.tolist(), [], cap)]
        return pa.table({"rk": pa.array([key[0].as_py()]), "chunk": pa.array([key[1].as_py()], pa.int64()), "names": pa.array([names], pa.list_(pa.string())),
                         "seq": pa.array([seq.tobytes()], pa.binary()), "own": pa.array([own], pa.list_(pa.string()))})
    return run


def _guess(cap: int):
    def run(batches):
        race, slots = None, []
        for b in batches:
            out = []
            for rk, chunk, names, own in zip(*(c.to_pylist() for c in b.columns)):
                if rk != race:
                    race, slots = rk, []
                if chunk >= 0:
                    out.append((rk, chunk, list(slots)))
                slots = list(own) if len(names) > cap else fold(names, slots, cap)
            if out:
                rk, chunk, start = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(rk), pa.array(chunk, pa.int64()), pa.array(start, pa.list_(pa.string()))], ["rk", "chunk", "start"])
    return run


def _refold(cap: int):
    def run(batches):
        for b in batches:
            start, end = [], []
            for names, seq, first in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                known = {d: i for i, d in enumerate(names)}
                every = names + [d for d in first if d not in known]
                known.update({d: i for i, d in enumerate(every)})
                start.append(first)
                end.append([every[i] for i in fold(np.frombuffer(seq, "<i4").tolist(), [known[d] for d in first], cap)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(start, pa.list_(pa.string())), pa.array(end, pa.list_(pa.string()))], ["rk", "chunk", "start", "end"])
    return run


def chunk_lists(positions: DataFrame, cap: int = CAP, chunk: int = CHUNK, initial: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(rk, chunk, start, end) of every chunk, and how many rounds of repair it took.

    ``initial`` (race_id, slots) holds the lists before the first message. Messages without a driver are left out."""
    rows = positions.where("driver_name is not null").select(race_key().alias("rk"), F.floor(F.col("arrival") / chunk).cast("long").alias("chunk"), "arrival", "driver_name")
    chunks = stored(rows.groupBy("rk", "chunk").applyInArrow(_summarise(cap), _SUMMARY), "capped-chunks")
    chain = chunks.select("rk", "chunk", "names", "own")
    if initial is not None:
        chain = chain.unionByName(initial.select(race_key().alias("rk"), F.lit(-1).cast("long").alias("chunk"), F.col("slots").alias("names"), F.col("slots").alias("own")))
    starts = (chain.repartition("rk").sortWithinPartitions("rk", "chunk")
              .mapInArrow(_guess(cap), "rk string, chunk long, start array<string>"))

    def folded(starts: DataFrame) -> DataFrame:
        return chunks.select("rk", "chunk", "names", "seq").join(starts, ["rk", "chunk"]).mapInArrow(_refold(cap), _FOLDED)

    lists, rounds = stored(folded(starts), "capped-lists"), 0
    before = F.lag("end").over(Window.partitionBy("rk").orderBy("chunk"))
    while True:
        wrong = stored(lists.withColumn("due", F.coalesce(before, F.col("start"))).where("due != start").select("rk", "chunk", F.col("due").alias("start")), "capped-wrong")
        if not wrong.limit(1).count():
            return lists, rounds
        mended = folded(wrong).select("rk", "chunk", F.col("start").alias("s"), F.col("end").alias("e"))
        lists = stored(lists.join(mended, ["rk", "chunk"], "left").select("rk", "chunk", F.coalesce("s", "start").alias("start"), F.coalesce("e", "end").alias("end")), "capped-lists")
        rounds += 1


def members(lists: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """(rk, driver_name, slot) of each race's list after its last chunk; races without a chunk keep their ``initial`` list."""
    last = lists.groupBy("rk").agg(F.max_by("end", "chunk").alias("slots"))
    if initial is not None:
        last = (last.withColumn("new", F.lit(1)).unionByName(initial.select(race_key().alias("rk"), "slots", F.lit(0).alias("new")))
                .groupBy("rk").agg(F.max_by("slots", "new").alias("slots")))
    return last.select("rk", F.posexplode("slots").alias("at", "driver_name")).select("rk", "driver_name", (F.col("at") + 1).cast("int").alias("slot"))


def with_values(listed: DataFrame, rows: DataFrame) -> DataFrame:
    """Each listed driver's latest message of ``rows``: race_id, driver_name, slot and the other columns."""
    rest = [c for c in rows.columns if c not in ("race_id", "driver_name")]
    last = rows.groupBy(race_key().alias("rk"), "driver_name").agg(F.max_by(F.struct(*rest), "arrival").alias("m"))
    return listed.join(last, ["rk", "driver_name"]).select(race_of(F.col("rk")).alias("race_id"), "driver_name", "slot", "m.*")


def bounded(positions: DataFrame, cap: int = CAP, chunk: int = CHUNK) -> DataFrame:
    """The list of each race after its last message, with the latest message of each listed driver."""
    lists, _ = chunk_lists(positions, cap, chunk)
    return with_values(members(lists), positions)


def _log(cap: int):
    def run(key: tuple, t: pa.Table, starts: pa.Table) -> pa.Table:
        t = _ordered(t)
        slots, out = starts.column("start")[0].as_py() if starts.num_rows else [], []
        for d in t.column("driver_name").to_pylist():
            slots = fold([d], slots, cap)
            out.append(list(slots))
        return pa.table({"rk": t.column("rk"), "arrival": t.column("arrival"), "driver_name": t.column("driver_name"), "slots": pa.array(out, pa.list_(pa.string()))})
    return run


def list_log(positions: DataFrame, cap: int = CAP, chunk: int = CHUNK, initial: DataFrame | None = None) -> DataFrame:
    """K7: the whole list as it stood after every message: race_id, arrival, driver_name, slots. Chunks expand from their settled starts."""
    lists, _ = chunk_lists(positions, cap, chunk, initial)
    rows = positions.where("driver_name is not null").select(race_key().alias("rk"), F.floor(F.col("arrival") / chunk).cast("long").alias("chunk"), "arrival", "driver_name")
    starts = lists.select(F.col("rk").alias("k"), F.col("chunk").alias("c"), "start")
    log = rows.groupBy("rk", "chunk").cogroup(starts.groupBy("k", "c")).applyInArrow(_log(cap), "rk string, arrival long, driver_name string, slots array<string>")
    return log.select(race_of(F.col("rk")).alias("race_id"), "arrival", "driver_name", "slots")
