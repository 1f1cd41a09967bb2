"""Conversation prefix trie (operator 12): subtree totals by parallel tree contraction.

Conversations are rebuilt first (``rebuilt``): the first h turns of the conversation c - c % 100, then c's own
turns after its first h, with h = crc32(decimal c) % 6. A node of the trie is a distinct sequence
of first turns; it is recognised by its depth and two sums, modulo 2**62, of hashes of (position,
turn), so that a prefix's key is a running sum and the parent's key is known without a look at the parent.

Subtree totals (``subtree_totals``) come from tree contraction in rounds of joins. Rake: every leaf
hands its total to its parent and goes. Compress: of the nodes with a single child, those that draw a
lower lot than their parent and their child go too (never two neighbours): what they hold is added to their
parent, and their child moves up to it. Every node keeps the count of its children and the sums of their ids, so the only child's id is at hand
without a join. Rounds go on until only roots are left; they grow with the logarithm of the
tree, however deep it is. Then the contracted nodes are expanded, last round first: a compressed node's total is what it
held plus the total of the child it had.

Nothing gathers by conversation or node: turns are numbered in range partitions (a conversation of any
length spreads), running sums go in chunks of ``chunk`` turns, children are summed by partial
aggregation, nodes with very many children reach these by broadcast (fewer than ``hot``
of them), and the ids that end at a node are hashed from chunks of ``ids_at_once`` ids, written in order.

Rows without a conversation id take no part; a null turn comes first, equal turns are ordered by
role, then text; null role or text is empty; repeated rows are turns of their own. A rebuilt
conversation may be empty: it is a member of the root. An empty table has no nodes. Texts are hashed at the
scan's end, whatever their length. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwall.llm import common as C

_MOD = 1 << 62
_DEC = "decimal(38,0)"


@dataclass(frozen=True)
class Params:
    block: int = 100
    most_shared: int = 6
    chunk: int = 4096
    hot: int = 1000
    ids_at_once: int = 8192


def numbered(conversations: DataFrame) -> DataFrame:
    """conv, at (place in the conversation from 0), t1, t2 (hashes of role and text), n (code points)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                                 F.monotonically_increasing_id().alias("tie")).filter("conv is not null")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    lined = turns.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(2), "text", "role").alias("t2"), F.length("text").cast("long").alias("n"))

    def number(batches):
        part, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            conv = b.column(0).to_numpy()
            if not len(conv):
                continue
            first = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
            no = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if conv[0] == last:
                no[:first[1] if len(first) > 1 else len(conv)] += count
            last, count = conv[-1], no[-1] + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(no), pa.array(np.full(len(conv), part, np.int64))], ["conv", "t1", "t2", "n", "no", "part"])

    rows = C.stored(lined.mapInArrow(number, "conv long, t1 long, t2 long, n long, no long, part long"), "numbered-turns")
    # conversations that go on from an earlier partition: at most one a partition
    pieces = rows.groupBy("conv", "part").agg(F.count("*").alias("size"))
    before = pieces.withColumn("before", F.sum("size").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = F.broadcast(before.filter("before > 0").select("conv", "part", "before"))
    return rows.join(before, ["conv", "part"], "left").select("conv", (F.col("no") + F.coalesce("before", F.lit(0))).alias("at"), "t1", "t2", "n")


def rebuilt(conversations: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, t1, t2, n, len) of every rebuilt turn, and (conv, len) of every rebuilt conversation."""
    turns = C.stored(numbered(conversations), "turns")
    own = turns.groupBy("conv").agg(F.count("*").alias("own"))
    heads = (turns.filter((F.col("conv") % p.block == 0) & (F.col("at") < p.most_shared)).groupBy(F.col("conv").alias("root"))
             .agg(F.sort_array(F.collect_list(F.struct("at", "t1", "t2", "n"))).alias("head")))
    convs = own.select("conv", "own", (F.crc32(F.col("conv").cast("string")) % p.most_shared).cast("int").alias("h"), (F.col("conv") - F.col("conv") % p.block).alias("root"))
    convs = convs.join(heads, "root", "left").select(
        "conv", "own", "h", F.when(F.col("h") == 0, F.array().cast("array<struct<at:bigint,t1:bigint,t2:bigint,n:bigint>>"))
        .otherwise(F.slice(F.coalesce("head", F.array()), F.lit(1), F.greatest("h", F.lit(1)))).alias("head"))
    convs = C.stored(convs.withColumn("len", F.size("head") + F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("h"))), "rebuilt-conversations")
    shared = convs.select("conv", F.posexplode("head").alias("pos", "turn"), "len").select("conv", F.col("pos").cast("long").alias("pos"), "turn.t1", "turn.t2", "turn.n", "len")
    # a conversation's own turns move by what is shared; long ones are few
    rest = C.attach(turns, ["conv"], convs.select("conv", "own", "h", F.size("head").alias("shared"), "len"), "own", p.hot)
    rest = rest.filter(F.col("at") >= F.col("found.h")).select("conv", (F.col("at") - F.col("found.h") + F.col("found.shared")).alias("pos"), "t1", "t2", "n", "found.len")
    return shared.unionByName(rest), convs.select("conv", "len")


def memberships(conversations: DataFrame, p: Params = Params()) -> DataFrame:
    """One row for each rebuilt conversation and depth: conv, d, s1, s2 (the node), p1, p2 (its parent), n (code points of the last text), last."""
    turns, convs = rebuilt(conversations, p)
    mask = F.lit(_MOD - 1)
    rows = turns.select("conv", "pos", "n", "len", F.floor(F.col("pos") / p.chunk).cast("long").alias("chunk"),
                        F.xxhash64("pos", "t1").bitwiseAND(mask).alias("h1"), F.xxhash64("pos", "t2").bitwiseAND(mask).alias("h2"))
    inside = Window.partitionBy("conv", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *(F.sum(F.col(f"h{i}").cast("decimal(20,0)")).over(inside).cast(_DEC).alias(f"l{i}") for i in (1, 2)))
    totals = rows.filter(F.col("len") > p.chunk).groupBy("conv", "chunk").agg(*(F.sum(F.col(f"h{i}").cast("decimal(20,0)")).cast(_DEC).alias(f"o{i}") for i in (1, 2)))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv", "chunk", *(F.sum(f"o{i}").over(earlier).cast(_DEC).alias(f"o{i}") for i in (1, 2)))
    whole = local.join(offsets, ["conv", "chunk"], "left")
    s = [F.pmod(F.col(f"l{i}") + F.coalesce(F.col(f"o{i}"), F.lit(0).cast(_DEC)), F.lit(_MOD).cast("decimal(20,0)")).cast("long") for i in (1, 2)]
    whole = whole.select("conv", (F.col("pos") + 1).alias("d"), s[0].alias("s1"), s[1].alias("s2"), "h1", "h2", "n", (F.col("pos") + 1 == F.col("len")).alias("last"))
    back = [F.when(F.col(f"s{i}") >= F.col(f"h{i}"), F.col(f"s{i}") - F.col(f"h{i}")).otherwise(F.col(f"s{i}") - F.col(f"h{i}") + F.lit(_MOD)) for i in (1, 2)]
    zero = F.lit(0).cast("long")
    top = convs.select("conv", zero.alias("d"), zero.alias("s1"), zero.alias("s2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("n"),
                       (F.col("len") == 0).alias("last"))
    return whole.select("conv", "d", "s1", "s2", back[0].alias("p1"), back[1].alias("p2"), "n", "last").unionByName(top)


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """Sums of ``values`` over the subtree of every node of ``tree`` (a, b: the id; pa, pb: the parent's, null for a root; values): a, b, values.

    Ids are pairs of integers. Any forest will do; rounds are logarithmic in its size."""
    dec = {v: F.col(v).cast(_DEC) for v in values}
    none = [F.lit(None).cast("long").alias(c) for c in ("pa", "pb", "na", "nb")]

    def change(a, b, kids, ka, kb, na=None, nb=None, held=False):
        """A row that adds to node (a, b)."""
        move = none[:2] + ([na.alias("na"), nb.alias("nb")] if na is not None else none[2:])
        return [a.alias("a"), b.alias("b"), *move, F.lit(kids).alias("kids"), ka.cast(_DEC).alias("ka"), kb.cast(_DEC).alias("kb"),
                *((F.col(v) if held else F.lit(0)).cast(_DEC).alias(v) for v in values)]

    def applied(nodes, changes, name):
        """``nodes`` with ``changes`` added; a node that moves has its new parent in (na, nb)."""
        both = nodes.select("a", "b", "pa", "pb", *none[2:], "kids", "ka", "kb", *values)
        for c in changes:
            both = both.unionByName(c)
        sums = [F.sum(c).cast(_DEC).alias(c) for c in ("ka", "kb", *values)]
        got = both.groupBy("a", "b").agg(F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("kids").cast("long").alias("kids"), *sums)
        return C.stored(got.select("a", "b", F.coalesce("na", "pa").alias("pa"), F.coalesce("nb", "pb").alias("pb"), "kids", "ka", "kb", *values), name)

    a, b, pa_, pb_ = (F.col(c) for c in ("a", "b", "pa", "pb"))
    zero = F.lit(0).cast(_DEC)
    start = tree.select("a", "b", "pa", "pb", F.lit(0).alias("kids"), zero.alias("ka"), zero.alias("kb"), *(x.alias(v) for v, x in dec.items()))
    live = applied(start, [start.filter("pa is not null").select(*change(pa_, pb_, 1, a, b))], "trie-live")
    leaf = (F.col("kids") == 0) & pa_.isNotNull()
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while live.filter("pa is not null").limit(1).count():
        raked = live.filter(leaf)
        left = applied(live.filter(~leaf), [raked.select(*change(pa_, pb_, -1, -a, -b, held=True))], "trie-raked")
        lot = lambda x, y: F.xxhash64(x.try_cast("long"), y.try_cast("long"), F.lit(len(rounds)))
        goes = F.coalesce((F.col("kids") == 1) & pa_.isNotNull() & (lot(a, b) < lot(pa_, pb_)) & (lot(a, b) < lot(F.col("ka"), F.col("kb"))), F.lit(False))
        gone = left.filter(goes).withColumns({"ca": F.col("ka").try_cast("long"), "cb": F.col("kb").try_cast("long")})
        live = applied(left.filter(~goes), [gone.select(*change(F.col("ca"), F.col("cb"), 0, zero, zero, pa_, pb_)),
                                            gone.select(*change(pa_, pb_, 0, F.col("ka") - a, F.col("kb") - b, held=True))], "trie-live")
        rounds.append((raked.select("a", "b", *values), gone.select("a", "b", "ca", "cb", *values)))
    total = live.select("a", "b", *values)
    for raked, gone in reversed(rounds):
        below = total.select(F.col("a").alias("ca"), F.col("b").alias("cb"), *(F.col(v).alias(f"{v}_below") for v in values))
        opened = gone.join(below, ["ca", "cb"]).select("a", "b", *((F.col(v) + F.col(f"{v}_below")).cast(_DEC).alias(v) for v in values))
        total = C.stored(total.unionByName(opened).unionByName(raked), "trie-totals")
    return total


def end_hashes(ends: DataFrame, p: Params = Params()) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids that end at each node of ``ends`` (d, s1, s2, conv): d, s1, s2, ends_sha256."""
    order, most = ["d", "s1", "s2", "conv"], p.ids_at_once

    def gather(batches):
        part, seq, key, ids = TaskContext.get().partitionId(), 0, None, []

        def row():
            return pa.RecordBatch.from_pydict({"d": pa.array([key[0]], pa.int64()), "s1": pa.array([key[1]], pa.int64()), "s2": pa.array([key[2]], pa.int64()),
                                               "part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()), "ids": pa.array([",".join(ids)])})

        out = []
        for b in batches:
            d, s1, s2, conv = (c.to_numpy() for c in b.columns)
            cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])) if len(d) else np.zeros(0, int)
            said = pc.cast(b.column(3), pa.string()).to_pylist()
            for lo, hi in zip(cut, np.append(cut[1:], len(d))):
                here = (int(d[lo]), int(s1[lo]), int(s2[lo]))
                if here != key:
                    if ids:
                        out.append(row())
                        seq, ids = seq + 1, []
                    key = here
                ids += said[lo:hi]
                if len(ids) >= most:
                    out.append(row())
                    seq, ids = seq + 1, []
            if len(out) >= 1000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if ids:
            out.append(row())
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    def digest(batches):
        key, sha, out = None, None, []
        for b in batches:
            for d, s1, s2, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 5))):
                if (d, s1, s2) == key:
                    sha.update(b",")
                else:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (d, s1, s2), hashlib.sha256()
                sha.update(ids.encode())
            if len(out) > 5000:
                yield named(out)
                out = []
        if key:
            out.append((*key, sha.hexdigest()))
        if out:
            yield named(out)

    def named(rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["d", "s1", "s2", "ends_sha256"])

    chunks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(gather, "d long, s1 long, s2 long, part long, seq long, ids string")
    return chunks.repartition("d", "s1", "s2").sortWithinPartitions("d", "s1", "s2", "part", "seq").mapInArrow(digest, "d long, s1 long, s2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (long), ends_sha256."""
    members = C.stored(memberships(conversations, p), "trie-members")
    nodes = members.groupBy("d", "s1", "s2").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("n").alias("n"))
    nodes = C.stored(nodes, "trie-nodes")
    kids = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(F.count("*").alias("n_children"))
    ends = end_hashes(members.filter("last"), p)
    none = hashlib.sha256(b"").hexdigest()
    nodes = C.stored(nodes.join(kids, ["d", "s1", "s2"], "left").join(ends, ["d", "s1", "s2"], "left")
                     .withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "ends_sha256": F.coalesce("ends_sha256", F.lit(none))}), "trie-counted")
    parents = nodes.filter("n_children > 0").select(F.col("d").alias("pd"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    tree = C.attach(nodes.withColumn("pd", F.col("d") - 1), ["pd", "p1", "p2"], parents, "n_children", p.hot)
    tree = C.stored(tree.select("conv_id", F.col("d").alias("depth"), "found.parent_conv_id", "n_convs", "n_children",
                                F.when(F.col("d") > 0, (F.col("n_convs") - 1) * F.col("n")).otherwise(0).alias("own"), "ends_sha256"), "trie")
    shape = tree.select(F.col("conv_id").alias("a"), F.col("depth").alias("b"), F.col("parent_conv_id").alias("pa"),
                        F.when(F.col("depth") > 0, F.col("depth") - 1).alias("pb"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("own").alias("saved_tokens"))
    totals = subtree_totals(shape, ["n_leaves", "saved_tokens"]).select(
        F.col("a").alias("conv_id"), F.col("b").alias("depth"), F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"))
    return tree.join(totals, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: CRC-32 of a number's digits, bit by bit.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii((c::VARCHAR)[i])::BIGINT),
  lambda acc, b: list_reduce([xor(acc, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295)"""

SQL = f"""
WITH own AS (SELECT conv_id AS c, {{'role': coalesce(role, ''), 'said': coalesce(text, '')}} AS t,
                    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
             FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list(t ORDER BY k) AS turns FROM own GROUP BY c),
named AS (SELECT c, turns, c - c % 100 AS root, {_CRC} % 6 AS h FROM lists),
rebuilt AS (SELECT a.c, coalesce(list_slice(r.turns, 1, a.h), list_slice(a.turns, 1, 0)) || list_slice(a.turns, a.h + 1, len(a.turns)) AS turns
            FROM named a LEFT JOIN lists r ON r.c = a.root),
prefixes AS (SELECT c, d, list_slice(turns, 1, d) AS p, len(turns) AS n FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
          FROM prefixes GROUP BY d, p),
kids AS (SELECT d - 1 AS d, list_slice(p, 1, d - 1) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, CASE WHEN nodes.d > 0 THEN (n_convs - 1) * length(nodes.p[nodes.d].said) ELSE 0 END AS own
               FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.p = nodes.p),
up AS (SELECT u, list_slice(p, 1, u) AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved
       FROM (SELECT unnest(range(0, d + 1)) AS u, p, n_children, own FROM full_nodes) GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, up.n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN up ON up.u = f.d AND up.p = f.p
LEFT JOIN nodes q ON q.d = f.d - 1 AND q.p = list_slice(f.p, 1, f.d - 1)
"""
