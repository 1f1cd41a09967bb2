"""Token-ID output (operator 3): flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by id; each task encodes its range and writes one shard:

* ``NNNNN.u16``  token ids, unsigned little-endian, documents one after another (``.u32`` where the
  vocabulary has more than 65,536 ids)
* ``NNNNN.len``  ids per document, 64-bit
* ``NNNNN.doc``  document ids, 64-bit (a null id is the smallest 64-bit integer)
* ``NNNNN.idx``  ids of all documents of all shards before each document, 64-bit, and the end

A shard's base is the prefix sum of the shards before it (one number a shard, never one a
document). A file is written under the attempt's own name and then moved, so a task that runs
again replaces it by the same bytes. Reading maps the files into memory.

Null text is empty (only the end id). Repeated ids are documents of their own, in no fixed order
among themselves; extra columns are ignored; an empty table gives no documents.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall.llm import common as C
from pitwall.session import scratch_path

READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
NULL_ID = -(2**63)
#: A single space between other characters begins a new piece in the tokenizer, so texts part there.
_PART = re.compile(r"(?<=\S) (?=\S)")
#: Texts without these part at plain spaces and line feeds.
_ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LATIN = frozenset(chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7))


class _Memory:
    """Ids of parts, in two generations of at most ``keep`` parts each."""

    def __init__(self, lead: str, keep: int):
        self.lead, self.keep, self.young, self.old = lead, keep, {}, {}

    def learn(self, found: set[str], encode) -> None:
        if len(self.young) > self.keep:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = [x for x in found if x not in young]
        new, marked = set(), []
        for x in missing:
            if x in old:
                young[x] = old[x]
            elif x[-1:] in (".", ",") and x[-2:-1] in _LATIN:
                # a piece of letters ends before a comma or full stop
                marked.append(x)
                if x[:-1] not in young:
                    new.add(x[:-1])
            else:
                new.add(x)
        new = list(new)
        for i in range(0, len(new), 20_000):
            some = new[i:i + 20_000]
            young.update(zip(some, encode([self.lead + x for x in some])))
        if marked:
            sign = dict(zip(".,", encode([".", ","])))
            for x in marked:
                young[x] = young[x[:-1]] + sign[x[-1]]


class CachedEncoder:
    """Ids of a text by the tokenizers library; its parts are encoded once each and remembered.

    Parts end where the tokenizer's own pattern always ends a piece: before a single space, and
    around a single line feed, between other characters."""

    def __init__(self, path: str, keep: int = 700_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "H" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.spaced, self.first = _Memory(" ", keep), _Memory("", keep // 4)
        self.feed = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as unsigned 16-bit integers where the vocabulary allows it, else 32-bit."""
        parted = []
        for t in texts:
            if _ODD.search(t) or "  " in t or "\n\n" in t or " \n" in t or "\n " in t or t[:1] in (" ", "\n") or t[-1:] in (" ", "\n"):
                parted.append([_PART.split(t)])
            else:
                parted.append([line.split(" ") for line in t.split("\n")] if t else [])
        self.first.learn({line[0] for lines in parted for line in lines}, self._ids)
        self.spaced.learn(set().union(*(line[1:] for lines in parted for line in lines)), self._ids)
        first, spaced = self.first.young, self.spaced.young.__getitem__
        return [self.feed.join([first[line[0]] + b"".join(map(spaced, line[1:])) for line in lines]) for lines in parted]


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


class _Files:
    """Files of one shard, written under this attempt's names; ``close`` moves them to their own."""

    def __init__(self, root: str, shard: int, kinds: tuple[str, ...]):
        self.fs, base = _store(root)
        tag = uuid.uuid4().hex
        self.names = {k: (f"{base}/.{shard:05d}.{k}.{tag}", f"{base}/{shard:05d}.{k}") for k in kinds}
        self.open = {k: self.fs.open_output_stream(a) for k, (a, _) in self.names.items()}

    def close(self) -> None:
        for k, f in self.open.items():
            f.close()
            self.fs.move(*self.names[k])


def write_tokens(docs: DataFrame, tokenizer: str, root: str | None = None, end_id: int = 0,
                 shards: int | None = None) -> str:
    """Encode ``docs`` (doc_id, text) into shards below ``root`` (by default a new shared folder); returns it."""
    spark = docs.sparkSession
    root = root or scratch_path(spark, "llm", f"tokens-{uuid.uuid4().hex}")
    fs, base = _store(root)
    fs.create_dir(base, recursive=True)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    def run(batches):
        shard, out, n_docs, n_ids = TaskContext.get().partitionId(), None, 0, 0
        enc = encoder(tokenizer)
        end, ids_file = array(enc.kind, [end_id]).tobytes(), "u16" if enc.kind == "H" else "u32"
        for b in batches:
            col = b.column(1)
            for lo in range(0, len(col), 256):
                out = out or _Files(root, shard, (ids_file, "len", "doc"))
                ids = enc.encode([t or "" for t in col.slice(lo, 256).to_pylist()])
                sizes = np.array([len(x) // len(end) + 1 for x in ids], "<i8")
                out.open[ids_file].write(b"".join(x + end for x in ids))
                out.open["len"].write(sizes.tobytes())
                out.open["doc"].write(np.array(b.column(0).slice(lo, 256).fill_null(NULL_ID).to_numpy(), "<i8").tobytes())
                n_docs, n_ids = n_docs + len(ids), n_ids + int(sizes.sum())
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [n_docs], "n_ids": [n_ids]})

    manifest = C.stored(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
                        .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
                        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
                        .mapInArrow(run, "shard int, n_docs long, n_ids long"), "token-shards")
    rows = sorted((r.shard, r.n_docs, r.n_ids) for r in manifest.collect())  # one row a shard
    base_of, total = {}, 0
    for shard, _, ids in rows:
        base_of[shard], total = total, total + ids

    def index(batches):
        for b in batches:
            for shard, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lens = np.frombuffer(_read(root, shard, "len"), "<i8")
                out = _Files(root, shard, ("idx",))
                out.open["idx"].write((first + np.concatenate([[0], np.cumsum(lens)])).astype("<i8").tobytes())
                out.close()
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32())})

    if rows:
        C.stored(_shards(spark, [(s, base_of[s]) for s, _, _ in rows]).mapInArrow(index, "shard int"), "token-index")
    return root


def _shards(spark: SparkSession, rows: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "shard int, base long").repartition(len(rows))


def _read(root: str, shard: int, kind: str):
    """The file's bytes, mapped into memory where the file system allows it."""
    fs, base = _store(root)
    path = f"{base}/{shard:05d}.{kind}"
    if isinstance(fs, pafs.LocalFileSystem):
        import os
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else b""
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def read_tokens(spark: SparkSession, root: str) -> DataFrame:
    """One row per document, from the files: READ_SCHEMA."""
    fs, base = _store(root)
    files = [x.base_name for x in fs.get_file_info(pafs.FileSelector(base))]
    found = [int(m[1]) for x in files if (m := re.fullmatch(r"(\d+)\.idx", x))]
    width = 2 if any(x.endswith(".u16") for x in files) else 4
    if not found:
        return spark.createDataFrame([], READ_SCHEMA)

    def run(batches):
        for b in batches:
            for shard in b.column(0).to_pylist():
                ids = np.frombuffer(_read(root, shard, f"u{8 * width}"), f"<u{width}")
                at = np.frombuffer(_read(root, shard, "idx"), "<i8")
                doc = np.frombuffer(_read(root, shard, "doc"), "<i8")
                for lo in range(0, len(doc), 4096):
                    some, cut = doc[lo:lo + 4096], at[lo:lo + 4097]
                    here = (cut - at[0]).tolist()
                    crc = [zlib.crc32(ids[i:j].astype("<u4")) for i, j in zip(here[:-1], here[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, mask=some == NULL_ID), pa.array(cut[:-1]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _shards(spark, [(s, 0) for s in found]).mapInArrow(run, READ_SCHEMA)
