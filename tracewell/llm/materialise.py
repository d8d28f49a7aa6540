"""Token sequences in training order, as fixed-stride binary shards.

Documents are tokenized, ended by one separator token and cut to sequences of a fixed length, the
last one padded. A document has no more tokens than bytes, so a cheap pass over the byte lengths
gives every possible sequence a number below N before anything is tokenized. Number i goes to the
place P(i), where P is a keyed Feistel network over the smallest even number of bits that holds N;
values of N or more go through the network again (cycle walking) until they fall below N, so that
P permutes 0..N-1. Equal ranges of places make the shards, and within a shard the sequences that
exist stand in the order of their places, without gaps. A sequence's slot is its rank: the counts of
the shards before, plus its position, which is byte position * stride of its shard. Tokens thus
move once, from the tokenizer to their shard. Shards are written by one task each under a temporary
name that is moved into place, so a task that runs twice leaves the same file.

Record: document id (int64), number of the sequence in its document (int32), tokens without padding
(int32), then the ids (uint16, or uint32 for large vocabularies), all little-endian.
"""

from __future__ import annotations

import base64
import io
import json
import os
import sys
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.llm.common import chunks, small_batches
from tracewell.storage import shared_dir

ROUNDS = 6
HEADER = np.dtype([("doc_id", "<i8"), ("part", "<i4"), ("tokens", "<i4")])
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stands for a null doc_id in a record.
NO_ID = -(2**63)


def _mixed(x: np.ndarray, key: int, turn: int) -> np.ndarray:
    """A keyed hash of 64-bit integers (the round function)."""
    x = x ^ np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _bits(n: int) -> int:
    """Bits of half a block, for blocks that hold 0..n-1."""
    return max(1, -(-max(1, n - 1).bit_length() // 2))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of sequences index (0..n-1) among n."""
    half = np.uint64(_bits(n))
    mask = np.uint64((1 << _bits(n)) - 1)
    x = np.asarray(index).astype(np.uint64)
    walking = np.arange(len(x))
    while len(walking):
        left, right = x[walking] >> half, x[walking] & mask
        for turn in range(ROUNDS):
            left, right = right, left ^ (_mixed(right, key, turn) & mask)
        x[walking] = (left << half) | right
        walking = walking[x[walking] >= n]
    return x.astype(np.int64)


def unpermute(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """The sequences in slots among n."""
    half = np.uint64(_bits(n))
    mask = np.uint64((1 << _bits(n)) - 1)
    x = np.asarray(slot).astype(np.uint64)
    walking = np.arange(len(x))
    while len(walking):
        left, right = x[walking] >> half, x[walking] & mask
        for turn in reversed(range(ROUNDS)):
            left, right = right ^ (_mixed(left, key, turn) & mask), left
        x[walking] = (left << half) | right
        walking = walking[x[walking] >= n]
    return x.astype(np.int64)


def _encoder(file: bytes):
    """The tokenizer of a rank file, kept by the worker process from task to task."""
    import tiktoken

    kept = sys.__dict__.setdefault("_tracewell_ranks", {})
    key = hash(file)
    if key not in kept:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        kept[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[key]


def capacities(docs: DataFrame, length: int) -> tuple[DataFrame, dict[int, int]]:
    """docs with `most`, the most sequences that a text can have, and their sum in each partition."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("most", F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / length).cast("long") + 1)
    sums = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.sum("most").alias("n")).collect()
    return rows, {r.task: r.n for r in sums}


def sequences(docs: DataFrame, ranks: str, length: int, separator: int, key: int, shard_places: int) -> tuple[DataFrame, int]:
    """(shard, place, doc_id, part, ids), the sequences of docs at their places, ids packed; and the number N of places."""
    with open(ranks, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    rows, sums = capacities(docs, length)
    starts, total = {}, 0
    for task in sorted(sums):
        starts[task], total = total, total + sums[task]
    small = np.dtype("<u2" if separator < 65536 else "<u4")
    schema = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("ids", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        task, encode = TaskContext.get().partitionId(), None
        at = starts.get(task, 0)
        end = at + sums.get(task, 0)
        for rb in batches:
            encode = encode or _encoder(file.value).encode_ordinary
            ids, texts, most = rb.column("doc_id").to_pylist(), rb.column("text").to_pylist(), rb.column("most").to_pylist()
            for a, b in chunks(texts):
                number, out_id, out_part, out = [], [], [], []
                for i in range(a, b):
                    tokens = np.array([*encode(texts[i] or ""), separator], small)
                    for part, first in enumerate(range(0, len(tokens), length)):
                        number.append(at + part)
                        out_id.append(ids[i])
                        out_part.append(part)
                        out.append(tokens[first : first + length].tobytes())
                    at += most[i]
                place = permute(np.array(number, np.int64), total, key)
                yield pa.RecordBatch.from_arrays([pa.array(place // shard_places), pa.array(place), pa.array(out_id, pa.int64()), pa.array(out_part, pa.int32()), pa.array(out, pa.binary())], schema=schema)
        if at != end:
            raise RuntimeError(f"partition {task} holds other rows than when it was counted")

    return rows.mapInArrow(run, "shard long, place long, doc_id long, part int, ids binary"), total


def _files(path: str):
    """(file system, path in it) for a folder; local paths and file: need no more than the standard library."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return None, parts.path or path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(path: str, name: str, blocks) -> None:
    """Write blocks to path/name at once: a reader sees the whole file or none."""
    store, folder = _files(path)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    if store is None:
        os.makedirs(folder, exist_ok=True)
        with open(draft, "wb") as f:
            for b in blocks:
                f.write(b)
        os.replace(draft, f"{folder}/{name}")
    else:
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(draft) as f:
            for b in blocks:
                f.write(b)
        store.move(draft, f"{folder}/{name}")


def _open(path: str, name: str) -> io.IOBase:
    store, folder = _files(path)
    return open(f"{folder}/{name}", "rb") if store is None else store.open_input_file(f"{folder}/{name}")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def record(ids_type: str, length: int) -> np.dtype:
    return np.dtype([*((n, HEADER[n]) for n in HEADER.names), ("ids", ids_type, (length,))])


def write_shards(docs: DataFrame, path: str, ranks: str, length: int = 512, separator: int = 50256, key: int = 20240229, shard_places: int = 32_768) -> dict:
    """Write the sequences of docs (doc_id, text) to shards in folder path, and return their description.

    The description also stands in path/layout.json, with the counts of the shards. Null and empty
    texts are one separator; repeated rows are sequences each; a null doc_id is written as the smallest
    int64; other columns are ignored. An empty table writes no shard. Sequences are numbered by the
    order of the rows in docs' partitions, which must be the same each time docs is read; the same
    input under the same splits gives the same shards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    placed, places = sequences(docs, ranks, length, separator, key, shard_places)
    layout = {"length": length, "separator": separator, "key": key, "places": places, "shard_places": shard_places, "ids": "<u2" if separator < 65536 else "<u4"}
    kind = record(layout["ids"], length)
    layout["stride"] = kind.itemsize

    def write(batches):
        def packed():
            """(shard, slots, records) of runs within one shard."""
            for rb in batches:
                shard = rb.column("shard").to_numpy()
                out = np.zeros(rb.num_rows, kind)
                out["ids"] = separator
                out["doc_id"] = rb.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                out["part"] = rb.column("part").to_numpy()
                for i, x in enumerate(rb.column("ids").to_pylist()):
                    v = np.frombuffer(x, layout["ids"])
                    out["ids"][i, : len(v)], out["tokens"][i] = v, len(v)
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                for a, b in zip(cuts, cuts[1:]):
                    if b > a:
                        yield int(shard[a]), out[a:b]

        runs = packed()
        head = next(runs, None)
        while head is not None:
            shard, count, after = head[0], 0, []

            def blocks():
                nonlocal count
                run = head
                while run is not None and run[0] == shard:
                    count += len(run[1])
                    yield run[1].tobytes()
                    run = next(runs, None)
                after.append(run)

            _write(path, shard_name(shard), blocks())
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([count], pa.int64())], names=["shard", "n"])
            head = after[0]

    shards = -(-places // shard_places)
    ordered = placed.repartition(max(1, min(shards, 10_000)), "shard").sortWithinPartitions("shard", "place")
    counts = [0] * shards
    for r in ordered.mapInArrow(write, "shard long, n long").collect():
        counts[r.shard] = r.n
    layout |= {"sequences": sum(counts), "counts": counts}
    _write(path, "layout.json", [json.dumps(layout).encode()])
    return layout


def read_layout(path: str) -> dict:
    with _open(path, "layout.json") as f:
        return json.loads(f.read())


def read_sequences(path: str, start: int = 0, count: int | None = None):
    """(slot, doc_id, part, ids without padding) from slot start on, in order, by one seek and then sequential reads."""
    layout = read_layout(path)
    kind, ends = record(layout["ids"], layout["length"]), np.cumsum(layout["counts"])
    end = layout["sequences"] if count is None else min(layout["sequences"], start + count)
    while start < end:
        shard = int(np.searchsorted(ends, start, side="right"))
        stop, before = min(end, int(ends[shard])), int(ends[shard]) - layout["counts"][shard]
        with _open(path, shard_name(shard)) as f:
            f.seek((start - before) * kind.itemsize)
            for slot in range(start, stop):
                r = np.frombuffer(f.read(kind.itemsize), kind)[0]
                yield slot, None if r["doc_id"] == NO_ID else int(r["doc_id"]), int(r["part"]), r["ids"][: r["tokens"]]
        start = stop


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, part, n_tokens, ids) of all records in folder path, one task a shard at most; ids packed."""
    layout = read_layout(path)
    kind, counts = record(layout["ids"], layout["length"]), layout["counts"]
    before = spark.sparkContext.broadcast(np.concatenate(([0], np.cumsum(counts))).astype(np.int64))
    names = ["slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "ids"]

    def run(batches):
        for rb in batches:
            for shard in rb.column("id").to_pylist():
                first, last = before.value[shard], before.value[shard + 1]
                if first == last:
                    continue
                with _open(path, shard_name(shard)) as f:
                    at = 0
                    while block := f.read(kind.itemsize * 1024):
                        r = np.frombuffer(block, kind)
                        place = np.arange(at, at + len(r), dtype=np.int64)
                        ids = [x[:n].tobytes() for x, n in zip(r["ids"], r["tokens"])]
                        doc = pa.array(r["doc_id"].astype(np.int64), mask=r["doc_id"] == NO_ID)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(first + place), pa.array(np.full(len(r), shard, np.int64)), pa.array(place * kind.itemsize), doc, pa.array(r["part"].astype(np.int32)), pa.array(r["tokens"].astype(np.int64)), pa.array(ids, pa.binary())], names=names)
                        at += len(r)

    return spark.range(0, len(counts), 1, max(1, min(len(counts), 10_000))).mapInArrow(run, "slot long, shard long, byte_offset long, doc_id long, part int, n_tokens long, ids binary")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
