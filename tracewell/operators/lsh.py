"""Hash vectors, band and slot indexes over them, and lookups by equi-joins."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions import hashing as H
from tracewell.storage import shipped, stored

#: The prime by which the MinHash permutations count: ranks up to it get places of their own, and a product fits a long.
MINHASH_PRIME = 2**31 - 1
SLOTS, SLOT_BITS = 8, 8
#: Rows of a bucket that one task looks up, and tasks for each core, over which buckets are dealt.
HOT, TASKS_PER_CORE = 4096, 8
# The 64-bit FNV-1a offset basis and prime.
FNV_START, FNV_PRIME = np.uint64(H.FNV_HIGH << 32 | H.FNV_LOW), np.uint64(2**40 + 435)


def sign_hash(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, h): vectors as arrays of 1 and -1."""
    return vectors.select(F.col(id_col).alias("id"), H.binarized(F.col(column)).alias("h"))


def bands(hashes: DataFrame, count: int, width: int, bits: int = 1) -> DataFrame:
    """(id, band, key): each hash cut to `count` bands of width * bits components."""
    size = width * bits
    keys = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.array_join(F.transform(F.slice("h", i * size + 1, size), lambda x: x.cast("string")), ""))
    return hashes.select("id", F.posexplode(keys).alias("band", "key"))


def grid_bands(hashes: DataFrame, grid: list[tuple[int, int]], bits: int = 1) -> DataFrame:
    """(g, bands, width, id, band, key) for all settings of a grid in one table."""
    parts = [bands(hashes, n, k, bits).select(F.lit(g).alias("g"), F.lit(n).alias("bands"), F.lit(k).alias("width"), "id", "band", "key") for g, (n, k) in enumerate(grid)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def buckets(banded: DataFrame, least: int = 2) -> DataFrame:
    """banded's rows in buckets of `least` rows or more."""
    by = [c for c in banded.columns if c != "id"]
    if least <= 1:
        return banded
    return banded.join(banded.groupBy(by).count().where(F.col("count") >= least).drop("count"), by, "left_semi")


def grouped_buckets(banded: DataFrame, least: int = 2) -> DataFrame:
    """Buckets with their sorted ids."""
    by = [c for c in banded.columns if c != "id"]
    return buckets(banded, least).groupBy(by).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def candidates(banded: DataFrame, least: int = 2) -> DataFrame:
    """Distinct (q, nn) that share a bucket; a row is its own candidate if it shares one with another. Grid columns stay."""
    held = buckets(banded, least)
    by = [c for c in held.columns if c != "id"]
    out = [c for c in by if c not in ("band", "key")]
    return held.select(*by, F.col("id").alias("q")).join(held.select(*by, F.col("id").alias("nn")), by).select(*out, "q", "nn").distinct()


def sign_codes(hashes: DataFrame) -> DataFrame:
    """(id, bits, known): of the first 64 components of hashes (id, h), which are 1 and which are there, as bits of longs; null hashes are left out."""
    first = F.slice("h", 1, 64)
    place = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    packed = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a.bitwiseOR(y))
    bits = packed(F.transform(first, lambda x, i: F.when(x > 0, place(i)).otherwise(F.lit(0).cast("long"))))
    return hashes.where("h is not null").select("id", bits.alias("bits"), packed(F.transform(first, lambda x, i: place(i))).alias("known"))


def _masks(count: int, width: int) -> list[int]:
    """The bits of each band, as signed 64-bit numbers."""
    if count * width > 64:
        raise ValueError("codes have 64 bits")
    part = (((1 << width) - 1) << b * width for b in range(count))
    return [m - (1 << 64) if m >> 63 else m for m in part]


def code_candidates(hashes: DataFrame, count: int, width: int) -> DataFrame:
    """`candidates` of sign hashes (id, h) in `count` bands of `width` components, told apart where they meet.

    A pair is given in the first band that it shares, so that only codes are shuffled and no pair is. Pairs of ids that
    come in several rows are made distinct afterwards. Rows of a bucket beyond HOT are dealt to several tasks.
    """
    masks = _masks(count, width)
    codes = sign_codes(hashes).groupBy("id").agg(F.collect_list(F.struct("bits", "known")).alias("x")).select("id", (F.size("x") > 1).alias("many"), F.explode("x").alias("x")).select("id", "many", "x.bits", "x.known")
    each = F.array(*(F.struct(F.lit(b).alias("band"), F.col("bits").bitwiseAND(F.lit(m)).alias("b_bits"), F.col("known").bitwiseAND(F.lit(m)).alias("b_known")) for b, m in enumerate(masks)))
    rows = stored(codes.select("*", F.explode(each).alias("e")).select("id", "many", "bits", "known", "e.*"), "codes")
    by = ["band", "b_bits", "b_known"]
    sizes = rows.groupBy(by).agg(F.count("*").alias("n")).where("n > 1").select(*by, F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    held = rows.join(sizes, by)
    asked = held.select(*by, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("q"), F.col("many").alias("q_many"), F.col("bits").alias("q_bits"), F.col("known").alias("q_known"))
    met = held.select(*by, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("nn"), F.col("many").alias("nn_many"), F.col("bits").alias("nn_bits"), F.col("known").alias("nn_known"))
    differ = F.col("q_bits").bitwiseXOR(F.col("nn_bits")).bitwiseOR(F.col("q_known").bitwiseXOR(F.col("nn_known")))
    fresh = F.col("q") != F.col("nn")
    for b, m in enumerate(masks[:-1]):
        fresh &= (F.col("band") <= b) | (differ.bitwiseAND(F.lit(m)) != 0)
    # the work of a task grows with its pairs, not its bytes
    tasks = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    dealt = lambda df: df.repartition(tasks, *by, "part")
    pairs = lambda x, y: dealt(x).join(dealt(y).hint("merge"), [*by, "part"]).where(fresh).select("q", "nn")
    once = pairs(asked.where("not q_many"), met.where("not nn_many"))
    alone = held.select(F.col("id").alias("q")).distinct().select("q", F.col("q").alias("nn"))
    found = once.union(alone)
    if rows.where("many").take(1):
        found = found.union(pairs(asked.where("q_many"), met).union(pairs(asked.where("not q_many"), met.where("nn_many"))).distinct())
    return found


def lookup(queries: DataFrame, index: DataFrame, form: Callable[[Column], Column] = lambda ids: ids) -> DataFrame:
    """(q, band, ids): for each query (id, band, key), band by band, the rows of an index (id, band, key) in its bucket, as `form` makes them of the sorted list.

    A bucket is listed once, and queries take the list of theirs; lists are merged only for ids that come with several keys in a band.
    """
    listed = lambda c: form(F.array_sort(F.collect_list(c))).alias("ids")
    held = index.groupBy("band", "key").agg(listed("id"))
    asked = stored(queries.withColumnRenamed("id", "q").groupBy("q", "band").agg(F.collect_list("key").alias("keys")), "asked")
    # sorted by bucket, so that a list stands in a run of rows
    found = asked.where(F.size("keys") == 1).select("q", "band", F.col("keys")[0].alias("key")).join(held.hint("merge"), ["band", "key"]).select("q", "band", "ids")
    several = asked.where(F.size("keys") > 1)
    if several.take(1):
        hits = several.select("q", "band", F.explode("keys").alias("key")).join(index, ["band", "key"])
        found = found.union(hits.groupBy("q", "band").agg(listed("id")))
    return found


def bucket_lists(index: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """An index (id, band, key, *more) as lists (band, key, *more, part, ids) of HOT ids or so, and (band, key, parts) of the buckets of several parts."""
    by = ["band", "key"]
    hot = index.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(*by, F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    dealt = index.join(hot, by, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int"))
    return dealt.groupBy(*by, *more, "part").agg(F.collect_list("id").alias("ids")), hot


def in_lists(queries: DataFrame, lists: DataFrame, hot: DataFrame) -> DataFrame:
    """queries (id, band, key) as q, with each list of `bucket_lists` of their buckets; queries of a large bucket go to the tasks of its parts. Lists stay whole, so that pairs are made last."""
    # the work of a task grows with its pairs, not its bytes
    tasks = TASKS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism
    parted = queries.withColumnRenamed("id", "q").where("key is not null").join(hot, ["band", "key"], "left")
    asked = parted.select("q", "band", "key", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    by = ["band", "key", "part"]
    return asked.repartition(tasks, *by).join(lists.repartition(tasks, *by).hint("merge"), by)


def without_candidates(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Queries (id, ...) for which nothing was found."""
    return queries.join(found.select(F.col("q").alias("id")).distinct(), "id", "left_anti")


def permutations(count: int, seed: int = 1) -> list[tuple[int, int]]:
    """(a, b) of the permutations r -> (a r + b) mod MINHASH_PRIME."""
    return [((seed * 7919 + 1103515245 * (k + 1)) % (MINHASH_PRIME - 1) + 1, (seed * 31 + 1140671485 * (k + 1)) % MINHASH_PRIME) for k in range(count)]


def minhash(ranked: DataFrame, count: int = 64, seed: int = 1) -> DataFrame:
    """(id, sig) of rows (id, rank): for each permutation the smallest place of a term; ids without terms have no row.

    Only ranks are gathered by id; an id's places are worked out in its task.
    """
    places = permutations(count, seed)

    def run(batches):
        for rb in batches:
            held = rb.column("ranks")
            sizes, ranks = held.value_lengths().to_numpy(zero_copy_only=False), held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sig = np.empty((len(sizes), count), np.int32)
            if len(sizes):
                starts = np.cumsum(sizes) - sizes
                for k, (a, b) in enumerate(places):
                    sig[:, k] = np.minimum.reduceat((a * ranks + b) % MINHASH_PRIME, starts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * count, pa.int32()), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([rb.column("id"), lists], names=["id", "sig"])

    held = ranked.where("rank is not null").groupBy("id").agg(F.collect_list("rank").alias("ranks"))
    return held.mapInArrow(run, f"id {ranked.schema['id'].dataType.simpleString()}, sig array<int>")


def minhash_bits(signatures: DataFrame) -> DataFrame:
    """(id, h): signatures as bits, the low 16 of each value, most significant first."""
    each = F.transform("sig", lambda v: F.array(*(F.shiftright(v, 15 - i).bitwiseAND(F.lit(1)) for i in range(16))))
    return signatures.select("id", F.flatten(each).alias("h"))


def simhash(weights: DataFrame, symmetric: bool = False) -> DataFrame:
    """(id, code): 64 bits of rows (id, term, w). A set bit of a term's hash adds its weight, a clear bit subtracts 1 (or the weight, if symmetric); a sum of 0 gives 0."""
    hashed = weights.select("term").distinct().withColumn("f", H.fnv1a64(F.col("term")))
    rows = weights.join(hashed, "term")
    bit = lambda k: F.shiftright(F.col("f.hi" if k < 32 else "f.lo"), 31 - k % 32).bitwiseAND(1) == 1
    sums = [F.sum(F.when(bit(k), F.col("w")).otherwise(-F.col("w") if symmetric else F.lit(-1.0))).alias(f"s{k}") for k in range(64)]
    return rows.groupBy("id").agg(*sums).select("id", F.array(*(F.when(F.col(f"s{k}") > 0, 1).otherwise(0) for k in range(64))).alias("code"))


def fnv1a64(terms: list[bytes]) -> np.ndarray:
    """FNV-1a hashes; all terms advance byte by byte, the longest first, so that those still running are a prefix."""
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    order = np.argsort(-sizes, kind="stable")
    flat, starts = np.frombuffer(b"".join(terms), np.uint8).astype(np.uint64), (np.cumsum(sizes) - sizes)[order]
    running = len(terms) - np.cumsum(np.bincount(sizes, minlength=1))  # how many are longer than 0, 1, 2, ... bytes
    h = np.full(len(terms), FNV_START, np.uint64)
    for j, n in enumerate(running[running > 0].tolist()):
        h[:n] = (h[:n] ^ flat[starts[:n] + j]) * FNV_PRIME
    out = np.empty_like(h)
    out[order] = h
    return out


def simhash_rows(rows: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(id, code): `simhash` of rows (id, counts), an array of structs (term, n) each, hashed in their tasks; nothing is shuffled. Rows without terms are left out.

    vocabulary: the terms (term) that count, bounded, as they are sent to all tasks; others are left out.
    """
    known = shipped(rows.sparkSession, vocabulary.select("term").distinct().toArrow().column("term").combine_chunks()) if vocabulary is not None else None

    def run(batches):
        kept = known() if known else None
        for rb in batches:
            held = rb.column("counts")
            sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            terms, n = held.flatten().field("term").dictionary_encode(), held.flatten().field("n").to_numpy(zero_copy_only=False)
            at, owner = terms.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
            if kept is not None:
                some = pc.is_in(terms.dictionary, kept).to_numpy(zero_copy_only=False)[at]
                at, owner, n = at[some], owner[some], n[some]
                sizes = np.bincount(owner, minlength=len(sizes))
            h = fnv1a64([t.encode() for t in terms.dictionary.to_pylist()])
            # a set bit adds n and a clear one subtracts 1
            sums = [np.bincount(owner, (n + 1) * ((h >> np.uint64(63 - k)) & np.uint64(1)).astype(np.int64)[at], minlength=len(sizes)) - sizes for k in range(64)]
            code = (np.stack(sums, 1) > 0).astype(np.int32)
            some = pa.array(np.flatnonzero(sizes))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * 64, pa.int32()), pa.array(code[sizes > 0].ravel()))
            yield pa.RecordBatch.from_arrays([rb.column("id").take(some), lists], names=["id", "code"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, code array<int>")


def slots(codes: DataFrame) -> DataFrame:
    """(id, slot, val): codes as slots of eight bits."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.aggregate(F.slice("code", i * SLOT_BITS + 1, SLOT_BITS), F.lit(0), lambda a, b: a * 2 + b))
    return codes.select("id", F.posexplode(keys).alias("slot", "val"))


def agreeing_slots(codes: DataFrame) -> DataFrame:
    """(q, nn, agree) of different rows that agree in one slot or more.

    Two rows share a bucket of some combination of c slots exactly if they agree in c slots or more.
    """
    s = slots(codes)
    return s.select(F.col("id").alias("q"), "slot", "val").join(s.select(F.col("id").alias("nn"), "slot", "val"), ["slot", "val"]).where("q <> nn").groupBy("q", "nn").agg(F.count("*").cast("int").alias("agree"))


def slot_lookup(queries: DataFrame, held: DataFrame, least: int) -> DataFrame:
    """(q, nn, agree): for codes of queries the held codes that agree with them in `least` slots or more; ids don't repeat on either side.

    A pair is given in the first slot that it shares, and its slots are compared there, so that no pair is shuffled.
    """

    def placed(codes: DataFrame, name: str) -> DataFrame:
        return slots(codes).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", "val"))).alias("x")).select(F.col("id").alias(name), F.transform("x", lambda x: x["val"]).alias(f"{name}_vals"))

    # a pair that agrees in enough slots agrees in one of the first
    first = lambda df, *c: df.select(*c, F.posexplode(F.slice(c[1], 1, SLOTS - least + 1)).alias("slot", "val"))
    hits = first(placed(queries, "q"), "q", "q_vals").join(first(placed(held, "nn"), "nn", "nn_vals"), ["slot", "val"])
    same = [F.col("q_vals")[k] == F.col("nn_vals")[k] for k in range(SLOTS)]
    fresh = F.lit(True)
    for k in range(SLOTS - least):
        fresh &= (F.col("slot") <= k) | ~same[k]
    agree = sum((x.cast("int") for x in same), F.lit(0))
    return hits.where(fresh & (agree >= least)).select("q", "nn", agree.alias("agree"))


def slot_grid() -> list[tuple[int, int, int]]:
    """(c, bands, width) of the slot combinations, most slots first."""
    return [(c, math.comb(SLOTS, c), SLOT_BITS * c) for c in range(SLOTS, 0, -1)]


def slot_candidates(codes: DataFrame) -> DataFrame:
    """(g, bands, width, q, nn) for all numbers c of slots, most slots first."""
    agree = agreeing_slots(codes)
    out = None
    for g, (c, n, k) in enumerate(slot_grid()):
        part = agree.where(F.col("agree") >= c).select(F.lit(g).alias("g"), F.lit(n).alias("bands"), F.lit(k).alias("width"), "q", "nn")
        out = part if out is None else out.union(part)
    return out


def segment_hamming(a: Column, b: Column, size: int) -> Column:
    """Share of segments of `size` components in which two hashes agree throughout."""
    part = F.transform(F.sequence(F.lit(0), (F.size(a) / size).cast("int") - 1), lambda i: F.when(F.slice(a, i * size + 1, size) == F.slice(b, i * size + 1, size), 1).otherwise(0))
    return F.aggregate(part, F.lit(0), lambda s, x: s + x) * size / F.size(a)


def soft_hamming(a: Column, b: Column, size: int) -> Column:
    """1 minus the mean over segments of half the largest difference."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))
    part = F.transform(F.sequence(F.lit(0), (F.size(a) / size).cast("int") - 1), lambda i: F.array_max(F.slice(gaps, i * size + 1, size)))
    return 1 - F.aggregate(part, F.lit(0.0), lambda s, x: s + x) * size / (F.size(a) * 2)


def collision_curve(spark, grid: list[tuple[int, int]], points: int = 100) -> DataFrame:
    """(bands, width, s, p): chance of a common bucket on an even grid of similarities from 0 to 1."""
    settings = F.explode(F.array(*(F.struct(F.lit(n).alias("bands"), F.lit(k).alias("width")) for n, k in grid)))
    rows = spark.range(points).select((F.col("id") / (points - 1)).alias("s"), settings.alias("x"))
    return rows.select("x.bands", "x.width", "s", H.collision(F.col("s"), F.col("x.bands"), F.col("x.width")).alias("p"))


def top_k(candidates_: DataFrame, sims: DataFrame, k: int) -> DataFrame:
    """(q, rank, nn, s): the k most similar candidates of each query, ties to the smaller nn."""
    w = Window.partitionBy("q").orderBy(F.desc("s"), "nn")
    return candidates_.where("q <> nn").join(sims, ["q", "nn"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "rank", "nn", "s")
