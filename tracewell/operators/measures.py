"""Similarity measures of pairs of traces.

Set and vector measures join sparse features on their terms. Alignment measures are dynamic
programs over two frame arrays: nested aggregates in the JVM for short traces, or kernels over
diagonals, whose time is linear in cells. They run only for pairs that share a frame, since all
others have a value that follows from their lengths. Where a measure is not
symmetric, arguments are in the order in which the study calls it (i is the row, j the other).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewell.functions import text as T
from tracewell.operators import features as X, kernels, pairs as P
from tracewell.storage import stored

# ---- sets and vectors


def set_overlap(items: DataFrame) -> DataFrame:
    """(i, j, o): number of shared distinct items of rows (id, item)."""
    one = items.distinct()
    return one.select(F.col("id").alias("i"), "item").join(one.select(F.col("id").alias("j"), "item"), "item").where("i < j").groupBy("i", "j").agg(F.count("*").alias("o"))


def jaccard(items: DataFrame, n: int) -> DataFrame:
    """(i, j, sim) of the item sets of ids 0..n-1; null where both are empty."""
    sizes = items.distinct().groupBy("id").agg(F.count("*").alias("size"))
    found = P.filled(n, set_overlap(items), "o", 0)
    found = found.join(sizes.select(F.col("id").alias("i"), F.col("size").alias("a")), "i", "left").join(sizes.select(F.col("id").alias("j"), F.col("size").alias("b")), "j", "left")
    union = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)) - F.col("o")
    return found.select("i", "j", F.try_divide(F.col("o").cast("double"), union.cast("double")).alias("sim"))


def cosine(weights: DataFrame, n: int) -> DataFrame:
    """(i, j, sim) of sparse vectors (id, term, w) of ids 0..n-1; null where one is zero."""
    w = weights.select("id", "term", F.col("w").cast("double").alias("w"))
    norms = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = w.select(F.col("id").alias("i"), "term", F.col("w").alias("a")).join(w.select(F.col("id").alias("j"), "term", F.col("w").alias("b")), "term").where("i < j")
    dots = dots.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    found = P.filled(n, dots, "dot", 0.0)
    found = found.join(norms.select(F.col("id").alias("i"), F.col("norm").alias("a")), "i", "left").join(norms.select(F.col("id").alias("j"), F.col("norm").alias("b")), "j", "left")
    return found.select("i", "j", F.try_divide(F.col("dot"), F.col("a") * F.col("b")).alias("sim"))


def dense_cosine(rows: DataFrame) -> DataFrame:
    """(i, j, sim) of all pairs i < j of dense vectors (id, v); null where one is zero."""
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    prepared = rows.select("id", F.col("v").cast("array<double>").alias("v")).withColumn("norm", norm(F.col("v")))
    dot = F.aggregate(F.zip_with("v_i", "v_j", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return P.upper_triangle(prepared).select("i", "j", F.try_divide(dot, F.col("norm_i") * F.col("norm_j")).alias("sim"))


# ---- alignments; x and y are columns of frame arrays

_TABLE = "element_at(aggregate(sequence(1, size(x)), {first}, (up, i) -> aggregate(sequence(1, size(y)), array({left}), (row, j) -> array_append(row, {cell}))), -1)"


def _program(first: str, left: str, cell: str) -> str:
    """A dynamic program's last value. In a cell: up[j - 1], up[j] and row[j - 1] are its neighbours, x and y count from 0."""
    return _TABLE.format(first=first, left=left, cell=cell)


_EDITS = _program("cast(sequence(0, size(y)) as array<int>)", "i", "least(get(up, j - 1) + if(get(x, i - 1) = get(y, j - 1), 0, 1), get(up, j) + 1, get(row, j - 1) + 1)")
_PDM = _program("array_repeat(0D, size(y) + 1)", "0D", "greatest(get(up, j - 1) + if(get(x, i - 1) = get(y, j - 1), exp(-{c} * (least(i, j) - 1)) * exp(-{o} * abs(i - j)), 0D), get(up, j), get(row, j - 1))")
_GLOBAL = _program("transform(sequence(0, size(y)), k -> cast(-{gap} * k as double))", "cast(-{gap} * i as double)", "greatest(get(up, j - 1) + if(get(x, i - 1) = get(y, j - 1), {match}D, -{mismatch}D), get(up, j) - {gap}, get(row, j - 1) - {gap})")
_BRODIE = _program(
    "array_repeat(0D, size(y) + 1)", "0D",
    "greatest(get(up, j - 1) + if(get(x, i - 1) = get(y, j - 1), (1 - get(px, i - 1)) * (1 - (i - 1) / size(x)) * exp(-abs(i - j) / 2), -1D), get(up, j), get(row, j - 1))")
_WEIGHTED = _program(
    "transform(sequence(0, size(y)), k -> aggregate(slice(wy, 1, k), 0D, (a, w) -> a + w))", "aggregate(slice(wx, 1, i), 0D, (a, w) -> a + w)",
    "if(get(x, i - 1) = get(y, j - 1), get(up, j - 1), least(get(wx, i - 1) + get(wy, j - 1) + get(up, j - 1), get(wx, i - 1) + get(up, j), get(wy, j - 1) + get(row, j - 1)))")


def levenshtein_sql() -> str:
    return f"1 - {_EDITS} / greatest(size(x), size(y))"


def pdm_sql(c: float = 0.1, o: float = 0.1) -> str:
    table = _PDM.format(c=c, o=o)
    return f"if(x = y, 1D, {table} / aggregate(sequence(0, least(size(x), size(y))), 0D, (a, i) -> a + exp(-{c} * i)))"


def nw_sql(match: float = 1, mismatch: float = 1, gap: float = 1) -> str:
    return f"{_GLOBAL.format(match=match, mismatch=mismatch, gap=gap)} / greatest(size(x), size(y))"


def prefix_sql() -> str:
    """Place of the first mismatch over the longer length; 0 if there is none within the shorter one."""
    return "greatest(coalesce(array_position(zip_with(slice(x, 1, least(size(x), size(y))), slice(y, 1, least(size(x), size(y))), (a, b) -> a = b), false), 0) - 1, 0) / greatest(size(x), size(y))"


def brodie_sql() -> str:
    """px and py: shares of the frames of x and y. Both self-weights place frames by the length of x."""
    weight = lambda p: f"aggregate(transform({p}, (s, k) -> (1 - s) * (1 - k / size(x))), 0D, (a, w) -> a + w)"
    return f"try_divide({_BRODIE}, greatest({weight('px')}, {weight('py')}))"


def lerch_sql(a: str = "x", b: str = "y", idf: str = "gx") -> str:
    """Frames of the first trace, weighted by idf squared and the root of their counts in the second."""
    count = lambda where: f"sqrt(size(filter({where}, f -> f = t.f)))"
    term = f"transform(arrays_zip({a}, {idf}), t -> named_struct('f', t.{a}, 'g', t.{idf} * t.{idf}))"
    score = f"aggregate({term}, 0D, (s, t) -> s + {count(b)} * t.g)"
    most = f"aggregate({term}, 0D, (s, t) -> s + if({count(b)} > 0, {count(b)}, {count(a)}) * t.g)"
    return f"try_divide({score}, {most})"


def moroo_sql(alpha: float = 0.5, lerch: str = "lerch", pdm: str = "pdm") -> str:
    return f"if({lerch} = 0 and {pdm} = 0, 0D, {lerch} * {pdm} / ({alpha} * {pdm} + (1 - {alpha}) * {lerch}))"


def stack_weights_sql(idf: str, alpha: float, beta: float, gamma: float) -> str:
    """Weights by place and by idf; an unknown frame has a null idf."""
    return f"transform({idf}, (g, k) -> 1 / pow(1 + k, {alpha}) * if(g is null, 1 / (1 + exp({beta * gamma}D)), 1 / (1 + exp(-{beta} * (g - {gamma})))))"


def tracesim_sql() -> str:
    total = "(aggregate(wx, 0D, (a, w) -> a + w) + aggregate(wy, 0D, (a, w) -> a + w))"
    return f"if({total} = 0, 0D, 1 - if(size(x) = 0 or size(y) = 0, 0D, {_WEIGHTED}) / {total})"


def normalized(frames: DataFrame) -> DataFrame:
    return frames.select("id", F.transform("frames", T.normalized_frame).alias("frames"))


def with_statistics(frames: DataFrame, statistics: DataFrame, n_docs: int) -> DataFrame:
    """frames (id, frames) with p (shares, 0 for unknown frames), g (idf, that of a single occurrence for unknown ones) and known (idf or null)."""
    items = frames.select("id", F.posexplode("frames").alias("pos", "term")).join(statistics.select("term", "idf", "share"), "term", "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", "term", "idf", "share")))
    return items.groupBy("id").agg(listed.alias("f")).select(
        "id", F.col("f.term").alias("frames"), F.transform("f", lambda x: F.coalesce(x["share"], F.lit(0.0))).alias("p"),
        F.transform("f", lambda x: F.coalesce(x["idf"], 1 + F.log(F.lit(float(n_docs))))).alias("g"), F.col("f.idf").alias("known"))


def _near(frames: DataFrame, swapped: bool, prepare: dict[str, str] | None) -> DataFrame:
    """(i, j, x, y, further arrays) of pairs that share a frame, and the columns of `prepare`."""
    others = [c for c in frames.columns if c not in ("id", "frames")]
    near = P.sharing(frames.select("id", F.explode("frames").alias("item")))
    for side, row in zip("xy", "ji" if swapped else "ij"):
        near = near.join(frames.select(F.col("id").alias(row), F.col("frames").alias(side), *(F.col(c).alias(f"{c}{side}") for c in others)), row)
    for name, sql in (prepare or {}).items():
        near = near.withColumn(name, F.expr(sql))
    return near


def _every(near: DataFrame, frames: DataFrame, n: int, default: str) -> DataFrame:
    """(i, j, sim) of all pairs of ids 0..n-1: that of near (i, j, sim), and the default for others."""
    near = near.withColumn("_done", F.lit(1))
    every = P.all_indices(n, frames.sparkSession).join(near, ["i", "j"], "left")
    if "size" in default:
        sizes = frames.select("id", F.size("frames").alias("size"))
        every = every.join(sizes.select(F.col("id").alias("i"), F.col("size").alias("size_i")), "i").join(sizes.select(F.col("id").alias("j"), F.col("size").alias("size_j")), "j")
    return every.select("i", "j", F.when(F.col("_done") == 1, F.col("sim")).otherwise(F.expr(default)).alias("sim"))


def aligned(frames: DataFrame, value_sql: str, n: int, default: str, swapped: bool = False, prepare: dict[str, str] | None = None) -> DataFrame:
    """(i, j, sim) of all pairs of ids 0..n-1: value_sql for pairs that share a frame, the SQL default for others.

    frames: (id, frames, further arrays). In value_sql x and y are the frames of rows i and j (j and
    i if swapped), and each further array c is cx and cy. prepare: more columns, by SQL, in order.
    """
    near = _near(frames, swapped, prepare)
    return _every(near.select("i", "j", F.expr(value_sql).cast("double").alias("sim")), frames, n, default)


def aligned_by(frames: DataFrame, kernel, n: int, default: str, swapped: bool = False, arrays: tuple[str, ...] = (), prepare: dict[str, str] | None = None, value_sql: str = "value") -> DataFrame:
    """The same by a kernel over diagonals (`kernels`), for long traces: frames travel as numbers of their dictionary.

    arrays: names of further arrays that the kernel reads. prepare: columns by SQL before, of which those that aren't
    such arrays are kept for value_sql, which turns the kernel's value into the measure.
    """
    numbers = X.ranked_frames(frames.select("id", "frames"), X.frame_dictionary(frames)).withColumnRenamed("ranks", "frames")
    others = [c for c in frames.columns if c not in ("id", "frames")]
    ready = stored(numbers.join(frames.select("id", *others), "id") if others else numbers, "numbered")
    keep = tuple(c for c in prepare or {} if c[:-1] not in arrays)
    near = kernels.measured(_near(ready, swapped, prepare), kernel, arrays, keep)
    return _every(near.select("i", "j", F.expr(value_sql).cast("double").alias("sim")), frames, n, default)
