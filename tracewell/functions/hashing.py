"""Column expressions for hash bits, pair numbers and collision probabilities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 64-bit FNV-1a offset basis as two 32-bit halves, and its prime 2**40 + 435.
FNV_HIGH, FNV_LOW, FNV_FACTOR = 3421674724, 2216829733, 435
LOW_32 = (1 << 32) - 1


def fnv1a64(text: Column) -> Column:
    """FNV-1a hash of the UTF-8 bytes, as a struct (hi, lo) of 32-bit halves in longs."""
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1))), lambda i: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))
    codes = F.when(F.octet_length(text) == 0, F.array().cast("array<bigint>")).otherwise(codes)
    start = F.struct(F.lit(FNV_HIGH).cast("long").alias("hi"), F.lit(FNV_LOW).cast("long").alias("lo"))

    def step(state: Column, byte: Column) -> Column:
        x = state["lo"].bitwiseXOR(byte)
        carry = F.shiftright(x * FNV_FACTOR, 32)
        high = (state["hi"] * FNV_FACTOR + carry + x * 256).bitwiseAND(F.lit(LOW_32))
        return F.struct(high.alias("hi"), (x * FNV_FACTOR).bitwiseAND(F.lit(LOW_32)).alias("lo"))

    return F.aggregate(codes, start, step)


def bits(hash64: Column) -> Column:
    """The 64 bits of a struct (hi, lo), most significant first."""
    part = lambda v: F.array(*(F.shiftright(v, 31 - i).bitwiseAND(F.lit(1)).cast("int") for i in range(32)))
    return F.concat(part(hash64["hi"]), part(hash64["lo"]))


def binarized(vector: Column) -> Column:
    """1 for positive components and -1 for others."""
    return F.transform(vector, lambda x: F.when(x > 0, 1).otherwise(-1))


def _row_start(n: Column, a: Column) -> Column:
    """Place of the pair (a, a + 1): one of the two factors is even, so the halving is exact."""
    return F.shiftright((2 * n - (a + 1)) * a.cast("long"), 1)


def pair_index(n: Column | int, a: Column, b: Column) -> Column:
    """Place of the pair a < b in the flattened upper triangle of n rows."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("long")
    return _row_start(n, a) + b - a - 1


def pair_of_index(n: Column | int, x: Column) -> Column:
    """The pair (a, b) at place x of the flattened upper triangle, as a struct."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("long")
    root = F.floor(n - 0.5 - F.sqrt((n - 0.5) * (n - 0.5) - 2 * x)).cast("long")
    start = lambda a: _row_start(n, a)
    # the root may be one off where the square root was rounded
    a = F.when(start(root) > x, root - 1).when(start(root + 1) <= x, root + 1).otherwise(root)
    return F.struct(a.alias("a"), (x - start(a) + a + 1).cast("long").alias("b"))


def band_grid(m: int) -> list[tuple[int, int]]:
    """(L, K) from (1, m) by doubling L, as long as L divides into m bits."""
    return [(1 << i, m >> i) for i in range(m.bit_length())]


def collision(s: Column, bands: Column | int, width: Column | int) -> Column:
    """Chance that at least one of `bands` bands of `width` bits agrees at similarity s."""
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    return 1 - F.pow(1 - F.pow(s, lit(width)), lit(bands))
