"""Distinct counts over huge identifier sets, from mergeable partial results.

A sketch has 2^P registers. Each holds the maximum rank seen and two indicator bits for
the two ranks below it, 8 bits in all. Merging is lossless: the sketch of a union is the
merge of the sketches. The estimate is the maximum-likelihood one under the Poisson model;
its standard error is about 0.76 / sqrt(2^P), 1.2 % at P = 12.

While rows are aggregated a register is kept as the OR of one bit per rank (a JVM
aggregate with map-side combination), from which the 8 bits follow.

Defined results: a null, empty or blank identifier isn't counted; case and white space
around it don't matter; null group columns are groups of their own (index: main); a
group without identifiers has no row; an empty table gives no rows; equal rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = 12
#: Standard error of an estimate, as a share of it.
ERROR = 0.761 / (1 << P) ** 0.5


def rank_bit(identifier: Column, p: int = P) -> tuple[Column, Column]:
    """(register, one bit at position rank - 1) of an identifier."""
    h = F.xxhash64(identifier)
    low = h.bitwiseAND(F.lit((1 << (64 - p)) - 1)).bitwiseOR(F.lit(1 << (64 - p)))
    return F.shiftrightunsigned(h, 64 - p).cast("int"), low.bitwiseAND(-low)


def _top(mask: Column) -> Column:
    """Number of the highest bit set, from 1."""
    return F.length(F.bin(mask))


def cells(rows: DataFrame, keys: list[str], identifier: Column, p: int = P) -> DataFrame:
    """(keys, register, mask): the finest partial results."""
    named = rows.withColumn("__id", F.lower(F.regexp_replace(identifier, r"^\s+|\s+$", ""))).filter("__id <> ''")
    register, bit = rank_bit(F.col("__id"), p)
    return named.select(*keys, register.alias("register"), bit.alias("bit")).groupBy(*keys, "register").agg(F.bit_or("bit").alias("mask"))


def code(mask: Column) -> Column:
    """The 8 bits of a register: rank * 4 + indicators of the two ranks below."""
    top = _top(mask)
    below = F.when(top > 2, F.call_function("shiftright", mask, top - 3).bitwiseAND(F.lit(3))).otherwise(F.call_function("shiftleft", mask, F.lit(3) - top).bitwiseAND(F.lit(3)))
    return (top * 4 + below).cast("int")


def mask_of(code_: Column) -> Column:
    """The bits a code stands for: merging by OR of these and code() again loses nothing."""
    top = F.call_function("shiftright", code_, F.lit(2))
    three = F.lit(4).cast("bigint").bitwiseOR(code_.bitwiseAND(F.lit(3)).cast("bigint"))
    return F.when(top > 2, F.call_function("shiftleft", three, top - 3)).otherwise(F.call_function("shiftright", three, F.lit(3) - top))


#: Registers in use up to which a stored sketch lists them, three bytes each; beyond, it has a byte for every register.
LISTED = ((1 << P) - 1) // 3


def _packed(registers):
    import numpy as np
    import pandas as pd

    def one(r) -> bytes:
        r = np.asarray(r, np.uint32)
        if len(r) <= LISTED:
            return np.column_stack([r >> 16, r >> 8 & 255, r & 255]).astype(np.uint8).tobytes()
        dense = np.zeros(1 << P, np.uint8)
        dense[r >> 8] = r & 255
        return dense.tobytes()

    return pd.Series([one(r) for r in registers])


def _unpacked(stored):
    import numpy as np
    import pandas as pd

    def one(b: bytes):
        a = np.frombuffer(b, np.uint8).astype(np.int32)
        if len(a) < 1 << P:
            a = a.reshape(-1, 3)
            return a[:, 0] << 16 | a[:, 1] << 8 | a[:, 2]
        used = np.flatnonzero(a).astype(np.int32)
        return used << 8 | a[used]

    return pd.Series([one(b) for b in stored])


def sketches(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sketch): one byte a register, 2^P bytes at most; fewer where few registers are in use."""
    listed = found.select(*keys, (F.col("register") * 256 + code(F.col("mask"))).alias("r")).groupBy(*keys).agg(F.sort_array(F.collect_list("r")).alias("r"))
    return listed.select(*keys, F.pandas_udf(_packed, "binary")("r").alias("sketch"))


def merged_cells(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the union of stored sketches, by keys."""
    each = stored.select(*keys, F.explode(F.pandas_udf(_unpacked, "array<int>")("sketch")).alias("r"))
    return each.select(*keys, F.expr("r div 256").cast("int").alias("register"), mask_of(F.col("r") % 256).alias("mask")).groupBy(*keys, "register").agg(F.bit_or("mask").alias("mask"))


def ml_estimate(codes, counts, p: int = P):
    """Maximum-likelihood estimates for groups given as lists of codes and how many registers have each."""
    import numpy as np

    m = 1 << p
    n = len(codes)
    alpha, beta = np.zeros(n), np.zeros((n, 66 - p))
    for g in range(n):
        c, k = np.asarray(codes[g]), np.asarray(counts[g], float)
        top, bits = c >> 2, c & 3
        alpha[g] = m - k.sum() + (k * 0.5**top).sum()
        np.add.at(beta[g], top, k)
        for back, bit in ((1, 2), (2, 1)):
            has, at = (bits & bit) > 0, top - back
            ok = at >= 1
            np.add.at(beta[g], at[ok & has], k[ok & has])
            alpha[g] += (k[ok & ~has] * 0.5 ** at[ok & ~has]).sum()
    rate = 0.5 ** np.arange(beta.shape[1])
    low, high = np.full(n, 1e-9), np.full(n, 2.0 ** (64 - p))
    for _ in range(80):  # the derivative falls in the rate, so halving the logarithm's range finds its zero
        mid = np.sqrt(low * high)
        with np.errstate(over="ignore"):
            slope = (beta * rate / np.expm1(mid[:, None] * rate)).sum(axis=1) - alpha
        low, high = np.where(slope > 0, mid, low), np.where(slope > 0, high, mid)
    return np.sqrt(low * high) * m / (1 + 0.4815 / m)


def estimates(found: DataFrame, keys: list[str], sets: list[list[str]], p: int = P) -> DataFrame:
    """(keys, grouping, estimate, error): one row for each group of each grouping set, absent keys null.

    grouping tells which keys a row is grouped by (1 bit each, first key highest).
    """
    base = found.select(*(F.col(k).alias(k) for k in keys), "register", "mask")
    number = {tuple(s): sum(1 << (len(keys) - 1 - keys.index(k)) for k in s) for s in sets}
    levels = F.explode(F.array(*(F.lit(v) for v in number.values())))
    spread = base.withColumn("grouping", levels).select(
        "grouping", *(F.when(F.col("grouping").bitwiseAND(F.lit(1 << (len(keys) - 1 - i))) != 0, F.col(k)).alias(k) for i, k in enumerate(keys)), "register", "mask"
    )
    registers = spread.groupBy("grouping", *keys, "register").agg(F.bit_or("mask").alias("mask"))
    histogram = registers.select("grouping", *keys, code(F.col("mask")).alias("code")).groupBy("grouping", *keys, "code").agg(F.count("*").alias("n"))
    # at most 8 * 64 codes in a group
    grouped = histogram.groupBy("grouping", *keys).agg(F.collect_list(F.struct("code", "n")).alias("h"))

    @F.pandas_udf("double")
    def estimate(codes, counts):
        import pandas as pd

        return pd.Series(ml_estimate(codes.tolist(), counts.tolist(), p))

    return grouped.select(*keys, "grouping", estimate(F.col("h.code"), F.col("h.n")).alias("estimate")).withColumn("standard_error", F.col("estimate") * F.lit(0.761 / (1 << p) ** 0.5))
