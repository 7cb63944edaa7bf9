"""Bloom filter and bitmap functions with exact bit positions, as Column expressions.

64-bit unsigned hashing is done on two 32-bit limbs held in BIGINTs: no product leaves 63 bits, so it is
exact under ANSI arithmetic and much cheaper than DECIMAL(38).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FNV-1a, 64 bits. The offset basis is 14695981039346656037, the prime 2**40 + 435.
FNV_BASIS_HIGH, FNV_BASIS_LOW = 14695981039346656037 >> 32, 14695981039346656037 & 0xFFFFFFFF
FNV_PRIME_LOW = 435
MASK = 0xFFFFFFFF


def optimal_bits(n: Column, rate: float) -> Column:
    """m = ceil(-n ln p / ln(2)^2)."""
    return F.ceil(-n * math.log(rate) / (math.log(2) * math.log(2))).cast("long")


def optimal_hashes(n: Column, rate: float) -> Column:
    """k = ceil(m / n ln 2), 1 at least."""
    return F.greatest(F.ceil(optimal_bits(n, rate) / n * math.log(2)).cast("long"), F.lit(1))


def params(n: int, rate: float) -> tuple[int, int]:
    """(m, k) for a filter of n keys."""
    if n < 1 or not 0 < rate < 1:
        raise ValueError("a Bloom filter needs at least one key and a rate between 0 and 1")
    m = math.ceil(-n * math.log(rate) / (math.log(2) * math.log(2)))
    return m, max(1, math.ceil(m / n * math.log(2)))


def filter_bytes(bits: Column) -> Column:
    """Encoded size: two 32-bit fields and the bit set."""
    return (F.ceil(bits / 8) + 8).cast("long")


def _step(hi: Column, lo: Column, byte: Column) -> Column:
    low = lo.bitwiseXOR(byte)
    product = low * FNV_PRIME_LOW
    carry = F.shiftright(product, 32)
    high = hi * FNV_PRIME_LOW + F.shiftleft(low, 8) + carry
    return F.struct(high.bitwiseAND(F.lit(MASK)).alias("hi"), product.bitwiseAND(F.lit(MASK)).alias("lo"))


def fnv1a(key: Column) -> Column:
    """FNV-1a of the key's bytes as struct(hi, lo) of unsigned 32-bit halves."""
    latin = F.decode(key.cast("binary"), "ISO-8859-1")
    start = F.struct(F.lit(FNV_BASIS_HIGH).cast("long").alias("hi"), F.lit(FNV_BASIS_LOW).cast("long").alias("lo"))
    positions = F.when(F.length(latin) > 0, F.sequence(F.lit(1), F.length(latin))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(positions, start, lambda acc, i: _step(acc["hi"], acc["lo"], F.ascii(F.substr(latin, i, F.lit(1))).cast("long")))


def second_hash(h: Column) -> Column:
    """The hash of the key with byte 1 appended, from the first hash; 1 instead of 0."""
    s = _step(h["hi"], h["lo"], F.lit(1).cast("long"))
    zero = (s["hi"] == 0) & (s["lo"] == 0)
    return F.struct(s["hi"].alias("hi"), F.when(zero, F.lit(1)).otherwise(s["lo"]).cast("long").alias("lo"))


def as_decimal(h: Column) -> Column:
    return h["hi"].cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(20,0)") + h["lo"].cast("decimal(20,0)")


def position(h1: Column, h2: Column, i: Column, m: Column) -> Column:
    """((h1 + i h2) mod 2^64) mod m; m is below 2^31 and i below 2^20."""
    low = h1["lo"] + h2["lo"] * i
    high = (h1["hi"] + h2["hi"] * i + F.shiftright(low, 32)).bitwiseAND(F.lit(MASK))
    return ((high % m) * (F.lit(4294967296) % m) + low.bitwiseAND(F.lit(MASK)) % m) % m


def probes(keys: DataFrame, m, k, key: str = "key") -> DataFrame:
    """One row per key and hash function, with column pos."""
    as_col = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")
    hashed = keys.withColumn("_h1", fnv1a(F.col(key))).withColumn("_h2", second_hash(F.col("_h1")))
    each = hashed.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), as_col(k) - 1)))
    return each.withColumn("pos", position(F.col("_h1"), F.col("_h2"), F.col("_i"), as_col(m)).cast("long")).drop("_h1", "_h2", "_i")


def bit_set(keys: DataFrame, m: int, k: int) -> DataFrame:
    """Distinct positions set by the keys: at most m rows."""
    return probes(keys.select("key"), m, k).select("pos").distinct()


#: Bits of a filter that is sent to all tasks at most.
PACKED_BITS = 1 << 22


def packed(bits: DataFrame, m: int) -> DataFrame:
    """One row with the filter's bits as an array of 64-bit words."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))
    words = [0] * (-(-m // 64))
    for r in bits.groupBy(F.floor(F.col("pos") / 64).alias("w")).agg(F.bit_or(bit).alias("word")).collect():  # m / 64 rows at most
        words[r["w"]] = r["word"]
    return bits.sparkSession.createDataFrame([(words,)], "words array<long>")


def may_contain(bits: DataFrame, keys: DataFrame, m: int, k: int) -> DataFrame:
    """(key, maybe): whether all k bits are set. bits has at most m rows, the filter's own size.

    A filter of PACKED_BITS at most is sent to all tasks, and keys are tested where they are. A larger one is
    joined with the keys' bits.
    """
    asked = keys.select("key").distinct()
    if m <= PACKED_BITS:
        hashed = asked.withColumn("_h1", fnv1a(F.col("key"))).withColumn("_h2", second_hash(F.col("_h1"))).crossJoin(F.broadcast(packed(bits, m)))

        def is_set(i: Column) -> Column:
            pos = position(F.col("_h1"), F.col("_h2"), i, F.lit(m).cast("long"))
            word = F.element_at("words", (F.floor(pos / 64) + 1).cast("int"))
            return F.call_function("shiftrightunsigned", word, (pos % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

        return hashed.select("key", F.forall(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), is_set).alias("maybe"))
    hit = probes(asked, m, k).join(bits.withColumn("_set", F.lit(True)), "pos", "left")
    return hit.groupBy("key").agg(F.bool_and(F.coalesce("_set", F.lit(False))).alias("maybe"))


def bitmap_bytes(positions: DataFrame, num_bits: int) -> DataFrame:
    """The set's bytes, least significant bit first, as rows (byte_no, byte); zero bytes are left out.

    A position at or beyond num_bits raises.
    """
    p = F.when((F.col("pos") < 0) | (F.col("pos") >= num_bits), F.raise_error(F.lit("bit position out of range"))).otherwise(F.col("pos")).cast("long")
    bits = positions.select(p.alias("pos")).distinct()
    return bits.groupBy(F.floor(F.col("pos") / 8).cast("long").alias("byte_no")).agg(F.bit_or(F.expr("shiftleft(1, cast(pos % 8 as int))")).cast("long").alias("byte"))
