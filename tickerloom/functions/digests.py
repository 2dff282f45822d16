"""Digests of a table's content that any engine can compute, and where two tables differ by them.

A row has one canonical text: every value with its length in front, a null with a mark of its own,
a double as its whole significand and exponent, an instant as microseconds. The md5 of that text is
cut into four lanes, and the lanes of all rows are added modulo 2^64, so a digest does not depend on
the order of rows, notices repeated ones, and combines map-side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANES = 4
MODULUS = 2**64
#: Children of a node of the digest tree, and its depth.
FANOUT, DEPTH = 256, 2


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent)


# A double's text takes several steps that each use the last one's result repeatedly. Over the columns of a
# table every step is a projection of its own, inside a value a lambda, so nothing is computed twice.


def _size(x: Column) -> Column:
    """The size of a double that has an exponent; null for zero and what is not finite."""
    size = F.abs(x)
    return F.when((size > 0) & (size < float("inf")), size)


def _near(size: Column) -> Column:
    return F.floor(F.log2(size))


def _exponent(size: Column, near: Column) -> Column:
    # A logarithm may miss the exponent by one next to a power of two.
    return near + (size >= _power(near + 1)).cast("int") - (size < _power(near)).cast("int")


def _half(exponent: Column) -> Column:
    return F.floor(exponent / 2)


def _double_text(x: Column, size: Column, exponent: Column, half: Column) -> Column:
    scaled = size * _power(-half) * _power(half - exponent) * F.lit(2.0**52)
    finite = F.concat(F.when(x < 0, F.lit("-")).otherwise(""), scaled.cast("bigint").cast("string"), F.lit("e"), exponent.cast("string"))
    return F.when(F.isnan(x), "nan").when(x == 0, "0").when(size.isNull() & x.isNotNull(), F.when(x > 0, "inf").otherwise("-inf")).otherwise(finite)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def double_text(x: Column) -> Column:
    """Sign, 53-bit significand and exponent of a double; exact, as powers of two only scale."""
    return _let(
        _size(x),
        lambda size: _let(
            _near(size),
            lambda near: _let(
                _exponent(size, near), lambda exponent: _let(_half(exponent), lambda half: _double_text(x, size, exponent, half))
            ),
        ),
    )


#: Dates whose text has ten characters lie between these.
SHORT_DATES = ("0000-01-01", "9999-12-31")
SHORT_FRAME = "10:"


def _joined_dates(days: Column) -> Column:
    """The texts of dates, each with the frame of a text of ten characters; nulls are left out."""
    return F.concat(F.lit(SHORT_FRAME), F.array_join(days.cast("array<string>"), SHORT_FRAME))


def _dates_text(days: Column, joined: Column, kind: T.DataType) -> Column:
    """The canonical text of a list of dates: as joined, unless an entry is null or not of ten characters."""
    first, last = (F.lit(d).cast("date") for d in SHORT_DATES)
    whole = F.length(joined) == F.size(days) * (len(SHORT_FRAME) + 10)
    plain = (F.array_min(days) >= first) & (F.array_max(days) <= last) & whole
    return F.when(plain, joined).otherwise(value_text(days, kind))


def value_text(x: Column, kind: T.DataType) -> Column:
    """The canonical text of a value; null for a null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return double_text(x.cast("double"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(x).cast("string")
    if isinstance(kind, T.DateType):
        return x.cast("string")
    if isinstance(kind, T.ArrayType):
        texts = F.transform(x, lambda e: value_text(e, kind.elementType))
        return F.when(x.isNotNull(), F.concat_ws("", F.transform(texts, framed)))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.concat(*[_let(value_text(x[f.name], f.dataType), framed) for f in kind]))
    return x.cast("string")


def framed(text: Column) -> Column:
    """A value's text with its length in characters in front; `n` for a null."""
    return F.when(text.isNull(), "n").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def row_lanes(df: DataFrame, *kept: Column) -> DataFrame:
    """The kept columns, and four 32-bit lanes of the md5 of each row's canonical text: lane0, lane1, ..."""
    kinds = [f.dataType for f in df.schema]
    held = [f"kept{i}" for i in range(len(kept))]
    values = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(df.schema)]
    rows = df.select(*[k.alias(h) for h, k in zip(held, kept, strict=True)], *values)
    doubles = [i for i, kind in enumerate(kinds) if isinstance(kind, (T.DoubleType, T.FloatType))]
    if doubles:
        c = F.col
        rows = rows.withColumns({f"c{i}": c(f"c{i}").cast("double") for i in doubles})
        rows = rows.withColumns({f"size{i}": _size(c(f"c{i}")) for i in doubles})
        rows = rows.withColumns({f"near{i}": _near(c(f"size{i}")) for i in doubles})
        rows = rows.withColumns({f"exponent{i}": _exponent(c(f"size{i}"), c(f"near{i}")) for i in doubles})
        rows = rows.withColumns({f"half{i}": _half(c(f"exponent{i}")) for i in doubles})
    dates = [i for i, kind in enumerate(kinds) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.DateType)]
    rows = rows.withColumns({f"joined{i}": _joined_dates(F.col(f"c{i}")) for i in dates})

    def text(i: int, kind: T.DataType) -> Column:
        if i in doubles:
            return _double_text(*(F.col(f"{part}{i}") for part in ("c", "size", "exponent", "half")))
        return _dates_text(F.col(f"c{i}"), F.col(f"joined{i}"), kind) if i in dates else value_text(F.col(f"c{i}"), kind)

    texts = [text(i, kind) for i, kind in enumerate(kinds)]
    rows = rows.select(*held, *[t.alias(f"t{i}") for i, t in enumerate(texts)])
    rows = rows.select(*held, F.md5(F.concat(*[framed(F.col(f"t{i}")) for i in range(len(kinds))]).cast("binary")).alias("md5"))
    lanes = [F.conv(F.substring("md5", 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"lane{i}") for i in range(LANES)]
    return rows.select(*held, *lanes)


def _added() -> list[Column]:
    """The lanes of all rows added modulo 2^64: the halves of a lane add up to longs for 2^47 rows."""

    def half(part: Column) -> Column:
        return F.coalesce(F.sum(part), F.lit(0)).cast("decimal(20,0)")

    def added(lane: str) -> Column:
        high, low = half(F.shiftright(lane, 16)), half(F.col(lane).bitwiseAND(F.lit(0xFFFF)))
        return ((high * F.lit(65536) + low) % F.lit(str(MODULUS)).cast("decimal(20,0)")).alias(lane)

    return [added(f"lane{i}") for i in range(LANES)]


def content_digest(df: DataFrame) -> DataFrame:
    """Row count and digest of a table, one tiny shuffle whatever its size."""
    sums = row_lanes(df).agg(F.count(F.lit(1)).alias("row_count"), *_added())
    return sums.select(
        "row_count", F.concat_ws(":", *[F.col(f"lane{i}").cast("decimal(20,0)").cast("string") for i in range(LANES)]).alias("digest")
    )


def _hashed(x: Column, kind: T.DataType) -> list[Column]:
    """What a value adds to the hash of its row; hashes skip nulls, so each has a mark of its own."""
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.ArrayType, T.StructType, T.MapType)):
        gaps = F.exists(x, lambda e: e.isNull())
        return [x.isNull(), F.size(x), F.coalesce(gaps, F.lit(False)), F.when(gaps, F.transform(x, lambda e: e.isNull())), x]
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        x = value_text(x, kind)
    return [x.isNull(), x]


def row_hashes(df: DataFrame, *kept: Column) -> DataFrame:
    """The kept columns, and two 64-bit hashes of each row: hash0, hash1.

    Together they are as wide as an md5 and need no text; they serve comparisons inside one job, never storage.
    """
    parts = [p for f in df.schema for p in _hashed(F.col(f"`{f.name}`"), f.dataType)]
    held = [f"kept{i}" for i in range(len(kept))]
    rows = df.select(*[k.alias(h) for h, k in zip(held, kept, strict=True)], *[p.alias(f"p{i}") for i, p in enumerate(parts)])
    names = [F.col(f"p{i}") for i in range(len(parts))]
    return rows.select(*held, F.xxhash64(*names).alias("hash0"), F.xxhash64(F.lit(1), *names).alias("hash1"))


def hash_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """only_in, rows: how many rows of either table the other lacks, counting copies.

    Rows meet by their hashes, so what is shuffled is 24 bytes a row whatever the columns.
    """
    sides = [row_hashes(df).withColumn("side", F.lit(sign)) for df, sign in ((left, 1), (right.select(*left.columns), -1))]
    surplus = sides[0].unionByName(sides[1]).groupBy("hash0", "hash1").agg(F.sum("side").alias("surplus")).where("surplus <> 0")
    only_in = F.when(F.col("surplus") > 0, "left").otherwise("right")
    return surplus.groupBy(only_in.alias("only_in")).agg(F.sum(F.abs("surplus")).alias("rows"))


def _node(key: list[str], level: int) -> Column:
    """The tree node of a row at a level: a key's hash, eight bits more at each level."""
    return F.pmod(F.xxhash64(*key), F.lit(FANOUT ** (level + 1)))


def differing_nodes(left: DataFrame, right: DataFrame, key: list[str]) -> list[int] | None:
    """Leaf nodes of the digest tree in which two tables differ; None if none does.

    Digests of nodes add the halves of row hashes. Each level compares them only below the nodes that differ on the one before. The driver sees
    at most FANOUT nodes times the differing ones of the level above, and stops refining where many
    differ: then reading their rows costs no more than digests would.
    """
    nodes: list[int] | None = None
    for level in range(DEPTH):
        sides = []
        for side, sign in ((left, 1), (right, -1)):
            rows = side.select(*left.columns)
            if nodes is not None:
                rows = rows.where(_node(key, level - 1).isin(nodes))
            hashes = row_hashes(rows, _node(key, level))
            lanes = hashes.select(
                F.col("kept0").alias("node"),
                *[F.shiftrightunsigned(f"hash{i}", 32).alias(f"lane{2 * i}") for i in range(LANES // 2)],
                *[F.col(f"hash{i}").bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"lane{2 * i + 1}") for i in range(LANES // 2)],
            )
            sides.append(
                lanes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *_added()).withColumn("side", F.lit(sign))
            )
        together = sides[0].unionByName(sides[1]).groupBy("node")
        unequal = [F.sum(F.col(c) * F.col("side")) != 0 for c in ("n", *(f"lane{i}" for i in range(LANES)))]
        found = together.agg(*[u.alias(f"u{i}") for i, u in enumerate(unequal)])
        found = found.where(" or ".join(f"u{i}" for i in range(len(unequal))))
        differing = [r["node"] for r in found.select("node").collect()]
        if not differing:
            return None
        nodes = differing
        if len(nodes) > FANOUT // 4:
            return [level, *nodes]
    return [DEPTH - 1, *nodes]


def in_nodes(df: DataFrame, key: list[str], nodes: list[int]) -> DataFrame:
    """The rows of the nodes that `differing_nodes` returned."""
    level, *own = nodes
    return df.where(_node(key, level).isin(own))
