"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Each bit position gets a non-zero vector of radius + 1 bits, and each non-zero vector of that
length is a mask: it keeps the positions whose vector has an odd inner product with it. For any
radius positions some mask has even products with all of them, so that two fingerprints that
differ only there agree under it: every pair within the radius shares a bucket of some table.

Only distinct fingerprints are bucketed. Buckets of more than `BUCKET` fingerprints are split by
a second covering family over the positions that the bucket leaves free, which again loses no
pair; what is left there is at most two to the power of the positions that both masks leave free,
whatever the corpus. A bucket yields the edges of a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import check_columns, whole_text, workers_import, written
from tickerloom.llm.components import connected_components

RADIUS = 3
SHINGLE = 3
#: Fingerprints of a bucket that are compared without splitting it further.
BUCKET = 2048
_BITS = 64


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Hashes of the shingles of lower-cased words, in order; a shorter text is one shingle."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - 1]]
    digest = xxhash.xxh64_intdigest
    last = ends[min(shingle, len(words)) - 1 :]
    return np.fromiter(
        (digest(joined[a : b - 1], 42) for a, b in zip(starts, last, strict=True)), np.uint64, n
    )


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over shingles of lower-cased words; 0 where there are no words."""
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    counts = np.zeros(_BITS, dtype=np.int64)
    for i in range(0, n, 65_536):
        part = np.ascontiguousarray(hashes[i : i + 65_536]).astype("<u8").view(np.uint8)
        counts += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (unique), the kept columns and fp (signed 64-bit) of each row of docs.

    A null text counts as empty, with fingerprint zero. Kept columns must not be named row or fp.
    """
    check_columns(docs, {"text", *keep})
    workers_import(docs.sparkSession)
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), *keep, whole_text().alias("__text")
    )
    schema = source.drop("__text").schema.add("fp", "long")
    names = schema.names

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                fps = np.array([fingerprint(t.as_py()) for t in part.columns[-1]], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(fps.view(np.int64))], names=names
                )

    return source.mapInArrow(hashed, schema)


def masks(radius: int = RADIUS, positions: tuple[int, ...] = tuple(range(_BITS))) -> list[int]:
    """The covering masks over the given positions, as signed 64-bit numbers."""
    vectors = 2 ** (radius + 1) - 1
    out = []
    for v in range(1, vectors + 1):
        kept = sum(
            1 << p for i, p in enumerate(positions) if ((i % vectors + 1) & v).bit_count() % 2
        )
        out.append(kept - (1 << _BITS) if kept >> (_BITS - 1) else kept)
    return out


def _free(mask: int) -> tuple[int, ...]:
    return tuple(p for p in range(_BITS) if not mask >> p & 1)


def _masked(fp: Column, chosen: list[int]) -> Column:
    return F.array(*(fp.bitwiseAND(F.lit(m)) for m in chosen))


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) that connect fps exactly as their links within the radius do."""
    members, roots = [], []
    left = fps
    while len(left) > 1:
        root, left = left[0], left[1:]
        waiting = np.array([root])
        while len(waiting) and len(left):
            block, waiting = waiting[:64], waiting[64:]
            near = np.zeros(len(left), dtype=bool)
            for x in block:
                near |= np.bitwise_count(left ^ x) <= radius
            found, left = left[near], left[~near]
            members.append(found)
            roots.append(np.full(len(found), root))
            waiting = np.concatenate([waiting, found])
    empty = np.empty(0, dtype=fps.dtype)
    return np.concatenate([empty, *members]), np.concatenate([empty, *roots])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges u, v that connect the distinct fingerprints (fp) as all links within the radius do."""
    first = masks(radius)
    second = [masks(radius, _free(m)) for m in first]
    tables = distinct.select("fp", F.posexplode(_masked(F.col("fp"), first)).alias("t", "key"))
    large = tables.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET)
    split = F.element_at(
        F.array(*(_masked(F.col("fp"), chosen) for chosen in second)), F.col("t") + 1
    )
    parts = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(split)
    shared = tables.join(large, ["t", "key"], "left").select(
        "t", "key", F.col("n").isNotNull().alias("large"), "fp", F.posexplode(parts).alias("s", "part")
    )
    bucket = ["t", "key", "large", "s", "part"]

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(6)]
            now = np.stack(columns, axis=1)
            rows = now if carry is None else np.concatenate([carry, now])
            changes = np.flatnonzero((rows[1:, :5] != rows[:-1, :5]).any(axis=1)) + 1
            if len(changes):
                yield edges_of(rows[: changes[-1], 5], np.concatenate([[0], changes]))
                rows = rows[changes[-1] :]
            carry = rows
        if carry is not None:
            yield edges_of(carry[:, 5], np.array([0, len(carry)]))

    def edges_of(fps: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        fps, size = fps.astype(np.int64).view(np.uint64), np.diff(bounds)
        at = bounds[:-1][size == 2]
        a, b = fps[at], fps[at + 1]
        near = np.bitwise_count(a ^ b) <= radius
        us, vs = [a[near]], [b[near]]
        for i in np.flatnonzero(size > 2):
            u, v = forest(fps[bounds[i] : bounds[i + 1]], radius)
            us.append(u)
            vs.append(v)
        both = [pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)]
        return pa.RecordBatch.from_arrays(both, names=["u", "v"])

    workers_import(distinct.sparkSession)
    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        shared.select(*bucket, "fp")
        .repartition(partitions, *bucket)
        .sortWithinPartitions(*bucket)
        .mapInArrow(connect, "u long, v long")
    )


def components(hashed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, component_id of each distinct fingerprint of hashed (doc_id, fp).

    component_id is the smallest doc_id among the rows that links connect; null doc_ids are passed
    over, and a component of null doc_ids only has a null component_id.
    """
    distinct, _ = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    labels = connected_components(links(distinct, radius)).withColumnRenamed("node", "fp")
    labelled = distinct.join(labels, "fp")
    smallest = labelled.groupBy("label").agg(F.min("first").alias("smallest"))
    linked = labelled.join(smallest, "label").select("fp", "smallest")
    return distinct.join(linked, "fp", "left").select(
        "fp", F.coalesce("smallest", "first").alias("component_id")
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs."""
    hashed, _ = written(
        fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "hashed"
    )
    return hashed.join(components(hashed, radius), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id, the first of ties.

    A null doc_id is larger than any other. All columns are kept.
    """
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()))
    renamed = renamed.withColumns({"text": F.col(inner["text"]), "doc_id": F.col(inner["doc_id"])})
    hashed, _ = written(fingerprints(renamed, (*inner.values(), "doc_id")), "hashed")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    # The smallest row of each fingerprint first, so that copies meet only in the aggregate.
    best = hashed.groupBy("fp").agg(F.min(order).alias("best"))
    groups = distinct_groups(hashed, radius)
    kept = best.join(groups, "fp").groupBy("label").agg(F.min("best").alias("best"))
    rows = kept.select(F.col("best.row").alias("row"))
    return hashed.join(rows, "row", "left_semi").select(
        *(F.col(n).alias(c) for c, n in inner.items())
    )


def distinct_groups(hashed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, label of each distinct fingerprint: label is the smallest fingerprint connected."""
    distinct, _ = written(hashed.select("fp").distinct(), "fingerprints")
    labels = connected_components(links(distinct, radius)).withColumnRenamed("node", "fp")
    return distinct.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))
