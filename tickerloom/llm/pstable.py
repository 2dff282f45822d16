"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

Normalised vectors are projected on Gaussian directions, shifted and cut into bins; PROJECTIONS
bins make the key of one of TABLES tables. For unit vectors a cosine of 0.9 is a distance of
0.447; with bins of 1.5 one projection agrees with probability 0.76 there, a key of eight with
0.114, and one of 24 tables with 0.945. Closer pairs agree more often (0.99 at cosine 0.95).

Equal vectors are collapsed first and count by their number. Vectors that share a bucket are
compared in double precision, whole buckets of up to CELL vectors at once; a larger bucket is
dealt out to cells of two of its chunks, so that no task holds it. A pair counts in the first
table where it shares a bucket. A cell yields link counts and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import check_columns, workers_import, written
from tickerloom.llm.components import connected_components

THRESHOLD = 0.9
TABLES = 24
PROJECTIONS = 8
WIDTH = 1.5
CELL = 1024
SEED = 20_260


def _directions(size: int, tables: int, projections: int, width: float):
    random = np.random.default_rng([SEED, size])
    directions = random.standard_normal((size, tables * projections))
    return directions, random.uniform(0, width, tables * projections)


def bucket_keys(unit: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """A 32-bit key per vector and table; clashes of keys only add candidates."""
    directions, shifts = _directions(unit.shape[1], tables, projections, width)
    bins = np.floor((unit @ directions + shifts) / width).astype(np.int64)
    bins = bins.reshape(len(unit), tables, projections)
    key = np.full(bins.shape[:2], unit.shape[1], dtype=np.uint64)
    for p in range(projections):
        key = (key ^ bins[:, :, p].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def readable(vectors: DataFrame) -> DataFrame:
    """row (unique), vec_id and vector (32-bit floats), null where a vector cannot have a cosine:
    null, empty, all zero, or with a null or non-finite component."""
    check_columns(vectors, ("vec_id", "embedding"))
    vector = F.col("embedding").cast("array<float>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vector, lambda x: x == 0)  # also for an empty one
    usable = F.when(~odd & ~zero, vector)
    return vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        usable.alias("vector"),
    )


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=np.float32).reshape(len(vectors), -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)  # keeps tiny and huge vectors exact
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def compare(
    vectors: np.ndarray,
    weights: np.ndarray,
    keys: np.ndarray,
    sides: np.ndarray,
    table: int,
    threshold: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Weighted numbers of new links, and the root in a spanning forest, of the rows of a cell.

    Pairs of one side are compared only where all rows have the same side.
    """
    unit, n = _unit(vectors), len(vectors)
    crossing = sides.min() != sides.max()
    links, adjacent = np.zeros(n, dtype=np.int64), []
    for begin in range(0, n, 256):
        near = unit[begin : begin + 256] @ unit.T >= threshold
        if crossing:
            near &= sides[begin : begin + 256, None] != sides[None, :]
        a, b = np.nonzero(near)
        a = a + begin
        a, b = a[a != b], b[a != b]
        adjacent.append((a, b))
        for i in range(0, len(a), 100_000):
            p, q = a[i : i + 100_000], b[i : i + 100_000]
            new = ~(keys[p, :table] == keys[q, :table]).any(axis=1)
            links += np.bincount(p[new], weights=weights[q[new]], minlength=n).astype(np.int64)
    a, b = (np.concatenate(x) for x in zip(*adjacent, strict=True))
    root = np.arange(n)
    while True:  # smallest label along links, with shortcuts
        after = root.copy()
        np.minimum.at(after, a, root[b])
        after = after[after]
        if np.array_equal(after, root):
            return links, root
        root = after


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    width: float = WIDTH,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding).

    Vectors without a cosine, and those of other lengths, link with nothing. Rows with equal
    vectors link with each other, also under one vec_id; null vec_ids stay null and are passed
    over for component_id, which is null if a component has no other.
    """
    workers_import(vectors.sparkSession)
    rows, _ = written(readable(vectors), "vectors")
    copies = (
        rows.where("vector is not null")
        .groupBy("vector")
        .agg(
            F.min("row").alias("node"),
            F.count("*").alias("weight"),
            F.min("vec_id").alias("first"),
        )
    )
    copies, _ = written(copies, "copies")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for i in range(0, len(at), 2048):
                    part = at[i : i + 2048]
                    matrix = flat[starts[part][:, None] + np.arange(size)]
                    keys = bucket_keys(_unit(matrix), tables, projections, width)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(1).take(pa.array(part)),
                            batch.column(2).take(pa.array(part)),
                            pa.array(np.full(len(part), size, dtype=np.int32)),
                            pa.array([x.tobytes() for x in matrix], pa.binary()),
                            pa.array([x.tobytes() for x in keys], pa.binary()),
                            pa.ListArray.from_arrays(
                                pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables),
                                pa.array(keys.ravel()),
                            ),
                        ],
                        names=["node", "weight", "size", "vector", "keys", "each"],
                    )

    keyed, _ = written(
        copies.select("vector", "node", "weight").mapInArrow(
            hashed, "node long, weight long, size int, vector binary, keys binary, each array<int>"
        ),
        "keyed",
    )
    slots = keyed.select("node", "size", F.posexplode("each").alias("t", "key"))
    found = slots.groupBy("t", "key", "size").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CELL).cast("int")
    mine = F.pmod(F.xxhash64("node"), chunks).cast("int")
    entries = (
        slots.join(found, ["t", "key", "size"])
        .select("node", "t", "key", "size", chunks.alias("chunks"), mine.alias("mine"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select(
            "node", "t", "key", "size", "mine",
            F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
        )
    )
    cell = ["t", "key", "size", "low", "high"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[pa.RecordBatch] = []
        held = None
        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy() for c in range(5)], axis=1)
            if not len(ids):
                continue
            bounds = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1), len(ids)]
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                if carry and tuple(ids[i]) != held:
                    yield from finish(carry)
                    carry = []
                held = tuple(ids[i])
                carry.append(batch.slice(i, j - i))
        if carry:
            yield from finish(carry)

    def finish(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(parts)
        if group.num_rows < 2:
            return
        t, low, high = (group.column(c)[0].as_py() for c in ("t", "low", "high"))
        sides, nodes = (group.column(c).to_numpy() for c in ("mine", "node"))
        if low != high and sides.min() == sides.max():
            return
        matrix = _matrix(group.column("vector").to_pylist())
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), dtype=np.int32)
        keys = keys.reshape(len(nodes), -1)
        n, root = compare(matrix, group.column("weight").to_numpy(), keys, sides, t, threshold)
        at = np.flatnonzero((n > 0) | (root != np.arange(len(root))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[at]), pa.array(n[at]), pa.array(nodes[root[at]])],
            names=["node", "links", "root"],
        )

    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked, _ = written(
        entries.join(keyed.select("node", "weight", "vector", "keys"), "node")
        .select(*cell, "mine", "node", "weight", "vector", "keys")
        .repartition(partitions, *cell)
        .sortWithinPartitions(*cell)
        .mapInArrow(compared, "node long, links long, root long"),
        "links",
    )
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    nodes = copies.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = nodes.groupBy("label").agg(F.min("first").alias("component"))
    known = nodes.join(counts, "node", "left").join(smallest, "label")
    known = known.select("vector", "weight", "links", "component")
    usable = F.col("weight").isNotNull()
    n_links = F.when(usable, F.col("weight") - 1 + F.coalesce("links", F.lit(0))).otherwise(0)
    component = F.when(usable, F.col("component")).otherwise(F.col("vec_id"))
    return (
        rows.join(known, "vector", "left")
        .select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
