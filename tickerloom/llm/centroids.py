"""Centroids of vectors in whole numbers, by tables of squared differences.

A component x becomes floor(SCALE * x). In each round a task tabulates, for every dimension and
every value that occurs in its batch, the squared difference to each centroid's component; the
distances of all vectors are then gathers from these tables and their sums. All arithmetic is exact:
64-bit where a batch's values allow it, Python's whole numbers otherwise.

A round is one pass over the vectors. It sends one row of sums per task and centroid, so neither the
driver nor a task gathers anything that grows with the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.llm.common import check_columns, workers_import, written

SCALE, DIMENSIONS, CLUSTERS, ROUNDS = 1024, 64, 8, 10
SEED = "3:"
#: Below this a squared distance over a few hundred dimensions fits 64 bits.
_NARROW = 2**26
#: Beyond this a squared distance has more than 38 digits.
_WIDE = 2.0**59
_WHOLE = pa.decimal128(38, 0)


def whole_numbers(vectors: DataFrame, vector: str, dimensions: int, scale: int) -> DataFrame:
    """The rows whose vector can be used, with it as `x`: whole numbers floor(scale * component).

    A vector that is null, has another length, or holds a component that is null, not finite, or
    2^59 or more once scaled, is left out.
    """
    scaled = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale))
    usable = F.forall(
        F.col(vector),
        lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * scale) < _WIDE),
    )
    kept = vectors.where((F.size(vector) == dimensions) & F.coalesce(usable, F.lit(False)))
    return kept.withColumn("x", scaled)


def _distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of the rows of x to every centroid, from tables per dimension."""
    most = max(abs(c) for row in centroids for c in row)
    wide = max(most, int(x.max()), -int(x.min())) >= _NARROW
    kind = object if wide else np.int64
    among = np.array(centroids, dtype=kind)
    total = np.zeros((len(x), len(centroids)), dtype=kind)
    for d in range(x.shape[1]):
        values, places = np.unique(x[:, d], return_inverse=True)
        differences = values.astype(kind)[:, None] - among[None, :, d]
        total += (differences * differences)[places]
    return total


def _nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid; the smaller number on ties."""
    distances = _distances(x, centroids)
    nearest = distances.argmin(axis=1)
    return nearest, distances[np.arange(len(x)), nearest]


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], _WHOLE)


def _totals(points: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int], int | None]]:
    """Per centroid with vectors: their number, component sums and squared distances' sum.

    The sums of distances are None beyond 38 digits.
    """
    dimensions = len(centroids[0])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = [0] * len(centroids)
        sums = [[0] * dimensions for _ in centroids]
        inertia = [0] * len(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), dimensions)
            near, distance = _nearest(x, centroids)
            for k in np.unique(near).tolist():
                own = near == k
                # Halves keep the sums of a batch within 64 bits.
                high, low = (x[own] >> 30).sum(axis=0), (x[own] & (2**30 - 1)).sum(axis=0)
                number[k] += int(own.sum())
                sums[k] = [s + (int(h) << 30) + int(w) for s, h, w in zip(sums[k], high, low, strict=True)]
                inertia[k] += sum(distance[own].tolist())
        found = [k for k in range(len(centroids)) if number[k]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(found, pa.int32()),
                pa.array([number[k] for k in found], pa.int64()),
                pa.array([[Decimal(s) for s in sums[k]] for k in found], pa.list_(_WHOLE)),
                pa.array([Decimal(i) if (i := inertia[k]) < 10**38 else None for k in found], _WHOLE),
            ],
            names=["cluster", "n", "sums", "inertia"],
        )

    parts = points.select("x").mapInArrow(
        summed, "cluster int, n long, sums array<decimal(38,0)>, inertia decimal(38,0)"
    )
    rows = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.col("sums")[d]) for d in range(dimensions)]).alias("sums"),
        F.when(F.count("inertia") == F.count("*"), F.try_sum("inertia")).alias("inertia"),
    )
    # One row per centroid.
    return {
        r["cluster"]: (r["n"], [int(s) for s in r["sums"]], None if r["inertia"] is None else int(r["inertia"]))
        for r in rows.collect()
    }


def _long(value: int | None) -> Column:
    fits = value is not None and value < 2**63
    return F.lit(value if fits else None).cast("long")


def clusters(
    vectors: DataFrame,
    identity: str = "vec_id",
    vector: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: str = SEED,
) -> DataFrame:
    """identity, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the usable vectors.

    Centroids start as the k vectors with the smallest sha256 of seed and identity; where rows share
    an identity (a null one counts as an empty text), the smaller vector comes first. With fewer than
    k vectors there are as many centroids as vectors, with none the result is empty. In each round
    every vector goes to its nearest centroid (the smaller number on ties), then every centroid with
    vectors becomes the floor of their mean. Repeated rows count as often as they occur. A sum of
    squares that does not fit a long is null. Other columns, whatever their names, are not read.
    """
    check_columns(vectors, (identity, vector))
    spark = vectors.sparkSession
    workers_import(spark)
    chosen = vectors.select(F.col(f"`{identity}`").alias("identity"), F.col(f"`{vector}`").alias("vector"))
    # Read once per round, so it is written: narrow whole numbers, dictionary-encoded.
    points, _ = written(
        whole_numbers(chosen, "vector", dimensions, scale).select("identity", "x"), "whole-vectors"
    )
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("identity").cast("string"), F.lit(""))), 256)
    centroids = [list(r["x"]) for r in points.orderBy(digest, "x").limit(k).select("x").collect()]
    result = "identity", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    if not centroids:
        nothing = points.select(
            "identity",
            F.lit(0).alias("cluster"),
            *[F.lit(0).cast("long").alias(c) for c in result[2:5]],
            F.lit("").alias("centroid_sha256"),
        )
        return nothing.where("false").withColumnRenamed("identity", identity)
    for _ in range(rounds):
        totals = _totals(points, centroids)
        moved = [
            [s // totals[c][0] for s in totals[c][1]] if c in totals else row for c, row in enumerate(centroids)
        ]
        if moved == centroids:  # no later round changes anything
            break
        centroids = moved
    totals = _totals(points, centroids)
    each = [totals[c][2] if c in totals else 0 for c in range(len(centroids))]
    whole = None if None in each else sum(each)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, distance = _nearest(_matrix(batch.column(1), dimensions), centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(near, pa.int32()), _decimals(distance)],
                    names=["identity", "cluster", "wide"],
                )

    schema = points.select("identity").schema.add("cluster", T.IntegerType()).add("wide", T.DecimalType(38, 0))
    per_cluster = F.array(*[_long(e) for e in each])
    return (
        points.mapInArrow(assigned, schema)
        .select(
            F.col("identity").alias(identity),
            "cluster",
            F.expr("try_cast(wide as bigint)").alias("distance"),
            F.get(per_cluster, F.col("cluster")).alias("cluster_inertia"),
            _long(whole).alias("inertia"),
            F.get(F.array(*[F.lit(s) for s in shas]), F.col("cluster")).alias("centroid_sha256"),
        )
    )
