"""Packing documents into token windows by non-negative least squares.

1. Each document is encoded once, in tasks, and cut into full windows and one shorter rest. The
   pieces with their ids are written to the shared folder.
2. The histogram of piece lengths has at most one row per length up to the window, whatever the
   corpus; only it reaches the driver. `plan` enumerates combinations of at most three lengths
   that fill a window exactly, solves for non-negative repeat counts against the histogram,
   rounds them down, and packs what is left greedily, again as patterns with repeat counts. The
   plan has at most the combinations (some 350,000 for 2048) and a few patterns per length, so
   what the tasks get of it has a bound that no corpus moves.
3. Pieces are numbered within their length. A length may be that of a third of all pieces, so the
   numbering counts hashed buckets of each length first and numbers inside them. The number of a
   piece gives its pattern, repetition and offset.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.bpe import encoder
from tickerloom.llm.common import check_columns, slices, whole_text, workers_import, written

WINDOW = 2048
#: Id that ends each document.
END_ID = 1
#: Steps of the least-squares solver.
SOLVER_STEPS = 300

_PIECES = "doc_id long, start long, length int, ids binary, ids_crc32 long, doc_tokens long"
_PIECES_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int32()),
        ("ids", pa.binary()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
    ]
)


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of each row of docs, stored: piece (a unique number), doc_id, start, length,
    ids (little-endian unsigned, 16 bits where the vocabulary allows, else 32), ids_crc32 (over
    the 32-bit form) and doc_tokens.

    A null or empty text gives one piece that holds the end id. Rows with the same or a null
    doc_id are packed each on its own.
    """
    check_columns(docs, ("doc_id", "text"))
    workers_import(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        width = "<u2" if len(coder.token_bytes) <= 65_536 else "<u4"
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(texts):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[i:j], coder.encode(texts[i:j]), strict=True):
                    ids = np.append(ids, end_id).astype("<u4")
                    for start in range(0, len(ids), window):
                        part = ids[start : start + window]
                        crc = zlib.crc32(part.tobytes())
                        stored_ids = part.astype(width).tobytes()
                        rows.append((doc_id, start, len(part), stored_ids, crc, len(ids)))
                columns = zip(*rows, strict=True)
                yield pa.record_batch(
                    [pa.array(c, f.type) for c, f in zip(columns, _PIECES_ARROW, strict=True)],
                    schema=_PIECES_ARROW,
                )

    cut_docs = docs.mapInArrow(cut, _PIECES)
    return written(cut_docs.select(F.monotonically_increasing_id().alias("piece"), "*"), "pieces")[0]


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples of the lengths that add up to the window, ascending, 0 for none."""
    has = np.zeros(window + 1, dtype=bool)
    has[lengths] = True
    small = lengths[lengths <= window // 2]
    pairs = small[has[window - small]]
    found = [np.stack([np.zeros_like(pairs), pairs, window - pairs], axis=1)]
    for a in lengths[lengths <= window // 3]:
        b = lengths[(lengths >= a) & (lengths <= (window - a) // 2)]
        b = b[has[window - a - b]]
        found.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(found)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = SOLVER_STEPS) -> np.ndarray:
    """Non-negative least squares: repeats x of the combinations that come closest to the histogram.

    Accelerated projected gradient on |Ax - h|^2 for x >= 0. A column of A counts the lengths of
    one combination; entry 0 of the histogram stands for "none" and is left out.
    """
    if not len(combos):
        return np.zeros(0)
    size = len(histogram)
    target = histogram.astype(float)

    def use(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(combos[:, c], weights=x, minlength=size) for c in range(3))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[combos].sum(axis=1)

    # The largest eigenvalue of A'A bounds the step; a few power iterations find it.
    v = np.ones(len(combos))
    for _ in range(20):
        w = back(use(v))
        top = np.linalg.norm(w)
        v = w / top
    step = 0.9 / top
    x = y = np.zeros(len(combos))
    momentum = 1.0
    for _ in range(steps):
        gap = use(y) - target
        gap[0] = 0
        after = np.maximum(0.0, y - step * back(gap))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = after + (momentum - 1) / following * (after - x)
        x, momentum = after, following
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence) and their repeats; uses each piece exactly once."""
    left = np.zeros(window + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] = count
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], wanted: int) -> None:
        need = Counter(pattern)
        repeats = int(min(wanted, *(left[k] // n for k, n in need.items())))
        if repeats > 0:
            for k, n in need.items():
                left[k] -= repeats * n
            out.append((pattern, repeats))

    if left[window]:
        take((window,), int(left[window]))
    combos = combinations(np.flatnonzero(left[:window]), window)
    x = repeat_counts(combos, left)
    whole = np.floor(x).astype(np.int64)
    for i in np.argsort(-x, kind="stable"):
        if whole[i] < 1:
            break
        take(tuple(int(k) for k in combos[i] if k), int(whole[i]))
    # What rounding and the solver left: the longest first, filled exactly where one or two
    # further lengths can, else with the longest that fits.
    while left.any():
        lengths = np.flatnonzero(left).tolist()
        pattern = [lengths[-1]]
        spare = left.copy()
        spare[pattern[0]] -= 1
        while (room := window - sum(pattern)) > 0:
            two = np.flatnonzero((spare[1:room] > 0) & (spare[room - 1 : 0 : -1] > 0)) + 1
            two = two[(2 * two != room) | (spare[two] > 1)]
            if spare[room]:
                chosen = [room]
            elif len(two):
                chosen = [int(room - two[0]), int(two[0])]
            else:
                at = bisect_right(lengths, room) - 1
                while at >= 0 and not spare[lengths[at]]:
                    at -= 1
                if at < 0:
                    break
                chosen = [lengths[at]]
            for k in chosen:
                spare[k] -= 1
            pattern += chosen
        take(tuple(pattern), int(left.max()))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length: first number of a slot's pieces, first sequence, offset; by first number."""
    used: Counter[int] = Counter()
    found: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, repeats in patterns:
        offset = 0
        for length in pattern:
            found.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += repeats
            offset += length
        sequence += repeats
    return {k: np.array(v, dtype=np.int64) for k, v in found.items()}


def numbered(cut: DataFrame) -> DataFrame:
    """cut with number: 0, 1, ... among the pieces of the same length."""
    spark = cut.sparkSession
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("rows"))
    base = counts.select(
        "length", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base")
    )
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("piece")) - 1
    return (
        cut.withColumn("inside", inside)
        .join(base, ["length", "bucket"])
        .withColumn("number", F.col("base") + F.col("inside"))
        .drop("bucket", "base", "inside")
    )


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Places the stored pieces: all their columns but ids, with sequence_id and offset.

    No pieces give no rows. Equal pieces take different places.
    """
    check_columns(cut, ("piece", "length"))
    workers_import(cut.sparkSession)
    cut = cut.drop("ids", "sequence_id", "offset")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = slots(plan(histogram, window))
    rows = numbered(cut)
    schema = rows.drop("number").schema.add("sequence_id", "long").add("offset", "long")
    names = schema.names

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                slot = places[int(k)]
                which = np.searchsorted(slot[:, 0], number[at], side="right") - 1
                sequence[at] = slot[which, 1] + number[at] - slot[which, 0]
                offset[at] = slot[which, 2]
            columns = [batch.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], names=names
            )

    return rows.mapInArrow(place, schema)


def sequences(cut: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length and ids in place, unpadded.

    A sequence holds at most one window of ids, so that no group grows with the corpus.
    """
    placed = packed.select("piece", "sequence_id", "offset").join(cut.select("piece", "length", "ids"), "piece")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(
        parts, F.lit(b""), lambda all_ids, part: F.concat(all_ids, part["ids"])
    )
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), joined.alias("ids")
    )
