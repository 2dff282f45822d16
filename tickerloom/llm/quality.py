"""Quality scores of whole texts by a factorisation machine.

Inputs are hashed words, statistics of the text's structure, and metadata of the text itself (its
size); labels, lang, source and doc_id are not among them. A score is

    sigmoid(w0 + <w, x> + 1/2 * sum_f ((x V_f)^2 - x^2 V_f^2))

where the last sum gives all pairwise interactions in time linear in the inputs. The machine is
fitted on a bounded sample of labelled rows (`SAMPLE`, those with the smallest hashes); features
and scores of all rows are computed in Spark tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import check_columns, whole_text, workers_import

#: Most labelled rows that are fitted on.
SAMPLE = 20_000
HASHED = 512
FACTORS = 8
EPOCHS, BATCH, RATE, DECAY = 20, 256, 0.01, 1e-4
FOLDS = 5
THRESHOLD = 0.3
_MARKS = b"#$%&*|!?.,;:'\"-_/=+@<>()[]{}"


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learnt; a null doc_id is not one of them."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def structure(text: str, words: list[str], counts: Counter) -> list[float]:
    """Statistics of a text; all finite, also for an empty one."""
    data = text.encode()
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    size, n = max(1, len(data)), max(1, len(words))
    upper, lower = seen[65:91].sum(), seen[97:123].sum()
    lines = text.split("\n")
    filled = [x for x in lines if x]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    ended = sum(x[-1] in ".?!" for x in filled)
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        len(text) / size,
        upper / size,
        upper / max(1, upper + lower),
        seen[48:58].sum() / size,
        seen[128:].sum() / size,
        seen[[9, 10, 11, 12, 13, 32]].sum() / size,
        seen[list(_MARKS)].sum() / size,
        *(seen[mark] / n for mark in _MARKS),
        lengths.mean() / 10,
        lengths.std() / 10,
        np.log1p(lengths.max()),
        (lengths <= 3).mean(),
        len(counts) / n,
        sum(map(eq, words, words[1:])) / n,
        max(counts.values(), default=0) / n,
        len(set(filled)) / max(1, len(filled)),
        ended / max(1, len(filled)),
        len(words) / max(1, len(filled)) / 100,
    ]


STATISTICS = len(structure("", [], Counter()))


def features(texts: list[str]) -> np.ndarray:
    """The inputs of each text: statistics, then hashed words of length one."""
    out = np.zeros((len(texts), STATISTICS + HASHED), dtype=np.float32)
    for i, text in enumerate(texts):
        words = text.split()
        counts = Counter(words)
        out[i, :STATISTICS] = structure(text, words, counts)
        if words:
            hashes = np.fromiter((zlib.crc32(w.encode()) for w in counts), np.int64, len(counts))
            weights = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
            signed = weights * np.where(hashes >> 16 & 1, 1.0, -1.0)
            hashed = np.bincount(hashes % HASHED, weights=signed, minlength=HASHED)
            out[i, STATISTICS:] = hashed / max(1e-9, np.linalg.norm(hashed))
    return out


@dataclass
class Machine:
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = self.inputs(x)
        pairs = ((x @ self.factors) ** 2 - (x**2) @ (self.factors**2)).sum(axis=1) / 2
        value = self.bias + x @ self.linear + pairs
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Machine:
    """A machine for inputs x and labels y (0 or 1); with one class or none it gives its rate."""
    d = STATISTICS + HASHED
    mean, scale = np.zeros(d), np.ones(d)
    rate = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(rate / (1 - rate)))
    machine = Machine(mean, scale, bias, np.zeros(d), np.zeros((d, FACTORS)))
    if not len(y) or y.min() == y.max():
        return machine
    mean[:STATISTICS] = x[:, :STATISTICS].mean(axis=0)
    scale[:STATISTICS] = x[:, :STATISTICS].std(axis=0) + 1e-3
    scale[STATISTICS:] = 0.1
    random = np.random.default_rng(seed)
    x = machine.inputs(x).astype(np.float32)
    weights = [np.array([bias]), np.zeros(d), random.normal(0, 0.01, (d, FACTORS))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(y))
        for begin in range(0, len(y), BATCH):
            at = order[begin : begin + BATCH]
            xb, (w0, w, v) = x[at], weights
            q = xb @ v
            value = w0 + xb @ w + (q**2 - (xb**2) @ (v**2)).sum(axis=1) / 2
            error = (1 / (1 + np.exp(-np.clip(value, -30, 30))) - y[at]) / len(at)
            slopes = [
                np.array([error.sum()]),
                xb.T @ error + DECAY * w,
                xb.T @ (error[:, None] * q) - v * ((xb**2).T @ error)[:, None] + DECAY * v,
            ]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                up = first[k] / (1 - 0.9**step)
                weights[k] = weights[k] - rate * up / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(mean, scale, float(weights[0][0]), weights[1], weights[2])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits on at most `sample` labelled rows outside the held-out fold.

    Labels that are null or contradict each other are passed over. A document that occurs in
    several rows counts with one of them.
    """
    check_columns(labels, ("doc_id", "quality"))
    workers_import(docs.sparkSession)
    agreed = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("low"), F.max("quality").alias("y"))
        .where("low = y")
    )
    # At most `sample` rows of two numbers: a bounded side, whatever the corpus.
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "y")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                x = features(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("y").cast(pa.int32()),
                        pa.array([r.tobytes() for r in x], pa.binary()),
                    ],
                    names=["doc_id", "y", "x"],
                )

    rows = (
        texts.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "y", "text")
        .mapInArrow(prepare, "doc_id long, y int, x binary")
        .groupBy("doc_id", "y")
        .agg(F.min("x").alias("x"))
        .collect()
    )
    rows = sorted(rows, key=lambda r: r["doc_id"])
    x = np.frombuffer(b"".join(r["x"] for r in rows), dtype=np.float32)
    x = x.reshape(len(rows), STATISTICS + HASHED)
    return fit(x, np.array([r["y"] for r in rows], dtype=np.float64))


def score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """docs with a score (0 to 1, higher for better texts); a column of its name is replaced.

    Only the text is an input. A null text counts as empty, which has a score too.
    """
    check_columns(docs, ("text",))
    workers_import(docs.sparkSession)
    kept = [c for c in docs.columns if c != name]
    source = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), whole_text().alias("text")
    )
    schema = source.drop("text").schema.add("score", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                scores = machine.scores(features(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(scores, pa.float64())], names=schema.names
                )

    named = source.mapInArrow(scored, schema)
    columns = (F.col(f"c{i}").alias(c) for i, c in enumerate(kept))
    return named.select(*columns, F.col("score").alias(name))
