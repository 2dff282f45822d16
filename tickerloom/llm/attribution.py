"""Token counts per section, from one encoding of the whole document.

A document is encoded once, whole, so that its counts add up to the document's own count, which
separate encodings of its sections would not. Each token has a span of characters; spans and
sections are both sorted, and an interval join finds the sections that a token meets. A token
that meets several belongs to the one that holds most of its characters, the earlier on a tie; one
that meets none belongs to section -1, outside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.bpe import Encoder, encoder
from tickerloom.llm.common import check_columns, prefix_sums, slices, whole_text, workers_import

OUTSIDE = -1
_COUNTED = (
    "doc_id long, section int, section_start long, section_end long, "
    "n_tokens long, n_crossing long, doc_tokens long"
)
_NAMES = [c.split()[0] for c in _COUNTED.split(", ")]


def lines(text: str | Column = "text") -> Column:
    """Spans (start, end in code points, end exclusive) of the lines of a text, without their ends."""
    parts = F.split(whole_text(text), "\n", -1)
    sizes = F.transform(parts, lambda x: (F.length(x) + 1).cast("long"))
    return F.zip_with(
        prefix_sums(sizes), sizes, lambda a, n: F.struct(a.alias("start"), (a + n - 1).alias("end"))
    )


def token_spans(coder: Encoder, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token; a token inside a character has that character's."""
    ends = np.cumsum(coder.byte_lengths[ids])
    starts = ends - coder.byte_lengths[ids]
    if text.isascii():
        return starts, ends
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1] + 1


def attribute(
    starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, stops: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether the token reaches beyond that section."""
    first = np.searchsorted(stops, starts, side="right")
    after = np.searchsorted(begins, ends, side="left")
    section = np.where(after > first, first, OUTSIDE)
    for i in np.flatnonzero(after - first > 1):
        k = np.arange(first[i], after[i])
        shared = np.minimum(ends[i], stops[k]) - np.maximum(starts[i], begins[k])
        section[i] = k[np.argmax(shared)]
    inside = section >= 0
    crossing = np.zeros(len(section), dtype=bool)
    own = section[inside]
    crossing[inside] = (starts[inside] < begins[own]) | (ends[inside] > stops[own])
    return section, crossing


def token_counts(docs: DataFrame, path: str, sections: Column | None = None) -> DataFrame:
    """Rows doc_id, section, section_start, section_end, n_tokens, n_crossing, doc_tokens.

    sections: an array of spans (start, end in code points) of the text, sorted and without
    overlaps; by default the lines. Each section of each row of docs gives one row, also without
    tokens; section -1, with null bounds, has the tokens outside all sections. n_crossing of them
    reach beyond their section. A null text counts as empty, null sections as none. Byte-level
    vocabularies only.
    """
    check_columns(docs, ("doc_id", "text"))
    workers_import(docs.sparkSession)
    spans = lines() if sections is None else sections
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        whole_text().alias("text"),
        F.transform(spans, lambda s: s["start"].cast("long")).alias("begins"),
        F.transform(spans, lambda s: s["end"].cast("long")).alias("stops"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            doc_ids, texts, *bounds = (c.to_pylist() for c in batch.columns)
            for i, j in slices(texts):
                out: list[list] = [[] for _ in _NAMES]
                for k, ids in zip(range(i, j), coder.encode(texts[i:j]), strict=True):
                    starts, ends = token_spans(coder, texts[k], ids)
                    begins, stops = (np.array(b[k] or [], dtype=np.int64) for b in bounds)
                    section, crossing = attribute(starts, ends, begins, stops)
                    size = len(begins) + 1
                    tokens = np.bincount(section + 1, minlength=size)
                    across = np.bincount(section + 1, weights=crossing, minlength=size)
                    out[0] += [doc_ids[k]] * size
                    out[1] += range(-1, size - 1)
                    out[2] += [None, *begins.tolist()]
                    out[3] += [None, *stops.tolist()]
                    out[4] += tokens.tolist()
                    out[5] += across.astype(np.int64).tolist()
                    out[6] += [len(ids)] * size
                kinds = [pa.int32() if n == "section" else pa.int64() for n in _NAMES]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=_NAMES
                )

    return source.mapInArrow(count, _COUNTED)
