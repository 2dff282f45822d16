"""Byte-pair encoding and decoding with a tokenizers vocabulary; long texts in parts.

`Encoder` gives the ids of the tokenizers library. Texts of Latin letters and common punctuation,
whose character classes no Unicode version has changed, take a quicker way through merge ranks
with the same result; all others, and texts with very long unsplit runs, go through the library.

A text of more than LONG_CHARS characters is encoded by tree concatenation: its parts are encoded
in parallel tasks, then neighbours are joined pairwise. A join re-encodes a window of tokens on
both sides of the seam and doubles it until the outer tokens of the window are those that either
side had there; a window that covers both sides is the plain encoding, so the loop ends.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks own the cores

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402
import pyarrow as pa  # noqa: E402
import tiktoken  # noqa: E402
from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tickerloom.llm.common import check_columns, slices, whole_text, workers_import  # noqa: E402

#: Longer texts are encoded in parts of PART_CHARS characters.
LONG_CHARS = 32_768
PART_CHARS = 16_384
#: Tokens on each side of a seam in the first window, and how many must agree at its ends.
WINDOW, AGREE = 32, 8

_NOT_PLAIN = re.compile("[^\x01-įı-ſ‐-‧‰-⁞₠-₿]")
_LONG_RUN = re.compile(r"\S{400}|\s{400}")
_SPACE = "\t-\r \x85\xa0"
_L, _N = (
    "".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == k) for k in "LN"
)
#: The pre-token patterns of the two public vocabularies.
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_SPACE}{_L}{_N}]+"
_WORD_END = "</w>"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """encode() gives what the library's encode(add_special_tokens=False) gives."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.words = described["model"].get("end_of_word_suffix") == _WORD_END
        self.specials = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
        self._vocabulary = described["model"]["vocab"]
        self._pieces = re.compile(_WORD_PATTERN).findall
        # A word end is byte 0 here: texts that hold it go through the library.
        shown, ranks = byte_alphabet(), {}
        for token, k in self._vocabulary.items():
            if token not in self.specials:
                end = self.words and token.endswith(_WORD_END)
                body = token.removesuffix(_WORD_END) if end else token
                ranks[bytes(shown[c] for c in body) + b"\0" * end] = k
        self._ranks = tiktoken.Encoding(
            "ranks",
            pat_str=r"[^\x00]+\x00" if self.words else _BYTE_PATTERN,
            mergeable_ranks=ranks,
            special_tokens={},
        )
        table = [b""] * (1 + max([*self._vocabulary.values(), *self.specials.values()]))
        for token, k in ranks.items():
            table[k] = token
        for token, k in self.specials.items():
            table[k] = token.encode()
        #: The bytes each id stands for; 0 marks a word end where the vocabulary has them.
        self.token_bytes = table
        self.byte_lengths = np.array([len(x) for x in table], dtype=np.int64)
        self.inside = np.array([x[:1] != b"" and x[0] & 0xC0 == 0x80 for x in table])
        self.decimal = [str(k) for k in range(len(table))]

    def _quick(self, text: str) -> bool:
        return not (
            _NOT_PLAIN.search(text) or any(s in text for s in self.specials) or _LONG_RUN.search(text)
        )

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if not self._quick(text):
                rest.append(i)
            elif not self.words:
                out[i] = self._ranks.encode_to_numpy(text, disallowed_special=())
            elif pieces := self._pieces(text.lower()):
                text = "\0".join(pieces) + "\0"
                out[i] = self._ranks.encode_to_numpy(text, disallowed_special=())
            else:
                out[i] = np.empty(0, dtype="<u4")
        found = self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        for i, ids in zip(rest, found, strict=True):
            out[i] = np.array(ids.ids, dtype="<u4")
        return out

    def raw(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decode(skip_special_tokens=False) gives, for byte-level ids."""
        if self.words:
            return self.library.decode(ids.tolist(), skip_special_tokens=False)
        return self.raw(ids).decode("utf-8", "replace")

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of a text from the ids of its two parts (byte-level vocabularies)."""
        k = WINDOW
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            while i and self.inside[left[i]]:
                i -= 1
            while j < len(right) and self.inside[right[j]]:
                j += 1
            a, b = left[i:], right[:j]
            (middle,) = self.encode([(self.raw(a) + self.raw(b)).decode()])
            if (not i or np.array_equal(middle[:AGREE], a[:AGREE])) and (
                j == len(right) or np.array_equal(middle[-AGREE:], b[-AGREE:])
            ):
                return np.concatenate([left[:i], middle, right[j:]])
            k *= 2

    def concatenate(self, parts: list[np.ndarray]) -> np.ndarray:
        """Joins the ids of consecutive parts pairwise, as a tree."""
        while len(parts) > 1:
            parts = [
                self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i]
                for i in range(0, len(parts), 2)
            ]
        return parts[0]

    def ids_sha256(self, ids: np.ndarray) -> str:
        text = ",".join(map(self.decimal.__getitem__, ids.tolist()))
        return hashlib.sha256(text.encode()).hexdigest()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    return Encoder(path)


_ENCODED = "doc_id long, ids binary, n_tokens long, ids_sha256 string"
_ENCODED_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string())]
)


def _encoded(coder: Encoder, doc_ids: list, ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array(doc_ids, pa.int64()),
            pa.array([x.astype("<u4", copy=False).tobytes() for x in ids], pa.binary()),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([coder.ids_sha256(x) for x in ids], pa.string()),
        ],
        schema=_ENCODED_ARROW,
    )


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens and ids_sha256 of each row of docs.

    A null text counts as empty: no ids. Repeated rows give repeated results, a null doc_id stays
    null, other columns of docs are ignored, and an empty table gives no rows.
    """
    check_columns(docs, ("doc_id", "text"))
    workers_import(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    is_long = F.length("text") > LONG_CHARS

    def encode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(texts):
                yield _encoded(coder, doc_ids[i:j], coder.encode(texts[i:j]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [text[i : i + PART_CHARS] for i in range(0, len(text), PART_CHARS)]
                yield pa.record_batch(
                    [
                        pa.array([row] * len(parts), pa.int64()),
                        pa.array([doc_id] * len(parts), pa.int64()),
                        pa.array(range(len(parts)), pa.int32()),
                        pa.array(parts, pa.string()),
                    ],
                    names=["row", "doc_id", "part", "text"],
                )

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for i, j in slices(texts):
                ids = [x.astype("<u4", copy=False).tobytes() for x in coder.encode(texts[i:j])]
                columns = [batch.column(c).slice(i, j - i) for c in range(3)]
                yield pa.record_batch(
                    [*columns, pa.array(ids, pa.binary())], names=["row", "doc_id", "part", "ids"]
                )

    def concatenate(group: pd.DataFrame) -> pd.DataFrame:
        coder = encoder(path)
        parts = [np.frombuffer(x, dtype="<u4") for x in group.sort_values("part")["ids"]]
        ids = [coder.concatenate(parts)]
        return _encoded(coder, [None], ids).to_pandas().assign(doc_id=group["doc_id"].iloc[0])

    short = docs.where(~is_long).mapInArrow(encode_whole, _ENCODED)
    long = (
        docs.where(is_long)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        .mapInArrow(cut, "row long, doc_id long, part int, text string")
        .repartition("row", "part")
        .mapInArrow(encode_parts, "row long, doc_id long, part int, ids binary")
        .groupBy("row")
        .applyInPandas(concatenate, _ENCODED)
    )
    return short.unionByName(long)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column decoded: the text of ids. Null ids give an empty text."""
    check_columns(encoded, ("ids",))
    workers_import(encoded.sparkSession)
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = encoded.select(*kept).schema.add("decoded", "string")
    at = kept.index("ids")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [np.frombuffer(x or b"", dtype="<u4") for x in part.column(at).to_pylist()]
                decoded = pa.array([coder.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(texts, schema)
