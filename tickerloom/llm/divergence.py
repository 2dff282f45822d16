"""Divergence of term frequencies between the sources of a language, over run-length columns.

A group is a language and a source. Its column holds its count of every kept term of the language.
The vocabulary of a language is dealt into blocks by a hash of the term, and within a block terms
are reordered so that equal counts lie together; each group's column is then stored as runs of equal
counts. Two columns are compared at the cuts of both: the divergence f of a run counts as often as
the run is long. All arithmetic is on whole numbers.

A block holds about `BLOCK` terms however large the vocabulary is, a term that is very common is one
row, and all sums combine before they are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import check_columns, whole_text, workers_import, written

#: A term of a language is kept if it occurs in so many of its documents.
LEAST_DOCUMENTS = 10
TOP = 10
#: p = 1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)).
SCALE, SMOOTH = 1_000_000_000, 2
#: Terms of a block, and different terms a task holds while it counts.
BLOCK, HELD = 32_768, 200_000

# Every byte that is no part of a term becomes a space; A-Z become lower case.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_SLICE = 1 << 22


def term_counts(text: str) -> Counter:
    """Occurrences of every term (as UTF-8) of a text; texts of any length, a slice at a time."""
    data = text.encode().translate(_WORDS)
    if len(data) <= _SLICE:
        return Counter(data.split())
    counts, begin = Counter(), 0
    while begin < len(data):
        end = data.find(b" ", begin + _SLICE)
        end = len(data) if end < 0 else end
        counts.update(data[begin:end].split())
        begin = end
    return counts


def _counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts of each task."""
    names = ["lang", "source", "term", "n", "docs"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, documents) in held.items():
                terms = list(n)
                for i in range(0, len(terms), 50_000):
                    part = terms[i : i + 50_000]
                    columns = [[lang] * len(part), [source] * len(part), [t.decode() for t in part]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array(c, pa.string()) for c in columns),
                            pa.array([n[t] for t in part], pa.int64()),
                            pa.array([documents[t] for t in part], pa.int64()),
                        ],
                        names=names,
                    )
            held.clear()

        for batch in batches:
            columns = [batch.column(c) for c in range(3)]
            for i in range(batch.num_rows):
                lang, source, text = (c[i].as_py() for c in columns)
                own = term_counts(text)
                n, documents = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(own)
                documents.update(own.keys())
                size += len(n)
                if size > HELD:
                    yield from flushed()
                    size = 0
        yield from flushed()

    workers_import(docs.sparkSession)
    return docs.select("lang", "source", "text").mapInArrow(
        counted, "lang string, source string, term string, n long, docs long"
    )


def frequency(count: int, total: int, terms: int) -> int:
    return 1 + SCALE * (count + SMOOTH) // (total + SMOOTH * terms)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f of whole numbers: below 2 * SCALE, so their squares fit 64 bits."""
    return (p - q) * (p - q) // (p + q)


class RunLengthColumn:
    """Frequencies of one group over the reordered terms of a block, as runs of equal counts."""

    def __init__(self, counts: np.ndarray, total: int, terms: int):
        cuts = np.flatnonzero(np.diff(counts)) + 1
        self.starts = np.concatenate([[0], cuts]) if len(counts) else np.zeros(0, np.int64)
        self.size = len(counts)
        runs = counts[self.starts] if len(counts) else counts
        values, places = np.unique(runs, return_inverse=True)
        # Whole numbers of Python, as a count times the scale may pass 64 bits.
        each = np.array([frequency(int(c), total, terms) for c in values], np.int64)
        self.p = each[places] if len(each) else np.zeros(0, np.int64)

    def at(self, positions: np.ndarray) -> np.ndarray:
        return self.p[np.searchsorted(self.starts, positions, side="right") - 1]

    def against(self, other: "RunLengthColumn") -> int:
        """Sum of f over all terms of the block, run by run."""
        if not self.size:
            return 0
        cuts = np.union1d(self.starts, other.starts)
        lengths = np.diff(np.append(cuts, self.size))
        return int((divergence(self.at(cuts), other.at(cuts)) * lengths).sum())


def _reordered(block: pd.DataFrame, sources: list[str]) -> tuple[list[str], dict[str, np.ndarray]]:
    """Terms of a block ordered by their counts, and the counts of each source in that order.

    The source with the most terms decides first, so that its runs are longest.
    """
    places = {s: i for i, s in enumerate(sources)}
    filled = Counter(s for names in block["sources"] for s in names)
    rank = sorted(range(len(sources)), key=lambda i: (-filled[sources[i]], i))
    turn = {place: t for t, place in enumerate(rank)}
    signatures = [
        tuple(sorted((turn[places[s]], -int(n)) for s, n in zip(names, counts, strict=True)))
        for names, counts in zip(block["sources"], block["counts"], strict=True)
    ]
    order = sorted(range(len(block)), key=signatures.__getitem__)
    columns = {s: np.zeros(len(block), np.int64) for s in filled}
    for position, row in enumerate(order):
        for s, n in zip(block["sources"].iat[row], block["counts"].iat[row], strict=True):
            columns[s][position] = n
    terms = block["term"].tolist()
    return [terms[i] for i in order], columns


def _block_results(key: tuple, block: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Of one block: pair rows (both sources, part of their sum) and candidate term rows."""
    lang = key[0]
    groups = groups.sort_values("source")
    sources, totals = groups["source"].tolist(), [int(t) for t in groups["total"]]
    terms_of_lang, lang_total = int(groups["terms"].iat[0]), sum(totals)
    terms, counts = _reordered(block, sources)
    nothing = np.zeros(len(terms), np.int64)
    columns = {
        s: RunLengthColumn(counts.get(s, nothing), total, terms_of_lang)
        for s, total in zip(sources, totals, strict=True)
    }
    rows = []
    for i, s in enumerate(sources):
        for t in sources[i + 1 :]:
            rows.append((lang, s, "pair", t, columns[s].against(columns[t])))
    whole = RunLengthColumn(sum(counts.values(), nothing), lang_total, terms_of_lang)
    everywhere = np.arange(len(terms))
    q = whole.at(everywhere) if terms else nothing
    for s, own in counts.items():
        p = columns[s].at(everywhere)
        found = np.flatnonzero((own > 0) & (p > q))
        values = divergence(p[found], q[found])
        if len(found) > TOP:  # the block's share of the group's best, with all ties
            least = np.partition(values, -TOP)[-TOP]
            found, values = found[values >= least], values[values >= least]
        best = sorted(zip((-values).tolist(), (terms[f].encode() for f in found), strict=True))[:TOP]
        rows += [(lang, s, "term", term.decode(), -value) for value, term in best]
    return pd.DataFrame(rows, columns=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank over docs (text, lang, source).

    Part `pair`: every other source of the language with the sum of f over all kept terms (0 where a
    language keeps none), ranked. Part `term`: the up to ten kept terms that occur in the group more
    often than in its language, by f. Equal values are ranked by item. A null lang, source or text is
    empty; an empty text still makes its group; each row counts as a document, repeated ones too; a
    language with one source has no pair rows; an empty table gives no rows. Other columns are not
    read, whatever their names.
    """
    check_columns(docs, ("text", "lang", "source"))
    spark = docs.sparkSession
    # The text as it is: the frame has no other columns that could clash.
    named = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
        whole_text("text").alias("text"),
    )
    counted = (
        _counted(named)
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    entry = F.collect_list(F.struct("source", "n"))
    terms, _ = written(
        counted.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sort_array(entry).alias("entries"))
        .where(F.col("docs") >= LEAST_DOCUMENTS)
        .select("lang", "term", "entries"),
        "terms",
    )
    each = terms.select("lang", F.explode("entries").alias("e")).groupBy("lang", "e.source")
    totals = each.agg(F.sum("e.n").alias("total"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    groups, _ = written(
        named.select("lang", "source")
        .distinct()
        .join(totals, ["lang", "source"], "left")
        .join(kept, "lang", "left")
        .select(
            "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")
        ),
        "groups",
    )
    # Every block of a language gets its groups; a language without kept terms has one empty block.
    blocks = F.greatest(F.ceil(F.col("terms") / BLOCK), F.lit(1)).cast("int")
    dealt = terms.join(kept, "lang").select(
        "lang",
        F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"),
        "term",
        F.col("entries.source").alias("sources"),
        F.col("entries.n").alias("counts"),
    )
    everywhere = groups.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    results = (
        dealt.groupBy("lang", "block")
        .cogroup(everywhere.groupBy("lang", "block"))
        .applyInPandas(_block_results, "lang string, source string, part string, item string, value long")
    )
    found, _ = written(results, "divergence")
    one_way = found.where("part = 'pair'").groupBy("lang", "source", "part", "item")
    pairs = one_way.agg(F.sum("value").alias("value"))
    both = pairs.unionByName(
        pairs.select(
            "lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"
        )
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(best)
    top = found.where("part = 'term'").withColumn("rank", ranked).where(F.col("rank") <= TOP)
    return both.withColumn("rank", ranked).unionByName(top)
