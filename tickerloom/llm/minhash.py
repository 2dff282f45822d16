"""Near-duplicates: SimHash links, MinHash and prefix filter for the rest, exact comparisons.

SimHash comes first: the texts that op8's fingerprints link are compared by their whole sets of shingles
and connected where these are similar. Its radius is narrow, so more pairs follow.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
`BANDS` keys of `ROWS` minima each choose the texts that can have a partner: a pair at exactly 0.8
shares no key with probability (1 - 0.8^4)^24, about 3e-6, a more similar one less. Among these texts
shingles are ordered by how many texts hold them, the rarest first. Sets that are similar enough share
a shingle among the first ninth of the smaller and the first fifth of the larger one, so only these
prefixes are indexed, and a passage that many texts share hardly ever reaches them. A pair whose sizes,
places or parities rule the similarity out is no candidate; every candidate pair is compared by its
whole sets.

Equal sets are one node, and pairs that are connected already, by SimHash first, need no comparison: in each of a few
turns a text meets one leader, and components found so far are contracted. What is still apart then
meets in pairs of the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tickerloom.llm.common import discard, settled, whole_text, workers_import
from tickerloom.llm.components import labelled
from tickerloom.llm.simhash import fingerprint, shingle_hashes
from tickerloom.llm.simhash import links as fingerprint_links

SHINGLE = 5
BANDS, ROWS = 24, 4
#: Turns in which each text meets one leader, before the pairs that are still apart.
LEADERS = 2

_FIXED = np.random.Generator(np.random.PCG64(8)).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_FLIP, _FACTOR = _FIXED[0], _FIXED[1] | np.uint64(1)
#: Words of a set's parities.
WORDS = 4
_PLACE = np.uint64(0xD1B54A32D192ED03)


def shingle_set(text: str) -> np.ndarray:
    """The different hashes of a text's shingles, sorted; empty where there are no words."""
    return np.unique(shingle_hashes(text, SHINGLE))


def keys(hashes: np.ndarray) -> list[int]:
    """The bucket keys of a set, as signed numbers; none of an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(hashes), 1024):
        part = (hashes[None, i : i + 1024] ^ _FLIP) * _FACTOR
        np.minimum(least, part.min(axis=1), out=least)
    bands = least.astype("<u8").reshape(BANDS, ROWS)
    digests = np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], np.uint64)
    return digests.view(np.int64).tolist()


def parities(hashes: np.ndarray) -> list[int]:
    """For each of 64 * WORDS bits whether an odd number of the set's shingles fall on it, as words.

    A shingle that only one of two sets holds changes one bit at most, so two sets differ in no fewer
    shingles than their parities in bits.
    """
    places = (hashes * _PLACE) >> np.uint64(64 - (64 * WORDS - 1).bit_length())
    odd = np.bincount(places.astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _signed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, digest, size, keys and parities of the shingle set of each row's `text`, and its SimHash."""
    schema = docs.select(*keep).schema.add("digest", "binary").add("size", "long")
    schema = schema.add("keys", ArrayType(LongType())).add("bits", ArrayType(LongType())).add("fp", "long")
    names = schema.names

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                digests, sizes, found, bits, fps = [], [], [], [], []
                for t in part.columns[-1]:
                    text = t.as_py()
                    hashes = shingle_set(text)
                    fps.append(fingerprint(text))
                    digests.append(xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes()))
                    sizes.append(len(hashes))
                    found.append(keys(hashes))
                    bits.append(parities(hashes))
                added = [
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(found, pa.list_(pa.int64())),
                    pa.array(bits, pa.list_(pa.int64())),
                    pa.array(np.array(fps, np.uint64).view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *added], names=names)

    workers_import(docs.sparkSession)
    return docs.select(*keep, "text").mapInArrow(signed, schema)


def _shingles(texts: DataFrame) -> DataFrame:
    """node, shingle: the different shingles of each text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(*batch.columns, strict=True):
                shingles = shingle_set(text.as_py()).view(np.int64)
                for i in range(0, len(shingles), 100_000):
                    part = pa.array(shingles[i : i + 100_000])
                    nodes = pa.array(np.full(len(part), node.as_py(), np.int64))
                    yield pa.RecordBatch.from_arrays([nodes, part], names=["node", "shingle"])

    workers_import(texts.sparkSession)
    return texts.select("node", "text").mapInArrow(hashed, "node long, shingle long")


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts have shingle sets with a Jaccard similarity of 0.8 or more."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pairs of one text follow each other, so its set is built once.
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            us, vs = (batch.column(c).to_pylist() for c in (0, 1))
            close = []
            for i, (u, v) in enumerate(zip(us, vs, strict=True)):
                for node, column in ((u, 2), (v, 3)):
                    if node not in known:
                        if len(known) > 64:
                            known.clear()
                        known[node] = shingle_set(batch.column(column)[i].as_py())
                x, y = known.get(u), known.get(v)
                x = shingle_set(batch.column(2)[i].as_py()) if x is None else x
                both = len(np.intersect1d(x, y, assume_unique=True))
                close.append(9 * both >= 4 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(close, pa.bool_()))

    left = texts.select(F.col("node").alias("u"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("y"))
    workers_import(texts.sparkSession)
    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y")
    return joined.mapInArrow(compared, "u long, v long")


def _prefixes(texts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, str]:
    """shingle, node, size, bits, place, indexed: prefixes of the sets of texts, rarest shingle first.

    place counts all shingles of the set in this order, those that no other text holds first.
    """
    spark = texts.sparkSession
    shingles, folder = settled(_shingles(texts), "shingles")
    counts = shingles.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # Only shingles of several texts can meet; how many of a set stand before them follows from its size.
    shared = shingles.join(counts, "shingle").join(nodes.select("node", "size", "bits"), "node")
    own = Window.partitionBy("node")
    rank = F.row_number().over(own.orderBy("n", "shingle")) + F.col("size") - F.count("*").over(own)
    placed = shared.withColumn("place", rank)
    probe = F.col("size") - F.ceil(F.col("size") * 4 / 5) + 1
    index = F.col("size") - F.ceil(F.col("size") * 8 / 9) + 1
    kept = placed.where(F.col("place") <= probe)
    result = settled(
        kept.select("shingle", "node", "size", "bits", "place", (F.col("place") <= index).alias("indexed")), "prefixes"
    )
    discard(spark, folder)
    return result


class _Components:
    """Labels of nodes under growing sets of links; what is connected is contracted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, None
        self.labels = spark.createDataFrame([], "node long, label long")

    def of(self, rows: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
        """rows with the label of a node column; a node without links is its own."""
        known = self.labels.select(F.col("node").alias(node), F.col("label").alias("known"))
        return rows.join(known, node, "left").withColumn(label, F.coalesce("known", node)).drop("known")

    def link(self, pairs: DataFrame) -> None:
        between = self.of(self.of(pairs, "u", "a"), "v", "b").select(F.col("a").alias("u"), F.col("b").alias("v"))
        components, components_folder = labelled(between, settled)
        merged = components.select(F.col("node").alias("label"), F.col("label").alias("to"))
        # Nodes with a label move with it; the others enter under their own name.
        held = self.labels.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        entered = merged.join(self.labels, merged["label"] == self.labels["node"], "left_anti")
        labels, folder = settled(held.unionByName(entered.select(F.col("label").alias("node"), F.col("to").alias("label"))), "labels")
        for used in (components_folder, self.folder):
            if used:
                discard(self.spark, used)
        self.labels, self.folder = labels, folder


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes that connect them as the links of their fingerprints (node, fp) do.

    Nodes with one fingerprint meet its smallest node only, and these meet along op8's links.
    """
    firsts = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    copies = nodes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    edges = fingerprint_links(firsts.select("fp")).withColumnsRenamed({"u": "fp", "v": "other_fp"})
    others = firsts.withColumnsRenamed({"fp": "other_fp", "first": "other"})
    between = edges.join(firsts, "fp").join(others, "other_fp").where("first <> other")
    return copies.unionByName(between.select(F.least("first", "other").alias("u"), F.greatest("first", "other").alias("v"))).distinct()


def links(nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, str | None]:
    """node, label of the nodes that similar pairs connect, and the folder that holds them.

    nodes has node, size, keys, bits and fp, texts node and text. A node without similar others has no row, or
    its own label.
    """
    spark = nodes.sparkSession
    found = _Components(spark)
    near, near_folder = settled(_simhash_pairs(nodes.select("node", "fp")), "near")
    each = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = each.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    partnered = each.join(shared.select("band", "key"), ["band", "key"], "left_semi").select("node")
    partnered = partnered.unionByName(near.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    chosen, chosen_folder = settled(nodes.select("node", "size", "bits").join(partnered, "node", "left_semi"), "chosen")
    if chosen.isEmpty():
        for folder in (near_folder, chosen_folder):
            discard(spark, folder)
        return found.labels, None
    held, held_folder = settled(texts.join(chosen, "node", "left_semi").select("node", "text"), "texts")
    similar, similar_folder = settled(_similar(near, held), "similar")
    found.link(similar)
    for folder in (near_folder, similar_folder):
        discard(spark, folder)
    prefixes, prefix_folder = _prefixes(held, chosen)
    discard(spark, chosen_folder)
    # The smaller set has four fifths of the larger one's entries at least.
    fits = 5 * F.least("size", "other_size") >= 4 * F.greatest("size", "other_size")
    # Similar sets differ in a ninth of their entries at most, their parities in no more bits.
    bits = sum(F.bit_count(F.col("bits")[w].bitwiseXOR(F.col("other_bits")[w])) for w in range(WORDS))
    fits = fits & (9 * bits <= F.col("size") + F.col("other_size"))
    ordered = [F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")]
    for turn in range(LEADERS + 1):
        current, current_folder = settled(found.of(prefixes), "current")
        spread = current.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        apart = current.join(spread.where("low < high").select("shingle"), "shingle", "left_semi")
        differ = F.col("label") != F.col("other_label")
        names = ("node", "size", "label", "bits")
        renamed = [F.col(n).alias("other" if n == "node" else f"other_{n}") for n in names]
        if turn < LEADERS:
            # One leader per shingle, and of a text's leaders one.
            first = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), *renamed))
            leaders = apart.groupBy("shingle").agg(first.alias("l")).select("shingle", "l.*")
            met = apart.join(leaders, "shingle").where(differ & fits)
            met = met.groupBy("node").agg(F.min(F.struct("order", "other"))["other"].alias("other"))
        else:
            indexed = apart.where("indexed")
            probes = apart.select("shingle", *renamed, F.col("place").alias("other_place"))
            smaller = F.struct("size", "node") < F.struct("other_size", "other")
            # No more than the rest of both sets behind the shingle can be shared as well.
            rest = F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place")) + 1
            enough = 9 * rest >= 4 * (F.col("size") + F.col("other_size"))
            met = indexed.join(probes, "shingle").where(smaller & differ & fits & enough)
        pairs, pairs_folder = settled(met.select(*ordered).distinct(), "pairs")
        similar, similar_folder = settled(_similar(pairs, held), "similar")
        found.link(similar)
        for folder in (current_folder, pairs_folder, similar_folder):
            discard(spark, folder)
    for folder in (held_folder, prefix_folder):
        discard(spark, folder)
    return found.labels, found.folder


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of similar texts: the smallest doc_id, by a hash on ties.

    Groups are connected by links. A null doc_id is larger than any other; texts without words are
    one group; a null text is empty; of repeated rows one stays; texts may be of any length; an empty
    table stays empty. All columns are kept, whatever their names.
    """
    spark = docs.sparkSession
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text, doc_id = inner["text"], inner["doc_id"]
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()))
    sha = F.unhex(F.substring(F.sha2(F.encode(whole_text(text), "UTF-8"), 256), 1, 32))
    source = renamed.withColumns({"doc": F.col(doc_id), "sha": sha, "text": whole_text(text)})
    signed, signed_folder = settled(_signed(source, ["doc", "sha"]), "signed")
    order = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("sha").alias("sha"))
    # Copies meet only in the aggregate.
    groups = signed.groupBy("digest").agg(
        F.min(order).alias("best"), *(F.any_value(c).alias(c) for c in ("size", "keys", "bits")), F.min("fp").alias("fp")
    )
    nodes, nodes_folder = settled(groups.drop("digest").withColumn("node", F.monotonically_increasing_id()), "nodes")
    chosen = nodes.select("node", F.col("best.sha").alias("sha"), F.col("best.doc").alias("at"))
    # One of the rows that hold a node's first text.
    texts = source.join(chosen, "sha").where(F.col("doc").eqNullSafe(F.col("at"))).dropDuplicates(["node"])
    labels, labels_folder = links(nodes, texts)
    kept = (
        nodes.join(labels, "node", "left")
        .groupBy(F.coalesce("label", "node").alias("label"))
        .agg(F.min("best").alias("best"))
    )
    # Repeated rows, of which one stays, are rare; only they are grouped with all their columns.
    repeated = signed.groupBy("doc", "sha").agg((F.count("*") > 1).alias("again")).where("again")
    chosen_rows = kept.select("best.doc", "best.sha")
    same = lambda x, y: x["doc"].eqNullSafe(y["doc"]) & (x["sha"] == y["sha"])
    marked = chosen_rows.join(repeated, same(chosen_rows, repeated), "left").select(
        chosen_rows["doc"], chosen_rows["sha"], F.coalesce(repeated["again"], F.lit(False)).alias("again")
    )
    final, _ = settled(marked, "kept")
    for folder in (signed_folder, nodes_folder, labels_folder):
        if folder:
            discard(spark, folder)
    columns = list(inner.values())
    rows = source.select("doc", "sha", *columns)
    once, several = final.where("not again"), final.where("again")
    alone = rows.join(once, same(rows, once), "left_semi").select(*columns)
    more = rows.join(several, same(rows, several), "left_semi").groupBy("doc", "sha").agg(
        F.any_value(F.struct(*columns)).alias("row")
    )
    both = alone.unionByName(more.select("row.*"))
    return both.select(*(F.col(n).alias(c) for c, n in inner.items()))
