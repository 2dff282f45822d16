"""Centroids, suffix-array deduplication and source divergence against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import centroids, divergence, queries, repeats, suffixes

SF = "/root/testdata/sf0.001"


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


# ---------------------------------------------------------------- centroids

CLUSTER_COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def plain_clusters(vectors, k=8, rounds=10, dimensions=64):
    kept = [
        (i, [math.floor(1024 * float(c)) for c in v])
        for i, v in vectors
        if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)
    ]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def near(x):
        distances = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centres]
        return distances.index(min(distances)), min(distances)

    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in kept:
            members[near(x)[0]].append(x)
        for c, xs in members.items():
            centres[c] = [sum(column) // len(xs) for column in zip(*xs, strict=True)]
    rows = [(i, *near(x)) for i, x in kept]
    of = Counter()
    for _, c, d in rows:
        of[c] += d
    fits = lambda d: d if d < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, fits(d), fits(of[c]), fits(sum(of.values())), sha[c]) for i, c, d in rows), key=repr)


def test_clusters_of_the_registered_query(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = queries.op11_centroid_clusters(spark, SF)
    assert tuple(found.columns) == CLUSTER_COLUMNS
    assert rows_of(found, *CLUSTER_COLUMNS) == plain_clusters(vectors)


def hostile_vectors():
    r = random.Random(11)
    vector = lambda: [r.uniform(-1, 1) for _ in range(4)]
    rows = [(i, vector()) for i in range(30)]
    rows += [(3, [0.5, 0.5, -0.5, 0.25])] * 3 + [(None, vector()), (40, [0.0] * 4), (41, [1e6, -1e6, 3.0, 0.0])]
    rows += [(50, None), (51, []), (52, [1.0, 2.0]), (53, [None, 1.0, 1.0, 1.0]), (54, [math.nan, 1.0, 1.0, 1.0])]
    return rows + [(55, [math.inf, 1.0, 1.0, 1.0])]


@pytest.mark.parametrize("rows", [hostile_vectors(), hostile_vectors()[:3], [(1, [1e13, 0.0, 0.0, 0.0]), (2, [-1e13, 0.0, 0.0, 0.0]), (3, [9.0] * 4)]])
def test_clusters_of_hostile_vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    frame = frame.withColumns({c: F.lit("clash") for c in ("x", "identity", "vector", "cluster", "distance", "inertia")})
    found = centroids.clusters(frame, dimensions=4, k=3, rounds=4)
    assert rows_of(found, *CLUSTER_COLUMNS) == plain_clusters(rows, 3, 4, 4)


def test_vectors_too_large_to_scale_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [1e300] * 4), (2, [1.0] * 4)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in centroids.clusters(frame, dimensions=4).collect()] == [2]
    nothing = centroids.clusters(frame.where("false"), dimensions=4)
    assert tuple(nothing.columns) == CLUSTER_COLUMNS and nothing.isEmpty()


# ---------------------------------------------------------------- suffix arrays


def test_suffix_arrays_and_common_prefixes():
    r = random.Random(1)
    for turn in range(600):
        alphabet = [0, 1, 97, 98, 255][: r.choice([1, 2, 3, 5])]
        data = bytes(r.choice(alphabet) for _ in range(r.randrange(60)))
        if turn % 5 == 0:
            data = (data[:7] * 9)[:60]
        if turn % 7 == 0:
            data = b"\xff".join([data[:20], data[5:25], data[:20]])
        text = np.frombuffer(data, np.uint8)
        order = suffixes.suffix_array(text)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        prefixes = suffixes.common_prefixes(text, order)
        for a, b in itertools.pairwise(order.tolist()):
            pairs = zip(data[a:], data[b:], strict=False)
            shared = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1] != 255, pairs))
            assert prefixes[b] == shared


REPEAT_COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def plain_repeats(rows, length=100):
    """Equal (doc_id, text) rows are one document; rows are given in the order that ties take."""
    seen, results = set(), {}
    for doc, text in sorted(dict.fromkeys(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            string = data[i : i + length]
            if string in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(string)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(g > b for b, g in zip([0, *gone], gone))
        results[doc, text] = (doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted((results[r] for r in rows), key=repr)


def planted_repeats():
    r = random.Random(5)
    passages = ["".join(r.choice("ab cdé中") for _ in range(500)) for _ in range(4)]
    rows = []
    for i in range(150):
        text = ""
        for _ in range(r.randrange(4)):
            if r.random() < 0.5:
                begin = r.randrange(500)
                text += r.choice(passages)[begin : begin + r.randrange(400)]
            else:
                text += "".join(r.choice("xyz") for _ in range(r.randrange(150)))
        rows.append((i, text))
    rows += [(1000, "a" * 1000), (1001, "ab" * 300), (1002, None), (1003, ""), (1004, rows[5][1])]
    rows += [(1005, "b" * 99), (1006, "c" * 100), (1007, "c" * 101), (1008, passages[0] * 40)] * 2
    return [*rows, (None, rows[9][1] + "q" + passages[1])]


@pytest.mark.parametrize("options", [{}, {"crowd": 2}, {"shard_bytes": 20_000, "crowd": 10}, {"gram": 20}])
def test_repeats_by_brute_force(spark, options):
    rows = planted_repeats()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame = frame.withColumns({c: F.lit("clash") for c in ("id", "digest", "doc", "first", "n_bytes", "piece")})
    found = repeats.deduplicated(frame, **options)
    assert rows_of(found, *REPEAT_COLUMNS) == plain_repeats(rows)


def test_long_texts_are_cut_into_slices_without_loss(monkeypatch):
    r = random.Random(9)
    text = "".join(r.choice("abc d") for _ in range(9000)).encode()
    whole = set()
    monkeypatch.setattr(repeats, "SLICE", 1000)
    for data, parts in repeats._slices([b"short", text, text[:150]], 100):
        sizes = np.array([p[2] for p in parts])
        ends = np.cumsum(sizes)
        starts, runs, grams = repeats.pieces(data, ends - sizes, ends, 100, 32)
        own = np.searchsorted(ends - sizes, starts, side="right") - 1
        for s, n, g, o in zip(starts, runs, grams, own, strict=True):
            for k in range(s, s + n):
                place = (parts[o][0], int(k - (ends - sizes)[o]) + parts[o][1])
                assert place not in whole
                whole.add(place)
    assert whole == {(1, i) for i in range(len(text) - 99)} | {(2, i) for i in range(51)}


def test_repeats_of_the_registered_query_and_of_nothing(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert rows_of(queries.op12_suffix_dedup(spark, SF), *REPEAT_COLUMNS) == plain_repeats(rows)
    assert repeats.deduplicated(documents.where("false")).isEmpty()


# ---------------------------------------------------------------- divergence

AUDIT_COLUMNS = ("lang", "source", "part", "item", "value", "rank")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows):
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((t or "", x or "", s or "") for t, x, s in rows):
        words = Counter(w.translate(LOWER) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text))
        counts[lang, source].update(words)
        documents[lang].update(words.keys())
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {lang for lang, _ in counts}:
        kept = [t for t, n in documents[lang].items() if n >= 10]
        sources = [s for x, s in counts if x == lang]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out, key=repr)


def test_audit_of_the_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source").collect()]
    assert rows_of(queries.op13_source_divergence(spark, SF), *AUDIT_COLUMNS) == plain_audit(rows)


def test_audit_of_hostile_rows_in_small_blocks(spark, monkeypatch):
    r = random.Random(13)
    words = [f"{a}{b}é" for a in "abcXY" for b in "klmn"] + ["中文", "the", "THE", "a\0b"]
    rows = [(" ".join(r.choices(words, k=r.randrange(30))), r.choice(["en", "de", None]), f"s{r.randrange(4)}") for _ in range(120)]
    rows += rows[:9] + [(None, None, None), ("", "en", "empty"), ("once only", "xx", "s1"), ("", "xx", "s2"), ("alone", "yy", None)]
    rows += [("the " * 50_000, "en", "s1")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    frame = frame.withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "block", "entries", "value")})
    monkeypatch.setattr(divergence, "BLOCK", 3)
    assert rows_of(divergence.audit(frame), *AUDIT_COLUMNS) == plain_audit(rows)
    assert divergence.audit(frame.where("false")).isEmpty()


def test_counts_of_texts_in_slices(monkeypatch):
    text = "The quick Äpfel, brown-fox; the END " * 50
    whole = divergence.term_counts(text)
    monkeypatch.setattr(divergence, "_SLICE", 64)
    assert divergence.term_counts(text) == whole and whole[b"the"] == 100
