"""Concentration of current direct-long holdings by economic entity.

Weights are whole numbers of the smallest money unit, so every sum and square is exact in any order.
All measures combine map-side: sums in Spark's own aggregates, the largest weights of a fund in a
buffer of fixed size per fund and task. A fund with very many entities costs its map tasks, and its
last task reads at most `TOP_HOLDINGS` weights of each of them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.schemas import TOP_HOLDINGS

# Tasks get the helpers below by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Funds whose buffers a task holds before it hands them on.
HELD_FUNDS = 50_000


def largest_of(funds: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest weights of every fund; funds are small whole numbers."""
    order = np.lexsort((-weights, funds))
    sizes = np.bincount(funds, minlength=1)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return order[rank < k]


def largest_weights(weights: DataFrame, k: int = TOP_HOLDINGS) -> DataFrame:
    """fund, largest: the k largest weights of each fund in descending order.

    weights has fund (string) and weight (long). Each task keeps k weights per fund.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"fund": pa.array([], pa.string()), "weight": pa.array([], pa.int64())})
        for batch in batches:
            merged = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(held.schema)]).combine_chunks()
            encoded = merged.column("fund").chunk(0).dictionary_encode() if merged.num_rows else None
            if encoded is None:
                continue
            places = largest_of(
                encoded.indices.to_numpy(zero_copy_only=False), merged.column("weight").to_numpy(), k
            )
            held = merged.take(pa.array(places))
            if len(encoded.dictionary) > HELD_FUNDS:
                yield from held.to_batches()
                held = held.slice(0, 0)
        yield from held.to_batches()

    partial = weights.select("fund", "weight").where("fund is not null").mapInArrow(kept, "fund string, weight long")
    together = F.sort_array(F.collect_list("weight"), asc=False)
    return partial.groupBy("fund").agg(F.slice(together, 1, k).alias("largest"))


def concentration(holdings: DataFrame, entities: DataFrame) -> DataFrame:
    """Per fund: HHI, HHI points, effective holdings and the weight of its ten largest entities.

    holdings has fund, security, direct_long (boolean) and weight (long); entities maps security to
    entity and may hold a null. Securities of one entity are added up first; an entity counts if its
    weight is positive. Holdings that are not direct-long or not mapped take no part and are
    reported. A fund without an eligible entity has counts and no measures.
    """
    mapped = holdings.join(entities.select("security", "entity"), "security", "left")
    eligible = F.col("direct_long") & F.col("entity").isNotNull()
    by_entity = mapped.groupBy("fund", "entity").agg(
        F.sum(F.when(eligible, F.col("weight"))).alias("weight"),
        F.sum(F.when(F.col("direct_long") & F.col("entity").isNull(), F.col("weight"))).alias("unmapped"),
        F.sum(F.when(~F.col("direct_long"), F.col("weight"))).alias("excluded"),
    )
    counts = F.col("weight") > 0
    exact = F.when(counts, F.col("weight").cast("decimal(19,0)"))
    totals = by_entity.groupBy("fund").agg(
        F.count_if(counts).alias("entities"),
        F.sum(exact).alias("total"),
        F.sum((exact * exact).cast("decimal(38,0)")).alias("squares"),
        F.coalesce(F.sum("unmapped"), F.lit(0)).alias("unmapped_weight"),
        F.coalesce(F.sum("excluded"), F.lit(0)).alias("excluded_weight"),
    )
    largest = largest_weights(by_entity.where(counts))
    total = F.col("total").cast("double")
    hhi = F.col("squares").cast("double") / (total * total)
    top = F.aggregate("largest", F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    return totals.join(largest, "fund", "left").select(
        "fund",
        "entities",
        F.coalesce(F.col("total").cast("long"), F.lit(0)).alias("eligible_weight"),
        "unmapped_weight",
        "excluded_weight",
        hhi.alias("raw_hhi"),
        (hhi * 10_000.0).alias("hhi_points"),
        (F.lit(1.0) / hhi).alias("effective_holdings"),
        (F.lit(100.0) * top / total).alias("top_10_weight_pct"),
    )
