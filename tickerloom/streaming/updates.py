"""Incremental updates of a canonical table from a stream of landed vintages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickerloom.operators.incremental import refresh_signals
from tickerloom.operators.quality import row_violations
from tickerloom.operators.signals import stored_signals
from tickerloom.operators.spine import signal_bounds
from tickerloom.operators.vintages import REJECTED, grouped_copies, vintage_actions
from tickerloom.schemas import KEY
from tickerloom.session import stored_in
from tickerloom.sources import files
from tickerloom.sources.store import CanonicalStore


def decide_vintage(store: CanonicalStore, rows: DataFrame, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a vintage does to the stored months it touches, as key, values and action, and refused rows with the reason.

    Late arrivals show up as ``stale`` here: the revision rules are the late-data
    policy, so the stream needs no watermark and keeps no state. Copies are grouped
    once and meet the stored rows once; both results are written, and `scratch` takes
    their folders.
    """

    def kept(df: DataFrame, purpose: str) -> DataFrame:
        result, folder = stored_in(df, purpose)
        scratch.append(folder)
        return result

    broken = row_violations(rows, store.rules).groupBy(*KEY).agg(F.min(F.struct("priority", "rule"))["rule"].alias("reason"))
    copies = kept(grouped_copies(rows, store.values), "copies")
    conflicts = copies.where("in_conflict").select(*KEY, F.lit("conflicting_duplicates").alias("reason"))
    invalid = kept(broken.join(conflicts.select(*KEY), list(KEY), "left_anti").unionByName(conflicts), "invalid")
    agreed = copies.where(~F.col("in_conflict")).select(*rows.columns)
    clean = agreed.alias("r").join(invalid.alias("b"), nullsafe_keys("r", "b"), "left_anti")
    if store.current() is None:
        return clean.withColumn("action", F.lit("new")), invalid
    months = store._months(clean)
    actions = vintage_actions(store.read(months), clean, store.values)
    decided = kept(actions.select(*rows.columns, "action"), "decided")
    refused = decided.where(F.col("action").isin(*REJECTED)).select(*KEY, F.col("action").alias("reason"))
    return decided, invalid.unionByName(refused)


def taken(decided: DataFrame) -> DataFrame:
    """The rows of a vintage that may be merged."""
    return decided.where(~F.col("action").isin("existing_only", *REJECTED)).drop("action")


def split_vintage(store: CanonicalStore, rows: DataFrame, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of a vintage that may be merged, and the others with the reason."""
    decided, refused = decide_vintage(store, rows, scratch)
    return taken(decided), refused


def nullsafe_keys(left: str, right: str) -> Column:
    return reduce(and_, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in KEY])


def apply_vintage(store: CanonicalStore, quarantine: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: merge what the rules allow, quarantine the rest.

    A replayed batch finds its rows identical and changes no value, and its
    quarantine folder is rewritten under the same batch number.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, folders = store.conformed(batch), []
        try:
            if rows.isEmpty():
                return
            decided, refused = decide_vintage(store, rows, folders)
            refused.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
                f"{quarantine}/batch={batch_id}"
            )
            if not taken(decided).isEmpty():
                store.persist_decided(decided)
        finally:
            for folder in folders:
                files.remove(spark, folder)

    return run


def signal_refresher(store: CanonicalStore, root: str) -> Callable[[], None]:
    """An ``after`` step that keeps both signals below ``root`` up to date with the store.

    The first run computes them in full; later ones compute only what the entries behind the last
    run can reach, from bounded history. `current.json` names the tables of the last run and is
    written last, so a run that died changes nothing. A run without new entries does nothing.
    """
    spark = store.spark

    def run() -> None:
        entry = store.current()
        pointer = f"{root}/current.json"
        state = files.read_json(spark, pointer) if files.exists(spark, pointer) else None
        if entry is None or (state and state["entry"] == entry["number"]):
            return
        prices = store.read()
        bounds = signal_bounds(prices)
        folder = f"{root}/{entry['number']:08d}"
        if files.exists(spark, folder):
            files.remove(spark, folder)
        moved = state and state["first"] != str(bounds.calendar.sessions[bounds.first])
        recomputed = None
        if state is None or moved:
            momentum, volatility = stored_signals(prices, bounds, f"{folder}/full")
        else:
            held = [spark.read.parquet(f"{root}/{state['entry']:08d}/{name}") for name in ("momentum", "volatility")]
            fresh = refresh_signals(*held, prices, store.changes(state["entry"]), bounds, f"{folder}/work")
            momentum, volatility = fresh.momentum, fresh.volatility
            recomputed = fresh.islands.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] or 0
        momentum.write.parquet(f"{folder}/momentum")
        volatility.write.parquet(f"{folder}/volatility")
        for scratch in ("full", "work"):
            if files.exists(spark, f"{folder}/{scratch}"):
                files.remove(spark, f"{folder}/{scratch}")
        first = str(bounds.calendar.sessions[bounds.first])
        if files.exists(spark, pointer):
            files.remove(spark, pointer)
        files.write_json(spark, pointer, {"entry": entry["number"], "first": first, "recomputed_rows": recomputed})
        if state:
            files.remove(spark, f"{root}/{state['entry']:08d}")

    return run


def stream_updates(
    spark: SparkSession,
    landing: str,
    store: CanonicalStore,
    quarantine: str,
    checkpoint: str,
    after: Callable[[], None] | None = None,
) -> StreamingQuery:
    """Start the update stream over a folder of canonical Parquet vintages.

    ``after`` runs behind every merged batch, for example to evaluate and publish.
    """
    merge = apply_vintage(store, quarantine)

    def run(batch: DataFrame, batch_id: int) -> None:
        merge(batch, batch_id)
        if after is not None:
            after()

    return (
        spark.readStream.schema(store.schema)
        .parquet(landing)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
