"""Publication of an evaluation as a run folder, and discovery of runs."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.digests import content_digest
from tickerloom.plans.evaluate import Evaluation
from tickerloom.plans.ordering import write_sorted
from tickerloom.schemas import ARTIFACTS, ContractError
from tickerloom.session import side_by_side
from tickerloom.sources import files
from tickerloom.sources.store import RUN_STAMP
from tickerloom.sources.universe import universe_hash

RUN_PATTERN = r"^[0-9]{8}T[0-9]{12}Z$"


def manifest_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per artifact: file name, field count, schema, row count and digest."""
    rows = [
        content_digest(df).select(
            F.lit(name).alias("artifact"),
            F.lit(f"{name}.parquet").alias("filename"),
            F.lit(len(df.columns)).alias("fields"),
            F.lit(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)).alias("schema"),
            "row_count",
            "digest",
        )
        for name, df in frames.items()
    ]
    combined = rows[0]
    for more in rows[1:]:
        combined = combined.unionByName(more)
    return combined


def ticker_metadata(universe: DataFrame, prices: DataFrame, statuses: DataFrame | None) -> DataFrame:
    """Per configured instrument: acquisition claims and what the input holds."""
    held = prices.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.min("retrieved_at").alias("input_first_retrieved_at"),
        F.max("retrieved_at").alias("input_last_retrieved_at"),
    )
    joined = universe.join(held, "ticker", "left").withColumn("input_rows", F.coalesce("input_rows", F.lit(0).cast("bigint")))
    if statuses is None:
        claims = {
            "acquisition_status": F.lit("not_requested"),
            "error": F.lit(None).cast("string"),
            "rows_received": F.lit(None).cast("bigint"),
            "retrieved_at": F.lit(None).cast("timestamp"),
            "query_start": F.lit(None).cast("date"),
            "query_end_exclusive": F.lit(None).cast("date"),
            "first_returned_date": F.lit(None).cast("date"),
            "last_returned_date": F.lit(None).cast("date"),
        }
        joined = joined.withColumns(claims)
    else:
        joined = joined.join(
            statuses.select(
                "ticker",
                F.col("status").alias("acquisition_status"),
                "error",
                "rows_received",
                "retrieved_at",
                "query_start",
                F.col("query_end").alias("query_end_exclusive"),
                F.col("first_date").alias("first_returned_date"),
                F.col("last_date").alias("last_returned_date"),
            ),
            "ticker",
            "left",
        )
    return joined.select(
        "ord",
        "ticker",
        "name",
        "category",
        "acquisition_status",
        "error",
        "rows_received",
        "retrieved_at",
        "query_start",
        "query_end_exclusive",
        "first_returned_date",
        "last_returned_date",
        "input_rows",
        "input_first_retrieved_at",
        "input_last_retrieved_at",
    )


def manifest_head(evaluation: Evaluation, created_at: datetime, context: dict | None = None) -> dict:
    """What a manifest says of the run as a whole."""
    target = evaluation.target
    return {
        "run_id": created_at.strftime(RUN_STAMP),
        "created_at": created_at.strftime("%Y-%m-%dT%H:%M:%S.%fZ"),
        "mode": evaluation.mode,
        "captured_at": target.captured_at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ"),
        "target_session": target.target_session.isoformat(),
        "request_start": target.request_start.isoformat(),
        "request_end_exclusive": target.request_end.isoformat(),
        "universe_sha256": universe_hash(evaluation.universe).first()["universe_sha256"],
        "context": context or {},
    }


def publish(
    evaluation: Evaluation, root: str, created_at: datetime | None = None, context: dict | None = None
) -> str:
    """Write, read back, compare and then rename a run folder into place; returns its path.

    ``context`` holds what the caller knows about the code that ran (version control
    head, package versions). A run whose final check fails is renamed out of the way.
    """
    spark = evaluation.universe.sparkSession
    created_at = (created_at or datetime.now(timezone.utc)).astimezone(timezone.utc)
    run = created_at.strftime(RUN_STAMP)
    final, staging = f"{root}/{run}", f"{root}/.{run}.tmp-{uuid.uuid4().hex}"
    if files.exists(spark, final):
        raise FileExistsError(final)
    expected = {name: evaluation.frames[name] for name in ARTIFACTS}
    claims = ticker_metadata(evaluation.universe, evaluation.frames["input_prices"], evaluation.statuses)
    *_, digests = side_by_side(
        spark,
        *[partial(write_sorted, frame, f"{staging}/{name}.parquet") for name, frame in expected.items()],
        partial(claims.write.parquet, f"{staging}/ticker_metadata.parquet"),
        manifest_rows(expected).collect,
    )
    source = {r["artifact"]: r.asDict() for r in digests}
    manifest = manifest_head(evaluation, created_at, context) | {"artifacts": source}
    files.write_json(spark, f"{staging}/manifest.json", manifest)
    check_artifacts(spark, staging, manifest)
    files.rename(spark, staging, final)
    try:
        check_artifacts(spark, final, manifest)
    except ContractError:
        files.rename(spark, final, f"{final}.invalid-{uuid.uuid4().hex}")
        raise
    return final


def read_run(spark: SparkSession, folder: str) -> tuple[dict, dict[str, DataFrame]]:
    """A run's manifest and its artifact tables; a missing run is an error."""
    manifest = files.read_json(spark, f"{folder}/manifest.json")
    frames = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in ARTIFACTS}
    frames["ticker_metadata"] = spark.read.parquet(f"{folder}/ticker_metadata.parquet")
    return manifest, frames


def artifact_violations(spark: SparkSession, frames: dict[str, DataFrame], manifest: dict) -> DataFrame:
    """Artifacts whose stored schema, row count or digest differs from the manifest."""
    claimed = spark.createDataFrame(
        [(a["artifact"], a["schema"], a["row_count"], a["digest"]) for a in manifest["artifacts"].values()],
        "artifact string, claimed_schema string, claimed_rows bigint, claimed_digest string",
    )
    actual = manifest_rows({name: frames[name] for name in ARTIFACTS})
    joined = claimed.join(actual, "artifact", "full_outer")
    rules = F.array_compact(
        F.array(
            F.when(F.col("claimed_rows").isNull() | F.col("row_count").isNull(), F.lit("artifact_missing")),
            F.when(F.col("claimed_schema") != F.col("schema"), F.lit("schema_differs")),
            F.when(F.col("claimed_rows") != F.col("row_count"), F.lit("row_count_differs")),
            F.when(F.col("claimed_digest") != F.col("digest"), F.lit("digest_differs")),
        )
    )
    return joined.select(F.explode(rules).alias("rule"), "artifact")


def check_artifacts(spark: SparkSession, folder: str, manifest: dict) -> None:
    _, frames = read_run(spark, folder)
    bad = [f"{r['artifact']}: {r['rule']}" for r in artifact_violations(spark, frames, manifest).collect()]
    if bad:
        raise ContractError(f"run {folder} does not match its manifest: {bad}")


def classify_runs(names: DataFrame) -> DataFrame:
    """Tell runs, temporary, quarantined and rejected folder names apart."""
    name = F.col("name")
    kind = (
        F.when(name.startswith(".") & name.contains(".tmp-"), "temporary")
        .when(name.contains(".invalid-"), "quarantined")
        .when(name.rlike(RUN_PATTERN), "run")
        .otherwise("rejected")
    )
    return names.select("name", kind.alias("kind"))


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    listed = spark.createDataFrame([(n,) for n in files.names(spark, root)], "name string")
    return classify_runs(listed).orderBy(F.col("name").desc())


def artifact_inventory(manifest: dict, spark: SparkSession) -> DataFrame:
    """One row per field of every artifact of a run."""
    text = spark.createDataFrame([(json.dumps(list(manifest["artifacts"].values())),)], "doc string")
    entry = F.from_json(
        "doc", "array<struct<artifact: string, filename: string, row_count: bigint, digest: string, schema: string>>"
    )
    return inventory_rows(text.select(F.inline(entry)))


def inventory_rows(manifest: DataFrame) -> DataFrame:
    """Explode manifest rows to one row per field."""
    return manifest.select(
        "artifact",
        "filename",
        "row_count",
        F.posexplode(F.split("schema", ",(?=[a-z0-9_]+:)")).alias("position", "field"),
    ).select(
        "artifact",
        "filename",
        "row_count",
        (F.col("position") + 1).alias("position"),
        F.substring_index("field", ":", 1).alias("field"),
        F.expr("substring(field, instr(field, ':') + 1)").alias("type"),
    )
