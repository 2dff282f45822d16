"""The canonical table on disk: monthly folders, replaced by new versions of a month.

An update reads and rewrites only the months its rows fall into. Every update writes
a numbered log entry that maps months to folders; the highest entry is the current
table and an earlier one is the superseded table, byte for byte. Creating an entry
fails when another writer has taken its number, so of two writers one wins.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions.numeric import exact_value
from tickerloom.operators.batches import status_violations
from tickerloom.operators.quality import Rule, require_none, row_violations
from tickerloom.operators.vintages import (
    REJECTED,
    grouped_copies,
    rejected,
    revision_summary,
    vanished_rows,
    vintage_actions,
)
from tickerloom.schemas import KEY, ContractError, check_columns
from tickerloom.session import no_rows, stored_in
from tickerloom.sources import files

RUN_STAMP = "%Y%m%dT%H%M%S%fZ"
MONTH = "yyyy-MM"


@dataclass(frozen=True)
class Persisted:
    entry: int
    revised_rows: int
    revised_tickers: DataFrame
    snapshot: str | None


class CanonicalStore:
    """One canonical table below ``root``; single writer, any number of readers."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, values: tuple[str, ...], rules):
        self.spark, self.root, self.schema, self.values = spark, root.rstrip("/"), schema, values
        self.rules: list[Rule] = rules

    def entries(self) -> list[int]:
        listed = files.names(self.spark, f"{self.root}/log")
        return sorted(int(n.split(".")[0]) for n in listed if n.endswith(".json"))

    def entry(self, number: int) -> dict:
        return files.read_json(self.spark, f"{self.root}/log/{number:08d}.json")

    def current(self) -> dict | None:
        numbers = self.entries()
        return self.entry(numbers[-1]) if numbers else None

    def snapshots(self) -> dict[str, int]:
        """Snapshot names and the log entry each one preserves."""
        found = (self.entry(n) for n in self.entries())
        return {e["snapshot"]: e["number"] - 1 for e in found if e["snapshot"]}

    def read(self, months: list[str] | None = None, number: int | None = None) -> DataFrame:
        """The table, or only some of its months; a store that was never written is an error."""
        entry = self.current() if number is None else self.entry(number)
        if entry is None:
            raise FileNotFoundError(f"no canonical table at {self.root}")
        wanted = [m for m in sorted(entry["months"]) if months is None or m in months]
        paths = [f"{self.root}/{entry['months'][m]}" for m in wanted]
        if not paths:
            return no_rows(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def changes(self, after: int, until: int | None = None) -> DataFrame:
        """ticker, date of the rows that the entries behind `after` added or revised."""
        keys = [F.col(c) for c in KEY]
        found = self.spark.createDataFrame([], "ticker string, date date")
        for number in self.entries():
            if after < number <= (until or number):
                rows = self.spark.read.parquet(f"{self.root}/versions/{number:08d}")
                found = found.unionByName(rows.where(F.col("action").isin("new", "revise")).select(*keys))
        return found.distinct()

    def _months(self, df: DataFrame, *bounds: str) -> list[str]:
        # At most twelve names per year of history, however many rows there are.
        named = [F.date_format(b, MONTH) for b in bounds or ("date",)]
        if bounds:
            low, high = df.agg(F.min(bounds[0]), F.max(bounds[1])).first()
            if low is None:
                return []
            entry = self.current() or {"months": {}}
            return [m for m in entry["months"] if f"{low:%Y-%m}" <= m <= f"{high:%Y-%m}"]
        return sorted(r[0] for r in df.select(named[0]).distinct().collect())

    def check_vanished(self, statuses: DataFrame) -> None:
        """Reject when a successful response lacks keys stored inside its query window."""
        if self.current() is None:
            return
        success = statuses.where("status = 'success'")
        stored = self.read(self._months(success, "query_start", "query_end"))
        found = vanished_rows(stored, statuses).select(
            F.lit(1).alias("priority"), F.lit("vanished_observation").alias("rule"), "ticker", "date"
        )
        require_none(found, "stored rows")

    def conformed(self, incoming: DataFrame) -> DataFrame:
        """The columns of the table in its types; a value that a type cannot hold is an error."""
        incoming = check_columns(incoming, self.schema)
        given = incoming.schema
        return incoming.withColumns(
            {c: exact_value(F.col(c), given[c].dataType, self.schema[c].dataType, f"'{c}'") for c in self.values}
        )

    def persist(
        self, incoming: DataFrame, statuses: DataFrame | None = None, snapshot_time: datetime | None = None
    ) -> Persisted:
        """Merge one incoming vintage under the revision rules, all of it or nothing."""
        # One pass over the input; all checks and the merge read the written copy.
        copies, scratch = stored_in(grouped_copies(self.conformed(incoming), self.values), "incoming")
        try:
            return self._merge(copies, statuses, snapshot_time)
        finally:
            files.remove(self.spark, scratch)

    def _merge(self, copies: DataFrame, statuses: DataFrame | None, snapshot_time: datetime | None) -> Persisted:
        conflicts = copies.where("in_conflict").select(
            F.lit(1).alias("priority"), F.lit("conflicting_duplicates").alias("rule"), *KEY
        )
        require_none(conflicts, "incoming rows")
        require_none(row_violations(copies, self.rules), "incoming rows")
        incoming = copies.select(*[f.name for f in self.schema])
        months = self._months(incoming)
        if not months:
            raise ContractError("no observations are available to persist")
        if statuses is not None:
            contract = status_violations(statuses, incoming)
            require_none(contract.withColumn("priority", F.lit(1)), "retrieval statuses")
            self.check_vanished(statuses)

        before = self.current()
        existing = self.read(months) if before else no_rows(self.spark, self.schema)
        if before:
            require_none(row_violations(existing, self.rules), "stored rows")
        return self._commit(vintage_actions(existing, incoming, self.values), before, months, snapshot_time)

    def persist_decided(self, decided: DataFrame) -> Persisted:
        """Write a vintage whose rows are valid and whose actions are known, with the stored rows of its months.

        What was refused stays as it is stored, as `vintage_actions` shows it. Nothing is joined again.
        """
        stays = F.col("action").isin("existing_only", *REJECTED)
        months = self._months(decided.where(~stays))
        if not months:
            raise ContractError("no observations are available to persist")
        before = self.current()
        if before:
            require_none(row_violations(self.read(months), self.rules), "stored rows")
        actions = decided.where(F.date_format("date", MONTH).isin(months)).withColumn(
            "action", F.when(stays, "existing_only").otherwise(F.col("action"))
        )
        return self._commit(actions, before, months, None)

    def _commit(
        self, actions: DataFrame, before: dict | None, months: list[str], snapshot_time: datetime | None
    ) -> Persisted:
        number = (before["number"] if before else 0) + 1
        version = f"versions/{number:08d}"
        folder = f"{self.root}/{version}"
        if files.exists(self.spark, folder):
            # An update that died before its log entry; nothing refers to the folder.
            files.remove(self.spark, folder)
        # Rows meet by month, and adaptive execution splits a month beyond its advisory size
        # over several tasks and files, however many months an update touches.
        (
            actions.select(*[f.name for f in self.schema], "action")
            .withColumn("month", F.date_format("date", MONTH))
            .hint("rebalance", "month")
            .sortWithinPartitions("month", "ticker", "date")
            .write.partitionBy("month")
            .parquet(folder)
        )
        # The action is one more column of the new files; the checks below read only it.
        written = self.spark.read.parquet(folder)
        try:
            refused = rejected(written).select(
                F.lit(1).alias("priority"), F.col("action").alias("rule"), "ticker", "date"
            )
            require_none(refused, "incoming revisions")
        except ContractError:
            files.remove(self.spark, folder)
            raise
        if before and written.where(F.col("action").isin("new", "advance", "revise")).isEmpty():
            # A replayed vintage: the table already says all of it.
            files.remove(self.spark, folder)
            return Persisted(before["number"], 0, revision_summary(no_rows(self.spark, written.schema)), None)
        revised = revision_summary(written)
        count = revised.agg(F.coalesce(F.sum("revised_rows"), F.lit(0))).first()[0]
        snapshot = self._snapshot_name(snapshot_time) if count else None
        entry = {
            "number": number,
            "months": {**(before["months"] if before else {}), **{m: f"{version}/month={m}" for m in months}},
            "revised_rows": count,
            "snapshot": snapshot,
        }
        files.write_json(self.spark, f"{self.root}/log/{number:08d}.json", entry)
        return Persisted(number, count, revised, snapshot)

    def _snapshot_name(self, at: datetime | None) -> str:
        at = at or datetime.now(timezone.utc)
        if at.tzinfo is None:
            raise ValueError("the snapshot time must be timezone-aware")
        stem = f"{self.root.rsplit('/', 1)[-1]}_{at.astimezone(timezone.utc).strftime(RUN_STAMP)}"
        taken = set(self.snapshots())
        name, again = stem, 0
        while name in taken:
            again += 1
            name = f"{stem}_{again:03d}"
        return name
