"""Run history as Parquet tables with snapshots, by day."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import history
from evenkeel.session import pinned
from evenkeel.sources.snapshots import PERIOD, SnapshotTable

SCHEMAS = {
    "sessions": "session_id string, test_type string, client_id string, client_role string,"
    " source_type string, target_type string, ignore_columns array<string>, report_format string,"
    " created_at timestamp",
    "events": "session_id string, status string, event_ts timestamp, error_message string",
    "files": "session_id string, file_role string, file_path string, file_name string,"
    " file_size_bytes long, file_format string, row_count long, column_count int,"
    " columns array<string>, recorded_at timestamp",
    "audit": "session_id string, client_id string, client_role string, tool_name string, action string,"
    " success boolean, error_message string, execution_time_ms long, request_metadata string,"
    " created_at timestamp",
}
_TIME = {"sessions": "created_at", "events": "event_ts", "files": "recorded_at", "audit": "created_at"}
TABLES = (*SCHEMAS, "results", "mismatches")
STATUSES = ("pending", "running", "completed", "failed")


def run_id(source_query: str, target_query: str, at: datetime) -> str:
    """A run name from the time and both queries."""
    digest = hashlib.md5(f"{source_query}{target_query}".encode()).hexdigest()
    return f"{at:%Y%m%d_%H%M%S}_{digest[:8]}"


class HistoryStore:
    """Writes run history under ``root``; a change of state is a new event row.

    Each table is a ``SnapshotTable``: several programs may write, and readers keep the version they began with.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def snapshots(self, table: str) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.root}/{table}")

    def append(self, table: str, df: DataFrame, ts: str) -> None:
        self.snapshots(table).append(df, ts)

    def _append_rows(self, table: str, rows: Sequence[Mapping[str, object]]) -> None:
        names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        df = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMAS[table])
        self.append(table, df, _TIME[table])

    def table(self, name: str) -> DataFrame:
        """The latest rows, with their day as ``period``."""
        rows = self.snapshots(name).read()
        if rows is not None:
            return rows
        if name not in SCHEMAS:
            raise LookupError(f"nothing has been written to {name!r} yet")
        return self.spark.createDataFrame([], f"{SCHEMAS[name]}, {PERIOD} date")

    def create_session(self, session_id: str, at: datetime, **fields: object) -> None:
        self._append_rows("sessions", [{"session_id": session_id, "created_at": at, **fields}])
        self.set_status(session_id, "pending", at)

    def set_status(self, session_id: str, status: str, at: datetime, error: str | None = None) -> None:
        if status not in STATUSES:
            raise ValueError(f"status must be one of {STATUSES}, not {status!r}")
        row = {"session_id": session_id, "status": status, "event_ts": at, "error_message": error}
        self._append_rows("events", [row])

    def record_file(self, session_id: str, file_role: str, at: datetime, **fields: object) -> None:
        row = {"session_id": session_id, "file_role": file_role, "recorded_at": at, **fields}
        self._append_rows("files", [row])

    def log_audit(self, at: datetime, metadata: Mapping[str, object] | None = None, **fields: object) -> None:
        text = json.dumps(metadata) if metadata else None
        self._append_rows("audit", [{"created_at": at, "request_metadata": text, **fields}])

    def save_summary(self, session_id: str, summary: DataFrame, at: datetime, seconds: float) -> None:
        """Append the one-row summary of a comparison."""
        row = summary.withColumns(
            {
                "session_id": F.lit(session_id),
                "created_at": F.lit(at),
                "comparison_time_ms": F.lit(int(seconds * 1000)),
            }
        )
        self.append("results", row, "created_at")

    def save_mismatches(self, session_id: str, differences: DataFrame, at: datetime) -> None:
        """Append all mismatch details of a comparison, written in parallel."""
        rows = differences.withColumns({"session_id": F.lit(session_id), "created_at": F.lit(at)})
        self.append("mismatches", rows, "created_at")

    def sessions(self) -> DataFrame:
        """Sessions with their current status, from the event log."""
        state = history.session_state(self.table("events")).drop("created_at")
        return self.table("sessions").drop(PERIOD).join(state, "session_id", "left")

    def compact(self) -> None:
        """Bring the small files of each table and day together; days with one file stay as they are."""
        for name in TABLES:
            self.snapshots(name).compact()

    def remove_expired(self, as_of: datetime, days: int) -> dict[str, set[str]]:
        """Take out what the retention rule ends: the days that were written again, by table.

        Sessions go last, so a run that stops half-way is made good by the next. The audit log outlives its sessions.
        """
        gone = pinned(history.expired_sessions(self.sessions(), F.lit(as_of), days))
        order = [t for t in TABLES if t not in ("audit", "sessions")]
        return {name: self.snapshots(name).remove(gone, "session_id") for name in (*order, "sessions")}
