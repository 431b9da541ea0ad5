"""Statistics of sessions over a stream of results, with resets: a state for each session, and the same over a table.

events: session, seq (order within a session), kind ('result' or 'reset'), passed, errors, warnings, millis. A reset ends a
stretch and begins the next one with zeros. Each batch gives the session's stretch as it stands, and stretches that ended in
it. Rows go by seq within a batch; a row that comes in a later batch than a reset counts after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "session string, seq bigint, kind string, passed boolean, errors bigint, warnings bigint, millis bigint"
_COUNTS = ["total_files", "passed_files", "failed_files", "total_errors", "total_warnings", "total_millis"]
_STATE = ", ".join(f"{c} bigint" for c in ["stretch", *_COUNTS])
STATISTICS = f"session string, {_STATE}, average_millis double, pass_rate double"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _row(session: str | None, stretch: int, counts: np.ndarray) -> tuple:
    n = int(counts[0])
    return session, stretch, *map(int, counts), float(counts[5]) / n if n else 0.0, float(counts[1]) * 100.0 / n if n else 0.0


class SessionStatistics(StatefulProcessor):
    """One value a session: the number of its stretch, and the stretch's sums."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("statistics", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        stretch, counts = (int(held[0]), np.array(held[1:], dtype=np.int64)) if held else (0, np.zeros(len(_COUNTS), dtype=np.int64))
        frame = pd.concat([r[["seq", "kind", "passed", "errors", "warnings", "millis"]] for r in rows]).sort_values("seq", kind="stable")
        reset = (frame["kind"] == "reset").to_numpy()
        result = (frame["kind"] == "result").to_numpy()
        passed = result & frame["passed"].fillna(False).to_numpy(dtype=bool)
        sums = [result, passed, result & ~passed, *[np.where(result, frame[c].fillna(0).to_numpy(dtype=np.int64), 0) for c in ("errors", "warnings", "millis")]]
        each = np.column_stack([s.astype(np.int64) for s in sums])
        out, start = [], 0
        for end in [*np.flatnonzero(reset).tolist(), len(frame)]:
            counts = counts + each[start:end].sum(axis=0)
            out.append(_row(key[0], stretch, counts))
            if end < len(frame):
                stretch, counts, start = stretch + 1, np.zeros(len(_COUNTS), dtype=np.int64), end
        self.state.update((stretch, *map(int, counts)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STATISTICS.split(", ")])

    def close(self) -> None:
        pass


def running(events: DataFrame) -> DataFrame:
    """The stream's statistics, to be written in update mode; the state is kept in RocksDB, and sets that in the session."""
    events.sparkSession.conf.set(*_PROVIDER)
    return events.groupBy("session").transformWithStateInPandas(SessionStatistics(), STATISTICS, "Update", "None")


def statistics(events: DataFrame) -> DataFrame:
    """The same numbers over a table: a row for each session and stretch."""
    so_far = W.partitionBy("session").orderBy("seq").rangeBetween(W.unboundedPreceding, 0)
    df = events.withColumn("stretch", F.count_if(F.col("kind") == "reset").over(so_far))
    result = F.col("kind") == "result"
    passed = F.coalesce(F.col("passed"), F.lit(False))
    sums = [
        F.count_if(result), F.count_if(result & passed), F.count_if(result & ~passed), *[F.coalesce(F.sum(F.when(result, F.col(c))), F.lit(0)) for c in ("errors", "warnings", "millis")],
    ]
    df = df.groupBy("session", "stretch").agg(*[s.alias(c) for s, c in zip(sums, _COUNTS)])
    return df.withColumns(
        {
            "average_millis": F.coalesce(F.try_divide(F.col("total_millis").cast("double"), F.col("total_files")), F.lit(0.0)),
            "pass_rate": F.coalesce(F.try_divide(F.col("passed_files") * F.lit(100.0).cast("double"), F.col("total_files")), F.lit(0.0)),
        }
    )
