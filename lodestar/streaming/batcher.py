"""Requests gathered into batches on a stream, with state and timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_ROWS = "run long, id long, batch long, size long, full boolean"


def batched(stream: DataFrame, most: int, wait_ms: int, by: str = "run") -> DataFrame:
    """``stream(run, id)`` -> ``(run, id, batch, size, full)``, append mode: each request once, when its batch goes out.

    A batch goes out once it has ``most`` requests (``full``) or its oldest one is ``wait_ms`` of processing time old; it
    holds at most ``most``, and what is left starts a window of its own. The state of a run is less than ``most`` ids.
    Rows with a null run are a run of their own; a null id is carried.
    """
    if most < 1 or wait_ms < 1:
        raise ValueError("a batch has at least one request and one millisecond")

    def out(run, ids: list, n: int, full: bool) -> pd.DataFrame:
        return pd.DataFrame({"run": pd.array([run] * len(ids), "Int64"), "id": pd.array(ids, "Int64"), "batch": n, "size": len(ids), "full": full})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = None if pd.isna(key[0]) else int(key[0])
        n, began, ids = state.get if state.exists else (0, 0, [])
        ids, now = list(ids), state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            yield out(run, ids, n, False)
            n, ids = n + 1, []
        else:
            for pdf in frames:
                for i in pdf["id"]:
                    if not ids:
                        began = now
                    ids.append(None if pd.isna(i) else int(i))
                    if len(ids) == most:
                        yield out(run, ids, n, True)
                        n, ids = n + 1, []
        if ids and now - began >= wait_ms:
            yield out(run, ids, n, False)
            n, ids = n + 1, []
        state.update((n, began, ids))
        if ids:
            state.setTimeoutDuration(max(1, began + wait_ms - now))

    rows = stream.selectExpr(f"CAST({by} AS BIGINT) AS run", "CAST(id AS BIGINT) AS id")
    return rows.groupBy("run").applyInPandasWithState(step, _ROWS, "n long, began long, ids array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)
