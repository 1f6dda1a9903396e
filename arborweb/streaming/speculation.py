"""Probing as a stream: the state of each template is kept from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship

STATE = "highest BIGINT, failed BIGINT, last BIGINT, done BOOLEAN"
OUTPUT = "entry STRING, highest_success BIGINT, consecutive_failures BIGINT, last_n BIGINT, done BOOLEAN"


def advance(state: tuple[int | None, int, int, bool], outcomes: list[tuple[int, bool]], gap: int) -> tuple[int | None, int, int, bool]:
    """The state after more outcomes (n, ok), in the order of n: (highest success, failures
    since, last n, done). Once done, nothing changes it."""
    highest, failed, last, done = state
    for n, ok in sorted(outcomes):
        if done:
            break
        last = n
        if ok:
            highest, failed = n, 0
        else:
            failed += 1
        done = failed >= gap
    return highest, failed, last, done


def stream_speculation(outcomes: DataFrame, gap: int) -> DataFrame:
    """States of templates from a stream of ``entry, n, ok``; one row whenever one changes."""
    ship(outcomes.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got = state.get if state.exists else (0, 0, 0, False)
        now = (got[0] or None, got[1], got[2], got[3])
        new = [(int(n), bool(ok)) for pdf in batches for n, ok in zip(pdf["n"], pdf["ok"], strict=True)]
        highest, failed, last, done = advance(now, new, gap)
        state.update((highest or 0, failed, last, done))
        yield pd.DataFrame({"entry": [key[0]], "highest_success": pd.array([highest], dtype="Int64"), "consecutive_failures": [failed], "last_n": [last], "done": [done]})

    return outcomes.groupBy("entry").applyInPandasWithState(run, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
