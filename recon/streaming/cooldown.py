"""Alerts that rest after firing, over a stream of checks (ST3)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recon.operators.cooldown import due_ticks, walk

OUTPUT = "rule string, fired_at timestamp"
STATE = "last_fired bigint"


def fire_with_cooldown(checks: DataFrame, cooldown_seconds: int) -> DataFrame:
    """Alerts of `(rule, checked_at, fires)` with a rest of `cooldown_seconds` after each fired one.

    State is one timestamp per rule. Ticks of a batch are put in time order before
    they are judged; those within the rest of the last alert are passed over as they
    come, and the others are 8 bytes each. A source's limit per batch (files,
    offsets) bounds them.
    """
    rest = max(int(cooldown_seconds) * 1_000_000, 1)

    def judge(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] + rest if state.exists else None
        ticks = np.empty(0, np.int64)
        for part in parts:
            at = part["at"].to_numpy(np.int64)
            ticks = np.union1d(ticks, at if until is None else at[at >= until])
        fired = walk(ticks, 0, rest)
        if len(fired):
            state.update((int(fired[-1]),))
            yield pd.DataFrame({"rule": key[0], "fired_at": pd.to_datetime(fired, unit="us")})

    return due_ticks(checks).groupBy("rule").applyInPandasWithState(judge, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
