"""Alerts that rest after firing (H10), and the step that a stream of checks shares (ST3).

Whether a tick fires depends on the last one that did. A rule's ticks are dealt
into blocks of neighbouring times, and each block becomes a function: from the
tick that fires first in it to the tick that fires last. One pass over these
functions in time order tells with which tick each block starts, and the blocks
are then walked side by side. So a rule with any number of ticks is many blocks,
and a task holds one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recon.plans.lineage import materialize

BLOCK = 1_000_000  # ticks of a block


def due_ticks(checks: DataFrame) -> DataFrame:
    """(rule, at): the ticks that call for an alert, in microseconds; ticks without a time are none."""
    at = F.unix_micros(F.col("checked_at").cast("timestamp")).alias("at")
    return checks.where("fires").select("rule", at).where("at IS NOT NULL")


def walk(ticks: np.ndarray, start: int, rest: int) -> np.ndarray:
    """The ticks that fire, of sorted ones from place `start` on, if that one fires."""
    fired, i = [], start
    while i < len(ticks):
        fired.append(i)
        i = int(np.searchsorted(ticks, ticks[i] + rest))
    return ticks[fired]


def last_fired(ticks: np.ndarray, rest: int) -> np.ndarray:
    """For each of the sorted ticks, the one that fires last if that tick fires first."""
    n = len(ticks)
    following = np.append(np.searchsorted(ticks, ticks + rest), n)
    last = np.where(following[:n] < n, following[:n], np.arange(n))
    while True:  # each round doubles the steps that are taken at once
        further = last[last]
        if np.array_equal(further, last):
            return ticks[last]
        last = further


def fired_alerts(checks: DataFrame, cooldown_seconds: int, block: int = BLOCK) -> DataFrame:
    """Which checks raise an alert when a rule rests after each alert it fired.

    `checks` has `rule`, `checked_at` and `fires`. The result has `rule` and
    `fired_at`. Repeated ticks are one; a NULL rule is a rule of its own. A cooldown
    of 0 fires at every tick. Blocks have about `block` ticks, however they are
    spread over rules and times.
    """
    rest = max(int(cooldown_seconds) * 1_000_000, 1)
    due = materialize(due_ticks(checks).distinct(), "ticks")
    blocks = -(-due.count() // block) or 1
    dealt = due.repartitionByRange(blocks, "rule", "at").withColumn("block", F.spark_partition_id())
    dealt = materialize(dealt, "blocks")
    rule = T.StructField("rule", dealt.schema["rule"].dataType)

    def ends(ticks: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(ticks["at"].to_numpy(np.int64))
        # A rest that began before the block ends less than `rest` after its first tick.
        entries = int(np.searchsorted(at, at[0] + rest)) + 1
        out = pd.DataFrame({"entry": at[:entries], "last": last_fired(at, rest)[:entries]})
        return out.assign(rule=ticks["rule"].iloc[0], block=ticks["block"].iloc[0])[["rule", "block", "entry", "last"]]

    long = T.LongType()
    of_block = T.StructType([rule, T.StructField("block", T.IntegerType())])
    functions = dealt.groupBy("rule", "block").applyInPandas(ends, T.StructType([*of_block, T.StructField("entry", long), T.StructField("last", long)]))

    def compose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, now, until, done = object(), None, None, None
        for part in parts:
            starts = []
            for name, number, entry, last in part.itertuples(index=False):
                name = None if pd.isna(name) else name
                if name != known:
                    known, until, done = name, None, None
                if number != done and (until is None or entry >= until):
                    starts.append((name, number, entry))
                    until, done = last + rest, number
            if starts:
                yield pd.DataFrame(starts, columns=["rule", "block", "entry"])

    in_order = functions.repartition("rule").sortWithinPartitions("rule", "block", "entry")
    starts = in_order.mapInPandas(compose, T.StructType([*of_block, T.StructField("entry", long)]))

    def fire(ticks: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(ticks["at"].to_numpy(np.int64))
        fired = walk(at, int(np.searchsorted(at, ticks["entry"].iloc[0])), rest)
        return pd.DataFrame({"rule": ticks["rule"].iloc[0], "at": fired}, columns=["rule", "at"])

    # One start per rule and block, found again by both.
    s = starts.select(F.col("rule").alias("r"), F.col("block").alias("b"), "entry")
    started = dealt.join(s, dealt.rule.eqNullSafe(s.r) & (dealt.block == s.b)).select("rule", "block", "at", "entry")
    fired = started.groupBy("rule", "block").applyInPandas(fire, T.StructType([rule, T.StructField("at", long)]))
    return fired.select("rule", F.timestamp_micros("at").cast("timestamp_ntz").alias("fired_at"))
