"""Streaming twins of the batch operators.

An event-time watermark cannot say "the newer business date wins", so the effective date lives in the state and state
is never evicted.  Within a micro-batch a key's updates are folded in the order of ``seq``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAR_DOWN, FAR_UP = 0.05, 20.0
STATE = "value string, eff_date string, source string, seq long"


def _day(text: str | None) -> date | None:
    m = re.fullmatch(r"(\d\d)/(\d\d)/(\d{4})", text or "")
    try:
        return date(int(m[3]), int(m[2]), int(m[1])) if m else None
    except ValueError:
        return None


def _amount(text: str | None) -> float | None:
    m = re.fullmatch(r"\s*[€\s]*(\d[\d.\s]*(?:,\d+)?)\s*€?\s*", text or "")
    return float(re.sub(r"[\s.]", "", m[1]).replace(",", ".")) if m else None


def replaces(old: tuple, new: tuple) -> bool:
    """True if (value, eff_date, ...) ``new`` replaces ``old``: amounts 20 times larger do, twentieths do not, and a
    dated value yields to no older or undated one."""
    a, b = _amount(old[0]), _amount(new[0])
    if a and b and a > 0 and b > 0:
        if b <= a * FAR_DOWN:
            return False
        if b >= a * FAR_UP:
            return True
    was, now = _day(old[1]), _day(new[1])
    return not (was is not None and (now is None or now < was))


def rolling_state(updates: DataFrame, keys: tuple[str, str] = ("entity_id", "field_id")) -> DataFrame:
    """The state of each key after every micro-batch, from updates (keys, seq, value, eff_date, source) in a stream."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        for seq, value, eff, source in zip(rows.seq, rows.value, rows.eff_date, rows.source, strict=True):
            if value is None or not str(value).strip():
                continue
            new = (str(value), None if pd.isna(eff) else eff, source if not pd.isna(source) else (current[2] if current else None), int(seq))
            if current is None or replaces(current, new):
                current = new
        if current is not None:
            state.update(current)
            yield pd.DataFrame([[*key, *current]], columns=[*keys, "value", "eff_date", "source", "seq"])

    kinds = [f"{k} {updates.schema[k].dataType.simpleString()}" for k in keys]
    rows = updates.select(*keys, "seq", F.col("value").cast("string").alias("value"), F.col("eff_date").cast("string").alias("eff_date"), F.col("source").cast("string").alias("source"))
    return rows.groupBy(*keys).applyInPandasWithState(step, ", ".join([*kinds, STATE]), STATE, "update", GroupStateTimeout.NoTimeout)


def first_by_hash(stream: DataFrame, event_time: str, delay: str, key: str = "hash") -> DataFrame:
    """The first row of each content hash; hashes are remembered within the watermark's delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, event_time: str, delay: str, width: str, key: str) -> DataFrame:
    """Counts by key and tumbling window; rows later than the watermark are left out."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), key).agg(F.count("*").alias("n"))


def once_per_batch(write: Callable[[DataFrame, int], None], done: set[int]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that leaves out batches already written; ``done`` comes from the sink."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id not in done:
            write(batch, batch_id)
            done.add(batch_id)

    return run
