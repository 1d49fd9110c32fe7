"""Keyed state machines over streams: the cooldown of each scope."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.operators.cooldown import FIRST_WAIT, LONG_FROM, REPEAT_SECONDS, REPEAT_WAIT

STATE = "resume long, count int, last long, kind string"
OUT = "scope string, resume long, ambiguous_count int, cooldown_kind string"


def advance(state: tuple, at: int, retry_after: int | None) -> tuple:
    """One observation, by the rules of operators.cooldown."""
    resume, count, last, _ = state
    if retry_after is not None:
        wait, count, seen, kind = retry_after, 0, None, "provider_long" if retry_after >= LONG_FROM else "provider_short"
    else:
        count = count + 1 if last is not None and at - last <= REPEAT_SECONDS else 1
        wait, seen, kind = (REPEAT_WAIT, at, "ambiguous_long") if count >= 2 else (FIRST_WAIT, at, "ambiguous_short")
    return max(resume or 0, at + wait), count, seen, kind


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = tuple(None if pd.isna(x) else x for x in state.get) if state.exists else (None, 0, None, "")
    rows = pd.concat(list(frames)).sort_values(["at", "retry_after"], na_position="first")
    for at, retry in zip(rows["at"], rows["retry_after"], strict=True):
        now = advance(now, int(at), None if pd.isna(retry) else int(retry))
    state.update(now)
    yield pd.DataFrame([(key[0], now[0], now[1], now[3])], columns=["scope", "resume", "ambiguous_count", "cooldown_kind"])


def cooldowns(observations: DataFrame) -> DataFrame:
    """The cooldown of each scope after every batch of (scope, at, retry_after) that touches it."""
    return observations.groupBy("scope").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
