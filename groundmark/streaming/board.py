"""The board of results as a stream: totals of the newest session, the last good ones kept, and a mark where they are stale.

State is kept by board: the newest session that had results, and the totals of its ranking keys. Landings of an older
session change nothing. A period of three refreshes without a batch that has rows for the board makes what it shows stale;
a timer of processing time says so once, and the next rows take the mark away.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds between two refreshes, and how many without news make a board stale.
REFRESH_S, STALE_AFTER = 5.0, 3
ROW = "board string, session string, key string, total double, n long, stale boolean"


class Board(StatefulProcessor):
    """Landings (board, session, landing, key, score, bad) to the rows that changed, and to stale marks."""

    def __init__(self, refresh_s: float = REFRESH_S):
        self.period_ms = int(STALE_AFTER * refresh_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "session string, due long, stale boolean")
        self.seen = handle.getMapState("seen", "landing string", "key string, score double")
        self.totals = handle.getMapState("totals", "key string", "total double, n long")

    def _show(self, board: str, session: str, rows: list[tuple], stale: bool) -> pd.DataFrame:
        return pd.DataFrame([(board, session, *row, stale) for row in rows], columns=[x.split()[0] for x in ROW.split(", ")])

    def _add(self, changed: dict, key: str, score: float, n: int) -> None:
        had = changed.get(key) or (self.totals.getValue((key,)) if self.totals.containsKey((key,)) else (0.0, 0))
        changed[key] = (had[0] + score, had[1] + n)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.newest.get()
        session, due, stale = state if state else (None, None, False)
        changed: dict[str, tuple[float, int]] = {}
        news = False
        for part in rows:
            # a batch that could not be read is no news: what was good stays
            for row in part[~part["bad"]].sort_values("session").itertuples():
                news = True
                if session is not None and row.session < session:
                    continue
                if session is None or row.session > session:
                    session, changed = row.session, {}
                    self.seen.clear()
                    self.totals.clear()
                if self.seen.containsKey((row.landing,)):  # a landing that was scored anew takes its old score back
                    old, score = self.seen.getValue((row.landing,))
                    self._add(changed, old, -score, -1)
                score = 0.0 if pd.isna(row.score) else float(row.score)
                self._add(changed, row.key, score, 1)
                self.seen.updateValue((row.landing,), (row.key, score))
        if not news:
            return
        for name, value in changed.items():
            self.totals.updateValue((name,), value)
        if due is not None:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.period_ms
        self.handle.registerTimer(due)
        self.newest.update((session, due, False))
        shown = [(k[0], *v) for k, v in self.totals.iterator()] if stale else [(k, *v) for k, v in changed.items()]
        if shown:
            yield self._show(key[0], session, shown, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        session, due, stale = self.newest.get()
        if not stale:
            self.newest.update((session, due, True))
            yield self._show(key[0], session, [(k[0], *v) for k, v in self.totals.iterator()], True)


def board(landings: DataFrame, refresh_s: float = REFRESH_S) -> DataFrame:
    """A stream of the changed rows (board, session, key, total, n, stale) of scored landings (board, session, landing, key, score).

    The last row of a board's key within its newest session is what it shows. A null score counts as 0; a landing that comes
    again replaces itself; rows marked `bad`, of what could not be read, are no news.
    """
    bad = F.coalesce("bad", F.lit(False)) if "bad" in landings.columns else F.lit(False)
    rows = landings.select("board", "session", F.col("landing").cast("string").alias("landing"), "key", F.col("score").cast("double").alias("score"), bad.alias("bad"))
    return rows.groupBy("board").transformWithStateInPandas(Board(refresh_s), ROW, "Update", "ProcessingTime")
