"""Rate limits on a stream: the batch answer in any order of arrival within the watermark."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.operators.corrections import HOUR_US

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "subject_id long, seq long, us long, in_last_hour long, allowed boolean"


class Limiter(StatefulProcessor):
    """Holds a subject's attempts until the watermark has passed them, answers them in order, and remembers only the
    stored times of the last hour. When that hour has passed too, nothing of the subject is left."""

    def __init__(self, most: int, within_us: int):
        self.most, self.within_us = most, within_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, seq bigint")
        self.stored = handle.getListState("stored", "us bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = [pair for batch in rows for pair in zip(batch["us"].tolist(), batch["seq"].tolist(), strict=True)]
        self.waiting.appendList(came)
        # A timer for the first attempt alone: when it fires, the first that isn't due yet gets the next.
        self.handle.registerTimer(min(us for us, _ in came) // 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed_us = (timerValues.getCurrentWatermarkInMs() + 1) * 1000
        waiting = sorted(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        due, later = [x for x in waiting if x[0] < passed_us], [x for x in waiting if x[0] >= passed_us]
        stored = [us for (us,) in self.stored.get()] if self.stored.exists() else []
        answers = []
        for us, seq in due:
            stored = [t for t in stored if t >= us - self.within_us]
            answers.append((key[0], seq, us, len(stored), len(stored) < self.most))
            if len(stored) < self.most:
                stored.append(us)
        stored = [t for t in stored if t + self.within_us >= passed_us]
        for state, values in ((self.waiting, later), (self.stored, [(t,) for t in stored])):
            if values:
                state.put(values)
            else:
                state.clear()
        if later:
            self.handle.registerTimer(later[0][0] // 1000)
        if stored:
            self.handle.registerTimer((stored[-1] + self.within_us) // 1000 + 1)
        if answers:
            yield pd.DataFrame(answers, columns=["subject_id", "seq", "us", "in_last_hour", "allowed"])

    def close(self) -> None:
        pass


def rate_limited(attempts: DataFrame, watermark: str, most: int = 10, within_us: int = HOUR_US) -> DataFrame:
    """Attempts (``subject_id seq us ts``, ``ts`` the time of ``us``) with how many of the subject's were stored in the
    hour before each, and whether it was allowed. Names RocksDB as the state store of the session, which timers need."""
    spark = attempts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    keyed = attempts.withWatermark("ts", watermark).groupBy("subject_id")
    return keyed.transformWithStateInPandas(Limiter(most, within_us), outputStructType=ANSWER, outputMode="Append", timeMode="EventTime")
