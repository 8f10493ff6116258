"""Timers of the rate limit: one for the first attempt that waits, not one for each."""

from __future__ import annotations

import pandas as pd

from tideline.streaming.limits import Limiter


class State:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def clear(self):
        self.rows = []


class Handle:
    def __init__(self):
        self.timers, self.made, self.watermark = set(), 0, 0

    def getListState(self, name, schema):  # noqa: N802
        return State()

    def registerTimer(self, at):  # noqa: N802
        self.made += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark


def test_one_timer_waits_for_many_attempts():
    handle, limiter = Handle(), Limiter(2, 5_000)
    limiter.init(handle)
    list(limiter.handleInputRows((1,), iter([pd.DataFrame({"us": [9_000, 1_000, 3_000, 40_000], "seq": [2, 0, 1, 3]})]), None))
    assert handle.timers == {1}
    got = []
    for handle.watermark in (3, 10, 60, 100):
        while due := {t for t in handle.timers if t <= handle.watermark}:
            handle.timers -= due
            got += [tuple(r) for _ in due for f in limiter.handleExpiredTimer((1,), handle, None) for r in f.itertuples(index=False)]
    assert got == [(1, 0, 1_000, 0, True), (1, 1, 3_000, 1, True), (1, 2, 9_000, 0, True), (1, 3, 40_000, 0, True)]
    assert not handle.timers and not limiter.waiting.rows and not limiter.stored.rows and handle.made < 10
