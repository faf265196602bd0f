"""OP-185: device profiles kept as state of a stream, with an end.

State of a device: one value of what was observed on each day that the watermark has
not passed, the profile since it began, and when its timer stands. One timer a device stands at the
end of its first such day; when it fires, all days that the watermark has passed
by then are added to the profile, in order, with a row each. So state is read and
written once a device and batch, however many days or rows came. A profile begins
anew after ``idle`` days without an observation, and the timer removes it then, so
the state has devices seen lately only. Days are whole, so the order in which rows
come doesn't matter; rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from heronflow.streaming.flows import timed

DAY_MS = 86_400_000
ROWS = "device_id bigint, day bigint, observations bigint, bytes bigint, tcp bigint, profile_days bigint, profile_observations bigint, profile_bytes bigint"
_ROW = Row(*(c.split()[0] for c in ROWS.split(", ")))
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DeviceProfiles(StatefulProcessor):
    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # day, observations, bytes and TCP packets of each day, one after another
        self.days = handle.getValueState("days", "seen array<bigint>")
        self.profile = handle.getValueState("profile", "days bigint, n bigint, bytes bigint, last bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def _open(self) -> dict[int, list[int]]:
        (seen,) = self.days.get() or ((),)
        return {seen[k]: list(seen[k + 1 : k + 4]) for k in range(0, len(seen), 4)}

    def _keep(self, open_: dict[int, list[int]]) -> None:
        if open_:
            self.days.update(([x for day in sorted(open_) for x in (day, *open_[day])],))
        else:
            self.days.clear()

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        open_ = self._open()
        for _, _, day, size, tcp in rows:
            if day is None:
                continue
            seen = open_.setdefault(day, [0, 0, 0])
            seen[0] += 1
            seen[1] += size or 0
            seen[2] += tcp or 0
        if open_:
            self._keep(open_)
            due, now = (min(open_) + 1) * DAY_MS, self.timer.get()
            if now is None or due < now[0]:
                if now is not None:
                    self.handle.deleteTimer(now[0])
                self._wake(due)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        open_ = self._open()
        days, n, total, last = self.profile.get() or (0, 0, 0, None)
        for day in sorted(d for d in open_ if (d + 1) * DAY_MS <= now):
            seen, size, tcp = open_.pop(day)
            if last is not None and day - last > self.idle:
                days, n, total = 0, 0, 0
            days, n, total, last = days + 1, n + seen, total + size, day
            yield _ROW(*key, day, seen, size, tcp, days, n, total)
        self._keep(open_)
        idle = None if last is None else (last + self.idle + 2) * DAY_MS
        if open_ or idle is not None and idle > now:
            self.profile.update((days, n, total, last))
            self._wake((min(open_) + 1) * DAY_MS if open_ else idle)
        else:
            self.profile.clear()
            self.timer.clear()

    def close(self) -> None:
        pass


def daily_profiles(observed: DataFrame, idle: int, late: str) -> DataFrame:
    """A row for each device and day (days since 1970) once the day is over."""
    rows = timed(observed, late).select("ts", "device_id", F.unix_date(F.to_date("ts")).cast("bigint").alias("day"), F.col("payload_size").alias("bytes"), (F.col("protocol") == "TCP").cast("bigint").alias("tcp"))
    return rows.groupBy("device_id").transformWithState(DeviceProfiles(idle), ROWS, "Append", "EventTime")
