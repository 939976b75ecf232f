"""Live events as streams: ids once, running counts, and each segment's text folded from deltas."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FOLDED = "project_id long, segment_id long, text string, status string, last_id long"
IDLE_MS = 86_400_000


def stream_dedup(events: DataFrame, time: str = "ts", late: str = "1 hour", after: int | None = None) -> DataFrame:
    """Each event id once, those at or below ``after``, the last one sent, not at all. Ids repeat only for a while, so the watermark bounds what is remembered."""
    if after is not None:
        events = events.where(F.col("id") > after)
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(["project_id", "id"])


def stream_progress(events: DataFrame) -> DataFrame:
    """Running counts for each project."""
    return events.groupBy("project_id").agg(F.count_if(F.col("type") == "segment_done").alias("done"), F.count_if(F.col("type") == "segment_error").alias("errors"), F.count("*").alias("total"))


WHOLE = ("segment_done", "segment_updated")


def fold(text: str, status: str, rows: pd.DataFrame) -> tuple[str, str]:
    """``folded`` of a frame of events in any order."""
    rows = rows.sort_values("id", kind="stable")
    return folded(text, status, list(zip(*(rows[c].tolist() for c in ("id", *FIELDS)), strict=True)))


def anew(event: tuple) -> bool:
    """Whether an event puts a text in place of what was there: a reset, or a whole text given with a delta or at the end."""
    return event[TYPE] == "segment_reset" or (event[TYPE] in ("segment_delta", *WHOLE) and not pd.isna(event[TARGET]))


def says(event: tuple) -> bool:
    return event[TYPE] in WHOLE and not pd.isna(event[STATUS])


def folded(text: str, status: str, events: list[tuple]) -> tuple[str, str]:
    """Events in the order of ids: deltas add to the text, a whole text or a reset replaces it. What stands before the
    last replacement doesn't matter, so only the deltas after it are joined."""
    at = next((k for k in range(len(events) - 1, -1, -1) if anew(events[k])), -1)
    if at >= 0:
        text = "" if events[at][TYPE] == "segment_reset" else events[at][TARGET]
    added = [e[DELTA] for e in events[at + 1 :] if e[TYPE] == "segment_delta" and not pd.isna(e[DELTA])]
    return text + "".join(added), next((e[STATUS] for e in reversed(events) if says(e)), status)


def needed(events: list[tuple]) -> list[tuple]:
    """Those of waiting events, in order, that later ones may still meet: the last replacement and the deltas after it, the
    last status, and the last event. What an event that comes late puts before the replacement changes no text."""
    at = next((k for k in range(len(events) - 1, -1, -1) if anew(events[k])), 0)
    said = next((k for k in range(len(events) - 1, -1, -1) if says(events[k])), -1)
    kept = [e for k, e in enumerate(events[:-1]) if k == said or (k >= at and (anew(e) or e[TYPE] == "segment_delta"))]
    return kept + events[-1:]


WAITING = "id long, ts long, type string, delta string, target_text string, status string"
FIELDS = [c.split()[0] for c in WAITING.split(", ")][1:]
ID, TS, TYPE, DELTA, TARGET, STATUS = range(6)


class SegmentTexts(StatefulProcessor):
    """A segment's text from events in any order. Events wait in a list until the watermark has passed them and all
    before them; then they are folded into the settled text and leave the state, which so holds no more than the
    watermark's span, and of that only what is ``needed``: it is read and written at once, not event by event. A waiting
    event's time is the latest of those up to it, so it stands for those that are no longer kept. What comes after its
    place was settled is too late. A timer ends idle segments."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "text string, status string, last_id long")
        self.waiting = handle.getListState("waiting", WAITING)

    def forget(self) -> None:
        self.settled.clear()
        self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.settled.get()
        text, status, last = known or ("", "pending", -1)
        held = {e[ID]: tuple(e) for e in self.waiting.get()} if known else {}
        came: dict[int, tuple] = {}
        for frame in rows:
            times = frame["ts"].to_numpy().astype("datetime64[ms]").astype("int64").tolist()
            for e in zip(frame["id"].tolist(), times, *(frame[c].tolist() for c in FIELDS[1:]), strict=True):
                if not pd.isna(e[ID]) and e[ID] > last:
                    came[int(e[ID])] = (int(e[ID]), e[TS], *(None if pd.isna(x) else x for x in e[2:]))
        deleted = any(e[TYPE] == "project_deleted" for e in came.values())
        every = sorted((came | held).values(), key=lambda e: e[ID])
        now, so_far = folded(text, status, every)
        newest = every[-1][ID] if every else last
        if deleted:
            self.forget()
        else:
            watermark = timerValues.getCurrentWatermarkInMs()
            times = list(accumulate((e[TS] for e in every), max))
            n = bisect_right(times, watermark)  # up to the first that may still be overtaken
            if n:
                text, status = folded(text, status, every[:n])
                last = every[n - 1][ID]
            self.settled.update((text, status, last))
            left = needed([(e[ID], t, *e[2:]) for e, t in zip(every[n:], times[n:], strict=True)])
            if left:
                self.waiting.put(left)
            elif held:
                self.waiting.clear()
            if known:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
            self.handle.registerTimer(max(times[-1] if times else 0, watermark) + IDLE_MS)
        yield pd.DataFrame({"project_id": [key[0]], "segment_id": [key[1]], "text": [now], "status": [so_far], "last_id": [newest]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter([])

    def close(self) -> None:
        pass


def stream_segment_text(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each segment's text so far, whatever order events come in while the watermark waits for them; state goes, by event
    time, a day after a segment's last event, or with its project. The session's state store must be the one that
    ``state_store`` names. A timeout by the clock would keep a stream that ends with its data from ending."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy("project_id", "segment_id").transformWithStateInPandas(SegmentTexts(), FOLDED, "update", "eventTime")


def state_store(spark: SparkSession) -> None:
    """The store that keeps maps and timers, for streams that begin after this."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
