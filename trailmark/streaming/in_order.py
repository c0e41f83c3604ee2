"""Custom state per key, decided in order of event time whatever files and micro-batches the rows come in.

A ``Decider`` keeps the state of a key and takes its rows in order of (seconds, event_id). ``AsItComes``
hands it each micro-batch as it is. ``InOrder`` holds rows back until the watermark has passed their
second and hands them over when an event-time timer fires. A row that comes after later rows of its key
have been decided can't be taken any more; it is given out as late, never dropped.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trailmark.operators.spread import MILESTONE_STEP, MILESTONES

ORDER = ["seconds", "event_id"]
#: Kinds of rows; a carried one is a detection of the slot of time before.
DETECTION, SIGHTING, CARRIED = "detection", "sighting", "carried"
#: Entries of state that the sources of an item are dealt over. An entry is read and written as a whole.
SOURCE_SLOTS = 1024
#: Most rows that wait in one entry of state.
BLOCK_ROWS = 10_000


def _blocks(rows: pd.DataFrame) -> list[tuple[bytes]]:
    """Rows as entries of state, many to an entry: every entry is a call of its own to the state store."""
    packed = []
    for start in range(0, len(rows), BLOCK_ROWS):
        batch = pa.RecordBatch.from_pandas(rows.iloc[start : start + BLOCK_ROWS], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        packed.append((sink.getvalue().to_pybytes(),))
    return packed


def _rows(blocks: Iterator[tuple[bytes]], columns: list[str]) -> pd.DataFrame:
    return pd.concat([pa.ipc.open_stream(bytes(b)).read_pandas() for (b,) in blocks], ignore_index=True)[columns]


class Decider:
    """State of one kind of key. ``FIELDS`` names the columns besides ORDER that it takes, all of them strings.

    Where keys are slots of time, ``SLOTS``, none knows what has been decided of the others.
    """

    FIELDS: list[str] = []
    SLOTS = False

    def open(self, handle: StatefulProcessorHandle, **options) -> None:
        raise NotImplementedError

    def decide(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        """Takes rows in order; what they tell, or None for nothing."""
        raise NotImplementedError

    def late(self, key: tuple, rows: pd.DataFrame, behind: np.ndarray) -> pd.DataFrame | None:
        """Rows that came too late, by so many seconds; None if all of them are told for another key."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError


class Cooldown(Decider):
    """Keeps the last kept second per (item, alert type) and drops alerts within the cooldown."""

    def __init__(self, cooldown_seconds: int, tell_late: bool = False):
        self.gap, self.tell_late = cooldown_seconds, tell_late

    def open(self, handle, **options):
        self.last = handle.getValueState("last_kept", "second bigint", **options)

    def _told(self, key, seconds, events, late):
        texts = {c: pd.Series([v] * len(seconds), dtype="object") for c, v in zip(("video_hash", "alert_type"), key, strict=True)}
        told = pd.DataFrame(texts | {"seconds": seconds.astype("int64"), "event_id": events.astype("int64")})
        return told.assign(late=late) if self.tell_late else told

    def decide(self, key, rows):
        seconds = rows["seconds"].to_numpy()
        floor = self.last.get()[0] + self.gap if self.last.exists() else seconds[0]
        kept = []
        at = int(np.searchsorted(seconds, floor, side="left"))
        while at < len(seconds):
            kept.append(at)
            at = int(np.searchsorted(seconds, seconds[at] + self.gap, side="left"))
        # nothing is told for nothing kept: an empty frame has no types
        if not kept:
            return None
        self.last.update((int(seconds[kept[-1]]),))
        return self._told(key, seconds[kept], rows["event_id"].to_numpy()[kept], False)

    def late(self, key, rows, behind):
        return self._told(key, rows["seconds"].to_numpy(), rows["event_id"].to_numpy(), True)

    def forget(self):
        self.last.clear()


class Spread(Decider):
    """Per item: running count, last country, countries seen, and count and first second of every source.

    Sources are dealt over slots by their digest, so that a micro-batch makes no more calls than there are slots.
    Where state expires by itself each source is a slot of its own, or one would keep the others.
    """

    FIELDS = ["country", "ip_hash"]

    def open(self, handle, **options):
        self.total = handle.getValueState("total", "n bigint, country string, countries bigint", **options)
        self.countries = handle.getMapState("countries", "country string", "seen int", **options)
        self.sources = handle.getMapState("sources", "slot string", "packed string", **options)
        self.expires = bool(options)

    def decide(self, key, rows):
        rows = rows.reset_index(drop=True)
        before, last, unique = self.total.get() if self.total.exists() else (0, None, 0)
        number = before + 1 + np.arange(len(rows))

        once = ~rows["country"].duplicated()
        unseen = [c for c in rows["country"][once] if not self.countries.containsKey((c,))]
        new = (once & rows["country"].isin(unseen)).to_numpy()
        countries = unique + np.cumsum(new)
        previous = rows["country"].shift(1)
        previous[0] = last

        by_source = rows.groupby("ip_hash", sort=False)["seconds"]
        counts = by_source.agg(["size", "first"])
        slots: dict[str, dict[str, tuple[int, int]]] = {}
        for ip, n, at in counts.itertuples(name=None):
            slot = ip if self.expires else str(zlib.crc32(ip.encode()) % SOURCE_SLOTS)
            slots.setdefault(slot, {})[ip] = n, at
        known: dict[str, list[int]] = {}
        for slot, arrived in slots.items():
            stored = json.loads(self.sources.getValue((slot,))[0]) if self.sources.containsKey((slot,)) else {}
            known |= {ip: stored[ip] for ip in arrived if ip in stored}
            for ip, (n, at) in arrived.items():
                total, earliest = stored.get(ip, (0, at))
                stored[ip] = total + n, earliest
            self.sources.updateValue((slot,), (json.dumps(stored),))
        counts["base"] = [known[ip][0] if ip in known else 0 for ip in counts.index]
        counts["since"] = [known[ip][1] if ip in known else at for ip, at in counts["first"].items()]
        uploads = rows["ip_hash"].map(counts["base"]).to_numpy() + 1 + by_source.cumcount().to_numpy()
        first = rows["ip_hash"].map(counts["since"]).to_numpy()

        self.total.update((int(number[-1]), rows["country"].iloc[-1], int(countries[-1])))
        for country in unseen:
            self.countries.updateValue((country,), (1,))

        viral = np.isin(number, MILESTONES) | (number % MILESTONE_STEP == 0)
        seconds = rows["seconds"].to_numpy()
        kinds = [
            ("reupload", uploads > 1, None, None, uploads, seconds - first),
            ("spread", new & (number > 1), previous, rows["country"], countries, None),
            ("viral", viral, None, None, number, countries),
        ]
        found = [self._told(key, rows[mask], kind, *self._at(mask, *values)) for kind, mask, *values in kinds if mask.any()]
        return pd.concat(found, ignore_index=True) if found else None

    @staticmethod
    def _at(mask, *values):
        return [None if v is None else np.asarray(v)[mask] for v in values]

    @staticmethod
    def _told(key, rows, kind, previous, country, number, detail):
        def column(values, dtype):
            return pd.Series([None] * len(rows) if values is None else values, dtype=dtype)

        return pd.DataFrame(
            {
                "video_hash": column([key[0]] * len(rows), "object"),
                "event_id": column(rows["event_id"].to_numpy(), "int64"),
                "kind": column([kind] * len(rows), "object"),
                "previous_country": column(previous, "object"),
                "country": column(country, "object"),
                "number": column(number, "Int64"),
                "detail": column(detail, "Int64"),
            }
        )

    def late(self, key, rows, behind):
        return self._told(key, rows, "late", None, rows["country"].to_numpy(), None, behind)

    def forget(self):
        for state in (self.total, self.countries, self.sources):
            state.clear()


class LastDetection(Decider):
    """Per item and slot of time the detections of the last ``within`` seconds, one entry per second, for the sightings that follow.

    Takes rows of all kinds; each sighting finds the last detection of an earlier second and how many there are.
    """

    FIELDS = ["kind"]
    SLOTS = True

    def __init__(self, within_seconds: int):
        self.within = within_seconds

    def open(self, handle, **options):
        # seconds with a detection, the greatest event and the number of events in each
        self.recent = handle.getListState("recent", "second bigint, event_id bigint, n bigint", **options)

    def decide(self, key, rows):
        found = rows["kind"].to_numpy() != SIGHTING
        known = pd.DataFrame(list(self.recent.get()) if self.recent.exists() else [], columns=["second", "event", "n"], dtype="int64")
        new = pd.DataFrame({"second": rows["seconds"][found], "event": rows["event_id"][found], "n": 1})
        told = pd.concat([known, new.astype("int64")]).groupby("second", as_index=False).agg({"event": "max", "n": "sum"})
        at, total = told["second"].to_numpy(), np.concatenate([[0], np.cumsum(told["n"].to_numpy())])

        keep = told[at > rows["seconds"].iloc[-1] - self.within]
        if len(keep):
            self.recent.put([tuple(int(v) for v in r) for r in keep.itertuples(index=False)])
        else:
            self.recent.clear()

        seen = rows["seconds"].to_numpy()[~found]
        end, start = np.searchsorted(at, seen, side="left"), np.searchsorted(at, seen - self.within, side="left")
        hit = end > start
        if not hit.any():
            return None
        events = rows["event_id"].to_numpy()[~found][hit]
        return self._told(key, SIGHTING, events, told["event"].to_numpy()[end[hit] - 1], (total[end] - total[start])[hit], False)

    @staticmethod
    def _told(key, kind, events, last, n, late):
        def numbers(values):
            return pd.Series([None] * len(events) if values is None else values, dtype="Int64")

        kinds = pd.Series([kind] * len(events) if isinstance(kind, str) else kind, dtype="object")
        item = pd.Series([key[0]] * len(events), dtype="object")
        out = {"video_hash": item, "kind": kinds, "event_id": events.astype("int64"), "detection_id": numbers(last)}
        return pd.DataFrame(out | {"detections": numbers(n), "late": late})

    def late(self, key, rows, behind):
        rows = rows[(rows["kind"] != CARRIED).to_numpy()]  # carried ones are as late in their own slot
        return self._told(key, rows["kind"].to_numpy(), rows["event_id"].to_numpy(), None, None, True) if len(rows) else None

    def forget(self):
        self.recent.clear()


class AsItComes(StatefulProcessor):
    """Every micro-batch of a key in order; batches must come in order of time themselves."""

    def __init__(self, decider: Decider, ttl_ms: int | None = None):
        self.decider = decider
        self.ttl = {"ttlDurationMs": ttl_ms} if ttl_ms else {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.decider.open(handle, **self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = self.decider.decide(key, pd.concat(list(rows)).sort_values(ORDER))
        if told is not None:
            yield told

    def close(self) -> None:
        pass


class InOrder(StatefulProcessor):
    """Rows wait in state until the watermark has passed their second.

    A key holds the rows of the allowed lateness and of one micro-batch. A row that follows the one before
    by more than ``forget_seconds`` finds its key forgotten, whenever it comes. A key has one timer: for its
    first waiting row, or, with none waiting, for the time from which on every row would find it forgotten;
    then its state goes. For a key that is not known, or is a slot of time, rows behind the watermark are late,
    for one that is known only those that are not after its last decided second.
    """

    def __init__(self, decider: Decider, forget_seconds: int):
        self.decider, self.idle = decider, forget_seconds
        self.columns = [*ORDER, *decider.FIELDS]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        # last decided second, first held second (-1: none), time of the timer (-1: none)
        self.place = handle.getValueState("place", "decided bigint, held bigint, timer bigint")
        self.decider.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        decided, first, timer = self.place.get() if self.place.exists() else (None, -1, -1)
        closed = mark // 1000 - 1 if decided is None or self.decider.SLOTS else decided
        for chunk in rows:
            chunk = chunk[chunk["is_row"].to_numpy(dtype=bool)]  # the others are heartbeats
            seconds = chunk["seconds"].to_numpy(dtype="int64")
            late = seconds <= closed
            told = self.decider.late(key, chunk[late], closed - seconds[late]) if late.any() else None
            if told is not None:
                yield told
            chunk, seconds = chunk[~late], seconds[~late]
            if len(chunk):
                self.held.appendList(_blocks(chunk[self.columns]))
                first = int(seconds.min()) if first < 0 else min(first, int(seconds.min()))
        if decided is not None or first >= 0:
            yield from self._release(key, mark, decided, first, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        decided, first, timer = self.place.get() if self.place.exists() else (None, -1, -1)
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return  # set anew since
        if first < 0 and decided is not None and (decided + 1 + self.idle) * 1000 <= mark:
            self.place.clear()
            self.decider.forget()
        else:
            yield from self._release(key, mark, decided, first, -1)

    def _release(self, key, mark, decided, first, timer):
        if first >= 0 and (first + 1) * 1000 <= mark:
            waiting = _rows(self.held.get(), self.columns)
            ready = (waiting["seconds"] + 1) * 1000 <= mark
            rest = waiting[~ready]
            if len(rest):
                self.held.put(_blocks(rest))
            else:
                self.held.clear()
            due = waiting[ready].sort_values(ORDER)
            seconds = due["seconds"].to_numpy()
            gaps = np.diff(seconds, prepend=seconds[0] if decided is None else decided)
            starts = np.flatnonzero(gaps > self.idle).tolist()
            for a, b in zip([0, *starts], [*starts, len(due)], strict=True):
                if a in starts:
                    self.decider.forget()
                told = self.decider.decide(key, due.iloc[a:b]) if a < b else None
                if told is not None:
                    yield told
            decided = int(seconds[-1])
            first = int(rest["seconds"].min()) if len(rest) else -1
        wanted = (first + 1) * 1000 if first >= 0 else (decided + 1 + self.idle) * 1000
        if wanted != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        self.place.update((decided, first, wanted))

    def close(self) -> None:
        pass
