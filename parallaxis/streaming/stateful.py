"""Stateful operators over streams: greedy rate thinning, counters, the latest sample at each frame, segments, and the completeness of uploads.

Each keeps a few values per key, and lets them go when they can't matter any more. Thinning compares with the last row that was kept, so
rows of a key must come in time order; one that comes late is an error, as it would be for a recorder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Thinning(StatefulProcessor):
    """Keeps a row if it is at least so far behind the last one kept. Rows: key, ts (double), payload."""

    def __init__(self, least: float, strict: bool = True):
        self.least, self.strict = least, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "kept double, seen double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept, seen = self.last.get() if self.last.exists() else (float("-inf"), float("-inf"))
        out = []
        for pdf in rows:
            for r in pdf.sort_values("ts", kind="stable").itertuples(index=False):
                if r.ts < seen:
                    if self.strict:
                        raise ValueError(f"a row of {key[0]} at {r.ts} comes after one at {seen}")
                    continue
                seen = r.ts
                if r.ts - kept >= self.least:
                    kept = r.ts
                    out.append((key[0], r.ts, r.payload))
        self.last.update((kept, seen))
        yield pd.DataFrame(out, columns=["key", "ts", "payload"])

    def close(self) -> None:
        pass


def thin(stream: DataFrame, least: float, strict: bool = True) -> DataFrame:
    """stream: key string, ts double, payload string."""
    return stream.groupBy("key").transformWithStateInPandas(statefulProcessor=Thinning(least, strict), outputStructType="key string, ts double, payload string", outputMode="Append", timeMode="None")


#: A recorder shows its counters with every so many colour frames, and looks at every so many depth maps from the first on.
COLOR_CADENCE, DEPTH_CADENCE = 5, 15
COUNTERS = "key string, color_frames long, depth_frames long, dropped_color long, dropped_depth long, valid_share double, median_m double"


class Counters(StatefulProcessor):
    """Running counters of a recording, given out with every COLOR_CADENCE-th delivered colour frame.

    Rows: key, ts, pos, stream ('color' or 'depth'), dropped (null if it was delivered), valid_share and median_m (of a depth map); in a
    batch they are taken by ts, then pos. The last two are those of the latest map that was looked at."""

    NAMES = ("color_frames", "depth_frames", "dropped_color", "dropped_depth", "valid_share", "median_m")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "color_frames long, depth_frames long, dropped_color long, dropped_depth long, valid_share double, median_m double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = dict(zip(self.NAMES, self.held.get() if self.held.exists() else (0, 0, 0, 0, None, None), strict=True))
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "pos"], kind="stable").itertuples(index=False):
            if isinstance(r.dropped, str):
                held[f"dropped_{r.stream}"] += 1
                continue
            held[f"{r.stream}_frames"] += 1
            if r.stream == "depth" and held["depth_frames"] % DEPTH_CADENCE == 1:
                held |= {n: None if pd.isna(getattr(r, n)) else float(getattr(r, n)) for n in ("valid_share", "median_m")}
            if r.stream == "color" and held["color_frames"] % COLOR_CADENCE == 0:
                out.append((key[0], *held.values()))
        self.held.update(tuple(held.values()))
        yield pd.DataFrame(out, columns=["key", *self.NAMES])

    def close(self) -> None:
        pass


def counters(stream: DataFrame) -> DataFrame:
    """stream: key string, ts double, pos long, stream string, dropped string, valid_share double, median_m double."""
    return stream.groupBy("key").transformWithStateInPandas(statefulProcessor=Counters(), outputStructType=COUNTERS, outputMode="Append", timeMode="None")


#: The clock of recordings begins anywhere, the watermark at 0; so times are moved by this, or the first rows would be late.
ORIGIN_MS = 86_400_000


def _at(ts: Column) -> Column:
    return F.timestamp_millis((ts * 1000).cast("long") + ORIGIN_MS).alias("at")


class Latest(StatefulProcessor):
    """Each frame with the newest sample up to its time, once the watermark says that none is missing.

    Rows: key, ts (seconds), at (its timestamp, with the watermark), is_sample, payload. Frames wait for the watermark; when it passes them they
    go, and of the samples up to it only the newest stays. So what a key holds is what lies within the watermark's delay, and one sample."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "ts double, payload string")
        self.frames = handle.getListState("frames", "ts double, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for pdf in rows:
            for state, of in ((self.samples, pdf[pdf["is_sample"]]), (self.frames, pdf[~pdf["is_sample"]])):
                if len(of):
                    state.appendList([(float(t), None if p is None else str(p)) for t, p in zip(of["ts"], of["payload"], strict=True)])
                    latest = max(latest if latest is not None else float("-inf"), float(of["ts"].max()))
        if latest is not None:
            self.handle.registerTimer(self._due(latest))
        yield pd.DataFrame([], columns=["key", "ts", "payload", "sample"])

    @staticmethod
    def _due(ts: float) -> int:
        """When the watermark is beyond everything of this time."""
        return int(ts * 1000) + 1 + ORIGIN_MS

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = expiredTimerInfo.getExpiryTimeInMs()
        samples = sorted(self.samples.get() if self.samples.exists() else (), key=lambda s: s[0])
        out, waiting, i = [], [], 0
        for ts, payload in sorted(self.frames.get() if self.frames.exists() else (), key=lambda f: f[0]):
            if self._due(ts) > limit:
                waiting.append((ts, payload))
                continue
            while i < len(samples) and samples[i][0] <= ts:
                i += 1
            out.append((key[0], ts, payload, samples[i - 1][1] if i else None))
        past = sum(self._due(ts) <= limit for ts, _ in samples)
        for state, kept in ((self.samples, samples[max(past - 1, 0) :]), (self.frames, waiting)):
            state.put(kept) if kept else state.clear()
        yield pd.DataFrame(out, columns=["key", "ts", "payload", "sample"])

    def close(self) -> None:
        pass


def with_latest(frames: DataFrame, samples: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """frames: key string, ts double, payload string; samples: the same. Adds sample: the payload of the newest sample up to each frame's time, null
    before the first. Rows may come out of order by the delay; later ones are left out."""
    part = lambda df, is_sample: df.select("key", "ts", _at(F.col("ts")), F.lit(is_sample).alias("is_sample"), "payload")
    both = part(frames, False).unionByName(part(samples, True)).withWatermark("at", delay)
    return both.groupBy("key").transformWithStateInPandas(statefulProcessor=Latest(), outputStructType="key string, ts double, payload string, sample string", outputMode="Append", timeMode="EventTime")


class Segments(StatefulProcessor):
    """Segments of a file that is being written: full ones as they close, the last one when the file ends or has been silent for long.

    Rows: key, ts, at, pos, size (null: the file ends). A segment closes with the frame that takes it to the limit. What ends leaves no state."""

    def __init__(self, limit: int, silence_ms: int):
        self.limit, self.silence_ms = limit, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "segment long, frames long, size long, latest double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        segment, frames, size, latest = self.open.get() if self.open.exists() else (0, 0, 0, float("-inf"))
        out, ended = [], False
        for r in pd.concat(list(rows)).sort_values(["ts", "pos"], kind="stable").itertuples(index=False):
            latest = max(latest, float(r.ts))
            ended = pd.isna(r.size)
            if ended:
                continue
            frames, size = frames + 1, size + int(r.size)
            if size >= self.limit:
                out.append((key[0], segment, frames, size, "full"))
                segment, frames, size = segment + 1, 0, 0
        if ended:
            out += [(key[0], segment, frames, size, "ended")] if frames else []
            self._forget()
        else:
            self.open.update((segment, frames, size, latest))
            self._wait(latest)
        yield pd.DataFrame(out, columns=["key", "segment", "frames", "size", "why"])

    def _forget(self) -> None:
        self.open.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def _wait(self, latest: float) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(latest * 1000) + ORIGIN_MS + self.silence_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        segment, frames, size, _ = self.open.get() if self.open.exists() else (0, 0, 0, 0.0)
        self.open.clear()
        yield pd.DataFrame([(key[0], segment, frames, size, "silent")] if frames else [], columns=["key", "segment", "frames", "size", "why"])

    def close(self) -> None:
        pass


def segments(stream: DataFrame, limit: int, silence_s: float, delay: str = "10 seconds") -> DataFrame:
    """stream: key string, ts double, pos long, size long; a row without a size ends its file. key, segment, frames, size and why it was closed (full,
    ended, silent: nothing came for so long by the rows' times)."""
    rows = stream.select("key", "ts", _at(F.col("ts")), "pos", "size").withWatermark("at", delay)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Segments(limit, int(silence_s * 1000)), outputStructType="key string, segment long, frames long, size long, why string", outputMode="Append", timeMode="EventTime")


class Completeness(StatefulProcessor):
    """Emits an upload once its manifest and every file it lists have come, in any order, with equal sizes and hashes.

    Rows: key, name, size, sha256, manifest (JSON list of name, size, sha256; null for files). The first manifest of a key and
    the latest file of a name count. A complete upload is emitted once and its files and manifest leave the state; that it was emitted is
    remembered for as long as an upload may be silent. One that is silent for longer before it is complete is emitted as expired,
    with what had come, and leaves the state too."""

    def __init__(self, silence_ms: int | None = None):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "name string", "size long, sha256 string")
        self.manifest = handle.getValueState("manifest", "value string")
        self.done = handle.getValueState("done", "value boolean", *([self.silence_ms] if self.silence_ms else []))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        if not self.done.exists():
            for pdf in rows:
                for r in pdf.itertuples(index=False):
                    if isinstance(r.manifest, str):
                        if not self.manifest.exists():
                            self.manifest.update((r.manifest,))
                    else:
                        self.files.updateValue((r.name,), (int(r.size), r.sha256))
            members = json.loads(self.manifest.get()[0]) if self.manifest.exists() else None
            if members is not None and all(self._there(m) for m in members):
                out.append((key[0], len(members), sum(int(m["size"]) for m in members), "complete"))
                self._forget()
                self.done.update((True,))
            elif self.silence_ms:
                self._timers(timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)
        yield pd.DataFrame(out, columns=["key", "members", "size", "state"])

    def _there(self, m: dict) -> bool:
        return self.files.containsKey((m["name"],)) and tuple(self.files.getValue((m["name"],))) == (int(m["size"]), m["sha256"])

    def _forget(self) -> None:
        self.files.clear()
        self.manifest.clear()
        self._timers()

    def _timers(self, *due: int) -> None:
        if self.silence_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            for t in due:
                self.handle.registerTimer(t)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sizes = [int(v[0]) for v in self.files.values()] if self.files.exists() else []
        self.files.clear()
        self.manifest.clear()
        yield pd.DataFrame([(key[0], len(sizes), sum(sizes), "expired")], columns=["key", "members", "size", "state"])

    def close(self) -> None:
        pass


def completed(stream: DataFrame, silence_s: float | None = None) -> DataFrame:
    """stream: key string, name string, size long, sha256 string, manifest string. key, members, size, state: complete, or, if a silence is
    given, expired (members and size are then of the files that had come)."""
    processor = Completeness(int(silence_s * 1000) if silence_s else None)
    return stream.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType="key string, members int, size long, state string", outputMode="Append", timeMode="ProcessingTime" if silence_s else "None")
