"""Fragmented writing as a stream: rows come in, complete fragments go out.

State per file is what waits for the next key frame: encoded samples, the access unit still open, and counters. A key frame
later than what waits sends it off; a row of kind `end` sends the rest and ends the file. Decode times that go back are an
error row, not dropped, since the container forbids them; so are the other rules of submission. Once a file has an error
it stays closed. State is bounded by max_fragment_bytes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinotable.sources import mux
from kinotable.sources.boxes import Malformed
from kinotable.sources.config import nal_units

INPUT = "file string, submit_no bigint, kind string, data binary, pts_ticks bigint, dts_ticks bigint, duration_ticks bigint, is_key boolean"
OUTPUT = "file string, sequence bigint, content binary, violation string"


class Fragmenter:
    """One file's state. Sequence 0 is what stands before the fragments."""

    def __init__(self, video: dict, audio: dict | None, most: int, names: tuple[str, str]):
        self.video, self.audio, self.most, self.names = video, audio, most, names
        self.waiting: list[dict] = []
        self.open: dict | None = None
        self.last: dict[str, int] = {}
        self.sequence, self.closed = 0, False

    def _fail(self, code: str) -> tuple[int | None, bytes | None, str]:
        self.closed, self.waiting, self.open = True, [], None
        return None, None, code

    def _bytes(self) -> int:
        return sum(s["size"] for s in self.waiting) + (self.open["size"] if self.open else 0)

    def _settle(self) -> None:
        if self.open:
            self.waiting.append(self.open)
            self.open = None

    def _send(self, until: int | None) -> Iterator[tuple]:
        """The fragment of all samples before a decode time."""
        own = [s for s in self.waiting if until is None or s["dts"] < until]
        if not own:
            return
        video = [s for s in own if s["kind"] == "video"]
        if not video and until is not None:  # what waits goes on with the next fragment
            return
        if not video or not video[0]["is_key"]:
            yield self._fail("fragment_without_key")
            return
        self.sequence += 1
        yield self.sequence, mux.fragment(self.sequence, [(1, video), (2, [s for s in own if s["kind"] == "audio"])]), None
        self.waiting = self.waiting[len(own) :] if until is None else [s for s in self.waiting if s["dts"] >= until]

    def push(self, row: dict) -> Iterator[tuple]:
        """Output rows (sequence, content, violation) that a submitted row causes."""
        if self.closed:
            return
        kind = row["kind"]
        if kind == "end":
            self._settle()
            yield from self._send(None)
            if not self.sequence and not self.closed:
                yield self._fail("fragmented_without_video")
            self.closed = True
            return
        pts, dts, duration = (int(row[f"{k}_ticks"]) for k in ("pts", "dts", "duration"))
        try:
            units = nal_units(bytes(row["data"])) if kind == "video" else [bytes(row["data"])]
        except Malformed as broken:
            yield self._fail(str(broken))
            return
        n = self.video["nal_length_size"]
        rules = [
            (kind == "audio" and self.audio is None, "configuration_missing"), (not all(units), "payload_empty"), (kind == "video" and max(map(len, units)) >= 1 << 8 * n, "nal_too_long"), (pts < 0, "pts_negative"), (dts < 0, "dts_negative"), (duration <= 0, "duration_not_positive"),
            (dts < self.last.get(kind, 0), "dts_regresses"), (dts < max(self.last.values(), default=0), "dts_regresses_across_tracks"), (duration >= 1 << 32, "duration_range"), (not -(1 << 31) <= pts - dts < 1 << 31, "composition_range"),
        ]
        data = b"".join(len(u).to_bytes(n) + u for u in units) if kind == "video" and not any(r for r, _ in rules) else units[0]
        same = kind == "video" and self.open and (self.open["pts"], self.open["dts"]) == (pts, dts)
        rules.append((bool(same) and (self.open["duration"], self.open["is_key"]) != (duration, bool(row["is_key"])), "access_unit_disagrees"))
        rules.append((kind == "video" and not same and "video" not in self.last and not row["is_key"], "first_video_not_key"))
        if code := next((c for bad, c in rules if bad), None):
            yield self._fail(code)
            return
        if kind == "video" and not same:
            self._settle()
            if row["is_key"] and any(s["kind"] == "video" for s in self.waiting):
                yield from self._send(dts)
                if self.closed:
                    return
        if self._bytes() + len(data) > self.most:
            yield self._fail("fragment_too_large")
            return
        if not self.last:
            yield 0, mux.header("fragmented", self.video, self.audio, self.names), None
        if same:
            self.open["data"] += data
            self.open["size"] += len(data)
        else:
            sample = {"kind": kind, "pts": pts, "dts": dts, "duration": duration, "is_key": kind == "audio" or bool(row["is_key"]), "size": len(data), "data": data}
            if kind == "video":
                self.open = sample
            else:
                self.waiting.append(sample)
        self.last[kind] = dts


def fragment_stream(rows: DataFrame, video: dict, audio: dict | None = None, max_fragment_bytes: int = mux.FRAGMENT_BYTES, names: tuple[str, str] = mux.HANDLER_NAMES) -> DataFrame:
    """Stream of OUTPUT rows from a stream of INPUT rows, which for each file must come in the order of submit_no over batches; within a batch they are put in order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own: Fragmenter = pickle.loads(state.get[0]) if state.exists else Fragmenter(video, audio, max_fragment_bytes, names)
        out = [(key[0], *x) for row in pd.concat(list(batches)).sort_values("submit_no").to_dict("records") for x in own.push(row)]
        state.update((pickle.dumps(own),))
        yield pd.DataFrame(out, columns=["file", "sequence", "content", "violation"])

    return rows.groupBy("file").applyInPandasWithState(step, OUTPUT, "blob binary", "append", GroupStateTimeout.NoTimeout)
