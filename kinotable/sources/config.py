"""Codec configurations from sample descriptions: walks of variable-length records, as one Arrow function over small payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinotable.functions.codec import PARAMETER_SETS, RATES
from kinotable.sources.boxes import Malformed, children

MAX_DEPTH, MAX_DESCRIPTORS = 32, 4096

VIDEO = T.StructType(
    [T.StructField("codec", T.StringType()), *(T.StructField(k, T.BinaryType()) for k in ("vps", "sps", "pps")), *(T.StructField(k, T.IntegerType()) for k in ("nal_length_size", "width", "height"))]
)
AUDIO = T.StructType([T.StructField("asc", T.BinaryType()), *(T.StructField(k, T.IntegerType()) for k in ("sample_rate", "channel_config", "object_type"))])
SCHEMA = T.StructType([T.StructField("video", VIDEO), T.StructField("audio", AUDIO), T.StructField("violation", T.StringType())])


def _need(data: memoryview, at: int, size: int, code: str) -> memoryview:
    if at + size > len(data):
        raise Malformed(code)
    return data[at : at + size]


def _sized(data: memoryview, at: int, code: str) -> tuple[bytes, int]:
    """A record behind its 16-bit length, and where it ends."""
    size = int.from_bytes(_need(data, at, 2, code))
    return bytes(_need(data, at + 2, size, code)), at + 2 + size


def nal_units(data: bytes) -> list[bytes]:
    """NAL units of raw or Annex B data: only a start code at byte 0 makes it Annex B."""
    raw = data[:3] != b"\0\0\1" and data[:4] != b"\0\0\0\1"
    if raw:
        return [data]
    out, at = [], 3 if data[2] == 1 else 4
    while True:
        code = data.find(b"\0\0\1", at)
        end = len(data) if code < 0 else code - 1 if code > at and data[code - 1] == 0 else code
        if end <= at:
            raise Malformed("nal_empty")
        out.append(data[at:end])
        if code < 0:
            return out
        at = code + 3


def check_video(codec: str, sets: dict[str, bytes | None], length_size: int, width: int, height: int) -> None:
    """Raises the first broken rule of a video configuration."""
    if not 1 <= length_size <= 4:
        raise Malformed("config_length_size")
    if not (width == height == 0 or 0 < width < 1 << 16 and 0 < height < 1 << 16):
        raise Malformed("config_dimensions")
    for name, kind in PARAMETER_SETS[codec].items():
        data = sets.get(name)
        units = nal_units(data) if data else []
        if len(units) != 1 or len(units[0]) < (2 if codec == "H265" else 1) or (units[0][0] & 31 if codec == "H264" else units[0][0] >> 1 & 63) != kind:
            raise Malformed(f"config_{name}")


def _avc(box: memoryview) -> tuple[dict[str, bytes], int]:
    _need(box, 0, 7, "avcC_truncated")
    sets, at = [], 6
    if not box[5] & 31:
        raise Malformed("avcC_no_sps")
    for _ in range(box[5] & 31):
        sps, at = _sized(box, at, "avcC_truncated")
        sets.append(sps)
    if at >= len(box) or not box[at]:
        raise Malformed("avcC_no_pps")
    return {"sps": sets[0], "pps": _sized(box, at + 1, "avcC_truncated")[0]}, (box[4] & 3) + 1


def _hevc(box: memoryview) -> tuple[dict[str, bytes], int]:
    _need(box, 0, 23, "hvcC_truncated")
    sets: dict[str, bytes] = {}
    names, at = {v: k for k, v in PARAMETER_SETS["H265"].items()}, 23
    for _ in range(box[22]):
        head = _need(box, at, 3, "hvcC_truncated")
        at += 3
        for _ in range(int.from_bytes(head[1:3])):
            nal, at = _sized(box, at, "hvcC_truncated")
            if head[0] & 63 in names:
                sets.setdefault(names[head[0] & 63], nal)
    if len(sets) < 3:
        raise Malformed("hvcC_parameter_sets")
    return sets, (box[21] & 3) + 1


def _descriptor(data: memoryview, depth: int, count: list[int]) -> bytes | None:
    """Payload of the first decoder-specific descriptor."""
    if depth > MAX_DEPTH:
        raise Malformed("descriptor_depth")
    at = 0
    while at < len(data):
        count[0] += 1
        if count[0] > MAX_DESCRIPTORS:
            raise Malformed("descriptor_count")
        if at + 2 > len(data):
            raise Malformed("descriptor_header")
        tag, size, at = data[at], 0, at + 1
        for k in range(4):
            byte = _need(data, at, 1, "descriptor_length")[0]
            size, at = size << 7 | byte & 127, at + 1
            if byte < 128:
                break
            if k == 3:
                raise Malformed("descriptor_length")
        own = _need(data, at, size, "descriptor_exceeds_parent")
        if tag == 5:
            return bytes(own)
        skip = {3: 3, 4: 13}.get(tag, 0)
        inner = own[skip:] if size >= skip else own
        if len(inner) and (found := _descriptor(inner, depth + 1, count)) is not None:
            return found
        at += size
    return None


def parse_asc(asc: bytes) -> tuple[int, int, int]:
    """(object type, sample rate, channel configuration) of an AudioSpecificConfig."""
    if len(asc) < 2:
        raise Malformed("asc_malformed")
    bits, at = "".join(f"{b:08b}" for b in asc), 0

    def take(n: int) -> int:
        nonlocal at
        if at + n > len(bits):
            raise Malformed("asc_malformed")
        at += n
        return int(bits[at - n : at], 2)

    kind = take(5)
    kind = 32 + take(6) if kind == 31 else kind
    index = take(4)
    rate = take(24) if index == 15 else RATES[index] if index < len(RATES) else 0
    channels = take(4)
    if not 1 <= kind <= 31 or rate <= 0 or not 1 <= channels <= 7:
        raise Malformed("asc_malformed")
    return kind, rate, channels


def _only(boxes: list[tuple[int, int, int, str]], kind: str) -> tuple[int, int, int, str]:
    own = [b for b in boxes if b[3] == kind]
    if len(own) != 1:
        raise Malformed(f"{kind}_missing" if not own else f"{kind}_repeated")
    return own[0]


def parse(stsd: bytes, handler: str) -> tuple[dict | None, dict | None]:
    """(video, audio) configuration of a sample description, one of them None."""
    data = memoryview(stsd)
    if int.from_bytes(_need(data, 0, 8, "stsd_truncated")[4:8]) != 1:
        raise Malformed("stsd_entries")
    entries = list(children(data, 8, len(data)))
    if len(entries) != 1:
        raise Malformed("stsd_entries")
    start, size, header, kind = entries[0]
    entry = data[start + header : start + size]
    if handler == "vide":
        if kind not in ("avc1", "hvc1"):
            raise Malformed("video_entry_unsupported")
        _need(entry, 0, 78, "video_entry_truncated")
        width, height = int.from_bytes(entry[24:26]), int.from_bytes(entry[26:28])
        s, n, h, _ = _only(list(children(entry, 78, len(entry))), "avcC" if kind == "avc1" else "hvcC")
        sets, length_size = (_avc if kind == "avc1" else _hevc)(entry[s + h : s + n])
        codec = "H264" if kind == "avc1" else "H265"
        check_video(codec, sets, length_size, width, height)
        return {"codec": codec, "vps": sets.get("vps"), "sps": sets["sps"], "pps": sets["pps"], "nal_length_size": length_size, "width": width, "height": height}, None
    if kind != "mp4a":
        raise Malformed("audio_entry_unsupported")
    _need(entry, 0, 28, "audio_entry_truncated")
    s, n, h, _ = _only(list(children(entry, 28, len(entry))), "esds")
    box = entry[s + h : s + n]
    _need(box, 0, 5, "esds_truncated")
    asc = _descriptor(box[4:], 0, [0])
    if asc is None:
        raise Malformed("esds_no_config")
    kind_, rate, channels = parse_asc(asc)
    return None, {"asc": asc, "sample_rate": rate, "channel_config": channels, "object_type": kind_}


@F.pandas_udf(SCHEMA)
def parse_stsd(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for payloads, handlers in rows:
        out = []
        for payload, handler in zip(payloads, handlers, strict=True):
            try:
                out.append((*parse(payload, handler), None) if payload is not None and handler in ("vide", "soun") else (None, None, None))
            except Malformed as broken:
                out.append((None, None, str(broken)))
        yield pd.DataFrame(out, columns=["video", "audio", "violation"])
