"""Writing containers: samples to progressive, fast-start and fragmented files.

Rules, access units, fragment numbers and the order of the bytes are columns, computed natively; what Python does is to lay
one file's ordered samples out as bytes, in a grouped map. A file is bounded by the container's own limit.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kinotable.functions.codec import longest_nal
from kinotable.functions.timing import TICKS
from kinotable.operators import kernels
from kinotable.operators.payload import annex_b, prefixed
from kinotable.sources.config import nal_units
from kinotable.sources.shared import settled

LAYOUTS = ("progressive", "faststart", "fragmented")
#: Encoded bytes that a fragment may gather before its next key frame.
FRAGMENT_BYTES = 16 << 20
#: Names in the handler boxes.
HANDLER_NAMES = ("Video", "Audio")

#: Sample flags of key and other samples.
KEY_FLAGS, OTHER_FLAGS = 0x02000000, 0x01010000


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind.encode()) + body


def full(kind: str, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def table(kind: str, entries: list[tuple[int, ...]], form: str, version: int = 0) -> bytes:
    """A full box with a count and entries of one form."""
    return full(kind, version, 0, struct.pack(">I", len(entries)), *(struct.pack(f">{form}", *e) for e in entries))


def fixed(value: float) -> int:
    """16.16 fixed point, halves away from zero."""
    return int(abs(value) * 65536 + 0.5) * (1 if value >= 0 else -1)


MATRIX = struct.pack(">9i", fixed(1), 0, 0, 0, fixed(1), 0, 0, 0, 0x40000000)
FTYP = box("ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso6mp41")


def descriptor(tag: int, body: bytes) -> bytes:
    """An MPEG-4 descriptor; lengths are in groups of 7 bits, up to four."""
    groups, left = [len(body) & 127], len(body) >> 7
    while left:
        groups.append(left & 127 | 128)
        left >>= 7
    if len(groups) > 4:
        raise ValueError("descriptor_too_large")
    return bytes([tag, *reversed(groups)]) + body


def video_entry(video: dict) -> bytes:
    sets = {k: nal_units(bytes(video[k]))[0] for k in ("vps", "sps", "pps") if video.get(k) is not None}
    sized = lambda x: struct.pack(">H", len(x)) + x
    if video["codec"] == "H264":
        profile = sets["sps"][1:4] + bytes([66, 0, 30])[len(sets["sps"][1:4]) :]
        config = box("avcC", b"\1", profile, bytes([0xFC | video["nal_length_size"] - 1, 0xE1]), sized(sets["sps"]), b"\1", sized(sets["pps"]))
    else:
        # fixed values: a general profile is declared, whatever the parameter sets say
        head = bytes([1, 1]) + bytes(10) + bytes([120, 0xF0, 0, 0xFC, 0xFD, 0xF8, 0xF8, 0, 0, video["nal_length_size"] - 1, 3])
        config = box("hvcC", head, *(bytes([0x80 | n, 0, 1]) + sized(sets[k]) for n, k in ((32, "vps"), (33, "sps"), (34, "pps"))))
    dpi = fixed(72)
    return box("avc1" if video["codec"] == "H264" else "hvc1", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", video["width"], video["height"], dpi, dpi, 0, 1), bytes(32), struct.pack(">Hh", 24, -1), config)


def audio_entry(audio: dict) -> bytes:
    decoder = descriptor(4, bytes([0x40, 0x15]) + bytes(11) + descriptor(5, bytes(audio["asc"])))
    esds = full("esds", 0, 0, descriptor(3, b"\0\1\0" + decoder + descriptor(6, b"\2")))
    channels = 8 if audio["channel_config"] == 7 else audio["channel_config"]
    # the rate's upper bits are cut off, as the field has 16 of them
    return box("mp4a", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", channels, 16, 0, 0, audio["sample_rate"] << 16 & 0xFFFFFFFF), esds)


def runs(values: list[int]) -> list[tuple[int, int]]:
    return [(sum(1 for _ in same), v) for v, same in groupby(values)]


def sample_table(entry: bytes, samples: list[dict], video: bool, shift: int) -> bytes:
    offsets = [s["offset"] + shift for s in samples]
    wide = max(offsets, default=0) >= 1 << 32
    parts = [
        full("stsd", 0, 0, struct.pack(">I", 1), entry),
        table("stts", runs([s["duration"] for s in samples]), "II"),
        table("stsc", [(1, 1, 1)] if samples else [], "III"),
        full("stsz", 0, 0, struct.pack(f">{len(samples) + 2}I", 0, len(samples), *(s["size"] for s in samples))),
        table("co64" if wide else "stco", [(o,) for o in offsets], "Q" if wide else "I"),
    ]
    keys = [(k,) for k, s in enumerate(samples, 1) if s["is_key"]]
    if video and len(keys) < len(samples):
        parts.append(table("stss", keys, "I"))
    late = [s["pts"] - s["dts"] for s in samples]
    if video and any(late):
        parts.append(table("ctts", runs(late), "Ii", 1))
    return box("stbl", *parts)


def track(number: int, kind: str, config: dict, samples: list[dict], shift: int, names: tuple[str, str]) -> bytes:
    video, duration = kind == "video", end_of(samples)
    entry = video_entry(config) if video else audio_entry(config)
    media_header = full("vmhd", 0, 1, bytes(8)) if video else full("smhd", 0, 0, bytes(4))
    return box(
        "trak",
        full("tkhd", 1, 7, struct.pack(">QQIIQ", 0, 0, number, 0, duration), bytes(8), struct.pack(">hhHH", 0, 0, 0 if video else 0x100, 0), MATRIX, struct.pack(">II", *((config["width"] << 16, config["height"] << 16) if video else (0, 0)))),
        box(
            "mdia",
            full("mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, TICKS, duration, 0x55C4, 0)),
            full("hdlr", 0, 0, struct.pack(">I4s", 0, b"vide" if video else b"soun"), bytes(12), names[not video].encode(), b"\0"),
            box("minf", media_header, box("dinf", full("dref", 0, 0, struct.pack(">I", 1), full("url ", 0, 1))), sample_table(entry, samples, video, shift)),
        ),
    )


def end_of(samples: list[dict]) -> int:
    return max((s["dts"] + s["duration"] for s in samples), default=0)


def movie(tracks: list[tuple[str, dict, list[dict]]], names: tuple[str, str], shift: int = 0, fragmented: bool = False) -> bytes:
    duration = max((end_of(s) for _, _, s in tracks), default=0)
    head = full("mvhd", 1, 0, struct.pack(">QQIQIHH", 0, 0, TICKS, duration, fixed(1), 0x100, 0), bytes(8), MATRIX, bytes(24), struct.pack(">I", 3))
    extends = box("mvex", *(full("trex", 0, 0, struct.pack(">5I", k, 1, 0, 0, 0)) for k in range(1, len(tracks) + 1))) if fragmented else b""
    return box("moov", head, *(track(k, *t, shift, names) for k, t in enumerate(tracks, 1)), extends)


def fragment(sequence: int, tracks: list[tuple[int, list[dict]]]) -> bytes:
    """A moof and its mdat; tracks: (track id, samples with data), those without samples left out."""
    tracks = [t for t in tracks if t[1]]
    size = 24 + sum(64 + 16 * len(s) for _, s in tracks)
    starts = accumulate((sum(x["size"] for x in s) for _, s in tracks), initial=size + 8)
    parts = []
    for (number, samples), start in zip(tracks, starts, strict=False):
        signed = any(s["pts"] < s["dts"] for s in samples)
        rows = [struct.pack(">IIIi" if signed else ">IIII", s["duration"], s["size"], KEY_FLAGS if s["is_key"] else OTHER_FLAGS, s["pts"] - s["dts"]) for s in samples]
        parts.append(box("traf", full("tfhd", 0, 0x020000, struct.pack(">I", number)), full("tfdt", 1, 0, struct.pack(">Q", samples[0]["dts"])), full("trun", int(signed), 0xF01, struct.pack(">Ii", len(rows), start), *rows)))
    return box("moof", full("mfhd", 0, 0, struct.pack(">I", sequence)), *parts) + box("mdat", *(s["data"] for _, t in tracks for s in t))


def header(layout: str, video: dict | None, audio: dict | None, names: tuple[str, str] = HANDLER_NAMES) -> bytes:
    """What stands before the fragments of a fragmented file."""
    return FTYP + movie([("video", video, []), *([("audio", audio, [])] if audio else [])], names, fragmented=True)


def build(layout: str, samples: list[dict], video: dict | None, audio: dict | None, names: tuple[str, str] = HANDLER_NAMES) -> bytes:
    """A file from samples in the order of their bytes: kind, pts, dts, duration, is_key, size, data and, for fragments, fragment_id."""
    if layout == "fragmented":
        out = [header(layout, video, audio, names)]
        for number, group in groupby(samples, key=lambda s: s["fragment_id"]):
            own = list(group)
            out.append(fragment(number, [(1, [s for s in own if s["kind"] == "video"]), (2, [s for s in own if s["kind"] == "audio"])]))
        return b"".join(out)
    at = len(FTYP) + 16  # a data box with a wide size
    for s in samples:
        s["offset"], at = at, at + s["size"]
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + sum(s["size"] for s in samples)) + b"".join(s["data"] for s in samples)
    tracks = [(k, c, own) for k, c in (("video", video), ("audio", audio)) if (own := sorted((s for s in samples if s["kind"] == k), key=lambda s: s["no"]))]
    if layout == "progressive":
        return FTYP + data + movie(tracks, names)
    head = movie(tracks, names)
    for _ in range(8):  # places grow with the header, and wider places with them
        after = movie(tracks, names, len(head))
        if len(after) == len(head):
            return FTYP + after + data
        head = after
    raise ValueError("faststart_layout")


def encode(video_input: DataFrame, audio_input: DataFrame, configs: DataFrame, layout: str = "progressive", max_fragment_bytes: int = FRAGMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Samples in the order of their bytes, and violations(file, code).

    video_input and audio_input: file, submit_no (unique in a file, over both), data, pts_ticks, dts_ticks, duration_ticks, and
    is_key for video. configs: file, video, audio. A video buffer is one NAL unit or Annex B; neighbours of equal times are one
    access unit. Files with a violation have no samples.
    """
    if layout not in LAYOUTS or max_fragment_bytes <= 0:
        raise ValueError(f"unknown layout {layout!r}, or no room for fragments")
    times = [F.col(f"{k}_ticks").cast("bigint").alias(k) for k in ("pts", "dts", "duration")]
    video = video_input.select("file", "submit_no", F.lit("video").alias("kind"), *times, "is_key", annex_b("data").alias("b"))
    audio = audio_input.select("file", "submit_no", F.lit("audio").alias("kind"), *times, F.lit(True).alias("is_key"), "data")
    known = configs.select("file", "video", "audio")
    # rules on what is submitted, per track and (for fragments) over both
    meta = video.select("file", "submit_no", "kind", *("pts", "dts", "duration"), "is_key", F.col("b.violation").alias("bad"), F.exists("b.units", lambda u: F.octet_length(u) == 0).alias("empty"), F.array_max(F.transform("b.units", lambda u: F.octet_length(u))).alias("longest"))
    meta = meta.unionByName(audio.select("file", "submit_no", "kind", "pts", "dts", "duration", "is_key", F.lit(None).cast("string").alias("bad"), (F.coalesce(F.octet_length("data"), F.lit(0)) == 0).alias("empty"), F.lit(0).alias("longest")))
    meta = meta.join(known, "file", "left")
    both = Window.partitionBy("file").orderBy("submit_no")
    one = Window.partitionBy("file", "kind").orderBy("submit_no")
    lag = lambda c, w: F.lag(c).over(w)
    is_video = F.col("kind") == "video"
    same = (F.col("pts") == lag("pts", one)) & (F.col("dts") == lag("dts", one))
    fragmented = F.lit(layout == "fragmented")
    first_video = F.first(F.when(is_video, F.col("is_key")), ignorenulls=True).over(both)
    code = F.coalesce(
        F.when(is_video & F.col("video").isNull() | ~is_video & F.col("audio").isNull(), F.lit("configuration_missing")), F.col("bad"), F.when(F.col("empty"), F.lit("payload_empty")),
        F.when(is_video & (F.col("longest") > longest_nal(F.col("video.nal_length_size"))), F.lit("nal_too_long")), F.when(F.col("pts") < 0, F.lit("pts_negative")), F.when(F.col("dts") < 0, F.lit("dts_negative")),
        F.when(F.col("duration") <= 0, F.lit("duration_not_positive")), F.when(F.col("dts") < lag("dts", one), F.lit("dts_regresses")), F.when(fragmented & (F.col("dts") < lag("dts", both)), F.lit("dts_regresses_across_tracks")),
        F.when(is_video & same & ((F.col("duration") != lag("duration", one)) | (F.col("is_key") != lag("is_key", one))), F.lit("access_unit_disagrees")), F.when(fragmented & F.coalesce(~first_video, F.lit(False)), F.lit("first_video_not_key")),
        F.when(F.col("duration") >= 1 << 32, F.lit("duration_range")), F.when(~(F.col("pts") - F.col("dts")).between(-(1 << 31), (1 << 31) - 1), F.lit("composition_range")),
    )
    wrong = meta.select("file", code.alias("code")).where("code IS NOT NULL")
    counts = known.join(meta.groupBy("file").agg(F.count(F.when(is_video, 1)).alias("v"), F.count("*").alias("all")), "file", "left")
    none = F.when(F.coalesce("all", F.lit(0)) == 0, F.lit("no_samples")).when(fragmented & (F.coalesce("v", F.lit(0)) == 0), F.lit("fragmented_without_video"))
    wrong = wrong.unionByName(counts.select("file", none.alias("code")).where("code IS NOT NULL"))
    # access units
    units = kernels.access_units(video, ["file"], ["submit_no"]).join(known.select("file", F.col("video.nal_length_size").alias("n")), "file")
    units = units.groupBy("file", "kind", "au_no").agg(F.min("submit_no").alias("submit_no"), *(F.min(k).alias(k) for k in ("pts", "dts", "duration")), F.bool_and("is_key").alias("is_key"), F.min("n").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("submit_no", "b.units"))), lambda x: x["units"])).alias("units"))
    samples = units.select("file", "submit_no", "kind", "pts", "dts", "duration", "is_key", prefixed(F.col("units"), F.col("n")).alias("data")).unionByName(audio)
    samples = samples.withColumns({"size": F.octet_length("data").cast("bigint"), "no": F.row_number().over(Window.partitionBy("file", "kind").orderBy("submit_no"))})
    if layout == "fragmented":
        samples = kernels.fragments(samples, ["file"], "dts", (F.col("kind") == "video") & F.col("is_key"), ["submit_no"])
        rank = F.when(F.col("kind") == "video", 0).otherwise(1)
        samples = samples.withColumn("physical_no", F.row_number().over(Window.partitionBy("file").orderBy("fragment_id", rank, "no")))
        # units are counted when they come; a fragment's last rows are with what waits for the next one
        large = samples.groupBy("file", "fragment_id").agg(F.sum("size").alias("b")).where(F.col("b") > max_fragment_bytes)
        wrong = wrong.unionByName(large.select("file", F.lit("fragment_too_large").alias("code")))
    else:
        samples = kernels.physical_order(samples, ["file"], "submit_no", F.col("kind")).withColumn("fragment_id", F.lit(None).cast("bigint"))
    # written once, so that the rules' plan isn't part of that of the samples
    wrong = settled(wrong.distinct())
    return samples.join(wrong.select("file").distinct(), "file", "left_anti"), wrong


_FILE = T.StructType([T.StructField("file", T.StringType()), T.StructField("content", T.BinaryType())])


def _builder(layout: str, names: tuple[str, str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        samples = rows.sort_values("physical_no").drop(columns=["video", "audio"]).to_dict("records")
        first = rows.iloc[0]
        return pd.DataFrame({"file": [first["file"]], "content": [build(layout, samples, first["video"], first["audio"], names)]})

    return run


def mux(video_input: DataFrame, audio_input: DataFrame, configs: DataFrame, layout: str = "progressive", max_fragment_bytes: int = FRAGMENT_BYTES, names: tuple[str, str] = HANDLER_NAMES) -> tuple[DataFrame, DataFrame]:
    """(file, content) of each file without violation, and violations(file, code); inputs as for encode()."""
    samples, wrong = encode(video_input, audio_input, configs, layout, max_fragment_bytes)
    rows = samples.join(configs.select("file", "video", "audio"), "file")
    return rows.groupBy("file").applyInPandas(_builder(layout, names), _FILE), wrong
