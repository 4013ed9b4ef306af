"""Payloads of samples: NAL units, audio units, and both on one timeline.

Metadata stays apart from file contents until here. A sample's bytes are cut in the JVM; Python sees a sample only to find
the places of its NAL units, and gives back places alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinotable.functions import timing
from kinotable.functions.binary import piece, to_bytes
from kinotable.functions.codec import longest_nal
from kinotable.operators import kernels
from kinotable.sources.boxes import Malformed
from kinotable.sources.config import nal_units as _annex_b
from kinotable.sources.media import Media

_PLACES = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("size", T.LongType()), T.StructField("violation", T.StringType())]))


def _places(data: bytes, length_size: int) -> list[tuple[int, int, str | None]]:
    out, at = [], 0
    while at < len(data):
        if at + length_size > len(data):
            return [*out, (at, 0, "nal_length_cut")]
        size = int.from_bytes(data[at : at + length_size])
        at += length_size
        if not 0 < size <= len(data) - at:
            return [*out, (at, 0, "nal_exceeds_sample")]
        out.append((at, size, None))
        at += size
    return out


@F.pandas_udf(_PLACES)
def nal_places(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Places of the length-prefixed NAL units of samples; the last one has what is broken, if anything is."""
    for samples, sizes in rows:
        yield pd.Series([[dict(zip(("at", "size", "violation"), p, strict=True)) for p in _places(bytes(d), int(n))] for d, n in zip(samples, sizes, strict=True)])


_UNITS = T.StructType([T.StructField("units", T.ArrayType(T.BinaryType())), T.StructField("violation", T.StringType())])


@F.pandas_udf(_UNITS)
def annex_b(rows: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """NAL units of raw or Annex B buffers, or what is broken."""
    for buffers in rows:
        out = []
        for data in buffers:
            try:
                out.append((_annex_b(bytes(data)), None))
            except Malformed as broken:
                out.append((None, str(broken)))
        yield pd.DataFrame(out, columns=["units", "violation"])


def prefixed(units: Column, length_size: Column) -> Column:
    """NAL units (an array) as one sample, each behind its length; null if one is empty or too long for it."""
    whole = F.aggregate(units, F.lit(b"").cast("binary"), lambda acc, u: F.concat(acc, F.substring(to_bytes(F.octet_length(u), 4), (5 - length_size).cast("int"), F.lit(4)), u))
    return F.when(F.forall(units, lambda u: F.octet_length(u).between(1, longest_nal(length_size))), whole)


def _with_bytes(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Samples with column data. The samples are the small side: they are hashed, so that contents are neither sorted nor held."""
    return files.select("file", "content").join(samples.hint("shuffle_hash"), "file").withColumn("data", piece("content", F.col("offset"), F.col("size"))).drop("content")


def _ticks() -> dict[str, Column]:
    return {f"{k}_ticks": timing.rounded(k, "timescale") for k in ("pts", "dts", "duration")}


def _checked(df: DataFrame, mode: str) -> DataFrame:
    """Rows with a violation are an error when they are reached (failfast), or go."""
    if mode == "failfast":
        return df.where(F.when(F.col("violation").isNotNull(), F.raise_error(F.col("violation")).cast("boolean")).otherwise(True)).drop("violation")
    return df.where("violation IS NULL").drop("violation")


def _late_rules() -> Column:
    """What a decoded sample must hold when it is delivered."""
    return F.when(F.col("pts") < 0, F.lit("sample_pts_negative")).when(F.col("duration") <= 0, F.lit("sample_duration"))


def nal_units(media: Media, files: DataFrame, mode: str = "permissive") -> DataFrame:
    """file, track_id, sample_no, nal_no, data, pts_ticks, dts_ticks, duration_ticks, is_key of each video NAL unit, in decode order by sample_no and nal_no. Broken framing shows only here: earlier units of the sample are delivered."""
    video = media.samples.where("kind = 'video'").join(media.tracks.where("kind = 'video'").select("file", F.col("video.nal_length_size").alias("n")), "file")
    rows = _with_bytes(video, files).select("*", F.posexplode(nal_places("data", "n")).alias("k", "p"))
    rows = rows.withColumns({"nal_no": F.col("k") + 1, "violation": F.coalesce("p.violation", _late_rules()), "data": piece("data", F.col("p.at"), F.col("p.size")), **_ticks()})
    return _checked(rows, mode).select("file", "track_id", "sample_no", "nal_no", "data", "pts_ticks", "dts_ticks", "duration_ticks", "is_key")


def audio_samples(media: Media, files: DataFrame, mode: str = "permissive") -> DataFrame:
    """file, track_id, sample_no, data, pts_ticks, dts_ticks, duration_ticks of each audio unit, in decode order by sample_no."""
    rows = _with_bytes(media.samples.where("kind = 'audio'"), files)
    rows = rows.withColumns({"violation": F.coalesce(F.when(F.col("size") <= 0, F.lit("sample_empty")), _late_rules()), **_ticks()})
    return _checked(rows, mode).select("file", "track_id", "sample_no", "data", "pts_ticks", "dts_ticks", "duration_ticks")


def timeline(media: Media, files: DataFrame, mode: str = "permissive") -> DataFrame:
    """NAL units and audio units of each file in delivery order (delivery_no from 1): by exact decode time, video first at equal times, with the track's configuration."""
    samples = media.samples.select("file", "track_id", "sample_no", "dts", "timescale")
    video = nal_units(media, files, mode).withColumn("kind", F.lit("video"))
    audio = audio_samples(media, files, mode).withColumns({"kind": F.lit("audio"), "nal_no": F.lit(1), "is_key": F.lit(None).cast("boolean")})
    both = video.unionByName(audio).join(samples, ["file", "track_id", "sample_no"])
    merged = kernels.merge_tracks(both, ["file"], "kind", "dts", "timescale", ["sample_no", "nal_no"])
    return merged.join(media.tracks.select("file", "track_id", "video", "audio"), ["file", "track_id"]).select(
        "file", "delivery_no", "kind", "track_id", "sample_no", "nal_no", "data", "pts_ticks", "dts_ticks", "duration_ticks", "is_key", "video", "audio"
    )


def deliver(ordered: DataFrame, handler) -> None:
    """Calls handler(row) for each row of a timeline, in order within a file, on the executors; its errors end the job."""
    ordered.repartition("file").sortWithinPartitions("file", "delivery_no").foreach(handler)
