"""Queries that write containers from the driver's tables and read them back, with the SQL of the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from kinotable.functions.binary import unsigned
from kinotable.operators import payload
from kinotable.plans.tables import SAMPLES, table
from kinotable.sources import boxes, datasource, media, mux
from kinotable.sources.shared import settled, shared_folder
from kinotable.streaming.fragmenter import INPUT, fragment_stream

_VIDEO = "named_struct('codec', 'H264', 'vps', cast(null AS binary), 'sps', X'6742001E', 'pps', X'68CE06E2', 'nal_length_size', 4, 'width', 16, 'height', 16)"
_H265 = "named_struct('codec', 'H265', 'vps', X'4001', 'sps', X'4201', 'pps', X'4401', 'nal_length_size', 4, 'width', 16, 'height', 16)"
_CODECS = {
    "H264": {"codec": "H264", "vps": None, "sps": b"\x67\x42\x00\x1e", "pps": b"\x68\xce\x06\xe2", "nal_length_size": 4, "width": 16, "height": 16},
    "AAC": {"asc": b"\x12\x10", "sample_rate": 44100, "channel_config": 2, "object_type": 2},
}
_AUDIO = "named_struct('asc', X'1210', 'sample_rate', 44100, 'channel_config', 2, 'object_type', 2)"
#: Ticks of a unit of the samples' durations.
UNIT = 1000


def inputs(spark: SparkSession, sf_dir: str, h265: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events as what is submitted to a writer: a file for each user, view and click as video (view as key frames), others as audio; times run on over all events of a user, from the first view on. h265: with H.265 video in Annex B of two NAL units a sample, shown a unit earlier or later than decoded."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("submit_no"), F.col("event_type").isin("view", "click").alias("video"), (F.col("event_type") == "view").alias("is_key"), (F.col("event_id") % 7 + 1).alias("n"), "event_type", F.floor(F.col("value") * 100).cast("bigint").alias("v"))
    w = Window.partitionBy("file").orderBy("submit_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("seen", F.max(F.when(F.col("is_key"), 1).otherwise(0)).over(w)).where("seen = 1")
    dts = (F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * UNIT).alias("dts_ticks")
    text = F.encode(F.concat("event_type", F.col("v").cast("string")), "UTF-8")
    if h265:
        unit = F.concat(F.lit(b"\0\0\0\1"), F.when(F.col("is_key"), F.lit(b"\x26\1")).otherwise(F.lit(b"\x02\1")), text, F.lit(b"\0\0\1\x4e\1x"))
        data = F.when(F.col("video"), unit).otherwise(F.concat(F.lit(b"\x21"), text)).alias("data")
    else:
        data = F.concat(F.when(F.col("is_key"), F.lit(b"\x65")).when(F.col("video"), F.lit(b"\x41")).otherwise(F.lit(b"\x21")), text).alias("data")
    rows = rows.select("file", "submit_no", "video", "is_key", data, dts, (F.col("n") * UNIT).alias("duration_ticks"))
    shift = F.when(F.col("video"), F.greatest(-F.col("dts_ticks"), (F.col("submit_no") % 3 - 1) * UNIT)).otherwise(0) if h265 else F.lit(0)
    rows = settled(rows.withColumn("pts_ticks", F.col("dts_ticks") + shift))
    configs = rows.select("file").distinct().select("file", F.expr(_H265 if h265 else _VIDEO).alias("video"), F.expr(_AUDIO).alias("audio"))
    return rows.where("video").drop("video"), rows.where("NOT video").drop("video", "is_key"), configs


def _files(spark: SparkSession, sf_dir: str, layout: str, h265: bool = False) -> DataFrame:
    """The written files, put down once, as both the scan and the payloads read them."""
    return settled(mux.mux(*inputs(spark, sf_dir, h265), layout)[0])


def _samples(layout: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = media.decode(boxes.scan(_files(spark, sf_dir, layout)))
        return found.samples.select(F.col("file").cast("bigint").alias("file"), "kind", "sample_no", "size", "dts", "duration", "is_key")

    return run


def _h265(layout: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = media.decode(boxes.scan(_files(spark, sf_dir, layout, h265=True)))
        return found.samples.select(F.col("file").cast("bigint").alias("file"), "kind", "sample_no", "size", "dts", "pts", "duration", "is_key")

    return run


def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that files break: every fifth file is left as it is, the others are cut by a byte, lose their moov, have half a box header more, or two moov boxes."""
    kind, c = F.col("file").cast("bigint") % 5, F.col("content")
    moov = F.substring(c, 29, 0x7FFFFFFF)  # behind ftyp, in files that start fast
    moov = F.substring(moov, F.lit(1), unsigned(c, 28, 4).cast("int"))
    wrong = F.when(kind == 1, F.substring(c, F.lit(1), F.octet_length(c) - 1)).when(kind == 2, F.overlay(c, F.lit(b"free"), 33, 4)).when(kind == 3, F.concat(c, F.lit(b"\0\0\0\x08"))).when(kind == 4, F.concat(c, moov)).otherwise(c)
    found = media.decode(boxes.scan(_files(spark, sf_dir, "faststart").select("file", wrong.alias("content"))))
    return found.violations.select(F.col("file").cast("bigint").alias("file"), "code")


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of files that the data source has written to a folder, read from there."""
    datasource.register(spark)
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _files(spark, sf_dir, "progressive").select("file", "content").write.format("mp4").mode("append").save(folder)
    found = media.read(spark, f"{folder}/*.mp4")
    return found.samples.select(F.regexp_extract("file", r"(\d+)\.mp4$", 1).cast("bigint").alias("file"), "kind", "sample_no", "size", "dts", "duration", "is_key")


def stream_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of files that a stream has written fragment by fragment."""
    video, audio, _ = inputs(spark, sf_dir)
    rows = video.withColumn("kind", F.lit("video")).unionByName(audio.withColumns({"kind": F.lit("audio"), "is_key": F.lit(False)}))
    ends = rows.groupBy("file").agg((F.max("submit_no") + 1).alias("submit_no")).withColumn("kind", F.lit("end"))
    schema = StructType.fromDDL(INPUT)
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows.unionByName(ends, allowMissingColumns=True).select(*(F.col(f.name).cast(f.dataType) for f in schema)).write.parquet(f"{folder}/in")
    out = fragment_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), _CODECS["H264"], _CODECS["AAC"])
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    parts = F.array_sort(F.collect_list(F.struct("sequence", "content")))
    whole = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["content"]))
    files = settled(spark.read.parquet(f"{folder}/out").where("violation IS NULL").groupBy("file").agg(whole.alias("content")))
    found = media.decode(boxes.scan(files))
    return found.samples.select(F.col("file").cast("bigint").alias("file"), "kind", "sample_no", "size", "dts", "duration", "is_key")


def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, key frames, duration and bytes of each track of written and read files."""
    rows = _samples("progressive")(spark, sf_dir)
    return rows.groupBy("file", "kind").agg(F.count("*").alias("samples"), F.count(F.when(F.col("is_key"), 1)).alias("key_samples"), F.sum("duration").alias("duration"), F.sum("size").alias("bytes"))


def nal_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline of written and read fragmented files."""
    files = _files(spark, sf_dir, "fragmented")
    found = payload.timeline(media.decode(boxes.scan(files)), files)
    return found.select(F.col("file").cast("bigint").alias("file"), "delivery_no", "kind", F.decode(F.substring("data", 2, 1000), "UTF-8").alias("text"), "dts_ticks", "duration_ticks")


def box_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level boxes of fragmented files."""
    found = boxes.scan(_files(spark, sf_dir, "fragmented")).where("depth = 0 AND type IN ('moof', 'mdat')")
    return found.groupBy(F.col("file").cast("bigint").alias("file"), "type").agg(F.count("*").alias("boxes"), F.sum("size").alias("bytes"))


def box_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track fragments and headers in the movie fragments of each file, by selecting children, firsts and only ones."""
    found = settled(boxes.scan(_files(spark, sf_dir, "fragmented")))
    moofs = boxes.of_type(found, "moof")
    inside = boxes.children_of(found, moofs)
    only, wrong = boxes.exactly_one(found, moofs, "mfhd")
    parts = [inside.select("file", F.col("type").alias("what")), boxes.first_of(inside, "traf").select("file", F.lit("first traf").alias("what")), only.select("file", F.lit("only mfhd").alias("what")), wrong.select("file", F.col("code").alias("what"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.groupBy(F.col("file").cast("bigint").alias("file"), "what").agg(F.count("*").alias("n"))


_IN = f"""{SAMPLES},
seen AS (SELECT *, max(is_key::INT) OVER (PARTITION BY file ORDER BY sample_id ROWS UNBOUNDED PRECEDING) AS s FROM samples),
put AS (SELECT file, sample_id, kind, is_key, event_type || (size - 1)::VARCHAR AS text, duration * {UNIT} AS duration, ((coalesce(sum(duration) OVER (PARTITION BY file ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * {UNIT})::BIGINT AS put_at FROM seen WHERE s = 1),
sized AS (SELECT *, strlen(text) + 1 + CASE kind WHEN 'video' THEN 4 ELSE 0 END AS size, row_number() OVER (PARTITION BY file, kind ORDER BY sample_id)::INTEGER AS sample_no FROM put),
frag AS (SELECT *, sum((is_key)::INT) OVER (PARTITION BY file ORDER BY sample_id) AS f FROM sized),
placed AS (SELECT *, (min(put_at) OVER (PARTITION BY file, kind, f) + coalesce(sum(duration) OVER (PARTITION BY file, kind, f ORDER BY sample_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS dts FROM frag)"""

_CONTIGUOUS = "(coalesce(sum(duration) OVER (PARTITION BY file, kind ORDER BY sample_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS dts"
_PROGRESSIVE = f"WITH {_IN} SELECT file, kind, sample_no, size, {_CONTIGUOUS}, duration, kind = 'audio' OR is_key AS is_key FROM sized"

_FRAGMENTED = f"WITH {_IN} SELECT file, kind, sample_no, size, dts, duration, kind = 'audio' OR is_key AS is_key FROM placed"
#: Two NAL units with a header of two bytes and a length of four, the second with one byte more.
_H265_SIZE = "(size + CASE kind WHEN 'video' THEN 8 ELSE 0 END)::BIGINT AS size"
_PTS = f"(dts + CASE kind WHEN 'video' THEN greatest(-put_at, (sample_id % 3 - 1) * {UNIT}) ELSE 0 END)::BIGINT AS pts"

SQL = {
    "h265_progressive": f"WITH {_IN}, timed AS (SELECT *, {_CONTIGUOUS} FROM sized) SELECT file, kind, sample_no, {_H265_SIZE}, dts, {_PTS}, duration, kind = 'audio' OR is_key AS is_key FROM timed",
    "h265_fragmented": f"WITH {_IN} SELECT file, kind, sample_no, {_H265_SIZE}, dts, {_PTS}, duration, kind = 'audio' OR is_key AS is_key FROM placed",
    "broken_files": f"""WITH {_IN} SELECT file, code FROM (SELECT DISTINCT file FROM sized) JOIN (VALUES (1, 'box_exceeds_parent'), (2, 'moov_missing'), (3, 'box_header_incomplete'), (4, 'moov_repeated')) v(k, code) ON file % 5 = k
UNION ALL SELECT DISTINCT file, kind || '_tracks' FROM sized WHERE file % 5 = 4""",
    "stored_files": _PROGRESSIVE,
    "stream_fragments": _FRAGMENTED,
    "mux_demux_progressive": _PROGRESSIVE,
    "mux_demux_faststart": _PROGRESSIVE,
    "mux_demux_fragmented": _FRAGMENTED,
    "track_summary": f"WITH {_IN} SELECT file, kind, count(*)::BIGINT AS samples, count(*) FILTER (kind = 'audio' OR is_key)::BIGINT AS key_samples, sum(duration)::BIGINT AS duration, sum(size)::BIGINT AS bytes FROM sized GROUP BY file, kind",
    "nal_delivery": f"WITH {_IN} SELECT file, row_number() OVER (PARTITION BY file ORDER BY dts, kind DESC, sample_no)::INTEGER AS delivery_no, kind, text, dts AS dts_ticks, duration AS duration_ticks FROM placed",
    "box_children": f"""WITH {_IN}, m AS (SELECT file, f, count(DISTINCT kind) AS tracks FROM frag GROUP BY file, f)
SELECT file, 'traf' AS what, sum(tracks)::BIGINT AS n FROM m GROUP BY file UNION ALL SELECT file, unnest(['mfhd', 'first traf', 'only mfhd']), count(*) FROM m GROUP BY file""",
    "box_layout": f"""WITH {_IN}, m AS (SELECT file, f, sum(size) + 8 AS mdat, 24 + 64 * count(DISTINCT kind) + 16 * count(*) AS moof FROM frag GROUP BY file, f)
SELECT file, 'mdat' AS type, count(*)::BIGINT AS boxes, sum(mdat)::BIGINT AS bytes FROM m GROUP BY file UNION ALL SELECT file, 'moof', count(*), sum(moof)::BIGINT FROM m GROUP BY file""",
}

QUERIES = {
    "mux_demux_progressive": _samples("progressive"), "mux_demux_faststart": _samples("faststart"), "mux_demux_fragmented": _samples("fragmented"),
    "track_summary": track_summary, "nal_delivery": nal_delivery, "box_layout": box_layout, "box_children": box_children,
    "h265_progressive": _h265("progressive"), "h265_fragmented": _h265("fragmented"), "broken_files": broken_files, "stored_files": stored_files, "stream_fragments": stream_fragments,
}
