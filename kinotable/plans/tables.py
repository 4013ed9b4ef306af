"""Queries of the kernels over the driver's tables, each with the DuckDB SQL of the same rows.

A user of `events` stands for a file, its event type for the kind of track, `view` events for key frames, and the event's
value for a size; event_id orders the rows in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinotable.functions import binary, timing
from kinotable.operators import kernels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples: file, sample_id, kind, is_key, size, duration."""
    size = (F.floor(F.col("value") * 100).cast("bigint") + 1).alias("size")
    kind = F.when(F.col("event_type").isin("view", "click"), "video").otherwise("audio").alias("kind")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"), F.col("event_id").alias("sample_id"), kind, (F.col("event_type") == "view").alias("is_key"), size, (F.col("event_id") % 7 + 1).alias("duration"), "event_type"
    )


SAMPLES = """samples AS (SELECT user_id AS file, event_id AS sample_id, CASE WHEN event_type IN ('view', 'click') THEN 'video' ELSE 'audio' END AS kind,
  event_type = 'view' AS is_key, floor(value * 100)::BIGINT + 1 AS size, event_id % 7 + 1 AS duration, event_type FROM events)"""


def dts_prefix_sum(spark, sf_dir):
    return kernels.exclusive_sum(samples(spark, sf_dir), ["file"], ["sample_id"], "duration", "dts").select("file", "sample_id", "dts")


def chunk_offsets(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("chunk", F.floor(F.col("sample_id") / 4).cast("bigint"))
    return kernels.exclusive_sum(rows, ["file", "chunk"], ["sample_id"], "size", "chunk_offset").select("file", "sample_id", "chunk_offset")


def asof_chunk_map(spark, sf_dir):
    rows = samples(spark, sf_dir)
    runs = rows.where("is_key").select("file", F.col("sample_id").alias("first"), F.col("size").alias("run_size"), F.col("sample_id").alias("run_id"))
    return kernels.as_of(rows, runs, ["file"], "sample_id", "first", ["run_size", "run_id"]).select("file", "sample_id", "run_size", "run_id")


def rle_encode(spark, sf_dir):
    return kernels.run_lengths(samples(spark, sf_dir), ["file"], ["sample_id"], "kind").select("file", "run_no", "run_length", "kind")


def rle_expand(spark, sf_dir):
    return kernels.expand_runs(rle_encode(spark, sf_dir), "run_length", "in_run").select("file", "run_no", "in_run", "kind")


def sync_mark(spark, sf_dir):
    rows = samples(spark, sf_dir)
    listed = rows.where("is_key AND file % 3 <> 0").select("file", "sample_id")
    return kernels.sync_mark(rows, listed, ["file"], "sample_id", "is_sync").select("file", "sample_id", "is_sync")


def default_precedence(spark, sf_dir):
    """lineitem rows as samples with some values left out; row-wise, so repeated keys don't matter."""
    q, n = F.col("l_quantity").cast("bigint"), F.col("l_linenumber").cast("bigint")
    some = lambda m, v: F.when(F.col("l_orderkey") % m == 0, v)
    value = kernels.resolve(some(2, q), some(3, n), F.col("l_suppkey") % 4)
    flags = kernels.resolve_flags(some(5, q * 65536), some(2, n * 65536), n - 1, some(7, F.lit(65536).cast("bigint")), F.lit(0).cast("bigint"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", value.alias("value"), flags.alias("flags"), kernels.is_key(flags).alias("is_key"))


def range_overlap(spark, sf_dir):
    rows = samples(spark, sf_dir).select("file", "sample_id", (F.col("sample_id") * 5000).alias("start"), (F.col("sample_id") * 5000 + F.col("size") * 30).alias("end"))
    return kernels.overlaps(rows, ["file"], "start", "end", ["sample_id"]).select("file", "sample_id", "start", "prior_end")


def monotonic_check(spark, sf_dir):
    return kernels.regressions(samples(spark, sf_dir), ["file"], ["sample_id"], "size", strict=True).select("file", "sample_id", "size", "prior_value")


def _timed(spark, sf_dir):
    rows = kernels.exclusive_sum(samples(spark, sf_dir), ["file", "kind"], ["sample_id"], "duration", "dts")
    return rows.withColumn("timescale", F.when(F.col("kind") == "video", 25).otherwise(30))


def track_merge(spark, sf_dir):
    return kernels.merge_tracks(_timed(spark, sf_dir), ["file"], "kind", "dts", "timescale", ["sample_id"]).select("file", "sample_id", "delivery_no")


def conversation_merge(spark, sf_dir):
    """Turns as samples of two tracks; repeated turns are told apart by role and text length."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "video").otherwise("audio").alias("kind"), F.length("text").alias("size"), F.floor(F.col("turn") / 2).cast("bigint").alias("dts"), F.lit(1).alias("timescale"))
    return kernels.merge_tracks(rows, ["conv_id"], "kind", "dts", "timescale", ["turn", "size"]).select("conv_id", "turn", "kind", "delivery_no")


def access_units(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("dts", F.floor(F.col("sample_id") / 500).cast("bigint"))
    units = kernels.access_units(rows, ["file"], ["sample_id"], "dts", "dts")
    return units.groupBy("file", "au_no").agg(F.count("*").alias("nals"), F.sum("size").alias("size"), F.min("sample_id").alias("first_id"))


def _fragmented(spark, sf_dir):
    rows = kernels.exclusive_sum(samples(spark, sf_dir), ["file"], ["sample_id"], "duration", "running").withColumn("dts", F.floor(F.col("running") / 9).cast("bigint"))
    return kernels.fragments(rows, ["file"], "dts", F.col("is_key"), ["sample_id"])


def gop_segment(spark, sf_dir):
    return _fragmented(spark, sf_dir).select("file", "sample_id", "dts", "fragment_id")


def physical_order(spark, sf_dir):
    return kernels.physical_order(samples(spark, sf_dir), ["file"], "sample_id", F.col("kind")).select("file", "sample_id", "physical_no")


def fragment_layout(spark, sf_dir):
    """Place of each sample in its fragment's data, video first, and the fragment's header size."""
    rows = _fragmented(spark, sf_dir).withColumn("rank", F.when(F.col("kind") == "video", 0).otherwise(1))
    rows = kernels.exclusive_sum(rows, ["file", "fragment_id"], ["rank", "dts", "sample_id"], "size", "data_offset")
    sizes = rows.groupBy("file", "fragment_id").agg((24 + 64 * F.countDistinct("rank") + 16 * F.count("*")).alias("moof_size"))
    return rows.join(sizes, ["file", "fragment_id"]).select("file", "sample_id", "fragment_id", "moof_size", (F.col("data_offset") + F.col("moof_size") + 8).alias("data_offset"))


def track_duration(spark, sf_dir):
    return kernels.track_duration(_timed(spark, sf_dir), ["file", "kind"], "dts", "duration")


def rescale_time(spark, sf_dir):
    rows = samples(spark, sf_dir)
    out = [timing.rounded(F.col("size") - 500, F.lit(t)).alias(f"ticks_{t}") for t in (1000, 44100, 90000, 10_000_000)]
    return rows.select("sample_id", *out)


def box_roundtrip(spark, sf_dir):
    """Each document as a box, and its header read back."""
    boxed = table(spark, sf_dir, "documents").select("doc_id", binary.box("mdat", F.encode("text", "UTF-8")).alias("b"))
    return boxed.select("doc_id", binary.unsigned("b", 0, 4).alias("size"), binary.fourcc("b", 4).alias("type"), F.decode(binary.piece("b", 8, F.octet_length("b") - 8), "UTF-8").alias("text"))


def u32_decode(spark, sf_dir):
    n = F.col("doc_id") * 4000037 + F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(binary.to_bytes(n % (1 << 32), 4), binary.to_bytes(-n % (1 << 31), 4), binary.to_bytes(n, 8)).alias("b"))
    return rows.select("doc_id", binary.unsigned("b", 0, 4).alias("u32"), binary.signed32("b", 4).alias("i32"), binary.unsigned64("b", 8).cast("bigint").alias("u64"))


def h264_h265_nal_type(spark, sf_dir):
    from kinotable.functions import codec

    raw = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", codec.nal_type_h264(raw).alias("h264"), codec.nal_type_h265(raw).alias("h265"))


def aac_config(spark, sf_dir):
    """AudioSpecificConfig bytes of rates and channels from parts, and what they parse to."""
    from kinotable.functions import codec

    rate = F.when(F.col("p_partkey") % 2 == 0, F.element_at(F.lit(codec.RATES), (F.col("p_partkey") % 13 + 1).cast("int"))).otherwise((F.col("p_partkey") * 37 % 90000 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", rate.alias("rate"), (F.col("p_partkey") % 7 + 1).cast("int").alias("channels"))
    rows = rows.withColumn("asc", codec.encode_asc("rate", "channels", F.lit(2))).withColumn("p", codec.parse_asc("asc"))
    return rows.select("p_partkey", F.lower(F.hex("asc")).alias("asc"), F.col("p.sample_rate").alias("sample_rate"), F.col("p.channel_config").alias("channel_config"), F.col("p.object_type").alias("object_type"))


_TIMED = "timed AS (SELECT *, (coalesce(sum(duration) OVER (PARTITION BY file, kind ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS dts, CASE kind WHEN 'video' THEN 25 ELSE 30 END AS timescale FROM samples)"
_DTS = "run AS (SELECT *, ((coalesce(sum(duration) OVER (PARTITION BY file ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT // 9)::BIGINT AS dts FROM samples)"
_FRAGMENTS = _DTS + """, keys AS (SELECT DISTINCT file, dts AS k FROM run WHERE is_key),
fragmented AS (SELECT r.file, r.sample_id, r.kind, r.size, r.dts, greatest(1, (SELECT count(*) FROM keys WHERE keys.file = r.file AND keys.k <= r.dts))::BIGINT AS fragment_id FROM run r)"""
_RLE = """marked AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY file ORDER BY sample_id) = kind THEN 0 ELSE 1 END AS n FROM samples),
runs AS (SELECT file, run_no, count(*)::BIGINT AS run_length, min(kind) AS kind FROM (SELECT file, kind, (sum(n) OVER (PARTITION BY file ORDER BY sample_id))::BIGINT AS run_no FROM marked) GROUP BY file, run_no)"""


def _rounded(t: int) -> str:
    v = "(size - 500)"
    s = f"({v} % {t} * 10000000)"
    return f"({v} // {t} * 10000000 + {s} // {t} + CASE WHEN abs({s} % {t}) * 2 >= {t} THEN sign({s} % {t}) ELSE 0 END)::BIGINT AS ticks_{t}"


SQL = {
    "dts_prefix_sum": f"WITH {SAMPLES} SELECT file, sample_id, coalesce(sum(duration) OVER (PARTITION BY file ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS dts FROM samples",
    "chunk_offsets": f"WITH {SAMPLES} SELECT file, sample_id, coalesce(sum(size) OVER (PARTITION BY file, sample_id // 4 ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chunk_offset FROM samples",
    "asof_chunk_map": f"WITH {SAMPLES}, runs AS (SELECT file, sample_id AS first, size AS run_size, sample_id AS run_id FROM samples WHERE is_key) SELECT s.file, s.sample_id, run_size, run_id FROM samples s ASOF LEFT JOIN runs r ON s.file = r.file AND s.sample_id >= r.first",
    "rle_encode": f"WITH {SAMPLES}, {_RLE} SELECT * FROM runs",
    "rle_expand": f"WITH {SAMPLES}, {_RLE} SELECT file, run_no, unnest(range(run_length))::BIGINT AS in_run, kind FROM runs",
    "sync_mark": f"WITH {SAMPLES}, listed AS (SELECT file, sample_id FROM samples WHERE is_key AND file % 3 <> 0) SELECT file, sample_id, file NOT IN (SELECT file FROM listed) OR sample_id IN (SELECT sample_id FROM listed) AS is_sync FROM samples",
    "default_precedence": """WITH f AS (SELECT *, coalesce(CASE WHEN l_orderkey % 5 = 0 THEN l_quantity::BIGINT * 65536 END, CASE WHEN l_linenumber = 1 AND l_orderkey % 2 = 0 THEN l_linenumber * 65536 END, CASE WHEN l_orderkey % 7 = 0 THEN 65536 END, 0)::BIGINT AS flags FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(CASE WHEN l_orderkey % 2 = 0 THEN l_quantity::BIGINT END, CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber END, nullif(l_suppkey % 4, 0))::BIGINT AS value, flags, flags & 65536 = 0 AS is_key FROM f""",
    "range_overlap": f"WITH {SAMPLES}, r AS (SELECT file, sample_id, sample_id * 5000 AS start, max(sample_id * 5000 + size * 30) OVER (PARTITION BY file ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_end FROM samples) SELECT * FROM r WHERE start < prior_end",
    "monotonic_check": f"WITH {SAMPLES}, r AS (SELECT file, sample_id, size, lag(size) OVER (PARTITION BY file ORDER BY sample_id) AS prior_value FROM samples) SELECT * FROM r WHERE size <= prior_value",
    "track_merge": f"WITH {SAMPLES}, {_TIMED}, other AS (SELECT file, max(CASE WHEN kind = 'video' THEN timescale END) AS v, max(CASE WHEN kind = 'audio' THEN timescale END) AS a FROM timed GROUP BY file) SELECT t.file, sample_id, row_number() OVER (PARTITION BY t.file ORDER BY dts::HUGEINT * coalesce(CASE kind WHEN 'video' THEN a ELSE v END, 1), kind DESC, sample_id)::INTEGER AS delivery_no FROM timed t JOIN other o USING (file)",
    "conversation_merge": "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'video' ELSE 'audio' END AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, role = 'user' DESC, turn, length(text))::INTEGER AS delivery_no FROM conversations",
    "access_units": f"WITH {SAMPLES}, m AS (SELECT *, sample_id // 500 AS dts FROM samples) SELECT file, row_number() OVER (PARTITION BY file ORDER BY dts)::BIGINT AS au_no, count(*)::BIGINT AS nals, sum(size)::BIGINT AS size, min(sample_id) AS first_id FROM m GROUP BY file, dts",
    "gop_segment": f"WITH {SAMPLES}, {_FRAGMENTS} SELECT file, sample_id, dts, fragment_id FROM fragmented",
    "physical_order": f"""WITH {SAMPLES}, n AS (SELECT *, CASE kind WHEN 'video' THEN coalesce(lead(sample_id) OVER (PARTITION BY file, kind ORDER BY sample_id), 9223372036854775807) ELSE sample_id END AS place FROM samples)
SELECT file, sample_id, row_number() OVER (PARTITION BY file ORDER BY place, kind DESC, sample_id)::INTEGER AS physical_no FROM n""",
    "fragment_layout": f"""WITH {SAMPLES}, {_FRAGMENTS}, m AS (SELECT file, fragment_id, (24 + 64 * count(DISTINCT kind) + 16 * count(*))::BIGINT AS moof_size FROM fragmented GROUP BY ALL)
SELECT f.file, sample_id, f.fragment_id, moof_size, (coalesce(sum(size) OVER (PARTITION BY f.file, f.fragment_id ORDER BY kind DESC, dts, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + moof_size + 8)::BIGINT AS data_offset FROM fragmented f JOIN m USING (file, fragment_id)""",
    "track_duration": f"WITH {SAMPLES}, {_TIMED} SELECT file, kind, max(dts + duration) AS track_duration FROM timed GROUP BY file, kind",
    "rescale_time": f"WITH {SAMPLES} SELECT sample_id, {', '.join(map(_rounded, (1000, 44100, 90000, 10_000_000)))} FROM samples",
    "box_roundtrip": "SELECT doc_id, strlen(text) + 8 AS size, 'mdat' AS type, text FROM documents",
    "u32_decode": "WITH n AS (SELECT doc_id, doc_id * 4000037 + n_chars AS n FROM documents) SELECT doc_id, n % 4294967296 AS u32, -n % 2147483648 AS i32, n AS u64 FROM n",
    "h264_h265_nal_type": "WITH b AS (SELECT doc_id, ('0x' || hex(encode(text))[1:2])::BIGINT AS b FROM documents) SELECT doc_id, b & 31 AS h264, (b >> 1) & 63 AS h265 FROM b",
    "aac_config": """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350][p_partkey % 13 + 1] ELSE p_partkey * 37 % 90000 + 1 END::BIGINT AS rate, p_partkey % 7 + 1 AS ch FROM part),
i AS (SELECT *, list_position([96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350], rate) - 1 AS k FROM r)
SELECT p_partkey, CASE WHEN k >= 0 THEN lpad(lower(hex((2 << 11) + (k << 7) + (ch << 3))), 4, '0') ELSE lpad(lower(hex((2::BIGINT << 35) + (15::BIGINT << 31) + (rate << 7) + (ch << 3))), 10, '0') END AS asc, rate::INTEGER AS sample_rate, ch::INTEGER AS channel_config, 2 AS object_type FROM i""",
}

QUERIES = {name: globals()[name] for name in SQL}
