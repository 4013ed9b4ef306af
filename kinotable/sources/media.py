"""Tracks and samples of scanned files: the sample tables of progressive files and the runs of fragmented ones.

Everything here is native and partitioned by file, so one shuffle of metadata serves all steps. A broken rule is a row
of `violations`; a file with one has no tracks and no samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinotable.functions.binary import flags, fourcc, signed32, unsigned, unsigned64, version
from kinotable.operators import kernels
from kinotable.sources import boxes as box_scan
from kinotable.sources.boxes import MAX_ENTRIES, MAX_SAMPLES
from kinotable.sources.config import parse_stsd
from kinotable.sources.shared import observed, settled

SAMPLES = ["file", "track_id", "kind", "timescale", "sample_no", "offset", "size", "pts", "dts", "duration", "is_key", "fragment_seq"]
_HUGE = (1 << 63) - 1


@dataclass
class Media:
    """What a set of files holds. tracks: file, track_id, kind, timescale, video, audio. samples: SAMPLES, times in track units. violations: file, code."""

    boxes: DataFrame
    tracks: DataFrame
    samples: DataFrame
    violations: DataFrame


def _first(*rules: tuple[Column, str]) -> Column:
    """Code of the first rule whose condition holds; null if none does."""
    out = F.lit(None).cast("string")
    for condition, code in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(True)), F.lit(code)).otherwise(out)
    return out


def _entries(name: str, step: int, base: int = 8) -> Column:
    """Whether a table's entry count is beyond the limit or the box; a missing table is fine."""
    p = F.col(name)
    count = unsigned(p, base - 4, 4)
    return p.isNotNull() & ((F.octet_length(p) < base) | (count > MAX_ENTRIES) | (count > F.floor((F.octet_length(p) - base) / step)))


def _bound(value: Column, use) -> Column:
    """use(value), with the value read once: a lambda that names a column of the row would copy its bytes for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _table(name: str, step: int, *fields: Column, base: int = 8) -> Column:
    """Array over the entries of a table; `fields` are functions of the entry's place."""
    p = F.col(name)
    count = unsigned(p, base - 4, 4)
    at = _bound(p, lambda b: F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda k: F.struct(*(f(b, k * step + base).alias(n) for n, f in fields))))
    return F.when(count > 0, at).otherwise(F.array().cast(f"array<struct<{','.join(f'{n}:bigint' for n, _ in fields)}>>"))


def _u32(shift: int = 0):
    return lambda p, at: unsigned(p, at + shift, 4)


def _tracks(boxes: DataFrame) -> DataFrame:
    """One row for each track box, with its tables and the first violation of what every track must hold."""
    kinds = ["tkhd", "mdia", "hdlr", "mdhd", "minf", "stbl", "stsd", "stsz", "stts", "stco", "co64", "stsc", "ctts", "stss"]
    of = lambda k: F.col("type") == k
    inside = boxes.where("trak_start IS NOT NULL AND violation IS NULL")
    found = inside.groupBy("file", "trak_start").agg(
        F.max("file_size").alias("file_size"),
        *(F.count(F.when(of(k), 1)).alias(f"n_{k}") for k in kinds),
        *(F.min_by("payload", F.when(of(k), F.col("start"))).alias(k) for k in kinds if k in box_scan.DECODED),
    )
    handler = F.when(F.octet_length("hdlr") >= 12, fourcc("hdlr", 8))
    found = found.withColumn("handler", handler)
    one = lambda k: (F.col(f"n_{k}") != 1, f"{k}_count")
    media = F.col("handler").isin("vide", "soun")
    size = lambda k: F.octet_length(k)
    v = lambda k: version(k)
    track_id = F.when(v("tkhd") == 0, unsigned("tkhd", 12, 4)).when(v("tkhd") == 1, unsigned("tkhd", 20, 4))
    timescale = F.when(v("mdhd") == 0, unsigned("mdhd", 12, 4)).when(v("mdhd") == 1, unsigned("mdhd", 20, 4))
    found = found.withColumns({"track_id": track_id, "timescale": timescale, "config": parse_stsd("stsd", "handler"), "n_samples": F.when(size("stsz") >= 12, unsigned("stsz", 8, 4))})
    head = _first(one("mdia"), one("hdlr"), (size("hdlr") < 12, "hdlr_truncated"), one("tkhd"), (~v("tkhd").isin(0, 1), "tkhd_version"), (F.col("track_id").isNull(), "tkhd_truncated"), (F.col("track_id") == 0, "track_id_zero"))
    rest = _first(
        one("mdhd"), (~v("mdhd").isin(0, 1), "mdhd_version"), (F.col("timescale").isNull(), "mdhd_truncated"), (~F.col("timescale").between(1, (1 << 31) - 1), "timescale_range"), one("minf"), one("stbl"), one("stsd"),
        (F.col("config.violation").isNotNull(), "config"), one("stsz"), (F.col("n_samples").isNull(), "stsz_truncated"), (F.col("n_samples") > MAX_SAMPLES, "sample_count"),
        ((unsigned("stsz", 4, 4) == 0) & (F.col("n_samples") > F.floor((size("stsz") - 12) / 4)), "stsz_entries"), one("stts"), (_entries("stts", 8), "stts_entries"),
        (F.when(F.col("n_stco") > 0, F.col("n_stco") < 1).otherwise(F.col("n_co64") != 1), "chunk_offsets_count"), (F.when(F.col("stco").isNotNull(), _entries("stco", 4)).otherwise(_entries("co64", 8)), "chunk_offsets_entries"),
        one("stsc"), (_entries("stsc", 12), "stsc_entries"), (F.col("ctts").isNotNull() & ~F.coalesce(v("ctts").isin(0, 1), F.lit(False)), "ctts_version"), (_entries("ctts", 8), "ctts_entries"), (_entries("stss", 4), "stss_entries"),
    )
    code = F.when(rest == "config", F.col("config.violation")).otherwise(rest)
    return found.withColumn("violation", F.coalesce(head, F.when(media, code)))


def _progressive(tracks: DataFrame) -> DataFrame:
    """Samples of tracks without violation: the tables are decoded and zipped in the row, then exploded once. Column violation has what only the tables together show."""
    runs = lambda a, value: F.flatten(F.transform(F.col(a), lambda r: F.array_repeat(r[value], r["n"].cast("int"))))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, r: s + r["n"])
    constant, n = unsigned("stsz", 4, 4), F.col("n_samples")
    index = F.sequence(F.lit(0).cast("bigint"), n - 1)
    sizes = F.when(n == 0, F.array().cast("array<bigint>")).when(constant == 0, _bound(F.col("stsz"), lambda b: F.transform(index, lambda k: unsigned(b, k * 4 + 12, 4)))).otherwise(F.array_repeat(constant, n.cast("int")))
    big = lambda p, at: F.when(unsigned64(p, at) <= _HUGE, unsigned64(p, at)).cast("bigint")
    offsets = F.when(F.col("stco").isNotNull(), _table("stco", 4, ("at", _u32()))).otherwise(_table("co64", 8, ("at", big)))
    shift = lambda p, at: F.when(version(p) == 1, signed32(p, at + 4)).otherwise(unsigned(p, at + 4, 4))
    t = tracks.withColumns({
        "sizes": sizes, "durations": _table("stts", 8, ("n", _u32()), ("v", _u32(4))), "offsets": offsets,
        "chunks": _table("stsc", 12, ("first", _u32()), ("n", _u32(4)), ("entry", _u32(8))), "shifts": F.when(F.col("ctts").isNotNull(), _table("ctts", 8, ("n", _u32()), ("v", shift))),
        "sync": F.when(F.col("stss").isNotNull(), _table("stss", 4, ("at", _u32()))),
    })
    n_chunks = F.size("offsets").cast("bigint")
    # a mapping holds up to the next one's first chunk: runs of chunks
    until = lambda k: F.least(F.coalesce(F.get(F.col("chunks"), k + 1)["first"], n_chunks + 1), n_chunks + 1)
    mapped = F.transform("chunks", lambda c, k: F.struct(F.greatest(until(k) - c["first"], F.lit(0)).alias("chunks"), c["n"].alias("n")))
    t = t.withColumn("mapped", mapped)
    described = F.aggregate("mapped", F.lit(0).cast("decimal(38,0)"), lambda s, m: (s + m["chunks"] * m["n"].cast("decimal(20,0)")).cast("decimal(38,0)"))
    rule = _first(
        (F.exists("durations", lambda r: r["n"] == 0) | (total("durations") != n), "stts_count"), (F.exists("offsets", lambda o: o["at"].isNull()), "chunk_offset_range"),
        (F.exists("chunks", lambda c: (c["first"] == 0) | (c["n"] == 0) | (c["entry"] != 1)), "stsc_mapping"), ((F.size("chunks") > 0) & (F.get("chunks", F.lit(0))["first"] != 1), "stsc_first_chunk"),
        (F.exists(F.transform("chunks", lambda c, k: (k > 0) & (c["first"] <= F.get(F.col("chunks"), k - 1)["first"])), lambda x: x), "stsc_order"),
        (F.col("shifts").isNotNull() & (F.exists("shifts", lambda r: r["n"] == 0) | (total("shifts") != n)), "ctts_count"),
        (F.col("sync").isNotNull() & ((F.size("sync") > n) | F.exists("sync", lambda s: (s["at"] == 0) | (s["at"] > n))), "stss_sample"),
        ((n > 0) & ((n_chunks == 0) | (F.size("chunks") == 0)), "chunk_tables_missing"), ((n > 0) & (described > n), "stsc_more_samples"), ((n > 0) & (described < n), "stsc_fewer_samples"),
    )
    # a rule about a table that isn't there holds for it
    t = t.withColumn("violation", rule)
    good = F.col("violation").isNull() & (n > 0)
    per_chunk = F.flatten(F.transform("mapped", lambda m: F.array_repeat(m["n"], m["chunks"].cast("int"))))
    chunk = F.flatten(F.transform(per_chunk, lambda c, k: F.array_repeat(k.cast("bigint"), c.cast("int"))))
    t = t.withColumn("listed", F.when(good & F.col("sync").isNotNull(), F.sort_array(F.array_distinct(F.transform("sync", lambda s: s["at"])))))
    # a mark for each sample up to the last that is listed, in one pass over the list and the list moved on by one
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.col("listed"))
    gaps = F.zip_with("listed", F.slice(before, F.lit(1), F.size("listed")), lambda v, u: (v - u - 1).cast("int"))
    keys = F.flatten(F.transform(gaps, lambda n: F.concat(F.array_repeat(F.lit(False), n), F.array(F.lit(True)))))
    t = t.withColumns({"d": F.when(good, runs("durations", "v")), "s": F.when(good & F.col("shifts").isNotNull(), runs("shifts", "v")), "c": F.when(good, chunk), "o": F.transform("offsets", lambda o: o["at"]), "keys": keys})
    # the arrays are bound to one variable: a column that a lambda names could be made anew for each element
    arrays = F.struct("sizes", "d", "s", "c", "o", "keys")
    of_sample = lambda x, z, k: F.struct(
        (k + 1).cast("int").alias("sample_no"), z.alias("size"), F.get(x["d"], k).alias("duration"), F.coalesce(F.get(x["s"], k), F.lit(0)).alias("shift"),
        F.get(x["c"], k).alias("chunk"), F.get(x["o"], F.get(x["c"], k).cast("int")).alias("chunk_offset"),
        (x["keys"].isNull() | F.coalesce(F.get(x["keys"], k), F.lit(False))).alias("is_key"),
    )
    row = F.explode_outer(F.when(good, _bound(arrays, lambda x: F.transform(x["sizes"], lambda z, k: of_sample(x, z, k)))))
    s = t.select("file", "track_id", "handler", "timescale", "file_size", "trak_start", "violation", row.alias("r")).select("*", "r.*")
    s = kernels.exclusive_sum(s, ["file", "trak_start", "chunk"], ["sample_no"], "size", "in_chunk")
    s = kernels.exclusive_sum(s, ["file", "trak_start"], ["sample_no"], "duration", "dts")
    s = s.withColumns({"offset": F.col("chunk_offset") + F.col("in_chunk"), "pts": F.col("dts") + F.col("shift"), "fragment_seq": F.lit(None).cast("bigint")})
    beyond = F.col("sample_no").isNotNull() & (F.col("offset") > F.col("file_size") - F.col("size"))
    return s.withColumn("violation", F.coalesce("violation", F.when(beyond, F.lit("sample_outside_file"))))


def _fragmented(boxes: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples of movie fragments (with a violation column) and (file, violation) of what concerns fragments or tracks."""
    whole = boxes.where("violation IS NULL")
    top = whole.where("depth = 0")
    order = Window.partitionBy("file").orderBy("start")
    top = top.withColumns({"next_type": F.lead("type").over(order), "next_start": F.lead("start").over(order), "next_size": F.lead("size").over(order), "next_header": F.lead("header_size").over(order)})
    moofs = top.where("type = 'moof'").select("file", F.col("start").alias("moof_start"), "next_type", (F.col("next_start") + F.col("next_header")).alias("data_start"), (F.col("next_start") + F.col("next_size")).alias("data_end"))
    inside = whole.where("moof_start IS NOT NULL")
    of = lambda k: F.col("type") == k
    heads = inside.groupBy("file", "moof_start").agg(F.count(F.when(of("mfhd"), 1)).alias("n_mfhd"), F.count(F.when(of("traf"), 1)).alias("n_traf"), F.min_by("payload", F.when(of("mfhd"), F.col("start"))).alias("mfhd"))
    moofs = moofs.join(heads, ["file", "moof_start"], "left").withColumn("seq", unsigned("mfhd", 4, 4))
    moofs = moofs.withColumn("prior_seq", F.lag("seq").over(Window.partitionBy("file").orderBy("moof_start")))
    moofs = moofs.withColumn("violation", _first((~F.col("next_type").eqNullSafe("mdat"), "moof_without_mdat"), (F.col("n_mfhd") != 1, "mfhd_count"), (F.col("seq").isNull(), "mfhd_truncated"), (F.coalesce(F.col("seq") <= F.col("prior_seq"), F.lit(False)), "sequence_order"), (F.col("n_traf") == 0, "traf_missing")))

    # one row for each traf
    parts = inside.where("traf_start IS NOT NULL").groupBy("file", "moof_start", "traf_start").agg(
        *(F.count(F.when(of(k), 1)).alias(f"n_{k}") for k in ("tfhd", "tfdt", "trun")), *(F.min_by("payload", F.when(of(k), F.col("start"))).alias(k) for k in ("tfhd", "tfdt")),
    )
    f = F.coalesce(flags("tfhd"), F.lit(0))
    has = lambda bits: f.bitwiseAND(F.lit(bits)) != 0
    at = lambda *bits: F.lit(8) + sum((F.when(has(b), 8 if b == 1 else 4).otherwise(0) for b in bits), F.lit(0))
    field = lambda bit, *before: F.when(has(bit), unsigned("tfhd", at(*before), 4))
    raw_base, raw_time = unsigned64("tfhd", 8), unsigned64("tfdt", 4)
    fits_long = lambda x: F.when(x <= _HUGE, x).cast("bigint")
    parts = parts.withColumns({
        "track_id": unsigned("tfhd", 4, 4), "base": F.when(has(1), fits_long(raw_base)).when(has(0x20000), F.col("moof_start")), "entry": field(2, 1), "h_duration": field(8, 1, 2), "h_size": field(16, 1, 2, 8), "h_flags": field(32, 1, 2, 8, 16),
        "decode_time": F.when(version("tfdt") == 0, unsigned("tfdt", 4, 4)).when(version("tfdt") == 1, fits_long(raw_time)),
    })
    needs = at(1, 2, 8, 16, 32)
    known = tracks.where(F.col("handler").isin("vide", "soun")).select("file", "track_id", "handler", "timescale")
    trex = whole.where("type = 'trex' AND moof_start IS NULL").groupBy("file", unsigned("payload", 4, 4).alias("track_id")).agg(F.count("*").alias("n_trex"), F.min_by("payload", "start").alias("trex"))
    known = known.join(trex, ["file", "track_id"], "left")
    parts = parts.join(known, ["file", "track_id"], "left")
    parts = parts.withColumn("again", F.row_number().over(Window.partitionBy("file", "moof_start", "track_id").orderBy("traf_start")))
    parts = parts.withColumn("violation", _first(
        (F.col("n_tfhd") != 1, "tfhd_count"), (F.octet_length("tfhd") < F.greatest(needs, F.lit(8)), "tfhd_truncated"), (has(1) & has(0x20000), "tfhd_two_bases"), (~has(1) & ~has(0x20000), "tfhd_no_base"), (F.col("base").isNull(), "tfhd_base_range"),
        (F.coalesce(F.col("entry") != 1, F.lit(False)), "tfhd_description"), (F.col("handler").isNull(), "traf_unknown_track"), (F.col("again") > 1, "traf_repeated_track"), (F.col("n_tfdt") != 1, "tfdt_count"),
        (~F.coalesce(version("tfdt").isin(0, 1), F.lit(False)), "tfdt_version"), (F.col("decode_time").isNull(), "tfdt_range"), (F.col("n_trun") == 0, "trun_missing"),
    ))

    # one row for each run, then for each sample
    runs = inside.where("type = 'trun'").select("file", "moof_start", "traf_start", F.col("start").alias("trun_start"), "payload")
    g = F.coalesce(flags("payload"), F.lit(0))
    got = lambda bits: g.bitwiseAND(F.lit(bits)) != 0
    stride = sum((F.when(got(b), 4).otherwise(0) for b in (0x100, 0x200, 0x400, 0x800)), F.lit(0))
    base = F.lit(8) + F.when(got(1), 4).otherwise(0) + F.when(got(4), 4).otherwise(0)
    place = lambda bit: sum((F.when(got(b), 4).otherwise(0) for b in (0x100, 0x200, 0x400) if b < bit), F.lit(0))
    runs = runs.withColumns({"n": unsigned("payload", 4, 4), "v": version("payload"), "shifted": F.when(got(1), signed32("payload", 8)), "first_flags": F.when(got(4), unsigned("payload", F.lit(8) + F.when(got(1), 4).otherwise(0), 4)), "stride": stride, "base_at": base})
    runs = runs.withColumn("upto", F.sum("n").over(Window.partitionBy("file").orderBy("trun_start")))
    runs = runs.withColumn("run_violation", _first(
        (F.octet_length("payload") < 8, "trun_truncated"), (~F.col("v").isin(0, 1), "trun_version"), (F.col("upto") > MAX_SAMPLES, "sample_count"), (got(1) & F.col("shifted").isNull(), "trun_truncated"),
        (got(4) & got(0x400), "trun_two_flags"), (got(4) & F.col("first_flags").isNull(), "trun_truncated"), (F.col("n") * F.col("stride") > F.octet_length("payload") - F.col("base_at"), "trun_entries"),
    ))
    runs = runs.withColumns({f"has_{b}": got(b) for b in (0x100, 0x200, 0x400, 0x800)} | {f"at_{b}": F.col("base_at") + place(b) for b in (0x100, 0x200, 0x400, 0x800)})
    field_at = lambda bit, k: F.col(f"at_{bit}") + k * F.col("stride")
    own = lambda b, bit, k: F.when(F.col(f"has_{bit}"), unsigned(b, field_at(bit, k), 4))
    shift = lambda b, k: F.when(F.col("v") == 1, F.when(F.col("has_2048"), signed32(b, field_at(0x800, k)))).otherwise(own(b, 0x800, k))
    entry = lambda b, k: F.struct(k.alias("k"), own(b, 0x100, k).alias("duration"), own(b, 0x200, k).alias("size"), own(b, 0x400, k).alias("flags"), F.coalesce(shift(b, k), F.lit(0)).alias("shift"))
    entries = _bound(F.col("payload"), lambda b: F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda k: entry(b, k)))
    each = F.explode_outer(F.when(F.col("run_violation").isNull() & (F.col("n") > 0), entries))
    s = runs.select("file", "moof_start", "traf_start", "trun_start", "shifted", "first_flags", "run_violation", F.when(got(1), F.col("trun_start")).alias("jump"), each.alias("r")).select("*", "r.*").drop("r")
    s = s.join(parts.select("file", "traf_start", "track_id", "handler", "timescale", "base", "decode_time", "h_duration", "h_size", "h_flags", "trex", F.col("violation").alias("traf_violation")), ["file", "traf_start"])
    s = s.join(moofs.select("file", "moof_start", "seq", "data_start", "data_end"), ["file", "moof_start"])
    s = s.withColumns({"duration": kernels.resolve(F.col("duration"), F.col("h_duration"), unsigned("trex", 12, 4)), "size": kernels.resolve(F.col("size"), F.col("h_size"), unsigned("trex", 16, 4)), "flags": kernels.resolve_flags(F.col("flags"), F.col("first_flags"), F.col("k"), F.col("h_flags"), unsigned("trex", 20, 4))})
    # data goes on behind the run before, unless a run has a place of its own
    inorder = Window.partitionBy("file", "traf_start").orderBy("trun_start", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("jump", F.coalesce(F.last("jump", ignorenulls=True).over(inorder), F.lit(-1)))
    s = s.withColumn("origin", F.col("base") + F.coalesce(F.first("shifted").over(Window.partitionBy("file", "traf_start", "jump").orderBy("trun_start", "k")), F.lit(0)))
    s = kernels.exclusive_sum(s, ["file", "traf_start", "jump"], ["trun_start", "k"], "size", "behind")
    s = kernels.exclusive_sum(s, ["file", "traf_start"], ["trun_start", "k"], "duration", "since")
    s = s.withColumns({"offset": F.col("origin") + F.col("behind"), "dts": F.col("decode_time") + F.col("since"), "is_key": kernels.is_key(F.col("flags"))}).withColumn("pts", F.col("dts") + F.col("shift"))
    real = F.col("k").isNotNull()
    s = s.withColumn("prior_end", F.max(F.col("offset") + F.col("size")).over(Window.partitionBy("file", "moof_start").orderBy("offset", "trun_start", "k").rowsBetween(Window.unboundedPreceding, -1)))
    in_track = Window.partitionBy("file", "track_id").orderBy("moof_start", "traf_start", "trun_start", "k")
    s = s.withColumns({"sample_no": F.when(real, F.sum(F.when(real, 1).otherwise(0)).over(in_track.rowsBetween(Window.unboundedPreceding, Window.currentRow))).cast("int"), "prior_decode_end": F.max(F.col("dts") + F.col("duration")).over(in_track.rowsBetween(Window.unboundedPreceding, -1))})
    s = s.withColumn("violation", F.coalesce("traf_violation", "run_violation", F.when(real, _first(
        (F.coalesce(F.col("decode_time") < F.col("prior_decode_end"), F.lit(False)) & (F.col("since") == 0), "decode_time_order"), (F.coalesce(F.col("duration"), F.lit(0)) == 0, "sample_duration"), (F.coalesce(F.col("size"), F.lit(0)) == 0, "sample_size"),
        ((F.col("offset") < F.col("data_start")) | (F.col("offset") + F.col("size") > F.col("data_end")), "sample_outside_mdat"), (F.coalesce(F.col("offset") < F.col("prior_end"), F.lit(False)), "sample_overlap"),
    ))))
    has_moof = moofs.select("file").distinct()
    here = known.join(has_moof, "file", "left_semi")
    default = here.withColumn("violation", _first((F.coalesce(F.col("n_trex"), F.lit(0)) == 0, "trex_missing"), (F.col("n_trex") > 1, "trex_repeated"), (F.octet_length("trex") < 24, "trex_truncated"), (unsigned("trex", 8, 4) != 1, "trex_description")))
    twice = here.groupBy("file", "track_id").count().where("count > 1").select("file", F.lit("track_id_repeated").alias("violation"))
    both = tracks.where(F.col("handler").isin("vide", "soun") & (F.col("n_samples") > 0)).join(has_moof, "file", "left_semi").select("file", F.lit("progressive_and_fragmented").alias("violation"))
    broken = moofs.select("file", "violation").unionByName(parts.select("file", "violation")).unionByName(default.select("file", "violation")).unionByName(twice).unionByName(both)
    return s.withColumn("fragment_seq", F.col("seq")), broken.where("violation IS NOT NULL")


_held: list[tuple[SparkSession, str]] = []
_lock = Lock()


@contextmanager
def _keyed_by_file(spark: SparkSession) -> Iterator[None]:
    """While tables are written: rows that lie together by file needn't be dealt anew for joins by file and more. The option goes back when the last of several threads is done."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    with _lock:
        _held.append((spark, spark.conf.get(name) if not _held else _held[0][1]))
        spark.conf.set(name, "false")
    try:
        yield
    finally:
        with _lock:
            own, before = _held.pop()
            if not _held:
                own.conf.set(name, before)


#: Tables of a track without samples: entries alone, no rules that they could break.
_NO_TABLES = "n_samples = 0 AND octet_length(stts) = 8 AND octet_length(stsc) = 8 AND octet_length(coalesce(stco, co64)) = 8 AND ctts IS NULL AND stss IS NULL"


def decode(boxes: DataFrame, mode: str = "permissive", settle: bool = True) -> Media:
    """Tracks, samples and violations of scanned boxes. Boxes, tracks and samples, which are metadata alone, are written to the shared folder on the way, so that files are read and tables decoded once, unless settle is false. mode: permissive, or failfast, where reading samples of a file with a violation is an error."""
    if mode not in ("permissive", "failfast"):
        raise ValueError(f"unknown mode {mode!r}")

    def keep(df: DataFrame) -> DataFrame:
        if not settle:
            return df
        with _keyed_by_file(df.sparkSession):
            return settled(df)

    tables = fragments = 1  # whether any file may have sample tables, or movie fragments; else these aren't planned at all
    if settle:
        boxes, seen = observed(boxes, F.count(F.when(F.col("moof_start").isNotNull() | (F.col("type") == "moof"), 1)).alias("n"))
        boxes, fragments = boxes.repartition("file"), seen["n"]
    tracks, is_media = _tracks(boxes), F.col("handler").isin("vide", "soun")
    if settle:
        with _keyed_by_file(boxes.sparkSession):
            tracks, seen = observed(tracks, F.count(F.when(is_media & ~F.coalesce(F.expr(_NO_TABLES), F.lit(False)), 1)).alias("n"))
        tables = seen["n"]
    sound = tracks.where("violation IS NULL")
    media = sound.where(is_media)
    kind = F.when(F.col("handler") == "vide", "video").otherwise("audio").alias("kind")
    shape = lambda df: df.select("*", kind).select(*SAMPLES, "violation").where("sample_no IS NOT NULL OR violation IS NOT NULL")
    parts, broken = [], []
    if tables or not fragments:
        parts.append(shape(_progressive(media)))
    if fragments:
        fragmented, wrong = _fragmented(boxes, sound)
        parts.append(shape(fragmented))
        broken.append(wrong)
    found = keep(parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0])
    top = boxes.groupBy("file").agg(F.count(F.when((F.col("type") == "moov") & (F.col("depth") == 0), 1)).alias("moov"), F.max("violation").alias("violation"))
    wrong = [
        top.select("file", F.coalesce("violation", F.when(F.col("moov") == 0, "moov_missing").when(F.col("moov") > 1, "moov_repeated")).alias("violation")),
        tracks.select("file", "violation"), found.select("file", "violation"), *broken,
        tracks.where(F.col("handler").isin("vide", "soun")).groupBy("file", "handler").count().where("count > 1").select("file", F.concat(F.when(F.col("handler") == "vide", "video").otherwise("audio"), F.lit("_tracks")).alias("violation")),
    ]
    every = wrong[0]
    for w in wrong[1:]:
        every = every.unionByName(w)
    violations = keep(every.where("violation IS NOT NULL").select("file", F.col("violation").alias("code")).distinct())
    rows = found.where("sample_no IS NOT NULL").select(SAMPLES)
    shown = media.select("file", "track_id", kind, F.col("timescale").cast("int").alias("timescale"), "config.video", "config.audio")
    if mode == "failfast":
        first = violations.groupBy("file").agg(F.min("code").alias("__code"))
        stop = lambda df: df.join(first, "file", "left").where(F.when(F.col("__code").isNotNull(), F.raise_error(F.concat(F.col("file"), F.lit(": "), F.col("__code"))).cast("boolean")).otherwise(True)).drop("__code")
    else:
        stop = lambda df: df.join(violations, "file", "left_anti")
    return Media(boxes, stop(shown), stop(rows).withColumn("timescale", F.col("timescale").cast("int")), violations)


def read(spark: SparkSession, path: str | list[str], mode: str = "permissive") -> Media:
    """Media of the files at a path."""
    return decode(box_scan.scan(box_scan.files(spark, path)), mode)
