"""Files written here and read back: whole layouts, broken files, streams and the data source."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from kinotable.operators import payload
from kinotable.sources import boxes, datasource, media, mux
from kinotable.sources.shared import settled
from kinotable.streaming.fragmenter import INPUT, Fragmenter, fragment_stream

H264 = {"codec": "H264", "vps": None, "sps": bytes([0x67, 0x42, 0, 0x1E]), "pps": bytes([0x68, 0xCE, 6, 0xE2]), "nal_length_size": 4, "width": 16, "height": 16}
H265 = {"codec": "H265", "vps": b"\x40\1", "sps": b"\x42\1", "pps": b"\x44\1", "nal_length_size": 4, "width": 16, "height": 16}
AAC = {"asc": b"\x12\x10", "sample_rate": 44100, "channel_config": 2, "object_type": 2}
CONFIG = "file string, video struct<codec:string,vps:binary,sps:binary,pps:binary,nal_length_size:int,width:int,height:int>, audio struct<asc:binary,sample_rate:int,channel_config:int,object_type:int>"
TIMES = "pts_ticks long, dts_ticks long, duration_ticks long"
MS = 10_000

#: What the bytes of three units of two NAL units each, and two audio units, hash to.
FTYP_SHA = "44c20fd378624cfb5c351d"
SIZES = {"H264": (1160, 1128), "H265": (1185, 1153)}


def noise(n, seed):
    v, out = (seed + 1) * 2654435761 % 2**32, bytearray()
    for _ in range(n):
        v = (v * 1664525 + 1013904223) % 2**32
        out.append(v >> 24)
    return out


def nal(codec, n, key, seed):
    b = noise(n, seed)
    b[: 1 if codec == "H264" else 2] = (b"\x65" if key else b"\x41") if codec == "H264" else (b"\x26\1" if key else b"\x02\1")
    return bytes(b)


def submitted():
    video, audio = [], []
    for codec in ("H264", "H265"):
        n = 0
        for i in range(3):
            data = b"".join(b"\0\0\0\1" + nal(codec, s + i, i % 2 == 0, seed + 2 * i) for s, seed in ((257, 300), (129, 301)))
            video.append((codec, n, data, i * 40 * MS, i * 40 * MS, 40 * MS, i % 2 == 0))
            n += 1
            if i < 2:
                audio.append((codec, n, bytes(noise(191 + i, 400 + i)), i * 40 * MS, i * 40 * MS, 40 * MS))
                n += 1
    return video, audio


@pytest.fixture(scope="module")
def inputs(spark):
    video, audio = submitted()
    return (
        spark.createDataFrame(video, f"file string, submit_no long, data binary, {TIMES}, is_key boolean"),
        spark.createDataFrame(audio, f"file string, submit_no long, data binary, {TIMES}"),
        spark.createDataFrame([("H264", H264, AAC), ("H265", H265, AAC)], CONFIG),
    )


@pytest.fixture(scope="module")
def written(spark, inputs):
    """Files of each layout, as (file, content) with the layout in the name; names as long as those the sizes are known for."""
    out = {}
    for layout in mux.LAYOUTS:
        files, wrong = mux.mux(*inputs, layout, names=("V" * 17, "A" * 21))
        assert wrong.count() == 0
        out |= {f"{r.file}.{layout}": bytes(r.content) for r in files.collect()}
    return out


def of(spark, contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "file string, content binary")


def test_layouts(written):
    for codec, (whole, head) in SIZES.items():
        order = {layout: [(t, n) for _, n, _, t in boxes.children(memoryview(written[f"{codec}.{layout}"]), 0, len(written[f"{codec}.{layout}"]))] for layout in mux.LAYOUTS}
        assert order["progressive"] == [("ftyp", 28), ("mdat", 1587), ("moov", whole)]
        assert order["faststart"] == [("ftyp", 28), ("moov", whole), ("mdat", 1587)]
        assert order["fragmented"] == [("ftyp", 28), ("moov", head), ("moof", 216), ("mdat", 1181), ("moof", 104), ("mdat", 406)]
        assert hashlib.sha256(written[f"{codec}.progressive"][8:28]).hexdigest().startswith(FTYP_SHA)


def test_bytes_stand_in_writing_order(written):
    video, audio = submitted()
    v = [b"".join(struct.pack(">I", len(u)) + u for u in r[2].split(b"\0\0\0\1")[1:]) for r in video if r[0] == "H264"]
    a = [r[2] for r in audio if r[0] == "H264"]
    assert written["H264.progressive"][44 : 28 + 1587] == a[0] + v[0] + a[1] + v[1] + v[2]
    assert v[0] + v[1] + a[0] + a[1] in written["H264.fragmented"]


def test_timeline_of_every_layout(spark, written):
    files = of(spark, written)
    rows = payload.timeline(media.decode(boxes.scan(files)), files).orderBy("file", "delivery_no").collect()
    video, audio = submitted()
    for name in written:
        own = [r for r in rows if r.file == name]
        assert [f"{r.kind}:{r.pts_ticks}" for r in own] == [f"{k}:{t * 40 * MS}" for k, t in (("video", 0), ("video", 0), ("audio", 0), ("video", 1), ("video", 1), ("audio", 1), ("video", 2), ("video", 2))]
        assert [bytes(r.data) for r in own if r.kind == "audio"] == [r[2] for r in audio if name.startswith(r[0])]
        assert [bytes(r.data) for r in own if r.kind == "video"] == [u for r in video if name.startswith(r[0]) for u in r[2].split(b"\0\0\0\1")[1:]]
        assert [r.is_key for r in own if r.kind == "video"] == [True, True, False, False, True, True]
        assert all(r.duration_ticks == 40 * MS and (r.video.width == 16 if r.kind == "video" else r.audio.sample_rate == 44100) for r in own)


def broken_files(written):
    """name: (content, code)"""
    p, f = written["H264.progressive"], written["H264.fragmented"]

    def change(data, kind, at, value, nth=0, size=4):
        k = -1
        for _ in range(nth + 1):
            k = data.index(kind, k + 1)
        out = bytearray(data)
        out[k + 4 + at : k + 4 + at + size] = value.to_bytes(size)
        return bytes(out)

    moof = f.index(b"moof") - 4
    second = f.index(b"moof", moof + 8) - 4
    return {
        "good": (p, None), "empty": (b"", "moov_missing"), "cut": (p[:-3], "box_exceeds_parent"), "stub": (p + b"\0\0\0", "box_header_incomplete"), "two_moov": (p + p[p.index(b"moov") - 4 :], "moov_repeated"),
        "tkhd_version": (change(p, b"tkhd", 0, 2, size=1), "tkhd_version"), "track_zero": (change(p, b"tkhd", 20, 0), "track_id_zero"), "timescale": (change(p, b"mdhd", 20, 0), "timescale_range"),
        "entry": (p.replace(b"avc1", b"hev1"), "video_entry_unsupported"), "audio_entry": (p.replace(b"mp4a", b"ac-3"), "audio_entry_unsupported"), "stsz_limit": (change(p, b"stsz", 8, 1_000_001), "sample_count"), "stsz_cut": (change(p, b"stsz", 8, 900), "stsz_entries"),
        "stts_count": (change(p, b"stts", 8, 2), "stts_count"), "stts_zero": (change(p, b"stts", 8, 0), "stts_count"), "stsc_description": (change(p, b"stsc", 16, 2), "stsc_mapping"), "stsc_first": (change(p, b"stsc", 8, 2), "stsc_first_chunk"), "stsc_more": (change(p, b"stsc", 12, 2), "stsc_more_samples"),
        "stco": (change(p, b"stco", 8, 5000), "sample_outside_file"), "stss": (change(p, b"stss", 8, 9), "stss_sample"), "no_stts": (p.replace(b"stts", b"free", 1), "stts_count"), "two_video": (p.replace(b"soun", b"vide"), "video_tracks"), "avc_sps": (p.replace(b"\x67\x42\x00\x1e", b"\x66\x42\x00\x1e"), "config_sps"),
        "sequence": (change(f, b"mfhd", 4, 1, nth=1), "sequence_order"), "time": (change(f, b"tfdt", 4, 5, nth=2, size=8), "decode_time_order"), "no_tfdt": (f.replace(b"tfdt", b"free", 1), "tfdt_count"), "unknown": (change(f, b"tfhd", 4, 9), "traf_unknown_track"), "twice": (change(f, b"tfhd", 4, 1, nth=1), "traf_repeated_track"),
        "no_base": (change(f, b"tfhd", 1, 0, size=3), "tfhd_no_base"), "both_bases": (change(f, b"tfhd", 1, 0x020001, size=3), "tfhd_truncated"), "outside": (change(f, b"trun", 8, 20), "sample_outside_mdat"), "overlap": (change(f, b"trun", 8, 224, nth=1), "sample_overlap"), "no_mdat": (f[:second] + f[second : second + 104], "moof_without_mdat"),
        "trun_entries": (change(f, b"trun", 4, 60), "trun_entries"), "zero_duration": (change(f, b"trun", 12, 0), "sample_duration"), "no_trex": (f.replace(b"trex", b"free", 1), "trex_missing"), "trex_entry": (change(f, b"trex", 8, 2), "trex_description"), "no_traf": (f.replace(b"traf", b"free"), "traf_missing"),
        "trun_version": (change(f, b"trun", 0, 2, size=1), "trun_version"), "mixed": (p + f[moof:], "progressive_and_fragmented"),
    }


def test_violations(spark, written):
    broken = broken_files(written)
    found = media.decode(boxes.scan(of(spark, {k: v for k, (v, _) in broken.items()})))
    codes = {}
    for r in found.violations.collect():
        codes.setdefault(r.file, set()).add(r.code)
    assert {k: code for k, (_, code) in broken.items() if code and code not in codes.get(k, ())} == {}
    assert "good" not in codes
    assert {r.file for r in found.samples.select("file").distinct().collect()} == {"good"} == {r.file for r in found.tracks.select("file").distinct().collect()}


def test_failfast(spark, written):
    found = media.decode(boxes.scan(of(spark, {"x": written["H264.progressive"][:-3]})), "failfast")
    with pytest.raises(Exception, match="sample_outside_file"):
        media.decode(boxes.scan(of(spark, {"good": written["H264.progressive"], "x": broken_files(written)["stco"][0]})), "failfast").samples.collect()
    assert found.violations.count() == 1
    with pytest.raises(ValueError, match="unknown mode"):
        media.decode(found.boxes, "loose")


def test_broken_framing_shows_late(spark, written):
    p = bytearray(written["H264.progressive"])
    p[44 + 191 : 44 + 195] = (9999).to_bytes(4)  # the first NAL length, behind the first audio unit
    files = of(spark, {"x": bytes(p)})
    found = media.decode(boxes.scan(files))
    assert found.violations.count() == 0 and found.samples.count() == 5
    assert payload.nal_units(found, files).count() == 4
    with pytest.raises(Exception, match="nal_exceeds_sample"):
        payload.nal_units(found, files, "failfast").collect()


def fragment_file(tfhd=b"", tfhd_flags=0x020000, truns=(), trex=(0, 0, 0), data=b"x" * 64):
    """A fragmented file of one video track with boxes of our own."""
    head = mux.header("fragmented", H264, None).replace(struct.pack(">5I", 1, 1, 0, 0, 0), struct.pack(">5I", 1, 1, *trex))
    traf = mux.box("traf", mux.full("tfhd", 0, tfhd_flags, struct.pack(">I", 1), tfhd), mux.full("tfdt", 0, 0, struct.pack(">I", 100)), *truns)
    moof = mux.box("moof", mux.full("mfhd", 0, 0, struct.pack(">I", 1)), traf)
    return head + moof + mux.box("mdat", data), len(moof) + 8


def test_defaults_and_runs(spark):
    """Nearest level wins; a run without a place goes on; first-sample flags concern one sample."""
    run = lambda flags, n, *words: mux.full("trun", 0, flags, struct.pack(f">{len(words) + 1}I", n, *words))
    size = len(fragment_file(truns=[run(1, 2, 0)])[0]) - len(fragment_file()[0])
    at = fragment_file()[1] + size
    cases = {
        "trex": ({"truns": [run(1, 2, at)], "trex": (7, 5, 0x10000)}, [(5, 7, 100, False), (5, 7, 107, False)]),
        "tfhd": ({"truns": [run(1, 1, at + 12)], "tfhd": struct.pack(">III", 9, 6, 0), "tfhd_flags": 0x020038, "trex": (7, 5, 0x10000)}, [(6, 9, 100, True)]),
        "own": ({"truns": [run(0x301, 1, at + 8, 3, 4)], "trex": (7, 5, 0)}, [(4, 3, 100, True)]),
        "first": ({"truns": [run(5, 2, at + 4, 0x10000)], "trex": (7, 5, 0)}, [(5, 7, 100, False), (5, 7, 107, True)]),
        "goes_on": ({"truns": [run(1, 2, at + 16), run(0, 1)], "trex": (7, 5, 0)}, [(5, 7, 100, True), (5, 7, 107, True), (5, 7, 114, True)]),
    }
    files = {k: fragment_file(**v)[0] for k, (v, _) in cases.items()}
    found = media.decode(boxes.scan(of(spark, files)))
    assert found.violations.collect() == []
    rows = found.samples.orderBy("file", "sample_no").collect()
    for name, (_, want) in cases.items():
        own = [r for r in rows if r.file == name]
        assert [(r.size, r.duration, r.dts, r.is_key) for r in own] == want, name
        assert all(b.offset == a.offset + a.size for a, b in zip(own, own[1:], strict=False))


def test_negative_offsets_and_wide_places(spark):
    sample = {"kind": "video", "pts": 0, "dts": 40, "duration": 40, "is_key": True, "size": 5, "data": b"\0\0\0\1e", "no": 1}
    assert mux.fragment(1, [(1, [dict(sample)])]).count(b"trun\1\0\x0f\1") == 1
    assert b"co64" in mux.sample_table(b"", [sample | {"offset": (1 << 32) + 1}], True, 0)
    built = mux.build("progressive", [dict(sample, pts=80, dts=0), dict(sample, pts=40, dts=40, is_key=False, no=2)], H264, None)
    found = media.decode(boxes.scan(of(spark, {"x": built}))).samples.orderBy("sample_no").collect()
    assert [(r.pts, r.dts, r.is_key) for r in found] == [(80, 0, True), (40, 40, False)]


def test_writer_rules(spark, inputs):
    video, audio, configs = inputs
    rows = [(k, *r[1:]) for k in ("regress", "across", "empty", "delta", "negative", "unit") for r in submitted()[0] if r[0] == "H264"]
    change = {"regress": (2, 4, 0), "empty": (1, 2, b"\0\0\1"), "delta": (0, 6, False), "negative": (0, 4, -1)}
    out = []
    for r in rows:
        at, col, value = change.get(r[0], (None, 0, None))
        r = list(r)
        if at is not None and r[1] == 2 * at:
            r[col] = value
        if r[0] == "unit" and r[1] == 2:
            r[3:6] = 0, 0, 1
        out.append(tuple(r))
    v = spark.createDataFrame(out, video.schema)
    a = spark.createDataFrame([("across", 9, b"a", 0, 0, 1)], audio.schema)
    c = spark.createDataFrame([(k, H264, AAC) for k in ("regress", "across", "empty", "delta", "negative", "unit", "none")], CONFIG)
    files, wrong = mux.mux(v, a, c, "fragmented")
    codes = {(r.file, r.code) for r in wrong.collect()}
    assert codes >= {("regress", "dts_regresses"), ("across", "dts_regresses_across_tracks"), ("empty", "nal_empty"), ("delta", "first_video_not_key"), ("negative", "dts_negative"), ("unit", "access_unit_disagrees"), ("none", "no_samples")}
    assert files.count() == 0
    files, wrong = mux.mux(*inputs, "fragmented", max_fragment_bytes=1000)
    assert {r.code for r in wrong.collect()} == {"fragment_too_large"}
    with pytest.raises(ValueError, match="unknown layout"):
        mux.encode(*inputs, "flat")


def rows_for_stream(codec="H264"):
    video, audio = submitted()
    rows = [(f, n, "video", d, p, t, u, k) for f, n, d, p, t, u, k in video if f == codec] + [(f, n, "audio", d, p, t, u, True) for f, n, d, p, t, u in audio if f == codec]
    return sorted(rows, key=lambda r: r[1]) + [(codec, 99, "end", b"", 0, 0, 0, False)]


def test_stream_writes_the_same_bytes(spark, written, tmp_path):
    rows = rows_for_stream()
    schema = ", ".join(INPUT.split(", "))
    for k in range(0, len(rows), 2):
        spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = fragment_stream(source, H264, AAC, names=("V" * 17, "A" * 21))
    query = out.writeStream.format("memory").queryName("fragments").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    parts = spark.table("fragments").orderBy("sequence").collect()
    assert [p.violation for p in parts] == [None] * 3
    assert b"".join(bytes(p.content) for p in parts) == written["H264.fragmented"]


def test_stream_rules():
    def run(change, most=1 << 20):
        own, out = Fragmenter(H264, AAC, most, mux.HANDLER_NAMES), []
        for r in map(dict, (zip(("file", "submit_no", "kind", "data", "pts_ticks", "dts_ticks", "duration_ticks", "is_key"), r, strict=True) for r in rows_for_stream())):
            out += own.push(r | change.get(r["submit_no"], {}))
        return [v for _, _, v in out if v]

    assert run({}) == []
    assert run({2: {"dts_ticks": -1}}) == ["dts_negative"]
    assert run({4: {"dts_ticks": 1}}) == ["dts_regresses"]
    assert run({3: {"dts_ticks": 1}}) == ["dts_regresses_across_tracks"]
    assert run({0: {"is_key": False}}) == ["first_video_not_key"]
    assert run({2: {"data": b""}}) == ["payload_empty"]
    assert run({}, most=1000) == ["fragment_too_large"]


def test_key_frames_of_one_decode_time():
    rows = [("a", 0, "audio", b"x", 0, 0, 10, False), ("a", 1, "video", b"\x65a", 5, 5, 10, True), ("a", 2, "video", b"\x65b", 6, 5, 10, True), ("a", 3, "video", b"\x41c", 15, 15, 10, False), ("a", 4, "end", None, None, None, None, None)]
    names = ("file", "submit_no", "kind", "data", "pts_ticks", "dts_ticks", "duration_ticks", "is_key")
    one = Fragmenter(H264, AAC, 1 << 20, ("v", "a"))
    out = [x for r in rows for x in one.push(dict(zip(names, r, strict=True)))]
    assert [(n, code) for n, _, code in out] == [(0, None), (1, None)]  # one fragment, as kernels.fragments() has it


def test_many_key_samples_in_linear_time(spark):
    import time

    n = 200_000
    video = spark.range(n).select(F.lit("big").alias("file"), F.col("id").alias("submit_no"), F.when(F.col("id") % 2 == 0, F.lit(b"\x65a")).otherwise(F.lit(b"\x41b")).alias("data"), *((F.col("id") * 400000).alias(f"{k}_ticks") for k in ("pts", "dts")), F.lit(400000).cast("long").alias("duration_ticks"), (F.col("id") % 2 == 0).alias("is_key"))
    audio = spark.createDataFrame([], f"file string, submit_no long, data binary, {TIMES}")
    files, _ = mux.mux(video, audio, spark.createDataFrame([("big", H264, AAC)], CONFIG), "progressive")
    files = settled(files)
    began = time.perf_counter()
    found = media.decode(boxes.scan(files)).samples
    assert found.where("is_key = (sample_no % 2 = 1)").count() == n and time.perf_counter() - began < 60


def test_data_source(spark, written, tmp_path):
    datasource.register(spark)
    of(spark, written).write.format("mp4").mode("append").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"{k}.mp4" for k in written)
    found = media.decode(spark.read.format("mp4").load(str(tmp_path)))
    assert found.violations.count() == 0 and found.samples.count() == 5 * len(written)
    again = media.read(spark, str(tmp_path))
    assert again.samples.count() == 5 * len(written)
    with pytest.raises(Exception, match="within the output path"):
        of(spark, {"../x": b""}).write.format("mp4").mode("append").save(str(tmp_path))


def test_delivery_calls_back_in_order(spark, written, tmp_path):
    files = of(spark, {"x": written["H264.faststart"]})
    log = str(tmp_path / "log")

    def handler(row):
        with open(log, "a") as f:
            f.write(f"{row.kind} ")

    payload.deliver(payload.timeline(media.decode(boxes.scan(files)), files), handler)
    with open(log) as f:
        assert f.read().split() == ["video", "video", "audio", "video", "video", "audio", "video", "video"]


def test_empty_inputs(spark, inputs):
    none = of(spark, {})
    found = media.decode(boxes.scan(none))
    assert found.samples.count() == found.tracks.count() == found.violations.count() == 0
    files, wrong = mux.mux(inputs[0].limit(0), inputs[1].limit(0), inputs[2].limit(0))
    assert files.count() == wrong.count() == 0


def test_faststart_grows_to_wide_places():
    sample = {"kind": "audio", "pts": 0, "dts": 0, "duration": 1, "is_key": True, "size": 1, "data": b"a", "no": 1}
    assert mux.build("faststart", [sample], None, AAC).index(b"moov") < mux.build("faststart", [dict(sample)], None, AAC).index(b"mdat")


def test_scan_limits():
    many = b"\0\0\0\x08free" * (boxes.MAX_BOXES + 1)
    with pytest.raises(boxes.Malformed, match="box_count"):
        list(boxes.children(memoryview(many), 0, len(many)))
    moofs = b"\0\0\0\x08moof" * (boxes.MAX_FRAGMENTS + 1)
    with pytest.raises(boxes.Malformed, match="moof_count"):
        list(boxes.children(memoryview(moofs), 0, len(moofs)))
    wide = struct.pack(">I4sQ", 1, b"free", 16) + struct.pack(">I4s", 0, b"mdat") + b"xyz"
    assert [(n, h, t) for _, n, h, t in boxes.children(memoryview(wide), 0, len(wide))] == [(16, 16, "free"), (11, 8, "mdat")]
    with pytest.raises(boxes.Malformed, match="box_too_large"):
        list(boxes.children(memoryview(struct.pack(">I4sQ", 1, b"free", 1 << 63)), 0, 16))


def test_bytes_are_numbered(spark, inputs):
    samples, _ = mux.encode(*inputs, "progressive")
    assert samples.groupBy("file").agg(F.max("physical_no")).collect()[0][1] == 5
