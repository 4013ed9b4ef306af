import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kinotable.functions import binary, codec, timing
from kinotable.sources import mux
from kinotable.sources.boxes import Malformed
from kinotable.sources.config import nal_units, parse_asc


def test_fields(spark):
    data = struct.pack(">IiHB3s4sQ", 4000000000, -5, 65535, 1, b"\x00\x02\x01", b"moov", (1 << 64) - 1)
    row = spark.createDataFrame([(data,)], "b binary").select(
        binary.unsigned("b", 0, 4), binary.signed32("b", 4), binary.unsigned("b", 8, 2), binary.unsigned("b", 10, 1), binary.unsigned("b", 11, 3), binary.fourcc("b", 14), binary.unsigned64("b", 18), binary.unsigned("b", 24, 4), binary.version("b"), binary.flags(F.substring("b", 11, 4))
    ).first()
    assert tuple(row) == (4000000000, -5, 65535, 1, 513, "moov", (1 << 64) - 1, None, 238, 513)


def test_to_bytes_and_box(spark):
    row = spark.range(1).select(binary.to_bytes(F.lit(258), 4), binary.to_bytes(F.lit(-1), 2), binary.box("free", F.lit(b"ab"))).first()
    assert [bytes(x) for x in row] == [b"\0\0\1\2", b"\xff\xff", b"\0\0\0\x0afreeab"]


@pytest.mark.parametrize("timescale", [1, 3, 1000, 44100, 90000, 2**31 - 1])
def test_rounding_is_half_away_from_zero(spark, timescale):
    values = [*range(-40, 41), 9 * 10**11 + 7, -9 * 10**11 - 7, 2**31 * 5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(timing.rounded("v", F.lit(timescale))).collect()]
    exact = [Fraction(v * timing.TICKS, timescale) for v in values]
    assert got == [int(abs(x) + Fraction(1, 2)) * (1 if x >= 0 else -1) for x in exact]


def test_exact_times(spark):
    one = spark.range(1)
    assert one.select(timing.exact_ticks(F.lit(3), F.lit(1000))).first()[0] == 30000
    assert one.select(timing.exact_units(F.lit(400000), F.lit(25))).first()[0] == 1
    for wrong in (timing.exact_ticks(F.lit(1), F.lit(3)), timing.exact_units(F.lit(1), F.lit(25))):
        with pytest.raises(Exception, match="no whole number"):
            one.select(wrong).collect()


def test_nal_types(spark):
    rows = spark.createDataFrame([("H264", b"\x67"), ("H265", b"\x42\x01"), ("H265", b"\x26\x01")], "c string, d binary")
    assert [r[0] for r in rows.select(codec.nal_type(F.col("c"), "d")).collect()] == [7, 33, 19]
    assert [r[0] for r in spark.range(1, 5).select(codec.longest_nal(F.col("id").cast("int"))).collect()] == [255, 65535, 2**24 - 1, 2**32 - 1]


@pytest.mark.parametrize(("rate", "channels", "kind", "data"), [(44100, 2, 2, "1210"), (96000, 7, 1, "0838"), (50000, 2, 2, "178061a810"), (7350, 1, 31, None)])
def test_audio_config(spark, rate, channels, kind, data):
    asc = spark.range(1).select(codec.encode_asc(F.lit(rate), F.lit(channels), F.lit(kind))).first()[0]
    if data:
        assert bytes(asc).hex() == data and parse_asc(bytes(asc)) == (kind, rate, channels)
        parsed = spark.createDataFrame([(asc,)], "a binary").select(codec.parse_asc("a").alias("p"), codec.asc_matches("a", F.lit(rate), F.lit(channels)).alias("m")).first()
        assert (parsed.p.object_type, parsed.p.sample_rate, parsed.p.channel_config, parsed.m) == (kind, rate, channels, True)


@pytest.mark.parametrize("asc", [b"", b"\x12", b"\x12\x00", b"\x16\x90", b"\xff\xff", b"\x17\x80"])
def test_audio_config_malformed(spark, asc):
    with pytest.raises(Malformed):
        parse_asc(asc)
    assert spark.createDataFrame([(asc,)], "a binary").select(codec.parse_asc("a")).first()[0] is None


def test_video_config_rules(spark):
    good = ("H264", None, b"\x67\x42", b"\x68\xce", 4, 16, 16)
    rows = [good, ("H263", *good[1:]), (*good[:4], 5, 16, 16), (*good[:5], 0, 16), (*good[:2], b"\x68", *good[3:]), ("H265", b"\x40\x01", b"\x42\x01", b"\x44\x01", 4, 0, 0), ("H265", None, b"\x42\x01", b"\x44\x01", 4, 0, 0)]
    df = spark.createDataFrame(rows, "codec string, vps binary, sps binary, pps binary, n int, w int, h int")
    got = [r[0] for r in df.select(codec.video_config_violation(*(F.col(c) for c in df.columns))).collect()]
    assert got == [None, "config_codec", "config_length_size", "config_dimensions", "config_sps", None, "config_vps"]


def test_annex_b():
    assert nal_units(b"\x65\x00\x00\x01\x02") == [b"\x65\x00\x00\x01\x02"]
    assert nal_units(b"\0\0\1\x65\1\0\0\0\1\x06\5") == [b"\x65\1", b"\x06\5"]
    assert nal_units(b"\0\0\0\1\x65\0\0\1\x41") == [b"\x65", b"\x41"]
    for broken in (b"\0\0\1", b"\0\0\1\0\0\1\x65", b"\0\0\1\x65\0\0\1"):
        with pytest.raises(Malformed):
            nal_units(broken)


def test_layout_helpers():
    assert mux.fixed(1) == 65536 and mux.fixed(-0.5) == -32768
    assert mux.descriptor(5, bytes(200))[:3] == b"\x05\x81\x48"
    assert mux.runs([5, 5, 7]) == [(2, 5), (1, 7)]
