"""Codec fields as native expressions: NAL types, parameter sets, AudioSpecificConfig."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinotable.functions.binary import unsigned

#: Sampling rates by index; index 15 stands before a 24-bit rate.
RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]

#: NAL types of parameter sets.
PARAMETER_SETS = {"H264": {"sps": 7, "pps": 8}, "H265": {"vps": 32, "sps": 33, "pps": 34}}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nal_type_h264(data: Column | str) -> Column:
    return unsigned(data, 0, 1).bitwiseAND(F.lit(31))


def nal_type_h265(data: Column | str) -> Column:
    return F.shiftright(unsigned(data, 0, 1), 1).bitwiseAND(F.lit(63))


def nal_type(codec: Column | str, data: Column | str) -> Column:
    return F.when(_col(codec) == "H264", nal_type_h264(data)).when(_col(codec) == "H265", nal_type_h265(data))


def longest_nal(length_size: Column | int) -> Column:
    """The longest NAL unit whose length fits 1 to 4 bytes."""
    return F.element_at(F.array(*(F.lit((1 << 8 * k) - 1).cast("bigint") for k in range(1, 5))), F.lit(length_size) if isinstance(length_size, int) else length_size)


def starts_with_code(data: Column | str) -> Column:
    """Whether a start code stands at byte 0, so that the data is Annex B."""
    return F.coalesce(F.hex(F.substring(_col(data), 1, 4)).rlike("^(?:000001|00000001)"), F.lit(False))


def video_config_violation(codec: Column, vps: Column, sps: Column, pps: Column, length_size: Column, width: Column, height: Column) -> Column:
    """First broken rule of a video configuration (parameter sets without start codes), or null."""
    sets = F.lit(None).cast("string")
    for name, data in (("pps", pps), ("sps", sps), ("vps", vps)):
        wanted = F.when(codec == "H264", F.lit(PARAMETER_SETS["H264"].get(name))).otherwise(F.lit(PARAMETER_SETS["H265"][name]))
        bad = F.coalesce(F.octet_length(data) == 0, F.lit(True)) | (nal_type(codec, data) != wanted)
        sets = F.when(wanted.isNotNull() & bad, F.lit(f"config_{name}")).otherwise(sets)
    return (
        F.when(~codec.isin("H264", "H265") | codec.isNull(), F.lit("config_codec"))
        .when(~F.coalesce(length_size.between(1, 4), F.lit(False)), F.lit("config_length_size"))
        .when(~F.coalesce(((width == 0) & (height == 0)) | (width.between(1, 65535) & height.between(1, 65535)), F.lit(False)), F.lit("config_dimensions"))
        .otherwise(sets)
    )


def parse_asc(asc: Column | str) -> Column:
    """struct(object_type, sample_rate, channel_config) of an AudioSpecificConfig; null if it is malformed or unsupported."""
    bits = F.concat(*(F.coalesce(F.lpad(F.bin(unsigned(asc, k, 1)), 8, "0"), F.lit("")) for k in range(8)))
    at = lambda first, n: F.conv(F.nullif(F.substr(bits, F.lit(first) + 1 if isinstance(first, int) else first + 1, F.lit(n)), F.lit("")), 2, 10).cast("int")
    whole = lambda first, n: F.when(F.length(bits) >= first + n, at(first, n))
    escape = at(0, 5) == 31
    kind = F.when(escape, 32 + whole(F.lit(5), 6)).otherwise(at(0, 5))
    p = F.when(escape, 11).otherwise(5)
    index = whole(p, 4)
    rate = F.when(index == 15, whole(p + 4, 24)).otherwise(F.get(F.lit(RATES), index))
    channels = F.when(index == 15, whole(p + 28, 4)).otherwise(whole(p + 4, 4))
    good = (F.octet_length(_col(asc)) >= 2) & kind.between(1, 31) & (rate > 0) & channels.between(1, 7)
    return F.when(good, F.struct(kind.alias("object_type"), rate.alias("sample_rate"), channels.alias("channel_config")))


def encode_asc(sample_rate: Column | str, channel_config: Column | str, object_type: Column | str) -> Column:
    """AudioSpecificConfig bytes; null for values it can't hold."""
    rate, channels, kind = _col(sample_rate), _col(channel_config), _col(object_type)
    bits = lambda v, n: F.lpad(F.bin(v.cast("bigint")), n, "0")
    index = F.array_position(F.lit(RATES), rate.cast("int")) - 1
    text = F.concat(bits(kind, 5), F.when(index >= 0, bits(index, 4)).otherwise(F.concat(F.lit("1111"), bits(rate, 24))), bits(channels, 4))
    whole = F.rpad(text, F.when(index >= 0, 16).otherwise(40), F.lit("0"))
    good = kind.between(1, 31) & channels.between(1, 7) & rate.between(1, (1 << 24) - 1)
    return F.when(good, F.unhex(F.lpad(F.conv(whole, 2, 16), F.when(index >= 0, 4).otherwise(10), F.lit("0"))))


def create_aac_lc(sample_rate: Column | str, channel_config: Column | str) -> Column:
    return encode_asc(sample_rate, channel_config, F.lit(2))


def channels(channel_config: Column | str) -> Column:
    """Channels that a configuration stands for."""
    return F.when(_col(channel_config) == 7, 8).otherwise(_col(channel_config))


def asc_matches(asc: Column | str, sample_rate: Column | str, channel_config: Column | str) -> Column:
    """Whether an AudioSpecificConfig says what was declared."""
    p = parse_asc(asc)
    return F.coalesce((p["sample_rate"] == _col(sample_rate)) & (p["channel_config"] == _col(channel_config)), F.lit(False))
