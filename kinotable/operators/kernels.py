"""The relational kernels of media tables, on any DataFrame with fitting columns.

All take the names of key columns (what is independent, such as a file and a track) and of order columns, which must
order the rows of a key in full for a defined result. Each kernel is one window partitioning or less; those on equal keys
share their shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _over(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def exclusive_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds the sum of `value` over the rows before: decode times from durations, places in a chunk from sizes."""
    before = _over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("bigint"))


def as_of(rows: DataFrame, runs: DataFrame, keys: list[str], at: str, first: str, values: list[str]) -> DataFrame:
    """Adds to each row the `values` of the last run of its keys with first <= at; null if there is none. Runs of a key must differ in `first`."""
    left = rows.withColumn("__row", F.lit(1)).withColumn("__at", F.col(at).cast("bigint"))
    right = runs.select(*keys, F.col(first).cast("bigint").alias("__at"), F.lit(0).alias("__row"), F.struct(*values).alias("__run"))
    both = left.unionByName(right, allowMissingColumns=True)
    run = F.last("__run", ignorenulls=True).over(_over(keys, ["__at", "__row"]).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__found", run).where("__row = 1")
    return found.select(*rows.columns, *(F.col("__found")[v].alias(v) for v in values))


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Keys, run_no (from 1), run_length and `value` of the runs of equal neighbours."""
    w = _over(keys, order)
    new = df.withColumn("__new", F.when(F.lag(F.struct(value)).over(w).eqNullSafe(F.struct(value)), 0).otherwise(1))
    marked = new.withColumn("run_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    return marked.groupBy(*keys, "run_no").agg(F.count("*").alias("run_length"), F.first(value).alias(value))


def expand_runs(runs: DataFrame, length: str, out: str) -> DataFrame:
    """Each row as often as its length says, with its number (from 0) in `out`."""
    return runs.where(F.col(length) > 0).withColumn(out, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(length).cast("bigint") - 1)))


def sync_mark(samples: DataFrame, sync: DataFrame, keys: list[str], number: str, out: str) -> DataFrame:
    """Adds whether a sample is a sync sample: all are where a key has no list, else those listed; repeats in the list count once."""
    listed = sync.select(*keys, number).distinct().withColumn("__hit", F.lit(True))
    having = sync.select(*keys).distinct().withColumn("__list", F.lit(True))
    joined = samples.join(listed, [*keys, number], "left").join(having, keys, "left")
    return joined.select(*samples.columns, (F.col("__list").isNull() | F.col("__hit").isNotNull()).alias(out))


def resolve(own: Column, fragment: Column, track: Column) -> Column:
    """A sample's value: its own, else its fragment's, else its track's, where 0 counts as none."""
    return F.coalesce(own, fragment, F.nullif(track, F.lit(0)))


def resolve_flags(own: Column, first: Column, index: Column, fragment: Column, track: Column) -> Column:
    """A sample's flags: its own, else the run's first-sample flags if it is the first, else its fragment's, else its track's, where 0 is a value."""
    return F.coalesce(own, F.when(index == 0, first), fragment, track)


def is_key(flags: Column) -> Column:
    """Whether sample flags leave the non-sync bit clear."""
    return flags.bitwiseAND(F.lit(0x00010000)) == 0


def overlaps(ranges: DataFrame, keys: list[str], start: str, end: str, tie: list[str]) -> DataFrame:
    """The ranges that begin before one that begins earlier has ended, with prior_end."""
    before = _over(keys, [start, *tie]).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("prior_end", F.max(end).over(before)).where(F.col(start) < F.col("prior_end"))


def regressions(df: DataFrame, keys: list[str], order: list[str], value: str, strict: bool = False) -> DataFrame:
    """Rows whose `value` is less than that of the row before (or equal, if it must increase strictly), with prior_value."""
    rows = df.withColumn("prior_value", F.lag(value).over(_over(keys, order)))
    return rows.where(F.col(value) <= F.col("prior_value") if strict else F.col(value) < F.col("prior_value"))


def merge_tracks(samples: DataFrame, keys: list[str], kind: str, dts: str, timescale: str, ties: list[str], out: str = "delivery_no") -> DataFrame:
    """Numbers the rows of each key in decode order across tracks, from 1; video goes first at equal times.

    Times are compared exactly, as dts times the other track's timescale. A key has at most two tracks.
    """
    whole = Window.partitionBy(*keys)
    rank = F.when(F.col(kind) == "video", 0).otherwise(1)
    rows = samples.withColumn("__v", F.max(F.when(F.col(kind) == "video", F.col(timescale))).over(whole)).withColumn("__a", F.max(F.when(F.col(kind) != "video", F.col(timescale))).over(whole))
    other = F.coalesce(F.when(F.col(kind) == "video", F.col("__a")).otherwise(F.col("__v")), F.lit(1))
    rows = rows.withColumn("__t", F.col(dts).cast("decimal(20,0)") * other.cast("decimal(10,0)"))
    return rows.withColumn(out, F.row_number().over(_over(keys, ["__t", rank, *ties]))).drop("__v", "__a", "__t")


def access_units(nals: DataFrame, keys: list[str], order: list[str], pts: str = "pts", dts: str = "dts") -> DataFrame:
    """Adds au_no (from 1): neighbours with equal pts and dts are one access unit."""
    w = _over(keys, order)
    new = F.when((F.col(pts) == F.lag(pts).over(w)) & (F.col(dts) == F.lag(dts).over(w)), 0).otherwise(1)
    return nals.withColumn("__new", new).withColumn("au_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("__new")


def fragments(samples: DataFrame, keys: list[str], dts: str, key_frame: Column, tie: list[str], out: str = "fragment_id") -> DataFrame:
    """Adds the fragment of each sample: the number of distinct decode times of key frames up to its own, at least 1.

    Samples at a key frame's time are in its fragment, so the frame is by range, not by rows.
    """
    rows = samples.withColumn("__key", key_frame)
    first = Window.partitionBy(*keys, dts).orderBy(F.desc("__key"), *tie)
    rows = rows.withColumn("__n", F.when(F.col("__key") & (F.row_number().over(first) == 1), 1).otherwise(0))
    upto = Window.partitionBy(*keys).orderBy(dts).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.greatest(F.lit(1), F.sum("__n").over(upto)).cast("bigint")).drop("__key", "__n")


def physical_order(units: DataFrame, keys: list[str], submitted: str, kind: Column, out: str = "physical_no") -> DataFrame:
    """Numbers samples (video as access units) in the order their bytes are written, from 1: audio at once, video when the next video unit or the end comes."""
    rows = units.withColumn("__video", F.when(kind == "video", 1).otherwise(0))
    following = F.lead(submitted).over(Window.partitionBy(*keys, "__video").orderBy(submitted))
    at = F.when(F.col("__video") == 1, F.coalesce(following, F.lit((1 << 63) - 1))).otherwise(F.col(submitted))
    rows = rows.withColumn("__at", at)
    return rows.withColumn(out, F.row_number().over(_over(keys, ["__at", F.desc("__video"), submitted]))).drop("__at", "__video")


def track_duration(samples: DataFrame, keys: list[str], dts: str, duration: str, out: str = "track_duration") -> DataFrame:
    """End of the sample that ends last, of each key."""
    return samples.groupBy(*keys).agg(F.max(F.col(dts) + F.col(duration)).alias(out))
