"""Benchmark decontamination: find every occurrence of a benchmark n-gram in training texts; cut it out or drop the text.

The windows of the benchmark are hashed into sorted arrays that every executor gets. A scan hashes the words of a text,
rolls them into window hashes, looks those up, and compares the words of each hit, so that hash collisions never count.
The number of windows is counted first: a benchmark whose index is larger than `index_bytes` is scanned in blocks that
fit, each pass adding its hits to the rows of the one before. There is no shuffle.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinotable.llm import _text

#: Words of a window; an item with fewer words is one window as a whole.
WINDOW = 10
#: Bytes of the windows' index that one pass may send to the executors, unless one item alone has more; bytes of a window in it.
INDEX_BYTES, WINDOW_BYTES = 64 << 20, 32
#: A text is dropped if at least this share of its words is hit, else its hit spans are cut out.
DROP_SHARE = 0.5

_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ROLL = np.uint64(0xD6E8FEB86659FD93)


class Windows:
    """The windows of some benchmark items for lookups by hash and comparison by words: sorted arrays, by length."""

    def __init__(self, items: pa.Table, window: int = WINDOW):
        self.ids = items.column("item_id").to_pylist()
        data, offsets = _text.utf8(items.column("text").combine_chunks())
        found: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)  # hash, item, first and last byte in `words`
        words, done = [], 0
        for lo, hi in _text.slices(offsets):
            own = offsets[lo : hi + 1]
            low, starts, ends, before = _text.word_bounds(data[own[0] : own[-1]], own - own[0])
            size, n = ends - starts, np.diff(before)
            at = np.concatenate([[0], np.cumsum(size + 1)])  # of the words, with one blank behind each
            joined = low[np.minimum(np.arange(at[-1]) - np.repeat(at[:-1] - starts, size + 1), max(len(low) - 1, 0))] if len(size) else low[:0]
            joined[at[1:] - 1] = 32
            long = np.minimum(n, window)
            for m, h in rolls(_text.word_hashes(low, starts, ends), int(long.max(initial=0))):
                of = np.flatnonzero(long == m)
                if not len(of):
                    continue
                count = n[of] - m + 1
                first = np.repeat(before[of] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                found[m].append((h[first], np.repeat(of + lo, count).astype(np.int32), (at[first] + done).astype(np.int32), (at[first + m] - 1 + done).astype(np.int32)))
            words.append(joined)
            done += len(joined)
        self.words = np.concatenate(words).tobytes() if words else b""
        self.tables, self.seen = {}, {}
        for m, parts in found.items():
            h, item, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((item, h))
            again = np.concatenate([[False], (np.diff(h[order]) == 0) & (np.diff(item[order]) == 0)])
            same = [self.words[begin[x] : end[x]] == self.words[begin[y] : end[y]] for x, y in zip(order[np.flatnonzero(again)], order[np.flatnonzero(again) - 1], strict=True)]
            again[np.flatnonzero(again)] = same  # an item's window counts once
            order = order[~again]
            self.tables[m] = (h[order], item[order], begin[order], end[order])
            seen = np.zeros(1 << max(16, min(24, len(order).bit_length() + 3)), bool)
            seen[h & np.uint64(len(seen) - 1)] = True
            self.seen[m] = seen

    def nbytes(self) -> int:
        return len(self.words) + sum(x.nbytes for t in self.tables.values() for x in t) + sum(x.nbytes for x in self.seen.values())

    def find(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, words, item ids) of each occurrence; `before` has the words before each text."""
        if not self.tables or not len(starts):
            return
        raw = None
        for n, h in rolls(_text.word_hashes(low, starts, ends), max(self.tables)):
            if n not in self.tables or not len(h):
                continue
            seen, (known, item, begin, end) = self.seen[n], self.tables[n]
            at = np.flatnonzero(seen[h & np.uint64(len(seen) - 1)])
            first = np.searchsorted(known, h[at])
            good = known[np.minimum(first, len(known) - 1)] == h[at]
            good &= np.searchsorted(before, at, "right") == np.searchsorted(before, at + n - 1, "right")
            if not good.any():
                continue
            raw = raw or low.tobytes()
            last = np.searchsorted(known, h[at], "right")
            for k, x, y in zip(at[good].tolist(), first[good].tolist(), last[good].tolist(), strict=True):
                key = b" ".join(raw[a:b] for a, b in zip(starts[k : k + n].tolist(), ends[k : k + n].tolist(), strict=True))
                own = {self.ids[item[j]] for j in range(x, y) if self.words[begin[j] : end[j]] == key}
                if own:
                    yield k, n, own - {None}


def rolls(words: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of all runs of 1, 2, ... `most` words."""
    h = words.copy()
    for n in range(1, most + 1):
        if n > 1:
            h = h[:-1] * _ROLL + words[n - 1 :] if len(h) > 1 else h[:0]
        yield n, h


#: Of one text: words, hit words as (first word, words, first byte, end byte) of merged spans, and items found so far.
SCAN = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("word", "words", "byte", "end_byte")]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanner(block, carry: bool):
    """mapInArrow function; `carry`: rows bring hits of earlier blocks and keep their text for the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = block.value
        for batch in _text.parts(batches):
            data, offsets = _text.utf8(batch.column("text"))
            n_words = np.zeros(batch.num_rows, np.int64)
            ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
            items: dict[int, set[str]] = defaultdict(set)
            where: dict[int, list[tuple[int, int, int, int]]] = {}
            if carry:
                for k, (spans, ids) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                    if spans:
                        ranges[k], items[k] = [(s["word"], s["word"] + s["words"]) for s in spans], set(ids)
            for lo, hi in _text.slices(offsets):
                own = offsets[lo : hi + 1]
                low, starts, ends, before = _text.word_bounds(data[own[0] : own[-1]], own - own[0])
                n_words[lo:hi] = np.diff(before)
                for k, n, ids in windows.find(low, starts, ends, before):
                    doc = int(np.searchsorted(before, k, "right")) - 1
                    ranges[lo + doc].append((k - int(before[doc]), k - int(before[doc]) + n))
                    items[lo + doc] |= ids
                for doc in range(lo, hi) if ranges else ():
                    if doc in ranges:
                        base, zero = int(before[doc - lo]), int(own[doc - lo] - own[0])
                        where[doc] = [(a, b - a, int(starts[base + a]) - zero, int(ends[base + b - 1]) - zero) for a, b in _merged(ranges[doc])]
            cols = {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(n_words),
                "spans": pa.array([[dict(zip(("word", "words", "byte", "end_byte"), s, strict=True)) for s in where.get(k, ())] for k in range(batch.num_rows)], pa.list_(pa.struct([(x, pa.int64()) for x in ("word", "words", "byte", "end_byte")]))),
                "items": pa.array([sorted(items.get(k, ())) for k in range(batch.num_rows)], pa.list_(pa.string())),
            }
            rest = [x for x in batch.schema.names if x not in cols]
            yield pa.RecordBatch.from_arrays([*cols.values(), *(batch.column(x) for x in rest)], [*cols, *rest])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, index_bytes: int = INDEX_BYTES, keep: list[str] = ()) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, merged hit spans and the sorted ids of items found; `keep`: columns to return beside, none of which may be named as one of those (an error).

    benchmark(item_id, text). A null or empty text has no words and no hits; so has a null or empty item. Items with a
    null id count for spans, not as items. Repeated items add nothing, repeated documents each get their row. Extra
    columns are ignored. Ids of items are strings in the result.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    total = bench.agg(F.sum(F.regexp_count("text", F.lit(_ANY_WORD)))).first()[0] or 0
    blocks = max(1, -(-total * WINDOW_BYTES // index_bytes))
    if clash := {*keep} & {*SCAN.names}:
        raise ValueError(f"names that scan() returns itself: {sorted(clash)}")
    rows = docs.select("doc_id", "text", *keep)
    for k in range(blocks):
        own = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast(Windows(own.distinct().toArrow(), window))
        last = k == blocks - 1
        fields = [*SCAN.fields, *(f for f in rows.schema.fields if f.name in keep or f.name == "text")]
        rows = rows.mapInArrow(_scanner(block, k > 0), T.StructType(fields))
        if not last:
            rows = _text.settled(rows)
    return rows if "text" in keep else rows.drop("text")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from scan()."""
    hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"]), F.lit(0).cast("long"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_share: float = DROP_SHARE) -> DataFrame:
    """docs without benchmark passages: hit spans are cut out of texts, and texts with at least `drop_share` of their words hit go. Other rows, nulls included, stay as they are, repeated ones each; an empty table stays empty. The columns stay, and n_chars follows the text if it is there."""
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*names).alias("row"))
    found = scan(packed, benchmark, window, keep=["row"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    raw = F.encode(F.col("row")["text"], "UTF-8")
    # the bytes between spans, with a line break where a span was
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("spans")["end_byte"])
    starts = F.concat(F.col("spans")["byte"], F.array(F.octet_length(raw).cast("long")))
    parts = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.decode(F.substring(raw, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")), "UTF-8"))
    text = F.when(F.size("spans") == 0, F.col("row")["text"]).otherwise(F.array_join(parts, "\n"))
    out = found.where((F.size("spans") == 0) | (hit < drop_share * F.col("n_words"))).select(text.alias("text"), "row", (F.size("spans") > 0).alias("cut"))
    return out.select(*(F.col("text") if n == "text" else F.when(F.col("cut"), F.length("text").cast(docs.schema[n].dataType)).otherwise(F.col("row")[n]).alias(n) if n == "n_chars" else F.col("row")[n].alias(n) for n in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(_text.table(spark, sf_dir, "documents"), _text.table(spark, sf_dir, "benchmark")))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
grams AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r, k, g.n, item_id FROM grams g JOIN windows v ON g.g = v.g AND g.n = v.n),
words AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS i FROM hits) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""


def brute(items: list[tuple[str, str | None]], texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """n_words, n_hit, n_items and items_sha256 by plain comparison, for tests."""
    import regex

    words = lambda t: regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for item, b in items:
            v = words(b)
            n = min(window, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    ids.add(str(item))
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return out
