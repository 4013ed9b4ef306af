"""SimHash near-duplicates by multi-index hashing.

Each text gets a 64-bit fingerprint of its word shingles. Equal fingerprints are one node from then on, so a group of
copies of any size costs one row. The 64 bits are cut into segments, each with a radius; the radii are such that two
fingerprints within the full distance are within the radius of some segment (they add up to distance - segments + 1).
Every fingerprint asks, for each segment, for all values in the Hamming ball around its own, and what the join finds is
verified on all bits inside the join, so only true links come out of it, each once. How many segments there are follows
from the number of fingerprints: few wide segments mean more values asked for and fewer rows per value. Every choice
finds every link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinotable.llm import _text

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Of the wider groups of near_duplicates(): least similarity, and words of a shingle.
NEAR_SIMILARITY, NEAR_SHINGLE = 0.8, 5
#: Texts by which frequent shingles are told, and how many of these at most; both only order the search.
SAMPLE, FREQUENT = 20_000, 1 << 19
#: Texts that search by a key beyond which it counts as frequent, though the sample doesn't tell.
CROWD = 100
#: Edges that one task joins.
EDGES = 1 << 20
#: Comparisons of two fingerprints that take as long as a row of the join.
COMPARISONS = 50
#: Ids that may be broadcast.
BROADCAST_IDS = 250_000
#: Bits by which tasks are told which texts are asked for: of each id, and in all (as a power of two).
ASKED_BITS, MOST_BITS = 64, 28
#: Bits of the sketches by which a join tells pairs apart.
SHORT_BITS = 512
#: Pairs with one text that are compared in one place.
TOGETHER = 200
#: Bytes of words: all but blanks.
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
_ROLL = np.uint64(0x9FB21C651E98DF25)
#: Text bytes that are shingled at once; the words at the seams are carried over.
CHUNK = 4 << 20


def _chunks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in parts of bounded size."""
    if len(text) <= CHUNK:
        yield text.lower().split()
        return
    rest = b""
    for at in range(0, len(text), CHUNK):
        part = rest + text[at : at + CHUNK].lower()
        words = part.split()
        open_end = at + CHUNK < len(text) and words and not part[-1:].isspace()
        rest = words.pop() if open_end else b""
        yield words
    if rest:
        yield [rest]


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bit k is 1 if more than half of the shingles' XXH64 have it. Null and blank texts have fingerprint 0."""
    ones, total, last, short = np.zeros(64, np.int64), 0, [], []
    for words in _chunks(text or b""):
        w = last + words
        grams = list(map(b" ".join, zip(*(w[k:] for k in range(shingle)))))
        last = w[-(shingle - 1) :] if shingle > 1 else []
        short = w if len(w) < shingle else short
        if grams:
            h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), "<u8", len(grams))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(grams)
    if not total and short:
        return xxhash.xxh64_intdigest(b" ".join(short), SEED)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little") if total else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.parts(batches):
            texts = batch.column("text").cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segments(n: int, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, radius) of each segment: of the ways to cut, the one with the least work for n fingerprints, counting a row asked for or held as COMPARISONS comparisons."""
    ways = []
    for m in range(min(2, distance + 1), min(4, max(2, distance)) + 1):
        spare = distance - m + 1
        widths = [64 // m + (k < 64 % m) for k in range(m)]
        radii = [spare // m + (k < spare % m) for k in range(m)]
        asked, held = ([sum(comb(w, k) for k in range(half + 1)) for w, half in zip(widths, halves, strict=True)] for halves in zip(*map(_halves, radii), strict=True))
        work = n * (sum(asked) + sum(held)) * COMPARISONS + sum(n * n * a * h / 2**w for w, a, h in zip(widths, asked, held, strict=True))
        ways.append((work, [(sum(widths[:k]), widths[k], radii[k]) for k in range(m)]))
    return min(ways)[1]


def _halves(radius: int) -> tuple[int, int]:
    """Radii of the balls around the values asked for and around those in the table."""
    return (radius + 1) // 2, radius // 2


def ball(width: int, radius: int) -> list[int]:
    """Masks of at most `radius` of `width` bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _part(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else fp


def _ways(cut: list[tuple[int, int, int]], side: int) -> Column:
    """Where a fingerprint in column fp looks (side 0) or lies (side 1): segment and value."""

    def keys(k: int, low: int, width: int, radius: int) -> Column:
        masks = F.lit(ball(width, _halves(radius)[side])).cast("array<bigint>")
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("s"), _part(F.col("fp"), low, width).bitwiseXOR(m).alias("key")))

    return F.concat(*(keys(k, *x) for k, x in enumerate(cut)))


def _once(cut: list[tuple[int, int, int]], u: Column, v: Column, at: Column) -> Column:
    """Whether a pair counts where it was met: in the first segment that has it, at the value between the two that has the lowest of the differing bits on the asking side."""
    diff, earlier, here = u.bitwiseXOR(v), F.lit(False), F.lit(False)
    for k, (low, width, radius) in enumerate(cut):
        own, between, rest = _part(diff, low, width), F.lit(0).cast("bigint"), _part(diff, low, width)
        for _ in range(_halves(radius)[0]):
            lowest = rest.bitwiseAND(-rest)
            between, rest = between.bitwiseOR(lowest), rest.bitwiseXOR(lowest)
        here = here | ((at["s"] == k) & ~earlier & (at["key"].bitwiseXOR(_part(u, low, width)) == between))
        earlier = earlier | (F.bit_count(own) <= radius)
    return here


def _near(u: Column, v: Column, distance: int) -> Column:
    return F.bit_count(u.bitwiseXOR(v)) <= distance


def links(fps: DataFrame, distance: int = DISTANCE, cut: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Pairs u < v of the distinct fingerprints in column fp that differ in at most `distance` bits, each once; with a column label, only pairs of two labels.

    A segment's radius is met half way: both sides list a ball, that of the table being the smaller one. A fingerprint
    doesn't ask where all that lies there has its own label.
    """
    cut = cut or segments(fps.count(), distance)
    labelled = "label" in fps.columns
    names = ["fp", "label"] if labelled else ["fp"]
    asked, held = (fps.select(*names, F.explode(_ways(cut, side)).alias("at")) for side in (0, 1))
    if labelled:
        there = held.groupBy("at").agg(F.min("label").alias("least"), F.max("label").alias("most"))
        asked = asked.join(there, "at").where("least <> label OR most <> label")
    p, t = asked.alias("p"), held.alias("t")
    u, v = F.col("p.fp"), F.col("t.fp")
    pair = (F.col("p.at") == F.col("t.at")) & (u < v) & _near(u, v, distance) & _once(cut, u, v, F.col("p.at"))
    if labelled:
        pair = pair & (F.col("p.label") != F.col("t.label"))
    return p.join(t, pair).select(u.alias("u"), v.alias("v"))


def heads(fps: DataFrame, distance: int, cut: list[tuple[int, int, int]]) -> DataFrame:
    """Pairs (u, v) of fingerprints within the distance where v is the least or largest of those that lie where u asks: a few for each, however dense a group is."""
    asked, held = (fps.select("fp", F.explode(_ways(cut, side)).alias("at")) for side in (0, 1))
    ends = held.groupBy("at").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))

    def linked(u: str, v: str) -> Column:
        return (F.col(u) != F.col(v)) & _near(F.col(u), F.col(v), distance)

    # told in the join, as most of those that meet in a bucket are far apart in the other bits
    met = asked.join(ends, "at").where(linked("fp", "a") | linked("fp", "b"))
    return met.select(F.col("fp").alias("u"), F.explode(F.array_distinct(F.array("a", "b"))).alias("v")).where(linked("u", "v")).distinct()


def groups(fps: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """u and the smallest fingerprint v that links reach from it, for all of the n distinct fingerprints in column fp but those smallest ones.

    Fingerprints are joined to the ends of the buckets they ask first. The full search then lists links between what is
    not yet in one group only, so that a dense group of m fingerprints gives some multiple of m rows, not of m * m. The
    components are the same: a link inside a group adds nothing.
    """
    cut = segments(n, distance)
    roots = stars(heads(fps, distance, cut))
    named = fps.join(roots, F.col("fp") == F.col("u"), "left").select("fp", F.coalesce("v", "fp").alias("label"))
    more = links(_text.settled(named), distance, cut)
    return stars(roots.unionByName(more))


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges that aren't the smallest of their component, and the smallest of each."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    rest = np.flatnonzero(label != np.arange(len(ids)))
    return ids[rest], ids[label[rest]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars, in bounded steps: no more edges than nodes are left."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        if sum(len(u) for u, _ in held) > 2 * EDGES:
            u, v = _roots(*map(np.concatenate, zip(*held, strict=True)))
            if len(u) > EDGES:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                held = []
            else:
                held = [(u, v)]
    if held:
        u, v = _roots(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def stars(edges: DataFrame, at_once: int = EDGES) -> DataFrame:
    """u and the smallest node v reachable from it, for all nodes of edges(u, v) but those smallest ones.

    Each task makes stars of its own edges. If at most `at_once` edges are left, one task joins them; else alternating
    large-star and small-star steps go on, with a contraction by each task in every round. Each round is written to the
    shared folder, and the writing tasks count what is left.
    """
    kind = "u long, v long"
    now, n = _text.counted(edges.select("u", "v").where("u <> v").mapInArrow(_contracted, kind))
    while n > at_once:
        roles = now.select(F.col("u").alias("x"), F.lit(1).alias("down")).union(now.select(F.col("v").alias("x"), F.lit(0).alias("down")))
        # done if every node has one edge to a smaller one, or none and only edges from larger ones
        if not roles.groupBy("x").agg(F.sum("down").alias("down"), F.count("*").alias("n")).where("down > 1 OR down = 1 AND n > 1").limit(1).count():
            return now
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now, n = _text.counted(small.where("u <> v").distinct().mapInArrow(_contracted, kind))
    return _text.settled(now.coalesce(1).mapInArrow(_contracted, kind)) if n else now


def components(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id of each row of docs(doc_id, text).

    component_id is the smallest doc_id that links reach from the row, its own included. Null and blank texts have
    fingerprint 0 and link like others. A null doc_id is never the smallest; a component of only such rows has a null
    id. Repeated rows each get their row; an empty table gives none. Extra columns are ignored.
    """
    fps = _text.settled(fingerprints(docs, shingle))
    nodes, n = _text.counted(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = groups(nodes.select("fp"), n, distance)
    named = nodes.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "rep", F.coalesce("v", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = named.join(best, "root").select("fp", "component_id")
    return fps.join(_text.settled(ids), "fp").select("doc_id", "fp", "component_id")


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = NEAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of `size` words of some texts, one text behind the other, and where each text's begin and end. A text of fewer words has the one of all its words; a blank one has one too."""
    low, starts, ends, before = _text.word_bounds(data, offsets, _SOLID)
    words, n = _text.word_hashes(low, starts, ends), np.diff(before)
    made = np.maximum(n - size + 1, 1)
    at = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(at[-1], np.uint64)
    inside = np.arange(at[-1]) - np.repeat(at[:-1], made)  # of each shingle, its number in the text
    first, last = np.repeat(before[:-1], made) + inside, np.repeat(before[1:], made)
    for k in range(size):
        here = first + k
        good = here < last
        out[good] = out[good] * _ROLL + words[here[good]]
    return _text.mixed(out + np.repeat(np.minimum(n, size), made).astype(np.uint64)), at


def _slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As shingles(), a bounded number of texts at a time."""
    data, offsets = _text.utf8(column)
    for lo, hi in _text.slices(offsets):
        own = offsets[lo : hi + 1]
        yield shingles(data[own[0] : own[-1]], own - own[0])


def _sets(column: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
    """Of each text the sorted hashes of its distinct shingles and the SimHash of all its shingles."""
    for grams, at in _slices(column):
        ones = np.add.reduceat(np.unpackbits(grams.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), at[:-1], axis=0, dtype=np.int32)
        fps = np.packbits(2 * ones > np.diff(at)[:, None], axis=1, bitorder="little").view("<u8").ravel()
        for k in range(len(at) - 1):
            yield np.unique(grams[at[k] : at[k + 1]]), int(fps[k])


def _node(grams: np.ndarray) -> int:
    """A text's node: the hash of its shingle set, as a long."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), SEED)).view(np.int64))


def _sketch(grams: np.ndarray, m: int | None = None) -> bytes:
    """A bit for each remainder of the set's hashes by a power of two (m, else at least as many as hashes): whether an odd number has it."""
    m = m or 64 << max(0, ceil(len(grams) / 64) - 1).bit_length()
    return np.packbits(np.bincount((grams & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1, bitorder="little").tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """The least number of hashes that only one of the sets with these sketches can have: each makes one bit differ, or takes a difference back."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def _least(n: int, similarity: float) -> int:
    """Shingles that a set of n shares at least with one that is similar to it."""
    return max(1, ceil(similarity * n - 1e-9))


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about SAMPLE distinct texts have, sorted, and in how many of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.parts(batches):
            for grams, _ in _sets(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    share = F.lit(int(SAMPLE / max(SAMPLE, texts.count()) * (1 << 30)))
    some = texts.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)) < share).dropDuplicates(["text"])
    with _text.tidy(texts.sparkSession):
        found = some.select("text").mapInArrow(run, "gram long").groupBy("gram").count().where("count > 1").orderBy(F.desc("count"), "gram").limit(FREQUENT).toArrow()
    grams, counts = found.column("gram").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(grams)
    return grams[order], counts[order]


_KEYED = "doc_id long, t long, fp long, node long, n int, usual float, sketch binary, short array<long>, keys array<long>"


def _keying(spark: SparkSession, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> Callable:
    """mapInArrow function of _keyed(), from rows (doc_id, t, text)."""
    sent = spark.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        for batch in _text.parts(batches):
            fps, nodes, sizes, usual, sketches, short, keys = [], [], [], [], [], [], []
            for grams, fp in _sets(batch.column("text")):
                at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
                often = np.where(known[at] == grams, counts[at], 0) if len(known) else np.zeros(len(grams), np.int64)
                first = np.argsort(often, kind="stable")[: len(grams) - _least(len(grams), similarity) + 1]
                fps.append(fp)
                nodes.append(_node(grams))
                sizes.append(len(grams))
                usual.append(float(often.mean()))
                sketches.append(_sketch(grams))
                short.append(np.frombuffer(_sketch(grams, SHORT_BITS), "<i8"))
                keys.append(grams[first].view(np.int64))
            columns = [batch.column("doc_id"), batch.column("t"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(usual, pa.float32()), pa.array(sketches, pa.binary()), pa.array(short, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "fp", "node", "n", "usual", "sketch", "short", "keys"])

    return run


def _keyed(texts: DataFrame, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, t (a hash of the text), fp, node, n (the size of its shingle set), usual, sketch, short (a sketch of SHORT_BITS) and keys of each row of texts(doc_id, text).

    Keys are the first shingles of the set, rare ones first, so many that two similar sets have one in common: n less the
    least number of shared shingles, and one more. Any order that is the same for all texts finds every pair; this one
    leaves what many texts share to those that hold little else. usual: how frequent the text's shingles are on average;
    of near copies, those with the fewest changes have the most. frequent: frequent shingles, sorted, and how frequent.
    """
    run = _keying(texts.sparkSession, similarity, frequent)
    return texts.withColumn("t", F.xxhash64("text")).select("doc_id", "t", "text").mapInArrow(run, _KEYED)


def _uncrowded(nodes: DataFrame, texts: DataFrame, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """nodes, and (key, count) of the keys that several of them have, when no more than CROWD nodes search by a key that `frequent` lacks, as far as FREQUENT such keys go.

    A crowded key moves behind all that nothing is known of and before those of the sample, in the order of all texts.
    It only moves back, so a text that doesn't search by it keeps its keys; the others get theirs anew. The order stays
    one for all texts, so every pair is still found. What takes a crowded key's place may be crowded in turn: hence rounds.
    """
    grams, counts = frequent[0], frequent[1].astype(np.float64)
    room, given = FREQUENT, nodes
    while True:
        held = _text.settled(nodes.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 1"))
        known = nodes.sparkSession.createDataFrame(pa.table({"key": grams.view(np.int64)}))
        crowd = held.where(F.col("count") > CROWD).join(F.broadcast(known), "key", "left_anti")
        with _text.tidy(nodes.sparkSession):
            found = crowd.orderBy(F.desc("count"), "key").limit(room).toArrow() if room else None
        if not found:
            return nodes, held
        _text.forgotten(held)
        room -= found.num_rows
        grams = np.concatenate([grams, found.column("key").to_numpy().view(np.uint64)])
        counts = np.concatenate([counts, 1 + found.column("count").to_numpy() / (1 << 53)])
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
        moved = nodes.sparkSession.createDataFrame(found.select(["key"]))
        asked, n = _text.counted(nodes.select("t", F.explode("keys").alias("key")).join(F.broadcast(moved), "key", "left_semi").select("t").distinct())
        rows = texts.select("doc_id", "text", F.xxhash64("text").alias("id"), F.xxhash64("text").alias("t"))
        keys = _asked(rows, asked, n, _keying(nodes.sparkSession, similarity, (grams, counts)), _KEYED).groupBy("node", "t").agg(F.min("keys").alias("other"))
        old, nodes = nodes, _text.settled(nodes.join(keys, ["node", "t"], "left").withColumn("keys", F.coalesce("other", "keys")).drop("other"))
        _text.forgotten(asked)
        if old is not given:
            _text.forgotten(old)


def _few(ids: DataFrame, n: int) -> DataFrame:
    """The n ids, marked for a broadcast if they are few."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def _asked(rows: DataFrame, ids: DataFrame, n: int, then: Callable | None = None, kind: str | None = None) -> DataFrame:
    """The rows(id, ...) whose id, a hash, is one of the n in the one column of ids, and some others: one in ASKED_BITS, more as ids come near to 2**MOST_BITS. A bit for each first part of an id goes to every task, so that rows aren't shuffled. Equal ids are one row of those that a task sees. then: a mapInArrow function that makes rows of `kind` of these in the same worker; two such steps, one behind the other, take two workers in each task."""
    width = min(max((ASKED_BITS * n).bit_length(), 15), MOST_BITS)
    place = ids.select(F.shiftrightunsigned(ids.columns[0], 64 - width).alias("p")).select(F.shiftright("p", 15).alias("at"), F.col("p").bitwiseAND(F.lit(32767).cast("bigint")).alias("p"))
    with _text.tidy(rows.sparkSession):
        parts = place.repartition("at").groupBy("at").agg(F.bitmap_construct_agg("p").alias("bits")).toArrow()
    bits = np.zeros((1 << (width - 15), 4096), np.uint8)
    for at, part in zip(parts.column("at").to_pylist(), parts.column("bits").to_pylist(), strict=True):
        bits[at] = np.frombuffer(part, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(bits.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, seen = sent.value, set()
        for batch in _text.parts(batches):
            own = batch.column("id").to_numpy()
            at = own.view(np.uint64) >> np.uint64(64 - width)
            good = np.flatnonzero(told[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            good = [k for k in good.tolist() if (x := int(own[k])) not in seen and not seen.add(x)]
            if good:
                yield batch.take(pa.array(good, pa.int64()))

    return rows.mapInArrow((lambda batches: then(run(batches))) if then else run, kind or rows.schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd, a third of what their shingles take."""
    for batch in _text.parts(batches):
        texts = batch.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
        packed = [pa.compress(x, "zstd", asbytes=True) for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(packed, pa.large_binary())], ["id", "size", "text"])


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) but those whose sketches show that the sets aren't similar."""
    own = nodes.select("node", "n", "sketch")
    both = pairs.join(own.toDF("u", "n", "a"), "u").join(own.toDF("v", "m", "b"), "v").select("u", "v", (F.col("n") + F.col("m")).alias("n"), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.parts(batches):
            most = batch.column("n").to_numpy() * ((1 - similarity) / (1 + similarity)) + 1e-6
            least = list(map(_apart, batch.column("a").to_pylist(), batch.column("b").to_pylist()))
            yield batch.select(["u", "v"]).filter(pa.array(np.array(least, np.int64) <= most))

    return both.mapInArrow(run, "u long, v long")


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose texts have Jaccard similarity of at least `similarity` on sets of NEAR_SHINGLE words.

    What sketches leave is compared by the texts themselves. A pair meets at that of its two nodes that has more pairs,
    so a text goes to few places; a place has about TOGETHER pairs.
    """
    pairs = _text.settled(_possible(pairs, nodes, similarity))
    degrees = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").count()
    both = pairs.join(degrees.toDF("u", "d"), "u").join(degrees.toDF("v", "e"), "v")
    home, far = (F.when((F.col("d") >= F.col("e")) == first, F.col("u")).otherwise(F.col("v")) for first in (True, False))
    part = F.pmod(F.xxhash64("far"), F.ceil(F.col("most") / TOGETHER))
    both = both.select(home.alias("home"), far.alias("far"), F.greatest("d", "e").alias("most")).select("home", "far", part.alias("part"))
    places = both.select("home", "part", F.explode(F.array("home", "far")).alias("node")).distinct()
    places, n = _text.counted(places.join(nodes.select("node", F.col("own").alias("id")), "node"))
    if not n:
        return pairs
    rows = texts.select("text", F.xxhash64("doc_id", F.xxhash64("text")).alias("id"))
    sent = _asked(rows, places.select("id"), n, _packed, "id long, size long, text binary")
    there = sent.join(F.broadcast(places) if 4 * n <= BROADCAST_IDS else places, "id")
    there = there.select("home", "part", "node", "size", "text").repartition("home", "part").sortWithinPartitions("home", "part", F.col("node") != F.col("home"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one = None, None
        for batch in _text.parts(batches, 100):
            found, columns = [], [batch.column(x).to_pylist() for x in ("home", "node", "size", "text")]
            texts = [pa.decompress(x, size, "zstd", asbytes=True) for size, x in zip(*columns[2:], strict=True)]
            sets = (np.unique(grams[a:b]) for grams, at in _slices(pa.array(texts, pa.large_binary()).view(pa.large_string())) for a, b in zip(at, at[1:], strict=False))
            for home, node, other in zip(*columns[:2], sets, strict=True):
                if _node(other) != node:
                    continue  # another text with the same hash
                if node == home:
                    now, one = home, other
                elif now == home:
                    shared = len(np.intersect1d(one, other, assume_unique=True))
                    if shared >= similarity * (len(one) + len(other) - shared) - 1e-9:
                        found.append((min(home, node), max(home, node)))
            u, v = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return there.mapInArrow(run, "u long, v long")


def _grouped(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, node) of each row of docs(doc_id, text), and (node, doc_id, t) of the row that stands for the group of each node: the smallest doc_id, then the smallest t; null if the group has no doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = _frequent(texts)
    rows = _text.settled(_keyed(texts, similarity, frequent))
    rep, own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t")), F.xxhash64("doc_id", "t")
    given, n = _text.counted(rows.groupBy("node").agg(F.min("t").alias("t"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("usual").alias("usual"), F.min("sketch").alias("sketch"), F.min("short").alias("short"), F.min("keys").alias("keys"), F.min(rep).alias("rep"), F.min(own).alias("own")))
    keyed, rows = rows, _text.settled(rows.select("doc_id", "t", "node"))
    _text.forgotten(keyed)

    def can(n: Column, at: Column, m: Column, other: Column) -> Column:
        """Whether sets of n and m that share a key at these places, but none before, can be similar."""
        return F.least(n - at, m - other) >= similarity / (1 + similarity) * (n + m) - 1e-6

    # keys that one node alone has lead nowhere
    keyed, shared = _uncrowded(given, texts, similarity, frequent)
    every = keyed.select("node", "n", "usual", F.posexplode("keys").alias("at", "key"))
    members = _text.settled(every.join(shared.select("key"), "key").select("key", "node", "n", "usual", "at"))
    nodes = _text.settled(keyed.drop("keys"))
    for done in (given, keyed, shared):
        _text.forgotten(done)

    # first, each node and the most usual nodes that it meets: by fingerprints, and by keys
    cut = segments(n)
    asked, held = (nodes.select("node", "fp", "usual", F.explode(_ways(cut, side)).alias("at")) for side in (0, 1))
    heads = held.groupBy("at").agg(F.max(F.struct("usual", "node", "fp")).alias("head"))
    close = asked.join(heads, "at").where((F.col("node") != F.col("head.node")) & _near(F.col("fp"), F.col("head.fp"), DISTANCE)).select("node", "head.usual", F.col("head.node").alias("v"), F.lit(1).alias("kind"))
    heads = members.groupBy("key").agg(F.max(F.struct("usual", "node", "n", "at")).alias("head"))
    meet = members.drop("usual").join(heads, "key").where((F.col("node") != F.col("head.node")) & can(F.col("n"), F.col("at"), F.col("head.n"), F.col("head.at"))).select("node", "head.usual", F.col("head.node").alias("v"), F.lit(2).alias("kind"))
    met = close.unionByName(meet).groupBy("node", "kind", "v").agg(F.max("usual").alias("usual"), F.count("*").alias("n"))
    best = met.groupBy("node", "kind").agg(F.max_by("v", F.struct("usual", "v")).alias("a"), F.max_by("v", F.struct("n", "v")).alias("b"))
    pairs = best.select("node", F.explode(F.array("a", "b")).alias("v")).select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()
    edges = _text.settled(_similar(_text.settled(pairs), nodes, texts, similarity))
    roots = stars(edges)

    # then all that meet in a key and are still in two groups; most nodes of a key are in one
    named = members.join(roots, F.col("node") == F.col("u"), "left").select("key", "node", "n", "at", F.coalesce("v", "node").alias("label"))
    most = named.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1").select("key", "most")
    named = _text.settled(named.join(most, "key").join(nodes.select("node", "short"), "node"))
    p, t = named.where("label <> most").alias("p"), named.alias("t")
    cross = (F.col("p.key") == F.col("t.key")) & (F.col("p.label") != F.col("t.label")) & ((F.col("t.label") == F.col("t.most")) | (F.col("p.node") < F.col("t.node")))
    # short sketches tell in the join, as most of those that meet in a key have little else in common, and in many keys at that
    apart = sum((F.bit_count(F.get("p.short", F.lit(k)).bitwiseXOR(F.get("t.short", F.lit(k)))) for k in range(SHORT_BITS // 64)), F.lit(0))
    cross = cross & (apart <= (1 - similarity) / (1 + similarity) * (F.col("p.n") + F.col("t.n")) + 1e-6)
    rest = p.join(t, cross & can(F.col("p.n"), F.col("p.at"), F.col("t.n"), F.col("t.at"))).select(F.least("p.node", "t.node").alias("u"), F.greatest("p.node", "t.node").alias("v")).distinct()
    rest, n = _text.counted(rest)
    if n:
        roots = stars(roots.unionByName(_text.settled(_similar(rest, nodes, texts, similarity))))

    named = nodes.join(roots, F.col("node") == F.col("u"), "left").select("node", "rep", F.coalesce("v", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("rep"))
    return rows, _text.settled(named.select("node", "label").join(least, "label").select("node", "rep"))


def near_duplicates(docs: DataFrame, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of its group) of each row of docs(doc_id, text).

    Groups are the components of all pairs of texts whose sets of NEAR_SHINGLE words have a Jaccard similarity of at
    least `similarity`. Multi-index hashing of fingerprints proposes the first pairs; keys of _keyed() propose the rest,
    however far fingerprints are apart; each is verified. What is in one group already is not compared again, so that
    dense groups don't give all their pairs. Null and blank texts are one group. A group without any doc_id has a null
    id. Repeated rows each get their row; an empty table gives none. Extra columns are ignored.
    """
    rows, ids = _grouped(docs, similarity)
    return rows.join(ids, "node").select("doc_id", F.col("rep.doc_id").alias("component_id"))


def distinct(docs: DataFrame, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """docs with one row of each group of near_duplicates(): that of the smallest doc_id; of rows that repeat this doc_id, the text with the smallest hash, then the first row as JSON. Rows without doc_id stay, as nothing tells them apart. Columns stay; an empty table stays empty."""
    rows, ids = _grouped(docs, similarity)
    found = rows.where("doc_id IS NOT NULL").join(ids, "node").groupBy("doc_id", "t").agg(F.max(((F.col("doc_id") == F.col("rep.doc_id")) & (F.col("t") == F.col("rep.t"))).cast("int")).alias("stays"), F.count("*").alias("n"))
    ids, n = _text.counted(found.where("stays = 0 OR n > 1").select(F.col("doc_id").alias("other_id"), F.col("t").alias("other_t"), "stays"))
    # few ids are told to every task, so that texts needn't be shuffled; more are joined
    small = _few(ids, n)
    same = lambda few: (docs["doc_id"].cast("long") == few["other_id"]) & (F.xxhash64(docs["text"].cast("string")) == few["other_t"])
    rest = docs.join(small, same(ids), "left_anti")
    repeated = docs.join(small.where("stays = 1"), same(ids), "left_semi")
    row = F.struct(*docs.columns)
    one = repeated.groupBy("doc_id", F.xxhash64(F.col("text").cast("string"))).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return rest.unionByName(one.select(*(F.col("row")[c].alias(c) for c in docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(_text.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
