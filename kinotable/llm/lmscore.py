"""Language-model scoring by cross-entropy difference.

Two bigram models share the vocabulary of a public tokenizer, the order, the smoothing and the size: the target model
counts the labelled texts, the background model counts all texts, scaled to the target's number of tokens. A text's
score is the mean over its tokens of target loss less background loss; low scores are like the target. No text is scored
by what it has itself added to a model: its own counts are left out, so that only what other texts hold makes it likely.

Texts become ids once and are written to the shared folder, in chunks of bounded size. Each chunk's distinct bigrams are
counted exactly and summed over a shuffle, so the table of bigrams grows with the corpus; a chunk's texts are scored with
the sums of its own bigrams, which a join brings to it. Only unigram counts, 2 x (vocabulary + 1) numbers, come to the
driver and go to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinotable.llm import _text, packing

#: Numbers in a slice of a table, and bytes of ids in a chunk, unless one text alone is longer.
SLICE, CHUNK = 1 << 14, 4 << 20
#: Ids that a vectorised step takes at once, unless one text alone is longer.
IDS = 1 << 19
#: Partial sums of a slice of unigram counts, so that no task gets one from every other.
SALTS = 64
#: Weight of the unigram model behind a bigram, and pseudo-count of each id in it.
BACKOFF, PSEUDO = 20.0, 0.1
#: Target ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])


def _keys(ids: np.ndarray, firsts: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The id before each id (`vocabulary` at a text's start) and the bigram: both ids in one long."""
    before = np.empty(len(ids), np.uint32)
    before[1:] = ids[:-1]
    before[firsts] = vocabulary
    return before, (before.astype(np.uint64) << np.uint64(32) | ids).view(np.int64)


def _kind(vocabulary: int) -> np.dtype:
    """Of ids as they are written, packing.Encoder's: two bytes where the vocabulary allows."""
    return np.dtype(np.uint16 if vocabulary <= 1 << 16 else np.uint32)


def _slices(batch: pa.RecordBatch, kind: np.dtype) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, ids of its texts one behind the other, and where each text's ids begin and end."""
    column = batch.column("ids").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for lo, hi in _text.slices(offsets, IDS * kind.itemsize):
        yield lo, hi, data[offsets[lo] : offsets[hi]].view(kind), (offsets[lo : hi + 1] - offsets[lo]) // kind.itemsize


def encoded(docs: DataFrame, target: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, target (whether the id is among those of target(doc_id)), chunk and ids (binary, unsigned numbers of 16 bits, or 32 if the vocabulary needs them) of docs(doc_id, text)."""
    with open(path or packing.tokenizer_path()) as f:
        spec = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((spec, packing.quick_merges(spec)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, chunk, held = packing.Encoder(*sent.value), TaskContext.get().partitionId() << 32, 0
        for batch in _text.parts(batches):
            ids = [encode(t.as_py()) for t in batch.column("text")]
            chunks = []
            for x in ids:
                if held and held + len(x) > CHUNK:
                    chunk, held = chunk + 1, 0
                held += len(x)
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("target"), pa.array(chunks, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "target", "chunk", "ids"])

    ids = target.select(F.col("doc_id").cast("long").alias("target_id")).where("target_id IS NOT NULL").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = rows.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("target_id"), "left").select("doc_id", "text", F.col("target_id").isNotNull().alias("target"))
    return rows.mapInArrow(run, "doc_id long, target boolean, chunk long, ids binary")


class Models:
    """Unigram counts of both models: `tables` has those of all texts, then of the target's."""

    def __init__(self, tables: list[np.ndarray], vocabulary: int):
        self.vocabulary = vocabulary
        total, target = (float(t[:vocabulary].sum()) for t in tables)
        scale = target / total if total and target else 1.0
        self.parts = [(tables[1].astype(np.float64), 1.0), (tables[0].astype(np.float64), scale)]

    def losses(self, ids: np.ndarray, at: np.ndarray, known: np.ndarray, counts: list[np.ndarray], target: np.ndarray) -> list[np.ndarray]:
        """Target's and background's loss of each id, in nats, by the counts (target's, all) of the sorted bigrams `known`, which has all of these ids.

        at: where each text's ids begin and end, none empty; target: whether the text is one of the target's. The text's own counts are left out.
        """
        firsts, long = at[:-1], np.diff(at)
        before, keys = _keys(ids, firsts, self.vocabulary)
        where, doc, out = np.searchsorted(known, keys), np.repeat(np.arange(len(long)), long), []
        own_pair, own_id, own_before = (_repeats(doc, x) for x in (where, ids, before))
        own_before = own_before + (before == np.repeat(ids[at[1:] - 1], long))  # a text's last id stands before none
        for k, ((uni, by), n) in enumerate(zip(self.parts, counts, strict=True)):
            out_of = np.repeat(target, long) if k == 0 else 1
            behind = ((uni[ids] - own_id * out_of) * by + PSEUDO) / ((uni[: self.vocabulary].sum() - np.repeat(long, long) * out_of) * by + PSEUDO * self.vocabulary)
            out.append(-np.log(((n[where] - own_pair * out_of) * by + BACKOFF * behind) / ((uni[before] - own_before * out_of) * by + BACKOFF)))
        return out


def _repeats(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each element, how often its text has it."""
    _, inverse, n = np.unique(doc.astype(np.uint64) << np.uint64(32) | x.astype(np.uint64), return_inverse=True, return_counts=True)
    return n[inverse]


def _counter(vocabulary: int):
    size, kind = vocabulary + 1, _kind(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, size), np.int64)
        for batch in _text.parts(batches):
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, ids, at in _slices(batch, kind):
                full = np.diff(at) > 0
                own = np.repeat(target[lo:hi], np.diff(at))
                for t, of, texts in ((0, slice(None), full), (1, own, full & target[lo:hi])):
                    tables[t, :vocabulary] += np.bincount(ids[of], minlength=vocabulary)
                    tables[t, vocabulary] += texts.sum()
        parts = [(t, k, tables[t, k * SLICE : (k + 1) * SLICE]) for t in range(2) for k in range(-(-size // SLICE))]
        parts = [(t, k, x.astype("<i8").tobytes()) for t, k, x in parts if x.any()]
        salt = TaskContext.get().partitionId() % SALTS
        for at in range(0, len(parts), 64):
            t, k, x = zip(*parts[at : at + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(k, pa.int32()), pa.array([salt] * len(t), pa.int32()), pa.array(x, pa.binary())], ["t", "k", "salt", "n"])

    return run


def _bigrams(vocabulary: int):
    """Counts a task's bigrams, chunk by chunk: all, and those of target texts."""
    kind = _kind(vocabulary)

    def summed(chunk: int, pieces: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, at = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
        n = [np.bincount(at, np.concatenate([p[k] for p in pieces]), len(keys)).astype(np.int64) for k in (1, 2)]
        for lo in range(0, len(keys), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), chunk)), *(pa.array(x[part]) for x in (keys, *n))], ["chunk", "key", "n", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces = None, []
        for batch in _text.parts(batches):
            target, chunks = batch.column("target").to_numpy(zero_copy_only=False).astype(bool), batch.column("chunk").to_numpy()
            for lo, hi, ids, at in _slices(batch, kind):
                long = np.diff(at)
                if not len(ids):
                    continue
                _, keys = _keys(ids, at[:-1][long > 0], vocabulary)
                of, own = np.repeat(chunks[lo:hi], long), np.repeat(target[lo:hi], long)
                for chunk in np.unique(chunks[lo:hi][long > 0]).tolist():
                    if chunk != now and pieces:
                        yield from summed(now, pieces)
                        pieces = []
                    now = chunk
                    distinct, inverse = np.unique(keys[of == chunk], return_inverse=True)
                    pieces.append((distinct, np.bincount(inverse, minlength=len(distinct)), np.bincount(inverse, own[of == chunk], len(distinct))))
        if pieces:
            yield from summed(now, pieces)

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int, int], np.ndarray] = {}
    for batch in batches:
        for t, k, salt, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(n, "<i8")
            sums[t, k, salt] = sums[t, k, salt] + x if (t, k, salt) in sums else x
    for key, n in sums.items():
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in key), pa.array([n.astype("<i8").tobytes()], pa.binary())], ["t", "k", "salt", "n"])


def fit(rows: DataFrame, vocabulary: int) -> Models:
    """Both models' unigrams from encoded(): each slice of counts is summed up by salt, then over the salts."""
    kind = "t int, k int, salt int, n binary"
    size = vocabulary + 1
    parts = rows.select("target", "ids").mapInArrow(_counter(vocabulary), kind)
    slices = 2 * -(-size // SLICE)
    summed = parts.repartition(slices * 4, "t", "k", "salt").mapInArrow(_sum, kind).withColumn("salt", F.lit(0)).repartition(slices, "t", "k").mapInArrow(_sum, kind)
    tables = [np.zeros(size), np.zeros(size)]
    for r in summed.toLocalIterator():
        tables[r["t"]][r["k"] * SLICE : (r["k"] + 1) * SLICE] = np.frombuffer(r["n"], "<i8")
    return Models(tables, vocabulary)


def score(docs: DataFrame, target: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (their difference) of each row of docs(doc_id, text), losses as means in nats.

    target(doc_id) names the texts that the target model counts, repeated ids once. A null or empty text has 0 tokens and
    null losses and score. Each text's own counts are left out of both models; copies of it in other rows stay in. Without
    other target texts, the target's model is smoothing alone. Repeated rows and null ids each count and get
    their row. Extra columns are ignored.
    """
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path or packing.tokenizer_path()).get_vocab_size(with_added_tokens=True)
    rows = _text.settled(encoded(docs, target, path))
    sent, kind = docs.sparkSession.sparkContext.broadcast(fit(rows, vocabulary)), _kind(vocabulary)

    parts = _text.settled(rows.select("target", "chunk", "ids").mapInArrow(_bigrams(vocabulary), "chunk long, key long, n long, m long"))
    sums = _text.settled(parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    wanted = parts.select("chunk", "key").join(sums, "key").select("chunk", "key", "n", "m")

    def run(texts: pa.Table, bigrams: pa.Table) -> pa.Table:
        models: Models = sent.value
        known, counts, every = bigrams.column("key").to_numpy(), [bigrams.column(k).to_numpy() for k in ("m", "n")], []
        order = np.argsort(known)
        known, counts = known[order], [x[order] for x in counts]
        for batch in texts.to_batches():
            n, means = np.zeros(batch.num_rows, np.int64), np.full((2, batch.num_rows), np.nan)
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, ids, at in _slices(batch, kind):
                n[lo:hi] = np.diff(at)
                full = np.flatnonzero(n[lo:hi])
                if len(full):
                    for k, loss in enumerate(models.losses(ids, np.append(at[:-1][full], at[-1]), known, counts, target[lo + full])):
                        means[k, lo + full] = np.add.reduceat(loss, at[:-1][full], dtype=np.float64) / n[lo + full]
            none = n == 0
            cols = [pa.array(x, pa.float64(), mask=none) for x in (means[0], means[1], means[0] - means[1])]
            every.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *cols], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]))
        return pa.Table.from_batches(every, RESULT)

    return rows.select("chunk", "doc_id", "target", "ids").groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _text.table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return score(_text.table(spark, sf_dir, "documents"), good)
