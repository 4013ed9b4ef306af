"""Packing along a space-filling curve.

Each text becomes token ids, read through a bounded table of words, and a point: its hashed token vector, in which rare
tokens weigh more, less what the whole corpus would have in its place, projected to a few dimensions. Partitions are
ranges of the Hilbert key of the point that hold equal numbers of tokens, by a histogram of the curve, and are sorted by
it, so similar texts lie side by side; a range that alone is too large, as of a large group of equal texts, is spread
over several partitions. Each partition cuts its row of ids into full sequences; what is left at its end is cut into
powers of two, which need no padding. Ids pass one shuffle, as binary.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinotable.llm import _text

TOKENIZER = "byte_bpe_50k.json"
LENGTH = 2048
END_ID = 1
#: Dimensions of the curve and bits of each.
DIMENSIONS, BITS = 4, 7
#: Bits of a key that tell its bin in the histogram of the curve.
BIN_BITS = 14
#: Sums of directions are kept in whole numbers of this part, so that no order of adding changes them.
UNIT = 1 << 16
#: Id bytes that a partition of the curve is meant to hold, before the session's number of shuffle partitions.
PARTITION_BYTES = 48 << 20
#: Words whose ids a task remembers, and the longest such word.
REMEMBER, REMEMBER_CHARS = 200_000, 64

#: Fixed value: the pattern of byte-level pre-tokenizers of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_JOINED_BLANKS = re.compile(r" (?=\s)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Ids of texts as the tokenizers library gives them, as numpy arrays.

    The byte-level pre-tokenizer starts a piece at each blank that no white space follows or joins, so a text without
    joined blanks is the sum of its words with the blank before them. Texts with such blanks or with the strings of added
    tokens go to the library whole. `merges`: what quick_merges() proved; then short words of the Latin blocks are merged
    by tiktoken, whose calls cost a third.
    """

    def __init__(self, spec: str, merges: dict[bytes, int] | None = None):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.quick = merges and tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def _ids(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        if self.quick:
            encode, code = self.quick.encode_ordinary, "H" if self.dtype is np.uint16 else "I"
            out = {w: array(code, encode(" " + w)).tobytes() for w in words if len(w) <= REMEMBER_CHARS and (w.isascii() or max(w) < "\u0250")}
            words = [w for w in words if w not in out]
        if words:
            out |= {w: np.array(e.ids, self.dtype).tobytes() for w, e in zip(words, self.tokenizer.encode_batch_fast([" " + w for w in words], add_special_tokens=False), strict=True)}
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __call__(self, text: str | None) -> bytes:
        """Ids as bytes of self.dtype."""
        if not text:
            return b""
        if any(s in text for s in self.special) or _JOINED_BLANKS.search(text):
            return self._whole(text)
        head, *words = text.split(" ")
        memo = self.memo
        new = list(set(words).difference(memo))
        if new:
            memo |= self._ids(new)
        out = (self._whole(head) if head else b"") + b"".join(map(memo.__getitem__, words))
        # a full table stays as it is: frequent words came early
        for w in new if len(memo) > REMEMBER else [w for w in new if len(w) > REMEMBER_CHARS]:
            del memo[w]
        return out


def quick_merges(spec: str) -> dict[bytes, int] | None:
    """Bytes of all vocabulary strings, if merging by the rank of the joined string is proved to equal merging by the list of merges.

    Take the first step at which the two differ: two neighbours whose join z is in the vocabulary, though by another
    listed pair. What is inside z so far came about as if z stood alone, so the listed merges would not join z alone
    either. Hence if the library encodes each vocabulary string alone as itself, and ids follow the list, there is no
    such step. Checked for each string, without pre-tokenizer; None if one fails or the model is of another kind.
    """
    parsed = json.loads(spec)
    model, pre = parsed["model"], parsed["pre_tokenizer"] or {}
    vocab, merges = model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", ())]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not parsed["normalizer"]
    if model["type"] != "BPE" or not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
    letters = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}
    alone = Tokenizer.from_str(json.dumps(parsed | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
    strings = [v for v in vocab if all(c in letters for c in v) and v not in {t["content"] for t in parsed["added_tokens"]}]
    ids = [vocab[a + b] for a, b in merges]
    if ids != sorted(set(ids)) or any(vocab[v] >= min(ids) for v in strings if len(v) == 1) or len(strings) != 256 + len(ids):
        return None
    if any(e.ids != [vocab[v]] for v, e in zip(strings, alone.encode_batch_fast(strings, add_special_tokens=False), strict=True)):
        return None
    return {bytes(letters[c] for c in v): vocab[v] for v in strings}


def projection(n_ids: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """For each token id: its weight times a pseudo-random direction from its hash, the weight, and its square. Ids of this kind of vocabulary are in the order of merges, frequent ones first, so the weight grows with the id."""
    h = _text.mixed(np.arange(1, n_ids * dimensions + 1, dtype=np.uint64))
    directions = ((h >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23) - 1).reshape(n_ids, dimensions)
    weight = (np.log2(np.arange(n_ids) + 2) / np.log2(n_ids + 2)).astype(np.float32)[:, None] ** 3
    return np.hstack([directions * weight, weight, weight**2])


def positions(sums: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Keys on the curve of texts with these sums of projection() rows; centre: the corpus' sums. Less its share of the centre, and over its spread, a text's point is much the same for any length."""
    of, weight, squares = np.split(sums / UNIT, [-2, -1], axis=1)
    mean = centre[:-2] / max(centre[-2], 1e-9)
    z = (of - weight * mean) / np.sqrt(np.maximum(squares, 1e-9) / 3)
    return hilbert(np.minimum((1 << BITS) / (1 + np.exp(-np.clip(z, -30, 30))), (1 << BITS) - 1).astype(np.int64))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows), by Skilling's transform of axes to transposed index."""
    x = points.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        for axis in x:
            high = (axis & q) != 0
            swap = np.where(high, 0, (x[0] ^ axis) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            axis ^= swap
        q >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | axis >> b & 1
    return key


def encoded(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, sums (of its tokens' rows of projection(), in UNIT), tokens and ids (unsigned little-endian) of each row of docs(doc_id, text); the end id is in all."""
    with open(path or tokenizer_path()) as f:
        spec = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((spec, quick_merges(spec)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*sent.value)
        end = np.array([end_id], encode.dtype).tobytes()
        directions = projection(encode.tokenizer.get_vocab_size(with_added_tokens=True))
        for batch in _text.parts(batches):
            ids = [encode(t.as_py()) + end for t in batch.column("text")]
            sums = np.stack([directions[np.frombuffer(x, encode.dtype)].sum(0) for x in ids])
            tokens = np.array([len(x) for x in ids], np.int64) // len(end)
            sums = np.round(sums.astype(np.float64) * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(sums), pa.list_(pa.int64())), pa.array(tokens), pa.array(ids, pa.binary())], ["doc_id", "sums", "tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, sums array<long>, tokens long, ids binary")


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """rows (of encoded()) with key and part: partitions of about equal tokens along the curve. The histogram of the curve has 2**BIN_BITS bins whatever the rows."""
    size = DIMENSIONS + 2
    centre = rows.agg(*(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(size)), F.sum("tokens").alias("tokens")).first()
    if centre["tokens"] is None:
        return rows.select("doc_id", "tokens", "ids", F.lit(0).cast("long").alias("key"), F.lit(0).alias("part"))
    middle = np.array([centre[f"s{k}"] for k in range(size)], np.float64)

    @F.pandas_udf("long")
    def keys(sums: pd.Series) -> pd.Series:
        return pd.Series(positions(np.stack(sums.to_list()).astype(np.float64).reshape(-1, size), middle), dtype="int64")

    shift = max(0, DIMENSIONS * BITS - BIN_BITS)
    keyed = rows.select("doc_id", "tokens", keys("sums").alias("key"))
    bins = sorted((r["bin"], r["n"]) for r in keyed.groupBy(F.shiftright("key", shift).alias("bin")).agg(F.sum("tokens").alias("n")).toLocalIterator())
    each, before, table = centre["tokens"] / parts, 0, []
    for at, n in bins:
        first, last = min(parts - 1, int(before / each)), min(parts - 1, int((before + n - 1) / each))
        before += n
        table.append((at, first, last - first + 1 if n >= each else 1))  # a bin that several partitions need is spread over them
    starts = rows.sparkSession.createDataFrame(table, "bin long, first int, spread int")
    wide = rows.select("doc_id", "tokens", "ids", keys("sums").alias("key")).withColumn("bin", F.shiftright("key", shift)).join(F.broadcast(starts), "bin")
    part = F.col("first") + F.pmod(F.xxhash64("doc_id", "tokens", "key"), F.col("spread")).cast("int")
    return wide.select("doc_id", "tokens", "ids", "key", part.alias("part"))


def _packer(length: int):
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sequence, filled = TaskContext.get().partitionId() << 40, 0, 0
        pending: list[tuple] = []  # of the sequence that isn't full: doc_id, start, ids, doc_tokens

        def rows(pieces: list[tuple], number: int) -> Iterator[tuple]:
            offset = 0
            for doc, start, ids, tokens in pieces:
                yield doc, start, len(ids), ids.tobytes(), tokens, base + number, offset
                offset += len(ids)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in _text.parts(batches):
            out: list[tuple] = []
            size = 0
            for doc, tokens, raw in zip(batch.column("doc_id").to_pylist(), batch.column("tokens").to_pylist(), batch.column("ids").cast(pa.large_binary()), strict=True):
                raw = raw.as_buffer()
                ids = np.frombuffer(raw, f"<u{raw.size // tokens}").astype("<u4")
                at = 0
                while at < tokens:
                    take = min(length - filled, tokens - at)
                    pending.append((doc, at, ids[at : at + take], tokens))
                    at, filled = at + take, filled + take
                    if filled == length:
                        out += rows(pending, sequence)
                        pending, filled, sequence, size = [], 0, sequence + 1, size + 4 * length
                        if size > 16 << 20:
                            yield batch_of(out)
                            out, size = [], 0
            if out:
                yield batch_of(out)
        out = []
        while filled:  # cut the rest at powers of two
            goal, part = 1 << (filled.bit_length() - 1), []
            filled -= goal
            while goal:
                doc, start, ids, tokens = pending.pop(0)
                take = min(goal, len(ids))
                part.append((doc, start, ids[:take], tokens))
                if take < len(ids):
                    pending.insert(0, (doc, start + take, ids[take:], tokens))
                goal -= take
            out += rows(part, sequence)
            sequence += 1
        if out:
            yield batch_of(out)

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset.

    Each id of each row of docs(doc_id, text) and the end id behind it lie in exactly one piece. Sequences hold `length`
    ids, or fewer where that is a power of two. A null or empty text is its end id alone. Repeated rows and null ids are
    packed like others. Extra columns are ignored. An empty table gives no pieces.
    """
    rows = _text.settled(encoded(docs, path, end_id))
    spark = docs.sparkSession
    total = rows.agg(F.sum(F.col("tokens"))).first()[0] or 0
    parts = max(1, -(-2 * total // PARTITION_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = dealt(rows, parts).repartitionById(parts, "part").sortWithinPartitions("key", "doc_id", "tokens")
    return placed.select("doc_id", "tokens", "ids").mapInArrow(_packer(length), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_text.table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
