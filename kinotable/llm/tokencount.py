"""Token counts by whole-token shortcut.

A sentencepiece BPE joins neighbouring symbols only if the result is in its vocabulary. If no piece has a word-start mark
behind another character, nothing is ever joined across the start of a word, so a text's count is the sum over its
words. Vocabulary strings that the library, given one alone, encodes as a single token are proved so once on the driver;
a word that is among them counts 1 straight away. Only the rest is merged by the library, and its counts are remembered
while a bounded table has room. A vocabulary without that property is counted by the library on whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinotable.llm import _text

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
#: Words whose counts a task remembers, and the longest such word.
REMEMBER, REMEMBER_CHARS = 400_000, 64

MARK = "▁"
_UNITS = re.compile(f"{MARK}+[^{MARK}]*")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def proved(model: bytes) -> dict[str, int] | None:
    """Words (without their mark) that are one token each; None if words of this vocabulary can be joined or the library changes blanks."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) or sp.is_byte(k))]
    if any(MARK in p.lstrip(MARK) for p in pieces) or sp.encode(f"a  {MARK}b ", out_type=str) != sp.encode("a   b ", out_type=str) or "".join(sp.encode(" a  b ", out_type=str)) != f"{MARK}{MARK}a{MARK}{MARK}b{MARK}":
        return None
    words = [p[1:] for p in pieces if p[:1] == MARK and MARK not in p[1:] and len(p) > 1]
    return {w: 1 for w, ids in zip(words, sp.encode(words, num_threads=1), strict=True) if len(ids) == 1}


class Counter:
    """Counts tokens of texts; `single` from proved()."""

    def __init__(self, model: bytes, single: dict[str, int] | None):
        self.sp, self.single = sentencepiece.SentencePieceProcessor(model_proto=model), single
        self.memo: dict[str, int] = dict(single or ())
        self.lone = len(self.sp.encode("a ")) - len(self.sp.encode("a"))

    def _learn(self, words: set[str]) -> dict[str, int]:
        """Counts of words not known yet; those too long to remember are returned."""
        new = list(words.difference(self.memo))
        if not new:
            return {}
        if len(self.memo) + len(new) > REMEMBER + len(self.single):
            self.memo = dict(self.single)
            new = list(words.difference(self.memo))
        counts = dict(zip(new, map(len, self.sp.encode(new, num_threads=1)), strict=True))
        once = {w: counts.pop(w) for w in new if len(w) > REMEMBER_CHARS}
        self.memo |= counts
        return once

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.single is None:
            return len(self.sp.encode(text))
        words, lone = text.split(" "), 0
        if MARK in text or "" in words:  # a run of blanks belongs to the word behind it
            words = [u[1:] for u in _UNITS.findall(MARK + text.replace(" ", MARK))]
            if not words[-1]:  # a blank with nothing behind it
                words.pop()
                lone = self.lone
        once = self._learn(set(words))
        memo = self.memo
        return lone + (sum(map(memo.__getitem__, words)) if not once else sum(once[w] if w in once else memo[w] for w in words))


def counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row of docs(doc_id, text), as the sentencepiece library encodes whole texts.

    A null or empty text has 0 of both. Repeated rows and null ids each get their row. Extra columns are ignored.
    `path`: the vocabulary file, on the driver; its bytes (bounded by the vocabulary) go to the executors.
    """
    with open(path or tokenizer_path(), "rb") as f:
        model = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((model, proved(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(*sent.value)
        for batch in _text.parts(batches):
            n = pa.array([count(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n_bytes).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts(_text.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
