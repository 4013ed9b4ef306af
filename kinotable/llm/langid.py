"""Language identification of mixed-language text.

A model holds, for each language, log probabilities of hashed letter trigrams (word edges included) and the scripts its
words are written in. A word's script narrows the languages it can have; trigram sums score it; Viterbi over the words
of a text, with a penalty for each switch, labels spans. A text is decoded word by word only if needed: if, in no run of
words, other languages gain more than the penalty over the best single language, one span is proved to be the best path.

The model is fitted on a bounded sample of labelled rows (TRAIN_TEXTS distinct texts of each language, chosen by hash)
and is sent to the executors; its size is languages x BUCKETS floats, NUMBERS at most. Prediction reads the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinotable.llm import _text

#: About so many distinct texts of each language are learned from.
TRAIN_TEXTS = 2000
#: Trigram hashes, and numbers in a model: with more languages than these allow, trigrams share fewer hashes.
BUCKETS, NUMBERS = 1 << 16, 1 << 24
#: Languages whose shares may be broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
#: Log probability that a switch of language costs.
SWITCH = 12.0
#: A script belongs to a language if at least this share of its words is in it.
SCRIPT_SHARE = 0.01
#: Texts whose predicted language holds less than this share of the letters are rejected by accepted().
MIN_SCORE = 0.3
UNKNOWN = "und"
#: First code point of each range and its script; ranges end where the next begins, "" is no script.
SCRIPTS = [
    (0x41, "Latin"), (0x5B, ""), (0x61, "Latin"), (0x7B, ""), (0xAA, "Latin"), (0xAB, ""), (0xB5, "Greek"), (0xB6, ""), (0xBA, "Latin"), (0xBB, ""), (0xC0, "Latin"), (0xD7, ""), (0xD8, "Latin"), (0xF7, ""), (0xF8, "Latin"), (0x2B0, ""),
    (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Syriac"), (0x750, "Arabic"), (0x780, "Thaana"), (0x7C0, ""), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"),
    (0xB00, "Oriya"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3130, "Hangul"), (0x3190, ""), (0x3400, "Han"), (0x4DC0, ""), (0x4E00, "Han"), (0xA000, ""),
    (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, ""), (0xFB50, "Arabic"), (0xFE00, ""), (0x20000, "Han"), (0x323B0, ""),
]

_NAMES = sorted({name for _, name in SCRIPTS if name})
_STARTS = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([0, *(_NAMES.index(name) + 1 if name else 0 for _, name in SCRIPTS)], np.uint8)
_LETTER = _text.WORD.copy()
_LETTER[48:58] = False
_ANY_LETTER = regex.compile(r"\p{L}")


class Words:
    """The words (runs of ASCII letters and of all code points above ASCII) of some texts that lie one behind the other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = _text.LOWER[data]
        inside = np.zeros(len(low) + 2, bool)
        inside[1:-1] = _LETTER[low]
        first = np.zeros(len(low) + 1, bool)
        first[offsets] = True
        starting = inside[1:-1] & (~inside[:-2] | first[:-1])
        ending = inside[1:-1] & (~inside[2:] | first[1:])
        self.starts, self.ends = np.flatnonzero(starting), np.flatnonzero(ending) + 1
        self.before = np.searchsorted(self.starts, offsets)
        at = np.flatnonzero(inside[1:-1])
        left = np.where(starting[at], 0, low[np.maximum(at - 1, 0)]).astype(np.uint32)
        right = np.where(ending[at], 0, low[np.minimum(at + 1, max(len(low) - 1, 0))]).astype(np.uint32)
        self.grams = ((left << np.uint32(16) | low[at].astype(np.uint32) << np.uint32(8) | right) * np.uint32(2654435761)) >> np.uint32(32 - (BUCKETS - 1).bit_length())
        self.firsts = np.searchsorted(at, self.starts)  # of each word, among the letters
        self.scripts = self._scripts(low)

    def _scripts(self, low: np.ndarray) -> np.ndarray:
        """Script of the first letter with one, of each word; 0 if none has."""
        out = np.zeros(len(self.starts), np.uint8)
        lead = low[self.starts] if len(self.starts) else np.zeros(0, np.uint8)
        out[lead < 128] = _NAMES.index("Latin") + 1
        at = self.starts.copy()
        open_ = np.flatnonzero((lead >= 128) & (out == 0))
        while len(open_):  # one more character of the words whose characters so far have no script
            p = at[open_]
            b = [low[np.minimum(p + k, len(low) - 1)].astype(np.int64) for k in range(4)]
            size = np.where(b[0] < 0x80, 1, np.where(b[0] < 0xE0, 2, np.where(b[0] < 0xF0, 3, 4)))
            code = np.select([size == 1, size == 2, size == 3], [b[0], (b[0] & 31) << 6 | b[1] & 63, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63], (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63)
            out[open_] = _SCRIPT[np.searchsorted(_STARTS, code, "right")]
            at[open_] = p + size
            open_ = open_[(out[open_] == 0) & (at[open_] < self.ends[open_])]
        return out


class Model:
    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        """grams: counts by language and bucket; scripts: words by language and script."""
        self.langs = langs
        self.bits = (grams.shape[1] - 1).bit_length()
        rates = (grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * grams.shape[1])
        self.logs = np.log(rates).astype(np.float32)
        self.allowed = scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= SCRIPT_SHARE
        self.usual = int(np.argmax(scripts.sum(1))) if len(langs) else 0
        self.scale = np.abs(self.logs).max(initial=1)

    def scores(self, words: Words) -> np.ndarray:
        """Languages x words. A word's script narrows the languages that are scored; the others get less than these by four impossible trigrams. A word whose script no language has scores 0 for all."""
        out = np.zeros((len(self.langs), len(words.starts)), np.float64)
        grams = words.grams >> np.uint32((BUCKETS - 1).bit_length() - self.bits)
        sizes = np.diff(np.append(words.firsts, len(grams)))
        for script in np.unique(words.scripts).tolist():
            own, can = words.scripts == script, np.flatnonzero(self.allowed[:, script])
            if not len(can):
                continue
            at, part, firsts = (slice(None), grams, words.firsts) if own.all() else (np.flatnonzero(own), grams[np.repeat(own, sizes)], np.concatenate([[0], np.cumsum(sizes[own])[:-1]]))
            found = np.stack([np.add.reduceat(self.logs[k][part], firsts, dtype=np.float64) for k in can])
            if len(can) < len(self.langs):
                out[:, at] = found.min(0) - 4 * self.scale
            for k, row in zip(can, found, strict=True):
                out[k, at] = row
        return out

    def label(self, words: Words) -> list[list[tuple[int, int, int]]]:
        """Of each text its spans (language, first word, words)."""
        n_docs, s = len(words.before) - 1, self.scores(words)
        doc = np.repeat(np.arange(n_docs), np.diff(words.before))
        sums = np.stack([np.bincount(doc, x, n_docs) for x in s])
        best = sums.argmax(0)
        gain = np.zeros(s.shape[1])
        own = s[best[doc], np.arange(len(doc))]
        if len(self.langs) > 1:
            others = s.copy()
            others[best[doc], np.arange(len(doc))] = -np.inf
            gain = others.max(0) - own
        run = np.cumsum(gain)
        deep = np.ptp(run) + 1 if len(run) else 1  # apart for each text, so that a minimum stays within it
        lowest = np.minimum.accumulate((run - gain) - deep * doc) if len(run) else run
        most = np.full(n_docs, -np.inf)
        np.maximum.at(most, doc, run - deep * doc - lowest)
        spans = []
        for k in range(n_docs):
            a, b = int(words.before[k]), int(words.before[k + 1])
            if a == b:
                spans.append([])
            elif most[k] <= SWITCH - 1e-3:
                spans.append([(int(best[k]), 0, b - a)])
            else:
                spans.append(viterbi(s[:, a:b]))
        return spans


def viterbi(s: np.ndarray, switch: float = SWITCH) -> list[tuple[int, int, int]]:
    """Spans of the best path over languages x words; staying is preferred, then the first language."""
    n_langs, n = s.shape
    total, back = s[:, 0].copy(), np.zeros((n, n_langs), np.int32)
    here = np.arange(n_langs)
    for k in range(1, n):
        top = int(total.argmax())
        moved = total[top] - switch > total
        back[k] = np.where(moved, top, here)
        total = np.where(moved, total[top] - switch, total) + s[:, k]
    state, end, out = int(total.argmax()), n, []
    for k in range(n - 1, -1, -1):
        before = int(back[k, state]) if k else -1
        if before != state:
            out.append((state, k, end - k))
            end, state = k, before
    return out[::-1]


_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.LongType())])


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in _text.parts(batches):
        for lang in batch.column("lang").unique().to_pylist():
            texts = batch.filter(pa.compute.equal(batch.column("lang"), lang)).column("text")
            data, offsets = _text.utf8(texts)
            for lo, hi in _text.slices(offsets):
                own = offsets[lo : hi + 1]
                words = Words(data[own[0] : own[-1]], own - own[0])
                grams[lang] = grams.get(lang, 0) + np.bincount(words.grams, minlength=BUCKETS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(words.scripts, minlength=len(_NAMES) + 1)
    for kind, counts in enumerate((grams, scripts)):
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([kind] * len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "kind", "at", "n"])


def fit(labelled: DataFrame, texts: int = TRAIN_TEXTS) -> Model:
    """A model from labelled(text, lang), rows with a null in either left out. About `texts` distinct texts of each language count: those with the smallest hashes. Repeated rows change nothing."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    have = rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("n"))
    shares = have.select("lang", F.least(F.lit(1 << 30), F.ceil(F.lit(float(texts) * (1 << 30)) / F.greatest("n", F.lit(1)))).alias("share"))
    shares, n = _text.counted(shares)
    sample = rows.join(F.broadcast(shares) if n <= BROADCAST_LANGUAGES else shares, "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("share")).select("text", "lang").dropDuplicates(["lang", "text"])
    counts = sample.mapInArrow(_counting, _COUNTS).groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(counts.column("lang").unique().to_pylist())
    buckets = BUCKETS
    while buckets > 64 and buckets * len(langs) > NUMBERS:
        buckets //= 2
    grams, scripts = np.zeros((len(langs), buckets)), np.zeros((len(langs), len(_NAMES) + 1))
    lang, kind, at, n = (counts.column(c) for c in ("lang", "kind", "at", "n"))
    lang = pa.compute.index_in(lang.combine_chunks(), pa.array(langs, pa.string())).to_numpy(zero_copy_only=False)
    kind, at, n = kind.to_numpy(), at.to_numpy(), n.to_numpy()
    np.add.at(grams, (lang[kind == 0], at[kind == 0] * buckets // BUCKETS), n[kind == 0])
    np.add.at(scripts, (lang[kind == 1], at[kind == 1]), n[kind == 1])
    return Model(langs, grams, scripts)


LABELS = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("lang_spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("byte", T.LongType()), T.StructField("end_byte", T.LongType())]))),
    ]
)


def predict(docs: DataFrame, model: Model, keep: list[str] = ()) -> DataFrame:
    """`keep` columns of docs(text), lang_pred, score and lang_spans for each row.

    lang_pred is the language with most letter bytes in the labelled spans (ties: the first by name), score their share,
    0 if no word's script is known. A null text, or one without letters, is "und" with score 0 and no spans; so is every
    text if the model has no language. Repeated rows and null ids each get their row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for batch in _text.parts(batches):
            texts = batch.column("__text")
            data, offsets = _text.utf8(texts)
            pred, score, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in range(len(texts))]
            for lo, hi in _text.slices(offsets, _text.SLICE_BYTES // (1 + len(m.langs) // 32)) if m.langs else ():
                own = offsets[lo : hi + 1]
                words = Words(data[own[0] : own[-1]], own - own[0])
                sizes = words.ends - words.starts
                total = np.concatenate([[0], np.cumsum(sizes)])
                known = np.concatenate([[0], np.cumsum(sizes * m.allowed[:, words.scripts].any(0))])
                ascii_words = np.concatenate([[0], np.cumsum(words.scripts == _NAMES.index("Latin") + 1)])
                for k, spans in enumerate(m.label(words)):
                    a, b, zero = int(words.before[k]), int(words.before[k + 1]), int(own[k] - own[0])
                    if a == b or ascii_words[a] == ascii_words[b] and not _ANY_LETTER.search(texts[lo + k].as_py()):
                        continue
                    of = np.zeros(len(m.langs))
                    for lang, first, n in spans:
                        of[lang] += known[a + first + n] - known[a + first]
                        out[lo + k].append({"lang": m.langs[lang], "byte": int(words.starts[a + first]) - zero, "end_byte": int(words.ends[a + first + n - 1]) - zero})
                    top = int(of.argmax()) if of.any() else m.usual
                    pred[lo + k], score[lo + k] = m.langs[top], of[top] / (total[b] - total[a])
            cols = [pa.array(pred), pa.array(score), pa.array(out, pa.list_(pa.struct([("lang", pa.string()), ("byte", pa.int64()), ("end_byte", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], [*keep, *LABELS.names])

    rows = docs.select(*keep, F.col("text").alias("__text"))
    return rows.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *LABELS.fields]))


def held_out() -> F.Column:
    """Rows that are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def learn(docs: DataFrame) -> Model:
    """Model from the rows of docs(doc_id, text, lang) that aren't held out; rows without id count as held out."""
    return fit(docs.where(~F.coalesce(held_out(), F.lit(True))))


def accepted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows that language ID rejects: those without letters, and those whose main language holds less than `min_score` of their letters. A null lang is filled in; columns stay. Repeated rows and ids each stay or go alike; an empty table stays empty."""
    packed = docs.select("text", F.struct(*docs.columns).alias("row"))
    found = predict(packed, learn(docs), keep=["row"])
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*((F.coalesce(F.col("row")[c], F.col("lang_pred")) if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _text.table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), "lang_pred", "score")
