"""License scans by exact set-similarity join.

A text block is any run of BLOCK words, or of twice a template's words if that is more. A block matches a template if it
holds at least THRESHOLD of the template's distinct words. The words of the templates are ordered by how many texts of the
corpus hold them, rarest first: a match must have one of the first |T| - need + 1 words of its template (prefix filter),
so blocks are looked for only around those words. What lies within reach of one must have need distinct words of the
template (length filter), a block begins at a word of the template, and the word need - 1 places on must still be in it
(positional filter). What passes is counted in full, block by block.

Native: array functions of Spark alone, in the row, without a join of texts. The index of the templates is in the plan
as a literal; MOST_WORDS bounds it. The only thing gathered is one count for each template word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinotable.llm import _text

#: Label, and notice in lower-case words.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.8
BLOCK = 64
#: Words that all templates together may have.
MOST_WORDS = 4096
#: Label, and the words of a phrase that stand one behind the other.
PHRASES = [("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license"))]

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# what is between words, and word characters of either case; written out one by one, as such a class is one table lookup
_OUT = "[" + "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]"
_IN = "[^" + _OUT[1:]


def need(size: int, threshold: float = THRESHOLD) -> int:
    """Shared words that make a template of `size` distinct words match."""
    return next(n for n in range(1, size + 1) if n >= threshold * size - 1e-9)


def reach(words: int) -> int:
    """Words of a block for a template of so many words."""
    return max(BLOCK, 2 * words)


def lowered(text: Column | str) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _let(value: Column, use) -> Column:
    """use(value), with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _strings(values: list[str]) -> Column:
    return F.lit(list(values)).cast("array<string>") if values else F.array().cast("array<string>")


def any_of(words: list[str]) -> str:
    """Pattern of these words (lower-case, ASCII) as whole words, by common beginnings, so that a place is tried once for each letter."""

    def tree(rests: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for r in rests:
            if r:
                by.setdefault(r[0], []).append(r[1:])
        inner = "|".join(c + tree(by[c]) for c in sorted(by))
        return inner and f"(?:{inner}){'?' if '' in rests else ''}"

    return f"(?<!{_IN}){tree(sorted(set(words)))}(?!{_IN})"


def frequencies(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[str, int]:
    """Texts of docs(text) that hold each template word."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    held = docs.select(F.explode(F.array_intersect(_strings(vocabulary), F.regexp_extract_all(lowered("text"), F.lit(f"{_IN}++"), F.lit(0)))).alias("w"))
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}


class Index:
    """Templates as columns: words in global order, prefixes, and for each prefix word its templates."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int], threshold: float = THRESHOLD):
        self.labels = [label for label, _ in templates]
        order = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
        self.sets = [sorted(set(t.split()), key=order.__getitem__) for _, t in templates]
        if sum(map(len, self.sets)) > MOST_WORDS:
            raise ValueError(f"templates have over {MOST_WORDS} words")
        self.need = [need(len(s), threshold) for s in self.sets]
        self.reach = [reach(len(t.split())) for _, t in templates]
        self.prefix: dict[str, list[int]] = {}
        for k, (s, n) in enumerate(zip(self.sets, self.need, strict=True)):
            for w in s[: len(s) - n + 1]:
                self.prefix.setdefault(w, []).append(k)

    def matches(self, words: Column) -> Column:
        """(label, containment) of the templates that some block matches, with the best block's containment; `words` of the text."""
        index = F.create_map(*(c for w, at in sorted(self.prefix.items()) for c in (F.lit(w), F.array(*map(F.lit, at)))))
        table = F.array(*(F.struct(F.lit(label).alias("label"), _strings(s).alias("words"), F.lit(n).alias("need"), F.lit(r).alias("reach")) for label, s, n, r in zip(self.labels, self.sets, self.need, self.reach, strict=True)))
        found = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), F.when(w.isin(sorted(self.prefix)), w).alias("w"))), lambda x: x["w"].isNotNull())
        places = F.flatten(F.transform(found, lambda x: F.transform(F.try_element_at(index, x["w"]), lambda t: F.struct(t.alias("t"), x["i"].alias("i")))))

        def block(hits: Column, of: Column, a: Column, k: Column) -> Column:
            """Distinct words of the template in the block that begins at hit a, the k-th, if it can have enough."""
            end = a["j"] + of["reach"]
            own = F.transform(F.filter(hits, lambda b: (b["j"] >= a["j"]) & (b["j"] < end)), lambda b: b["w"])
            return F.when(F.get(hits, k + of["need"] - 1)["j"] < end, F.size(F.array_distinct(own)))

        def around(of: Column, i: Column, best: Column) -> Column:
            """The most such words of the blocks that hold the word at i, or `best` if no block has more."""
            low = F.greatest(i - of["reach"] + 1, F.lit(0))
            near = F.transform(F.slice(words, low + 1, i + of["reach"] - low), lambda w, j: F.struct((j + low).alias("j"), w.alias("w")))
            hits = F.filter(near, lambda x: F.array_contains(of["words"], x["w"]))
            can = lambda h: F.size(F.array_distinct(F.transform(h, lambda x: x["w"]))) >= F.greatest(of["need"], best + 1)
            most = lambda h: F.array_max(F.transform(h, lambda a, k: F.when(a["j"] <= i, block(h, of, a, k))))
            return _let(hits, lambda h: F.when(can(h), F.greatest(best, F.coalesce(most(h), F.lit(0)))).otherwise(best))

        def of_template(all_places: Column, t: Column) -> Column:
            own = F.filter(all_places, lambda p: p["t"] == t)
            return _let(F.get(table, t), lambda of: _let(
                F.aggregate(own, F.lit(0), lambda best, p: F.when(best >= F.size(of["words"]), best).otherwise(around(of, p["i"], best))),
                lambda n: F.struct(of["label"].alias("label"), (n / F.size(of["words"])).alias("containment"), (n >= of["need"]).alias("ok")),
            ))

        every = _let(places, lambda ps: F.transform(F.array_distinct(F.transform(ps, lambda p: p["t"])), lambda t: of_template(ps, t)))
        return F.array_distinct(F.transform(F.filter(every, lambda x: x["ok"]), lambda x: F.struct(x["label"].alias("label"), x["containment"].alias("containment"))))


def _phrase(words: tuple[str, ...]) -> str:
    return rf"(?i)(?<!{_IN})" + rf"{_OUT}+".join(words) + rf"(?!{_IN})"


def scan(docs: DataFrame, keep: list[str] = (), templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """`keep` columns of docs(text), n_words, n_base, first_word, last_word (of phrases), base_labels (array) and found (array of label and containment).

    A null or empty text has no words and no labels. Repeated rows and null ids each get their row, and repeated texts
    count each for the order of words, which changes no result. Columns in `keep` may not be named as those returned
    (an error). An empty table gives no rows.
    """
    if clash := {*keep} & {"n_words", "n_base", "first_word", "last_word", "base_labels", "found"}:
        raise ValueError(f"names that scan() returns itself: {sorted(clash)}")
    index = Index(templates, frequencies(docs, templates), threshold)
    text = F.coalesce(F.col("text"), F.lit(""))
    # one letter for each word: a text without words, which the pattern leaves as it is, has none
    marks = F.regexp_replace(text, F.lit(f"{_OUT}*+{_IN}++{_OUT}*+"), F.lit("w"))
    rows = docs.select(F.struct(*keep).alias("kept") if keep else F.lit(0).alias("kept"), text.alias("t"), lowered(text).alias("lower"), marks.alias("marks"))
    n_words = F.when(F.col("marks").rlike(f"^{_OUT}*+$"), 0).otherwise(F.length("marks")).cast("long").alias("n_words")
    may = F.col("lower").rlike(any_of(sorted(index.prefix)))
    rows = rows.select("kept", n_words, F.when(F.contains("lower", F.lit("license")), F.col("t")).alias("t"), F.when(may, F.regexp_extract_all("lower", F.lit(f"{_IN}++"), F.lit(0))).alias("w"))
    pieces = lambda words: F.when(F.col("t").isNotNull(), F.split("t", _phrase(words), -1))
    rows = rows.select("kept", "n_words", "w", *(pieces(words).alias(f"p_{label}") for label, words in PHRASES))
    count = lambda piece: F.regexp_count(piece, F.lit(f"{_IN}+"))
    hit = {label: F.size(f"p_{label}") > 1 for label, _ in PHRASES}
    first = F.least(*(F.when(hit[label], count(F.get(F.col(f"p_{label}"), F.lit(0)))) for label, _ in PHRASES))
    last = F.greatest(*(F.when(hit[label], F.col("n_words") - count(F.element_at(f"p_{label}", -1)) - len(words)) for label, words in PHRASES))
    total = sum((F.coalesce(F.greatest(F.size(f"p_{label}") - 1, F.lit(0)), F.lit(0)) for label, _ in PHRASES), F.lit(0))
    base = F.array_compact(F.array(*(F.when(hit[label], F.lit(label)) for label, _ in PHRASES)))
    none = F.array().cast("array<struct<label:string,containment:double>>")
    rows = rows.select("kept", "n_words", total.cast("long").alias("n_base"), first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), F.array_sort(base).alias("base_labels"), "w")
    found = F.when(F.col("w").isNotNull(), index.matches(F.col("w"))).otherwise(none)
    return rows.select(*(F.col("kept")[c].alias(c) for c in keep), "n_words", "n_base", "first_word", "last_word", "base_labels", found.alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(_text.table(spark, sf_dir, "documents"), keep=["doc_id"])
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("found", lambda x: x["label"]))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["containment"])), F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _sql() -> str:
    lists = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))!r}, {need(len(set(t.split())))}, {reach(len(t.split()))})" for k, (label, t) in enumerate(TEMPLATES))
    at = " UNION ALL ".join(f"SELECT r, '{label}' AS label, i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs) WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words)) for label, words in PHRASES)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
places AS ({at}),
base AS (SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
templates(t, label, ws, need, reach) AS (VALUES {lists}),
hits AS (SELECT r, i, x, t FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM docs) JOIN (SELECT t, unnest(ws) AS x FROM templates) USING (x)),
blocks AS (SELECT r, t, count(DISTINCT x) OVER (PARTITION BY r, t ORDER BY i RANGE BETWEEN CURRENT ROW AND (reach - 1) FOLLOWING) AS n FROM hits JOIN templates USING (t)),
found AS (SELECT r, label, max(n / len(ws)) AS containment FROM blocks JOIN templates USING (t) WHERE n >= need GROUP BY r, label),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION SELECT r, label FROM found) GROUP BY r),
best AS (SELECT r, max(containment) AS containment FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN every USING (r) LEFT JOIN best USING (r)
"""


SQL = _sql()
