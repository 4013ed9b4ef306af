"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score, and the score decides.

The contract's four kinds stay whatever their score; of the other kinds, those without a checksum (identity and national
telephone numbers) are weak proposals, which count only where words nearby lift them to MIN_SCORE.

Native: regular expressions and array functions of Spark alone. A pattern's matches and the pieces of text between them
give the places, as prefix sums of lengths (in code points), so every step is linear in the text. The patterns use
possessive repetition, which matches the same here and doesn't recurse, so a long run of digits can't exhaust a stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinotable.llm import _text

#: Kinds in their order, with pattern. The first four are the base.
PATTERNS = {
    # a run of local characters starts where the text or the last match ends or behind another character
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # in one run or in groups of four
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9])",
    "tel": r"(?<![A-Za-z0-9])0[0-9]{2,4}[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,4}(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for a pattern to be tried.
NEEDED = {"email": "@", "ip": ".", "phone": "+", "ssn": "-", "tel": "0"}
#: Words near a span that make it more likely, in either case; no letter or digit may stand before or behind.
CONTEXT = {
    "email": "e-?mail|contact|write|reach",
    "ip": "ip|address|host|server|client",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax|whatsapp",
    "iban": "iban|bank|account|konto|transfer",
    "ssn": "ssn|social|security|identity",
    "tel": "phone|tel|call|mobile|fax|whatsapp",
}
#: Score of a confirmed span, what a word nearby adds, and how many code points before and behind are near.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "tel": 0.4}
NEARBY, REACH = 0.2, 40
#: Least score of a span that isn't of the base.
MIN_SCORE = 0.5

_RUN = 256


def _running(values: Column, first: Column, add) -> Column:
    """For each element what add() makes of `first` and the elements before it; in two levels, so that a long array isn't copied once for each element."""
    def let(value: Column, use) -> Column:  # evaluated once, not in each step of what uses it
        return F.element_at(F.transform(F.array(value), use), 1)

    def within(part: Column, begin: Column) -> Column:
        return F.aggregate(part, F.array(begin), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _RUN).cast("int")), lambda b: F.slice(v, b * _RUN + 1, F.lit(_RUN)))

    def filled(blocks: Column) -> Column:
        begins = within(F.transform(blocks, lambda b: F.aggregate(b, first, add)), first)
        return let(begins, lambda starts: F.flatten(F.transform(blocks, lambda b, k: F.slice(within(b, F.get(starts, k)), F.lit(1), F.size(b)))))

    return let(values, lambda v: let(cut(v), filled))


def starts(lengths: Column) -> Column:
    """Sums of the lengths before each."""
    return _running(F.transform(lengths, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    compact = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substr(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), F.lit(-3)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(14, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return mod97(m) if kind == "iban" else F.lit(True)


def _places(kind: str, size) -> Column:
    """Where the pieces of one kind begin, in what size() measures."""
    m, p = F.col(f"m_{kind}"), F.col(f"p_{kind}")
    return starts(F.zip_with(m, F.slice(p, F.lit(1), F.size(m)), lambda a, b: size(a) + size(b)))


def _found(kind: str) -> Column:
    """Confirmed spans of one kind from columns m_ (matches), p_ (pieces between them), a_ and b_ (where pieces begin)."""
    p = F.col(f"p_{kind}")

    def span(x: Column, k: Column) -> Column:
        near = F.concat(F.right(F.get(p, k), F.lit(REACH)), F.lit(" "), F.left(F.get(p, k + 1), F.lit(REACH)))
        start, byte = F.get(F.col(f"a_{kind}"), k) + F.length(F.get(p, k)), F.get(F.col(f"b_{kind}"), k) + F.octet_length(F.get(p, k))
        return F.struct(
            start.alias("start"), F.lit(list(PATTERNS).index(kind)).alias("order"), (start + F.length(x)).alias("end"), byte.alias("byte"), (byte + F.octet_length(x)).alias("end_byte"), F.lit(kind).alias("kind"),
            (F.lit(SCORES[kind]) + F.when(near.rlike(f"(?i)(?<![A-Za-z0-9])(?:{CONTEXT[kind]})(?![A-Za-z0-9])"), NEARBY).otherwise(0.0)).alias("score"), confirmed(kind, x).alias("ok"),
        )

    return F.filter(F.transform(f"m_{kind}", span), lambda s: s["ok"] if kind in BASE else s["ok"] & (s["score"] >= MIN_SCORE))


def find(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """`keep` columns of docs(text) and pii: the confirmed spans of each row by start, then kind as listed: start, order, end, byte, end_byte, kind, score, ok.

    start and end are code points, byte and end_byte bytes of UTF-8, ends exclusive. A null or empty text has none. Matches of one kind don't overlap; those of
    different kinds can. Repeated rows and null ids each get their row. No name in `keep` may be pii.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("kept") if keep else F.lit(0).alias("kept"), text.alias("t"))
    none, kinds = F.array().cast("array<string>"), list(PATTERNS)
    match = {k: F.regexp_extract_all("t", F.lit(PATTERNS[k]), F.lit(0)) for k in kinds}
    match = {k: F.when(F.contains("t", F.lit(NEEDED[k])), x).otherwise(none) if k in NEEDED else x for k, x in match.items()}
    rows = rows.select("kept", "t", *(match[k].alias(f"m_{k}") for k in kinds))
    rows = rows.select("kept", *(f"m_{k}" for k in kinds), *(F.when(F.size(f"m_{k}") > 0, F.split("t", PATTERNS[k], -1)).otherwise(none).alias(f"p_{k}") for k in kinds))
    rows = rows.select("*", *(F.when(F.size(f"m_{k}") > 0, _places(k, f)).alias(f"{x}_{k}") for k in kinds for x, f in (("a", F.length), ("b", F.octet_length))))
    empty = F.array().cast("array<struct<start:bigint,order:int,end:bigint,byte:bigint,end_byte:bigint,kind:string,score:double,ok:boolean>>")
    spans = [F.when(F.size(f"m_{k}") > 0, _found(k)).otherwise(empty) for k in kinds]
    return rows.select(*(F.col("kept")[c].alias(c) for c in keep), F.array_sort(F.concat(*spans)).alias("pii"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scores(spans: Column) -> Column:
    """Scores in hundredths."""
    return F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")


def redacted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs with each span that scores at least `min_score` replaced by its kind in angle brackets; overlapping spans become one, named by the first. Rows, repeated ones too, columns and null texts stay, an empty table stays empty; n_chars follows the text if it is there."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = find(packed, keep=["row"]).select("row", F.filter("pii", lambda s: s["score"] >= min_score).alias("s"))
    # the end of all spans before each; those that start before it add to what is merged so far
    before = _running(F.transform("s", lambda s: s["end_byte"]), F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))
    found = found.select("row", "s", F.when(F.size("s") > 0, before).alias("e"))
    lead = F.filter(F.transform("s", lambda s, k: F.struct(s["byte"].alias("a"), s["kind"].alias("kind"), F.get("e", k).alias("e"))), lambda x: x["a"] >= x["e"])
    last = F.greatest(F.element_at("e", -1), F.element_at("s", -1)["end_byte"])
    found = found.select("row", F.when(F.size("s") > 0, lead).alias("l"), F.when(F.size("s") > 0, last).alias("last"), F.encode(F.col("row")["text"], "UTF-8").alias("raw"))
    own, raw = F.col("row")["text"], F.col("raw")
    cut = lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8")
    # what stands before each merged span begins where those before it have ended
    kept = F.transform("l", lambda x: F.concat(cut(x["e"], x["a"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    text = F.concat(F.array_join(kept, ""), cut(F.col("last"), F.octet_length(raw)))
    new = found.select("row", F.when(F.size("l") > 0, text).otherwise(own).alias("text"), (F.size("l") > 0).alias("cut"))
    return new.select(*(F.col("text") if c == "text" else F.when(F.col("cut"), F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(_text.table(spark, sf_dir, "documents"), keep=["doc_id"])
    of = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["order"] < len(BASE))
    return found.select("doc_id", *(of(k) for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), _scores(F.col("pii")).alias("scores"))


def brute(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, order, end, kind) of the base kinds by Python's re on the contract's patterns, for tests."""
    import re

    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind: str, m: str) -> bool:
        d = [int(c) for c in m if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(plain.items()) for m in re.finditer(p, text or "") if good(kind, m[0]))


def _sql() -> str:
    # boundaries of letters and digits: as \b once no underscore is left
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "tel": r"\b0[0-9]{2,4}[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,4}\b"}
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    near = f"translate(right(p[i], {REACH}) || ' ' || left(p[i + 1], {REACH}), {letters})"
    score = "CASE kind " + " ".join(f"WHEN '{k}' THEN {round(x * 100)} + CASE WHEN regexp_matches({near}, '\\b(?:{CONTEXT[k]})\\b') THEN {round(NEARBY * 100)} ELSE 0 END" for k, x in SCORES.items()) + " END"
    kinds = " UNION ALL ".join(f"SELECT r, '{k}' AS kind, {n} AS ord, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS p FROM d" for n, (k, p) in enumerate(plain.items()))
    total = lambda part: f"coalesce(list_sum(list_transform({part}, lambda v: length(v))), 0)"
    join = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord){}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in BASE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '_', '%') AS t FROM documents),
m AS ({kinds}),
s AS (SELECT r, kind, ord, m[i] AS x, ({total("p[1:i]")} + {total("m[1:i - 1]")})::BIGINT AS start, regexp_replace(m[i], '[^0-9]', '', 'g') AS digits, replace(m[i], ' ', '') AS compact, {score} AS score
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
ok AS (SELECT r, kind, ord, start, start + length(x) AS stop, score FROM s WHERE (ord < {len(BASE)} OR score >= {round(MIN_SCORE * 100)}) AND CASE kind
  WHEN 'ip' THEN len(list_filter(string_split(x, '.'), lambda v: length(ltrim(v, '0')) > 3 OR coalesce(try_cast(v AS BIGINT), 0) > 255)) = 0
  WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse(digits)[i]::INTEGER ELSE reverse(digits)[i]::INTEGER * 2 - CASE WHEN reverse(digits)[i]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
  WHEN 'iban' THEN list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(compact[5:] || compact[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), ''), ''), lambda c: c::INTEGER), lambda a, b: (a * 10 + b) % 97) = 1
  ELSE true END),
g AS (SELECT r, {counts}, {join.format(f" FILTER (ord < {len(BASE)})")} AS base, {join.format("")} AS spans, coalesce(string_agg(score::VARCHAR, ',' ORDER BY start, ord), '') AS scores FROM ok GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (r)
"""


SQL = _sql()
