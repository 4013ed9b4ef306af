"""The operators against brute force, exact round trips and held-out rows, with nulls, empty and repeated rows and clashing columns."""

import os
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinotable.llm import _text, decontaminate, langid, licenses, lmscore, packing, pii, queries, sharding, simhash, tokencount, topk

WORDS = "alpha beta gamma delta eins zwei drei été ñu Apache License mit general public 中文 x1 --- 42".split(" ")
ODD = [None, "", " ", "\n\n", "!!", "A", "É", "x" * 5000, "word " * 30000, "\0 \t", "😀", "same text here", "same text here"]


def texts(n, seed=7, words=WORDS, most=40):
    rnd = random.Random(seed)
    return ODD + [rnd.choice([" ", "\n", "  "]).join(rnd.choice(words) for _ in range(rnd.randint(1, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Ids with a null and a repeat, odd texts, and columns named as those the operators add."""
    rows = [(k, t, f"l{k % 3}" if k % 5 else None, "s", k, True) for k, t in enumerate(texts(80))]
    rows += [(None, "no id at all", None, None, None, None), rows[-1], (rows[-2][0], *rows[-2][1:])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, contaminated boolean").selectExpr("*", "'z' AS row", "1 AS spans", "2 AS pii", "3 AS score", "4 AS fp", "5 AS u", "6 AS slot", "7 AS key", "8 AS __text").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


SQL = sorted(n for n in queries.oracle_sql() if n.startswith("op"))


@pytest.mark.parametrize("name", SQL)
def test_query_against_sql(name, against_sql):
    against_sql(queries.queries()[name], queries.oracle_sql()[name])


# decontamination


def test_decontamination_against_brute_force(spark, docs):
    items = [("a", "alpha beta gamma"), ("b", " ".join(WORDS[:14])), ("c", None), ("d", ""), ("e", "word " * 12), ("f", "ALPHA, beta. Gamma"), (None, "zwei drei")]
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("n_words", F.lit(0))
    want = Counter()
    rows = docs.select("doc_id", "text").collect()
    for r, b in zip(rows, decontaminate.brute([x for x in items if x[0]], [r.text for r in rows]), strict=True):
        want[r.doc_id, b[0], b[2], b[3]] += 1
    for size in (1 << 20, 600):  # in one block, and in several
        found = decontaminate.digest(decontaminate.scan(docs, bench, index_bytes=size)).collect()
        assert Counter((r.doc_id, r.n_words, r.n_items, r.items_sha256) for r in found) == want
    named = bench.where("item_id IS NOT NULL")
    hits = {r.doc_id: r.n_hit for r in decontaminate.digest(decontaminate.scan(docs, named)).collect()}
    for r, b in zip(rows, decontaminate.brute([x for x in items if x[0]], [r.text for r in rows]), strict=True):
        assert hits[r.doc_id] == b[1] or r.doc_id is None


def test_index_of_a_large_benchmark():
    import time

    import pyarrow as pa

    rnd = np.random.default_rng(3)
    vocabulary = np.array([f"w{k}x" for k in range(30000)])
    items = [" ".join(vocabulary[rnd.integers(0, 30000, 400)]) for _ in range(2000)]
    items += items[:500]  # items that share all windows
    began = time.perf_counter()
    index = decontaminate.Windows(pa.table({"item_id": [str(k) for k in range(2500)], "text": items}))
    n = 2500 * 391
    assert time.perf_counter() - began < 30 and index.nbytes() < n * decontaminate.WINDOW_BYTES + (16 << 20)
    text = "start " + items[7][:2000].rsplit(" ", 1)[0] + " end"
    data = np.frombuffer(text.encode(), np.uint8)
    from kinotable.llm import _text

    hits = list(index.find(*_text.word_bounds(data, np.array([0, len(data)]))))
    assert len(hits) == len(text.split()) - 2 - 9 and all(ids == {"7", "2007"} for _, _, ids in hits)


def test_decontamination_cuts_and_drops(spark):
    passage = " ".join(f"w{k}" for k in range(10))
    rows = [(1, f"Été one two {passage} three " + "four " * 20, 0), (2, passage, 0), (3, "clean", 5), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.clean(df, bench).collect()}
    cut = "Été one two \n three " + "four " * 20
    assert got == {1: (cut, len(cut)), 3: ("clean", 5), 4: (None, None)}


def test_decontamination_empty(docs, none, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(decontaminate.scan(none, bench)).count() == 0
    assert decontaminate.digest(decontaminate.scan(docs, bench)).where("contaminated").count() == 0
    assert decontaminate.clean(docs, bench).count() == docs.count()


# near duplicates


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(fps, distance):
    """Smallest key reachable, by brute force."""
    least = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= distance and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_fingerprints_of_parts(monkeypatch):
    for t in texts(40):
        assert simhash.fingerprint(t and t.encode()) == plain_fingerprint(t), t
    long = " ".join(WORDS[k * 7 % len(WORDS)] for k in range(3000)) + " "
    monkeypatch.setattr(simhash, "CHUNK", 101)
    assert simhash.fingerprint(long.encode()) == plain_fingerprint(long)
    assert simhash.fingerprint(long.strip().encode()) == plain_fingerprint(long)


@pytest.mark.parametrize(("distance", "cut"), [(4, None), (4, [(0, 32, 2), (32, 32, 1)]), (4, [(0, 22, 1), (22, 21, 1), (43, 21, 0)]), (7, None), (10, [(0, 16, 2), (16, 16, 2), (32, 16, 2), (48, 16, 1)]), (1, None), (0, None)])
def test_links_are_whole(spark, distance, cut):
    rnd = random.Random(distance)
    centres = [rnd.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = sorted({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 9))) for c in centres for _ in range(25)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, cut).collect()]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    assert len(got) == len(set(got)) and set(got) == want


def test_stars(spark):
    rnd = random.Random(3)
    edges = [(a, a + 1) for a in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)] + [(5, 5)]
    got = {r.u: r.v for r in simhash.stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {k: v for k, v in least.items() if k != v}
    frame = spark.createDataFrame(edges, "u long, v long").repartition(5)
    assert {r.u: r.v for r in simhash.stars(frame, 0).collect()} == got  # in rounds, without a task that has all
    assert simhash.stars(frame.where("false")).count() == 0


def test_dense_groups_give_few_links(spark):
    rnd = random.Random(8)
    fps = sorted({sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 3))) for _ in range(1500)} | {rnd.getrandbits(63) for _ in range(300)})
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    cut = simhash.segments(len(fps))
    want = {k: v for k, v in grouped({x: x for x in fps}, 4).items() if k != v}
    assert {r.u: r.v for r in simhash.groups(frame, len(fps)).collect()} == want
    assert simhash.heads(frame, 4, cut).count() < 20 * len(fps) < simhash.links(frame, 4, cut).count()


def test_components_against_brute_force(docs, none):
    rows = docs.select("doc_id", "text").distinct().where("doc_id IS NOT NULL").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = grouped(fps, 4)
    got = simhash.components(docs).collect()
    assert {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got if r.doc_id is not None} == {(k, fps[k], want[k]) for k in fps}
    assert len(got) == docs.count() and simhash.components(none).count() == 0


def test_near_duplicates(spark, docs, none):
    rnd = random.Random(5)
    base = [[f"w{rnd.randint(0, 5000)}" for _ in range(300)] for _ in range(6)]
    rows = []
    for k, words in enumerate(base):
        rows += [(100 * k, " ".join(words)), (100 * k + 1, " ".join(words))]
        for j in range(2, 12):  # up to three words changed: similar at 0.8 or more
            w = words.copy()
            for at in rnd.sample(range(300), 1 + j % 3):
                w[at] = f"new{j}"
            rows.append((100 * k + j, " ".join(w)))
    kept = sorted(r.doc_id for r in simhash.distinct(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [k for k in kept if k % 100 == 0] == [0, 100, 200, 300, 400, 500] and len(kept) <= 9
    left = simhash.distinct(docs)
    assert left.columns == docs.columns and left.where("doc_id IS NULL").count() == 1
    assert left.groupBy("doc_id").count().where("count > 1").count() == 0
    assert left.where("text = 'same text here'").count() == 1 and simhash.distinct(none).count() == 0


def shingle_sets(rows):
    return {k: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, t.lower().split()) for k, t in rows)}


def test_near_duplicates_beyond_ten_bits(spark):
    rnd = random.Random(11)
    rows = []
    for k in range(40):  # pairs of 50 to 120 words, one to three of them changed, so around a similarity of 0.8
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(50, 120))]
        rows.append((2 * k, " ".join(words)))
        for at in rnd.sample(range(len(words)), 1 + k % 3):
            words[at] = f"new{k}"
        rows.append((2 * k + 1, " ".join(words)))
    sets, fps = shingle_sets(rows), {k: plain_fingerprint(t) for k, t in rows}
    bits = {k: (fps[k] ^ fps[k + 1]).bit_count() for k in fps if k % 2 == 0}
    alike = {k for k in bits if len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1])}
    assert any(bits[k] > 10 for k in alike) and any(k not in alike for k in bits)
    kept = {r.doc_id for r in simhash.distinct(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {k for k in fps if k % 2 == 0 or k - 1 not in alike}


def test_near_duplicates_of_members(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(300)]
    rows = []
    for j in range(700):  # a dense group, in which some are near to other members than the one with most links
        words = base.copy()
        for at in rnd.sample(range(300), rnd.randint(1, 5)):
            words[at] = f"new{rnd.randint(0, 10**9)}"
        rows.append((j, " ".join(words)))
    sets = shingle_sets(rows)
    reached, todo = {0}, [0]
    while todo:
        near = {k for k in sets.keys() - reached if len(sets[k] & sets[todo[-1]]) >= 0.8 * len(sets[k] | sets[todo[-1]])}
        todo = todo[:-1] + sorted(near)
        reached |= near
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert reached == set(sets) and set(got.values()) == {0}


def test_near_duplicates_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    sets = shingle_sets(rows)
    least = {k: k for k in sets}
    pairs = [(a, b) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in pairs:
        old = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if old == least:
            break
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == least
    assert sorted(r.doc_id for r in simhash.distinct(docs).collect()) == sorted(set(least.values()))


def test_keys_that_the_sample_does_not_know(spark, sf, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash, "CROWD", 5)
    rnd = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [" ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(100)) for _ in range(120)]
    rows = [(k, f"{t[:200]} {passage} {t[200:]}") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [(500, rows[7][1] + " end")], "doc_id long, text string")
    frequent = simhash._frequent(df)
    keyed = simhash._keyed(df, 0.8, frequent).select("node", "t", "keys")
    most = lambda held: held.selectExpr("max(count)").first()[0]
    before = keyed.selectExpr("explode(keys) AS key").groupBy("key").count()
    after, held = simhash._uncrowded(keyed, df, 0.8, frequent)
    assert most(before) > 50 and most(held) <= 5 and after.count() == 121
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {k: k for k in range(120)} | {500: 7}
    test_near_duplicates_against_brute_force(spark, sf)


def test_near_duplicates_keep_little_on_disk(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)  # as where more texts are asked for than ids may be broadcast
    rnd = random.Random(21)
    rows = []
    for k in range(300):  # groups of four near copies, of 1,000 words
        words = [f"w{rnd.randint(0, 10**6)}" for _ in range(1000)]
        for j in range(4):
            rows.append((4 * k + j, " ".join(words)))
            words[rnd.randrange(1000)] = f"new{j}"
    local = [d.toString() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shared = _text.shared_folder(spark).removeprefix("file:")

    def held():
        found = [(d, x) for top in (*local, shared) for d, _, names in os.walk(top) for x in names if top == shared or x.startswith("shuffle_")]
        return {os.path.join(*f): os.path.getsize(os.path.join(*f)) for f in found if os.path.exists(os.path.join(*f))}

    counted, before, most = _text.counted, held(), []

    def watched(df):
        out = counted(df)
        time.sleep(0.2)  # files go in the background
        most.append(sum(n for f, n in held().items() if f not in before))
        return out

    monkeypatch.setattr(_text, "counted", watched)
    with _text.passing(spark):
        kept = sorted(r.doc_id for r in simhash.distinct(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect())
    assert kept == list(range(0, 1200, 4))
    assert max(most) < 1.5 * sum(len(t) for _, t in rows)


def test_asked_rows(spark, monkeypatch):
    rows = spark.range(40_000).select(F.xxhash64(F.col("id") % 20_000).alias("id"), F.col("id").alias("x"))
    ids = spark.range(0, 20_000, 100).select(F.xxhash64("id").alias("t"))
    want = {r.t for r in ids.collect()}
    got = [r.id for r in simhash._asked(rows.coalesce(1), ids, 200).collect()]
    assert len(got) == len(set(got)) < 1000 and want <= set(got)
    assert simhash._asked(rows, ids.where("false"), 0).count() == 0
    monkeypatch.setattr(simhash, "MOST_BITS", 15)  # more others, but none less
    assert want <= {r.id for r in simhash._asked(rows, ids, 200).collect()}


def test_a_task_has_one_python_worker(spark, sf, monkeypatch):
    """Two Python steps in one stage have a worker each, and so twice the memory."""
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash, "CROWD", 5)
    counted, seen = _text.counted, []

    def behind(node):
        """Python steps one behind the other, with no exchange between them."""
        below = max([0, *(behind(node.children().apply(k)) for k in range(node.children().size()))])
        seen.append(below + any(x in node.nodeName() for x in ("Arrow", "Python")))
        return 0 if "Exchange" in node.nodeName() else seen[-1]

    def watched(df):
        behind(df._jdf.queryExecution().executedPlan())
        return counted(df)

    monkeypatch.setattr(_text, "counted", watched)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that plans show exchanges before they run
    try:
        simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert max(seen) == 1


def test_sketches_lose_no_similar_pair():
    rnd = np.random.default_rng(2)
    for _ in range(300):
        n = int(rnd.integers(1, 3000))
        a = rnd.integers(0, 2**64, n, np.uint64)
        b = np.unique(np.concatenate([a[rnd.random(n) < rnd.random()], rnd.integers(0, 2**64, int(rnd.integers(1, max(2, n // 3))), np.uint64)]))
        a = np.unique(a)
        assert simhash._apart(simhash._sketch(a), simhash._sketch(b)) <= len(np.setxor1d(a, b))
        assert simhash._apart(simhash._sketch(a, 512), simhash._sketch(b, 512)) <= len(np.setxor1d(a, b))
    far = [simhash._sketch(np.unique(rnd.integers(0, 2**64, 1000, np.uint64))) for _ in range(2)]
    assert simhash._apart(*far) > 2000 * 0.2 / 1.8


def test_rows_that_repeat_an_id(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (1, b, "z"), (2, a, "x"), (3, b + " end", "w"), (None, a, "n"), (None, a, "n")]
    left = simhash.distinct(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).collect()
    assert Counter(tuple(r) for r in left) == Counter({(1, a, "x"): 1, (1, b, "z"): 1, (None, a, "n"): 2})


def test_near_duplicates_are_six_groups(spark):
    rnd = random.Random(5)
    base = [[f"w{rnd.randint(0, 5000)}" for _ in range(300)] for _ in range(6)]
    rows = []
    for k, words in enumerate(base):
        rows += [(100 * k, " ".join(words)), (100 * k + 1, " ".join(words))]
        for j in range(2, 12):
            w = words.copy()
            for at in rnd.sample(range(300), 1 + j % 3):
                w[at] = f"new{j}"
            rows.append((100 * k + j, " ".join(w)))
    kept = sorted(r.doc_id for r in simhash.distinct(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [0, 100, 200, 300, 400, 500]


# language ID


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = langid.query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found) > 0
    assert all(0 <= r.score <= 1 for r in found)


def test_language_viterbi_and_shortcut():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        s = rnd.normal(0, 6, (3, int(rnd.integers(1, 9))))
        best = max(((sum(s[path[k], k] for k in range(s.shape[1])) - langid.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False)), path) for path in np.ndindex(*[3] * s.shape[1])), key=lambda x: x[0])[0]
        spans = langid.viterbi(s)
        got = sum(s[x, a : a + n].sum() for x, a, n in spans) - langid.SWITCH * (len(spans) - 1)
        assert got == pytest.approx(best) and sum(n for *_, n in spans) == s.shape[1]


def test_language_shortcut_is_the_best_path():
    rnd, letters = random.Random(4), "abcdeé"
    counts = np.random.default_rng(4).integers(0, 50, (3, langid.BUCKETS)).astype(float) ** 2
    scripts = np.ones((3, len(langid._NAMES) + 1))
    scripts[2, langid._NAMES.index("Cyrillic") + 1] = 1e6  # Cyrillic narrows to one language
    model = langid.Model(["x", "y", "z"], counts, scripts)
    assert 0 < model.allowed.sum() < model.allowed.size
    texts = ["".join(rnd.choice([letters, "жш", letters])[rnd.randrange(2)] if rnd.random() < 0.8 else " " for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    words = langid.Words(np.frombuffer(data, np.uint8), offsets)
    s, one = model.scores(words), 0
    for k, spans in enumerate(model.label(words)):
        own = s[:, words.before[k] : words.before[k + 1]]
        total = lambda path: sum(own[x, a : a + n].sum() for x, a, n in path) - langid.SWITCH * (len(path) - 1)  # noqa: B023, E731
        if own.shape[1]:
            one += len(spans) == 1
            assert total(spans) == pytest.approx(total(langid.viterbi(own)), abs=1e-2)
    assert 20 < one < 300


def test_language_samples_distinct_texts_of_many_languages(spark, monkeypatch):
    rows = [("the same text again and again", "en")] * 3000 + [(f"another text number {k} with words", "en") for k in range(40)]
    rows += [(f"text of language number {k} here", f"l{k:04d}") for k in range(600)]
    monkeypatch.setattr(langid, "NUMBERS", 1 << 18)
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), 30)
    assert len(model.langs) == 601 and model.logs.size <= 1 << 18
    assert model.logs[0].max() - model.logs[0].min() > 1  # learned from several texts
    got = langid.predict(spark.createDataFrame([("another text number 7 with words",)], "text string"), model).collect()
    assert got[0].lang_pred in model.langs


def test_language_edges(spark, docs, none):
    train = [(k, t, x) for k, (t, x) in enumerate([("the cat and the dog are here with them", "en"), ("der Hund und die Katze sind hier mit ihnen", "de"), ("кошка и собака здесь вместе с нами", "ru")] * 4)]
    model = langid.fit(spark.createDataFrame(train, "k long, text string, lang string"))
    rows = ["the dog and the cat are with them here the dog and the cat", "die Katze und der Hund sind mit ihnen hier", "собака и кошка", "123 !?", None, "", "——", "中文", "the dog and the cat are here with them and the dog собака и кошка здесь вместе с нами кошка и собака"]
    got = langid.predict(spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k long, text string").coalesce(1), model, ["k"]).orderBy("k").collect()
    assert [r.lang_pred for r in got][:7] == ["en", "de", "ru", "und", "und", "und", "und"]
    assert got[7].lang_pred in ("en", "de", "ru") and got[7].score == 0 and got[3].score == 0
    assert [s.lang for s in got[8].lang_spans] == ["en", "ru"] and 0.4 < got[8].score < 1
    assert langid.predict(docs, langid.learn(none), ["doc_id"]).where("lang_pred <> 'und'").count() == 0
    assert langid.accepted(docs).columns == docs.columns and langid.accepted(none).count() == 0


# top-k


def test_topk_against_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in rnd.normal(0, 0.3, 8)]) for k in range(130)] + [(200 + k, [0.5] * 8) for k in range(60)]
    rows += [(500, None), (501, [1.0, None] * 4), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (520, [1.0, 2.0]), (521, [2.0, 2.0]), (540, []), (541, []), (None, [1.0] * 8), rows[0], (560, [1e300] * 8), (580, [3e7] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("rank", F.lit(2)).withColumn("row", F.lit(3)).repartition(3)
    held = lambda x: max(-(2**63), min(2**63 - 1, x))
    x = [(k, [held(int(np.floor(64 * c))) for c in v]) for k, v in rows if k is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = Counter()
    for a, (q, u) in enumerate(x):
        if q % 20 == 0:
            best = sorted((-held(sum(c * d for c, d in zip(u, w, strict=True))), v) for b, (v, w) in enumerate(x) if a != b and len(w) == len(u))[:20]
            want.update((q, n, v, -s) for n, (s, v) in enumerate(best, 1))
    for size in (topk.QUERY_BYTES, 300):  # all queries at once, and in blocks
        monkeypatch.setattr(topk, "QUERY_BYTES", size)
        assert Counter(tuple(r) for r in topk.search(df).select("query_id", "rank", "vec_id", "score").collect()) == want
    assert topk.search(df.where("false")).count() == 0


def test_topk_sql_on_repeated_ids(spark, tmp_path):
    import duckdb

    rnd = np.random.default_rng(6)
    rows = [(int(k % 50), [float(x) for x in rnd.normal(0, 0.3, 6)]) for k in range(120)] + [(20, [1e5] * 6), (20, [1e5] * 6), (41, [-1e5] * 6), (None, [1.0] * 6), (60, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = topk.query(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert Counter(map(tuple, got)) == Counter(con.execute(topk.SQL).fetchall()) and len(got) > 20


def test_index_reads_few_postings_and_stays_exact():
    rnd = np.random.default_rng(4)
    x = rnd.integers(-3, 4, (4000, 32)) + np.where(rnd.random((4000, 32)) < 0.02, 60, 0)
    q = x[:40].copy()
    q[:, 16:] = 0  # dimensions that no query has
    index, best = topk.Index(np.arange(4000), np.arange(4000), x), topk.Best(40, 10)
    query, at = index.search(q, best.least, 10)
    best.add(query, topk._products(x[at], q[query]), index.ids[at], index.rows[at])
    for k, row in enumerate(q):
        exact = x @ row
        order = np.lexsort((np.arange(4000), -exact))[:10]
        own = best.rows[0] == k
        assert best.rows[2][own].tolist() == order.tolist() and (-best.rows[1][own]).tolist() == exact[order].tolist()
    assert len(at) < 4000 * 40 // 4 and 0 < index.read < 0.6 * index.postings
    later = topk.Index(np.arange(4000), np.arange(4000, 8000), x // 4)  # no vector reaches what was found before
    later.search(q, best.least, 10)
    assert later.read < 0.6 * later.postings / 2


# language-model scores


def test_lm_scores_against_brute_force(spark, docs, none):
    target = spark.createDataFrame([(20,), (21,), (21,), (22,), (None,), (999,)], "doc_id long")
    got = lmscore.score(docs, target).collect()
    rows = docs.select("doc_id", "text").collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = [tok.encode(r.text or "", add_special_tokens=False).ids for r in rows]
    v = tok.get_vocab_size()
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]

    own_target = [r.doc_id in (20, 21, 22) for r in rows]
    for t, own in zip(own_target, ids, strict=True):
        for m in (0, 1) if t else (0,):
            uni[m].update(own + ([v] if own else []))
            bi[m].update(zip([v, *own], own, strict=False))
    total = [sum(n for t, n in u.items() if t != v) for u in uni]
    by = {0: total[1] / total[0], 1: 1.0}
    want = defaultdict(list)
    for r, t, own in zip(rows, own_target, ids, strict=True):
        loss, left, pairs = [0.0, 0.0], Counter([v, *own]), Counter(zip([v, *own], own, strict=False))
        for m in (0, 1):
            out = 1 if m == 0 or t else 0  # a text's own counts are left out
            for a, b in zip([v, *own], own, strict=False):
                p = ((uni[m][b] - left[b] * out) * by[m] + lmscore.PSEUDO) / ((total[m] - len(own) * out) * by[m] + lmscore.PSEUDO * v)
                n = (uni[m][a] - left[a] * out) * by[m]
                loss[m] -= np.log(((bi[m][a, b] - pairs[a, b] * out) * by[m] + lmscore.BACKOFF * p) / (n + lmscore.BACKOFF))
        want[r.doc_id].append((len(own), (loss[1] - loss[0]) / len(own) if own else None))
    for r in got:
        n, s = want[r.doc_id][0]
        assert r.n_tokens == n and (r.score is None if s is None else r.score == pytest.approx(s, abs=1e-3))
    assert len(got) == len(rows) and lmscore.score(none, target).count() == 0
    assert lmscore.score(docs, target.where("false")).where("score IS NULL AND n_tokens > 0").count() == 0


def test_lm_bigrams_are_exact(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "CHUNK", 1 << 16, raising=False)
    tok = Tokenizer.from_file(packing.tokenizer_path())
    v, rnd = tok.get_vocab_size(), random.Random(2)
    rows = [(k, tok.decode([rnd.randrange(1000, v) for _ in range(400)])) for k in range(300)]  # far more bigrams than a fixed table tells apart
    rows += [(1000 + k, t) for k, t in rows[:30]]  # texts that occur twice
    got = {r.doc_id: r.background_loss for r in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k,) for k, _ in rows], "doc_id long")).collect()}
    twice = [got[k] for k in [*range(30), *range(1000, 1030)]]
    assert len(got) == len(rows) and max(twice) < min(x for k, x in got.items() if 30 <= k < 300) - 1


def test_lm_scores_tell_quality(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    means = {r.quality: r.m for r in lmscore.query(spark, sf).join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("m")).collect()}
    assert means[1] < means[0]


# personal data


def test_pii_against_brute_force(spark, docs, none):
    rnd = random.Random(9)
    bits = ["a", "b@c.d", "_", "@", ".", "1.2.3.4", "999.", "+1 (234) 555-1234", "4111 1111 1111 1111", "-", " ", "é", "😀", "7", "+", "5555", "DE89370400440532013000", "x.y", "c.d_e@f.g", "call ", "\n", "(", ")"]
    rows = list(enumerate(["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(800)] + ODD + [" ".join(["x@y.zz"] * 700)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.pii for r in pii.find(df, ["doc_id"]).collect()}
    assert {k: [(s.start, s.order, s.end, s.kind) for s in v if s.order < 4] for k, v in found.items()} == {k: pii.brute(t) for k, t in rows}
    assert any(s.kind == "iban" for v in found.values() for s in v)
    for r in pii.redacted(df).collect():
        merged, text = [], rows[r.doc_id][1]
        for s in found[r.doc_id]:
            if merged and s.start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s.end)
            else:
                merged.append([s.start, s.end, s.kind])
        out, at = "", 0
        for a, b, kind in merged:
            out, at = out + text[at:a] + f"<{kind.upper()}>", b
        assert r.text == (None if text is None else out + text[at:])
    assert pii.redacted(docs).columns == docs.columns and pii.redacted(none).count() == 0 and pii.find(none).count() == 0


def test_pii_long_runs(spark):
    rows = [(0, "1" * 200000), (1, "a" * 100000), (2, "a@b" + ".c" * 50000), (3, "+1" + "-" * 100000)]
    got = {r.doc_id: len(r.pii) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0}


def test_pii_checks_and_context(spark):
    rows = [("DE89 3704 0044 0532 0130 00 Please pay",), ("DE88 3704 0044 0532 0130 00",), ("GB82WEST12345698765432 OK",), ("NO93 8601 1117 947",), ("xDE89370400440532013000",)]
    df = spark.createDataFrame(rows, "text string").coalesce(1)
    assert [len(r.pii) for r in pii.find(df.select("text")).select("pii").collect()] == [1, 0, 1, 1, 0]
    scores = [r.pii[0].score for r in pii.find(spark.createDataFrame([("phone: +1 234 555 1234",), ("xx +1 234 555 1234",)], "text string").coalesce(1)).collect()]
    assert scores == pytest.approx([0.8, 0.6])


def test_pii_context_decides_on_weak_proposals(spark):
    rows = ["SSN 123-45-6789", "item 123-45-6789", "please call 030 1234 567 today", "part 030 1234 567 today", "xphone 030 1234 567", "phone" + " " * 60 + "030 1234 567", "from 10.0.0.1", "_tel_ 0301 123 4567"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.pii] for r in pii.find(df, ["doc_id"]).collect()}
    assert got == {0: ["ssn"], 1: [], 2: ["tel"], 3: [], 4: [], 5: [], 6: ["ip"], 7: ["tel"]}
    assert {r.doc_id: r.text for r in pii.redacted(df).collect()}[2] == "please call <TEL> today"
    assert pii.redacted(df, 0.7).where("doc_id IN (0, 2, 6)").where("text LIKE '%<%'").count() == 0  # scores decide


def test_pii_weak_proposals_against_sql(spark, tmp_path):
    import duckdb

    rnd = random.Random(12)
    bits = ["phone ", "TEL ", "ssn:", "_", "030 1234 567", "0301/1234567", "123-45-6789", "a", " ", "é", ".", "call", " and so on for a while ", "b@c.d", "1.2.3.4", "host", "4111 1111 1111 1111", "\n"]
    rows = [(k, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))) for k in range(1500)] + [(None, None), (1, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(pii.SQL)
    names = [c[0] for c in want.description]
    got = pii.query(spark, str(tmp_path)).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall()) and sum("tel" in r.spans for r in got) > 10 < sum("ssn" in r.spans for r in got)


# licenses


def test_licenses(spark, docs, none):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [(0, "x " * 100 + mit + " y" * 100), (1, "MIT\nLicense; General-Public License mit license"), (2, "mit_license unmit license"), (3, "Été " + " ".join(mit.split()[:8])), (4, None), (5, "LICENSED under the\nApache License, Version 2.0"), (6, "---"), (7, "mit license " * 3000)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert {x.label for x in got[0].found} == {"mit"} and got[0].n_base == 0 and got[0].found[0].containment == 1
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 5, ["gpl", "mit"])
    assert (got[2].n_words, got[2].n_base) == (4, 1) and (got[3].n_words, got[3].found) == (9, [])
    assert (got[4].n_words, got[6].n_words, got[7].n_base, got[7].last_word) == (0, 0, 3000, 5998)
    assert {x.label for x in got[5].found} == {"apache"}
    assert licenses.scan(docs, ["doc_id"]).count() == docs.count() and licenses.scan(none).count() == 0
    with pytest.raises(ValueError, match="templates"):
        licenses.Index([("x", " ".join(f"w{k}" for k in range(9999)))], {f"w{k}": 1 for k in range(9999)})
    with pytest.raises(ValueError, match="names"):
        licenses.scan(docs, ["found"])


def test_license_blocks_slide_by_word(spark):
    rnd = random.Random(7)
    long = " ".join(f"t{k}" for k in range(45))  # a template of more words than half a block
    templates = [("a", "one two three four five six seven eight nine ten"), ("b", "one two red blue green"), ("long", long), ("a", "x y")]
    vocabulary = sorted({w for _, t in templates[:2] for w in t.split()}) + ["pad"] * 60 + ["x"]
    rows = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 400)))) for k in range(120)]
    spread = "one " + "pad " * 20 + "two three four " + "pad " * 20 + "five six seven " + "pad " * 9 + "eight"  # 57 words, over any grid
    rows += [(200 + k, "pad " * k + spread + " pad" * 50) for k in range(0, 64, 7)] + [(300, "pad " * 40 + long + " pad" * 9), (301, long.replace("t3 ", "t3 pad ").replace("t30 ", "")), (302, "One TWO \u212Aelvin x Y" * 3)]
    got = {r.doc_id: {(x.label, round(x.containment, 6)) for x in r.found} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], templates).collect()}
    for k, text in rows:
        words, want = "".join(c.lower() if c.isascii() else c for c in text).split(), set()
        for label, t in templates:
            parts = set(t.split())
            reach = licenses.reach(len(t.split()))
            best = max(len(parts & set(words[i : i + reach])) for i in range(len(words)))
            if best >= licenses.need(len(parts)):
                want.add((label, round(best / len(parts), 6)))
        assert got[k] == want, k
    assert all(any(x == "a" for x, _ in got[k]) for k in range(200, 264, 7)) and {x for x, _ in got[300]} == {x for x, _ in got[301]} == {"long"}


@settings(max_examples=20, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4), min_size=1, max_size=12), st.lists(st.text("abc", min_size=1, max_size=4), max_size=20))
def test_word_pattern(words, text):
    import re

    pattern = licenses.any_of(sorted(words))
    assert re.findall(pattern, " ".join(text)) == [w for w in text if w in words]


# sharding


@pytest.mark.parametrize(("n", "slots"), [(1, 2), (3, 7), (5, 101), (12, 1009)])
def test_lookup_against_turns(n, slots):
    shards = tuple(f"s{k}" for k in range(n))
    table = sharding.lookup(shards, slots)
    assert table == sharding.brute(shards, slots)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1


def test_few_slots_move():
    shards = tuple(f"s{k}" for k in range(20))
    a, b = sharding.lookup(shards, 4099), sharding.lookup(shards[:-1], 4099)
    assert sum(x != y for x, y in zip(a, b, strict=True) if x < 19) < 0.15 * 4099
    for bad in (((), 7), (("a", "a"), 7), (("a", "b"), 8)):
        with pytest.raises(ValueError, match="prime"):
            sharding.lookup(*bad)


def test_placement(docs, none):
    got = sharding.place(docs, keep=["doc_id"]).collect()
    assert len(got) == docs.count() and len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.place(none).count() == 0


# tokens


ALPHABET = st.sampled_from([" ", "  ", "\n", "\t", "a", "the", "tion", "é", "ß", "▁", " ", "　", "中", "<s>", "</s>", "<unk>", "<0x0A>", ".", "12", "<|endoftext|>", "\0", "①", "ing", "'s", "😀", " \n"])
TEXT = st.lists(ALPHABET, max_size=12).map("".join)


@pytest.fixture(scope="module")
def counter():
    with open(tokencount.tokenizer_path(), "rb") as f:
        model = f.read()
    single = tokencount.proved(model)
    assert len(single) > 10_000
    return tokencount.Counter(model, single)


@pytest.fixture(scope="module")
def encoder():
    with open(packing.tokenizer_path()) as f:
        spec = f.read()
    merges = packing.quick_merges(spec)
    assert len(merges) == 50256
    return packing.Encoder(spec, merges)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_counts_as_the_library(counter, text):
    assert counter(text) == len(counter.sp.encode(text))


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_as_the_library(encoder, text):
    assert np.frombuffer(encoder(text), np.uint16).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_counts_of_rows(docs, none, counter, monkeypatch):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.counts(docs).collect())
    want = Counter((r.doc_id, len((r.text or "").encode()), len(counter.sp.encode(r.text or ""))) for r in docs.collect())
    assert got == want and tokencount.counts(none).count() == 0
    monkeypatch.setattr(tokencount, "REMEMBER", 3)
    assert [counter(t) for t in texts(30)] == [len(counter.sp.encode(t or "")) for t in texts(30)]


def test_other_vocabularies_go_to_the_library():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        assert packing.quick_merges(f.read()) is None


# packing


@pytest.mark.parametrize("length", [2048, 64])
def test_packing_round_trip(docs, none, encoder, length):
    pieces = packing.pack(docs, length=length).collect()
    own = defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        own[r.doc_id].append((r.start, ids, r.doc_tokens))
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, tuple(encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in rows)
    once = {k: x for (k, x), n in want.items() if n == 1 and sum(r.doc_id == k for r in rows) == 1}
    for k, ids in once.items():
        joined = [x for _, part, _ in sorted(own[k], key=lambda p: p[0]) for x in part]
        assert tuple(joined) == ids and [s for s, *_ in sorted(own[k])] == np.cumsum([0, *(len(p) for _, p, _ in sorted(own[k], key=lambda p: p[0]))])[:-1].tolist() and {t for *_, t in own[k]} == {len(ids)}
    assert sum(r.length for r in pieces) == sum(len(x) * n for (_, x), n in want.items())
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or at < length and at & (at - 1) == 0
    assert packing.pack(none).count() == 0


def test_packing_digest(spark, sf):
    got = packing.query(spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    tok = Tokenizer.from_file(packing.tokenizer_path())
    some = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()}
    for r in got.where(F.col("doc_id").isin(list(some))).collect():
        ids = (tok.encode(some[r.doc_id], add_special_tokens=False).ids + [1])[r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_are_neighbours(dimensions, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    keys = packing.hilbert(points, bits)
    walk = points[np.argsort(keys)]
    assert sorted(keys) == list(range(len(points))) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_packing_ranges_hold_equal_tokens(spark):
    rnd = random.Random(3)
    rows = [(k, "the same long text over and over " * 30) for k in range(400)]  # a third of all tokens and more at one place of the curve
    rows += [(1000 + k, " ".join(rnd.choice(["stone", "river", "tree", "x", "été", "Haus"]) for _ in range(rnd.randint(1, 900)))) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = 12
    held = packing.dealt(packing.encoded(df), parts).groupBy("part").agg(F.sum("tokens").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).orderBy("part").collect()
    mean = sum(r.n for r in held) / parts
    assert max(r.n for r in held) < 1.6 * mean and len(held) > 8
    assert all(x.b <= y.b and x.a <= y.a for x, y in zip(held, held[1:]))  # ranges of the curve


def test_packing_puts_like_texts_together(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 400")
    topics = {r.doc_id: r.lang for r in docs.collect()}
    order = [r.doc_id for r in packing.dealt(packing.encoded(docs), 1).orderBy("key", "doc_id").select("doc_id").collect()]
    together = sum(topics[a] == topics[b] for a, b in zip(order, order[1:])) / (len(order) - 1)
    chance = sum((n / len(order)) ** 2 for n in Counter(topics[k] for k in order).values())
    assert together > chance + 0.3


# pipeline


def test_pipeline_hands_short_batches_to_python(spark, sf):
    import corpus_pipeline

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows = spark.range(4000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 1000).alias("text"), F.lit("en").alias("lang"))
    for name in ("language_id", "near_duplicates", "decontamination", "packing"):
        try:
            dict(corpus_pipeline.STAGES)[name](spark, rows.limit(3), sf)
            found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        assert max(found) < 5 << 20 and sum(found) > 40 << 20, name


def test_pipeline(spark, sf, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "packing"]
    shared = _text.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    out = corpus_pipeline.run(spark, sf)
    (made,) = set(os.listdir(shared)) - before
    assert os.listdir(f"{shared}/{made}") == ["4"]  # only the last stage's rows are left
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    tables = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0 < len(ids) < tables.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, sf)
        assert left.columns == docs.columns and stage(spark, docs.where("false"), sf).count() == 0, name
        assert left.where("doc_id = 20").count() >= 1, name  # a clean text stays
