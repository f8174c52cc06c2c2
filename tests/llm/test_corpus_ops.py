"""Importance resampling, line dedup and collocations against plain Python on small texts with nulls, ties, repeated rows and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalmill.llm import collocation, importance, linedup

DOC = "doc_id long, text string, lang string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# -- importance resampling -----------------------------------------------------------------------


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(text))


def features(text, most=2):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def resampled(docs, target):
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    alls, allt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (alls + 10000) / ((s[b] + 1) * (allt + 10000))))
    rows = []
    for i, x in docs:
        fs = features(x)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= 20])
    eligible = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    drawn = len(eligible) * 25 // 100
    out = [(*r[:4], n + 1 if n < drawn else None) for n, r in enumerate(eligible)] + [(*r[:4], None) for r in rows if not r[4]]
    return sorted(out, key=str)


TEXTS = ["Ärger über 2 Dinge", "", None, "The THE the", "x" * 200 + " y " + "é" * 90, "日本 語\x00text\x7f{a}", " \n\t "]


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    docs = [(i if i % 11 else None, " ".join(rng.choice(["Alpha", "beta", "Größe", "x1", "delta-two", "q" * 80]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return docs + list(enumerate(TEXTS, 1000)) + docs[3:6]


@pytest.mark.parametrize("docs", [corpus(), [], [(1, None)]])
def test_resampling_is_that_of_plain_python(spark, docs):
    target = ["beta x1 beta", None, "größe alpha"]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, rank int")
    got = importance.resample(df.repartition(3), spark.createDataFrame([(t, 1) for t in target], "text string, n int"))
    got = sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()), key=str)
    assert got == resampled(docs, target)


def test_long_texts_are_split_in_blocks(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["ab", "ü", "c" * 70, "d9"]) for _ in range(3000))
    whole = importance.feature_buckets([text.encode(), b"tail one"])
    monkeypatch.setattr(importance, "BLOCK", 50)
    cut = importance.feature_buckets([text.encode(), b"tail one"])
    assert all((a == b).all() for a, b in zip(whole, cut))
    n = int(whole[1][0])
    assert sorted(whole[2][:n]) == sorted(bucket(f) for f in features(text)) and list(whole[0]) == [3000, 2]


def test_bytes_beyond_utf8_count_as_replaced():
    bad = importance.feature_buckets([b"a\xffb c"])
    assert sorted(bad[2]) == sorted(bucket(f) for f in features("a�b c"))


# -- line dedup ------------------------------------------------------------------------------------


def deduped(docs, least=20, docs_least=3):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < docs_least or max(j for j in held[key(x)] if j is not None) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def lined(n=80, seed=9):
    rng = random.Random(seed)
    pool = [f"Common line number {i} of the corpus" for i in range(12)] + ["short", "", "ü" * 19, "ü" * 20, "Exactly twenty chars"]
    docs = []
    for i in range(n):
        lines = [rng.choice(["  {}", "{}\t", "{}"]).format(rng.choice(pool)) for _ in range(rng.randint(0, 9))]
        lines = [x.upper() if rng.random() < 0.2 else x for x in lines] + (["A line that a third of all documents hold\r"] if i % 3 == 0 else []) + [f"only here {i} " * 3]
        docs.append((i if i % 13 else None, "\n".join(lines)))
    long = (500, "\n".join(f"a long text repeats this line {i % 40} again" for i in range(4000)))
    return docs + docs[10:14] + [(7, docs[8][1]), (600, ""), (601, None), long, (501, long[1]), (502, long[1])]


@pytest.mark.parametrize("docs", [lined(), [], [(None, "The same line in rows without id")] * 4])
def test_lines_are_those_of_plain_python(spark, docs):
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, kept string, _k1 int").repartition(4)
    got = [(r["_row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in linedup.drop_repeated_lines(df).collect()]
    assert sorted(got, key=str) == deduped(docs)


def test_hash_is_perfect_and_minimal():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 60000):
        h = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        h[0, : n // 2] = 5  # first hashes alone need not differ
        ph = linedup.PerfectHash.over(*h)
        assert sorted(ph.of(*h)) == list(range(n))
        assert sum(ph.sizes) <= 64 * len(ph.sizes) + 6 * n


def test_probes_of_absent_lines_and_hot_shards(spark, monkeypatch):
    monkeypatch.setattr(linedup, "LEAST_SHARDS", 2)
    monkeypatch.setattr(linedup, "SHARD_KEYS", 3)
    rows = [(d, 0, d, 0, k, k * 31) for k in range(40) for d in range(2 + k % 4)] + [(d, 0, d, 1, 99, 1) for d in range(500)]
    occ = spark.createDataFrame(rows, "_k1 long, _k2 long, doc_id long, pos long, _h1 long, _h2 long")
    got = sorted((r["_k1"], r["pos"]) for r in linedup.lost_lines(occ).collect())
    want = [(d, 0) for k in range(40) for d in range(2 + k % 4) if 2 + k % 4 >= 3 and d != 1 + k % 4] + [(d, 1) for d in range(499)]
    assert got == sorted(want)


# -- collocations ----------------------------------------------------------------------------------


def mined(docs, least, inside=80, top=2000, order=4):
    f, n = Counter(), Counter()
    for t, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low(t)):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, order + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    c = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    worst = Counter()
    for (lang, p), a in c.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                worst[lang, p[i : i + k]] = max(worst[lang, p[i : i + k]], a)
    out = []
    for lang in n:
        rows = []
        for (g, p), a in c.items():
            if g == lang and not 100 * worst[g, p] >= inside * a:
                score, _, l, r = min((2000000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), l, r))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows[:top])]
    return sorted(out)


def prose(n=50, seed=2):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Paris", "\x01x", "é", "very", "long", "|", "a\x00b"]
    docs = []
    for _ in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(rng.randint(0, 80)))
        text += " once upon a time there was a small house by the sea and nobody lived in it." * rng.randint(0, 2) + " la la la la la la"
        docs.append((text, rng.choice(["en", "fr", None])))
    return docs + docs[:5] + [("", "en"), (None, "de"), ("...", None)]


def test_collocations_are_those_of_plain_python(spark):
    for least, inside, top, order in ((3, 80, 2000, 4), (8, 101, 15, 4), (4, 80, 50, 3)):
        df = spark.createDataFrame([(t, g, 1, "z") for t, g in prose()], "text string, lang string, n int, phrase string").repartition(4)
        got = collocation.collocations(df, least=least, inside=inside, top=top, order=order)
        got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got.collect())
        assert got == mined(prose(), least, inside, top, order)


def test_frequent_words_and_pairs_are_dealt_by_more_words(spark, monkeypatch):
    monkeypatch.setattr(collocation, "LOOK", 1.0)
    docs = [("of the w%d x%d, the end of the day" % (i % 50, i % 7), "en") for i in range(300)] + prose()
    df = spark.createDataFrame(docs, "text string, lang string")
    look = collocation.edges(df)
    one, two = (collocation.busy_heads(look, k, 1 / 32) for k in (1, 2))
    assert ("en", "of") in one and ("en", "of the") in two and len(one) <= 32
    names = [b"of", b"the", b"sea"]
    codes = np.array([[1, 1, 3, 1], [2, 2, 1, 0], [3, 1, 2, 0], [0, 0, 0, 0]])
    depth, code = collocation.edge_depths(pa.array(["en"]), pa.array(names, pa.large_binary()), np.zeros(4, np.int64), codes, one, two)
    assert list(depth) == [4, 4, 1, 2] and code[0] != code[1]
    monkeypatch.setattr(collocation, "ROUTES", 1)
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocation.collocations(df, least=5).collect())
    assert got == mined(docs, 5)


def test_empty_table_has_no_collocations(spark):
    assert collocation.collocations(spark.createDataFrame([], DOC)).count() == 0


def test_unary_paths(spark):
    line = "a b c d e f g h i j k l m".split()
    edges = [("en", " ".join(line[i : i + 4]), 7) for i in range(len(line) - 3)]
    edges += [("en", "m x y z", 7), ("en", "x y z q", 9), ("en", "j k l n", 7)]  # a node with two ways out, a change of weight
    edges += [("en", f"{x} {y} {z} {x}", 5) for x, y, z in (("r", "s", "t"), ("s", "t", "r"), ("t", "r", "s"))]  # a ring
    edges += [("fr", "a b c d", 7), ("fr", "la la la la", 30)]
    got = sorted((r["lang"], " ".join(r["path"]), r["n"]) for r in collocation.unary_paths(spark.createDataFrame(edges, "lang string, phrase string, n long")).collect())
    want = [("en", " ".join(line[:-1]), 7), ("en", "j k l m", 7), ("en", "j k l n", 7), ("en", "m x y z", 7), ("en", "x y z q", 9)]
    want += [("en", e[1], 5) for e in edges if e[2] == 5] + [("fr", "a b c d", 7), ("fr", "la la la la", 30)]
    assert got == sorted(want)


def test_counts_beyond_64_bits(spark):
    big = 10**13
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, 2 * big + 1), ("en", "b", 1, big)], "lang string, phrase string, words int, n long")
    r = collocation.scored(counts.where("words = 2"), counts).first()
    assert (r["l"], r["r"], r["score"]) == (2 * big + 1, big, 2000000 * big // (3 * big + 1))


def test_queries_equal_the_operators(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in importance.op11_importance(spark, d).collect()]
    assert sorted(got, key=str) == resampled([x[:2] for x in docs], target)
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linedup.op12_line_dedup(spark, d).collect()]
    assert sorted(got, key=str) == sorted(((*x[:3], hashlib.sha256(x[3].encode()).hexdigest()) for x in deduped([x[:2] for x in docs])), key=str)
    assert sum(x[2] for x in got) > 0
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocation.op13_collocations(spark, d).collect())
    assert got == mined([x[1:] for x in docs], 30) and got
    assert collocation.op13_collocations(spark, d).where(F.col("rank") > 2000).count() == 0


# -- decontamination: every window --------------------------------------------------------------


def best_window(item, doc, k=5):
    """(similarity, start) of the best window of a document, over all windows of the item's length."""
    n, k = len(item), min(k, len(item))
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    t, out = grams(item), (0.0, 0)
    for s in range(max(len(doc) - n, 0) + 1):
        g = grams(doc[s : s + n])
        same = sum((g & t).values())
        if g and same / (sum(g.values()) + sum(t.values()) - same) > out[0] + 1e-12:
            out = (same / (sum(g.values()) + sum(t.values()) - same), s)
    return out


def edited(rng, item, edits):
    w = list(item)
    for _ in range(edits):
        i = rng.randrange(len(w))
        what = rng.random()
        w[i : i + (what < 0.7)] = [f"new{rng.random()}"] * (what > 0.3)
    return w


def test_decontamination_finds_the_best_of_all_windows(spark):
    from signalmill.llm import decontam

    rng = random.Random(11)
    items = [[f"i{j}w{x}" for x in range(rng.choice([30, 60, 100]))] for j in range(8)] + [["a", "b"] * 20, ["one"], ["x", "y", "z", "x", "y"]]
    docs = [[f"f{i}{x}" for x in range(rng.randint(0, 40))] + edited(rng, rng.choice(items[:8]), rng.randint(0, 4)) + [f"g{i}{x}" for x in range(rng.randint(0, 40))] for i in range(300)]
    whole = items[0][:50] + [f"in{x}" for x in range(5)] + items[0][50:]
    docs += [["q", "q"] + whole[2:-3] + ["r"] * 3, items[8][3:] + ["a"], ["one"], items[1][:28], items[2] + ["z"] * 50 + items[2][:55], items[3][30:] + items[3][:30], ["x", "y", "z", "x"]]
    b = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in decontam.matches(d, b).collect()}
    want = {(i, j): best_window(w, x) for i, x in enumerate(docs) for j, w in enumerate(items)}
    want = {p: (round(s, 6), at) for p, (s, at) in want.items() if s >= 0.8 - 1e-12}
    assert len(want) > 60 and set(got) <= set(want)
    for low, high, least in ((0.8, 0.85, 0.95), (0.85, 0.9, 0.99), (0.9, 1.01, 1.0)):
        near = [p for p, (s, _) in want.items() if low <= s < high]
        assert len(near) > 5 and sum(p in got for p in near) >= least * len(near), (low, len(near))
    assert len(got) >= 0.98 * len(want) and sum(got[p] == want[p] for p in got) >= 0.98 * len(got)


def test_decontamination_of_a_window_no_shingle_is_aligned_with(spark):
    """The first two words replaced, five put in the middle, the last three replaced: three windows reach 0.8, none of them at an aligned start."""
    from signalmill.llm import decontam

    item = [f"w{i}" for i in range(100)]
    doc = ["q", "q"] + item[2:50] + [f"in{x}" for x in range(5)] + item[50:97] + ["r"] * 3
    assert best_window(item, doc)[0] >= 0.8
    b, d = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), spark.createDataFrame([(7, " ".join(doc))], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.matches(d, b).collect()] == [(7, 1)]
    assert decontam.decontaminate(d, b).count() == 0
