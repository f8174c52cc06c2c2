"""The registered op* queries and the pipeline on small tables, against brute force, SQL and planted cases."""

import hashlib
import json
import math
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, ODD, auc, documents, passages, prose, removed, shingles

import corpus_pipeline
from signalmill.llm import chat, common, decontam, html, lattice, mixing, quality, registry, sigtree, suffix, toxicity, warc

BIG = 2**53 + 1
#: Names the operators use inside; as columns of documents they must not clash.
INNER = "_row _k1 _k2 _text _found _kept _later _ord score _score a c h g key node cid component label block level start n at piece asks size position _rank _slice _start fp spots".split()


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def in_duckdb(folder, sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return [dict(zip(names, r)) for r in got.fetchall()]


def same_rows(df, rows):
    plain = lambda r: sorted((k, round(v, 5) if isinstance(v, float) else v) for k, v in r.items())
    assert sorted(map(repr, map(plain, (r.asDict() for r in df.collect())))) == sorted(map(repr, map(plain, rows)))


def test_registry_is_complete():
    assert len(registry.queries()) == 13 and set(registry.oracle_sql()) <= set(registry.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "suffix_dedup", "decontamination", "mixing"]


# -- op1 ---------------------------------------------------------------------------------------


def test_op1_against_brute_force(spark, tmp_path):
    rows = [(1, 0, "user", "a <|im_end|>\n b"), (1, 1, "assistant", None), (1, 2, "assistant", "x\\y"), (BIG, 5, "system", "s"), (BIG, 6, "assistant", "</s>é"), (BIG + 1, 0, "assistant", ""), (2, 0, "user", "q" * 5000)]
    save(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("formatted", F.lit(1)), tmp_path, "conversations")
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = {r["conv_id"]: r for r in chat.op1_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    for i in got:
        turns = sorted(r for r in rows if r[0] == i)
        loss = "".join(t or "" for _, _, role, t in turns if role == "assistant")
        want = hashlib.sha256("".join(f"{role}\n{t or ''}\n" for _, _, role, t in turns).encode()).hexdigest()
        assert (got[i]["n_turns"], got[i]["turns_sha256"], got[i]["loss_chars"]) == (len(turns), want, len(loss))
        assert got[i]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_layouts_with_other_fields(spark):
    q = [("user", "q"), ("assistant", "a")]
    m = [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a"}]
    cases = [
        ({"id": 1, "messages": m, "meta": {"x": [1]}}, q), ({"messages": []}, []), ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, m[1]]}, q),
        ({"messages": [m[0], {"role": "assistant", "content": None, "tool_calls": [{"f": 1}]}, {"role": "tool", "content": "r"}]}, [q[0], ("assistant", '[{"f": 1}]'), ("tool", "r")]),
        ({"system": "s", "prompt": "q", "response": "a", "score": 3}, [("system", "s"), *q]), ({"odd": 1}, [(None, None)]),
    ]
    df = spark.createDataFrame([(BIG + i, json.dumps(x)) for i, (x, _) in enumerate(cases)] + [(None, "{")], "id long, j string")
    got: dict = {}
    for r in chat.turns_from_json(df, "id", "j").orderBy("turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for i, (_, want) in enumerate(cases):
        assert got.get(BIG + i, []) == want, i
    table = spark.createDataFrame([(7, 0, "gpt", "x", 1)], "conversation_id long, turn long, `from` string, value string, extra int")
    assert [tuple(r)[:4] for r in chat.turns_from_rows(table).collect()] == [(7, 0, "assistant", "x")]
    with pytest.raises(ValueError):
        chat.turns_from_rows(table.drop("value"))


# -- op2 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("group", [4096, 1])
def test_op2_against_brute_force(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    texts = passages()
    rows = [(BIG + i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(BIG, texts[0], "en", "s", 1), (None, prose(90, 77), "en", "s", 1)]
    save(spark.createDataFrame(rows, DOCS).repartition(3), tmp_path, "documents")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.op2_suffix_dedup(spark, str(tmp_path)).collect()]
    want = []
    for (i, t, *_), gone in zip(rows, removed([r[1] for r in rows], 400)):
        raw = (t or "").encode()
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_longest_previous_factors():
    rng = np.random.default_rng(1)
    for k in range(8):
        t = rng.integers(97, 99, 90).astype(np.uint8) if k % 2 else np.frombuffer(b"abcab" * (6 + k), np.uint8)
        raw, depth, n = t.tobytes(), 16, len(t)
        order, ranks = suffix.suffix_order(t, depth)
        before, after = suffix.previous_factors(order, ranks, depth), suffix.next_factors(order, ranks, depth)
        for place, i in enumerate(order):
            window = raw[i : i + depth]
            if i + depth <= n:
                assert (before[place] >= depth) == (raw.find(window) < i)
                assert (after[place] >= depth) == (raw.rfind(window) > i)
    assert suffix.nearest_smaller(np.array([3, 1, 2, 5, 4, 0])).tolist() == [-1, -1, 1, 2, 2, -1]


# -- op3 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("dim", [16, 64, 384])
@pytest.mark.parametrize("cosine", [0.9, 0.91, 0.92])
def test_lattice_recall_at_the_threshold(dim, cosine):
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(2000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(2000, dim))
    b -= (b * a).sum(1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    (ka, qa), (kb, qb) = (lattice.Lattice().keys(x) for x in (a, b))
    met = (ka == kb) | (qa == kb[..., None]).any(2) | (qb == ka[..., None]).any(2)
    assert met.any(1).mean() >= 0.95


def test_op3_odd_norms_and_repeated_ids(spark, tmp_path):
    one = [3.0, 4.0, 1.0, 2.0]
    rows = [(1, one), (2, [x * 1e200 for x in one]), (3, [x * 1e-200 for x in one]), (3, one), (4, [-x for x in one]), (BIG, one), (5, None), (6, [None, 1.0, 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0, 1.0])]
    save(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("k", "e", "label", "cid", "n_links")}), tmp_path, "embeddings")
    got = lattice.op3_lattice_dedup(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert len(got) == len(rows) and by[1] == [(4, 1, True)] and by[2] == [(4, 1, False)] and by[BIG] == [(4, 1, False)] and set(by[3]) == {(4, 1, False)}
    assert all(by[i] == [(0, i, True)] for i in (4, 5, 6, 7))


# -- op4 ---------------------------------------------------------------------------------------


def test_op4_exact_ids_and_urls(spark, tmp_path):
    body = "x" * 1000
    rows = [(BIG, "http://a/x%20y", body), (BIG + 2, "http://a/é z", body), (BIG + 3, None, body), (1, "u", None), (2, "u", "x" * 999), (3, "v", "x" * 999), (5, "w", "y" * 2000), (5, "w", "y" * 2000), (4, "w", "y" * 2000)]
    save(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("content", F.lit(1)), tmp_path, "pages")
    same_rows(warc.op4_warc(spark, str(tmp_path)), in_duckdb(tmp_path, warc.OP4_SQL, "pages"))
    save(spark.createDataFrame([], "page_id long, url string, html string"), tmp_path, "pages")
    empty = warc.op4_warc(spark, str(tmp_path))
    assert empty.count() == 0 and empty.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_urls_dates_and_broken_archives():
    record = warc.arc_record("1", "http://a/x%20y z", b"HTTP/1.1 200 OK\r\n\r\nhello")
    whole = warc.arc_block("1", [record], "n") + warc.arc_block("2", [warc.arc_record("2", "http://b", b"yo")], "n")
    assert [r["URL"] for r in warc.parse_arc(whole)] == ["http://a/x%20y%20z", "http://b"]
    a, b = warc.parse_arc(b"no header here\n1 2 3 4 x\n" + whole[:-2])
    assert not a["cut"] and b["cut"] and b["content"] == b"y"
    assert warc.iso_time("199905") == "1999-05-01T00:00:00Z"
    info, response = warc.warc_info("p"), warc.warc_header("response", [("A", "b"), ("C", None)], 2).encode() + b"hi"
    assert [h["warc-type"] for h, _ in warc.parse_warc(info + b"\r\n\r\n" + response)] == ["warcinfo", "response"]
    assert [h["warc-type"] for h, _ in warc.parse_warc(info + b"\r\n\r\nWARC/1.1\r\nX: y\r\n\r\n" + response[:-1])] == ["warcinfo"]


# -- op5 ---------------------------------------------------------------------------------------


def grouped(sets, least):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= least * (len(sets[i]) + len(sets[j]) - same):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_op5_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sigtree, "BLOCK_DOCS", 4)
    monkeypatch.setattr(sigtree, "GROUP", 16)
    r = random.Random(5)
    base = prose(80, 1).split()
    texts = [" ".join(base)]
    for i in range(40):  # one large group of near copies
        w = list(base)
        w[r.randrange(80)] = f"edit{i}"
        texts.append(" ".join(w))
    for n in (7, 30, 200):
        w = prose(n, n).split()
        texts += [" ".join(w), " ".join(w[:-1]), " ".join(w[: n // 2]), " ".join(w).upper(), " ".join(w)]
    texts += ODD
    save(documents(spark, texts).withColumn("node", F.lit(1)), tmp_path, "documents")
    got = {x["doc_id"]: x for x in sigtree.op5_ngram_jaccard(spark, str(tmp_path)).collect()}
    sets = [shingles(t, 3) for t in texts]
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == grouped(sets, 90)


def test_trees_of_two_sides_lose_no_pair_and_prune():
    rng = np.random.default_rng(4)
    rule = sigtree.Rule(80)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, 200, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[rng.permutation(200)[:188]], rng.integers(0, 2**63, 6, dtype=np.uint64)])) for _ in range(5)]
    size, bits = np.array([len(s) for s in sets]), sigtree.aligned([sigtree.bitmap(s) for s in sets])
    assert len(sigtree.Tree(size, bits).levels) == 4
    for side in (None, np.arange(200) % 2):
        a, b = sigtree.tree_forest(size, bits, rule, side)
        nodes, low = sigtree.local_forest(a, b)
        label = np.arange(200)
        label[nodes] = low
        for i in range(200):
            for j in range(i):
                if (side is None or side[i] != side[j]) and rule.linked(len(np.intersect1d(sets[i], sets[j])), size[i], size[j]):
                    assert label[i] == label[j]
        assert len(a) < 200


# -- op6 ---------------------------------------------------------------------------------------


def test_op6_against_sql(spark, tmp_path):
    item, short = prose(40, 11), "tiny bit"
    w = item.split()
    texts = [prose(200, 1), prose(50, 2) + " " + item + " " + prose(70, 3), item.upper(), prose(30, 4) + " " + " ".join([*w[:38], "x", "y"]), " ".join(w[:36]), *ODD, short]
    save(documents(spark, texts).withColumns({c: F.lit(1) for c in ("gram", "fp", "n")}), tmp_path, "documents")
    save(spark.createDataFrame([(1, item), (2, None), (3, ""), (4, short), (5, prose(60, 12)), (6, item)], "item_id long, text string"), tmp_path, "benchmark")
    same_rows(decontam.op6_decontam(spark, str(tmp_path)), in_duckdb(tmp_path, decontam.OP6_SQL, "documents", "benchmark"))


def test_multi_index_finds_all_within_radius_and_few_others(spark):
    rng = np.random.default_rng(6)
    bits = rng.integers(0, 2, (60, 256))
    flips = [0, 5, 20, 40, 58, 59]
    near = bits.copy()
    for i in range(60):
        near[i, rng.permutation(256)[: flips[i % 6]]] ^= 1
    longs = lambda b: [int(np.packbits(b[j * 64 : j * 64 + 64]).view(">i8")[0]) for j in range(4)]
    windows = spark.createDataFrame([(i, 7, longs(b)) for i, b in enumerate(near)], "w long, n int, fp array<long>")
    items = spark.createDataFrame([(i, 7, longs(b)) for i, b in enumerate(bits)], "item_id long, n int, fp array<long>")
    found = {(r["w"], r["item_id"]) for r in decontam.candidates(windows, items).collect()}
    assert found == {(i, j) for i in range(60) for j in range(60) if (near[i] != bits[j]).sum() <= decontam.RADIUS}
    errors = decontam.RADIUS // (decontam.LONGS * decontam.CUTS)
    keys = lambda df, e, c: df.select(c, F.explode(F.array_distinct(decontam._probes("fp", e))).alias("k"))
    met = keys(windows, errors // 2, "w").join(keys(items, errors - errors // 2, "item_id"), "k").select("w", "item_id").distinct().count()
    assert met < 0.5 * 60 * 60


# -- op7 ---------------------------------------------------------------------------------------

LONG = "A paragraph of some length that says what the page is about, in words."


@pytest.mark.parametrize("page,want", [
    ("<body><div class='ad-free article-body'><p>%s</p><p>More of it here.</p></div></body>" % LONG, LONG + " More of it here."),
    ("<main><div class='related-work'><p>%s</p></div><p>%s</p></main>" % (LONG, LONG), None),
    ("<form class=page><div class='with-sidebar'><p>%s</p><div class=sidebar>x y</div></div></form>" % LONG, LONG),
    ("<main><article><p>%s</p></article><article><p>Two, shorter.</p></article></main>" % LONG, LONG + " Two, shorter."),
    ("<body><div><a href=a>Home</a></div><div><a href=b>About</a></div><div><a href=c>Team</a></div><div><a href=d>Mail</a></div><p>%s</p><p>Short.</p><p>%s</p><div><a href=e>Legal</a></div><div><a href=f>Terms</a></div><div><a href=f>Press</a></div></body>" % (LONG, LONG), LONG + " Short. " + LONG),
])
def test_content_without_an_article(page, want):
    got = html.extract(page)
    assert got == want if want else LONG in got


def test_clusters_choose_the_lines(monkeypatch):
    page = "<body><nav>m1 m2</nav><div class=ad>Buy it.</div><article><h1>T</h1><p>%s</p></article><footer>f</footer></body>" % LONG
    assert html.extract(page) == "T " + LONG
    monkeypatch.setattr(html, "clustered", lambda ratio, weight: np.ones(len(ratio), bool))
    assert html.extract(page) != "T " + LONG


def test_op7_rows_and_deep_pages(spark, tmp_path):
    began = time.time()
    assert html.extract("<div class=a>" * 100_000 + LONG) == LONG
    assert time.time() - began < 5
    rows = [(BIG, "u", f"<article><p>{LONG}</article>"), (BIG, "u", f"<article><p>{LONG}</article>"), (None, None, None), (3, "v", "")]
    save(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("h", F.lit(1)), tmp_path, "pages")
    got = html.op7_html_text(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(i, u, LONG if i == BIG else "", len(LONG) if i == BIG else 0) for i, u, _ in rows]))
    assert html.extract_pages(spark.read.parquet(f"{tmp_path}/pages.parquet").where("false")).count() == 0


# -- op8 and op10 --------------------------------------------------------------------------------


def toxic_rows(n, seed):
    """Texts whose toxic passage stands anywhere, also after thousands of characters or at the end of a long word."""
    r = random.Random(seed)
    texts, y = [], []
    for i in range(n):
        w = prose(r.choice([20, 60, 800]), seed * 1000 + i).split()
        if i % 3 == 0:
            at = r.choice([0, len(w)])
            w[at:at] = r.choice([["zzbad"], ["zznasty", "zzbad"], ["abcdefghijklzzbad"]]) * 2
        texts.append(" ".join(w))
        y.append(float(i % 3 == 0))
    return texts, np.array(y)


def test_toxicity_reads_whole_texts_and_words():
    net = toxicity.train(*toxic_rows(240, 1), epochs=6)
    texts, y = toxic_rows(90, 2)
    assert auc(toxicity.score_texts(net, texts), y) > 0.95
    late = prose(900, 5)
    calm, rude = toxicity.score_texts(net, [late, late + " zzbad zznasty zzbad"])
    assert len(late) > 3000 and rude > calm + 0.3
    a, b = toxicity.Vocabulary(["abcdefghiXXXX"]), toxicity.Vocabulary(["abcdefghiYYYY"])
    assert a.word != b.word and set(a.gram) != set(b.gram)
    assert len(toxicity.words_of("字" * 100)) > 5 and len(toxicity.cut([np.zeros(64, int)])[0]) == 7


def plain_logit(p, vectors):
    """Logit of a window of word vectors, one number at a time."""
    size, h, states = toxicity.SIZE, toxicity.STATE, {}
    sig = lambda v: 1 / (1 + math.exp(-v))
    for way in "fb":
        w, u, c, state, seen = p["w" + way], p["u" + way], p["c" + way], [0.0] * h, []
        for x in vectors if way == "f" else vectors[::-1]:
            own = [c[j] + sum(x[i] * w[i][j] for i in range(size)) for j in range(3 * h)]
            old = [sum(state[i] * u[i][j] for i in range(h)) for j in range(3 * h)]
            z, r = ([sig(own[k * h + j] + old[k * h + j]) for j in range(h)] for k in (0, 1))
            state = [(1 - z[j]) * state[j] + z[j] * math.tanh(own[2 * h + j] + r[j] * old[2 * h + j]) for j in range(h)]
            seen.append(state)
        states[way] = seen if way == "f" else seen[::-1]
    both = [f + b for f, b in zip(states["f"], states["b"])]
    weight = [math.exp(sum(a * math.tanh(v) for a, v in zip(p["att"], s))) for s in both]
    pooled = [sum(a * s[j] for a, s in zip(weight, both)) / sum(weight) for j in range(2 * h)]
    return p["bias"][0] + sum(o * v for o, v in zip(p["out"], pooled))


def test_toxicity_scores_are_those_of_a_scalar_pass(monkeypatch):
    texts, y = toxic_rows(60, 6)
    net = toxicity.train(texts, y, epochs=2)
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    some = [*texts[:4], " ".join(toxicity.words_of(texts[5])[:45]), "one"]
    got = toxicity.score_texts(net, some)
    for text, s in zip(some, got):
        words, clean = toxicity.words_of(text), 1.0
        for at in range(0, max(len(words) - toxicity.WINDOW, 0) + toxicity.STRIDE, toxicity.STRIDE):
            part = words[at : at + toxicity.WINDOW]
            if at and len(words) <= at - toxicity.STRIDE + toxicity.WINDOW:
                break
            vectors = []
            for w in part:
                v = toxicity.Vocabulary([w])
                grams = [p["gram"][g] for g in v.gram]
                vectors.append([a + sum(g[i] for g in grams) / len(grams) for i, a in enumerate(p["word"][v.word[0]])])
            clean *= 1 - 1 / (1 + math.exp(-plain_logit(p, vectors)))
        assert s == pytest.approx(1 - clean, rel=1e-3, abs=1e-5)
    # A step's gradients are those of all its windows, however many are traced at a time.
    monkeypatch.setattr(toxicity, "TRACED", 7)
    again = toxicity.train(texts[:30], y[:30], epochs=1)
    monkeypatch.setattr(toxicity, "TRACED", 10**6)
    whole = toxicity.train(texts[:30], y[:30], epochs=1)
    assert np.allclose(toxicity.score_texts(again, texts), toxicity.score_texts(whole, texts), atol=1e-2)


def test_quality_margins_are_differences_of_dense_log_densities(spark):
    r, k = np.random.default_rng(3), len(quality.NAMES)
    y = np.arange(400) % 2
    x = r.normal(size=(400, k)) * (1 + y[:, None]) + y[:, None] * r.normal(size=k)
    model = quality.fit(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "label int, x array<double>"))
    center, scale = x.mean(0), x.std(0)
    z = (x - center) / scale
    every, density = np.cov(z.T, bias=True), []
    for label in (0, 1):
        own = z[y == label]
        cov = (1 - quality.SHRINK) * np.cov(own.T, bias=True) + quality.SHRINK * np.diag(np.diag(every)) + quality.FLOOR * np.eye(k)
        d = np.clip(z, -8, 8) - own.mean(0)
        density.append(-0.5 * (d @ np.linalg.inv(cov) * d).sum(1) - 0.5 * np.log(np.linalg.det(cov)))
    assert np.allclose(model.margins(x), density[1] - density[0], rtol=1e-6, atol=1e-6)


def test_op8_and_op10_of_repeated_rows_and_null_ids(spark, tmp_path):
    texts, y = toxic_rows(60, 3)
    rows = [*enumerate(texts), (0, texts[0]), (0, texts[0]), (1, texts[2]), (None, texts[0]), (None, texts[0]), (None, None), (BIG, "")]
    save(spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS), tmp_path, "documents")
    known = [(i, int(v), int(1 - v)) for i, v in enumerate(y)] + [(0, 1, 1), (None, 1, 0), (5, None, None)]
    save(spark.createDataFrame(known, "doc_id long, toxic int, quality int"), tmp_path, "labels")
    for name in ("op8_toxicity", "op10_quality"):
        got = [(r["doc_id"], r["score"], r["held_out"]) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted((x[0] for x in got), key=repr) == sorted((i for i, _ in rows), key=repr)
        of = lambda i: sorted(round(s, 6) for d, s, _ in got if d == i)
        assert len(set(of(0))) == 1 and len(of(None)) == 3 and of(None).count(of(0)[0]) == 2
        assert of(2)[0] in of(1) and all(0 <= s <= 1 and h is not None for _, s, h in got)


def test_op8_and_op10_rows(spark, tmp_path):
    texts, y = toxic_rows(60, 3)
    save(documents(spark, texts + ODD).withColumns({c: F.lit(1) for c in ("score", "_text", "label")}), tmp_path, "documents")
    save(spark.createDataFrame([(i, int(v), int(1 - v)) for i, v in enumerate(y)], "doc_id long, toxic int, quality int"), tmp_path, "labels")
    for name in ("op8_toxicity", "op10_quality"):
        got = registry.queries()[name](spark, str(tmp_path)).collect()
        cut = 0.7 if name == "op8_toxicity" else 0.3
        assert sorted(r["doc_id"] for r in got) == list(range(len(texts + ODD)))
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in got)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(d + "/documents.parquet"), spark.read.parquet(d + "/labels.parquet")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1")
    got = scored.select("score", "toxic").toPandas()
    s, y = got["score"].to_numpy(), got["toxic"].to_numpy()
    assert auc(s, y) > 0.85 and (s[y == 1] >= 0.7).mean() > 0.6 and (s[y == 0] >= 0.7).mean() < 0.03


# -- op9 ---------------------------------------------------------------------------------------


def test_op9_against_sql(spark, tmp_path):
    rows = [(i, prose(5 + i % 37, i), None if i % 11 == 0 else f"s{i % 4}") for i in range(200)] + [(1, prose(6, 1), "s1")] * 2 + [(None, "a b c", "s2"), (None, "d e", "s2"), (900, None, "s3"), (901, " ", None)]
    save(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("size", "position", "_rank", "copy")}), tmp_path, "documents")
    got = mixing.op9_mixing(spark, str(tmp_path))
    same_rows(got, in_duckdb(tmp_path, mixing.OP9_SQL, "documents"))
    out = got.collect()
    assert len(out) == len(rows) and all(r["taken"] <= 2 * r["size"] and (r["taken"] > 0) == (r["position"] is not None) for r in out)


def test_schedule_moves_positions_not_amounts(spark):
    docs = documents(spark, [prose(10 + i % 9, i) for i in range(80)], lambda i: f"s{i % 2}")
    flat = mixing.positioned(docs, schedules=((1.0, 1.0, 1.0),)).collect()
    late = mixing.positioned(docs, schedules=((0.0, 1.0, 4.0),)).collect()
    taken = lambda rows: {r["doc_id"]: len(r["positions"]) for r in rows}
    assert taken(flat) == taken(late)
    mean = lambda rows: np.mean([p for r in rows for p in r["positions"]])
    assert mean(late) > mean(flat) + 0.1
    with pytest.raises(ValueError):
        mixing.positioned(docs, schedules=((0.0, 0.0, 0.0),))


# -- pipeline ------------------------------------------------------------------------------------


def test_pipeline_on_planted_cases(spark, tmp_path):
    texts, y = toxic_rows(360, 4)
    n, item, p = len(texts), prose(40, 901), prose(70, 902)
    near = prose(150, 903).split()
    extra = [" ".join(near), " ".join([*near[:75], "other", *near[76:]]), prose(90, 904), prose(90, 904), prose(40, 905) + " " + p + " " + prose(40, 906), p + " " + prose(30, 907), prose(30, 908) + " " + item, None, ""]
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate([*texts, *extra])] + [(n + 2, extra[2], "en", "s1", 0), (None, prose(80, 909), "en", "s1", 0), (None, prose(80, 909), "en", "s1", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in INNER})
    save(docs, tmp_path, "documents")
    save(spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int"), tmp_path, "labels")
    save(spark.createDataFrame([(1, item)], "item_id long, text string"), tmp_path, "benchmark")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "mixing":
            assert out.schema.names == docs.schema.names
        out.write.parquet(f"{tmp_path}/stage-{name}")
        now = spark.read.parquet(f"{tmp_path}/stage-{name}")
        seen[name] = [(r["doc_id"], r["text"]) for r in now.collect()] if name != "mixing" else now.collect()
    ids = lambda name: [i for i, _ in seen[name]]
    kept = set(ids("toxicity"))
    assert np.mean([i not in kept for i in range(n) if y[i]]) > 0.9 and np.mean([i in kept for i in range(n) if not y[i]]) > 0.9
    assert kept >= set(range(n, n + 9)) | {None}
    after = ids("ngram_jaccard")
    assert n in after and n + 1 not in after and n + 2 in after and n + 3 not in after and after.count(None) == 2
    text = dict(seen["suffix_dedup"])
    assert text[n + 4] == extra[4] and text[n + 5].strip() == prose(30, 907) and text[n + 2] == extra[2]
    assert ids("suffix_dedup").count(n + 2) == 1 and ids("suffix_dedup").count(None) == 1  # of equal rows one stays
    assert n + 6 not in ids("decontamination") and set(ids("decontamination")) == set(ids("suffix_dedup")) - {n + 6}
    position = [r["position"] for r in sorted(seen["mixing"], key=lambda r: r["position"])]
    assert len(position) > 0 and position[0] >= 0 and position[-1] <= 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name



def test_run_chains_the_stages(spark, tmp_path, monkeypatch):
    save(spark.range(5).withColumnRenamed("id", "doc_id"), tmp_path, "documents")
    step = lambda n: (f"s{n}", lambda spark, docs, sf_dir: docs.where(f"doc_id <> {n}"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [step(0), step(2), step(3)])
    assert sorted(r[0] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [1, 4]


def test_run_deletes_what_finished_stages_stored(spark, tmp_path, monkeypatch):
    save(spark.range(5).withColumnRenamed("id", "doc_id"), tmp_path, "documents")
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/scratch")
    step = lambda n: (f"s{n}", lambda spark, docs, sf_dir: common.stored(docs.where(f"doc_id <> {n}"), f"own{n}"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [step(0), step(2), step(3)])
    left = lambda: sorted(p.name.split("-")[0] for p in (tmp_path / "scratch" / "signalmill").iterdir())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2 and left() == ["own3", "s2"]

    def broken(spark, docs, sf_dir):
        common.stored(docs, "half")
        raise ValueError

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("bad", broken), step(3)])
    with pytest.raises(ValueError):
        corpus_pipeline.run(spark, str(tmp_path))
    assert left() == ["own3", "s2"]


def test_op2_gives_the_remaining_text(spark, tmp_path):
    """The result held digests only, so what was cut could not be read from it."""
    one, passage = "a line that stands once. ", "".join(f"word{i} " for i in range(80))
    rows = [(1, "x" + one + passage + "end", "en", "s", 1), (2, passage, "en", "s", 1), (3, one, "en", "s", 1), (4, None, "en", "s", 1)]
    save(spark.createDataFrame(rows, DOCS), tmp_path, "documents")
    got = {r["doc_id"]: r for r in suffix.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {i: r["text"] for i, r in got.items()} == {1: "x" + one + "end", 2: "", 3: one, 4: ""}
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got.values())


def test_op2_marks_documents_that_lost_bytes(spark, tmp_path):
    """The report read the result by the size of the input, as no column said which documents hold a copied passage."""
    passage = "".join(f"word{i} " for i in range(80))
    rows = [(1, "x " + passage + "end", "en", "s", 1), (2, passage, "en", "s", 1), (3, passage[:399], "en", "s", 1), (4, "one", "en", "s", 1), (5, None, "en", "s", 1)]
    save(spark.createDataFrame(rows, DOCS), tmp_path, "documents")
    got = suffix.op2_suffix_dedup(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["duplicated"] for r in got} == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert all(r["duplicated"] == (r["n_removed"] > 0) for r in got)
