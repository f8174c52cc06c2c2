"""Training-data operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signalmill.llm import chat, common, components, decontam, html, lattice, mixing, quality, sigtree, suffix, textbytes, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DIR = "/root/testdata/sf0.001"


def documents(spark, texts, source=lambda i: "s"):
    return spark.createDataFrame([(i, t, "en", source(i), None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


ODD = [None, "", "   ", "one", "two words", "é" * 500, "ab " * 400]


# -- chat -------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<|im_end|>\n", "\\", "\\<|im_start|>", "<|im_", "a\nb\\n", "<\\|im_end|>"])
def test_render_round_trip(text):
    piece, a, b = chat.render("us\ner", text)
    assert list(chat.parse(piece + chat.render("x", text)[0])) == [("us\ner", text), ("x", text)]
    assert chat.unescape(piece[a:b]) == text


def test_layouts_give_same_turns(spark):
    want = [("user", "q"), ("assistant", "a")]
    same = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
            {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"prompt": "q", "completion": "a"}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(same)] + [(98, "{broken"), (99, '{"odd": 1}'), (None, None)], "id long, j string")
    got = collections.defaultdict(list)
    for r in chat.turns_from_json(df, "id", "j").orderBy("turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert all(got[i] == want for i in range(len(same)))
    assert got[98] == got[99] == got[None] == [(None, None)]


def test_formatting_in_parts_and_odd_rows(spark):
    rows = [(1, 0, "user", "q" * 50), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, 2, None, "c"), (None, 0, "user", "x"), (2, None, "assistant", "y")]
    t = spark.createDataFrame([(*r, "f") for r in rows], "conv_id long, turn long, role string, text string, fingerprint string")
    for part in (20, 10_000):
        d = {r["conv_id"]: r for r in chat.digests(chat.format_turns(t, part=part)).collect()}
        assert d[1]["n_turns"] == 4 and d[1]["loss_chars"] == 1 and set(d) == {1, 2, None}
        assert d[1]["turns_sha256"] == hashlib.sha256(("user\n" + "q" * 50 + "\nassistant\n\nassistant\nb\n\nc\n").encode()).hexdigest()
    assert chat.format_turns(t.where("false")).count() == 0


# -- components -------------------------------------------------------------------------------


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (None, 3), (7, 1), (7, 1)], "a long, b long")
    got = {tuple(r) for r in components.connected_components(e).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 1), (4, 4), (5, 4)}
    assert components.connected_components(e.where("false")).count() == 0


# -- suffix dedup ------------------------------------------------------------------------------


def removed(texts, span, keep_first=False):
    seen, first = collections.Counter(), {}
    raws = [(t or "").encode() for t in texts]
    for i, b in enumerate(raws):
        for j in range(len(b) - span + 1):
            w = b[j : j + span]
            seen[w] += 1
            first.setdefault(w, (i, j))
    out = []
    for i, b in enumerate(raws):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - span + 1):
            w = b[j : j + span]
            if seen[w] > 1 and not (keep_first and first[w] == (i, j)):
                gone[j : j + span] = True
        out.append(gone)
    return out


def passages():
    p = prose(120, 1)
    return [p, prose(60, 2) + " " + p + " " + prose(60, 3), p[50:600] + prose(90, 4), prose(200, 5), p, prose(80, 6) + p[100:560] + "é" * 40 + p[100:560], *ODD, "x" * 420]


@pytest.mark.parametrize("group", [4096, 1])
def test_suffix_spans_match_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)  # 1 sends every group through window hashes
    texts = passages()
    found = {r["_row"]["doc_id"]: r["_found"] for r in suffix.repeated(documents(spark, texts)).collect()}
    for i, gone in enumerate(removed(texts, 400)):
        got = np.zeros(len(gone), bool)
        for s, e in suffix.spans_of(found[i], 400):
            got[s:e] = True
        assert (got == gone).all(), i


def test_suffix_keep_first(spark):
    texts = passages()
    out = {r["doc_id"]: r for r in suffix.drop_later_copies(documents(spark, texts), 300, 200).collect()}
    for i, gone in enumerate(removed(texts, 300, True)):
        raw = (texts[i] or "").encode()
        if not gone.any():
            assert out[i]["text"] == texts[i]
        elif gone.all():
            assert i not in out
        else:
            kept = bytes(b for b, g in zip(raw, gone) if not g)
            assert abs(len(out[i]["text"].encode()) - len(kept)) <= 6 and out[i]["n_chars"] == len(out[i]["text"])
    assert suffix.drop_later_copies(documents(spark, []), 300, 200).count() == 0


def test_words_of_text():
    said = "(The dog's  bark\u2014is \u201cl\u00f6ud\u201d\u00a0here.) -- \u65e5\u672c\u8a9e\u3002ok " + "z" * 300
    raw = np.frombuffer(said.encode(), np.uint8)
    _, start, end = textbytes.words_of(raw)
    got = [raw[a:b].tobytes().decode() for a, b in zip(start, end)]
    assert got == ["The", "dog's", "bark\u2014is", "l\u00f6ud", "here", "--", "\u65e5", "\u672c", "\u8a9e", "ok", *"z" * 300]
    assert all(len(x) == 0 for x in textbytes.words_of(np.zeros(0, np.uint8)))


@pytest.mark.parametrize("group", [4096, 1])
def test_pipeline_cuts_passages_of_51_words(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    rng = np.random.default_rng(8)
    words = lambda n: ["".join(rng.choice(list("abcdefgh"), 3)) for _ in range(n)]
    p, han = words(51), "".join(chr(0x4E00 + i) for i in rng.integers(0, 9000, 60))
    texts = [" ".join(x) for x in (words(30) + p + words(30), words(40) + p + words(9), words(20) + p[:50] + words(20), words(9) + p[1:] + words(70), p)]
    texts += [han + " tail", "head " + han, "(" + " ".join(p) + ")", " ".join(p[:30] + words(1) + p[31:]), None, ""]
    assert len(" ".join(p)) < 300
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeated_passages(spark, documents(spark, texts), "").collect()}
    assert out[1].split() == [*texts[1].split()[:40], *texts[1].split()[91:]]
    assert 4 not in out and 7 not in out and out[6] == "head "
    assert all(out[i] == texts[i] for i in (0, 2, 3, 5, 8, 9, 10))


@pytest.mark.parametrize("group", [4096, 1])
@pytest.mark.parametrize("words", [False, True])
def test_suffix_keeps_one_of_equal_rows(spark, monkeypatch, group, words):
    monkeypatch.setattr(suffix, "GROUP", group)
    a, b, c = prose(90, 31), prose(100, 32), prose(80, 33)
    rows = [(1, a), (1, a), (1, a), (2, b + " " + a), (2, b + " " + a), (None, c), (None, c), (3, "short"), (3, "short"), (4, None), (4, None), (None, c + " " + c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix.drop_later_copies(docs, *((51, 34) if words else (300, 200)), words=words).collect()
    texts = lambda i: sorted((r["text"] or "").strip() for r in got if r["doc_id"] == i)
    assert texts(1) == [a] and texts(2) == [b] and texts(3) == ["short"] * 2 and texts(4) == [""] * 2
    # Rows of null id stand in the order of their hashes: c stays once, in one of the two.
    assert sum(t.count(c) for t in texts(None)) == 1


def test_suffix_order_is_exact():
    raw = np.frombuffer(b"banana" * 7 + b"bandana", np.uint8)
    order, _ = suffix.suffix_order(raw, 64)
    text = raw.tobytes()
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:] + b"\0" * 64)


# -- lattice -----------------------------------------------------------------------------------


def test_nearest_e8_is_nearest():
    x = np.random.default_rng(1).normal(size=(200, 8)) * 2
    p = lattice.nearest_e8(x)
    near = ((x - p) ** 2).sum(1)
    for v in lattice.ROOTS:
        assert (((x - p - v) ** 2).sum(1) >= near - 1e-9).all()


@pytest.mark.parametrize("block", [512, 3])
def test_lattice_links(spark, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 64))
    v = np.concatenate([base, base[:20] + rng.normal(size=(20, 64)) * 0.2, base[:5] + rng.normal(size=(5, 64)) * 0.45, base[:3]])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, []), (102, [0.0] * 64), (103, [float("nan")] + [1.0] * 63), (None, base[0].tolist()), (104, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in lattice.near_duplicates(df, block=block).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    want, have = linked.sum(1), np.array([got[i]["n_links"] for i in range(len(v))])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()
    assert all(got[i]["n_links"] == 0 for i in (100, 101, 102, 103, 104, None)) and len(got) == len(rows)
    assert got[100]["component_id"] == 100 and not got[None]["kept"]
    assert lattice.near_duplicates(df.where("false")).count() == 0


# -- archives ----------------------------------------------------------------------------------


def test_arc_versions_and_round_trip(spark, tmp_path):
    body = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "http://a/x y", body), (2, None, body), (3, "http://c", None), (4, "http://d", "short"), (5, "http://e", "short"), (6, "u", "é\r\n\r\nWARC/1.1\r\n" + body), (None, "n", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    arc, out = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    warc.write_arc(pages, arc)
    warc.write_warc(warc.with_types(warc.convert_arc(spark, arc)), out)
    got = {r["page_id"]: r for r in warc.read_warc(spark, out).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    assert (got[1]["record_type"], got[1]["refers_to"], got[2]["record_type"], got[2]["refers_to"]) == ("revisit", 2, "response", None)
    assert got[4]["record_type"] == got[5]["record_type"] == "response" and got[3]["payload_bytes"] == 0
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    one = warc.arc_block("1", [warc.arc_record("1", "http://a", b"HTTP/1.1 200 OK\r\n\r\nhi")], "n") + warc.arc_block("2", [warc.arc_record("2", "http://b", b"yo")], "n")
    a, b = warc.parse_arc(one)
    assert warc.split_http(a["content"])[1] == b"hi" and b["Result-code"] == "200" and b["content"] == b"yo"


# -- n-gram Jaccard ------------------------------------------------------------------------------


def shingles(text, k):
    raw = (text or "").encode()
    raw = raw.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k,least,group", [(3, 90, 2048), (5, 80, 2048), (5, 80, 4)])
def test_jaccard_groups(spark, monkeypatch, k, least, group):
    monkeypatch.setattr(sigtree, "GROUP", group)
    monkeypatch.setattr(sigtree, "BLOCK_DOCS", 8)
    r = random.Random(7)
    base = [prose(n, n) for n in (5, 9, 14, 40, 120, 300, 300)]
    texts = list(base)
    for b in base:
        for edits in (0, 1, 1, 2, 4, 9):
            w = b.split()
            for _ in range(edits):
                w[r.randrange(len(w))] = "EDIT%d" % r.randrange(9999)
            texts.append(" ".join(w).upper() if edits == 1 else " ".join(w))
    texts += [base[5] + " tail%d" % i for i in range(30)] + ODD
    got = {x["doc_id"]: x for x in sigtree.similar_groups(documents(spark, texts), k, sigtree.Rule(least)).collect()}
    sets = [shingles(t, k) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= least * (len(sets[i]) + len(sets[j]) - same):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == label
    kept = {x["doc_id"] for x in sigtree.keep_first(documents(spark, texts), k, sigtree.Rule(least)).collect()}
    assert kept == {i for i in range(len(texts)) if label[i] == i}


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    rule = sigtree.Rule(80)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(400)[: rng.integers(330, 400)]], rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64)])) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 2**63, 600, dtype=np.uint64))]  # a longer bitmap, which folds
    bits = sigtree.aligned([sigtree.bitmap(s) for s in sets])
    size = np.array([len(s) for s in sets])
    a, b = sigtree.tree_forest(size, bits, rule)
    nodes, low = components.local_forest(a, b)
    label = np.arange(60)
    label[nodes] = low
    for i in range(60):
        for j in range(i):
            if rule.linked(len(np.intersect1d(sets[i], sets[j])), size[i], size[j]):
                assert label[i] == label[j]


# -- decontamination --------------------------------------------------------------------------


def test_decontamination(spark):
    item = prose(40, 11)
    w = item.split()
    near = " ".join(w[:20] + ["swap"] + w[21:])
    texts = [prose(200, 1), prose(50, 2) + " " + item + " " + prose(70, 3), item.upper(), prose(30, 4) + " " + near, " ".join(w[:20]), *ODD, "tiny bit"]
    docs = documents(spark, texts)
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny bit"), (5, prose(60, 12))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.matches(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (len(texts) - 1, 4)}  # one word swapped in forty: 31 of 41 shingles, under 0.8
    assert got[1, 1]["start"] == 50 and got[1, 1]["similarity"] == 1.0
    kept = {r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {k[0] for k in got}
    assert decontam.matches(docs, bench.where("false")).count() == 0
    assert decontam.decontaminate(docs.where("false"), bench).count() == 0


def test_decontamination_runs_no_python(spark):
    bench = spark.createDataFrame([(1, prose(40, 11))], "item_id long, text string")
    plan = decontam.matches(documents(spark, [prose(99, 1)]), bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- html --------------------------------------------------------------------------------------


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain", "plain"), ("<nav>menu</nav>", ""),
    ("<body><nav>m</nav><article><h1>T</h1><p>One&nbsp;&amp; <b>t</b>wo<br>three<p>four</article><footer>f</footer>", "T One & two three four"),
    ("<body><div class='sidebar'>s</div><main><p>text text text</p><form>f</form><div id=comments><p>c</p></div></main>", "text text text"),
    ("<div class=ad>a</div><p>alpha beta gamma</p><script>x<y</script><p>d</p>", "alpha beta gamma d"),
    ("<article><p>cut short", "cut short"),
])
def test_html(page, want):
    assert html.extract(page) == want


# -- classifiers ---------------------------------------------------------------------------------


def held_out(spark, labels, column, folds, held, scored):
    want = {r["doc_id"]: r[column] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % folds == held}
    s = np.array([scored[i] for i in want])
    y = np.array(list(want.values()))
    return s, y


def auc(s, y):
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(d + "/documents.parquet"), spark.read.parquet(d + "/labels.parquet")
    out = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert auc(*held_out(spark, labels, "quality", 5, 0, out)) > 0.95
    odd = quality.classify(documents(spark, ODD), labels).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.classify(documents(spark, []), labels.where("false")).count() == 0


def test_gru_gradients():
    net = toxicity.Net(1)
    net.p = {k: v.astype(np.float64) * (30 if k in ("word", "gram") else 1) for k, v in net.p.items()}
    ids, table = np.array([[0, 1, 2, -1], [2, 0, -1, -1]]), np.random.default_rng(0).normal(size=(3, toxicity.SIZE))
    loss = lambda: net.forward(ids, table)[0] @ np.array([1.0, -2.0])
    _, tape = net.forward(ids, table, keep=True)
    g, dtab = net.backward(tape, table, np.array([1.0, -2.0]))
    for name, at in (("uf", (0, 3)), ("wb", (1, 2)), ("att", (1,)), ("out", (0,)), ("cb", (5,))):
        old, eps = net.p[name][at], 1e-3
        net.p[name][at] = old + eps
        up = loss()
        net.p[name][at] = old - eps
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2 / eps, rel=2e-2, abs=1e-4)


def test_toxicity_learns(spark):
    r = random.Random(1)
    texts, y = [], []
    for i in range(240):
        w = prose(r.randint(5, 80), i).split()
        if i % 3 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["zzbad", "zzworse", "zznasty"]))
        texts.append(" ".join(w))
        y.append(float(i % 3 == 0))
    net = toxicity.train(texts[:180], np.array(y[:180]), epochs=8)
    s = toxicity.score_texts(net, texts[180:])
    assert auc(s, np.array(y[180:])) > 0.95
    out = toxicity.score(documents(spark, ODD), net).collect()
    assert len(out) == len(ODD) and all(0 <= x["score"] <= 1 for x in out)


# -- mixing --------------------------------------------------------------------------------------


def test_mixing_keeps_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (1, "a", "p q r"), (None, "a", "k"), (None, "a", "l m"), (None, None, "n"), (2, "b", "u v w"), (3, "b", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op9_mixing(spark, str(tmp_path)).collect()
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=key) == sorted(((i, len((t or "").split())) for i, _, t in rows), key=key)
    assert all(r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"] for r in got)


def test_mixing(spark):
    texts = [prose(20 + i % 30, i) for i in range(300)] + ODD
    docs = documents(spark, texts, lambda i: None if i % 50 == 7 else f"s{min(i % 7, 2)}")
    m = mixing.mix(docs).collect()
    by = collections.defaultdict(list)
    for r in m:
        by[r["source"]].append(r)
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts)
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(1.5 * total)
    for v in by.values():
        assert abs(sum(r["words"] for r in v) - v[0]["target"]) <= 800
        assert all(r["copy"] <= 2 for r in v) and v[0]["target"] <= 2 * v[0]["source_size"] + 1e-6
    order = mixing.training_order(mixing.mix(docs))
    p = [r["position"] for r in order.collect()]
    assert p == sorted(p) and 0 <= p[0] and p[-1] <= 1
    assert [tuple(r) for r in order.collect()] == [tuple(r) for r in mixing.training_order(mixing.mix(docs)).collect()]
    assert mixing.mix(docs.where("false")).count() == 0


# -- pipeline -------------------------------------------------------------------------------------


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
    assert corpus_pipeline.STAGES[4][1](spark, docs, DIR).count() > 0


def test_shingle_hashes_match_sets():
    texts = ["A b c d", "a B C d e", "", "x y", "ä ö ü", "a b c d"]
    for k in (3, 5):
        for t, s in zip(texts, textbytes.shingle_sets(texts, k)):
            assert len(s) == len(shingles(t, k))


def test_clashing_columns(spark):
    extra = documents(spark, [prose(60, 1), prose(60, 1), prose(50, 2)]).withColumns({c: F.lit(1) for c in ("node", "key", "found", "start", "size", "item_id", "_rank_", "words", "copy")})
    assert sigtree.keep_first(extra).columns == extra.columns
    assert suffix.drop_later_copies(extra, 300, 200).columns == extra.columns
    bench = spark.createDataFrame([(1, prose(30, 9), 5)], "item_id long, text string, doc_id long")
    assert decontam.decontaminate(extra, bench).count() == 3
    assert mixing.training_order(mixing.mix(extra)).count() > 0


def test_batches_of_long_texts_end_by_their_bytes(spark):
    """The pipeline, in suffix_dedup on check_l: Arrow batches held up to 64 MB of whole texts, several times over in each task."""
    session, limit = spark.newSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = lambda s: s.range(0, 400, 1, 1).select("id", F.repeat(F.lit("x"), 50_000).alias("text"))
    make = lambda batch: iter([pd.DataFrame({"rows": [len(batch)], "chars": [batch["text"].str.len().sum()]})])
    sizes = common.map_texts(docs(session), make, "rows long, chars long").toPandas()
    assert sizes["rows"].sum() == 400 and sizes["chars"].sum() == 20_000_000
    assert sizes["chars"].max() < common.BATCH_BYTES + 100_000
    own = spark.newSession()
    own.conf.set(limit, "1MB")
    assert common.map_texts(docs(own), make, "rows long, chars long").toPandas()["chars"].max() < 1_200_000
    scored, net = spark.newSession(), toxicity.Net()
    assert toxicity.score(docs(scored).limit(2), net).count() == 2
    assert int(scored.conf.get(limit).removesuffix("b")) == common.BATCH_BYTES
