"""Fingerprints, language ID, M-tree search, WARC, HTML text, quality trees and the pipeline."""

import base64
import hashlib
import math
import random
import timeit
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filigrane.llm import html_text, language_id, metric_tree, quality, syncmers, warc
from filigrane.llm.shared import prepare, scratch

CLASH = "b long, copy boolean, fp string, score double, bytes long, first long, page string"
EXTRA = (1, True, "x", 0.5, 2, 3, "p")


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)


def docs_of(spark, rows, more=""):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"doc_id long, text string{more}, {CLASH}")


def test_fingerprints(spark):
    rng = random.Random(1)
    words = [f"w{i}é" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 4, 7, 40, 400]))) for _ in range(60)] + ["", None, "a" * 20001, "\n x \t y"]
    rows = [(i * 97 - 900, t) for i, t in enumerate(texts)] + [(None, "left right")]
    rows[5] = (rows[5][0], rows[3][1])
    got = {r.doc_id: r for r in syncmers.edited_fingerprints(docs_of(spark, rows).repartition(4)).collect()}
    assert len(got) == len(rows)
    known = sorted((d, t or "") for d, t in rows if d is not None)
    for (d, t), (e, u) in zip(known, known[1:] + known[:1]):
        half = len(t) // 2
        edit = t[: len(t) - half] + u[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert (r.fingerprint == got[e].fingerprint) <= (r.near_next == 1.0) and 0 <= r.near_edited <= 1
        if edit == t:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    assert got[rows[5][0]].fingerprint == got[rows[3][0]].fingerprint
    assert got[None].near_next == 0.0 and got[None].edited_sha256 == hashlib.sha256(b"left ").hexdigest()
    assert syncmers.edited_fingerprints(docs_of(spark, rows).limit(0)).count() == 0


def test_fingerprints_equal_brute_force(spark):
    import xxhash

    hash64 = lambda b, seed: (x := xxhash.xxh64_intdigest(b, seed % 2**64)) - (x >> 63 << 64)
    of_longs = lambda *v: __import__("functools").reduce(lambda seed, x: hash64(int(x).to_bytes(8, "little", signed=True), seed), v, 42)

    def fingerprint(text):
        words = [w for w in __import__("re").split("[ \t-\r]+", text) if w]
        hashes = [hash64(w.encode(), 42) for w in words]
        pairs = [of_longs(a, b) for a, b in zip(hashes, hashes[1:])]
        found = {of_longs(*pairs[i : i + 1], pairs[i + 2], pairs[i + 3]) & 0xFFFFFFFF for i in range(len(pairs) - 3) if min(pairs[i], pairs[i + 3]) <= min(pairs[i + 1], pairs[i + 2])}
        if not found and words:
            seed = 42
            for w in words:
                seed = hash64(w.encode(), seed)
            found = {seed & 0xFFFFFFFF}
        return sorted(found)[: syncmers.SKETCH]

    def likeness(a, b):
        union = sorted({*a, *b})[: syncmers.SKETCH]
        return 1.0 if not a and not b else len({*union} & {*a} & {*b}) / max(1, len(union))

    rng = random.Random(8)
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate((0, 1, 4, 5, 6, 9, 30, 31, 300, 700, 40))] + [(11, None), (12, "x y\tz"), (13, "x y\tz"), (14, "é " * 9)]
    got = {r.doc_id: r for r in syncmers.edited_fingerprints(docs_of(spark, rows)).collect()}
    shown = lambda f: "".join(f"{h:08x}" for h in f)
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        edit = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        own, other, changed = fingerprint(t), fingerprint(u), fingerprint(edit)
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (shown(own), shown(changed))
        assert (got[d].near_edited, got[d].near_next) == (likeness(own, changed), likeness(own, other))


def test_anchors_do_not_depend_on_context(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(80))
    found = {}
    for r in syncmers.anchors(docs_of(spark, [(1, "one two three " + passage), (2, passage + " four")])).collect():
        found.setdefault(r.doc_id, {})[r.anchor] = r.position
    shared = found[1].keys() & found[2].keys()
    assert len(shared) >= 20 and all(found[1][a] - found[2][a] == 3 for a in shared)
    assert set(found[2]) - shared <= {a for a, p in found[2].items() if p >= 75}


def test_phrase_table_parses_like_longest_matches():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sample, text = rng.integers(2, 5, 60).tolist(), rng.integers(2, 6, 50).tolist()
        n, state = language_id.PhraseTable(*language_id.transitions(sample), 6).walk(text)
        assert language_id.PhraseTable(*language_id.transitions(sample), 6, 3).walk(text) == (n, state)  # letters without a column
        joined = "".join(map(str, sample))
        want, at = 0, 0
        while at < len(text):
            k = 1
            while at + k < len(text) and "".join(map(str, text[at : at + k + 1])) in joined:
                k += 1
            want, at = want + 1, at + k
        assert n + (state > 0) == want


def test_whole_texts_are_parsed_in_one_go(spark, sf, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    model = language_id.Model({"x": [t[:900] for t in texts[:20]], "y": ["aaaa bbbb"], "z": ["zz"]}).prepared()
    texts += ["", "a" * 5000, "ab" * 3000, "a" * 257, "b a" * 90]
    monkeypatch.setattr(language_id, "SEGMENT", 64)
    monkeypatch.setattr(language_id, "ROUNDS", 2)
    got = model.phrases(texts)[0]
    for k, alphabet in enumerate(model.alphabets):
        for t, n in zip(texts, got[:, k].tolist()):
            want, state = model.table(k).walk(alphabet[model.code(t.lower())].tolist())
            assert n == want + (state > 0)
    monkeypatch.setattr(language_id, "FEW_LETTERS", 5)
    monkeypatch.setattr(language_id, "COLUMNS", 5)
    monkeypatch.setattr(language_id, "KEPT_CELLS", 0)  # tables made anew, most letters looked up
    assert (language_id.Model({"x": [t[:900] for t in texts[:20]], "y": ["aaaa bbbb"], "z": ["zz"]}).prepared().phrases(texts)[0] == got).all()


def test_samples_of_tables_of_any_size():
    from filigrane.llm.shared import hash_below

    for n in (0, 1, 300):
        assert hash_below(300, n) == 2**63 - 1
    for n in (10**9, 10**12, 10**15):
        assert abs((hash_below(300, n) + 2**63) / 2**64 * n - 300) < 1


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    odd = spark.createDataFrame([(1, None, "x", 1.0), (2, "12 34 !", "x", 1.0), (3, "", None, None), (None, "the of and " * 9000, "x", 1.0)], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identified(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] == "en"
    held = [(r, zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in language_id.identified(docs, model).collect()]
    assert np.mean([r.lang == r.lang_pred for r, out in held if out]) > 0.95 and all(0 <= r.score <= 1 for r, _ in held)
    nothing = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identified(docs.limit(3), nothing).collect()} == {"und"}
    assert language_id.identified(docs.limit(0), model).count() == 0
    again = language_id.identified(docs.repartition(9), model, keep=["doc_id"]).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in again} == {(r.doc_id, r.lang_pred, r.score) for r, _ in held}


def test_languages_equal_plain_parses(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)

    def coded(text):  # letters a sample holds, one sign for all other letters, one for the rest
        return "".join(c if c in model.letters else "?" if c.isalpha() else " " for c in text.lower())

    def phrases(text, sample):
        n = at = 0
        while at < len(text):
            k = 1
            while at + k < len(text) and text[at : at + k + 1] in sample:
                k += 1
            n, at = n + 1, at + k
        return n

    samples = {k: coded(t) for k, t in model.texts.items()}
    texts = [r.text[:400] for r in docs.orderBy("doc_id").limit(25).collect() if r.text] + ["Ωμέγα", "a", "der the la", "x9 y8 " * 30]
    names, scores = model.prepared().predict(texts)
    for text, name, score in zip(texts, names, scores.tolist(), strict=True):
        low = coded(text)
        bits = {k: phrases(low, s) * np.log2(max(2, len(s))) / len(low) for k, s in samples.items()}
        best = min(sorted(bits), key=bits.get)
        assert abs(bits[name] - bits[best]) < 1e-12
        assert abs(score - 1 / sum(2.0 ** (-language_id.SHARPNESS * (b - bits[best])) for b in bits.values())) < 1e-9


def test_languages_of_many_scripts():
    rng = random.Random(12)
    scripts = {"ru": (0x430, 32), "uk": (0x430, 32), "el": (0x3B1, 24), "hi": (0x905, 45), "mr": (0x905, 45), "ka": (0x10D0, 33), "en": (0x61, 26), "ko": (0xAC00, 900), "zh": (0x4E00, 900), "ja": (0x4E00, 900)}

    def words(first, n):  # of one length in all languages, so that only letters tell
        return ["".join(chr(first + rng.randrange(n)) for _ in range(4)) for _ in range(150)]

    known = {k: words(*v) for k, v in scripts.items()}
    text = lambda k, n: " ".join(rng.choices(known[k], k=n))
    model = language_id.Model({k: [text(k, 2000)] for k in scripts}).prepared()
    asked = [k for k in scripts for _ in range(5)]
    assert model.predict([text(k, 30) for k in asked])[0] == asked
    assert model.predict(["\u0561\u0562\u0563 12", "12"])[0][1] == language_id.UNKNOWN


def test_metric_tree(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 8)) / 3
    x[100:300] = x[0]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(800, None), (850, [None, 1.0]), (900, [float("nan")] * 8), (None, [1.0] * 8), (950, [1.0]), (950, [0.5, 0.5]), (1000, [])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, score long, shard int").repartition(3)
    want = {}
    use = [(i, np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v))))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    got = metric_tree.nearest(table, table.filter("vec_id % 50 = 0"), shard_rows=150, block_rows=5).collect()
    for q, qv in use:
        if q % 50 == 0:
            want.setdefault(q, []).append(sorted((-int(qv @ v), i) for i, v in use if i != q)[:5])
    have = {}
    for r in got:
        have.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert set(have) == set(want)
    for q in want:
        if len(want[q]) == 1:
            assert [(s, i) for _, s, i in sorted(have[q])] == want[q][0]
    assert metric_tree.nearest(table.limit(0), table.limit(0)).count() == 0
    few = table.filter("vec_id in (0, 1)")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in metric_tree.nearest(few, few).collect()) == [(0, 1, 1), (1, 1, 0)]
    big = metric_tree.MTree(np.arange(2), metric_tree.exact_matrix([np.array([1e15, 1.0]), np.array([1e15, 2.0])]))
    assert big.search(big.x[0], 0, 1)[0] == [(2**63 - 1, 1)]
    big = metric_tree.MTree(np.arange(2), metric_tree.exact_matrix([np.array([1e6, 1.0]), np.array([1e6, 2.0])]))
    assert big.search(big.x[0], 0, 1)[0] == [(int(256e6) ** 2 + 256 * 512, 1)]


def test_metric_tree_holds_scores_to_64_bits(spark):
    prepare(spark)
    rng = np.random.default_rng(12)
    rows = [(i, [s * 2e6] * 64) for i, s in enumerate((1, 1, -1))] + [(10 + i, rng.normal(size=64).tolist()) for i in range(20)]
    rows += [(50, [1e306, -1e306]), (51, [8e305, 1.0]), (52, [-1.7e308] + [1.0] * 63), (100, [3e7] * 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)

    def whole(v):
        scaled = [256 * c for c in v] + [0.0] * (64 - len(v))
        return [(2**63 - 1 if c > 0 else -(2**63)) if abs(c) >= 2**63 else math.floor(c) for c in scaled]

    held = {i: whole(v) for i, v in rows}
    for shard_rows in (5, 1000):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in metric_tree.nearest(table, table.filter("vec_id % 50 = 0 or vec_id = 2"), shard_rows=shard_rows).collect())
        want = []
        for q in (0, 2, 50, 100):
            scores = {i: min(max(sum(a * b for a, b in zip(held[q], held[i])), -(2**63)), 2**63 - 1) for i in held if i != q}
            want += [(q, n, i, scores[i]) for n, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:5], 1)]
        assert got == want


def test_metric_tree_leaves_out_all_own_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 8))
    x /= np.sqrt((x**2).sum(1))[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 2 + [(50, x[50].tolist())] * 7 + [(7, x[7].tolist())] * 3 + [(100, x[1].tolist()), (100, x[2].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    use = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows]
    for shard_rows in (1000, 20):
        got = sorted((r.query_id, r["rank"], -r.score, r.vec_id) for r in metric_tree.nearest(table, table.filter("vec_id % 50 = 0"), shard_rows=shard_rows).collect())
        want = []
        for q in (0, 50, 100):  # a query's distinct vectors against every row of other ids
            asked = {tuple(v) for i, v in use if i == q}
            best = sorted((-int(np.dot(a, v)), i) for a in asked for i, v in use if i != q)[:5]
            want += [(q, n, s, i) for n, (s, i) in enumerate(best, 1)]
        assert got == want


def test_metric_tree_prunes():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 4)) * 5
    x = metric_tree.exact_matrix(list(np.repeat(centres, 250, 0) + rng.normal(size=(10_000, 4)) * 0.01))
    tree = metric_tree.MTree(np.arange(len(x)), x)
    best, pages, products = tree.search(x[0], 0, 5)
    scores = x @ x[0]
    assert [i for _, i in best] == sorted(range(1, len(x)), key=lambda i: (-scores[i], i))[:5] and pages < 20 and products < 10_000


def test_metric_tree_skips_vectors_of_leaves(monkeypatch):
    monkeypatch.setattr(metric_tree, "PAGE_ROWS", 32)
    rng = np.random.default_rng(6)
    for width, ties in ((2, 1), (3, 40), (16, 1)):
        x = np.round(rng.normal(size=(3000, width)) * 200 / ties) * ties
        x[500:600] = x[7]
        ids = rng.permutation(3000)
        tree, made = metric_tree.MTree(ids, x), 0
        for q in range(0, 3000, 100):
            best, pages, products = tree.search(x[q], int(ids[q]), 5)
            scores = x @ x[q]
            assert [i for _, i in best] == [int(ids[r]) for r in np.lexsort((ids, -scores)) if r != q][:5]
            made += products
        assert width > 3 or made < 30 * 3000 / 4  # in 16 dimensions few bounds hold


def test_warc(spark):
    odd = "WARC/1.1\r\n\r\nX\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"
    rows = [(1, "http://a/", "same"), (2, "http://b/é", "same"), (3, "u", odd), (4, None, None), (5, "x", ""), (6, "a\r\nb", odd), (None, "n", "same"), (None, "m", "only"), (2, "again", "same"), (7, "long", "é" * 300_000)]
    pages = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"page_id long, url string, html string, {CLASH}").repartition(3)
    for least in (0, 5):
        path = scratch(spark, "warc")
        warc.write_archive(pages, path, least)
        records = warc.read_records(spark, path, with_payload=True)
        got = warc.captures(records).collect()
        assert len(got) == len(rows)
        firsts = {}
        for i, _, h in rows:
            if i is not None:
                firsts[h or ""] = min(i, firsts.get(h or "", i))
        have = sorted((r.metadata.page_id or 0, r.record_type, r.response.payload_bytes, r.response.payload_digest) for r in got)
        b32 = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        want = []
        for i, _, h in rows:
            h = h or ""
            again = len(h.encode()) >= least and h in firsts and i != firsts[h]
            want.append((i or 0, "revisit" if again else "response", len(h.encode()), b32(h)))
        assert have == sorted(want)
        for r in got:
            if r.record_type == "response":
                assert b32(r.response.payload.decode()) == r.response.payload_digest
            else:
                first = next(x for x in got if x.response.record_id == r.response.refers_to)
                assert first.response.payload_digest == r.response.payload_digest and first.record_type == "response"
    sizes = spark.createDataFrame([(i, "u", "x" * n) for i, n in enumerate((0, 10, 70_000, 70_001, 3_000_000, 3_000_001))], "page_id long, url string, html string")
    for some in (sizes, sizes.filter("page_id > 3"), sizes.filter("page_id between 2 and 3")):
        path = scratch(spark, "warc")
        warc.write_archive(some, path)
        found = warc.captures(warc.read_records(spark, path)).select("metadata.page_id", "response.payload_bytes").collect()
        assert sorted((r.page_id, r.payload_bytes) for r in found) == sorted((r.page_id, len(r.html)) for r in some.collect())
    plain = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nWARC-Type: x\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert [b for _, b in warc.parse(plain)] == [b"abc", b""]
    assert warc.captures(warc.read_records(spark, path).limit(0)).count() == 0
    path = scratch(spark, "warc")
    warc.write_archive(pages.limit(0), path)
    empty = warc.read_records(spark, path)
    assert [r.kind for r in empty.collect()] == ["warcinfo"] and warc.captures(empty).count() == 0


def test_warc_requests_are_whole(spark):
    urls = {"http://a.b/x/y?q=1#f": ("/x/y?q=1", "a.b"), "https://u@h:8/": ("/", "h:8"), "http://h?q": ("/?q", "h"), "http://h": ("/", "h"), "no url": ("/", ""), "http://h/a b\r\nX: 1": ("/a%20b%20%20X:%201", "h"), None: ("/", "")}
    path = scratch(spark, "warc")
    warc.write_archive(spark.createDataFrame([(i, u, "p") for i, u in enumerate(urls)], "page_id long, url string, html string"), path)
    blocks = [b for row in spark.read.format("binaryFile").load(path).collect() for h, b in warc.parse(bytes(row.content)) if h["warc-type"] == "request"]
    want = [f"GET {asked} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode() for asked, host in urls.values()]
    assert sorted(blocks) == sorted(want)


def test_warc_query_names_the_first_of_many_copies(spark, tmp_path):
    pages = [(i, f"http://h/{i}", "same" if i % 3 else f"own {i}") for i in range(1, 60)] + [(100, "u", None), (101, "u", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.op6_warc(spark, str(tmp_path)).collect()}
    assert got == {i: ("revisit", 1) if h == "same" and i > 1 else ("revisit", 100) if i == 101 else ("response", None) for i, _, h in pages}
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: (r[3], r[4]) for r in con.sql(warc.OP6_SQL).fetchall()} == got


def test_html_text(spark):
    head = '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></ul></nav>'
    notice = "<div>this notice stands on every page of the host and says so here</div>"
    rows = [
        (1, "http://h/1", head + "<article><h1>A &amp; B</h1><p>x<b> y\n z<br>w</p><div class='comments'>no</div><p>&eacute;</article><aside>no</aside><footer>f</footer>"),
        (2, "http://h/2", head + notice + "<div>own text of page two is kept</div></body>"),
        (3, "http://h/3", head + notice + "<p>own text of page three</p><form>no</form>"),
        (4, "http://other/4", notice),
        (5, None, None),
        (6, "http://h/6", "<main><p>main part<div class='ad'>no</div></main><p>out"),
        (None, "not a url [", "plain < text"),
        (7, "http://h/7", "<article>" + "<p>word &lt;" * 3000 + "</article>"),
        (8, "http://i/8", notice), (8, "http://i/8", notice),
    ]
    pages = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"page_id long, url string, html string, {CLASH}").repartition(4)
    got = html_text.main_text(pages).collect()
    text = {r.page_id: r.text for r in got}
    own = "this notice stands on every page of the host and says so here"
    assert text == {1: "A & B\nx y z w\né", 2: "own text of page two is kept", 3: "own text of page three", 4: own, 5: "", 6: "main part", None: "plain < text", 7: "\n".join(["word <"] * 3000), 8: own}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_open_pages_lose_what_any_two_pages_of_a_host_share(spark):
    rng = random.Random(21)
    phrase = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(400)) for _ in range(n))
    shared = [phrase(rng.choice([5, 8, 9, 20, 40])) for _ in range(12)]
    rows = []
    for i in range(60):
        blocks = []
        for _ in range(rng.randrange(1, 7)):
            own = [phrase(rng.choice([1, 6, 12, 30])) for _ in range(rng.randrange(0, 3))] + rng.sample(shared, rng.randrange(0, 3))
            rng.shuffle(own)
            if own:
                blocks.append((rng.random() < 0.2, " ".join(own)))
        blocks.append((False, phrase(60)))  # so that no page is a copy of another
        rows.append((i, f"http://host{i % 3}/{i}", blocks))
    run = html_text.RUN
    streams = {i: [w for _, t in blocks for w in t.split()] for i, _, blocks in rows}
    met = {}
    for i, words in streams.items():
        for k in range(len(words) - run + 1):
            met.setdefault((i % 3, *words[k : k + run]), set()).add(i)

    def covered(i, lo, hi, inside):
        gone, words = [False] * (hi - lo), streams[i]
        for k in range(len(words) - run + 1):
            if len(met[(i % 3, *words[k : k + run])]) > 1 and (not inside or lo <= k and k + run <= hi):
                for at in range(max(k, lo), min(k + run, hi)):
                    gone[at - lo] = True
        return gone

    want = {}
    for i, _, blocks in rows:
        kept, at = [], 0
        for aside, text in blocks:
            words = text.split()
            lo, at = at, at + len(words)
            if not aside and not all(covered(i, lo, at, False)):
                kept.append(" ".join(w for w, g in zip(words, covered(i, lo, at, True)) if not g))
        want[i] = "\n".join(k for k in kept if k)
    html = lambda blocks: "".join(f"<nav>{t}</nav>" if aside else f"<div>{t}</div>" for aside, t in blocks)
    pages = spark.createDataFrame([(i, u, html(b)) for i, u, b in rows], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert got == want and sum(len(w.split()) for w in want.values()) < 0.8 * sum(map(len, streams.values()))


ARTICLE_HTML = "<article><p>text</p></article>"


@pytest.mark.parametrize(
    "page,want",
    [
        ("<html><head><title>t</title><body>" + ARTICLE_HTML, "text"),
        ("<head><meta charset=x><script>s</script><p>a<p>b", "a\nb"),
        ("<head><title>t</title><noscript><p>no</p></noscript></head>a", "a"),
        ('<div class="wrap has-sidebar"><nav>no</nav>' + ARTICLE_HTML + "</div>", "text"),
        ('<div class="content no-sidebar">a<div class="elementor-widget">b</div></div>', "a\nb"),
        ('<p>a<div class="cookie-banner">no</div><div id="site-footer">no</div><div class="left sidebar">no', "a"),
        ("<form><nav>no</nav>" + ARTICLE_HTML + "<p>no</form>", "text"),
        ("<a>skip</a><form><nav>no</nav><p>whole page of text</p></form>", "skip\nwhole page of text"),
        ("<p>text of the page</p><form>no</form>", "text of the page"),
        ('<div class="sidebar widget">no' + ARTICLE_HTML + "</div>", "text"),
        ("<div class=sidebar>no<main>text</main></div>", "text"),
        (ARTICLE_HTML + "<aside><article>no</article></aside>", "text"),
        ("<p>text<aside><article>more</article></aside>", "text\nmore"),
        ("<div><p class=notice>no<p>a</div>b", "a\nb"),
        ("<ul><li class=menu>no<li>a</ul>b", "a\nb"),
        ("<dl><dt class=alert>no<dd>a</dl>", "a"),
        ("<section><div class=notice>no</section>" + ARTICLE_HTML, "text"),
        ("<table><tr><td><div class=ad>no<td>a<tr><td>b</table>c", "a\nb\nc"),
        ("<div class=ad>no<div>no</div><p>no</div>a", "a"),
        ("<div><span class=ad>no<div></span>a</div>b</div>", "a\nb"),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p>", "a x=1 b"),
        ("<div><svg><path><p>a</p></div>", "a"),
        ("<p>a<svg><text>no</text></svg>b<noscript><p>no</p></noscript>c</p>", "abc"),
        ('<p title="x>Real</p><p>more', "Real\nmore"),
        ('<p title="x>no</p><p class="y">more', "more"),
        ('<p title="x>Real', "Real"),
        ("<p title='a>b' data-x=\"c>d\">text</p>", "text"),
        ("<p it's>a</p><p data=x'y>b", "a\nb"),
        ("<!doctype html><?x y?></ z><p>a<!-- <p>no --><!-->b-->c", "ab-->c"),
        ("a < b <1 <é> </é>c", "a < b <1 <é> c"),
        ("<SCRIPT>if (a</b/.x) '</p>'</SCRIPT ><p>a<style/>b", "ab"),
        ("<script src=x/>a", "a"),
        ("<div hidden>no</div><div data-hidden=1>a</div>", "a"),
        ("a<p", "a"),
    ],
)
def test_main_text_of_markup(page, want):
    blocks = html_text.blocks_of(page)
    best = max((p for p, _ in blocks), default=0)
    assert "\n".join(t for p, t in blocks if p == max(best, 0)) == want


def test_html_text_keeps_copies(spark):
    rng = random.Random(11)
    notice, one, two, other = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(n)) for k, n in (("n", 13), ("a", 40), ("b", 40), ("c", 30)))
    near = two.replace(two.split()[20], "edited")
    page = lambda *blocks: "<nav>menu</nav>" + "".join(f"<div>{b}</div>" for b in blocks)
    rows = [(i, "http://c/", page(notice, one, two)) for i in range(11, 14)] + [(14, "https://c/print", page(notice, one, near)), (15, "http://c/15", page(notice, other))]
    rows += [(i, "http://d/", page(notice, one)) for i in (21, 22)] + [(23, "http://d/23", page(notice, one + " more"))]
    rows += [(31, "http://e/", page(one)), (31, "http://e/", page(one)), (None, "http://e/", page(one)), (33, "http://e/33", "<article>x</article>" + page(notice))]
    pages = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"page_id long, url string, html string, {CLASH}").repartition(4)
    got = sorted(((r.page_id or 0, r.text) for r in html_text.main_text(pages).collect()))
    want = [(i, f"{one}\n{two}") for i in range(11, 14)] + [(14, f"{one}\n{near}"), (15, other), (21, f"{notice}\n{one}"), (22, f"{notice}\n{one}"), (23, f"{notice}\n{one} more")]
    assert got == [(0, one), *want, (31, one), (31, one), (33, "x")]


def test_deep_markup_takes_linear_time():
    n = 50_000
    blocks = html_text.blocks_of("<div class=ad>" + "<i>" * n + "<b>" * n + "</i>" * n + "</div><p>a" + "<div>" * n + "b")
    assert [t for p, t in blocks if p == 0] == ["a", "b"]


@pytest.mark.parametrize("unit", ['<a "', "<a x='", '<a x="', "<!--", "<script ", '<script "', "<a b=", "<", "<p>", "</p>", "<script>", "<a x='>y='", "<li><a x=y", "<a " + "b" * 50, "<!", "</", "<a =\">"])
def test_odd_markup_takes_linear_time(unit):
    def took(n):
        return min(timeit.repeat(lambda: html_text.blocks_of(unit * n + ">x"), number=1, repeat=3))

    assert took(40_000) < 12 * took(10_000) + 0.2


def test_suffix_groups():
    rng = np.random.default_rng(0)
    streams = [rng.integers(0, 2, rng.integers(0, 40)).astype(np.uint64) for _ in range(12)]
    order, group = html_text.suffix_groups(streams, 5)
    places = [(i, j) for i, s in enumerate(streams) for j in range(len(s))]
    runs = [tuple(streams[places[x][0]][places[x][1] : places[x][1] + 5].tolist()) for x in order]
    assert len(runs) == sum(max(0, len(s) - 4) for s in streams) and runs == sorted(runs)
    assert len(set(zip(runs, group.tolist()))) == len(set(runs)) == len(set(group.tolist()))


def test_host_suffix_array_is_one_over_all_batches(spark):
    rng = random.Random(4)
    rows = [(i, i, i, i % 2, [rng.choice("abc") for _ in range(rng.randrange(0, 60))], i % 3 == 0) for i in range(90)]
    pages = spark.createDataFrame(rows, "row long, page long, family long, host long, words array<string>, open boolean").repartition(7)
    run = 4
    array = html_text.suffix_array(html_text.page_suffixes(pages, run)).collect()
    keys = [bytes(r.key) for r in array]
    assert keys == sorted(keys)  # over all partitions
    met, name = {}, lambda r, k: html_text.suffix_keys(np.array([r[3]], np.uint64), html_text.token_numbers(r[3], r[4]), np.array([k]), run).tobytes()
    for r in rows:
        for k in range(len(r[4]) - run + 1):
            met.setdefault((r[3], *r[4][k : k + run]), []).append((r, k))
    assert len(set(keys)) == len(met) and set(keys) == {name(*places[0]) for places in met.values()}
    opened = sorted((row, place) for r in array for row, place in zip(r.rows, r.places))
    assert opened == sorted((r[0], k) for places in met.values() for r, k in places if r[5])
    got = sorted((r.row, r.place) for r in html_text.repeats(html_text.suffix_array(html_text.page_suffixes(pages, run))).collect())
    assert got == sorted((r[0], k) for places in met.values() if len({r[0] for r, _ in places}) > 1 for r, k in places if r[5])


def test_a_block_on_most_pages_of_a_host_is_no_article(spark):
    rng = random.Random(8)
    phrase = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    notice, half, short, copied = phrase(12), phrase(9), phrase(html_text.RUN - 1), phrase(60)
    rows, want = [], {}

    def add(i, host, tag, blocks, gone=()):
        rows.append((i, f"http://{host}/{i}", f"<{tag}>" + "".join(f"<p>{b}</p>" for b in blocks) + f"</{tag}>"))
        want[i] = "\n".join(b for b in blocks if b not in gone)

    for i in range(12):
        own = [phrase(30), notice, phrase(3), *([half] if i % 2 else []), short, notice[:-1] + "x", notice + " and more"]
        add(i, "most", "article" if i % 3 else "main", own, (notice, notice[:-1] + "x", notice + " and more"))
    for i in range(20, 20 + html_text.PAGES - 1):
        add(i, "few", "article", [phrase(30), notice])
    for i in range(40, 60):  # copies of one page, nearly; with it seven pages have the notice
        add(i, "copies", "article", [copied, phrase(1), notice])
    for i in range(60, 66):
        add(i, "copies", "article", [phrase(30), notice])
    for i in range(80, 100):
        add(i, "rest", "article", [phrase(30), *([notice] if i < 90 else [])])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in html_text.main_text(pages).collect()} == want


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = quality.grow(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    row, total = x[0], trees.start
    for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):  # the same, node by node
        node = 0
        while node < len(f):
            node = 2 * node + (2 if row[f[node]] > t[node] else 1)
        total += leaf[node - len(f)]
    assert abs(trees.score(x[:1])[0] - 1 / (1 + np.exp(-total))) < 1e-12
    assert quality.grow(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality.grow(x[:9], np.ones(9)).score(x) > 0.8).all()


def test_quality(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    trees = quality.fit(docs, labels)
    every = quality.scored(docs, trees).collect()
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}  # rows that were not learned
    found = [(r.score >= 0.5) == truth[r.doc_id] for r in every if r.doc_id in truth]
    assert len(found) > 15 and np.mean(found) > 0.9
    for r in every:  # the same, node by node
        row, total = quality.statistics(pa.array([r.text or ""]))[0], trees.start
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9
    odd = docs_of(spark, [(1, None), (1, None), (2, ""), (None, "A b. " * 30000), (3, "\x00")])
    got = quality.scored(odd, trees).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and got[0].fp == "x"
    assert quality.scored(odd.limit(0), quality.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_statistics():
    texts = ["Ab ab ab\ncd. 12", None, "", "é|é #"]
    got = {k: v for k, v in zip(quality.STATISTICS, quality.statistics(pa.array(texts)).T.tolist())}
    assert got["distinct_words"] == [4 / 5, 0, 0, 1] and got["doubled_words"][0] == 1 / 5 and got["top_word"][0] == 2 / 5
    assert got["upper"][0] == 1 / 15 and got["digits"][0] == 2 / 15 and got["lines"][0] == 1 / 15 and got["bars"][3] == 1 / 7
    sliced = quality.statistics(pa.array(["zz", *texts]).slice(1))
    assert np.allclose(sliced, quality.statistics(pa.array(texts)))


def test_pipeline_stages_against_plain_versions(spark, sf):
    import corpus_pipeline as P
    from test_similar import brute

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "language", "near duplicates", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = P.keep_quality(spark, docs, sf)
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and np.mean([(d in kept) == bool(q) for d, q in labels.items()]) > 0.95
    odd = docs.limit(20).unionByName(spark.createDataFrame([(10**6, "123 !", "en", "s", 5), (10**6 + 1, None, "en", "s", 0)], docs.schema))
    told = P.keep_language(spark, odd, sf)
    assert told.columns == docs.columns and {r.doc_id for r in told.collect()} == {r.doc_id for r in docs.limit(20).collect()}
    some = docs.limit(90).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "no id", "en", "s", 5)], docs.schema))
    left = [r.doc_id for r in P.keep_one_of_similar(spark, some, sf).collect()]
    rows = [(r.doc_id, r.text) for r in docs.limit(90).collect()]
    assert sorted(x for x in left if x is not None) == sorted({c for *_, c in brute(rows)}) and left.count(None) == 1
    clash = spark.createDataFrame([(5, "a b c d e f g", 1), (5, "a b c d e f g", 2), (5, "quite another text", 3), (6, "a b c d e f g", 4), (7, None, 5), (7, "", 6), (8, "", 7)], "doc_id long, text string, label long")
    clash = clash.withColumns({"m": F.create_map(F.lit("k"), "label"), "component_id": F.lit(0), "lang": F.lit("en"), "n": F.lit("x")})
    left = P.keep_one_of_similar(spark, clash, sf)
    assert left.columns == clash.columns and sorted((r.doc_id, r.text or "") for r in left.collect()) == [(5, "a b c d e f g"), (5, "quite another text"), (7, ""), (7, ""), (8, "")]
    for stage in (P.keep_quality, P.keep_language, P.keep_one_of_similar, P.pack):
        assert stage(spark, clash.limit(0), sf).count() == 0
    assert P.keep_quality(spark, clash, sf).columns == clash.columns and P.keep_language(spark, clash, sf).columns == clash.columns
    assert sorted(r.doc_id for r in P.pack(spark, clash, sf).collect()) == [5, 5, 5, 6, 7, 7, 8]
    packed = P.run(spark, sf)
    assert packed.columns[0] == "doc_id" and 0 < packed.select("doc_id").distinct().count() < docs.count()
