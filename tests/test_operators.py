"""Operators against plain Python on small fixtures."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from filigrane.functions import text as T
from filigrane.functions import vectors as V
from filigrane.operators import bm25, chunking, fusion, report, statements, vector

CORPUS = ["the cat sat on the mat", "The dog sat", "", "cat cat dog | x", "nothing here", "the cat sat on the mat"]


def plain_bm25(texts, query, section=None, sections=None):
    tokens = [t.lower().split() for t in texts]
    n, avgdl = len(texts), sum(map(len, tokens)) / len(texts)
    out = []
    for i, own in enumerate(tokens):
        if section is not None and sections[i] not in ("general", section):
            continue
        tf, score = Counter(own), 0.0
        for term in query.lower().split():
            df = sum(term in t for t in tokens)
            if tf[term]:
                score += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf[term] * 2.5 / (tf[term] + 1.5 * (0.25 + 0.75 * len(own) / max(1, avgdl)))
        out.append((i, score))
    return sorted(out, key=lambda x: -x[1])


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame([(i, t, "general" if i % 2 else "de") for i, t in enumerate(CORPUS)], "k int, text string, section string")


@pytest.mark.parametrize("query", ["cat", "cat cat the", "unknown", "THE dog sat x", ""])
def test_bm25(corpus, query):
    got = [(r.k, r.score) for r in bm25.search(corpus, "k", "text", query, 99).orderBy("rank").collect()]
    want = plain_bm25(CORPUS, query)
    assert [k for k, _ in got] == [k for k, _ in want]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want))
    filtered = [r.k for r in bm25.search(corpus, "k", "text", query, 3, "xx", "section").orderBy("rank").collect()]
    assert filtered == [k for k, _ in plain_bm25(CORPUS, query, "xx", ["de", "general"] * 3)][:3]
    assert all(r.score > 0 for r in bm25.search(corpus, "k", "text", query, 9, drop_zero=True).collect())


def test_bm25_index(spark, corpus):
    asked = spark.createDataFrame([(1, "cat cat the"), (2, "dog")], "query_id int, query string")
    found = bm25.search_index(bm25.postings(corpus, "k", "text"), bm25.term_stats(corpus, "k", "text"), bm25.corpus_stats(corpus, "k", "text"), asked, "k", 2).collect()
    for q, words in ((1, "cat cat the"), (2, "dog")):
        got = sorted((r["rank"], r.k, round(r.score, 9)) for r in found if r.query_id == q)
        assert got == [(i + 1, k, round(s, 9)) for i, (k, s) in enumerate([x for x in plain_bm25(CORPUS, words) if x[1] > 0][:2])]


def plain_embedding(text):
    import hashlib

    v = [0.0] * 128
    for i, w in enumerate(text.lower().split()):
        v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 128] += 1 / (i + 1)
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


def test_hash_embedding_and_search(corpus):
    rows = {}
    for r in vector.hash_embedding(corpus, "k", "text").collect():
        rows.setdefault(r.k, {})[r.bucket] = r.value
    for i, t in enumerate(CORPUS):
        assert all(abs(rows.get(i, {}).get(b, 0.0) - x) < 1e-9 for b, x in enumerate(plain_embedding(t)))
    q = plain_embedding("cat dog zzz")
    score = [sum(a * b for a, b in zip(q, plain_embedding(t))) + 0.05 * ("|" in t) for t in CORPUS]
    got = [(r.k, r.score) for r in vector.search_text(corpus, "k", "text", "cat dog zzz", 99, boosted=True).orderBy("rank").collect()]
    assert all(abs(score[k] - s) < 1e-9 for k, s in got) and [k for k, _ in got] == sorted(range(6), key=lambda k: (-dict(got)[k], k))


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([3.0, 4.0, 9.0], [3.0, 4.0], 1.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert all(abs(r.got - r.want) < 1e-12 for r in df.withColumn("got", V.cosine(F.col("a"), F.col("b"))).collect())


def test_fusion(spark):
    lists = [spark.createDataFrame(x, "key string, rank int") for x in ([("p", 1), ("q", 2), ("p", 3), ("s", 4)], [("r", 1), ("q", 2), ("t", 4)])]
    got = [(r.key, round(r.score, 12)) for r in fusion.fuse(lists, "key", 9).orderBy("rank").collect()]
    want = {"p": 1 / 61 + 1 / 63, "q": 2 / 62, "r": 1 / 61, "s": 1 / 64, "t": 1 / 64}
    assert got == [(k, round(want[k], 12)) for k in ("p", "q", "r", "s", "t")]


def test_gate(spark):
    a = spark.createDataFrame([(1, 0.29)], "k int, score double")
    b = spark.createDataFrame([(2, 0.1)], "k int, score double")
    assert [r.k for r in fusion.gated(a, b).collect()] == [2]
    assert [r.k for r in fusion.gated(a.withColumn("score", F.lit(0.3)), b).collect()] == [1]
    assert [r.k for r in fusion.gated(a.limit(0), b).collect()] == [2]


def test_rewrite(spark):
    for said in ("My EXPANSION_PLANS", "clients_market financial_results", "plain words"):
        got = spark.range(1).select(fusion.rewrite(F.lit(said)).alias("q")).first().q
        assert got == fusion.rewrite_text(said) and got.startswith(said + " ")


def test_chunks(spark):
    texts = ["", "   \n", "a", "b" * 974, "c" * 975, "d" * 1024, "😀é" * 600]
    docs = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "name string, text string")
    parents = chunking.parents(docs, F.col("name"), F.col("text"))
    got = {}
    for r in parents.collect():
        got.setdefault(r.source, {})[r.parent_idx] = (r.parent_id, r.content)
    for i, t in enumerate(texts):
        want = {k: (f"f{i}_p{k}", t[k * 974 : k * 974 + 1024]) for k in range(math.ceil(len(t) / 974))} if t.strip() else {}
        assert got.get(f"f{i}", {}) == want
    ids = {r.child_id: r.content for r in chunking.children(parents).collect()}
    assert ids["f6_p0_c1"] == texts[6][250:550] and "f3_p0_c3" in ids and "f3_p0_c4" not in ids
    small = chunking.parents(docs, F.col("name"), F.col("text"), split=chunking.recursive_split(size=100, overlap=10))
    assert all(len(r.content) <= 100 for r in small.collect())


def plain_hybrid(docs, query, k):
    parts = []
    for name, text in sorted(docs):
        parents = [text[i : i + 1024] for i in range(0, len(text), 974)] if text.strip() else []
        parts += [(p, p[j : j + 300]) for p in parents for j in range(0, len(p), 250)]
    texts = [c for _, c in parts]

    def near(q):
        e = plain_embedding(q)
        scores = [(i, sum(a * b for a, b in zip(e, plain_embedding(t))) + 0.05 * ("|" in t)) for i, t in enumerate(texts)]
        return sorted(((i, round(s, 9)) for i, s in scores), key=lambda x: -x[1])[:8]

    hits, words = near(query), plain_bm25(texts, query)[:8]
    if hits[0][1] < 0.3:
        wide = fusion.rewrite_text(query)
        hits, words = near(wide), plain_bm25(texts, wide)[:8]
    fused = {}
    for own in (hits, words):
        for rank, (i, _) in enumerate(own, 1):
            fused[parts[i][0]] = fused.get(parts[i][0], 0.0) + 1 / (60 + rank)
    return sorted(fused.items(), key=lambda x: -x[1])[:k]


@pytest.mark.parametrize("query", ["unique needle phrase", "zzz"])
def test_hybrid_equals_a_plain_version(spark, query):
    texts = {"a": "lorem ipsum dolor " * 60, "b": " ".join(f"w{i}" for i in range(150)) + " unique needle phrase", "c": "needle | unique", "d": "unique needle phrase again", "e": " "}
    docs = spark.createDataFrame(list(texts.items()), "name string, text string")
    got = [(r.content, round(r.score, 9)) for r in fusion.hybrid(docs, "name", "text", query, 3).orderBy("rank").collect()]
    assert got == [(c, round(s, 9)) for c, s in plain_hybrid(texts.items(), query, 3)]


def test_growth(spark):
    rows = [("s", i, v) for i, v in enumerate([96523.40, 92997.80, 92391.10, 92762.20, 81378.90][::-1])]
    got = statements.latest_first(spark.createDataFrame(rows, "s string, i int, v double"), ["s"], "i", "v").orderBy("position").collect()
    assert [r.trend for r in got] == ["[+] +3.79%", "[+] +0.66%", "[-] -0.40%", "[+] +13.99%", "[+] Growth"]
    rows = [("z", i, v) for i, v in enumerate([0.0, 5.0, -1.0, 4.0, None, 3.0, 1.0, 2.0, 3.0])]
    got = statements.latest_first(spark.createDataFrame(rows, "s string, i int, v double"), ["s"], "i", "v").orderBy("position").collect()
    assert len(got) == 8 and [r.growth_pct is None for r in got] == [False, False, False, True, True, True, False, True]


def test_health(spark):
    rows = [(56801.0, 10211.5), (48290.4, 13824.0), (0.0, 1.0), (None, 1.0), (-5.0, 1.0), (1.0, 1.0)]
    got = statements.balance_health(spark.createDataFrame(rows, "equity double, debt double")).collect()
    assert [(r.de_text, r.health) for r in got] == [("0.18x", "Healthy Solvency"), ("0.29x", "Healthy Solvency"), ("N/A", "N/A"), ("N/A", "N/A"), ("-0.20x", "Healthy Solvency"), ("1.00x", "Elevated Leverage")]
    assert got[4].equity_negative


def test_five_factors_make_roe(spark):
    df = spark.createDataFrame([(60.0, 80.0, 100.0, 900.0, 1500.0, 700.0, 300.0)], "pat double, pbt double, ebit double, revenue double, assets double, equity double, debt double")
    r = statements.dupont(df).first()
    assert abs(r.tax_burden * r.interest_burden * r.operating_margin * r.asset_turnover * r.equity_multiplier * 100 - r.roe_pct) < 1e-9 and r.roce_pct == 10.0


def test_dcf(spark):
    df = spark.createDataFrame([(1, 100.0, 10.0, 50.0)], "grp int, fcf double, shares double, price double")
    r = statements.dcf(df, terminal_growth=0.03).first()
    flows = [100 * 1.06 ** min(y, 5) * 1.05 ** max(y - 5, 0) for y in range(1, 11)]
    value = sum(f / 1.13**y for y, f in enumerate(flows, 1)) + flows[-1] * 1.03 / 0.10 / 1.13**10
    assert abs(r.intrinsic - value) < 1e-6 and abs(r.price_mos30 - value * 0.07) < 1e-6
    with pytest.raises(ValueError):
        statements.dcf(df, terminal_growth=0.13)


def test_flags(spark):
    df = spark.createDataFrame([(1, True, False, None), (2, None, None, None)], "grp int, is_debt_safe boolean, is_liquidity_healthy boolean, is_earnings_high_quality boolean")
    a, b = statements.strengths_and_watch_points(df).orderBy("grp").collect()
    assert a.strengths == "1. " + statements.FLAGS[0][2] and a.watch_points == "1. " + statements.FLAGS[1][3] and (b.strengths, b.watch_points) == ("", "")


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.tokens(F.lit(" A b\t\nC "))) == ["a", "b", "c"]
    assert [one(T.plain(F.lit(x))) for x in (0.125, 2.675, -0.001, 1234567.891)] == ["0.12", "2.67", "-0.00", "1234567.89"]
    assert one(T.thousands(F.lit(1234567.891))) == "1,234,567.89"
    assert [one(T.money(F.lit(x))) for x in ("a ₹1.881 Trillion b", "$19.83 billion", "₹ 2,62,450 Cr", "none")] == ["₹1.881 Trillion", "$19.83 billion", "₹ 2,62,450 Cr", None]
    page = "".join(f'<a class="result__snippet x" href="#">{x}</a>' for x in ("one <b>&amp;\nmore</b>", " ", "&quot;q&quot;", "fourth"))
    assert one(T.snippets(F.lit(page))) == ["one &\nmore", '"q"']
    assert [one(T.strip_fences(F.lit(x))) for x in ("```markdown\na\n```", "```\nb\n``` tail", "c", "```d ``` e\n```")] == ["a", "b", "c", "d ``` e"]
    assert one(T.unescape(F.lit("&eacute;&lt;&#x41;"))) == "é<A"
    assert one(T.numbered(F.array(F.lit("a"), F.lit("b")))) == "1. a\n2. b"


def test_report(spark):
    rows = [("S", i, m) for i, m in enumerate(report.AUDIT_MARKERS)] + [("T", 0, report.AUDIT_MARKERS[0])]
    got = {r.symbol: r for r in report.audited(report.assemble(spark.createDataFrame(rows, "symbol string, ordinal int, markdown string"), F.lit("# x"), "end")).collect()}
    assert got["S"].is_accurate and not got["T"].is_accurate and got["T"].report == f"# x\n\n{report.AUDIT_MARKERS[0]}\n\n---\n\nend\n"
    said = spark.createDataFrame([("ctx " + report.CONTEXT_MARKER, report.TASK_MARKER + " do"), ("", report.TASK_MARKER), (None, " p ")], "context string, prompt string")
    assert [r.answer for r in report.completed(said).collect()] == ["ctx", report.NO_CONTEXT, "p"]

    def model(context, prompt):
        if not context:
            raise TimeoutError
        return "model"

    assert [r.answer for r in report.completed(said, model).collect()] == ["model", report.NO_CONTEXT, "p"]
    peers = spark.createDataFrame([("g", i, n) for i, n in enumerate(["Me", "", "a", None, "b", "c", "d", "e", "f", "h"])], "g string, i int, name string")
    assert [r.name for r in report.peers(peers, "ME", "g", "i", "name").orderBy("ordinal").collect()] == list("abcdef")
    listings = spark.createDataFrame([("Alpha Beta",), ("gamma",)], "name string")
    assert report.ticker_search(listings, "name", " A b ").count() == 1 and report.ticker_search(listings, "name", "al").count() == 0


def test_unescape_decodes_what_html_does(spark):
    import html
    import random
    from html.entities import html5

    rng, names = random.Random(1), sorted(html5)
    odd = ["&", "&&", "&#", "&#x", "&;", "&#;", "&#xg;", "& amp;", "&amp", "&ampamp;", "&notit;", "&notin;", "&" + "a" * 40 + ";", "", "é &lt;b&gt; &", "&#10000000000000000000000;", "&#0065;", "&#xD800;"]
    texts = odd + [f"&#{i};" for i in range(600)] + [f"&#x{rng.randrange(0x120000):x}" + rng.choice([";", "", "g"]) for _ in range(500)]
    texts += ["&" + n for n in names] + [a + "&" + n.rstrip(";") + b for n in names for a, b in [(rng.choice(["x", " "]), rng.choice(["q", "", ";", " ", "=1"]))]]
    got = [r.x for r in spark.createDataFrame([*enumerate(texts), (10**6, None)], "i int, t string").orderBy("i").select("i", T.unescape(F.col("t")).alias("x")).collect()]
    assert got == [html.unescape(t) for t in texts] + [None]
