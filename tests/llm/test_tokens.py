"""BPE, token counts and packing against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from filigrane.llm import bpe, packing, token_counts
from filigrane.llm.shared import prepare

ODD = ["", "  ", "It's we'll don'T 'S're ''s", "ΣΑΣ İx é é", "a\x1cb c", "<|startoftext|> x<|endoftext|>y <|endoftext|", "日本語 한국어 x", "ab" * 3000, "12 3.4 ###%%", "a b c"]
SCHEMA = "doc_id long, text string, n_chars long, bin long, start string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path(bpe.VOCABULARY))


@pytest.fixture
def odd(spark):
    prepare(spark)
    rows = [(i, t, 0, 7, "x") for i, t in enumerate(ODD)] + [(None, "null id", 1, 1, None), (3, None, None, None, None), (3, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_encode_and_decode_equal_the_library(spark, odd, sf, library):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    want = sorted((r.doc_id is None, r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    got = bpe.round_trip(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.ids) for r in got) == want
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) and r.n_tokens == len(r.ids) for r in got)
    digests = {(r.doc_id, r.ids_sha256) for r in bpe.round_trip(docs, digests=True).collect()}
    assert digests == {(i, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for _, i, ids in want}


def test_no_documents(spark, odd):
    assert bpe.round_trip(odd.limit(0)).count() == 0 and bpe.round_trip(odd.limit(0), digests=True).count() == 0


def test_every_code_point_equals_the_library(library):
    enc = bpe.encoder(bpe.VOCABULARY)
    marks = [0x301, 0x308, 0x338, 0x11099, 0x16D67, 0x1611F]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or c % 16 == 0 or 0xE0000 <= c < 0xE0200)]
    odd = [c for c in points if enc.odd_of[c] and c < 0x20000]
    texts = [f"{chr(c)}a1" for c in points] + [f"X{chr(c)}'s{chr(c)}{chr(m)}" for c in odd for m in marks[:2]] + [f"{chr(c)}{chr(m)}" for c in range(0x250, 0x1200) for m in marks]
    texts += [chr(a) + chr(b) for a in range(0x16100, 0x16140) for b in range(0x16100, 0x16140)]
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    got = enc.encode_all(pa.array(texts, pa.string()))
    assert [t for t, a, b in zip(texts, want, got, strict=True) if a.ids != b.tolist()] == []


def test_segment_tree_merges_like_a_plain_scan():
    rng = np.random.default_rng(1)
    pairs = {(int(a), int(b)): (r, 10 + r) for r, (a, b) in enumerate({tuple(x) for x in rng.integers(0, 30, (200, 2))})}
    ranks = bpe.PairRanks(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    merged = np.array([m for _, m in pairs.values()], np.int32)
    words = [rng.integers(0, 10, rng.integers(1, 16)).tolist() for _ in range(300)]

    def plain(ids):
        ids = list(ids)
        while found := min(((pairs[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs), default=None):
            ids[found[1] : found[1] + 2] = [pairs[tuple(ids[found[1] : found[1] + 2])][1]]
        return ids

    tokens = np.full((len(words), 16), -1, np.int32)
    for row, w in zip(tokens, words):
        row[: len(w)] = w
    ids, counts = bpe.merge_many(tokens, ranks, merged)
    want = [plain(w) for w in words]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert [bpe.merge_one(w, pairs) for w in words] == want


def greedy(word, pieces, free):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if tuple(word[:k]) in pieces), 0)
        if not k:
            return n if tuple(word) in {(c,) for c in free} else 0
        n, word = n + 1, word[k:]
    return n


def test_automaton_counts_like_greedy_matching():
    rng = np.random.default_rng(2)
    for _ in range(30):
        pieces = {tuple(rng.integers(0, 3, rng.integers(1, 6)).tolist()) for _ in range(12)}
        ends = {(*p, 9) for p in list(pieces)[:4]}
        match = token_counts.LongestMatch([*pieces, *ends], free=(9,))
        for _ in range(200):
            word = [*rng.integers(0, 3, rng.integers(1, 12)).tolist(), 9]
            assert match.count(word) == greedy(word, pieces | ends, (9,))


def library_words(library, text):
    return [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]


def test_token_counts(spark, odd, library):
    got = {(r.doc_id, r.n_words): r for r in token_counts.count_tokens(odd).collect()}
    assert len(token_counts.count_tokens(odd).collect()) == odd.count()
    enc = bpe.encoder(bpe.VOCABULARY)
    byte_of = {s: i for i, s in enumerate(bpe.byte_symbols())}
    pieces = {tuple([byte_of[c] for c in t.removesuffix("</w>")] + [256] * t.endswith("</w>")) for t in enc.token_of.values() if t not in enc.special}
    for i in (2, 3, 6, 8):
        words = [w for c in ODD[i].split() for w in enc.words_in(bpe.unicodedata.normalize("NFC", "".join(x.lower() for x in c)))]
        assert got[i, len(words)].n_tokens == sum(greedy([*w.encode(), 256], pieces, (256,)) for w in words)
    special = sorted(enc.special)[0]
    texts = ["a\x1cb c", f"{special} x", f"the{special}{special}\x1fof", f" {special} ", "a\x1c\x1d", "the of the", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = {r.doc_id: r for r in token_counts.count_tokens(rows).collect()}
    for i, text in enumerate(texts):  # the library's own pretokens of what lies between special strings
        between = re.split(re.escape(special), text or "")
        words = [w for b in between for w in library_words(library, b)]
        n = (text or "").count(special)
        assert told[i].n_words == len(words) + n and told[i].n_unknown == 0
        assert told[i].n_tokens == n + sum(greedy([*(byte_of[c] for c in w), 256], pieces, (256,)) for w in words)
    assert got[0, 0].n_tokens == 0 and all(r.n_unknown == 0 for r in got.values())
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def check_packing(rows, docs, library, capacity):
    ids = defaultdict(list)
    for r in docs:
        ids[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 0])
    places = defaultdict(list)
    for r in rows:
        assert r.start == r.piece * capacity
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(x[r.start : r.start + capacity]) == r.length for x in ids[r.doc_id])
        places[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing(spark, odd, sf, library):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).repartition(7)
    for capacity, fan in ((2048, 64), (256, 2)):
        rows = packing.pack(docs, capacity=capacity, fan=fan).collect()
        n = check_packing(rows, docs.collect(), library, capacity)
        whole = packing.best_fit(np.array([r.length for r in rows]), capacity)[2]
        assert n <= len(whole) + 3
    assert packing.pack(odd.limit(0)).count() == 0


def test_packing_of_many_groups_a_partition(spark, library, monkeypatch):
    docs = spark.createDataFrame([(i, "one two three " * (i % 7)) for i in range(700)], "doc_id long, text string").repartition(2)
    monkeypatch.setattr(packing, "_BYTES", 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        rows = packing.pack(docs, capacity=64, local_pieces=1).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    check_packing(rows, docs.collect(), library, 64)


def test_best_fit_merges_across_groups(spark, library):
    docs = spark.createDataFrame([(i, "word") for i in range(40)], "doc_id long, text string").repartition(10)
    assert packing.pack(docs, capacity=100, fan=3).select("sequence_id").distinct().count() == 1
