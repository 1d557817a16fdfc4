"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree hold ``rank * leaves + position`` of each adjacent pair, so the root is the leftmost
pair of the lowest rank.  A merge changes three leaves and their ancestors.  Many words are merged at once:
one tree a word, all in one numpy array, each round taking every tree's root.  Words that are too long for
that, or too few, go through the same tree in plain Python.

White space never lies inside a pretoken, so a text is split at white space, each distinct chunk is encoded
once for each batch of texts.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.llm.shared import column, gathered, prepare, table

VOCABULARY = "word_bpe_49k.json"
#: Bytes of the texts that are encoded together; a longer text goes alone.
BATCH_BYTES = 8_000_000
LANES = 8192
_NONE = np.int32(2**31 - 1)


def vocabulary_path(name_or_path: str) -> str:
    """A path as it is; a bare name is one of the public tokenizers' files."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices of runs of counts items from starts, one run after the other."""
    total = int(counts.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


_BREAK, _LETTER, _NUMBER, _OTHER = range(4)
_kinds: list[np.ndarray] = []


def char_kinds() -> np.ndarray:
    """By code point: white space, letter, number or anything else."""
    if not _kinds:
        import regex

        out = np.full(0x110000, _OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, said in ((_BREAK, r"\p{White_Space}+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for m in regex.finditer(said, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                out[a : b + 1] = kind
        _kinds.append(out)
    return _kinds[0]


@dataclass
class CharTables:
    """What a tokenizers file makes of each code point, as runs: where they begin, their kind, and whether they are odd.

    Odd ones are those that this Python's Unicode tables don't know, normalize or class otherwise; chunks that
    hold one are normalized and split by the library itself.
    """

    starts: np.ndarray
    kinds: np.ndarray
    odd: np.ndarray

    def spread(self) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(np.append(self.starts, 0x110000))
        return np.repeat(self.kinds, sizes), np.repeat(self.odd, sizes)


_tables: dict[str, CharTables] = {}


def char_tables(name_or_path: str) -> CharTables:
    """Asked of the library once, on the driver: whole runs of code points first, halves of those where it differs."""
    if name_or_path in _tables:
        return _tables[name_or_path]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path(name_or_path))
    said = char_kinds()
    kind = said.copy()
    split = library.pre_tokenizer.pre_tokenize_str

    def spans(text: str) -> list[tuple[int, int]]:
        return [at for _, at in split(text)]

    def agrees(a: int, b: int) -> bool:
        text, n = "".join(map(chr, range(a, b))), b - a
        match said[a]:
            case 0:
                return spans(f"a{text}a") == [(0, 1), (n + 1, n + 2)]
            case 1:
                return spans(f"a{text}") == [(0, n + 1)]
            case 2:
                return len(spans(f"a{text}#")) == n + 2
        return spans(f"#{text}") == [(0, n + 1)]

    edges = np.unique(np.concatenate([[0, 0xD800, 0xE000], np.flatnonzero(np.diff(said)) + 1]))
    todo = [(a, b) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), 0x110000], strict=True) if a != 0xD800]
    while todo:
        a, b = todo.pop()
        if agrees(a, b):
            continue
        if b - a > 1:
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
            continue
        got = spans(f"a{chr(a)}#")
        kind[a] = {((0, 2), (2, 3)): _LETTER, ((0, 1), (1, 3)): _OTHER, ((0, 1), (2, 3)): _BREAK}.get(tuple(got), _NUMBER)
    odd = kind != said
    odd[0x33480:0xE0000] = odd[0xE0200:0xF0000] = True  # no characters as yet
    known = []
    for c in (*range(0xD800), *range(0xF900, 0x33480), *range(0xE0000, 0xE0200)):
        if unicodedata.category(chr(c)) == "Cn":
            odd[c] = True
        elif kind[c] != _BREAK and c != 124:
            known.append(chr(c))
    # alone, taken apart, and beside marks of the lowest and of a high combining class
    asked = [*known, *(d for c in known if (d := unicodedata.normalize("NFD", c)) != c)]
    asked += [x for c in known if unicodedata.combining(c) for x in (c + "\u0334", "\u0345" + c)]
    for text, low in zip(asked, library.normalizer.normalize_str("|".join(asked)).split("|"), strict=True):
        if low != "".join(x.lower() for x in unicodedata.normalize("NFC", text)):
            odd[[ord(c) for c in text if c not in "\u0334\u0345" and ord(c) > 127]] = True
    first = np.flatnonzero(np.concatenate([[True], (np.diff(kind) != 0) | (np.diff(odd) != 0)])).astype(np.int32)
    _tables[name_or_path] = CharTables(first, kind[first], odd[first])
    return _tables[name_or_path]


class PairRanks:
    """Open-addressing table from a pair of ids to the rank of its merge, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, bits: int = 18):
        while (1 << bits) < 4 * max(1, len(left)):
            bits += 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        self.probes = 1
        for rank, (key, slot) in enumerate(zip(self._key(left, right).tolist(), self._slot(self._key(left, right)).tolist(), strict=True)):
            step = 0
            while self.keys[slot] not in (-1, key):
                slot, step = (slot + 1) & self.mask, step + 1
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank
            self.probes = max(self.probes, step + 1)

    @staticmethod
    def _key(left, right):
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks; those of pairs without a merge, or with an id below 0, are _NONE."""
        key = self._key(left, right)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where((found == key) & (left >= 0) & (right >= 0), self.ranks[slot], _NONE)
        todo = np.flatnonzero((found != key) & (found != -1) & (left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not todo.size:
                break
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


def merge_one(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge one word with a segment tree in plain Python. ranks: pair -> (rank, merged id)."""
    n = len(ids)
    if n < 2:
        return list(ids)
    size = 1 << (n - 1).bit_length()
    none = (1 << 62, 0)
    tree = [none] * (2 * size)
    ids, nxt, prv = [*ids], [*range(1, n + 1)], [*range(-1, n - 1)]

    def rank(i: int, j: int) -> tuple[int, int]:
        found = ranks.get((ids[i], ids[j])) if 0 <= i and j < n else None
        return (found[0], i) if found else none

    for i in range(n - 1):
        tree[size + i] = rank(i, i + 1)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, value: tuple[int, int]) -> None:
        i += size
        tree[i] = value
        while i := i >> 1:
            best = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best

    dead = [False] * n
    while tree[1] != none:
        _, i = tree[1]
        j = nxt[i]
        after, before = nxt[j], prv[i]
        ids[i] = ranks[(ids[i], ids[j])][1]
        dead[j] = True
        nxt[i] = after
        if after < n:
            prv[after] = i
        put(j, none)
        put(i, rank(i, after))
        if before >= 0:
            put(before, rank(before, i))
    return [x for x, gone in zip(ids, dead, strict=True) if not gone]


def merge_many(tokens: np.ndarray, ranks: PairRanks, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge words of at most P symbols, P a power of two; tokens: (n, P) ids, -1 after a word's end.

    Returns all ids that remain, word after word, and their count a word.
    """
    n, size = tokens.shape
    width = size + 1
    tok = np.full((n, width), -1, np.int32)
    tok[:, :size] = tokens
    first = ranks(tok[:, :size].ravel(), tok[:, 1:].ravel()).reshape(n, size)
    nxt = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
    prv = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
    nxt[:, size], prv[:, 0] = size, size
    tree = np.full((n, 2 * size), _NONE, np.int32)
    tree[:, size:] = np.where(first == _NONE, _NONE, first * np.int32(size) + np.arange(size, dtype=np.int32))
    at = size >> 1
    while at:
        np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2], out=tree[:, at : 2 * at])
        at >>= 1
    tok, nxt, prv, flat = tok.ravel(), nxt.ravel(), prv.ravel(), tree.ravel()
    live = np.flatnonzero(tree[:, 1] != _NONE)
    while live.size:
        root = flat[live * (2 * size) + 1]
        pos, rank = root & np.int32(size - 1), root // np.int32(size)
        base, leaf = live * width, live * (2 * size) + size
        here = base + pos
        right = nxt[here]
        after, before = nxt[base + right], prv[here]
        new = merged[rank]
        tok[here], tok[base + right] = new, -1
        nxt[here], prv[base + after] = after, pos
        m = live.size
        two = ranks(np.concatenate([new, tok[base + before]]), np.concatenate([tok[base + after], new]))
        key_here = np.where(two[:m] == _NONE, _NONE, two[:m] * np.int32(size) + pos)
        key_left = np.where(two[m:] == _NONE, _NONE, two[m:] * np.int32(size) + before)
        edge = before == size
        before, key_left = np.where(edge, pos, before), np.where(edge, key_here, key_left)
        flat[leaf + right] = _NONE
        flat[leaf + pos] = key_here
        flat[leaf + before] = key_left
        node = np.concatenate([pos, right, before]).astype(np.int64) + size
        top = np.concatenate([leaf, leaf, leaf]) - size
        while node[0] > 1:
            node >>= 1
            low = top + 2 * node
            flat[top + node] = np.minimum(flat[low], flat[low + 1])
        live = live[flat[leaf - size + 1] != _NONE]
    kept = tok.reshape(n, width)[:, :size] != -1
    return tok.reshape(n, width)[:, :size][kept], kept.sum(1)


class Encoder:
    """A byte-level BPE vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str, tables: CharTables):
        import regex

        self.path, self.library = path, None
        self.kind_of, self.odd_of = tables.spread()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab, merges = said["model"]["vocab"], said["model"]["merges"]
        suffix = said["model"].get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int32)
        right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.ranks = PairRanks(left, right)
        self.rank_of = {}
        for i, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), self.merged.tolist(), strict=True)):
            self.rank_of.setdefault((a, b), (i, c))
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int32)
        self.token_of = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.token_of |= {i: t for t, i in self.special.items()}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        pattern = next(p["pattern"]["Regex"] for p in said["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_in = regex.compile(pattern).findall
        self.space = regex.compile(r"\p{White_Space}+")

    def by_library(self, chunk: str) -> str:
        """A chunk, which has no white space, as the file's normalizer makes it."""
        from tokenizers import Tokenizer

        self.library = self.library or Tokenizer.from_file(self.path)
        return self.library.normalizer.normalize_str(chunk)

    def split_by_library(self, chunk: str) -> list[str]:
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def encode_words(self, data: np.ndarray, size_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words whose bytes follow each other in data, and their count a word; size_of: bytes of each, over 0."""
        ends = np.cumsum(size_of)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        classes = 1 << np.ceil(np.log2(np.maximum(2, size_of))).astype(np.int64)
        counts, done = np.zeros(len(size_of), np.int64), []
        for size in np.unique(classes).tolist():
            rows = np.flatnonzero(classes == size)
            if size > 1024 or rows.size < 16:
                for i in rows.tolist():
                    ids = np.array(merge_one(symbols[ends[i] - size_of[i] : ends[i]].tolist(), self.rank_of), np.int32)
                    counts[i] = ids.size
                    done.append((np.array([i]), ids))
                continue
            lanes = max(64, min(LANES, (LANES * 16) // size))
            for at in range(0, rows.size, lanes):
                part = rows[at : at + lanes]
                lens = size_of[part]
                lane = np.repeat(np.arange(part.size), lens)
                place = np.arange(lane.size) - np.repeat(np.cumsum(lens) - lens, lens)
                tokens = np.full((part.size, size), -1, np.int32)
                tokens[lane, place] = symbols[place + np.repeat(ends[part] - lens, lens)]
                ids, counts[part] = merge_many(tokens, self.ranks, self.merged)
                done.append((part, ids))
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for part, ids in done:
            out[ragged(starts[part], counts[part])] = ids
        return out, counts

    def pretokens(self, chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pretokens of chunks (an Arrow array of strings without white space): NFC, then each character's lower case.

        Returns their bytes one after the other, each one's size in bytes, and how many each chunk has.
        """
        text = "\n".join(chunks.to_pylist())
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        odd = np.flatnonzero(self.odd_of[points])
        odd = np.unique(np.cumsum(points == 10)[odd]).tolist() if odd.size else []
        text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        if odd:
            lines = text.split("\n")
            for i in odd:
                lines[i] = self.by_library(chunks[i].as_py())
            text = "\n".join(lines)
        if "'" in text:  # contractions: the pattern itself, for the chunks that hold one
            split = {i: self.split_by_library for i in odd}
            text = "\n".join("\v".join(split.get(i, self.words_in)(c)) if "'" in c else c for i, c in enumerate(text.split("\n")))
        raw = text.encode("utf-8", "surrogatepass")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kind_of[points]
        new = np.ones(points.size, bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        if "'" in text:  # what the pattern has found stays one pretoken
            parts = np.zeros(points.size, bool)
            lines = np.cumsum(points == 10)
            quoted = np.unique(lines[points == 39])
            parts[np.isin(lines, quoted)] = True
            after = np.ones(points.size, bool)
            after[1:] = (kind[:-1] == _BREAK) | (kind[1:] == _BREAK)
            new = np.where(parts, after, new)
        first = np.flatnonzero(new)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.concatenate([np.cumsum(width) - width, [len(raw)]])
        sizes = np.diff(np.append(at[first], len(raw)))
        real = kind[first] != _BREAK
        line = np.cumsum(points == 10)[first[real]] if points.size else np.empty(0, np.int64)
        data = np.frombuffer(raw, np.uint8)[ragged(at[first[real]], sizes[real])]
        return data, sizes[real], np.bincount(line, minlength=len(chunks))

    def encode_chunks(self, chunks) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of distinct chunks, and their count a chunk; each distinct pretoken is merged once."""
        import pyarrow as pa

        if not len(chunks):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        data, sizes, per_chunk = self.pretokens(chunks)
        if not sizes.size:
            return np.empty(0, np.int32), per_chunk
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        own = words.dictionary
        ends = np.frombuffer(own.buffers()[1], np.int32)[: len(own) + 1].astype(np.int64)
        ids, counts = self.encode_words(np.frombuffer(own.buffers()[2], np.uint8)[: ends[-1]], np.diff(ends))
        rows = words.indices.to_numpy()
        out = ids[ragged((np.cumsum(counts) - counts)[rows], counts[rows])]
        last = np.cumsum(per_chunk)
        total = np.concatenate([[0], np.cumsum(counts[rows])])
        return out, total[last] - total[last - per_chunk]

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, its special tokens' strings included."""
        import pyarrow as pa

        out, at = [], 0
        for m in [*self.special_at.finditer(text), None]:
            chunks = pa.array([c for c in self.space.split(text[at : m.start() if m else None]) if c], pa.string())
            out.append(self.encode_chunks(chunks)[0])
            if m:
                out.append(np.array([self.special[m[0]]], np.int32))
                at = m.end()
        return np.concatenate(out)

    def encode_all(self, texts) -> Iterator[np.ndarray]:
        """The ids of each of an Arrow array of texts, in order; a null text has none."""
        import pyarrow as pa
        import pyarrow.compute as pc

        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        upto, at = np.cumsum(size), 0
        while at < len(texts):
            n = max(1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH_BYTES, "right")) - at)
            part = pc.fill_null(texts.slice(at, n), "")
            odd = pc.match_substring_regex(part, "[\x1c-\x1f]|" + "|".join(map(re.escape, self.special))).to_numpy(zero_copy_only=False)
            split = pc.utf8_split_whitespace(pc.if_else(pa.array(odd), "", part))
            chunks = split.flatten().dictionary_encode()
            ids, counts = self.encode_chunks(chunks.dictionary)
            rows = chunks.indices.to_numpy()
            starts = np.cumsum(counts) - counts
            bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
            for i in range(n):
                if odd[i]:
                    yield self.encode(part[i].as_py())
                else:
                    own = rows[bounds[i] : bounds[i + 1]]
                    yield ids[ragged(starts[own], counts[own])]
            at += n

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by one space: the vocabulary file names no decoder."""
        return " ".join(self.token_of[i] for i in ids)


_encoders: dict[str, Encoder] = {}


def encoder(name_or_path: str, tables: CharTables | None = None) -> Encoder:
    """One a process; tasks are given the tables that the driver made."""
    if name_or_path not in _encoders:
        _encoders[name_or_path] = Encoder(vocabulary_path(name_or_path), tables or char_tables(name_or_path))
    return _encoders[name_or_path]


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, digests: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids.

    docs: doc_id, text; other columns are ignored.  Returns doc_id, n_tokens and, per document, either
    ids array<int> and decoded string, or with digests=True ids_sha256 and decoded_sha256.  A null text is
    empty: no ids, empty decoded text.  Texts of any length are read as a whole.  Repeated rows and null doc_ids are
    kept as rows of their own; an empty table has no rows.
    """

    tables = char_tables(vocabulary)

    def run(batches):
        import pyarrow as pa

        enc = encoder(vocabulary, tables)
        digit_of, token_of = list(map(str, range(max(enc.token_of) + 1))), [enc.token_of.get(i) for i in range(max(enc.token_of) + 1)]
        for part in gathered(batches, BATCH_BYTES):
            n, a, b = [], [], []
            for found in enc.encode_all(column(part, "text")):
                ids = found.tolist()
                text = " ".join(map(token_of.__getitem__, ids))
                n.append(len(ids))
                if digests:
                    a.append(hashlib.sha256(" ".join(map(digit_of.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                else:
                    a.append(ids)
                    b.append(text)
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string() if digests else pa.list_(pa.int32())), pa.array(b, pa.string())], names=names
            )

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = ["long", "long", *(("string", "string") if digests else ("array<int>", "string"))]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    prepare(spark)
    return round_trip(table(spark, sf_dir, "documents"), digests=True)
