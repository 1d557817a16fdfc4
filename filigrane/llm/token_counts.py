"""Token counts by a linear longest-match automaton.

The vocabulary's trie gets, for each node, a failure link and the number of pieces that greedy matching has
closed when it takes that link.  A word is then read once, symbol by symbol: the pops add up to the number of
its greedy word pieces, and no piece is ever built.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.llm.bpe import BATCH_BYTES, VOCABULARY, byte_symbols, char_tables, encoder
from filigrane.llm.shared import column, gathered, prepare, table

#: The symbol after a word's last byte, for vocabularies that mark word ends.
END = 256
_STRIDE = 512


class LongestMatch:
    """pieces: sequences of symbols below 512. free: symbols that, left alone, close a word without a piece."""

    def __init__(self, pieces, free=()):
        child: dict[int, int] = {}
        is_piece = [False]
        edges: list[list[tuple[int, int]]] = [[]]
        for piece in [*pieces, *((c,) for c in free)]:
            node = 0
            for c in piece:
                nxt = child.get(node * _STRIDE + c)
                if nxt is None:
                    nxt = len(is_piece)
                    child[node * _STRIDE + c] = nxt
                    edges[node].append((c, nxt))
                    edges.append([])
                    is_piece.append(False)
                node = nxt
            is_piece[node] = node != 0
        self.child, self.fail, self.pops = child, [-1] * len(is_piece), [0] * len(is_piece)
        unpaid = {child[c] for c in free}
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in edges[u]:
                queue.append(v)
                if is_piece[v]:
                    self.fail[v], self.pops[v] = 0, int(v not in unpaid)
                    continue
                z, more = self.fail[u], 0
                while z >= 0 and z * _STRIDE + c not in child:
                    more += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = child[z * _STRIDE + c], self.pops[u] + more

    def count(self, symbols) -> int:
        """The number of greedy longest-match pieces; 0 if the word has none that cover it."""
        child, fail, pops = self.child, self.fail, self.pops
        node = n = 0
        for c in symbols:
            while (nxt := child.get(node * _STRIDE + c)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = nxt
        while node:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


_automata: dict[str, LongestMatch] = {}


def automaton(vocabulary: str) -> LongestMatch:
    """Of a tokenizers file with word ends: its tokens as bytes, the word end as END, which may also stand alone."""
    if vocabulary not in _automata:
        enc, byte_of = encoder(vocabulary), {s: i for i, s in enumerate(byte_symbols())}

        def symbols(token: str):
            end = token.endswith("</w>")
            return [byte_of[c] for c in (token[:-4] if end else token)] + [END] * end

        _automata[vocabulary] = LongestMatch((symbols(t) for t in enc.token_of.values() if t not in enc.special), free=(END,))
    return _automata[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every whole text.

    A word is a pretoken of the vocabulary file, or one of its special strings, which is one token; a word that
    pieces can't cover counts as one unknown token.  A null or empty text has zeros. Texts of any length are read as a
    whole. Repeated rows and null doc_ids stay as rows of their own; other columns are ignored; an empty table has no rows.
    """
    tables = char_tables(vocabulary)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        enc, match = encoder(vocabulary, tables), automaton(vocabulary)
        odd_text = "[\x1c-\x1f]|" + "|".join(map(re.escape, enc.special))

        def counted(split):
            """Words, tokens and unknown ones of each list of an Arrow array of lists of chunks."""
            chunks = split.flatten().dictionary_encode()
            data, sizes, per_chunk = enc.pretokens(chunks.dictionary)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            words = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
            found = np.fromiter((match.count((*w, END)) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
            found = found[words.indices.to_numpy()] if len(sizes) else np.empty(0, np.int64)
            last = np.cumsum(per_chunk)

            def over(per: np.ndarray, width: np.ndarray) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(per)])
                return total[last] - total[last - width] if len(width) else np.empty(0, np.int64)

            rows = chunks.indices.to_numpy()
            bounds = split.offsets.to_numpy() - split.offsets[0].as_py()

            def by_text(per_chunk_value: np.ndarray) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(per_chunk_value[rows])]) if len(rows) else np.zeros(1, np.int64)
                return total[bounds[1:]] - total[bounds[:-1]]

            return by_text(per_chunk), by_text(over(np.maximum(found, 1), per_chunk)), by_text(over((found == 0).astype(np.int64), per_chunk))

        for part in gathered(batches, BATCH_BYTES):
            texts = pc.fill_null(column(part, "text"), "")
            odd = pc.match_substring_regex(texts, odd_text)  # these are cut as the vocabulary's own library does
            numbers = counted(pc.utf8_split_whitespace(pc.if_else(odd, "", texts)))
            at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            own = texts.take(pa.array(at)).to_pylist()
            cut = [[c for piece in enc.special_at.split(t) for c in enc.space.split(piece) if c] for t in own]
            if own:
                special = np.array([sum(1 for _ in enc.special_at.finditer(t)) for t in own])
                for number, more, extra in zip(numbers, counted(pa.array(cut, pa.list_(pa.string()))), (special, special, 0), strict=True):
                    number[at] = more + extra
            n_words, n_tokens, n_unknown = numbers
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    prepare(spark)
    return count_tokens(table(spark, sf_dir, "documents"))
