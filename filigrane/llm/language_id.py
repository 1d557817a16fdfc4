"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is turned into a table: state and letter give the next
state, and whether a phrase ends there because the text so far occurs nowhere in the language's sample.  A
text is parsed into its longest matches by walking the table; the language that needs the fewest phrases,
each counted as the logarithm of the sample's length, wins.  Texts are cut into segments that walk in step,
one table read for all segments; segments are then walked again from the state that the one before ended in,
until both walks agree, so that a whole text has the phrases of one parse from its first to its last character.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.llm.shared import annotated, hash_below, prepare, remainder, table

#: Labelled text of a language that is learned: so many characters, of so many documents, so many of each.
SAMPLE_CHARS = 50_000
SAMPLE_DOCS = 300
DOC_CHARS = 1_000
#: Characters that are learned in all, and languages: the commonest.  They bound what the driver gathers and ships: with more than
#: 40 languages each has a smaller sample.
SAMPLE_TOTAL = 2_000_000
MOST_LANGUAGES = 1_000
#: Numbers of tables that a worker keeps; with more, tables are made anew for each batch of texts.
KEPT_CELLS = 60_000_000
#: Characters that one lane walks, and rounds in which all lanes that don't agree yet walk in step.
SEGMENT = 256
ROUNDS = 4
#: Characters of texts that are parsed at a time; a longer text goes alone.
STEP_CHARS = 1_000_000
#: Letters of a language up to which each has a column of the table; with more, only so many, and the others' transitions are looked up.
FEW_LETTERS = 124
COLUMNS = 60
#: Differences of bits a character become odds by this power.
SHARPNESS = 4.0
_SPACE, _FOREIGN = 0, 1
UNKNOWN = "und"


def suffix_automaton(text: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions and suffix links of the smallest automaton that accepts every substring of text."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt, link


def transitions(text: list[int]) -> tuple[np.ndarray, int]:
    """(state, symbol, next state) of every transition of the text's suffix automaton, and how many states it has."""
    nxt, _ = suffix_automaton(text)
    return np.array([(s, c, t) for s, moves in enumerate(nxt) for c, t in moves.items()], np.int32).reshape(-1, 3), len(nxt)


class PhraseTable:
    """Calling it with states and symbols gives 4 * next state + phrases that ended on the way.

    Symbols below width have a column in a flat table; the transitions by others, of which there are few, are sorted.
    """

    def __init__(self, moves: np.ndarray, states: int, symbols: int, width: int | None = None):
        # a phrase ends before a symbol that can't follow; a symbol that the sample lacks is a phrase of its own
        self.restart = np.full(symbols, 2, np.int32)
        first = moves[moves[:, 0] == 0]
        self.restart[first[:, 1]] = 4 * first[:, 2] + 1
        self.symbols, self.width = symbols, width or symbols
        dense = np.tile(self.restart[: self.width], (states, 1))
        dense[0] -= 1
        near = moves[:, 1] < self.width
        dense[moves[near, 0], moves[near, 1]] = 4 * moves[near, 2]
        self.dense = dense.ravel()
        keys = moves[~near, 0].astype(np.int64) * symbols + moves[~near, 1]
        order = np.argsort(keys)
        self.keys, self.next = keys[order], 4 * moves[~near, 2][order]

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if not self.keys.size:
            return self.dense[state * self.width + symbol]
        out = self.dense[state * self.width + np.minimum(symbol, self.width - 1)]
        far = np.flatnonzero(symbol >= self.width)
        if far.size:
            keys = state[far] * self.symbols + symbol[far]
            at = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
            out[far] = np.where(self.keys[at] == keys, self.next[at], self.restart[symbol[far]] - (state[far] == 0))
        return out

    def walk(self, symbols: list[int]) -> tuple[int, int]:
        """Phrases that ended in a text, and the state it ends in."""
        n, s, flat, width = 0, 0, memoryview(self.dense), self.width
        for c in symbols:
            v = flat[s * width + c] if c < width else int(self(np.array([s]), np.array([c]))[0])
            n, s = n + (v & 3), v >> 2
        return n, s


class Model:
    """Samples by language; the tables are built where they are used."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names: list[str] = sorted(samples)
        most = min(SAMPLE_CHARS, SAMPLE_TOTAL // max(1, len(self.names)))
        self.texts = {k: " ".join(samples[k]).lower()[:most] for k in self.names}

    @cached_property
    def learned(self) -> list[tuple[np.ndarray, np.ndarray, int, int, float]]:
        """By language: its symbol of each code, its automaton's transitions, states, symbols and the bits of a phrase."""
        out = []
        for name in self.names:
            text = self.code(self.texts[name])
            alphabet, symbols = self.alphabet(text, 2 + len(self.letters))
            out.append((alphabet, *transitions(alphabet[text].tolist()), symbols, float(np.log2(max(2, len(text))))))
        return out

    @cached_property
    def letters(self) -> list[str]:
        return sorted({c for text in self.texts.values() for c in text if c.isalpha()})

    @cached_property
    def codes(self) -> np.ndarray:
        from filigrane.llm.bpe import _LETTER, char_kinds

        out = np.where(char_kinds() == _LETTER, _FOREIGN, _SPACE).astype(np.int32)
        out[[ord(c) for c in self.letters]] = 2 + np.arange(len(self.letters))
        return out

    def prepared(self) -> Model:
        """With the tables, which are far larger than what is learned; they are made where they are used."""
        self.alphabets, self.bits = ([x[k] for x in self.learned] for k in (0, 4))
        self.kept: dict[int, PhraseTable] = {}
        return self

    def table(self, k: int) -> PhraseTable:
        """A language's table; as many are kept as there is room for."""
        if k in self.kept:
            return self.kept[k]
        _, moves, states, symbols, _ = self.learned[k]
        made = PhraseTable(moves, states, symbols, None if symbols <= 2 + FEW_LETTERS else 2 + COLUMNS)
        if made.dense.size + sum(t.dense.size for t in self.kept.values()) <= KEPT_CELLS:
            self.kept[k] = made
        return made

    def __getstate__(self) -> dict:
        return {"names": self.names, "texts": {}, "letters": self.letters, "learned": self.learned}

    def alphabet(self, text: np.ndarray, codes: int) -> tuple[np.ndarray, int]:
        """A language's symbol of each code, and how many symbols it has; letters that its sample lacks are _FOREIGN."""
        counts = np.bincount(text, minlength=codes)
        counts[: _FOREIGN + 1] = 0
        ranked = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        out = np.full(codes, _FOREIGN, np.int64)
        out[_SPACE] = _SPACE
        out[ranked] = 2 + np.arange(len(ranked))
        return out, 2 + len(ranked)

    def code(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by text and language, letters and characters by text."""
        low = [t.lower() for t in texts]
        size = np.array([len(t) for t in low], np.int64)
        code = self.code("".join(low))
        ends = np.cumsum(size)
        letters = np.concatenate([[0], np.cumsum(code >= _FOREIGN)])
        n_letters = letters[ends] - letters[ends - size]
        lanes = -(-size // SEGMENT)
        total = int(lanes.sum())
        owner = np.repeat(np.arange(len(texts)), lanes)
        within = np.arange(total) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(ends - size, lanes) + within * SEGMENT
        length = np.minimum(SEGMENT, np.repeat(size, lanes) - within * SEGMENT)
        order = np.argsort(-length, kind="stable")
        place = np.empty(total, np.int64)  # of a lane, in text order, among those ordered by length
        place[order] = np.arange(total)
        before = np.full(total, -1)  # the place of the lane before in the same text
        before[place[1:][within[1:] > 0]] = place[:-1][within[1:] > 0]
        at, length, owner = at[order], length[order], owner[order]
        active = np.searchsorted(-length, -np.arange(SEGMENT), "left")  # lanes that have a symbol at each step
        out = np.zeros((len(texts), len(self.names)))
        steps = [code[at[:m] + j] for j, m in enumerate(active.tolist()) if m]
        final = place[np.cumsum(lanes)[lanes > 0] - 1]
        for k, alphabet in enumerate(self.alphabets):
            move = self.table(k)
            state, ended, walked = np.zeros(total, np.int64), np.zeros(total, np.int64), []
            for symbol in steps:
                m = symbol.size
                v = move(state[:m], alphabet[symbol])
                ended[:m] += v & 3
                state[:m] = v >> 2
                walked.append(v)
            entry = np.zeros(total, np.int64)
            for _ in range(ROUNDS):
                true = np.where(before >= 0, state[before], 0)
                lane = np.flatnonzero(true != entry)
                if not lane.size:
                    break
                entry, own = true, true[lane]
                for symbol, old in zip(steps, walked, strict=True):
                    here = lane < symbol.size
                    if not here.all():
                        state[lane[~here]] = own[~here]
                        lane, own = lane[here], own[here]
                    v = move(own, alphabet[symbol[lane]])
                    was = old[lane]
                    ended[lane] += (v & 3) - (was & 3)
                    old[lane] = v
                    apart = (v >> 2) != (was >> 2)  # the others go on as they did
                    lane, own = lane[apart], v[apart].astype(np.int64) >> 2
                    if not lane.size:
                        break
                state[lane] = own
            else:  # texts in which walks don't meet: one after the other, such lanes are few
                late = np.unique(owner[np.flatnonzero(np.where(before >= 0, state[before], 0) != entry)])
                for i in late.tolist():
                    n, s = move.walk(alphabet[code[ends[i] - size[i] : ends[i]]].tolist())
                    own = np.flatnonzero(owner == i)
                    ended[own], state[own] = 0, 0
                    ended[own[0]], state[place[np.cumsum(lanes)[i] - 1]] = n, s
            ended[final] += state[final] > 0
            out[:, k] = np.bincount(owner, ended, len(texts))
        return out, n_letters, size

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language and a score from 0 to 1 of each text; ties go to the first name."""
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        parts, held = [], []
        for t in texts:  # so many characters at a time
            held.append(t)
            if sum(map(len, held)) >= STEP_CHARS:
                parts.append(self.phrases(held))
                held = []
        parts += [self.phrases(held)] if held else []
        phrases, letters, size = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros((0, len(self.names))), np.zeros(0), np.zeros(0))
        bits = phrases * np.array(self.bits) / np.maximum(1, size)[:, None]
        best = bits.argmin(1)
        odds = 2.0 ** (-SHARPNESS * (bits - bits.min(1, keepdims=True)))
        known = letters > 0
        return [self.names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, 1 / odds.sum(1), 0.0)


def fit(docs: DataFrame) -> Model:
    """Learn from text and lang of documents that aren't held out (crc32(doc_id) mod 5 = 0).

    Of each of the MOST_LANGUAGES commonest languages a bounded sample: about SAMPLE_DOCS documents by a hash of
    doc_id and text (repeated rows count once), DOC_CHARS characters from the middle of each, SAMPLE_CHARS in all,
    and SAMPLE_TOTAL over all languages.
    """
    spark = docs.sparkSession
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    learn = learn.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    counts = learn.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return Model({})
    docs_each = max(1, min(SAMPLE_DOCS, 6 * SAMPLE_TOTAL // DOC_CHARS // len(counts)))
    most = F.broadcast(spark.createDataFrame([(r["lang"], hash_below(docs_each, r["n"])) for r in counts], "lang string, most long"))  # MOST_LANGUAGES rows
    start = F.greatest(F.lit(1), ((F.length("text") - DOC_CHARS) / 2).cast("int"))
    mark = F.xxhash64("doc_id", "text")
    found = learn.withColumn("mark", mark).join(most, "lang").filter("mark <= most").select("mark", "lang", "doc_id", F.substr("text", start, F.lit(DOC_CHARS)).alias("text"))
    rows = found.distinct().orderBy("mark", "lang", "doc_id", "text").limit(2 * docs_each * len(counts)).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"] * 2654435761 % 2**32, r["text"])):
        if r["text"] not in samples.setdefault(r["lang"], []):
            samples[r["lang"]].append(r["text"])
    return Model(samples)


def identified(docs: DataFrame, model: Model, columns: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """docs with the language and score of every whole text; a text that is null or without a letter is `und`, score 0.

    Rows that repeat, or repeat a doc_id, are rows of their own; equal texts have equal scores, and of equal scores the
    first name wins.  Texts of any length are parsed as a whole; columns of docs named like the new ones give way, all
    others stay as they are; an empty table has no rows, and a model of nothing says `und` to all.
    """
    model.learned  # noqa: B018  the automata are built once, on the driver

    def make():
        own = model.prepared()

        def work(texts):
            import pyarrow as pa

            said, score = own.predict([t or "" for t in texts.to_pylist()])
            return [pa.array(said, pa.string()), pa.array(score)]

        return work

    return annotated(docs, make, f"{columns[0]} string, {columns[1]} double", keep, 2_000_000)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; a null doc_id isn't held out."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    out = identified(docs, fit(docs), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
