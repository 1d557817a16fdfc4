"""Two-level chunking: parents of a text, children of each parent."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigrane.functions import text as T
from filigrane.sources.filings import is_blank

PARENT, CHILD, OVERLAP = 1024, 300, 50
EMBEDDED_CHARS = 2048
SHOWN_CHARS = 1200


def parents(docs: DataFrame, source: Column, content: Column, section: Column | None = None, size: int = PARENT, overlap: int = OVERLAP, split=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """source, section, parent_idx, parent_id, content, and columns to keep; blank texts have none.

    split: text column -> array of strings, instead of fixed windows (see recursive_split).
    """
    section = F.lit("general") if section is None else section
    pieces = split(content) if split else T.windows(content, size, overlap)
    rows = docs.filter(~is_blank(content)).select(source.cast("string").alias("source"), section.alias("section"), F.posexplode(pieces).alias("parent_idx", "content"), *keep)
    return rows.select("source", "section", "parent_idx", F.concat("source", F.lit("_p"), F.col("parent_idx").cast("string")).alias("parent_id"), "content", *keep)


def children(parents: DataFrame, size: int = CHILD, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """A parent's windows. The parent's text is not copied: join it by parent_id after ranking."""
    rows = parents.select("source", "section", "parent_idx", "parent_id", F.posexplode(T.windows(F.col("content"), size, overlap)).alias("child_idx", "content"), *keep)
    return rows.withColumn("child_id", F.concat("parent_id", F.lit("_c"), F.col("child_idx").cast("string")))


def recursive_split(size: int = PARENT, overlap: int = OVERLAP, separators: Iterable[str] = ("\n\n", "\n", " ", "")):
    """A splitter for parents(): breaks at the first separator that occurs, then at later ones where parts are too long.

    An Arrow UDF; how it cuts is this library's own choice, not that of any other splitter.
    """
    seps = tuple(separators)

    def cut(text: str, level: int) -> list[str]:
        if len(text) <= size:
            return [text]
        if level >= len(seps) or seps[level] == "":
            return [text[i : i + size] for i in range(0, len(text), size)]
        parts = text.split(seps[level])
        if len(parts) == 1:
            return cut(text, level + 1)
        return [piece for i, p in enumerate(parts) for piece in cut(p + (seps[level] if i + 1 < len(parts) else ""), level + 1) if piece]

    def merge(pieces: list[str]) -> list[str]:
        out: list[str] = []
        held: list[str] = []
        length = 0
        for p in pieces:
            if held and length + len(p) > size:
                out.append("".join(held))
                while held and (length > overlap or length + len(p) > size):
                    length -= len(held.pop(0))
            held.append(p)
            length += len(p)
        return out + (["".join(held)] if held else [])

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<string>")
    def split(text):
        return text.map(lambda t: [s for s in (c.strip() for c in merge(cut(t, 0))) if s] if t else [])

    return split
