"""JSON inside free text: balanced spans of any depth, told apart from brackets in strings.

A text is cut once into strings, brackets and what lies between; one fold over these pieces follows the depth, so
the work is linear in the text.  A string ends on its line, as JSON has it, so that a lone quote in prose spoils no
more than its line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string, a bracket, a run of other characters, a lone quote; possessive, so that no text makes it step back.
PIECE = r'"(?:[^"\\\n]++|\\.)*+"|[\[\]{}]|[^"\[\]{}]++|"'
COMMENTS = "_comments"
#: Depth up to which one pattern finds an object; deeper ones, and those that hold the key again, are found by the fold.
SHALLOW = 6


def pieces(text: Column) -> Column:
    """A text cut at strings and brackets; the pieces joined are the text."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def balanced(text: Column) -> Column:
    """The span from a text's first character, an opening bracket, to the bracket that closes it; null if none does."""

    def step(s: Column, piece: Column) -> Column:
        moved = lambda by: F.struct((s["at"] + 1).alias("at"), (s["depth"] + by).alias("depth"))
        return F.when((s["depth"] == 0) & (s["at"] > 0), s).when(piece.isin("[", "{"), moved(1)).when(piece.isin("]", "}"), moved(-1)).otherwise(moved(0))

    def cut(own: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"))
        return bound(F.aggregate(own, start, step), lambda s: F.when((s["depth"] == 0) & (s["at"] > 0), F.array_join(F.slice(own, F.lit(1), s["at"]), "")))

    return bound(pieces(text), cut)


def span_after(text: Column, header: str, bracket: str) -> Column:
    """The balanced span that begins at the first such bracket after the first header; null if there is none."""
    after = F.when(F.contains(text, F.lit(header)), F.substring(text, F.locate(header, text) + len(header), F.length(text)))
    return bound(after, lambda part: F.when(F.contains(part, F.lit(bracket)), balanced(F.substring(part, F.locate(bracket, part), F.length(part)))))


def array_after(text: Column, header: str) -> Column:
    """array<variant> of the JSON array after a header; empty if there is none or it is not JSON."""
    found = F.try_variant_get(F.try_parse_json(span_after(text, header, "[")), "$", "array<variant>")
    return F.coalesce(found, F.array().cast("array<variant>"))


def object_after(text: Column, header: str) -> Column:
    """map<string, variant> of the JSON object after a header; empty if there is none or it is not JSON."""
    found = span_after(text, header, "{")
    return F.coalesce(F.from_json(F.when(F.try_parse_json(found).isNotNull(), found), "MAP<STRING, VARIANT>"), F.create_map().cast("map<string, variant>"))


def _object(depth: int) -> str:
    """A pattern of balanced objects of so many levels, with strings; possessive, so linear."""
    inner = f"|{_object(depth - 1)}" if depth else ""
    return rf'\{{(?:[^{{}}"]++|"(?:[^"\\\n]++|\\.)*+"{inner})*+\}}'


def keyed_objects(text: Column, key: str = COMMENTS) -> Column:
    """The texts of all objects under a key, at any depth and inside each other, in order of their beginning.

    The key counts where it stands as a key, not inside a string: there the quotes beside it are escaped.  Where one
    pattern finds an object for every key, that is all; else the text is folded piece by piece.
    """
    lead = rf'(?<!\\)"{key}"\s*+:\s*+'
    shallow = F.regexp_extract_all(text, F.lit(f"{lead}({_object(SHALLOW)})"), F.lit(1))
    folded = _folded_objects(text, key)
    found = bound(shallow, lambda own: F.when(F.size(own) == F.regexp_count(text, F.lit(lead + r"\{")), own).otherwise(folded))
    return F.when(F.contains(text, F.lit(f'"{key}"')), found).otherwise(F.array().cast("array<string>"))


def _folded_objects(text: Column, key: str) -> Column:
    # said: 1 after the key, 2 after its colon.  open: start and depth of those not yet closed.  done: "start:stop " of
    # each, as text, since adding to an array copies its elements one by one
    fields = ("at", "depth", "said", "open", "done")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("said"), F.array().cast("array<struct<start:int,depth:int>>").alias("open"), F.lit("").alias("done"))

    def step(s: Column, piece: Column) -> Column:
        def to(**new: Column) -> Column:
            new = {"at": s["at"] + 1, "said": F.lit(0)} | new
            return F.struct(*(new.get(f, s[f]).alias(f) for f in fields))

        deeper, last = s["depth"] + 1, F.try_element_at(s["open"], F.lit(-1))
        opened = F.concat(s["open"], F.array(F.struct((s["at"] + 1).alias("start"), deeper.alias("depth"))))
        ended = F.concat(s["done"], last["start"].cast("string"), F.lit(":"), (s["at"] + 1).cast("string"), F.lit(" "))
        shallower = F.greatest(F.lit(0), s["depth"] - 1)  # prose may close what nothing opened
        return (
            F.when(piece == f'"{key}"', to(said=F.lit(1)))
            .when((s["said"] == 1) & (F.trim(F.translate(piece, "\t\r\n", "   ")) == ":"), to(said=F.lit(2)))
            .when((piece == "{") & (s["said"] == 2), to(depth=deeper, open=opened))
            .when(piece.isin("[", "{"), to(depth=deeper))
            .when(piece.isin("]", "}") & F.coalesce(last["depth"] == s["depth"], F.lit(False)), to(depth=shallower, open=F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1), done=ended))
            .when(piece.isin("]", "}"), to(depth=shallower))
            .otherwise(to())
        )

    def cut(own: Column) -> Column:
        ends = F.transform(F.array_remove(F.split(F.aggregate(own, start, step, lambda s: s["done"]), " "), ""), lambda o: F.split(o, ":").cast("array<int>"))
        found = F.array_sort(F.transform(ends, lambda o: F.struct(F.get(o, F.lit(0)).alias("start"), F.get(o, F.lit(1)).alias("stop"))))
        return F.transform(found, lambda o: F.array_join(F.slice(own, o["start"], o["stop"] - o["start"] + 1), ""))

    return bound(pieces(text), cut)
