"""Text expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of the extraction operators
SNIPPET = r'(?s)class="result__snippet[^"]*"[^>]*>(.*?)</a>'
TAG = r"<[^>]+>"
MONEY = r"(?i)(?:₹|\$)\s*[\d\.,]+\s*(?:Trillion|Billion|Lakh\s*Crore|Crore|Cr)"


def tokens(text: Column) -> Column:
    """Lower case, split at white space in the Unicode sense, no empty tokens."""
    return F.array_remove(F.split(F.lower(text), r"(?U)\s+"), "")


def counts(tokens: Column) -> Column:
    """array<struct<term, tf>> of a row's tokens, by term: sorted once, then cut where the token changes. No shuffle."""
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  computed once

    def cut(own: Column) -> Column:
        starts = F.array_compact(F.transform(own, lambda x, i: F.when((i == 0) | (F.get(own, i - 1) != x), i)))
        size = lambda at, j: (F.coalesce(F.get(at, j + 1), F.size(own)) - F.get(at, j)).cast("long")
        return bound(starts, lambda at: F.transform(at, lambda p, j: F.struct(F.get(own, p).alias("term"), size(at, j).alias("tf"))))

    return bound(F.sort_array(tokens), cut)


def windows(text: Column, size: int, overlap: int) -> Column:
    """Fixed windows of size code points that begin every size - overlap; an empty or null text has none.

    The text is cut once into pieces of a step, and each window joins neighbours: linear in the text.
    """
    step = max(1, size - overlap)
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
    more = -(-(size - step) // step)
    joined = pieces  # no lambda reads the array itself: it would be made anew for each element
    for k in range(1, more + 1):
        joined = F.zip_with(joined, F.slice(pieces, F.lit(k + 1), F.size(pieces)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.transform(joined, lambda p: F.substring(p, F.lit(1), F.lit(size)))


def stripped(text: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def _references() -> tuple[Column, str, Column]:
    """All named references of HTML by their first letter, as a map is searched from its begin; a pattern of those that need no semicolon, the longest first; and the odd numbers."""
    import html
    from html.entities import html5

    pairs = lambda rows: F.create_map(*(F.lit(x) for pair in rows for x in pair))
    named = {n: c for n, c in html5.items() if n.endswith(";") or n + ";" not in html5 or html5[n + ";"] == c}
    short = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    odd = [(k, html.unescape(f"&#{k};")) for k in (0, 13, *range(128, 160))]
    letters = {letter: pairs([(n, c) for n, c in named.items() if n[0] == letter]) for letter in sorted({n[0] for n in named})}
    return F.create_map(*(x for letter, own in letters.items() for x in (F.lit(letter), own))), f"^(?:{'|'.join(short)})", pairs(odd)


def unescape(text: Column) -> Column:
    """Every character reference of HTML decoded, as a browser reads text: named ones, old ones also without their semicolon, and numbers.

    The text is cut at what may be a reference, and each piece is looked up: no Python runs.
    """
    letters, short, odd = _references()
    named = lambda name: F.try_element_at(F.try_element_at(letters, F.substring(name, 1, 1)), name)
    cut = F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32};?)|&|[^&]++"), F.lit(0))

    def character(code: Column) -> Column:
        # what is no character is dropped, what is out of range becomes the replacement character
        low = code.bitwiseAND(F.lit(0xFFFF))
        dropped = code.between(1, 8) | (code == 11) | code.between(14, 31) | code.between(127, 159) | code.between(0xFDD0, 0xFDEF) | low.isin(0xFFFE, 0xFFFF)
        utf = lambda *octets: F.decode(F.unhex(F.concat(*(F.lpad(F.hex(o), 2, "0") for o in octets))), "UTF-8")
        six = lambda shift: (F.shiftright(code, shift).bitwiseAND(F.lit(63)) + 128)
        shown = F.when(code < 128, utf(code)).when(code < 2048, utf(F.shiftright(code, 6) + 192, six(0))).when(code < 65536, utf(F.shiftright(code, 12) + 224, six(6), six(0))).otherwise(utf(F.shiftright(code, 18) + 240, six(12), six(6), six(0)))
        return F.coalesce(F.try_element_at(odd, code), F.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd").when(dropped, "").otherwise(shown))

    def number(digits: Column, base: int) -> Column:
        most = 12  # longer ones, without zeros in front, are out of range anyway
        trimmed = F.regexp_replace(digits, "^0+(?=.)", "")
        return F.when(F.length(trimmed) > most, F.lit(1 << 40)).otherwise(F.conv(trimmed, base, 10).cast("long"))

    def old(name: Column) -> Column:
        begin = F.regexp_extract(name, short, 0)
        return F.when(begin != "", F.concat(named(begin), F.substring(name, F.length(begin) + 1, F.length(name)))).otherwise(F.concat(F.lit("&"), name))

    def decoded(piece: Column) -> Column:
        name = F.substring(piece, 2, 64)
        number_of = lambda at, base: number(F.replace(F.substring(piece, at, 2**31 - 1), F.lit(";"), F.lit("")), base)
        reference = F.when(piece.rlike("^&#[xX]"), character(number_of(4, 16))).when(piece.startswith("&#"), character(number_of(3, 10))).otherwise(F.coalesce(named(name), old(name)))
        return F.when(piece.startswith("&") & (piece != "&"), reference).otherwise(piece)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(cut, decoded), "")).otherwise(text)


def snippets(page: Column, most: int = 3) -> Column:
    """The first so many result snippets, cleaned; those that are then empty fall away after the cut."""
    raw = F.slice(F.regexp_extract_all(page, F.lit(SNIPPET), 1), 1, most)
    return F.filter(F.transform(raw, lambda r: stripped(unescape(strip_tags(r)))), lambda s: s != "")


def money(text: Column) -> Column:
    """The first sum of money with a unit, or null."""
    return F.nullif(F.regexp_extract(text, MONEY, 0), F.lit(""))


def strip_fences(text: Column) -> Column:
    """Stripped; without a leading code fence (with or without `markdown`) and all from the last fence on."""
    whole = stripped(text)
    inner = F.when(whole.startswith("```markdown"), F.substring(whole, 12, 2**31 - 1)).otherwise(F.substring(whole, 4, 2**31 - 1))
    after = F.substring_index(inner, "```", -1)  # the whole, if there is no further fence
    kept = F.when(F.contains(inner, F.lit("```")), F.substring(inner, F.lit(1), F.length(inner) - F.length(after) - 3)).otherwise(inner)
    return F.when(whole.startswith("```"), stripped(kept)).otherwise(whole)


def thousands(x: Column) -> Column:
    return F.format_number(x, 2)


def plain(x: Column) -> Column:
    """Two decimals without separators."""
    return F.replace(F.format_number(x, 2), F.lit(","), F.lit(""))


def rupees(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit("₹"), thousands(x)), F.lit("N/A"))


def trend(pct: Column) -> Column:
    """`[+] +p%` or `[-] p%`; without a number `[+] Growth`."""
    up = F.concat(F.lit("[+] +"), plain(pct), F.lit("%"))
    down = F.concat(F.lit("[-] "), plain(pct), F.lit("%"))
    return F.when(pct.isNull(), "[+] Growth").when(pct >= 0, up).otherwise(down)


def numbered(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def bullets(lines: Column, lead: str = "- ") -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit(lead), x)), "\n")


def bucket(word: Column, buckets: int = 128) -> Column:
    """A word's bucket by the first 32 bits of its MD5: the same in every process."""
    return F.pmod(F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
