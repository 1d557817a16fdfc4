"""Main text of web pages, with a host suffix array for boilerplate.

A page's markup gives blocks of text and where they stand: in an article, in the main part, in the open, or
in furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments).  Furniture and open blocks
are token streams.  The suffixes of all pages of a host are sorted into one suffix array, and tokens in substrings
of RUN tokens or more that repeat on distinct pages are covered.  A page's text is its article; without one, its
main part; without either, its open blocks without those that are covered as a whole, and of the others the
runs that no repeat inside the block covers.

Blocks of an article or main part have suffixes in the array too, each from where it begins.  Such a block is a
notice, and goes, only if it stands as a whole on PAGES pages of its host at least and on most of all of them;
else what stands in an article is never removed for being repeated.

A batch of pages is sorted in one task.  Suffixes that are equal as deep as they are sorted go on as one row, and
Spark's sort by host and tokens merges the batches' arrays, however many pages a host has.  Neighbours that share
RUN tokens are a repeat.  Pages whose text is the same or nearly so (the Jaccard join's components) are copies of
one page: what only copies share is no boilerplate and stays in each.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.llm.jaccard_join import similar_components
from filigrane.llm.shared import column, gathered, prepare, staged, table

#: Tokens that a repeated substring has at least.
RUN = 8
#: Pages, copies counted once, on which a block of an article stands at least when it is a notice.
PAGES = 8
#: Bytes of a host and of a token in the array's keys.
_HOST_BYTES, _TOKEN_BYTES = 4, 6
OPEN, MAIN, ARTICLE = range(3)
#: Other places while a page is read: furniture, a form, an article in furniture, what is never shown.
_ASIDE, _FORM, _AGAIN, _UNSHOWN = -1, -2, -3, -4
#: Their content is no markup; unclosed, it runs to the end of the page.
_RAW = tuple("script style textarea title iframe".split())
_SILENT = frozenset("noscript template svg object canvas select audio video annotation annotation-xml".split())
_FURNITURE = frozenset("nav footer aside dialog menu button fieldset".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsored promo banner sidebar cookie cookies consent notice alert newsletter subscribe share sharing social related recommended comment comments "
    "disqus respond menu navbar navigation nav breadcrumb breadcrumbs pagination pager footer masthead site-header popup modal overlay login signup skip-link toolbar widget".split()
)
_PARTS = _NAMES | {"site"}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())
_BLOCKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre section article main header figure figcaption address hr body html details summary center".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_IN_HEAD = frozenset("title meta link style script noscript base template".split())
#: Elements that are followed whatever they stand in; others only where they or what they stand in isn't kept.
_FOLLOWED = (_BLOCKS | _FURNITURE | _SILENT | frozenset("form td th head hgroup search".split())) - _VOID - {"html", "body"}
#: Start tags that end an open p, and what keeps a p, li, dt or dd out of their reach or an end tag's.
_END_P = (_BLOCKS | frozenset("form nav footer aside dialog menu fieldset hgroup search".split())) - frozenset("thead tbody tfoot tr caption html body".split())
_CELLS = ("table", "td", "th", "caption")
_STOPS = {k: (*_CELLS, *_SILENT, *more.split()) for k, more in {"p": "button", "li": "ul ol menu section article main nav aside blockquote fieldset", "dt": "dl section article main nav aside blockquote fieldset"}.items()}
_STOPS["dd"] = _STOPS["dt"]
_TABLE_PARTS = {"tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")} | dict.fromkeys(("thead", "tbody", "tfoot", "caption"), ("thead", "tbody", "tfoot", "caption", "tr", "td", "th"))
_OPENED = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_PLAIN = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>")
_ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+>?", re.I) for name in _RAW}


def tokens_of(page: str):
    """(text, "", "", "") or ("", "/" of an end tag, name, attributes) of a page, in one pass of linear time.

    Comments, declarations and the content of _RAW elements are left out; unclosed, they run to the page's end.
    A quoted value may hold ">".  Where a tag's quotes are not closed before the page ends, it and all later
    tags end at the first ">".  A tag without any ">" is the end of the page, as is text after it.
    """
    at, n, last, tag_at = 0, len(page), page.rfind(">"), _OPENED
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], "", "", ""
            return
        if lt > at:
            yield page[at:lt], "", "", ""
        first = page[lt + 1 : lt + 2]
        letter = page[lt + 2 : lt + 3] if first == "/" else first
        named = letter.isascii() and letter.isalpha()
        if first in ("!", "?") or (first == "/" and letter and not named):
            closed = page.find("-->", lt + 2) if page.startswith("<!--", lt) else page.find(">", lt)
            if closed < 0:
                return
            at = closed + (3 if page.startswith("<!--", lt) else 1)
            continue
        if not named:
            yield "<", "", "", ""
            at = lt + 1
            continue
        if lt > last:
            return
        m = tag_at.match(page, lt)
        if m is None:
            tag_at = _PLAIN
            m = tag_at.match(page, lt)
        if m is None:
            yield "<", "", "", ""
            at = lt + 1
            continue
        at, name, attrs = m.end(), m["name"].lower(), m["attrs"]
        if name in _RAW_ENDS and not m["end"]:
            closed = None if attrs.endswith("/") else _RAW_ENDS[name].search(page, at)
            at = at if attrs.endswith("/") else closed.end() if closed else n
            continue
        yield "", m["end"], name, attrs


def _named(value: str) -> bool:
    """Whether a class or id is a name of furniture, or joined of such names only (cookie-banner, not has-sidebar)."""
    return any(token in _NAMES or all(part in _PARTS for part in re.split("[_-]+", token)) and token != "site" for token in value.split())


def _is_furniture(name: str, attrs: str, in_article: bool) -> bool:
    if name in _FURNITURE or (name == "header" and not in_article):
        return True
    if not attrs or name in ("html", "body", "main", "td", "th"):
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id"):
            if _named(value) and not (name == "article" and "comment" not in value):
                return True
        elif (key == "role" and value in _ROLES) or (key == "aria-hidden" and value == "true") or key == "hidden":
            return True
    return False


class _Elements:
    """The open elements of a page, each with the place of what stands in it; every step costs the same at any depth."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.where: dict[str, list[int]] = {}

    @property
    def place(self) -> int:
        return self.stack[-1][1] if self.stack else OPEN

    def last(self, *names: str) -> int:
        """The position of the innermost open element of these names, or -1."""
        return max((at[-1] for n in names if (at := self.where.get(n))), default=-1)

    def push(self, name: str, place: int) -> None:
        self.where.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, place))

    def cut(self, at: int) -> None:
        """End the element at a position and all in it, and those around it whose own end tag came before."""
        while len(self.stack) > at or (self.stack and not self.stack[-1][0]):
            name, _ = self.stack.pop()
            if name:
                self.where[name].pop()

    def end_early(self, name: str) -> None:
        """An end tag of an inline element or a form: what is still open in it stays open, outside of it."""
        at = self.where[name].pop()
        inner, outer = self.stack[at][1], self.stack[at - 1][1] if at else OPEN
        self.stack[at] = ("", outer)
        if inner != outer:
            self.stack[at:] = [(n, outer if p == inner else p) for n, p in self.stack[at:]]
        self.cut(len(self.stack))

    def before(self, name: str) -> None:
        """End what a start tag ends."""
        if name in _BLOCKS and (at := self.last("svg", "annotation")) > self.last("foreignobject"):
            self.cut(at)
        if name in _TABLE_PARTS:
            stop = self.last("table", *_SILENT)
            open_parts = [at for part in _TABLE_PARTS[name] if (at := self.last(part)) > stop]
            if open_parts:
                self.cut(min(open_parts))
            return
        own = ("dt", "dd") if name in ("dt", "dd") else (name,) if name == "li" else ()
        if own and (at := self.last(*own)) > self.last(*_STOPS[name]):
            self.cut(at)
        if name in _END_P and (at := self.last("p")) > self.last(*_STOPS["p"]):
            self.cut(at)

    def end(self, name: str) -> None:
        """End what an end tag ends: not a thing outside the cell or table that it stands in."""
        at = self.last(name)
        if at < 0:
            return
        if name == "form" or name not in _FOLLOWED:
            self.end_early(name)
        elif name == "table" or at >= self.last("table", *(() if name in _TABLE_PARTS else _CELLS)):
            self.cut(at)


def _inside(name: str, attrs: str, place: int, in_article: bool) -> int:
    """The place of what stands in an element that stands in a place."""
    if place == _UNSHOWN or name in _SILENT or name == "head":
        return _UNSHOWN
    if _is_furniture(name, attrs, in_article):
        return _ASIDE
    if name == "form":
        return _FORM if place != _ASIDE else _ASIDE
    if name == "article":
        return _AGAIN if place in (_ASIDE, _AGAIN) else ARTICLE
    if name == "main" and place != ARTICLE:
        return MAIN
    return place


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(place, text) of a page's blocks in order; place is -1 for furniture. Text is decoded, its white space single spaces.

    An element ends as in HTML: at its end tag, its parent's, or a start tag that can't stand in it.  An article
    in a form, and a main in any furniture, is what it is elsewhere; an article in other furniture is open text.
    A form is furniture unless it holds most of the page's open words.
    """
    out: list[tuple[int, str]] = []
    held: list[str] = []
    elements = _Elements()
    place, hidden = OPEN, False  # of the text that is held; whether text is left out

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((place, text))

    for text, end, name, attrs in tokens_of(page):
        if text:
            if hidden and elements.stack[-1][0] == "head" and not text.isspace():
                elements.cut(elements.last("head"))
                hidden = elements.place == _UNSHOWN
            if not hidden:
                held.append(text)
            continue
        if end:
            elements.end(name)
        else:
            if (head := elements.last("head")) >= 0 and (name == "body" or (head == len(elements.stack) - 1 and name not in _IN_HEAD)):
                elements.cut(head)
            if name in ("br", "td", "th"):
                held.append(" ")
            elements.before(name)
            if name not in _VOID and not attrs.endswith("/") and not (name == "form" and elements.last("form") >= 0):
                inner = _inside(name, attrs, elements.place, elements.last("article") >= 0)
                if name in _FOLLOWED or inner != elements.place or inner < OPEN:
                    elements.push(name, inner)
        now = elements.place
        hidden = now == _UNSHOWN
        if not hidden and (now != place or name in _BLOCKS):
            flush()
            place = now
    flush()
    if any(p < _ASIDE for p, _ in out):
        words = {k: sum(len(t.split()) for p, t in out if p in k) for k in ((_FORM,), (OPEN, _AGAIN))}
        told = {_AGAIN: OPEN, _FORM: OPEN if words[(_FORM,)] >= words[(OPEN, _AGAIN)] else _ASIDE}
        out = [(told.get(p, p), t) for p, t in out]
    return out


def token_numbers(host: int, words: list[str]) -> np.ndarray:
    """64-bit numbers of a host's words; equal words of different hosts differ. host: its number."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w, host) for w in words), np.uint64, len(words))


def suffix_groups(streams: list[np.ndarray], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of streams set one after the other, sorted as deep as run tokens, and each suffix's group.

    Suffixes that share their first run tokens are neighbours and have one group. Prefix doubling: ranks by h
    tokens give those by 2h.  A stream's end differs from everything, so that no match runs over it; suffixes
    of fewer than run tokens are left out.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    total = int(sizes.sum())
    flat = np.concatenate(streams) if total else np.zeros(0, np.uint64)
    rank = np.unique(flat, return_inverse=True)[1].astype(np.int64) + 1
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)  # tokens to the stream's end
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        later = np.zeros(total, np.int64)
        has = left > step
        later[has] = rank[np.flatnonzero(has) + step]
        rank = np.unique(rank * (total + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    full = np.flatnonzero(left >= run)
    order = full[np.argsort(rank[full], kind="stable")]
    return order, rank[order]


def suffix_keys(hosts: np.ndarray, flat: np.ndarray, at: np.ndarray, run: int = RUN) -> np.ndarray:
    """Sort keys, one row of bytes each: a host's number, then those of the run tokens of flat from a place."""
    number = lambda x, n: x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :n]
    tokens = number(flat, _TOKEN_BYTES)
    return np.hstack([number(hosts, _HOST_BYTES), *(tokens[at + k] for k in range(run))])


def _binary(keys: np.ndarray):
    """Rows of bytes as an Arrow array."""
    import pyarrow as pa

    n, width = keys.shape
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(keys))])


_SUFFIXES = "key binary, low long, high long, least long, most long, starts int, rows array<long>, places array<int>"
_NONE = (2**63 - 1, -(2**63))  # smallest and largest of no pages


def page_suffixes(pages: DataFrame, run: int = RUN) -> DataFrame:
    """The suffixes of run tokens or more of pages' furniture and open text, those of a batch that share run tokens as one row.

    pages: row, page, family, host (all long), words (array<string>), open (boolean).  key: host and run tokens;
    low to most: smallest and largest page and family; starts: 0; rows, places: where the suffixes of open pages begin.
    """

    def sort(batches):
        import pyarrow as pa

        for part in gathered(batches, 4_000_000):
            hosts = column(part, "host").to_numpy().view(np.uint64)
            words = column(part, "words")
            sizes = words.value_lengths().to_numpy()
            streams = [token_numbers(h, w) for h, w in zip(hosts.tolist(), words.to_pylist(), strict=True)]
            order, group = suffix_groups(streams, run)
            if not len(order):
                continue
            begin = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(streams)), sizes)[order]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            kept = np.array(column(part, "open"))[owner]
            offsets = np.append(np.concatenate([[0], np.cumsum(kept)])[first], kept.sum()).astype(np.int32)
            rows, places = column(part, "row").to_numpy()[owner[kept]], (order - begin[owner])[kept].astype(np.int32)
            ends = [f.reduceat(column(part, c).to_numpy()[owner], first) for c in ("page", "family") for f in (np.minimum, np.maximum)]
            arrays = [
                _binary(suffix_keys(hosts[owner[first]], np.concatenate(streams), order[first], run)), *map(pa.array, ends), pa.array(np.zeros(len(first), np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(rows)), pa.ListArray.from_arrays(offsets, pa.array(places)),
            ]
            yield from pa.table(arrays, names=["key", "low", "high", "least", "most", "starts", "rows", "places"]).to_batches(max_chunksize=20_000)

    return pages.select("row", "page", "family", "host", "words", "open").mapInArrow(sort, _SUFFIXES)


def block_suffixes(texts: DataFrame, run: int = RUN) -> DataFrame:
    """The suffixes of texts' blocks (lines) of run tokens or more, each from where its block begins, as page_suffixes gives its own.

    texts: row, host (long), text.  starts: the blocks; places: ~block of each.
    """

    def begin(batches):
        import pyarrow as pa

        for part in gathered(batches, 2_000_000):
            at, streams = [], []
            hosts = column(part, "host").to_numpy().view(np.uint64)
            for i, (host, text) in enumerate(zip(hosts.tolist(), column(part, "text").to_pylist(), strict=True)):
                own = [(k, words[:run]) for k, block in enumerate(text.split("\n")) if len(words := block.split(" ", run)) >= run]
                at += [(i, k) for k, _ in own]
                streams.append(token_numbers(host, [w for _, words in own for w in words]))
            if not at:
                continue
            owner, block = np.array(at).T
            keys = suffix_keys(hosts[owner], np.concatenate(streams), np.arange(len(at)) * run, run)
            _, first, group, n = np.unique(keys.view(f"V{keys.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
            order, offsets = np.argsort(group, kind="stable"), np.append(0, np.cumsum(n)).astype(np.int32)
            arrays = [
                _binary(keys[first]), *(pa.array(np.full(len(n), e)) for e in _NONE * 2), pa.array(n.astype(np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(column(part, "row").to_numpy()[owner[order]])), pa.ListArray.from_arrays(offsets, pa.array((~block[order]).astype(np.int32))),
            ]
            yield from pa.table(arrays, names=["key", "low", "high", "least", "most", "starts", "rows", "places"]).to_batches(max_chunksize=20_000)

    return texts.select("row", "host", "text").mapInArrow(begin, _SUFFIXES)


def suffix_array(suffixes: DataFrame) -> DataFrame:
    """One array of the suffixes of all pages, host after host: equal ones are neighbours, in one partition."""
    return suffixes.repartitionByRange("key").sortWithinPartitions("key")


def repeats(array: DataFrame) -> DataFrame:
    """row, place, n of the suffixes in a suffix array that repeat: neighbours share their tokens as deep as they are sorted.

    A place of 0 or more is that of a suffix of an open page that distinct pages share which are no copies; one below
    is ~block of an article's block, and n blocks, PAGES or more, begin like it.  A task holds the places of one
    repeat, 12 bytes each.
    """

    def scan(batches):
        import pyarrow as pa

        held, key, (low, high), (least, most), starts = [], None, _NONE, _NONE, 0

        def told():
            """The places of the neighbours held, if they are repeats of a kind."""
            for rows, places in held:
                wanted = ((places >= 0) & (low != high and least != most)) | ((places < 0) & (starts >= PAGES))
                if wanted.any():
                    yield rows[wanted], places[wanted], np.full(wanted.sum(), starts)

        for part in gathered(batches, 4_000_000):
            keys = column(part, "key")
            n = len(keys)
            flat = np.frombuffer(keys.buffers()[2], np.uint8)
            bounds = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + n + 1]
            flat = flat[bounds[0] : bounds[-1]].reshape(n, -1)
            first = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]).any(axis=1)))
            ends = [f.reduceat(column(part, c).to_numpy(), first) for c, f in (("low", np.minimum), ("high", np.maximum), ("least", np.minimum), ("most", np.maximum), ("starts", np.add))]
            offsets = np.concatenate([[0], np.cumsum(column(part, "rows").value_lengths().to_numpy())])
            rows, places = (column(part, c).flatten().to_numpy() for c in ("rows", "places"))
            out = []
            for i, (a, b, *found) in enumerate(zip(offsets[first].tolist(), offsets[np.append(first[1:], n)].tolist(), *(e.tolist() for e in ends), strict=True)):
                if i or key != flat[0].tobytes():
                    out += told()
                    held = []
                    low, high, least, most, starts = found
                else:
                    low, high, least, most, starts = min(low, found[0]), max(high, found[1]), min(least, found[2]), max(most, found[3]), starts + found[4]
                if b > a:
                    held.append((rows[a:b].copy(), places[a:b].copy()))
            key = flat[-1].tobytes()
            if out:
                yield from pa.table([np.concatenate(c) for c in zip(*out)], names=["row", "place", "n"]).to_batches(max_chunksize=100_000)
        for found in told():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["row", "place", "n"])

    return array.mapInArrow(scan, "row long, place int, n long")


def main_text(pages: DataFrame, run: int = RUN) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    pages: page_id, url, html; other columns are ignored.  A null or empty html, or one without main text, gives
    an empty text; null urls and those without a host share one host.  Rows that repeat a page_id are pages of their own,
    but count as one where repeats on distinct pages are looked for, as do pages whose texts link as
    op7_jaccard_join links documents.  Pages of any length are read as a whole; an empty table gives no rows.  It runs
    jobs, and stages what they find.
    """
    spark = pages.sparkSession

    def parse(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for part in gathered(batches, 4_000_000):
            texts, hosts, streams, opened = [], [], [], []
            for url, page in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                blocks = blocks_of(page or "")
                best = max((p for p, _ in blocks), default=OPEN)
                texts.append("\n".join(t for p, t in blocks if p == best) if best > OPEN else None)
                try:
                    host = (urlsplit(url or "").hostname or "").lower()
                except ValueError:
                    host = ""
                hosts.append(xxhash.xxh3_64_intdigest(host))
                words, own = [], []
                for p, t in blocks:
                    if p <= OPEN:
                        at = len(words)
                        words += t.split()
                        if p == OPEN and best <= OPEN:
                            own.append({"at": at, "end": len(words)})
                streams.append(words)
                opened.append(own)
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)), column(part, "page_id"), column(part, "url"), pa.array(np.array(hosts, np.uint64).view(np.int64)), pa.array(texts, pa.string()),
                    pa.array(streams, pa.list_(pa.string())), pa.array(opened, pa.list_(pa.struct([("at", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["row", "page_id", "url", "host", "text", "words", "opened"],
            )
            row += n

    def uncovered(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for opened, words, places in zip(*(batch.column(c).to_pylist() for c in ("opened", "words", "places")), strict=True):
                hit, kept = np.sort(np.array(places or [], np.int64)), []
                for b in opened:
                    lo, hi = b["at"], b["end"]
                    if _covered(hit, run, lo, hi).all():
                        continue
                    own = _covered(hit[(hit >= lo) & (hit + run <= hi)], run, lo, hi)
                    kept.append(" ".join(w for w, gone in zip(words[lo:hi], own.tolist(), strict=True) if not gone))
                texts.append("\n".join(t for t in kept if t))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    made = source.mapInArrow(parse, "row long, page_id long, url string, host long, text string, words array<string>, opened array<struct<at: int, end: int>>")
    parsed = staged(spark, made, "parsed", compression="zstd")
    whole, open_pages = parsed.filter("text is not null"), parsed.filter("text is null")
    page = F.coalesce("page_id", -1 - F.col("row")).alias("page")
    if open_pages.isEmpty():
        numbered = parsed.withColumn("family", F.col("row"))
    else:
        body = F.concat_ws(" ", F.flatten(F.transform("opened", lambda b: F.slice("words", b["at"] + 1, b["end"] - b["at"])))).alias("text")
        numbered = _families(parsed, open_pages.select(F.col("row").alias("doc_id"), body))
    streams = page_suffixes(numbered.filter(F.size("words") >= run).select("row", page, "family", "host", "words", F.col("text").isNull().alias("open")), run)
    found = staged(spark, repeats(suffix_array(streams.unionByName(block_suffixes(whole, run)))), "repeats")
    covered = found.filter("place >= 0").groupBy("row").agg(F.collect_list("place").alias("places"))
    rest = open_pages.join(covered, "row", "left").select("page_id", "url", "opened", "words", "places").mapInArrow(uncovered, "page_id long, url string, text string")
    told = whole.join(_notices(whole.select("row", page, "host", "text"), parsed.groupBy("host").agg(F.count("*").alias("pages")), found), "row", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone", i)), "\n")
    told = told.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept))
    return told.select("page_id", "url", "text").unionByName(rest).withColumn("n_chars", F.char_length("text").cast("long"))


def _notices(whole: DataFrame, on_hosts: DataFrame, found: DataFrame) -> DataFrame:
    """row, gone: the blocks of whole texts that stand, as a whole, on PAGES pages of a host or more and on most of all.

    whole: row, page, host, text; found: what repeats gives.  Only pages with a block that begins like those
    of so many rows are compared, to count copies once; most of a host's pages are those of all, copies included.
    """
    begun = found.filter("place < 0").join(whole.select("row", "host"), "row").join(on_hosts, "host").filter("2 * n > pages")
    begun = staged(whole.sparkSession, begun.select("row", (-1 - F.col("place")).alias("block"), "pages"), "begun")
    if begun.isEmpty():
        return begun.select("row", F.array("block").alias("gone"))
    maybe = whole.join(begun.select("row").distinct(), "row", "left_semi")
    maybe = _families(maybe, maybe.select(F.col("row").alias("doc_id"), "text"))
    blocks = maybe.select("row", "page", "host", "family", F.posexplode(F.split("text", "\n")).alias("block", "t")).withColumn("t", F.sha2("t", 256)).join(begun, ["row", "block"])
    ranks = blocks.groupBy("host", "t", "pages").agg(F.least(F.countDistinct("page"), F.countDistinct("family")).alias("n"))
    blocks = blocks.join(ranks.filter((F.col("n") >= PAGES) & (2 * F.col("n") > F.col("pages"))).select("host", "t"), ["host", "t"], "left_semi")
    return staged(whole.sparkSession, blocks.groupBy("row").agg(F.collect_set("block").alias("gone")), "notices")


def _families(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows and their family: the row of the first of the texts that links reach, else their own."""
    linked = similar_components(texts).filter("component_id <> doc_id").select(F.col("doc_id").alias("row"), "component_id")
    return rows.join(staged(rows.sparkSession, linked, "copies"), "row", "left").withColumn("family", F.coalesce("component_id", "row"))


def _covered(starts: np.ndarray, run: int, lo: int, hi: int) -> np.ndarray:
    """Which of the tokens lo to hi lie in a substring of run tokens from one of starts."""
    edges = np.zeros(hi - lo + 1, np.int64)
    near = starts[(starts < hi) & (starts + run > lo)]
    np.add.at(edges, np.maximum(near - lo, 0), 1)
    np.add.at(edges, np.minimum(near + run - lo, hi - lo), -1)
    return np.cumsum(edges)[:-1] > 0


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    prepare(spark)
    return main_text(table(spark, sf_dir, "pages"))
