"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host and URL path, and each is paired with the nearer of
its two neighbours: the one whose path agrees with its own for longer. The text
lines of both (a line for each block element) are aligned by longest common
subsequence, and the lines that they share are deleted as the site's furniture.
A line inside an element that names itself as furniture (menu, footer, advert,
form, reader comment ...) is compared by its place in the page, since such lines
often differ in words alone; with no counterpart next door it goes too. If a
neighbour shares more than half of an article element's text, both are one
article under two URLs, and its lines stay.

Reading a page takes time in proportion to its length, whatever is in it.
"""

from __future__ import annotations

import html as references
import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numera.llm.common import checkpoint, row_keys

#: What may begin at a <: a comment, a declaration, or a tag with its name.
_MARK = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
#: The rest of a tag, quoted values whole; the quantifier gives nothing back.
_REST = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")
_RAW = frozenset("script style noscript template svg math iframe object textarea select title".split())
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.IGNORECASE)

# HTML's elements by kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot"
    " th thead tr ul".split()
)
_FURNITURE = frozenset("nav footer aside form head button dialog menu search".split())
_ARTICLE = frozenset("article main".split())
_CLOSED_BY_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HAS_ITEMS = frozenset("ul ol dl table select menu dir".split())
# Words in class, id or role that name furniture.
_FURNITURE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist complementary"
    " consent contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation navigation newsletter notice notification"
    " pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup social sponsor sponsored"
    " subscribe subscription toolbar widget".split()
)
# Words before them that tell a place.
_PLACES = frozenset("bottom global left main page primary right secondary site top".split())


class Line:
    """A block's text, whether it is in an article or in furniture, and the key it is aligned by."""

    __slots__ = ("text", "article", "furniture", "key")

    def __init__(self, text: str, article: bool, furniture: bool, path: int) -> None:
        self.text, self.article, self.furniture = text, article, furniture
        self.key = (path if furniture else xxhash.xxh3_64_intdigest(text)) - (1 << 63)


def _names_furniture(name: str) -> bool:
    """A class, id or role of furniture words only, or with where they are before them: cookie-notice, site-footer, ad-2."""
    parts = [w for w in re.split(r"[^a-z]+", name.lower()) if w]
    return bool(parts) and parts[-1] in _FURNITURE_WORDS and all(w in _FURNITURE_WORDS or w in _PLACES for w in parts)


def _is_furniture(tag: str, attributes: str, in_article: bool, by_name: bool = True) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether by its name alone."""
    if tag in _FURNITURE or tag == "header" and not in_article:
        return True, False
    if not attributes.strip() or tag in ("html", "body"):
        return False, False
    named = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" and value.strip().lower() != "false" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _HIDING.search(value):
            return True, False
        named = named or name in ("class", "id", "role") and any(map(_names_furniture, value.split()))
    return named and by_name, named and by_name


def page_lines(html: str | None) -> list[Line]:
    """The page's lines of text, top to bottom.

    If all articles are in furniture, names don't count on elements that are or contain one.
    """
    around: set[int] = set()
    lines = _lines(html or "", frozenset(), around)
    if around and not any(x.article and not x.furniture for x in lines):
        return _lines(html or "", frozenset(around), set())
    return lines


def _tokens(html: str) -> Iterator[tuple[int, str | None, str, str]]:
    """(start, text, name, attributes): pieces of text, and tags without text, ends with a / before their name.

    Comments, declarations and elements of another language are left out. A
    tag that no > ends is text. If the quotes of a tag hide every > up to the
    page's end, quotes count no more from there on.
    """
    at, search, quotes = 0, 0, True
    while (start := html.find("<", search)) >= 0:
        m = _MARK.match(html, start)
        if not m:
            search = start + 1
            continue
        end = html.find("-->", m.end()) if m[1] else html.find(">", m.end())
        if end < 0 and not m[1]:
            break  # nothing ends a tag any more
        if m[1]:
            end = len(html) if end < 0 else end + 3
        elif m[2]:
            end += 1
        else:
            rest = _REST.match(html, m.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else end + 1
        if start > at:
            yield at, html[at:start], "", ""
        at = search = end
        if m[1] or m[2]:
            continue
        name, attributes = m[4].lower(), html[m.end() : end - 1]
        if name in _RAW:
            if not m[3]:
                close = _CLOSE[name].search(html, end)
                at = search = close.end() if close else len(html)
            continue
        yield start, None, m[3] + name, attributes
    if at < len(html):
        yield at, html[at:], "", ""


_CLOSE = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in _RAW}


class _Stack:
    """Open elements; each knows its place (a hash of the names above it), whether it is in an article or in
    furniture, and how many blocks are above it."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.states: list[tuple[bool, bool, int, int]] = [(False, False, 0, 0)]
        self.open: dict[str, list[int]] = {}
        self.lists: list[int] = []  # depths of elements that have items

    def push(self, tag: str, article: bool, furniture: bool) -> None:
        _, _, path, blocks = self.states[-1]
        self.open.setdefault(tag, []).append(len(self.tags))
        if tag in _HAS_ITEMS:
            self.lists.append(len(self.tags))
        self.tags.append(tag)
        self.states.append((article, furniture, hash_of(path, tag), blocks + (tag in _BLOCK)))

    def last(self, tags: tuple[str, ...], within: int = 0) -> int:
        """Depth of the innermost open element of these names, -1 without one from depth ``within`` on."""
        depth = max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)
        return depth if depth >= within else -1

    def blocks_from(self, depth: int) -> bool:
        return self.states[-1][3] > self.states[depth][3]

    def cut(self, depth: int) -> None:
        """Close the element at ``depth`` and all inside it."""
        while len(self.tags) > depth:
            self.open[self.tags.pop()].pop()
            self.states.pop()
        while self.lists and self.lists[-1] >= depth:
            self.lists.pop()


def hash_of(path: int, tag: str) -> int:
    return xxhash.xxh3_64_intdigest(tag, path)


def _lines(html: str, unnamed: frozenset[int], around: set[int]) -> list[Line]:
    """The lines, without names on elements that begin at ``unnamed``; adds where those begin
    that are furniture by name alone and are or contain an article to ``around``."""
    lines: list[Line] = []
    stack = _Stack()
    text: list[tuple[str, bool]] = []
    named: list[tuple[int, int]] = []  # depth and start of open elements that are furniture by name

    def flush() -> None:
        """End the block: furniture inside a line of its own text is left out of it."""
        if not text:
            return
        own = [t for t, furniture in text if not furniture]
        if not "".join(own).strip():
            own = [t for t, _ in text]
        joined = " ".join(references.unescape("".join(own)).split())
        furniture = all(f for t, f in text if t.strip())
        text.clear()
        if joined:
            lines.append(Line(joined, stack.states[-1][0], furniture, stack.states[-1][2]))

    def close(tags: tuple[str, ...], within: int = 0) -> None:
        depth = stack.last(tags, within)
        if depth >= 0:
            if stack.blocks_from(depth):
                flush()
            stack.cut(depth)

    for start, piece, tag, attributes in _tokens(html):
        if piece is not None:
            text.append((piece, stack.states[-1][1]))
        elif tag == "br" or tag == "/br":
            text.append(("\n", stack.states[-1][1]))
        elif tag[0] == "/":
            if tag[1:] in _BLOCK:
                flush()
            close((tag[1:],))
        else:
            if tag in _BLOCK:
                flush()
            if tag in _VOID or attributes.rstrip().endswith("/"):
                continue
            if tag in _BLOCK and tag not in ("html", "head", "body"):
                close(("p",))
            if tag in _CLOSED_BY_SIBLING:
                close(_CLOSED_BY_SIBLING[tag], stack.lists[-1] + 1 if stack.lists else 0)
            if tag == "body":
                close(("head",))
            article, furniture = stack.states[-1][:2]
            own, by_name = _is_furniture(tag, attributes, article, start not in unnamed)
            while named and named[-1][0] >= len(stack.tags):
                named.pop()
            if by_name:
                named.append((len(stack.tags), start))
            if tag in _ARTICLE and named:
                around.update(at for _, at in named)
                named.clear()
            stack.push(tag, article or tag in _ARTICLE, furniture or own)
    flush()
    return lines


#: Pairs of equal lines from which on a subsequence is found by halves.
_MOST_PAIRS = 2_000_000


def common_subsequence(a: list[int], b: list[int]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    shared = {*range(head), *range(len(a) - tail, len(a))}
    where: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)
    if sum(len(where.get(x, ())) for x in a[head : len(a) - tail]) > _MOST_PAIRS:
        return shared | {head + i for i in _by_halves(a[head : len(a) - tail], b[head : len(b) - tail])}
    ends: list[int] = []
    chains: list[tuple[int, tuple | None]] = []
    for i in range(head, len(a) - tail):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            else:
                ends[k], chains[k] = j, link
    link = chains[-1] if chains else None
    while link:
        shared.add(link[0])
        link = link[1]
    return shared


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and each beginning of ``b``, a bit a place."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    v = every
    for x in a:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & every
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _by_halves(a: list[int], b: list[int]) -> set[int]:
    """``common_subsequence`` in little memory: where the halves of ``a`` meet best in ``b``, again and again."""
    if not a or not b:
        return set()
    if len(a) == 1:
        return {0} if a[0] in b else set()
    half = len(a) // 2
    j = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
    return _by_halves(a[:half], b[:j]) | {half + i for i in _by_halves(a[half:], b[j:])}


def _runs(keys: list[int]) -> list[int]:
    """Start of each run of equal keys: a menu's lines count as one."""
    return [i for i, k in enumerate(keys) if not i or keys[i - 1] != k]


def main_text(lines: list[Line], neighbour: list[int] | None) -> str:
    """What is left of the page: without furniture and the lines that it shares with its neighbour (whose
    line keys are given, run by run); an article stays whole if the neighbour has more than half of it."""
    starts = _runs([x.key for x in lines])
    shared = common_subsequence([lines[i].key for i in starts], neighbour or [])
    number, run = -1, set(starts)
    own: list[tuple[Line, bool]] = []
    for i, x in enumerate(lines):
        number += i in run
        if not x.furniture:
            own.append((x, number in shared))
    sizes = [(len(x.text), met) for x, met in own if x.article]
    recurs = 2 * sum(n for n, met in sizes if met) > sum(n for n, _ in sizes)
    return "\n".join(x.text for x, met in own if not met or x.article and recurs)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for value in batch.column("html"):
            keys = [x.key for x in page_lines(value.as_py())]
            packed.append(np.array([keys[i] for i in _runs(keys)], np.int64).tobytes())
        yield batch.drop_columns(["html"]).append_column("keys", pa.array(packed, pa.binary()))


_EDGE = pa.schema([("part", pa.int32()), ("first_host", pa.string()), ("first_path", pa.string()), ("first_keys", pa.binary()), ("last_host", pa.string()), ("last_path", pa.string()), ("last_keys", pa.binary())])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last row of a sorted partition."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            row = lambda i, b=batch: tuple(b.column(c)[i].as_py() for c in ("host", "path", "keys"))
            first, last = first or row(0), row(batch.num_rows - 1)
    if first:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((TaskContext.get().partitionId(), *first, *last), _EDGE.types)], schema=_EDGE)


def agreement(a: str, b: str) -> tuple[int, int]:
    """How far two URL paths agree: whole segments, then characters."""
    n = len(os.path.commonprefix([a, b]))
    return a.count("/", 0, n) + (n == len(a) == len(b)), n


def _paired(ends: list[tuple]):
    """Each row with the keys of the nearer of its neighbours in the host, the one before it if both are as near."""

    def nearest(before: tuple | None, own: tuple, after: tuple | None) -> bytes | None:
        near = [x for x in (before, after) if x is not None and x[0] == own[0] and own[0] is not None]
        return max(near, key=lambda x: agreement(x[1], own[1]))[2] if near else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = max((e for e in ends if e[0] < part), default=None)
        after = min((e for e in ends if e[0] > part), default=None)
        previous, held = before[4:7] if before else None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "keys", "k1", "k2"))):
                if held:
                    out.append((held[3], held[4], nearest(previous, held, row)))
                    previous = held
                held = row
            yield _pair_batch(out)
        if held:
            yield _pair_batch([(held[3], held[4], nearest(previous, held, after[1:4] if after else None))])

    return run


def _pair_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["k1", "k2", "near"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, near in zip(batch.column("html"), batch.column("near")):
            packed = near.as_py()
            texts.append(main_text(page_lines(html.as_py()), np.frombuffer(packed, np.int64).tolist() if packed else None))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html).

    A null html counts as empty and has an empty text. A null url belongs to
    the empty host. A page alone on its host has no neighbour and loses its
    furniture only. Rows that are equal in id, url and html count once as
    neighbours and get one result each; of pages with one URL each is the
    other's neighbour. An empty table gives an empty result; other columns are
    not looked at.

    Only line keys are sorted by host and path, in ranges that split a large
    host; two rows for each range reach the driver to pair pages across ranges.
    """
    k1, k2 = row_keys(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), k1.alias("k1"), k2.alias("k2"))
    own = rows.select(_host(F.col("url")).alias("host"), _path(F.col("url")).alias("path"), "k1", "k2", "html")
    keyed = own.mapInArrow(_keys, "host string, path string, k1 long, k2 long, keys binary").dropDuplicates(["k1", "k2"])
    ordered = checkpoint(checkpoint(keyed).repartitionByRange("host", "path", "k1", "k2").sortWithinPartitions("host", "path", "k1", "k2"))
    ends = [tuple(r) for r in ordered.mapInArrow(_ends, "part int, first_host string, first_path string, first_keys binary, last_host string, last_path string, last_keys binary").collect()]
    near = ordered.mapInArrow(_paired(ends), "k1 long, k2 long, near binary")
    # a hash table of keys spares sorting the pages
    return rows.join(near.hint("shuffle_hash"), ["k1", "k2"]).mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
