"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

Pages are token streams of tags and texts. Within a page, runs of equally shaped groups fold into one repeated group.
The streams of a host's pages are aligned one after the other with the expression found so far: equal tokens stay,
different texts become text slots, and what only one side has becomes an optional group. Each text slot of the
expression then belongs to the page's frame (menus, headers, footers, sidebars, notices, adverts, forms, comments) or
to its content: what the elements of all pages together say of it; where they leave it open - a paragraph whose class
only sounds like a frame, a host without an article element - whether it varies from page to page, and how much text
its blocks hold. Every page is matched with the expression of its host, whole: the text of content slots is its main
text. A text that the expression doesn't know is judged by its own elements.

Wrappers are inferred from all pages of a host, and all pages are matched, very long ones whole. Null html is empty
and has no text; null urls and urls without a host share a wrapper. Repeated rows give repeated results; empty tables
give none; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import functools
import html
import pickle
import re
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, lean, map_slices, materialise, small_batches

#: Different pages after which a text that never varies is fixed; nodes that a task holds before it hands its
#: expressions on, whole; parts of a host's expressions that are aligned apart.
SURE, HELD, SALTS = 3, 200_000, 16
#: Bits that one alignment keeps at a time; it never shortens what is aligned.
ROWS_BITS = 1 << 27
#: Elements by role.
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FRAME = frozenset("head nav header footer aside form script style noscript iframe button select option textarea template svg canvas object dialog menu label fieldset title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTENT = frozenset(["article", "main"])
FRAME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget rail"
    " notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments"
    " reply replies respond discussion disqus pagination pager toolbar copyright legal".split()
)
CONTENT_NAMES = frozenset("article content post entry story main body text".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Elements that hold running text: of the names above, only these tell that such an element isn't content.
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption".split()) | INLINE
SURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr newsletter subscribe"
    " comment comments reply replies respond disqus footer sidebar share sharing social pagination pager".split()
)
#: Characters of a text, on average, from which blocks of little text on a page of many such blocks are running text.
PROSE = 30
SPACE = re.compile(r"[ \t\n\r\f\v ]+")
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|</?[A-Za-z][^<>]*(?:>|\Z)", re.DOTALL)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Token(NamedTuple):
    """``key``: what is compared. ``text``: of texts. ``frame``, ``content``: where a text lies by its elements; ``weak``:
    its names alone sound like a frame."""

    key: str
    text: str = ""
    frame: bool = False
    content: bool = False
    path: str = ""
    weak: bool = False


def _element(tag: str, name: str) -> tuple[str, bool, bool, bool]:
    """What an opening tag is compared by, and whether it opens a part of the frame, of the content, or perhaps of the
    frame."""
    if name == tag[1:-1]:
        return f"<{name}>", name in FRAME, name in CONTENT, False
    frame, content, weak, marks = name in FRAME, name in CONTENT, False, []
    for m in ATTRIBUTE.finditer(tag, 1 + len(name)):
        kind, value = m[1].lower(), next((g for g in m.groups()[1:] if g is not None), "")
        names = {w.lower() for w in WORDS.findall(value)}
        if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "role" and value in FRAME_ROLES:
            frame = True
        elif kind == "role" and value in ("main", "article") or kind == "itemprop" and value == "articleBody":
            content = True
        elif kind in ("class", "id") and name not in ("html", "body"):
            if name in TEXT_LEVEL and not names & SURE_NAMES:
                weak |= bool(names & FRAME_NAMES)
            else:
                frame |= bool(names & FRAME_NAMES) and name not in CONTENT
            content |= bool(names & CONTENT_NAMES)
            marks += sorted(value.lower().split()) if kind == "class" else []
    return f"<{name}.{'.'.join(marks)}>" if marks else f"<{name}>", frame, content and not frame, weak


OUTSIDE = ("", False, False, "", False)


def tokens(page: str) -> list[Token]:
    """The stream of a page. Texts know whether they lie in the frame or the content; unclosed elements end with the
    element around them."""
    out: list[Token] = []
    open_: list[tuple[str, bool, bool, str, bool]] = []  # name, in frame, in content, path of blocks, perhaps in frame
    at, n = 0, len(page)

    def add(raw: str) -> None:
        if raw and not raw.isspace():
            _, frame, content, path, weak = open_[-1] if open_ else OUTSIDE
            out.append(Token("#", raw, frame, content, path, weak))
        elif raw:
            out.append(Token(" ", " "))

    while at < n:
        m = MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[0]
        if tag[1] in "!?":
            if tag.startswith("<![CDATA["):
                add(tag[9:-3])
            continue
        name = NAME.match(tag)[1].lower()
        if tag[1] == "/":
            depth = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), -1)
            if depth >= 0 and not (name in INLINE and any(x[0] not in INLINE for x in open_[depth + 1 :])):
                del open_[depth:]
            out.append(Token(f"</{name}>"))
            continue
        key, frame, content, weak = _element(tag, name)
        if name in VOID or tag.endswith("/>"):
            out.append(Token(key))
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and name not in INLINE:
            depth = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] not in INLINE), -1)
            if depth >= 0 and open_[depth][0] == name:
                del open_[depth:]
        out.append(Token(key))
        above = open_[-1] if open_ else OUTSIDE
        path = above[3] if name in INLINE or name in ("p", "br", "li", "ul", "ol", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6") else above[3] + key
        if name in RAW:
            end = re.compile(f"</{name}\\b[^>]*>?", re.IGNORECASE).search(page, at)
            stop = end.start() if end else n
            if page[at:stop].strip():
                out.append(Token("#", page[at:stop], True, False, path))
            out.append(Token(f"</{name}>"))
            at = end.end() if end else n
            continue
        open_.append((name, above[1] or frame, above[2] or content, path, above[4] or weak))
    return out


# -- union-free expressions -----------------------------------------------------------------------------------------


class Slot:
    """A node of an expression: a token, or a group that is optional or repeated."""

    __slots__ = ("at", "constant", "content", "count", "frame", "items", "key", "mass", "match", "optional", "pages", "path", "repeated", "weak")

    def __init__(self, token: Token | None = None, items: list[Slot] | None = None, repeated: bool = False, optional: bool = False, page: int = 0, at: int = 0) -> None:
        self.key = token.key if token else "(" + " ".join(x.key for x in items) + ")" + "+" * repeated
        self.items, self.repeated, self.optional = items, repeated, optional
        self.constant = token.text if token and token.key == "#" else None
        self.frame, self.content, self.path, self.weak = (token.frame, token.content, token.path, token.weak) if token else (False, False, "", False)
        self.mass, self.count, self.pages = len(token.text) if token else 0, 1, frozenset([page])
        #: Nodes are aligned by ``match``: texts also by the blocks they lie in, and never across the edge of a frame.
        #: ``at``: positions in the page.
        self.match = (f"#{'!' * token.frame}{token.path}" if token.key == "#" else token.key) if token else "(" + " ".join(x.match for x in items) + ")" + "+" * repeated
        self.at = [at]


def fold(slots: list[Slot]) -> list[Slot]:
    """Runs of equally shaped neighbours, of one to eight nodes each, as repeated groups; the shortest first."""
    for width in range(1, 9):
        out, at = [], 0
        keys = [s.key for s in slots]
        if not any(map(str.__eq__, keys, keys[width:])):
            continue
        while at < len(slots):
            end = at + width
            if keys[at:end] == keys[end : end + width] and len(keys[at:end]) == width and any(k[0] in "<(" for k in keys[at:end]):
                group = slots[at:end]
                while keys[end : end + width] == keys[at : at + width]:
                    for own, other in zip(group, slots[end : end + width], strict=True):
                        _merge(own, other)
                    end += width
                out.append(group[0] if width == 1 and group[0].repeated else Slot(items=group, repeated=True))
                at = end
            else:
                out.append(slots[at])
                at += 1
        slots = out
    return slots


def _merge(own: Slot, other: Slot, across: bool = False) -> None:
    """``other`` into ``own``, of the same key: different texts make a text slot."""
    if own.items is not None:
        for a, b in zip(own.items, other.items, strict=True):
            _merge(a, b, across)
    if own.constant != other.constant:
        own.constant = None
    own.frame &= other.frame
    own.content |= other.content
    own.weak &= other.weak
    own.mass += other.mass
    own.count += other.count
    own.optional |= other.optional
    own.at += () if across else other.at
    if across and len(own.pages) < SURE:
        own.pages = frozenset(sorted(own.pages | other.pages)[:SURE])


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of positions: bit-parallel, a row of bits for each of ``b``; where the
    rows would take over ROWS_BITS, ``b`` is halved and ``a`` cut where the halves' lengths add up to the most."""
    start, n, m = 0, len(a), len(b)
    while start < n and start < m and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    out = [(k, k) for k in range(start)]
    if start < n and start < m:  # a key that one side hasn't got is in no common subsequence
        held = set(b[start:m])
        rows = [i for i in range(start, n) if a[i] in held]
        held = {a[i] for i in rows}
        columns = [j for j in range(start, m) if b[j] in held]
        if rows:
            out += [(rows[i], columns[j]) for i, j in _common([a[i] for i in rows], [b[j] for j in columns])]
    return out + [(n + k, m + k) for k in range(len(a) - n)]


def places_of(a: Sequence[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, key in enumerate(a):
        out.setdefault(key, []).append(i)
    return out


def embedded(a: Sequence[str], b: list[str], places: dict[str, list[int]]) -> list[tuple[int, int]]:
    """``common`` of both; where all of ``b`` lies in ``a`` in order, as a page does in its host's expression, without
    reading the rest of ``a``."""
    start, n, m = 0, len(a), len(b)
    while start < n and start < m and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    out, at = [(k, k) for k in range(start)], start
    for j in range(start, m):
        own = places.get(b[j], ())
        k = bisect.bisect_left(own, at)
        if k == len(own) or own[k] >= n:
            return common(a, b)
        out.append((own[k], j))
        at = own[k] + 1
    return out + [(n + k, m + k) for k in range(len(a) - n)]


def _rows(a: list[str], b: list[str], keep: bool) -> list[int]:
    """Bit i of the row of j is 0 where a[i] lengthens the common subsequence of a[:i] and b[:j + 1]."""
    where = places_of(a)
    few = len(where) * len(a) <= ROWS_BITS  # else only the places of frequent keys are kept as bits
    bits: dict[str, int] = {}
    full = (1 << len(a)) - 1
    row, out = full, []
    for key in b:
        own = bits.get(key)
        if own is None:
            places = where.get(key, ())
            own = _bits(places)
            if few or len(places) * 256 > len(a):
                bits[key] = own
        met = row & own
        row = (row + met | row - met) & full
        if keep:
            out.append(row)
    return out if keep else [row]


def _bits(places: Sequence[int]) -> int:
    if len(places) < 8:
        return functools.reduce(lambda x, i: x | 1 << i, places, 0)
    out = bytearray((places[-1] >> 3) + 1)
    for i in places:
        out[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(out, "little")


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """The length of the common subsequence of ``b`` and every prefix of ``a``."""
    bits, out = _rows(a, b, False)[0], [0]
    for bit in reversed(f"{bits:0{len(a)}b}"):
        out.append(out[-1] + (bit == "0"))
    return out


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    if len(a) * len(b) > ROWS_BITS and len(b) > 1:
        half = len(b) // 2
        left, right = _lengths(a, b[:half]), _lengths(a[::-1], b[half:][::-1])
        cut = max(range(len(a) + 1), key=lambda i: left[i] + right[len(a) - i])
        return common(a[:cut], b[:half]) + [(cut + i, half + j) for i, j in common(a[cut:], b[half:])]
    rows, i, j, out = _rows(a, b, True), len(a), len(b), []
    while j:
        i = (~rows[j - 1] & (1 << i) - 1).bit_length()  # the next that lengthens it
        if not i:
            break
        j -= 1
        if not j or rows[j - 1] >> i - 1 & 1:
            i -= 1
            out.append((i, j))
    return out[::-1]


def align(own: list[Slot], other: list[Slot]) -> list[Slot]:
    """The expression of both: a longest common subsequence stays, the rest becomes optional."""
    out, i, j = [], 0, 0
    for x, y in [*common([s.match for s in own], [s.match for s in other]), (len(own), len(other))]:
        for s in [*own[i:x], *other[j:y]]:
            s.optional = True
            out.append(s)
        if x < len(own):
            _merge(own[x], other[y], True)
            out.append(own[x])
        i, j = x + 1, y + 1
    return out


def stream(page: str, found: list[Token] | None = None) -> list[Slot]:
    page_id = zlib.crc32(page.encode("utf-8", "surrogatepass"))
    return fold([Slot(t, page=page_id, at=k) for k, t in enumerate(tokens(page) if found is None else found) if t.key != " "])


def infer(pages: list[str]) -> list[Slot]:
    """The expression of some pages, copies counted once."""
    out: list[Slot] = []
    for k, s in enumerate(sorted((stream(p) for p in dict.fromkeys(pages)), key=len)):
        out = align(out, s) if k else s
    return out


def leaves(slots: list[Slot]) -> Iterator[Slot]:
    for s in slots:
        if s.items is None:
            yield s
        else:
            yield from leaves(s.items)


class Wrapper(NamedTuple):
    """What matching needs. ``articles``: content elements were seen. ``keys``: the nodes of the expression.
    ``verdicts``: for every node, whether its texts, in order, are content. ``places``: the nodes of each key, where
    many pages are matched."""

    articles: bool
    keys: tuple[str, ...]
    verdicts: tuple[tuple[bool, ...], ...]
    places: dict[str, list[int]] | None = None


def wrapper(pages: list[str]) -> Wrapper:
    return decided(infer(pages))


def decided(slots: list[Slot]) -> Wrapper:
    """Which slots are content. Elements that are parts of frames hold none; a text that is the same on several pages and
    whose names sound like a frame is none. Else, where any slot lies in content elements, those that do. Where none
    does, slots that don't hold the same text on all of several pages, in the blocks that hold the most text or, where
    many blocks of one shape hold a little each, in those that hold running text."""
    texts = [s for s in leaves(slots) if s.key == "#" and not s.frame]
    articles = any(s.content for s in texts)
    mass: dict[str, int] = {}
    shapes: dict[str, list[int]] = {}
    for s in texts:
        varies = s.constant is None or len(s.pages) < SURE
        mass[s.path] = mass.get(s.path, 0) + s.mass * varies
        shape = shapes.setdefault(MARKS.sub("", s.path), [0, 0])
        shape[0], shape[1] = shape[0] + s.mass * varies, shape[1] + s.count * varies
    top, widest = max(mass.values(), default=0), max((m for m, _ in shapes.values()), default=0)

    def content(s: Slot, optional: bool) -> bool:
        fixed = s.constant is not None and len(s.pages) >= SURE and not optional
        if s.frame or fixed and s.weak:
            return False
        if articles:
            return s.content
        held, texts_ = shapes[MARKS.sub("", s.path)]
        return not fixed and mass[s.path] > 0 and (mass[s.path] >= top / 4 or held >= widest / 4 and held >= PROSE * texts_)

    verdicts = tuple(tuple(content(x, s.optional or x.optional) for x in leaves([s]) if x.key == "#") for s in slots)
    return Wrapper(articles, tuple(s.match for s in slots), verdicts)


#: The class words in a path of blocks.
MARKS = re.compile(r"\.[^>]*")


def matched(page: str, known: Wrapper, found: list[Token]) -> dict[int, bool]:
    """Verdicts on the texts of a page, by position, from its whole stream's match with the expression."""
    slots, out = stream(page, found), {}
    keys = [s.match for s in slots]
    for i, j in common(known.keys, keys) if known.places is None else embedded(known.keys, keys, known.places):
        for s, content in zip((x for x in leaves([slots[j]]) if x.key == "#"), known.verdicts[i], strict=True):
            out |= dict.fromkeys(s.at, content)
    return out


@functools.lru_cache(maxsize=4096)
def _ends_block(key: str) -> bool:
    return re.match(r"</?([^\s.>]+)", key)[1] not in INLINE


def extract(page: str | None, known: Wrapper | None = None) -> str:
    """The main text: content texts, character references decoded, blocks joined by one space."""
    if not page:
        return ""
    found = tokens(page)
    named = any(t.content and not t.frame and t.key == "#" for t in found)
    verdicts = matched(page, known, found) if known is not None else {}
    if not named and (known is None or known.articles and not any(v and not found[k].frame for k, v in verdicts.items())):
        verdicts = matched(page, wrapper([page]), found)
    blocks: list[str] = []
    parts: list[str] = []

    def end() -> None:
        if parts:
            block = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if block:
                blocks.append(block)
            parts.clear()

    for k, t in enumerate(found):
        if t.key == "#":
            # what no slot holds is judged by its elements; what they name content is, however its template was aligned
            if not t.frame and (t.content and not t.weak or verdicts.get(k, t.content or not named)):
                parts.append(t.text)
        elif t.key == " ":
            if parts:
                parts.append(" ")
        elif _ends_block(t.key):
            end()
    end()
    return " ".join(blocks)


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def wrappers(df: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper), from all pages of a host. Tasks align the pages they read and hand on expressions, which are
    aligned in turn: pages aren't moved, and of a hot host no more than some expressions a task are. Every node of every
    page is kept, however many they become."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Slot]] = {}
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for host, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own, new = known.get(host), stream(text)
                    known[host] = align(own, new) if own is not None else new
                    size += len(known[host]) - len(own or ())
                    if size > HELD:
                        yield _rows_of(known)
                        known, size = {}, 0
        yield _rows_of(known)

    def merge(rows: pa.Table) -> pa.Table:
        out: list[Slot] | None = None
        for x in sorted(rows.column("found").to_pylist()):
            new = pickle.loads(zlib.decompress(x))
            out = align(out, new) if out is not None else new
        return pa.Table.from_batches([_rows_of({rows.column("host")[0].as_py(): out})])

    def decide(part: dict[str, list]) -> dict[str, list]:
        return {"host": part["host"], "wrapper": [zlib.compress(pickle.dumps(tuple(decided(pickle.loads(zlib.decompress(x)))))) for x in part["found"]]}

    texts = small_batches(df).filter(F.col(page).isNotNull()).select(host_of(url).alias("host"), F.col(page).alias("html"))
    kind = "host string, found binary"
    found = materialise(texts.mapInArrow(lean(read), kind))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("found"), F.lit(SALTS))).groupBy("host", "salt").applyInArrow(merge, kind)
    merged = salted.groupBy("host").applyInArrow(merge, kind)
    return materialise(map_slices(merged, "host string, wrapper binary", decide, ["host", "found"], 16))


def _rows_of(known: dict[str, list[Slot]]) -> pa.RecordBatch:
    for slots in known.values():
        for s in leaves(slots):
            s.at = []
    packed = [zlib.compress(pickle.dumps(x), 1) for x in known.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array(packed, pa.binary())], names=["host", "found"])


def main_text(df: DataFrame, url: str = "url", page: str = "html", key: str = "page_id") -> DataFrame:
    """(key, url, text) for every row."""
    kinds = dict(df.dtypes)
    known = wrappers(df, url, page)
    rows = df.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(page).alias("html"), host_of(url).alias("host")).join(known, "host", "left")
    read: dict[bytes, Wrapper] = {}

    def work(part: dict[str, list]) -> dict[str, list]:
        texts = []
        for p, w in zip(part["html"], part["wrapper"], strict=True):
            if w is not None and w not in read:
                if len(read) > 10_000:
                    read.clear()
                got = Wrapper(*pickle.loads(zlib.decompress(w)))
                read[w] = got._replace(places=places_of(got.keys))
            texts.append(extract(p, read[w] if w is not None else None))
        return {key: part["k"], url: part["u"], "text": texts}

    return map_slices(rows, f"`{key}` {kinds[key]}, `{url}` string, text string", work, ["k", "u", "html", "wrapper"])
