"""Main text of web pages: markup gives the blocks, a suffix array per host tells what its pages repeat.

A page is cut into text blocks in page order. Markup alone settles some:
scripts, styles, menus, footers, forms and what is named as an advert, a
notice or a comment is never text of the article, and what stands inside an
article element, outside of those, always is. Repetition must not touch the
latter: articles are copied whole and share passages, so a paragraph of an
article that occurs on other pages is still its text.

The runs of ``MIN_RUN`` tokens of all pages of a host are brought together by a
shuffle: a suffix array to that depth, of which each task holds some groups of
equal suffixes. A group with two distinct pages is a substring that the host
repeats, and the tokens that such substrings cover are counted for every page.
They are boilerplate on pages without an article element, which keep the runs of
tokens that nothing covers.

A host of any size is compared as a whole, and every page is. Runs are looked
for in two steps: first by anchors, of which some three runs share one; a run whose
anchor no other page has is on no other page. Those left are told apart by digests
of 96 bits between groups of pages, and of 64 bits in a group.

Defined results: a null or empty page has the empty text. A page without a
url belongs to a host without a name. Repeated rows are extracted each for
itself, and do not count as distinct pages if they share an id.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import ready, whole_text

# Tokens that a repeated substring has at least, and that a kept unique run has at least.
MIN_RUN, MIN_KEPT = 8, 5

NEVER, ARTICLE, OPEN = "0", "1", "2"

# Elements whose content is code, not text.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "object"}
LEFT_OUT = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select"}
BODY = {"article", "main"}
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr img".split()
)
NAMED = re.compile(
    r"(?:ads?|advert(?:s|isements?|ising)?|sponsor(?:s|ed)?|promo(?:tion)?s?|banners?|side-?bars?|nav(?:bar|igation)?|menus?|"
    r"breadcrumbs?|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe|subscription|social|shar(?:e|ing)|related|recommended|"
    r"comments?|disqus|replies|respond|site-?footer|site-?header|footers?|popups?|modals?|overlay|pagination|pager|login|search|"
    r"legal|copyright|widgets?|toolbar|skip-?link)"
)
# What may stand beside such a name in one class or id; with any other word it names a layout or a subject.
NEUTRAL = re.compile(
    r"(?:site|page|main|global|top|bottom|left|right|primary|secondary|inner|outer|box|bar|list|items?|posts?|articles|stories|buttons?|"
    r"links?|icons?|section|block|area|zone|slot|unit|form|signup|container|wrap(?:per)?|panel|text|message|row|col|[0-9]*)"
)
_PARTS = re.compile(r"[^a-z0-9]+")


def _named(value: str) -> bool:
    """Whether one class or id, as a whole, is the name of something beside the text."""
    for token in value.split():
        if NAMED.fullmatch(token):
            return True
        parts = _PARTS.split(token)
        named = [bool(NAMED.fullmatch(part)) for part in parts]
        if any(named) and all(is_name or NEUTRAL.fullmatch(part) for is_name, part in zip(named, parts)):
            return True
    return False


_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _left_out(name: str, attributes: str, in_body: bool) -> int:
    """0: not left out, 1: by a class or id alone, 2: by the element, its role or since it is hidden."""
    by_name = 0
    if name in LEFT_OUT or (name == "header" and not in_body):
        return 2
    if not attributes or name in BODY or name in ("html", "body"):
        return 0
    for attribute in _ATTRIBUTE.finditer(attributes):
        key, value = attribute[1].lower(), (attribute[2] or attribute[3] or attribute[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return 2
        # The id of a heading says what it is about.
        if (key == "class" or (key == "id" and not re.fullmatch("h[1-6]", name))) and _named(value):
            by_name = 1
        if key == "role" and value in ("navigation", "banner", "contentinfo", "search", "complementary", "form", "alert", "dialog"):
            return 2
    return by_name


def blocks_of(page: str) -> list[tuple[str, str]]:
    """Kind and text of every block with text, in page order."""
    found: list[tuple[str, str]] = []
    parts: list[str] = []
    # Open elements: name, how left out, whether in an article body. The counts save a search of the stack.
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    open_names: Counter = Counter()

    def end_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                _, left_out, in_body = stack[-1]
                found.append((NEVER if left_out else ARTICLE if in_body else OPEN, text))

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        begin = page.find("<", at)
        if begin < 0 or begin > last:
            parts.append(html.unescape(page[at:]))
            break
        if begin > at:
            parts.append(html.unescape(page[at:begin]))
        following = page[begin + 1 : begin + 2]
        if page.startswith("<!--", begin):
            close = page.find("-->", begin + 4)
            at = end if close < 0 else close + 3
            continue
        if following in ("!", "?"):
            at = page.find(">", begin) + 1
            continue
        if not (following.isalpha() or (following == "/" and page[begin + 2 : begin + 3].isalpha())):
            parts.append("<")
            at = begin + 1
            continue
        tag = _TAG.match(page, begin)
        if tag:
            closing, name, attributes, at = tag[1], tag[2].lower(), tag[3], tag.end()
        else:
            # A quote that is never closed: the tag ends at the next bracket.
            at = page.find(">", begin) + 1
            named = re.match(r"</?([a-zA-Z][^\s/>\"']*)", page[begin:begin + 64])
            closing, name, attributes = "/" * (following == "/"), named[1].lower() if named else "", ""
        if name not in INLINE:
            end_block()
        if closing:
            if open_names[name]:
                while True:
                    popped = stack.pop()[0]
                    open_names[popped] -= 1
                    if popped == name:
                        break
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at) if not attributes.endswith("/") else None
            at = close.end() if close else at if attributes.endswith("/") else end
            continue
        if name in EMPTY or attributes.endswith("/"):
            continue
        _, left_out, in_body = stack[-1]
        if left_out == 1 and name in BODY and not in_body:
            # A class around the body names the layout.
            left_out = 0
        stack.append((name, max(left_out, _left_out(name, attributes, in_body)), in_body or name in BODY))
        open_names[name] += 1
    end_block()
    return found


def covered(streams: list[np.ndarray], owners: list, min_run: int = MIN_RUN) -> list[np.ndarray]:
    """Per stream of token numbers, which tokens lie in a substring that occurs on another owner's page too.

    The suffix array of a few pages in memory; :func:`extract` finds the same for all hosts.
    """
    bounds = np.cumsum([0, *[len(s) + 1 for s in streams]])
    most = max((int(s.max()) for s in streams if len(s)), default=0) + 1
    # Every page ends in a token of its own, which no substring can cross.
    text = np.concatenate([np.append(s, most + i) for i, s in enumerate(streams)]) if streams else np.empty(0, np.int64)
    page = np.repeat(np.unique(np.array([str(o) for o in owners]), return_inverse=True)[1], np.diff(bounds)) if streams else text
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    depth = 1
    while depth < min_run:
        # Ranks by the first 2 * depth tokens, from the ranks of both halves; past the end comes nothing.
        step = min(depth, min_run - depth)
        follower = np.concatenate([rank[step:] + 1, np.zeros(min(step, n), dtype=rank.dtype)])[:n]
        _, rank = np.unique(rank.astype(np.int64) * (n + 2) + follower, return_inverse=True)
        depth += step
    suffixes = np.lexsort((page, rank))
    ordered = rank[suffixes]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if n else np.empty(0, int)
    pages = page[suffixes]
    ends = np.append(starts[1:], n) - 1
    # Suffixes of a group are sorted by page: more than one page if the first and last differ.
    shared = np.repeat(pages[starts] != pages[ends], np.diff(np.append(starts, n))) if n else np.empty(0, bool)
    marks = np.zeros(n + 1, dtype=np.int64)
    hit = suffixes[shared]
    np.add.at(marks, hit, 1)
    np.add.at(marks, np.minimum(hit + min_run, n), -1)
    inside = np.cumsum(marks[:-1]) > 0
    return [inside[bounds[i] : bounds[i + 1] - 1] for i in range(len(streams))]


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def main_text(blocks: list[tuple[str, list[str]]], repeated: np.ndarray) -> str:
    """What is kept of a page, given which tokens of its blocks are repeated on other pages."""
    has_article = any(kind == ARTICLE for kind, _ in blocks)
    kept, at = [], 0
    for kind, words in blocks:
        inside = repeated[at : at + len(words)]
        at += len(words)
        if kind == ARTICLE:
            kept.append(" ".join(words))
        elif kind == OPEN and not has_article:
            if not inside.any():
                kept.append(" ".join(words))
                continue
            removed = np.zeros(len(words), dtype=bool)
            for begin, end in _runs(inside):
                # The overhang of a repeat that begins or ends in another block is not one here.
                removed[begin:end] = end - begin >= min(MIN_RUN, len(words))
            runs = [" ".join(words[a:b]) for a, b in _runs(~removed) if b - a >= min(MIN_KEPT, len(words))]
            if runs:
                kept.append(" ".join(runs))
    return "\n".join(kept)


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


# ------------------------------------------------------------- what a host repeats

# Bytes of html that are compared in one group, and how many groups' values meet in one task.
GROUP_BYTES, GROUPS_MET = 4 << 20, 16
# Tokens of the piece by which a run of MIN_RUN tokens is first looked for, and bits of its digest.
ANCHOR, ANCHOR_BITS = 4, 40
# Bytes of text whose runs are made at once.
_BYTES_AT_ONCE = 1 << 20

_VALUES = pa.schema([("bucket", pa.int64()), ("part", pa.string()), ("tag", pa.string()), ("twice", pa.bool_()), ("found", pa.binary())])
_VALUES_TYPE = "bucket bigint, part string, tag string, twice boolean, found binary"


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


# A value for each byte, for each half of a digest; what separates tokens counts for nothing.
_BYTES = [_mixed(_mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(half << 32))) for half in (1, 2)]
for _values in _BYTES:
    _values[[10, 32]] = 0


def _tokens(text: bytes) -> list[np.ndarray]:
    """Both halves of a digest of every token of a text, each of which ends in a space or a line end."""
    data = np.frombuffer(text, dtype=np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.append(0, ends[:-1] + 1)
    sizes = ends - starts + 1
    places = np.arange(len(data)) - np.repeat(starts, sizes)
    # Odd, so that no byte's value is lost.
    weights = _mixed(_mixed(np.arange(1, int(sizes.max()) + 1, dtype=np.uint64))) | np.uint64(1)
    weights = weights[places]
    return [_mixed(np.add.reduceat(values[data] * weights, starts)) for values in _BYTES]


def _rolled(tokens: np.ndarray, width: int) -> np.ndarray:
    """A value for every ``width`` tokens in a row."""
    rolled = np.zeros(max(len(tokens) - width + 1, 0), dtype=np.uint64)
    for at in range(width):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + tokens[at : at + len(rolled)]
    return rolled


class _Windows:
    """The runs of :data:`MIN_RUN` tokens of some pages, by number: ``begins``, ``owners``, ``anchors`` and 96-bit ``digests``.

    An anchor is the least digest of the :data:`ANCHOR` tokens long pieces of a run. Equal runs
    have equal anchors, and neighbouring runs mostly share theirs.
    """

    def __init__(self, texts: list[bytes], hosts: list[str], owners: np.ndarray):
        lengths = np.array([text.count(b" ") + text.count(b"\n") + 1 if text else 0 for text in texts], dtype=np.int64)
        self.ends = np.cumsum(lengths)
        spans = np.maximum(lengths - MIN_RUN + 1, 0)
        first = np.concatenate([[0], np.cumsum(spans)])
        self.begins = np.repeat(self.ends - lengths - first[:-1], spans) + np.arange(first[-1])
        self.owners = np.repeat(owners, spans)
        if not len(self.begins):
            self.anchors, self.digests = np.empty(0, np.uint64), [np.empty(0, np.uint64)] * 2
            return
        halves = _tokens(b"\n".join([*filter(None, texts), b""]))
        salts = np.array([xxhash.xxh3_64_intdigest(host) for host in hosts], dtype=np.uint64)
        salt = np.repeat(salts, spans)
        self.digests = [_mixed(_rolled(half, MIN_RUN)[self.begins] + salt) for half in halves]
        self.digests[1] >>= np.uint64(32)
        pieces = _rolled(halves[0], ANCHOR)
        pieces = _mixed(pieces + np.repeat(salts, lengths)[: len(pieces)])
        least = pieces[self.begins]
        for at in range(1, MIN_RUN - ANCHOR + 1):
            np.minimum(least, pieces[self.begins + at], out=least)
        self.anchors = _mixed(least) >> np.uint64(64 - ANCHOR_BITS)


def _distinct(columns: list[np.ndarray], owners: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct values, sorted, and which of them have two owners."""
    order = np.lexsort((owners, *columns[::-1]))
    ordered, owners = [column[order] for column in columns], owners[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([column[1:] != column[:-1] for column in ordered], axis=0)
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(order)) - 1
    return [column[starts] for column in ordered], owners[starts] != owners[last]


def _holds(known: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Which values are among the known ones, which are sorted."""
    first, last = (np.searchsorted(known[0], columns[0], side=side) for side in ("left", "right"))
    held = np.zeros(len(first), dtype=bool)
    # Hardly ever more than one step: known values that begin alike.
    for step in range(int((last - first).max(initial=0))):
        at = np.flatnonzero(first + step < last)
        held[at] |= np.all([k[first[at] + step] == c[at] for k, c in zip(known, columns)], axis=0)
    return held


def _packed(columns: list[np.ndarray]) -> bytes:
    """Sorted values in few bytes: differences, byte by byte, so that the shuffle's compression finds the empty ones."""
    steps = np.diff(columns[0], prepend=np.uint64(0))
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in (steps, *columns[1:]))


def _unpacked(packed: bytes, width: int) -> list[np.ndarray]:
    flat = np.frombuffer(packed, dtype=np.uint8).reshape(width, 8, -1)
    columns = [np.ascontiguousarray(part.T).reshape(-1).view(np.uint64) for part in flat]
    return [np.cumsum(columns[0], dtype=np.uint64), *columns[1:]]


def _pages(rows: pa.Table) -> Iterator[tuple[pa.Table, list[str], list[bytes], _Windows]]:
    """Some rows of a group at a time: the kinds of their blocks, their text, a line per block, and their runs."""
    pages = [zlib.decompress(packed).split(b"\n", 1) for packed in rows["blocks"].to_pylist()]
    kinds, texts = [page[0].decode() for page in pages], [page[1] for page in pages]
    hosts = [host_of(url) for url in rows["url"].to_pylist()]
    owners = pd.factorize(np.array(rows["owner"].to_pylist(), dtype=object))[0]
    cuts = np.cumsum([len(text) for text in texts]) // _BYTES_AT_ONCE
    for cut in np.unique(cuts):
        begin, end = np.searchsorted(cuts, [cut, cut + 1])
        yield rows.slice(begin, end - begin), kinds[begin:end], texts[begin:end], _Windows(texts[begin:end], hosts[begin:end], owners[begin:end])


def _returned(values: pa.Table) -> np.ndarray:
    """What came back to a group, sorted."""
    return np.sort(np.concatenate([np.empty(0, np.uint64), *(_unpacked(packed, 1)[0] for packed in values["found"].to_pylist())]))


def _sent(rows: pa.Table, found: list[tuple[list[np.ndarray], np.ndarray]], bits: int, buckets: int) -> pa.Table:
    """A group's distinct values, and apart those that two owners in it have, by the range in which they meet those of other groups."""
    if not any(len(owners) for _, owners in found):
        return _VALUES.empty_table()
    values, twice = _distinct([np.concatenate(column) for column in zip(*(columns for columns, _ in found))], np.concatenate([owners for _, owners in found]))
    part = rows["part"][0].as_py()
    tag = rows["crowd"][0].as_py() or part
    sent = []
    for is_twice in (False, True):
        columns = [column[twice == is_twice] for column in values]
        place = (columns[0] >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)
        edges = np.searchsorted(place, np.arange(buckets + 1, dtype=np.uint64))
        for i in np.flatnonzero(np.diff(edges)).tolist():
            sent.append((i, part, tag, is_twice, _packed([column[edges[i] : edges[i + 1]] for column in columns])))
    return pa.table([list(column) for column in zip(*sent)], schema=_VALUES)


def _repeated(values: DataFrame, width: int) -> DataFrame:
    """Of the values that groups sent, the first 64 bits of those that two owners have."""

    def meet(rows: pa.Table) -> pa.Table:
        unpacked = [_unpacked(packed, width) for packed in rows["found"].to_pylist()]
        tags = pd.factorize(np.array(rows["tag"].to_pylist(), dtype=object))[0]
        # What two owners of a group have counts as if another group had it, too.
        counted = [(columns, tag) for columns, tag in zip(unpacked, tags)] + [
            (columns, -1) for columns, twice in zip(unpacked, rows["twice"].to_pylist()) if twice
        ]
        owners = np.repeat([tag for _, tag in counted], [len(columns[0]) for columns, _ in counted])
        columns, shared = _distinct([np.concatenate(column) for column in zip(*(columns for columns, _ in counted))], owners)
        shared = [column[shared] for column in columns]
        found = [own[0][_holds(shared, own)] for own in unpacked]
        back = rows.set_column(4, "found", pa.array([_packed([own]) for own in found], pa.binary()))
        return back.filter(pa.array([len(own) > 0 for own in found]))

    return values.groupBy("bucket").applyInArrow(meet, _VALUES_TYPE)


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, int]:
    """Per row: id, url, ``owner``, the group ``part``, and ``blocks``, packed: a line of their kinds, then a line per block.

    Rows of one id are in one part or, if they are too many, in parts that hold nothing else;
    these have it in ``crowd``. Also returns the number of parts.
    """
    ready(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), whole_text(html_col).alias("html")
    ).withColumn("owner", F.to_json(F.struct("id")))  # Pages are told apart by ids; a null id is one of them.
    size = F.sum(F.octet_length("html") + 1_000)
    parts = max(1, -(-(rows.agg(size).first()[0] or 0) // GROUP_BYTES))
    # Broadcast: at most one id for every group.
    crowds = F.broadcast(rows.groupBy("owner").agg(F.ceil(size / GROUP_BYTES).alias("pieces")).filter("pieces > 1"))
    piece = F.concat("owner", F.lit("/"), F.pmod(F.monotonically_increasing_id(), "pieces").cast("string"))
    number = F.pmod(F.xxhash64("owner"), F.lit(parts)).cast("string")
    dealt = rows.join(crowds, "owner", "left").select(
        "id", "url", "html", "owner", F.coalesce(piece, number).alias("part"), F.when(F.col("pieces") > 1, F.col("owner")).alias("crowd")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [blocks_of(page) for page in batch["html"]]
            lines = ("\n".join(["".join(kind for kind, _ in blocks), *(text for _, text in blocks)] if blocks else ["", ""]) for blocks in found)
            yield batch.drop(columns="html").assign(blocks=[zlib.compress(text.encode(), 6) for text in lines])

    kind = rows.schema["id"].dataType.simpleString()
    return dealt.mapInPandas(run, f"id {kind}, url string, owner string, part string, crowd string, blocks binary"), parts


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, ``text``, the main text, and ``n_repeated``, the tokens of all its blocks that the host repeats.

    Every page of every host is compared. The parsed pages are shuffled once, by their groups,
    and each step reads them from there.
    """
    rows, parts = parsed(pages, id_col, url_col, html_col)
    buckets = -(-parts // GROUPS_MET)
    grouped = rows.groupBy("part")

    def anchors(group: pa.Table) -> pa.Table:
        found = []
        for *_, runs in _pages(group):
            # Neighbours mostly have the same anchor.
            new = np.ones(len(runs.anchors), dtype=bool)
            new[1:] = (runs.anchors[1:] != runs.anchors[:-1]) | (runs.owners[1:] != runs.owners[:-1])
            found.append(([runs.anchors[new]], runs.owners[new]))
        return _sent(group, found, ANCHOR_BITS, buckets)

    def digests(group: pa.Table, back: pa.Table) -> pa.Table:
        common, found = [_returned(back)], []
        for *_, runs in _pages(group):
            asked = _holds(common, [runs.anchors])
            found.append(([half[asked] for half in runs.digests], runs.owners[asked]))
        return _sent(group, found, 64, buckets)

    def texts(group: pa.Table, back: pa.Table) -> pa.Table:
        shared, done = [_returned(back)], []
        for part, kinds, lines, runs in _pages(group):
            begins = runs.begins[_holds(shared, runs.digests[:1])]
            inside = np.zeros((int(runs.ends[-1]) if len(runs.ends) else 0) + 1, dtype=np.int64)
            np.add.at(inside, begins, 1)
            np.add.at(inside, begins + MIN_RUN, -1)
            marks = np.split(np.cumsum(inside)[:-1] > 0, runs.ends[:-1])
            blocks = [[(kind, line.split(" ")) for kind, line in zip(k, text.decode().split("\n"))] for k, text in zip(kinds, lines)]
            extracted = pa.array([main_text(page, own) for page, own in zip(blocks, marks)], pa.string())
            repeated = pa.array([int(own.sum()) for own in marks], pa.int64())
            done.append(part.select(["id", "url"]).append_column("text", extracted).append_column("n_repeated", repeated))
        return pa.concat_tables(done)

    common = _repeated(grouped.applyInArrow(anchors, _VALUES_TYPE), 1).groupBy("part")
    shared = _repeated(grouped.cogroup(common).applyInArrow(digests, _VALUES_TYPE), 2).groupBy("part")
    kind = rows.schema["id"].dataType.simpleString()
    done = grouped.cogroup(shared).applyInArrow(texts, f"id {kind}, url string, text string, n_repeated bigint")
    return done.withColumnsRenamed({"id": id_col, "url": url_col})
