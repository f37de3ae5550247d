"""Main text of HTML pages: page structure first, then differencing against the nearest URL of the host.

A page is read into blocks of text. Blocks inside menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are furniture. Every page is paired with its nearest neighbour by URL path on the
same host; its other blocks and the neighbour's are aligned by longest common subsequence, and shared blocks are
template. A page that marks its article (``article``, ``main``, or a role or class that says so) has as its text the
blocks of that article, less the template that most pages of the host repeat; any other page has all blocks that are no template.
Pages of a host with the same blocks are one page here, decided once, so neighbours are never copies and copies get
equal texts; pages that differ in any block are pages of their own, and what they share counts as template. The order by host and path is global and split into blocks of bounded size whose edges overlap, so a
host may have any share of the pages; only hashes of blocks travel.

Text differencing alone can't give the right article where, as in generated pages, furniture differs from page
to page and articles share passages; hence a declared article loses no passage that only some pages share, and never all
its text.

Defined cases: a null or empty html gives an empty text; a null or unparsable url has no host, so its page
is not paired; repeated rows are pages of their own, and a copy of a page does not empty it.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import with_position
from docsieve.session import stage

#: Pages per block of the ordered pages; each block also sees one page before and one after.
BLOCK = 256
#: Different pages a host needs before a block in more than half of them counts as repeated by the host.
LEAST_PAGES = 8
#: Parts that the pages of a host are dealt to when they meet the blocks it repeats.
_PARTS_OF_HOST = 16

_SKIP = frozenset("script style noscript template head svg math iframe object select textarea button canvas video audio".split())
_FURNITURE = frozenset("nav header footer aside form menu dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset((
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul").split())
_MAIN_NAMES = frozenset("main article articlebody".split())
_FURNITURE_NAMES = frozenset((
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement banner sponsor sponsored "
    "promo promotion cookie cookies consent notice notices popup modal newsletter subscribe subscription share sharing social "
    "breadcrumb breadcrumbs comment comments disqus reply replies respond related recommended widget form login search "
    "pagination pager toolbar copyright").split())
#: Parts of class names around a furniture name: "ad-slot" is one, "has-sidebar" and "social-ready" only speak of one.
_HOLDERS = frozenset((
    "bar box block wrapper container area slot unit inner outer list item items links link button buttons section panel "
    "top bottom left right").split())
_STATES = frozenset("has with without no not is".split())
_RAW = "script|style|textarea|iframe"
#: Raw elements go with all they hold; an unclosed script or style holds the rest of the page.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*+>.*?</\1\s*+>|<(?:script|style)\b[^>]*+>.*\Z"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    furniture: bool
    main: bool
    #: In an article that only a name around it makes furniture.
    held: bool = False


def _speaks_of_furniture(name: str) -> bool:
    """Whether a class or id, in lower case with its parts divided, names a piece of furniture itself."""
    parts = _PARTS.findall(name)
    if not parts or parts[0] in _STATES:
        return False
    return parts[-1] in _FURNITURE_NAMES or parts[0] in _FURNITURE_NAMES and parts[-1] in _HOLDERS


def _names(attributes: str) -> tuple[bool, bool, bool]:
    """Whether the attributes declare furniture, hint at it by a name, and speak of the main part."""
    strong = weak = main = False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, given = key.lower(), next((v for v in values if v), "")
        value = given.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            strong = True
        elif key == "role":
            strong |= value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form")
            main |= value in ("main", "article")
        elif key in ("class", "id", "itemprop"):
            names = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", given).lower().split()
            weak |= any(map(_speaks_of_furniture, names))
            main |= value in _MAIN_NAMES
    return strong, weak, main


@dataclass(frozen=True)
class _Open:
    """An open element: declared furniture, furniture by its name, part of the article, and text to be dropped."""

    name: str = ""
    strong: bool = False
    weak: bool = False
    main: bool = False
    held: bool = False
    drop: bool = False


def blocks(page: str | None) -> list[Block]:
    """Text blocks in page order, white space folded and character references decoded.

    What stands in inline furniture, such as a button in a paragraph, is left out of its block.
    """
    page = page or ""
    out: list[Block] = []
    parts: list[str] = []
    stack = [_Open()]

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            own = next(e for e in reversed(stack) if not e.drop)
            out.append(Block(text, own.strong or own.weak, own.main, own.held and not own.strong))

    def close(name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == name:
                del stack[i:]
                return
            # A paragraph or inline end does not reach through an element that holds blocks.
            if name not in _BLOCK and stack[i].name in _BLOCK:
                return

    at = 0
    for token in _TOKEN.finditer(page):
        if not stack[-1].drop:
            parts.append(page[at:token.start()])
        at = token.end()
        if token[3] is None:
            continue
        name = token[3].lower()
        if name in _BLOCK:
            flush()
        if token[2]:
            close(name)
            continue
        if name in _VOID or token[4].endswith("/"):
            continue
        if name == "p" and stack[-1].name == "p":
            stack.pop()
        inside = stack[-1]
        strong, weak, main = _names(token[4]) if token[4] else (False, False, False)
        if name in ("body", "html"):
            strong = weak = False
        strong |= name in _SKIP or name in _FURNITURE and not (name == "header" and inside.main)
        begins = (main or name in ("article", "main")) and not (strong or weak or inside.strong or inside.main)
        stack.append(_Open(
            name, inside.strong or strong, inside.weak or weak, inside.main or begins,
            inside.weak if begins else inside.held and not weak,
            inside.drop or name in _SKIP or name not in _BLOCK and (strong or weak)))
        if len(stack) > 4000:  # unclosed elements of a broken page: the innermost ones decide
            del stack[1:2000]
    if not stack[-1].drop:
        parts.append(page[at:])
    flush()
    return out


def article(found: list[Block]) -> list[str] | None:
    """The lines of a declared article, None if the page declares none.

    An article inside an element with a name like a sidebar's counts if there is no other: the name then speaks of
    the layout and not of reader comments beside the article.
    """
    lines = [b.text for b in found if b.main and not b.furniture] or [b.text for b in found if b.held]
    return lines or None


def candidates(found: list[Block]) -> list[str]:
    return [b.text for b in found if not b.furniture]


def text_lines(found: list[Block], template: Iterable[int], repeated: Iterable[int]) -> list[str]:
    """The lines of the main text, from the places among the candidates of the template and of what the host repeats."""
    lines = article(found)
    if lines is None:
        gone = set(template)
        return [x for i, x in enumerate(candidates(found)) if i not in gone]
    gone, open_blocks = set(repeated), [b for b in found if not b.furniture]
    return [b.text for i, b in enumerate(open_blocks) if b.main and i not in gone] or lines


def _lengths(a: list, where: dict, n: int) -> int:
    """Bit-parallel row of the longest common subsequence: zeros up to bit j count what ``a`` shares with b[:j+1]."""
    full = (1 << n) - 1
    row = full
    for x in a:
        match = where.get(x, 0)
        if match:
            u = row & match
            row = ((row + u) | (row - u)) & full
    return row


def _masks(b: list) -> dict:
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    return where


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``, in space that stays linear."""
    if not a or not b:
        return []
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places = list(range(head)) + list(range(len(a) - tail, len(a)))
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    shared = set(x) & set(y)
    keep = [i for i, v in enumerate(x) if v in shared]
    x, y = [x[i] for i in keep], [v for v in y if v in shared]
    inner = _split(x, y) if x and y else []
    return sorted(places + [head + keep[i] for i in inner])


def _split(x: list, y: list) -> list[int]:
    if len(x) == 1:
        return [0] if x[0] in y else []
    if not y:
        return []
    mid, n = len(x) // 2, len(y)
    top = _lengths(x[:mid], _masks(y), n)
    low = _lengths(x[:mid - 1:-1], _masks(y[::-1]), n)
    best, cut, left = -1, 0, 0
    right = n - low.bit_count()
    for j in range(n + 1):
        if left + right > best:
            best, cut = left + right, j
        if j < n:
            left += not top >> j & 1
            right -= not low >> (n - 1 - j) & 1
    return _split(x[:mid], y[:cut]) + [mid + i for i in _split(x[mid:], y[cut:])]


def _objects(arrays) -> np.ndarray:
    arrays = list(arrays)
    out = np.empty(len(arrays), object)
    for i, x in enumerate(arrays):
        out[i] = x
    return out


def _line_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lines = [candidates(blocks(page)) for page in batch["html"]]
        keep = [len(x) > 0 for x in lines]
        lines = [x for x in lines if x]
        hashes = [np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) for x in a], np.uint64).view(np.int64)
                  for a in lines]
        yield batch.loc[keep, ["key", "host", "path"]].assign(
            page=np.array([hashlib.md5(x.tobytes()).hexdigest() for x in hashes], object), lines=_objects(hashes))


def _nearness(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _template(group: pd.DataFrame) -> pd.DataFrame:
    """Template lines of each page of a block of neighbours, by the nearer of the two beside it, and those its host repeats."""
    group = group.sort_values("position")
    rows = list(group[["host", "page", "path", "lines", "own", "often"]].itertuples(index=False))
    out = []
    for i, row in enumerate(rows):
        near = [rows[j] for j in (i - 1, i + 1) if 0 <= j < len(rows) and rows[j].host == row.host]
        if not row.own or not near:
            continue
        other = max(near, key=lambda r: _nearness(r.path, row.path))
        places = common_lines(row.lines.tolist(), other.lines.tolist())
        if places:
            often = () if row.often is None else set(row.often.tolist())
            out.append((row.host, row.page, places, [i for i in places if row.lines[i] in often]))
    return pd.DataFrame(out, columns=["host", "page", "drop", "repeated"])


def repeated_lines(pages: DataFrame) -> DataFrame:
    """host, often: hashes of the lines in more than half of a host's different pages, if it has enough of them."""
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    seen = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(
        F.count(F.lit(1)).alias("n")).where(2 * F.col("n") > LEAST_PAGES)
    # Such lines are less than twice as many as a page has on average, so a host's set stays small.
    return seen.join(sizes, "host").where(2 * F.col("n") > F.col("pages")).groupBy("host").agg(
        F.collect_list("line").alias("often"))


def _key():
    null = F.lit("\x00")
    return F.md5(F.concat_ws("\x1f", F.coalesce(F.col("page_id").cast("string"), null), F.coalesce("url", null),
                             F.coalesce("html", null)))


def template_lines(pages: DataFrame) -> DataFrame:
    """key, drop, repeated: the places of the template lines of each page, and of those that its host repeats."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]+)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]+([^?#]*)", 1)
    hashed = stage(pages.select(_key().alias("key"), host.alias("host"), path.alias("path"), "html").mapInPandas(
        _line_hashes, "key string, host string, path string, page string, lines array<bigint>").where(
        "host <> ''"), "lines")
    distinct = hashed.groupBy("host", "page").agg(F.min("path").alias("path"), F.first("lines").alias("lines"))
    often = repeated_lines(distinct).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS_OF_HOST - 1))))
    known = distinct.withColumn("part", F.pmod(F.xxhash64("page"), F.lit(_PARTS_OF_HOST)).cast("int")).join(
        often, ["host", "part"], "left").drop("part")
    placed = with_position(known, "host", "path", "page")
    own = F.floor(F.col("position") / BLOCK)
    at = F.col("position") % BLOCK
    views = F.array_compact(F.array(
        F.struct(own.alias("block"), F.lit(True).alias("own")),
        F.when((at == 0) & (own > 0), F.struct((own - 1).alias("block"), F.lit(False).alias("own"))),
        F.when(at == BLOCK - 1, F.struct((own + 1).alias("block"), F.lit(False).alias("own")))))
    drops = placed.select("*", F.inline(views)).groupBy("block").applyInPandas(
        _template, "host string, page string, drop array<int>, repeated array<int>")
    return hashed.select("key", "host", "page").distinct().join(drops, ["host", "page"]).select("key", "drop", "repeated")


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for page, drop, repeated in zip(batch["html"], batch["drop"], batch["repeated"]):
            texts.append("\n".join(text_lines(
                blocks(page), () if drop is None else drop, () if repeated is None else repeated)))
        yield batch[["page_id", "url"]].assign(text=texts)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages`` (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    drops = template_lines(pages)
    joined = pages.withColumn("key", _key()).join(drops, "key", "left")
    return joined.select("page_id", "url", "html", "drop", "repeated").mapInPandas(
        _texts, "page_id bigint, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
