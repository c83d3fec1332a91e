"""HTML extraction: markup first, then a suffix array over each host's pages for what markup leaves open.

A page is cut into blocks. Markup decides most of them: text inside the article (or main) element is kept, menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go. The rest is open: text of pages
without an article element, and link lists inside one. For these, the token streams outside the kept text of all pages
of a host are concatenated into one suffix array. It is cut at depth ``DEPTH``: suffixes are dealt and compared by their
first DEPTH tokens, so that equal neighbours, the intervals with that common prefix, come together in one shuffle with
map-side combining and without a host ever meeting in one task. An interval seen on ``MIN_PAGES`` distinct pages is a
repeated substring; tokens it covers are boilerplate, an open block mostly covered goes, a unique run stays. Where every
open block of a page is covered, the page is a copy rather than a frame, and its open blocks stay.

Why not by repetition alone: articles carry sentences that the host also uses in its menus and adverts, and whole
articles are copied, so inside an article element repetition does not tell boilerplate from text.

Defined results: a null or empty html gives an empty text; a null url is a host of its own; copies of a page count as one
page; repeated rows are returned each; unclosed tags end with their parent; an empty table gives no rows; columns may have any names.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written
from .common import packed

DEPTH = 6               # tokens of a repeated substring, at least
MIN_PAGES = 3           # distinct pages of the host that repeat it
COVERED = 0.6           # share of a block's tokens, from which on it goes
LINKED = 0.6            # share of a block's text inside links, from which on an article's block is open

RAW = {"script", "style", "template", "noscript", "svg", "math", "iframe", "object", "textarea", "title", "head", "canvas", "select", "option", "button"}
CHROME = {"nav", "footer", "header", "aside", "form", "menu", "dialog", "fieldset"}
MAIN = {"article", "main"}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "area", "base", "col", "embed", "wbr", "track", "param"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
          "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|nav|navbar|navigation|menu|"
                  r"breadcrumbs?|header|masthead|footer|sidebar|aside|widget|related|recommend\w*|share|sharing|social|subscribe|newsletter|signup|login|"
                  r"comments?|comment-list|disqus|replies|respond|pagination|pager|toolbar|skip-link)(?:$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
KEEP, OPEN, DROP = 0, 1, 2


def _is_chrome(tag: str, attributes: str) -> bool:
    if tag in CHROME:
        return True
    if not attributes or tag in ("body", "html"):
        return False
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
        if name == "role" and value.lower() in ROLES or name in ("class", "id") and tag not in MAIN and HINT.search(value):
            return True
    return False


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of every block that is not raw content, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool]] = []               # tag, chrome from here, main from here
    pieces: list[str] = []
    linked = total = chrome = main = in_link = at = 0

    def flush():
        nonlocal linked, total
        text = " ".join(entities.unescape("".join(pieces)).split()) if pieces else ""
        if text:
            zone = DROP if chrome else KEEP if main and linked < LINKED * max(1, total) else OPEN
            out.append((zone, text))
        pieces.clear()
        linked = total = 0

    def say(text: str):
        nonlocal linked, total
        if text:
            pieces.append(text)
            n = len(text.strip())
            total += n
            linked += n if in_link else 0

    while True:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in RAW and not closing and tag != "head":
            if not m[3].endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in INLINE and not (not closing and m[3] and _is_chrome(tag, m[3])):
            if tag in ("br", "img"):
                pieces.append(" ")
            if closing and any(t[0] == tag for t in stack):
                pass
            else:
                continue
        flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    for _, c, k in stack[i:]:
                        chrome -= c
                        main -= k
                    del stack[i:]
                    break
        elif tag not in VOID and not m[3].endswith("/"):
            if tag in ("p", "li", "td", "tr", "dt", "dd") and stack and stack[-1][0] == tag:
                _, c, k = stack.pop()
                chrome -= c
                main -= k
            c, k = _is_chrome(tag, m[3]) or tag == "head", tag in MAIN or bool(re.search(r"\brole\s*=\s*[\"']?main\b", m[3] or ""))
            stack.append((tag, c, k))
            chrome += c
            main += k
    flush()
    return out


def _grams(tokens: list[str], seed: int) -> list[int]:
    """Signed 64-bit hashes of every run of DEPTH tokens."""
    if len(tokens) < DEPTH:
        return []
    h = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)
    n = len(h) - DEPTH + 1
    out = np.full(n, seed, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(DEPTH):
            out = (out ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64).tolist()


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower()
    except ValueError:
        return ""


PARSED = "struct<text:string,page:long,open:array<struct<zone:int,text:string,at:int,tokens:int>>,grams:array<long>>"


def parse(page: str, host: str) -> dict:
    """Text where markup decides everything; else the open page's blocks. Always the hashes of the stream outside kept text."""
    blocks = blocks_of(page)
    has_main = any(z == KEEP for z, _ in blocks)
    open_ = any(z == OPEN for z, _ in blocks) and not has_main
    seed = xxhash.xxh3_64_intdigest(host)
    stream, placed = [], []
    for zone, text in blocks:
        tokens = text.split()
        placed.append({"zone": zone, "text": text, "at": len(stream), "tokens": 0 if zone == KEEP else len(tokens)})
        if zone != KEEP:
            stream += tokens
    return {"text": None if open_ else "\n".join(t for z, t in blocks if z == KEEP), "open": placed if open_ else None,
            "page": xxhash.xxh3_64_intdigest(page + "\n" + host) - 2**63, "grams": _grams(stream, seed)}


def settle(blocks: list[dict], hits: list[int] | None) -> str:
    """The page's text, given the stream places at which repeated substrings start."""
    covered = set()
    for h in hits or []:
        covered.update(range(h, h + DEPTH))
    open_ = [b for b in blocks if b["zone"] == OPEN]
    unique = [b for b in open_ if sum(i in covered for i in range(b["at"], b["at"] + b["tokens"])) < COVERED * b["tokens"]]
    stay = {id(b) for b in (unique or open_)}
    return "\n".join(b["text"] for b in blocks if b["zone"] == KEEP or id(b) in stay)


def _parse_column(html: Column, url: Column) -> Column:
    block = pa.struct([("zone", pa.int32()), ("text", pa.string()), ("at", pa.int32()), ("tokens", pa.int32())])
    kind = pa.struct([("text", pa.string()), ("page", pa.int64()), ("open", pa.list_(block)), ("grams", pa.list_(pa.int64()))])

    @F.arrow_udf(PARSED)
    def parsed(pages: pa.Array, urls: pa.Array) -> pa.Array:
        return pa.array([parse(p, host_of(u)) for p, u in zip(pages.to_pylist(), urls.to_pylist(), strict=True)], kind)
    return parsed(html, url)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``row`` (the input row) and its ``text``."""
    rows = packed(pages)
    html, url = F.coalesce(F.col("row.html").cast("string"), F.lit("")), F.col("row.url").cast("string")
    slim = F.col("row").dropFields("html") if len(pages.columns) > 1 else F.col("row")
    stored = written(rows.select(slim.alias("row"), _parse_column(html, url).alias("p")).select("row", "p.*"), "pages")
    suffixes = stored.select("page", F.explode("grams").alias("gram"))
    repeated = suffixes.distinct().groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).select("gram")
    undecided = stored.filter(F.col("text").isNull())
    places = undecided.dropDuplicates(["page"]).select("page", F.posexplode("grams").alias("at", "gram"))
    hits = places.join(repeated, "gram", "left_semi").groupBy("page").agg(F.collect_list("at").alias("hits"))

    @F.arrow_udf("string")
    def settled(blocks: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array([settle(b, h) for b, h in zip(blocks.to_pylist(), hits.to_pylist(), strict=True)], pa.string())

    decided = stored.filter(F.col("text").isNotNull()).select("row", "text")
    late = undecided.join(hits, "page", "left").select("row", settled(F.col("open"), F.col("hits")).alias("text"))
    return decided.unionByName(late)


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).select(F.col("row.page_id").cast("long").alias("page_id"), F.col("row.url").alias("url"),
                                 "text", F.length("text").cast("long").alias("n_chars"))
