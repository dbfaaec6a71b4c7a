"""Main text of web pages by site style trees: importance of a site's nodes by entropy, low ones removed."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript noembed noframes iframe template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "legend", "figcaption", "summary"}
#: Presentation that marks what isn't the article: elements, and words of class, id and role.
NOISE_TAGS = frozenset("nav header footer aside form button select dialog menu search head script style noscript template iframe svg math textarea".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice notices alert gdpr comment comments reply replies respond discussion disqus share sharing social related recommended newsletter subscribe subscription signup login popup modal widget toolbar pagination pager complementary contentinfo copyright legal skip".split())
ARTICLE = frozenset(["article", "main"])
#: Within an article a container is noise only if its class and id have no other words than these.
STRICT = frozenset("ad ads advert adverts advertisement advertising sponsored comments".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_IN_TAG = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_WHITE = re.compile(r"\s+")

#: A node is noise if its importance is below this, from this many distinct pages of its host on; fewer can't tell.
IMPORTANCE, PAGES = 0.1, 8
#: The share of contents in a node's importance; the rest is its presentation's.
GAMMA = 0.9
#: Below so many nested blocks a path is a digest, so that hostile nesting can't make it long.
DEEP = 64


class Block:
    __slots__ = ("path", "marks", "text", "in_article", "linked")

    def __init__(self, path: str, marks: bool, in_article: bool):
        self.path, self.marks, self.in_article, self.text, self.linked = path, marks, in_article, [], 0


class _Tags:
    """The tags of a page, found in one pass: a quote counts only after an equals sign, and one that is never closed ends
    with its tag. A tag that the page's end cuts off is a tag."""

    def __init__(self, html: str):
        self.html, self.unclosed = html, set()

    def _find(self, what: str, at: int) -> int:
        """html.find, which looks for what is nowhere ahead only once."""
        if what in self.unclosed:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.unclosed.add(what)
        return found

    def at(self, lt: int) -> tuple[str, str, str, int] | None:
        """(closing or opening, tag, attributes, end) of the tag at lt, empty names for comments; None if it is text."""
        html = self.html
        for start, end in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
            if html.startswith(start, lt):
                found = self._find(end, lt + len(start))
                return "", "", "", len(html) if found < 0 else found + len(end)
        closing = html.startswith("/", lt + 1)
        name = _NAME.match(html, lt + 1 + closing)
        if name is None:
            return None
        at = name.end()
        while True:
            if closing:
                found = self._find(">", at)
            else:
                m = _IN_TAG.search(html, at)
                if m is None:
                    found = -1
                elif m[0] == ">":
                    found = m.start()
                else:
                    found = self._find(m[0][-1], m.end())
                    if found >= 0:
                        at = found + 1
                        continue
                    found = self._find(">", m.end())
            end = len(html) if found < 0 else found
            return "/" if closing else "<", name[0].lower(), html[name.end() : end], min(end + 1, len(html))


def _label(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """A node's presentation (tag, class and role words), whether it marks noise by itself, whether a word of its does, and
    whether all its words do by the strict list."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, tag in NOISE_TAGS, False, False
    words, noise, named, said = [], tag in NOISE_TAGS, False, []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            noise = True
        else:
            found = [w.lower() for w in _NAME_WORDS.findall(value)]
            said += found
            if tag not in ARTICLE and tag not in ("body", "html") and not NOISE_WORDS.isdisjoint(found):
                named = True
            if name != "id":
                words += [w for w in found if not w.isdigit()]
    strict = tag not in ARTICLE and bool(said) and STRICT.issuperset(said)
    return f"{tag}.{'.'.join(sorted(set(words)))}" if words else tag, noise, named, strict


def blocks_of(html: str) -> list[Block]:
    """The page's text blocks in order, each with the path of its presentation. Tolerates what browsers do: unclosed and
    stray tags, raw text elements, a page cut anywhere.

    A container that a word marks as noise isn't marked if it holds the page's only article or main elements, or, on a
    page that has none, most of its text. Within an article words mark by the strict list alone.
    """
    named: list[list] = []  # of each container with such a word: characters of text, holds an article
    found, whole, apart = _parse(html, frozenset(), named)
    held = any(holds for _, holds in named)
    good = frozenset(k for k, (n, holds) in enumerate(named) if not apart and (holds or not held and 2 * n > whole))
    return _parse(html, good, [])[0] if good else found


def styles_of(html: str) -> dict[str, set[str]]:
    """The presentation of each node: the labels of its children in order, repeats in a row once, for every such path."""
    styles: dict[str, set[str]] = {}
    _parse(html, frozenset(), [], styles)
    return styles


def _parse(html: str, good: frozenset, named: list[list], styles: dict | None = None) -> tuple[list[Block], int, bool]:
    """Blocks, the characters of text that no element marks as noise, and whether an article is in no named container.
    Adds the named containers to named; those whose number is in good don't mark. Adds nodes' presentation to styles."""
    found: list[Block] = []
    tags, opened, depth = _Tags(html), Counter(), 0
    children: list[list[str]] = [[]]  # of the page and of each block on the stack
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, noise, in article
    within: list[tuple[int, ...]] = []  # of each of the stack: the named containers around it, None in noise of another kind
    whole, apart = 0, False
    current: Block | None = None
    at = 0

    def text(raw: str) -> None:
        nonlocal current, whole
        if not raw:
            return
        around = within[len(stack) - 1] if stack else ()
        if around is not None:
            n = len("".join(raw.split()))
            whole += n
            for k in around:
                named[k][0] += n
        _, path, noise, inside = stack[-1] if stack else ("", "", False, False)
        if current is not None and current.marks != noise:
            if noise:  # marked elements in the midst of a line
                return
            current = None
        if current is None:
            if not raw.strip():
                return
            current = Block(path, noise, inside)
            found.append(current)
        current.text.append(raw)
        if any(x[0] == "a" for x in stack[-4:]):
            current.linked += len(raw)

    def close(k: int) -> None:
        """The stack's elements from k on end."""
        nonlocal depth
        for tag, path, *_ in reversed(stack[k:]):
            opened[tag] -= 1
            if tag in BLOCK:
                depth -= 1
                own = children.pop()
                if styles is not None:
                    styles.setdefault(path, set()).add(" ".join(x for i, x in enumerate(own) if not i or own[i - 1] != x))
        del stack[k:]

    while True:
        lt = html.find("<", at)
        token = tags.at(lt) if lt >= 0 else None
        while lt >= 0 and token is None:
            lt = html.find("<", lt + 1)
            token = tags.at(lt) if lt >= 0 else None
        text(html[at:] if token is None else html[at:lt])
        if token is None:
            break
        kind, tag, attributes, at = token
        if kind == "/":
            if tag in BLOCK:
                current = None
            elif tag == "br":
                text(" ")
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break
        elif kind == "<":
            if tag in BLOCK:
                current = None
                if tag == "body":
                    close(0)
                elif tag in CLOSES_P:
                    for k in range(len(stack) - 1, -1, -1) if opened["p"] else ():
                        if stack[k][0] == "p":
                            close(k)
                            break
                        if stack[k][0] in BLOCK:
                            break
                elif tag in ("li", "dd", "dt", "tr", "td", "th"):
                    same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                    for k in range(len(stack) - 1, -1, -1) if any(opened[x] for x in same) else ():
                        if stack[k][0] in same:
                            close(k)
                            break
                        if stack[k][0] in ("ul", "ol", "dl", "table", "tbody", "article", "section", "div") or tag in ("td", "th") and stack[k][0] == "tr":
                            break
            elif tag == "br":
                text(" ")
            if tag in VOID:
                continue
            label, noise, word, strict = _label(tag, attributes)
            _, path, above, inside = stack[-1] if stack else ("", "", False, False)
            if tag in ("svg", "math") and attributes.endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            around = within[len(stack) - 1] if stack else ()
            around = None if noise else around
            if inside:
                noise = noise or strict  # other words may well be the article's own
            elif word:
                named.append([0, False])
                if around is not None:
                    around = (*around, len(named) - 1)
                noise = noise or len(named) - 1 not in good
            if tag in ARTICLE and around is not None:
                apart = apart or not around
                for k in around:
                    named[k][1] = True
            del within[len(stack) :]
            within.append(around)
            opened[tag] += 1
            if tag not in BLOCK:
                stack.append((tag, path, above or noise, inside))
            else:
                children[-1].append(label)
                children.append([])
                depth += 1
                below = f"{path}/{label}" if depth <= DEEP else f"#{_digest(path + label):x}"
                # article and main carry their own header and footer; what marks noise elsewhere still does within
                stack.append((tag, below, above or noise, inside or tag in ARTICLE))
    close(0)
    return found, whole, apart


def block_text(block: Block) -> str:
    return _WHITE.sub(" ", unescape("".join(block.text))).strip()


def _host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


#: Removed paths of so many characters may be broadcast.
MOST_BYTES = 8 << 20
_NODES = "host string, path string, style boolean, feature long, page long"


def _nodes(batches):
    """A row for each (page, path, feature) of the page's tree, distinct: the contents of all its text nodes, the article's
    and those marked as noise included, and the presentation (style) of all its elements. page is a digest of all blocks,
    the same for copies of a page."""
    names = ["host", "path", "style", "feature", "page"]
    types = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            out: dict[str, list] = {k: [] for k in names}
            part = batch.slice(at, 64)
            for url, html in zip(*(part.column(k).to_pylist() for k in ("url", "html")), strict=True):
                bodies = [(b.path, x) for b in blocks_of(html) if (x := block_text(b))]
                page = _digest("\n".join(f"{p}\n{x}" for p, x in bodies))
                found = {(p, False, _digest(x)) for p, x in bodies} | {(p, True, _digest(x)) for p, all_ in styles_of(html).items() for x in all_}
                for k, column in zip(("path", "style", "feature"), zip(*found, strict=True) if found else ((), (), ()), strict=True):
                    out[k] += column
                out["host"] += [_host(url)] * len(found)
                out["page"] += [page] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, types, strict=True)], names)


def importance(nodes: DataFrame) -> DataFrame:
    """(host, path, pages, importance): of each text node of each site's merged tree. nodes are distinct, so copies of a
    page count once.

    A node's contents are features; a feature on few of the pages tells the page apart, one on all of them doesn't. The
    importance of contents is 1 less the mean over the node's occurrences of log(pages with the content) / log(pages with
    the node): the entropy, to base of the pages, of a content spread evenly over the pages that hold it. The importance
    of a presentation is the entropy, to the same base, of the node's styles over the pages. Both make the whole, GAMMA
    being the contents' share.
    """
    features = nodes.groupBy("host", "path", "style", "feature").agg(F.count(F.lit(1)).alias("n"))
    sums = features.groupBy("host", "path").agg(
        F.sum(F.when(~F.col("style"), F.col("n"))).alias("occurrences"), F.sum(F.when(~F.col("style"), F.col("n") * F.log("n"))).alias("spread"),
        F.sum(F.when(F.col("style"), F.col("n"))).alias("shown"), F.sum(F.when(F.col("style"), F.col("n") * F.log("n"))).alias("alike"),
    )
    pages = nodes.where(~F.col("style")).select("host", "path", "page").distinct().groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"))
    base = F.log(F.greatest("pages", F.lit(2)))
    content = 1 - F.col("spread") / F.col("occurrences") / base
    shape = F.coalesce(F.greatest((F.log("shown") - F.col("alike") / F.col("shown")) / base, F.lit(0.0)), F.lit(0.0))
    return sums.where("occurrences > 0").join(pages, ["host", "path"]).select("host", "path", "pages", (GAMMA * content + (1 - GAMMA) * F.least(shape, F.lit(1.0))).alias("importance"))


def main_text(html: str, removed: frozenset = frozenset()) -> str:
    """The main text's blocks joined by newlines: what presentation doesn't mark as noise, less the removed paths; only
    what is in article or main elements, if that is half of it or more."""
    blocks = [(b, x) for b in blocks_of(html) if not b.marks and (b.in_article or b.path not in removed) and (x := block_text(b))]
    inside = sum(len(x) for b, x in blocks if b.in_article)
    if 2 * inside >= sum(len(x) for _, x in blocks):
        blocks = [(b, x) for b, x in blocks if b.in_article] or blocks
    return "\n".join(x for _, x in blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): a row per row of pages; text is empty where there is none or html is null.

    Pages of one host (empty for a null or odd url) share a tree of all their nodes. Nodes of low importance go, wherever
    enough pages show it, but none within an article. Sites' removed paths are joined to their pages by host; they travel
    as a broadcast where they have been counted to be few, hosts and bytes of paths both. Repeated rows, null ids and
    columns of other names change nothing; a hostile page takes time by its length.
    """
    rows = pages.select(F.col(url_col).cast("string").alias("url"), common.text_of(html_col).alias("html"))
    nodes = rows.mapInArrow(common.task("style_tree", _nodes), _NODES)
    low = importance(common.cut(nodes.distinct(), "nodes")).where((F.col("pages") >= PAGES) & (F.col("importance") < IMPORTANCE))
    low = common.cut(low.groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("removed")), "low")
    n, size = low.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.array_join("removed", ""))), F.lit(0))).first()
    told = None
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), common.text_of(html_col).alias("html"))
    if n > common.BROADCAST_ROWS or size > MOST_BYTES:
        host = F.udf(_host, "string")
        own = own.withColumn("host", host("url")).join(low, "host", "left").drop("host")
    else:
        told = pages.sparkSession.sparkContext.broadcast({r["host"]: frozenset(r["removed"]) for r in low.collect()})
        own = own.withColumn("removed", F.lit(None).cast("array<string>"))

    def run(batches):
        for batch in batches:
            texts = []
            for url, html, removed in zip(*(batch.column(k).to_pylist() for k in ("url", "html", "removed")), strict=True):
                gone = told.value.get(_host(url), frozenset()) if told else frozenset(removed or ())
                texts.append(main_text(html, gone))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return own.select("page_id", "url", "html", "removed").mapInArrow(common.task("style_tree", run), "page_id long, url string, text string, n_chars long")
