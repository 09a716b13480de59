"""Main text of web pages by a site style tree.

1. The elements of all distinct pages of a host are merged: those with the same path of tags and classes are one node of the
   host's tree. Pages with the same elements and text blocks are one page, however often they are repeated. A node keeps in how many pages it stands, its presentations (rows of child elements), and how many pages share
   each content (text block) below it.
2. Importance of a node that ``m`` pages have: presentation ``-sum p log_m p`` over its presentations, content
   ``1 - average of log_m k`` over the contents, each in ``k`` pages; together ``(1 - g^l) presentation + g^l content`` for ``l``
   presentations. What looks and reads the same on all pages comes near 0, what differs from page to page near 1. A node of fewer
   than ``LEAST_PAGES`` pages has importance 1, for nothing can be said of it.
3. From each page the branches below ``LOWEST`` go, and those that their tag or class declares to be no text of the page: navigation,
   footers, forms, scripts, adverts, notices, comments. No branch around an ``article`` or ``main`` element goes.
4. Where a page has an ``article`` (else a ``main``) element, branches inside and beside it are judged too. Inside, the low branches stay
   when they hold more than ``MOST_INSIDE`` of the text (near copies of one article, not what a site adds to each). Beside, only
   branches stay of which the tree knows that they are at least ``BESIDE``.

Text outside tags is decoded, white space inside a block becomes one blank, and blocks are joined by one blank in page order. Null and
empty pages give an empty text. Pages without a url are of one host without a name. Rows are independent in the second pass, so repeated rows give
repeated rows. Tree counts are combined before the shuffle, so a host with most pages is no hot group.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import map_batches, written

# Distinct pages.
LEAST_PAGES = 5
LOWEST = 0.3
BESIDE = 0.6
MOST_INSIDE = 0.5
DECAY = 0.9
# Hosts with judged branches up to which their table is broadcast; beyond it the join shuffles.
BROADCAST_HOSTS = 100_000

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>?|<[!?][^>]*>?""", re.DOTALL
)
CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead tr ul video audio".split()
)
# Tags whose text is none of the page's main text.
DECLARED = frozenset("head nav footer aside form button select menu dialog svg canvas object audio video map datalist".split())
# Words in classes, ids and roles that declare the same (own list).
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar rail widget widgets menu "
    "nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments disqus "
    "reply replies respond share sharing social related recommended recommendations copyright contentinfo complementary "
    "search".split()
)
KEPT_TAGS = frozenset("html body article main".split())
# An opening tag of the key closes an open element of the value, up to the nearest of the stops.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table body article main section div nav".split())


@functools.lru_cache(maxsize=100_000)
def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """Name of an element in the style tree, and whether it is declared to be no main text."""
    names = [a or b or c for a, b, c in CLASS.findall(attributes)] if attributes else []
    words = {w.lower() for n in names for w in PART.findall(n)}
    noise = tag in DECLARED or (tag not in KEPT_TAGS and bool(words & NOISE_WORDS))
    noise = noise or (tag not in KEPT_TAGS and bool(attributes) and bool(HIDDEN.search(attributes)))
    if tag == "article" and words & {"comment", "comments", "reply"}:
        noise = True
    style = ".".join(sorted({re.sub(r"\d+", "#", n) for name in names for n in name.split()}))
    return f"{tag}.{style}" if style else tag, noise


@functools.lru_cache(maxsize=200_000)
def path_number(path: str) -> int:
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Element:
    __slots__ = ("tag", "path", "noise", "main", "holds", "children")

    def __init__(self, tag: str, path: str, noise: bool, main: str):
        self.tag, self.path, self.noise, self.main = tag, path, noise, main
        # Whether an article or main element stands in it.
        self.holds = False
        self.children: list[str] = []


def read_page(page: str) -> tuple[list[tuple[str, list[Element]]], list[Element]]:
    """Text blocks of a page in order, each with the elements around it from the outside, and all elements."""
    blocks: list[tuple[str, list[Element]]] = []
    elements: list[Element] = []
    stack: list[Element] = []
    text: list[str] = []
    at = 0

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                blocks.append((joined, stack.copy()))
            text.clear()

    def close(k: int) -> None:
        flush()
        del stack[k:]

    while match := TAG.search(page, at):
        if match.start() > at:
            text.append(page[at : match.start()])
        at = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if match[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in KEPT_TAGS and tag not in KEPT_TAGS:
                    break
            continue
        attributes = match[3]
        if tag in RAW:
            end = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            at = len(page) if end is None else end.start()
            continue
        if tag in VOID or attributes.endswith("/"):
            if tag == "hr":
                flush()
            text.append(" ")
            continue
        label, noise = _label(tag, attributes.strip())
        if tag not in BLOCKS and not noise:
            continue
        if tag in BLOCKS:
            if stack and stack[-1].tag == "p":
                close(len(stack) - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in CLOSES.get(tag, ()):
                    close(k)
                    break
                if stack[k].tag in STOPS:
                    break
        flush()
        above = stack[-1] if stack else None
        if above:
            above.children.append(label)
        main = above.main if above else ""
        # A page header is none of the text, an article's own header is.
        noise = noise or (tag == "header" and not main)
        main = tag if tag in ("article", "main") and main != "article" else main
        element = Element(tag, f"{above.path}/{label}" if above else label, noise or bool(above and above.noise), main)
        if tag in ("article", "main") and not element.noise:
            for e in stack:
                e.holds = True
        elements.append(element)
        stack.append(element)
    if at < len(page):
        text.append(page[at:])
    flush()
    return blocks, elements


def main_text(page: str | None, removed: frozenset[int] | set[int], beside: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's text without declared noise and without the branches whose path numbers are in ``removed``.

    Of the text beside the article (else main) elements of a page stays what lies in branches whose path numbers are in ``beside``.
    """
    blocks, elements = read_page(page or "")
    low: set[int] = set()
    if removed:
        low = {id(e) for e in elements if not e.holds and e.tag not in KEPT_TAGS and path_number(e.path) in removed}
    blocks = [b for b in blocks if not (b[1] and b[1][-1].noise)]
    inside = main_kind(blocks)
    stays = [not any(id(e) in low for e in around) for _, around in blocks]
    if inside:
        own = [k for k, (_, around) in enumerate(blocks) if around and around[-1].main == inside]
        gone = sum(len(blocks[k][0]) for k in own if not stays[k])
        if gone > MOST_INSIDE * sum(len(blocks[k][0]) for k in own):
            for k in own:
                stays[k] = True
        for k in set(range(len(blocks))).difference(own):
            around = blocks[k][1]
            stays[k] &= bool(around) and around[-1].tag not in KEPT_TAGS and path_number(around[-1].path) in beside
    return " ".join(text for (text, _), stay in zip(blocks, stays, strict=True) if stay)


def main_kind(blocks: list[tuple[str, list[Element]]]) -> str:
    """The element that holds a page's main text, ``article`` or else ``main``; empty where no text is in either."""
    found = {around[-1].main for _, around in blocks if around and not around[-1].noise}
    return "article" if "article" in found else "main" if "main" in found else ""


def host_of(url: Column) -> Column:
    """Lower-case host of a url without port and user; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def plain(df: DataFrame, key: str, url: str, page: str) -> DataFrame:
    column = F.col(f"`{url}`").cast("string")
    return df.select(
        F.col(f"`{key}`").cast("bigint").alias("key"), column.alias("url"), F.col(f"`{page}`").alias("page"), host_of(column).alias("host")
    )


def tree_facts(pages: DataFrame) -> DataFrame:
    """``host, path, kind, value``: what each distinct page has of its host's tree.

    Kinds are page (0), presentation (1), content (2), standing beside a page's article or main elements (3). Equal pages of a host are told by a digest of all their elements and blocks; the
    facts of a page are packed into one value until only one of its copies is left.
    """

    def read(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for hosts, texts in batches:
            digests, packed = [], []
            for page in texts:
                blocks, elements = read_page(page or "")
                inside = main_kind(blocks)
                found: set[tuple[int, int, int]] = set()
                for e in elements:
                    if e.tag not in KEPT_TAGS:
                        path = path_number(e.path)
                        found.add((path, 0, 0))
                        found.add((path, 1, path_number(">".join(e.children))))
                        if inside and e.main != inside and not e.noise:
                            found.add((path, 3, 0))
                shown = [e.path for e in elements]
                for text, around in blocks:
                    value = path_number(text)
                    found.update((path_number(e.path), 2, value) for e in around if e.tag not in KEPT_TAGS)
                    shown += [around[-1].path if around else "", text]
                digests.append(path_number.__wrapped__("\n".join(shown)))
                packed.append(np.array(sorted(found), np.int64).tobytes())
            yield [hosts, digests, packed]

    def unpack(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for hosts, packed in batches:
            facts = [np.frombuffer(p, np.int64).reshape(-1, 3) for p in packed]
            every = np.concatenate(facts) if facts else np.zeros((0, 3), np.int64)
            yield [[h for h, f in zip(hosts, facts, strict=True) for _ in range(len(f))], every[:, 0], every[:, 1].astype(np.int32), every[:, 2]]

    read_once = map_batches(pages, ["host", "page"], read, "host string, digest bigint, facts binary")
    distinct = read_once.dropDuplicates(["host", "digest"])
    return map_batches(distinct, ["host", "facts"], unpack, "host string, path bigint, kind int, value bigint")


def importances(facts: DataFrame) -> DataFrame:
    """``host, path, pages, beside, importance`` of the nodes of all trees."""
    counts = facts.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("k"))
    k = F.col("k").cast("double")

    def over(kind: int, value):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0.0))

    nodes = counts.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == 0, F.col("k"))).alias("pages"),
        F.max(F.col("kind") == 3).alias("beside"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("styles"),
        over(1, k * F.log(k)).alias("style_k_log_k"),
        over(2, k).alias("contents"),
        over(2, k * F.log(k)).alias("content_k_log_k"),
    )
    m = F.col("pages").cast("double")
    presentation = F.lit(1.0) - F.col("style_k_log_k") / (m * F.log(m))
    content = F.when(F.col("contents") > 0, 1 - F.col("content_k_log_k") / (F.col("contents") * F.log(m))).otherwise(0.0)
    weight = F.pow(F.lit(DECAY), F.col("styles"))
    both = (1 - weight) * presentation + weight * content
    return nodes.select("host", "path", "pages", "beside", F.when(F.col("pages") < LEAST_PAGES, 1.0).otherwise(both).alias("importance"))


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` for every row of ``df``."""
    pages = plain(df, key, url, page)
    low = F.col("importance") < LOWEST
    known = F.col("beside") & (F.col("pages") >= LEAST_PAGES) & (F.col("importance") >= BESIDE)
    judged = importances(tree_facts(pages)).where(low | known).groupBy("host").agg(
        F.collect_set(F.when(low, F.col("path"))).alias("removed"), F.collect_set(F.when(known, F.col("path"))).alias("stays")
    )
    judged = written(judged, "branches")
    few = judged.count() <= BROADCAST_HOSTS
    rows = pages.join(F.broadcast(judged) if few else judged, "host", "left")

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, urls, contents, lists, beside in batches:
            texts = [main_text(p, frozenset(r or ()), frozenset(s or ())) for p, r, s in zip(contents, lists, beside, strict=True)]
            yield [keys, urls, texts, [len(t) for t in texts]]

    schema = f"`{key}` bigint, `{url}` string, text string, n_chars bigint"
    return map_batches(rows, ["key", "url", "page", "removed", "stays"], run, schema)
