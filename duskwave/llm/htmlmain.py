"""Main text of web pages, without the site's template.

Pages are read once into a small element tree. Every element's subtree is hashed; Spark counts, for each host, in how
many different pages a subtree occurs, and subtrees that recur across them are deleted from the whole tree, menus and
footers as well as notices inside articles. What a host shows on one page only can't be told from its text by counting:
that goes by its kind (forms, scripts, what is marked as navigation, advert, notice, comment ...), and where a page
marks its article, the text is what is left of the article.

Two different pages suffice for what stands outside of a marked article; inside one, and on pages that mark none, a
share of the host's pages is asked for, since authors do repeat themselves. Pages with equal article text count as one
page, so that copies of a page don't make its own text a template; and inside a marked article only containers can be
template, never single paragraphs.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, ship, stored, text_slices

#: Fixed values of HTML: elements without content, with raw text, that start a new line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Ends an open element of the first kind when one of the second starts.
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "legend", "summary", "body", "html", "head"}
SAME_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table menu select".split())
ITEM_OR_SCOPE = SCOPE | frozenset(SAME_KIND)
#: Never main text.
DROPPED = RAW | frozenset("head nav header footer aside form button select option input label fieldset menu dialog svg math object audio video canvas embed map progress meter datalist output".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed|s)?|promo(?:tion|s)?|nav|navbar|navigation|menu|menus|breadcrumbs?|sidebar|side-bar|footer|header|masthead|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|comments?|replies|respond|disqus|share|sharing|social|related|recommended|pagination|pager|toolbar|widget|skip|login|signup|search)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
CONTAINERS = frozenset("div section aside ul ol dl table figure details nav header footer form".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_STOP = re.compile("[>\"']")
#: Names start where no name character stands before them, so that each stretch of the text is read once.
ATTRIBUTE = re.compile(r"(?<![^\s=\"'/>])([^\s=\"'/>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]++))")
WHITE = re.compile(r"[\x20\t\n\r\x0b\x0c\xa0]+")
RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}


class Page:
    """A lenient tree of elements and strings: unknown ends are ignored, open elements end with what holds them.

    Elements are numbers in page order, 0 is the root; what is inside an element has higher numbers. Reading and all
    walks are loops over lists, in time proportional to the page at any depth, whatever is left open in it.
    """

    def __init__(self, page: str):
        self.name = ["html"]
        self.children: list[list[int | str]] = [[]]
        self.main, self.dropped = [False], [False]
        stack, open_count = [0], Counter(("html",))
        block_at, item_at = [0], [-1]  # for each open element, the stack's nearest block, and its nearest list item or list
        at, n = 0, len(page)
        last = {c: page.rfind(c) for c in ">\"'"}
        loose_until = 0  # up to here a quote is left open, and quotes count as plain characters

        def pop_to(k: int) -> None:
            for e in stack[k:]:
                open_count[self.name[e]] -= 1
            del stack[k:], block_at[k:], item_at[k:]

        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                self.children[stack[-1]].append(page[at:])
                break
            if lt > at:
                self.children[stack[-1]].append(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            slash = page.startswith("/", lt + 1)
            named = NAME.match(page, lt + 1 + slash) if lt < last[">"] else None
            if named is None:
                if lt < last[">"] and page.startswith(("<!", "<?"), lt):
                    at = page.find(">", lt) + 1
                else:
                    self.children[stack[-1]].append("<")
                    at = lt + 1
                continue
            end = named.end()
            while True:  # to the > that ends the tag, outside of quotes
                stop = TAG_STOP.search(page, end)
                if stop[0] == ">" or stop.start() < loose_until:
                    end = stop.end()
                    if stop[0] == ">":
                        break
                elif (close := page.find(stop[0], stop.end()) if stop.start() < last[stop[0]] else -1) >= 0 and close < last[">"]:
                    end = close + 1
                else:
                    loose_until, end = stop.end(), named.end()
            at, name = end, named[0].lower()
            attributes = page[named.end() : end - 1]
            if slash:
                if open_count[name] and name != "html":
                    k = len(stack) - 1
                    while self.name[stack[k]] != name:
                        k -= 1
                    if k:
                        pop_to(k)
                continue
            if name in ("html", "body") and len(stack) == 1:
                if name == "body":
                    self._open(name, attributes, stack, open_count, block_at, item_at)
                continue
            if name in CLOSES_P and self.name[stack[block_at[-1]]] == "p":
                pop_to(block_at[-1])
            if name in SAME_KIND:
                while item_at[-1] > 0 and self.name[stack[item_at[-1]]] in SAME_KIND[name]:
                    pop_to(item_at[-1])
            if name in RAW:
                e = self._add(name, attributes, stack[-1])
                close = RAW_END[name].search(page, at)
                self.children[e].append(page[at : close.start() if close else n])
                at = close.end() if close else n
            elif name in VOID or attributes.endswith("/") and name not in BLOCK:
                self._add(name, attributes, stack[-1])
            else:
                self._open(name, attributes, stack, open_count, block_at, item_at)
        self.hash = [0] * len(self.name)
        # has any text; has text that doesn't go by its kind
        self.text, self.kept = [False] * len(self.name), [False] * len(self.name)
        for e in range(len(self.name) - 1, -1, -1):
            for c in self.children[e]:
                if isinstance(c, str):
                    if not c.isspace():
                        self.text[e] = self.kept[e] = True
                else:
                    self.text[e] |= self.text[c] and self.name[c] not in RAW
                    self.kept[e] |= self.kept[c] and not self.dropped[c]

    def _add(self, name: str, attributes: str, parent: int) -> int:
        e = len(self.name)
        main = name == "article" or name == "main"
        dropped = name in DROPPED
        if attributes and not dropped and not attributes.isspace():
            a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            main |= a.get("role") == "main" or a.get("itemprop") == "articleBody"
            dropped = a.get("role") in ROLES or "hidden" in attributes.lower().split() or a.get("aria-hidden") == "true"
            if not dropped and name not in ("html", "body", "article", "main") and not main:
                dropped = any(MARKED.search(x) for x in (a.get("class"), a.get("id")) if x)
        self.name.append(name)
        self.children.append([])
        self.main.append(main)
        self.dropped.append(dropped)
        self.children[parent].append(e)
        return e

    def _open(self, name, attributes, stack, open_count, block_at, item_at) -> None:
        e = self._add(name, attributes, stack[-1])
        block_at.append(len(stack) if name in BLOCK else block_at[-1])
        item_at.append(len(stack) if name in ITEM_OR_SCOPE else item_at[-1])
        stack.append(e)
        open_count[name] += 1

    def label(self) -> None:
        """Hashes all subtrees; markup counts by name only, text without its white space at the ends, scripts and the like not at all."""
        for e in range(len(self.name) - 1, -1, -1):
            parts = [self.name[e].encode()]
            for c in self.children[e]:
                if isinstance(c, str):
                    parts.append(c.strip().encode("utf-8", "surrogatepass"))
                elif self.name[c] not in RAW:
                    parts.append(self.hash[c].to_bytes(8, "little"))
            self.hash[e] = xxhash.xxh64_intdigest(b"\0".join(parts))

    def region(self) -> list[int]:
        """The outermost elements marked as main text that hold any, in page order; the root if there is none."""
        found: list[int] = []
        todo = [(0, False)]
        while todo:
            e, articles = todo.pop()
            if self.dropped[e]:
                continue
            if articles:
                if self.name[e] == "article":
                    if self.kept[e]:
                        found.append(e)
                    continue
            elif self.main[e] and self.kept[e]:
                if self.name[e] != "main" or not self._holds_article(e):
                    found.append(e)
                    continue
                articles = True
            todo += [(c, articles) for c in reversed(self.children[e]) if not isinstance(c, str)]
        return found or [0]

    def _holds_article(self, main: int) -> bool:
        todo = [c for c in self.children[main] if not isinstance(c, str)]
        while todo:
            e = todo.pop()
            if self.dropped[e]:
                continue
            if self.name[e] == "article":
                if self.kept[e]:
                    return True
                continue
            todo += [c for c in self.children[e] if not isinstance(c, str)]
        return False

    def blocks(self, roots: list[int], gone: frozenset[int] | set[int] = frozenset(), kinds: bool = True) -> list[str]:
        """Text of the block elements under roots, in page order, without the elements in gone."""
        out: list[str] = []
        now: list[str] = []

        def close() -> None:
            text = WHITE.sub(" ", entities.unescape("".join(now))).strip(" ")
            if text:
                out.append(text)
            now.clear()

        for root in roots:
            todo: list[int | str | None] = [root]
            while todo:
                c = todo.pop()
                if c is None:
                    close()
                elif isinstance(c, str):
                    now.append(c)
                elif c not in gone and self.name[c] not in RAW and not (kinds and self.dropped[c]):
                    if self.name[c] == "br":
                        now.append("\n")
                    if self.name[c] in BLOCK:
                        close()
                        todo.append(None)
                    todo += reversed(self.children[c])
            close()
        return out

    def candidates(self, region: list[int]) -> Iterator[tuple[int, bool]]:
        """Elements that may be template, and whether they stand where main text does."""
        marked, roots = region != [0], set(region)
        todo = [(0, not marked)]
        while todo:
            e, inside = todo.pop()
            if self.name[e] in RAW or not self.text[e]:
                continue
            inside = (inside or e in roots) and not self.dropped[e]
            if e and self.name[e] not in ("body", "html") and not (inside and (self.main[e] or marked and self.name[e] not in CONTAINERS)):
                yield e, inside
            todo += [(c, inside) for c in self.children[e] if not isinstance(c, str)]


def signature(host: str, tree: int, inside: bool) -> int:
    """A signed 64-bit name of a subtree of a host, apart for inside and outside of main text."""
    h = xxhash.xxh64_intdigest(tree.to_bytes(8, "little") + host.encode("utf-8", "surrogatepass"), int(inside))
    return h - (1 << 64) if h >> 63 else h


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def subtree_counts(rows: DataFrame) -> DataFrame:
    """host and html -> host, tree, inside, n: in how many different pages of the host a subtree occurs; tree null: the host's different pages.

    Every page gives one row with the list of its subtrees; the lists are taken apart when they are counted.
    """

    def subtrees(batch: pa.RecordBatch) -> pa.RecordBatch:
        body, inner, outer = [], [], []
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(text)
            page.label()
            region = page.region()
            h = xxhash.xxh64_intdigest("\n".join(page.blocks(region)).encode("utf-8", "surrogatepass"))
            body.append(h - (1 << 64) if h >> 63 else h)
            found: tuple[set[int], set[int]] = (set(), set())
            for e, inside in page.candidates(region):
                found[inside].add(signature(host, page.hash[e], inside))
            outer.append(list(found[0]))
            inner.append(list(found[1]))
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("host"), pa.array(body, pa.int64()), pa.array(outer, longs), pa.array(inner, longs)], ["host", "body", "outer", "inner"])

    seen = stored(arrow_map(rows.select("host", "html"), subtrees, "host string, body long, outer array<long>, inner array<long>", "html"), "subtrees")
    trees = lambda name, inside: seen.select("host", F.explode(name).alias("tree"), F.lit(inside).alias("inside"), "body")
    per_page = trees("outer", False).union(trees("inner", True)).select("tree", "inside", F.xxhash64("host").alias("at"), "body").distinct()
    n = per_page.groupBy("tree", "inside", "at").agg(F.count("*").alias("n"))
    hosts = seen.select(F.xxhash64("host").alias("at"), "body").distinct().groupBy("at").agg(F.count("*").alias("host_n"))
    return n.join(hosts, "at")


def templates(rows: DataFrame, min_share: float) -> DataFrame:
    """tree of all subtrees that are template, written to the shared folder."""
    n = subtree_counts(rows)
    return stored(n.where((F.col("n") >= 2) & (~F.col("inside") | (F.col("n") >= F.col("host_n") * min_share))).select("tree"), "template")


def main_text(pages: DataFrame, min_share: float = 0.2, page_id: str = "page_id", url: str = "url", html: str = "html", most_broadcast: int = 1 << 21, kinds: bool = True) -> DataFrame:
    """page_id, url, text, n_template and template_chars for every row of pages.

    A subtree is template when at least two different pages of its host hold it; where main text stands (inside a marked
    article, or anywhere on a page that marks none) these must also be at least min_share of the host's different pages.
    A host with one page shows no template, so there only kinds and marks decide. n_template subtrees with
    template_chars of text (as it stands in the page) were deleted from a page. Without kinds, only counting decides,
    besides scripts and the like: no kind is dropped and no marked article looked for.

    Template names go to all tasks where there are at most most_broadcast of them (8 bytes each); beyond that they are
    joined to the pages. Null html is empty text; null or odd urls share one nameless host. Repeated rows get equal
    results, an empty table gives an empty result, other columns are ignored. Very long, deep or broken pages take time
    in proportion to their length; an element that is left open ends with the page.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    found = templates(rows, min_share)
    known = None
    if found.count() <= most_broadcast:
        known = pages.sparkSession.sparkContext.broadcast(np.sort(found.toArrow().column("tree").to_numpy()))
    else:
        rows = rows.withColumn("page", F.md5("html"))
        rows = rows.join(_page_templates(rows, found), ["host", "page"], "left")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, numbers, sizes = [], [], []
        hosts, own = batch.column("host").to_pylist(), batch.column("trees").to_pylist() if known is None else None
        for i, text in enumerate(batch.column("html").to_pylist()):
            page = Page(text)
            page.label()
            region = page.region() if kinds else [0]
            elements, names = [], []
            for e, inside in page.candidates(page.region()):
                elements.append(e)
                names.append(signature(hosts[i], page.hash[e], inside))
            names = np.array(names, np.int64)
            if known is None:
                hit = np.isin(names, np.array(own[i] or [], np.int64))
            else:
                at = np.searchsorted(known.value, names)
                hit = at < len(known.value)
                hit[hit] = known.value[at[hit]] == names[hit]
            gone = {e for e, x in zip(elements, hit.tolist(), strict=True) if x}
            out.append("\n".join(page.blocks(region, gone, kinds)))
            n, size = _deleted(page, gone)
            numbers.append(n)
            sizes.append(size)
        cols = [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_template", "template_chars"])

    types = dict(rows.dtypes)
    return arrow_map(rows, extract, f"page_id {types['page_id']}, url {types['url']}, text string, n_template long, template_chars long", "html")


def _deleted(page: Page, gone: set[int]) -> tuple[int, int]:
    """How many outermost elements of gone there are, and their characters of text."""
    n = size = 0
    todo = [(0, False)]
    while todo:
        e, inside = todo.pop()
        if e in gone and not inside:
            n, inside = n + 1, True
        for c in page.children[e]:
            if isinstance(c, str):
                size += len(c) if inside else 0
            elif page.name[c] not in RAW:
                todo.append((c, inside))
    return n, size


def _page_templates(rows: DataFrame, found: DataFrame) -> DataFrame:
    """host, page (a digest of html) and the template names of each different page that has any, by a join."""

    def names(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(text)
            page.label()
            out.append(list({signature(host, page.hash[e], inside) for e, inside in page.candidates(page.region())}))
        return pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(out, pa.list_(pa.int64()))], ["host", "page", "own"])

    each = arrow_map(rows.select("host", "page", "html"), names, "host string, page string, own array<long>", "html")
    each = each.select("host", "page", F.explode("own").alias("tree")).distinct().join(found, "tree")
    return each.groupBy("host", "page").agg(F.collect_list("tree").alias("trees"))
