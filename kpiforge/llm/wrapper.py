"""Main text of web pages by wrapper induction.

Pages become trees; sibling runs of like elements are folded into one repeated node.
The host's most frequent folded tree is its model, and every other is aligned with it by simple tree matching (most pairs of equal nodes that
keep order and ancestors), so that all pages of the host name their slots alike.  A
slot whose text is the same on ``constant`` of the host's different pages that have it
(and on ``min_pages`` of them at least) is template; a slot that varies is content.  On
a host with fewer pages, ``few_pages`` at least, it must be on all of them.

What is no content by its meaning stays out however much it varies: menus, headers and
footers of the page, sidebars, notices, adverts, forms, scripts, styles and reader
comments, told by element, role or a whole name of class or id.  An article in an element
with such a name comes back if the page has no other, a main element always.  Where a
page has an article (or main) element, only the slots in it can be content.  The template
decides on both: articles are trees of their own, aligned with the host's most frequent
one, and what is constant in them goes like what is constant around them.  Articles with
equal texts count once there, so that copies don't make an article template, and as the
element speaks for content, a text must be in twice ``min_pages`` of them.

Counting is by (host, slot, text hash) and combined before it is shuffled, so a host
with a third of all pages is no single task's work.  A page gets the constant texts of
its own shape, which are no more than the blocks of a page, however many shapes its host
has (pages with an id of their own in a slot's path are a shape each).  Defined cases: null or empty html, and pages without
content, give an empty text; a null or odd url is a host of its own kind; equal rows get
equal texts; an empty table gives no rows;
very long html is one row in one task; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import rows_of, written

# Elements of HTML by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
             "strike strong sub sup time tt u var wbr".split())
DROPPED = set("head script style noscript template nav footer aside form button select option textarea input iframe object "
              "embed svg canvas dialog menu xmp noembed noframes title".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
MARKS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
            "navigation menu menubar sidebar breadcrumb breadcrumbs cookie cookies consent notice alert popup modal overlay "
            "newsletter subscribe signup login share sharing social related recommended widget comment comments disqus "
            "replies footer masthead pagination pager skip "
          # names of several words count as they are written
          "ad-banner ad-container ad-slot ad-unit main-nav main-navigation site-navigation nav-menu main-menu top-bar site-header "
          "page-header-nav site-footer page-footer footer-widgets widget-area widget-title left-sidebar right-sidebar sidebar-left "
          "sidebar-right cookie-banner cookie-notice cookie-consent cookie-bar share-buttons share-bar social-share social-links "
          "social-icons sharing-buttons related-posts related-articles related-links comment-list comments-area comment-form "
          "comment-respond newsletter-signup skip-link skip-to-content login-form".split())
#: What marks a block: nothing, an element or role that is no content, an article in an element of
#: such a name, and such a name.
CLEAR, OUT, HELD, MARKED = range(4)
#: Elements that an opening tag of the same group closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: Blocks that close an open paragraph.
ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
             "ol p pre section table ul".split())
#: What an optional end tag doesn't reach through.
SCOPE = set("table ul ol dl article section div body html td th nav aside main".split())

#: Elements nested deeper than this become siblings, as browsers have it (with a limit of their own).
DEPTH = 200

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


class Node:
    __slots__ = ("tag", "marks", "out", "marked", "kids")

    def __init__(self, tag: str, marks: str = "", out: bool = False, marked: bool = False):
        self.tag, self.marks, self.out, self.marked = tag, marks, out, marked
        self.kids: list = []  # nodes and strings in page order

    @property
    def name(self) -> str:
        return f"{self.tag}.{self.marks}" if self.marks else self.tag


def _opened(tag: str, attributes: str) -> Node:
    marks, out, marked = [], tag in DROPPED, False
    if attributes and "=" in attributes or "hidden" in attributes:
        for key, *value in _ATTR.findall(attributes):
            value = "".join(value)
            key = key.lower()
            if key == "role":
                out = out or value.lower() in ROLES
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                out = True
            elif key in ("class", "id") and tag not in ("html", "body", "article", "main"):
                marks += value.split()
                marked = marked or any(w.lower() in MARKS for w in value.split())
    return Node(tag, " ".join(sorted(set(marks)))[:60], out, marked)


def parse(html: str) -> Node:
    """The page's tree; open elements close where HTML lets them, at the latest with
    the element around them."""
    root = Node("#page")
    open_, at, end = [root], 0, len(html)
    while at < end:
        found = _TAG.search(html, at)
        if not found:
            open_[-1].kids.append(html[at:])
            break
        if found.start() > at:
            open_[-1].kids.append(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth].tag == tag:
                    del open_[depth:]
                    break
                if open_[depth].tag in SCOPE and tag in INLINE | {"p", "li"}:
                    break
            continue
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        if shut:
            for depth in range(len(open_) - 1, 0, -1):
                if open_[depth].tag in shut:
                    del open_[depth:]
                    break
                if open_[depth].tag in SCOPE:
                    break
        node = _opened(tag, found[3])
        open_[-1].kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = close.end() if close else end
        elif tag not in VOID and not found[3].endswith("/") and len(open_) < DEPTH:
            open_.append(node)
    return root


def clean(text: str) -> str:
    return " ".join(references.unescape(text).split())


def slots(root: Node) -> list[tuple[tuple[str, ...], str, bool, bool]]:
    """The page's blocks in order: path of node names, text, whether it is out by its
    meaning, and whether it lies in an article."""
    found: list = []
    buffer: list[str] = []

    def flush(path, out, inside):
        if buffer:
            text = clean("".join(buffer))
            if text:
                found.append((path, text, out, inside))
            buffer.clear()

    def entered(kid, out, inside):
        if out == OUT or kid.out or kid.tag == "header" and not inside:
            return OUT
        if kid.marked:
            return OUT if out == HELD else MARKED
        if out == MARKED and kid.tag in ("article", "main"):
            return HELD if inside or kid.tag == "article" else CLEAR
        return out

    def walk(node, path, out, inside):
        for kid in node.kids:
            if isinstance(kid, str):
                buffer.append(kid)
            elif kid.tag in INLINE and not kid.out and not kid.marked:
                walk(kid, path, out, inside)
            elif kid.tag == "br":
                buffer.append(" ")
            else:
                flush(path, out, inside)
                state = entered(kid, out, inside)
                walk_in = (*path, kid.name)
                into = inside or kid.tag in ("article", "main")
                walk(kid, walk_in, state, into)
                flush(walk_in, state, into)

    walk(root, (), CLEAR, False)
    flush((), CLEAR, False)
    only = {CLEAR} if any(s[3] and s[2] == CLEAR for s in found) else {CLEAR, HELD}
    return [(path, text, out not in only, inside) for path, text, out, inside in found]


def folded(paths: list[tuple[str, ...]]) -> tuple:
    """The tree of the blocks' paths, like siblings folded: (name, children)."""
    tree: dict = {}
    for path in paths:
        at = tree
        for name in path:
            at = at.setdefault(name, {})

    def built(name, kids):
        return name, tuple(built(k, v) for k, v in kids.items())

    return built("#page", tree)


def aligned(a: tuple, b: tuple) -> tuple[int, list[tuple[tuple[str, ...], tuple[str, ...]]]]:
    """Simple tree matching: the size of the largest match of two folded trees and its
    pairs of paths (below the roots)."""

    def match(x, y, at_x, at_y):
        if x[0].split(".")[0] != y[0].split(".")[0]:
            return 0, []
        kx, ky = x[1], y[1]
        score = np.zeros((len(kx) + 1, len(ky) + 1), np.int64)
        pairs: dict = {}
        for i, p in enumerate(kx, 1):
            for j, q in enumerate(ky, 1):
                pairs[i, j] = match(p, q, (*at_x, p[0]), (*at_y, q[0]))
                n = pairs[i, j][0]
                score[i, j] = max(score[i - 1, j], score[i, j - 1], score[i - 1, j - 1] + n)
        got, i, j = [], len(kx), len(ky)
        while i and j:
            if score[i, j] == score[i - 1, j]:
                i -= 1
            elif score[i, j] == score[i, j - 1]:
                j -= 1
            else:
                got += pairs[i, j][1]
                i, j = i - 1, j - 1
        return 1 + int(score[len(kx), len(ky)]) + (x[0] == y[0]), [(at_x, at_y), *got]

    return match(a, b, (), ())


def content(got: list[tuple]) -> list[tuple[str, str]]:
    """The blocks that the template decides on, as (slot, text): those in articles, with
    their paths from the article on, and on a page without them the others."""
    inner = [("\t".join(_within(s[0])), s[1]) for s in got if s[3] and not s[2]]
    return inner or [("\t".join(s[0]), s[1]) for s in got if not s[2]]


def _within(path: tuple[str, ...]) -> tuple[str, ...]:
    return path[next(i for i, name in enumerate(path) if name in ("article", "main")) :]


def _host(url_col: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^\s*(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def sides(got: list[tuple]) -> list[tuple[bool, list[tuple[tuple[str, ...], str]]]]:
    """The blocks (path, text) around the page's articles, and those in them that are no menus and so on."""
    return [(False, [s[:2] for s in got if not s[3]]), (True, [(_within(s[0]), s[1]) for s in got if s[3] and not s[2]])]


def _blocks(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """One row per tree, at most two a page: host, inside (the tree is of the page's articles, not
    of what is around them), page (hash of the html, or of the articles' texts), shape (folded
    tree as JSON) and its blocks (slot, text hash)."""

    def run(batches):
        import json

        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        def number(text):
            return xxh3_64_intdigest(text.encode()) - (1 << 63)

        names = ["host", "inside", "page", "shape", "blocks"]
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.struct([("slot", pa.string()), ("text", pa.int64())]))]
        for batch in batches:
            out: list[tuple] = []
            for host, html in rows_of(batch):
                for inside, found in sides(slots(parse(html or ""))):
                    if found:
                        page = number("\n".join(t for _, t in found) if inside else html)
                        held = sorted({("\t".join(path), number(t)) for path, t in found})
                        out.append((host, inside, page, json.dumps(folded([path for path, _ in found])),
                                    [{"slot": slot, "text": t} for slot, t in held]))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return pages.select(_host(url_col).alias("host"), html_col).mapInArrow(
        run, "host string, inside boolean, page bigint, shape string, blocks array<struct<slot: string, text: bigint>>")


def template(pages: DataFrame, url_col: str = "url", html_col: str = "html", constant: float = 0.9, min_pages: int = 5,
             few_pages: int = 3) -> DataFrame:
    """(host, inside, shape, slot, text) of the blocks that are template, for every shape of
    a tree: the hash of a text that ``constant`` of a host's different pages have in the same
    slot of its model, where that shape has it.  A shape's texts are each in nine of ten
    pages with their slot, so a shape has about as many as a page has blocks."""
    side = ["host", "inside"]
    # pages with equal html, and articles with equal texts, count once, in the first of their shapes
    trees = written(_blocks(pages, url_col, html_col).groupBy(*side, "page", "shape").agg(F.first("blocks").alias("blocks")), "trees")
    once = trees.groupBy(*side, "page").agg(F.min("shape").alias("once"))
    trees = trees.join(once, [*side, "page"]).withColumn("n", (F.col("shape") == F.col("once")).cast("bigint"))
    counted = trees.select(*side, "shape", "n", F.explode(F.concat(F.col("blocks"), F.array(F.struct(
        F.lit(None).cast("string").alias("slot"), F.lit(0).cast("bigint").alias("text"))))).alias("b"))
    counted = counted.groupBy(*side, "shape", F.col("b.slot").alias("slot"), F.col("b.text").alias("text")).agg(F.sum("n").alias("n"))
    counted = written(counted, "slots")
    shapes = counted.where("slot is null").select(*side, "shape", "n")
    counted = counted.where("slot is not null")
    model = shapes.groupBy(*side).agg(F.max(F.struct("n", "shape"))["shape"].alias("model"))
    pairs = shapes.select(*side, "shape").join(model, side)

    def align(batches):
        import json

        import pyarrow as pa

        def tree(x):
            return x[0], tuple(map(tree, x[1]))

        known: dict = {}
        for batch in batches:
            out = []
            for host, inside, shape, other in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if (shape, other) not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[shape, other] = aligned(tree(json.loads(shape)), tree(json.loads(other)))[1]
                out += [(host, inside, shape, "\t".join(x), "\t".join(y)) for x, y in known[shape, other]]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.bool_(), *[pa.string()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                             [*side, "shape", "slot", "model_slot"])

    names = pairs.mapInArrow(align, "host string, inside boolean, shape string, slot string, model_slot string")
    named = counted.join(written(names, "names"), [*side, "shape", "slot"], "left").withColumn(
        "model_slot", F.coalesce("model_slot", "slot"))
    texts = named.groupBy(*side, "model_slot", "text").agg(F.sum("n").alias("n"))
    sizes = shapes.join(named.select(*side, "shape", "model_slot").distinct(), [*side, "shape"]).groupBy(*side, "model_slot").agg(
        F.sum("n").alias("pages"))
    least = F.when(F.col("inside"), 2 * min_pages).otherwise(min_pages)
    often = texts.join(sizes, [*side, "model_slot"]).where((F.col("n") >= least) & (F.col("n") >= constant * F.col("pages")))
    few = shapes.where("not inside").groupBy(*side).agg(F.sum("n").alias("all")).where(F.col("all").between(few_pages, min_pages - 1))
    everywhere = texts.join(few, side).where(F.col("n") == F.col("all"))
    fixed = often.select(*side, "model_slot", "text").union(everywhere.select(*side, "model_slot", "text"))
    return named.join(fixed, [*side, "model_slot", "text"]).select(*side, "shape", "slot", "text")


def main_text(html: str | None, fixed: set[tuple[str, int]]) -> str:
    """The content blocks of one page, joined by a blank; ``fixed`` holds its shape's
    template blocks (slot, text hash), those of articles with paths from the article on."""
    from xxhash import xxh3_64_intdigest

    keep = content(slots(parse(html or "")))
    if fixed:
        keep = [s for s in keep if (s[0], xxh3_64_intdigest(s[1].encode()) - (1 << 63)) not in fixed]
    return " ".join(s[1] for s in keep)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", constant: float = 0.9,
              min_pages: int = 5, few_pages: int = 3) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    key = ["host", "inside", "shape"]
    fixed = template(pages, url_col, html_col, constant, min_pages, few_pages).withColumn("shape", F.xxhash64("shape"))
    fixed = written(fixed.groupBy(*key).agg(F.collect_set(F.xxhash64("slot", "text")).alias("gone")), "template")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), _host(url_col).alias("host"), F.col(html_col).alias("html"))

    def run(batches):
        import json

        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        block = pa.struct([("slot", pa.string()), ("text", pa.int64()), ("words", pa.string())])
        for batch in batches:
            out: list[tuple] = []
            for (html,) in rows_of(batch, 3):
                got = slots(parse(html or ""))
                (_, around), (_, inner) = sides(got)
                out.append((bool(inner), json.dumps(folded([path for path, _ in inner or around])),
                            [{"slot": slot, "text": xxh3_64_intdigest(t.encode()) - (1 << 63), "words": t} for slot, t in content(got)]))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            kinds = [pa.bool_(), pa.string(), pa.list_(block)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]],
                                             ["page_id", "url", *key, "blocks"])

    types = dict(own.dtypes)
    own = own.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, host string, inside boolean, shape string, "
                              "blocks array<struct<slot: string, text: bigint, words: string>>")
    own = own.withColumn("shape", F.xxhash64("shape")).withColumn("blocks", F.transform("blocks", lambda b: F.struct(
        F.xxhash64(b["slot"], b["text"]).alias("key"), b["words"].alias("words"))))
    keep = F.filter("blocks", lambda b: ~F.array_contains(F.coalesce("gone", F.array().cast("array<bigint>")), b["key"]))
    text = F.array_join(F.transform(keep, lambda b: b["words"]), " ")
    return own.join(fixed, key, "left").select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint"))
