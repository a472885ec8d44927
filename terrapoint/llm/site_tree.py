"""Main text of web pages by a site style tree.

A page's markup becomes a tree of elements; the trees of one host are merged into a style tree whose nodes are element
paths (tag, class, id and role, from the root). Each node has two kinds of importance over the n pages that hold it:
presentation, the entropy (base n) of the child patterns it shows, and content, one less the mean entropy of where its
texts occur: a text that stands in c of n pages counts log(c) / log(n). A node whose content is the same on nearly all
pages and whose presentation never varies is template; it goes with its branch. What markup itself declares (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) has importance 0 on any host. An
element it declares as an article (by its tag or role, or by a class that holds most of the open text) is a prior: branches inside are judged by the tree too and go when their importance
is under the threshold; branches that it leaves open, on a page with an article, stay when theirs is at least one less
the threshold. As one article may be copied onto many pages of a host, branches inside articles are counted over the
host's different articles (by their largest branch) instead of its pages, and a page's largest branch always stays.

Texts stay on the executors: what is shuffled are (host, path, text) digests, summed before the shuffle, so a host with
a third of all pages costs one row a task, path and text; only the paths to remove come back, joined by host.

Edge cases: null or empty html gives an empty text; a null url, or one without a host, is a host of its own name; pages
on hosts of fewer than `least_pages` pages are judged by the tree of their registered domain, and by markup alone where
that is as small; markup cut off at any
place is read to its end; pages of any size are read whole; repeated rows give equal rows; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapoint.llm.common import staged
from terrapoint.llm.url_reputation import domain_columns

#: HTML elements by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend option select".split()
)
BOILERPLATE = frozenset("nav header footer aside form script style head menu dialog button select noscript template iframe svg textarea input label fieldset title search".split())
#: Elements that end an open p, and elements that end open siblings of their own kind.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("ul ol table dl select body html article section div main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Whole names in class or id of a part that is not the article: a word of the middle line, with those around it.
_NAMED = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|mobile|sticky|fixed|post|entry|article|user|the|js|g|l|c)[_-])*"
    r"(?:ads?|adverts?|advertisements?|adsbygoogle|adsense|banner|sponsor(?:ed|s)?|promos?|promoted|promotions?|nav|navbar|navigation|menu|breadcrumbs?|side-?bar|footer|header|masthead|cookies?|consent|gdpr|notice|popup|modal|overlay"
    r"|newsletter|subscribe|subscriptions?|sign-?up|log-?in|comments?|disqus|replies|respond|share|sharing|social|related|recommended|recommendations?|widgets?|toolbar|pagination|pager|skip-?link|toc|copyright)"
    r"(?:[_-]?(?:container|wrapper|box|bar|area|block|section|list|items?|inner|unit|slot|links?|menu|nav|posts?|articles?|stories|news|forms?|buttons?|icons?|modal|popup|banner|overlay|message|notice|policy|media|thread|top|bottom|left|right|[0-9]+))*",
    re.IGNORECASE,
)
_HEADING = re.compile(r"(?:(?:post|entry|article|page|main|story|content)[_-])?header(?:[_-](?:inner|wrapper|container))?", re.IGNORECASE)
_ARTICLE = re.compile(r"(?:main[_-])?(?:article|post|entry|story)(?:[_-]?(?:body|content|text))?", re.IGNORECASE)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s>/]*)[^>]*(?:>|$)|<([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)"
    r"|<([a-zA-Z][^\s>/]*)([^>]*)(?:>|$)",  # a quote that never ends
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


class Block:
    """One run of text: the path of its element, whether markup keeps or drops it, and the text."""

    __slots__ = ("path", "state", "text")

    def __init__(self, path: str, state: int, text: str):
        self.path, self.state, self.text = path, state, text


DROPPED, OPEN, KEPT, LIKELY = -1, 0, 1, 2


def _judged(tag: str, attributes: str, outer: int) -> tuple[str, int]:
    """(step of the path, state) of an element under one of state `outer`."""
    if tag in BOILERPLATE:
        inside = outer in (KEPT, LIKELY) and tag in ("header", "label")  # an article's own header holds its heading
        return tag, outer if inside else DROPPED
    step, state = tag, outer
    names: list[str] = []
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "role":
                if value.lower() in ROLES:
                    state = DROPPED
                elif value.lower() in ("main", "article") and state != DROPPED:
                    state = KEPT
                step += f"[{value}]"
            elif name in ("class", "id"):
                names += value.split()
                step += f"{'.' if name == 'class' else '#'}{re.sub(r'[0-9]+', '0', value)}"
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                state = DROPPED
    if tag in ("html", "body"):
        return step, outer
    if outer == DROPPED or state == DROPPED:
        return step, DROPPED
    if tag not in HEADINGS and any(_NAMED.fullmatch(n) and not (outer in (KEPT, LIKELY) and _HEADING.fullmatch(n)) for n in names):
        return step, DROPPED
    if tag in ("article", "main"):
        return step, KEPT
    if state == OPEN and any(_ARTICLE.fullmatch(n) for n in names):
        return step, LIKELY
    return step, state


def blocks(page: str) -> tuple[list[Block], list[tuple[str, int, str]]]:
    """The page's text blocks in order, and (path, state, pattern of its children) of the elements that markup doesn't drop."""
    out: list[Block] = []
    shapes: list[tuple[str, int, str]] = []
    stack: list[list] = [["", "", OPEN, []]]  # tag, path, state, children
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                top = next(e for e in reversed(stack) if not e[0] or e[0] in BLOCK)
                out.append(Block(top[1], top[2], text))

    def close(n: int) -> None:
        """Closes all but the n outer elements."""
        while len(stack) > n:
            tag, path, state, children = stack[-1]
            if tag in BLOCK:
                flush()
            stack.pop()
            if state != DROPPED and tag in BLOCK:
                shapes.append((path, state, ",".join(children)))

    def end_open(kinds: tuple[str, ...], scope: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in kinds:
                close(i)
                return
            if stack[i][0] in scope:
                return

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and stack[-1][2] != DROPPED:
            parts.append(page[at:lt])
        if lt == size:
            break
        m = _TOKEN.match(page, lt)
        if not m:
            if stack[-1][2] != DROPPED:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                if tag == "p":
                    flush()
            continue
        if not (m[2] or m[4]):
            continue
        tag, attributes = (m[2] or m[4]).lower(), m[3] or m[5] or ""
        if tag in CLOSES_P:
            end_open(("p",), SCOPES - {"p"})
        if tag in SIBLINGS:
            end_open(SIBLINGS[tag], SCOPES - {tag})
        if tag in BLOCK:
            flush()
        if tag in ("br", "hr"):
            parts.append(" ")
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else size
            continue
        step, state = _judged(tag, attributes, stack[-1][2])
        if tag in BLOCK:
            stack[-1][3].append(step)
        stack.append([tag, f"{stack[-1][1]}>{step}" if tag in BLOCK else stack[-1][1], state, []])
    flush()
    close(1)
    # What a class name alone calls an article is one if it holds most of the text, and no element is one outright.
    sizes = {state: sum(len(b.text) for b in out if b.state == state) for state in (OPEN, KEPT, LIKELY)}
    likely = KEPT if not sizes[KEPT] and sizes[LIKELY] >= sizes[OPEN] else OPEN
    for b in out:
        b.state = likely if b.state == LIKELY else b.state
    return out, [(path, likely if state == LIKELY else state, shape) for path, state, shape in shapes]


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def extract(pages: DataFrame, least_pages: int = 8, threshold: float = 0.2, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url and text of every row: the blocks that stay, in page order, joined by empty lines."""
    given = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    at = F.instr(F.coalesce("url", F.lit("")), "://")
    site = F.lower(F.regexp_extract(F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise(""), "^[^/?#]*", 0))
    given = given.select("page_id", "url", "html", site.alias("host"))

    # The style tree: digests of (path, child pattern) and (path, text), for paths that markup doesn't drop. Inside an
    # article they carry the article's digest, so that its copies count once; kind 2 holds the host's articles.
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, kinds, what, wholes = [], [], [], [], []
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, shapes = blocks(page or "")
                main = largest(found)
                whole = None if main is None else _number("\n".join(b.text for b in found if b.state == KEPT and b.path == main))
                seen = {(_number(b.path), 1, _number(b.text), b.state) for b in found}
                seen |= {(_number(path), 0, _number(shape), state) for path, state, shape in shapes}
                if whole is not None:
                    seen.add((0, 2, whole, KEPT))
                for path, kind, digest, state in sorted(seen):
                    hosts.append(name)
                    paths.append(path)
                    kinds.append(kind)
                    what.append(digest)
                    wholes.append(whole if state == KEPT else None)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(kinds, pa.int32()), pa.array(what, pa.int64()), pa.array(wholes, pa.int64())], ["host", "path", "kind", "digest", "whole"])

    seen = given.select("host", "html").mapInArrow(features, "host string, path long, kind int, digest long, whole long")
    copies = staged(seen.groupBy("host", "path", "kind", "digest", "whole").agg(F.count(F.lit(1)).alias("c")), "site-copies")
    hosts = given.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hosts = staged(hosts.withColumn("domain", domain_columns(F.col("host"))[0]), "site-hosts")
    own = lists(importance(copies, hosts, "host"), least_pages, threshold)
    wider = copies.join(hosts.select("host", "domain"), "host").groupBy("domain", "path", "kind", "digest", "whole").agg(F.sum("c").alias("c"))
    domains = hosts.groupBy("domain").agg(F.sum("pages").alias("pages"))
    shared = lists(importance(wider, domains, "domain"), least_pages, threshold)
    of = F.col("pages") >= least_pages
    both = hosts.join(own, "host", "left").join(shared.withColumnsRenamed({"template": "t", "important": "i"}), "domain", "left")
    template = both.select("host", F.when(of, F.col("template")).otherwise(F.col("t")).alias("template"), F.when(of, F.col("important")).otherwise(F.col("i")).alias("important"))
    template = staged(template.where("template is not null"), "site-templates")

    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, gone, sure in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                found, _ = blocks(page or "")
                texts.append("\n\n".join(chosen(found, set(gone or ()), set(sure or ()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return given.join(template, "host", "left").select("page_id", "url", "html", "template", "important").mapInArrow(main_text, "page_id long, url string, text string")


def importance(copies: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """key, path, kept, pages, presentation and content of every path of a style tree. copies: key, path, kind (0 child
    patterns, 1 texts, 2 articles), digest, whole (the article's digest inside one) and c pages; sizes: key and pages."""
    inside = F.col("whole").isNotNull()
    counts = copies.groupBy(key, "path", "kind", "digest", inside.alias("kept")).agg(F.sum(F.when(inside, 1).otherwise(F.col("c"))).cast("double").alias("c"))
    sums = counts.groupBy(key, "path", "kind", "kept").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("forms"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.sum(F.log("c")).alias("logc"))
    sums = staged(sums, f"site-sums-{key}")
    every = sizes.select(key, "pages", F.lit(False).alias("kept")).unionByName(sums.where("kind = 2").select(key, F.col("forms").alias("pages"), F.lit(True).alias("kept")))
    n = F.log(F.greatest(F.col("pages").cast("double"), F.lit(2.0)))
    presentation = F.when(F.col("kind") == 0, (F.log("total") - F.col("clogc") / F.col("total")) / n)
    content = F.when(F.col("kind") == 1, 1 - F.col("logc") / F.col("forms") / n)
    judged = sums.where("kind < 2").join(every, [key, "kept"]).withColumns({"presentation": presentation, "content": content})
    return judged.groupBy(key, "path", "kept").agg(F.max("pages").alias("pages"), F.max("presentation").alias("presentation"), F.max("content").alias("content")).where("content is not null")


def lists(judged: DataFrame, least_pages: int, threshold: float) -> DataFrame:
    """key, and the paths that go (template) and those that stay though markup leaves them open (important)."""
    key = judged.columns[0]
    weight = F.greatest(F.col("content"), F.coalesce("presentation", F.lit(0.0)))
    low, high = weight < threshold, ~F.col("kept") & (F.col("content") >= 1 - threshold)
    both = [F.sort_array(F.collect_list(F.when(which, F.col("path")))).alias(name) for name, which in (("template", low), ("important", high))]
    return judged.where((F.col("pages") >= least_pages) & (low | high)).groupBy(key).agg(*both)


def largest(found: list[Block]) -> str | None:
    """Path of the branch that holds most of what markup keeps; None without any."""
    sizes: dict[str, int] = {}
    for b in found:
        if b.state == KEPT:
            sizes[b.path] = sizes.get(b.path, 0) + len(b.text)
    return max(sizes, key=sizes.__getitem__) if sizes else None


def chosen(found: list[Block], template: set[int], important: set[int] | frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks that stay. Where markup names an article with text: its largest branch, its branches that
    aren't template, and important ones outside; else those markup leaves open that aren't template."""
    main = largest(found)
    if main is None:
        return [b.text for b in found if b.state == OPEN and _number(b.path) not in template]
    return [b.text for b in found if (b.path == main or _number(b.path) not in template if b.state == KEPT else _number(b.path) in important)]
