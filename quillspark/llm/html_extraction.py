"""Main text of web pages by template deduction from equivalence classes of tokens.

A page is a sequence of tokens: tags that open a container, told apart by their path, and text
runs with their path. Over the different pages of a host, tokens whose occurrence vectors (how
often on which page) are equal form a class; a class is valid if it has two tokens or more,
occurs on a tenth of the pages and on two at least, and its tokens come in one order on nearly
all of them. Valid classes nest, since a token's path names what encloses it, and make the host's
template; an odd or empty page merely has none of their tokens. What the template leaves open
are its slots. The article is the deepest template tag that holds half of what varies on the
page; template texts inside it, and parts marked as menus, notices and the like, are left out.

Class words that also name parts of articles (as in related-work, search-results, legal) drop a
part only if half of its text is in links, as a menu's is. Buttons, selects and text areas are
controls of forms wherever they stand, and go. Formulas stay, without their annotations. The
text of a noscript stays unless it stands elsewhere on the page or speaks of JavaScript.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, stored

_TOKEN = re.compile(
    r"<!--(?:.*?)(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-label|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "template", "svg", "annotation", "annotation-xml", "select", "button", "object", "video", "audio", "canvas")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_OUTER = frozenset("html body main article section div aside nav header footer form ul ol dl table tbody thead tfoot tr td th blockquote figure fieldset center details dialog menu".split())
_ALONE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_DROPPED = frozenset("nav footer aside form head menu dialog header".split())
#: Words in class, id or role that mark what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars footer footers masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup "
    "login comment comments respond reply replies discussion disqus searchbox toc copyright disclaimer complementary contentinfo".split()
)
#: Words that do so only where half of the part's text is in links.
DOUBTFUL = frozenset("share sharing social related recommended recommendations pager pagination widget widgets search skip legal".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_SUPPORT = 0.1  # share of a host's different pages on which a class has to occur
_ORDERED = 0.9  # share of its pages on which a class's tokens come in its usual order
_TEXT_PAGES, _TEXT_SHARE = 8, 0.9  # pages, and share of them, from which a text is the template's

Run = tuple[int, bool, bool, str, bool]  # node, in a dropped part, begins a block, text, in a link


class Node(NamedTuple):
    """A container of a page: its parent's number, its path's hash, its tag."""

    parent: int
    path: int
    tag: str


ROOT = Node(-1, 0, "")


def _marks(attributes: str) -> tuple[bool, bool, str]:
    """(marked as no article, marked by a doubtful word, class and id as a path label)."""
    named = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
    words = {w for k in ("class", "id", "role") for w in _SPLIT.sub(" ", named.get(k, "")).lower().split()}
    label = "".join(f".{c}" for c in named.get("class", "").split()[:2])
    return bool(words & NOT_ARTICLE) or "hidden" in named, bool(words & DOUBTFUL), label


def _below(path: int, label: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}/{label}") >> 1


class Doubt(NamedTuple):
    """A part that may be no article: the number of the one around it, whether it is a noscript."""

    parent: int
    noscript: bool


def without_doubt(page: list[Run], parts: list[int], doubts: list[Doubt]) -> list[Run]:
    """Runs with those parts dropped that turn out to be menus or second forms of other text; parts: the
    innermost doubtful part of each run, -1 for none."""
    within: list[bool] = []  # a noscript or inside of one
    for d in doubts:
        within.append(d.noscript or d.parent >= 0 and within[d.parent])
    elsewhere = {run[3].strip() for run, part in zip(page, parts, strict=True) if part < 0 or not within[part]}
    chars, linked, alone, script = ([0] * len(doubts) for _ in range(4))
    for (_, _, _, text, link), part in zip(page, parts, strict=True):
        if part >= 0 and (text := text.strip()):
            chars[part] += len(text)
            linked[part] += len(text) * link
            alone[part] += text not in elsewhere
            script[part] += "javascript" in text.lower()
    for i in range(len(doubts) - 1, -1, -1):
        if (up := doubts[i].parent) >= 0:
            for counts in (chars, linked, alone, script):
                counts[up] += counts[i]
    gone: list[bool] = []
    for i, d in enumerate(doubts):
        own = script[i] > 0 or alone[i] == 0 if d.noscript else 2 * linked[i] >= chars[i]
        gone.append(own or d.parent >= 0 and gone[d.parent])
    return [(n, dropped or part >= 0 and gone[part], *rest) for (n, dropped, *rest), part in zip(page, parts, strict=True)]


def runs(html: str) -> tuple[list[Run], list[Node]]:
    """(text runs in page order, containers in the order they open, the first for the page itself)."""
    out: list[Run] = []
    nodes = [ROOT]
    doubts: list[Doubt] = []
    parts: list[int] = []  # of each run, its doubtful part
    stack: list[tuple[str, int, bool, bool, int]] = []  # tag, node, dropped, in article or main, doubtful part
    fresh, at, size, links = True, 0, len(html), 0
    while at < size:
        m = _TOKEN.match(html, at)
        at = m.end()
        text = m["text"]
        node, dropped, inside, part = stack[-1][1:] if stack else (0, False, False, -1)
        if text is not None:
            out.append((node, dropped, fresh, text, links > 0))
            parts.append(part)
            fresh = False
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                out.append((node, dropped, fresh, " ", links > 0))
                parts.append(part)
                fresh = False
            continue
        if tag in _BLOCK:
            fresh = True
        if m["end"] or m["end2"]:
            links = max(0, links - (tag == "a"))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body") and tag not in ("html", "body", "main", "article"):
                    break  # a stray end tag doesn't close the article
            continue
        attributes = m["attributes"] if m["tag"] else m["attributes2"]
        if tag in _RAW:
            if not attributes.rstrip().endswith("/"):
                close = _RAW[tag].search(html, at)
                at = close.end() if close else size
            continue
        if tag in _VOID:
            continue
        links += tag == "a"
        if tag in _ALONE:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _ALONE[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in _OUTER and stack[i][0] not in ("tr", "td", "th"):
                    break
        elif tag in _BLOCK:
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in _OUTER:
                    break
        node, dropped, inside, part = stack[-1][1:] if stack else (0, False, False, -1)
        marked, doubtful, label = _marks(attributes) if attributes.strip() else (False, False, "")
        if (doubtful or tag == "noscript") and tag not in ("html", "body", "main", "article"):
            doubts.append(Doubt(part, tag == "noscript"))
            part = len(doubts) - 1
        if tag in _OUTER:
            nodes.append(Node(node, _below(nodes[node].path, tag + label), tag))
            node = len(nodes) - 1
        own = tag in _DROPPED and not (tag == "header" and inside) or marked and tag not in ("html", "body", "main", "article")
        stack.append((tag, node, dropped or own, inside or tag in ("article", "main"), part))
    return without_doubt(out, parts, doubts) if doubts else out, nodes


def under(nodes: list[Node], top: int) -> list[bool]:
    """Which containers are inside of one, itself included."""
    out = [False] * len(nodes)
    for i, node in enumerate(nodes):
        out[i] = i == top or node.parent >= 0 and out[node.parent]
    return out


def text_token(path: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{' '.join(unescape(text).split())}") >> 1


def blocks(page: list[Run], inside: list[bool], leave: set[int]) -> list[str]:
    """Blocks of text inside some containers, without dropped parts and the runs of given numbers; references
    decoded, white space inside a block one space, empty blocks left out."""
    out: list[str] = []
    parts: list[str] = []

    def close() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(text)
        parts.clear()

    last = False
    for i, (node, dropped, fresh, text, _) in enumerate(page):
        if dropped or not inside[node]:
            last = False
            continue
        if fresh or not last:
            close()
        last = True
        parts.append(" " if i in leave else text)
    close()
    return out


def inner_chars(page: list[Run], nodes: list[Node], skip: set[int], links: bool) -> list[int]:
    """Characters of text in each container and those inside it."""
    size = [0] * len(nodes)
    for i, (node, _, _, text, linked) in enumerate(page):
        if i not in skip and (links or not linked):
            size[node] += len(text.strip())
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i].parent] += size[i]
    return size


def own_container(page: list[Run], nodes: list[Node]) -> int:
    """Where a page without a template has its article: in its largest article or main tag, else its body."""
    size = inner_chars([r for r in page if not r[1]], nodes, set(), True)
    for tag in ("article", "main"):
        found = [i for i, node in enumerate(nodes) if node.tag == tag]
        if found:
            return max(found, key=lambda i: (size[i], -i))
    return next((i for i, node in enumerate(nodes) if node.tag == "body"), 0)


def container(page: list[Run], nodes: list[Node], template: dict[int, tuple[float, bool]], texts: set[int]) -> int:
    """The deepest of the page's template tags that hold half of what varies; template: mean characters
    of a tag by path, and whether its content is the same on all pages; texts: the numbers of the template's runs."""
    size = inner_chars(page, nodes, texts, False)
    count = Counter(node.path for node in nodes)
    depth = [0] * len(nodes)
    held: list[tuple[int, float]] = []
    still = [False] * len(nodes)
    for i, node in enumerate(nodes[1:], start=1):
        depth[i], still[i] = depth[node.parent] + 1, still[node.parent]
        if count[node.path] == 1 and node.path in template:
            mean, same = template[node.path]
            still[i] = still[i] or same
            # the page's own characters beside the host's mean; names of tags only weigh in
            if not still[i]:
                held.append((i, (mean + size[i]) * (4 if any(nodes[j].tag in ("article", "main") for j in _chain(nodes, i)) else 1)))
    if not held:
        return own_container(page, nodes)
    most = max(x for _, x in held)
    return max((i for i, x in held if 2 * x >= most), key=lambda i: (depth[i], -i))


def _chain(nodes: list[Node], i: int) -> Iterator[int]:
    while i > 0:
        yield i
        i = nodes[i].parent


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["host", "page", "token", "is_text", "n", "chars", "at", "content"]
    for b in batches:
        for some in (b.slice(at, 64) for at in range(0, b.num_rows, 64)):
            rows: list[tuple] = []
            for host, page, html in zip(*(c.to_pylist() for c in some.columns), strict=True):
                found, nodes = runs(html or "")
                if len(nodes) == 1:
                    continue  # no container: no page of the host's kind
                size, first, n, chars = inner_chars(found, nodes, set(), False), {}, Counter(), Counter()
                content = [xxhash.xxh64() for _ in nodes]
                for node, _, _, text, _ in found:
                    for j in _chain(nodes, node):
                        content[j].update(text)
                for i, node in enumerate(nodes[1:], start=1):
                    first.setdefault(node.path, i)
                    n[node.path] += 1
                    chars[node.path] += size[i]
                rows += [(host, page, p, False, k, chars[p], first[p], content[first[p]].intdigest() >> 1) for p, k in n.items()]
                texts = Counter(text_token(nodes[node].path, text) for node, _, _, text, _ in found if text.strip())
                rows += [(host, page, t, True, k, 0, 0, 0) for t, k in texts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def templates(pages: DataFrame) -> DataFrame:
    """(host, token, is_text, chars, same): the tokens of each host's template, with the mean characters of
    a tag's content and whether that is the same everywhere. pages: host, page (the digest of its html), html.

    An occurrence vector is kept as the sum over pages of a hash of page and count, so a host
    of any size is a plain aggregation; pages that are copies count once.
    """
    tokens = pages.mapInArrow(_tokens, "host string, page long, token long, is_text boolean, n long, chars long, at long, content long")
    with Scratch(pages.sparkSession) as scratch:
        tokens = scratch.stored(tokens.dropDuplicates(["host", "page", "token"]))
        vector = F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector")
        same = (F.min("content") == F.max("content")).alias("same")
        seen = tokens.groupBy("host", "token").agg(F.max("is_text").alias("is_text"), vector, F.count("*").alias("pages"), F.max("n").alias("most"), F.avg("chars").alias("chars"), same)
        seen = scratch.stored(seen.where("pages >= 2"))
        total = tokens.where("NOT is_text").select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("all"))
        tags = seen.where("NOT is_text")
        classes = tags.groupBy("host", "vector").agg(F.count("*").alias("size"), F.max("pages").alias("pages")).join(total, "host")
        classes = classes.where((F.col("size") >= 2) & (F.col("pages") >= F.col("all") * _SUPPORT)).select("host", "vector")
        members = scratch.stored(tags.join(classes, ["host", "vector"]).select("host", "token", "vector"))
        # the order of a class's tokens on each page that has them
        met = tokens.where("NOT is_text").select("host", "page", "token", "at").join(members, ["host", "token"])
        order = F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"])).alias("order")
        orders = met.groupBy("host", "vector", "page").agg(order).groupBy("host", "vector", "order").agg(F.count("*").alias("n"))
        valid = orders.groupBy("host", "vector").agg((F.max("n") / F.sum("n")).alias("share")).where(F.col("share") >= _ORDERED)
        out = tags.join(members.join(valid, ["host", "vector"]).select("host", "token"), ["host", "token"])
        # no content is the same everywhere if it was seen on a few pages alone
        out = out.where("most = 1").select("host", "token", "is_text", "chars", (F.col("same") & (F.col("pages") >= _TEXT_PAGES)).alias("same"))
        texts = seen.where("is_text AND most = 1").join(total, "host").where((F.col("pages") >= _TEXT_PAGES) & (F.col("pages") >= F.col("all") * _TEXT_SHARE))
        out = out.union(texts.select("host", "token", "is_text", F.lit(0.0).alias("chars"), F.lit(True).alias("same")))
        # a page's tokens meet the template here, so that html never moves by host
        used = tokens.select("host", "page", "token").join(out, ["host", "token"])
        return stored(used.groupBy("host", "page").agg(F.collect_list(F.struct("token", "is_text", "chars", "same")).alias("template")))


def page_text(html: str, template: list[dict] | None) -> str:
    page, nodes = runs(html)
    known = {t["token"] for t in template or () if t["is_text"]}
    tags = {t["token"]: (t["chars"], t["same"]) for t in template or () if not t["is_text"]}
    fixed = {i for i, (node, _, _, text, _) in enumerate(page) if known and text_token(nodes[node].path, text) in known}
    top = container(page, nodes, tags, fixed) if tags else own_container(page, nodes)
    inside = under(nodes, top)
    here = [i for i, r in enumerate(page) if inside[r[0]] and not r[1]]
    mine = sum(len(page[i][3].strip()) for i in here)
    if 2 * sum(len(page[i][3].strip()) for i in here if i in fixed) >= mine:
        fixed = set()  # near copies of one page, not a template
    return "\n".join(blocks(page, inside, fixed))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [page_text(html.as_py() or "", template.as_py()) for html, template in zip(b.column("html"), b.column("template"), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): a row per row of pages.

    Null html counts as empty: empty text. Pages with a null url or without a host share the
    empty host. A page of which the template knows no tag, as on a host with one page, is read
    by its own article or main tag, else its body. Repeated rows keep a row each, and copies
    count as one page of their host. Other columns are not read; an empty table gives an empty
    result.
    """
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    rows = rows.withColumn("host", _host(F.col("url"))).withColumn("page", F.xxhash64("html"))
    of_page = templates(rows.select("host", "page", "html"))
    id_type = rows.schema["id"].dataType.simpleString()
    # a row per page is no table of bounded size: it is never broadcast
    out = rows.join(of_page.hint("merge"), ["host", "page"], "left").select("id", "url", "html", "template")
    out = out.mapInArrow(_extract, f"page_id {id_type}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
