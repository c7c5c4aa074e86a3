"""Main text of web pages: site templates removed by counting element subtrees per host.

1. Every page is parsed to a tree of elements.  Each subtree has a hash of its tags and texts, from below.
2. Spark counts, per host, on how many pages (distinct urls) each container subtree occurs.  A subtree on at least
   ``least`` pages and ``share`` of its host's pages is template.
3. Template subtrees are deleted, and with them what its markup names as no part of the article (menus, headers,
   footers, sidebars, notices, adverts, forms, scripts, styles, comments); what is left of the article elements, or else
   of the main element, or else of the body, is the text, a line per block.

Only containers count as candidates for 2, and only those without a headline that hold less than half of their page's
text: a passage or a whole article that many pages share is text, not template.

Templates are few beside pages.  Up to ``most`` of them (counted) go to all tasks as sorted 64-bit numbers; beyond it
each page gets the list of its own ones by a join, which moves the pages once.  Both ways give the same rows.

Defined results: null and empty html give the empty string; a null url has an empty host, whose pages are counted like
those of any other; rows that repeat count as one page and are extracted each; unclosed, misnested and unknown elements
are read as browsers do in the main (a paragraph ends where a block begins, an end tag closes what is open inside); an
empty table gives an empty table; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, text_batches
from .textbytes import tidy
from .url_filter import host_of

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")

#: Elements whose content is no markup; all are left out of texts.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "figure", "fieldset", "details", "center", "main", "hgroup", "nav", "header", "footer", "aside", "form", "menu"}
BLOCKS = CONTAINERS | HEADINGS | {"html", "body", "article", "address", "p", "li", "dt", "dd", "pre", "blockquote", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "hr", "figcaption", "legend", "summary", "option", "head", "search", "dialog"}
#: Elements that are never article text.
ASIDE = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "search", "template", "svg", "math", "object", "audio", "video", "canvas", "button", "select", "datalist", "input", "map", "applet"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist"}
#: Words of class and id that name what is no part of an article.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising advertorial adsense adslot adbox adunit banner banners billboard breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright "
    "discussion disclaimer disqus dropdown footer footnav gdpr header hidden login masthead megamenu menu menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager pagination paywall "
    "popup promo promos promoted promotion recommendations recommended register related replies reply respond search share sharing sidebar sidebars signup skip skiplink social socials sponsor sponsored sponsors sponsorship "
    "subscribe subscription toolbar topbar widget widgets".split()
)
#: Where one word says nothing, a pair or the whole does.
PAIRS = re.compile(r"(?i)(?:^|[^a-z])(?:side[-_]?bar|news[-_]?letter|nav[-_]?bar|pop[-_]?up|log[-_]?in|sign[-_]?up|read[-_]?more|see[-_]?also|site[-_]?(?:header|footer|nav|menu|notice)|page[-_]?(?:header|footer)|top[-_]?(?:bar|nav)|user[-_]?comments?)(?:$|[^a-z])")
COMMENTS = {"comment", "comments", "reply", "replies", "respond", "related", "teaser", "sponsored", "promo", "ad"}
#: A paragraph ends where one of these begins; the others end where one of their kind begins, up to the scope's elements.
ENDS_P = BLOCKS - {"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "option", "head", "html", "body"}
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = {"table", "td", "th", "caption", "button", "html", "template"}


class Page:
    """A parsed page: its elements in the order of their start tags, and its texts with the element that holds each.

    ``parent``, ``tag``, ``attrs``, ``digest``, ``size`` (characters other than white space) and ``headline`` (holds an h1)
    are lists by element; element 0 is the document.  A text "" marks the edge of a block.
    """

    def __init__(self, text: str):
        self.parent, self.tag, self.attrs, self.size, self.headline = [-1], [""], [{}], [0], [False]
        self.digest: list[int] = [0]
        self.texts: list[tuple[int, str]] = []
        self.hashers = [blake2b(digest_size=8)]
        self.open, self.count = [0], Counter()  # open elements, and how many of each tag
        at, raw, skip = 0, "", re.compile("")
        while at < len(text):
            if raw:
                end = skip.search(text, at)
                at, raw = (end.end() if end else len(text)), ""
                self.end(self.tag[self.open[-1]])
                continue
            found = TOKEN.search(text, at)
            if not found:
                self.add(text[at:])
                break
            if found.start() > at:
                self.add(text[at : found.start()])
            at = found.end()
            name = (found[2] or "").lower()
            if name and found[1]:
                self.end(name)
            elif name:
                self.begin(name, {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(found[3])} if found[3].strip(" /\n\t\r\f") else {})
                if name in RAW:
                    raw, skip = name, re.compile(rf"(?i)</{re.escape(name)}(?=[\s/>])[^>]*>?")
        while self.open:
            self.close()

    def add(self, text: str) -> None:
        text = entities.unescape(text)
        e = self.open[-1]
        self.texts.append((e, text))
        self.hashers[-1].update(" ".join(text.split()).encode("utf-8", "replace") + b"\0")
        self.size[e] += len(text) - sum(map(text.count, " \n\t\r"))

    def begin(self, name: str, attrs: dict[str, str]) -> None:
        if name in ENDS_P:
            self.close_to({"p"}, SCOPE)
        if name in SAME:
            self.close_to(*SAME[name])
        if name in ("html", "body") and self.count[name]:
            return
        if name == "body":
            self.close_to({"head"}, set())
        self.parent.append(self.open[-1]), self.tag.append(name), self.attrs.append(attrs)
        self.size.append(0), self.headline.append(name == "h1"), self.digest.append(0)
        self.open.append(len(self.tag) - 1)
        self.count[name] += 1
        self.hashers.append(blake2b(b"<" + name.encode("utf-8", "replace") + b"\0", digest_size=8))
        if name in BLOCKS or name == "br":
            self.texts.append((self.open[-1], ""))
        if name in VOID:
            self.close()

    def close(self) -> None:
        e, own = self.open.pop(), self.hashers.pop().digest()
        self.count[self.tag[e]] -= 1
        self.digest[e] = int.from_bytes(own, "big", signed=True)
        if self.open:
            up = self.open[-1]
            self.hashers[-1].update(own)
            self.size[up] += self.size[e]
            self.headline[up] = self.headline[up] or self.headline[e]
            if self.tag[e] in BLOCKS:
                self.texts.append((up, ""))

    def close_to(self, names: set[str], scope: set[str]) -> None:
        """Close up to and with the innermost element of ``names`` that is open inside the scope."""
        if not any(self.count[x] for x in names):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[k]] in names:
                while len(self.open) > k:
                    self.close()
                return
            if self.tag[self.open[k]] in scope:
                return

    def end(self, name: str) -> None:
        """Close the nearest open element of that name; ends of inline elements don't reach out of their block."""
        if not self.count[name]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[k]]
            if tag == name:
                while len(self.open) > k:
                    self.close()
                return
            if name not in BLOCKS and tag in BLOCKS:
                return

    def named_aside(self) -> list[bool]:
        """By element: whether its markup, or that of one around it, says that it is no article text."""
        out, inside = [False], [False]
        for e in range(1, len(self.tag)):
            tag, attrs, up = self.tag[e], self.attrs[e], self.parent[e]
            root = tag in ("article", "main")
            inside.append(inside[up] or root)
            drop = out[up] or tag in ASIDE or tag in RAW
            if tag == "header":
                drop = drop or not inside[up]
            elif self.tag[up] == "header" and inside[up]:
                drop = drop or tag not in HEADINGS and tag not in ("hgroup", "div") and not self.headline[e]
            if attrs and not drop:
                drop = "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")))
                label = f"{attrs.get('class', '')} {attrs.get('id', '')}"
                if not drop and label != " " and tag not in ("html", "body"):
                    words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", label)}
                    if root or self.headline[e]:
                        drop = tag == "article" and bool({w.lower() for w in label.split()} & COMMENTS)
                    else:
                        drop = bool(words & NAMES) or bool(PAIRS.search(label))
            out.append(drop)
        return out

    def candidates(self) -> set[int]:
        """Hashes of the subtrees that may be template."""
        whole = self.size[0]
        return {self.digest[e] for e in range(1, len(self.tag)) if self.size[e] and not self.headline[e] and 2 * self.size[e] < whole and (self.tag[e] in CONTAINERS or self.tag[e] in BLOCKS and ("class" in self.attrs[e] or "id" in self.attrs[e]))}

    def main_text(self, template: Callable[[int], bool]) -> str:
        """The article's blocks, a line each; ``template`` tells the hashes of template subtrees."""
        may, gone = self.candidates(), self.named_aside()
        which = {h for h in may if template(h)}
        roots: dict[str, list[int]] = {"article": [], "main": []}
        within = {"article": [False] * len(gone), "main": [False] * len(gone)}
        for e in range(1, len(gone)):
            up = self.parent[e]
            gone[e] = gone[e] or gone[up] or self.digest[e] in which
            if not gone[e] and self.size[e]:
                kind = "main" if self.attrs[e].get("role", "").lower() == "main" else self.tag[e]
                if kind in roots and not within[kind][up]:
                    roots[kind].append(e)
                    within[kind][e] = True
            for inside in within.values():
                inside[e] = inside[e] or inside[up]
        area = next((within[kind] for kind in ("article", "main") if roots[kind]), None)
        lines, line = [], []
        for e, text in [*self.texts, (0, "")]:
            if not text and self.tag[e] == "br":
                text = " "
            if not text:
                lines.append(" ".join("".join(line).split()))
                line = []
            elif not gone[e] and (area is None or area[e]):
                line.append(text)
        return "\n".join(x for x in lines if x)


def _mark(host: str, digest: int) -> int:
    """A template of a host as one number."""
    return int.from_bytes(blake2b(host.encode("utf-8", "replace") + digest.to_bytes(8, "big", signed=True), digest_size=8).digest(), "big", signed=True)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (host, page, mark) for every candidate subtree, and one with mark null for every page."""
    for batch in batches:
        hosts, pages, marks = [], [], []
        for host, page, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            own = [None, *(_mark(host, h) for h in Page(text or "").candidates())]
            hosts += [host] * len(own)
            pages += [page] * len(own)
            marks += own
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(marks, pa.int64())], names=["_host", "_page", "_mark"])


def _extractor(templates: np.ndarray | None):
    """Texts of pages (id, url, host, html[, marks]); ``templates``: the sorted marks of all hosts, or None where pages bring theirs."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            own = batch.column(4).to_pylist() if templates is None else [None] * batch.num_rows
            for host, text, marks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), own, strict=True):
                if templates is None:
                    there = set(marks or [])
                    known = lambda h, host=host, there=there: _mark(host, h) in there
                else:
                    known = lambda h, host=host: len(templates) > 0 and templates[min(int(np.searchsorted(templates, m := _mark(host, h))), len(templates) - 1)] == m
                texts.append(Page(text or "").main_text(known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["_id", "_url", "text"])

    return step


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 3, share: float = 0.1, most: int = 2_000_000) -> DataFrame:
    """One row per page: its id and url columns, and ``text``, the blocks of the main text, a line each."""
    plain = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host_of(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html"))
    page = F.xxhash64(F.coalesce("_url", F.lit("")))
    with text_batches(pages.sparkSession):
        seen = plain.select("_host", page.alias("_page"), "_html").mapInArrow(tidy(_candidates), "_host string, _page long, _mark long")
        # A page's rows are distinct before pages are counted, so a host with most pages has one row a mark and task.
        counted = cut(seen.distinct().groupBy("_host", "_mark").agg(F.count("*").alias("_n")), "subtrees")
    # A mark's host is part of its hash, so marks of two hosts differ; counts of hosts are few.
    whole = counted.where("_mark is null").select(F.col("_host").alias("_of"), F.col("_n").alias("_pages"))
    often = counted.where(F.col("_mark").isNotNull() & (F.col("_n") >= least)).join(whole, F.col("_host") == F.col("_of"))
    often = cut(often.where(F.col("_n") >= F.lit(share) * F.col("_pages")).select("_mark"), "templates")
    kind = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    schema = f"_id {kind[id_col]}, _url {kind[url_col]}, text string"
    if often.limit(most + 1).count() <= most:
        marks = np.sort(np.fromiter((r[0] for r in often.toLocalIterator()), np.int64))
        out = plain.select("_id", "_url", "_host", "_html").mapInArrow(tidy(_extractor(marks)), schema)
    else:
        key = lambda t: F.unhex(F.sha2(F.concat_ws("\0", F.lit(""), "_host", F.coalesce(t, F.lit(""))), 256))
        keyed = plain.withColumn("_key", key(F.col("_html")))

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, own = [], []
                for k, host, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                    found = [_mark(host, h) for h in Page(text or "").candidates()]
                    keys += [k] * len(found)
                    own += found
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(own, pa.int64())], names=["_key", "_mark"])

        of_page = keyed.select("_key", "_host", "_html").mapInArrow(tidy(listed), "_key binary, _mark long").distinct()
        lists = of_page.join(often, "_mark", "left_semi").groupBy("_key").agg(F.collect_list("_mark").alias("_marks"))  # at most a page's own subtrees
        out = keyed.join(lists, "_key", "left").select("_id", "_url", "_host", "_html", "_marks").mapInArrow(tidy(_extractor(None)), schema)
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text")
