"""Parsing of crawled pages: title, main text, links and images, in one Arrow pass."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import urls

#: What is cut before the main text, what has no end tag, and class words of a content element.
CUT = {"script", "style", "nav", "footer", "header", "aside"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = re.compile("content|main|post|article", re.I)
PARSED = "url string, title string, content string, hrefs array<struct<pos:int,href:string>>, images array<struct<pos:int,src:string,alt:string,context:string>>, error string"


class _Tree(HTMLParser):
    """A light tree: nodes are [name, attributes, children, parent]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = ["", {}, [], None]

    def handle_starttag(self, name, attrs):
        node = [name, dict(attrs), [], self.here]
        self.here[2].append(node)
        if name not in VOID:
            self.here = node

    def handle_startendtag(self, name, attrs):
        self.here[2].append([name, dict(attrs), [], self.here])

    def handle_endtag(self, name):
        node = self.here
        while node is not self.root and node[0] != name:
            node = node[3]
        if node is not self.root:
            self.here = node[3]

    def handle_data(self, data):
        self.here[2].append(data)


def _walk(node) -> Iterator:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        if not isinstance(x, str):
            stack.extend(reversed(x[2]))


def _texts(node, cut: bool) -> list[str]:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x.strip():
                out.append(x.strip())
        elif not (cut and x[0] in CUT):
            stack.extend(reversed(x[2]))
    return out


def _find(root, test, cut: bool = False):
    stack = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str) or (cut and x[0] in CUT):
            continue
        if test(x):
            return x
        stack.extend(reversed(x[2]))
    return None


def _context(img) -> str:
    up = img[3]
    while up is not None and up[0] != "figure":
        up = up[3]
    caption = _find(up, lambda x: x[0] == "figcaption") if up else None
    if caption is not None:
        return " ".join(_texts(caption, False))
    up = img[3]
    while up is not None and up[0] not in ("p", "div", "section", "article", "body"):
        up = up[3]
    if up is None or up[0] not in ("p", "div"):
        return ""
    text = " ".join(_texts(up, False))
    return text[:500] + "..." if len(text) > 500 else text


def parse_page(html: str | None) -> tuple:
    """(title, content, hrefs, images) of a page."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    root = tree.root
    title = next((" ".join(_texts(x, False)) for name in ("title", "h1") if (x := _find(root, lambda n, name=name: n[0] == name)) is not None and _texts(x, False)), "Untitled")
    hrefs, images = [], []
    for x in _walk(root):
        if isinstance(x, str):
            continue
        if x[0] == "a" and (h := (x[1].get("href") or "").strip()) and not h.startswith(("javascript:", "mailto:", "tel:", "#")):
            hrefs.append({"pos": len(hrefs), "href": h})
        if x[0] == "img" and (s := (x[1].get("src") or "").strip()) and not s.startswith("data:"):
            images.append({"pos": len(images), "src": s, "alt": x[1].get("alt") or "", "context": _context(x)})
    tests = (lambda x: x[0] == "main", lambda x: x[0] == "article", lambda x: bool(CONTENT.search(x[1].get("class") or "")), lambda x: x[0] == "body")
    main = next((x for t in tests if (x := _find(root, t, True)) is not None), root)
    content = re.sub(r" {2,}", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(_texts(main, True)))).strip()
    return title, content, hrefs, images


def parsed_rows(batches: Iterator[pd.DataFrame], most: int = 128) -> Iterator[pd.DataFrame]:
    """PARSED rows of (url, html), at most `most` at once, so that a batch's results are never held together."""
    for b in batches:
        for i in range(0, len(b), most):
            rows = []
            for u, h in zip(b["url"].iloc[i : i + most], b["html"].iloc[i : i + most]):
                try:
                    rows.append((u, *parse_page(h), None))
                except Exception as e:  # noqa: BLE001  one page must not end the job
                    rows.append((u, None, None, [], [], str(e)))
            yield pd.DataFrame(rows, columns=["url", "title", "content", "hrefs", "images", "error"])


def parse_pages(pages: DataFrame) -> DataFrame:
    """(url, html) → PARSED rows; a page that fails has an error and nothing else."""
    return pages.select("url", "html").mapInPandas(parsed_rows, PARSED)


def page_links(parsed: DataFrame, scope: urls.Scope, once: bool = True) -> DataFrame:
    """(url, pos, link, kind): links of each page, made absolute and bare, the first place of each (or, unless once, every place); images count as external."""
    rows = parsed.where("error is null").select("url", F.explode("hrefs").alias("h")).select("url", F.col("h.pos").alias("pos"), urls.normalize(F.col("h.href"), F.col("url")).alias("link"))
    kind = urls.classify(F.col("link"), scope)
    if once:
        rows = rows.groupBy("url", "link").agg(F.min("pos").alias("pos"))
    return rows.select("url", "pos", "link", F.when(kind == "image", "external").otherwise(kind).alias("kind"))


def links_found(links: DataFrame) -> DataFrame:
    """(url, internal, pdf, video, external): a page's links by kind, in order."""
    kinds = ("internal", "pdf", "video", "external")
    pick = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "link")))), lambda x: x["link"]).alias(k)
    return links.groupBy("url").agg(*[pick(k) for k in kinds])


def page_images(parsed: DataFrame) -> DataFrame:
    """(page_url, url, alt_text, context, original_filename), once per page."""
    i = parsed.where("error is null").select(F.col("url").alias("page_url"), F.explode("images").alias("i"))
    rows = i.select("page_url", urls.normalize(F.col("i.src"), F.col("page_url")).alias("url"), "i.pos", "i.alt", "i.context")
    first = rows.groupBy("page_url", "url").agg(F.min_by(F.struct("alt", "context"), "pos").alias("x"))
    return first.select("page_url", "url", F.col("x.alt").alias("alt_text"), "x.context", F.regexp_extract("url", r"([^/?]*)(?:\?.*)?$", 1).alias("original_filename"))


def linking_to_pdfs(found: DataFrame) -> DataFrame:
    return found.where(F.size("pdf") > 0).select("url", F.size("pdf").alias("pdfs"))
