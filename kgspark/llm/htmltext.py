"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements, told apart by their path from the root,
and the texts of its leaves, told apart by path and wording. Tokens whose
occurrence vectors over the distinct pages of a host are equal make an
equivalence class. A class on at least half of the pages is valid if its tokens
have an order and lie in one gap of each class around it; valid classes nested
so are the host's template, and the gaps between their tokens are its slots. The
article is what the slots of one template element hold. Texts of the template
itself are left out unless they stand inside an article or main element: a note
that many articles of a host share belongs to each of them. Element names decide
what the template leaves open: which of the slots' texts are surroundings that
differ from page to page. Occurrence vectors are compared by a commutative 64-bit
digest, so that no host is gathered in one place: counts and digests are
combined before the shuffle.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import materialize

#: Element names by what they mean for the layout of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("script style textarea title xmp iframe noembed noframes noscript head template form button select option svg canvas audio video dialog".split())
ASIDE = frozenset("nav footer aside menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption li dd dt".split())
ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Words of class, id and role values that mark what is not the article.
MARKS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar side aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner notice notices cookie cookies consent gdpr alert popup modal "
    "newsletter subscribe signup comment comments reply replies respond disqus discussion share sharing social related recommended breadcrumb breadcrumbs pagination pager widget contentinfo complementary search toolbar".split()
)
#: Words of such values that tell a place or shape of what another word names.
SHAPES = frozenset("box slot list links block bar container wrapper wrap section area inner outer top bottom left right item items unit form button buttons content body panel region group main page site global primary secondary".split())
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(?:/?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[!?][^>]*>)|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


class Element:
    __slots__ = ("name", "marks", "path", "depth", "parent", "hidden", "main", "block", "slot", "chars")

    def __init__(self, name: str, attributes: str, parent: Element | None) -> None:
        self.name, self.parent, self.chars = name, parent, 0
        values = [v.strip("\"'").lower() for _, v in ATTRIBUTE.findall(attributes)] if "=" in attributes else []
        self.marks = {w for v in values for w in SPLIT.split(v) if w}
        inside = parent.main if parent else False
        # inside an article a value counts if all of it says so: related-links does, related-work is of the article
        marked = self.marks & MARKS if not inside else any(names_aside(w) for v in values for w in v.split())
        label = name + "".join("." + v for v in sorted(values) if not any(c.isdigit() for c in v))
        # of the whole path, made step by step
        self.path = digest(label, parent.path) if parent else 0
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if parent is None or name in BLOCKS else parent.block
        self.slot = False
        self.main = inside or name in ("article", "main") or "main" in self.marks and name != "body"
        own = name in HIDDEN or name in ASIDE or (name == "header" and not inside) or (name not in ("html", "body", "article", "main", "h1", "h2", "h3", "p") and bool(marked)) or (name == "article" and bool(self.marks & {"comment", "reply", "related", "teaser", "promo", "ad"}))
        self.hidden = own or (parent.hidden if parent else False)


def names_aside(value: str) -> bool:
    """Is one class, id or role made of words for surroundings and, beside them, shapes and numbers only?"""
    words = [w for w in SPLIT.split(value) if w and not any(c.isdigit() for c in w)]
    return any(w in MARKS for w in words) and all(w in MARKS or w in SHAPES for w in words)


STOPS = frozenset("td th li button article body".split())


def parse(page: str | None) -> Iterator[tuple[str, Element, str]]:
    """("open", element, "") and ("text", parent element, decoded text) in page order, for any string, in time that grows with its length."""
    root = here = Element("", "", None)
    opened: dict[str, int] = defaultdict(int)
    raw, at, page = "", 0, page or ""

    def up(to: Element) -> None:
        """Close elements until `to` is the innermost."""
        nonlocal here
        while here is not to:
            opened[here.name] -= 1
            here = here.parent

    while at < len(page):
        if raw:
            end = re.compile(rf"</{raw}\b[^>]*>?", re.I).search(page, at)
            yield "text", here, page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            up(here.parent)
            raw = ""
            continue
        m = PIECE.match(page, at)
        piece, at = m[0], m.end()
        named = NAME.match(piece)
        if not named:
            if piece[0] != "<" or piece == "<":
                yield "text", here, entities.unescape(piece)
            continue
        name = named[1].lower()
        if piece[1] == "/":
            if opened[name] > 0:
                e = here
                while e.name != name:
                    e = e.parent
                up(e.parent)
            continue
        if opened["p"] > 0 and (name in CLOSES_P or name == "p"):
            e = here
            while e is not root and e.name != "p" and e.name not in STOPS:
                e = e.parent
            if e.name == "p":
                up(e.parent)
        if name in ITEMS and any(opened[n] > 0 for n in (("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,))):
            e = here
            while e is not root and e.name not in ITEMS[name]:
                if e.name == name or (name in ("dt", "dd") and e.name in ("dt", "dd")) or (name in ("td", "th") and e.name in ("td", "th")):
                    up(e.parent)
                    break
                e = e.parent
        element = Element(name, piece[named.end() : -1], here)
        yield "open", element, ""
        if name not in VOID and not piece.endswith("/>"):
            here = element
            opened[name] += 1
            raw = name if name in RAW else ""


def digest(s: str, seed: int = 0) -> int:
    """62-bit token of a string after what seed stands for."""
    data = s.encode("utf-8", "surrogatepass")
    return zlib.crc32(data, seed & 0x7FFFFFFF) << 31 ^ zlib.crc32(data[::-1], (seed >> 31) ^ 0x5BD1E995)


def text_token(e: Element, words: list[str]) -> int:
    return digest("\n" + " ".join(words), e.path)


def page_tokens(page: str | None) -> dict[int, list]:
    """token → [count, first place, depth, characters below it that are not hidden, kind (1: main, 2: a heading), is it text, token of the element around it]."""
    out: dict[int, list] = {}
    elements: list[Element] = []
    for place, (kind, e, text) in enumerate(parse(page), 1):
        if kind == "open":
            elements.append(e)
            t = out.setdefault(e.path, [0, place, e.depth, 0, 0 if e.hidden else 1 if e.main else 2 * (e.name in HEADINGS), 0, e.parent.path])
            t[0] += 1
            continue
        words = text.split()
        if not words or e.name in RAW:
            continue
        t = out.setdefault(text_token(e, words), [0, place, e.depth + 1, 0, 0, 1, e.path])
        t[0] += 1
        if not e.hidden:
            e.chars += len(text)
            t[3] += len(text)
    for e in reversed(elements):  # children come after their parents
        out[e.path][3] += e.chars
        e.parent.chars += e.chars
    return out


class Row(NamedTuple):
    """A token on the pages of a host; text: it is one, and no element; times: occurrences on all of the pages."""

    token: int
    vector: int
    pages: int
    place: float
    depth: int
    chars: int
    main: int
    text: int
    times: int
    parent: int


class Gap:
    """Part of a page between two tokens of a class around it, and the classes in it."""

    def __init__(self) -> None:
        self.classes: list[tuple[list[float], list[Gap]]] = []

    def take(self, places: list[float]) -> bool:
        """Nest a class here or deeper; False if it lies across a token of a class that is here."""
        for around, gaps in self.classes:
            k = {bisect_right(around, p) for p in places}
            if len(k) > 1:
                return False
            (k,) = k
            if 0 < k < len(around):  # between the first and the last token of that class
                return gaps[k].take(places)
        self.classes.append((places, [Gap() for _ in range(len(places) + 1)]))
        return True


class Template:
    """Nested valid classes of a host, and the element whose slots hold the article."""

    def __init__(self, pages: int, rows: list[tuple], least: int = 4) -> None:
        """rows: tuples of Row's fields; texts of fewer than `least` pages are not taken for the template's."""
        by: dict[int, list[Row]] = defaultdict(list)
        for r in map(Row._make, rows):
            if 2 * r.pages >= pages:
                by[r.vector].append(r)
        whole, self.texts, once = Gap(), set(), []
        below: dict[int, int] = defaultdict(int)  # characters of the template's own texts
        for members in sorted(by.values(), key=lambda m: (-m[0].pages, -len(m), m[0].vector)):
            places = sorted(r.place for r in members)
            if len(set(places)) < len(places) or not whole.take(places):
                continue
            once += [r for r in members if not r.text and r.times == r.pages]
            for r in members:
                if r.text and r.pages >= least:
                    self.texts.add(r.token)
                    below[r.parent] += r.chars
        for r in sorted((r for m in by.values() for r in m if not r.text), key=lambda r: -r.depth):
            below[r.parent] += below[r.token]
        self.main = self._main({r.token: r for r in once}, {r.token: r.chars - below[r.token] for r in once}) if pages > 1 else None

    @staticmethod
    def _main(once: dict[int, Row], held: dict[int, int]) -> int | None:
        """The element whose slots hold the article: the outermost named so, if it holds most; else the one that the way from the root to most of the text leads to, up to a heading."""
        top = max(held.values(), default=0)
        if top <= 0:
            return None
        named = [t for t, r in once.items() if r.main == 1 and held[t] >= 0.6 * top]
        if named:
            return min(named, key=lambda t: (once[t].depth, -held[t], t))
        inner: dict[int, list[int]] = defaultdict(list)
        for t, r in once.items():
            inner[r.parent].append(t)
        here = min((t for t in once if held[t] == top), key=lambda t: (once[t].depth, t))
        while (kids := inner[here]) and not any(once[t].main == 2 and held[t] > 0 for t in kids):
            best = max(kids, key=lambda t: (held[t], -t))
            if held[best] < 0.75 * held[here]:
                break
            here = best
        return here


def extract(page: str | None, template: Template | None = None) -> str:
    """Blocks of the article, one a line.

    The region is what lies in the slots of the template's main element, without
    the template's own texts that no article or main element holds. Of that, hidden elements and those marked as
    surroundings do not count; if any of it lies in article or main elements,
    only that does. A page without that element goes by such elements, or as a
    whole.
    """
    blocks: dict[str, list[str]] = {"main": [], "slot": [], "named": [], "body": []}
    parts: dict[str, list[str]] = {k: [] for k in blocks}

    def end() -> None:
        for kind, xs in parts.items():
            words = "".join(xs).split()
            xs.clear()
            if words:
                blocks[kind].append(" ".join(words))

    slots = template is not None and template.main is not None
    texts = template.texts if template is not None else ()
    last = None
    for kind, e, text in parse(page):
        if kind == "open":
            e.slot = e.parent.slot or slots and e.path == template.main
            if e.name in BLOCKS:
                end()
                last = e
            elif e.name == "br":
                for xs in parts.values():
                    xs.append(" ")
            continue
        if e.block is not last:
            end()
            last = e.block
        if e.hidden or texts and not e.main and (words := text.split()) and text_token(e, words) in texts:
            continue
        parts["body"].append(text)
        for kind, inside in (("main", e.slot and e.main), ("slot", e.slot), ("named", e.main)):
            if inside:
                parts[kind].append(text)
    end()
    return "\n".join(blocks["main"] or blocks["slot"] or blocks["named"] or blocks["body"])


TOKENS = "host string, page long, token long, n int, place int, depth int, chars long, main int, text int, parent long"


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, rows array): tokens on at least half of a host's distinct pages, with the digest of their occurrence vectors.

    Their number is at most twice the tokens of a page, however many pages a host has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, p, t, *v) for h, p, x in zip(b["host"], b["page"], b["html"]) for t, v in page_tokens(x).items()]
            rows += [(h, p, -1, 1, 0, 0, 0, 0, 0, 0) for h, p in zip(b["host"], b["page"])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TOKENS.split(", ")])

    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit(""))
    named = pages.select(host.alias("host"), F.xxhash64(html_col).alias("page"), F.col(html_col).alias("html"))
    # equal pages of a host count once
    tokens = named.mapInPandas(run, TOKENS).dropDuplicates(["host", "page", "token"])
    counted = tokens.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.avg("place").alias("place"), F.min("depth").alias("depth"), F.sum("chars").alias("chars"), F.max("main").alias("main"), F.max("text").alias("text"), F.sum("n").alias("times"), F.min("parent").alias("parent")
    )
    counted = materialize(counted, "tokens")
    totals = counted.where("token = -1").select("host", F.col("pages").alias("total"))
    kept = counted.where("token <> -1 and pages > 1").join(totals, "host").where("pages * 2 >= total and total > 1")
    return kept.groupBy("host").agg(F.first("total").alias("pages"), F.sort_array(F.collect_list(F.struct(*Row._fields))).alias("rows"))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row.

    Null and empty pages, and pages without text, give ""; null urls share the
    host ""; a host's only page has no template and goes by its elements alone;
    repeated rows stay. Templates are broadcast if their measured size is at
    most broadcast_bytes, and joined by host otherwise, hot hosts being split at
    run time.
    """
    found = materialize(templates(pages, url_col, html_col), "templates")
    size = found.agg(F.sum(F.size("rows") * 80 + F.length("host"))).first()[0] or 0
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    # the template as one value, so that a row of it costs little beside its page
    packed = found.select("host", "pages", F.to_json("rows").alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        seen: dict[str, Template | None] = {}
        for b in batches:
            texts = []
            for h, n, r, x in zip(b["host"], b["pages"], b["rows"], b["html"]):
                if h not in seen:
                    if len(seen) > 1000:
                        seen.clear()
                    seen[h] = Template(int(n), [tuple(t[k] for k in Row._fields) for t in json.loads(r)]) if r else None
                texts.append(extract(x, seen[h]))
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    joined = rows.join(F.broadcast(packed) if size <= broadcast_bytes else packed, "host", "left")
    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")
