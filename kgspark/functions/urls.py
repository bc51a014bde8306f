"""URL functions; the scope of a crawl is a parameter."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """Exact host (with port, as written), path prefixes within scope, and prefixes that are tested first and excluded."""

    host: str
    allowed: tuple[str, ...]
    excluded: tuple[str, ...] = ()


#: File endings that are no pages, that are images, and that have names of their own.
FILES = "pdf png jpg jpeg gif svg webp mp4 mp3 zip pptx ppt docx doc css js json xml rss".split()
IMAGES = "png jpg jpeg gif svg webp".split()
NAMED = "png jpg jpeg gif svg webp pdf".split()

_PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)"


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def without_fragment(url: Column) -> Column:
    """Fragment dropped, then every trailing slash, unless the url ends in ://."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.when(bare.endswith("/") & ~bare.endswith("://"), F.regexp_replace(bare, "/+$", "")).otherwise(bare)


def without_dots(path: Column) -> Column:
    """A path without empty, `.` and `..` segments, the latter with the segment before them; a slash at the end stays."""
    parts = F.filter(F.split(path, "/", -1), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    end = F.when(path.rlike(r"(?:/|/\.\.?)$") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def resolve(href: Column, base: Column) -> Column:
    """Absolute, scheme-relative, root-relative, query-only and plain relative links against base; paths put together here have no dot segments."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    own = F.regexp_extract(base, r"^([^?#]*)", 1)
    way, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"([?#].*)?$", 0)
    down = F.concat(F.substring(folder, F.length(origin) + 1, F.length(folder)), way)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, without_dots(way), rest))
        .when(href == "", base)
        .when(href.startswith("?") | href.startswith("#"), F.concat(own, href))
        .otherwise(F.concat(origin, without_dots(down), rest))
    )


def normalize(href: Column, base: Column | None = None) -> Column:
    return without_fragment(href if base is None else resolve(href, base))


def _ends(low: Column, names: list[str]) -> Column:
    return low.rlike(r"\.(?:" + "|".join(names) + ")$")


def within_scope(url: Column, scope: Scope) -> Column:
    p = path(url)
    any_of = lambda xs: F.lit(False) if not xs else reduce(lambda a, b: a | b, [p.startswith(x) for x in xs])
    return (authority(url) == scope.host) & ~any_of(scope.excluded) & any_of(scope.allowed)


def internal_page(url: Column, scope: Scope) -> Column:
    return within_scope(url, scope) & ~_ends(F.lower(path(url)), FILES)


def classify(url: Column, scope: Scope) -> Column:
    low, host = F.lower(path(url)), authority(url)
    return (
        F.when(host.contains("youtube.com") | host.contains("youtu.be"), "video")
        .when(low.endswith(".pdf"), "pdf")
        .when(_ends(low, IMAGES), "image")
        .when(within_scope(url, scope), "internal")
        .otherwise("external")
    )


def short_hash(url: Column, n: int = 12) -> Column:
    return F.substring(F.md5(url), 1, n)


def extension(url: Column) -> Column:
    return F.regexp_extract(F.lower(path(url)), r"(\.(?:" + "|".join(NAMED) + "))$", 1)


def video_id(url: Column) -> Column:
    host = authority(url)
    by_query = F.regexp_extract(url, r"v=([A-Za-z0-9_-]+)", 1)
    embed = F.regexp_extract(path(url), r"/embed/([^/?]*)", 1)
    return F.when(host == "youtu.be", F.regexp_replace(path(url), "^/+|/+$", "")).when(
        host.contains("youtube.com"), F.when(by_query != "", by_query).when(path(url).contains("/embed/"), embed)
    )


def resource_type(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(url.isNull() | (url == ""), "unknown")
        .when(low.contains("youtube") | low.contains("youtu.be"), "video")
        .when(low.endswith(".pdf"), "pdf")
        .when(low.endswith(".pptx") | low.endswith(".ppt"), "slide")
        .otherwise("web")
    )


def image_path(url: Column, filename: Column) -> Column:
    """Short hash and the file name's lower-cased ending, .png if it has none."""
    ending = F.lower(F.regexp_extract(filename, r"[^./](\.[^./]+)$", 1))
    return F.concat(short_hash(url), F.when(ending != "", ending).otherwise(F.lit(".png")))
