"""URL expressions.  Column in, Column out; all stay inside generated code."""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
# Scheme, user info, then a bracketed or a plain host: everything before the port.
_HOST_PART = r"://(?:[^/?#]*@)?(?:\[[^\]/?#]*\]|[^/?#:@\[]*)"
DEFAULT_PORT = rf"^(?:((?i:https){_HOST_PART}):0*443|((?i:http){_HOST_PART}):0*80)([/?#]|$)"
HAS_PORT = rf"^(?i:https?){_HOST_PART}:[^/?#@]*(?:[/?#]|$)"
GOOD_PORT = rf"^(?i:https?){_HOST_PART}:" + (
    r"(?:0*(?:[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5]))?(?:[/?#]|$)"
)
UNPAIRED = r"^[^:/?#]*://(?:[^/?#\]]*\[[^/?#\]]*|[^/?#\[]*\][^/?#\[]*)(?:[/?#]|$)"
BRACKETED = r"^[^:/?#]*://(?:[^/?#]*@)?\["
_H = "[0-9a-fA-F]{1,4}"
_V4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"


def _six() -> str:
    """An IPv6 address: eight groups, or fewer around one '::'; the last two may
    be dotted."""
    forms = [f"(?:{_H}:){{7}}{_H}", f"(?:{_H}:){{6}}{_V4}"]
    for left in range(8):
        before = f"{_H}(?::{_H}){{{left - 1}}}" if left else ""
        after = [f"{_H}(?::{_H}){{0,{6 - left}}}"] * (left < 7) + [f"(?:{_H}:){{0,{5 - left}}}{_V4}"] * (left < 6)
        forms.append(f"{before}::(?:{'|'.join(after)})?" if after else f"{before}::")
    return "|".join(forms)


#: A bracketed host that is one: an IPv6 address, with a zone maybe, or a later kind.
GOOD_BRACKETS = rf"^[^:/?#]*://(?:[^/?#]*@)?\[(?:(?:{_six()})(?:%[^\]/?#]+)?|v[0-9a-fA-F]+\.[^\]/?#]+)\](?:[:/?#]|$)"
INNER_BRACKET = r"^[^:/?#]*://(?:[^/?#]*@)?[^/?#@\[]+\["
#: Characters that compatibility normalisation turns into marks of a URL.
_TURNING = "".join(c for c in map(chr, range(0x80, 0x10000)) if set(unicodedata.normalize("NFKC", c)) & set("/?#@:"))
TURNED_MARK = rf"^[^:/?#]*://[^/?#]*[{_TURNING}]"
EDGE_SPACE = r"^[\x00-\x20]+|[\t\r\n]"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]*)"
FILE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), SCHEME, 1))


def host(url: Column | str) -> Column:
    """Host without user info and port, lower case; '' if there is none."""
    return F.lower(F.regexp_extract(_col(url), HOST, 1))


def origin(url: Column | str) -> Column:
    """scheme://host[:port], scheme and host in lower case."""
    return F.lower(F.regexp_extract(_col(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))


def directory(url: Column | str) -> Column:
    """The URL up to and including the last slash of its path."""
    bare = F.regexp_replace(_col(url), r"[?#].*$", "")
    whole = F.when(bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*$"), F.concat(bare, F.lit("/"))).otherwise(bare)
    return F.regexp_replace(whole, r"[^/]*$", "")


def bad_url(url: Column | str) -> Column:
    """An http(s) port that is no number up to 65535, brackets that are unpaired or
    hold no address, or a host that normalisation would cut elsewhere."""
    url = _col(url)
    brackets = url.rlike(UNPAIRED) | url.rlike(INNER_BRACKET) | (url.rlike(BRACKETED) & ~url.rlike(GOOD_BRACKETS))
    brackets = (url.contains("[") | url.contains("]")) & brackets  # byte tests come first
    turned = (F.octet_length(url) != F.length(url)) & url.rlike(TURNED_MARK)
    return (url.rlike(HAS_PORT) & ~url.rlike(GOOD_PORT)) | brackets | turned


def unusable(url: Column | str) -> Column:
    """Does :func:`clean_url` give null for this URL, which is not null?"""
    url = _col(url)
    return url.isNotNull() & ~_plain(url) & bad_url(F.regexp_replace(url, EDGE_SPACE, ""))


def _plain(url: Column) -> Column:
    """True only for URLs that :func:`clean_url` leaves alone.  Byte tests, so
    most URLs never meet a regular expression."""
    marks = [url.contains(c) for c in (";", "?#", "[", "]", "\t", "\r", "\n")]
    marks += [url.endswith("#"), url.endswith("?"), F.locate(":", url, 7) > 0]
    odd = marks[0]
    for mark in marks[1:]:
        odd = odd | mark
    odd = odd | (F.octet_length(url) != F.length(url))
    return (url.startswith("https://") | url.startswith("http://")) & ~odd


def clean_url(url: Column | str) -> Column:
    """Drop the default port and re-serialise: scheme in lower case, no empty
    parameter, query or fragment mark.  The host keeps its letter case.  URLs
    with an unusable port give null."""
    url = _col(url)
    raw = F.regexp_replace(url, EDGE_SPACE, "")
    name = F.regexp_extract(raw, SCHEME, 1)
    out = F.concat(F.lower(name), F.substring(raw, F.length(name) + 1, F.length(raw)))
    for pattern, keep in (
        (DEFAULT_PORT, "$1$2$3"),
        (r"^([^#]*)#$", "$1"),
        (r"^([^?#]*)\?(#|$)", "$1$2"),
        (r"^([^?#]*/[^;/?#]*);([?#]|$)", "$1$2"),
    ):
        out = F.regexp_replace(out, pattern, keep)
    return F.when(_plain(url), url).when(~bad_url(raw), out)


def strip_fragment(url: Column | str, allow_hash: bool = False) -> Column:
    """Without ``#...`` unless hash URLs are allowed."""
    return _col(url) if allow_hash else F.substring_index(_col(url), "#", 1)


def entry_path(url: Column | str) -> Column:
    """host + path + query, so http and https share one entry; a root has '/'."""
    file = F.regexp_extract(_col(url), FILE, 1)
    return F.concat(host(url), F.when(file.startswith("/"), file).otherwise(F.concat(F.lit("/"), file)))


def sort_key(url: Column | str) -> Column:
    """Host labels in reverse, then path and query: one site sorts together."""
    labels = F.array_join(F.reverse(F.split(host(url), r"\.")), ",")
    file = F.regexp_extract(_col(url), FILE, 1)
    return F.concat(labels, F.lit(")"), F.when(file.startswith("/"), file).otherwise(F.concat(F.lit("/"), file)))


def _dotless(path: Column) -> Column:
    """The path with '.' and '..' segments applied."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part == ".", acc)
        .when(part == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(part))),
    )
    tail = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.array_join(kept, "/")
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(joined, tail)).otherwise(path)


class Base(NamedTuple):
    """What relative links need of their page's URL: take it once per page."""

    scheme: Column
    root: Column
    folder: Column
    bare: Column
    whole: Column


def base_of(url: Column | str) -> Base:
    url = _col(url)
    root = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(url, r"[?#].*$", "")
    folder = F.substring(directory(url), F.length(root) + 1, F.length(url) + 1)
    return Base(scheme(url), root, folder, bare, strip_fragment(url))


def resolve(base: Base | Column | str, href: Column | str) -> Column:
    """The absolute URL of a link found on page ``base``."""
    if not isinstance(base, Base):
        base = base_of(base)
    href = F.trim(_col(href))
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.substring(href, F.length(path) + 1, F.length(href))
    return (
        F.when(href.startswith("//"), F.concat(base.scheme, F.lit(":"), href))
        .when(href.startswith("/") & ~href.contains("/."), F.concat(base.root, href))
        .when(href.startswith("/"), F.concat(base.root, _dotless(path), rest))
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("?"), F.concat(base.bare, href))
        .when((href == "") | href.startswith("#"), F.concat(base.whole, href))
        .otherwise(F.concat(base.root, _dotless(F.concat(base.folder, path)), rest))
    )
