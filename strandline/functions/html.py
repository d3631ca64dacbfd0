"""Page expressions over raw HTML: text, links, language, title.

Every pattern passes over a page once.  What is opened and never closed (a
comment, script, tag, quote or title) reaches to the end of the page, as it does in
a browser, so no opener is scanned from twice."""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside of a tag up to its '>', which quotes may hold too.
INSIDE = r"""(?:[^>"']++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+>?"""
TAG = r"(?s)<[a-zA-Z/!?]" + INSIDE
HIDDEN = (
    r"(?is)<!--(?:.*?-->|.*\z)"
    r"|<script\b(?:.*?</script(?=[\s/>])[^<>]*+>?|.*\z)"
    r"|<style\b(?:.*?</style(?=[\s/>])[^<>]*+>?|.*\z)"
)

REFERENCE = r"&(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[a-zA-Z][a-zA-Z0-9]*);"
#: The 252 named references of HTML 4, and the one that XHTML adds.
NAMED = {**{name: chr(point) for name, point in name2codepoint.items()}, "apos": "'"}
#: What numbers 128 to 159 stand for, where not themselves.
WINDOWS = {
    128: "€", 130: "‚", 131: "ƒ", 132: "„", 133: "…", 134: "†", 135: "‡", 136: "ˆ", 137: "‰", 138: "Š", 139: "‹", 140: "Œ", 142: "Ž",
    145: "‘", 146: "’", 147: "“", 148: "”", 149: "•", 150: "–", 151: "—", 152: "˜", 153: "™", 154: "š", 155: "›", 156: "œ", 158: "ž", 159: "Ÿ",
}


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _character(reference: Column) -> Column:
    """What stands for ``&reference;``; null for a name that is not known."""
    digits = F.when(reference.rlike("^#[xX]"), F.conv(F.substring(reference, 3, 8), 16, 10)).otherwise(F.substring(reference, 2, 9))
    point = digits.cast("bigint")
    unsound = (point == 0) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF)
    spelled = F.decode(F.unhex(F.lpad(F.hex(F.when(unsound, F.lit(0xFFFD)).otherwise(point)), 8, "0")), "UTF-32")
    numbered = F.coalesce(F.element_at(_literal_map(WINDOWS), point.cast("int")), spelled)
    return F.when(reference.startswith("#"), numbered).otherwise(F.element_at(_literal_map(NAMED), reference))


def unescape(text: Column) -> Column:
    """Character references decoded, in one pass: what they give is not read again."""
    between = F.split(text, REFERENCE)
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    given = F.transform(found, lambda r: F.coalesce(_character(r), F.concat(F.lit("&"), r, F.lit(";"))))
    decoded = F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("b"), given.alias("g")), lambda x: F.array(x["b"], F.coalesce(x["g"], F.lit(""))))), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


def visible(html: Column) -> Column:
    """HTML without comments, scripts and styles."""
    return F.regexp_replace(html, HIDDEN, " ")


def text_of(html: Column) -> Column:
    """The text a reader sees, white space collapsed."""
    text = unescape(F.regexp_replace(visible(html), TAG, " "))
    return F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " "))


#: One attribute of a tag: its name, and its value if it has one.
ATTRIBUTE = r"""(?s)[\s"'/]([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?"""


def _names(tag: Column) -> Column:
    return F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), F.lower)


def attribute(tag: Column, name: str) -> Column:
    """The attribute's value in an opening tag: quoted either way or bare; '' if
    it has none.  Attributes are read in turn, so none is found inside another."""
    values = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2))
    place = F.array_position(_names(tag), name.lower()).cast("int")
    found = F.coalesce(F.get(values, place - 1), F.lit(""))
    return unescape(F.regexp_replace(found, r"^[\"']|[\"']$", ""))


PART = r"""\.[\w-]+|\#[\w-]+|\[[\w-]+(?:=(?:"[^"]*"|'[^']*'|[\w-]+))?\]"""
RULE = re.compile(rf"^\s*([a-zA-Z][a-zA-Z0-9-]*|\*)?((?:{PART})*)\s*->\s*@?([a-zA-Z-]+)\s*$")


def _condition(tag: Column, part: str) -> Column:
    """Does an opening tag meet ``.class``, ``#id``, ``[attr]`` or ``[attr=value]``?"""
    if part[0] == ".":
        return F.array_contains(F.split(attribute(tag, "class"), r"\s+"), part[1:])
    if part[0] == "#":
        return attribute(tag, "id") == part[1:]
    name, equals, value = part[1:-1].partition("=")
    if equals:
        return attribute(tag, name) == value.strip("\"'")
    return F.array_contains(_names(tag), name.lower())


def link_values(html: Column, rule: str) -> Column:
    """All values that a rule selects: a selector of one element (tag or ``*``,
    ``.class``, ``#id``, ``[attr]``, ``[attr=value]``), ``->`` and an attribute.
    Selectors that look at other elements are refused."""
    match = RULE.match(rule)
    if not match or not (match[1] or match[2]):
        raise ValueError(f"unsupported link rule {rule!r}: use one element's selector, as in a.nav[href]->href")
    tag, parts, wanted = match.groups()
    name = "[a-zA-Z][a-zA-Z0-9-]*" if tag in (None, "*") else tag
    tags = F.regexp_extract_all(visible(html), F.lit(TAG), F.lit(0))  # all, since a tag may stand in another's quotes

    def keep(t: Column) -> Column:
        cond = t.rlike(rf"(?is)^<{name}[\s/]") & t.endswith(">") & F.array_contains(_names(t), wanted.lower())
        for part in re.findall(PART, parts):
            cond = cond & _condition(t, part)
        return cond

    return F.transform(F.filter(tags, keep), lambda t: F.trim(attribute(t, wanted)))


def base_href(html: Column) -> Column:
    """Where the first ``<base href>`` points; '' if there is none."""
    return F.coalesce(F.get(link_values(html, "base[href]->href"), 0), F.lit(""))


def language(html: Column) -> Column:
    """The ``lang`` of the root element, primary subtag, lower case; '' if none."""
    return F.lower(F.regexp_extract(html, r"(?is)<html\b[^<>]*?\slang\s*=\s*[\"']?([a-zA-Z]+)", 1))


def title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title\b[^<>]*+>(.*?)(?:</title|\z)", 1)
    return F.trim(F.regexp_replace(unescape(found), r"[\s\u00a0]+", " "))
