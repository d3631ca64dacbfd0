"""Link rules whose selectors look at other elements: descendants, children, siblings.

A page's tags are folded once, with a stack of the open elements.  Every compound of
every selector is a bit.  An open element knows which compounds are met by itself and by
what it lies in, and which by its children so far, so each tag is judged from the top of
the stack, whatever the number of rules.

Elements are as follows.  Void elements hold nothing.  A closing tag closes the innermost
open element of its name with all that is open inside it, or nothing.  ``li``, ``dt`` and
``dd``, ``option``, cells, rows and ``p`` close the one before as in :data:`ENDS`, if that
is innermost.  What lies deeper than :data:`DEPTH` is taken as siblings, so a hostile page
costs no more than a bounded stack for each tag."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import html as H

DEPTH = 256
CHUNK = 256  # tags whose hits are gathered at a time

# Elements without an end, and what an opening tag ends.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = (
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul"
).split()
ENDS = {
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",),
    "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), **{b: ("p",) for b in BLOCKS},
}

_ELEMENT = re.compile(rf"([a-zA-Z][a-zA-Z0-9-]*|\*)?((?:{H.PART})*)")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|(\s+)")
MOST = 62  # compounds of all rules together


@dataclass(frozen=True)
class Chain:
    """Compounds (tag, parts), what joins each to the one before, and the attribute."""

    compounds: tuple[tuple[str | None, tuple[str, ...]], ...]
    joins: tuple[str, ...]
    wanted: str


def parse(rule: str) -> list[Chain]:
    """The selectors of ``selector, selector -> attribute``."""
    bad = ValueError(f"unsupported link rule {rule!r}: use selectors of tags, .class, #id, [attr], [attr=value] joined by ' ', >, + or ~")
    text, arrow, wanted = rule.rpartition("->")
    wanted = wanted.strip().removeprefix("@").lower()
    if not arrow or not re.fullmatch(r"[a-z-]+", wanted):
        raise bad
    chains, at, text = [], 0, text.strip()
    while True:
        compounds, joins = [], []
        while True:
            found = _ELEMENT.match(text, at)
            if not found[0]:
                raise bad
            compounds.append((None if found[1] in (None, "*") else found[1].lower(), tuple(re.findall(H.PART, found[2]))))
            at = found.end()
            joined = _COMBINATOR.match(text, at)
            if not joined or text[joined.end() :].startswith(","):
                break
            joins.append(joined[1] or " ")
            at = joined.end()
        chains.append(Chain(tuple(compounds), tuple(joins), wanted))
        rest = re.compile(r"\s*,\s*").match(text, at)
        if not rest:
            break
        at = rest.end()
    if at != len(text):
        raise bad
    return chains


def _name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z][^\s/>]*)", 1))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


FRAME = "struct<name:string,own:bigint,above:bigint,last:bigint,earlier:bigint>"


def _frame(name: Column, own: Column, above: Column, last: Column, earlier: Column) -> Column:
    return F.struct(name.alias("name"), own.alias("own"), above.alias("above"), last.alias("last"), earlier.alias("earlier"))


def _hits(tags: Column, chains: Sequence[Chain]) -> Column:
    """(place in ``tags``, bits) of the elements that any chain's last compound picks."""
    names, parts, root, final = {}, {}, 0, 0  # bits by tag name, by part
    by_join = dict.fromkeys(" >+~", 0)
    bit = total = 0
    for chain in chains:
        for i, (name, conditions) in enumerate(chain.compounds):
            flag = 1 << bit
            total |= flag
            if i == 0:
                root |= flag
            else:
                by_join[chain.joins[i - 1]] |= flag
            if name:
                names[name] = names.get(name, 0) | flag
            for c in conditions:
                parts[c] = parts.get(c, 0) | flag
            bit += 1
        final |= 1 << (bit - 1)
    if bit > MOST:
        raise ValueError(f"link rules of more than {MOST} elements together")
    named = sum(names.values())

    def meets(tag: Column, name: Column) -> Column:
        """Compounds that the element meets on its own."""
        bits = _long(total & ~named)
        for n, flags in names.items():
            bits = bits.bitwiseOR(F.when(name == n, _long(flags)).otherwise(_long(0)))
        for part, flags in parts.items():
            bits = bits.bitwiseAND(F.when(bits.bitwiseAND(_long(flags)) == 0, _long(-1)).when(H._condition(tag, part), _long(-1)).otherwise(_long(~flags)))
        return bits

    def event(tag: Column, at: Column) -> Column:
        opens = ~tag.startswith("</")
        ends = F.lit(None).cast("array<string>")
        for closed in sorted(set(ENDS.values())):
            openers = [n for n, c in ENDS.items() if c == closed]
            ends = F.when(_name(tag).isin(openers), F.array(*map(F.lit, closed))).otherwise(ends)
        return F.struct(
            at.alias("at"), _name(tag).alias("name"), opens.alias("opens"), ends.alias("ends"),
            F.when(opens, meets(tag, _name(tag))).otherwise(_long(0)).alias("meets"),
        )

    whole = F.filter(F.transform(tags, event), lambda e: e["name"] != "")

    def step(acc: Column, e: Column) -> Column:
        stack = acc["stack"]

        def last_of(test) -> Column:  # the place of the innermost open element, 1 for the root
            return F.array_max(F.transform(stack, lambda f, i: F.when(test(f["name"]), i + 1).otherwise(F.lit(0))))

        size = F.when(e["opens"] & e["ends"].isNull(), F.size(stack)).when(e["opens"], last_of(lambda n: ~F.array_contains(e["ends"], n)))
        size = size.otherwise(_let(last_of(lambda n: n == e["name"]), lambda p: F.when(p > 0, p - 1).otherwise(F.size(stack))))

        def opened(kept: Column) -> Column:
            top = F.element_at(stack, kept)
            shifted = lambda c, join: F.shiftleft(c, 1).bitwiseAND(_long(by_join[join]))
            joined = _long(root)
            for c, join in (("above", " "), ("own", ">"), ("last", "+"), ("earlier", "~")):
                if by_join[join]:
                    joined = joined.bitwiseOR(shifted(top[c], join))

            def pushed(own: Column) -> Column:
                parent = _frame(top["name"], top["own"], top["above"], own, top["earlier"].bitwiseOR(own))
                child = _frame(e["name"], own, top["above"].bitwiseOR(own), _long(0), _long(0))
                alone = e["name"].isin(*VOID) | (kept > DEPTH)
                grown = F.concat(F.slice(stack, 1, kept - 1), F.when(alone, F.array(parent)).otherwise(F.array(parent, child)))
                bits = own.bitwiseAND(_long(final))
                hit = F.struct(e["at"].alias("at"), bits.alias("bits"))
                return F.struct(grown.alias("stack"), F.when(bits != 0, F.array_append(acc["hits"], hit)).otherwise(acc["hits"]).alias("hits"))

            return _let(joined.bitwiseAND(e["meets"]), pushed)

        closed = F.struct(F.slice(stack, 1, size).alias("stack"), acc["hits"].alias("hits"))
        return F.when(e["opens"], _let(size, opened)).otherwise(closed)

    none = F.array().cast("array<struct<at:int,bits:bigint>>")
    bottom = F.array(_frame(F.lit(""), *[_long(0)] * 4)).cast(f"array<{FRAME}>")

    def gather(acc: Column, chunk: Column) -> Column:
        folded = F.aggregate(chunk, F.struct(acc["stack"].alias("stack"), none.alias("hits")), step)
        return _let(folded, lambda x: F.struct(x["stack"].alias("stack"), F.array_append(acc["all"], x["hits"]).alias("all")))

    start = F.struct(bottom.alias("stack"), F.array().cast("array<array<struct<at:int,bits:bigint>>>").alias("all"))
    chunks = _let(whole, lambda es: F.transform(F.sequence(F.lit(0), F.size(es).cast("int") - 1, F.lit(CHUNK)), lambda c: F.slice(es, c + 1, CHUNK)))
    chunks = F.when(F.size(whole) > 0, chunks).otherwise(F.array().cast("array<array<struct<at:int,name:string,opens:boolean,ends:array<string>,meets:bigint>>>"))
    return F.flatten(F.aggregate(chunks, start, gather, lambda acc: acc["all"]))


def nested_link_values(html: Column, rules: Sequence[str]) -> Column:
    """All values that the rules select, in the order of the page.  An element
    that several rules pick gives each rule's attribute."""
    chains = [c for rule in rules for c in parse(rule)]
    last, flags = -1, {}
    for c in chains:
        last += len(c.compounds)
        flags[c.wanted] = flags.get(c.wanted, 0) | 1 << last
    tags = F.filter(F.regexp_extract_all(H.visible(html), F.lit(H.TAG), F.lit(0)), lambda t: t.endswith(">"))

    def values(tag: Column, bits: Column) -> Column:
        given = [
            F.when((bits.bitwiseAND(_long(f)) != 0) & F.array_contains(H._names(tag), w), F.trim(H.attribute(tag, w))) for w, f in flags.items()
        ]
        return F.filter(F.array(*given), lambda v: v.isNotNull())

    found = _let(tags, lambda ts: F.flatten(F.transform(_hits(ts, chains), lambda h: values(F.element_at(ts, h["at"] + 1), h["bits"]))))
    return found
