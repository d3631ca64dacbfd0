"""URL filter: host and path rules first, then a weighted vocabulary.

The longest fitting rule decides.  Where none fits, one Aho-Corasick pass over
the lower-cased URL finds all vocabulary terms; hits count only between
characters that are neither a-z nor 0-9.  One strict term, or distinct soft terms
of enough weight together, reject the URL.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import refuse_clash, small

#: (host and path, verdict); a rule fits its host and all subdomains.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: One of these rejects a URL.
STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "escorts", "malware", "warez")
#: Weights of soft terms; distinct hits of SOFT_LIMIT in sum reject.
SOFT = {
    "adult": 1.0, "bet": 1.0, "bonus": 1.0, "casino": 1.0, "cheap": 1.0, "click": 0.5, "free": 0.5, "jackpot": 1.0,
    "loan": 1.0, "nude": 1.5, "pills": 1.0, "poker": 1.0, "sex": 1.5, "slots": 1.0, "spam": 1.0, "viagra": 1.5, "win": 0.5,
}
SOFT_LIMIT = 2.0
MOST_TERMS = 1_000_000

SCHEMA = "host string, path string, rule string, verdict string, strict_hits bigint, soft_hits bigint"
BOUNDARY = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def read_vocabulary(rows: DataFrame, most: int = MOST_TERMS) -> tuple[tuple[str, ...], dict[str, float]]:
    """Strict and soft terms of a table with columns term, kind (``strict`` or
    ``soft``) and weight (of soft terms; null: 1), for ``filter_urls``.

    A-Z are lower-cased.  Rows without a term or with another kind are left out; a
    term that is strict once is strict, and the largest of a soft term's weights
    counts.  The terms go to every task, so more than ``most`` are an error.
    """
    term = F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = rows.filter("term <> '' and kind in ('strict', 'soft')")
    known = known.groupBy(term.alias("term")).agg(
        F.max((F.col("kind") == "strict").cast("int")).alias("strict"),
        F.max(F.coalesce(F.col("weight").cast("double"), F.lit(1.0))).alias("weight"),
    )
    found = known.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} terms")
    return tuple(sorted(r.term for r in found if r.strict)), {r.term: r.weight for r in found if not r.strict}


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[tuple[str, float], ...]):
    found = ahocorasick.Automaton()
    for term, weight in soft:
        found.add_word(term, (term, weight))
    for term in strict:
        found.add_word(term, (term, None))
    if len(found):
        found.make_automaton()
    return found


def vocabulary_hits(url: str, terms) -> tuple[int, dict[str, float]]:
    """Number of distinct strict terms, and the distinct soft terms, of a
    lower-cased URL."""
    strict, soft = set(), {}
    if not len(terms):
        return 0, soft
    for last, (term, weight) in terms.iter(url):
        first = last - len(term) + 1
        if (first and url[first - 1] in BOUNDARY) or url[last + 1 : last + 2] in BOUNDARY:
            continue
        if weight is None:
            strict.add(term)
        else:
            soft[term] = weight
    return len(strict), soft


def longest_rule(host: str, path: str, by_host: dict[str, list[tuple[str, str, str]]]) -> tuple[str | None, str | None]:
    """Rule and verdict; the rules of a host are sorted longest first."""
    best, verdict, at = None, None, 0
    while True:
        for prefix, rule, says in by_host.get(host[at:], ()):
            if path.startswith(prefix):
                if best is None or len(rule) > len(best):
                    best, verdict = rule, says
                break
        at = host.find(".", at) + 1
        if not at:
            return best, verdict


def filter_urls(
    pages: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: float = SOFT_LIMIT, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The ``keep`` columns of ``pages`` and host, path, rule, verdict,
    strict_hits, soft_hits; one row per row, in one scan without a shuffle.

    Host: between the first ``://`` and the next ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased.  Path: from there up to ``?``, ``#`` or the end.  A null or
    empty URL, or one without ``://``, has both empty and fits no rule; the
    vocabulary still judges it, and null is allowed.  ``keep`` may not hold one of
    the names added.
    """
    refuse_clash(keep, SCHEMA)
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        by_host.setdefault(host, []).append((slash + path, rule, verdict))
    for own in by_host.values():
        own.sort(key=lambda x: -len(x[0]))
    terms = (tuple(strict), tuple(sorted(soft.items())))

    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = pages.select(
        *keep,
        F.translate(F.regexp_extract(url, parts, 1), upper, lower).alias("host"),
        F.regexp_extract(url, parts, 2).alias("path"),
        F.translate(url, upper, lower).alias("url_lower"),
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(*terms)
        for batch in small(batches):
            out = []
            for host, path, url in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "url_lower"))):
                rule, verdict = longest_rule(host, path, by_host)
                strict_hits, soft_hits = vocabulary_hits(url, found)
                if verdict is None:
                    verdict = "block" if strict_hits or sum(soft_hits.values()) >= soft_limit else "allow"
                out.append((rule, verdict, strict_hits, len(soft_hits)))
            added = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = [*batch.columns[:-1], *(pa.array(list(a), k) for a, k in zip(added, kinds))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "rule", "verdict", "strict_hits", "soft_hits"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema) if keep else ""
    return rows.mapInArrow(judge, f"{kept}, {SCHEMA}" if kept else SCHEMA)
