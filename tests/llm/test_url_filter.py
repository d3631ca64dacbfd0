"""URL rules and vocabulary against plain searches."""

import random
import re

import pytest

from strandline.llm import url_filter as uf
from strandline.llm.queries import QUERIES

SCHEMA = "page_id bigint, url string, host string, rule string, url_lower string"


def plain(url):
    """host, path, rule, verdict, strict and soft hits by regular expressions."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    host, path = "", ""
    if "://" in (url or ""):
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in uf.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            fits.append((len(rule), rule, verdict))
    hit = lambda term: re.search(f"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])", low) is not None
    strict, soft = sum(map(hit, uf.STRICT)), [t for t in uf.SOFT if hit(t)]
    said = "block" if strict or sum(uf.SOFT[t] for t in soft) >= uf.SOFT_LIMIT else "allow"
    _, rule, verdict = max(fits, default=(0, None, said))
    return host, path, rule, verdict, strict, len(soft)


def test_against_plain_searches(spark):
    rng = random.Random(6)
    terms = [*uf.STRICT, *uf.SOFT, "news", "casinos", "sussex", "pokerface"]
    urls = [
        None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.ORG/EN/1", "http://example.org/en/1", "http://a.example.org/es/x",
        "http://example.org", "http://notexample.org/es/", "http://example.org:80/es/", "http://org/", "http://x.com/de", "http://com/de/?a",
        "a://b://c/d", "http://x.net/\n?free", "http://é.com/fr/É#x", "http://x.net/adult?poker=1", "http://x.net/poker/poker",
        "http://x.net/" + "a/" * 50_000 + "porn",
    ]
    for _ in range(300):
        host = rng.choice(["a.example.org", "x.com", "shop.net", "example.org", "b.org", "fr.com"])
        path = "".join(rng.choice(["/", "-", "", ".", "_", "%20"]) + rng.choice(terms) for _ in range(rng.randint(0, 4)))
        urls.append(f"https://{host}{rng.choice(['', '/fr/', '/de/', '/es/', '/en/1', '/'])}{path}")
    urls += urls[-5:]
    rows = [(i, u, None, "x", None) for i, u in enumerate(urls)]
    found = uf.filter_urls(spark.createDataFrame(rows, SCHEMA), keep=("page_id",)).collect()
    assert len(found) == len(urls)
    for row in found:
        assert tuple(row)[1:] == plain(urls[row.page_id]), urls[row.page_id]


def test_other_rules_and_no_vocabulary(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c/d", None, None, None)], SCHEMA)
    rules = (("b/c", "block"), ("a.b/c/d", "allow"), ("a.b/", "block"))
    assert uf.filter_urls(pages, rules=rules, strict=(), soft={}).first().rule == "a.b/c/d"
    assert uf.filter_urls(pages, rules=(), strict=(), soft={}).first().verdict == "allow"
    assert uf.filter_urls(pages.limit(0)).collect() == []


def test_vocabulary_of_thousands_from_a_table(spark):
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abcdefg", k=rng.randint(2, 6))) for _ in range(6_000)})
    terms = [(w, "strict" if i % 10 == 0 else "soft", None if i % 3 else 0.5) for i, w in enumerate(words[::2])]
    odd = [(None, "strict", 1.0), ("", "soft", 1.0), ("zzz", "other", 1.0), (words[0].upper(), "soft", 9.0), (words[2], "soft", 0.25)]
    strict, soft = uf.read_vocabulary(spark.createDataFrame(terms + odd, "term string, kind string, weight double"))
    assert set(strict) == {t for t, k, _ in terms if k == "strict"}
    assert soft == {t: max(w or 1.0, 0.25 if t == words[2] else 0) for t, k, w in terms if k == "soft"}
    urls = ["http://h.net/" + "".join(rng.choice(words) + rng.choice("/-._") for _ in range(rng.randint(0, 5))) for _ in range(500)]
    pages = spark.createDataFrame([(i, u, None, None, None) for i, u in enumerate(urls)], SCHEMA)
    for row in uf.filter_urls(pages, rules=(), strict=strict, soft=soft, keep=("page_id",)).collect():
        held = set(re.split("[^a-z0-9]", urls[row.page_id]))
        weight = sum(soft[t] for t in held & set(soft))
        assert (row.strict_hits, row.soft_hits) == (len(held & set(strict)), len(held & set(soft)))
        assert row.verdict == ("block" if held & set(strict) or weight >= uf.SOFT_LIMIT else "allow")
    with pytest.raises(ValueError, match="more than 5"):
        uf.read_vocabulary(spark.createDataFrame(terms, "term string, kind string, weight double"), most=5)


def test_kept_columns_named_like_results_are_refused(spark):
    with pytest.raises(ValueError, match="host"):
        uf.filter_urls(spark.createDataFrame([(1, "u", "h", None, None)], SCHEMA), keep=("page_id", "host"))


def test_the_query_rejects_named_sites(spark, tmp_path):
    urls = ["http://spam-farm.net/x", "http://a.casino-win.net/", "http://spam-farms.net/", "http://x.net/casino/win", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: (r.verdict, r.strict_hits) for r in QUERIES["op10_url_filter"](spark, str(tmp_path)).collect()}
    assert found == {0: ("block", 1), 1: ("block", 1), 2: ("allow", 0), 3: ("allow", 0), 4: ("allow", 0)}
