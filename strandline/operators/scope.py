"""Which URLs belong to a crawl: scope, include and exclude rules, blocking,
date ranges and limits."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import urls as U
from strandline.operators.ordered import running_cut
from strandline.operators.skew import lookup_join
from strandline.session import written

# The scope types.
SCOPE_TYPES = ("page", "page-spa", "prefix", "host", "domain", "any", "custom")

LITERAL_KEYS = 1_000  # up to this many seed keys become a literal set
TOP_K = 100_000  # up to this many pages come from a top-k sort


def scope_type_of(scope_type: str | None, include: str | None) -> str:
    """The scope in force: custom if an include regex is given, else prefix."""
    chosen = scope_type or ("custom" if include else "prefix")
    if chosen not in SCOPE_TYPES:
        raise ValueError(f"unknown scope type {chosen!r}: one of {', '.join(SCOPE_TYPES)}")
    return chosen


def _scope_key(kind: str, url: Column) -> Column:
    """The part of a URL that decides."""
    if kind == "page":
        return U.clean_url(url)
    if kind == "page-spa":
        return U.strip_fragment(U.clean_url(url))
    return U.directory(url) if kind == "prefix" else U.host(url)


def _covering_keys(kind: str, key: Column) -> Column:
    """Every seed key that would cover ``key``: so scope is an equality, and a
    site with many seeds and many pages never pairs them all."""
    if kind == "prefix":  # the directory and the ones above it
        parts = F.split(key, "/")
        return F.transform(
            F.sequence(F.lit(3), F.greatest(F.size(parts) - 1, F.lit(3))),
            lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")),
        )
    if kind == "domain":  # the host and its parent domains
        labels = F.split(key, r"\.")
        return F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."),
        )
    return F.array(key)


def in_scope(
    urls: DataFrame,
    seeds: DataFrame,
    scope_type: str | None = None,
    include: str | None = None,
    url: str = "url",
) -> DataFrame:
    """The rows of ``urls`` that lie in the scope of at least one seed, or match
    ``include``: with a named scope type the pattern widens that scope."""
    kind = scope_type_of(scope_type, include)
    if kind == "custom":
        return include_rx(urls, include, url) if include else urls
    if kind == "any":
        return urls
    also = F.coalesce(F.col(url).rlike(include), F.lit(False)) if include else F.lit(False)
    keys = seeds.select(_scope_key(kind, F.col("url")).alias("key")).filter("key <> ''").distinct()
    few = keys.limit(LITERAL_KEYS + 1).collect()
    keyed = urls.withColumn("scope_key", _scope_key(kind, F.col(url)))
    if len(few) <= LITERAL_KEYS:  # a set test in the scan's own stage
        values = [r.key for r in few]
        if kind in ("prefix", "domain"):
            hit = F.exists(_covering_keys(kind, F.col("scope_key")), lambda k: k.isin(values))
        else:
            hit = F.col("scope_key").isin(values)
        return keyed.filter(F.coalesce(hit, F.lit(False)) | also).drop("scope_key")
    if kind in ("prefix", "domain"):
        owners = keyed.select("scope_key").distinct()
        owners = owners.withColumn("key", F.explode(_covering_keys(kind, F.col("scope_key"))))
        hits = lookup_join(owners, keys, ["key"], "left_semi", spread=["scope_key"])
        covered = written(hits.select("scope_key").distinct(), "scope")
    else:
        covered = keys.withColumnRenamed("key", "scope_key")
    if not include:
        return lookup_join(keyed, covered, ["scope_key"], "left_semi", [url]).drop("scope_key")
    marked = lookup_join(keyed, covered.withColumn("covered", F.lit(True)), ["scope_key"], "left", [url])
    return marked.filter(F.col("covered").isNotNull() | also).drop("scope_key", "covered")


def flag_scope(
    links: DataFrame, seeds: DataFrame, scope_type: str | None = None, include: str | None = None
) -> DataFrame:
    """Links with ``in_scope``, judged on their target."""
    inside = in_scope(links.select("dst").distinct(), seeds, scope_type, include, "dst")
    marked = lookup_join(links, inside.withColumn("hit", F.lit(True)), ["dst"], "left", ["src"], measure=False)
    return marked.withColumn("in_scope", F.col("hit").isNotNull()).drop("hit")


def include_rx(df: DataFrame, rx: str, url: str = "url") -> DataFrame:
    """Keep URLs that match."""
    return df.filter(F.col(url).rlike(rx))


def exclude_rx(df: DataFrame, rx: Sequence[str], url: str = "url") -> DataFrame:
    """Drop URLs that match any of the patterns.  A row without URL matches none."""
    for pattern in rx:
        df = df.filter(F.coalesce(~F.col(url).rlike(pattern), F.lit(True)))
    return df


class BlockRule(NamedTuple):
    url: str
    text: str | None = None


def replace_blocked(df: DataFrame, blocked: Column, message: str | None) -> DataFrame:
    """Without a message blocked rows go; with one they become message records."""
    if message is None:
        return df.filter(~blocked)
    stand_in = {
        "text": F.lit(message),
        "body": F.lit(message.encode()),
        "mime": F.lit("text/plain"),
        "bytes": F.lit(len(message.encode())).cast("bigint"),
        "digest": F.md5(F.lit(message)),
    }
    marked = df.withColumn("blocked", blocked)
    return marked.withColumns(
        {c: F.when(F.col("blocked"), v).otherwise(F.col(c)) for c, v in stand_in.items() if c in df.columns}
    )


def block(
    df: DataFrame, rules: Sequence[BlockRule], message: str | None = None, url: str = "url", text: str = "text"
) -> DataFrame:
    """Block captures by URL pattern and, where a rule has one, text pattern.

    Rules without text are tested first and as one alternation; the text is
    only read for URLs a text rule names."""
    plain = "|".join(f"(?:{r.url})" for r in rules if r.text is None)
    blocked = F.col(url).rlike(plain) if plain else F.lit(False)
    for rule in rules:
        if rule.text is not None:
            blocked = blocked | (F.col(url).rlike(rule.url) & F.col(text).rlike(rule.text))
    return replace_blocked(df, F.coalesce(blocked, F.lit(False)), message)


GRAMS = (3, 6, 12)  # lengths of the texts that rules are looked up by
RULES_A_ROW = 64

#: What makes it doubtful which characters a pattern needs: flags, quoting, codes.
DOUBT = r"\(\?[a-zA-Z-]|\\[0-9QEcxuUpPkNX]"
CUT = "\x00"  # in place of what is not a plain character


def required_literals(pattern: Column) -> Column:
    """The texts that are in whatever the pattern matches, as far as is plain from
    outside of its groups and classes; '' may be among them."""
    plain = F.regexp_replace(pattern, r"\\.", CUT)
    plain = F.regexp_replace(plain, r"\[\^?\]?[^\]]*\]", CUT)
    for _ in range(3):  # groups in groups
        plain = F.regexp_replace(plain, r"\([^()]*\)", CUT)
    unclear = pattern.rlike(DOUBT) | plain.rlike(r"[|()\[\]\\]") | pattern.contains("&&")
    plain = F.regexp_replace(plain, r"(?s).(?:[*?]|\{[^}]*\})[+?]?", CUT)
    runs = F.split(F.regexp_replace(plain, r"[.^$+*?{}]", CUT), CUT)
    return F.when(unclear, F.array(F.lit(""))).otherwise(runs)


def required_literal(pattern: Column) -> Column:
    """The longest of them; '' if there is none."""
    runs = F.transform(required_literals(pattern), lambda r: F.struct(F.length(r).alias("n"), r.alias("run")))
    return F.coalesce(F.array_max(runs)["run"], F.lit(""))


def _grams(text: Column) -> Column:
    """Its distinct parts of each length in :data:`GRAMS`."""

    def parts(size: int) -> Column:
        places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: text.substr(i, F.lit(size)))

    return F.array_distinct(F.concat(*map(parts, GRAMS)))


def tested_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, pattern, text): each distinct ``url`` with the rules that it has to be
    tested with.

    A rule is looked up by the rarest part, among all URLs, of the texts that its matches
    need; a part has one of the lengths in :data:`GRAMS`, so rules with longer texts keep to
    few URLs however many there are.  Only URLs that hold them are tested.  Rules that need
    no such text meet every URL, in rows of some :data:`RULES_A_ROW`.  Rules without a
    pattern match nothing; a rule that needs what no URL holds is left out."""
    urls = urls.filter("url is not null").distinct()
    seen = urls.select(F.explode(_grams(F.col("url"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n_urls"))
    seen = written(seen, "grams")
    given = rules.select("pattern", "text").filter("pattern is not null").distinct()
    needs = given.withColumn("grams", F.array_distinct(F.flatten(F.transform(required_literals(F.col("pattern")), _grams))))
    free = needs.filter(F.size("grams") == 0).select("pattern", "text", F.lit("").alias("gram"))
    bound = needs.select("pattern", "text", F.explode("grams").alias("gram"))
    bound = lookup_join(bound, seen, ["gram"], "left", ["pattern"])
    rarest = F.min(F.struct(F.coalesce("n_urls", F.lit(0)).alias("n"), "gram")).alias("rarest")
    bound = bound.groupBy("pattern", "text").agg(rarest).filter("rarest.n > 0").select("pattern", "text", F.col("rarest.gram").alias("gram"))
    keyed = written(bound.unionByName(free), "rules")
    blocks = keyed.groupBy("gram").agg(F.ceil(F.count("*") / RULES_A_ROW).alias("blocks"))
    block = F.pmod(F.xxhash64("pattern", "text"), F.col("blocks"))
    rows = lookup_join(keyed, blocks, ["gram"], "inner", ["pattern"]).groupBy("gram", block.alias("block"))
    rows = written(rows.agg(F.collect_list(F.struct("pattern", "text")).alias("rules")), "rules")
    met = urls.select("url", F.explode(F.array_union(_grams(F.col("url")), F.array(F.lit("")))).alias("gram"))
    met = lookup_join(met, rows, ["gram"], "inner", ["url"])
    return met.select("url", F.inline("rules"))


def matching_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, always, texts) of each distinct ``url`` that rules (pattern, text) match:
    does one without a text pattern, and the text patterns of the others."""
    hit = tested_rules(urls, rules).filter(F.regexp_like(F.col("url"), F.col("pattern")))
    return hit.groupBy("url").agg(F.bool_or(F.col("text").isNull()).alias("always"), F.collect_set("text").alias("texts"))


def block_table(df: DataFrame, rules: DataFrame, message: str | None = None, url: str = "url", text: str = "text") -> DataFrame:
    """As :func:`block`, by a table of rules (pattern, text) of any size: the plan does
    not grow with them.  A text is read only for URLs that a text rule names."""
    hits = matching_rules(df.select(F.col(url).alias("url")), rules)
    hits = hits.select(F.col("url").alias(url), F.col("always").alias("rule_always"), F.col("texts").alias("rule_texts"))
    marked = lookup_join(df, hits, [url], "left", [c for c in df.columns if c != text] or [url]).select(*df.columns, "rule_always", "rule_texts")
    named = F.coalesce(F.exists("rule_texts", lambda t: F.regexp_like(F.col(text), t)), F.lit(False))
    blocked = F.coalesce("rule_always", F.lit(False)) | named
    return replace_blocked(marked, blocked, message).drop("rule_always", "rule_texts")


def hosts_of(lines: DataFrame) -> DataFrame:
    """Hosts-file lines (``value``) as distinct lower-case ``host`` rows."""
    bare = F.trim(F.regexp_replace("value", r"#.*$", ""))
    return lines.select(F.lower(F.element_at(F.split(bare, r"\s+"), -1)).alias("host")).filter("host <> ''").distinct()


def block_hosts(df: DataFrame, hosts: DataFrame, message: str | None = None, url: str = "url") -> DataFrame:
    """Block captures whose host is listed exactly."""
    table = hosts.select(F.lower("host").alias("listed")).distinct()
    keyed = df.withColumn("listed", U.host(url))
    if message is None:
        return lookup_join(keyed, table, ["listed"], "left_anti", [url]).drop("listed")
    marked = lookup_join(keyed, table.withColumn("hit", F.lit(True)), ["listed"], "left", [url]).drop("listed")
    return replace_blocked(marked, F.col("hit").isNotNull(), message).drop("hit")


def period_start(text: Column | str) -> Column:
    """The start of a full or partial ISO date; null if it is none."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text)


def sitemap_between(df: DataFrame, lo: str | None = None, hi: str | None = None, lastmod: str = "lastmod") -> DataFrame:
    """Dates in [lo, hi], both inclusive; undated rows stay.  A ``lastmod``
    stored as a timestamp is compared as it is, which reaches the scan.  A bound
    that is no ISO date is an error."""
    for bound in filter(None, (lo, hi)):
        if df.sparkSession.range(1).select(period_start(F.lit(bound))).first()[0] is None:
            raise ValueError(f"unreadable date {bound!r}")
    typed = df.schema[lastmod].dataType.typeName() != "string"
    when = F.col(lastmod) if typed else period_start(lastmod)
    for bound, test in ((lo, when.__ge__), (hi, when.__le__)):
        if bound:
            start = period_start(F.lit(bound))
            df = df.filter(when.isNull() | test(start.cast(df.schema[lastmod].dataType) if typed else start))
    return df


def page_limit(
    df: DataFrame,
    limit: int = 0,
    max_limit: int = 0,
    order: Sequence[str] = ("ts", "capture_id"),
    per: Sequence[str] = (),
    top_k: int = TOP_K,
) -> DataFrame:
    """The first pages in ``order``, of the whole table or per group.

    ``max_limit`` replaces ``limit`` if both are set; 0 means no limit.  Small
    limits (up to ``top_k``) are a top-k; larger ones find the cut from hourly counts, so no task
    holds more than its share.  Either way rows without a time come first, and a
    null group is a group."""
    n = max_limit or limit
    if not n:
        return df
    if per and n <= min(1000, top_k):  # Spark trims each group before the shuffle
        rank = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
        return df.withColumn("page_rank", rank).filter(F.col("page_rank") <= n).drop("page_rank")
    if not per and n <= top_k:
        return df.orderBy(*order).limit(n)
    return running_cut(df, F.lit(1), n - 1, order, per)[0]


class Cut(NamedTuple):
    df: DataFrame
    partial: bool


def limit_cut(
    df: DataFrame,
    limit: int,
    by: str = "bytes",
    mode: str = "soft",
    order: Sequence[str] = ("ts", "capture_id"),
) -> Cut:
    """Stop a crawl at ``limit`` bytes or elapsed seconds.

    The record that crosses a byte limit is the last one kept.  ``soft`` keeps
    what was taken and says it is partial; ``hard`` keeps nothing once hit."""
    if mode not in ("soft", "hard"):
        raise ValueError("mode is soft or hard")
    if by == "bytes":
        kept, hit = running_cut(df, F.col("bytes"), limit, order)
    elif by == "elapsed":
        ts = order[0]
        kind = df.schema[ts].dataType
        span = df.agg(F.min(ts).cast("timestamp").alias("lo"), F.max(ts).cast("timestamp").alias("hi")).first()
        end = (F.lit(span["lo"]) + F.make_dt_interval(secs=F.lit(limit))).cast(kind)
        hit = span["lo"] is not None and (span["hi"] - span["lo"]).total_seconds() > limit
        kept = df.filter(F.col(ts).isNull() | (F.col(ts) <= end)) if hit else df  # rows without time come first
    else:
        raise ValueError("by is bytes or elapsed")
    if hit and mode == "hard":
        kept = df.filter(F.lit(False))
    return Cut(kept, hit)


def exclusive(soft: int | None, hard: int | None) -> tuple[int, str] | None:
    """The limit in force: soft and hard exclude each other."""
    if soft and hard:
        raise ValueError("soft and hard limit exclude each other")
    return (soft, "soft") if soft else (hard, "hard") if hard else None


def with_failed(df: DataFrame, invalid_status_fails: bool = False) -> DataFrame:
    """Adds ``failed``: not loaded (no status) or, if asked for, a 4xx/5xx status."""
    failed = F.coalesce(F.col("status"), F.lit(0)) == 0
    if invalid_status_fails:
        failed = failed | (F.col("status") >= 400)
    return df.withColumn("failed", failed)
