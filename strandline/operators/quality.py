"""Checks on finished archives and on job recipes."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import urls as U
from strandline.functions.devices import DEVICES
from strandline.operators.rank import DEDUP_POLICIES
from strandline.operators.scope import SCOPE_TYPES


def missing_entries(expected: DataFrame, entries: DataFrame, size: str = "bytes") -> DataFrame:
    """Expected paths with no entry or an empty one.  Entries shrink to
    distinct paths before the join."""
    have = entries.filter(F.col(size) > 0).select("path").distinct()
    return expected.select("path").distinct().join(have, "path", "left_anti")


class Rule(NamedTuple):
    flag: str
    kind: str = "string"
    required: bool = False
    minimum: int | None = None
    graphemes: tuple[int, int] | None = None
    pattern: str | None = None
    relaxed: str | None = None
    choices: tuple[str, ...] = ()


def recipe_rules(extension: str) -> list[Rule]:
    """The constraints on a job recipe's flags; ``extension`` is the archive
    file's.  Flags without a constraint are not listed."""
    # Fixed values from here on.
    name = r"^([a-z0-9\-\.]+_)([a-z\-]+_)([a-z0-9\-\.]+)$"
    file = r"^([a-z0-9\-\.]+_)([a-z\-]+_)([a-z0-9\-\.]+_)([a-z0-9\-\.]+_|)([\d]{4}-[\d]{2}|\{period\})." + extension + "$"
    relaxed = r"^[A-Za-z0-9._-]+$"
    zero_up = (
        "extra_hops", "page_limit", "max_page_limit", "page_load_timeout", "behavior_timeout", "post_load_delay", "page_extra_delay",
        "size_soft_limit", "size_hard_limit", "disk_utilization", "time_soft_limit", "time_hard_limit", "max_page_retries",
        "fail_on_failed_limit", "content_header_bytes_length",
    )
    switches = (
        "allow_hash_urls", "block_ads", "fail_on_failed_seed", "fail_on_invalid_status", "verbose", "keep", "overwrite",
        "ignore_content_header_charsets", "ignore_http_header_charsets", "ignore_unknown_charsets",
    )
    return [
        Rule("name", required=True, pattern=name, relaxed=relaxed),
        Rule("archive_file", pattern=file, relaxed=relaxed),
        Rule("title", graphemes=(1, 30)),
        Rule("description", graphemes=(1, 80)),
        Rule("long_description", graphemes=(1, 4000)),
        Rule("output", pattern="^/output$"),
        Rule("progress_file", pattern=r"^/output/task_progress\.json$"),
        Rule("scope_type", "string-enum", choices=SCOPE_TYPES),
        Rule("dedup_policy", "string-enum", choices=DEDUP_POLICIES),
        Rule("save_state", "string-enum", choices=("never", "partial", "always")),
        Rule("mobile_device", "string-enum", choices=DEVICES),
        Rule("language", "language"),
        Rule("admin_email", "email"),
        Rule("replay_viewer_source", "url"),
        Rule("workers", "integer", minimum=1),
        Rule("depth", "integer", minimum=-1),
        Rule("net_idle_wait", "integer"),
        *[Rule(f, "integer", minimum=0) for f in zero_up],
        *[Rule(f, "boolean") for f in switches],
    ]


KINDS = {
    "integer": r"^[+-]?[0-9]+$",
    "boolean": r"(?i)^(true|false)$",
    "language": r"^[a-z]{3}(,[a-z]{3})*$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"^https?://[^/?#\s]+",
}


def _broken(rule: Rule, value: Column, strict: bool) -> list[tuple[str, Column]]:
    """(constraint, is it violated) for one flag; unset flags only fail ``required``."""
    checks = []
    if rule.required:
        checks.append(("required", value.isNull()))
    if rule.kind in KINDS:
        checks.append(("type", ~value.rlike(KINDS[rule.kind])))
    if rule.minimum is not None:
        checks.append(("min", value.try_cast("bigint") < rule.minimum))
    if rule.graphemes:
        least, most = rule.graphemes  # never more graphemes than characters, so few values are counted
        more = (F.length(value) > most) & value.rlike(rf"^\X{{{most + 1}}}")
        checks += [("min_graphemes", ~value.rlike(rf"^\X{{{least}}}")), ("max_graphemes", more)]
    pattern = rule.pattern if strict else (rule.relaxed or rule.pattern)
    if pattern:
        checks.append(("pattern", ~value.rlike(pattern)))
    if rule.choices:
        checks.append(("choices", ~value.isin(list(rule.choices))))
    return checks


def check_recipes(recipes: DataFrame, rules: Sequence[Rule], id: str = "recipe_id", strict: bool = True) -> DataFrame:
    """One row per violation: (id, flag, constraint).  The rules are part of the
    plan, so this is a single pass without join or shuffle."""
    found = []
    for rule in rules:
        if rule.flag not in recipes.columns:
            if rule.required:
                found.append(F.struct(F.lit(rule.flag).alias("flag"), F.lit("required").alias("constraint")))
            continue
        for constraint, broken in _broken(rule, F.col(rule.flag).cast("string"), strict):
            item = F.struct(F.lit(rule.flag).alias("flag"), F.lit(constraint).alias("constraint"))
            found.append(F.when(broken, item))
    violations = F.filter(F.array(*found), lambda v: v.isNotNull())
    return recipes.select(id, F.inline(violations))


def qa_compare(crawl: DataFrame, replay: DataFrame, ts: str | None = None) -> DataFrame:
    """Each page in the crawl against its replay: (url, presence, same_text,
    size_permille, shared, tokens).  Both sides have ``url`` and ``text``.  Of
    several rows of one cleaned URL the newest by ``ts`` counts, without ``ts``
    the longest text (then the smallest digest).  Sizes and digests travel for all
    pages, and in place of the text hashes of its distinct tokens.  Jaccard is
    shared / tokens."""

    def side(df: DataFrame, suffix: str) -> DataFrame:
        words = F.filter(F.array_distinct(F.split(F.lower("text"), r"\s+")), lambda w: w != "")
        thin = df.select(
            U.clean_url("url").alias("url"),
            *([F.col(ts).alias("at")] if ts else []),
            F.md5("text").alias("digest"),
            F.length("text").cast("bigint").alias("size"),
            F.transform(words, lambda w: F.xxhash64(w)).alias("words"),
        )
        order = F.struct(*["at"] * bool(ts), F.col("size"), F.col("digest"))
        one = thin.groupBy("url").agg(F.max_by(F.struct("digest", "size", "words"), order).alias("x"))
        return one.select("url", *[F.col(f"x.{c}").alias(f"{c}_{suffix}") for c in ("digest", "size", "words")])

    both = side(crawl, "c").join(side(replay, "r"), "url", "full_outer")
    c, r = F.col("size_c"), F.col("size_r")
    shared = F.size(F.array_intersect("words_c", "words_r")).cast("bigint")
    # |A u B| without building it; array_intersect skips null sides.
    tokens = F.size("words_c").cast("bigint") + F.size("words_r").cast("bigint") - shared
    paired = c.isNotNull() & r.isNotNull()
    return both.select(
        "url",
        F.when(r.isNull(), "crawl_only").when(c.isNull(), "replay_only").otherwise("both").alias("presence"),
        F.when(paired, F.col("digest_c") == F.col("digest_r")).alias("same_text"),
        F.when(paired, F.try_divide(r * 1000, c).cast("bigint")).alias("size_permille"),
        F.when(paired, shared).alias("shared"),
        F.when(paired, tokens).alias("tokens"),
    )
