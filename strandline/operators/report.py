"""Crawl statistics, outcomes, progress and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import html as H
from strandline.functions import languages as L
from strandline.functions import urls as U
from strandline.operators.canonical import clean_urls
from strandline.operators.skew import lookup_join

# Exit codes.
EXIT_OK = 0
EXIT_REFUSED = 2
EXIT_SIZE_LIMIT = 14
EXIT_TIME_LIMIT = 15
EXIT_PREFLIGHT_OK = 100

# How the two phases weigh in overall progress.
CRAWL_SHARE = 0.9

# Archive metadata and the recipe column it comes from.
METADATA = (
    ("Name", "name"),
    ("Title", "title"),
    ("Description", "description"),
    ("LongDescription", "long_description"),
    ("Creator", "creator"),
    ("Publisher", "publisher"),
    ("Language", "language"),
    ("Illustration", "favicon"),
)

# Defaults of the charset audit.
CHARSETS_TO_TRY = ("UTF-8", "ISO-8859-1")
CONTENT_HEADER_BYTES = 1024


# --- statistics and limits -------------------------------------------------


def crawl_stats(df: DataFrame, by: Sequence[str] = (), page_limit: int = 0) -> DataFrame:
    """crawled, pending, failed, total and limit{max, hit}, overall or per group.
    ``df`` has ``failed`` and optionally ``pending``."""
    pending = F.coalesce(F.col("pending"), F.lit(False)) if "pending" in df.columns else F.lit(False)
    stats = df.groupBy(*by).agg(
        F.count_if(~pending & ~F.col("failed")).alias("crawled"),
        F.count_if(pending).alias("pending"),
        F.count_if(~pending & F.col("failed")).alias("failed"),
        F.count("*").alias("total"),
    )
    hit = F.lit(page_limit > 0) & (F.col("crawled") >= page_limit)
    return stats.withColumn("limit", F.struct(F.lit(page_limit).alias("max"), hit.alias("hit")))


def pending_pages(df: DataFrame) -> DataFrame:
    """The pages behind ``pending``, as rows: the list has no bound."""
    return df.filter("pending").select("url").distinct()


def failed_seeds(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """Seeds whose page failed (``pages`` has ``url`` and ``failed``)."""
    failed = clean_urls(pages.filter("failed")).withColumnRenamed("url", "clean")
    return seeds.withColumn("clean", U.clean_url("url")).join(failed, "clean", "left_semi").drop("clean")


def failed_limit(df: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Failed pages, and whether they exceed ``n``."""
    return df.groupBy(*by).agg(F.count_if("failed").alias("failed")).withColumn("exceeded", F.col("failed") > n)


def classify_runs(runs: DataFrame) -> DataFrame:
    """Adds ``outcome``, ``converts`` (is an archive still made), ``final_code``
    and ``partial_flag`` (null unless a progress file was asked for).

    ``runs`` has ``exit_code`` and optionally ``soft_size``, ``soft_time``,
    ``has_progress`` and ``accepted_codes`` (comma list)."""
    have, no = set(runs.columns), F.lit(False)
    flag = {c: F.coalesce(F.col(c), no) if c in have else no for c in ("soft_size", "soft_time", "has_progress")}
    code = F.col("exit_code")
    accepted = no
    if "accepted_codes" in have:
        codes = F.transform(F.split("accepted_codes", ","), lambda c: F.trim(c))
        accepted = F.coalesce(F.array_contains(codes, code.cast("string")), no)
    stopped = (
        ((code == EXIT_SIZE_LIMIT) & flag["soft_size"]) | ((code == EXIT_TIME_LIMIT) & flag["soft_time"]) | accepted
    )
    outcome = (
        F.when(code.isin(EXIT_OK, EXIT_PREFLIGHT_OK), "complete")
        .when(stopped, "partial")
        .when(code == EXIT_REFUSED, "rejected")
        .otherwise("failed")
    )
    named = runs.withColumn("outcome", outcome)
    converts = F.col("outcome").isin("complete", "partial")
    return (
        named.withColumn("converts", converts)
        .withColumn("final_code", F.when(converts, F.lit(0)).otherwise(code))
        .withColumn("partial_flag", F.when(flag["has_progress"] & converts, F.col("outcome") == "partial"))
    )


def outcome_counts(runs: DataFrame) -> DataFrame:
    return classify_runs(runs).groupBy("outcome").agg(F.count("*").alias("runs"), F.count_if("partial_flag").alias("flagged"))


# --- progress --------------------------------------------------------------


def crawl_progress(df: DataFrame) -> DataFrame:
    """Crawl updates (``crawled``, ``total``) in overall units."""
    total = (F.col("total").cast("double") / F.lit(CRAWL_SHARE)).cast("bigint")
    return df.withColumns({"done": F.col("crawled").cast("bigint"), "total": total}).drop("crawled")


def convert_progress(df: DataFrame) -> DataFrame:
    """Conversion updates (``written``, ``total``) in overall units; a total of
    zero gives null, which later steps leave out."""
    total = F.col("total").cast("double")
    part = F.try_divide(F.col("written").cast("double"), total) / F.lit(10.0)
    done = (total * (F.lit(CRAWL_SHARE) + part)).cast("bigint")
    return df.withColumns({"done": done, "total": F.col("total").cast("bigint")}).drop("written")


def progress_updates(crawl: DataFrame, convert: DataFrame) -> DataFrame:
    """Usable updates of both phases; a broken one is left out."""
    both = crawl_progress(crawl).unionByName(convert_progress(convert))
    return both.filter(F.col("done").isNotNull() & F.col("total").isNotNull())


def latest_progress(updates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The newest update: (done, total), overall or per group."""
    newest = updates.groupBy(*by).agg(F.max(F.struct("ts", "done", "total")).alias("u"))
    return newest.filter("u is not null").select(*by, "u.done", "u.total")


def progress(
    crawl: DataFrame, convert: DataFrame, by: Sequence[str] = (), partial: bool | None = None
) -> DataFrame:
    """Overall progress.  ``partial`` is stamped on once the run has ended."""
    latest = latest_progress(progress_updates(crawl, convert), by)
    return latest if partial is None else latest.withColumn("partial", F.lit(partial))


# --- audits ----------------------------------------------------------------


def user_agent_suffix(suffix: str, admin_email: str | None = None) -> str:
    return f"{suffix} {admin_email}" if admin_email else suffix


def effective_user_agent(ua: Column | str) -> Column:
    """Trimmed; an empty one counts as not given."""
    trimmed = F.trim(F.col(ua) if isinstance(ua, str) else ua)
    return F.when(trimmed != "", trimmed)


def ua_audit(captures: DataFrame, suffix: str, by: Sequence[str] = ("collection",)) -> DataFrame:
    """Per group: request records with a user agent, those without ``Mozilla``,
    those not ending in a blank and the suffix, and whether the group passes
    (at least one such record and none wrong)."""
    ua = F.col("user_agent")
    counted = ua.isNotNull() & (ua != "")
    if "rec_type" in captures.columns:
        counted = counted & (F.col("rec_type") == "request")
    return (
        captures.groupBy(*by)
        .agg(
            F.count_if(counted).alias("requests"),
            F.count_if(counted & ~ua.contains("Mozilla")).alias("no_mozilla"),
            F.count_if(counted & ~ua.endswith(" " + suffix)).alias("no_suffix"),
        )
        .withColumn("passed", F.expr("requests > 0 and no_mozilla = 0 and no_suffix = 0"))
    )


# Bodies as hexadecimal digits: units that are no surrogate, or pairs of them; code
# points up to 10FFFF that are no surrogate.
_X = "[0-9A-F]"
WIDE_BE = rf"^(?:(?:[0-9A-CEF]{_X}|D[0-7]){_X}{{2}}|D[89AB]{_X}{{2}}D[C-F]{_X}{{2}})*+$"
WIDE_LE = rf"^(?:{_X}{{2}}(?:[0-9A-CEF]{_X}|D[0-7])|{_X}{{2}}D[89AB]{_X}{{2}}D[C-F])*+$"
WIDER_BE = rf"^(?:0000(?:[0-9A-CEF]{_X}|D[0-7]){_X}{{2}}|00(?:0[1-9A-F]|10){_X}{{4}})*+$"
WIDER_LE = rf"^(?:{_X}{{2}}(?:[0-9A-CEF]{_X}|D[0-7])0000|{_X}{{4}}(?:0[1-9A-F]|10)00)*+$"


# Charsets Spark can test without decoding errors: name → is the body valid.
def _decodable(body: Column) -> dict[str, Column]:
    digits = F.hex(body)
    ascii_only = F.decode(body, "ISO-8859-1").rlike(r"^[\x00-\x7F]*$")
    return {
        "utf-8": F.is_valid_utf8(body.cast("string")),
        "iso-8859-1": F.lit(True),
        "us-ascii": ascii_only,
        "utf-16": F.when(digits.startswith("FEFF"), digits.rlike(WIDE_BE)).otherwise(digits.rlike(WIDE_LE)),
        "utf-16be": digits.rlike(WIDE_BE),
        "utf-16le": digits.rlike(WIDE_LE),
        "utf-32": F.when(digits.startswith("0000FEFF"), digits.rlike(WIDER_BE)).otherwise(digits.rlike(WIDER_LE)),
    }


def charsets(
    captures: DataFrame,
    aliases: Mapping[str, str] | None = None,
    to_try: Sequence[str] = CHARSETS_TO_TRY,
    header_bytes: int = CONTENT_HEADER_BYTES,
    ignore_http: bool = False,
    ignore_content: bool = False,
    ignore_unknown: bool = False,
) -> DataFrame:
    """Adds ``charset``, ``charset_source`` (http, content, tried or none) and
    ``decodable``.  The HTTP header comes before the content; a charset that is
    declared but not known is null in ``decodable`` unless unknown ones are
    ignored, when the try-list follows.  ``captures`` has ``content_type`` and
    ``body``."""
    head = F.decode(F.substring("body", 1, header_bytes), "ISO-8859-1")
    declared = r"(?i)(?:charset|encoding)\s*=\s*[\"']?\s*([a-zA-Z0-9._:-]+)"
    in_head = r"(?is)<(?:meta\b[^>]*?\bcharset|\?xml\b[^>]*?\bencoding)\s*=\s*[\"']?\s*([a-zA-Z0-9._:-]+)"
    names = {k.lower(): v.lower() for k, v in (aliases or {}).items()}

    def named(found: Column) -> Column:
        name = F.lower(found)
        for alias, charset in names.items():
            name = F.when(F.lower(found) == alias, F.lit(charset)).otherwise(name)
        return F.nullif(name, F.lit(""))

    valid = _decodable(F.col("body"))
    df = captures.withColumns(
        {
            "_http": F.lit(None).cast("string") if ignore_http else named(F.regexp_extract("content_type", declared, 1)),
            "_content": F.lit(None).cast("string") if ignore_content else named(F.regexp_extract(head, in_head, 1)),
        }
    )
    usable = {c: F.col(c).isin(list(valid)) if ignore_unknown else F.col(c).isNotNull() for c in ("_http", "_content")}
    tried = F.coalesce(*[F.when(valid[c.lower()], F.lit(c.lower())) for c in to_try if c.lower() in valid], F.lit(None))
    df = df.withColumns(
        {
            "charset": F.when(usable["_http"], F.col("_http")).when(usable["_content"], F.col("_content")).otherwise(tried),
            "charset_source": F.when(usable["_http"], "http").when(usable["_content"], "content").otherwise("tried"),
        }
    ).drop("_http", "_content")
    ok = reduce(lambda acc, kv: acc.when(F.col("charset") == kv[0], kv[1]), valid.items(), F.when(F.lit(False), F.lit(None)))
    source = F.when(F.col("charset").isNull(), "none").otherwise(F.col("charset_source"))
    return df.withColumns({"charset_source": source, "decodable": ok})


def charset_audit(captures: DataFrame, by: Sequence[str] = ("host",), **options) -> DataFrame:
    """Captures per group, charset and source: how many decode, fail, or have a
    charset that cannot be tested.  Bodies never leave their task."""
    named = charsets(captures, **options)
    return named.groupBy(*by, "charset", "charset_source").agg(
        F.count("*").alias("captures"),
        F.count_if(F.col("decodable")).alias("decodable"),
        F.count_if(~F.col("decodable")).alias("broken"),
        F.count_if(F.col("decodable").isNull()).alias("untested"),
    )


def iso3(code: str) -> Column:
    """The ISO 639-3 code for a two-letter or bibliographic code; others of three
    letters stand for themselves, the rest is null."""
    known = F.create_map(*[F.lit(x) for pair in L.TO_ISO3.items() for x in pair])
    code = F.lower(F.trim(F.col(code)))
    return F.coalesce(F.element_at(known, code), F.when(code.rlike("^[a-z]{3}$"), code))


def site_metadata(pages: DataFrame, seeds: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The eight metadata fields of each site (host).

    A site's homepage is its first seed.  Language and title come from that
    page unless ``overrides`` (one row per ``site``, columns as in METADATA)
    says otherwise.  Languages get their ISO 639-3 code; a page that declares none,
    or a two-letter code that is none, has ``eng``.  Other pages go before
    any shuffle when the homepages are few enough to broadcast, and only the
    short extracts of a page are shuffled, never its HTML."""
    homes = seeds.groupBy(U.host("url").alias("site")).agg(F.min_by("url", "pos").alias("url"))
    extracts = pages.select("url", H.language(F.col("html")).alias("code"), H.title(F.col("html")).alias("page_title"))
    extracts = lookup_join(extracts, homes.select("url"), ["url"], "left_semi", spread=["code", "page_title"])
    extracts = extracts.groupBy("url").agg(F.min(F.struct("code", "page_title")).alias("x")).select("url", "x.*")
    found = homes.join(extracts, "url", "left")
    given = {"name": F.col("site"), "title": F.nullif("page_title", F.lit("")), "language": F.coalesce(iso3("code"), F.lit(L.FALLBACK))}
    columns = [c for _, c in METADATA]
    base = found.select("site", "url", *[given.get(c, F.lit(None).cast("string")).alias(f"found_{c}") for c in columns])
    if overrides is not None:
        base = base.join(overrides, "site", "left")
        have = overrides.columns
    else:
        have = []
    if "language" in have:
        base = base.withColumn("language", F.coalesce(iso3("language"), F.col("language")))
    picked = [
        (F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"found_{c}")) if c in have else F.col(f"found_{c}")).alias(name)
        for name, c in METADATA
    ]
    return base.select("site", F.col("url").alias("homepage"), *picked)
