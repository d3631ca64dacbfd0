"""Quality rules as a bitmask ledger.

Every measurement and every rule is evaluated once per document and stored: the
measurements as numbers, the failed rules as bits of one number.  Policies are
versions of a list of rules, that is masks, and are applied to the stored bits
without another look at a text.  What a rule costs is found the same way: documents
are counted by their bits (at most one row per combination of failed rules, counted
in the map task first), and every policy and rule is judged on those counts by
bitwise operations.

All of it is DataFrame functions.  A document is one row from beginning to end; only
counts by bits are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import written

SPACE = " \t\n\x0b\f\r"  # \x20 and \x09 to \x0D
WORD = r"[^\x20\t-\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 3

#: What is measured, in the order of the ledger's columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words")


@dataclass(frozen=True)
class Rule:
    """A rule fails a document if its SQL condition over the measurements holds.
    Its place among ``RULES`` is its bit; places are never used again for another."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 10 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("few_letters", "100 * n_letter_words < 80 * n_words"),
    Rule("many_words", "n_words > 100000"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the list of rules that count."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        places = {rule.name: place for place, rule in enumerate(rules)}
        return sum(1 << places[name] for name in set(self.rules))


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = (
    BASE,
    Policy("v1", (*BASE.rules, "short_words", "long_words", "symbols", "repeated_lines")),
    Policy("v2", (*BASE.rules, "short_words", "long_words", "symbols", "repeated_lines", "few_letters")),
)


def _held(df: DataFrame, **values: Column) -> DataFrame:
    """Adds costly columns that later expressions use many times: a generator keeps
    the optimizer from writing them out at each use."""
    packed = F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("ledger_held")
    held = df.select(*df.columns, packed)
    return held.select(*df.columns, *[F.col(f"ledger_held.{k}").alias(k) for k in values])


def repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds how many words lie in a window of three that the text holds twice or more.

    Windows are sorted with their places, so equal ones are neighbours; the places
    they cover are counted once each.  No window leaves its row."""
    windows = F.transform(
        words, lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))
    )
    all_windows = F.when(F.size(words) >= WINDOW, F.slice(windows, F.lit(1), F.size(words) - (WINDOW - 1)))
    df = _held(df, ledger_windows=F.array_sort(all_windows))
    again = lambda x, j: (x["w"] == F.get("ledger_windows", j - 1)["w"]) | (x["w"] == F.get("ledger_windows", j + 1)["w"])
    places = F.transform("ledger_windows", lambda x, j: F.when(again(x, j), F.sequence(x["i"], x["i"] + (WINDOW - 1))))
    covered = F.size(F.array_distinct(F.flatten(F.array_compact(places))))
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("bigint")).drop("ledger_windows")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``MEASURES`` (long) of every row.  A null text is empty: all zero.

    A line counts if it holds a word; of equal lines all but the first are repeated."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("ledger_text"))
    text = F.col("ledger_text")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    rows = _held(rows, ledger_words=F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), ledger_lines=lines)
    rows = rows.select(
        "doc_id",
        "ledger_words",
        F.size("ledger_words").alias("n_words"),
        F.char_length(F.translate(text, SPACE, "")).alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        F.size("ledger_lines").alias("n_lines"),
        (F.size("ledger_lines") - F.size(F.array_distinct("ledger_lines"))).alias("n_dup_lines"),
        F.size(F.filter("ledger_words", lambda w: w.rlike(r"\p{L}"))).alias("n_letter_words"),
    )
    rows = repeated_words(rows, "ledger_words", "n_repeat_words")
    return rows.select("doc_id", *[F.col(m).cast("bigint").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, ``MEASURES`` and ``failed`` (the bits of the rules that fail the row)
    of every row of ``docs``; store it once, judge it by any policy.

    Null and empty texts have no words and fail what that fails.  Repeated rows and
    ids, null ids among them, have a row each.  No rows give no rows; other columns
    of ``docs`` are not looked at."""
    if len(rules) > 62:
        raise ValueError("a ledger holds 62 rules at most")
    bits = sum((F.when(F.expr(rule.fails), 1 << place).otherwise(0).cast("bigint") for place, rule in enumerate(rules)), F.lit(0).cast("bigint"))
    return measure(docs, id_col, text_col).withColumn("failed", bits)


def passes(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """Does a row of the ledger pass?"""
    return F.col("failed").bitwiseAND(F.lit(policy.mask(rules))) == 0


def judge(entries: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``, a filter on stored bits.  What
    the base rules fail is never kept, whatever the policy."""
    base = passes(BASE, rules)
    return entries.withColumns({"base_failed": ~base, "kept": base & passes(policy, rules)})


def ablations(entries: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per policy and rule of it: version, rule, n_docs, n_kept (under the policy),
    n_failed (by the rule), n_only (by the rule alone), n_kept_without (if the rule
    were left out), and ``together`` (bits of the rules that fail any document of
    the rule).  An empty ledger gives no rows."""
    cases = [
        F.struct(F.lit(p.version).alias("version"), F.lit(rule.name).alias("rule"), F.lit(p.mask(rules)).alias("mask"), F.lit(1 << place).alias("bit"))
        for p in policies
        for place, rule in enumerate(rules)
        if rule.name in p.rules
    ]
    counts = entries.groupBy("failed").agg(F.count("*").alias("n"))  # a row per combination of failed rules
    each = counts.select("failed", "n", F.explode(F.array(*cases)).alias("x")).select("failed", "n", "x.*")
    here = F.col("failed").bitwiseAND(F.col("mask"))
    by_rule = here.bitwiseAND(F.col("bit")) != 0
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return each.groupBy("version", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(here == 0).alias("n_kept"),
        total(by_rule).alias("n_failed"),
        total(here == F.col("bit")).alias("n_only"),
        total((here == 0) | (here == F.col("bit"))).alias("n_kept_without"),
        F.coalesce(F.bit_or(F.when(by_rule, here)), F.lit(0).cast("bigint")).alias("together"),
    )


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger written to the shared folder and read back."""
    return written(ledger(docs, id_col, text_col), "rule-ledger")
