"""The registered queries of this subpackage, and their SQL where it can
express them over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe_transducer, cross_polytope, exact_dedup, language_id, lm_score, mixing, ordinal_quality, rule_ledger, simhash, spelling, token_alignment, token_files, url_filter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_files")
def _(spark, d):
    return token_files.token_digest(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query("op2_simhash")
def _(spark, d):
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query("op3_lm_score")
def _(spark, d):
    docs = table(spark, d, "documents")
    return lm_score.score(docs, lm_score.train(docs, F.col("source") == "src1"))


@query("op4_language_id")
def _(spark, d):
    docs = table(spark, d, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op5_bpe_codec")
def _(spark, d):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_transducer.encode_decode(table(spark, d, "documents"), ranks, public_tokenizers.PATTERN, memo=400_000)


@query("op6_mix_sources")
def _(spark, d):
    mixed = mixing.mix(table(spark, d, "documents"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


SQL["op6_mix_sources"] = r"""
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
        coalesce(length(text), 0) as chars, text is null as no_text,
        (('0x' || substr(md5(concat_ws(':', doc_id::varchar, md5(coalesce(text, '')))), 1, 13))::bigint::double + 0.5)
            / 4503599627370496.0 as u
    from documents),
keyed as (
    select *, -ln(u) / (case when no_text then 1.0 else 1 / (1 + abs(chars / greatest(size, 1)::double - 6)) end) as k from sized),
sources as (
    select source, sum(size)::bigint as source_size,
        [3.0::double, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
    from keyed group by source),
levels as (
    select *, (1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over up_to, 0))
            / nullif(sum(weight) over () - coalesce(sum(weight) over up_to, 0), 0) as level
    from sources
    window up_to as (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
filled as (select max(level) filter (level < 2 * source_size / weight) as level from levels),
planned as (
    select source, source_size, least(2.0::double * source_size, coalesce(filled.level, 1e300) * weight) as target
    from sources, filled),
placed as (
    select k.doc_id, k.size, p.source_size, p.target, coalesce(floor(p.target / nullif(p.source_size, 0)), 0)::bigint as full_,
        coalesce(sum(k.size) over (partition by k.source order by k.k, k.doc_id, k.size
            rows between unbounded preceding and 1 preceding), 0) + k.size / 2.0::double as middle
    from keyed k join planned p on k.source is not distinct from p.source)
select doc_id, size, source_size, target,
    (size * (full_ + (middle <= target - full_ * source_size)::int))::bigint as taken
from placed
"""


@query("op7_exact_dedup")
def _(spark, d):
    return exact_dedup.dedup_groups(table(spark, d, "documents")).drop("h", "chars")


SQL["op7_exact_dedup"] = r"""
with normal as (
    select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
    from documents)
select doc_id, first_value(doc_id) over best as keep_id, count(*) over (partition by text_sha256) as group_size,
    row_number() over best = 1 as kept, text_sha256
from normal window best as (partition by text_sha256 order by chars desc, doc_id)
"""


@query("op8_quality_classifier")
def _(spark, d):
    docs = table(spark, d, "documents")
    return ordinal_quality.rate(docs, ordinal_quality.train(docs, table(spark, d, "labels")))


@query("op9_nearest_vectors")
def _(spark, d):
    vectors = table(spark, d, "embeddings")
    return cross_polytope.nearest_rows(vectors, vectors.filter("vec_id % 100 = 0"))


#: Strict terms of the query: the general words and whole site names.
URL_STRICT = (*url_filter.STRICT, "spam-farm", "casino-win")


@query("op10_url_filter")
def _(spark, d):
    return url_filter.filter_urls(table(spark, d, "pages"), strict=URL_STRICT, keep=("page_id",))


def _url_sql() -> str:
    edge = "(^|[^a-z0-9]){}($|[^a-z0-9])"
    hit = lambda term: f"regexp_matches(low, '{edge.format(term)}')::int"
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0]))
    fits = lambda r: f"(host = '{r.partition('/')[0]}' or host like '%.{r.partition('/')[0]}') and starts_with(path, '/{r.partition('/')[2]}')"
    weight = " + ".join(f"{w} * {hit(t)}" for t, w in url_filter.SOFT.items())
    return rf"""
with parts as (
    select page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
    from pages),
hits as (
    select *, ({" + ".join(map(hit, URL_STRICT))})::bigint as strict_hits,
        ({" + ".join(map(hit, url_filter.SOFT))})::bigint as soft_hits, {weight} as soft_weight,
        case {" ".join(f"when {fits(r)} then '{r}'" for r, _ in rules)} end as rule
    from parts)
select page_id, host, path, rule, strict_hits, soft_hits,
    case {" ".join(f"when rule = '{r}' then '{v}'" for r, v in rules)}
        when strict_hits > 0 or soft_weight >= {url_filter.SOFT_LIMIT} then 'block' else 'allow' end as verdict
from hits
"""


SQL["op10_url_filter"] = _url_sql()


@query("op11_token_alignment")
def _(spark, d):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align(table(spark, d, "documents"), *paths)


@query("op12_spelling_variants")
def _(spark, d):
    return spelling.variants(table(spark, d, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_quality_rules")
def _(spark, d):
    judged = rule_ledger.judge(rule_ledger.stored(table(spark, d, "documents")), rule_ledger.POLICIES[-1])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL["op13_quality_rules"] = r"""
with texts as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from documents),
windows as (
    select doc_id, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) as w
    from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from texts)),
again as (select doc_id, i, count(*) over (partition by doc_id, w) as times from windows),
covered as (
    select doc_id, count(distinct place)::bigint as n_repeat_words
    from (select doc_id, unnest([i, i + 1, i + 2]) as place from again where times > 1) group by doc_id),
measured as (
    select doc_id, len(words)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
        len(list_filter(words, lambda x: regexp_matches(x, '\p{L}')))::bigint as n_letter_words
    from texts left join covered using (doc_id)),
based as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not (base_failed or word_chars < 3 * n_words or word_chars > 10 * n_words or 10 * n_symbols > n_words
        or 100 * n_dup_lines > 30 * n_lines or 100 * n_letter_words < 80 * n_words) as kept
from based
"""
