"""The same queries as DuckDB SQL over the given tables.

Given page URLs have no port, no upper-case scheme and no empty marks, so they
equal their cleaned form; only ``U1_clean_url`` and ``U1_collisions`` see others."""

from __future__ import annotations

from strandline.fixtures import HOST, cte
from strandline.functions import languages
from strandline.plans.queries import SIZE_LIMIT, TIME_LIMIT

SQL: dict[str, str] = {}

NOFRAG = "regexp_replace({}, '#.*$', '')"
FILE = "regexp_extract({}, '^[a-z]+://[^/?#]*([^#]*)', 1)"
DIRECTORY = "regexp_extract(regexp_replace({}, '[?#].*$', ''), '^(.*/)', 1)"


def host(c: str) -> str:
    return HOST.format(c)


#: What the given pages hold, written out here: no pattern of the library is reused.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape(c: str) -> str:
    for reference, char in REFERENCES:
        quoted = char.replace("'", "''")
        c = f"replace({c}, '{reference}', '{quoted}')"
    return c


def visible(c: str) -> str:
    for opener, closer in (("<!--", "-->"), ("<script", "</script>"), ("<style", "</style>")):
        c = f"regexp_replace({c}, '(?is){opener}.*?{closer}', ' ', 'g')"
    return c


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


# --- flagship ----------------------------------------------------------------

SQL["host_report"] = f"""{cte('captures', 'blocklist')},
kept as (select *, row_number() over (partition by page, digest order by ts, capture_id) as rn
  from (select *, {NOFRAG.format('url')} as page from captures) t
  where not regexp_matches(url, '\\?utm_') and not regexp_matches(url, '/96[0-9]')
    and host not in (select host from blocklist))
select host, count(distinct page) as pages, count(*) filter (where status < 400) as crawled,
  count(*) filter (where status >= 400) as failed, count(*) as total, cast(sum(bytes) as bigint) as bytes
from kept where rn = 1 group by host"""

SQL["archive_build"] = f"""{cte('captures', 'seeds', 'blocklist')},
scoped as (select capture_id, ts, {NOFRAG.format('url')} as url, bytes, digest from captures
  where not regexp_matches(url, '\\?utm_') and not regexp_matches(url, '/96[0-9]')
    and host in (select {host('url')} from seeds) and host not in (select host from blocklist)),
firsts as (select * from scoped qualify row_number() over (partition by url, digest order by ts, capture_id) = 1),
page_starts as (select url, ts, capture_id from firsts qualify row_number() over (partition by url order by ts, capture_id) = 1),
allowed as (select url from page_starts order by ts, capture_id limit 100),
summed as (select *, sum(bytes) over (order by ts, capture_id) - bytes as before, sum(bytes) over () as total
  from firsts where url in (select url from allowed))
select capture_id, url, bytes, total > {SIZE_LIMIT // 10} as partial from summed where before <= {SIZE_LIMIT // 10}"""

#: Chains of the redirects in ``map`` (src, dst), with loops: src, target (null in a loop).
_chain = """chain as (select src, dst as at from map union select w.src, r.dst from chain w join map r on r.src = w.at),
ends as (select w.src, max(case when r.src is null or r.dst = r.src then w.at end) as target
  from chain w left join map r on r.src = w.at group by w.src),
moved as (select src, target from ends where target <> src),
shown as (select src, dst from hrefs where src not in (select src from ends where target is null or target <> src)),
pages_reached(url, depth) as (select coalesce(m.target, s.url), 0 from starts s left join moved m on m.src = s.url
  union select coalesce(m.target, h.dst), r.depth + 1 from pages_reached r join shown h on h.src = r.url left join moved m on m.src = h.dst where r.depth < {depth}),
seen as (select url, min(depth) as depth from pages_reached group by url),
sources as (select src, dst from map where src <> dst),
met as (select url, 0 as depth from starts union all select h.dst, s.depth + 1 from seen s join shown h on h.src = s.url where s.depth < {depth}),
via(url, depth) as (select url, depth from met where url in (select src from sources)
  union select m.dst, v.depth from via v join sources m on m.src = v.url where m.dst in (select src from sources)),
visited as (select url, depth, false as via from seen
  union all select url, min(depth), true from via where url not in (select url from seen) group by url)"""
_hop_target = "case when starts_with(redirect_to, '//') then regexp_extract(url, '^([a-z]+:)', 1) || redirect_to else redirect_to end"

SQL["archive_build_full"] = f"""{cte('captures', 'seeds', 'blocklist', 'sitemap', 'edges', 'hops', recursive=True)},
starts as (select {NOFRAG.format('url')} as url from seeds union select {NOFRAG.format('loc')} from (select loc,
    cast(case length(lastmod) when 4 then lastmod || '-01-01' when 7 then lastmod || '-01' else lastmod end as date) as day
  from sitemap) t where day is null or day between date '2021-01-01' and date '2022-12-31'),
hosts as (select distinct {host('url')} as host from starts),
hrefs as (select distinct {NOFRAG.format('a.url')} as src, {NOFRAG.format('b.url')} as dst
  from edges e join pages a on a.page_id = e.src join pages b on b.page_id = e.dst where {host('b.url')} in (select host from hosts)),
map as (select {NOFRAG.format('url')} as src, {NOFRAG.format(_hop_target)} as dst from hops where status in (301, 302, 307, 308)
  qualify row_number() over (partition by src order by ts desc, {_hop_target} desc) = 1),
{_chain.format(depth=3)},
rows_in as (select capture_id, ts, url, status, bytes, digest, attempt from captures
  union all select capture_id, ts, url, status, bytes, digest, attempt from hops),
tried as (select capture_id, ts, {NOFRAG.format('url')} as url, bytes, digest, attempt, status >= 400 as failed from rows_in
  where not regexp_matches(url, '\\?utm_') and not regexp_matches(url, '/96[0-9]')
    and {host('url')} in (select host from hosts) and {host('url')} not in (select host from blocklist)),
numbered as (select *, row_number() over (partition by url order by attempt, capture_id) as nth from tried
  where url in (select url from visited)),
final as (select * from numbered where nth <= 2
  qualify row_number() over (partition by url order by failed, case when failed then -nth else nth end) = 1),
summed as (select *, sum(bytes) over (order by ts, capture_id) - bytes as before, sum(bytes) over () as total_bytes from final),
kept as (select * from summed where before <= {SIZE_LIMIT})
select capture_id, url, bytes, count(*) over () as done, count(*) over () as total, total_bytes > {SIZE_LIMIT} as partial from kept"""

# --- sources and sinks -------------------------------------------------------

SQL["S1_load_seeds"] = "select row_number() over (order by page_id) - 1 as pos, url from pages"
SQL["S2_warc_scan"] = """select url, cast(200 as int) as status, 'text/html' as mime,
  cast(octet_length(encode(html)) as int) as size, md5(html) as digest from pages"""
SQL["S3_union_collections"] = f"""{cte('captures')}
select cast(case collection when 'crawl-2' then 1 when 'crawl-0' then 2 else 3 end as int) as run_no, collection,
  count(*) as captures, cast(sum(bytes) as bigint) as bytes from captures group by all"""
SQL["S4_read_sitemap"] = f"{cte('sitemap')} select loc, lastmod from sitemap"
SQL["S4_sitemap_seeds"] = f"{cte('sitemap', 'seeds')} select url from seeds union select loc from sitemap"
SQL["S5_filter_logs"] = f"""{cte('logs')} select log_id, level, context from logs
where level in ('error', 'warn') and context not in ('recorderNetwork', 'jsError', 'screencast')"""
SQL["S6_write_archive"] = f"{cte('captures')} select capture_id, url, status, bytes, digest from captures"
SQL["S7_build_index"] = f"""{cte('captures')}
select array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || {FILE.format('url')} as key,
  capture_id, url, status, digest, bytes from captures"""
SQL["S7_lookup"] = f"select * from ({SQL['S7_build_index']}) t where starts_with(key, 'net,example,')"
SQL["S7_nearest"] = f"""{cte('captures', 'asked')},
pairs as (select a.page_id, a.url, c.capture_id, c.ts, abs(epoch_us(c.ts) - epoch_us(a.ts)) as apart from asked a left join captures c on c.url = a.url)
select page_id, url, capture_id as nearest_id, cast(floor(epoch(ts)) as bigint) as nearest from pairs
qualify row_number() over (partition by page_id order by apart, ts, capture_id) = 1"""
SQL["S8_rollover_greedy"] = f"""{cte('captures', recursive=True)},
summed as (select capture_id, sum(bytes) over (order by ts, capture_id) - bytes as before from captures),
starts(cut) as (select cast(0 as hugeint) union all
  select (select min(before) from summed where before >= s.cut + 1000000) from starts s where s.cut is not null),
numbered as (select cut, row_number() over (order by cut) - 1 as shard from starts where cut is not null)
select capture_id, n.shard from summed s asof join numbered n on s.before >= n.cut"""
SQL["S9_compact_files"] = f"{cte('captures')} select capture_id, collection, bytes, 'nightly' as operator from captures"
SQL["S8_rollover"] = f"""{cte('captures')}
select capture_id, cast(floor((sum(bytes) over (order by ts, capture_id) - bytes) // 1000000) as bigint) as shard from captures"""
SQL["S9_compact"] = f"{cte('captures')} select capture_id, collection, bytes, 'nightly' as operator from captures"
SQL["S10_page_text"] = f"""select url,
  {squeeze(unescape(f"regexp_replace({visible('html')}, '(?s)<[^>]*>', ' ', 'g')"))} as text from pages"""

SQL["S10_page_text_hostile"] = """select url, 'T'' ' || case page_id % 6 when 0 then 'café ’x — &lt; &nosuch; © go'
  when 1 then 'before' when 2 then 'in' when 3 then '1 < 2' when 4 then '€€' else 'plain text' end as text from pages"""
SQL["G1_extract_links_hostile"] = """with places as (select page_id, url as src, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as root,
    regexp_extract(url, '^([a-z]+):', 1) as scheme from pages),
found as (select src, unnest(case page_id % 6
    when 0 then [root || '/c/' || page_id || '/one/two?a=1&b=2'] when 2 then [root || '/abs']
    when 3 then [root || '/c/up', root || '/c/' || page_id || '/map'] when 4 then [root || '/c/' || page_id || '/here']
    when 5 then [scheme || '://other.example.org/y'] else [] end) as dst from places)
select distinct src, dst from found"""

SQL["G1_extract_links_nested"] = """with places as (select page_id, url as src, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as root from pages),
found as (select src, root || unnest(['/n/' || page_id] || case page_id % 6 when 0 then ['/deep'] when 1 then ['/in', '/lead'] when 2 then ['/after']
    when 3 then [] when 4 then ['/quoted', '/still'] else ['/cell', '/head', '/more'] end) as dst from places)
select distinct src, dst from found"""

# --- URL projections ---------------------------------------------------------

# What a URL may be, written out here: no pattern of the library is reused.
_PLACE = r"(?:[^/?#]*@)?(?:\[[^\]/?#]*\]|[^/?#:@\[]*)"
_SCHEME = "^([a-zA-Z][a-zA-Z0-9+.-]*):"
_EDGES = r"^[\x00-\x20]+|[\t\r\n]"
_DEFAULT_PORT = f"^(?:((?i:https)://{_PLACE}):0*443|((?i:http)://{_PLACE}):0*80)([/?#]|$)"
_PORT = f"^(?i:https?)://{_PLACE}:([^/?#@]*)(?:[/?#]|$)"
_BRACKETS = r"^[^:/?#]*://(?:[^/?#\]]*\[[^/?#\]]*|[^/?#\[]*\][^/?#\[]*)(?:[/?#]|$)"


def _lower_scheme(c: str) -> str:
    name = f"regexp_extract({c}, '{_SCHEME}', 1)"
    return f"lower({name}) || substr({c}, length({name}) + 1)"


def _steps(c: str) -> str:
    for pattern, keep in (
        (_DEFAULT_PORT, r"\1\2\3"),
        ("^([^#]*)#$", r"\1"),
        (r"^([^?#]*)\?(#|$)", r"\1\2"),
        ("^([^?#]*/[^;/?#]*);([?#]|$)", r"\1\2"),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{keep}')"
    return c


SQL["U1_clean_url"] = f"""{cte('spelled')},
trimmed as (select page_id, regexp_replace(url, '{_EDGES}', '', 'g') as raw from spelled),
parted as (select *, regexp_matches(raw, '{_PORT}') as has_port, regexp_extract(raw, '{_PORT}', 1) as port from trimmed)
select page_id, case when (has_port and port <> '' and not (regexp_full_match(port, '[0-9]+') and coalesce(try_cast(port as hugeint) <= 65535, false)))
  or regexp_matches(raw, '{_BRACKETS}') then null else {_steps(_lower_scheme('raw'))} end as clean from parted"""
SQL["U1_collisions"] = f"""{cte('variants')},
entries as (select v.url as spelling, c.host || {FILE.format('c.url')} as entry
  from variants v join captures c on c.capture_id = v.capture_id),
spelled as (select entry, spelling, count(*) as n from entries group by all)
select entry, count(*) as variants, cast(sum(n) as bigint) as captures, max(n) as largest_variant from spelled group by entry"""
SQL["U2_strip_fragment"] = f"select page_id, {NOFRAG.format('url')} as url from pages"
SQL["U3_override_origin"] = f"""{cte('mapping')}
select p.page_id, case when m.origin is null then p.url else m.replacement || substr(p.url, length(m.origin) + 1) end as url
from pages p left join mapping m on m.origin = regexp_extract(p.url, '^([a-z]+://[^/?#]+)', 1)"""
SQL["U4_entry_path"] = f"select page_id, {host('url')} || {FILE.format('url')} as path from pages"

# --- filters -----------------------------------------------------------------

_scope = f"{cte('seeds')} select page_id, url from pages p where exists (select 1 from seeds s where "
SQL["F1_scope_page"] = _scope + "s.url = p.url)"
SQL["F1_scope_page_spa"] = _scope + f"{NOFRAG.format('s.url')} = {NOFRAG.format('p.url')})"
SQL["F1_scope_prefix"] = _scope + f"starts_with(p.url, {DIRECTORY.format('s.url')}))"
SQL["F1_scope_host"] = _scope + f"{host('s.url')} = {host('p.url')})"
_bare = f"regexp_replace({host('s.url')}, '^(www|m|blog)\\.', '')"
SQL["F1_scope_domain"] = _scope + f"{host('p.url')} = {_bare} or ends_with({host('p.url')}, '.' || {_bare}))"
SQL["F1_scope_any"] = "select page_id, url from pages"
SQL["F1_scope_custom"] = "select page_id, url from pages where regexp_matches(url, '\\.html$')"
SQL["F2_include_rx"] = "select page_id, url from pages where regexp_matches(url, '/(en|fr)/[0-9]+\\.html')"
SQL["F3_exclude_rx"] = (
    "select page_id, url from pages where not regexp_matches(url, '\\?utm_') and not regexp_matches(url, '/96[0-9]')"
)
_blocked = "(regexp_matches(url, '//blog\\.') or (regexp_matches(url, '/fr/') and regexp_matches(html, '(?i)nicht')))"
SQL["F4_block"] = f"select page_id, url from pages where not {_blocked}"
SQL["F4_block_message"] = f"""select page_id, case when {_blocked} then md5('blocked by rule') else md5(html) end as digest,
  {_blocked} as blocked from pages"""
SQL["F4_block_table"] = f"""{cte('block_rules')}, hit as (select page_id, bool_or(r.text is null or regexp_matches(html, r.text)) as blocked
  from pages join block_rules r on regexp_matches(url, r.pattern) group by page_id)
select page_id, case when coalesce(blocked, false) then md5('blocked by rule') else md5(html) end as digest, coalesce(blocked, false) as blocked
from pages left join hit using (page_id)"""
SQL["F5_block_hosts"] = f"""{cte('captures', 'blocklist')}
select capture_id, url from captures where host not in (select host from blocklist)"""
SQL["F5_block_hosts_message"] = f"""{cte('captures', 'blocklist')}
select capture_id, case when b.host is null then bytes else 14 end as bytes, b.host is not null as blocked
from captures c left join blocklist b on b.host = c.host"""
SQL["F6_sitemap_between"] = f"""{cte('sitemap')} select loc, lastmod from (select *,
  cast(case length(lastmod) when 4 then lastmod || '-01-01' when 7 then lastmod || '-01' else lastmod end as date) as day from sitemap) t
where day is null or day between date '2021-03-01' and date '2023-03-14'"""
SQL["F7_page_limit"] = f"{cte('captures')} select capture_id, url from captures order by ts, capture_id limit 500"
SQL["F7_page_limit_nulls"] = f"""{cte('timeless')} select capture_id, collection from timeless
qualify row_number() over (partition by collection order by ts nulls first, capture_id) <= 120"""
SQL["F8_size_nulls"] = f"""{cte('timeless')}, summed as (select capture_id, bytes,
    sum(bytes) over (order by ts nulls first, capture_id) - bytes as before from timeless)
select capture_id, bytes from summed where before <= {SIZE_LIMIT}"""
SQL["F7_page_limit_large"] = f"{cte('captures')} select capture_id, url from captures order by ts, capture_id limit 700"


def _per_collection(n: int) -> str:
    return f"""{cte('captures')} select capture_id, collection from captures
qualify row_number() over (partition by collection order by ts, capture_id) <= {n}"""


SQL["F7_page_limit_per_collection"] = _per_collection(100)
SQL["F7_page_limit_per_collection_large"] = _per_collection(250)


def _size_cut(limit: int, mode: str) -> str:
    kept = "before <= {0}" if mode == "soft" else "before <= {0} and total <= {0}"
    return f"""{cte('captures')},
summed as (select capture_id, bytes, sum(bytes) over (order by ts, capture_id) - bytes as before, sum(bytes) over () as total from captures)
select capture_id, bytes, total > {limit} as partial from summed where {kept.format(limit)}"""


def _time_cut(mode: str) -> str:
    kept = "ts <= lo + to_seconds({0})" if mode == "soft" else "hi <= lo + to_seconds({0})"
    return f"""{cte('captures')},
spanned as (select capture_id, bytes, ts, min(ts) over () as lo, max(ts) over () as hi from captures)
select capture_id, bytes, hi > lo + to_seconds({TIME_LIMIT}) as partial from spanned where {kept.format(TIME_LIMIT)}"""


SQL["F8_size_soft"] = _size_cut(SIZE_LIMIT, "soft")
SQL["F8_size_hard"] = _size_cut(SIZE_LIMIT, "hard")
SQL["F8_size_not_hit"] = _size_cut(10**15, "hard")
SQL["F8_time_soft"] = _time_cut("soft")
SQL["F8_time_hard"] = _time_cut("hard")
SQL["F9_with_failed"] = f"{cte('captures')} select capture_id, status = 0 as failed, status >= 400 as failed_strict from captures"

# --- graph -------------------------------------------------------------------

_links = f"""found as (select url as src, unnest(regexp_extract_all({visible('html')}, '(?is)<a\\s[^>]*\\shref\\s*=\\s*"([^"]*)"|<a\\shref="([^"]*)"', 2)) as href from pages),
links as (select distinct src, {NOFRAG.format("regexp_extract(src, '^([a-z]+://[^/?#]+)', 1) || href")} as dst from found)"""
SQL["G1_extract_links"] = f"with {_links} select src, dst from links"


def _walk(edges: str, depth: int, extra: int) -> str:
    """Every state within the bounds; the smallest ones are kept by the caller."""
    cost = "case when e.in_scope then 0 else 1 end" if extra else "0"
    return f"""{cte('seeds', edges, recursive=True)},
walk as (select pos as page_id, 0 as depth, 0 as extra from seeds
  union select e.dst, w.depth + 1, w.extra + {cost} from walk w join {edges} e on e.src = w.page_id
    where w.depth < {depth} and w.extra + {cost} <= {extra})"""


_first = "select page_id, cast(min(depth) as int) as depth from walk group by page_id"
SQL["G2_reach_depth"] = f"{_walk('edges', 2, 0)} {_first}"
SQL["G2_reach_all"] = f"{_walk('edges', 60, 0)} {_first}"
SQL["G2_reach_redirected"] = f"""{cte('seeds', 'edges', 'hops', recursive=True)},
starts as (select url from seeds),
hrefs as (select distinct a.url as src, b.url as dst from edges e join pages a on a.page_id = e.src join pages b on b.page_id = e.dst),
map as (select url as src, {_hop_target} as dst from hops where status in (301, 302, 307, 308)),
{_chain.format(depth=4)}
select url, cast(depth as int) as depth, via from visited"""
SQL["G3_extra_hops"] = f"""{_walk('scoped_edges', 6, 2)}
select page_id, cast(depth as int) as depth, cast(extra as int) as extra from walk a where not exists (
  select 1 from walk b where b.page_id = a.page_id and b.depth <= a.depth and b.extra <= a.extra
    and (b.depth < a.depth or b.extra < a.extra))"""
_ends = """walk as (select src, dst as at from {0} union select w.src, r.dst from walk w join {0} r on r.src = w.at),
ends as (select w.src, max(case when r.src is null or r.dst = r.src then w.at end) as target,
    count(distinct case when w.at <> w.src then w.at end) as steps
  from walk w left join {0} r on r.src = w.at group by w.src)"""
SQL["G4_resolve_redirects"] = f"""{cte('redirects', recursive=True)}, {_ends.format('redirects')}
select src, target, case when target is not null then steps end as hops, target is null as loop from ends"""
SQL["G4_redirect_map_resolved"] = f"""{cte('moved', recursive=True)},
placed as (select ts, url as src, case when starts_with(redirect_to, '/') then regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || redirect_to
    when starts_with(redirect_to, '?') then regexp_replace(url, '[?#].*$', '') || redirect_to else redirect_to end as dst
  from moved where status in (301, 302, 307, 308)),
map as (select src, dst from placed qualify row_number() over (partition by src order by ts desc, dst desc) = 1),
{_ends.format('map')}
select src, target, case when target is not null then steps end as hops, target is null as loop from ends"""
SQL["G5_frontier"] = f"{cte('captures')}, {_links} select dst as url from links except select url from captures"

SQL["G5_saved_deltas"] = f"""{cte('captures')}, {_links}
select dst as url from links union select url from pages except select url from captures"""

# --- deduplication and ranking -----------------------------------------------


def _first_of(key: str) -> str:
    return f"""{cte('captures')} select capture_id, url, digest from captures
qualify row_number() over (partition by {key} order by ts, capture_id) = 1"""


SQL["D1_dedup_skip"] = _first_of("url, digest")
SQL["D1_dedup_skip_digest"] = _first_of("digest")
SQL["D1_dedup_revisit"] = f"""{cte('captures')}, f as (select capture_id,
  first_value(capture_id) over (partition by url, digest order by ts, capture_id) as first_id from captures)
select capture_id, case when first_id <> capture_id then first_id end as revisit_of from f"""
SQL["D1_dedup_keep"] = f"{cte('captures')} select capture_id, url, digest from captures"


def _attempts(retries: int) -> str:
    return f"""tries as (select *, status >= 400 as failed, row_number() over (partition by url order by attempt, capture_id) as nth from captures),
final as (select * from tries where nth <= 1 + {retries}
  qualify row_number() over (partition by url order by failed, case when failed then -nth else nth end) = 1)"""


SQL["D2_final_attempt"] = f"""{cte('captures')}, {_attempts(2)}
select url, capture_id, attempt, status, failed, nth as attempts_used from final"""
SQL["D3_retain_latest"] = f"""{cte('states')} select crawl_id, state_id from states
qualify row_number() over (partition by crawl_id order by ts desc, state_id desc) <= 5"""
SQL["D4_homepage"] = f"""{cte('site_seeds', 'url_redirects', recursive=True)}, {_ends.format('url_redirects')}
select s.url, coalesce(e.target, s.url) as homepage from (select min_by(url, pos) as url from site_seeds) s left join ends e on e.src = s.url"""

# --- reports -----------------------------------------------------------------


def _stats(by: str) -> str:
    pending = "user_agent like 'curl%'"
    counts = f"""count(*) filter (where not {pending} and status < 400) as crawled, count(*) filter (where {pending}) as pending,
  count(*) filter (where not {pending} and status >= 400) as failed, count(*) as total"""
    return f"""{cte('captures')}, stats as (select {by}{counts} from captures {'group by all' if by else ''})
select *, cast(2000 as int) as limit_max, crawled >= 2000 as limit_hit from stats"""


SQL["A1_crawl_stats"] = _stats("")
SQL["A1_crawl_stats_by_collection"] = _stats("collection, ")
SQL["A2_failed_seeds"] = f"""{cte('captures', 'site_seeds')}, {_attempts(1)}
select pos, url from site_seeds where url in (select url from final where failed)"""
SQL["A3_failed_limit"] = f"""{cte('captures')} select collection, count(*) filter (where status >= 400) as failed,
  count(*) filter (where status >= 400) > 1200 as exceeded from captures group by collection"""
_runs = f"""{cte('runs')}, named as (select *, case when exit_code in (0, 100) then 'complete'
  when (exit_code = 14 and soft_size) or (exit_code = 15 and soft_time)
    or coalesce(list_contains(string_split(accepted_codes, ','), cast(exit_code as varchar)), false) then 'partial'
  when exit_code = 2 then 'rejected' else 'failed' end as outcome from runs),
judged as (select *, outcome in ('complete', 'partial') as converts from named),
flagged as (select *, case when has_progress and converts then outcome = 'partial' end as partial_flag from judged)"""
SQL["A4_classify_runs"] = f"""{_runs} select run_id, outcome, converts,
  cast(case when converts then 0 else exit_code end as int) as final_code, partial_flag from flagged"""
SQL["A4_outcome_counts"] = f"""{_runs} select outcome, count(*) as runs,
  count(*) filter (where partial_flag) as flagged from flagged group by outcome"""
_progress = f"""{cte('crawl_updates', 'convert_updates')}, updates as (
  select collection, ts, crawled as done, cast(trunc(total / 0.9::double) as bigint) as total from crawl_updates union all
  select collection, ts, cast(trunc(total * (0.9::double + (written::double / total) / 10.0::double)) as bigint), total
  from convert_updates where total > 0)
select collection, done, total from updates
qualify row_number() over (partition by collection order by ts desc, done desc, total desc) = 1"""
SQL["A5_progress"] = _progress


def _agents(by: str) -> str:
    asked = "rec_type = 'request' and user_agent <> ''"
    return f"""{cte('captures')}, counted as (select {by}, count(*) filter (where {asked}) as requests,
  count(*) filter (where {asked} and not contains(user_agent, 'Mozilla')) as no_mozilla,
  count(*) filter (where {asked} and not ends_with(user_agent, ' +Bot test@example.com')) as no_suffix from captures group by {by})
select *, requests > 0 and no_mozilla = 0 and no_suffix = 0 as passed from counted"""


SQL["A6_ua_audit"] = _agents("collection")
SQL["A6_ua_audit_by_host"] = _agents("host")
SQL["S2_warc_to_ua_audit"] = _agents("host")
SQL["S2_warc_to_dedup"] = f"""{cte('captures')} select 'capture ' || capture_id as capture_id, url, digest from captures
qualify row_number() over (partition by url, digest order by ts, 'capture ' || capture_id) = 1"""
SQL["A7_charset_audit"] = f"""{cte('typed')}, declared as (select *,
  nullif(lower(regexp_extract(content_type, '(?i)charset="?([a-zA-Z0-9_-]+)', 1)), '') as in_http,
  nullif(lower(regexp_extract(html, '(?i)<meta charset="?([a-zA-Z0-9_-]+)', 1)), '') as in_html from typed),
chosen as (select host, damaged, case coalesce(in_http, in_html) when 'utf8' then 'utf-8' else coalesce(in_http, in_html) end as charset,
  case when in_http is null then 'content' else 'http' end as charset_source from declared),
tested as (select *, case charset when 'utf-8' then not damaged when 'iso-8859-1' then true end as ok from chosen)
select host, charset, charset_source, count(*) as captures, count(*) filter (where ok) as decodable,
  count(*) filter (where not ok) as broken, count(*) filter (where ok is null) as untested from tested group by all"""
_title = squeeze(unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))
_codes = ", ".join(f"('{two}', '{three}')" for two, three in languages.PAIRS)
SQL["A8_site_metadata"] = f"""{cte('site_seeds', 'overrides')}, codes(two, three) as (values {_codes}),
found as (select {host('s.url')} as site, s.url as homepage, {_title} as page_title,
    lower(regexp_extract(p.html, '<html lang="([a-zA-Z]+)', 1)) as code
  from site_seeds s join pages p on p.url = s.url)
select f.site, homepage, f.site as "Name", coalesce(o.title, page_title) as "Title", cast(null as varchar) as "Description",
  cast(null as varchar) as "LongDescription", o.creator as "Creator", cast(null as varchar) as "Publisher",
  coalesce(c.three, 'eng') as "Language", cast(null as varchar) as "Illustration"
from found f left join overrides o on o.site = f.site left join codes c on c.two = f.code"""

# --- quality -----------------------------------------------------------------

SQL["Q1_missing_entries"] = f"""{cte('captures', 'expected')}
select distinct host || '/' || expected_page as path from expected
except select host || '/' || page_id from captures where bytes > 0"""
_checks = [
    ("name", "pattern", "not regexp_matches(name, '^([a-z0-9\\-\\.]+_)([a-z\\-]+_)([a-z0-9\\-\\.]+)$')"),
    *[
        (flag, f"{end}_graphemes", f"length_grapheme({flag}) {test}")
        for flag, most in (("title", 30), ("description", 80), ("long_description", 4000))
        for end, test in (("min", "< 1"), ("max", f"> {most}"))
    ],
    ("workers", "min", "cast(workers as bigint) < 1"),
    ("scope_type", "choices", "scope_type not in ('page', 'page-spa', 'prefix', 'host', 'domain', 'any', 'custom')"),
]
SQL["Q2_check_recipes"] = cte("recipes") + " union all ".join(
    f" select recipe_id, '{flag}' as flag, '{constraint}' as \"constraint\" from recipes where {test}"
    for flag, constraint, test in _checks
)
_words = "list_filter(list_distinct(regexp_split_to_array(lower(text), '\\s+')), lambda w: w <> '')"
_side = "select 'https://docs.example.org/' || doc_id as url, text, " + _words + " as words from {}"
SQL["Q3_qa_compare"] = f"""{cte('replay')}, c as ({_side.format('documents')}), r as ({_side.format('replay')}),
b as (select coalesce(c.url, r.url) as url, c.text as ct, r.text as rt, c.words as cw, r.words as rw,
    len(list_intersect(c.words, r.words)) as both_words from c full join r on c.url = r.url)
select url, case when rt is null then 'crawl_only' when ct is null then 'replay_only' else 'both' end as presence,
  ct = rt as same_text, case when rt is not null then cast(length(rt) * 1000 // nullif(length(ct), 0) as bigint) end as size_permille,
  case when ct is not null and rt is not null then both_words end as shared,
  case when ct is not null and rt is not null then len(cw) + len(rw) - both_words end as tokens from b"""

_spaced = "list_filter(list_distinct(regexp_split_to_array(lower({}), '\\s+')), lambda w: w <> '')"
SQL["Q3_qa_compare_spellings"] = f"""with sides as (select 'https' || regexp_replace(url, '^[a-z]+', '') as url, unnest([html, reverse(html)]) as text
  from pages), c as (select url, arg_max(text, (length(text), md5(text))) as text from sides group by url), r as (select 'https' || regexp_replace(url, '^[a-z]+', '') as url,
  'T'' ' || case page_id % 6 when 0 then 'café ’x — &lt; &nosuch; © go' when 1 then 'before' when 2 then 'in' when 3 then '1 < 2'
    when 4 then '€€' else 'plain text' end as text from pages)
select c.url, 'both' as presence, c.text = r.text as same_text, cast(length(r.text) * 1000 // length(c.text) as bigint) as size_permille,
  len(list_intersect({_spaced.format('c.text')}, {_spaced.format('r.text')})) as shared,
  len({_spaced.format('c.text')}) + len({_spaced.format('r.text')})
    - len(list_intersect({_spaced.format('c.text')}, {_spaced.format('r.text')})) as tokens
from c join r on c.url = r.url"""

# --- streams -----------------------------------------------------------------

_captured = """captured as (select ts, concat('crawl-', cast(event_id % 3 as varchar)) as collection, event_type,
  cast(round(value * 100) as bigint) as bytes, event_type in ('error', 'signup') as failed, user_id, event_id from events)"""
_closed = "date_trunc('{0}', ts) + interval 1 {0} <= (select max(ts) from captured) - interval 10 minute"
SQL["T1_progress_stream"] = _progress
SQL["T2_crawl_stats_stream"] = f"""with {_captured}
select cast(epoch(date_trunc('hour', ts)) as bigint) as start, collection, count(*) filter (where not failed) as crawled,
  count(*) filter (where failed) as failed, count(*) as total from captured where {_closed.format('hour')} group by all"""
SQL["T3_dedup_stream"] = f"""with {_captured},
seen as (select concat('https://u.example.org/', cast(user_id as varchar), '/', event_type) as url, event_id as capture_id, ts
  from captured where {_closed.format('hour')})
select url, capture_id from seen qualify row_number() over (partition by url order by ts, capture_id) = 1"""
SQL["T3_first_merged"] = """select concat('https://u.example.org/', cast(user_id as varchar), '/', event_type) as url, event_id as capture_id from events
qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1"""
SQL["T4_limit_monitor"] = f"""with {_captured},
minutes as (select collection, date_trunc('minute', ts) + interval 1 minute as m, sum(bytes) as b
  from captured where {_closed.format('minute')} group by all),
sums as (select collection, m, sum(b) over (partition by collection order by m) as total from minutes)
select collection, cast(epoch(m) as bigint) as "end", cast(total as bigint) as bytes from sums where total > 500000
qualify row_number() over (partition by collection order by m) = 1"""
