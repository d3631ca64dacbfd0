"""Derived input tables, as SQL that Spark and DuckDB both run.

The given tables hold no captures, links or logs.  These SELECTs derive them
with one row or more per given row, so the work of a query grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOST = r"regexp_extract({}, '^[a-z]+://([^/:?#]+)', 1)"

SQL = {
    "captures": f"""
select /*+ SHUFFLE_HASH(p) */ e.event_id as capture_id, concat('crawl-', cast(e.event_id % 3 as string)) as collection,
  e.ts, p.page_id, p.url, {HOST.format('p.url')} as host,
  case when e.event_type = 'view' then 'request' else 'response' end as rec_type,
  case e.event_type when 'error' then 500 when 'signup' then 404 when 'click' then 301 else 200 end as status,
  cast(round(e.value * 100) as bigint) as bytes,
  p.digest, e.attempt,
  case when e.event_id % 17 = 0 then 'curl/8' else 'Mozilla/5.0 (X) +Bot test@example.com' end as user_agent
from (select event_id, ts, event_type, value, event_id % (select count(*) from pages) as page_id,
        cast(floor(event_id / (1.0 * (select count(*) from pages))) as bigint) + 1 as attempt from events) e
join (select page_id, url, md5(html) as digest from pages) p on p.page_id = e.page_id""",
    "moved": """
select capture_id, ts, url, cast(case capture_id % 6 when 0 then 301 when 1 then 302 when 2 then 307 when 3 then 308 else 200 end as int) as status,
  case capture_id % 4 when 0 then '/moved/x' when 1 then '?p=1' when 2 then 'https://m.example.org/' else url end as redirect_to
from captures""",
    "timeless": """
select capture_id, case when capture_id % 50 = 7 then null else ts end as ts,
  case when capture_id % 47 = 3 then null else collection end as collection, bytes from captures""",
    "odd_pages": """
select page_id, url, concat('<html><head><base href="/c/', cast(page_id as string), '/x"><title>T&#39;</title></head>',
  case page_id % 6
    when 0 then '<p title=''a>b''>caf&eacute; &#8217;x &#x2014; &amp;lt; &nosuch; &copy;</p><a href="one&#x2f;two?a=1&amp;b=2">go</a>'
    when 1 then '<p>before</p><!-- open <a href="/no">'
    when 2 then '<script>var a = "<p>no</p>";</script ><a href=''/abs''>in</a><script>never closed <a href="/no2">'
    when 3 then '<a title="x > y" href="../up">1 < 2</a><area class="big nav" shape="rect" href="map"><area class="nav" href="no3">'
    when 4 then '<a href="./here#frag">&euro;&#128;</a><p class="open <a href="/no4">'
    else '<style>p { }</style><a href="//other.example.org/y">plain</a> text' end) as html
from pages""",
    "nested_pages": """
select page_id, url, concat('<html><body><a href="/top">t</a><nav class="main"><ul><li><a href="/n/', cast(page_id as string), '">n</a>', case page_id % 6
    when 0 then '<li><p>open<li><b><a href="/deep">d</a></b></ul></nav><a href="/out">o</a>'
    when 1 then '</li><li><ul><li class="x"><a href="/in">i</a></ul></li></ul></nav><h2>T</h2><p>a<a href="/lead">l</a><p><a href="/second">s</a>'
    when 2 then '<br><img src="/i"></ul><a href="/beside">b</a></nav><h2>T<br></h2>text<p class="x"><a href="/after">a</a></p>'
    when 3 then '</div></ul></ul></nav><div><!-- <nav><li><a href="/no"> --><a href="/plain">p</a></div><h2></h2><div></div><p><a href="/late">l</a>'
    when 4 then '<li class="x"><a title="</nav>" href="/quoted">q</a><script>"</ul></nav>"</script><li><a href="/still">s</a></ul></nav>'
    else '<table><tr><td>1<td><a href="/cell">c</a><tr><th><a href="/head">h</a></table><a href="/more">m</a></nav></ul><a href="/end">e</a>' end) as html
from pages""",
    "site_seeds": f"""
select f.pos, p.url from (select min(page_id) as pos from pages group by {HOST.format('url')}) f
join pages p on p.page_id = f.pos""",
    "seeds": f"""
select f.pos, p.url from (select min(page_id) as pos from pages where url like '%/es/%' or url like '%/de/%'
  group by {HOST.format('url')}) f join pages p on p.page_id = f.pos""",
    "spelled": f"""
select page_id, case page_id % 8
  when 0 then concat(substr(url, 1, k), ':443', substr(url, k + 1)) when 1 then concat(substr(url, 1, k), ':80', substr(url, k + 1))
  when 2 then concat('HTTPS', substr(url, 6)) when 3 then concat(url, '#') when 4 then concat(substr(url, 1, k), ':99999', substr(url, k + 1))
  when 5 then concat(substr(url, 1, k), ':00080/a?') when 6 then concat(substr(url, 1, k), ':8080', substr(url, k + 1)) else url end as url
from (select page_id, url, length(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) as k from pages) t""",
    "variants": f"""
select capture_id, case capture_id % 3 when 0 then url
  when 1 then concat(substr(url, 1, k), case when url like 'https:%' then ':443' else ':80' end, substr(url, k + 1))
  else concat(upper(substr(url, 1, 4)), substr(url, 5)) end as url
from (select capture_id, url, length(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) as k from captures) t""",
    "mapping": f"""
select distinct regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as origin,
  concat('http://mirror.', {HOST.format('url')}, ':8080') as replacement from pages where url like '%//blog.%'""",
    "scoped_edges": """
select e.src, e.dst, p.url like '%/en/%' as in_scope from edges e join pages p on p.page_id = e.dst""",
    "url_redirects": """
select a.url as src, b.url as dst from redirects r join pages a on a.page_id = r.src join pages b on b.page_id = r.dst""",
    "crawl_updates": """
select collection, max(ts) as ts, count(case when status < 400 then 1 end) as crawled, count(*) as total
from captures group by collection, date_trunc('hour', ts)""",
    "convert_updates": """
select collection, max(ts) as ts, count(case when bytes > 1000 then 1 end) as written, count(*) as total
from captures where rec_type = 'request' group by collection, date_trunc('hour', ts)""",
    "overrides": f"""
select distinct {HOST.format('url')} as site, concat('Site ', upper({HOST.format('url')})) as title, 'An author' as creator
from pages where url like '%//www.%'""",
    "typed": f"""
select page_id, {HOST.format('url')} as host, html, case page_id % 5 when 0 then 'text/html' when 1 then 'text/html; charset=UTF-8'
  when 2 then 'text/html; charset=ISO-8859-1' when 3 then 'text/html; charset=x-other' else 'text/html; charset="utf8"' end as content_type,
  page_id % 7 = 3 as damaged from pages""",
    "sitemap": """
select url as loc, case page_id % 4 when 0 then concat('20', cast(20 + page_id % 5 as string))
  when 1 then concat('202', cast(page_id % 5 as string), '-0', cast(1 + page_id % 9 as string))
  when 2 then concat('202', cast(page_id % 5 as string), '-03-1', cast(page_id % 10 as string)) else null end as lastmod
from pages""",
    "edges": """
select t.src, t.dst from (
  select page_id as src, page_id * 2 + 1 as dst from pages union all
  select page_id, page_id * 2 + 2 from pages union all
  select page_id, (page_id * page_id + 3) % (select count(*) from pages) from pages) t
join pages p on p.page_id = t.dst""",
    "redirects": """
select page_id as src, case when page_id % 11 = 5 then page_id + 1 when page_id % 11 = 6 then page_id - 1
  when page_id % 7 in (1, 2, 3) then page_id + 1 else page_id end as dst from pages""",
    "hops": """
select -1 - a.page_id as capture_id, e.ts, a.url, cast(case a.page_id % 5 when 0 then 301 when 1 then 302 when 2 then 307 when 3 then 308 else 200 end as int) as status,
  cast(100 as bigint) as bytes, md5(a.url) as digest, cast(0 as bigint) as attempt,
  case a.page_id % 3 when 0 then regexp_replace(b.url, '^[a-z]+:', '') else b.url end as redirect_to
from redirects r join pages a on a.page_id = r.src join pages b on b.page_id = r.dst join events e on e.event_id = a.page_id where r.src <> r.dst""",
    "asked": """
select p.page_id, p.url, e.ts + interval 40 minutes as ts from pages p join events e on e.event_id = p.page_id * 3 + 1""",
    "block_rules": """
select case page_id % 4 when 0 then concat('/', regexp_extract(url, '/([a-z][a-z]/[0-9]+)', 1), '([/?.#]|$)')
    when 1 then concat('^https?://(?:www|blog)[.].*/', cast(page_id as string), '[^0-9]')
    when 2 then concat('/', regexp_extract(url, '/([a-z][a-z]/[0-9]+)', 1), '[?#]') else concat('/none/', cast(page_id as string), '/x') end as pattern,
  case page_id % 4 when 2 then '<h1>[A-M]' else null end as text from pages union all
select concat('/tracked/', cast(doc_id as string), '[?]ref=', lang), case when doc_id % 2 = 0 then lang else null end from documents union all
select distinct concat('[', substr(lang, 1, 1), ']', substr(lang, 2, 1), '/[1-3]..$'), '[Ee]n' from documents where lang is not null""",
    "blocklist": f"""
select distinct {HOST.format('url')} as host from pages where url like '%pills%' or url like '%spam%' or url like '%casino%' or url like '%ads-%'""",
    "logs": """
select event_id as log_id, ts, case event_type when 'error' then 'error' when 'click' then 'warn' else 'info' end as level,
  case user_id % 5 when 0 then 'general' when 1 then 'recorderNetwork' when 2 then 'jsError' when 3 then 'screencast' else 'links' end as context
from events""",
    "runs": """
select o_orderkey as run_id, o_custkey as recipe_id,
  cast(case o_orderkey % 6 when 0 then 0 when 1 then 2 when 2 then 14 when 3 then 15 when 4 then 100 else 1 end as int) as exit_code,
  o_orderkey % 4 = 2 as soft_size, o_orderkey % 5 = 3 as soft_time, o_orderkey % 3 = 1 as has_progress,
  case when o_orderkey % 7 = 0 then '1,137' else null end as accepted_codes from orders""",
    "states": """
select o_custkey as crawl_id, o_orderkey as state_id, o_orderdate as ts from orders""",
    "recipes": """
select doc_id as recipe_id, concat(case when doc_id % 9 = 0 then 'BAD' else source end, '_', lang, '_', cast(doc_id as string)) as name,
  cast(null as string) as title, cast(null as string) as description, text as long_description,
  cast(cast(doc_id % 7 - 1 as int) as string) as workers,
  case doc_id % 5 when 0 then 'page' when 1 then 'host' when 2 then 'prefix' when 3 then 'everything' else null end as scope_type
from documents union all
select -1 - conv_id * 1000 - turn, concat(role, '_en_', cast(conv_id as string)), text, text, text, cast(turn as string), role from conversations""",
    "replay": """
select d.doc_id, case when l.toxic = 1 then replace(d.text, 'e', 'a') when l.quality = 0 then concat(d.text, ' ', d.source) else d.text end as text
from documents d join labels l on l.doc_id = d.doc_id
union all select -1 - item_id, text from benchmark""",
    "expected": f"""
select host, max(page_id) + max(page_id) % 2 as expected_page
from (select p.page_id, {HOST.format('p.url')} as host from pages p) t group by host""",
}

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NEEDS = {
    "variants": ("captures",),
    "timeless": ("captures",),
    "moved": ("captures",),
    "scoped_edges": ("edges",),
    "url_redirects": ("redirects",),
    "hops": ("redirects",),
    "crawl_updates": ("captures",),
    "convert_updates": ("captures",),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in :data:`SQL`."""
    for base in NEEDS.get(name, ()):
        derived(spark, sf_dir, base).createOrReplaceTempView(base)
    text = SQL[name]
    for table in GIVEN:
        if f" {table}" in text:
            given(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(text)


def cte(*names: str, recursive: bool = False) -> str:
    """``with a as (...), b as (...)`` for a DuckDB statement."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*NEEDS.get(name, ()), name) if n not in order]
    return ("with recursive " if recursive else "with ") + ",\n".join(f"{n} as ({SQL[n]})" for n in order)
