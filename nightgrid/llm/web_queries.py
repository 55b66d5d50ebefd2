"""Queries over the pages table with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightgrid.llm import urlfilter, warc


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records from pages, in the order of page_id.

    A third of the captures, by a mix of the id, are not-modified answers.  Of
    the ids modulo 5, one class has another version of the entity tag; of those
    modulo 7, one has no tag and one has neither validator.
    """
    crc = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1000003)) * 48271 % 2147483647
    revisit = crc % 3 == 1
    site = F.coalesce(warc.canonical_url(F.col("url")), F.lit(""))
    tag = F.when(crc % 7 > 1, F.concat(F.lit('"'), F.md5(site.cast("binary")), F.when(crc % 5 == 0, "-b").otherwise("-a"), F.lit('"')))
    date = F.when(crc % 7 > 0, F.concat(F.lit("day "), (F.length(site) % 28).cast("string")))
    values = {
        "content-type": F.lit("text/html"),
        "content-length": F.when(revisit, "0").otherwise(F.length("html").cast("string")),
        "cache-control": F.when(revisit, "max-age=60").otherwise("max-age=10"),
        "etag": tag,
        "last-modified": date,
        "date": F.when(revisit, F.col("page_id").cast("string")),
        "server": F.when(~revisit, F.col("page_id").cast("string")),
    }
    fields = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    headers = F.map_from_entries(F.filter(fields, lambda x: x["value"].isNotNull()))
    return pages.select(F.col("page_id").alias("record_id"), "url", F.col("page_id").alias("at"), revisit.alias("revisit"), headers.alias("headers"), F.when(~revisit, F.md5(F.coalesce("html", F.lit("")).cast("binary"))).alias("body_id"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    fields = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return got.select(F.col("record_id").alias("page_id"), F.col("canonical").alias("canonical_url"), "status", F.col("source_id").alias("source_page_id"), "body_id", F.array_join(fields, "; ").alias("headers"))


_LIKE = " or ".join("u similar to '" + g.replace(".", "[.]").replace("**", "\x00").replace("*", "[^/]*").replace("\x00", "(.|\\n)*") + "'" for v, g in urlfilter.GLOBS if v == "block")
_ALLOW = next(g for v, g in urlfilter.GLOBS if v == "allow")
_SITES = ", ".join(f"('{v}', '{s}')" for v, s in urlfilter.SITE_RULES)
OP4_SQL = f"""
with rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (
  select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
sites(verdict, rule) as (values {_SITES}),
split as (select verdict, rule, split_part(rule, '/', 1) as h, substr(rule, strpos(rule, '/')) as p from sites),
urls as (select distinct host, path, host || path as u from parts),
best as (
  select host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as v
  from urls join split on (host = h or suffix(host, '.' || h)) and starts_with(path, p) group by all)
select page_id, host, path, rule, coalesce(v, case when suffix(u, '/robots.txt') then 'allow' when {_LIKE} then 'block' else 'allow' end) as verdict
from parts join urls using (host, path) left join best using (host, path)
"""
OP6_SQL = r"""
with cut as (
  select page_id, url, html, case when strpos(url, '://') > 0 then regexp_replace(substr(url, strpos(url, '://') + 3), '#.*$', '') end as r from pages),
canon as (
  select page_id, html, ltrim(regexp_replace(regexp_extract(r, '[?](.*)$', 1), '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '&') as q,
    regexp_replace(regexp_replace(lower(regexp_extract(r, '^([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/+$', ''), '[.]html$', '') as site from cut),
named as (select page_id, html, site || case when q <> '' then '?' || q else '' end as c, (page_id % 1000003) * 48271 % 2147483647 as crc from canon),
rec as (
  select page_id, c, crc % 3 = 1 as revisit, crc,
    case when crc % 7 > 1 then '"' || md5(coalesce(c, '')) || case when crc % 5 = 0 then '-b' else '-a' end || '"' end as etag,
    case when crc % 7 > 0 then 'day ' || (length(coalesce(c, '')) % 28) end as lm,
    case when crc % 3 <> 1 then md5(coalesce(html, '')) end as body, length(html) as size from named),
found as (select v.page_id, max(f.page_id) as src from rec v join rec f on v.c = f.c and f.page_id < v.page_id and not f.revisit where v.revisit group by 1),
judged as (
  select v.*, f.page_id as src, f.etag as fe, f.lm as fl, f.body as fb, f.size as fs,
    case when not v.revisit then 'full' when f.page_id is null then 'missing' when v.etag is null and v.lm is null then 'unverified'
      when v.etag is not null and v.etag is not distinct from f.etag then 'resolved' when v.etag is null and v.lm is not distinct from f.lm then 'resolved' else 'mismatch' end as status
  from rec v left join found using (page_id) left join rec f on f.page_id = found.src)
select page_id, c as canonical_url, status, case when status = 'resolved' then src end as source_page_id, case when status = 'resolved' then fb else body end as body_id,
  concat_ws('; ', 'cache-control: max-age=' || case when revisit then '60' else '10' end,
    'content-length: ' || case when status = 'resolved' then fs when revisit then 0 else size end, 'content-type: text/html',
    case when revisit then 'date: ' || page_id end,
    'etag: ' || case when status = 'resolved' then coalesce(etag, fe) else etag end,
    'last-modified: ' || case when status = 'resolved' then coalesce(lm, fl) else lm end,
    case when status = 'resolved' then 'server: ' || src when not revisit then 'server: ' || page_id end) as headers
from judged
"""
ORACLES = {"op4_url_filters": OP4_SQL, "op6_revisits": OP6_SQL}
QUERIES = {"op4_url_filters": op4_url_filters, "op6_revisits": op6_revisits}
