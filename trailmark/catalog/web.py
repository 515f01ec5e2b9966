"""Pages as scripts and crawls: hosts, paths, categories, platforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cookies
from ..functions.text import day_of, looks_like_html
from ..functions.urls import asset, asset_version, comparable_url, host, on_platform, page_or_unknown, plain_host, plugin_version, short_path, stack_source, url_category, weak_host
from ..operators import aggregates, filters, joins
from ..session import table
from .registry import query

HOST = "nullif(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:]*)', 1)), '')"
PATH = "nullif(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '')"
H = f"h AS (SELECT page_id, url, {HOST} AS host, {PATH} AS path FROM pages)"
PLATFORMS = ("example.com", "ththth.example.net")


@query(f"WITH {H} SELECT page_id, host, array_to_string(string_split(host, '.')[:-2], '.') AS weak, CASE WHEN host LIKE '%example.com' THEN 'com' ELSE 'weak_domain=' || array_to_string(string_split(host, '.')[:-2], '.') END AS category, CASE WHEN length(path) > 8 THEN substr(path, 1, 7) || '…' ELSE path END AS short, regexp_replace(host, '^www\\.', '') AS plain, regexp_replace(replace(replace(url, 'https://', ''), 'http://', ''), '/+$', '') AS comparable FROM h")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", host("url").alias("host"), weak_host(host("url")).alias("weak"), F.when(F.endswith(host("url"), F.lit("example.com")), "com").otherwise(url_category("url")).alias("category"), short_path("url", 8).alias("short"), plain_host("url").alias("plain"), comparable_url("url").alias("comparable"))


@query(f"WITH {H} SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'domain:data' WHEN page_id % 5 = 1 THEN 'domain:relative' WHEN page_id % 5 = 2 THEN 'domain:ad' WHEN page_id % 5 = 3 THEN 'domain:script-origin' ELSE 'weak_domain=' || array_to_string(string_split(host, '.')[:-2], '.') END AS category FROM h")
def url_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    url = F.when(k == 0, F.concat(F.lit("data:"), "url")).when(k == 1, F.concat(F.lit("/x/"), "url")).when(k == 2, F.concat(F.lit("https://a.adnxs.com/"), "page_id")).otherwise(F.col("url"))
    own = F.when(k == 3, host("url"))
    return table(spark, sf_dir, "pages").select("page_id", url_category(url, own).alias("category"))


@query(f"WITH {H} SELECT platform, count(page_id)::BIGINT AS n FROM (VALUES ('example.com'), ('ththth.example.net'), ('none.example')) v(platform) LEFT JOIN h ON host = platform OR host LIKE '%.' || platform GROUP BY 1")
def platform_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(host("url").alias("host"))
    return aggregates.platform_counts(hosts, spark.createDataFrame([("example.com",), ("ththth.example.net",), ("none.example",)], "platform string"))


@query(f"WITH {H} SELECT page_id, (host = 'example.com' OR host LIKE '%.example.com' OR host = 'ththth.example.net' OR host LIKE '%.ththth.example.net') AS hosted FROM h")
def denylist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", on_platform(host("url"), PLATFORMS).alias("hosted"))


@query(f"WITH {H} SELECT page_id % 10 AS cluster, count(DISTINCT url)::BIGINT AS n_urls, array_to_string(list_sort(list(DISTINCT host)), ',') AS domains FROM h GROUP BY 1")
def urls_domains_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("cluster"), F.col("url").alias("script_url"), host("url").alias("domain"))
    return aggregates.urls_and_domains(own).select("cluster", F.size("urls").cast("long").alias("n_urls"), F.array_join("domains", ",").alias("domains"))


@query(f"WITH {H}, t AS (SELECT host, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, host LIMIT 10) SELECT coalesce(t.host, 'Other') AS shown, count(*)::BIGINT AS n FROM h LEFT JOIN t USING (host) GROUP BY 1")
def domain_top_or_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = aggregates.top_or_other(table(spark, sf_dir, "pages").select(host("url").alias("domain")), "domain")
    return own.groupBy("shown").agg(F.count("*").alias("n"))


@query(f"WITH {H} SELECT page_id % 10 AS cluster, host AS domain, count(DISTINCT page_id)::BIGINT AS n FROM h GROUP BY ALL")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.domain_counts(table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("cluster"), F.col("page_id").alias("trace_id"), host("url").alias("domain")))


@query("SELECT page_id, (trim(html) = '' OR ltrim(html) LIKE '<%' OR regexp_matches(lower(substr(html, 1, 200)), '<(!doctype|html|head|body|script|div)\\b')) AS html_like, false AS url_html_like FROM pages")
def html_like_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", looks_like_html("html").alias("html_like"), looks_like_html("url").alias("url_html_like"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'plugin' WHEN 1 THEN 'theme' END AS kind, CASE page_id % 3 WHEN 0 THEN 'slider-' || page_id % 4 WHEN 1 THEN 'astra' END AS name, CASE page_id % 3 WHEN 0 THEN '1.' || page_id % 7 WHEN 1 THEN '2.' || page_id % 5 || '.1' END AS version FROM pages")
def asset_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("page_id") % 3, lambda n: (F.col("page_id") % n).cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://a.example/wp-content/plugins/slider-"), s(4), F.lit("/x.js?v=9&ver=1."), s(7))).when(k == 1, F.concat(F.lit("https://a.example/WP-content/themes/astra/app-2."), s(5), F.lit(".1.css"))).otherwise(F.lit("https://a.example/x.js?ver=3"))
    a = asset(url)
    return table(spark, sf_dir, "pages").select("page_id", a["kind"].alias("kind"), a["name"].alias("name"), a["version"].alias("version"))


@query("SELECT page_id, 'slider-' || page_id % 4 AS name, CASE page_id % 3 WHEN 0 THEN '1.' || page_id % 7 WHEN 1 THEN '5.1' END AS version FROM pages")
def plugin_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("page_id") % 3, lambda n: (F.col("page_id") % n).cast("string")
    url = F.concat(F.lit("https://a.example/wp-content/plugins/Slider-"), s(4), F.lit("/x.js"), F.when(k == 0, F.concat(F.lit("?ver=1."), s(7))).when(k == 1, "?5.1").otherwise("?t=4"))
    p = plugin_version(url)
    return table(spark, sf_dir, "pages").select("page_id", p["name"].alias("name"), p["version"].alias("version"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'sid,k' || page_id % 3 END AS keys, CASE WHEN page_id % 2 = 0 THEN '/p' || page_id % 4 END AS path, CASE WHEN page_id % 2 = 0 THEN 'secure,httponly' ELSE 'secure' END AS flags FROM pages")
def cookie_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda n: (F.col("page_id") % n).cast("string")
    cookie = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("sid=1; Path = /p"), s(4), F.lit("; k"), s(3), F.lit("=2; sid=3; Secure; HttpOnly; secure"))).otherwise("Secure; domain=a.example")
    return table(spark, sf_dir, "pages").select("page_id", cookies.keys(cookie).alias("keys"), cookies.attribute(cookie, "path").alias("path"), cookies.flags(cookie).alias("flags"))


@query(f"WITH {H} SELECT page_id, host || CASE WHEN length(path) > 80 THEN substr(path, 1, 79) || '…' ELSE coalesce(path, '') END AS source FROM h")
def stack_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = F.concat(F.lit("Error\n  at f ("), F.col("url"), F.lit(":10:5)\n  at g (https://b.example/y.js:1)"))
    return table(spark, sf_dir, "pages").select("page_id", stack_source(stack).alias("source"))


@query(f"WITH {H} SELECT page_id % 100 AS crawl_id, min(page_id) AS report_id FROM h GROUP BY 1")
def crawl_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls joined with reports of the same day and URL, in forms that differ by scheme, www and a slash."""
    p = table(spark, sf_dir, "pages")
    name = F.concat(F.lit("site"), (F.col("page_id") % 100).cast("string"), F.lit(".example/a"))
    crawls = p.select((F.col("page_id") % 100).alias("crawl_id"), F.lit("20250101-120000").alias("folder"), F.concat(F.lit("https://www."), name).alias("url")).distinct()
    reports = p.select(F.col("page_id").alias("report_id"), F.lpad(F.col("page_id").cast("string"), 10, "0").alias("file"), F.lit("20250101").alias("folder"), F.concat(F.lit("http://"), name, F.lit("/")).alias("url"))
    return joins.crawl_reports(crawls, reports)


@query("SELECT DISTINCT CASE WHEN page_id % 4 = 0 THEN 'unknown://t' || page_id ELSE 'https://p' || page_id % 20 END AS page_url, 't' || page_id AS trace_id FROM pages")
def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.page_edges(_traces(spark, sf_dir))


@query("SELECT CASE WHEN page_id % 4 = 0 THEN 'unknown://t' || page_id ELSE 'https://p' || page_id % 20 END AS page_url, coalesce(max(CASE WHEN page_id % 3 = 0 THEN page_id % 11 END), -1)::BIGINT AS verdict FROM pages GROUP BY 1")
def page_max_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.page_verdicts(_traces(spark, sf_dir)).withColumn("verdict", F.col("verdict").cast("long"))


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("t"), i.cast("string")).alias("trace_id"), F.when(i % 4 == 0, " ").otherwise(F.concat(F.lit("https://p"), (i % 20).cast("string"))).alias("page_url"), F.when(i % 3 == 0, i % 11).alias("verdict_count"), F.array(F.struct(F.lit("plugin").alias("kind"), F.concat(F.lit("s"), (i % 5).cast("string")).alias("slug"), (i % 2).cast("string").alias("version"))).alias("assets"))


@query("SELECT DISTINCT CASE WHEN page_id % 4 = 0 THEN 'unknown://t' || page_id ELSE 'https://p' || page_id % 20 END AS page_url, 'plugin' AS kind, 's' || page_id % 5 AS slug, (page_id % 2)::VARCHAR AS version FROM pages")
def page_asset_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.asset_edges(_traces(spark, sf_dir))


@query("SELECT slug, version, (row_number() OVER (ORDER BY min(page_id), slug, version) - 1)::INT AS idx FROM (SELECT page_id, 's' || page_id % 5 AS slug, (page_id % 2)::VARCHAR AS version FROM pages) GROUP BY slug, version")
def first_appearance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _traces(spark, sf_dir).select(F.regexp_extract("trace_id", r"(\d+)", 1).cast("long").alias("n"), F.explode("assets").alias("a")).select("n", "a.slug", "a.version")
    return joins.numbered(own, ["slug", "version"], "n")


@query("SELECT page_id, strftime(DATE '2025-01-01' + (page_id % 30)::INT, '%Y%m%d') AS day, page_id % 2 = 0 AS kept FROM pages")
def timestamp_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.concat(F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (F.col("page_id") % 30).cast("int")), "yyyyMMdd"), F.when(F.col("page_id") % 2 == 0, "-120000").otherwise("-130000"))
    stamp = F.substring_index(folder, "-", -1)
    return table(spark, sf_dir, "pages").select("page_id", day_of(folder).alias("day"), filters.in_timestamps(stamp, ["12", "999"]).alias("kept"))


@query(f"WITH {H} SELECT page_id, coalesce(regexp_extract(url, '[?&]ver=([^&#]*)', 1), '') AS ver FROM h")
def url_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(asset_version(F.substring_index(F.col("url"), "#", 1)), F.lit("")).alias("ver"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'unknown://' || page_id END AS page FROM pages")
def page_or_made_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", page_or_unknown(F.when(F.col("page_id") % 2 == 0, F.col("url")), F.col("page_id").cast("string")).alias("page"))
