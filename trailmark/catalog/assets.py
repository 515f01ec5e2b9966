"""Assets and advisories: a part's brand is an asset, its size a version, its supplier's number the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import asset_key
from ..functions.versions import compare, described, groups, groups_from_title, satisfies
from ..operators import aggregates, filters
from ..plans import vulnerabilities
from ..session import table
from .registry import query, r6

A = "a AS (SELECT l_suppkey % 10 AS cluster, l_orderkey AS trace_id, p_brand AS name, p_size::VARCHAR AS version, l_returnflag = 'R' AS suspicious FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.select((F.col("l_suppkey") % 10).alias("cluster"), F.col("l_orderkey").alias("trace_id"), F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("version"), (F.col("l_returnflag") == "R").alias("suspicious"))


@query(f"WITH {A} SELECT cluster, name || ' (' || version || ')' AS label, count(*)::BIGINT AS n, (row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, name || ' (' || version || ')'))::INT AS rank FROM a GROUP BY cluster, name, version QUALIFY rank <= 20")
def asset_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.asset_distribution(_assets(spark, sf_dir))


@query(f"WITH {A} SELECT name AS base, version, count(*)::BIGINT AS n, (sum(count(*)) OVER (PARTITION BY name))::BIGINT AS total FROM a GROUP BY name, version")
def distribution_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _assets(spark, sf_dir).select(F.concat("name", F.lit(" ("), "version", F.lit(")")).alias("label"), F.lit(1).alias("n"))
    return aggregates.version_distribution(labels)


@query(f"WITH {A} SELECT name AS base, CASE WHEN version::INT % 2 = 0 THEN version ELSE 'unspecified' END AS version, count(*)::BIGINT AS n, (sum(count(*)) OVER (PARTITION BY name))::BIGINT AS total FROM a WHERE version::INT % 5 > 0 GROUP BY name, 2")
def asset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("version").cast("int")
    labels = _assets(spark, sf_dir).select(F.concat("name", F.when(v % 2 == 0, F.concat(F.lit(" ("), "version", F.lit(")"))).otherwise("")).alias("label"), F.when(v % 5 > 0, 1).otherwise(0).alias("n"))
    return aggregates.asset_totals(labels)


_SUPPORT = f"WITH {A}, t AS (SELECT cluster, trace_id, name, max(suspicious::INT) AS s FROM a GROUP BY ALL), g AS (SELECT coalesce(cluster, -1) AS cluster, name, count(*)::BIGINT AS total, sum(s)::BIGINT AS suspicious FROM t GROUP BY GROUPING SETS ((cluster, name), (name)))"


@query(f"{_SUPPORT} SELECT * FROM g")
def asset_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.asset_support(_assets(spark, sf_dir)).select(F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"), "name", "total", "suspicious")


@query(f"{_SUPPORT} SELECT cluster, name, round(suspicious / total, 6) AS ratio, (row_number() OVER (PARTITION BY cluster ORDER BY suspicious / total DESC, suspicious DESC, name))::INT AS rank FROM g WHERE suspicious >= 3 AND suspicious / total >= 0.2 QUALIFY rank <= 5")
def asset_coupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = aggregates.coupled(aggregates.asset_support(_assets(spark, sf_dir)), 5, 3, 0.2)
    return own.select(F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"), "name", r6("ratio").alias("ratio"), "rank")


@query(f"WITH {A} SELECT name, count(*)::BIGINT AS total, sum(suspicious::INT)::BIGINT AS suspicious FROM a GROUP BY 1 HAVING sum(suspicious::INT) >= 3 AND sum(suspicious::INT) / count(*) >= 0.33")
def support_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _assets(spark, sf_dir).groupBy("name").agg(F.count("*").alias("total"), F.sum(F.col("suspicious").cast("int")).alias("suspicious"))
    return filters.supported(n, 3, 0.33).select("name", "total", "suspicious")


@query(f"WITH {A}, d AS (SELECT cluster, name AS slug, CASE WHEN version::INT % 3 = 0 THEN 'unspecified' ELSE version END AS version, count(DISTINCT trace_id)::BIGINT AS traces FROM a GROUP BY ALL) SELECT cluster, slug, sum(traces)::BIGINT AS total, string_agg(version || ' ×' || traces, ', ' ORDER BY traces DESC, version) AS versions FROM d GROUP BY ALL")
def version_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _assets(spark, sf_dir).select("cluster", "trace_id", F.col("name").alias("slug"), F.when(F.col("version").cast("int") % 3 > 0, F.col("version")).otherwise(" ").alias("version"))
    return aggregates.version_texts(aggregates.distinct_versions(own))


@query(f"WITH {A}, b AS (SELECT cluster, name AS slug, count(DISTINCT trace_id % 1000) AS domains FROM a GROUP BY cluster, name QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(DISTINCT trace_id % 1000) DESC, name) <= 5) SELECT a.cluster, slug, any_value(domains)::BIGINT AS domains, version, count(DISTINCT trace_id % 1000)::BIGINT AS version_domains FROM a JOIN b ON a.cluster = b.cluster AND name = slug GROUP BY a.cluster, slug, version")
def domain_plugin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _assets(spark, sf_dir).select("cluster", F.col("name").alias("slug"), "version", (F.col("trace_id") % 1000).alias("domain"))
    return aggregates.domains_per_plugin(own).select("cluster", "slug", "domains", "version", "version_domains")


# an advisory for each brand, with a range that follows from the brand's number; one without ranges for every third
V = """v AS (SELECT DISTINCT lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g')) AS slug, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS n FROM part),
r AS (SELECT slug, 'CVE-' || n AS vuln_id, n, n % 10 AS low, n % 10 + 20 AS high, n % 3 = 0 AS every FROM v)"""


def _advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = table(spark, sf_dir, "part").select("p_brand").distinct()
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    text = lambda c: c.cast("string")
    rng = F.struct(text(n % 10).alias("from_version"), F.lit(True).alias("from_inclusive"), text(n % 10 + 20).alias("to_version"), F.lit(False).alias("to_inclusive"))
    affected = F.map_from_arrays(F.array(F.lit("r")), F.array(rng))
    none = F.map_filter(affected, lambda k, v: F.lit(False))
    software = F.array(F.struct(F.lit("plugin").alias("type"), F.col("p_brand").alias("slug"), F.col("p_brand").alias("name"), F.when(n % 3 == 0, none).otherwise(affected).alias("affected_versions")))
    raw = brand.select(F.concat(F.lit("id-"), text(n)).alias("id"), F.concat(F.lit("CVE-"), text(n)).alias("cve"), F.col("p_brand").alias("title"), F.lit("2024-01-02 03:04:05").alias("published"), F.array(F.lit(""), F.lit("https://a.example")).alias("references"), software.alias("software"))
    return vulnerabilities.advisories(raw)


@query(f"WITH {A}, {V} SELECT DISTINCT slug, version, vuln_id FROM a JOIN r ON lower(regexp_replace(name, '[^A-Za-z0-9]+', '-', 'g')) = slug WHERE every OR (version::INT >= low AND version::INT < high)")
def version_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = asset_key(F.lit("plugin"), "name", "version")
    own = _assets(spark, sf_dir).select(key["slug"].alias("slug"), key["version"].alias("version")).distinct()
    return vulnerabilities.matches(own, _advisories(spark, sf_dir)).select("slug", "version", "vuln_id")


@query(f"WITH {A}, {V}, d AS (SELECT DISTINCT lower(regexp_replace(name, '[^A-Za-z0-9]+', '-', 'g')) AS slug, CASE WHEN version::INT % 7 > 0 THEN version END AS version FROM a) SELECT d.slug, coalesce(d.version, '') AS version, CASE WHEN d.version IS NOT NULL AND (every OR (d.version::INT >= low AND d.version::INT < high)) THEN 'matched' WHEN d.version IS NULL THEN 'version_missing' ELSE 'no_matching_version' END AS status FROM d JOIN r USING (slug)")
def asset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = asset_key(F.lit("plugin"), "name", "version")
    own = _assets(spark, sf_dir).select(key["slug"].alias("slug"), F.when(F.col("version").cast("int") % 7 > 0, F.col("version")).alias("version"))
    return vulnerabilities.statuses(own, _advisories(spark, sf_dir)).select("slug", F.coalesce("version", F.lit("")).alias("version"), "status")


@query(f"WITH {A}, {V}, x AS (SELECT cluster, trace_id, slug, every OR (version::INT >= low AND version::INT < high) AS hit FROM a JOIN r ON lower(regexp_replace(name, '[^A-Za-z0-9]+', '-', 'g')) = slug) SELECT cluster, slug, count(DISTINCT trace_id)::BIGINT AS traces, count(DISTINCT trace_id) FILTER (hit)::BIGINT AS matched, CASE WHEN bool_or(hit) THEN 'matched' ELSE 'no_matching_version' END AS status FROM x GROUP BY ALL")
def cluster_vulnerabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = asset_key(F.lit("plugin"), "name", "version")
    own = _assets(spark, sf_dir).select("cluster", "trace_id", key["slug"].alias("slug"), key["version"].alias("version"))
    return vulnerabilities.by_cluster(own, vulnerabilities.statuses(own, _advisories(spark, sf_dir))).select("cluster", "slug", "traces", "matched", "status")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'all versions' WHEN p_size % 3 = 1 THEN '* - 1.' || p_size ELSE '< 1.' || p_size END AS said, CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 3 = 1 THEN 20 <= p_size ELSE 20 < p_size END AS holds FROM part")
def version_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("p_size") % 3, F.concat(F.lit("1."), F.col("p_size").cast("string"))
    one = F.map_from_arrays(F.array(F.lit("r")), F.array(F.struct(F.lit("*").alias("from_version"), F.lit(True).alias("from_inclusive"), v.alias("to_version"), F.lit(True).alias("to_inclusive"))))
    from_map, from_title = groups(one), groups_from_title(F.concat(F.lit("Thing < "), v))
    own = F.when(k == 0, F.slice(from_title, 1, 0)).when(k == 1, from_map).otherwise(from_title)
    return table(spark, sf_dir, "part").withColumn("g", own).select("p_partkey", described("g").alias("said"), satisfies(F.lit("1.20"), "g").alias("holds"))


@query("SELECT p_partkey, sign(p_size - 20)::INT AS c FROM part")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat(F.lit("1."), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", compare(v, F.lit("1.20.0")).alias("c"))


@query("SELECT s_suppkey % 20 AS slug, CASE WHEN s_suppkey % 20 < 10 THEN 'local' ELSE 'cache' END AS came_from FROM supplier WHERE s_suppkey % 20 <> 15 GROUP BY ALL")
def precedence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20).alias("slug")).distinct()
    one = lambda x: F.array(F.lit(x))
    local = s.where("slug < 10").select("slug", F.when(F.col("slug") > 5, one("local")).otherwise(F.slice(one("local"), 1, 0)).alias("entries"))
    cache = s.select("slug", F.when(F.col("slug") == 15, F.slice(one("cache"), 1, 0)).otherwise(one("cache")).alias("entries"))
    return vulnerabilities.merged(local, cache).select("slug", F.when(F.coalesce(F.get("entries", F.lit(0)), F.lit("local")) == "local", "local").otherwise("cache").alias("came_from"))


@query("SELECT l_suppkey % 10 AS cluster, least(sum((l_returnflag = 'R')::INT), 100)::BIGINT AS alerts FROM lineitem WHERE l_linestatus <> 'O' GROUP BY 1")
def alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("cluster"), F.col("l_linestatus").alias("slug"), (F.col("l_returnflag") == "R").cast("long").alias("matched"), F.lit(100).cast("long").alias("domains"))
    return aggregates.alert_counts(own, ("O",)).select("cluster", "alerts")
