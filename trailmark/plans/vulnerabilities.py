"""Advisories: ingest, matching against assets by version range, roll-ups.

One ingest serves all uses, with the kinds of software and the least length of slug aliases as
parameters. Advisories are a dimension that Spark may broadcast by its size; nothing forces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import blank_to_null
from ..functions.text import published, slug, slug_aliases, sound_version, strongest_status, vulnerability_id
from ..functions.versions import groups, groups_from_title, satisfies

FALLBACKS = 3


def advisories(raw: DataFrame, kinds: tuple[str, ...] | None = None, least: int = 3) -> DataFrame:
    """SRC-18, DEC-7: slug, kind, vuln_id, title, reference, published, groups. raw: id, cve, title, published, references, software (FIXTURES 1.7)."""
    own = raw.select("id", "cve", "title", "published", "references", F.explode("software").alias("s"))
    own = own.where(F.coalesce("s.type", F.lit("plugin")).isin(*kinds)) if kinds else own
    aliases = F.array_distinct(F.concat(slug_aliases("s.slug", least), F.array(slug("s.name"))))
    rows = own.select(
        F.explode(F.filter(aliases, lambda x: F.coalesce(x, F.lit("")) != "")).alias("slug"), F.coalesce("s.type", F.lit("plugin")).alias("kind"), vulnerability_id("cve", "id").alias("vuln_id"), F.coalesce(blank_to_null(F.trim("title")), F.lit("unknown")).alias("title"),
        F.get(F.filter("references", lambda r: F.coalesce(r, F.lit("")) != ""), F.lit(0)).alias("reference"), published("published").alias("published"), groups("s.affected_versions").alias("groups"),
    )
    return rows.dropDuplicates(["slug", "kind", "vuln_id"])


def legacy_advisories(raw: DataFrame, least: int = 1) -> DataFrame:
    """SRC-18, the old form: slug -> list of struct(cve, wordfence_uuid, title), with ranges in titles. raw: slug, entries."""
    own = raw.select("slug", F.explode("entries").alias("e"))
    return own.select(F.explode(slug_aliases("slug", least)).alias("slug"), F.lit("plugin").alias("kind"), vulnerability_id("e.cve", "e.wordfence_uuid").alias("vuln_id"), F.col("e.title").alias("title"), F.lit(None).cast("string").alias("reference"), F.lit(None).cast("timestamp").alias("published"), groups_from_title("e.title").alias("groups")).dropDuplicates(["slug", "vuln_id"])


def merged(local: DataFrame, cache: DataFrame) -> DataFrame:
    """JN-13: slug, entries: the local list where the slug is known, even if empty, else the cached one if it isn't empty."""
    both = local.select("slug", F.col("entries").alias("l"), F.lit(True).alias("_l")).join(cache.select("slug", F.col("entries").alias("c")), "slug", "full_outer")
    return both.select("slug", F.when(F.col("_l"), F.col("l")).when(F.size("c") > 0, F.col("c")).alias("entries")).where("entries is not null")


def newest_first(vulns: DataFrame) -> DataFrame:
    """TOP-06: adds rank within the slug: newest first, undated last."""
    return vulns.withColumn("rank", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc_nulls_last("published"), "vuln_id")))


def matches(assets: DataFrame, vulns: DataFrame) -> DataFrame:
    """JN-08: asset rows by advisory whose range holds their version: an equi-join by slug and the range as a further condition. assets: slug, version and more."""
    v = vulns.withColumnRenamed("slug", "_slug").drop("kind")
    return assets.join(v, (F.col("slug") == F.col("_slug")) & (F.coalesce("version", F.lit("")) != "") & F.coalesce(satisfies("version", "groups"), F.lit(False))).drop("_slug")


def statuses(assets: DataFrame, vulns: DataFrame) -> DataFrame:
    """JN-08, JN-18: slug, version, status, vuln_ids, fallback: each distinct asset once.

    Unknown slugs are no_wordfence; without a match the FALLBACKS newest advisories are shown.
    """
    own = assets.select("slug", F.coalesce(sound_version("version"), blank_to_null(F.trim("version"))).alias("version")).distinct()
    ranked = newest_first(vulns)
    known = ranked.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= FALLBACKS, F.struct("rank", "vuln_id")))), lambda x: x["vuln_id"]).alias("newest"))
    hit = matches(own, vulns).groupBy("slug", "version").agg(F.array_sort(F.collect_set("vuln_id")).alias("vuln_ids"))
    x = own.join(known, "slug", "left").join(hit.withColumnsRenamed({"slug": "s", "version": "v"}), (F.col("slug") == F.col("s")) & F.col("version").eqNullSafe(F.col("v")), "left")
    status = F.when(F.col("newest").isNull(), "no_wordfence").when(F.col("vuln_ids").isNotNull(), "matched").when(F.col("version").isNull(), "version_missing").otherwise("no_matching_version")
    none = F.array().cast("array<string>")
    return x.select("slug", "version", status.alias("status"), F.coalesce("vuln_ids", none).alias("vuln_ids"), F.when(status.isin("matched", "no_wordfence"), none).otherwise(F.col("newest")).alias("fallback"))


def by_cluster(assets: DataFrame, found: DataFrame) -> DataFrame:
    """AGG-17, DEC-18: cluster, slug, traces, matched traces, vuln_ids, status. assets: cluster, trace_id, slug, version; found: from statuses()."""
    f = found.withColumnsRenamed({"slug": "s", "version": "v"})
    on = (F.col("slug") == F.col("s")) & F.coalesce(sound_version("version"), blank_to_null(F.trim("version"))).eqNullSafe(F.col("v"))
    hit = f.where("status = 'matched'").select("s", "v", F.lit(1).alias("hit"))
    # traces are counted on narrow rows, one for each trace and slug; what advisories say is added up over distinct versions
    each = assets.join(hit, on, "left").groupBy("cluster", "slug", "trace_id").agg(F.max("hit").alias("hit"))
    traces = each.groupBy("cluster", "slug").agg(F.count("*").alias("traces"), F.count("hit").alias("matched"))
    versions = assets.select("cluster", "slug", "version").distinct().join(f, on).groupBy("cluster", "slug")
    said = versions.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("vuln_ids")))).alias("vuln_ids"), strongest_status(F.collect_set("status")).alias("status"))
    return said.join(traces, ["cluster", "slug"]).select("cluster", "slug", "traces", "matched", "vuln_ids", "status")


def needed(vulns: DataFrame, assets: DataFrame) -> DataFrame:
    """SET-07: advisories of slugs that occur."""
    return vulns.join(assets.select("slug").distinct(), "slug", "left_semi")
