"""Row filters and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.common import any_of, blank_to_null, col
from ..functions.urls import host


def in_timestamps(ts: Column | str, wanted: list[str]) -> Column:
    """FLT-01: equal to a listed value or starting with it; an empty list takes all."""
    return any_of(wanted, lambda w: F.startswith(col(ts), F.lit(w))) if wanted else F.lit(True)


def with_preview(traces: DataFrame, preview: str = "ast_preview") -> DataFrame:
    """FLT-06."""
    return traces.where(F.trim(F.coalesce(preview, F.lit(""))) != "")


def with_events(scripts: DataFrame, events: str) -> DataFrame:
    """FLT-05."""
    return scripts.where(F.coalesce(F.size(events), F.lit(0)) > 0)


def suspicious_enough(traces: DataFrame, least: int | None) -> DataFrame:
    """FLT-07."""
    return traces if not least else traces.where(F.coalesce("suspicious_event_count", F.lit(0)) >= least)


def first_scripts(scripts: DataFrame, most: int | None, key: str = "trace_id") -> DataFrame:
    """FLT-08: the first by key; 0 or None takes all."""
    return scripts.orderBy(key).limit(most) if most else scripts


def is_csv_with_rows(text: Column | str) -> Column:
    """FLT-12: more than one line that is not blank."""
    return F.size(F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")) > 1


def is_suspicious(least: int = 1, capabilities: tuple[str, ...] = K.HIGH_RISK) -> Column:
    """FLT-16: enough suspicious events (if any are asked for), or a capability of high risk; a given list replaces the usual one."""
    risky = F.exists(F.map_entries("capability_counts"), lambda e: e["key"].isin(*capabilities) & (e["value"] > 0))
    return F.coalesce((F.coalesce("suspicious_event_count", F.lit(0)) >= least) & F.lit(least > 0), F.lit(False)) | F.coalesce(risky, F.lit(False))


def supported(assets: DataFrame, support: int = 3, ratio: float = 0.6) -> DataFrame:
    """FLT-17, TOP-04: assets with so many suspicious traces that are such a share of their traces, by ratio."""
    own = assets.withColumn("ratio", F.col("suspicious") / F.col("total"))
    return own.where((F.col("suspicious") >= support) & (F.col("ratio") >= ratio)).orderBy(F.desc("ratio"), F.desc("suspicious"), F.desc("name"))


def listed_clusters(text: str | None) -> list[int]:
    """FLT-23: cluster numbers from text separated by commas or spaces."""
    return [int(x) for x in (text or "").replace(",", " ").split()]


def in_clusters(traces: DataFrame, text: str | None) -> DataFrame:
    """FLT-23, FLT-24."""
    own = listed_clusters(text)
    return traces.where(F.col("cluster").isin(own)) if own else traces


def flat(traces: DataFrame) -> DataFrame:
    """PRJ-01: the columns of a trace that plots and tables use."""
    wanted = ["trace_id", "cluster", "capability_cluster", "silhouette_score", "num_events", "suspicious_event_count", "script_url", "page_url", "url_hash", "timestamp", "script_id", "hash", "is_wordpress", "wordpress_version", "ast_similarity", "heuristic_names", "coordinates"]
    own = [F.col(c) if c in traces.columns else F.lit(None).alias(c) for c in wanted]
    verdict = [F.col(f"virustotal.{c}").alias(c) if "virustotal" in traces.columns else F.lit(None).alias(c) for c in ("verdict", "verdict_count")]
    return traces.select(*own, *verdict, host("script_url").alias("domain"), F.size("event_sequence").alias("sequence_length"))


def advisory_view(advisories: DataFrame) -> DataFrame:
    """PRJ-02: what a report shows of an advisory, with defaults."""
    return advisories.select("slug", "vuln_id", F.coalesce(blank_to_null(F.col("title")), F.lit("Unknown")).alias("title"), F.coalesce("reference", F.lit("")).alias("reference"), F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit("unknown")).alias("published"))
