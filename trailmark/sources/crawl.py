"""Crawl folders <root>/<url_hash>/<timestamp>/... as tables.

All files are found and read by Spark's own sources, in any store; a file's keys come from its path.
Malformed files give null rows, which callers drop or count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import blank_to_null
from ..functions.text import severity_label, verdict
from ..functions.urls import asset

# schemas (FIXTURES 1.1 to 1.7)
INDEX = "script_id string, script_url string, hash string, file_name string, is_module boolean"
SCRIPTS = "map<string, struct<url:string, events:array<string>>>"
FINGERPRINT = "url string, is_wordpress boolean, wordpress_version string, resource_urls_with_wp_paths array<string>"
REPORT = "url string, report struct<id:string, links:struct<self:string>, attributes:struct<url:string, last_analysis_date:bigint, last_analysis_stats:struct<malicious:int,suspicious:int,harmless:int,undetected:int,timeout:int>, threat_severity:struct<threat_severity_level:string,level_description:string>>>"
AST = "script_path string, file_name string, script_hash string, generated_at string, num_nodes bigint, max_depth int, node_type_counts map<string,bigint>, depth_histogram map<string,bigint>, normalized_counts map<string,double>, unit_vector map<string,double>, feature_hash string, parser string, ast_preview string"
ADVISORY = "id string, cve string, title string, published string, references array<string>, software array<struct<type:string, slug:string, name:string, affected_versions:map<string, struct<from_version:string, from_inclusive:boolean, to_version:string, to_inclusive:boolean>>>>"


def keys(depth: int = 0) -> tuple[Column, Column]:
    """url_hash and timestamp from the path of a file ``depth`` folders below the crawl's."""
    below = "[^/]+/" * depth
    at = lambda i: F.regexp_extract("_metadata.file_path", rf"([^/]+)/([^/]+)/{below}[^/]+$", i)
    return at(1).alias("url_hash"), at(2).alias("timestamp")


def crawls(spark: SparkSession, root: str) -> DataFrame:
    """SRC-01, SRC-11: url_hash, timestamp of every crawl that holds a file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", rf"/([^/]+)/([0-9]{{8}}[^/]*)/", 1).alias("url_hash"), F.regexp_extract("path", r"/([^/]+)/([0-9]{8}[^/]*)/", 2).alias("timestamp")).where("url_hash != ''").distinct()


def texts(spark: SparkSession, root: str, name: str, depth: int = 0) -> DataFrame:
    """url_hash, timestamp, value: whole files of this name."""
    return spark.read.option("wholetext", "true").text(f"{root}/*/*/{name}").select(*keys(depth), "value")


def scripts(spark: SparkSession, root: str) -> DataFrame:
    """SRC-01, SRC-02: url_hash, timestamp, script_id, url, events (array of JSON texts), a row for each script."""
    own = texts(spark, root, "byscripts.json").select("url_hash", "timestamp", F.from_json("value", SCRIPTS).alias("m"))
    return own.where("m is not null").select("url_hash", "timestamp", F.explode("m").alias("script_id", "s")).select("url_hash", "timestamp", "script_id", "s.url", "s.events")


def raw_events(spark: SparkSession, root: str) -> DataFrame:
    """SRC-03, SRC-04: raw protocol events of crawls that have a script index: url_hash, timestamp, at, method, params (JSON text)."""
    own = texts(spark, root, "trace_v2.json").select("url_hash", "timestamp", F.explode(F.from_json("value", "array<struct<timestamp:string, event:struct<method:string, params:string>>>")).alias("e"))
    return own.select("url_hash", "timestamp", F.col("e.timestamp").alias("at"), "e.event.method", "e.event.params").join(index(spark, root).select("url_hash", "timestamp").distinct(), ["url_hash", "timestamp"], "left_semi")


def index(spark: SparkSession, root: str) -> DataFrame:
    """SRC-05, SRC-06: rows of loaded_js/index.csv."""
    return spark.read.schema(INDEX).option("header", "true").option("enforceSchema", "false").csv(f"{root}/*/*/loaded_js/index.csv").select(*keys(1), "*")


def code(spark: SparkSession, root: str, most: int = 50_000, lines: int = 20) -> DataFrame:
    """SRC-07, SRC-12: url_hash, timestamp, file_name, hash, length, text (cut for display), preview of loaded scripts."""
    own = spark.read.format("binaryFile").option("pathGlobFilter", "*.{js,mjs,cjs}").load(f"{root}/*/*/loaded_js")
    text = F.decode("content", "UTF-8")
    return own.select(F.regexp_extract("path", r"/([^/]+)/([^/]+)/loaded_js/([^/]+)$", 1).alias("url_hash"), F.regexp_extract("path", r"/([^/]+)/([^/]+)/loaded_js/([^/]+)$", 2).alias("timestamp"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.sha2("content", 256).alias("hash"), "length", F.substring(text, 1, most).alias("text"), F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n").alias("preview"))


def script_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC-25: n script files of each crawl."""
    own = spark.read.format("binaryFile").option("pathGlobFilter", "*.{js,mjs,cjs}").load(f"{root}/*/*/loaded_js").select(F.regexp_extract("path", r"/([^/]+)/([^/]+)/loaded_js/", 1).alias("url_hash"), F.regexp_extract("path", r"/([^/]+)/([^/]+)/loaded_js/", 2).alias("timestamp"))
    return own.groupBy("url_hash", "timestamp").agg(F.count("*").alias("n"))


def _json(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    own = texts(spark, root, name)
    return own.select("url_hash", "timestamp", F.from_json("value", schema).alias("j")).where("j is not null").select("url_hash", "timestamp", "j.*")


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """SRC-08, SRC-28, FN-19: the site's fingerprint with its plugins and themes; empty and invalid files are left out."""
    f = _json(spark, root, "fingerprint.json", FINGERPRINT)
    found = F.filter(F.transform("resource_urls_with_wp_paths", asset), lambda a: a.isNotNull())
    side = lambda kind: F.array_distinct(F.transform(F.filter(found, lambda a: a["kind"] == kind), lambda a: F.struct(a["name"].alias("name"), a["version"].alias("version"))))
    return f.select("url_hash", "timestamp", F.col("url").alias("page_url"), "is_wordpress", "wordpress_version", side("plugin").alias("wordpress_plugins"), side("theme").alias("wordpress_themes"))


def reports(spark: SparkSession, root: str) -> DataFrame:
    """SRC-09, FN-23: verdict, its count and scanners of each crawl; zero scanners are null, a count of zero stays."""
    s = "report.attributes.last_analysis_stats"
    n = lambda c: F.coalesce(f"{s}.{c}", F.lit(0))
    total = n("malicious") + n("suspicious") + n("harmless") + n("undetected") + n("timeout")
    level = "report.attributes.threat_severity.threat_severity_level"
    return _json(spark, root, "virustotal_report.json", REPORT).select("url_hash", "timestamp", "url", F.struct(verdict(n("malicious"), n("suspicious"), level).alias("verdict"), (n("malicious") + n("suspicious")).alias("verdict_count"), F.nullif(total, F.lit(0)).alias("total_scanners"), severity_label(level).alias("severity")).alias("virustotal"))


def ast_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """SRC-10: fingerprints of scripts by hash."""
    own = spark.read.option("wholetext", "true").text(f"{root}/*/*/loaded_js_asts/ast_*.json")
    return own.select(F.from_json("value", AST).alias("j")).where("j is not null").select("j.*").dropDuplicates(["script_hash"])


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18: a list of advisories, or an object of them."""
    own = spark.read.option("wholetext", "true").text(path)
    listed = F.from_json(F.when(F.trim("value").startswith("["), F.col("value")), f"array<struct<{_fields(ADVISORY)}>>")
    keyed = F.map_values(F.from_json(F.when(F.trim("value").startswith("{"), F.col("value")), f"map<string, struct<{_fields(ADVISORY)}>>"))
    return own.select(F.explode(F.coalesce(listed, keyed)).alias("a")).select("a.*")


def legacy_advisories(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18, the old form: slug, entries."""
    own = spark.read.option("wholetext", "true").text(path)
    return own.select(F.explode(F.from_json("value", "map<string, array<struct<cve:string, wordfence_uuid:string, title:string>>>")).alias("slug", "entries"))


def _fields(ddl: str) -> str:
    """``a t, b u`` as ``a:t, b:u`` at the top level."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def trace_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-13, SRC-26: traces of a JSON file that is a list or an object with ``traces``."""
    own = spark.read.option("wholetext", "true").text(path)
    listed = F.from_json(F.when(F.trim("value").startswith("["), F.col("value")), f"array<{schema}>")
    inside = F.from_json(F.when(F.trim("value").startswith("{"), F.col("value")), f"struct<traces:array<{schema}>>")["traces"]
    return own.select(F.explode(F.coalesce(listed, inside)).alias("t")).select("t.*")


def cluster_report(spark: SparkSession, path: str, trace: str = "trace_id:string, script_url:string, suspicious_event_count:bigint") -> tuple[DataFrame, DataFrame]:
    """SRC-16: tables of clusters and of their traces from a report."""
    cluster = f"cluster_id:int, count:bigint, average_events_per_script:double, silhouette:double, ast_similarity:double, closest_clusters:array<struct<cluster_id:int,distance:double>>, virustotal_average_verdict_count:double, wordpress_plugins:array<struct<label:string,count:bigint>>, traces:array<struct<{trace}>>"
    own = spark.read.option("wholetext", "true").text(path).select(F.explode(F.from_json("value", f"struct<clusters:array<struct<{cluster}>>>")["clusters"]).alias("c"))
    return own.select("c.*").drop("traces"), own.select("c.cluster_id", F.explode("c.traces").alias("t")).select("cluster_id", "t.*")


def summary_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17: section (a cluster's number), key, value of a text report with ``Cluster N`` headings and ``key: value`` lines."""
    from pyspark.sql import Window

    own = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    section = blank_to_null(F.regexp_extract("line", r"^\s*Cluster\s+(-?\d+)", 1)).cast("int")
    own = own.withColumn("section", F.last(section, ignorenulls=True).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return own.where(F.col("line").rlike(r"^\s*[^:]+:\s")).select("section", F.trim(F.regexp_extract("line", r"^\s*([^:]+):\s*(.*)$", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^\s*([^:]+):\s*(.*)$", 2)).alias("value"))


def sample_manifest(spark: SparkSession, root: str) -> DataFrame:
    """SRC-21: cluster and trace of earlier samples, from manifests, else from imported ones."""
    schema = "struct<cluster_id:int, original_cluster_id:int, samples:array<struct<trace_id:string, script_sha256:string>>>"
    own = spark.read.option("wholetext", "true").text(f"{root}/*/*manifest*.json").select(F.from_json("value", schema).alias("m"))
    return own.select(F.coalesce("m.cluster_id", "m.original_cluster_id").alias("cluster"), F.explode("m.samples").alias("s")).select("cluster", "s.*").dropDuplicates(["cluster", "trace_id"])


def artefacts(spark: SparkSession, root: str) -> DataFrame:
    """SRC-27: url_hash, timestamp, script_id with a trace's index row and its events: what a pair of traces is shown with."""
    return scripts(spark, root).join(index(spark, root), ["url_hash", "timestamp", "script_id"])
