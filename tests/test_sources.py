"""Readers and writers on a made-up crawl folder, and the streams."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from trailmark.sources import crawl, remote, tables
from trailmark.streaming import live


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("crawl")
    at = top / "hash1" / "20250102-030405"
    (at / "loaded_js_asts").mkdir(parents=True)
    (at / "loaded_js").mkdir()
    (at / "byscripts.json").write_text(json.dumps({"12": {"url": "https://a/x.js", "events": [{"eventType": "consoleAPI", "argsValues": [{"type": "Eval Call"}]}]}, "13": {"url": "u", "events": []}}))
    (at / "trace_v2.json").write_text(json.dumps([{"timestamp": "1", "event": {"method": "Debugger.scriptParsed", "params": {"scriptId": "12"}}}, {"timestamp": "2"}]))
    (at / "loaded_js" / "index.csv").write_text("script_id,script_url,hash,file_name,is_module\n012,https://a/x.js,abc,x.js,true\n")
    (at / "loaded_js" / "x.js").write_text("let a = 1;\n" * 30)
    (at / "fingerprint.json").write_text(json.dumps({"url": "https://a", "is_wordpress": True, "wordpress_version": "6", "resource_urls_with_wp_paths": ["https://a/wp-content/plugins/p/x.js?ver=2", "https://a/wp-content/themes/t/y.css"]}))
    (at / "virustotal_report.json").write_text(json.dumps({"url": "https://a", "report": {"attributes": {"last_analysis_stats": {"malicious": 0, "harmless": 3}}}}))
    (at / "loaded_js_asts" / "ast_abc.json").write_text(json.dumps({"script_hash": "abc", "num_nodes": 3, "unit_vector": {"A": 1.0}}))
    bad = top / "hash2" / "20250102"
    bad.mkdir(parents=True)
    (bad / "byscripts.json").write_text("{broken")
    (bad / "fingerprint.json").write_text("")
    return str(top)


def test_crawl(spark, root):
    assert {(r["url_hash"], r["timestamp"]) for r in crawl.crawls(spark, root).collect()} == {("hash1", "20250102-030405"), ("hash2", "20250102")}
    s = {r["script_id"]: r for r in crawl.scripts(spark, root).collect()}
    assert set(s) == {"12", "13"} and s["12"]["url_hash"] == "hash1" and "Eval Call" in s["12"]["events"][0]
    e = crawl.raw_events(spark, root).collect()
    assert [(r["method"], json.loads(r["params"])) for r in e if r["method"]] == [("Debugger.scriptParsed", {"scriptId": "12"})]
    i = crawl.index(spark, root).first()
    assert (i["script_id"], i["is_module"], i["url_hash"]) == ("012", True, "hash1")
    c = crawl.code(spark, root).first()
    assert c["file_name"] == "x.js" and c["preview"].count("\n") == 19 and len(c["hash"]) == 64
    assert crawl.script_files(spark, root).first()["n"] == 1
    f = crawl.fingerprints(spark, root).collect()
    assert len(f) == 1 and f[0]["wordpress_plugins"][0]["version"] == "2" and f[0]["wordpress_themes"][0]["name"] == "t"
    v = crawl.reports(spark, root).first()["virustotal"]
    assert (v["verdict"], v["verdict_count"], v["total_scanners"]) == ("Clean", 0, 3)
    assert crawl.ast_fingerprints(spark, root).first()["num_nodes"] == 3


def test_reports(spark, tmp_path):
    path = f"file://{tmp_path}"
    (tmp_path / "vulns.json").write_text(json.dumps({"x": {"id": "1", "cve": "CVE-1", "title": "t", "software": [{"slug": "foo", "affected_versions": {"r": {"to_version": "2"}}}]}}))
    assert crawl.advisories(spark, f"{path}/vulns.json").first()["software"][0]["slug"] == "foo"
    (tmp_path / "old.json").write_text(json.dumps({"foo": [{"cve": "", "wordfence_uuid": "u", "title": "Foo < 2"}]}))
    assert crawl.legacy_advisories(spark, f"{path}/old.json").first()["entries"][0]["title"] == "Foo < 2"
    (tmp_path / "report.json").write_text(json.dumps({"clusters": [{"cluster_id": 1, "count": 2, "traces": [{"trace_id": "a"}, {"trace_id": "b"}]}]}))
    clusters, members = crawl.cluster_report(spark, f"{path}/report.json")
    assert clusters.first()["count"] == 2 and members.count() == 2
    (tmp_path / "summary.txt").write_text("Cluster 1\n  size: 3\nCluster 2\n  size: 4\n")
    assert {(r["section"], r["key"], r["value"]) for r in crawl.summary_lines(spark, f"{path}/summary.txt").collect()} == {(1, "size", "3"), (2, "size", "4")}
    for name, body in (("list.json", [{"trace_id": "a"}]), ("object.json", {"traces": [{"trace_id": "a"}]})):
        (tmp_path / name).write_text(json.dumps(body))
        assert crawl.trace_list(spark, f"{path}/{name}", "struct<trace_id:string>").first()["trace_id"] == "a"


def test_run_tables(spark, tmp_path):
    path, config = f"file://{tmp_path}/run", {"cap": 200}
    assert not tables.is_current(spark, path, config)
    tables.write_run({"pairs": spark.createDataFrame([(1, 2, 0.5)], "i int, j int, dist double")}, path, config)
    assert tables.is_current(spark, path, config) and not tables.is_current(spark, path, {"cap": 1}) and tables.read_run(spark, path, "pairs").count() == 1
    done = f"file://{tmp_path}/done"
    for _ in range(2):
        tables.append_new(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), done, ["k"])
    assert spark.read.parquet(done).count() == 2
    clusters, members = spark.createDataFrame([(1, 2)], "cluster int, size int"), spark.createDataFrame([(1, "b"), (1, "a")], "cluster int, trace_id string")
    assert json.loads(tables.report_json(clusters, members, 1).first()["value"])["traces"] == [{"trace_id": "a"}]
    assert tables.report_text(clusters, ["size"]).first()["value"] == "Cluster 1\n  size: 2"
    tables.write_csv(clusters, f"file://{tmp_path}/csv", tables.SAMPLE_COLUMNS)
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/csv").columns == tables.SAMPLE_COLUMNS
    assert "<table" in tables.html(clusters)
    s = spark.createDataFrame([(1, 1, "h", "t", "x.js", "tr", "abcdef")], "cluster int, rank int, url_hash string, timestamp string, file_name string, trace_id string, hash string")
    assert tables.selection(s, "/r", "/o").first()["target"] == "/o/cluster_1/01_tr_abcdef.js"


def test_rate_limit():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limit = remote.RateLimit(2, 60, 500, lambda: now[0], sleep)
    got = list(remote.fetched(["a", "b", "c"], lambda k: 1 / 0 if k == "b" else k, limit, tries=1))
    assert [(k, r) for k, r, _ in got] == [("a", "a"), ("b", None), ("c", "c")] and got[1][2] and slept == [60]


def test_streams(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(minutes=10 * i if i < 5 else 600 + i), 1, "a" if i < 2 else "b", 1.0, "{}") for i in range(8)]
    spark.createDataFrame(rows, live.EVENTS).write.parquet(f"{tmp_path}/in")

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = run(live.session_traces(live.read_events(spark, f"{tmp_path}/in")), "sessions")
    assert [(r["event_sequence"], r["compressed"]) for r in got] == [(["a", "a", "b", "b", "b"], ["a", "b"])]
    assert sum(r["n"] for r in run(live.token_rates(live.read_events(spark, f"{tmp_path}/in")), "rates")) == 5
    assert len(run(live.first_seen(live.read_events(spark, f"{tmp_path}/in"), ["event_type"]).select("event_type", F.col("ts")), "seen")) == 2
