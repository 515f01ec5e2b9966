"""Analyses on hand-built rows, properties, and two ways to the same result."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import aggregates, filters, joins
from trailmark.plans import ast_fingerprints, clustering, cohesion, comparison, heuristics, sampling, sequences, traces, vulnerabilities


def plain_dtw(a, b, cost):
    if not a or not b:
        return float(len(a) + len(b))
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = cost(a[i - 1], b[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[-1, -1]


def test_warping_three_ways(spark):
    rng = random.Random(1)
    seqs = [[rng.choice(["a", "b", "Eval Call", "c|weak_host=x", "c|weak_host=y"]) for _ in range(rng.randint(0, 12))] for _ in range(14)]
    names = sorted({t for s in seqs for t in s})
    m = sequences.cost_matrix(names)
    at = {t: i for i, t in enumerate(names)}
    want = {(i, j): plain_dtw(seqs[i], seqs[j], lambda x, y: m[at[x], at[y]]) for i in range(14) for j in range(i + 1, 14)}
    df = spark.createDataFrame(list(enumerate(seqs)), "key int, seq array<string>")
    got = {(r["i"], r["j"]): r["dist"] for r in sequences.dtw_pairs(df, "key", "seq", block=4).collect()}
    assert got == pytest.approx(want)
    p = sequences.pairs(df, "key", ["seq"], block=4)
    by_pair = {(r["i"], r["j"]): r["d"] for r in p.select("i", "j", sequences.dtw("seq_i", "seq_j").alias("d")).collect()}
    assert by_pair == pytest.approx(want)
    simple = spark.createDataFrame([(list("aab"), list("abb")), ([], list("ab")), (list("ab"), [])], "a array<string>, b array<string>")
    native = [r["d"] for r in simple.select(sequences.dtw_native("a", "b", "CASE WHEN x = y THEN 0D ELSE 1D END").alias("d")).collect()]
    assert native == [0.0, 2.0, 2.0]


def test_costs():
    m = sequences.cost_matrix(["Eval Call", "x", "x|weak_host=a", "x|weak_host=b"])
    assert m[0, 1] == 2 and m[1, 2] == 0.2 and m[2, 3] == pytest.approx(0.2) and (np.diag(m) == 0).all() and (m == m.T).all()


def test_subsequence_and_bounds():
    a, b, d = sequences.best_match(np.array([1, 2, 3]), np.array([9, 1, 2, 2, 3, 9]))
    assert (a, b, d) == (1, 4, 0.0)
    assert sequences.envelope_bound(np.array([5]), np.array([1, 2]), 0) == 0 and sequences.envelope_bound(np.array([5, 5]), np.array([1, 2]), 1) == pytest.approx((9 + 9) ** 0.5)


def test_trace_rows(spark):
    rows = [(1, 3, "b", "B"), (1, 1, "a", "A"), (1, 2, "a", "A"), (2, 1, "Eval Call|x", "OBF")]
    got = {r["k"]: r for r in traces.trace_rows(spark.createDataFrame(rows, "k int, ts int, token string, capability string"), "k", ["ts"]).collect()}
    assert got[1]["event_sequence"] == ["a", "a", "b"] and got[1]["compressed_event_sequence"] == ["a", "b"] and got[1]["capability_counts"] == {"A": 2, "B": 1}
    assert got[2]["suspicious_event_count"] == 1
    one = spark.range(1)
    assert one.select(traces.compressed(F.array(*map(F.lit, "aabba")), 2).alias("x")).first()["x"] == ["a", "b"]
    assert one.select(traces.compressed(F.array().cast("array<string>")).alias("x")).first()["x"] == []
    assert one.select(traces.motifs(F.array(F.lit("a")), 2).alias("x")).first()["x"] == []


def test_raw_events(spark):
    stack = lambda *f: json.dumps({"stackTrace": {"callFrames": [{"scriptId": i, "url": u} for i, u in f]}, "type": "log", "args": []})
    raw = spark.createDataFrame([
        ("h", "1", "Debugger.scriptParsed", json.dumps({"scriptId": "7", "url": "https://a/x.js"})), ("h", "2", "Debugger.scriptParsed", json.dumps({"scriptId": "7", "url": "https://a/later.js"})),
        ("h", "3", "Debugger.scriptParsed", json.dumps({"scriptId": "8", "url": "chrome://x"})), ("h", "4", "Debugger.scriptParsed", json.dumps({"scriptId": "9", "url": "https://b"})),
        ("h", "5", "Runtime.consoleAPICalled", stack(("8", "chrome://x"), ("7", "https://a/x.js"))), ("h", "6", "Runtime.consoleAPICalled", stack(("9", "https://b"), ("7", "https://a/x.js"))),
        ("h", "7", "Network.requestWillBeSent", json.dumps({"requestId": "r", "request": {"url": "https://c", "method": "GET"}, "type": "XHR", "initiator": {"type": "script"}})),
    ], "crawl string, timestamp string, method string, params string")
    scripts = traces.registered_scripts(raw, spark.createDataFrame([("h", "7"), ("h", "8")], "crawl string, script_id string"), ["crawl"])
    assert [(r["script_id"], r["url"]) for r in scripts.collect()] == [("7", "https://a/x.js")]
    assert [(r["script_id"], r["timestamp"]) for r in traces.routed_events(raw, scripts, ["crawl"]).collect()] == [("7", "5")]
    own = traces.tokens(spark.createDataFrame([("t", "https://a/x.js", '{"argsValues":[{"type":"Eval Call"}],"eventType":"consoleAPI"}')], "key string, script_url string, event string"), ["key"])
    assert [r["token"] for r in own.collect()] == ["Eval Call"]


def test_clusters_are_found(spark):
    rng = np.random.RandomState(0)
    points = np.concatenate([rng.randn(30, 2) * 0.2, rng.randn(30, 2) * 0.2 + 8, rng.uniform(-30, 40, (6, 2))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "key int, v array<double>")
    got = {r["key"]: r["cluster"] for r in clustering.hdbscan(sequences.vector_pairs(df, "key", "v", 16), 5).collect()}
    assert len({got[i] for i in range(30)}) == 1 and len({got[i] for i in range(30, 60)}) == 1 and got[0] != got[30] and min(got[0], got[30]) > 0
    assert clustering.condensed_labels([], 5) == {} and clustering.condensed_labels([(1, 2, 1.0)], 5) == {1: -1, 2: -1}
    assert len(clustering.force_layout(["a", "b", "c"], [("a", "b", 1.0)])) == 3


def test_spanning_tree_weight(spark):
    rng = random.Random(2)
    edges = [(i, j, rng.random()) for i in range(20) for j in range(i + 1, 20)]
    tree = clustering.spanning_tree(spark.createDataFrame(edges, "i int, j int, reach double"), 4).collect()
    up = {i: i for i in range(20)}
    top = lambda a: a if up[a] == a else top(up[a])
    total = 0.0
    for i, j, w in sorted(edges, key=lambda e: e[2]):
        if top(i) != top(j):
            up[top(i)] = top(j)
            total += w
    assert len(tree) == 19 and sum(r["reach"] for r in tree) == pytest.approx(total)


def test_quality_measures(spark):
    p = spark.createDataFrame([(1, 2, 1.0), (1, 3, 4.0), (2, 3, 4.0), (1, 4, 9.0), (2, 4, 9.0), (3, 4, 9.0)], "i int, j int, dist double")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, -1)], "key int, cluster int")
    s = {r["key"]: r["silhouette"] for r in cohesion.silhouettes(p, labels).collect()}
    assert s == pytest.approx({1: 0.75, 2: 0.75, 3: 0.0})
    assert cohesion.silhouettes(p, labels.where("cluster = 0")).count() == 0
    t = spark.createDataFrame([(1, 0, None), (2, 0, 0.5), (3, 0, 0.5), (4, -1, 9.0), (5, 1, float("nan"))], "key int, cluster int, silhouette double")
    assert {(r["cluster"], r["key"]) for r in cohesion.representatives(t).collect()} == {(0, 2), (1, 5)}
    aligned = spark.createDataFrame([(0, 1, 5.0, 0.9), (0, 2, 1.0, 0.1), (0, 3, None, None)], "cluster int, key int, normalized double, coverage double")
    assert {r["key"] for r in cohesion.rejected(aligned, 4.0, 0.5).where("rejected").collect()} == {1, 2}


def test_detectors(spark):
    def fired(tokens, payloads, host="s.example", caps=None):
        df = spark.createDataFrame([(tokens, [json.dumps(p) for p in payloads], host, caps or {"X": 1})], "event_sequence array<string>, payloads array<string>, script_host string, capability_counts map<string,int>")
        r = heuristics.detected(df).first()
        return {h["name"]: h["evidence"] for h in r["heuristic_hits"]}

    define = {"type": "Object.defineProperty Called", "property": "Promise", "registrationStack": "at x"}
    benign = define | {"registrationStack": "at jquery.js"}
    assert fired([], []) == {}
    got = fired(["Fetch Request|weak_host=c2.indejs"], [{"type": "atob De-obfuscation", "output": " evil() "}, {"type": "Eval Call", "codePreview": "x;evil()"}])
    assert set(got) == {"obfuscated_eval_chain", "c2_host_contact"} and got["c2_host_contact"] == "C2 host(s): c2.indejs"
    cdn = ["Script Src Set|weak_host=cdn.jsdelivr", "Script Src Set|weak_host=cdnjs.cloudflare", "DOM Mutation|Node.appendChild|X"]
    assert "cdn_script_reinjection" in fired(cdn, [define, benign]) and "cdn_script_reinjection" not in fired(cdn, [benign, benign])
    assert "web3_listener_bootstrap" in fired(["Eval Call"], [{"type": "Event Listener Added", "listenerPreview": "new Web3()", "eventType": "load"}])
    assert "prototype_mass_patching" in fired([], [define] * 5) and "prototype_mass_patching" not in fired([], [benign] * 5) and "stack_anomaly" not in fired([], [benign])
    assert "cookie_beacon" in fired(["Eval Call|host=a.51"], [{"type": "Cookie Read", "keys": "__51a, __vt"}])
    assert "blob_worker_dropper" in fired(["Blob URL Created", "Web Worker Created|domain:blob", "x onmessage", "DOM Property Read|window|sessionStorage"], [])
    assert "anti_tamper_locking" in fired([], [define | {"configurable": False, "isNative": True}]) and "anti_tamper_locking" not in fired([], [define | {"isNative": True}])
    assert "environment_mimicry" in fired(["read navigator.webdriver", "Navigator.Plugins"], [])
    assert "platform_divergence" in fired(["ontouchstart", "screen.width", "XHR Request"], []) and "platform_divergence" not in fired(["ontouchstart", "XHR Request"], [])


def test_runs_compared(spark):
    old = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "key int, cluster int")
    assert {r["state"] for r in comparison.moves(old, old).collect()} == {"kept"}
    o = comparison.overlaps(old, spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "key int, cluster int"))
    assert all(0 < r["source_fraction"] <= 1 and 0 < r["target_fraction"] <= 1 for r in o.collect())
    assert comparison.merges(o, 1, 0.2).count() == 1 and comparison.splits(o, 1, 0.2).count() == 0


def test_sampling(spark):
    rows = [(0, f"t{i}", i % 2, float(i)) for i in range(5)] + [(1, f"u{i}", i, float(i % 3)) for i in range(20)]
    got = sampling.diverse(spark.createDataFrame(rows, "cluster int, trace_id string, bucket int, score double")).collect()
    assert [r["trace_id"] for r in sorted(got, key=lambda r: r["pick"]) if r["cluster"] == 0] == ["t4", "t3", "t2"]
    assert sum(r["cluster"] == 1 for r in got) == 15
    t = spark.createDataFrame([("a", [("XHR Request|x", 1)], 3, True), ("b", [("Cookie Read", 1)], 9, False)], "trace_id string, event_distribution array<struct<label:string,n:int>>, suspicious_event_count int, is_wordpress boolean")
    assert [r["trace_id"] for r in sampling.filtered(t, network=True, xhr=True, least_suspicious=2, wordpress=1).collect()] == ["a"]


def test_legacy_advisories(spark):
    raw = spark.createDataFrame([("foo-bar", [("", "u1", "Foo <= 1.2"), ("CVE-1", "", "Foo")])], "slug string, entries array<struct<cve:string,wordfence_uuid:string,title:string>>")
    v = vulnerabilities.legacy_advisories(raw)
    assert {(r["slug"], r["vuln_id"]) for r in v.collect()} == {("foo-bar", "WF-u1"), ("foo-bar", "CVE-1"), ("bar", "WF-u1"), ("bar", "CVE-1")}
    a = spark.createDataFrame([("bar", "1.3"), ("bar", None), ("zzz", "1")], "slug string, version string")
    got = {(r["slug"], r["version"]): (r["status"], r["vuln_ids"]) for r in vulnerabilities.statuses(a, v).collect()}
    assert got == {("bar", "1.3"): ("matched", ["CVE-1"]), ("bar", None): ("version_missing", []), ("zzz", "1"): ("no_wordfence", [])}


def test_fingerprints(spark):
    rows = [("a", "var x = f(1); // c"), ("b", "<html></html>"), ("a", "var x = f(1); // c"), ("c", "")]
    got = {r["hash"]: r for r in ast_fingerprints.fingerprints(spark.createDataFrame(rows, "hash string, text string")).collect()}
    assert got["a"]["status"] == "ok" and got["a"]["node_type_counts"]["Keyword"] == 1 and got["b"]["status"] == "non_js" and got["c"]["unit_vector"] is None

    def broken(source):
        raise ValueError(source)

    assert ast_fingerprints.fingerprints(spark.createDataFrame(rows[:1], "hash string, text string"), broken, "x").first()["status"] == "failed"


def test_small_operators(spark):
    assert filters.listed_clusters("1, 2 3") == [1, 2, 3] and filters.listed_clusters(None) == [] and aggregates.run_key(["b", "a", "b"]) == "b-a"
    both = aggregates.combined(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int"))
    assert sorted(both.columns) == ["a", "b"] and both.count() == 2
    wanted, done = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert joins.existing_or_new(wanted, done, ["k"]).count() == 1 and joins.existing_or_new(wanted, done, ["k"], force=True).count() == 2


def test_lookups_and_orders(spark):
    from trailmark.functions import text, versions
    from trailmark.sources import tables

    t = spark.createDataFrame([("a", 1)], "trace_id string, n int")
    assert {(r["trace_id"], r["n"]) for r in sampling.looked_up(spark.createDataFrame([("a",), ("z",)], "trace_id string"), t).collect()} == {("a", 1), ("z", None)}
    v = spark.createDataFrame([("1.10",), ("beta",), ("1.9",), ("1.2",)], "v string")
    assert [r["v"] for r in v.orderBy(*versions.order("v")).collect()] == ["1.2", "1.9", "1.10", "beta"]
    s = spark.createDataFrame([(["b", "", "a", "b"],)], "s array<string>")
    assert tuple(s.select(text.preview("s", 1), F.array_join(text.ordered_distinct("s"), ",")).first()) == ("b", "b,a")
    assert tables.resolved(None, None, ["y", "x"]) == "x" and tables.resolved("e", "d", []) == "e"
    traces_of = spark.createDataFrame([(1, f"t{i}", "p", [("OBFUSCATION", 9)], [("XHR Request|x", 4)], ["eval"], {"OBFUSCATION": 9}, 5) for i in range(4)], "cluster int, trace_id string, bucket string, capability_summary array<struct<label:string,n:int>>, event_distribution array<struct<label:string,n:int>>, event_sequence_preview array<string>, capability_counts map<string,int>, suspicious_event_count int")
    assert [r["trace_id"] for r in sampling.selected(traces_of, network=True).orderBy("pick").collect()] == ["t0", "t1", "t2"]


def test_consecutive_numbers_have_no_gaps(spark):
    from trailmark.operators.joins import consecutive

    df = spark.range(5000).selectExpr("pmod(xxhash64(id), 700) as a", "id as b").repartition(7)
    got = [(r["a"], r["b"], r["idx"]) for r in consecutive(df, ["a", "b"]).collect()]
    assert [x[2] for x in sorted(got)] == list(range(5000))
