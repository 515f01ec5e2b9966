"""Traces from ``events``: a trace is a user, a token an event type, ``error`` is suspicious."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import once
from ..functions.tokens import base_of, canonical, has_weak, is_noise, is_request, is_xhr, parts, request_details, weak_penalty, weight, with_tokens
from ..operators.aggregates import top_counts
from ..plans import heuristics, sampling, sequences, traces
from ..session import table
from .registry import query, r6

SUSPICIOUS = ("error",)
TR = "tr AS (SELECT user_id AS key, list(event_type ORDER BY ts, event_id) AS seq FROM events GROUP BY user_id)"
CO = TR + ", co AS (SELECT key, seq, list_filter(seq, lambda x, i: i = 1 OR x <> seq[i - 1]) AS comp FROM tr)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace of each user. Capability: upper-case event type."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", F.col("event_type").alias("token"), F.upper("event_type").alias("capability"))
    return traces.trace_rows(e, "key", ["ts", "event_id"], suspicious=SUSPICIOUS)


@query(f"WITH {TR} SELECT key, array_to_string(seq, '>') AS sequence, len(seq)::BIGINT AS num_events FROM tr")
def traces_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("key", F.array_join("event_sequence", ">").alias("sequence"), "num_events")


@query(f"WITH {CO} SELECT key, array_to_string(comp, '>') AS compressed FROM co")
def compress_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("key", F.array_join("compressed_event_sequence", ">").alias("compressed"))


@query("SELECT user_id AS key, count(*) FILTER (event_type = 'error')::BIGINT AS suspicious_event_count FROM events GROUP BY user_id")
def suspicious_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("key", "suspicious_event_count")


@query("SELECT user_id AS key, upper(event_type) AS capability, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def capability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("key", F.explode("capability_counts").alias("capability", "n"))


@query("SELECT user_id AS key, upper(event_type) AS capability, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY user_id, event_type")
def capability_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.capability_shares(rows(spark, sf_dir), "key").withColumn("share", r6("share"))


def _motifs(n: int) -> str:
    return f"WITH {TR}, m AS (SELECT key, unnest(list_transform(range(1, len(seq) - {n - 2}), lambda i: array_to_string(seq[i:i + {n - 1}], ' > '))) AS motif FROM tr) SELECT key, motif, count(*)::BIGINT AS n FROM m GROUP BY ALL"


@query(_motifs(2))
def capability_motifs2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.motif_counts(rows(spark, sf_dir), "key", "event_sequence", 2)


@query(_motifs(3))
def capability_motifs3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.motif_counts(rows(spark, sf_dir), "key", "event_sequence", 3)


@query("SELECT event_type AS token, count(*)::BIGINT AS n FROM events GROUP BY ALL ORDER BY n DESC, token LIMIT 15")
def token_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.frequent_tokens(rows(spark, sf_dir), "event_sequence")


@query("WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT event_type || '|' || props AS token, count(DISTINCT user_id)::BIGINT AS df, round(ln((any_value(n) + 1) / (count(DISTINCT user_id) + 1)) + 1, 6) AS idf FROM events, n GROUP BY 1")
def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", F.concat_ws("|", "event_type", "props").alias("token"), F.lit("X").alias("capability"))
    own = traces.trace_rows(e, "key", ["ts", "event_id"])
    return traces.inverse_document_frequency(own, "event_sequence").withColumn("idf", r6("idf"))


@query(f"WITH {CO} SELECT min(len(comp))::INT AS shortest, max(len(comp))::INT AS longest, round(avg(len(comp)), 6) AS mean FROM co")
def seq_len_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.length_stats(rows(spark, sf_dir), "compressed_event_sequence")


@query(f"WITH {CO}, v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM (SELECT DISTINCT event_type AS token FROM events)), x AS (SELECT key, unnest(comp) AS token, generate_subscripts(comp, 1) AS pos FROM co) SELECT key, string_agg(idx::VARCHAR, ',' ORDER BY pos) AS ids FROM x JOIN v USING (token) GROUP BY key")
def vocab_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rows(spark, sf_dir)
    own = traces.encoded(t, "key", "compressed_event_sequence", traces.vocabulary(t, "event_sequence"))
    return own.select("key", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT event_id, user_id AS key, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS micros FROM events")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts")
    return traces.relative_times(e, "key", "ts", ["event_id"]).select("event_id", "key", F.round(F.col("seconds") * 1e6).cast("long").alias("micros"))


@query(f"WITH {TR}, p AS (SELECT key, seq, list_position(seq[1:40], 'signup') AS f FROM tr) SELECT key, CASE WHEN f > 0 THEN array_to_string(seq[f:f + 11], '>') ELSE '' END AS tokens FROM p")
def platform_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("key", F.array_join(heuristics.platform_window("event_sequence", probes=("signup",)), ">").alias("tokens"))


# --- time warping ---------------------------------------------------------------------------
DTW = f"""{CO}, e AS (SELECT a.key AS i, b.key AS j, a.comp AS a, b.comp AS b FROM co a JOIN co b ON a.key < b.key),
d AS (SELECT i, j, list_reduce(list_prepend(list_prepend(0.0::DOUBLE, list_transform(b, lambda y: 'inf'::DOUBLE)), list_transform(a, lambda x: list_transform(b, lambda y: (CASE WHEN x = y THEN 0.0 WHEN x = 'error' OR y = 'error' THEN 2.0 ELSE 1.0 END)::DOUBLE))),
  lambda prev, costs: list_reduce(list_prepend(['inf'::DOUBLE], list_transform(range(1, len(costs) + 1), lambda k: [costs[k], prev[k], prev[k + 1]])),
    lambda cur, z: list_append(cur, z[1] + least(cur[-1], z[2], z[3]))))[-1] AS dist FROM e)"""


def _pairs(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return sequences.dtw_pairs(rows(spark, sf_dir), "key", "compressed_event_sequence", suspicious=SUSPICIOUS, **more)


@query(f"WITH {DTW} SELECT i, j, dist FROM d")
def dtw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"WITH {DTW}, s AS (SELECT i AS key, j AS other, dist FROM d UNION ALL SELECT j, i, dist FROM d) SELECT key, other, dist, 1 AS rank FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY dist, other) = 1")
def dtw_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.dtw_nearest(rows(spark, sf_dir), "key", "compressed_event_sequence", SUSPICIOUS)


@query(f"WITH {DTW} SELECT i, j, round(1 / (1 + dist), 6) AS similarity FROM d WHERE 1 / (1 + dist) BETWEEN 0.03 AND 0.05")
def dtw_similarity_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, within=(0.03, 0.05)).select("i", "j", r6(sequences.similarity("dist")).alias("similarity"))


@query(f"WITH {DTW} SELECT i, j, least(dist, 12.0) AS dist FROM d")
def dtw_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, cap=12.0)


@query()
def subsequence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user against the longest trace of its ten-user group."""
    t = rows(spark, sf_dir)
    ids = traces.encoded(t, "key", "compressed_event_sequence", traces.vocabulary(t, "event_sequence")).withColumn("cluster", F.expr("int(key div 10)"))
    q = ids.groupBy("cluster").agg(F.max_by("ids", F.struct(F.size("ids"), -F.col("key"))).alias("query_ids"))
    return sequences.alignments(ids.join(q, "cluster"))


# --- tokens ---------------------------------------------------------------------------------
_TOKENS = """tok AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'XHR Request' WHEN 'view' THEN 'networkRequest' WHEN 'error' THEN 'Eval Call' ELSE 'Timer ' || event_type END
  || '|method=get|weak_host=u' || user_id % 7 || '.example|weak_path=/p' || user_id % 3 || CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN '|resource=XHR' ELSE '' END AS token FROM events)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    base = F.when(F.col("event_type") == "click", "XHR Request").when(F.col("event_type") == "view", "networkRequest").when(F.col("event_type") == "error", "Eval Call").otherwise(F.concat(F.lit("Timer "), F.col("event_type")))
    own = F.concat(base, F.lit("|method=get|weak_host=u"), (u % 7).cast("string"), F.lit(".example|weak_path=/p"), (u % 3).cast("string"), F.when((F.col("event_type") == "view") & (u % 2 == 0), "|resource=XHR").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", own.alias("token"))


@query(f"WITH {_TOKENS} SELECT event_id, split_part(token, '|', 1) AS base, array_to_string(list_filter(string_split(token, '|')[2:], lambda p: NOT regexp_matches(p, '^weak_(host|path|domain)=')), '|') AS strong, array_to_string(list_filter(string_split(token, '|')[2:], lambda p: regexp_matches(p, '^weak_(host|path|domain)=')), '|') AS weak, array_to_string(list_filter(string_split(token, '|'), lambda p: NOT regexp_matches(p, '^weak_(host|path|domain)=')), '|') AS canonical, true AS has_weak, CASE WHEN token LIKE 'Eval Call%' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM tok")
def token_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir)
    return t.select("event_id", base_of("token").alias("base"), F.array_join(parts("token", False), "|").alias("strong"), F.array_join(parts("token", True), "|").alias("weak"), canonical("token").alias("canonical"), has_weak("token").alias("has_weak"), weight("token").alias("weight"))


@query(f"WITH {_TOKENS} SELECT event_id, (token LIKE 'XHR Request|%' OR token LIKE 'networkRequest|%') AS is_request, (token LIKE 'XHR Request|%' OR token LIKE '%|resource=XHR') AS is_xhr, 'GET' AS method, regexp_extract(token, 'weak_host=([^|]*)', 1) AS host, 'https://' || regexp_extract(token, 'weak_host=([^|]*)', 1) || regexp_extract(token, 'weak_path=([^|]*)', 1) AS url FROM tok")
def request_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return once(_tokens(spark, sf_dir), d=request_details("token")).select("event_id", is_request("token").alias("is_request"), is_xhr("token", d).alias("is_xhr"), d["method"].alias("method"), d["host"].alias("host"), d["url"].alias("url"))


@query("WITH w AS (SELECT user_id AS key, list_sort(list(DISTINCT event_type) FILTER (value > 80)) AS a, list_sort(list(DISTINCT event_type) FILTER (value <= 20)) AS b FROM events GROUP BY user_id) SELECT key, round(CASE WHEN coalesce(a, []) = coalesce(b, []) THEN 0.0 WHEN coalesce(len(a), 0) = 0 OR coalesce(len(b), 0) = 0 THEN 0.2 ELSE 0.05 + 0.15 * (1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))) END, 6) AS penalty FROM w")
def jaccard_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.array_sort(F.collect_set(F.when(F.col("value") > 80, F.col("event_type")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("value") <= 20, F.col("event_type")))).alias("b"))
    return own.select("key", r6(weak_penalty("a", "b")).alias("penalty"))


# --- scores and rules -----------------------------------------------------------------------
@query("SELECT user_id AS key, round(count(*) FILTER (event_type = 'error') + 2 * count(*) FILTER (event_type = 'click') + 3 * count(*) FILTER (event_type = 'purchase') + 5 * max((event_type = 'purchase')::INT) + 0.5 * count(*) FILTER (event_type = 'error'), 6) AS score FROM events GROUP BY user_id")
def trace_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import trace_score as score

    t = rows(spark, sf_dir)
    pairs = F.transform(F.map_entries("capability_counts"), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("n")))
    return t.select("key", r6(score(F.col("suspicious_event_count"), pairs, pairs, F.col("event_sequence"), F.coalesce(F.try_element_at("capability_counts", F.lit("ERROR")), F.lit(0)), ("purchase",), ("CLICK",))).alias("score"))


@query("WITH s AS (SELECT user_id AS key, user_id // 10 AS cluster, sum(value) AS score FROM events GROUP BY 1, 2) SELECT cluster, round(avg(score), 4) AS mean_score, count(*) FILTER (score >= 3600)::BIGINT AS n_over FROM s GROUP BY 1 HAVING avg(score) >= 3400 OR count(*) FILTER (score >= 3600) >= 4")
def keep_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.expr("user_id div 10").alias("cluster"), "user_id").agg(F.sum("value").alias("score"))
    return sampling.kept_clusters(s, 3400, 4, 3600).withColumn("mean_score", F.round("mean_score", 4))


_HITS = "h AS (SELECT user_id AS key, user_id // 10 AS cluster, list_filter(['errors', 'buys', 'slow'], lambda n: (n = 'errors' AND e >= 15) OR (n = 'buys' AND p >= 15) OR (n = 'slow' AND v > 3500)) AS names FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS p, sum(value) AS v FROM events GROUP BY 1))"


@query(f"WITH {_HITS}, t AS (SELECT cluster, count(*)::BIGINT AS traces, count(*) FILTER (len(names) > 0)::BIGINT AS hits, round(avg((len(names) > 0)::INT), 6) AS share, array_to_string(list_sort(list(key) FILTER (len(names) > 0))[1:3], ',') AS samples FROM h GROUP BY 1), n AS (SELECT cluster, name, count(*) AS n FROM (SELECT cluster, unnest(names) AS name FROM h) GROUP BY ALL), k AS (SELECT cluster, string_agg(name || ':' || n, ',' ORDER BY n DESC, name) AS top FROM n GROUP BY 1) SELECT t.*, coalesce(top, '') AS top FROM t LEFT JOIN k USING (cluster)")
def heuristic_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    own = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("trace_id")).agg(n("error").alias("e"), n("purchase").alias("p"), F.sum("value").alias("v"))
    names = F.array_compact(F.array(F.when(F.col("e") >= 15, "errors"), F.when(F.col("p") >= 15, "buys"), F.when(F.col("v") > 3500, "slow")))
    out = heuristics.by_cluster(own.select("trace_id", F.expr("trace_id div 10").alias("cluster"), names.alias("heuristic_names")))
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(""))
    return out.select("cluster", "traces", "hits", r6("share").alias("share"), text("samples").alias("samples"), text("top").alias("top"))


@query()
def heuristic_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over traces whose payloads are made from events."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "Eval Call").when(F.col("event_type") == "click", "Object.defineProperty Called").when(F.col("event_type") == "view", "atob De-obfuscation").otherwise("Cookie Read")
    payload = F.to_json(F.struct(kind.alias("type"), F.lit("payload(1)").alias("codePreview"), F.lit("payload(1)").alias("outputPreview"), F.lit("Promise").alias("property"), F.concat(F.lit("__51"), F.col("user_id").cast("string")).alias("value"), F.lit(False).alias("configurable"), (F.col("user_id") % 2 == 0).alias("isNative")))
    token = F.concat(kind, F.lit("|weak_host=collect-v6.51"))
    own = e.groupBy(F.col("user_id").alias("trace_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", token.alias("t")))), lambda x: x["t"]).alias("event_sequence"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", payload.alias("p")))), lambda x: x["p"]).alias("payloads"))
    own = own.withColumns({"script_host": F.lit("a.example"), "capability_counts": F.create_map(F.lit("OBFUSCATION"), F.lit(1))})
    return heuristics.detected(own).select("trace_id", F.explode("heuristic_hits").alias("h")).select("trace_id", "h.*")


@query("SELECT cluster, event_type, n, rank FROM (SELECT user_id // 10 AS cluster, event_type, count(*)::BIGINT AS n, (row_number() OVER (PARTITION BY user_id // 10 ORDER BY count(*) DESC, event_type))::INT AS rank FROM events GROUP BY 1, 2) WHERE rank <= 3")
def distribution_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.expr("user_id div 10").alias("cluster"), "event_type")
    return top_counts(e, ["cluster"], "event_type", 3)


def _calls(n: int, name: str, **more) -> list[dict]:
    return [{"type": "Object.defineProperty Called", "property": f"{name}", **more} for _ in range(n)]


#: tokens, payloads and the rules that they fire: one trace for each rule, and one for none
CASES: list[tuple[list[str], list[dict], list[str]]] = [
    (["a|weak_host=h.example"], [{"type": "atob De-obfuscation", "outputPreview": "\n\t payload(1) "}, {"type": "Eval Call", "codePreview": "x payload(1) y"}], ["obfuscated_eval_chain"]),
    (["Script Src Set|weak_host=cdn.jsdelivr.net", "Script Src Set|weak_host=unpkg.com", "DOM Mutation|Node.appendChild|x"], _calls(2, "x"), ["cdn_script_reinjection", "stack_anomaly"]),
    (["Eval Call|x"], [{"type": "Event Listener Added", "listenerPreview": "ask MetaMask", "eventType": "click"}], ["web3_listener_bootstrap"]),
    (["x"], _calls(5, "Promise"), ["prototype_mass_patching", "stack_anomaly"]),
    (["t|weak_host=collect-v9.example", "Eval Call"], [{"type": "Cookie Read", "keys": "__51a, ibx_b"}], ["cookie_beacon"]),
    (["Blob URL Created", "Web Worker Created|domain:blob|wpTestEmojiSupports", "x|onmessage", "DOM Property Read|window|sessionStorage"], [], ["blob_worker_dropper"]),
    (["x|weak_host=a.indejs.net"], [], ["c2_host_contact"]),
    (["x"], [{"type": "DOM Mutation", "stack": "\n at one"}], ["stack_anomaly"]),
    (["x"], _calls(1, "eval", configurable=False, isNative=True, stack="at jquery.js"), ["anti_tamper_locking"]),
    (["DOM Property Read|navigator.webdriver", "DOM Property Read|navigator.plugins"], [], ["environment_mimicry"]),
    (["r|ontouchstart", "r|screen.width", "XHR Request|x"], [], ["platform_divergence"]),
    (["plain", "Script Src Set|weak_host=unpkg.com", "r|ontouchstart", "x|navigator.webdriver"], [*_calls(4, "Promise", stack="a\nb\nc\nd"), {"type": "Eval Call", "codePreview": "zz"}, {"type": "Cookie Read", "keys": "__51a"}], []),
]
_FIRED = ", ".join(f"({k}, '{name}')" for k, (_, _, names) in enumerate(CASES) for name in names)


@query(f"SELECT DISTINCT user_id AS trace_id, name FROM events JOIN (VALUES {_FIRED}) v(k, name) ON user_id % {len(CASES)} = k")
def heuristic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over traces made so that it fires, and over those of the others, where it does not."""
    case = (F.col("user_id") % len(CASES)).cast("int")
    of = lambda i, dump: F.from_json(F.get(F.array(*(F.lit(json.dumps([dump(x) for x in c[i]])) for c in CASES)), case), "array<string>")
    own = table(spark, sf_dir, "events").select("user_id").distinct()
    own = own.select(F.col("user_id").alias("trace_id"), of(0, str).alias("event_sequence"), of(1, json.dumps).alias("payloads"), F.lit("own.example").alias("script_host"), F.create_map(F.lit("OTHER"), F.lit(1)).alias("capability_counts"))
    return heuristics.detected(own).select("trace_id", F.explode("heuristic_names").alias("name"))


# --- events as JSON -------------------------------------------------------------------------
def json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded event of another family for each event type: event_id, event, script_host."""
    e = table(spark, sf_dir, "events")
    u, n = F.col("user_id").cast("string"), (F.col("event_id") % 4).cast("string")
    host = F.concat(F.lit("api.u"), (F.col("user_id") % 5).cast("string"), F.lit(".example.com"))
    arg = (
        F.when(F.col("event_type") == "click", F.to_json(F.struct(F.lit("XHR Request").alias("type"), F.concat(F.lit("https://"), host, F.lit(":8443/p"), n, F.lit("?q=1")).alias("url"), F.lit("POST").alias("method"), F.lit("xhr").alias("resourceType"))))
        .when(F.col("event_type") == "view", F.to_json(F.struct(F.lit("Cookie Update").alias("type"), F.concat(F.lit("sid="), u, F.lit("; Path=/c"), n, F.lit("; Secure")).alias("value"))))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct(F.lit("Form Submitted").alias("type"), F.lit("/buy").alias("action"), F.lit(2).alias("fieldCount"), F.array(F.struct(F.lit("card").alias("name"), F.lit("text").alias("type"), F.col("event_id").alias("value_length")), F.struct(F.lit("").alias("name"), F.lit("password").alias("type"), F.lit(None).cast("long").alias("value_length"))).alias("fields"))))
        .when(F.col("event_type") == "signup", F.to_json(F.struct(F.lit("DOM Mutation").alias("type"), F.lit("Node.appendChild").alias("method"), F.struct(F.when(F.col("event_id") % 2 == 0, "script").otherwise("div").alias("tagName"), F.concat(F.lit("n"), n).alias("id"), F.lit("a.b c").alias("className")).alias("target"))))
        .otherwise(F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, "Monitoring Started").otherwise("Eval Call").alias("type"))))
    )
    event = F.concat(F.lit('{"eventType":"consoleAPI","argsValues":['), arg, F.lit("]}"))
    return e.select("event_id", "user_id", event.alias("event"), F.when(F.col("user_id") % 2 == 0, host).alias("script_host"))


@query("""SELECT event_id, CASE event_type
 WHEN 'click' THEN 'XHR Request|' || CASE WHEN user_id % 2 = 0 THEN 'domain:script-origin' ELSE 'weak_domain=api.u' || user_id % 5 || '.example' END || '|weak_host=api.u' || user_id % 5 || '.example|weak_path=/p' || event_id % 4 || '|method=POST|resource=xhr'
 WHEN 'view' THEN 'Cookie Update|keys=sid|path=/c' || event_id % 4 || '|flags=secure'
 WHEN 'purchase' THEN 'Form Submitted|domain:relative|weak_path=/buy|fields=2|field_preview=card:text:len=' || event_id || '|password'
 WHEN 'signup' THEN 'DOM Mutation|Node.appendChild|' || CASE WHEN event_id % 2 = 0 THEN 'SCRIPT' ELSE 'DIV' END || '#n' || event_id % 4 || '.a.b.c' ELSE 'Eval Call' END AS token,
 CASE event_type WHEN 'click' THEN 'NET_XHR' WHEN 'view' THEN 'COOKIE' WHEN 'purchase' THEN 'CREDENTIALS' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'DOM_INJECT_SCRIPT' ELSE 'DOM_MUTATION' END ELSE 'OBFUSCATION' END AS capability
 FROM events WHERE NOT (event_type = 'error' AND event_id % 3 = 0)""")
def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and capabilities of JSON events of five families, noise left out."""
    own = with_tokens(json_events(spark, sf_dir))
    return own.where(~is_noise("base", "arg")).select("event_id", "token", "capability")


@query("SELECT user_id AS key, count(*) FILTER (event_type IN ('view', 'purchase') OR (event_type = 'error' AND event_id % 3 > 0))::BIGINT AS suspicious, count(*)::BIGINT - count(*) FILTER (event_type = 'error' AND event_id % 3 = 0)::BIGINT AS num_events FROM events GROUP BY 1")
def json_trace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces from JSON events, end to end."""
    own = with_tokens(json_events(spark, sf_dir)).where(~is_noise("base", "arg"))
    return traces.trace_rows(own, "user_id", ["event_id"]).select(F.col("user_id").alias("key"), F.col("suspicious_event_count").alias("suspicious"), "num_events")


@query("SELECT (row_number() OVER (ORDER BY n DESC, s DESC, key))::INT AS rank, key AS cluster FROM (SELECT user_id // 10 AS key, count(*) FILTER (event_type = 'error') AS n, sum(event_id) AS s FROM events GROUP BY 1)")
def ranked_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").groupBy(F.expr("user_id div 10").alias("cluster")).agg(F.count_if(F.col("event_type") == "error").alias("suspicious"), F.sum("event_id").alias("score"))
    return sampling.ranked_clusters(own).select("rank", "cluster")
