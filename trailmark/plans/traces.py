"""From raw browser events to traces: event routing, tokens, sequences, profiles.

Inputs are tables (see ``trailmark.sources``); nothing here reads files or collects rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.common import col
from ..functions.tokens import base_of, is_noise, with_tokens
from ..functions.urls import host


# --- raw events -----------------------------------------------------------------------------
def registered_scripts(raw: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """JN-01, FLT-09: scripts that the page parsed and the index lists, outside the browser's own pages; the first of each id.

    raw: keys, timestamp, method, params (JSON text). index: keys, script_id.
    """
    seen = raw.where("method = 'Debugger.scriptParsed'").select(*keys, "timestamp", F.get_json_object("params", "$.scriptId").alias("script_id"), F.get_json_object("params", "$.url").alias("url"))
    own = seen.where(~F.coalesce(F.col("url").startswith("chrome://") | F.col("url").startswith("chrome-error://"), F.lit(False))).join(index.select(*keys, "script_id"), [*keys, "script_id"], "left_semi")
    first = Window.partitionBy(*keys, "script_id").orderBy("timestamp", "url")
    return own.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "timestamp")


def calling_script(stack: Column | str) -> Column:
    """JN-02: script id of the first frame with a URL outside the browser's own pages. stack: array of struct(scriptId, url)."""
    own = F.filter(col(stack), lambda f: (F.coalesce(f["url"], F.lit("")) != "") & ~f["url"].startswith("chrome://") & ~f["url"].startswith("chrome-error://"))
    return F.get(own, F.lit(0))["scriptId"]


def routed_events(raw: DataFrame, scripts: DataFrame, keys: list[str]) -> DataFrame:
    """JN-02: console and network events of registered scripts, by their calling frame; others are dropped."""
    frames = F.from_json(F.coalesce(F.get_json_object("params", "$.stackTrace.callFrames"), F.get_json_object("params", "$.initiator.stack.callFrames")), "array<struct<scriptId:string,url:string>>")
    events = raw.where(F.col("method").isin("Runtime.consoleAPICalled", "Network.requestWillBeSent")).withColumn("script_id", calling_script(frames))
    console = F.struct(F.col("timestamp"), F.lit("consoleAPI").alias("eventType"), F.get_json_object("params", "$.type").alias("consoleType"), F.get_json_object("params", "$.args").alias("args"))
    network = F.struct(
        F.col("timestamp"), F.lit("networkRequest").alias("eventType"), F.get_json_object("params", "$.requestId").alias("requestId"), F.get_json_object("params", "$.request.url").alias("url"),
        F.get_json_object("params", "$.request.method").alias("method"), F.get_json_object("params", "$.type").alias("type"), F.get_json_object("params", "$.initiator.type").alias("initiatorType"),
    )
    said = F.when(F.col("method") == "Runtime.consoleAPICalled", F.to_json(console)).otherwise(F.to_json(network))
    return events.withColumn("event", said).join(scripts.select(*keys, "script_id"), [*keys, "script_id"]).select(*keys, "script_id", "timestamp", "event")


def argument_values(args: Column | str) -> Column:
    """FN-46: values of console arguments; text that holds JSON stays that JSON."""
    return F.transform(F.from_json(col(args), "array<struct<type:string,value:string,description:string>>"), lambda a: F.coalesce(a["value"], a["description"]))


# --- tokens and traces ----------------------------------------------------------------------
def tokens(events: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each event that counts: keep, token, base, capability, arg. events: keep, script_url, event (JSON text). FLT-02..04."""
    own = with_tokens(events.withColumn("script_host", host("script_url")))
    return own.where(~is_noise("base", "arg")).select(*keep, "token", "base", "capability", "arg")


def trace_rows(rows: DataFrame, key: str, order: list[str], token: str = "token", capability: str = "capability", suspicious: tuple[str, ...] = K.SUSPICIOUS, most: int | None = None) -> DataFrame:
    """AGG-01..03, WIN-01: sequences and counts of each trace, one shuffle by the trace.

    A trace is one record: its sequence is gathered in one row.
    """
    seq = F.sort_array(F.collect_list(F.struct(*order, F.col(token).alias("_t"), F.col(capability).alias("_c"))))
    own = rows.groupBy(key).agg(seq.alias("_s"))
    tokens_of, caps = F.transform("_s", lambda x: x["_t"]), F.transform("_s", lambda x: x["_c"])
    out = own.select(key, tokens_of.alias("event_sequence"), caps.alias("capability_sequence"))
    return out.select(
        "*", compressed("event_sequence", most).alias("compressed_event_sequence"), compressed("capability_sequence", most).alias("compressed_capability_sequence"), counts("capability_sequence").alias("capability_counts"),
        F.size(F.filter("event_sequence", lambda t: base_of(t).isin(*suspicious))).cast("long").alias("suspicious_event_count"), F.size("event_sequence").cast("long").alias("num_events"),
    )


def compressed(sequence: Column | str, most: int | None = None) -> Column:
    """WIN-01: runs of one token as a single token, on request the first ``most``."""
    s = col(sequence)
    kept = F.filter(F.transform(s, lambda x, i: F.struct(x.alias("x"), ((i == 0) | (x != F.get(s, i - 1))).alias("new"))), lambda p: F.coalesce(p["new"], F.lit(True)))
    out = F.transform(kept, lambda p: p["x"])
    return F.slice(out, 1, most) if most else out


def counts(sequence: Column | str) -> Column:
    """AGG-02: map of elements to how often they occur."""
    s = col(sequence)
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(s)), lambda x: F.struct(x, F.size(F.filter(s, lambda y: y == x)).cast("long"))))


def motifs(sequence: Column | str, n: int) -> Column:
    """AGG-08: every n consecutive elements, joined by `` > ``."""
    s = col(sequence)
    starts = F.when(F.size(s) >= n, F.sequence(F.lit(1), F.size(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(s, i, n), " > "))


def motif_counts(traces: DataFrame, key: str, sequence: str, n: int) -> DataFrame:
    """AGG-08: key, motif, n."""
    return traces.select(key, F.explode(motifs(sequence, n)).alias("motif")).groupBy(key, "motif").agg(F.count("*").alias("n"))


def frequent_tokens(traces: DataFrame, sequence: str, most: int = 15) -> DataFrame:
    """AGG-04, TOP-02: the most frequent tokens, ties by name."""
    return traces.select(F.explode(sequence).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(most)


def length_stats(traces: DataFrame, sequence: str) -> DataFrame:
    """AGG-05."""
    n = F.size(sequence)
    return traces.agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"))


def inverse_document_frequency(traces: DataFrame, sequence: str) -> DataFrame:
    """AGG-06: token, df, idf = ln((N + 1) / (df + 1)) + 1, N counting empty sequences too."""
    total = traces.agg(F.count("*").alias("total"))
    df = traces.select(F.explode(F.array_distinct(F.col(sequence))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(total)).select("token", "df", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # one row


def capability_shares(traces: DataFrame, key: str, counts_of: str = "capability_counts") -> DataFrame:
    """AGG-07: key, capability, share of the trace's events."""
    total = F.aggregate(F.map_values(counts_of), F.lit(0).cast("long"), lambda a, b: a + b)
    return traces.select(key, total.alias("_n"), F.explode(counts_of).alias("capability", "n")).select(key, "capability", (F.col("n") / F.when(F.col("_n") == 0, 1).otherwise(F.col("_n"))).alias("share"))


def vocabulary(traces: DataFrame, sequence: str) -> DataFrame:
    """SEQ-01: token, idx: distinct tokens numbered from 0 in order of their letters."""
    from ..operators.joins import consecutive

    return consecutive(traces.select(F.explode(sequence).alias("token")).distinct(), ["token"])


def encoded(traces: DataFrame, key: str, sequence: str, vocab: DataFrame) -> DataFrame:
    """SEQ-01, SEQ-15: key, ids of the sequence by a vocabulary; unknown tokens are -1."""
    rows = traces.select(key, F.posexplode(sequence).alias("pos", "token")).join(vocab, "token", "left")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("idx", F.lit(-1)).alias("idx")))), lambda x: x["idx"])
    return rows.groupBy(key).agg(ids.alias("ids"))


def relative_times(rows: DataFrame, key: str, ts: str, order: list[str]) -> DataFrame:
    """WIN-08: seconds since the first event of the trace."""
    first = F.min(ts).over(Window.partitionBy(key))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))
    return rows.withColumn("seconds", (micros(ts) - micros(first)) / 1e6)


def with_metadata(scripts: DataFrame, metadata: DataFrame, fingerprints: DataFrame, reports: DataFrame, asts: DataFrame, crawl: list[str]) -> DataFrame:
    """JN-03: scripts with their index rows, site fingerprint, verdict (by crawl) and AST (by hash), all left joins."""
    return scripts.join(metadata, [*crawl, "script_id"], "left").join(fingerprints, crawl, "left").join(reports, crawl, "left").join(asts, "hash", "left")
