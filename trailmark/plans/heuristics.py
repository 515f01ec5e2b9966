"""Rules that find behaviour in a trace (HEU-01..11), as expressions over its arrays.

Columns of a trace: event_sequence (array of tokens), payloads (array of JSON texts), script_host,
capability_counts. Hosts in tokens have lost their last label, so keywords that hold one seldom
match them; ``full_hosts`` takes hosts from the payloads' URLs instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.common import blank_to_null, has_any, once, said
from ..functions.urls import host

# what the rules read of a payload; each payload is parsed once
FIELDS = ("type", "keys", "value", "registrationStack", "stack", "outputPreview", "output", "inputPreview", "codePreview", "listenerPreview", "eventType", "property", "attribute", "object", "configurable", "isNativePrototype", "isNative", *K.URL_KEYS)
SCHEMA = f"struct<{', '.join(f'{f}:string' for f in FIELDS)}>"


def given(p: Column, name: str) -> Column:
    return p[name]


def member(p: Column, *names: str) -> Column:
    """The first of these members that is not null or blank."""
    return F.coalesce(*(blank_to_null(p[n]) for n in names))


def truth(p: Column, name: str) -> Column:
    return F.coalesce(~p[name].isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))



def _tokens() -> Column:
    return F.col("event_sequence")


def of_type(*kinds: str) -> Column:
    return F.filter("_payloads", lambda p: F.coalesce(given(p, "type").isin(*kinds), F.lit(False)))


def token_host(token: Column) -> Column:
    part = F.get(F.filter(F.split(token, r"\|"), lambda p: p.rlike("^(weak_domain|weak_host|host)=")), F.lit(0))
    return blank_to_null(F.regexp_replace(part, "^[^=]*=", ""))


def hosts(full: bool = False) -> Column:
    own = F.transform("_payloads", lambda p: host(member(p, *K.URL_KEYS))) if full else F.transform(_tokens(), lambda t: F.lower(token_host(t)))
    return F.filter(own, lambda h: h.isNotNull())


def listed(a: Column, most: int = 5) -> Column:
    return said(F.slice(F.array_sort(F.array_distinct(a)), 1, most))


def any_token(*words: str) -> Column:
    return F.exists(_tokens(), lambda t: has_any(t, words))


def cookie_names() -> Column:
    """Names in cookie payloads; separated by commas, as the recorder writes them."""
    lists = F.transform(of_type("Cookie Read", "Cookie Update"), lambda p: F.split(F.coalesce(member(p, "keys", "value"), F.lit("")), ","))
    return F.filter(F.transform(F.flatten(lists), lambda x: F.trim(x)), lambda x: x != "")


def benign_stack(p: Column) -> Column:
    """A stack of a known library, or of four frames or more; an empty one isn't."""
    stack = F.coalesce(member(p, "registrationStack", "stack"), F.lit(""))
    frames = F.size(F.filter(F.split(stack, r"\n"), lambda x: F.trim(x) != ""))
    return (stack != "") & (has_any(F.lower(stack), K.BENIGN_STACKS) | (frames >= 4))


def previews(kind: str, most: int, *names: str) -> Column:
    return F.filter(F.transform(of_type(kind), lambda p: F.substring(member(p, *names), 1, most)), lambda x: x.isNotNull())


def _match(name: str, severity: str, fires: Column, evidence: Column) -> Column:
    return F.when(F.coalesce(fires, F.lit(False)), F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), evidence.alias("evidence")))


def stripped(x: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def rules(full_hosts: bool = False) -> list[Column]:
    """A struct(name, severity, evidence) or null for each rule, in order."""
    t, h = _tokens(), hosts(full_hosts)
    decoded = previews("atob De-obfuscation", 256, "outputPreview", "output", "inputPreview")
    executed = F.concat(previews("Eval Call", 512, "codePreview", "inputPreview"), previews("Function Constructor", 512, "codePreview", "outputPreview"))
    chained = F.exists(decoded, lambda d: F.exists(executed, lambda e: F.contains(e, F.substring(stripped(d), 1, 32))))
    others = F.filter(h, lambda x: F.coalesce(x != F.col("script_host"), F.lit(True)))
    cdn = F.filter(F.transform(F.filter(t, lambda x: x.startswith("Script Src Set")), token_host), lambda x: has_any(x, K.CDN_HOSTS))
    defined = of_type("Object.defineProperty Called")
    inserted = any_token("DOM Mutation|Node.appendChild", "DOM Mutation|Node.insertBefore")
    web3 = F.filter(of_type("Event Listener Added"), lambda p: has_any(F.lower(given(p, "listenerPreview")), K.WEB3_WORDS))
    target = lambda p: F.lower(F.coalesce(member(p, "property", "attribute", "object"), F.lit("")))
    patched = F.filter(defined, lambda p: has_any(target(p), K.PATCH_TARGETS))
    names = cookie_names()
    beacon = F.filter(names, lambda x: F.exists(F.array(*map(F.lit, K.BEACON_COOKIES)), lambda b: F.startswith(x, b)))
    obfuscated = F.coalesce(F.try_element_at("capability_counts", F.lit("OBFUSCATION")), F.lit(0)) > 0
    workers = F.filter(t, lambda x: F.contains(x, F.lit("Web Worker Created")))
    worker = F.coalesce(F.get(F.filter(workers, lambda x: has_any(x, K.WORKER_QUEUES)), F.lit(0)), F.get(workers, F.lit(0)))
    siphoned = F.get(F.filter(names, lambda x: x.rlike("^(ibx_|wpfomo)")), F.lit(0))
    c2 = F.filter(h, lambda x: has_any(x, K.C2_HOSTS))
    shallow = F.filter(F.concat(of_type("DOM Mutation"), defined), lambda p: ~benign_stack(p))
    heads = F.transform(shallow, lambda p: F.substring(F.coalesce(blank_to_null(F.regexp_extract(stripped(F.coalesce(member(p, "registrationStack", "stack"), F.lit(""))), r"^([^\n]*)", 1)), given(p, "type")), 1, 80))
    locked = F.transform(F.filter(defined, lambda p: F.coalesce(given(p, "configurable") == "false", F.lit(False)) & (truth(p, "isNativePrototype") | truth(p, "isNative"))), lambda p: F.coalesce(member(p, "property", "attribute", "object"), F.lit("unknown")))
    probed = F.filter(F.transform(t, F.lower), lambda x: has_any(x, K.PROBED))
    early = F.filter(F.slice(F.transform(t, F.lower), 1, 40), lambda x: has_any(x, K.PLATFORM_PROBES))
    first = F.array_min(F.transform(early, lambda x: F.array_position(F.transform(t, F.lower), x)))
    window = F.when(first.isNotNull(), F.slice(t, first.cast("int"), F.lit(12)))
    return [
        _match("obfuscated_eval_chain", "high", chained & (F.size(h) > 0), F.concat(F.lit("Hosts reached after obfuscation: "), listed(F.when(F.size(others) > 0, others).otherwise(h)))),
        _match("cdn_script_reinjection", "high", (F.size(cdn) >= 2) & (F.size(defined) >= 2) & inserted & F.exists(defined, lambda p: ~benign_stack(p)), F.concat(F.lit("Injected CDN hosts: "), listed(cdn))),
        _match("web3_listener_bootstrap", "high", (F.size(web3) > 0) & any_token("atob De-obfuscation", "Eval Call"), F.concat(F.lit("Listener hooks: "), said(F.slice(F.transform(web3, lambda p: F.coalesce(member(p, "eventType"), F.lit("unknown"))), 1, 3)))),
        _match("prototype_mass_patching", "medium", (F.size(patched) >= 5) & F.exists(patched, lambda p: ~benign_stack(p)), F.concat(F.lit("Patched targets: "), listed(F.transform(patched, target)))),
        _match("cookie_beacon", "medium", (F.size(beacon) >= 2) & F.exists(h, lambda x: has_any(x, ("51", "collect-v"))) & (obfuscated | any_token("Eval Call")), F.concat(F.lit("Cookie keys: "), listed(beacon))),
        _match("blob_worker_dropper", "high", any_token("Blob URL Created") & F.exists(workers, lambda x: F.contains(x, F.lit("domain:blob"))) & any_token("onmessage") & any_token("DOM Property Read|window|sessionStorage"), F.concat(F.lit("Worker tokens: "), worker, F.lit(" | Cookies: "), F.coalesce(siphoned, F.lit("sessionStorage")))),
        _match("c2_host_contact", "high", F.size(c2) > 0, F.concat(F.lit("C2 host(s): "), listed(c2))),
        _match("stack_anomaly", "medium", F.size(shallow) > 0, F.concat(F.lit("Stack heads: "), said(F.slice(heads, 1, 4)))),
        _match("anti_tamper_locking", "medium", F.size(locked) > 0, F.concat(F.lit("Locked properties: "), listed(locked))),
        _match("environment_mimicry", "low", F.size(probed) >= 2, F.concat(F.lit("Properties accessed: "), said(F.slice(probed, 1, 4)))),
        _match("platform_divergence", "medium", (F.size(early) >= 2) & F.exists(window, lambda x: has_any(x, ("Script Src Set", "networkRequest", "XHR Request"))), F.concat(F.lit("Probe tokens: "), said(F.slice(early, 1, 3)))),
    ]


def hits(full_hosts: bool = False) -> Column:
    """Matches of all rules in their order, as an array of struct(name, severity, evidence), over parsed ``_payloads``."""
    return F.filter(F.array(*rules(full_hosts)), lambda x: x.isNotNull())


def detected(traces: DataFrame, full_hosts: bool = False) -> DataFrame:
    own = once(traces, _payloads=F.transform("payloads", lambda p: F.from_json(p, SCHEMA)))
    return once(own, heuristic_hits=hits(full_hosts)).drop("_payloads").withColumn("heuristic_names", F.transform("heuristic_hits", lambda x: x["name"]))


def platform_window(tokens: Column | str, first: int = 40, length: int = 12, probes: tuple[str, ...] = K.PLATFORM_PROBES) -> Column:
    """WIN-07: the tokens from the earliest probe among the first ones on."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    at = F.array_position(F.transform(F.slice(t, 1, first), lambda x: has_any(F.lower(x), probes)), True)
    return F.when(at > 0, F.slice(t, at.cast("int"), F.lit(length))).otherwise(F.slice(t, 1, 0))


def by_cluster(traces: DataFrame, key: str = "trace_id", least_hits: int = 1, samples: int = 3) -> DataFrame:
    """AGG-26: traces, hits, share, top-5 rules and sample traces of each cluster; samples are the first by key."""
    own = traces.withColumn("_hit", F.size("heuristic_names") >= least_hits)
    totals = own.groupBy("cluster").agg(F.count("*").alias("traces"), F.count_if("_hit").alias("hits"), F.avg(F.col("_hit").cast("int")).alias("share"))
    names = own.where("_hit").select("cluster", F.explode("heuristic_names").alias("name")).groupBy("cluster", "name").agg(F.count("*").alias("n"))
    top = names.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "name"))).where("r <= 5").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name", "n"))), lambda x: F.concat_ws(":", x["name"], x["n"].cast("string"))).alias("top"))
    some = own.where("_hit").withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(key))).where(F.col("r") <= samples).groupBy("cluster").agg(F.array_sort(F.collect_list(key)).alias("samples"))
    return totals.join(top, "cluster", "left").join(some, "cluster", "left")
