"""Event payloads and the tokens made from them.

``arg`` is an event's first argument as JSON text. A token is its base event and further parts,
joined by ``|``; parts that are null vanish.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import cookies
from .common import any_of, blank_to_null, col, has_any, let, once
from .urls import first_url, host, short_path, stack_source, url_category, weak_host


def member(arg: Column | str, *names: str) -> Column:
    """The first of these members of a JSON object that is not null or blank, as text."""
    return F.coalesce(*(blank_to_null(F.get_json_object(col(arg), f"$.{n}")) for n in names))


def given(arg: Column | str, name: str) -> Column:
    """A member as text, blank or not."""
    return F.get_json_object(col(arg), f"$.{name}")


def truth(arg: Column | str, name: str) -> Column:
    """Whether a member is there and neither false, zero nor blank."""
    x = given(arg, name)
    return F.coalesce(~x.isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))


def labelled(name: str, x: Column) -> Column:
    return F.concat(F.lit(name + "="), x)


def event_argument(event: Column | str) -> Column:
    """FLT-02: the event's first argument if it is an object, else one made from the event itself, else an empty object."""
    e = col(event)
    first = F.get_json_object(e, "$.argsValues[0]")
    kind = member(e, "eventType")
    own = F.map_filter(F.from_json(e, "map<string,string>"), lambda k, v: ~k.isin("argsValues", "timestamp", "eventType", "type"))
    resource = member(e, "type")
    extra = F.when(resource.isNotNull() & (resource != kind), F.map_from_arrays(F.array(F.lit("type"), F.lit("resourceType")), F.array(kind, resource))).otherwise(F.map_from_arrays(F.array(F.lit("type")), F.array(kind)))
    made = F.to_json(F.map_concat(own, F.map_filter(extra, lambda k, v: ~F.map_contains_key(own, k))))
    return F.when(F.startswith(first, F.lit("{")), first).when(kind.isNotNull() & (kind != "consoleAPI"), made).otherwise(F.lit("{}"))


def base_event(event: Column | str, arg: Column | str) -> Column:
    return F.coalesce(member(arg, "type"), member(event, "eventType"))


def is_noise(base: Column | str, arg: Column | str) -> Column:
    """FLT-03: an event of the monitor itself."""
    return F.coalesce(col(base).isin(*K.NOISE), F.lit(False)) | has_any(F.lower(given(arg, "registrationStack")), K.MONITOR_STACKS)


def dom_target(target: Column | str) -> Column:
    """FN-14: TAG#id.class.class of a target object."""
    tag = F.upper(member(target, "tagName", "nodeName"))
    classes = F.array_join(F.filter(F.split(F.replace(F.coalesce(given(target, "className"), F.lit("")), F.lit("."), F.lit(" ")), r"\s+"), lambda x: x != ""), ".")
    return F.concat(tag, F.coalesce(F.concat(F.lit("#"), member(target, "id")), F.lit("")), F.when(classes != "", F.concat(F.lit("."), classes)).otherwise(F.lit("")))


def listener_target(target: Column | str) -> Column:
    """FN-14: a target's text, or its description, type, selector or name."""
    t = blank_to_null(col(target))
    return F.when(F.startswith(t, F.lit("{")), F.coalesce(dom_target(t), member(t, "type"), member(t, "selector", "name"))).otherwise(t)


def storage_summary(value: Column | str) -> Column:
    """FN-15: up to three keys of an object, or entries of a list, or 40 characters of text."""
    v = blank_to_null(col(value))
    names = F.array_join(F.slice(F.json_object_keys(F.when(F.startswith(v, F.lit("{")), v)), 1, 3), ",")
    entries = F.array_join(F.slice(F.from_json(F.when(F.startswith(v, F.lit("[")), v), "array<string>"), 1, 3), ",")
    return F.coalesce(blank_to_null(names), blank_to_null(entries), F.when(~v.rlike(r"^[\[{]"), F.substring(v, 1, 40)))


def form_fields(fields: Column | str) -> Column:
    """FN-16: name:type:len=n of up to three fields."""
    own = F.slice(F.from_json(col(fields), "array<struct<name:string,type:string,value_length:string>>"), 1, 3)
    one = F.transform(own, lambda f: F.concat_ws(":", blank_to_null(f["name"]), blank_to_null(f["type"]), labelled("len", f["value_length"])))
    return blank_to_null(F.array_join(F.filter(one, lambda x: x != ""), "|"))


def capability(base: Column | str, attribute_name: Column | str, target_tag: Column | str) -> Column:
    """FN-07."""
    b, t, attribute = col(base), col(target_tag), F.lower(F.coalesce(col(attribute_name), F.lit("")))
    exact = F.create_map(*(F.lit(x) for kv in K.CAPABILITY_OF.items() for x in kv))
    by_tag = F.when(t == "SCRIPT", "DOM_INJECT_SCRIPT").when(t == "IFRAME", "DOM_INJECT_IFRAME").when(t == "STYLE", "DOM_INJECT_HTML").otherwise("DOM_MUTATION")
    by_attribute = F.when(attribute.isin("src", "srcdoc"), "DOM_INJECT_IFRAME").when(attribute.isin("href", "innerhtml"), "DOM_INJECT_HTML").when(attribute.startswith("on"), "DOM_INJECT_SCRIPT").otherwise("DOM_MUTATION")
    rules = (
        F.when(b.startswith("Geolocation"), "GEO").when(b.startswith("getUserMedia") | (b == "enumerateDevices Call"), "MEDIA")
        .when(b == "DOM Mutation", by_tag).when(b == "setAttribute Called", by_attribute)
        .when(b.isin("Timeout (Function) Set", "Interval (Function) Set"), "TIMERS")
        .when(b.startswith("Storage") | b.contains("localStorage") | b.contains("sessionStorage"), "STORAGE")
        .when(b.startswith("Web Worker"), "WORKER").otherwise("OTHER")
    )
    return F.coalesce(F.try_element_at(exact, b), rules)


def _place(url: Column, script_host: Column, most: int | None = 40) -> list[Column]:
    h = host(url)
    return [url_category(url, script_host), labelled("weak_host", F.coalesce(weak_host(h), h)), *([labelled("weak_path", short_path(url, most))] if most else [])]


# members of an argument that tokens are made from; an argument is parsed once
FIELDS = tuple(dict.fromkeys((
    "type", "method", "attributeName", "target", "tagName", "attribute", "value", "eventType", "listenerType", "event", "isCapture", "isPassive", "options", "name", "request", "arguments", "resourceType",
    "initiatorType", "fieldCount", "fields", "delay", "registrationStack", "key", "cacheName", "newValue", "contextType", "textLength", "textPreview", "functionName", "blobSize", "blobType", "element",
    "elementId", "message", "timestamp", "count", "mutationType", "iframeNumber", "object", "property", *K.URL_KEYS,
)))
FIELDS_SCHEMA = f"struct<{', '.join(f'{f}:string' for f in FIELDS)}>"


def parsed_member(fields: Column | str, name: str) -> Column:
    """A member of a parsed argument as text; what follows its name is a path inside it."""
    first = re.match(r"\w+", name)[0]
    return col(fields)[first] if first == name else F.get_json_object(col(fields)[first], f"${name[len(first) :]}")


def event_token(base: Column | str, fields: Column | str, script_host: Column | str, url: Column | str, worker_url: Column | str) -> Column:
    """FN-12: the parts that a family of events adds to its base, by the first family that the base belongs to.

    Give plain columns: each is used many times over.
    """
    b, s, u, w = col(base), col(script_host), col(url), col(worker_url)
    g = lambda name: parsed_member(fields, name)
    m = lambda *names: F.coalesce(*(blank_to_null(g(n)) for n in names))
    true = lambda name: F.coalesce(~g(name).isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))
    when = lambda ok, x: F.when(ok, x)
    value, href, prop = g("value"), m("href"), m("property")
    method = F.coalesce(m("request.method"), m("method"), m("options.method"), m("arguments[1].method"))
    resource = m("resourceType")
    is_form = b == "Form Submitted"
    options = F.array_join(F.slice(F.array_sort(F.json_object_keys(g("options"))), 1, 5), ",")
    size = F.coalesce(when(true("blobSize"), g("blobSize")), F.length(href).cast("string"))
    families: list[tuple[Column, list[Column]]] = [
        (b == "DOM Mutation", [m("method"), labelled("attr", m("attributeName")), dom_target(g("target"))]),
        (b.isin("setAttribute Called", "getAttribute Called"), [F.upper(m("tagName")), m("attribute", "attributeName"), when((value != "") & (F.length(value) < 60), labelled("value", value))]),
        (b.isin("Event Listener Added", "Event Listener Removed"), [labelled("event", m("eventType", "listenerType", "event")), labelled("target", listener_target(g("target"))), when(true("isCapture"), F.lit("capture")), when(true("isPassive"), F.lit("passive"))]),
        (b.startswith("Web Worker"), [*_place(w, s, 60), labelled("name", F.coalesce(m("options.name"), m("name")))]),
        (b.isin(*K.NETWORK_EVENTS), [*_place(u, s), labelled("method", method), when(resource != b, labelled("resource", resource)), labelled("initiator", m("initiatorType")), when(is_form, labelled("fields", g("fieldCount"))), when(is_form, labelled("field_preview", form_fields(g("fields"))))]),
        (b.isin("Timeout (Function) Set", "Interval (Function) Set"), [labelled("delay", g("delay")), labelled("source", stack_source(g("registrationStack")))]),
        (b.isin("Cookie Read", "Cookie Update"), [labelled("keys", F.coalesce(cookies.keys(value), when(value == "", F.lit("empty")))), labelled("domain", blank_to_null(cookies.attribute(value, "domain"))), labelled("path", blank_to_null(cookies.attribute(value, "path"))), labelled("flags", cookies.flags(value))]),
        (b.isin("Storage Event", "Cache API Open", "Cache API Match"), [labelled("key", m("key", "cacheName")), url_category(u, s), labelled("value_preview", storage_summary(m("newValue", "value")))]),
        (b.isin("PushManager Subscribe", "Notification Request Permission"), [labelled("options", blank_to_null(options))]),
        (b.isin("WebGL Context Creation", "Canvas toDataURL"), [m("contextType", "tagName")]),
        (b == "Service Worker Registration", [*_place(w, s, None), labelled("scope", m("options.scope"))]),
        (b.isin("Clipboard Read", "Clipboard Write"), [labelled("len", g("textLength")), labelled("preview", F.substring(m("textPreview"), 1, 40))]),
        (b == "Hook Detection Attempt", [labelled("function", m("functionName"))]),
        (b.isin("Blob URL Created", "Download Triggered"), [labelled("size", size), labelled("target", F.substring(F.coalesce(href, m("blobType")), 1, 60))]),
        (b == "Fullscreen Requested", [m("element", "elementId")]),
        (b.isin("Alert Dialog", "Confirm Dialog", "Prompt Dialog"), [labelled("msg", F.substring(m("message"), 1, 40))]),
        (b.isin("Geolocation getCurrentPosition", "Geolocation watchPosition"), [when(true("options.enableHighAccuracy"), F.lit("high_accuracy")), when(true("options.timeout"), labelled("timeout", g("options.timeout")))]),
        (b == "Window Blur (Possible Popup)", [when(true("timestamp"), g("timestamp"))]),
        (b == "WARNING: Multiple IFrames Created", [labelled("count", g("count")), F.substring(m("message"), 1, 40)]),
        (b == "MutationObserver (Native)", [m("mutationType"), labelled("attr", m("attributeName"))]),
        (b == "IFrame Created (Potential Context Escape)", [labelled("iframe", g("iframeNumber")), labelled("source", stack_source(g("registrationStack")))]),
    ]
    token = None
    for test, parts in families:
        made = F.concat_ws("|", b, *parts)
        token = F.when(test, made) if token is None else token.when(test, made)
    kept = F.when(F.lower(prop).isin("localstorage", "sessionstorage"), labelled("keys", storage_summary(value)))
    return token.otherwise(F.concat_ws("|", b, m("object"), prop, kept))


def with_tokens(events: DataFrame, event: str = "event", script_host: str = "script_host") -> DataFrame:
    """FN-13: adds arg, base, token, capability; events without a base, and of the console itself, are dropped (FLT-04).

    Each step is a column of its own, so that no expression is worked out twice.
    """
    own = once(once(events, arg=event_argument(event)), base=base_event(event, "arg")).where(F.col("base").isNotNull() & (F.col("base") != "consoleAPI"))
    own = once(own, _a=F.from_json("arg", FIELDS_SCHEMA))
    own = own.withColumn("_url", F.coalesce(*(blank_to_null(F.col("_a")[k]) for k in K.URL_KEYS)))
    own = own.withColumns({"_worker": F.coalesce(blank_to_null(F.col("_a.scriptURL")), F.col("_url")), "_tag": F.when(F.col("base") == "DOM Mutation", F.upper(member("_a.target", "tagName", "nodeName")))})
    return own.withColumns({"token": event_token("base", "_a", script_host, "_url", "_worker"), "capability": capability("base", F.col("_a.attribute"), "_tag")}).drop("_a", "_url", "_worker", "_tag")


def base_of(token: Column | str) -> Column:
    return F.substring_index(col(token), "|", 1)


def parts(token: Column | str, weak: bool) -> Column:
    """FN-09: the weak, or the strong, parts of a token after its base."""
    rest = F.slice(F.split(col(token), r"\|"), 2, 10_000)
    is_weak = lambda p: any_of(K.WEAK_PREFIXES, lambda w: F.startswith(p, F.lit(w)))
    return F.filter(rest, lambda p: is_weak(p) if weak else ~is_weak(p))


def canonical(token: Column | str) -> Column:
    """FN-11: base and strong parts."""
    return F.array_join(F.concat(F.array(base_of(token)), parts(token, weak=False)), "|")


def has_weak(token: Column | str) -> Column:
    return F.size(parts(token, weak=True)) > 0


def jaccard(a: Column | str, b: Column | str) -> Column:
    """SET-03."""
    return F.size(F.array_intersect(col(a), col(b))) / F.size(F.array_union(col(a), col(b)))


def weak_penalty(a: Column | str, b: Column | str) -> Column:
    """FN-10: cost between two lists of weak parts."""
    x, y = col(a), col(b)
    return F.when(x == y, 0.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.2).otherwise(0.05 + 0.15 * (1 - jaccard(x, y)))


def weight(token: Column | str, suspicious: tuple[str, ...] = K.SUSPICIOUS, idf: Column | None = None) -> Column:
    """FN-08: 2 for suspicious base events, else 1, times the inverse document frequency if given."""
    w = F.when(base_of(token).isin(*suspicious), 2.0).otherwise(1.0)
    return w if idf is None else w * F.coalesce(idf, F.lit(1.0))


def is_request(token: Column | str) -> Column:
    """FLT-14: the token's base is a network event."""
    b = F.lower(F.trim(base_of(token)))
    return b.isin(*K.REQUEST_BASES) | b.startswith("websocket")


def request_details(token: Column | str) -> Column:
    """FN-36: struct(method, host, path, domain, resource, initiator, url) from a network token."""
    parts_of = F.filter(F.transform(F.slice(F.split(col(token), r"\|"), 2, 10_000), lambda x: F.trim(x)), lambda p: p.rlike("[=:]"))
    pairs = F.transform(parts_of, lambda p: let(F.least(*(F.when(F.instr(p, x) > 0, F.instr(p, x)) for x in "=:")), lambda at: F.struct(F.lower(F.trim(F.substr(p, F.lit(1), at - 1))).alias("k"), F.trim(F.substr(p, at + 1)).alias("v"))))

    def said(own: Column) -> Column:
        last = lambda k: blank_to_null(F.try_element_at(F.filter(own, lambda p: p["k"] == k), F.lit(-1))["v"])
        return F.struct(*(last(k).alias(k) for k in ("method", "scheme", "resource", "initiator", "url")), *(F.coalesce(last(f"weak_{k}"), last(k)).alias(k) for k in ("host", "path", "domain")))

    def built(x: Column) -> Column:
        h, p, scheme = x["host"], x["path"], x["scheme"]
        start = F.when(F.endswith(scheme, F.lit("://")), scheme).when(scheme.isNotNull(), F.concat(scheme, F.lit("://"))).when(h.startswith("http"), "").otherwise("https://")
        url = F.concat(start, h, F.when(p.isNull(), "").when(p.startswith("/") | F.endswith(h, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p)))
        return F.struct(F.upper(x["method"]).alias("method"), h.alias("host"), p.alias("path"), x["domain"].alias("domain"), x["resource"].alias("resource"), x["initiator"].alias("initiator"), F.coalesce(x["url"], url, p).alias("url"))

    return let(let(pairs, said), built)


def is_xhr(token: Column | str, details: Column | None = None) -> Column:
    """FLT-14: an XHR request, or a network request for an XHR resource; give request_details() if they are there already."""
    d = request_details(token) if details is None else details
    b = F.lower(F.trim(base_of(token)))
    return (b == "xhr request") | ((b == "networkrequest") & F.coalesce(F.lower(d["resource"]) == "xhr", F.lit(False)))
