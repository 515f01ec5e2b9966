"""Column functions on hand-built rows with their edge cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from trailmark.functions import cookies, text, tokens, urls, versions


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def get(column):
        return one.select(column.alias("x")).first()["x"]

    return get


def lit(x):
    return F.lit(x) if x is not None else F.lit(None).cast("string")


@pytest.mark.parametrize(
    ("url", "host", "path", "weak"),
    [
        ("https://A.B.com:80/x/y?q#f", "a.b.com", "/x/y", "a.b"), ("//cdn.x.org/z.js", "cdn.x.org", "/z.js", "cdn.x"), ("/only/path", None, "/only/path", None),
        ("data:text/js,1", None, "text/js,1", None), ("https://localhost", "localhost", None, "localhost"), ("", None, None, None), (None, None, None, None), ("http://[bad", "[bad", None, "[bad"),
    ],
)
def test_hosts_and_paths(value, url, host, path, weak):
    assert (value(urls.host(lit(url))), value(urls.path(lit(url))), value(urls.weak_host(urls.host(lit(url))))) == (host, path, weak)


@pytest.mark.parametrize(
    ("url", "own", "want"),
    [
        (None, None, None), ("data:x", None, "domain:data"), ("blob:https://a.b/x", None, "domain:blob"), ("/x", None, "domain:relative"), ("https://x.doubleclick.net/a", None, "domain:ad"),
        ("https://notsegment.com/a", None, "domain:analytics"), ("https://a.b.com/", "a.b.com", "domain:script-origin"), ("https://a.b.com/", None, "weak_domain=a.b"),
    ],
)
def test_url_category(value, url, own, want):
    assert value(urls.url_category(lit(url), lit(own))) == want


def test_short_paths_versions_and_assets(value):
    assert value(urls.short_path(lit("https://a.b/" + "x" * 50), 10)) == "/" + "x" * 8 + "…"
    assert value(urls.asset_version(lit("https://a/x.js?v=3&ver=4"))) == "4"
    assert value(urls.asset_version(lit("https://a/jquery-3.6.0.min.js?x=1"))) == "3.6.0"
    assert value(urls.asset_version(lit("https://a/x.js?ver="))) is None
    a = value(urls.asset(lit("https://a/wp-content/PLUGINS/Foo/x.js?ver=1%2E2")))
    assert (a["kind"], a["name"], a["version"]) == ("plugin", "Foo", "1.2")
    assert value(urls.asset(lit("https://a/x.js"))) is None
    assert value(urls.plain_host(lit("WWW.A.com/x"))) == "a.com"
    assert value(urls.comparable_url(lit("https://www.a.com/www.x//"), without_www=True)) == "a.com/x"
    assert value(urls.stack_source(lit("at f (https://a.b/x.js:1:2)"))) == "a.b/x.js"
    assert value(urls.stack_source(lit("anonymous"))) is None


def test_cookies(value):
    c = lit("sid=1; k2 = 2; path=/; Domain=a.b; sid=3; k3=1; k4=1; Secure; httponly")
    assert value(cookies.keys(c)) == "sid,k2,k3" and value(cookies.attribute(c, "domain")) == "a.b" and value(cookies.attribute(c, "secure")) == "secure" and value(cookies.flags(c)) == "secure,httponly"
    assert value(cookies.keys(lit("Secure"))) is None and value(cookies.keys(lit(None))) is None and value(cookies.attribute(lit(""), "path")) is None


EVENTS = [
    ({"type": "Cookie Read", "value": "sid=1; path=/; Secure"}, "Cookie Read|keys=sid|path=/|flags=secure", "COOKIE"),
    ({"type": "Cookie Read", "value": ""}, "Cookie Read|keys=empty", "COOKIE"),
    ({"type": "DOM Mutation", "method": "Node.appendChild", "attributeName": "src", "target": {"tagName": "script", "id": "a", "className": "b.c d"}}, "DOM Mutation|Node.appendChild|attr=src|SCRIPT#a.b.c.d", "DOM_INJECT_SCRIPT"),
    ({"type": "DOM Mutation", "target": {}}, "DOM Mutation", "DOM_MUTATION"),
    ({"type": "setAttribute Called", "tagName": "a", "attribute": "onclick", "value": "f()"}, "setAttribute Called|A|onclick|value=f()", "DOM_INJECT_SCRIPT"),
    ({"type": "setAttribute Called", "tagName": "a", "attribute": "href", "value": "x" * 60}, "setAttribute Called|A|href", "DOM_INJECT_HTML"),
    ({"type": "Event Listener Added", "eventType": "load", "target": "window", "isCapture": True, "isPassive": False}, "Event Listener Added|event=load|target=window|capture", "OTHER"),
    ({"type": "Event Listener Removed", "event": "x", "target": {"nodeName": "DIV"}}, "Event Listener Removed|event=x|target=DIV", "OTHER"),
    ({"type": "Web Worker Created", "scriptURL": "blob:https://a.b/1", "options": {"name": "w"}}, "Web Worker Created|domain:blob|weak_path=https://a.b/1|name=w", "WORKER"),
    ({"type": "Fetch Request", "url": "https://api.x.com/v1", "method": "post", "initiatorType": "script"}, "Fetch Request|weak_domain=api.x|weak_host=api.x|weak_path=/v1|method=post|initiator=script", "NET_FETCH"),
    ({"type": "Form Submitted", "action": "/go", "fieldCount": 2, "fields": [{"name": "u", "type": "text", "value_length": 3}, {"name": "", "type": "password"}]}, "Form Submitted|domain:relative|weak_path=/go|fields=2|field_preview=u:text:len=3|password", "CREDENTIALS"),
    ({"type": "Timeout (Function) Set", "delay": 0, "registrationStack": "at https://s.com/a.js:3:1"}, "Timeout (Function) Set|delay=0|source=s.com/a.js", "TIMERS"),
    ({"type": "Storage Event", "key": "k", "newValue": {"a": 1, "b": 2, "c": 3, "d": 4}}, "Storage Event|key=k|value_preview=a,b,c", "STORAGE"),
    ({"type": "PushManager Subscribe", "options": {"b": 1, "a": 2}}, "PushManager Subscribe|options=a,b", "PUSH"),
    ({"type": "Canvas toDataURL", "tagName": "CANVAS"}, "Canvas toDataURL|CANVAS", "FINGERPRINTING"),
    ({"type": "Service Worker Registration", "scriptURL": "/sw.js", "options": {"scope": "/"}}, "Service Worker Registration|domain:relative|scope=/", "SERVICE_WORKER"),
    ({"type": "Clipboard Write", "textLength": 3, "textPreview": "abc"}, "Clipboard Write|len=3|preview=abc", "CLIPBOARD"),
    ({"type": "Hook Detection Attempt", "functionName": "toString"}, "Hook Detection Attempt|function=toString", "HOOK_EVASION"),
    ({"type": "Download Triggered", "href": "https://a/b"}, "Download Triggered|size=11|target=https://a/b", "DOWNLOAD"),
    ({"type": "Alert Dialog", "message": "m" * 50}, "Alert Dialog|msg=" + "m" * 40, "SOCIAL_ENGINEERING"),
    ({"type": "Geolocation getCurrentPosition", "options": {"enableHighAccuracy": True, "timeout": 0}}, "Geolocation getCurrentPosition|high_accuracy", "GEO"),
    ({"type": "WARNING: Multiple IFrames Created", "count": 3, "message": "x"}, "WARNING: Multiple IFrames Created|count=3|x", "HOOK_EVASION"),
    ({"type": "MutationObserver (Native)", "mutationType": "childList", "attributeName": "a"}, "MutationObserver (Native)|childList|attr=a", "DOM_MUTATION"),
    ({"type": "IFrame Created (Potential Context Escape)", "iframeNumber": 1}, "IFrame Created (Potential Context Escape)|iframe=1", "DOM_INJECT_IFRAME"),
    ({"type": "DOM Property Read", "object": "window", "property": "localStorage", "value": [1, 2]}, "DOM Property Read|window|localStorage|keys=1,2", "OTHER"),
    ({"type": "getUserMedia Call"}, "getUserMedia Call", "MEDIA"),
]


def test_event_tokens(spark):
    rows = [(i, json.dumps({"timestamp": "t", "eventType": "consoleAPI", "argsValues": [e[0]]}), None) for i, e in enumerate(EVENTS)]
    network = {"timestamp": "t", "eventType": "networkRequest", "url": "https://a.b/x", "type": "XHR", "method": "GET"}
    rows += [(100, json.dumps(network), "a.b"), (101, json.dumps({"eventType": "consoleAPI", "argsValues": ["text"]}), None), (102, "{}", None), (103, "not json", None), (104, None, None)]
    df = tokens.with_tokens(spark.createDataFrame(rows, "i int, event string, script_host string"))
    got = {r["i"]: (r["token"], r["capability"]) for r in df.collect()}
    assert got == {i: e[1:] for i, e in enumerate(EVENTS)} | {100: ("networkRequest|domain:script-origin|weak_host=a|weak_path=/x|method=GET|resource=XHR", "OTHER")}


def test_noise(value):
    assert value(tokens.is_noise(lit("x"), lit('{"registrationStack": "at Monitoring.js:1"}'))) and value(tokens.is_noise(lit("Monitoring Started"), lit("{}"))) and not value(tokens.is_noise(lit("x"), lit("{}")))


def test_token_parts(value):
    t = lit("A|x|weak_host=h|y|weak_path=/p")
    assert value(tokens.parts(t, weak=True)) == ["weak_host=h", "weak_path=/p"] and value(tokens.canonical(t)) == "A|x|y" and value(tokens.canonical(lit("A"))) == "A"
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert value(tokens.weak_penalty(arr(), arr())) == 0 and value(tokens.weak_penalty(arr("a"), arr())) == 0.2 and value(tokens.weak_penalty(arr("a"), arr("a"))) == 0
    assert value(tokens.weak_penalty(arr("a", "b"), arr("b", "c"))) == pytest.approx(0.05 + 0.15 * 2 / 3)
    assert value(tokens.weight(lit("Eval Call|x"))) == 2 and value(tokens.weight(lit("x"), idf=F.lit(3.0))) == 3


def test_labels_and_numbers(value):
    assert value(text.severity_label(lit("SEVERITY_VERY_HIGH"))) == "Very High" and value(text.severity_label(lit(" "))) is None
    assert value(text.verdict(F.lit(0), F.lit(2), lit("x"))) == "Suspicious" and value(text.verdict(F.lit(0), F.lit(0), lit(None))) == "Clean"
    n = F.lit(None).cast("int")
    assert value(text.scan_verdict(n, n, n, n, lit("late"))) == "error: late" and value(text.scan_verdict(n, n, n, n)) == "pending" and value(text.scan_verdict(F.lit(0), n, n, F.lit(3))) == "benign"
    assert value(text.slug(lit(" Foo -- Bar!2 "))) == "foo-bar-2" and value(text.slug_aliases(lit("a b c d"))) == ["a-b-c-d", "b-c-d"]
    assert tuple(value(text.label_parts(lit("a (b) (1.2)")))) == ("a (b)", "1.2") and tuple(value(text.label_parts(lit("a")))) == ("a", None)
    assert value(text.number(lit("N/A"))) is None and value(text.number(lit("x"), 0.0)) == 0 and value(text.number(lit(" 2.5 "))) == 2.5
    assert value(text.day_of(lit("20250101-101010"))) == "20250101" and value(text.day_of(lit("x-1"))) is None and value(text.day_before_dash(lit("20250101"))) == ""
    assert value(text.published(lit("2024-01-02 03:04:05"))).year == 2024 and value(text.published(lit("nope"))) is None
    assert tuple(value(text.trace_parts(lit("a_b_20250101_7")))) == ("a_b", "20250101", "7")
    assert value(text.strongest_status(F.array(F.lit("version_missing"), F.lit("matched")))) == "matched" and value(text.strongest_status(F.array().cast("array<string>"))) == "no_wordfence"
    assert value(text.top_level_parts(lit("a (1, 2), b: 3"))) == ["a (1, 2)", "b: 3"]
    assert value(text.unit_vector(F.create_map(F.lit("a"), F.lit(3), F.lit("b"), F.lit(4)))) == {"a": 0.6, "b": 0.8}
    assert value(text.shown(F.lit(None).cast("double"))) == "N/A" and value(text.shown_change(F.lit(1.5))) == "+1.500"
    assert value(text.wrapped_lines(lit("aa bb cc dd"), 5)) == "aa bb\ncc dd"
    assert value(text.blended(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))) == pytest.approx([0.5**0.5, 0.5**0.5])


@pytest.mark.parametrize(("a", "b", "want"), [("1.9", "1.10", -1), ("1.0", "1.0.0", 0), ("2.0-beta", "2.0", -1), ("1.2a-x", "1.2a-x", 0), ("", "1", 0), ("1.2.x-1", "1.2.3-1", 1)])
def test_version_order(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(versions.compare("a", "b").alias("c")).first()["c"] == want
    assert df.select(versions.compare("b", "a").alias("c")).first()["c"] == -want


@pytest.mark.parametrize(
    ("title", "version", "said", "holds"),
    [("Foo <= 1.2.3", "1.2.3", "<= 1.2.3", True), ("Foo < 1.2.3", "1.2.3", "< 1.2.3", False), ("Foo 1.0 - 2.0", "1.5", "1.0 - 2.0", True), ("Foo", "9", "all versions", True), ("Foo >= 1.0 and < 2.0", "2.1", ">= 1.0 and < 2.0", False)],
)
def test_version_ranges(value, title, version, said, holds):
    g = versions.groups_from_title(lit(title))
    assert value(versions.described(g)) == said and value(versions.satisfies(lit(version), g)) == holds
