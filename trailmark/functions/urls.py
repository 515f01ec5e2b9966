"""Hosts, paths, categories and asset versions of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .common import any_of, blank_to_null, col

HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def host(url: Column | str) -> Column:
    """FN-01: lower-case host without its port; null where there is none."""
    return blank_to_null(F.lower(F.regexp_extract(col(url), HOST, 1)))


def weak_host(h: Column | str) -> Column:
    """FN-02: host without its last label; a single label stays."""
    clean = F.lower(F.btrim(F.trim(col(h)), F.lit(".")))
    labels = F.filter(F.split(clean, r"\."), lambda x: x != "")
    return F.when(F.size(labels) > 1, F.array_join(F.slice(labels, F.lit(1), F.size(labels) - 1), ".")).otherwise(blank_to_null(clean))


def url_category(url: Column | str, script_host: Column | str | None = None) -> Column:
    """FN-03: the first that holds of data, blob, relative, ad, analytics, script origin, else the weak domain."""
    u, h = col(url), host(url)
    own = F.lit(False) if script_host is None else F.coalesce(h == col(script_host), F.lit(False))
    return (
        F.when(blank_to_null(u).isNull(), F.lit(None).cast("string")).when(u.startswith("data:"), "domain:data").when(u.startswith("blob:"), "domain:blob")
        .when(~u.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]"), "domain:relative").when(h.isNull(), "domain:unknown")
        .when(any_of(K.AD_SUFFIXES, lambda s: F.endswith(h, F.lit(s))), "domain:ad").when(any_of(K.ANALYTICS_SUFFIXES, lambda s: F.endswith(h, F.lit(s))), "domain:analytics")
        .when(own, "domain:script-origin").otherwise(F.concat(F.lit("weak_domain="), F.coalesce(weak_host(h), F.lit("unknown"))))
    )


def first_url(arg: Column | str) -> Column:
    """FN-04: the first URL-like member of a JSON object that is not blank."""
    return F.coalesce(*(blank_to_null(F.get_json_object(col(arg), f"$.{k}")) for k in K.URL_KEYS))


def path(url: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(col(url), PATH, 1))


def short_path(url: Column | str, most: int = 40) -> Column:
    """FN-17: path, cut to ``most`` characters of which the last is an ellipsis."""
    p = path(url)
    return F.when(F.length(p) > most, F.concat(F.substring(p, 1, most - 1), F.lit("…"))).otherwise(p)


def stack_source(stack: Column | str) -> Column:
    """FN-06: host and path of the first URL in a stack, without line and column."""
    url = blank_to_null(F.regexp_replace(F.regexp_extract(col(stack), r"(https?://[^\s)]+)", 1), r":\d+(:\d+)?$", ""))
    return blank_to_null(F.concat(F.coalesce(host(url), F.lit("")), F.coalesce(short_path(url, 80), F.lit(""))))


def query_value(url: Column | str, key: str) -> Column:
    """First value of a query key, decoded; null if blank or malformed."""
    return blank_to_null(F.try_url_decode(F.regexp_extract(col(url), rf"\?(?:[^#]*&)?{key}=([^&#]+)", 1)))


def asset_version(url: Column | str) -> Column:
    """FN-18: version from the query keys by priority, else from the file name."""
    name = F.regexp_extract(path(url), r"([^/]*)$", 1)
    return F.coalesce(*(query_value(url, k) for k in K.VERSION_KEYS), blank_to_null(F.regexp_extract(name, r"(\d+\.\d+(?:\.\d+)*)", 1)))


def asset(url: Column | str) -> Column:
    """FN-19: struct(kind, name, version) of a plugin or theme URL, the plugin first; null for others."""
    plugin = blank_to_null(F.regexp_extract(col(url), r"(?i)/wp-content/plugins/([^/]+)/", 1))
    theme = blank_to_null(F.regexp_extract(col(url), r"(?i)/wp-content/themes/([^/]+)/", 1))
    made = F.struct(F.when(plugin.isNotNull(), "plugin").otherwise("theme").alias("kind"), F.coalesce(plugin, theme).alias("name"), asset_version(url).alias("version"))
    return F.when(plugin.isNotNull() | theme.isNotNull(), made)


def plugin_version(url: Column | str) -> Column:
    """FN-20: struct(name, version) of a lower-cased plugin path; the version only from ``ver=`` or a bare query."""
    u = F.lower(col(url))
    name = blank_to_null(F.regexp_extract(u, r"/wp-content/plugins/([^/?#]+)", 1))
    bare = blank_to_null(F.regexp_extract(u, r"\?([^=&#]+)(?:#|$)", 1))
    return F.when(name.isNotNull(), F.struct(name.alias("name"), F.coalesce(query_value(u, "ver"), bare).alias("version")))


def plain_host(url: Column | str) -> Column:
    """FN-21: lower-case host without ``www.``, of a URL that may lack its scheme."""
    u = F.lower(F.trim(col(url)))
    full = F.when(u.contains("://"), u).otherwise(F.concat(F.lit("http://"), u))
    return blank_to_null(F.regexp_replace(F.regexp_extract(full, HOST, 1), r"^www\.", ""))


def comparable_url(url: Column | str, without_www: bool = False) -> Column:
    """FN-22: URL without scheme and trailing slashes, and on request without every ``www.``."""
    u = F.regexp_replace(F.replace(F.replace(col(url), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), "/+$", "")
    return F.replace(u, F.lit("www."), F.lit("")) if without_www else u


def page_or_unknown(page_url: Column | str, trace_id: Column | str) -> Column:
    """FN-48: page URL, or a made-up one from the trace."""
    return F.coalesce(blank_to_null(F.trim(col(page_url))), F.concat(F.lit("unknown://"), col(trace_id)))


def on_platform(h: Column | str, platforms: tuple[str, ...] = K.HOSTED_PLATFORMS) -> Column:
    """FLT-11: host is a platform's domain or lies below it."""
    return any_of(platforms, lambda d: (col(h) == d) | F.endswith(col(h), F.lit("." + d)))
