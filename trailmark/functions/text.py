"""Labels, verdicts, names, numbers and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import blank_to_null, col


# --- verdicts -------------------------------------------------------------------------------
def severity_label(level: Column | str) -> Column:
    """FN-23: title case of a severity level, its underscores as spaces and without the prefix."""
    return blank_to_null(F.initcap(F.lower(F.trim(F.replace(F.regexp_replace(col(level), "(?i)^severity_", ""), F.lit("_"), F.lit(" "))))))


def verdict(malicious: Column | str, suspicious: Column | str, level: Column | str) -> Column:
    """FN-23: Malicious before Suspicious before the severity before Clean."""
    return F.when(col(malicious) > 0, "Malicious").when(col(suspicious) > 0, "Suspicious").otherwise(F.coalesce(severity_label(level), F.lit("Clean")))


def scan_verdict(malicious: Column | str, suspicious: Column | str, harmless: Column | str, undetected: Column | str, error: Column | str | None = None) -> Column:
    """FN-24: label of a scanner's counts; harmless and undetected are benign. Without counts the error, else pending."""
    n = lambda c: F.coalesce(col(c), F.lit(0))
    label = F.when(n(malicious) > 0, "malicious").when(n(suspicious) > 0, "suspicious").when(n(harmless) + n(undetected) > 0, "benign").otherwise("unknown")
    scanned = F.coalesce(col(malicious), col(suspicious), col(harmless), col(undetected)).isNotNull()
    failed = F.lit(None).cast("string") if error is None else blank_to_null(col(error))
    return F.when(scanned, label).otherwise(F.coalesce(F.concat(F.lit("error: "), failed), F.lit("pending")))


def detection_ratio(hits: Column | str, total: Column | str) -> Column:
    """FN-24: hits/total as text; n/a without scanners."""
    return F.when(F.coalesce(col(total), F.lit(0)) > 0, F.concat_ws("/", F.coalesce(col(hits), F.lit(0)).cast("string"), col(total).cast("string"))).otherwise("n/a")


# --- dates and paths ------------------------------------------------------------------------
def day_of(name: Column | str) -> Column:
    """FN-25: YYYYMMDD that a folder name starts with, else null."""
    d = F.substring_index(col(name), "-", 1)
    return F.when(d.rlike("^[0-9]{8}$"), d)


def day_before_dash(name: Column | str) -> Column:
    """FN-25, the form that is blank without a dash."""
    return F.when(col(name).contains("-"), F.substring_index(col(name), "-", 1)).otherwise("")


def published(text: Column | str) -> Column:
    """FN-26: timestamp of an ISO date whose T may be a space; null if malformed."""
    return F.coalesce(F.try_to_timestamp(F.trim(col(text))), F.try_to_timestamp(F.replace(F.trim(col(text)), F.lit(" "), F.lit("T"))))


def trace_parts(trace_id: Column | str) -> Column:
    """FN-52: struct(url_hash, timestamp, script_id) of a trace id; the hash may hold underscores."""
    part = lambda i: blank_to_null(F.regexp_extract(col(trace_id), "^(.*)_([^_]*)_([^_]*)$", i))
    return F.struct(part(1).alias("url_hash"), part(2).alias("timestamp"), part(3).alias("script_id"))


def script_path(stored: Column | str, folder: Column | str, script_id: Column | str, digest: Column | str, missing: str | None = None) -> Column:
    """FN-53: the stored path, else <folder>/<id>_<hash>.js, else ``missing``."""
    guess = F.concat(col(folder), F.lit("/"), col(script_id), F.lit("_"), col(digest), F.lit(".js"))
    return F.coalesce(blank_to_null(col(stored)), guess, F.lit(missing))


def sample_name(rank: Column | str, trace_id: Column | str, digest: Column | str) -> Column:
    """FN-45: NN_trace_sha12.js."""
    return F.concat(F.lpad(col(rank).cast("string"), 2, "0"), F.lit("_"), col(trace_id), F.lit("_"), F.substring(col(digest), 1, 12), F.lit(".js"))


def wrapped_expression(source: Column | str) -> Column:
    """FN-56: a snippet as a parenthesised expression."""
    return F.concat(F.lit("("), col(source), F.lit("\n)"))


def looks_like_html(source: Column | str) -> Column:
    """FLT-10: blank, or starts with a tag, or has a common tag in its first 200 characters."""
    s = F.coalesce(col(source), F.lit(""))
    return (F.trim(s) == "") | F.ltrim(s).startswith("<") | F.lower(F.substring(s, 1, 200)).rlike(r"<(!doctype|html|head|body|script|div)\b")


def looks_like_expression(source: Column | str) -> Column:
    """FLT-10: the first character that is not white space opens an expression."""
    return F.ltrim(col(source)).rlike(r"^[\{\[\(\.=]")


# --- slugs and labels -----------------------------------------------------------------------
def slug(x: Column | str) -> Column:
    """FN-27."""
    return F.btrim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "-"), F.lit("-"))


def slug_aliases(x: Column | str, least: int = 3) -> Column:
    """FN-28: a slug and its endings of at least ``least`` words."""
    words = F.split(slug(x), "-")
    starts = F.when(F.size(words) > least, F.sequence(F.lit(2), F.size(words) - least + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(F.array(slug(x)), F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.size(words)), "-"))))


_LABEL = r"^\s*(.*?)\s*(?:\(([^()]*)\))?\s*$"


def label_parts(label: Column | str, missing: str | None = None) -> Column:
    """FN-29: struct(base, version) of ``name (version)``."""
    return F.struct(F.regexp_extract(col(label), _LABEL, 1).alias("base"), F.coalesce(blank_to_null(F.trim(F.regexp_extract(col(label), _LABEL, 2))), F.lit(missing)).alias("version"))


def label(name: Column | str, version: Column | str) -> Column:
    """AGG-14: ``name (version)``, or the name alone."""
    return F.when(blank_to_null(col(version)).isNotNull(), F.concat(col(name), F.lit(" ("), col(version), F.lit(")"))).otherwise(col(name))


def sound_version(version: Column | str) -> Column:
    """FN-30: a version of letters, digits, dots, dashes and underscores, else null."""
    return F.when(F.trim(col(version)).rlike("^[0-9A-Za-z._-]+$"), F.trim(col(version)))


def version_key(version: Column | str) -> Column:
    """FN-55: lower-case version, ``unspecified`` if blank."""
    return F.coalesce(blank_to_null(F.lower(F.trim(col(version)))), F.lit("unspecified"))


def asset_key(kind: Column | str, name: Column | str, version: Column | str) -> Column:
    """FN-49: struct(kind, slug, version)."""
    return F.struct(col(kind).alias("kind"), slug(name).alias("slug"), F.coalesce(sound_version(version), blank_to_null(F.trim(col(version))), F.lit("unspecified")).alias("version"))


def vulnerability_id(cve: Column | str, uuid: Column | str) -> Column:
    """FN-35."""
    return F.coalesce(blank_to_null(F.trim(col(cve))), F.concat(F.lit("WF-"), blank_to_null(F.trim(col(uuid)))), F.lit("unknown"))


# fixed values: states of an asset against the advisories (FN-50), from the weakest
STATUSES = ("no_wordfence", "version_missing", "no_matching_version", "fallback", "matched")


def status_rank(status: Column | str) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, STATUSES)), col(status)), F.lit(0)).cast("int")


def strongest_status(statuses: Column | str) -> Column:
    """FN-50: the state that says most."""
    ranks = F.array_max(F.transform(col(statuses), status_rank))
    return F.get(F.array(*map(F.lit, STATUSES)), F.greatest(F.coalesce(ranks, F.lit(1)), F.lit(1)) - 1)


# --- hashes and vectors ---------------------------------------------------------------------
def ast_bucket(preview: Column | str, digest: Column | str, trace_id: Column | str) -> Column:
    """FN-38: SHA-1 of the preview, else the script's hash, else the trace."""
    return F.coalesce(F.sha1(blank_to_null(col(preview)).cast("binary")), blank_to_null(col(digest)), col(trace_id).cast("string"))


def unit_vector(counts: Column | str, stored: Column | str | None = None) -> Column:
    """FN-40: a map of counts over its length, unless a stored vector is there; null if empty."""
    c = col(counts)
    norm = F.sqrt(F.aggregate(F.map_values(c), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    own = F.when((F.size(c) > 0) & (norm > 0), F.transform_values(c, lambda k, v: v.cast("double") / norm))
    return own if stored is None else F.coalesce(F.when(F.size(col(stored)) > 0, col(stored)), own)


def feature_hash(vector: Column | str) -> Column:
    """FN-39: SHA-256 over the vector's sorted entries with six digits."""
    said = F.transform(F.array_sort(F.map_entries(col(vector))), lambda e: F.format_string("%s:%.6f", e["key"], e["value"]))
    return F.sha2(F.array_join(said, ","), 256)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def blended(a: Column | str, b: Column | str, share: float = 0.5) -> Column:
    """FN-41: weighted mean of two vectors at unit length; the first where that is zero."""
    mean = F.zip_with(col(a), col(b), lambda x, y: (1 - share) * x.cast("double") + share * y.cast("double"))
    norm = F.sqrt(dot(mean, mean))
    return F.when(norm > 0, F.transform(mean, lambda x: x / norm)).otherwise(F.transform(col(a), lambda x: x.cast("double")))


# --- numbers and display --------------------------------------------------------------------
def number(x: Column | str, otherwise: float | None = None) -> Column:
    """FN-54: a lenient number; blank, ``N/A`` and malformed text give ``otherwise``."""
    t = F.trim(col(x).cast("string"))
    return F.coalesce(F.when(~F.upper(t).isin("", "N/A", "NAN", "NONE"), t).try_cast("double"), F.lit(otherwise).cast("double"))


def shown(x: Column | str, digits: int = 3) -> Column:
    """FN-57: a value with so many digits; N/A if null."""
    return F.when(col(x).isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f", col(x).cast("double")))


def shown_change(x: Column | str) -> Column:
    """FN-57: signed difference."""
    return F.when(col(x).isNull(), "N/A").otherwise(F.format_string("%+.3f", col(x).cast("double")))


def shown_percent(x: Column | str) -> Column:
    """FN-57."""
    return F.when(col(x).isNull(), "N/A").otherwise(F.format_string("%.1f%%", 100 * col(x).cast("double")))


def header(x: Column | str) -> Column:
    """FN-43: a column name of lower-case words joined by underscores."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(col(x))), "[^a-z0-9]+", "_"), F.lit("_"))


def top_level_parts(text: Column | str) -> Column:
    """FN-42: parts at commas that no parenthesis encloses."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"((?:[^,()]|\([^()]*\))+)"), 1), lambda x: F.trim(x)), lambda x: x != "")


def counted_parts(text: Column | str) -> Column:
    """FN-42: struct(label, n) of each part of a distribution written as ``label: n, label: n``."""
    return F.transform(top_level_parts(text), lambda p: F.struct(F.trim(F.regexp_extract(p, r"^(.*?)\s*[:=]\s*(\d+)$", 1)).alias("label"), F.regexp_extract(p, r"^(.*?)\s*[:=]\s*(\d+)$", 2).try_cast("int").alias("n")))


def written(pairs: Column | str, most: int | None = None) -> Column:
    """FN-44: struct(label, n) entries as ``label: n``, comma-joined."""
    own = col(pairs) if most is None else F.slice(col(pairs), 1, most)
    return F.array_join(F.transform(own, lambda p: F.concat_ws(": ", p["label"], p["n"].cast("string"))), ", ")


def neighbours_text(neighbours: Column | str) -> Column:
    """FN-44: ``cluster (distance)``, comma-joined."""
    return F.array_join(F.transform(col(neighbours), lambda n: F.format_string("%d (%.3f)", n["cluster_id"], n["distance"].cast("double"))), ", ")


def sound_neighbours(neighbours: Column | str) -> Column:
    """FN-51: neighbours with a number and a distance, nearest first."""
    cast = F.transform(col(neighbours), lambda n: F.struct(n["distance"].try_cast("double").alias("distance"), n["cluster_id"].try_cast("int").alias("cluster_id")))
    ok = F.array_sort(F.filter(cast, lambda n: n["distance"].isNotNull() & n["cluster_id"].isNotNull() & ~F.isnan(n["distance"])))
    return F.transform(ok, lambda n: F.struct(n["cluster_id"].alias("cluster_id"), n["distance"].alias("distance")))


def wrapped_lines(text: Column | str, width: int = 100) -> Column:
    """FN-44: text broken at spaces into lines of at most ``width`` characters."""
    return F.btrim(F.regexp_replace(col(text), rf"(.{{1,{width}}})(?:\s+|$)", "$1\n"), F.lit("\n"))


def jittered(x: Column | str, key: Column | str, scale: float = 1e-3) -> Column:
    """FN-47: a coordinate moved by a small amount that follows from the key."""
    return col(x) + scale * (F.pmod(F.xxhash64(col(key)), F.lit(2001)) - 1000) / 1000


def decoded_argument(x: Column | str) -> Column:
    """FN-46: JSON text inside a JSON string as a variant; null where it is no JSON."""
    return F.try_parse_json(col(x))


def trace_score(suspicious: Column, capabilities: Column, events: Column, preview: Column, obfuscation: Column, words: tuple[str, ...], risky: tuple[str, ...]) -> Column:
    """FN-37: suspicious events, 2 for each risky capability, 3 for each event with a keyword, 5 for a keyword in the preview, half for each obfuscation.

    ``capabilities`` and ``events`` are arrays of struct(label, n); ``preview`` is an array of tokens.
    """
    from .common import has_any

    total = lambda a, ok: F.aggregate(F.filter(a, ok), F.lit(0.0), lambda s, x: s + x["n"].cast("double"))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return (
        zero(suspicious) + 2 * F.coalesce(total(capabilities, lambda x: x["label"].isin(*risky)), F.lit(0.0)) + 3 * F.coalesce(total(events, lambda x: has_any(F.lower(x["label"]), words)), F.lit(0.0))
        + F.when(has_any(F.lower(F.array_join(preview, " ")), words), 5.0).otherwise(0.0) + 0.5 * zero(obfuscation)
    )


def preview(sequence: Column | str, most: int = 20) -> Column:
    """TOP-07: the first elements of a sequence, joined by an arrow."""
    return F.concat_ws(" -> ", F.slice(col(sequence), 1, most))


def ordered_distinct(items: Column | str) -> Column:
    """SET-04: distinct elements that are not blank, in the order of their first appearance."""
    return F.array_distinct(F.filter(col(items), lambda x: F.coalesce(x != "", F.lit(False))))
