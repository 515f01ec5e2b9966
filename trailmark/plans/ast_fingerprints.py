"""AST-01..04: fingerprints of script sources by a parser that the caller plugs in.

A parser is a function from source to (node, depth) pairs. ``lexical`` is the fallback that ships:
kinds of lexical tokens with the depth of brackets around them. No JavaScript parser is bundled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import feature_hash, looks_like_html, unit_vector

PREVIEW_LINES, PREVIEW_CHARS = 400, 8000
Parser = Callable[[str], "Iterator[tuple[str, int]]"]
_TOKEN = re.compile(r"""(?P<Comment>//[^\n]*|/\*.*?\*/)|(?P<String>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)|(?P<Number>\d[\w.]*)|(?P<Name>[A-Za-z_$][\w$]*)|(?P<Open>[([{])|(?P<Close>[)\]}])|(?P<Operator>[^\s\w])""", re.DOTALL)
_KEYWORDS = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield async await".split())


def lexical(source: str) -> Iterator[tuple[str, int]]:
    depth = 0
    for m in _TOKEN.finditer(source):
        kind = m.lastgroup or "Operator"
        if kind == "Close":
            depth = max(0, depth - 1)
            continue
        if kind != "Comment":
            yield ("Keyword" if kind == "Name" and m[0] in _KEYWORDS else kind), depth
        depth += kind == "Open"


def fingerprints(scripts: DataFrame, parser: Parser = lexical, name: str = "lexical") -> DataFrame:
    """hash, status, num_nodes, max_depth, node_type_counts, depth_histogram, unit_vector, feature_hash, ast_preview, parser. scripts: hash, text; each hash once. HTML and blank sources are not parsed."""
    own = scripts.dropDuplicates(["hash"]).select("hash", "text", looks_like_html("text").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("hash", pa.string()), ("status", pa.string()), ("num_nodes", pa.int64()), ("max_depth", pa.int32()), ("node_type_counts", pa.map_(pa.string(), pa.int64())), ("depth_histogram", pa.map_(pa.string(), pa.int64())), ("ast_preview", pa.string())])
        for batch in batches:
            rows = []
            for h, text, html in zip(*(batch.column(c).to_pylist() for c in ("hash", "text", "html")), strict=True):
                nodes, status = [], "non_js" if html else "ok"
                if not html:
                    try:
                        nodes = list(parser(text or ""))
                    except Exception:  # noqa: BLE001  a parser's failure is a status of the script
                        status = "failed"
                kinds, depths = Counter(k for k, _ in nodes), Counter(str(d) for _, d in nodes)
                preview = "\n".join(f"{'  ' * d}{k}" for k, d in nodes[:PREVIEW_LINES])[:PREVIEW_CHARS]
                rows.append({"hash": h, "status": status, "num_nodes": len(nodes), "max_depth": max((d for _, d in nodes), default=0), "node_type_counts": sorted(kinds.items()), "depth_histogram": sorted(depths.items()), "ast_preview": preview or None})
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    made = own.mapInArrow(run, "hash string, status string, num_nodes long, max_depth int, node_type_counts map<string,bigint>, depth_histogram map<string,bigint>, ast_preview string")
    return made.withColumn("unit_vector", unit_vector("node_type_counts")).withColumn("feature_hash", feature_hash("unit_vector")).withColumn("parser", F.lit(name))


def status_counts(made: DataFrame) -> DataFrame:
    """AST-04."""
    return made.groupBy("status").agg(F.count("*").alias("n"))
