"""The pipeline's stages, each against what its operator says of the stage before."""

from __future__ import annotations

import re

import pytest

from . import brute
from .test_operators import SCHEMA, docs, empty, texts  # noqa: F401  fixtures


@pytest.fixture(scope="module")
def folder(spark, docs, texts, tmp_path_factory):  # noqa: F811
    at = f"file://{tmp_path_factory.mktemp('data')}"
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, texts[5][:300]), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, docs, texts, folder):  # noqa: F811
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "packing"]
    df = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = spark.createDataFrame(stage(spark, df, folder).collect(), SCHEMA)
        assert df.columns == docs.columns
        seen[name] = {r["doc_id"]: r["text"] for r in df.collect()}
    base = brute.quality(texts.items())
    assert not any(base[i][5] for i in seen["quality_rules"]) and 20 <= len(seen["quality_rules"])
    near = brute.duplicates(seen["quality_rules"].items(), 80)
    assert set(seen["near_dedup"]) == {i for i, v in near.items() if v[2]}
    leak = brute.contamination(seen["near_dedup"].items(), [(1, texts[5][:300])])
    assert set(seen["decontamination"]) == {i for i, v in leak.items() if not v[4]}
    assert set(seen["secret_scan"]) == set(seen["decontamination"])
    assert not any(re.search(r"AKIA[A-Z0-9]{16}", t or "") for t in seen["secret_scan"].values())


def _plain(rows, items):
    """Texts that the first four stages leave, by plain versions of each."""
    from trailmark.llm import secretscan

    left = {d: t for d, _, _, t in rows}
    verdicts = brute.verdicts(rows)
    left = {d: t for d, t in left.items() if verdicts[d]}
    near = brute.duplicates(left.items(), 80)
    left = {d: t for d, t in left.items() if near[d][2]}
    leak = brute.contamination(left.items(), items)
    left = {d: t for d, t in left.items() if not leak[d][4]}
    clean = {}
    for d, t in left.items():
        spans = []  # of all kinds, earlier ones first and longer ones before shorter
        for kind, (pattern, group, least) in (secretscan.BASE | secretscan.MORE).items():
            spans += [(m.start(), -m.end(), kind) for m in pattern.finditer(t) if len(m[group]) >= least]
        out, at = "", 0
        for start, end, kind in sorted(spans):
            if -end > at:
                out += t[at : max(start, at)] + (f"[{kind}]" if start >= at else "")
                at = -end
        clean[d] = out + t[at:]
    return clean


def test_run_equals_a_plain_chain(spark, docs, texts, folder):  # noqa: F811
    """Every kept document's ids, piece by piece, in sequences that are full but for the last."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    import corpus_pipeline
    from trailmark.llm.queries import vocabulary

    want = _plain([(r["doc_id"], r["lang"], r["source"], r["text"]) for r in docs.collect()], [(1, texts[5][:300])])
    rows = corpus_pipeline.run(spark, folder).collect()
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {d: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for d, x in want.items()}
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids[d]), zlib.crc32(ids[d][at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids[d])
    for own in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:])) and min(own)[0] == 0 and sum(n for _, n in own) <= 2048
    assert sum(map(len, ids.values())) > 0.9 * 2048 * (len(places) - 1)


def test_repeated_and_unnamed_rows(spark, docs, folder):  # noqa: F811
    """Rows that repeat another, and rows without a doc_id, go through every stage."""
    import corpus_pipeline

    df = docs.unionByName(docs).unionByName(docs.selectExpr("cast(null as long) as doc_id", *docs.columns[1:]))
    for name, stage in corpus_pipeline.STAGES:
        before, df = df.count(), spark.createDataFrame((out := stage(spark, df, folder)).collect(), out.schema)
        assert 0 < df.count() and (name == "packing" or df.count() <= before)
    assert {None} < {r["doc_id"] for r in df.collect()}


def test_empty_tables(spark, empty, folder):  # noqa: F811
    import corpus_pipeline

    df = empty
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, folder).count() == 0
