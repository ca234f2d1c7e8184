"""Queries without SQL against what the files and plain reading say, over the whole tables."""

from pathlib import Path

import pytest
from test_catalog import SF

from silexa import catalog

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_sizes_are_those_of_the_files(spark):
    got = {r["name"]: (r["files"], r["bytes"]) for r in catalog.QUERIES["agg_28_size"](spark, SF).collect()}
    files = {n: [p] if (p := Path(SF, f"{n}.parquet")).is_file() else list(p.glob("*.parquet")) for n in ("part", "lineitem", "documents")}
    assert got == {n: (len(fs), sum(f.stat().st_size for f in fs)) for n, fs in files.items()}


def test_chunks_cover_their_texts(spark):
    """Passages stand in their text in order, and what lies between two of them is blank."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    parts = {}
    for r in catalog.QUERIES["str_03_chunks"](spark, SF).orderBy("doc_id", "pos").collect():
        parts.setdefault(r["doc_id"], []).append(r["passage"])
    for doc, text in texts.items():
        flat, end, last = "".join(text.split()), 0, 0
        for passage in parts.get(doc, []):
            own = "".join(passage.split())
            at = flat.find(own, last)
            assert own and 0 <= at <= end, doc
            last, end = at, max(end, at + len(own))
        assert end == len(flat), doc


def test_timings_are_those_of_the_captions_a_passage_touches(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text").collect()
    lines = {}
    for r in sorted((r for r in rows if (r["text"] or "").strip(" ")), key=lambda r: (r["conv_id"], r["turn"])):
        lines.setdefault(r["conv_id"], []).append(r["text"].strip(" "))
    asked = 0
    cursor = {}
    for r in catalog.QUERIES["arr_05_timings"](spark, SF).orderBy("conv_id", "pos").collect():
        own, joined = lines[r["conv_id"]], " ".join(lines[r["conv_id"]])
        starts = [sum(len(t) + 1 for t in own[:k]) for k in range(len(own))]
        at = joined.find(r["passage"], cursor.get(r["conv_id"], 0))
        if at < 0 or joined.count(r["passage"][:40]) > 1 or joined.count(r["passage"][-40:]) > 1:
            continue
        asked, cursor[r["conv_id"]] = asked + 1, at + 1
        touched = [(s, s + len(t)) for s, t in zip(starts, own, strict=True) if s < at + len(r["passage"]) and s + len(t) > at]
        assert (r["start_ms"], r["end_ms"]) == (touched[0][0] * 60, touched[-1][1] * 60)
    assert asked > 0
