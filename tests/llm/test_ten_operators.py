"""The ten operators against brute force, round trips and defined cases."""

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silexa.llm import decontaminate, jaccard, licenses, media, mixing, quality, shingles, suffixes, tokens, toxicity, urls
from silexa.llm.graph import components


@pytest.fixture(scope="module")
def rows():
    return brute.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.DOCUMENTS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.DOCUMENTS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# media


def test_media_gives_back_every_byte(docs, rows):
    found = by_id(media.media_columns(docs, with_media=True))
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and r["media_bytes"] == len(r["media"])
        assert bytes(r["media"][:2]) == b"\xff\xd8" and bytes(r["media"][-2:]) == b"\xff\xd9"


def test_media_of_all_byte_values_and_of_more_than_one_file():
    rng = np.random.default_rng(1)
    for n in (192, 192 * 7, 192 * (media.ROWS_PER_FILE + 3)):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert b"".join(t.tobytes() for t in media.decode(media.encode([payload]))[0]) == payload
    flat = bytes([255] * 192 + [0] * 192)
    assert b"".join(t.tobytes() for t in media.decode(media.encode([flat]))[0]) == flat


def test_long_texts_go_file_by_file_and_count_in_the_feature(spark, monkeypatch):
    import resource

    rng = np.random.default_rng(3)
    monkeypatch.setattr(media, "ROWS_PER_FILE", 40)
    monkeypatch.setattr(media, "CHUNK", 20_000)
    raw = [rng.integers(32, 127, n, dtype=np.uint8).tobytes().decode() for n in (30_000, 19_000, 40 * 192 * 3)]
    late = raw[2][:20_000] + "".join(" ~"[k // 300 % 2] for k in range(len(raw[2]) - 20_000))
    docs = spark.createDataFrame(list(enumerate([*raw, late])), "doc_id long, text string").coalesce(1)
    found = by_id(media.media_columns(docs, with_media=True))
    for i, t in enumerate([*raw, late]):
        payload = media.payload_of(t.encode())
        thumbs = media.decode([bytes(found[i]["media"])])[0]
        assert b"".join(t.tobytes() for t in thumbs) == payload and found[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert found[i]["media_sha256"] == hashlib.sha256(bytes(found[i]["media"])).hexdigest() and found[i]["tail_crc32"] == zlib.crc32(payload[-16:])
        assert found[i]["feature"] == media.features(thumbs)
    assert found[2]["feature"] != found[3]["feature"]
    monkeypatch.undo()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    described, _ = media._long(np.full(30 << 20, 65, dtype=np.uint8), False)
    assert described[0] == 30 << 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


class _Bits:
    """A plain writer of entropy-coded bits, for files that the encoder of the package does not write."""

    def __init__(self):
        self.bits = ""

    def value(self, n, code):
        size = abs(n).bit_length()
        self.bits += code[size] + (format(n if n > 0 else n + (1 << size) - 1, f"0{size}b") if size else "")

    def flush(self):
        self.bits += "1" * (-len(self.bits) % 8)
        raw = bytes(int(self.bits[i : i + 8], 2) for i in range(0, len(self.bits), 8))
        self.bits = ""
        return raw.replace(b"\xff", b"\xff\x00")


def _colour_file(width, height, sampling, interval, seed):
    """A colour file with AC coefficients by a plain encoder, and its luminance DC values by row and column."""
    rng = np.random.default_rng(seed)
    sizes = list(range(12))
    dc = {s: format(s, "04b") for s in sizes}
    ac_symbols = [0x00, 0xF0, *(r << 4 | s for r in (0, 3) for s in (1, 2, 5))]
    ac = {s: format(k, "04b") for k, s in enumerate(ac_symbols)}
    table = lambda symbols, kind: bytes([kind, 0, 0, 0, len(symbols), *[0] * 12, *symbols])
    h, v = sampling
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    light = rng.integers(-100, 100, (down * v, across * h))
    bits, scan, last, units = _Bits(), b"", [0, 0, 0], 0
    for y in range(down):
        for x in range(across):
            if interval and units and units % interval == 0:
                scan += bits.flush() + bytes([0xFF, 0xD0 + (units // interval - 1) % 8])
                last = [0, 0, 0]
            blocks = [(0, int(light[y * v + b, x * h + a])) for b in range(v) for a in range(h)] + [(1, int(rng.integers(-50, 50))), (2, int(rng.integers(-50, 50)))]
            for c, value in blocks:
                bits.value(value - last[c], dc)
                last[c], left = value, 63
                while left > 20 and rng.random() < 0.6:
                    run, size = [(0, 1), (3, 2), (0, 5), (15, 0)][rng.integers(4)]
                    bits.bits += ac[run << 4 | size] + "".join(rng.choice(["0", "1"]) for _ in range(size))
                    left -= run + 1
                bits.bits += ac[0]
            units += 1
    scan += bits.flush()
    seg = media._segment
    frame = bytes([8, *height.to_bytes(2, "big"), *width.to_bytes(2, "big"), 3, 1, h << 4 | v, 0, 2, 0x11, 1, 3, 0x11, 1])
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\xff\xd9") + seg(0xDB, bytes([0, *[4] * 64]) + bytes([1, *[9] * 64])) + b"\xff" + seg(0xC0, frame) + seg(0xC4, table(sizes, 0x00) + table(ac_symbols, 0x10))
    head += seg(0xDD, interval.to_bytes(2, "big")) if interval else b""
    data = head + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    rows, columns = -(-height // 8), -(-width // 8)
    return data, np.clip(light * 4 // 8 + 128, 0, 255)[:rows, :columns]


@pytest.mark.parametrize(("sampling", "interval"), [((1, 1), 0), ((2, 2), 3), ((2, 1), 0), ((1, 2), 5)])
def test_colour_files_with_subsampling_give_their_luminance(sampling, interval):
    for seed, (width, height) in enumerate([(64, 48), (70, 37), (9, 100)]):
        data, want = _colour_file(width, height, sampling, interval, seed)
        ((thumb,),) = media.decode([data])
        assert thumb.tolist() == want.tolist()


def test_features_are_those_of_a_plain_version():
    rng = np.random.default_rng(9)
    for shape in ((3, 192), (17, 192), (8, 8), (1, 1), (5, 3)):
        thumb = rng.integers(0, 256, shape, dtype=np.uint8)
        cells = []
        for r in range(8):
            for c in range(8):
                ys, xs = [[min(k * n // 8, n - 1) for k in range(8)] for n in shape]
                y0, x0 = ys[r], xs[c]
                y1, x1 = (ys[r + 1] if r < 7 else shape[0]), (xs[c + 1] if c < 7 else shape[1])
                cells.append(thumb[y0 : max(y1, y0 + 1), x0 : max(x1, x0 + 1)].astype(float).mean())
        bits = "".join("1" if m >= np.mean(cells) - 1e-9 else "0" for m in cells)
        assert media.features([thumb]) == f"{shape[1] * 8}x{shape[0] * 8}:{int(bits, 2):016x}"


def test_media_refuses_other_files(empty):
    whole = media.encode([b"a" * 192])[0]
    for bad in (b"GIF89a", b"", whole[:-2], whole[:40], whole.replace(b"\xff\xc0", b"\xff\xc2"), whole[: len(whole) // 2]):
        if bad:
            with pytest.raises(ValueError):
                media.decode([bad])
    assert media.media_columns(empty).count() == 0


# quality


def _labelled(n, seed=3):
    rng = np.random.default_rng(seed)
    good = "the study measured long term outcomes of patients who followed a steady plan and reported careful results in each group".split()
    bad = "buy cheap click now free $$$ win winner prize !!! http xx offer limited deal hot".split()
    texts, labels = [], []
    for i in range(n):
        y = i % 2
        texts.append(" ".join(rng.choice(good if y else bad, 60)).encode())
        labels.append(y)
    return texts, labels


def test_quality_holds_on_texts_it_has_not_seen():
    model = quality.fit(*_labelled(200))
    texts, labels = _labelled(80, seed=8)
    s = quality.scores(model, texts)
    assert ((s >= quality.THRESHOLD) == np.array(labels)).mean() > 0.97
    assert 0 <= s.min() and s.max() <= 1


def test_score_is_a_rising_curve_of_the_difference_alone():
    import zstandard

    model = quality.fit(*_labelled(200))
    texts = [*_labelled(20, seed=8)[0], b"", b"x", b"steady plan " * 50 + b"free prize !!! " * 50, bytes(range(256)) * 3]
    dictionary = {}
    for name, raw in (("good", model.good), ("bad", model.bad)):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=quality.LEVEL)
        dictionary[name] = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    want = []
    for t in texts:
        pieces = [t[i : i + quality.PIECE] for i in range(0, len(t), quality.PIECE)]
        each = sorted((len(dictionary["bad"].compress(p)) - len(dictionary["good"].compress(p))) / (len(p) + 16) for p in pieces) or [0.0]
        at = quality.TAIL * (len(each) - 1)
        low = each[int(at)] + (each[min(int(at) + 1, len(each) - 1)] - each[int(at)]) * (at - int(at))
        want.append(1 / (1 + np.exp(-np.clip(model.slope * low + model.intercept, -30, 30))))
    assert model.slope > 0 and quality.scores(model, texts) == pytest.approx(want)
    flat = quality.Model(model.good, model.bad, 0.0, model.intercept)
    assert len(set(quality.scores(flat, texts))) == 1


def test_curve_gives_probabilities_at_the_true_rate():
    rng = np.random.default_rng(6)
    y = np.repeat([0, 1], 2000)
    x = rng.normal(0, 1, 4000) + 1.5 * y
    slope, intercept = quality.logistic(x, y.astype(float), 0.9)
    y = (rng.random(50_000) < 0.9).astype(int)
    x = rng.normal(0, 1, 50_000) + 1.5 * y
    p = 1 / (1 + np.exp(-(slope * x + intercept)))
    for low in np.arange(0, 1, 0.1):
        own = (p >= low) & (p < low + 0.1)
        if own.sum() > 300:
            assert abs(p[own].mean() - y[own].mean()) < 0.05


def test_quality_without_both_classes_and_odd_texts(spark, docs, empty):
    assert quality.fit([b"a"] * 9, [1] * 9) is None
    both = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (None, 1), (3, 7)], "doc_id long, quality int")
    assert [tuple(r) for r in quality.marked(both, "quality").collect()] == [(2, 1)]
    assert {r["score"] for r in quality.score_quality(docs, None).collect()} == {0.5}
    model = quality.fit(*_labelled(60))
    found = by_id(quality.score_quality(docs, model))
    assert found[0]["score"] == found[10]["score"] and len(found) == docs.count()
    assert quality.score_quality(empty, model).count() == 0


def test_sample_holds_whole_texts_and_each_document_once(spark):
    texts, labels = _labelled(60)
    rows = [(i, t.decode()) for i, t in enumerate(texts)] + [(1000 + i, "long " * 40_000) for i in range(2)] + [(0, texts[0].decode())] * 50 + [(0, texts[0].decode() + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*enumerate(labels), (1000, 0), (1001, 1)], "doc_id long, quality int")
    found, own = quality.labelled_sample(docs, marks, "quality")
    assert sorted(found) == sorted(texts) and sorted(own) == sorted(labels)
    # With less room there are fewer rows, all of them whole, and the first ones stay the same.
    few, some = quality.labelled_sample(docs, marks, "quality", limit=6000)
    assert 0 < len(few) < len(found) and set(few) <= set(texts)
    assert all(sum(len(t) for t, y in zip(few, some, strict=True) if y == k) <= 6000 for k in (0, 1))
    assert [t for t in found if t in set(few)] == few


def test_too_little_text_for_training_gives_a_raw_dictionary():
    model = quality.fit([b"one good word", b"bad"] * 6, [1, 0] * 6)
    assert model.good == b"one good word" * 3 and model.bad == b"bad" * 3


def test_labelled_sample_reads_no_held_out_label(spark, docs):
    labels = spark.createDataFrame([(i, i // 10 % 2) for i in range(0, 600, 10)], "doc_id long, quality int")
    texts, y = quality.labelled_sample(docs, labels.filter(quality.fold(F.col("doc_id"), 5) != 0), "quality")
    used = [i for i in range(0, 600, 10) if zlib.crc32(str(i).encode()) % 5]
    assert len(texts) == len(used) and sum(y) == sum(i // 10 % 2 for i in used)


def test_a_kept_text_leaves_the_jvm_once_and_is_scored_in_parts(docs, monkeypatch):
    scored = quality.score_quality(docs, None, keep=tuple(docs.columns), name="_score")
    assert scored.columns == [*docs.columns, "_score"] and "_text" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["text"] for r in scored.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_shingles_are_hashed_some_bytes_at_a_time(monkeypatch):
    sizes, real = [], jaccard.shingle_sets
    monkeypatch.setattr(jaccard, "shingle_sets", lambda texts, size=5: sizes.append(sum(map(len, texts))) or real(texts, size))
    text = "one two three four five six " * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(range(2000)), pa.array([text] * 2000)], names=["doc_id", "key", "text"])
    assert sum(b.num_rows for b in jaccard._describe(iter([batch]))) >= 2000
    assert sum(sizes) == 2000 * len(text) and max(sizes) <= 1 << 19


# suffixes


def test_repeats_are_those_of_brute_force(docs, rows):
    want = brute.repeats(rows)
    found = by_id(suffixes.removal_report(docs))
    for i, t, *_ in rows:
        kept, removed, spans = want[i]
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len((t or "").encode()), removed, spans, hashlib.sha256(kept).hexdigest())
    assert sum(x[1] for x in want.values()) > 1000


def test_no_table_of_ranges_lies_beside_the_exchange_of_contents(docs, monkeypatch):
    """While contents are dealt out and met, the ranges and the places that asked for them are gone already."""
    there, real = {}, suffixes.materialise

    def watched(df, name):
        shared = Path(df.sparkSession.conf.get("spark.checkpoint.dir").removeprefix("file://"))
        there[name] = {p.name for p in shared.glob("silexa/*/*")}
        return real(df, name)

    before = {p.name for p in Path(docs.sparkSession.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("silexa/*/*")}
    monkeypatch.setattr(suffixes, "materialise", watched)
    suffixes.removal_report(docs).count()
    assert not ({"ranges", "shared"} & there["marks"]) - before and "ranges" not in there["texts"] - before


@pytest.mark.parametrize("large", [0, 1, 3])
def test_repeats_at_crowded_anchors_are_the_same(docs, rows, monkeypatch, large):
    monkeypatch.setattr(suffixes, "LARGE", large)
    monkeypatch.setattr(suffixes, "BROADCAST_BYTES", -1 if large == 3 else 1 << 20)
    want = {i: (n, s, hashlib.sha256(k).hexdigest()) for i, (k, n, s) in brute.repeats(rows).items()}
    assert {i: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in by_id(suffixes.removal_report(docs)).items()} == want


def test_repeats_do_not_hang_on_hashes(docs, rows, monkeypatch):
    # With a hash that takes few values unrelated ranges meet; only equal bytes may go.
    whole = suffixes._contents

    def few(batches):
        for b in whole(batches):
            deal = np.asarray(b.column(1).to_numpy()) % 3
            yield b.set_column(1, "deal", [int(x) for x in deal])

    monkeypatch.setattr(suffixes, "_contents", few)
    want = {i: (n, s) for i, (_, n, s) in brute.repeats(rows).items()}
    assert {i: (r["n_removed"], r["n_spans"]) for i, r in by_id(suffixes.removal_report(docs)).items()} == want


def test_a_long_text_is_searched_in_parts(spark):
    rng = np.random.default_rng(4)
    passage = "".join(rng.choice(list("abcdefgh"), 300))
    body = "".join(rng.choice(list("abcdefgh"), 2 * suffixes.CHUNK))
    text = body[: suffixes.CHUNK - 150] + passage + body[suffixes.CHUNK - 150 :] + passage + "x"
    docs = spark.createDataFrame([(1, text), (2, f"y{passage}z")], "doc_id long, text string")
    found = by_id(suffixes.removal_report(docs))
    assert (found[1]["n_removed"], found[1]["n_spans"]) == (300, 1) and (found[2]["n_removed"], found[2]["n_spans"]) == (300, 1)


def test_two_stage_sort_orders_suffixes():
    rng = np.random.default_rng(2)
    for alphabet in (2, 4, 60):
        raw = rng.integers(97, 97 + alphabet, 900, dtype=np.uint8)
        raw[-1] = 0
        padded = np.concatenate([raw, np.zeros(suffixes.LENGTH + 16, dtype=np.uint8)])
        words = np.zeros(len(raw) + suffixes.LENGTH + 8, dtype=np.uint64)
        for k in range(8):
            words = (words << np.uint64(8)) | padded[k : k + len(words)]
        order = suffixes.two_stage_sort(raw, words)
        assert sorted(order.tolist()) == list(range(len(raw)))
        text = padded.tobytes()
        keys = [text[i : i + suffixes.LENGTH] for i in order.tolist()]
        assert keys == sorted(keys)


def test_repeats_cut_texts_and_keep_extra_columns(spark, empty):
    passage = " ".join(f"p{i * i}" for i in range(40)) + "é" * 10
    rows = [(1, f"start {passage} end", "x"), (2, f"other {passage} tail", "y"), (None, passage, "z"), (3, None, "w")]
    found = by_id(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, _places string")))
    assert found[1]["text"] == rows[0][1] and found[2]["text"] == "othertail" and found[3]["text"] is None and found[3]["_places"] == "w"
    assert suffixes.removal_report(empty).count() == 0


# licenses


def test_base_phrases_at_every_place(spark, docs, rows, empty):
    extra = [(1, "Under the MIT license, under the mit-license. MIT"), (2, "Apache License, Version 2.0 (CC BY-NC)"), (3, "under the mitlicense"), (4, None), (5, "é under THE mit license")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in df.join(licenses.scan_licenses(df), "doc_id").collect():
        w = word.findall((r["text"] or "").translate(brute._LOW))
        places, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            for k in range(len(w)):
                if w[k : k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan_licenses(empty).count() == 0


def _plain(text):
    return " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.translate(brute._LOW))) + " "


def _slow_labels(text):
    """Every rule over the whole text without gates, then suppression by comparing all pairs."""
    words = _plain(text)
    hits = [(-r.priority, m.start() - m.end(), m.start(), n, m.end(), r.named(m), r.confidence) for n, r in enumerate(licenses.rules()) for m in re.finditer(rf"(?<= )(?:{r.expression})(?= )", words)]
    kept = []
    for h in sorted(hits):
        if not any(k[2] <= h[2] and h[4] <= k[4] for k in kept):
            kept.append(h)
    return {h[5] for h in kept}, max((h[6] for h in kept), default=0.0)


def _phrases(n=400, seed=4):
    rng = np.random.default_rng(seed)
    names = "MIT;Apache;Apache Software License;GPL;GNU General Public License;LGPL;GNU Affero General Public License;BSD;3-Clause BSD;Mozilla Public License;MPL;EUPL;PSF;Creative Commons Attribution-ShareAlike;CC BY-NC-SA;CC0;Unlicense;MS-PL;zlib/libpng".split(";")
    verbs = "licensed released distributed available provided published covered governed written".split()
    fill = "the a program file under by terms of license licence version public domain all rights reserved copyright (c) 2020 no copying permitted prohibited permission hereby granted mit gpl-3.0 spdx-license-identifier: source binary gnu é naïve".split()
    out = []
    for _ in range(n):
        lead = f"{rng.choice(verbs)} {rng.choice(['under', 'by'])} {rng.choice(['the ', '', 'terms of the '])}{rng.choice(names)} {rng.choice(['', 'License', 'licence'])} {rng.choice(['', 'version 2.0', 'v3', '4.0', '1.1'])}"
        out.append(" ".join([*rng.choice(fill, rng.integers(0, 9)), lead, *rng.choice(fill, rng.integers(0, 12))]))
    return out


def test_labels_and_scores_are_those_without_gates(spark):
    texts = [*_phrases(), "This program is covered by the GPL version 3", "as cc0", "SPDX-License-Identifier: GPL-2.0-or-later", "https://creativecommons.org/licenses/by-sa/4.0/"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = by_id(licenses.scan_licenses(docs))
    for i, t in enumerate(texts):
        labels, score = _slow_labels(t)
        base = set(filter(None, found[i]["base_labels"].split(",")))
        assert set(filter(None, found[i]["labels"].split(","))) == labels | base, t
        assert found[i]["score"] == max([score] + [0.9] * bool(base)), t
        words = _plain(t).split()
        for d in found[i]["detections"]:
            assert words[d["first"] : d["first"] + d["words"]], t
    at = len(texts) - 4
    assert [found[at + k]["labels"] for k in range(4)] == ["gpl-3", "cc0", "gpl-2", "cc-by-sa-4.0"]


def test_every_gate_is_necessary_and_rules_are_ordered():
    assert len(licenses.rules()) > 190 and all(licenses.required(r.expression) for r in licenses.rules())
    assert [h[2] for h in licenses.detect(" licensed under the apache license version 2 0 ")] == ["apache-2.0"]
    assert licenses.detect(" no such words here ") == []


def test_a_long_text_of_hits_takes_no_time_in_square(spark):
    import time

    began = time.time()
    found = by_id(licenses.scan_licenses(spark.createDataFrame([(1, "copyright notice " * 60_000)], "doc_id long, text string")))
    assert time.time() - began < 20 and len(found[1]["detections"]) == 60_000 and found[1]["detections"][-1]["first"] == 119_998


# tokens


def test_counts_are_those_of_a_public_unigram_tokenizer(spark, docs, rows):
    from tokenizers import Tokenizer, models, pre_tokenizers

    scores = tokens.piece_scores(tokens.FILE)
    vocabulary = list(scores.items())
    unigram = Tokenizer(models.Unigram([*vocabulary, ("<unk>", min(scores.values()))], unk_id=len(vocabulary), byte_fallback=False))
    unigram.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    known = frozenset("".join(scores))
    found = by_id(tokens.count_tokens(docs))
    compared = 0
    for i, t, *_ in rows:
        plain = " ".join((t or "").split())
        if t != plain or not set(plain.replace(" ", "")) <= known or not plain:
            continue
        assert found[i]["n_tokens"] == len(unigram.encode(plain, add_special_tokens=False).tokens), plain[:60]
        compared += 1
    assert compared > 20 and found[0]["n_tokens"] == found[10]["n_tokens"] == 0


def test_runs_of_blanks_against_the_full_vocabulary():
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    scores = tokens.piece_scores(tokens.FILE)
    model = sentencepiece.SentencePieceProcessor(model_file=tokens.FILE)
    runs = {p for p in map(model.id_to_piece, range(model.get_piece_size())) if len(p) > 1 and not p.strip("▁")}
    assert runs and runs <= scores.keys()
    vocabulary = list(scores.items())
    unigram = Tokenizer(models.Unigram([*vocabulary, ("<unk>", min(scores.values()))], unk_id=len(vocabulary), byte_fallback=False))
    unigram.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    own = tokens.Counter(scores)
    for text in ("if x:        return y", "a" + " " * 40 + "b  c   d", "column one    two     three", "ends in blanks     ", "def f(a,  b):    pass"):
        assert own.text(text)[0] == len(unigram.encode(text, add_special_tokens=False).tokens), text
    across = tokens.Counter({"▁": -2.0, "a": -1.0, "b": -1.0, "a▁b": -1.5})
    assert across.text("a b") == (2, -3.5)


def test_viterbi_is_the_best_of_all_cuts():
    c = tokens.Counter({"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -3.0, "c": -1.0, "▁": -2.0})
    assert c.word("abc") == (2, -2.5) and c.word("ab") == (1, -1.5)
    assert c.word("é")[0] == 2


# urls


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"), (F.col("id") % 17 == 0).alias("listed"))
    cascade = urls.build_cascade(keys)
    assert len(cascade.levels) > 1
    wrong = keys.select("listed", cascade.listed(F.array("h"))[0].alias("found")).filter("listed <> found").count()
    assert wrong == 0
    assert urls.build_cascade(keys, max_bytes=8) is None


def test_keys_that_share_a_hash_are_judged_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(urls, "key_hash", lambda key: F.length(key).cast("long"))
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(("bad.org", "fine.de", "sub.bad.org", "longer.name.org"))], "page_id long, url string")
    found = by_id(urls.judge_urls(pages, spark.createDataFrame([("bad.org",)], "host string")), "page_id")
    assert [found[i]["verdict"] for i in range(4)] == ["block", "allow", "block", "allow"]


@pytest.mark.parametrize("limit", [urls.MAX_BYTES, 1])
def test_longest_rule_wins_with_cascade_and_join(spark, limit):
    cases = [
        ("http://A.com/en/x", "com/en/", "block"), ("http://www.Example.com/en/7?q", "example.com/en/7", "allow"), ("http://xexample.com/en/7", "com/en/", "block"), ("ftp://b.net/de/8#f", "net/de/", "allow"),
        ("http://example.net/de/8", "example.net/de/8", "block"), ("http://example.org/es", None, "allow"), ("http://bad.org/fr", None, "block"), ("http://sub.bad.org", None, "block"), ("no host", None, "allow"), (None, None, "allow"), ("http://com/en/", "com/en/", "block"),
        ("http://" + "a." * 5000 + "bad.org/x", None, "block"), ("http://" + "b." * 5000 + "ok.org", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "r") for i, c in enumerate(cases)], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("bad.org",), ("unseen.org",)], "host string")
    found = by_id(urls.judge_urls(pages, listed, max_bytes=limit), "page_id")
    for i, (url, rule, verdict) in enumerate(cases):
        assert (found[i]["rule"], found[i]["verdict"]) == (rule, verdict), url
    assert urls.judge_urls(pages.limit(0), listed).count() == 0


# jaccard


def test_links_are_those_of_all_pairs(docs, rows):
    want = brute.components(rows)
    found = by_id(jaccard.link_documents(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == want
    assert len({c for _, c in want.values()}) < len(want) - 10


def test_shingles_have_no_shared_hashes(rows):
    texts = [(t or "").encode() for _, t, *_ in rows]
    for t, own in zip(texts, shingles.shingle_sets(texts), strict=True):
        assert len(own) == len(brute.shingles(t.decode()))


def test_hot_line_and_chain_of_near_copies(spark):
    line = " ".join(f"common{i}" for i in range(30))
    rows = [(i, f"{line} " + " ".join(f"own{i}x{k}" for k in range(8 + i % 5))) for i in range(40)]
    words = [f"w{k}" for k in range(80)]
    for i in range(40, 70):
        words[(i * 13) % 80] = f"new{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([*rows, (3, rows[50][1]), (None, rows[50][1])], "doc_id long, text string")
    found = [tuple(r) for r in jaccard.link_documents(docs).collect()]
    want = brute.components(rows)
    single = {d: c for d, _, c in found if d is not None and d != 3}
    assert all(single[i] in (want[i][1], 3) for i in single)
    assert {single[i] for i in range(40, 70) if want[i][1] == want[50][1]} == {3}
    assert (None, want[50][0], None) in found


def test_one_of_each_keeps_one_document_a_group(docs, rows, empty):
    want = brute.components(rows)
    kept = [r["doc_id"] for r in jaccard.one_of_each(docs).collect()]
    assert sorted(kept) == sorted({c for _, c in want.values()})
    assert jaccard.link_documents(empty).count() == 0


def test_hot_shingles_and_blocks_lose_nothing(docs, rows, monkeypatch):
    want = brute.components(rows)
    monkeypatch.setattr(jaccard, "SALT_LEVEL", 1)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 1)
    monkeypatch.setattr(jaccard, "BLOOM_BITS", 1)
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 0)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(docs).collect()} == want
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(docs).collect()) == sorted({c for _, c in want.values()})


def test_sets_that_a_common_passage_joins_do_not_meet(spark):
    line = " ".join(f"common{i}" for i in range(12))
    found = []
    for n in (100, 400):
        docs = spark.createDataFrame([(i, f"{line} own{i} more{i}") for i in range(n)], "doc_id long, text string")
        described = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(jaccard._describe, "kind byte, doc_id long, key long, node long, n long")
        met = jaccard.postings(docs, *jaccard._frequent(described)).repartition(4, "salt", "token").sortWithinPartitions("token", "node").mapInArrow(jaccard._met_twice, "salt byte, token long, node long, meta long")
        met = met.select("salt", "token", "node", F.shiftright("meta", 36).alias("place"), F.shiftright("meta", 9).bitwiseAND((1 << 27) - 1).alias("n"), F.shiftright("meta", 6).bitwiseAND(7).alias("least"))
        assert met.count() >= n
        found.append(jaccard.pairs_across(met, spark.createDataFrame([], "node long, label long")).count())
    assert found == [0, 0]


def test_one_of_each_of_rows_that_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a"), (1, text, "a"), (2, text, "b"), (3, "other words stand in here now", "b"), (3, "other words stand in here now", "a"), (3, "zz", "a"), (None, text, "n"), (None, text, "n")]
    kept = [tuple(r) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _nth string")).collect()]
    assert sorted(r[0] for r in kept if r[0]) == [1, 3] and [r for r in kept if r[0] is None] == [(None, text, "n")] * 2


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["label"] for r in components(edges).collect()} == {0}


# decontaminate


def _bench(spark):
    items = [
        (1, "Maria has 12 apples and buys 30 more apples at the small market near home how many apples"),
        (2, "the treaty that ended the long war between both kingdoms was signed in which city"),
        (3, "if a train runs 60 km in 2 hours and then 60 km again what is its speed"), (4, "too short"), (5, None),
    ]
    return spark.createDataFrame(items, "item_id long, text string")


def test_leaks_exact_changed_and_torn(spark, empty):
    docs = spark.createDataFrame(
        [
            (1, "Intro words. Maria has 12 apples and buys 30 more apples at the small market near home; how many apples? outro"),
            (2, "yesterday we saw that Petra has 7 apples and buys 5 more apples at the small market near home how many apples"),
            (3, "if a train runs 80 km in 2 hours and then 80 km again what is its speed"), (4, "if a train runs 80 km in 2 hours and then 90 km again what is its speed"),
            (5, "nothing of this kind stands here and no item is near"), (6, None), (7, ""), (None, "the treaty that ended the long war between both kingdoms was signed in which city"),
        ],
        "doc_id long, text string",
    )
    found = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.leaks(docs, _bench(spark)).collect()}
    assert found[(1, 1)] and found[(3, 3)] is False and found[(None, 2)]
    assert (4, 3) not in found and not any(d in (5, 6, 7) for d, _ in found)
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, _bench(spark)).collect()} >= {5, 6, 7, None}
    assert decontaminate.leaks(empty, _bench(spark)).count() == 0 and decontaminate.leaks(docs, _bench(spark).limit(0)).count() == 0


def test_names_in_any_place_and_numbers_with_separators(spark):
    item = "Tom has 800 apples. Tom gives 3 apples to Mary Jones. How many apples has Tom"
    bench = spark.createDataFrame([(1, item), (2, "we know how a clock is built"), (3, "Rome Paris London Berlin Madrid")], "item_id long, text string")
    docs = spark.createDataFrame(
        [
            (1, item), (2, "Bob has 1,200 apples. Bob gives 3.5 apples to Anna Lee. How many apples has Bob"), (3, "\"Bob has 1.200 apples.\nBob gives 4 apples to Anna Lee.\" How many apples has Bob?"),
            (4, "Bob has 900 apples. Max gives 4 apples to Anna Lee. Why many apples has Tim"), (5, "Vienna Lisbon Dublin Oslo Warsaw"), (6, "Rome, Paris, London, Berlin, Madrid"),
        ],
        "doc_id long, text string",
    )
    found = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["exact"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert found == {(1, 1): (9, True), (2, 1): (9, False), (3, 1): (9, False), (6, 3): (1, True)}


def _template(text, lower):
    """Raw and template words of a text by plain string work."""
    import unicodedata

    letter, number = (lambda c: unicodedata.category(c)[0] == "L"), (lambda c: unicodedata.category(c)[0] == "N")
    words, i, n = [], 0, len(text)
    opens, quotes = set(".!?:;…\n\r"), set(decontaminate._QUOTES.replace("\\", ""))
    while i < n:
        if not (letter(text[i]) or number(text[i])):
            i += 1
            continue
        j = i
        while j < n and (letter(text[j]) or number(text[j]) or (text[j] in ".," and j + 1 < n and number(text[j - 1]) and number(text[j + 1]))):
            j += 1
        word, k = text[i:j], i - 1
        head = re.match(r"[^\W\d_]*", word)[0]
        capital = unicodedata.category(word[0]) == "Lu" and any(unicodedata.category(c) == "Ll" for c in head)
        while k >= 0 and (text[k].isspace() and text[k] not in "\n\r" or text[k] in quotes | set("*•-")) and text[k] not in quotes:
            k -= 1
        opener = capital and (k < 0 or text[k] in opens | quotes)
        words.append([word, capital, opener, i])
        i = j
    out = []
    for word, capital, opener, at in words:
        low = word.lower().replace(",", "\3").replace(".", "\3")
        kind = "#w" if capital and (not opener or low not in lower) else low
        if not capital and word and number(word[0]):
            digits = re.match(r"[\d\3]+", low)[0]
            kind = "#n" + low[len(digits) :]
            if re.fullmatch(decontaminate.UNITS, low[len(digits) :]):
                kind = "#n#u"
        elif out and out[-1][1] == "#n" and text[at - 1] == " " and re.fullmatch(decontaminate.UNITS, low):
            kind = "#u"
        out.append([low, kind, capital and not opener, at + len(word)])
    return [o[0] for o in out], [o[1] for o in out]


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_templates_are_those_of_plain_string_work_and_texts_are_marked_once(spark):
    rng = np.random.default_rng(5)
    words = ["Tom", "McX", "Ärger", "USA", "tom", "xY", "3", "1,200.5", "60 km", "7kg", "4 kgs", "é"]
    between = [".", "!", ":", "…", "\n", "\r", "\t", " ", "  ", '"', "„", "’", "(", "[", "*", "•", "-", "—"]
    text = lambda: "".join(str(rng.choice(words)) + "".join(map(str, rng.choice(between, int(rng.integers(1, 5))))) for _ in range(int(rng.integers(0, 12))))
    texts = [str(rng.choice(["", *between])) + text() for _ in range(400)]
    texts += ["", " ", "Tom", "  Tom", ". " + " *-" * 200 + "Tom", "x " + " *-" * 200 + "Tom", "Tom Tom. Tom\nTom", "\n \t Tom", "a\n* Tom", "no capital, no digit"]
    lower = ["tom", "ärger"]
    rows = decontaminate._rows(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["i"], lower)
    want = [_template(t, set(lower)) for t in texts]
    assert [(r["raw"], r["words"]) for r in sorted(rows.collect())] == want
    assert {w for _, words in want for w in words} >= {"#w", "#n", "#u", "#n#u", "tom", "ärger"}
    # A step that Spark interprets row by row must not hold the marking of the text, which would then run again.
    nodes = [n.verboseStringWithOperatorId() for n in _nodes(rows._jdf.queryExecution().sparkPlan())]
    assert any("transform(" in n for n in nodes) and not any("transform(" in n and r"\p{Lu}" in n for n in nodes)


def _slow_leaks(docs, items):
    """All pairs of documents and items, window by window."""
    lower = {w for _, t in items if t for w in re.findall(r"[^\W_]+", t) if w[0].islower()}
    cut = lambda t: _template(t or "", lower)
    found = {}
    for item, text in items:
        raw, words = cut(text)
        width = min(decontaminate.WIDTH, len(words))
        total = len(words) - width + 1
        for doc, other in docs if width else ():
            draw, dwords = cut(other)
            lines = {}
            for p in range(total):
                for q in range(len(dwords) - width + 1):
                    if words[p : p + width] == dwords[q : q + width]:
                        slots = [(words[p + k], raw[p + k], draw[q + k]) for k in range(width) if words[p + k].startswith("#")]
                        names = sum(s[0] == "#w" for s in slots)
                        if (names * 2 <= width + 1 and width >= decontaminate.LEAST_WORDS) or all(b == d for _, b, d in slots):
                            lines.setdefault(q - p, []).append((p, slots))
            kept, exact = set(), True
            for windows in lines.values():
                pairs = {s for _, slots in windows for s in slots}
                if len({(k, b) for k, b, _ in pairs}) == len({(k, d) for k, _, d in pairs}) == len(pairs):
                    kept |= {p for p, _ in windows}
                    exact &= all(b == d for _, b, d in pairs)
            if len(kept) / total >= decontaminate.COVERAGE:
                found[doc, item] = (len(kept), total, exact)
    return found


def test_leaks_are_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    names = ["Tom", "Mary Jones", "Dr Ann Lee", "Bob", "Über", "Otto"]
    plain = "the man gives apples to a friend near house and then goes home again with more of them than before while nobody looks".split()

    def sentence(k):
        out = []
        for _ in range(k):
            x = rng.random()
            out.append(str(rng.choice(names)) if x < 0.15 else str(rng.choice(["3", "1,200", "4.5", "60 km", "7 kg", "12"])) if x < 0.3 else str(rng.choice(plain)))
        return " ".join(out).capitalize() + str(rng.choice([". ", "? ", ", ", "\n", "! "]))

    items = [(i, "".join(sentence(int(rng.integers(1, 14))) for _ in range(int(rng.integers(1, 4))))) for i in range(14)]
    items += [(20, "Tom"), (21, "gives apples"), (22, ""), (23, None), (24, items[0][1]), (25, "Mary Jones gives 3 apples")]
    docs = []
    for d in range(60):
        _, text = items[int(rng.integers(14))]
        for old, new in ((str(rng.choice(names)), str(rng.choice(names))), (str(rng.choice(["3", "12", "60"])), str(rng.choice(["8", "3", "12"])))):
            text = text.replace(old, new) if rng.random() < 0.7 else text
        docs.append((d, sentence(5) + text + sentence(4) if rng.random() < 0.8 else sentence(20)))
    docs += [(100, None), (101, ""), (102, "said Tom"), (103, "Mary Jones gives 3 apples"), (104, "Ann Lee gives 3 apples")]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = _slow_leaks(docs, items)
    got = lambda: {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"], r["exact"]) for r in decontaminate.leaks(table, bench).collect()}
    assert got() == want and len(want) > 40 and {e for *_, e in want.values()} == {True, False}
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert got() == want
    monkeypatch.setattr(decontaminate, "LOWER", 3)
    assert got() == want


def test_two_values_do_not_become_one(spark):
    bench = spark.createDataFrame([(1, "a boat sails 60 km on monday and then 90 km on the day behind it")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a boat sails 10 km on monday and then 20 km on the day behind it"), (2, "a boat sails 10 km on monday and then 10 km on the day behind it")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()] == [1]


# mixing


def test_targets_fill_up_by_weight(docs, rows, spark, empty):
    found = mixing.mixed_sizes(docs).collect()
    size = {i: brute.word_count(t) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    per = Counter()
    for i, n in size.items():
        per[source[i]] += n
    names = sorted((s for s in per if s is not None)) + [None] * (None in per)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(per.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * per[s]}
        for s in full or free:
            target[s] = 2 * per[s] if full else level * weight[s]
            left -= target[s] if full else 0
        free = free - full if full else set()
    for r in found:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], per[s]) and r["target"] == pytest.approx(target[s])
        assert r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mixed_sizes(docs.repartition(2)).collect()))
    assert mixing.mixed_sizes(empty).count() == 0


def test_documents_are_written_as_often_as_taken(docs):
    sizes = by_id(mixing.mixed_sizes(docs))
    copies = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert {i: r["copies"] for i, r in sizes.items() if r["copies"]} == dict(copies)


def test_mixing_stays_in_the_jvm(docs):
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_mixing_with_many_sources_shuffles_to_the_same_rows(docs, monkeypatch):
    one = sorted(map(tuple, mixing.mixed_sizes(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, mixing.mixed_sizes(docs).collect())) == one


def test_targets_of_many_sources_are_those_of_water_filling(spark):
    sizes = [(None, 40), ("a", 0), *((f"s{i:04d}", (i * 7919) % 997) for i in range(2000)), ("z", 10_000_000)]
    found = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long").repartition(7)).collect()}
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, (s, _) in enumerate(order)}
    rest, still, want = mixing.BUDGET * sum(n for _, n in sizes), dict(sizes), {}
    while still:
        level = rest / sum(weight[s] for s in still)
        full = {s: mixing.MOST * n for s, n in still.items() if level * weight[s] > mixing.MOST * n}
        if not full:
            want |= {s: level * weight[s] for s in still}
            break
        want |= full
        rest, still = rest - sum(full.values()), {s: n for s, n in still.items() if s not in full}
    assert found.keys() == want.keys() and all(abs(found[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


# extra columns


def test_columns_of_the_caller_keep_their_names(spark):
    names = ["_text", "_doc", "_tie", "_places", "_nth", "_source", "_score", "_keys", "_hits", "_row", "label", "node", "key", "token"]
    docs = spark.createDataFrame([(i, "some words of a text " * 9 + str(i % 2), f"s{i}", *["x"] * len(names)) for i in range(4)], ", ".join(["doc_id long", "text string", "source string", *(f"{n} string" for n in names)]))
    model, lexicon = quality.fit(*_labelled(60)), toxicity.Lexicon()
    keep = tuple(docs.columns)
    for out in (media.media_columns(docs, keep=keep), quality.score_quality(docs, model, keep=keep), licenses.scan_licenses(docs, keep=keep), tokens.count_tokens(docs, keep=keep), toxicity.score_toxicity(docs, lexicon, keep=keep), suffixes.remove_repeats(docs), jaccard.one_of_each(docs), decontaminate.decontaminate(docs, _bench(spark)), mixing.mixed_documents(docs)):
        rows = out.collect()
        assert rows and all(r[n] == "x" for r in rows for n in names)
    pages = docs.withColumnRenamed("doc_id", "page_id").withColumn("url", F.lit("http://a.com/en/x"))
    for limit in (urls.MAX_BYTES, 1):
        rows = urls.judge_urls(pages, spark.createDataFrame([("b.org",)], "host string"), max_bytes=limit).collect()
        assert len(rows) == 4 and all(r[n] == "x" for r in rows for n in names) and rows[0]["verdict"] == "block"


# toxicity


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[j - 1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_and_trie_are_exact_edit_distances():
    rng = np.random.default_rng(7)
    terms = ["scumbag", "vermin", "imbecilic", "worthless", "abc", "aabbaabb", "abababab", "grumb*", "abbaabbab*"]
    trie = toxicity.Trie(terms)
    words = ["scumbg", "scumbags", "vermn", "vremin", "imbeciilc", "wortles", "abd", "abc", "hello", "scum", "wurthlass", "grumbling", "grombling", "rumbling", "xgrumbl"]
    words += ["".join(rng.choice(list("ab"), rng.integers(3, 14))) for _ in range(400)]
    for _ in range(600):
        w = list(rng.choice(terms[:4]))
        for _ in range(rng.integers(0, 4)):
            w[int(rng.integers(len(w)))] = str(rng.choice(["", "x", "ab", "e"]))
        words.append("".join(w) or "x")
    for word in words:
        near = []
        for t in terms:
            stem, k = t.rstrip("*"), toxicity.edits(len(t.rstrip("*")))
            d = min(_distance(word[:i], stem) for i in range(len(word) + 1)) if t.endswith("*") else _distance(word, stem)
            if d <= k:
                near.append((d, t.endswith("*"), t))
        assert trie.near(word) == ((min(near)[2], min(near)[0]) if near else None), word
        assert trie.may(word) or not any(toxicity.edits(len(t.rstrip("*"))) for *_, t in near), word
        stems = [t for t in terms if t.endswith("*") and word.startswith(t[:-1]) and len(word) >= len(t)]
        assert trie.exact(word) == (word if word in terms else max(stems, key=len, default=None))


def _abuse(n=60, term="scumbag"):
    texts = [f"filler word number {i} you are a worthless {term} today {i}".encode() if i % 3 == 0 else f"a calm note about gardens and number {i} of the year {i * 7}".encode() for i in range(n)]
    return texts, [int(i % 3 == 0) for i in range(n)]


def test_quotations_however_many_stay_below_abuse():
    scorer = toxicity.Scorer(toxicity.learn(*_abuse()))
    abuse, quoted, misspelt, calm = (scorer.score(t) for t in ("you scumbag", 'they wrote "scumbag" about it', "such scumbagg here", "a calm note about gardens"))
    assert abuse > toxicity.THRESHOLD > toxicity.QUOTED >= quoted > 0 and misspelt > toxicity.THRESHOLD and calm == 0 and abuse <= 1
    for text in ('he said "scumbag" and then "scumbag" again', '“worthless scumbag”, he said, “scumbag”, and "a scumbag" once more', "the word scumbag is a word"):
        assert 0 < scorer.score(text) <= toxicity.QUOTED, text
    assert scorer.score('he said "scumbag", and you are a scumbag') > toxicity.THRESHOLD
    assert toxicity.Scorer(toxicity.learn([b"a"], [0])).score("a") == 0


def test_quotations_of_any_length():
    long_ = " ".join(["filler"] * 3000)
    scorer = toxicity.Scorer(toxicity.learn(*_abuse()))
    for n in ("x", long_):
        assert 0 < scorer.score(f'a letter "{n} you scumbag {n}" of old') <= toxicity.QUOTED
        assert scorer.score(f'a letter "{n}" you scumbag {n} "of old"') > toxicity.THRESHOLD
    plain = re.compile(rf"(?<!\w)[{toxicity._OPENING}](?=\w)[^\"“”„«»\n]*?(?<=[\w.,;:!?…])[{toxicity._CLOSING}](?!\w)")
    rng = np.random.default_rng(4)
    for _ in range(400):
        text = "".join(rng.choice(list("ab '\"“”„«»’\n. ,"), rng.integers(0, 60)))
        assert toxicity.quotations(text) == [m.span() for m in plain.finditer(text)]
    assert len(toxicity.quotations("'word " * 200_000)) == 0


def test_stems_that_only_tell_when_repeated():
    texts, labels = [], []
    for i in range(80):
        often = i % 4 == 0
        texts.append(f"plain talk {i} ".encode() + (f"grumbela{i} then grumbelo{i} and grumbelu{i}" if often else f"about grumbelx{i}").encode())
        labels.append(int(often))
    scorer = toxicity.Scorer(toxicity.learn(texts, labels))
    assert scorer.score("some grumbelq and grumbelw or grumbelz") > toxicity.THRESHOLD > scorer.score("one grumbelq alone")


def test_misspellings_of_rare_terms_count():
    # Forty terms, each in 2.5 % of the toxic rows; near the last one stand ordinary words.
    rng = np.random.default_rng(5)
    terms = ["".join(rng.choice(list("abcdefghijklmnop"), 8)) for _ in range(39)] + ["quixzotu"]
    texts = [f"calm note {i} {terms[i % 40]}".encode() for i in range(320)] + [f"calm note {i} quixzot{'abcdefgh'[i % 8]}".encode() for i in range(320)]
    scorer = toxicity.Scorer(toxicity.learn(texts, [1] * 320 + [0] * 320))
    assert all(scorer.weight(t) > 0.7 for t in terms[:39])
    assert all(scorer.weight("z" + t[1:]) > 0.6 for t in terms[:39])
    assert scorer.weight("quixzoty") < 0.5 and scorer.weight("quixzota") == 0


def test_without_the_automaton_misspelt_abuse_is_missed():
    lexicon = toxicity.learn(*_abuse(90, "imbecilic"))
    spoilt = [f"note {i}: what an {w} one" for i, w in enumerate(("imbecillic", "imbecilik", "imbecelic", "imbbecilic", "mbecilic", "imbexilix", "wrothles", "worthles", "worthlesss"))]
    on, off = toxicity.Scorer(lexicon), toxicity.Scorer(lexicon, automaton=False)
    assert sum(on.score(t) >= toxicity.THRESHOLD for t in spoilt) >= 8 and not any(off.score(t) for t in spoilt)


def test_scores_are_those_of_a_plain_version(spark):
    lexicon = toxicity.learn(*_abuse())
    texts = ["you scumbag", "worthles scumbagg " * 3, 'they call it "scumbag" there', "calm", None, "x " * 900 + "scumbag " + "y " * 900 + "worthless"]
    rows = by_id(toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon, with_hits=True))
    for i, t in enumerate(texts):
        left, best = 1.0, {}
        for h in rows[i]["hits"]:
            word = (t or "").lower()[h["at"] :].split()[0].strip('"')
            term = h["term"].rstrip("*")
            assert word == h["word"] and _distance(word, term) <= toxicity.edits(len(term))
            best[h["term"], h["quoted"]] = max(best.get((h["term"], h["quoted"]), 0), h["weight"])
        for (_, quoted), w in best.items():
            left *= 1 if quoted else 1 - min(w, 0.999)
        assert rows[i]["score"] == pytest.approx(max([1 - left, *(w for (_, q), w in best.items() if q)]))
    assert rows[0]["score"] > 0.7 and rows[2]["score"] <= 0.5 and rows[3]["score"] == rows[4]["score"] == 0 and len(rows[5]["hits"]) == 2


def test_toxicity_of_odd_texts(docs, empty):
    lexicon = toxicity.Lexicon(terms={"vermin": (0.9, 0.9, 0.9)})
    found = by_id(toxicity.score_toxicity(docs, lexicon))
    assert found[0]["score"] == 0 and len(found) == docs.count()
    assert toxicity.score_toxicity(empty, lexicon).count() == 0
