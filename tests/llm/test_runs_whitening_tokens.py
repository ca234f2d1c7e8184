"""Periodic runs, whitening and token files against plain versions, and their defined cases."""

import hashlib
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silexa.llm import runs, tokenfiles, whitening


@pytest.fixture(scope="module")
def rows():
    return brute.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.DOCUMENTS).repartition(3).persist()


def pairs(found):
    return sorted(map(tuple, found.tolist()))


# runs


def test_plain_runs_of_known_words():
    ids = lambda text: np.array([ord(c) for c in text], dtype=np.int32)
    assert pairs(runs.plain_runs(ids("x" + "ab" * 6 + "a"))) == [(1, 13, 2)]
    assert pairs(runs.plain_runs(ids("ab" * 5))) == []
    assert pairs(runs.plain_runs(ids("abcdef" * 2))) == [(0, 12, 6)]
    assert pairs(runs.plain_runs(ids("a" * 12))) == [(0, 12, 1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), max_size=4), st.sampled_from([2, 5, 12, 20]))
def test_runs_of_small_alphabets_are_those_of_all_distances(texts, least):
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    of, found = runs.find(np.array([w for t in texts for w in t], dtype=np.int32), bounds, least)
    for i, t in enumerate(texts):
        assert pairs(found[of == i]) == pairs(runs.plain_runs(np.array(t, dtype=np.int32), least))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(2, 6), st.integers(0, 40), st.integers(0, 2**32 - 1))
def test_planted_repeats_of_any_period_are_found(period, times, rest, seed):
    rng = np.random.default_rng(seed)
    ids = np.concatenate([rng.integers(0, 9, rest), np.tile(rng.integers(0, 9, period), times), rng.integers(0, 9, rest)]).astype(np.int32)
    _, found = runs.find(ids, np.array([0, len(ids)], dtype=np.int64))
    assert pairs(found) == pairs(runs.plain_runs(ids))


def test_runs_do_not_hang_on_hashes(monkeypatch):
    """Even if all range hashes are the same, the runs are right."""
    monkeypatch.setattr(runs._Equal, "_same", lambda self, a, d, n: np.ones(len(a), dtype=bool))
    ids = np.array([1, 2] * 9 + list(range(10, 40)) + [5, 6, 7] * 5, dtype=np.int32)
    assert pairs(runs.find(ids, np.array([0, len(ids)], dtype=np.int64))[1]) == pairs(runs.plain_runs(ids))


def test_texts_of_few_words_take_no_time_in_square():
    import time

    rng = np.random.default_rng(1)
    for ids in (np.zeros(60_000), np.tile([1, 2, 3], 20_000), np.tile(rng.integers(0, 99, 1000), 60), rng.random(60_000) < 0.01):
        began = time.process_time()
        _, found = runs.find(ids.astype(np.int32), np.array([0, len(ids)], dtype=np.int64))
        assert len(found) and time.process_time() - began < 20
    assert pairs(runs.find(np.zeros(60_000, dtype=np.int32), np.array([0, 60_000], dtype=np.int64))[1]) == [(0, 60_000, 1)]


def _plain_report(doc_id, text):
    words = (text or "").encode().split()
    places = runs.planted(doc_id, len(words))
    words = words if places is None else [words[i] for i in places]
    number = {}
    found = sorted(pairs(runs.plain_runs(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int32))), key=lambda r: (r[0], r[2]))
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], digest(lines.encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in dropped))


def test_report_is_that_of_a_plain_version(spark):
    texts = [(i, t) for i, (_, t, *_) in enumerate(brute.documents(90))] + [(1000, "go " * 30), (1001, "a b c " * 9 + "x"), (1002, None), (1003, "\t \n"), (1003, "\t \n"), (None, "one two"), (1004, "um " * 13 + "no " + "ah oh " * 8)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("runs", F.lit(7)).repartition(3)
    found = runs.run_report(runs.find_runs(df, rewrite=runs.planted))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(((i, *_plain_report(i, t)) for i, t in texts), key=key)
    assert sum(runs.planted(i, 40) is not None for i in range(300)) > 15


def test_runs_keep_columns_and_empty_tables(spark, docs):
    out = runs.find_runs(docs.withColumn("n_words", F.lit("x")), keep=("doc_id", "source", "n_words"))
    assert out.columns == ["doc_id", "source", "n_words", "runs", "collapsed"] and out.count() == docs.count()
    assert runs.run_report(runs.find_runs(docs.limit(0), rewrite=runs.planted)).count() == 0


def test_a_long_text_of_runs(spark):
    text = " ".join(f"w{i % 700}" for i in range(400_000)) + " end"
    row = runs.run_report(runs.find_runs(spark.createDataFrame([(3, text)], "doc_id long, text string"))).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 0, 400_000, 700)


# whitening

VECTORS = "vec_id long, embedding array<float>, component string"


def _plain_whitening(vectors, most=8):
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1], basis[:, ::-1]
    kept = [k for k in range(min(most, len(values))) if values[k] > 1e-12 * values[0]]
    return c @ basis[:, kept] / np.sqrt(values[kept]), values[kept] / values.sum(), [int(d) for d in ((n * x - sums) ** 2).sum(axis=1)]


@pytest.mark.parametrize(("n", "dim", "tasks"), [(700, 12, 11), (40, 5, 9), (3, 10, 2)])
def test_whitening_is_that_of_eigenvectors(spark, n, dim, tasks):
    rng = np.random.default_rng(n)
    vectors = (rng.normal(size=(n, dim)) * np.arange(1, dim + 1) + 3).tolist()
    found = whitening.whitened(spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], VECTORS).repartition(tasks)).collect()
    want, shares, deviations = _plain_whitening(vectors)
    got = np.full(want.shape, np.nan)
    for r in found:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviations[r["vec_id"]] and abs(r["explained"] / shares[r["component"] - 1] - 1) < 1e-6 and r["identity_error"] < 1e-9
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-9


def test_merges_of_states_lose_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(-(10**6), 10**6, (500, 7)) + rng.integers(0, 10**9, 7)
    whole, parts = whitening.of_rows(x), [whitening.of_rows(p) for p in np.split(x, [1, 4, 90, 400])]
    one = parts[0]
    for p in parts[1:]:
        one = whitening.merged(one, p)
    assert (one.n, one.sums) == (whole.n, whole.sums) and np.allclose(one.spread, whole.spread, rtol=1e-11)
    assert np.allclose(np.abs((one.vectors * whole.vectors).sum(axis=1)), 1, atol=1e-9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, 0.0], [0.0, 1.0], [0.0, 1.0]]
    odd = [None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [-inf, 1.0], [1e30, 1.0], [1.0, 2.0, 3.0], [4.0]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(good + odd)] + [(None, [3.0, 3.0], "x")], VECTORS)
    found = whitening.whitened(df).collect()
    assert sorted({(r["vec_id"] is None, r["vec_id"] or 0) for r in found}) == [(False, 0), (False, 1), (False, 2), (False, 3), (True, 0)]
    assert {r["component"] for r in found} == {1, 2} and {r["n"] for r in found} == {5}
    for none in (df.limit(0), df.filter("vec_id > 3"), df.filter("vec_id IN (2, 3)"), df.filter("vec_id = 0")):
        few = whitening.whitened(none.filter("size(embedding) <> 3 AND size(embedding) <> 1"))
        assert few.count() == 0 and few.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_great_entries_are_exact_and_what_is_no_long_is_null(spark):
    vectors = [[float(1 << 22), 1.0], [0.0, 5.0], [float(1 << 22), 9.0]]
    found = {r["vec_id"]: r["deviation"] for r in whitening.whitened(spark.createDataFrame([(i, v, "") for i, v in enumerate(vectors)], VECTORS)).collect()}
    x = [[int(1024 * c) + 100_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    assert max(want) > 1 << 63 and found == {i: w if w < 1 << 63 else None for i, w in enumerate(want)}


# token files


def _plain_tokens(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenfiles.default_file())
    return [[*e.ids, 2] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = [None, "", " \n\t", "Don't STOP 3.14 it's", "<|endoftext|> a<|startoftext|>b", "ΟΔΟΣ Σ ΑΣ. İstanbul", "é ́x   a b\u0085c \x1c d\x0be", "日本語 テキスト 👩‍👩‍👧 ﬁ", "퟿\u0000​", "x" * 5000, "ab" * 40 + "'ll'd"]


def test_ids_by_words_are_those_of_whole_texts():
    definition = open(tokenfiles.default_file()).read()
    texts = [*ODD, *(t for _, t, *_ in brute.documents())]
    words = tokenfiles.Words(definition)
    for _ in range(2):
        ids, sizes = tokenfiles.encoded(definition, [(t or "").encode() for t in texts], words)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == _plain_tokens(texts)
    whole, _ = tokenfiles.encoded(definition, [(t or "").encode() for t in texts], None)
    assert (whole == ids).all()


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_ids_of_any_text_by_words(text):
    definition = _DEFINITION
    ids, _ = tokenfiles.encoded(definition, [text.encode()], _WORDS)
    assert ids.tolist() == _plain_tokens([text])[0]


_DEFINITION = open(tokenfiles.default_file()).read()
_WORDS = tokenfiles.Words(_DEFINITION)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzAZ09'’.,!~<|>&ßÀÞàÿ÷×µ\u0301\x7f\xa0\xad sStTrRvVlLmMdDeE"), max_size=12), max_size=12))
def test_ids_of_plain_and_other_words(words):
    text = " ".join(words)
    ids, _ = tokenfiles.encoded(_DEFINITION, [text.encode()], _WORDS)
    assert ids.tolist() == _plain_tokens([text])[0]


def test_plain_words_reach_the_model_as_distinct_pieces(monkeypatch):
    words, sent = tokenfiles.Words(_DEFINITION), []
    monkeypatch.setattr(words, "tokenizer", None)
    model = words.plain.tokenizer
    monkeypatch.setattr(words.plain, "tokenizer", type("Model", (), {"encode_batch_fast": lambda _, x, **k: [sent.extend(x), model.encode_batch_fast(x, **k)][1]})())
    texts = ["Garçon, garçon! GARÇON's", "(garçon)\tit's \n It'S 'sa ''s"]
    ids, sizes = tokenfiles.encoded(_DEFINITION, [t.encode() for t in texts], words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == _plain_tokens(texts)
    pieces = " ".join(sent).split()
    assert len(pieces) == len(set(pieces)) == 10


def test_long_texts_and_other_tokenizers(monkeypatch):
    import json

    monkeypatch.setattr(tokenfiles, "CHUNK_BYTES", 50)
    monkeypatch.setattr(tokenfiles.spans_of, "__defaults__", (40,))
    texts = ["", *(" ".join(t or "" for t in ODD) for _ in range(3)), None, "a " * 500, "x" * 300 + " y"]
    ids, sizes = tokenfiles.encoded(_DEFINITION, [(t or "").encode() for t in texts], tokenfiles.Words(_DEFINITION))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == _plain_tokens(texts)
    assert tokenfiles.encoded(_DEFINITION, [], tokenfiles.Words(_DEFINITION))[0].tolist() == []
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "WhitespaceSplit"}}):
        other = json.dumps(json.loads(_DEFINITION) | change)
        words = tokenfiles.Words(other)
        some = [t.encode() for t in ("Don't STOP 3.14", "é à b")]
        assert words.plain is None and (tokenfiles.encoded(other, some, words)[0] == tokenfiles.encoded(other, some, None)[0]).all()


def test_files_hold_all_ids_in_order(spark, docs, rows, tmp_path):
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(i + 10_000, t) for i, t in enumerate(ODD)], "doc_id long, text string")).withColumn("part", F.lit("x")).withColumn("ids", F.lit(1))
    path = f"file://{tmp_path}/tokens"
    tokenfiles.write_tokens(more, path, files=5)
    files = tokenfiles.read_tokens(spark, path)
    found = {r["doc_id"]: r for r in tokenfiles.token_report(tokenfiles.token_digests(files)).collect()}
    kept = {r["doc_id"]: list(r["ids"]) for r in files.collect()}
    texts = sorted([(i, t) for i, t, *_ in rows] + [(i + 10_000, t) for i, t in enumerate(ODD)])
    at = 0
    for (i, _), ids in zip(texts, _plain_tokens([t for _, t in texts]), strict=True):
        assert kept[i] == ids
        assert tuple(found[i])[1:] == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_nulls_ties_and_empty_tables(spark, tmp_path):
    same = [(5, "a b"), (5, "a b"), (5, "c"), (None, "null first"), (None, None)]
    df = spark.createDataFrame(same, "doc_id long, text string").repartition(3)
    tokenfiles.write_tokens(df, f"file://{tmp_path}/a", files=4)
    found = sorted(map(tuple, tokenfiles.token_report(tokenfiles.token_digests(tokenfiles.read_tokens(spark, f"file://{tmp_path}/a"))).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, None, 5, 5, 5]
    assert [r[1] for r in found] == np.concatenate([[0], np.cumsum([r[2] for r in found])[:-1]]).tolist()
    tokenfiles.write_tokens(df.limit(0), f"file://{tmp_path}/b")
    assert tokenfiles.token_report(tokenfiles.token_digests(tokenfiles.read_tokens(spark, f"file://{tmp_path}/b"))).count() == 0


def test_lookups_skip_row_groups_and_files_are_cut_by_stripes(spark, tmp_path, monkeypatch):
    import pyarrow.orc as orc

    monkeypatch.setattr(tokenfiles, "STRIPE_BYTES", 1 << 16)
    rng = np.random.default_rng(3)
    texts = [(int(i) * 3, " ".join(map(str, rng.integers(0, 99_999, 60)))) for i in range(9000)]
    path = f"{tmp_path}/tokens"
    tokenfiles.write_tokens(spark.createDataFrame(texts, "doc_id long, text string"), f"file://{path}", files=1)
    (file,) = [f for f in tmp_path.glob("tokens/*.orc")]
    read = orc.ORCFile(str(file))
    assert read.nstripes > 1 and read.row_index_stride == tokenfiles.INDEX_ROWS

    def scanned(df):
        df.foreach(lambda r: None)
        node = df._jdf.queryExecution().executedPlan()
        while node.children().size():
            node = node.children().head()
        return node.metrics().apply("numOutputRows").value()

    for df, most in ((tokenfiles.read_tokens(spark, f"file://{path}", ids=[8997]), 2000), (tokenfiles.read_tokens(spark, f"file://{path}", low=26_000), 3000)):
        assert df.count() and 0 < scanned(df) < most
    # An id between its neighbours, which only the Bloom filter rules out.
    assert scanned(tokenfiles.read_tokens(spark, f"file://{path}", ids=[8998])) == 0
    monkeypatch.setattr(tokenfiles, "STRIPE_BYTES", 16 << 20)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 17))
    try:
        assert tokenfiles.read_tokens(spark, f"file://{path}").rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
