"""Judges, consolidation, sweep, second look and the stored index against versions that take one row after another."""

import random

import pytest
from pyspark.sql import functions as F

from silexa.operators import consolidation as K
from silexa.operators import index, vector
from silexa.operators.judge import RecordedJudge, ThresholdJudge, judged
from silexa.streaming import insights, windows

VECTORS = "vec_id long, embedding array<double>"
SURE = 0.8


def _rows(seed, n=70, dim=4):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]


def _like(a, b):
    norm = lambda v: sum(x * x for x in v) ** 0.5
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / (norm(a) * norm(b)), 6)


def _answers(rows, seed, low):
    """A judge's answers to most near pairs: odd verdicts, no confidence and missing ones among them."""
    rng = random.Random(seed)
    out = {}
    for i, v in rows:
        for j, w in rows:
            if i != j and _like(v, w) >= low and rng.random() < 0.97:
                out[i, j] = (rng.choice(["SAME", "SAME", "SAME", "DIFFERENT", "UNSURE", "nonsense"]), rng.choice([0.9, 0.8, 0.5, None]))
    return out


def _kind(answer):
    if answer is None:
        return "failed"
    verdict, sure = answer
    return {"SAME": "strong" if (sure or 0) >= SURE else "weak", "UNSURE": "unsure"}.get(verdict, "apart")


def _one_by_one(rows, answers, low, k):
    claims, assigned, edges = [], {}, set()
    for i, v in rows:
        near = sorted((-_like(v, w), j) for j, w in claims if _like(v, w) >= low)[:k]
        kinds = [_kind(answers.get((i, j))) for _, j in near]
        if "failed" in kinds:
            assigned[i] = (None, "pending")
        elif "strong" in kinds:
            assigned[i] = (near[kinds.index("strong")][1], "auto")
        else:
            if near:
                edges.add((min(i, near[0][1]), max(i, near[0][1]), "near_duplicate" if kinds[0] == "apart" else "review"))
            assigned[i] = (i, "seed")
            claims.append((i, v))
    return assigned, edges


def _recorded(spark, answers):
    return RecordedJudge(spark.createDataFrame([(i, j, v, c) for (i, j), (v, c) in answers.items()], "asked_id long, candidate_id long, verdict string, confidence double"))


def test_answers_are_made_safe(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (1, 4, 0.7), (1, 5, 0.6), (1, 6, 0.5)], "asked_id long, candidate_id long, similarity double")
    record = spark.createDataFrame([(1, 2, "SAME", 0.9, True), (1, 3, "odd", 0.9, True), (1, 4, "SAME", None, None), (1, 5, "UNSURE", 1.0, True), (2, 6, "SAME", 1.0, True)], "asked_id long, candidate_id long, verdict string, confidence double, enrich boolean")
    found = {r["candidate_id"]: (r["verdict"], r["kind"], r["enrich"]) for r in judged(pairs, RecordedJudge(record)).collect()}
    assert found == {2: ("SAME", "strong", True), 3: ("DIFFERENT", "apart", False), 4: ("SAME", "weak", False), 5: ("UNSURE", "unsure", False), 6: (None, "failed", False)}
    either = judged(spark.createDataFrame([(6, 2, 0.5)], pairs.schema), RecordedJudge(record, either=True)).first()
    assert either["kind"] == "strong"


@pytest.mark.parametrize(("seed", "k"), [(1, 5)])
def test_consolidation_is_that_of_one_insight_after_another(spark, seed, k):
    rows, low = _rows(seed, 40), 0.6
    answers = _answers(rows, seed, low)
    want, edges = _one_by_one(rows, answers, low, k)
    table, links = K.consolidate(spark.createDataFrame([*rows, (999, None)], VECTORS), low, _recorded(spark, answers), k=k)
    assert {r["vec_id"]: (r["claim_id"], r["matched_by"]) for r in table.collect()} == want
    assert {(r["claim_id"], r["related_claim_id"], r["kind"]) for r in links.collect()} == edges
    assert {"auto", "seed", "pending"} == {m for _, m in want.values()}


def test_copies_join_in_one_round(spark, monkeypatch):
    """A large group of equal vectors takes as many rounds as a small one."""
    calls, real = [], K.checkpointed
    monkeypatch.setattr(K, "checkpointed", lambda df: calls.append(1) or real(df))
    for n in (5, 150):
        table, _ = K.consolidate(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(n)], VECTORS), 0.8, ThresholdJudge(0.9, 0.85))
        assert table.filter("claim_id = 0").count() == n
        calls.append(0)
    assert calls.index(0) == len(calls) - calls.index(0) - 2


@pytest.mark.parametrize("cuts", [[1, 12]])
def test_any_split_into_batches_gives_the_same(spark, tmp_path, cuts):
    rows, low = _rows(7, 25), 0.6
    judge = ThresholdJudge(0.85, 0.75)
    whole, edges = K.consolidate(spark.createDataFrame(rows, VECTORS), low, judge)
    base = f"file://{tmp_path}"
    for a, b in zip([0, *cuts], [*cuts, 25], strict=True):
        spark.createDataFrame(rows[a:b], VECTORS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        # Every batch is a start of its own from the checkpoint; a further one finds nothing to do.
        for _ in range(2):
            insights.follow(spark, f"{base}/in", f"{base}/out", f"{base}/check", VECTORS, low, judge)
    plain = lambda df: sorted(map(str, df.drop("batch").collect()))
    assert plain(spark.read.parquet(f"{base}/out/assigned")) == plain(whole)
    assert plain(spark.read.parquet(f"{base}/out/edges")) == plain(edges)
    assert spark.read.parquet(f"{base}/out/claims").count() == whole.filter("matched_by = 'seed'").count() < 25


def _sweep_one_by_one(rows, answers, low, k, known):
    gone, merges, queued = set(), set(), []
    known = {frozenset(p) for p in known}
    for _, i, v in sorted((t, i, v) for i, t, v in rows):
        if i in gone:
            continue
        near = sorted((-_like(v, w), j) for j, _, w in rows if j != i and j not in gone and _like(v, w) >= low)[:k]
        kinds = [_kind(answers.get((i, j))) for _, j in near]
        if not near or "failed" in kinds:
            continue
        if "strong" in kinds:
            j = near[kinds.index("strong")][1]
            gone.add(j)
            merges.add((j, i))
        elif kinds[0] == "unsure" and frozenset((i, near[0][1])) not in known:
            known.add(frozenset((i, near[0][1])))
            queued.append((near[0][1], i))
    return merges, set(queued)


CLAIMS = "claim_id long, created_at long, embedding array<double>"


@pytest.mark.parametrize("seed", [3])
def test_sweep_is_that_of_one_claim_after_another_resumed_or_not(spark, seed):
    rng, low = random.Random(seed), 0.8
    rows = [(i, rng.randrange(9), v) for i, v in _rows(seed, 26)]
    answers = _answers([(i, v) for i, _, v in rows], seed, low)
    known = [p for p in answers if rng.random() < 0.1]
    want, queued = _sweep_one_by_one(rows, answers, low, 5, known)
    judge, reviews = _recorded(spark, answers), spark.createDataFrame(known, "claim_id long, candidate_id long")
    claims = spark.createDataFrame(rows, CLAIMS)
    merges, new, cursor = K.sweep(claims, low, judge, reviews)
    pairs = lambda df: {tuple(r)[:2] for r in df.collect()}
    assert (pairs(merges), pairs(new)) == (want, queued) and len(want) > 2
    assert cursor == max((t, i) for i, t, _ in rows)
    # In ticks of 13 claims, each on what the ones before have left.
    done, seen, after = set(), set(known), None
    while True:
        left = spark.createDataFrame([r for r in rows if r[0] not in {a for a, _ in done}], CLAIMS)
        merges, new, at = K.sweep(left, low, judge, spark.createDataFrame(list(seen), "claim_id long, candidate_id long"), after, 13)
        if at is None:
            break
        done, seen, after = done | pairs(merges), seen | pairs(new), at
    assert (done, seen - set(known)) == (want, queued)


def test_sweep_of_nothing(spark):
    merges, new, cursor = K.sweep(spark.createDataFrame([], CLAIMS), 0.5, ThresholdJudge(0.9, 0.8))
    assert merges.count() == new.count() == 0 and cursor is None


def test_second_look_is_that_of_one_review_after_another(spark):
    rng = random.Random(5)
    claims = {i: ["active", None] for i in range(60)}
    for i in (3, 7, 11):
        claims[i] = ["merged", i + 1]
    claims[20] = ["retired", None]
    for a, b in zip(range(22, 28), range(23, 29), strict=True):
        claims[a] = ["merged", b]
    reviews = [(r, rng.randrange(62), rng.randrange(60), 0.9, rng.randrange(5)) for r in range(20)] + [(60, 22, 1, 0.9, 0), (61, 24, 1, None, 0), (62, 3, 4, 0.9, 1), (63, 20, 5, 0.9, 1), (64, 50, 51, 0.9, 0)]
    answers = {(a, b): (rng.choice(["SAME", "DIFFERENT", "UNSURE", "odd"]), rng.choice([0.9, 0.6])) for a in range(60) for b in range(60) if (a, b) != (50, 51)}

    def end(i):
        for _ in range(5):
            if i not in state:
                return None
            if state[i][1] is None:
                return i if state[i][0] == "active" else None
            i = state[i][1]
        return None

    state, want, links, merges = {k: list(v) for k, v in claims.items()}, {}, set(), set()
    for r, a, b, _, _ in sorted(reviews, key=lambda x: (x[4], x[0])):
        a, b = end(a), end(b)
        if a is None or b is None:
            want[r] = "skipped"
        elif a == b:
            want[r] = "already merged"
        else:
            kind = _kind(answers.get((a, b)))
            want[r] = {"strong": "merged", "apart": "rejected", "failed": "failed"}.get(kind, "genuine")
            if kind == "strong":
                state[a] = ["merged", b]
                merges.add((a, b))
            if kind == "apart":
                links.add((min(a, b), max(a, b)))
    table = spark.createDataFrame([(i, *v) for i, v in claims.items()], "claim_id long, status string, merged_into long")
    out, got, found = K.second_look(spark.createDataFrame(reviews, "review_id long, claim_id long, candidate_id long, similarity double, created_at long"), table, _recorded(spark, answers))
    assert {r["review_id"]: r["outcome"] for r in out.collect()} == want and set(want.values()) >= {"merged", "rejected", "genuine", "already merged", "skipped", "failed"}
    assert {tuple(r) for r in got.collect()} == merges and {tuple(r)[:2] for r in found.collect()} == links
    after = {r["claim_id"]: [r["status"], r["merged_into"]] for r in K.merged(table, got).collect()}
    assert after == state


def test_vectors_of_other_lengths_zeros_and_one_plan_for_any_number_of_queries(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0])]
    vectors = spark.createDataFrame(rows, VECTORS)
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert {(r["query_id"], r["vec_id"]) for r in vector.match(vectors, asked, -1.0, 9).collect()} == {(1, 5), (5, 1)}
    assert vector.match(vectors, asked.limit(0), -1.0, 9).count() == 0

    def nodes(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        return plan.count("\n")

    few = nodes(vector.match(vectors, asked, 0.5, 3))
    monkeypatch.setattr(vector, "BLOCK_BYTES", 16)
    assert nodes(vector.match(vectors, asked, 0.5, 3)) == few


def test_python_holds_one_block_at_a_time(spark, monkeypatch):
    """Chunks reach Python in groups of one block, so that an Arrow batch ends with it; the groups are those that the join has made, without another shuffle or sort."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    want = sorted(map(tuple, vector.match(vectors, asked, 0.2, 3).collect()))
    monkeypatch.setattr(vector, "BLOCK_BYTES", 1600)
    monkeypatch.setattr(vector, "CHUNK_BYTES", 3200)
    df = vector.match(vectors, asked, 0.2, 3)
    assert sorted(map(tuple, df.collect())) == want and len(want) > 500
    plan = [line.strip(" :+-*") for line in df._jdf.queryExecution().executedPlan().toString().split("\n")]
    grouped, joined = (next(i for i, line in enumerate(plan) if name in line) for name in ("FlatMapGroupsInArrow", "SortMergeJoin"))
    assert not any("Exchange" in line or "Sort " in line for line in plan[grouped:joined])


def test_index_finds_nine_of_ten_and_all_with_all_lists(spark, tmp_path):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in base[i % 60]]) for i in range(1200)] + [(2000, None), (2001, [0.0] * 16), (2002, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    path = f"file://{tmp_path}/index"
    index.build(vectors, path, lists=24, sample=500)
    stored = index.Index(spark, path)
    assert stored.vectors.count() == 1200 and 5 < stored.vectors.select("list").distinct().count() <= 24
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = vector.match(vectors, queries, 0.6, 8)
    few, every = stored.search(queries, 0.6, 8, 4), stored.search(queries, 0.6, 8, 24)
    assert exact.count() > 100 and index.recall(few, exact) >= 0.9 and sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    one = stored.search(queries.filter("query_id = 50"), 0.6, 8, 2)
    assert "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()


def test_recall_on_the_given_vectors(spark):
    from silexa import catalog

    folder = "/root/testdata/sf0.01"
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert index.recall(catalog.QUERIES["vec_07_approximate"](spark, folder), vector.match(vectors, queries, 0.2, 10)) >= 0.9


def test_late_events_are_left_out(spark, tmp_path):
    base, schema = f"file://{tmp_path}", "at timestamp, kind string"
    at = lambda h, m: F.lit(f"2024-01-01 {h:02}:{m:02}:00").cast("timestamp")
    for times in ([(1, 5), (1, 50)], [(3, 0)], [(2, 55), (1, 59)], [(9, 0)]):
        one = None
        for h, m in times:
            row = spark.range(1).select(at(h, m).alias("at"), F.lit("x").alias("kind"))
            one = row if one is None else one.union(row)
        one.coalesce(1).write.mode("append").parquet(f"{base}/in")
        windows.follow(spark, f"{base}/in", f"{base}/out", f"{base}/check", schema, windows.per_window("at", "kind", "1 hour", late="30 minutes"))
    found = windows.latest(spark.read.parquet(f"{base}/out"), "kind").orderBy("start").collect()
    # The event of 2:55 is late but in time; the one of 1:59 comes when its window is closed.
    assert [(r["start"].hour, r["n"]) for r in found] == [(1, 2), (2, 1), (3, 1), (9, 1)]


@pytest.mark.parametrize("first", [7])
def test_consolidation_in_batches_is_that_at_once(spark, monkeypatch, first):
    """Pairs at hand are those of a batch and the nearest claims, with failed answers as well."""
    rows, low = _rows(5, 30), 0.6
    answers = _answers(rows, 5, low)
    want, edges = _one_by_one(rows, answers, low, 5)
    monkeypatch.setattr(K, "FIRST_BATCH", first)
    monkeypatch.setattr(K, "BATCH_PAIRS", 30)
    table, links = K.consolidate(spark.createDataFrame(rows, VECTORS), low, _recorded(spark, answers))
    assert {r["vec_id"]: (r["claim_id"], r["matched_by"]) for r in table.collect()} == want
    assert {(r["claim_id"], r["related_claim_id"], r["kind"]) for r in links.collect()} == edges


def test_a_sweep_waits_for_claims_alone_that_may_take_what_it_sees(spark, monkeypatch):
    """Peers that nobody is sure about hold nobody up: all of these settle in one round, which writes four tables."""
    calls, real = [], K.stored
    monkeypatch.setattr(K, "stored", lambda df: calls.append(1) or real(df))
    claims = spark.createDataFrame([(i, 0, [1.0, 0.01 * i]) for i in range(12)], CLAIMS)
    merges, reviews, _ = K.sweep(claims, 0.5, ThresholdJudge(1.1, 0.6))
    assert merges.count() == 0 and reviews.count() > 0 and len(calls) == 4


def test_a_sweep_holds_the_lists_of_one_batch_and_not_all_pairs(spark, monkeypatch):
    """Claims that are all alike, some of them equal, in batches that lists which may run out end early: no table written is larger than the lists of a batch."""
    rng, low = random.Random(11), 0.5
    rows = [(i, rng.randrange(9), [1.0, 0.2, 0.1] if i % 4 == 0 else [1.0, rng.gauss(0, 0.3), rng.gauss(0, 0.3)]) for i in range(30)]
    answers = _answers([(i, v) for i, _, v in rows], 11, low)
    assert len(answers) > 750
    want = _sweep_one_by_one(rows, answers, low, 2, [])
    sizes, batches = [], []
    for name in ("laid", "stored", "checkpointed"):
        real = getattr(K, name, None)
        monkeypatch.setattr(K, name, lambda df, *a, real=real: sizes.append((out := real(df, *a)).count()) or out, raising=False)
    if real := getattr(K, "_sweep_batch", None):
        monkeypatch.setattr(K, "_sweep_batch", lambda live, at, high, *a: batches.append((at, high, (out := real(live, at, high, *a))[2])) or out)
    monkeypatch.setattr(K, "PEERS", 4, raising=False)
    monkeypatch.setattr(K, "BATCH_ROWS", 64, raising=False)
    merges, queued, _ = K.sweep(spark.createDataFrame(rows, CLAIMS), low, _recorded(spark, answers), k=2)
    pairs = lambda df: {tuple(r)[:2] for r in df.collect()}
    assert (pairs(merges), pairs(queued)) == want and len(want[0]) > 2
    assert max(sizes) <= 64 and len(batches) > 2 and any(upto < high for _, high, upto in batches)
