"""Edits of the tree against versions that take one edit after another; flags and filing by rounds on small fixtures."""

import random

import pytest

from silexa.operators import changes as D
from silexa.operators import topics as E
from silexa.operators.refile import refile

TREE = "topic_id string, parent_id string, status string"


def below(parents, topic, target):
    """Whether a walk up from the target meets the topic or goes round."""
    at, seen = target, set()
    while at is not None:
        if at == topic or at in seen:
            return True
        seen.add(at)
        at = parents.get(at)
    return False


def case(seed):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(6)]
    parents = {n: (names[rng.randrange(i)] if i and rng.random() < 0.85 else None) for i, n in enumerate(names)}
    ops = [(i, rng.choice([*names, "gone"]), rng.choice([*names, *names, "nowhere", None])) for i in range(6)]
    return parents, ops


@pytest.mark.parametrize("seed", [4])
def test_moves_are_judged_one_after_another(spark, seed):
    parents, ops = case(seed)
    parents |= {"x": "y", "y": "x"}
    ops += [(90, "t1", "x"), (91, "t2", None)]
    table = spark.createDataFrame([(k, v, "active") for k, v in parents.items()], TREE)
    told = {}
    for pos, topic, to in ops:
        if topic not in parents:
            told[pos] = "unknown topic"
        elif to is None:
            told[pos], parents[topic] = "moved", None
        elif to == topic:
            told[pos] = "self"
        elif to not in parents:
            told[pos] = "unknown parent"
        elif below(parents, topic, to):
            told[pos] = "cycle"
        else:
            told[pos], parents[topic] = "moved", to
    assert {"moved", "cycle"} <= set(told.values())
    tree, outcomes = E.reparented(table, spark.createDataFrame(ops, "pos long, topic_id string, new_parent_id string"))
    assert {r["pos"]: r["outcome"] for r in outcomes.collect()} == told
    assert {r["topic_id"]: r["parent_id"] for r in tree.collect()} == parents


@pytest.mark.parametrize("seed", [11])
def test_merges_follow_chains_one_after_another(spark, seed):
    parents, ops = case(seed)
    filings = {(n, f"t{k}"): n * 10 + k for n in range(4) for k in range(n, 6, 2)}
    table = spark.createDataFrame([(k, v, "active") for k, v in parents.items()], TREE)
    rows = spark.createDataFrame([(c, t, at) for (c, t), at in filings.items()], "claim_id long, topic_id string, filed_at long")
    gone, told = {}, {}

    def end(t):
        while t in gone:
            t = gone[t]
        return t

    for pos, topic, to in ops:
        to = end(to)
        if topic not in parents:
            told[pos] = "unknown topic"
        elif topic in gone:
            told[pos] = "merged already"
        elif to not in parents:
            told[pos] = "unknown target"
        elif to == topic:
            told[pos] = "self"
        elif below(parents, topic, to):
            told[pos] = "below"
        else:
            told[pos], gone[topic] = "merged", to
            parents = {k: to if v == topic else v for k, v in parents.items()}
    assert "merged" in told.values()
    final = {}
    for (c, t), at in filings.items():
        final[c, end(t)] = min(final.get((c, end(t)), (True, 999)), (t in gone, at))
    tree, kept, outcomes = E.merged_topics(table, rows, spark.createDataFrame(ops, "pos long, topic_id string, target_id string"))
    want = sorted(((t, end(t) if told[p] == "merged" else to, told[p]) for p, t, to in ops), key=str)
    assert sorted((tuple(r) for r in outcomes.select("topic_id", "target_id", "outcome").collect()), key=str) == want
    assert {r["topic_id"]: (r["parent_id"], r["status"]) for r in tree.collect()} == {k: (v, "merged" if k in gone else "active") for k, v in parents.items()}
    assert {(r["claim_id"], r["topic_id"]): r["filed_at"] for r in kept.collect()} == {k: v[1] for k, v in final.items()}


def test_no_edits_and_descriptions(spark):
    table = spark.createDataFrame([("a", None, "active", "old"), ("b", "a", "active", "kept")], f"{TREE}, description string")
    none = spark.createDataFrame([], "pos long, topic_id string, new_parent_id string")
    tree, outcomes = E.reparented(table, none)
    assert tree.columns == table.columns and sorted(tree.collect()) == sorted(table.collect()) and outcomes.isEmpty()
    filings = spark.createDataFrame([(1, "a", 5)], "claim_id long, topic_id string, filed_at long")
    _, kept, told = E.merged_topics(table, filings, none.withColumnRenamed("new_parent_id", "target_id"))
    assert [tuple(r) for r in kept.collect()] == [(1, "a", 5)] and told.isEmpty()
    new = spark.createDataFrame([("a", None), ("z", "nobody")], "topic_id string, description string")
    assert {r["topic_id"]: r["description"] for r in E.described(table, new).collect()} == {"a": None, "b": "kept"}


def test_flags_are_resolved_by_known_verbs(spark):
    flags = spark.createDataFrame([("f1", None, 1), ("f2", "approved", 2), ("f3", None, 3)], "flag_id string, resolution string, n int")
    asks = spark.createDataFrame([(1, "f1", "edited"), (2, "f1", "split"), (3, "f2", "fine"), (4, "f9", "edited"), (5, None, "edited"), (6, "", "split"), (7, "f2", None)], "pos long, flag_id string, resolution string")
    out, answers = D.resolved(flags, asks)
    assert {r["flag_id"]: r["resolution"] for r in out.collect()} == {"f1": "split", "f2": "approved", "f3": None}
    assert {r["pos"]: r["answer"] for r in answers.collect()} == {1: 200, 2: 200, 3: 400, 4: 404, 5: 400, 6: 400, 7: 400}


def test_filing_grows_the_tree_and_stops_when_nothing_moves(spark):
    topics = spark.createDataFrame([("r", "Root", None, "active"), ("o", "Old", None, "archived")], "topic_id string, name string, parent_id string, status string")
    tags = [(1, "root", None, 1), (2, "A", "Root", 1), (3, "B", "a", 1), (4, "lost", "nowhere", 1), (5, "old", "x", 1), (6, None, None, 1), (3, "B", "a", 1)]
    filed, grown, history = refile(spark.createDataFrame(tags, "claim_id long, tag string, parent string, pos int"), topics)
    assert sorted((r["claim_id"], r["round"]) for r in filed.collect()) == [(1, 1), (2, 1), (3, 2)]
    names = {r["topic_id"]: r for r in grown.collect()}
    assert len(names) == 3 and {r["name"] for r in names.values()} == {"Root", "A", "B"}
    assert next(names[r["parent_id"]]["name"] for r in names.values() if r["name"] == "B") == "A"
    # Three stay out; two rounds in a row that leave them end it.
    assert history == [4, 3, 3, 3]
    assert refile(spark.createDataFrame(tags[:3], "claim_id long, tag string, parent string, pos int"), topics)[2] == [1, 0]
    assert refile(spark.createDataFrame(tags, "claim_id long, tag string, parent string, pos int"), topics, rounds=1)[2] == [4]
    assert refile(spark.createDataFrame([], "claim_id long, tag string, parent string, pos int"), topics)[0].isEmpty()
