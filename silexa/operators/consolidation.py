"""Consolidation of insights into claims, the sweep of claims, and the second look at failed checks: ordered, greedy processes as rounds of joins.

Each of them settles one row after another in a fixed order. A row can be settled as soon as no earlier open row can change what it sees, so every round settles all such rows at once; the
first open row is always one of them. Results equal those of the process row by row. What rounds need is written to the checkpoint folder and no group is collected; chains
of rows that all hang on each other take a round a row. Insights are taken in batches, each against the claims of those before it, so that the pairs at hand are those of a batch. The sweep
takes claims in batches as well, each with the nearest of the peers that are left, and ends a batch before a claim whose list may run out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silexa.operators import ranks
from silexa.operators.judge import SURE, Judge, judged
from silexa.operators.tree import resolve_redirects
from silexa.operators.vector import fewer_blocks, pairs_above, ranked
from silexa.session import checkpointed, deleted, dropped, laid, released, shared_folder, stored

#: Candidates that a judge sees (fixed value).
CANDIDATES = 5
#: Insights of the first batch, and pairs within a batch that the sizes of later ones aim at.
FIRST_BATCH, BATCH_PAIRS = 4096, 4_000_000
#: Nearest peers that a claim's list has in a batch of the sweep, unless they run out, and rows of all lists of a batch.
PEERS, BATCH_ROWS = 32, 1 << 20


def _nearest(by: str, other: str) -> Window:
    return Window.partitionBy(by).orderBy(F.col("similarity").desc(), other)


def consolidate(insights: DataFrame, threshold: float, judge: Judge, claims: DataFrame | None = None, k: int = CANDIDATES, sure: float = SURE) -> tuple[DataFrame, DataFrame]:
    """(assignments, edges) of ``insights`` (vec_id, embedding) taken in the order of vec_id, after the claims that are there already (vec_id, embedding).

    An insight's candidates are the ``k`` nearest claims at ``threshold`` or above among those before it. It joins the first that the judge is sure to be the same; else it
    becomes a claim, linked to its nearest candidate: near_duplicate where the judge keeps them apart, review where it is not sure. An insight with a candidate that the judge
    did not answer for stays pending, and is no claim. Insights without a vector are left out.
    """
    rows = checkpointed(ranks.placed(insights.filter("embedding IS NOT NULL").select("vec_id", "embedding"), [F.col("vec_id")], "place"))
    n, at, size, parts = rows.count(), 0, FIRST_BATCH, []
    while at < n or not parts:
        batch = rows.filter((F.col("place") > at) & (F.col("place") <= at + size)).drop("place")
        assigned, edges, pairs = _consolidate_batch(batch, threshold, judge, claims, k, sure)
        parts.append((assigned, edges))
        at += size
        if at < n:
            new = batch.join(assigned.filter("matched_by = 'seed'").select("vec_id"), "vec_id", "left_semi")
            claims = checkpointed(new if claims is None else claims.select("vec_id", "embedding").union(new))
            # Pairs grow with the square of a batch.
            size = max(1, min(4 * size, int(size * (BATCH_PAIRS / max(pairs, 1)) ** 0.5)))
    assigned, edges = parts[0]
    for more, linked in parts[1:]:
        assigned, edges = assigned.union(more), edges.union(linked)
    return assigned, edges


def _consolidate_batch(rows: DataFrame, threshold: float, judge: Judge, claims: DataFrame | None, k: int, sure: float) -> tuple[DataFrame, DataFrame, int]:
    """(assignments, edges, pairs within the batch) of one batch after ``claims``."""
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    known = None
    if claims is not None:
        # Claims stay claims, so only the nearest k of them are ever seen, and of the batch what is nearer than the last of those.
        known = checkpointed(ranked(pairs_above(claims.select("vec_id", "embedding"), asked, threshold, k=k), k))
        last = known.filter(F.col("nth") == k).select("query_id", (F.col("similarity") - 2e-6).alias("least"))
        asked = asked.join(last, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    near = pairs_above(rows, asked, threshold).filter("vec_id < query_id").withColumn("similarity", F.round("similarity", 6))
    near = checkpointed(near.select(F.col("query_id").alias("asked_id"), F.col("vec_id").alias("candidate_id"), "similarity"))
    pairs, within = near, near.count()
    if known is not None:
        pairs = near.union(known.select(F.col("query_id").alias("asked_id"), F.col("vec_id").alias("candidate_id"), "similarity"))
    pairs = checkpointed(judged(pairs, judge, sure))
    # ``settled`` has a row for each claim, and for each insight that will never be one.
    settled = claims.select(F.col("vec_id").alias("id"), F.lit("claim").alias("role")) if claims is not None else None
    open_ = checkpointed(rows.select(F.col("vec_id").alias("id")))
    settled = checkpointed(settled) if settled is not None else open_.select("id", F.lit("claim").alias("role")).limit(0)
    edges = pairs.select("asked_id", "candidate_id", "similarity", "kind")
    before = _nearest("asked_id", "candidate_id").rowsBetween(Window.unboundedPreceding, -1)
    while not open_.isEmpty():
        seen = edges.join(settled.withColumnRenamed("id", "candidate_id"), "candidate_id", "left").filter("role IS NULL OR role = 'claim'")
        is_claim = F.coalesce(F.col("role") == "claim", F.lit(False))
        seen = seen.withColumn("claims_before", F.coalesce(F.sum(is_claim.cast("int")).over(before), F.lit(0))).withColumn("all_before", F.coalesce(F.count(F.lit(1)).over(before), F.lit(0)))
        seen = seen.filter(F.col("claims_before") < k)
        placed = is_claim & (F.col("all_before") < k)
        any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
        state = seen.groupBy("asked_id").agg(any_((F.col("kind") == "failed") & placed).alias("fails"), any_(F.col("kind") == "failed").alias("may_fail"), any_((F.col("kind") == "strong") & placed).alias("joins"), any_(F.col("kind") == "strong").alias("may_join"))
        rows_now = open_.join(state, F.col("id") == F.col("asked_id"), "left")
        no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
        role = F.when(F.col("fails"), "pending").when(F.col("joins") & no("may_fail"), "member").when(no("may_join") & no("may_fail"), "claim")
        now = checkpointed(rows_now.select("id", role.alias("role")))
        settled = checkpointed(settled.union(now.filter("role IS NOT NULL")))
        open_ = now.filter("role IS NULL").select("id")
        edges = checkpointed(edges.join(open_.withColumnRenamed("id", "asked_id"), "asked_id", "left_semi"))
    found = pairs.join(settled.filter("role = 'claim'").select(F.col("id").alias("candidate_id")), "candidate_id", "left_semi")
    found = found.withColumn("nth", F.row_number().over(_nearest("asked_id", "candidate_id"))).filter(F.col("nth") <= k)
    first = found.groupBy("asked_id").agg(
        F.min_by(F.struct("candidate_id", "confidence", "enrich"), F.when(F.col("kind") == "strong", F.col("nth"))).alias("joined"), F.min_by(F.struct("candidate_id", "similarity", "kind"), "nth").alias("nearest")
    )
    done = checkpointed(rows.select(F.col("vec_id").alias("id")).join(settled, "id").join(first, F.col("id") == F.col("asked_id"), "left"))
    claim, member = F.col("role") == "claim", F.col("role") == "member"
    assigned = done.select(
        F.col("id").alias("vec_id"), F.when(claim, F.col("id")).when(member, F.col("joined.candidate_id")).alias("claim_id"), F.when(claim, "seed").when(member, "auto").otherwise("pending").alias("matched_by"),
        F.when(claim, F.lit(1.0)).when(member, F.col("joined.confidence")).alias("confidence"), (member & F.col("joined.enrich")).alias("enrich"),
    )
    linked = done.filter(claim & F.col("nearest").isNotNull())
    edges = linked.select(F.least("id", "nearest.candidate_id").alias("claim_id"), F.greatest("id", "nearest.candidate_id").alias("related_claim_id"), "nearest.similarity", F.when(F.col("nearest.kind") == "apart", "near_duplicate").otherwise("review").alias("kind"))
    return assigned, edges, within


def sweep(claims: DataFrame, threshold: float, judge: Judge, reviews: DataFrame | None = None, after: tuple | None = None, most: int | None = None, k: int = CANDIDATES, sure: float = SURE) -> tuple[DataFrame, DataFrame, tuple | None]:
    """(merges, reviews, cursor): one pass over active ``claims`` (claim_id, created_at, embedding), oldest first.

    A claim that has not been merged meanwhile is judged against its ``k`` nearest peers that have not either. The first that the judge is sure to be the same is merged into it, even an older one;
    if the judge is not sure about the nearest, the pair is queued, unless ``reviews`` (claim_id, candidate_id) or this pass has it in either direction. A sure DIFFERENT or a weak SAME does nothing, nor
    does a claim with an unanswered peer. ``after`` (created_at, claim_id) starts behind a claim and ``most`` ends after so many; ``cursor`` is the last one taken, None if there was none, and a
    pass goes on from it on the claims that are left.
    """
    spark = claims.sparkSession
    own = claims.select("claim_id", "created_at", "embedding", F.struct("created_at", "claim_id").alias("order"))
    todo = own.select("claim_id", "order")
    if after is not None:
        start = F.struct(F.lit(after[0]).cast(own.schema["created_at"].dataType).alias("created_at"), F.lit(after[1]).cast(own.schema["claim_id"].dataType).alias("claim_id"))
        todo = todo.filter(F.col("order") > start)
    if most is not None:
        todo = todo.orderBy("order").limit(most)
    todo = checkpointed(ranks.placed(todo, [F.col("order")], "place"))
    n, last = todo.agg(F.count(F.lit(1)), F.max("order")).first()
    folder = f"{shared_folder(spark)}/sweeps/{uuid.uuid4().hex}"
    live = laid(own.filter("embedding IS NOT NULL").join(todo.select("claim_id", "place"), "claim_id", "left").select("claim_id", "place", "embedding"), folder)
    blocks, at, least, parts = fewer_blocks(live), 0, max(PEERS, 2 * k), []
    peers = least
    while at < n:
        size = max(1, BATCH_ROWS // peers)
        new, unsure, upto = _sweep_batch(live, at, min(n, at + size), threshold, judge, peers, k, sure, blocks, f"{folder}/batch", f"{folder}/found")
        parts.append((new, unsure))
        # A list that may run out has ended the batch: fewer claims with longer lists come next.
        peers = max(least, peers // 2) if upto == min(n, at + size) else peers * 2
        at = upto
        if at < n:
            # As many at most as a batch has claims.
            left = laid(live.join(F.broadcast(new.select(F.col("loser_id").alias("claim_id"))), "claim_id", "left_anti"), folder)
            dropped(live)
            live = left
        deleted(spark, f"{folder}/batch")
        released(spark)
    dropped(live)
    merges = queued = None
    for new, unsure in parts:
        merges, queued = (new, unsure) if merges is None else (merges.union(new), queued.union(unsure))
    kind = own.schema["claim_id"].dataType.simpleString()
    if merges is None:
        return spark.createDataFrame([], f"loser_id {kind}, winner_id {kind}"), spark.createDataFrame([], f"claim_id {kind}, candidate_id {kind}, similarity double"), tuple(last) if last else None
    pair = [F.least("claim_id", "candidate_id").alias("a"), F.greatest("claim_id", "candidate_id").alias("b")]
    once = queued.groupBy(*pair).agg(F.min_by(F.struct("claim_id", "candidate_id", "similarity"), "place").alias("r"))
    if reviews is not None:
        once = once.join(reviews.select(*pair).distinct(), ["a", "b"], "left_anti")
    out = checkpointed(merges), checkpointed(once.select("r.*")), tuple(last)
    deleted(spark, folder)
    return out


def _sweep_batch(live: DataFrame, low: int, high: int, threshold: float, judge: Judge, peers: int, k: int, sure: float, blocks: int, folder: str, results: str) -> tuple[DataFrame, DataFrame, int]:
    """(merges, queued, place of the last claim taken) of the claims of ``live`` (claim_id, place, embedding) at the places from ``low`` + 1 to ``high``, or fewer, each with its ``peers`` nearest of ``live``."""
    batch = live.filter((F.col("place") > low) & (F.col("place") <= high))
    asking = batch.select(F.col("claim_id").alias("query_id"), F.col("embedding").alias("query"))
    near = laid(ranked(pairs_above(live.select(F.col("claim_id").alias("vec_id"), "embedding"), asking, threshold, k=peers, blocks=blocks), peers), folder)
    strong, failed, nearest = F.col("kind") == "strong", F.col("kind") == "failed", _nearest("asked_id", "candidate_id")
    before, kept = nearest.rowsBetween(Window.unboundedPreceding, -1), ["asked_id", "candidate_id", "similarity", "kind", "takes", "place"]
    asked = judged(near.select(F.col("query_id").alias("asked_id"), F.col("vec_id").alias("candidate_id"), "similarity"), judge, sure).select("asked_id", "candidate_id", "similarity", "kind")
    asked = asked.join(batch.select(F.col("claim_id").alias("asked_id"), "place"), "asked_id")
    full = F.count(F.lit(1)).over(Window.partitionBy("asked_id")) >= peers
    asked = laid(asked.withColumns({"full": full, "takes": strong & ~F.coalesce(F.bool_or(strong).over(before), F.lit(False))}), folder)

    def viewed(asked: DataFrame) -> DataFrame:
        """``takes``: at its turn the claim may merge this peer. A peer is safe for a claim if no open one before it may; ``may``: neither a safe peer that it would merge nor k safe ones are nearer."""
        risk = asked.filter("takes").groupBy("candidate_id").agg(F.min("place").alias("risk"))
        seen = asked.join(risk, "candidate_id", "left").withColumn("safe", F.col("risk").isNull() | (F.col("risk") >= F.col("place"))).drop("risk")
        taken, safe = F.coalesce(F.bool_or(strong & F.col("safe")).over(before), F.lit(False)), F.coalesce(F.sum(F.col("safe").cast("int")).over(before), F.lit(0))
        return seen.withColumns({"nth": F.row_number().over(nearest), "inside": safe < k, "may": strong & ~taken & (safe < k)})

    # A claim may merge its nearest peer, or one behind those that claims before it may merge: this grows until it holds for all.
    seen = laid(viewed(asked), folder)
    while not seen.filter("may AND NOT takes").isEmpty():
        more = laid(viewed(seen.withColumn("takes", F.col("takes") | F.col("may")).select(*kept, "full")), folder)
        dropped(seen)
        seen = more
    # A list without k safe peers may run out before the claim's turn; that claim and those behind it wait for the next batch.
    short = seen.filter("full").groupBy("place").agg(F.count_if("safe").alias("n")).filter(F.col("n") < k).agg(F.min("place")).first()[0]
    upto = high if short is None else short - 1
    asked = stored(seen.filter(F.col("inside") & (F.col("place") <= upto)).withColumn("takes", F.col("takes") & F.col("may")).select(*kept))
    merges, queued, rounds = None, None, []
    while not asked.isEmpty():
        seen = stored(viewed(asked).filter("inside").withColumn("takes", F.col("takes") & F.col("may")).drop("inside", "may"))
        first = F.col("nth") <= k
        state = seen.groupBy("asked_id", "place").agg(
            F.bool_or(failed).alias("may_fail"), F.bool_or(strong).alias("any_strong"), F.bool_or(failed & first).alias("failed"), F.bool_and(F.col("safe") | ~first).alias("all_safe"),
            F.min_by(F.struct("candidate_id", "nth", "safe"), F.when(strong, F.col("nth"))).alias("same"), F.min_by(F.struct("candidate_id", "similarity", "kind", "safe"), "nth").alias("nearest"),
        )
        risky = seen.filter("takes").groupBy(F.col("candidate_id").alias("asked_id")).agg(F.min("place").alias("risk"))
        merging = F.coalesce((F.col("same.nth") <= k) & F.col("same.safe"), F.lit(False))
        sure_of = F.col("all_safe") | (~F.col("may_fail") & (merging | (~F.col("any_strong") & F.col("nearest.safe"))))
        ready = stored(state.join(risky, "asked_id", "left").filter((F.col("risk").isNull() | (F.col("risk") > F.col("place"))) & sure_of))
        said = ready.filter("NOT failed").withColumn("same", F.when(F.col("same.nth") <= k, F.col("same.candidate_id")))
        new = said.filter("same IS NOT NULL").select(F.col("same").alias("loser_id"), F.col("asked_id").alias("winner_id"), "place")
        unsure = said.filter("same IS NULL AND nearest.kind = 'unsure'").select(F.col("nearest.candidate_id").alias("claim_id"), F.col("asked_id").alias("candidate_id"), "nearest.similarity", "place")
        merges, queued = (new.drop("place"), unsure) if merges is None else (merges.union(new.drop("place")), queued.union(unsure))
        # What goes is gone for the claims behind the one that takes it; those before it have seen it.
        gone = lambda c: new.select(F.col("loser_id").alias(c), F.col("place").alias(f"{c}_gone"))
        left = seen.join(ready.select("asked_id"), "asked_id", "left_anti").join(gone("asked_id"), "asked_id", "left").join(gone("candidate_id"), "candidate_id", "left")
        there = [F.col(f"{c}_gone").isNull() | (F.col(f"{c}_gone") > F.col("place")) for c in ("asked_id", "candidate_id")]
        rest = stored(left.filter(there[0] & there[1]).select(*kept))
        dropped(asked)
        dropped(seen)
        rounds.append(ready)
        asked = rest
    dropped(asked)
    if merges is None:
        kind = live.schema["claim_id"].dataType.simpleString()
        empty = live.sparkSession.createDataFrame
        return empty([], f"loser_id {kind}, winner_id {kind}"), empty([], f"claim_id {kind}, candidate_id {kind}, similarity double, place long"), upto
    out = laid(merges, results), laid(queued, results), upto
    for ready in rounds:
        dropped(ready)
    return out
def second_look(reviews: DataFrame, claims: DataFrame, judge: Judge, sure: float = SURE, hops: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, merges, links) of judging the pairs of ``reviews`` (review_id, claim_id, candidate_id, similarity, created_at) whose first check failed once more, oldest first.

    Both claims are followed to their survivors first, over ``hops`` merges at most, those of earlier rows included. A claim that is missing or not active: skipped. The same survivor: already merged, so
    accepted. A sure SAME merges the claim's survivor into the candidate's, DIFFERENT rejects and links them, anything else is a genuine review and stays pending; without an answer the row stays as it is (failed).
    """
    todo = checkpointed(reviews.select("review_id", "claim_id", "candidate_id", "similarity", F.struct("created_at", "review_id").alias("order")))
    now = checkpointed(claims.select("claim_id", "status", "merged_into"))
    out = merges = links = None
    while not todo.isEmpty():
        ends = resolve_redirects(now, hops, todo.select("claim_id").union(todo.select("candidate_id")).distinct())
        one, two = ends.select("claim_id", F.col("target_id").alias("a")), ends.select(F.col("claim_id").alias("candidate_id"), F.col("target_id").alias("b"))
        rows = todo.join(one, "claim_id", "left").join(two, "candidate_id", "left")
        # A row waits for earlier ones that touch one of its survivors, or lead to where it would go.
        touch = rows.select("review_id", "order", F.explode(F.array("a", "b", "claim_id", "candidate_id")).alias("at")).filter("at IS NOT NULL")
        first = touch.groupBy("at").agg(F.min("order").alias("first"))
        waits = touch.join(first, "at").filter(F.col("first") < F.col("order")).select("review_id").distinct()
        ready = checkpointed(rows.join(waits, "review_id", "left_anti"))
        settled = F.when(F.col("a").isNull() | F.col("b").isNull(), "skipped").when(F.col("a") == F.col("b"), "already merged")
        ready = ready.withColumn("outcome", settled)
        asked = ready.filter("outcome IS NULL").select("review_id", F.col("a").alias("asked_id"), F.col("b").alias("candidate_id"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
        answers = judged(asked.select("asked_id", "candidate_id", "similarity").distinct(), judge, sure)
        said = asked.join(answers.select("asked_id", "candidate_id", "kind"), ["asked_id", "candidate_id"]).select("review_id", "kind")
        outcome = F.coalesce("outcome", F.when(F.col("kind") == "strong", "merged").when(F.col("kind") == "apart", "rejected").when(F.col("kind") == "failed", "failed").otherwise("genuine"))
        done = checkpointed(ready.join(said, "review_id", "left").withColumn("outcome", outcome))
        part = done.select("review_id", "outcome", F.when(F.col("outcome").isin("merged", "already merged"), "accepted").when(F.col("outcome") == "rejected", "rejected").otherwise("pending").alias("status"))
        new = done.filter("outcome = 'merged'").select(F.col("a").alias("loser_id"), F.col("b").alias("winner_id"))
        apart = done.filter("outcome = 'rejected'").select(F.least("a", "b").alias("claim_id"), F.greatest("a", "b").alias("related_claim_id"), "similarity")
        out, merges, links = (part, new, apart) if out is None else (out.union(part), merges.union(new), links.union(apart))
        to = new.select(F.col("loser_id").alias("claim_id"), F.col("winner_id").alias("_to"))
        now = now.join(to, "claim_id", "left").select("claim_id", F.when(F.col("_to").isNotNull(), "merged").otherwise(F.col("status")).alias("status"), F.coalesce("_to", "merged_into").alias("merged_into"))
        now, todo = checkpointed(now), checkpointed(todo.join(done.select("review_id"), "review_id", "left_anti"))
    if out is None:
        kind, key = claims.schema["claim_id"].dataType.simpleString(), reviews.schema["review_id"].dataType.simpleString()
        spark = reviews.sparkSession
        return spark.createDataFrame([], f"review_id {key}, outcome string, status string"), spark.createDataFrame([], f"loser_id {kind}, winner_id {kind}"), spark.createDataFrame([], f"claim_id {kind}, related_claim_id {kind}, similarity double")
    return checkpointed(out), checkpointed(merges), checkpointed(links.distinct())


def merged(claims: DataFrame, merges: DataFrame) -> DataFrame:
    """``claims`` (claim_id, status, merged_into, ...) after ``merges`` (loser_id, winner_id)."""
    to = merges.select(F.col("loser_id").alias("claim_id"), F.col("winner_id").alias("_to"))
    gone: Column = F.col("_to").isNotNull()
    return claims.join(to, "claim_id", "left").withColumn("status", F.when(gone, "merged").otherwise(F.col("status"))).withColumn("merged_into", F.coalesce("_to", "merged_into")).drop("_to")
