"""N-gram Jaccard join with adaptive multi-match prefixes.

Every text becomes its set of word shingles (see ``shingles``); texts with the same set are one node. Shingles are ordered rare first (by a
table of frequent shingles, then by hash). For a set of n shingles at least ``ceil(t n)`` must be shared, so any linked pair shares at least L of the first
n - ceil(t n) + L shingles on both sides. Each set chooses its own L from 1 to ``MOST``: the one with the least estimated candidate cost (occurrences on the longer
prefix, and candidates left when L of them must agree). A pair is verified only if it shares min(L, L') prefix shingles
at places that leave room for enough others behind them.

Steps, all on Spark: (1) one pass for nodes and the frequent shingles, (2) one pass that sends prefixes to their shingle and keeps those met twice,
(3) per shingle every set is verified against one hub (the most typical set), and links are contracted to components, (4) each set that may link
with a set of another component is verified against that component's sets of fitting size, in blocks, (5) components of all links. Large groups of near copies collapse in step 3 without
their pairs ever being written out; step 4 leaves no pair across components untested, so no link between components is lost.

Step 4 finds its pairs by the first shingle that they share: all others stand behind it on both sides, so a set of n shingles that has it at
place p can only link with sets of at most ((1 + t) (n - p) - t n) / t shingles. Sets meet by shingle and class of size; sets that a common passage
joins, but no room for enough shared shingles, never meet. Of the pairs that do, those that share too few prefix shingles are dropped.

Shingles in 1024 texts or more are dealt out to ``SALTS`` tasks; where a set or a label stands for very many documents, joins by it are
left to adaptive execution, which splits the documents' side.

Equality of shingles and sets is that of 64-bit hashes (128 bits for sets inside an id).

Defined cases: a null text or one without words has an empty set, is linked with nothing and is its own component; a row with a null
doc_id takes no part and has a null component; rows that share a doc_id are rows of one document id, each with its own set and component; repeated rows get
equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fresh, materialise, mix, partitions, scratch
from .graph import components
from .shingles import shingle_sets

PERCENT = 75
SIZE = 5
MOST = 4
#: Weight of verifying a candidate against reading one occurrence, in the cost estimate.
VERIFY = 8.0
#: The table of frequent shingles has at most so many rows; it decides the order of shingles, never the result.
FREQUENT_ROWS = 500_000
FREQUENT = 8
#: Shingles whose frequency is 2 to this power or more are dealt out to ``SALTS`` tasks.
SALT_LEVEL, SALTS = 10, 64
BLOCK = 256
#: Bytes of text that a kernel hashes at once; its arrays take about fifty times as much, and a worker process keeps the powers of that many places.
CHUNK = 1 << 19
#: The filter of needed documents has ten bits a document, and this many at most; with more documents all texts take part in the join.
BLOOM_BITS = 1 << 28
#: Ids that are dropped travel to the documents while they take so many bytes at most; beyond, both sides are shuffled.
BROADCAST_BYTES = 64 << 20


def _need(n: np.ndarray | int) -> np.ndarray | int:
    return -(-PERCENT * n // 100)


def _node(tokens: np.ndarray) -> int:
    """Id of a set: 63 bits, from two sums over the set."""
    one = mix(tokens).sum(keepdims=True, dtype=np.uint64)
    two = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True, dtype=np.uint64)
    return int(mix(one + mix(two + np.uint64(len(tokens))))[0] >> np.uint64(1))


def _texts(column: pa.Array) -> list[bytes]:
    return [x.as_py() or b"" for x in pc.cast(column, pa.binary())]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: (doc_id, text key, node, n); of kind 1: (shingle, times met in this task's stretch) for shingles met twice."""
    gathered, size = [], 0

    def counts() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(gathered), return_counts=True)
        token, n = token[n > 1].view(np.int64), n[n > 1]
        zero = np.zeros(len(n), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(zero + 1, pa.int8()), pa.array(zero), pa.array(zero), pa.array(token), pa.array(n.astype(np.int64))], names=["kind", "doc_id", "key", "node", "n"])

    for batch in chunks(batches, "text", CHUNK):
        sets = shingle_sets(_texts(batch.column(2)), SIZE)
        nodes = [_node(s) if len(s) else -1 for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), dtype=np.int8)), batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["kind", "doc_id", "key", "node", "n"])
        gathered += sets
        size += sum(map(len, sets))
        if size > 2_000_000:
            yield counts()
            gathered, size = [], 0
    if size:
        yield counts()


def _prefixes(tokens: np.ndarray, hot: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(prefix shingles, their levels, L, how typical the set is from 0 to 63)."""
    n = len(tokens)
    own = np.zeros(n, dtype=np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        own = np.where(hot[at] == tokens, level[at], 0)
    order = np.lexsort((tokens, own))
    base = n - int(_need(n))
    length = min(base + MOST, n)
    tokens_, levels = tokens[order[:length]], own[order[:length]]
    cost = np.cumsum(np.exp2(levels))
    best, pick = None, 1
    for k in range(1, MOST + 1):
        if base + k > n:
            break
        c = cost[base + k - 1] * (1 + VERIFY / k)
        if best is None or c < best:
            best, pick = c, k
    return tokens_[: base + pick], levels[: base + pick], pick, int(63 * np.count_nonzero(own) / n)


def postings(docs: DataFrame, hot: np.ndarray, level: np.ndarray) -> DataFrame:
    """(salt, token, node, meta) of the prefix of every set, once a node in each task; meta packs place, n, least and typical."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_, level_ = shared.value
        seen: set[int] = set()
        for batch in chunks(batches, "text", CHUNK):
            out = []
            for s in shingle_sets(_texts(batch.column(0)), SIZE):
                if not len(s) or (node := _node(s)) in seen:
                    continue
                seen.add(node)
                tokens, levels, least, typical = _prefixes(s, hot_, level_)
                out.append((tokens, levels, np.full(len(tokens), node, dtype=np.int64), np.arange(len(tokens), dtype=np.int64) << 36 | (len(s) << 9 | least << 6 | typical)))
            if len(seen) > 500_000:
                seen = set()
            if out:
                tokens, levels, nodes, meta = (np.concatenate(c) for c in zip(*out, strict=True))
                salt = np.where(levels >= SALT_LEVEL, 1 + nodes % SALTS, 0).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(salt), pa.array(tokens.view(np.int64)), pa.array(nodes), pa.array(meta)], names=["salt", "token", "node", "meta"])

    return docs.select("text").mapInArrow(run, "salt byte, token long, node long, meta long")


def _met_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings in the order of token and node those whose shingle has two nodes here or is dealt out to several tasks."""
    held: tuple | None = None
    shown, names = False, ["salt", "token", "node", "meta"]
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            columns = [np.concatenate([[h], c]).astype(c.dtype) for h, c in zip(held, columns, strict=True)]
        salt, token, node, _ = columns
        same = np.zeros(len(token), dtype=bool)
        same[1:] = token[1:] == token[:-1]
        repeated = same.copy()
        repeated[1:] &= node[1:] == node[:-1]
        salt, token, node, meta = (c[~repeated] for c in columns)
        same = np.zeros(len(token), dtype=bool)
        same[1:] = token[1:] == token[:-1]
        keep = same | (salt > 0)
        keep[:-1] |= same[1:]
        # The last posting waits for its successor, unless it is out already.
        if shown:
            keep[0] = False
        shown = bool(keep[-1]) or (shown and len(token) == 1)
        held = salt[-1], token[-1], node[-1], meta[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (salt, token, node, meta)], names=names)


def _frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = described.filter("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    rows = rows.orderBy(F.col("n").desc(), "node").limit(FREQUENT_ROWS).toPandas()  # a proven bound: FREQUENT_ROWS pairs
    token = rows["node"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.log2(rows["n"].to_numpy(dtype=np.float64)).astype(np.int64)[order]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (group, block), targets before probes; gives (a, b) for each probe with its first linked target of the block."""
    group, ids, sizes, tokens, owner = None, [], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    pending: list[np.ndarray] = []
    for batch in chunks(batches, "text", CHUNK):
        sets = shingle_sets(_texts(batch.column(4)), SIZE)
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        roles, nodes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        found = []
        for key, role, node, own in zip(keys, roles, nodes, sets, strict=True):
            if key != group:
                group, ids, pending, tokens = key, [], [], np.zeros(0, dtype=np.uint64)
            if role == 0:
                if node not in ids:
                    ids.append(node)
                    pending.append(own)
                continue
            if pending:
                sizes = np.array([len(p) for p in pending], dtype=np.int64)
                tokens = np.concatenate(pending)
                owner = np.repeat(np.arange(len(pending)), sizes)
                order = np.argsort(tokens, kind="stable")
                tokens, owner, pending = tokens[order], owner[order], []
            if not len(tokens):
                continue
            low, high = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            hits = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits) + np.arange(int(hits.sum()))
            both = np.bincount(owner[at], minlength=len(ids))
            linked = np.flatnonzero(100 * both >= PERCENT * (sizes + len(own) - both))
            for k in linked:
                if ids[k] != node:
                    found.append((node, ids[k]))
                    break
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _bloom(needed: DataFrame):
    """A filter over the needed document ids, sized by their number, or None where that passes the bound."""
    bits = 1 << max(12, (10 * needed.count()).bit_length())
    if bits > BLOOM_BITS:
        return None
    at = lambda c: [F.pmod(F.xxhash64(c, F.lit(i)), F.lit(bits)) for i in range(3)]
    # At most bits / 64 rows of two numbers reach the driver.
    rows = needed.select(F.explode(F.array(*at(F.col("doc_id")))).alias("p")).groupBy((F.col("p") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("mask")).toPandas()
    words = np.zeros(bits // 64, dtype=np.int64)
    words[rows["word"].to_numpy(dtype=np.int64)] = rows["mask"].to_numpy(dtype=np.int64)
    shared = needed.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf(T.BooleanType())
    def hit(a, b, c):
        own, ok = shared.value, True
        for p in (a, b, c):
            p = p.to_numpy(dtype=np.int64)
            ok &= (own[p >> 6] >> (p & 63)) & 1 == 1
        import pandas as pd

        return pd.Series(ok)

    return lambda c: hit(*at(c))


def verified(docs: DataFrame, nodes: DataFrame, tests: DataFrame, name: str) -> DataFrame:
    """Links (a, b) among ``tests`` (group, block, role, node): each probe (role 1) against all targets (role 0) of its group and block."""
    needed = materialise(tests.join(nodes, "node").select("group", "block", "role", "node", "doc_id", "key"), f"{name}-tests")
    hit = _bloom(needed.select("doc_id"))
    texts = (docs.filter(hit(F.col("doc_id"))) if hit else docs).select("doc_id", F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(needed, ["doc_id", "key"]).select("group", "block", "role", "node", "text")
    rows = rows.repartition(partitions(docs.sparkSession), "group", "block").sortWithinPartitions("group", "block", "role", "node")
    return materialise(rows.mapInArrow(_verify, "a long, b long").distinct(), f"{name}-links")


def _size_class(n: Column) -> Column:
    """Classes of sizes, eight a doubling."""
    return F.when(n < 8, n).otherwise(F.floor(F.log2(n) * 8) - 16).cast("int")


def _classes(low: Column, high: Column) -> Column:
    return F.sequence(_size_class(low), _size_class(high))


def pairs_across(met: DataFrame, label: DataFrame) -> DataFrame:
    """(group, node, n, size) of the sets that may link with a set of another component ``group`` of ``size`` sets; of two components the smaller one's
    sets ask, of equal ones those of the smaller label."""
    least_size, most_size = F.ceil(F.col("n") * PERCENT / 100), F.floor(F.col("n") * 100 / PERCENT)
    # What a set can link with when this shingle is the first one shared.
    room = F.floor(((100 + PERCENT) * (F.col("n") - F.col("place")) - PERCENT * F.col("n")) / PERCENT)
    seen = met.join(label, "node", "left").select("salt", "token", "node", "n", "least", F.coalesce("label", "node").alias("label"), least_size.cast("long").alias("from"), F.least(room, most_size).cast("long").alias("to"))
    size = label.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    # Per shingle, component and class of size: what its sets have and ask for, so that one row stands for all of them.
    lists = seen.withColumn("class", _size_class(F.col("n"))).groupBy("token", "label", "class").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("least").alias("other"), F.min(F.when(F.col("to") >= F.col("from"), F.col("from"))).alias("ask_low"), F.max(F.when(F.col("to") >= F.col("from"), F.col("to"))).alias("ask_high"))
    mixed = lists.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("token")
    lists = materialise(lists.join(mixed, "token", "left_semi").join(size, "label", "left").withColumn("members", F.coalesce("members", F.lit(1))), "lists")
    asking = seen.filter(F.col("from") <= F.col("to")).join(lists.select("token", "label", "members").distinct(), ["token", "label"])
    left = asking.select("token", "label", "members", "node", "n", "from", "to", F.explode(_classes(F.col("from"), F.col("to"))).alias("class"))
    right = lists.filter("ask_high is not null").select("token", "class", F.col("label").alias("group"), "low", "high", "ask_low", "ask_high", F.col("members").alias("size"))
    fits = (F.col("from") <= F.col("high")) & (F.col("to") >= F.col("low")) & (F.col("n") >= F.col("ask_low")) & (F.col("n") <= F.col("ask_high"))
    smaller = (F.col("members") < F.col("size")) | ((F.col("members") == F.col("size")) & (F.col("label") < F.col("group")))
    found = materialise(left.join(right, ["token", "class"]).filter((F.col("label") != F.col("group")) & fits & smaller).select("group", "node", "n", "size").distinct(), "found")
    # The prefix shingles that each pair shares; of the pair's two numbers wanted the smaller one counts.
    theirs = lists.groupBy("token", F.col("label").alias("group")).agg(F.min("other").alias("other"))
    shared = found.join(seen.select("node", "token", "least"), "node").join(theirs, ["token", "group"])
    return shared.groupBy("group", "node", "n", "size").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("least", "other")).alias("wanted")).filter("shared >= wanted").select("group", "node", "n", "size")


def _labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, n, label) of every row: the size of its set and the label of its component."""
    spark = docs.sparkSession
    source = docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    described = materialise(source.mapInArrow(_describe, "kind byte, doc_id long, key long, node long, n long"), "described")
    rows = described.filter("kind = 0").select("doc_id", "key", "node", "n")
    nodes = rows.filter("node >= 0 and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("r"), F.max("n").alias("n")).select("node", "r.doc_id", "r.key", "n")
    nodes = materialise(nodes, "nodes")
    met = postings(docs.filter("doc_id is not null"), *_frequent(described)).repartition(partitions(spark), "salt", "token").sortWithinPartitions("token", "node").mapInArrow(_met_twice, "salt byte, token long, node long, meta long")
    met = materialise(met, "met").select("salt", "token", "node", F.shiftright("meta", 36).alias("place"), F.shiftright("meta", 9).bitwiseAND((1 << 27) - 1).alias("n"), F.shiftright("meta", 6).bitwiseAND(7).alias("least"), F.col("meta").bitwiseAND(63).alias("typical"))

    hubs = met.groupBy("token").agg(F.max(F.struct("typical", "n", "node")).alias("hub"), F.count(F.lit(1)).alias("k"), F.max("salt").alias("dealt")).filter("k > 1")
    hubs = hubs.select("token", "hub", F.explode(F.when(F.col("dealt") > 0, F.sequence(F.lit(0), F.lit(SALTS))).otherwise(F.array(F.lit(0)))).alias("salt"))
    near = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * PERCENT
    star = met.join(hubs, ["salt", "token"]).filter((F.col("node") != F.col("hub.node")) & near).select(F.col("hub.node").alias("group"), "node").distinct()
    star = materialise(star, "star")
    # A hub with very many sets is copied to one block for each BLOCK * 16 of them.
    many = star.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / (BLOCK * 16)).cast("int").alias("blocks"))
    targets = many.select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("group").alias("node"))
    probes = star.join(many, "group").select("group", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), "node")
    links = verified(docs, nodes, targets.unionByName(probes), "star")

    label = materialise(components(links), "labels")
    across = pairs_across(met, label)
    tried = star.select("group", "node").union(star.select(F.col("node").alias("group"), F.col("group").alias("node")))
    # Two single sets that the hub step has compared need no second look.
    again = across.filter("size = 1").join(tried, ["group", "node"], "left_anti").unionByName(across.filter("size > 1"))
    again = materialise(again, "across")
    # Components are cut into blocks of one class of size; a set goes to the classes it can link with.
    groups = again.filter("size > 1").select("group").distinct()
    members = groups.join(label.select(F.col("label").alias("group"), "node"), "group").join(nodes.select("node", "n"), "node").withColumn("class", _size_class(F.col("n")))
    members = materialise(members, "members")
    many = members.groupBy("group", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = lambda part: (F.col("class").cast("long") * (1 << 40) + part).alias("block")
    targets = members.join(many, ["group", "class"]).select("group", block(F.pmod(F.xxhash64("node"), F.col("blocks"))), F.lit(0).alias("role"), "node")
    asked = _classes(F.ceil(F.col("n") * PERCENT / 100), F.floor(F.col("n") * 100 / PERCENT))
    probes = again.filter("size > 1").select("group", "node", F.explode(asked).alias("class")).join(many, ["group", "class"])
    probes = probes.select("group", "class", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part")).select("group", block(F.col("part")), F.lit(1).alias("role"), "node")
    single = again.filter("size = 1")
    alone = [single.select("group", F.lit(-1).cast("long").alias("block"), F.lit(r).alias("role"), F.col(c).alias("node")) for r, c in ((0, "group"), (1, "node"))]
    tests = targets.unionByName(probes).unionByName(alone[0].distinct()).unionByName(alone[1])
    more = verified(docs, nodes, tests, "across")

    final = materialise(components(links.unionByName(more)), "final")
    own = rows.join(final, "node", "left").withColumn("label", F.when((F.col("node") >= 0) & F.col("doc_id").isNotNull(), F.coalesce("label", "node")))
    return materialise(own.select("doc_id", "n", "label"), "own")


def link_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``."""
    with scratch(docs.sparkSession) as own_:
        own = own_.keep(_labelled(docs))
    least = own.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = own.join(least, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of linked documents, that of the smallest id; rows with a null id stay.

    Of rows that share an id one stays: that with the least text, by its hash, then the least of the other columns. Where few ids are dropped, the texts stay where they are.
    """
    with scratch(docs.sparkSession) as own:
        linked = link_documents(docs).filter("doc_id is not null")
        ids = linked.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("rows"))
        ids = own.keep(materialise(ids.filter("not stays or rows > 1"), "ids"))
    count = ids.agg(F.count(F.lit(1)), F.coalesce(F.max("rows"), F.lit(1))).first()
    held = lambda df: F.broadcast(df) if count[0] * 32 <= BROADCAST_BYTES else df
    out = docs.join(held(ids.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    if count[1] == 1:
        return out
    (nth,) = fresh(docs.columns, "_nth")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), *[c for c in docs.columns if c not in ("doc_id", "text")])
    several = docs.join(held(ids.filter("stays").select("doc_id")), "doc_id", "left_semi").withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1)
    return out.unionByName(several.select(*docs.columns))
