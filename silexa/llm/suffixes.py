"""Suffix-array deduplication of byte strings across a corpus.

Every byte that lies in a string of ``LENGTH`` bytes which also starts earlier (smaller doc_id, or the same document and an earlier start) is
removed. Strings are judged on the input; they never cross documents.

The corpus is too large for one suffix array, so suffixes are dealt out by content first: each window of ``LENGTH`` bytes belongs to its
anchor, the place of the least hash among its ``GRAM``-byte pieces (leftmost of equals). Equal windows have equal anchors and meet in one task. Consecutive
windows with one anchor form a range of at most ``LENGTH - GRAM + 1`` windows, about one for each 39 bytes. Hashes only deal suffixes out; what repeats is decided on the bytes.

(1) Ranges are counted by the hash of their anchor, partly before the shuffle; those whose anchor occurs once cannot repeat. (2) The others send their bytes, each content of a stretch of
input once, to the task of their anchor, in the order of their bytes: a range that follows an equal one repeats it whole. (3) Where an anchor has several contents, their suffixes are sorted in two stages: suffixes smaller than
their successors are sorted directly, all others are induced by one scan over the buckets of first bytes. Windows with a common prefix of ``LENGTH`` or more are
adjacent then, and all but the first are marked. (4) The marks of each document are joined with its text.

An anchor with more than ``LARGE`` contents (the edge of a very common passage) is not sorted in one task: its windows are dealt out singly, by a
digest of their bytes, and met in the order of their bytes in the same way.

Defined cases: a null text is the empty text; rows with a null doc_id come last; rows that share a doc_id but not the text count as
documents in the order of a hash of the text; repeated rows are one document, so neither is earlier; an empty table gives an empty result. A task holds one text and
arrays of about a hundred times a part of ``CHUNK`` bytes of it, however long the text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, buffer_of, chunks, fresh, materialise, mix, partitions, scratch

LENGTH = 100
GRAM = 24
LARGE = 4000
#: Bytes of text that a task's kernels hold at once; their arrays take about a hundred times as much.
CHUNK = 1 << 18
BLOCK = 1 << 18
BROADCAST_BYTES = 64 << 20
LAST = (1 << 63) - 1


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document number, start, windows, anchor hash) of every range, for texts one behind the other."""
    spread = LENGTH - GRAM + 1
    n = len(data) - GRAM + 1
    if n < spread:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    rolling = RangeHash(data, salt=3)
    least = mix((rolling.sums[GRAM:] - rolling.sums[:-GRAM]) * rolling.inverse[:n])
    at = np.zeros(n, dtype=np.uint8)
    hashes, width = least, 1
    while width < spread:
        d = min(width, spread - width)
        take = least[d:] < least[:-d]
        at = np.where(take, at[d:] + np.uint8(d), at[:-d])
        least = np.minimum(least[d:], least[:-d])
        width += d
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + LENGTH <= offsets[1:][doc])
    anchor = start + at[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[start[1:]] != doc[start[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    return doc[begin], begin, count, hashes[anchor[first]]


def _rows(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64, copy=False)) for c in columns], names=names)


_NAMES = ["key", "content", "doc", "tie", "place"]
_SCHEMA = "key long, content long, doc long, tie long, place long"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, content, doc, tie, place) of the ranges; place holds the start and the number of windows, content a hash that only tells whether an anchor has many."""
    for batch in chunks(batches, "text", CHUNK):
        whole, ends = buffer_of(batch.column(2))
        docs, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        # A text longer than a chunk goes in parts that share LENGTH - 1 bytes, so that each window lies in one of them.
        step = CHUNK if len(ends) == 2 else max(len(whole), 1)
        for a in range(0, max(len(whole) - LENGTH + 1, 1), step):
            data = whole[a : a + step + LENGTH - 1]
            offsets = np.array([0, len(data)]) if len(ends) == 2 else ends
            number, begin, count, key = anchors(data, offsets)
            if len(begin):
                content = RangeHash(data, salt=7)(begin, begin + count + (LENGTH - 1))
                yield _rows(key, content, docs[number], ties[number], (begin - offsets[number] + a) << 16 | count, names=_NAMES)


def two_stage_sort(text: np.ndarray, words: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes at least (all bytes for those that are induced from distinct ones).

    ``words`` holds the 8 bytes from each place on as one number; behind the end are zeros.
    """
    n = len(text)
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    after = text[np.minimum(change + 1, n - 1)].astype(np.int16)
    rises = after > text[change]
    rises[-1] = True
    ascending = np.repeat(rises, np.diff(np.concatenate([[-1], change])))
    direct = np.flatnonzero(ascending)
    # Direct stage: by 8 bytes at a time; only groups that the next 8 bytes tell apart are sorted again.
    direct = direct[np.argsort(words[direct], kind="stable")]
    value = words[direct]
    split = np.ones(len(direct), dtype=bool)
    split[1:] = value[1:] != value[:-1]
    for skip in range(8, depth, 8):
        group = np.cumsum(split) - 1
        nxt = words[np.minimum(direct + skip, len(words) - 1)]
        torn = np.zeros(len(direct), dtype=bool)
        torn[1:] = (nxt[1:] != nxt[:-1]) & ~split[1:]
        if not torn.any():
            if split.all():
                break
            continue
        bad = np.zeros(group[-1] + 1, dtype=bool)
        bad[group[torn]] = True
        rows = np.flatnonzero(bad[group])
        order = rows[np.lexsort((nxt[rows], group[rows]))]
        direct[rows], nxt[rows] = direct[order], nxt[order]
        split[1:] |= (nxt[1:] != nxt[:-1]) & (group[1:] == group[:-1])
    # Induced stage: one scan over the buckets of first bytes, each bucket's induced suffixes before its direct ones.
    starts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        parts = waiting[c]
        front = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        row = [front] if len(front) else []
        while len(front):
            before = front[front > 0] - 1
            front = before[text[before] == c]
            if len(front):
                row.append(front)
        if starts[c + 1] > starts[c]:
            row.append(direct[starts[c] : starts[c + 1]])
        if not row:
            continue
        whole = np.concatenate(row)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cut = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for a, b in zip(cut, np.append(cut[1:], len(first)), strict=True):
                waiting[first[a]].append(before[a:b])
    return np.concatenate(out)


def repeated_windows(contents: list[bytes], counts: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """For each content the windows (of its first ``counts``) that a content of smaller ``rank``, or the same one further left, has as well."""
    joined = b"\x00".join(contents) + b"\x00"
    text = np.frombuffer(joined, dtype=np.uint8)
    padded = np.concatenate([text, np.zeros(LENGTH + 16, dtype=np.uint8)])
    words = np.zeros(len(text) + LENGTH + 8, dtype=np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(words)]
    sizes = np.array([len(c) + 1 for c in contents])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(contents)), sizes)
    inside = np.arange(len(text)) - base[owner]
    window = inside < counts[owner]
    order = two_stage_sort(text, words)
    order = order[window[order]]
    # Adjacent common prefixes: those of LENGTH or more join suffixes to groups.
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for skip in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        w = words[order + skip]
        same &= w[1:] == w[:-1]
    group = np.cumsum(np.concatenate([[0], ~same]))
    value = rank[owner[order]].astype(np.int64) * (int(counts.max()) + 1) + inside[order]
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, value)
    late = order[value > least[group]]
    out: list[list[int]] = [[] for _ in contents]
    for i in np.sort(late).tolist():
        out[owner[i]].append(i - base[owner[i]])
    return [np.array(x, dtype=np.int64) for x in out]


_PARTS = ["kind", "deal", "doc", "tie", "place", "bytes"]


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 1: marks, for what an equal content of the same stretch of input precedes. Kind 2: contents by anchor. Kind 3: single windows by digest."""
    types = [pa.int64()] * 5 + [pa.binary()]

    def rows(found: dict[tuple, list[tuple]]) -> pa.RecordBatch:
        out = []
        for (kind, deal, content), places in found.items():
            first = min(places)
            out.append((kind, deal, *first, content))
            out += [(1, hash(p), *p, None) for p in places if p != first]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=_PARTS)

    for batch in chunks(batches, "text", CHUNK):
        found: dict[tuple, list[tuple]] = {}
        size = 0
        for doc, tie, text, wants in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            raw = (text or "").encode()
            for w in wants:
                place, key = w["place"], w["key"]
                a, n = place >> 16, place & 0xFFFF
                if w["kind"] == 2:
                    found.setdefault((2, key, raw[a : a + n + LENGTH - 1]), []).append((doc, tie, place))
                    size += n + 2 * LENGTH
                else:
                    part = np.frombuffer(raw[a : a + n + LENGTH - 1], dtype=np.uint8)
                    at = np.arange(n)
                    for s, deal in zip(range(a, a + n), RangeHash(part, salt=11)(at, at + LENGTH).view(np.int64).tolist(), strict=True):
                        found.setdefault((3, deal, raw[s : s + LENGTH]), []).append((doc, tie, s << 16 | 1))
                    size += 2 * LENGTH * n
                if size > 16 * CHUNK:
                    yield rows(found)
                    found, size = {}, 0
        if found:
            yield rows(found)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by kind, deal, bytes and place: marks (doc, tie, place)."""
    names = ["doc", "tie", "place"]
    held: list[tuple] = []
    size = 0
    carry: list | None = None

    def sort() -> Iterator[pa.RecordBatch]:
        rank = np.zeros(len(held), dtype=np.int64)
        rank[sorted(range(len(held)), key=lambda i: held[i][:3])] = np.arange(len(held))
        found = repeated_windows([h[3] for h in held], np.array([h[2] & 0xFFFF for h in held]), rank)
        rows = []
        for (doc, tie, place, _), at in zip(held, found, strict=True):
            if len(at):
                cut = np.flatnonzero(np.diff(at) > 1) + 1
                rows += [(doc, tie, ((place >> 16) + int(run[0])) << 16 | len(run)) for run in np.split(at, cut)]
        if rows:
            yield _rows(*(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)), names=names)

    def settle(columns: list, stop: int) -> Iterator[pa.RecordBatch]:
        """Distinct contents before ``stop``: those that share their anchor with another one are sorted."""
        nonlocal held, size
        kind, deal = columns[0][:stop], columns[1][:stop]
        same = np.zeros(stop + 1, dtype=bool)
        same[1:stop] = (deal[1:] == deal[:-1]) & (kind[1:] == kind[:-1])
        last = None
        for i in np.flatnonzero((same[:-1] | same[1:]) & (kind == 2)).tolist():
            if size > BLOCK and deal[i] != last:
                yield from sort()
                held, size = [], 0
            last = deal[i]
            content = columns[5][i].as_py()
            held.append((int(columns[2][i]), int(columns[3][i]), int(columns[4][i]), content))
            size += len(content)

    for batch in batches:
        kinds = batch.column(0).to_numpy()
        done = kinds == 1
        if done.any():
            yield _rows(*(batch.column(i).to_numpy()[done] for i in (2, 3, 4)), names=names)
        if done.all():
            continue
        rest = pa.array(np.flatnonzero(~done))
        columns = [batch.column(i).to_numpy()[~done] for i in range(5)] + [batch.column(5).take(rest)]
        if carry:
            columns = [*(np.concatenate(c) for c in zip(carry[:5], columns[:5], strict=True)), pa.concat_arrays([carry[5], columns[5]])]
        kind, deal, doc, tie, place, content = columns
        equal = np.zeros(len(kind), dtype=bool)
        equal[1:] = (deal[1:] == deal[:-1]) & (kind[1:] == kind[:-1]) & pc.equal(content[1:], content[:-1]).to_numpy(zero_copy_only=False)
        first = np.maximum.accumulate(np.where(equal, 0, np.arange(len(kind))))
        later = equal & ((doc != doc[first]) | (tie != tie[first]) | (place != place[first]))
        if later.any():
            yield _rows(doc[later], tie[later], place[later], names=names)
        # Of each content the first stays; those of the last anchor wait for the next batch.
        keep = np.flatnonzero(~equal)
        columns = [c[keep] for c in columns[:5]] + [content.take(pa.array(keep))]
        open_ = (columns[1] == columns[1][-1]) & (columns[0] == columns[0][-1])
        stop = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
        yield from settle(columns, stop)
        carry = [c[stop:] for c in columns]
    if carry:
        yield from settle(carry, len(carry[0]))
    if held:
        yield from sort()


def removed_spans(size: int, places: list[int]) -> list[tuple[int, int]]:
    """Maximal removed runs (start, end) from marks."""
    if not places:
        return []
    p = np.sort(np.array(places, dtype=np.int64))
    a, b = p >> 16, (p >> 16) + (p & 0xFFFF) + (LENGTH - 1)
    reach = np.maximum.accumulate(b)
    cut = np.flatnonzero(a[1:] > reach[:-1]) + 1
    return list(zip(a[np.append(0, cut)].tolist(), reach[np.append(cut - 1, len(a) - 1)].tolist(), strict=True))


def mark_repeats(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a further column of marks, and the name of that column; names of the documents' own columns are left alone."""
    spark = docs.sparkSession
    doc, tie, places = fresh(docs.columns, "_doc", "_tie", "_places")
    key = F.xxhash64("text")
    twice = docs.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a <> b or doc_id is null").limit(1).count()
    source = docs.withColumns({doc: F.coalesce("doc_id", F.lit(LAST)), tie: key if twice else F.lit(0).cast("long")})
    rows = source.select(F.col(doc).alias("doc"), F.col(tie).alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark)
    with scratch(spark) as own:
        ranges = materialise(rows.mapInArrow(_ranges, _SCHEMA), "ranges")
        several = ranges.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
        found = shared = materialise(ranges.join(several, "key"), "shared")
        # Most ranges occur once; their table would lie beside the exchanges of texts and contents.
        own.drop(ranges)
        # Anchors of more than LARGE contents: at most one for so many ranges.
        large = shared.select("key", "content").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select("key", F.lit(3).cast("long").alias("kind"))
        large = materialise(large, "large")
        count = large.count()
        shared = shared.join(F.broadcast(large) if count * 32 <= BROADCAST_BYTES else large, "key", "left") if count else shared.withColumn("kind", F.lit(2).cast("long"))
        wants = shared.groupBy("doc", "tie").agg(F.collect_set(F.struct(F.coalesce("kind", F.lit(2).cast("long")).alias("kind"), "key", "place")).alias("wants"))
        # Written down, so that the exchanges behind them and the ranges are gone before the contents are dealt out.
        texts = materialise(rows.join(wants, ["doc", "tie"]).select("doc", "tie", "text", "wants"), "texts")
        own.drop(found)
        parts = texts.mapInArrow(_contents, "kind long, deal long, doc long, tie long, place long, bytes binary")
        parts = parts.repartition(n, "deal").sortWithinPartitions(*_PARTS[:2], "bytes", *_PARTS[2:5])
        marks = parts.mapInArrow(_resolve, "doc long, tie long, place long")
        # At most one mark for each byte of a document: a group is never larger than its text.
        marks = own.keep(materialise(marks.groupBy(F.col("doc").alias(doc), F.col("tie").alias(tie)).agg(F.collect_list("place").alias(places)), "marks"))
    return source.join(marks, [doc, tie], "left").select(*docs.columns, places), places


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows, _ = mark_repeats(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            out = []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                spans = removed_spans(len(raw), places)
                out.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(cut(raw, spans)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*out, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return raw
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining text of every row (characters cut in two by a removal go as well) and its length in ``n_chars``, where there is such a column."""
    rows, _ = mark_repeats(docs)
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            texts = []
            for text, places in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if text is None or not places:
                    texts.append(text)
                else:
                    raw = text.encode()
                    texts.append(cut(raw, removed_spans(len(raw), places)).decode("utf-8", "ignore"))
            columns = [batch.column(i) for i in range(len(names))]
            new = pa.array(texts, pa.string())
            columns[at] = new
            if count is not None:
                columns[count] = pc.utf8_length(new).cast(columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, docs.schema)
