"""Periodic runs of words: every maximal repetition of a text, found by block matching with integer-sequence automata.

A run is a stretch of words with smallest period q that holds ``max(least, 2 * q)`` words or more and that no neighbouring word extends. Within a run the
words before the last period all equal those q places on; these max(q, least - q) places or more hold an aligned block of the largest power of two B with
2 * B - 1 places at most. So every scale B looks for its aligned blocks at the distances q that lead to it, and at no others:

* A block counts only where each of its words comes again within the scale's greatest distance, over as many places in a row as the shortest run needs.
* The blocks of a text that are left become keys of one Aho-Corasick automaton over word numbers, which reads the stretches in which they may come again.
* Each block with one of its occurrences is a seed. It is extended in both directions to the last equal word, by range hashes and bisection, all seeds at once.
* Where a run of period B at most, found before, covers a block and its occurrence, they can only give that run again, so such windows are left out: a text of one word
  costs n log n, not its square.

What the hashes say is compared word by word before it counts; a text in which they were wrong is searched distance by distance. Of stretches with the same
ends the smallest period is the run's.

Defined cases: a null or empty text has no words and no runs; repeated rows get equal rows; an empty table gives an empty result; a null doc_id is kept, and nothing
is rewritten for it. A long text is split into words some MB at a time and held as word numbers, with its distinct words; columns named ``n_words``, ``runs`` or
``collapsed`` give way to the operator's own, all others keep their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, mix, powers, words_of

LEAST = 12
_FAR = np.iinfo(np.int64).max // 4
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def scale_of(period: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The size of the blocks that runs of a period are looked for with."""
    places = np.maximum(period, least - period)
    return 1 << (np.frexp((places + 1) // 2)[1] - 1)


def scales(longest: int, least: int = LEAST) -> Iterator[tuple[int, int, int, int]]:
    """(block size, least and greatest distance, places in a row) of every scale that a text of ``longest`` words can need, by rising size."""
    small = np.arange(1, min(longest // 2, 2 * least) + 1)
    of = scale_of(small, least)
    for b in np.unique(of):
        own = small[of == b]
        most = 4 * int(b) - 2
        if most >= least:  # beyond ``least`` a scale's distances are an unbroken range
            yield int(b), int(own.min()), min(most, longest // 2), int(np.maximum(own, least - own).min())
        else:
            yield int(b), int(own.min()), int(own.max()), int(np.maximum(own, least - own).min())
    b = int(of.max()) * 2 if len(of) else 1
    while 2 * b - 1 <= longest // 2:
        if 2 * b - 1 > 2 * least:
            yield b, 2 * b - 1, min(4 * b - 2, longest // 2), 2 * b - 1
        b *= 2


def _again(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every word of the texts that follow each other in ``ids`` how far on it comes again in its own text."""
    out = np.full(len(ids), _FAR, dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    near = np.diff(order)
    same = (ids[order[1:]] == ids[order[:-1]]) & (order[1:] < ends[order[:-1]])
    out[order[:-1][same]] = near[same]
    return out


def _stretches(ok: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
    start, stop = edge[::2], edge[1::2]
    keep = stop - start >= least
    return start[keep], stop[keep]


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, number within) for ``counts`` items of each."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _occurrences(ids: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, place) of every block of one text that comes again at a place from its ``low`` to its ``high``."""
    import ahocorasick

    keys: dict[tuple[int, ...], int] = {}
    kind = np.empty(len(at), dtype=np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for k, p in enumerate(at.tolist()):
        key = tuple(ids[p : p + size].tolist())
        found = keys.setdefault(key, len(keys))
        if found == len(keys) - 1:
            automaton.add_word(key, found)
        kind[k] = found
    automaton.make_automaton()
    order = np.argsort(low, kind="stable")
    first, last = low[order], np.maximum.accumulate(high[order]) + size
    cut = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1]]))
    places, kinds = [], []
    for u, v in zip(first[cut].tolist(), last[np.concatenate([cut[1:] - 1, [len(first) - 1]])].tolist(), strict=True):
        for end, found in automaton.iter(tuple(ids[u:v].tolist())):
            places.append(u + end - size + 1)
            kinds.append(found)
    place, of = np.array(places, dtype=np.int64), np.array(kinds, dtype=np.int64)
    # Blocks in the order of kind and place; each occurrence meets those of its kind whose window may hold it.
    wide = len(ids) + 1
    mine = np.argsort(kind * wide + at, kind="stable")
    sorted_ = (kind * wide + at)[mine]
    reach = int((high - at).max())
    left, right = np.searchsorted(sorted_, of * wide + np.maximum(place - reach, 0)), np.searchsorted(sorted_, of * wide + place)
    which, nth = _spread(right - left)
    block, place = mine[left[which] + nth], place[which]
    keep = (place >= low[block]) & (place <= high[block])
    return block[keep], place[keep]


class _Equal:
    """How far equality of two places goes on, by range hashes of the word numbers."""

    def __init__(self, ids: np.ndarray):
        self.power = powers(len(ids) + 1)
        self.sums = np.zeros(len(ids) + 1, dtype=np.uint64)
        np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * self.power[: len(ids)], out=self.sums[1:])

    def _same(self, a: np.ndarray, d: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.power[d] == self.sums[a + d + n] - self.sums[a + d]

    def after(self, a: np.ndarray, d: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from ``a`` and ``a + d`` on, up to ``most``."""
        return self._bisect(most, lambda n: self._same(a, d, n))

    def before(self, a: np.ndarray, d: np.ndarray, most: np.ndarray) -> np.ndarray:
        return self._bisect(most, lambda n: self._same(a - n, d, n))

    @staticmethod
    def _bisect(most: np.ndarray, same: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        known, step = np.zeros(len(most), dtype=np.int64), 1 << max(0, int(most.max(initial=0)).bit_length())
        while step:
            tried = known + step
            known = np.where((tried <= most) & same(np.minimum(tried, most)), tried, known)
            step >>= 1
        return known


def plain_runs(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of one text's runs by comparing it with itself at every distance."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(ids) // 2 + 1):
        for s, e in zip(*_stretches(ids[:-q] == ids[q:], max(q, least - q, 1)), strict=True):
            found.setdefault((int(s), int(e) + q), q)
    return np.array(sorted((s, e - s, q) for (s, e), q in found.items()), dtype=np.int64).reshape(-1, 3)


def find(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(text, (start, length, period)) of all runs of the texts ``ids[bounds[i] : bounds[i + 1]]``; starts count within the text, rows are in the order of text, start and period."""
    sizes = np.diff(bounds)
    if not sizes.max(initial=0):
        return np.zeros(0, dtype=np.int64), np.zeros((0, 3), dtype=np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    begins, ends = bounds[:-1][text], bounds[1:][text]
    again = _again(ids, ends)
    equal = None
    runs = np.zeros((0, 3), dtype=np.int64)  # start, stop and period, in places of ``ids``
    for size, least_d, most_d, row in scales(int(sizes.max()), least):
        start, stop = _stretches(again <= most_d, row)
        if not len(start):
            continue
        base = begins[start]
        first = base + -(-(start - base) // size) * size
        which, nth = _spread(np.maximum((stop - first) // size, 0))
        at = first[which] + nth * size
        known = runs[(runs[:, 2] <= size) & (runs[:, 2] < least_d)]
        low = at + least_d
        if len(known):
            known = known[np.argsort(known[:, 0], kind="stable")]
            reach = np.concatenate([[0], np.maximum.accumulate(known[:, 1])])[np.searchsorted(known[:, 0], at, side="right")]
            low = np.maximum(low, reach - size + 1)
        high = np.minimum(at + most_d, ends[at] - size)
        at, low, high = (x[low <= high] for x in (at, low, high))
        seeds, distances = [], []
        for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(text[at])) + 1) if len(at) else []:
            u, v = bounds[text[at[own[0]]]], bounds[text[at[own[0]]] + 1]
            block, place = _occurrences(ids[u:v], at[own] - u, low[own] - u, high[own] - u, size)
            seeds.append(at[own][block])
            distances.append(place + u - at[own][block])
        if not seeds:
            continue
        p, d = np.concatenate(seeds), np.concatenate(distances)
        fits = scale_of(d, least) == size
        p, d = p[fits], d[fits]
        if not len(p):
            continue
        equal = equal or _Equal(ids)
        s = p - equal.before(p, d, p - begins[p])
        e = p + d + equal.after(p, d, ends[p] - p - d)
        full = e - s >= np.maximum(least, 2 * d)
        runs = np.unique(np.concatenate([runs, np.stack([s, e, d], axis=1)[full]]), axis=0)
        # Rows are in the order of start, stop and period: the first of equal ends has the smallest period.
        runs = runs[np.concatenate([[True], (np.diff(runs[:, :2], axis=0) != 0).any(axis=1)])] if len(runs) else runs
    wrong = {int(text[s]) for s, e, q in runs.tolist() if not np.array_equal(ids[s : e - q], ids[s + q : e]) or (s > begins[s] and ids[s - 1] == ids[s - 1 + q]) or (e < ends[s] and ids[e] == ids[e - q])}
    of = text[runs[:, 0]]
    out = np.stack([runs[:, 0] - begins[runs[:, 0]], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    if wrong:
        good = ~np.isin(of, list(wrong))
        exact = [(i, plain_runs(ids[bounds[i] : bounds[i + 1]], least)) for i in sorted(wrong)]
        of, out = np.concatenate([of[good], *(np.full(len(x), i) for i, x in exact)]), np.concatenate([out[good], *(x for _, x in exact)])
    order = np.lexsort((out[:, 2], out[:, 0], of))
    return of[order], out[order]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words that the words of a text become: for every tenth document, by the crc32 of its id, its words repeat from some place on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + np.arange(n - a) % p
    return places


def find_runs(docs: DataFrame, least: int = LEAST, keep: tuple[str, ...] = ("doc_id",), rewrite: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """``keep`` columns, ``n_words``, ``runs`` (start, length and period, by start, then period) and ``collapsed``: the text without the words that any run has behind its first period.

    ``rewrite`` gives the places of the words that a text's words become before runs are looked for, by doc_id and number of words.
    """
    kept = [c for c in keep if c not in ("n_words", "runs", "collapsed")]
    hidden, key = fresh(kept, "_text", "_id")
    source = docs.select(*kept, docs["doc_id"].cast("long").alias(key), docs["text"].alias(hidden))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2]), "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, hidden):
            known: defaultdict[bytes, int] = defaultdict(count().__next__)
            rows = []
            texts = batch.column(len(kept) + 1)
            for i, doc_id in enumerate(batch.column(len(kept)).to_pylist()):
                raw = (texts[i].as_py() or "").encode()
                parts = [np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)) for words in words_of(raw)]
                ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
                places = rewrite(doc_id, len(ids)) if rewrite else None
                rows.append(ids if places is None else ids[places])
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            ids = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
            of, found = find(ids, bounds, least)
            edge = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(edge, bounds[of] + found[:, 0] + found[:, 2], 1)
            np.add.at(edge, bounds[of] + found[:, 0] + found[:, 1], -1)
            stays = np.cumsum(edge)[:-1] == 0
            vocabulary = list(known)
            collapsed = [b" ".join(map(vocabulary.__getitem__, ids[u:v][stays[u:v]].tolist())) for u, v in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            offsets = np.searchsorted(of, np.arange(len(rows) + 1)).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(np.diff(bounds)), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], names=[*kept, "n_words", "runs", "collapsed"])

    return source.mapInArrow(run, schema)


def run_report(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("b.period")
    return rows.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), period.alias("period"), F.floor(F.col("b.length") * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
