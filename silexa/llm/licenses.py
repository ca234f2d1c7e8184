"""License scans: ordered signature rules over normalised words, gated by keywords, overlaps resolved by priority and containment.

A text is lower-cased in A-Z and cut into words of ASCII letters, digits and everything outside ASCII. Base phrases (fixed by
the contract) are counted at every place. Signature rules (``signatures``) are regular expressions over the words joined with single blanks. What a
rule cannot match without is read off its expression; one Aho-Corasick pass over the text finds those keywords, and a rule runs only where each of them
(or one of its alternatives) occurs. Detections are ordered by priority, then length, then start, then the order of the rules; one that lies inside
an accepted detection's interval is suppressed, which a tree over the starts tells in logarithmic time. The score is that of the strongest accepted detection.

Defined cases: a null text is the empty text, without words, labels and places, score 0; repeated rows get equal rows; an empty table an empty result.
A long text takes a few times its size in memory and time in proportion.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import buffer_of, chunks, fresh
from .signatures import SIGNATURES

#: (phrase, label): fixed values of the contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Verbs before a license's name.
VERBS = "licensed|released|distributed|available|provided|published|covered|governed"
#: What the signatures' short forms stand for; ``<v:a|b>`` and ``<v?:a|b>`` are versions, ``<n:a|b>`` a bare number.
_SHORT = {
    "<under>": rf"(?:{VERBS})(?: \w+)? (?:under|by) (?:the )?(?:terms of )?(?:the )?",
    "<lic>": r"licen[sc]e",
    "<cc>": r"creative commons ",
    "<i>": r"(?: international| unported| public)?(?: licen[sc]e)?",
    "<parts>": r"(?P<parts>(?: nc| sa| nd){0,2})",
}
#: Labels whose versions go without a final 0.
_WHOLE = ("gpl", "lgpl", "agpl")
#: Keywords that a rule is gated by, at most.
_GATES = 3


@dataclass(frozen=True)
class Rule:
    label: str
    expression: str
    priority: int
    confidence: float

    def named(self, match: re.Match) -> str:
        """The label with the version and the parts that were matched."""
        found = match.groupdict()
        version = found.get("v") or found.get("n") or ""
        if self.label in _WHOLE:
            version = version.removesuffix(" 0")
        label = self.label.replace("{parts}", (found.get("parts") or "").replace(" ", "-"))
        return f"{label}-{re.sub(r'(?<=[0-9]) (?=[0-9])', '.', version).replace(' ', '-')}" if version else label


@cache
def rules() -> tuple[Rule, ...]:
    """All signature rules in their order."""
    out = []
    for label, expression, priority, confidence in SIGNATURES:
        expression = re.sub(r"<n:([^>]+)>", r"(?P<n>\1)", expression)
        expression = re.sub(r"<v(\??):([^>]+)>", r"(?:(?: <lic>)?(?: agreement)?(?: version| v)? ?v?(?P<v>\2))\1", expression)
        for short, full in _SHORT.items():
            expression = expression.replace(short, full)
        out.append(Rule(label, expression, priority, confidence))
    return tuple(out)


def required(expression: str) -> list[frozenset[str]]:
    """Keywords without which the expression cannot match: of each set one occurs in every match. Pieces of words, the longest first."""
    from re import _parser

    def best(text: str) -> frozenset[str] | None:
        piece = max(text.split(" "), key=len)
        return frozenset([piece]) if len(piece) > 1 else None

    def walk(parsed) -> list[frozenset[str]]:
        found, run = [], ""
        for op, value in parsed:
            name = str(op)
            if name == "LITERAL":
                run += chr(value)
                continue
            found, run = [*found, best(run)], ""
            if name == "SUBPATTERN":
                found += walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                found += walk(value[2])
            elif name == "BRANCH":
                ways = [walk(w) for w in value[1]]
                if all(ways):
                    found.append(frozenset().union(*(w[0] for w in ways)))
        return sorted({f for f in [*found, best(run)] if f}, key=lambda f: (-min(map(len, f)), sorted(f)))

    return walk(_parser.parse(expression))


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_WORD = rb"0-9a-z\x80-\xff"
_WORDS = re.compile(rb"[" + _WORD + rb"]+")
_BASE = [(re.compile(rb"(?<![" + _WORD + rb"])(?=" + (rb"[^" + _WORD + rb"]+").join(p.encode().split()) + rb"(?![" + _WORD + rb"]))"), label, max(p.split(), key=len).encode()) for p, label in BASE]


@cache
def _matcher():
    """The keywords' automaton, each rule's gates by the keywords' numbers, and the compiled rules."""
    import ahocorasick

    found, automaton = {}, ahocorasick.Automaton()
    gates = [[frozenset(found.setdefault(k, len(found)) for k in f) for f in required(r.expression)[:_GATES]] for r in rules()]
    for k, i in found.items():
        automaton.add_word(k, i)
    automaton.make_automaton()
    return automaton, gates, [re.compile(rf"(?<= )(?:{r.expression})(?= )") for r in rules()]


_OPEN: dict[frozenset[int], list[int]] = {}


def open_rules(low: str) -> list[int]:
    """Numbers of the rules whose gates a text in lower case passes."""
    automaton, gates, _ = _matcher()
    present = frozenset(i for _, i in automaton.iter(low))
    if present not in _OPEN:
        if len(_OPEN) > 50_000:
            _OPEN.clear()
        _OPEN[present] = [n for n, g in enumerate(gates) if all(f & present for f in g)] if present else []
    return _OPEN[present]


def detect(words: str, numbers: list[int] | None = None) -> list[tuple[int, int, str, float]]:
    """Accepted detections (start, end, label, confidence) in a string of words with single blanks between and around them; ``numbers``
    are the rules to run, all by default."""
    _, _, compiled = _matcher()
    hits = [(-r.priority, m.start() - m.end(), m.start(), n, m.end(), r.named(m), r.confidence) for n in (range(len(compiled)) if numbers is None else numbers) for r in [rules()[n]] for m in compiled[n].finditer(words)]
    hits.sort()
    # Of the accepted detections that start at or before a place, the furthest end: a Fenwick tree over the starts.
    starts = sorted({h[2] for h in hits})
    tree, out = [0] * (len(starts) + 1), []
    for _, _, start, _, end, label, confidence in hits:
        i = at = bisect_left(starts, start) + 1
        reach = 0
        while i:
            reach, i = max(reach, tree[i]), i & (i - 1)
        if reach < end:
            out.append((start, end, label, confidence))
            while at < len(tree):
                tree[at] = max(tree[at], end)
                at += at & -at
    return out


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Words, base phrase places and labels of every text, and ``detections``: label, first word, words, confidence."""
    columns = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("confidence", pa.float64())]))
    kept = [c for c in keep if c not in {n for n, _ in columns} | {"detections"}]
    (hidden,) = fresh(kept, "_text")
    source = docs.select(*kept, docs[text].alias(hidden))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    schema = (types + ", " if types else "") + "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label string, first long, words long, confidence double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, hidden):
            data, offsets = buffer_of(batch.column(len(kept)), pad=1)
            low = data.tobytes().translate(_LOWER)
            inside = _IS_WORD[np.frombuffer(low, dtype=np.uint8)]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            first = offsets[:-1][np.diff(offsets) > 0]
            begins[first] = inside[first]
            before = np.concatenate([[0], np.cumsum(begins)])
            rows = []
            for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                part, zero = low[a:b], int(before[a])
                places, base = [], set()
                for expression, label, need in _BASE:
                    if need in part:
                        at = [int(before[a + m.start()]) - zero for m in expression.finditer(part)]
                        places += at
                        base |= {label} if at else set()
                found = []
                if numbers := open_rules(part.decode("utf-8", "replace")):
                    words = " " + b" ".join(_WORDS.findall(part)).decode("utf-8", "replace") + " "
                    if hits := detect(words, numbers):
                        blanks = np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), dtype=np.uint32) == 32)
                        first, last = np.searchsorted(blanks, [[h[0] for h in hits], [h[1] for h in hits]]).tolist()
                        found = [(label, i - 1, k - i + 1, confidence) for (_, _, label, confidence), i, k in zip(hits, first, last, strict=True)]
                labels = base | {f[0] for f in found}
                rows.append((int(before[b]) - zero, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max([f[3] for f in found] + [0.9] * bool(base), default=0.0), [{"label": x, "first": i, "words": n, "confidence": c} for x, i, n, c in found]))
            by = list(zip(*rows, strict=True))
            arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(c, t) for c, (_, t) in zip(by, columns, strict=False)] + [pa.array(by[-1], spans)]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + [n for n, _ in columns] + ["detections"])

    return source.mapInArrow(run, schema)
