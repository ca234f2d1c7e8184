"""Toxicity: a learned lexicon in one trie, Levenshtein automata that find its misspelled terms, and scores from the context of each hit.

The lexicon comes from labelled rows alone. Its terms are whole words and stems (prefixes of ``STEMS`` letters, written with a star); a greedy cover
takes the term that explains most toxic texts not yet explained and hardly any other text, until no term explains ``LEAST`` more texts, or as many as the
number of candidates has digits: with so many to choose from, fewer are chance. Copies of one text therefore do not carry their incidental words into the lexicon. A term may need two or three hits in one block of ``BLOCK`` words before it tells
anything, so each term has a weight for one, two and three hits; below what it needs it counts half.

All terms stand in one trie, words as accepting ends and stems as accepting prefixes. A word of a text that has no term as it stands is
compiled to its Levenshtein automaton (1 edit for terms of 5 letters, 2 from 9 letters on) and walked with the trie; every state the walk can meet is
a row of a table shared by all words. Words near a term that occur in the non-toxic rows of the sample are ordinary and do not count; the
more of them stand near a term, the less its other misspellings weigh.

A hit inside quotation marks or beside a word of reporting is a quotation: all quotations of a text together score at most ``QUOTED``. The other
hits are combined by their terms; one beside a word of address counts for more.

The fit uses a bounded sample of whole texts: ``FIT_ROWS`` rows and ``FIT_BYTES`` bytes of each label at most, none of a text longer than ``quality.ROW_BYTES``. Scoring covers every text in full; its memory is a few times the text.

Defined cases: a null or empty text scores 0; without toxic rows the lexicon is empty and every score 0; a null doc_id counts as id ''
for the folds; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh

FIT_ROWS = 8000
FIT_BYTES = 8 << 20
LEAST = 2
#: Words that explain nothing more beside other terms are learned when this share of the toxic rows has them.
BESIDE_SHARE = 0.05
THRESHOLD = 0.7
STEMS = (4, 5, 6, 7, 8)
HITS = 3
BLOCK = 400
#: So many toxic texts give a term that needs repetition its full standing; those of fewer come last.
STEADY = 12
#: Of quotations, however many, a text gets this score at most.
QUOTED = 0.5
#: Words of address do not raise a hit below this weight.
DOUBTFUL = 0.7
#: What a misspelling by 0, 1 and 2 edits counts of its term.
DAMPED = (1.0, 0.92, 0.82)
MOST = 2
CACHE = 300_000

_WORD = re.compile(r"[^\W_]+")
#: Marks and words around a hit (fixed lists): quotation, reporting, address.
_OPENING, _CLOSING = "\"“„«‹‘'", "\"”“»›’'"
_OPENS, _CLOSES, _BREAKS = re.compile(rf"(?<!\w)[{_OPENING}](?=\w)"), re.compile(rf"(?<=[\w.,;:!?…])[{_CLOSING}](?!\w)"), re.compile("[\"“”„«»\n]")
_REPORTING = frozenset("said says quote quoted quotes called term word wrote reported sagte nannte wort dit mot appelle dijo palabra".split())
_ADDRESS = frozenset("you your youre u are du dein bist ihr tu vous es toi usted eres".split())


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of the quotations of a text, of any length: from a mark before a word to the next one behind a word or its stop, with no other double mark and no line end between."""
    closes, breaks = [m.start() for m in _CLOSES.finditer(text)], [m.start() for m in _BREAKS.finditer(text)]
    out, done = [], 0
    for start in (m.start() for m in _OPENS.finditer(text)):
        if start < done:
            continue
        at, stop = bisect_right(closes, start), bisect_right(breaks, start)
        if at < len(closes) and (stop == len(breaks) or closes[at] <= breaks[stop]):
            done = closes[at] + 1
            out.append((start, done))
    return out


@dataclass
class Lexicon:
    #: Term to its weights for one, two and three hits in a block; a star marks a stem.
    terms: dict[str, tuple[float, ...]] = field(default_factory=dict)
    #: What misspellings of a term count of it, and the ordinary words near terms.
    fuzzy: dict[str, float] = field(default_factory=dict)
    ordinary: frozenset[str] = frozenset()


def edits(n: int) -> int:
    return 0 if n < 5 else 1 if n < 9 else MOST


class Moves:
    """The universal Levenshtein automaton for up to ``MOST`` edits.

    A state is a set of (offset, edits) positions in the word, relative to the smallest one; what a letter does to it depends only on which of the
    next ``REACH`` letters of the word are that letter. States and moves are compiled when first met and then shared by all words.
    """

    REACH = 3 * MOST + 1

    def __init__(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.numbers: dict[tuple, int] = {}
        self.table: dict[int, tuple[int, int] | None] = {}
        self.start = self._number(((0, 0),))

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def step(self, state: int, seen: int) -> tuple[int, int] | None:
        """(state, shift) behind a letter, whose places among the next letters are the bits of ``seen``; None when no match is left."""
        key = state << self.REACH | seen
        if key not in self.table:
            self.table[key] = self._compile(self.states[state], seen)
        return self.table[key]

    def _compile(self, state: tuple, seen: int) -> tuple[int, int] | None:
        out: dict[int, int] = {}

        def put(at: int, e: int) -> None:
            if e <= MOST and e < out.get(at, MOST + 1):
                out[at] = e

        for at, e in state:
            put(at, e + 1)
            put(at + 1, e + 1)
            for skip in range(MOST - e + 1):
                if seen >> (at + skip) & 1:
                    put(at + skip + 1, e + skip)
                    break
        kept = [(i, e) for i, e in out.items() if not any(f < e and abs(i - j) <= e - f for j, f in out.items())]
        if not kept:
            return None
        base = min(i for i, _ in kept)
        return self._number(tuple(sorted((i - base, e) for i, e in kept))), base


_MOVES = Moves()


class Trie:
    """The lexicon's terms; stems accept any word that begins with them."""

    def __init__(self, terms):
        import ahocorasick

        #: A node is [children by letter, word ending here, stem ending here, most edits of a term below].
        self.root: list = [{}, None, None, 0]
        # Of a term's letters one part of k + 1 stays in place under its k edits: an automaton of the parts, with what a word with each must fulfil.
        parts: dict[str, list[tuple]] = defaultdict(list)
        for term in terms:
            word, stem = term.rstrip("*"), term.endswith("*")
            n, node = len(word), self.root
            k = edits(n)
            node[3] = max(node[3], k)
            for c in word:
                node = node[0].setdefault(c, [{}, None, None, 0])
                node[3] = max(node[3], k)
            node[2 if stem else 1] = term
            if k:
                cuts = [n * p // (k + 1) for p in range(k + 2)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    parts[word[a:b]].append((b - k - 1, b + k - 1, n - k, 1 << 30 if stem else n + k, frozenset(word), k))
        self.parts = ahocorasick.Automaton()
        for part, wants in parts.items():
            self.parts.add_word(part, wants)
        self.parts.make_automaton()
        self.any = bool(parts)

    def exact(self, word: str) -> str | None:
        """The term that the word is, else the longest stem it begins with."""
        node, stem = self.root, None
        for c in word:
            stem = node[2] or stem
            if (node := node[0].get(c)) is None:
                return stem
        return node[1] or stem

    def near(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its number of edits and that number; ties go to words, then to the smaller term."""
        n, places = len(word), defaultdict(int)
        for i, c in enumerate(word):
            places[c] |= 1 << i
        all_, best, states, step = (1 << Moves.REACH) - 1, None, _MOVES.states, _MOVES.step
        stack = [(self.root, _MOVES.start, 0)]
        while stack:
            node, state, base = stack.pop()
            if node[1]:
                d = min((e + n - base - i for i, e in states[state] if base + i <= n), default=MOST + 1)
                if d <= edits(len(node[1])) and (best is None or (d, False, node[1]) < best):
                    best = (d, False, node[1])
            if node[2]:
                d = min((e for i, e in states[state] if base + i <= n), default=MOST + 1)
                if d <= edits(len(node[2]) - 1) and (best is None or (d, True, node[2]) < best):
                    best = (d, True, node[2])
            for c, child in node[0].items():
                if move := step(state, places[c] >> base & all_ if c in places else 0):
                    if min(e for _, e in states[move[0]]) <= child[3]:
                        stack.append((child, move[0], base + move[1]))
        return (best[2], best[0]) if best else None

    def may(self, word: str) -> bool:
        """A necessary condition for ``near``: one part of a term stands near its place, and all but k of the term's letters occur."""
        n, own = len(word), None
        for end, wants in self.parts.iter(word) if self.any else ():
            for low, high, least, most, letters, k in wants:
                if low <= end <= high and least <= n <= most:
                    own = own or frozenset(word)
                    if len(letters - own) <= k:
                        return True
        return False


def hits_by_term(words: list[str], terms_of) -> dict[str, int]:
    """Terms of a text and their hits in the block that has most of them, ``HITS`` at most; ``terms_of`` gives the terms of a word."""
    out: dict[str, int] = {}
    for a in range(0, len(words), BLOCK):
        found: Counter = Counter()
        for w, k in Counter(words[a : a + BLOCK]).items():
            for t in terms_of(w):
                found[t] += k
        for t, k in found.items():
            if k > out.get(t, 0):
                out[t] = min(k, HITS)
    return out


def learn(texts: list[bytes], labels: list[int]) -> Lexicon:
    words_of = lambda t: _WORD.findall(t.decode("utf-8", "replace").lower())
    every = lambda w: [w, *(w[:n] + "*" for n in STEMS if n < len(w))]
    toxic: dict[tuple[str, int], set[int]] = defaultdict(set)
    for i, (t, y) in enumerate(zip(texts, labels, strict=True)):
        if y:
            for term, k in hits_by_term(words_of(t), every).items():
                for c in range(1, k + 1):
                    toxic[term, c].add(i)
    least = max(LEAST, len(str(len(toxic))))
    toxic = {key: d for key, d in toxic.items() if len(d) >= least}
    among, other, plain = frozenset(t for t, _ in toxic), Counter(), {}
    for t, y in zip(texts, labels, strict=True):
        if not y:
            words = words_of(t)
            for w in words:
                if w not in plain:
                    plain[w] = [t for t in every(w) if t in among]
            for term, k in hits_by_term(words, plain.__getitem__).items():
                other.update((term, c) for c in range(1, k + 1))
    n_toxic, n_other = max(sum(labels), 1), max(len(labels) - sum(labels), 1)
    pure = {key: d for key, d in toxic.items() if other[key] / n_other <= 0.02 * len(d) / n_toxic}

    def weight(term: str, c: int) -> float:
        own = len(toxic.get((term, c), ()))
        return (own + 0.5) / (own + other[term, c] + 2.5)

    left, chosen = {i for i, y in enumerate(labels) if y}, {}
    # Terms of few texts that need repetition weigh little, so they only explain what is left over.
    for again in (False, True):
        open_ = {key: own for key, d in pure.items() if (again or key[1] == 1 or len(d) >= STEADY) and len(own := d & left) >= least}
        while open_:
            key = max(open_, key=lambda k: (len(open_[k]), len(toxic[k]), -k[1], not k[0].endswith("*"), len(k[0]), k[0]))
            new = open_[key]
            chosen[key[0]] = min(key[1], chosen.get(key[0], HITS))
            left -= new
            open_ = {k: rest for k, own in open_.items() if k != key and len(rest := own - new) >= least}
    # Words that always stand beside others explain nothing more, but count as much as those.
    usual = sorted(len(toxic[t, 1]) for t in chosen if not t.endswith("*"))
    stems = {t[:-1] for t in chosen if t.endswith("*")}
    for (t, c), d in pure.items():
        if c == 1 and not t.endswith("*") and usual and len(d) >= max(BESIDE_SHARE * n_toxic, 0.25 * usual[len(usual) // 2]) and not any(t.startswith(s) for s in stems):
            chosen.setdefault(t, 1)
    out = Lexicon()
    for t, first in chosen.items():
        steps = [weight(t, c) for c in range(1, HITS + 1)]
        out.terms[t] = tuple(max(steps[first - 1 : c]) if c >= first else 0.5 * min(steps[c - 1], steps[first - 1]) for c in range(1, HITS + 1))
    trie, near, ordinary = Trie(out.terms), Counter(), set()
    for w in plain:
        if trie.may(w) and trie.exact(w) is None and (hit := trie.near(w)):
            ordinary.add(w)
            near[hit[0]] += 1
    out.ordinary = frozenset(ordinary)
    # The more different ordinary words stand near a term, the likelier one that the sample does not have is ordinary, too.
    out.fuzzy = {t: len(toxic[t, chosen[t]]) / (len(toxic[t, chosen[t]]) + near[t]) for t in out.terms}
    return out


class Scorer:
    def __init__(self, lexicon: Lexicon, automaton: bool = True):
        self.lexicon, self.trie, self.automaton = lexicon, Trie(lexicon.terms), automaton
        self.cold: set[str] = set()
        self.hot: dict[str, tuple[str, float]] = {}

    def term(self, word: str) -> tuple[str, float] | None:
        """The term of a word, and what the word counts of it."""
        if hit := self.trie.exact(word):
            return hit, 1.0
        if not self.automaton or not self.trie.may(word) or word in self.lexicon.ordinary:
            return None
        near = self.trie.near(word)
        return (near[0], self.lexicon.fuzzy.get(near[0], 1.0) * DAMPED[near[1]]) if near else None

    def weight(self, word: str) -> float:
        """Weight of one hit of the word without context."""
        hit = self.term(word)
        return self.lexicon.terms[hit[0]][0] * hit[1] if hit else 0.0

    def hits(self, text: str) -> list[tuple[int, str, str, float, bool]]:
        """(character, word, term, weight, quoted) of each hit; a term's hits weigh what as many in one block do."""
        low = text.lower()
        words = _WORD.findall(low)
        own = set(words)
        for w in own - self.cold - self.hot.keys():
            if hit := self.term(w):
                self.hot[w] = hit
            else:
                self.cold.add(w)
        found = {w: self.hot[w] for w in own & self.hot.keys()}
        if len(self.cold) > CACHE:
            self.cold = set()
        if len(self.hot) > CACHE:
            self.hot = {}
        if not found:
            return []
        # Misspellings add up to hits by what they count.
        out, blocks, spans = [], Counter(), quotations(low)
        starts = [a for a, _ in spans]
        for k, m in enumerate(_WORD.finditer(low)):
            if hit := found.get(m[0]):
                around = set(words[max(0, k - 4) : k] + words[k + 1 : k + 5])
                start, end = m.start(), m.end()
                at = bisect_left(starts, start) - 1
                quoted = (at >= 0 and spans[at][1] > end) or bool(around & _REPORTING)
                if not quoted:
                    blocks[hit[0], k // BLOCK] += hit[1]
                out.append((start, m[0], hit, quoted, bool(around & _ADDRESS)))
        most: dict[str, int] = {}
        for (t, _), k in blocks.items():
            most[t] = max(most.get(t, 1), min(int(k), HITS))
        rows = []
        for start, word, (t, share), quoted, address in out:
            x = self.lexicon.terms[t][0 if quoted else most[t] - 1] * share
            if quoted:
                x *= QUOTED
            elif address and x >= DOUBTFUL:
                x = 1 - (1 - x) * 0.5
            rows.append((start, word, t, x, quoted))
        return rows

    def score(self, text: str) -> float:
        return combined(self.hits(text))


def combined(hits: list[tuple[int, str, str, float, bool]]) -> float:
    """Each term by its weightiest hit, terms as independent evidence; quotations by the weightiest alone."""
    best: dict[str, float] = {}
    quoted = 0.0
    for _, _, t, x, q in hits:
        if q:
            quoted = max(quoted, min(x, QUOTED))
        else:
            best[t] = max(best.get(t, 0.0), x)
    left = 1.0
    for x in best.values():
        left *= 1 - min(x, 0.999)
    return max(1 - left, quoted)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",), with_hits: bool = False, automaton: bool = True) -> DataFrame:
    """``keep`` columns, score, and with ``with_hits`` the places, words, terms and weights behind it."""
    kept = [c for c in keep if c not in ("score", "hits")]
    (hidden,) = fresh(kept, "_text")
    source = docs.select(*kept, docs["text"].alias(hidden))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "score double"] + ["hits array<struct<at long, word string, term string, weight double, quoted boolean>>"] * with_hits)
    names_ = ("at", "word", "term", "weight", "quoted")
    spans = pa.list_(pa.struct(list(zip(names_, (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_()), strict=True))))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, automaton)
        for batch in batches:
            hits = [scorer.hits(x or "") for x in batch.column(len(kept)).to_pylist()]
            columns, names = [batch.column(i) for i in range(len(kept))], [*kept, "score"]
            columns.append(pa.array([combined(h) for h in hits], pa.float64()))
            if with_hits:
                columns.append(pa.array([[dict(zip(names_, x, strict=True)) for x in h] for h in hits], spans))
                names.append("hits")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)
