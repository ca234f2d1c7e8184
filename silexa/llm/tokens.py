"""Token counts under a unigram model without building the tokens: a Viterbi pass that carries best score and piece count alone.

The vocabulary is that of a public tokenizer file (path a parameter); a piece's score is -ln(rank + 2), its rank being its place
in the file. Blanks become the word mark; each word is scored by itself with all blanks before it, or each line where the vocabulary has pieces with a mark
behind a letter, so that no piece can cross a cut. One Aho-Corasick automaton enumerates all pieces
that end at a position, longest first; a later candidate wins only with a strictly greater score. A character that no single-character piece
covers may be left unknown at the lowest score minus 10, and counts as its UTF-8 bytes (byte fallback). These are the tie and fallback rules of the
public unigram tokenizers; the tests compare with one of them built from the same vocabulary.

A line feed is in no piece, so words are cut there as well, and counts add up. Words repeat, so each task keeps a bounded table of counts.

Defined cases: a null or empty text has 0 tokens; repeated rows get equal rows; an empty table gives an empty result. A long text is held once and cut into segments one by
one; a word of a megabyte takes some hundred bytes a character while it is scored.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh

MARK = "▁"
UNKNOWN = 10.0
CACHE = 400_000
FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Longer segments are not kept.
KEPT = 64
_WORDS, _LINES = re.compile(r" *[^ \n]+| +|\n"), re.compile(r"[^\n]+|\n")
_RESERVED = re.compile(r"<0x[0-9A-F]{2}>|<unk>|</?s>")


def piece_scores(path: str) -> dict[str, float]:
    """Piece to score, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return {p: -math.log(i + 2) for i, p in enumerate(pieces) if not _RESERVED.fullmatch(p) and "\n" not in p}


class Counter:
    """Counts and best scores of words under one vocabulary."""

    def __init__(self, scores: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, s in scores.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.singles = frozenset(p for p in scores if len(p) == 1)
        self.unknown = min(scores.values()) - UNKNOWN
        self.segment = _LINES if any(MARK in p.lstrip(MARK) for p in scores) else _WORDS
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        matches = self.automaton.iter(word)
        end, piece = next(matches, (n, None))
        for i, c in enumerate(word):
            top, pieces = None, 0
            while end == i:
                size, score = piece
                # Where the text before a piece cannot be reached, nothing is: single characters are always covered or unknown.
                if top is None or best[i + 1 - size] + score > top:
                    top, pieces = best[i + 1 - size] + score, count[i + 1 - size] + 1
                end, piece = next(matches, (n, None))
            if c not in self.singles and (top is None or best[i] + self.unknown > top):
                top, pieces = best[i] + self.unknown, count[i] + len(c.encode("utf-8", "replace"))
            best[i + 1], count[i + 1] = top, pieces
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        """Pieces and score of a whole text; the first word has a mark before it, too."""
        if not text:
            return 0, 0.0
        tokens, score, known = 0, 0.0, self.known
        for m in self.segment.finditer(" " + text):
            s = m[0]
            hit = known.get(s)
            if hit is None:
                hit = self.word(s.replace(" ", MARK))
                if len(s) <= KEPT:
                    if len(known) >= CACHE:
                        known.clear()
                    known[s] = hit
            tokens += hit[0]
            score += hit[1]
        return tokens, score


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens and the best score of every text. The driver reads the vocabulary at ``path`` and broadcasts it: some MB, whatever the corpus."""
    path = path or os.environ.get("TOKENIZER_FILE", FILE)
    kept = [c for c in keep if c not in ("n_tokens", "best_score")]
    (hidden,) = fresh(kept, "_text")
    source = docs.select(*kept, docs[text].alias(hidden))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "n_tokens long, best_score double"])

    shared = docs.sparkSession.sparkContext.broadcast(piece_scores(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counter(shared.value)
        for batch in batches:
            rows = [own.text(x or "") for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], names=[*kept, "n_tokens", "best_score"])

    return source.mapInArrow(run, schema)
