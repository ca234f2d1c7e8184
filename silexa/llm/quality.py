"""Compression classifier of text quality.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A text is cut into pieces of ``PIECE`` bytes that cover
all of it; each piece is compressed with either dictionary, and the difference of the two sizes over the piece's length is that piece's normalised
difference. The text's difference is the ``TAIL`` quantile of those of its pieces, so that a text with a fair share of bad pieces is told from one
without. This one number is all that a score depends on: a logistic curve, fitted on labelled rows that the dictionaries have not seen and weighted to
the true rate of the classes, turns it into the probability of label 1.

The fit uses a bounded sample: at most ``FIT_ROWS`` labelled texts of each class, those with the smallest hash of their id, and of those at
most ``FIT_BYTES`` bytes a class. Where a class has more bytes, the shorter texts stay whole and the longer ones give an equal number of
leading bytes each, so that no text displaces another; a model is a few hundred kB however large the corpus. Scoring covers every text in full and takes
a few bytes of memory for each piece.

Defined cases: a null text is the empty text; the empty text has the difference 0; without rows of both classes every
score is 0.5; a doc_id that is labelled both ways is no labelled row; rows with a null doc_id count as id '' for the folds; repeated rows get equal
scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, fresh

#: The labelled rows of each class that a fit may use: so many, of so many bytes together, none longer than that.
FIT_ROWS = 3000
FIT_BYTES = 6 << 20
ROW_BYTES = 64 << 10
DICT_BYTES = 65536
PIECE = 96
TAIL = 0.2
LEVEL = 3
#: Pieces of the texts that a dictionary is trained on.
SAMPLE = 1024
THRESHOLD = 0.3


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


class _Sizes:
    """Compressed sizes with either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        self.both = [z.ZstdCompressor(level=LEVEL, dict_data=self._loaded(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad)]

    @staticmethod
    def _loaded(raw: bytes):
        import zstandard as z

        out = z.ZstdCompressionDict(raw)
        out.precompute_compress(level=LEVEL)
        return out

    def difference(self, text: bytes) -> float:
        """Normalised difference of the compressed sizes: positive where the dictionary of good texts compresses better."""
        if not text:
            return 0.0
        n = len(text)
        one, two = (c.compress for c in self.both)
        lengths = np.minimum(PIECE, n - np.arange(0, n, PIECE)) + 16
        sizes = np.fromiter((len(two(p)) - len(one(p)) for p in (text[i : i + PIECE] for i in range(0, n, PIECE))), dtype=np.int64, count=len(lengths))
        return float(np.quantile(sizes / lengths, TAIL))


def fit(texts: list[bytes], labels: list[int], rate: float | None = None) -> Model | None:
    """Dictionaries from one half of the texts, the logistic curve from the other half; ``rate`` is the share of label 1 among all labelled rows.

    A class with too little text for training gives its own text as a raw dictionary; a class of under four texts gives no model.
    """
    import zstandard as z

    y = np.array(labels)
    if len(set(labels)) < 2 or min((y == 0).sum(), (y == 1).sum()) < 4:
        return None
    # Every second text of each class.
    half = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) % 2 == 1
    dicts = []
    for k in (1, 0):
        pieces = [t[i : i + SAMPLE] for t, own, h in zip(texts, labels, half, strict=True) if own == k and h for i in range(0, len(t), SAMPLE)]
        try:
            size = min(DICT_BYTES, max(1024, sum(map(len, pieces)) // 8))
            dicts.append(z.train_dictionary(size, [p for p in pieces if len(p) >= 8]).as_bytes())
        except z.ZstdError:
            # Too little text to train on: the last whole pieces that fit are the dictionary.
            kept = np.cumsum([len(p) for p in reversed(pieces)]) <= DICT_BYTES
            dicts.append(b"".join(pieces[len(pieces) - int(kept.sum()) :]))
    sizes = _Sizes(*dicts)
    # The texts behind the dictionaries would look too well compressed, so the other half alone fits the curve.
    x, own = np.array([sizes.difference(t) for t, h in zip(texts, half, strict=True) if not h]), y[~half].astype(float)
    slope, intercept = logistic(x, own, own.mean() if rate is None else rate)
    return Model(dicts[0], dicts[1], slope, intercept)


def logistic(x: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, float]:
    """Slope (0 at least) and intercept of the probability of 1 given ``x``, rows weighted so that label 1 has the share ``rate``."""
    weight = np.where(y == 1, rate / max(y.mean(), 1e-6), (1 - rate) / max(1 - y.mean(), 1e-6))
    scale = float(x.std()) + 1e-6
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w, ridge = np.zeros(2), np.array([1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-6), a.T @ (weight * (p - y)) + ridge * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0) / scale, float(w[1])


def scores(model: Model | None, texts: list[bytes], sizes: _Sizes | None = None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    sizes = sizes or _Sizes(model.good, model.bad)
    x = np.array([sizes.difference(t) for t in texts])
    return 1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -30, 30)))


def marked(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, _y) of the documents that are labelled 0 or 1, and not both."""
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_y"), F.max(label).alias("_other"))
    return rows.filter("_y = _other").drop("_other")


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the labelled rows, at the rate of label 1 among all of them."""
    rate = marked(labels, "quality").agg(F.avg("_y")).first()[0]
    return fit(*labelled_sample(docs, labels, "quality"), rate)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS, limit: int = FIT_BYTES, longest: int = ROW_BYTES) -> tuple[list[bytes], list[int]]:
    """Whole texts of at most ``rows`` documents of each label, those with the smallest hash of the id, and of at most ``limit`` bytes together: bounded for any corpus.

    Of rows that share a doc_id one counts, that with the least text. Texts longer than ``longest`` bytes are not in the sample, so that none takes the room of many; where the others have more than
    ``limit`` bytes, those with the greatest hashes are left out.
    """
    ids = marked(labels, label).withColumn("_h", F.md5(F.concat(F.lit("fit:"), F.col("doc_id").cast("string"))))
    picked = None
    for y in (0, 1):
        top = ids.filter(F.col("_y") == y).orderBy("_h", "doc_id").limit(rows)
        picked = top if picked is None else picked.unionByName(top)
    # At most 2 * rows short rows: a proven bound for the broadcast.
    text = F.coalesce("text", F.lit(""))
    sample = docs.filter(F.octet_length(text) <= longest).select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id")
    one = sample.groupBy("doc_id", "_y", "_h").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("_y").orderBy("_h", "doc_id"))
    chosen = one.withColumn("_sum", so_far).filter(F.col("_sum") <= limit).select("_y", "_h", F.col("text").cast("binary").alias("text"))
    chosen = chosen.toPandas().sort_values(["_h", "_y"], kind="stable")
    return [bytes(t) for t in chosen["text"]], [int(v) for v in chosen["_y"]]


def score_quality(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns of every document and its score; the text leaves the JVM once, also where it is kept, and is scored some MB at a time."""
    kept = [c for c in keep if c != name]
    (hidden,) = ("text",) if "text" in kept else fresh(kept, "_text")
    source = docs.select(*kept, *([] if hidden in kept else [docs["text"].alias(hidden)]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(kept)]), f"`{name}` double"])
    shared, at = docs.sparkSession.sparkContext.broadcast(model), source.columns.index(hidden)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sizes = _Sizes(own.good, own.bad) if own else None
        for batch in chunks(batches, hidden):
            texts = [(x or "").encode() for x in batch.column(at).to_pylist()]
            if texts:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(scores(own, texts, sizes), pa.float64())], names=[*kept, name])

    return source.mapInArrow(run, schema)
