"""Token ids as ORC files: written in ascending order of doc_id, read stripe by stripe, and pruned by file metadata.

Ids are stored as integers under ORC's run-length encoding. Stripes are bounded in bytes, row indexes in rows, and a Bloom filter on the document ids stands beside
the row index, so that a lookup of a few documents (``read_tokens`` with ``ids`` or a range) skips stripes and row groups by their minimum, maximum and
filter, while a whole read splits the files by stripes.

Texts are range-partitioned by doc_id, then by a hash of the text and by row, so that no id and no group of equal rows is bound to one task; each partition
is sorted, encoded as a stream and written as one file. A file's rows carry the number of its partition and the count of ids before them in the file; the place of a file
among all ids comes from one row a file.

Texts are encoded by the given tokenizer itself. One that drops white space and cannot merge across it is asked for distinct words alone (``by_word``), which
gives the same ids; tests compare with whole texts. The words of a few MB are found and told apart by Arrow, so that only distinct ones become Python objects. For the
tokenizer of ``default_file`` (and others of its normalizer and pre-tokenizer) words of printable ASCII and Latin-1 letters are cut into its pieces by one expression and go to its BPE model as
they are; all other words go through the whole tokenizer.

Defined cases: a null or empty text has the end id alone; a null doc_id comes first; rows that share a doc_id stand in the order of a hash of their text; an empty table gives an
empty folder's result; extra columns are not written. A text is split into words some MB at a time; its ids are one row, so a text may have 2^31 - 1 of them.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, partitions, spans_of

END = 2
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000
#: Bytes of distinct words that a worker process keeps from task to task; beyond, it starts anew.
KEPT_BYTES = 128 << 20
#: Words that are encoded in one call.
_CALL = 2000


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _PIECE}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words that NFC leaves as they are and of which each letter is known: printable ASCII and the letters from U+00C0 to U+00FF.
_PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
#: ``_PIECE`` for such words in lower case, and the line feed between two words.
_PLAIN_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^\na-z0-9ß-öø-ÿ]+")
#: The byte-level alphabet: bytes that stand for no printable character are moved behind U+0100.
_MOVED = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
_ALPHABET = {chr(b): chr(256 + i) for i, b in enumerate(_MOVED)}
_HIGH = re.compile("[\x7f-\xa0\xad]")


class Plain:
    """The BPE model of a tokenizer, given pieces between blanks; each piece's ids end with one that has the suffix of a word's end."""

    def __init__(self, parts: dict):
        from tokenizers import Tokenizer

        vocabulary, suffix = parts["model"]["vocab"], parts["model"]["end_of_word_suffix"]
        self.tokenizer = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.added = [t["content"].encode() for t in parts["added_tokens"]]

    @classmethod
    def of(cls, definition: str) -> Plain | None:
        """None, if the tokenizer's steps are not those that the expressions above stand for."""
        parts = json.loads(definition)
        model, added = parts["model"], parts["added_tokens"]
        same = parts["normalizer"] == _NORMALIZER and parts["pre_tokenizer"] == _PRE_TOKENIZER and model["type"] == "BPE" and not parts["truncation"] and not parts["padding"]
        same = same and model["end_of_word_suffix"] == "</w>" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "unk_token", "byte_fallback", "ignore_merges"))
        return cls(parts) if same and not any(t[k] for t in added for k in ("normalized", "single_word", "lstrip", "rstrip")) else None

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, sizes) of words that match ``_PLAIN``; None, if they hold an added token or the ends of the pieces cannot be told."""
        text = b"\n".join(words)
        if any(t in text for t in self.added):
            return None
        pieces = _PLAIN_PIECE.findall(text.decode().lower())
        number: defaultdict[str, int] = defaultdict(count().__next__)
        numbers = np.fromiter(map(number.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        # The line feed is no piece: it has no ids, and its number marks the ends of words.
        feed = number.pop("\n", -1)
        distinct = list(number)
        parts, ends, done = [], [], 0
        for k in range(0, len(distinct), _CALL):
            line = " ".join(distinct[k : k + _CALL])
            if not line.isascii():
                line = _HIGH.sub(lambda m: _ALPHABET[m[0]], line.encode().decode("latin-1"))
            (one,) = self.tokenizer.encode_batch_fast([line], add_special_tokens=False)
            ids = np.array(one.ids, dtype=np.int32)
            parts.append(ids)
            ends.append(done + np.flatnonzero(self.ends[ids]) + 1)
            done += len(ids)
        pool, stops = np.concatenate(parts), np.concatenate(ends)
        if len(stops) != len(distinct):
            return None
        sizes = np.diff(stops, prepend=0)
        if feed >= 0:
            stops, sizes = np.insert(stops, feed, 0), np.insert(sizes, feed, 0)
        each = sizes[numbers]
        upto = np.cumsum(each)
        ids = pool[np.repeat(stops[numbers] - upto, each) + np.arange(int(upto[-1]))]
        return ids, np.diff(upto[np.append(np.flatnonzero(numbers == feed), len(numbers) - 1)], prepend=0)


class Words:
    """The ids of distinct words, and where each word's begin and how many they are."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_str(definition), Plain.of(definition)
        whole = ((i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (t.normalized or t.single_word or t.lstrip or t.rstrip))
        self.mark_id, mark = next(whole, (None, None))
        self.mark = mark.content if mark else None
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.fresh: list[bytes] = []
        self.pool, self.bytes = np.zeros(0, dtype=np.int32), 0
        self.begin, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        before = len(self.number)
        out = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        new = list(islice(reversed(self.number), len(self.number) - before))[::-1]
        self.fresh += new
        self.bytes += sum(map(len, new)) + 100 * len(new)
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words in one call, between two of them an added token that none of them holds."""
        texts = [w.decode() for w in words]
        if self.mark and not any(self.mark in t for t in texts):
            (one,) = self.tokenizer.encode_batch_fast([self.mark.join(texts)], add_special_tokens=False)
            ids = np.array(one.ids, dtype=np.int32)
            cuts = np.flatnonzero(ids == self.mark_id)
            return np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        rows = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([x for r in rows for x in r], dtype=np.int32), np.array([len(r) for r in rows], dtype=np.int64)

    def learn(self) -> None:
        """Encode the words that have come since, many in one call."""
        fits = np.array([self.plain is not None and _PLAIN(w) is not None for w in self.fresh], dtype=bool)
        size, begin, parts, done = np.zeros(len(fits), dtype=np.int64), np.zeros(len(fits), dtype=np.int64), [self.pool], len(self.pool)
        for plain in (True, False):
            which = np.flatnonzero(fits == plain)
            step = _CALL * 100 if plain else _CALL
            for k in range(0, len(which), step):
                some = which[k : k + step]
                words = [self.fresh[i] for i in some]
                ids, sizes = (plain and self.plain.encode(words)) or self.encode(words)
                size[some], begin[some] = sizes, done + np.cumsum(sizes) - sizes
                parts.append(ids)
                done += len(ids)
        self.pool, self.fresh = np.concatenate(parts), []
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, size])

    def ids(self, numbers: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of texts of so many words each, with the end id behind each."""
        sizes = self.size[numbers]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = upto[np.cumsum(counts)]
        flat = self.pool[np.repeat(self.begin[numbers] - upto[:-1], sizes) + np.arange(int(upto[-1]))]
        return np.insert(flat, ends, end), np.diff(ends, prepend=0) + 1


_KNOWN: dict[int, Words] = {}


def words_kept(definition: str) -> Words:
    """The words that this worker process has met under a tokenizer."""
    key = zlib.crc32(definition.encode())
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = Words(definition)
    return _KNOWN[key]


def _values(words: pa.StringArray) -> list[bytes]:
    """The words as bytes; none of them holds a blank."""
    line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.view(pa.binary())), b" ")
    return line[0].as_buffer().to_pybytes().split(b" ") if len(words) else []


def _groups(raw: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(numbers of texts, stretches of them) of about CHUNK_BYTES; a longer text is cut at blanks."""
    texts, spans, size = [], [], 0
    for i, t in enumerate(raw):
        for span in spans_of(t):
            if spans and size + len(span) > CHUNK_BYTES:
                yield texts, spans
                texts, spans, size = [], [], 0
            texts.append(i)
            spans.append(span)
            size += len(span)
    if spans:
        yield texts, spans


def encoded(definition: str, raw: list[bytes], words: Words | None, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, their numbers), the end id behind each text. Without ``words`` whole texts go to the tokenizer."""
    if words is None:
        from tokenizers import Tokenizer

        rows = [np.array(e.ids, dtype=np.int32) for e in Tokenizer.from_str(definition).encode_batch_fast([t.decode() for t in raw], add_special_tokens=False)]
    else:
        if words.bytes > KEPT_BYTES:
            words.clear()
        parts, counts = [], np.zeros(len(raw), dtype=np.int64)
        for texts, spans in _groups(raw):
            split = pc.ascii_split_whitespace(pa.array(spans, pa.binary()).view(pa.string()))
            found = split.flatten().dictionary_encode()
            parts.append(words.numbers(_values(found.dictionary))[found.indices.to_numpy()])
            np.add.at(counts, texts, np.diff(split.offsets.to_numpy()))
        words.learn()
        return words.ids(np.concatenate([np.zeros(0, dtype=np.int64), *parts]), counts, end)
    last = np.array([end], dtype=np.int32)
    sizes = np.array([len(r) + 1 for r in rows], dtype=np.int64)
    return np.concatenate([x for r in rows for x in (r, last)] or [last[:0]]), sizes


def write_tokens(docs: DataFrame, path: str, file: str | None = None, end: int = END, by_word: bool = True, files: int | None = None) -> None:
    """Write the token ids of ``docs`` (doc_id, text) to ORC files in ``path``. The driver reads the tokenizer's file, some MB, and sends its content along."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Path(file or default_file()).read_text())
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.repartitionByRange(files or partitions(spark), "doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "_row").select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, at long, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, done, words = TaskContext.get().partitionId(), 0, words_kept(shared.value) if by_word else None
        for batch in chunks(batches, "text"):
            ids, sizes = encoded(shared.value, [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], words, end)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(sizes), part, dtype=np.int32)), pa.array(done + ends - sizes), lists], names=["doc_id", "part", "at", "ids"])
            done += int(ends[-1]) if len(ends) else 0

    out = rows.mapInArrow(run, schema).write.mode("overwrite").option("compression", "zstd")
    for k, v in {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01, "orc.create.index": "true", "orc.row.index.stride": INDEX_ROWS, "orc.stripe.size": STRIPE_BYTES}.items():
        out = out.option(k, v)
    out.orc(path)


def read_tokens(spark: SparkSession, path: str, kind: str = "long", ids: list[int] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, part, at, ids) of the files; of the documents ``ids``, or from ``low`` to ``high``, where given: these reach the files' metadata as filters."""
    rows = spark.read.schema(f"doc_id {kind}, part int, at long, ids array<int>").orc(path)
    if ids is not None:
        rows = rows.filter(F.col("doc_id").isin(ids))
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    return rows if high is None else rows.filter(F.col("doc_id") <= high)


def token_digests(files: DataFrame) -> DataFrame:
    """doc_id, part, at, n_tokens and the crc32 of the ids, from the files that ``read_tokens`` gives."""
    schema = f"doc_id {files.schema['doc_id'].dataType.simpleString()}, part int, at long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, ends = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B"), np.asarray(lists.offsets)
            crc = [zlib.crc32(values[4 * u : 4 * v]) for u, v in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, schema)


def token_report(digests: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 from ``token_digests``, which is read twice.

    The window runs over one row a file: as many as tasks wrote them.
    """
    files_in_order = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = digests.groupBy(F.col("part").alias("_part")).agg(F.sum("n_tokens").alias("total"))
    places = totals.select("_part", (F.sum("total").over(files_in_order) - F.col("total")).alias("before"))
    return digests.join(F.broadcast(places), F.col("part") == F.col("_part")).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
