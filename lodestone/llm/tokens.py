"""Whole texts to token ids with a public vocabulary, and flat token files.

The vocabulary's normaliser turns white space into separators that no token crosses, so a text's ids are the ids of its
space-separated pieces in a row. Each task keeps the ids of pieces that it has met, as packed bytes, and asks the
tokenizer only for new ones; the memory of this table is bounded by ``CACHE_PIECES``.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch, open_files

VOCABULARY = "word_bpe_49k.json"
CACHE_PIECES = 1_200_000
#: Bytes of text that one task turns into one file, at most about; and at least, where there are more cores than files.
FILE_BYTES, LEAST_BYTES = 1 << 28, 1 << 23
#: A piece of at least this many characters is encoded alone and not kept.
LONG_PIECE = 64
#: Beyond these characters lower-casing may depend on neighbours or meet the normaliser's composition, or cutting at white
#: space needs care: U+001C to U+001F are white space to Python and none to the normaliser.
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u024f]")
_CONTROL = "\x1c\x1d\x1e\x1f"
_SPECIAL = "<|"
#: Marks behind a word that are a word of their own, all of a run. An apostrophe may begin another.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_WHITE = re.compile("[^\\S\x1c-\x1f]+")
_open: dict[str, PieceIds] = {}


def _letters(piece: str) -> bool:
    """Whether the normaliser leaves letters alone: then they are one word, which no punctuation joins. Some letters, as U+0130, become a letter and a mark."""
    return piece.isalpha() and (piece.isascii() or unicodedata.normalize("NFC", piece).lower().isalpha())


def _plain(text: str) -> bool:
    if any(c in text for c in _CONTROL):
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _NOT_PLAIN.search(text)
    return True


class PieceIds(dict):
    """Ids of white-space separated pieces, as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        super().__init__()
        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(str(path))
        size = self.tokenizer.get_vocab_size()
        self._ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self._ends[i] = token.endswith("</w>")

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(_TAIL)
        if len(word) < len(piece) and _letters(word):
            ids = self[word] + self[piece[len(word) :]]
            if len(piece) < LONG_PIECE:
                self[piece] = ids
            return ids
        ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        if len(piece) < LONG_PIECE:
            self[piece] = ids
        return ids

    def learn(self, pieces: set[str]) -> None:
        """Encodes many new pieces in a few calls: words of letters, each of which ends with a word-end token, in a row, and others one by one."""
        if len(self) + len(pieces) > CACHE_PIECES:
            self.clear()
        ended, words, others = [], set(), []
        for p in pieces.difference(self):
            if len(p) < LONG_PIECE:
                word = p.rstrip(_TAIL)
                if not _letters(word):
                    others.append(p)
                    continue
                words.add(word)
                if len(word) < len(p):
                    ended.append((p, word))
        new = [w for w in words if w not in self]
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(part):
                raw, cut = ids.tobytes(), (ends * 4).tolist()
                self.update(zip(part, (raw[a:b] for a, b in zip([0, *cut], cut)), strict=False))
        for k in range(0, len(others), 4096):
            part = others[k : k + 4096]
            self.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True))
        for p, word in ended:
            self[p] = self[word] + self[p[len(word) :]]

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text whose special tokens, if any, are none; in lower case where that changes no id."""
        if _plain(text):
            return text.lower().split()
        return [p for p in _WHITE.split(text) if p] if any(c in text for c in _CONTROL) else text.split()

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text, as packed bytes."""
        if not text:
            return b""
        if _SPECIAL in text:  # special tokens may stand inside a piece
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, self.pieces(text)))


def piece_ids(vocabulary: str) -> PieceIds:
    """One table for each Python worker, kept from task to task."""
    if vocabulary not in _open:
        _open[vocabulary] = PieceIds(vocabulary)
    return _open[vocabulary]


def encoded(batch: pa.RecordBatch, vocabulary: str) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, packed ids) of a batch of (doc_id, text)."""
    known = piece_ids(vocabulary)
    ids = batch.column("doc_id").to_pylist()
    texts = batch.column("text")
    for k in range(0, len(ids), 500):
        part = texts.slice(k, 500).to_pylist()
        split = [known.pieces(t) if t and _SPECIAL not in t else None for t in part]
        known.learn(set(chain.from_iterable(own for own in split if own)))
        for i, t, own in zip(ids[k : k + 500], part, split, strict=True):
            yield i, known.ids(t) if own is None else b"".join(map(known.__getitem__, own))


# --- token files ---------------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, root: str, end_id: int, vocabulary: str = VOCABULARY, files: int | None = None) -> DataFrame:
    """Encodes every whole text and writes flat files below ``root``, in ascending doc_id order over all files.

    Returns one row per file: ``file``, ``first_id``, ``n_docs``, ``n_tokens``, and ``base``, the number of tokens in the files
    before it. ``<file>.bin`` has the ids as little-endian unsigned integers (16 bits where the vocabulary allows it, else 32),
    ``<file>.idx`` has for each document doc_id and the place of its first id in the file, both 64 bits. Documents are dealt by
    range of doc_id, so a task holds one file's ids at most in its buffer of a few MB; a task that runs twice writes under
    another name first and then renames, and the rows returned by the task that counts name the files.

    Null text: only the end id. Null doc_id: comes first, stored as -2**63. Repeated doc_ids: each row has its own entry,
    in order of the text. No rows: no files. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if not files:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(-(-size // FILE_BYTES), min(-(-size // LEAST_BYTES), 4 * spark.sparkContext.defaultParallelism), 1)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = open_files(root)
        name = f"part-{TaskContext.get().partitionId():06d}"
        attempt = f"{base}/.{name}-{uuid.uuid4().hex}"
        sink, index, first, n_docs, n_tokens = None, [], None, 0, 0
        for batch in batches:
            for doc_id, ids in encoded(batch, vocabulary):
                if sink is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(f"{attempt}.bin", buffer_size=1 << 22)
                    where = fs.open_output_stream(f"{attempt}.idx", buffer_size=1 << 20)
                    wide = "<u2" if piece_ids(vocabulary).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
                    first = doc_id
                packed = np.frombuffer(ids + end, "<u4")
                sink.write(packed.astype(wide).tobytes())
                where.write(np.array([-(2**63) if doc_id is None else doc_id, n_tokens], "<i8").tobytes())
                n_docs += 1
                n_tokens += len(packed)
        if sink is not None:
            sink.close()
            where.close()
            final = f"{name}-{os.path.basename(attempt)[-32:]}"
            for ext in ("bin", "idx"):
                fs.move(f"{attempt}.{ext}", f"{base}/{final}.{ext}")
            yield pa.RecordBatch.from_pydict({"file": [final], "width": [int(wide[-1])], "part": [int(name[5:])], "first_id": pa.array([first], pa.int64()), "n_docs": [n_docs], "n_tokens": [n_tokens]})

    scratch = Scratch(spark, "token-files")
    dealt = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = scratch.table(dealt.mapInArrow(write, "file string, width long, part long, first_id long, n_docs long, n_tokens long"), "files")
    # One row a file: the prefix sums over them are the files' bases.
    parts = sorted(written.collect(), key=lambda r: r.part)
    bases, at = [], 0
    for r in parts:
        bases.append((r.file, r.width, r.first_id, r.n_docs, r.n_tokens, at))
        at += r.n_tokens
    return spark.createDataFrame(bases, "file string, width long, first_id long, n_docs long, n_tokens long, base long")


def read_token_files(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """One row per document out of the files: doc_id, start (ids of all documents before it), n_tokens, ids (packed 32-bit).

    Local and mounted files are memory-mapped; from another store the same bytes are read by range.
    """
    n = max(manifest.count(), 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_files(root)
        for batch in batches:
            for m in batch.to_pylist():
                with fs.open_input_file(f"{base}/{m['file']}.idx") as f:
                    index = np.frombuffer(f.readall(), "<i8").reshape(-1, 2)
                starts = np.append(index[:, 1], m["n_tokens"])
                path, kind = f"{base}/{m['file']}.bin", np.dtype(f"<u{m['width']}")
                flat = np.memmap(path, kind, "r") if fs.type_name == "local" else None
                source = None if flat is not None else fs.open_input_file(path)
                for k in range(0, len(index), 256):
                    cut, ids = starts[k : k + 257], []
                    for a, b in zip(cut[:-1], cut[1:], strict=True):
                        part = flat[a:b] if flat is not None else np.frombuffer(source.read_at((b - a) * kind.itemsize, a * kind.itemsize), kind)
                        ids.append(part.astype("<u4").tobytes())
                    who = index[k : k + 256, 0]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(who, pa.int64(), mask=who == -(2**63)), "start": pa.array(cut[:-1] + m["base"], pa.int64()), "n_tokens": pa.array(np.diff(cut), pa.int64()), "ids": pa.array(ids, pa.binary())})

    return manifest.repartition(n, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def crc_of_ids(df: DataFrame) -> DataFrame:
    """``df`` with ``ids_crc32`` (long) of the packed ``ids`` in place of ``ids``."""
    return df.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def crc32(packed: bytes) -> int:
    return zlib.crc32(packed)
