"""Token-ID files: documents as token ids in independent Zstandard frames, with a seek table and checksums.

``write_token_files`` sorts the documents by id over range partitions and writes a file for each, or more files where one would be larger than ``FILE_BYTES``. A frame holds whole
documents; the record index of a file says for each document its frame, byte offset and number of ids. Readers
decompress only the frames of the documents that they are asked for.

Defined results: a null text is empty and gives only the end id; null ids come first; rows with equal ids come in the
order of their texts; an empty table gives no file. Other columns are ignored. A name of an added token in a text, such as <|endoftext|>, gives
the one id that the library's plain call gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.llm.arrays import chunks
from barspark.llm.frames import FrameReader, FrameWriter
from barspark.llm.shared import kept, new_folder

FRAME_BYTES, FILE_BYTES = 1 << 20, 1 << 30
ENTRY = np.dtype([("id", "<i8"), ("known", "u1"), ("width", "u1"), ("frame", "<u4"), ("offset", "<u8"), ("count", "<u8")])
MANIFEST = "part int, file int, path string, n_docs long, n_ids long"
#: Ids of pieces that a Python worker remembers within a task, and from one task to the next: a worker may serve other operators then.
REMEMBERED, REMEMBERED_AFTER = 1_000_000, 300_000
#: Bytes of texts whose new words go to the tokenizer's model in one call.
LEARNED_BYTES = 1 << 20
#: Latin letters, and marks after them. Every version of Unicode has these as letters, so with the space before them they are one piece to the tokenizer, and the
#: marks are another. An apostrophe may be part of a contraction and is no such mark.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch
#: The characters by which a byte-level vocabulary writes the bytes: printable ones of Latin-1 as they are, the others from U+0100 on. A line feed stays, to part words.
_BYTE_CHARS = np.arange(256)
_BYTE_CHARS[[b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]] = range(256, 324)
_BYTE_CHARS[10] = 10


class PieceIds(dict):
    """Ids of text pieces, made by the tokenizer at first sight. A piece is a word with the space before it, which is left out, or with a line feed."""

    def __init__(self, tokenizer, width: np.dtype):
        from tokenizers import pre_tokenizers

        super().__init__()
        self.tokenizer, self.width = tokenizer, width
        self.plain = type(tokenizer)(tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.begins[[i for token, i in vocab.items() if token[:1] == "\u0120"]] = True
        self.first: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.width).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if piece[:1] == "\n" and _WORD(piece, 1):
            ids = self.start("\n") + self.start(piece[1:])
        else:
            ids = self.encode(piece if piece[:1] == "\n" else " " + piece)
        self[piece] = ids
        return ids

    def learn(self, new: set[str]) -> None:
        """Have the model make the ids of all new words of letters in one call; they are told apart by the mark of the space before each."""
        if len(self) >= REMEMBERED:
            self.clear()
        words, marked, stems, marks = set(), [], [], []
        for piece in new:
            if m := _WORD(piece):
                words.add(m[1])
                if m[2]:
                    marked.append(piece)
                    stems.append(m[1])
                    marks.append(m[2])
        words = [w for w in words if w not in self]
        if not words:
            return
        raw = np.frombuffer((" " + "\n ".join(words)).encode(), dtype=np.uint8)
        shown = _BYTE_CHARS[raw].astype("<u2").tobytes().decode("utf-16-le")
        ids = np.array(self.plain.encode_batch_fast([shown], add_special_tokens=False)[0].ids, dtype=self.width)
        at = np.flatnonzero(self.begins[ids]) * self.width.itemsize
        if len(at) == len(words):  # else the vocabulary has no such marks, and words are encoded one by one
            raw, at = ids.tobytes(), [*at.tolist(), None]
            self.update(zip(words, [raw[a:b] for a, b in zip(at, at[1:])]))
            self.update((piece, self[w] + self.start(x)) for piece, w, x in zip(marked, stems, marks))

    def end_task(self) -> None:
        """Give the memory of many pieces back; the words seen first, which most of the frequent ones are among, stay."""
        if len(self) > REMEMBERED_AFTER:
            words = dict(islice(((p, ids) for p, ids in self.items() if p[-1:].isalpha()), REMEMBERED_AFTER))
            self.clear()
            self.update(words)
        if len(self.first) > REMEMBERED_AFTER:
            self.first.clear()

    def start(self, piece: str) -> bytes:
        """Ids of a piece that has no space before it."""
        if piece not in self.first:
            if len(self.first) >= REMEMBERED:
                self.first.clear()
            self.first[piece] = self.encode(piece) if piece else b""
        return self.first[piece]


#: White space before a space or line feed: there, pieces can't be cut.
_RUN = re.compile("[\\s᠎﻿][ \n]")
#: In a text of ASCII, these are all that such a run can begin with or be.
_ASCII_RUNS = ("  ", " \n", "\n ", "\n\n", *"\t\v\f\r\x1c\x1d\x1e\x1f")


def _may_have_runs(text: str) -> bool:
    """False only where ``_RUN`` finds nothing; much quicker than that for ASCII."""
    return not text.isascii() or any(run in text for run in _ASCII_RUNS)


@lru_cache(maxsize=2)
def _encoder(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    width = np.dtype("<u2") if tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
    pieces = PieceIds(tokenizer, width)

    def cut(text: str) -> list[str]:
        """The tokenizer splits a text before every space or line feed that follows a non-space anyway, so the ids of the text are those of its pieces."""
        if _may_have_runs(text) and _RUN.search(text) or any(name in text for name in added):
            return [text]
        return text.replace("\n", " \n").split(" ")

    def encode_all(texts: list[str]) -> Iterator[bytes]:
        parts = [cut(text) for text in texts]
        first = [own.pop(0) for own in parts]
        known = [list(map(pieces.get, own)) for own in parts]
        pieces.learn({p for own, found in zip(parts, known) for p, ids in zip(own, found) if ids is None})
        for head, own, found in zip(first, parts, known):
            if own:
                yield pieces.start(head) + b"".join([pieces[p] if ids is None else ids for p, ids in zip(own, found)])
            else:
                yield pieces.encode(head) if len(head) > 40 else pieces.start(head)

    def encode(text: str) -> bytes:
        return next(encode_all([text]))

    encode.all, encode.end_task = encode_all, pieces.end_task
    return encode, width


def encoded(tokenizer_path: str):
    """(text -> bytes of ids, dtype of an id) for a byte-level BPE file that cuts words at spaces. Names of added tokens are one id each, as in the library's plain call."""
    return _encoder(tokenizer_path)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the documents in ascending id order; return the manifest: part, file (its number in the part), path, n_docs, n_ids of each file."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = encoded(tokenizer_path)
        end = np.array([end_id], dtype=width).tobytes()
        part, file, out = TaskContext.get().partitionId(), 0, None
        index, frame, filled, total = [], [], 0, 0

        def done() -> pa.RecordBatch:
            nonlocal file, out, index, frame, filled, total
            if frame:
                out.add(b"".join(frame))
            path = out.close(np.array(index, dtype=ENTRY).tobytes())
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([file], pa.int32()), "path": [path], "n_docs": pa.array([len(index)], pa.int64()), "n_ids": pa.array([total // width.itemsize], pa.int64())})
            file, out, index, frame, filled, total = file + 1, None, [], [], 0, 0
            return row

        runs = ((batch["id"].slice(lo, hi - lo), batch["text"].slice(lo, hi - lo)) for batch in batches for lo, hi, _, _ in chunks(batch["text"], LEARNED_BYTES))
        for keys, texts in runs:
            for i, ids in zip(keys.to_pylist(), encode.all(texts.to_pylist())):
                out = out or FrameWriter(folder, f"tokens-{part:06d}-{file:04d}")
                ids += end
                index.append((i or 0, i is not None, width.itemsize, len(out.table), filled, len(ids) // width.itemsize))
                frame.append(ids)
                filled += len(ids)
                total += len(ids)
                if filled >= frame_bytes:
                    out.add(b"".join(frame))
                    frame, filled = [], 0
                if total >= file_bytes:
                    yield done()
        if out:
            yield done()
        encode.end_task()

    return kept(rows.mapInArrow(write, MANIFEST), "manifest")


def documents_of(path: str, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(id, ids before it in the file, its ids) of the wanted documents of one file, or of all."""
    reader = FrameReader(path)
    index = np.frombuffer(reader.index(), dtype=ENTRY)
    before = np.cumsum(index["count"]) - index["count"]
    for row, start in zip(index, before):
        i = int(row["id"]) if row["known"] else None
        if wanted is None or i in wanted:
            data, size = reader.frame(int(row["frame"])), int(row["width"])
            at = int(row["offset"])
            yield i, int(start), np.frombuffer(data, dtype=f"<u{size}", count=int(row["count"]), offset=at)
    reader.close()


def _files(manifest: DataFrame) -> DataFrame:
    """A row, and a task, for each file, with the ids of all files before it. The manifest has a row for each file only."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    rows = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return rows.repartition(max(1, manifest.count()))


def read_token_files(manifest: DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids array of the wanted documents (a small set of ids), or of all."""

    def read(batches):
        for batch in batches:
            for path, before in zip(batch["path"].to_pylist(), batch["before"].to_pylist()):
                rows, held = [], 0
                for i, start, ids in documents_of(path, wanted):
                    rows.append({"doc_id": i, "start": before + start, "ids": ids.astype(np.int32)})
                    held += len(ids)
                    if held > 1 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _files(manifest).mapInArrow(read, "doc_id long, start long, ids array<int>")


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of every document, read from the files."""

    def read(batches):
        import zlib

        for batch in batches:
            for path, before in zip(batch["path"].to_pylist(), batch["before"].to_pylist()):
                rows = [(i, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, start, ids in documents_of(path)]
                for lo in range(0, len(rows), 10_000):
                    columns = zip(*rows[lo : lo + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _files(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write all documents into a new shared folder and return the digests read back from the files."""
    spark: SparkSession = docs.sparkSession
    return read_digests(write_token_files(docs, new_folder(spark, "tokens"), tokenizer_path, end_id))
