"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put in another order, by a secondary sort of pieces.

``make_pieces`` cuts each text at two line ends and emits its three parts in pieces of whole lines (a longer line in
several), keyed by document and place in the output; the markers are pieces of their own. ``assemble`` deals pieces by
document and sorts each partition by document and place, so that a document's output runs past as a stream: no text is
put together in memory. ``digest_outputs`` feeds the stream to an incremental digest and, reading the markers in it,
gives every piece its place in the original; a second sort within the same partitions, without a shuffle, restores the
texts as streams, which ``digest_restored`` digests. ``output_texts`` puts the outputs together as texts.

The repartition with a sort within partitions is the DataFrame form of repartitionAndSortWithinPartitions: rows stay in
the JVM's sorter, which spills.

Defined results: a null text is empty; an empty text and one that holds a marker stay as they are (form plain); a null
id counts as an empty number. Rows with equal ids are documents of their own, equal rows too: pieces carry the input
partition and the row's number in it. Other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The markers, and the order of the parts (0 prefix, 1 middle, 2 suffix) in each form.
MARKERS = (b"<P>", b"<M>", b"<S>")
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
#: Bytes of a piece, at most; rows of an Arrow batch.
PIECE_BYTES, BATCH_ROWS = 1 << 16, 4096
#: Rows of a document share these. The first one (place 0, or -1 of the restored order) is a header without a piece.
KEY = ["key", "part", "nth"]
HEADER = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
PIECES = pa.schema([
    ("key", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()),
    ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("piece", pa.binary()),
])
PIECES_DDL = "key long, part int, nth long, place long, doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, piece binary"
#: Places of a part in the restored order begin at a multiple of this.
_PART = 1 << 40


def _numbers(doc_id: int | None, seed: int) -> list[int]:
    """The first four 8-digit groups of the sha256 of seed:doc_id."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(text[i : i + 8], 16) for i in range(0, 32, 8)]


def _chars(data: bytes) -> int:
    """Code points of UTF-8 text."""
    return int(np.count_nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))


def cut(data: bytes, doc_id: int | None, seed: int, fim_percent: int, spm_percent: int) -> tuple[int, str, tuple[bytes, bytes, bytes]]:
    """(number of lines, form, (prefix, middle, suffix)) of a text; all of a plain one is its prefix."""
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    if data and not data.endswith(b"\n"):
        ends = np.append(ends, len(data))
    n = len(ends)
    h1, h2, h3, h4 = _numbers(doc_id, seed)
    if not data or any(m in data for m in MARKERS) or h3 % 100 >= fim_percent:
        return n, "plain", (data, b"", b"")
    offsets = np.append(0, ends)
    low, high = sorted((int(offsets[h1 % (n + 1)]), int(offsets[h2 % (n + 1)])))
    return n, "spm" if h4 % 100 < spm_percent else "psm", (data[:low], data[low:high], data[high:])


def _in_pieces(data: bytes) -> Iterator[bytes]:
    """Pieces of whole lines of up to PIECE_BYTES; a longer line is cut."""
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        if end < len(data):
            end = data.rfind(b"\n", at, end) + 1 or end
        yield data[at:end]
        at = end


class _Rows:
    """Rows of PIECES, gathered into batches."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, key: tuple, place: int, header: tuple = (None,) * 5, output_sha256: str | None = None, piece: bytes | None = None) -> None:
        self.rows.append((*key, place, *header, output_sha256, piece))

    def full(self) -> bool:
        return len(self.rows) >= BATCH_ROWS

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in PIECES]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)


def make_pieces(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A header row and the output's pieces, compressed, of each document."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        markers = [pack(m) for m in MARKERS]
        part, nth, out = TaskContext.get().partitionId(), 0, _Rows()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                data = text.as_buffer().to_pybytes()
                # Documents are dealt by content, so that they go where they went if a lost task runs again over rows in another order.
                digest = hashlib.blake2b(data, digest_size=8, key=str(doc_id).encode()).digest()
                key = (int.from_bytes(digest, "little", signed=True), part, nth)
                n, form, parts = cut(data, doc_id, seed, fim_percent, spm_percent)
                plain = form == "plain"
                out.add(key, 0, (doc_id, n, form, *((None, None) if plain else (_chars(parts[0]), _chars(parts[1])))))
                place = 0
                for p in (0,) if plain else ORDERS[form]:
                    for piece in ([] if plain else [markers[p]]):
                        out.add(key, place := place + 1, piece=piece)
                    for piece in _in_pieces(parts[p]):
                        out.add(key, place := place + 1, piece=pack(piece))
                        if out.full():
                            yield out.batch()
                nth += 1
        yield out.batch()

    return rows.mapInArrow(run, PIECES_DDL)


def assemble(pieces: DataFrame) -> DataFrame:
    """The pieces, those of a document together and in the order of the output."""
    return pieces.repartition("key", "part").sortWithinPartitions(*KEY, "place")


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple | None, str | None, bytes | None]]:
    """(key, header or None, output_sha256, piece) of each row of sorted pieces, decompressed."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        keys = zip(*(batch[c].to_pylist() for c in KEY))
        headers = zip(*(batch[c].to_pylist() for c in HEADER))
        for key, header, sha, piece in zip(keys, headers, batch["output_sha256"].to_pylist(), batch["piece"]):
            data = piece.as_py()
            yield key, header if data is None else None, sha, None if data is None else unpack(data)


def digest_outputs(assembled: DataFrame) -> DataFrame:
    """The pieces with their places in the original, which follow from form and markers; the header has place -1 and the output's digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        out, key, header, digest, part, place = _Rows(), None, None, None, 0, 0
        for own, new, _, data in _documents(batches):
            if new is not None:
                if header is not None:
                    out.add(key, -1, header, digest.hexdigest())
                key, header, digest, part, place = own, new, hashlib.sha256(), 0, 0
            else:
                digest.update(data)
                if header[2] != "plain" and data in MARKERS:
                    part = MARKERS.index(data)
                else:
                    out.add(key, part * _PART + (place := place + 1), piece=pack(data))
            if out.full():
                yield out.batch()
        if header is not None:
            out.add(key, -1, header, digest.hexdigest())
        yield out.batch()

    return assembled.mapInArrow(run, PIECES_DDL)


def digest_restored(placed: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of each document. The sort stays within the partitions that assemble has made."""
    kind = pa.schema([f for f in PIECES if f.name in (*HEADER, "output_sha256")]).append(pa.field("restored_sha256", pa.string()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, header, digest = [], None, None

        def batch() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in kind]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

        for _, new, sha, data in _documents(batches):
            if new is not None:
                if header is not None:
                    rows.append((*header, digest.hexdigest()))
                if len(rows) >= BATCH_ROWS:
                    yield batch()
                    rows = []
                header, digest = (*new, sha), hashlib.sha256()
            else:
                digest.update(data)
        if header is not None:
            rows.append((*header, digest.hexdigest()))
        yield batch()

    ddl = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return placed.sortWithinPartitions(*KEY, "place").mapInArrow(run, ddl)


def output_texts(assembled: DataFrame) -> DataFrame:
    """doc_id, form, text: the outputs as texts, each of which a task holds while it puts it together."""
    kind = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header, text = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((header[0], header[2], b"".join(text).decode()), kind)], schema=kind)

        for _, new, _, data in _documents(batches):
            if new is not None:
                if header is not None:
                    yield row()
                header, text = new, []
            else:
                text.append(data)
        if header is not None:
            yield row()

    return assembled.mapInArrow(run, "doc_id long, form string, text string")


def fill_in_middle(docs: DataFrame, **options) -> DataFrame:
    """Digests of each document's output and of the text restored from it."""
    return digest_restored(digest_outputs(assemble(make_pieces(docs, **options))))
