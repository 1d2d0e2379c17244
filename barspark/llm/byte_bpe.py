"""Byte-level BPE by a rank file: encoding by replaying the merges over a corpus of words, and decoding.

The words of a block of texts (the matches of the pattern) are gathered once each. An inverted index leads from the rank
of a pair of neighbouring tokens to the places where the pair stands in those words. The ranks are taken in ascending
order; each merges its pairs at all places at once, and only the pairs to the left and right of a merged place are
looked up anew and entered into the index. The result of a word depends on the word only, so blocks, tasks and the
words that a worker remembers from earlier blocks do not change it, and no text leaves its task.

A word that is a token as a whole gets that token, as in the library. A merge may make a pair of a lower rank than its
own; that pair then comes first, in that word, before its other pairs of the rank.

Defined results: a null text is empty and has no ids; ids of documents may be null or repeat; an empty table gives an
empty one; other columns are ignored, whatever their names. A text of any length is encoded as a whole.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text, and new words, that are encoded together; words that a worker remembers.
BLOCK_CHARS, BLOCK_WORDS, REMEMBERED = 4_000_000, 150_000, 300_000
#: Longer texts are cut into words one by one.
LONG_TEXT = 1_000_000
#: No such pair.
NONE = np.iinfo(np.int64).max
ENCODED = "doc_id long, n_tokens long, ids binary"


@lru_cache(maxsize=2)
def read_tokens(path: str) -> dict[int, bytes]:
    """The tokens of a rank file by rank; it has a line for each, of its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}


class Ranks:
    """The ranks of the tokens of a rank file, and the pairs of tokens that make a token."""

    def __init__(self, path: str):
        self.rank = {t: r for r, t in read_tokens(path).items()}
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        self.base = max(self.rank.values()) + 2  # one more than any rank, for the end of a word
        halves = ((t[:i], t[i:], r) for t, r in self.rank.items() for i in range(1, len(t)))
        pairs = np.array(sorted((self.rank[a] * self.base + self.rank[b], r) for a, b, r in halves if a in self.rank and b in self.rank))
        self.pairs, self.made = pairs[:, 0].copy(), pairs[:, 1].copy()
        #: Tokens that are part of a token of a lower rank.
        late = np.maximum(self.pairs // self.base, self.pairs % self.base) > self.made
        self.early = set(np.maximum(self.pairs // self.base, self.pairs % self.base)[late].tolist())

    def made_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the tokens that the pairs make, or NONE."""
        pairs = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.made[at], NONE)


def _without_overlap(places: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of runs of places whose second token is the first of the next place, every other place from the left."""
    clash = np.concatenate([[False], second[:-1] == places[1:]])
    if not clash.any():
        return places
    order = np.arange(len(places))
    begin = np.maximum.accumulate(np.where(clash, 0, order))
    return places[(order - begin) % 2 == 0]


class Replay:
    """The tokens of a list of words, as linked places in one array, while the merges are applied."""

    def __init__(self, ranks: Ranks, words: list[bytes]):
        self.ranks = ranks
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        n = self.end = int(lengths.sum())
        self.word = np.repeat(np.arange(len(words)), lengths)
        # The place after the last one stands for both ends of all words.
        self.token = np.append(ranks.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)], ranks.base - 1)
        self.next, self.before = np.arange(1, n + 2), np.arange(-1, n)
        last = np.cumsum(lengths) - 1
        self.next[last], self.before[last + 1], self.before[:1], self.next[n] = n, n, n, n
        self.pair = np.append(ranks.made_of(self.token[:-1], self.token[self.next[:-1]]), NONE)
        self.index: dict[int, list[np.ndarray]] = {}
        self.waiting: list[int] = []
        self._enter(np.arange(n))

    def _enter(self, places: np.ndarray) -> None:
        """Put the places into the index by the ranks of their pairs."""
        made = self.pair[places]
        places, made = places[made != NONE], made[made != NONE]
        if not len(places):
            return
        order = np.argsort(made, kind="stable")
        places, made = places[order], made[order]
        cuts = np.flatnonzero(made[1:] != made[:-1]) + 1
        for rank, group in zip(made[np.append(0, cuts)].tolist(), np.split(places, cuts)):
            if rank in self.index:
                self.index[rank].append(group)
            else:
                self.index[rank] = [group]
                heapq.heappush(self.waiting, rank)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        while self.waiting:
            rank = heapq.heappop(self.waiting)
            groups = self.index.pop(rank)
            places = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            places = places[self.pair[places] == rank]
            if len(places):
                self._merge(rank, places)
        left = self.token[:-1] >= 0
        return self.token[:-1][left].astype("<u4"), np.bincount(self.word[left], minlength=int(self.word[-1]) + 1 if len(self.word) else 0)

    def _first_turn(self, rank: int, places: np.ndarray) -> np.ndarray:
        """Of the places, those up to the first in each word whose merge makes a pair of a lower rank: that pair comes before the others, which wait."""
        own = _without_overlap(places, self.next[places])
        gone, left = self.next[own], self.before[own]
        merged_left = np.concatenate([[False], left[1:] == gone[:-1]])
        lower = np.minimum(
            self.ranks.made_of(np.where(merged_left, rank, self.token[left]), np.full(len(own), rank)),
            self.ranks.made_of(np.full(len(own), rank), self.token[self.next[gone]]),
        ) < rank
        if not lower.any():
            return own
        words, first = np.unique(self.word[own[lower]], return_index=True)
        last = np.full(int(self.word[-1]) + 1, self.end)
        last[words] = own[lower][first]
        waits = places[places > last[self.word[places]]]
        if len(waits):
            self.index[rank] = [waits]
            heapq.heappush(self.waiting, rank)
        return own[own <= last[self.word[own]]]

    def _merge(self, rank: int, places: np.ndarray) -> None:
        places = self._first_turn(rank, places) if rank in self.ranks.early else _without_overlap(places, self.next[places])
        gone = self.next[places]
        after = self.next[gone]
        self.token[places], self.token[gone], self.pair[gone] = rank, -1, NONE
        self.next[places], self.before[after] = after, places
        self.before[self.end] = self.end
        left = self.before[places]
        touched = np.unique(np.concatenate([places, left[left < self.end]]))
        self.pair[touched] = self.ranks.made_of(self.token[touched], self.token[self.next[touched]])
        self._enter(touched)


class Encoder:
    """Encodes blocks of texts; remembers the words of earlier blocks."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks, self.pattern = Ranks(path), regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.counts = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)

    @property
    def new_words(self) -> int:
        return len(self.number) - len(self.counts)

    def words(self, text: str) -> array:
        """The numbers of the words of a text; new words get the next numbers."""
        found = (m.group() for m in self.pattern.finditer(text)) if len(text) > LONG_TEXT else self.pattern.findall(text)
        return array("I", map(self.number.__getitem__, found))

    def learn(self) -> None:
        """Replay the merges over the words that are new."""
        new = [w.encode() for w in list(self.number)[len(self.counts) :]]
        rank = self.ranks.rank
        whole = np.array([rank.get(w, -1) for w in new], dtype=np.int64)
        counts = np.ones(len(new), dtype=np.int64)
        merged, counts[whole < 0] = Replay(self.ranks, [w for w, r in zip(new, whole) if r < 0]).run()
        ids = np.empty(int(counts.sum()), dtype="<u4")
        own = np.repeat(whole, counts)
        ids[own >= 0], ids[own < 0] = own[own >= 0], merged
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])

    def encode(self, texts: list[array]) -> list[np.ndarray]:
        """The ids of texts that are given as numbers of words."""
        if self.new_words:
            self.learn()
        words = np.concatenate([np.frombuffer(t, dtype=np.uintc) for t in texts]).astype(np.int64)
        start, counts = np.cumsum(self.counts) - self.counts, self.counts[words]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(start[words] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.append(0, ends)[np.cumsum([len(t) for t in texts])]
        if len(self.number) > REMEMBERED:
            self.forget()
        return np.split(ids, cuts[:-1])


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of each document."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, texts, chars = _encoder(ranks_path, pattern), [], [], 0

        def done() -> pa.RecordBatch:
            ids = encoder.encode(texts)
            columns = [pa.array(held, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array((i.tobytes() for i in ids), pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids"])

        for batch in batches:
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_py()
                held.append(i)
                texts.append(encoder.words(text))
                chars += len(text)
                if chars >= BLOCK_CHARS or encoder.new_words >= BLOCK_WORDS:
                    yield done()
                    held, texts, chars = [], [], 0
        if held:
            yield done()

    return rows.mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded with decoded, the bytes of the ids (null ids: null). An id that is no token raises KeyError."""
    columns = ["doc_id", "n_tokens", "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = read_tokens(ranks_path)
        for batch in batches:
            found = [None if x is None else b"".join(map(token.__getitem__, np.frombuffer(x, dtype="<u4").tolist())) for x in (x.as_py() for x in batch["ids"])]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(found, pa.binary())], names=[*columns, "decoded"])

    return encoded.select(*columns).mapInArrow(run, f"{ENCODED}, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what decode returns."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
