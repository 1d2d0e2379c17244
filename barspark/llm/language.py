"""Language identification by prediction by partial matching.

For each language, a tree of byte contexts of up to ``ORDER`` bytes with counts. A byte costs -log2 of its share in the longest
context that has seen it; each context that has not costs an escape (escape probability distinct / (distinct + count)),
and after the shortest every byte is equally likely. The statistics are frozen before scoring, so the code length of a text
is exact and does not depend on other texts. The language of least code length wins; the score compares it with the others.

Texts are lower-cased, and each run of other than letters (Unicode category L) is one space, with one space before and behind. ``ORDER`` zero bytes
stand before each text as the contexts of its first bytes, so that every byte is charged, the first ones too.

The trees are learned from at most ``TRAIN_DOCS`` labelled documents of each language, chosen by a hash of id, text and the number of the copy (whole texts), so the model is
of bounded size for a fixed set of languages and rows that share an id, or all they have, are chosen one by one; every document is scored. Documents whose crc32(doc_id as text) mod 5 is 0, that have no label, or no id, are never learned from.

Defined results: null texts and texts without a letter (½, Ⅷ and ² are none) are ``und`` with score 0; a null id counts as held out; rows are scored one by one, so ids
may repeat; without any labelled document every prediction is ``und``; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.shared import kept, number_copies

ORDER = 3
TRAIN_DOCS = 1500
HELD_OUT = 5
CHUNK = 1 << 20

#: Numbers such as ½, ² and Ⅷ, which \w holds though they are neither letters nor digits. They have patterns of their own, up to U+FFFF and beyond it, as a pattern is fast only if it names plain characters.
_NUMBERS = "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_NUMBER, _WIDE_NUMBER = (re.compile(f"[{''.join(c for c in _NUMBERS if (c > chr(0xFFFF)) == wide)}]") for wide in (False, True))
_WIDE = re.compile("[\U00010000-\U0010ffff]")
_OTHER = re.compile(r"[\W\d_]+")
_START = "\0" * ORDER


def normal(text: str) -> bytes:
    """Lower-cased letters, single spaces around each run, behind the start mark; b"" if there is no letter."""
    text = text.lower()
    if not text.isascii():
        text = _NUMBER.sub(" ", text)
        if _WIDE.search(text):
            text = _WIDE_NUMBER.sub(" ", text)
    words = _OTHER.sub(" ", text).strip()
    return f"{_START} {words} ".encode() if words else b""


def grams(raw: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """For each byte behind the first ``order`` of its text (the start mark), the codes of the order + 1 bytes that end in it."""
    code = np.zeros(len(raw) - order, dtype=np.uint32)
    for i in range(order + 1):
        code = code << np.uint32(8) | raw[i : len(raw) - order + i]
    crosses = np.zeros(len(raw) + 1, dtype=bool)
    for i in range(order):  # such a byte would look back over the start of its text
        crosses[np.minimum(starts + i, len(raw))] = True
    return code[~crosses[order : len(raw)]]


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return raw, np.cumsum([0, *map(len, texts)])


def _count(batches):
    """Counts of the grams of each order, by language; a text counts as often as it was chosen."""
    for batch in batches:
        for lang, copies in set(zip(batch["lang"].to_pylist(), batch["copies"].to_pylist())):
            rows = batch.filter(pc.and_(pc.equal(batch["lang"], lang), pc.equal(batch["copies"], copies)))
            raw, at = _join([b for t in rows["text"].to_pylist() if (b := normal(t))])
            if len(raw) <= ORDER:
                continue
            code, n = np.unique(grams(raw, at[:-1], ORDER), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(code), "code": pa.array(code.astype(np.int64)), "n": pa.array(n.astype(np.int64) * copies)})


class Model:
    """Frozen cost tables: for each order, sorted codes of context and byte with a cost for each language."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.known = np.unique(np.concatenate([c for c, _ in counts])) if counts else np.zeros(0, dtype=np.uint32)
        self.levels = []
        for order in range(ORDER, -1, -1):
            per_lang = []
            for code, n in counts:
                key = code & np.uint32((1 << 8 * (order + 1)) - 1) if order < 3 else code
                key, at = np.unique(key, return_inverse=True)
                total = np.bincount(at, weights=n)
                context, where, distinct = np.unique(key >> np.uint32(8), return_inverse=True, return_counts=True)
                seen = np.bincount(where, weights=total)
                cost = -np.log2(total / (seen + distinct)[where])
                escape = -np.log2(distinct / (seen + distinct))
                per_lang.append((key, cost, context, escape))
            self.levels.append((order, per_lang))

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each code behind the bytes before it, for each language."""
        out = np.zeros((len(code), len(self.langs)))
        for j in range(len(self.langs)):
            open_, bits = np.arange(len(code)), np.zeros(len(code))
            for order, per_lang in self.levels:
                key, cost, context, escape = per_lang[j]
                mine = code[open_] & np.uint32((1 << 8 * (order + 1)) - 1) if order < 3 else code[open_]
                at = np.minimum(np.searchsorted(key, mine), max(len(key) - 1, 0))
                hit = key[at] == mine if len(key) else np.zeros(len(mine), dtype=bool)
                bits[open_[hit]] += cost[at[hit]]
                open_, mine = open_[~hit], mine[~hit]
                if len(context):
                    up = np.minimum(np.searchsorted(context, mine >> np.uint32(8)), len(context) - 1)
                    met = context[up] == mine >> np.uint32(8)
                    bits[open_[met]] += escape[up[met]]
            bits[open_] += 8.0  # every byte alike
            out[:, j] = bits
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (all its bytes behind the start mark) for each language; empty texts have 0."""
        raw, at = _join(texts)
        if len(raw) <= ORDER:
            return np.zeros((len(texts), len(self.langs)))
        code = grams(raw, at[:-1], ORDER)
        ordered = np.sort(code)
        first = np.ones(len(ordered), dtype=bool)
        first[1:] = ordered[1:] != ordered[:-1]
        distinct = ordered[first]
        cost = self.costs(distinct)
        where = np.searchsorted(distinct, code)
        ends = np.cumsum(np.maximum(np.diff(at) - ORDER, 0))
        sums = np.zeros((len(code) + 1, len(self.langs)))
        for j in range(len(self.langs)):
            np.cumsum(cost[where, j], out=sums[1:, j])
        return sums[ends] - sums[np.concatenate([[0], ends[:-1]])]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0, F.lit(True))


def training_texts(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """lang, text, copies: the train_docs rows of each language that come first by a hash of id, text and number of the copy; equal texts of an id are one row.

    Languages, hashes and numbers stand for the rows until they are chosen. A bound on the hash comes first, at which a language of n rows keeps train_docs of them with ten
    standard deviations to spare, so a window takes a bounded number of rows; what it keeps is in the same order.
    """
    rows = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    name = [F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64("text", "doc_id").alias("h2")]
    keyed = number_copies(rows.select("lang", *name), ["lang", "h1", "h2"], "copy").withColumn("drawn", F.xxhash64("h1", "h2", "copy"))
    share = F.least(F.lit(1.0), F.lit(train_docs + 10 * train_docs**0.5) / F.count("*"))
    bounds = rows.groupBy("lang").agg(share.alias("share"))  # a row for each language
    near = keyed.join(F.broadcast(bounds), "lang").filter(F.col("drawn") / float(1 << 64) + 0.5 <= F.col("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "h1", "h2"))
    picked = near.withColumn("place", place).filter(F.col("place") <= train_docs).groupBy("lang", "h1", "h2").agg(F.count("*").alias("copies"))
    # No more than train_docs rows for each language; copies of a text are put together before the shuffle.
    found = rows.select("lang", "text", *name).join(F.broadcast(kept(picked, "picked")), ["lang", "h1", "h2"])
    return found.groupBy("lang", "h1", "h2").agg(F.first("text").alias("text"), F.first("copies").alias("copies")).select("lang", "text", "copies")


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from docs (doc_id, text, lang). What comes to the driver are the counts of the bounded sample."""
    picked = training_texts(docs, train_docs)
    counts = picked.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    table = counts.toArrow().to_pandas()
    langs = sorted(table["lang"].unique())
    per_lang = []
    for lang in langs:
        own = table[table["lang"] == lang].sort_values("code")
        per_lang.append((own["code"].to_numpy().astype(np.uint32), own["n"].to_numpy().astype(float)))
    return Model(langs, per_lang)


def _predict(model_of):
    def predict(batches):
        model = model_of()
        for batch in batches:
            ids, held, texts = batch["doc_id"], batch["held_out"], batch["text"]
            lo = 0
            while lo < batch.num_rows:
                hi, size, part = lo, 0, []
                while hi < batch.num_rows and size < CHUNK:
                    text = normal(texts[hi].as_py() or "")
                    part.append(text)
                    size += len(text)
                    hi += 1
                letters = np.array([bool(t) for t in part])
                if model.langs:
                    bits = model.code_lengths(part)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(part)), best]
                    n = np.maximum(np.array([len(t) for t in part]) - ORDER, 1)
                    # Odds by the square root of the code length: a long text's certainty stays below 1 where languages are close.
                    odds = np.exp2(-(bits - least[:, None]) / np.sqrt(n)[:, None])
                    score = np.where(letters, 1 / odds.sum(axis=1), 0.0)
                    names = [model.langs[b] if ok else "und" for b, ok in zip(best, letters)]
                    per_byte = np.where(letters, least / n, 0.0)
                else:
                    names, score, per_byte = ["und"] * len(part), np.zeros(len(part)), np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), held.slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score), pa.array(per_byte)], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])
                lo = hi

    return predict


def predict_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and bits_per_byte (under the predicted language)."""
    model = train(docs) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(lambda: sent.value), "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


#: A text that costs more bits a byte than this under every learned language is in none of them.
MOST_BITS = 5.0


def keep_identified(docs: DataFrame, model: Model | None = None, most_bits: float = MOST_BITS) -> DataFrame:
    """The rows of docs, with all their columns, whose language is identified: not und, and of at most most_bits a byte under it."""
    model = train(docs) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        predict = _predict(lambda: sent.value)
        for batch in batches:
            n = batch.num_rows
            asked = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.zeros(n, dtype=bool)), batch["text"]], names=["doc_id", "held_out", "text"])
            found = pa.Table.from_batches(predict([asked])) if n else None
            if found is not None:
                good = np.array([x != "und" for x in found["lang_pred"].to_pylist()]) & (found["bits_per_byte"].to_numpy() <= most_bits)
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
