"""Repetition coverage: characters inside duplicated word n-grams and lines, by rolling hashes in numpy.

Grams are compared by 64 bits, made of strong hashes of their words; lines are compared by their bytes.

Each document is judged alone. A document fails the base rules if it has fewer than 20 words, or more than 30 % of its words lie in
8-word windows that occur twice or more in it. The method's verdict asks in addition that the characters inside duplicated
n-grams, for each n of ``LIMITS``, and inside duplicated lines stay within the given shares of the characters of its words.

Defined results: a null, empty or blank text has no words and fails; rows are judged one by one, so ids may repeat or be null; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.arrays import U64, Words, chunks, covered, gram_hashes, gram_starts, mix, repeated, value_codes

#: n-gram length: largest share of characters inside duplicated n-grams.
LIMITS = {5: 0.30, 10: 0.25, 16: 0.20}
LINE_LIMIT = 0.40
BASE_WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def measure(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a run of texts."""
    words = Words(raw, at)
    text = words.text_of_word()
    lead = (raw & 0xC0) != 0x80  # one for each code point
    chars = np.concatenate([[0], np.cumsum(lead)])
    size = chars[words.end] - chars[words.start]
    out = {"n_words": words.count.astype(np.int64), "word_chars": _per_text(size, words.first), "n_symbols": _per_text(_SYMBOL[raw], at)}

    codes = words.hashes()[0]
    salt = mix(np.arange(1, len(at), dtype=U64))
    for n in (BASE_WINDOW, *LIMITS):
        start = gram_starts(words, n)
        again = start[repeated(gram_hashes(codes, n)[start] ^ salt[text[start]])]
        inside = covered(again, again + n, len(words.start)) if len(again) else np.zeros(len(words.start), dtype=bool)
        out[f"words_{n}"] = _per_text(inside, words.first)
        out[f"chars_{n}"] = _per_text(np.where(inside, size, 0), words.first)

    cut = np.unique(np.concatenate([at, np.flatnonzero(raw == 0x0A) + 1]))  # where lines begin; texts end lines too
    if len(cut) < 2:
        zero = np.zeros(len(at) - 1, dtype=np.int64)
        return out | {"n_dup_lines": zero, "line_chars": zero}
    lo, hi = cut[:-1], cut[1:]
    hi = hi - (raw[hi - 1] == 0x0A)
    line, distinct = value_codes(raw[raw != 0x0A], hi - lo)
    w_lo, w_hi = np.searchsorted(words.start, lo), np.searchsorted(words.start, hi)
    full = w_hi > w_lo
    lo, hi, w_lo, w_hi = lo[full], hi[full], w_lo[full], w_hi[full]
    owner = np.searchsorted(at, lo, side="right") - 1
    key = owner * (len(distinct) + 1) + line[full]
    order = np.argsort(key, kind="stable")  # equal lines stay in order
    later = np.zeros(len(key), dtype=bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    sizes = np.concatenate([[0], np.cumsum(size)])
    line_chars = sizes[w_hi] - sizes[w_lo]
    out["n_dup_lines"] = np.bincount(owner[later], minlength=len(at) - 1).astype(np.int64)
    out["line_chars"] = np.bincount(owner[later], weights=line_chars[later], minlength=len(at) - 1).astype(np.int64)
    return out


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", f"words_{BASE_WINDOW}", "line_chars", *(f"chars_{n}" for n in LIMITS)]


def _measure(batches):
    for batch in batches:
        for lo, hi, raw, at in chunks(batch["text"]):
            m = measure(raw, at)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), *(pa.array(m[c]) for c in _COUNTS)], names=["doc_id", *_COUNTS])


def repetition_coverage(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """doc_id, the base counts, base_failed, the share of characters inside duplicated n-grams and lines, and kept."""
    limits = LIMITS if limits is None else limits
    if set(limits) - set(LIMITS):
        raise ValueError(f"n-grams are measured for {sorted(LIMITS)}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    m = rows.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS))
    words, chars = F.col("n_words"), F.col("word_chars")
    repeat_words = F.col(f"words_{BASE_WINDOW}")
    failed = (words < LEAST_WORDS) | (100 * repeat_words > MOST_REPEATED * words)
    share = {f"dup_{n}gram_share": F.coalesce(F.try_divide(F.col(f"chars_{n}"), chars), F.lit(0.0)) for n in limits}
    lines = F.coalesce(F.try_divide(F.col("line_chars"), chars), F.lit(0.0))
    good = lines <= line_limit
    for n, most in limits.items():
        good = good & (share[f"dup_{n}gram_share"] <= most)
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat_words.alias("n_repeat_words"), failed.alias("base_failed"),
        *(c.alias(name) for name, c in share.items()), lines.alias("dup_line_share"), (~failed & good).alias("kept"),
    )
