"""Personal data spans: regular expressions propose, checksums confirm, and nearby context words adjust a score.

The base kinds email, ip, card and phone are always reported where their pattern and check hold. The method adds spans of
further kinds: ``iban`` (mod-97), ``card_short`` (13 to 15 digits that pass Luhn) and ``phone_local`` (no plus sign); these start at
a score for their evidence, and words around the span raise it; those that reach ``LEAST_SCORE`` and do not overlap a base span stay.
Base spans stay whatever is around them, so their score is 1 and context does not change it. IBANs may be in small letters.

Offsets are code points, ends are exclusive. Defined results: a null text is empty and has no spans; rows are read one by one, so ids
may repeat or be null; an empty table gives no rows. Other columns are ignored. All scans take time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
LEAST_SCORE, CONTEXT = 0.6, 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: A run of digits is tried from its start only: if no match starts there, none starts later in the run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])([A-Za-z]{2})[0-9]{2}(?=\x20?[A-Za-z0-9])")
#: The length of an IBAN in each country of the public registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20,
}
_IBAN_BODY = {n: re.compile(rf"(?:\x20?[A-Za-z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])")
_TO_DIGITS = str.maketrans("", "", " ().-+")

#: Words that raise the score of a kind, in the languages of the corpus.
CONTEXT_WORDS = {
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "card_short": re.compile(r"\b(?:card|visa|amex|credit|karte|carte|tarjeta)\b", re.I),
    "phone_local": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b", re.I),
}
#: Score of a confirmed span without context, and with it.
SCORES = {"iban": (0.8, 0.95), "card_short": (0.4, 0.8), "phone_local": (0.3, 0.7)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    iban = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Spans of as many letters and digits as the country has, single spaces between them, that pass mod-97. What follows, a word in capitals for instance, is not read."""
    out = []
    for head in _IBAN_HEAD.finditer(text):
        if n := IBAN_LENGTHS.get(head[1].upper()):
            if (body := _IBAN_BODY[n].match(text, head.end())) and mod97(text[head.start() : body.end()]):
                out.append((head.start(), body.end()))
    return out


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @ and dotted domain, found from each @: a local part is the run of its characters before the @, cut at the end of the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, start)
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {"email": emails(text) if "@" in text else []}
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d)]
    found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(m[0].translate(_TO_DIGITS)) <= 15] if "+" in text else []
    return found


def more_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the method's own spans."""
    proposed = [("iban", *span) for span in ibans(text)]
    proposed += [("card_short", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 15 and luhn(d)]
    proposed += [("phone_local", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    covered = bytearray(len(text)) if proposed else bytearray()
    for a, b in taken:
        covered[a:b] = b"\x01" * (b - a)
    out = []
    for kind, start, end in proposed:
        if covered.find(1, start, end) >= 0:
            continue
        near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT // 2]
        score = SCORES[kind][bool(CONTEXT_WORDS[kind].search(near))]
        if score >= LEAST_SCORE:
            out.append((kind, start, end, score))
            covered[start:end] = b"\x01" * (end - start)
    return sorted(out, key=lambda x: (("iban", "card_short", "phone_local").index(x[0]), x[1]))


def _find(batches):
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.float64())]
    for batch in batches:
        ids, texts = batch["doc_id"], batch["text"]
        for lo in range(0, batch.num_rows, 500):
            rows = []
            for i, text in zip(ids.slice(lo, 500).to_pylist(), texts.slice(lo, 500).to_pylist()):
                found = base_spans(text)
                base = [f"{k}:{a}:{b}" for k in BASE for a, b in found[k]]
                more = more_spans(text, [x for k in BASE for x in found[k]]) if _HINT.search(text) else []
                joined = ",".join(base)
                rows.append((i, *(len(found[k]) for k in BASE), hashlib.sha256(joined.encode()).hexdigest(), ",".join([*base, *(f"{k}:{a}:{b}" for k, a, b, _ in more)]), [1.0] * len(base) + [s for *_, s in more]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


#: Every span of the method's own kinds has two digits in a row, or with one space or hyphen between them, as in a short card.
_HINT = re.compile(r"[0-9][\x20-]?[0-9]")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined, base kinds first) and the score of each span."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>")
