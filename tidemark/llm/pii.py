"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Work inside a task is per document and needs no other row, so the operator is a map without shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_of

#: Kinds in the order of the result; ``iban`` is added by the method.
KINDS = ("email", "ip", "card", "phone", "iban")

# The patterns of the contract.  Possessive repeats and the look-behind only spare
# useless backtracking on long runs of digits.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by country, of the IBAN registry.
IBAN_CHARS = {
    code: int(chars)
    for chars, codes in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
        "23:GI,IL,IQ,OM,SO 24:AD,AE,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
        "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split())
    for code in codes.split(",")
}
DIGIT = re.compile(r"[0-9]")
DIGITS_ONLY = re.compile(r"[^0-9]+")

#: Words that raise or lower the score when they stand within CONTEXT characters of a span.
SUPPORT = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "login", "address"),
    "card": ("card", "visa", "mastercard", "payment", "credit", "debit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "bank", "account", "transfer"),
}
AGAINST = ("order", "isbn", "version", "serial", "invoice", "sku", "test", "sample")
CONTEXT = 48
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9}
STEP = 0.1
#: Card numbers shorter than the contract's need a supporting word nearby.
SHORT_CARD = (13, 15)


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for place, char in enumerate(reversed(digits)):
        value = ord(char) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces leaves 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT) : start].lower() + " " + text[end : end + CONTEXT].lower()
    words = set(re.findall(r"[a-z]+", near))
    up = sum(w in words for w in SUPPORT[kind])
    down = sum(w in words for w in AGAINST)
    return round(min(1.0, max(0.0, BASE_SCORE[kind] + STEP * min(up, 2) - STEP * min(down, 2))), 3)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The spans of ``local@domain``, leftmost first: from each at sign to the left as far as local characters
    go, and to the right as far as the domain does, each character once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        done = at + 1
        if domain is not None:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, by kind, then start."""
    out = [("email", *span) for span in _emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = DIGITS_ONLY.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGITS_ONLY.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _iban_end(run: str) -> int | None:
    """End of the IBAN that the run of upper-case words and numbers begins with; None where there is none.

    It ends with a word, at the country's number of characters, and passes mod 97.
    """
    right, ends = IBAN_CHARS.get(run[:2]), [i for i, c in enumerate(run) if c == " "] + [len(run)]
    for spaces, end in enumerate(ends):
        if end - spaces == right:
            return end if mod97(run[:end].replace(" ", "")) else None
    return None


def added_spans(text: str) -> list[tuple[str, int, int]]:
    """What the method adds: IBANs that pass mod 97, and short card numbers that pass Luhn in context."""
    out = []
    if not DIGIT.search(text):
        return out
    for m in CARD.finditer(text):
        if m.end() - m.start() < SHORT_CARD[0]:
            continue
        digits = DIGITS_ONLY.sub("", m.group())
        alone = not (text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum())
        if SHORT_CARD[0] <= len(digits) <= SHORT_CARD[1] and alone and luhn(digits):
            if _score(text, "card", m.start(), m.end()) > BASE_SCORE["card"]:
                out.append(("card", m.start(), m.end()))
    m = IBAN.search(text)
    while m is not None:
        end = _iban_end(m.group())
        if end is not None:
            out.append(("iban", m.start(), m.start() + end))
        # A run without an IBAN at its start may have one at a later word.
        m = IBAN.search(text, m.start() + (end or 1))
    return out


def find_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """(base spans, all spans with scores), each by kind as listed, then start; code points."""
    base = base_spans(text)
    found = sorted({*base, *added_spans(text)}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return base, [(*s, _score(text, *s)) for s in found]


SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base_spans, spans (kind, start, end, score each), redacted text.

    Null and empty texts have no spans.  Repeated rows each get their row; an empty table gives an
    empty result; other columns are not read.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base_rows, all_rows, clean = [], [], []
            for text in batch.column("text").to_pylist():
                base, spans = find_spans(text)
                base_rows.append([{"kind": k, "start": s, "end": e, "score": None} for k, s, e in base])
                all_rows.append([{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in spans])
                at, parts = 0, []
                for k, s, e, _ in sorted(spans, key=lambda x: x[1]):
                    if s >= at:
                        parts += [text[at:s], f"<{k}>"]
                        at = e
                clean.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(base_rows, span), pa.array(all_rows, span), pa.array(clean, pa.string())],
                names=["id", "base_spans", "spans", "redacted"],
            )

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(scan, f"id {kind}, base_spans {SPAN_TYPE}, spans {SPAN_TYPE}, redacted string")
    return out.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans of :func:`personal_data`."""

    def joined(name: str):
        one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(name, one), ",")

    def number(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        id_col,
        *(number(k) for k in KINDS[:4]),
        F.sha2(joined("base_spans"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
