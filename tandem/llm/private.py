"""Personal data by anchor expansion.

An Aho-Corasick automaton reports the cues (at-sign, plus, dotted digits, digits, URL schemes, names of
identifiers); a local parser for each kind walks outward from its cue, sets the boundaries and validates.
No parser looks beyond the characters of its own candidate, so the work is linear in the text.

Kinds: ``email ip card phone`` as the contract writes them (a failing candidate is dropped without retry and
its characters stay used), and two that the cues add: ``url`` (scheme up to white space, quote, bracket or
closing punctuation) and ``secret`` (the value after ``password=``, ``token =``, ``api_key:``, ``iban:``,
``ssn:``, ``account no`` and the like, and access key ids).  Spans are code points, end exclusive.

Defined cases: a null text counts as empty and has no spans; repeated rows are handled row by row; texts of
any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tandem.llm.storage import ready

KINDS = ("email", "ip", "card", "phone", "url", "secret")
BASE = KINDS[:4]
RANK = {k: i for i, k in enumerate(KINDS)}
DIGITS = "0123456789"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOCAL_PART = frozenset(_LETTERS + DIGITS + "._%+-")
LABEL = frozenset(_LETTERS + DIGITS + "-")
PHONE_BODY = frozenset(" ().-" + DIGITS)
DIGIT = frozenset(DIGITS)
KEY_ID = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + DIGITS)
URL_STOP = frozenset(" \t\n\x0b\x0c\r\"'<>()[]{}|\\^`")
SCHEMES = ("http://", "https://", "ftp://")
NAMES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "access_key", "iban", "ssn", "account no",
         "account number")
VALUE = frozenset(_LETTERS + DIGITS + "-_/+=.")
KEY_PREFIXES = ("AKIA", "ASIA")


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()

    def add(word: str, kind: str) -> None:
        a.add_word(word, (kind, len(word)))

    add("@", "email")
    for d in DIGITS:
        add(d, "card")
        add("." + d, "ip")
        add("+" + d, "phone")
    for s in SCHEMES:
        for form in {s, s.upper(), s.capitalize()}:
            add(form, "url")
    for n in NAMES:
        for form in {n, n.upper(), n.capitalize()}:
            add(form, "secret")
    for p in KEY_PREFIXES:
        add(p, "key")
    a.make_automaton()
    return a


def _label_end(text: str, at: int) -> int:
    n = len(text)
    while at < n and text[at] in LABEL:
        at += 1
    return at


def _digits_end(text: str, at: int) -> int:
    n = len(text)
    while at < n and text[at] in DIGIT:
        at += 1
    return at


def email_at(text: str, sign: int, free: int) -> tuple[int, int] | None:
    """Around the at-sign; characters before ``free`` belong to an earlier address."""
    start = sign
    while start > free and text[start - 1] in LOCAL_PART:
        start -= 1
    end = _label_end(text, sign + 1)
    if start == sign or end == sign + 1:
        return None
    labels, n = 0, len(text)
    while end < n and text[end] == ".":
        more = _label_end(text, end + 1)
        if more == end + 1:
            break
        end, labels = more, labels + 1
    return (start, end) if labels else None


def ip_at(text: str, dot: int, free: int) -> tuple[tuple[int, int] | None, int]:
    """From the first number of the dotted chain that holds this dot: span of four numbers, and where to go on."""
    start = dot
    while start > free and text[start - 1] in DIGIT:
        start -= 1
    if start == dot:
        return None, dot + 1
    at, parts, n = dot, [text[start:dot]], len(text)
    while len(parts) < 4 and at < n and text[at] == ".":
        end = _digits_end(text, at + 1)
        if end == at + 1:
            break
        parts.append(text[at + 1:end])
        at = end
    if len(parts) < 4:
        return None, at
    ok = all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)
    return ((start, at) if ok else None), at


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def card_at(text: str, first: int) -> tuple[tuple[int, int] | None, int]:
    """The run of digits with single blanks or hyphens between them."""
    end, n = first + 1, len(text)
    while end < n:
        if text[end] in DIGIT:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGIT:
            end += 2
        else:
            break
    if end - first < 12:
        return None, end
    digits = text[first:end].replace(" ", "").replace("-", "")
    return ((first, end) if 12 <= len(digits) <= 19 and luhn(digits) else None), end


def phone_at(text: str, plus: int) -> tuple[tuple[int, int] | None, int]:
    """Plus, digit, then the longest run of phone characters that ends in a digit."""
    end, n = plus + 2, len(text)
    while end < n and text[end] in PHONE_BODY:
        end += 1
    while end > plus + 2 and text[end - 1] not in DIGIT:
        end -= 1
    if end < plus + 4:
        return None, plus + 1
    count = sum(ch in DIGIT for ch in text[plus:end])
    return ((plus, end) if 9 <= count <= 15 else None), end


def url_at(text: str, start: int, body: int) -> tuple[int, int] | None:
    end, n = body, len(text)
    while end < n and text[end] not in URL_STOP:
        end += 1
    while end > body and text[end - 1] in ".,;:!?*":
        end -= 1
    return (start, end) if end > body else None


def secret_at(text: str, after: int) -> tuple[int, int] | None:
    """The value that follows a name and ``=`` or ``:``; it must hold a digit and eight characters at least."""
    at, n = after, len(text)
    while at < n and text[at] in "\"' ":
        at += 1
    if at >= n or text[at] not in "=:":
        return None
    at += 1
    while at < n and text[at] in "\"' ":
        at += 1
    end = at
    while end < n and text[end] in VALUE:
        end += 1
    while end > at and text[end - 1] in ".=":
        end -= 1
    value = text[at:end]
    return (at, end) if len(value) >= 8 and any(ch in DIGIT for ch in value) else None


def key_at(text: str, start: int) -> tuple[int, int] | None:
    """An access key id: prefix and 16 capitals or digits, not part of a longer word."""
    end, n = start, len(text)
    while end < n and text[end] in KEY_ID:
        end += 1
    alone = (start == 0 or text[start - 1] not in VALUE) and (end == n or text[end] not in LABEL)
    return (start, end) if end - start == 20 and alone else None


def spans_of(text: str, cues) -> list[tuple[str, int, int]]:
    """All spans by start, then by kind."""
    found: list[tuple[str, int, int]] = []
    used = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in cues.iter(text):
        start = last - size + 1
        if kind == "email":
            span = email_at(text, last, used["email"])
            if span:
                used["email"] = span[1]
        elif start < used["secret" if kind == "key" else kind]:
            continue
        elif kind == "ip":
            span, used["ip"] = ip_at(text, start, used["ip"])
        elif kind == "card":
            span, used["card"] = card_at(text, last)
        elif kind == "phone":
            span, used["phone"] = phone_at(text, start)
        elif kind == "url":
            span = url_at(text, start, last + 1)
            used["url"] = span[1] if span else last + 1
        else:
            span = key_at(text, start) if kind == "key" else secret_at(text, last + 1)
            kind = "secret"
            if span:
                used["secret"] = span[1]
        if span:
            found.append((kind, *span))
    return sorted(found, key=lambda s: (s[1], RANK[s[0]]))


def written_spans(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "n_url long, n_secret long")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cues = automaton()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        cols: list[list] = [[] for _ in range(8)]
        for value in texts:
            spans = spans_of(value.as_py() or "", cues)
            base = [s for s in spans if s[0] in BASE]
            count = {k: 0 for k in KINDS}
            for s in spans:
                count[s[0]] += 1
            digest = hashlib.sha256(written_spans(base).encode()).hexdigest()
            for col, v in zip(cols, (*(count[k] for k in BASE), digest, written_spans(spans), count["url"], count["secret"])):
                col.append(v)
        yield pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()),
             pa.array(cols[5], pa.string()), *(pa.array(c, pa.int64()) for c in cols[6:])],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_url", "n_secret"])


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, digest of the base spans and all spans."""
    ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_rows, SCHEMA)


def op10(documents: DataFrame) -> DataFrame:
    return find_private(documents)
