"""Personal data by anchor expansion (operator 8).

One Aho-Corasick pass finds the anchors of a text: at-signs, schemes, plus signs, digits and identifier cues (in any case). At each
anchor a deterministic local parser expands to the span's boundaries and validates it. The base kinds email, ip, card
and phone give exactly the leftmost non-overlapping matches of their patterns; a match that fails its validation is
dropped and not retried. Further kinds, found from cues: account (IBAN with valid check digits; a number that an
account cue announces), ssn (announced by a cue), key (cloud access keys) and login (user and password in a web
address). Every parser moves on from where it stopped, so a text costs time in proportion to its length.

Null and empty texts hold nothing: counts 0 and the digest of the empty string. Repeated rows give repeated results,
null doc_ids stay null, an empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, documents, trim

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "ssn", "key", "login")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
NUMBER = re.compile(r"(?:\s*(?:no|nr|number|num|#)\b\.?)?[\s:#=]{0,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
SSN = re.compile(r"(?:\s*(?:no|number|#)\b\.?)?[\s:#=]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])", re.I)
KEY = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])")
LOGIN = re.compile(r"[^\s/@:\"'<>]++:[^\s/@\"'<>]++@[A-Za-z0-9.-]+")
CUES = {"account": "account", "acct": "account", "ssn": "ssn", "social security": "ssn"}
UPPER = re.compile("[A-Z]+")


def luhn(digits: str) -> bool:
    """Whether the digits pass the mod 10 check."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for cue in ("akia", "asia"):
        a.add_word(cue, ("key", 4))
    for cue, kind in CUES.items():
        a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans in code points, by kind as in KINDS, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the next match of a kind can begin
    tried_iban = 0
    lowered = text.lower() if text.isascii() else UPPER.sub(lambda m: m[0].lower(), text)  # as long as the text
    for last, (anchor, size) in anchors().iter(lowered):
        at = last + 1 - size
        if anchor == "digit":
            run_begins = not at or text[at - 1] not in DIGITS
            if run_begins and at >= done["ip"] and (m := IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                    found["ip"].append(m.span())
            if at >= done["card"] and (m := CARD.match(text, at)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
            if run_begins and at - 2 >= tried_iban and text[at - 2].isupper() and text[at - 1].isupper() and not (at > 2 and text[at - 3].isalnum()) and (m := IBAN.match(text, at - 2)):
                # the pattern is greedy over spaced groups; the check digits say how many of them belong to it
                for end in range(m.end(), at + 11, -1):
                    if text[end - 1] != " " and (end == len(text) or not text[end].isalnum()) and iban(text[at - 2 : end]):
                        found["account"].append((at - 2, end))
                        tried_iban = done["account"] = end
                        break
        elif anchor == "at":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                found["email"].append((start, m.end()))
                done["email"] = m.end()
        elif anchor == "plus":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif anchor == "scheme":
            if m := LOGIN.match(text, last + 1):
                found["login"].append(m.span())
        elif anchor == "key":
            if at >= done["key"] and not (at and text[at - 1].isalnum()) and (m := KEY.match(text, at)):
                found["key"].append(m.span())
                done["key"] = m.end()
        elif anchor in ("account", "ssn") and not (at and text[at - 1].isalnum()):
            m = (NUMBER if anchor == "account" else SSN).match(text, last + 1)
            if m and m.start(1) >= done[anchor]:
                found[anchor].append(m.span(1))
                done[anchor] = m.end(1)
    return [(k, a, b) for k in KINDS for a, b in sorted(found[k])]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans=None) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, done = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in (find(text) if spans is None else spans)):
        if a >= done:
            out += [text[done:a], f"[{k.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_documents(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of each row of docs(doc_id, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            each = [find(t or "") for t in batch.column(1).to_pylist()]
            counts = [[sum(k == kind for k, _, _ in spans) for spans in each] for kind in BASE]
            digest = [hashlib.sha256(joined(s for s in spans if s[0] in BASE).encode()).hexdigest() for spans in each]
            return {"doc_id": batch.column(0), **{f"n_{k}": c for k, c in zip(BASE, counts)}, "base_sha256": digest, "spans": [joined(s) for s in each]}

        return step

    return by_batch(docs.select("doc_id", "text"), SCHEMA, make)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with the spans of its text redacted; other columns as they are, n_chars (if any) of the new text."""
    has = "n_chars" in docs.columns

    @F.pandas_udf("string")
    def clean(s):
        trim()
        return s.map(lambda t: t if t is None else redact(t))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if has else out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_documents(documents(spark, sf_dir))


QUERIES = {"op8_pii": op8_pii}
ORACLES: dict[str, str] = {}
