"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors: at-signs, plus signs, digits, schemes
and cue words.  From each anchor a small deterministic parser expands the span
to its boundaries and validates it: addresses need a dotted domain, IPv4 parts
stay below 256, cards pass Luhn, accounts pass their check number or follow a
cue word.

Base kinds (``email ip card phone``) are leftmost and non-overlapping within a
kind; a candidate that fails validation is dropped, its text is not tried again.
The method adds ``iban`` (mod-97 valid), ``account`` (6 to 17 digits close
behind a cue word) and ``login`` (a scheme address with user data).

Defined results: null, empty and clean texts have no spans.  Offsets are code
points, end exclusive.  Texts are searched whole.  Repeated rows give equal spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from insight.llm.base import documents, register
from insight.llm.words import text_slices

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "account", "login"]
SCHEMES = ["http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://"]
CUES = ["account", "acct", "konto", "cuenta", "compte"]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIAL = re.compile(r"\+[0-9][ ().0-9-]+")
IBAN = re.compile(r"[ :]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
NUMBER = re.compile(r"[^0-9\n]{0,16}?([0-9]{6,17})(?![0-9])")
USERINFO = re.compile(r"[^\s/?#@]+@[A-Za-z0-9.-]+(?::[0-9]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def check_97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for mark in ["@", "+", *DIGITS]:
        a.add_word(mark, (mark if mark in "@+" else "#", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for s in ["IBAN", "iban", "Iban"]:
        a.add_word(s, ("iban", len(s)))
    for s in CUES:
        for form in (s, s.capitalize(), s.upper()):
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def find(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in the order of their starts."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mail_end = ip_end = card_end = 0
    for last, (what, size) in anchors.iter(text):
        at = last - size + 1
        if what == "#":
            if at >= card_end:
                m = CHAIN.match(text, at)
                if m:
                    card_end = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
                else:
                    card_end = at + 1
            if at >= ip_end:
                m = DOTTED.match(text, at)
                if m:
                    ip_end = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        out["ip"].append(m.span())
                else:  # no start within this run of digits can match either
                    ip_end = at + 1
                    while ip_end < len(text) and text[ip_end] in DIGITS:
                        ip_end += 1
        elif what == "@":
            start = at
            while start > mail_end and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m:
                mail_end = m.end()
                out["email"].append((start, m.end()))
        elif what == "+":
            m = DIAL.match(text, at)
            if m:
                end = m.end()
                while text[end - 1] not in DIGITS:
                    end -= 1
                if end >= at + 4 and 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    out["phone"].append((at, end))
        elif what == "scheme":
            m = USERINFO.match(text, last + 1)
            if m:
                out["login"].append((at, m.end()))
        elif what == "iban":
            m = IBAN.match(text, last + 1)
            if m:
                # the longest stretch of whole groups that checks
                for end in range(m.end(1), m.start(1) + 14, -1):
                    if (end == len(text) or not text[end].isalnum()) and check_97(text[m.start(1):end]):
                        out["iban"].append((m.start(1), end))
                        break
        else:
            m = NUMBER.match(text, last + 1)
            if m and (not out["account"] or m.start(1) >= out["account"][-1][1]):
                out["account"].append(m.span(1))
    return out


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> for the base kinds, base_sha256 and spans of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            for part in text_slices(batch, "text"):
                counts: dict[str, list[int]] = {k: [] for k in BASE_KINDS}
                base, spans = [], []
                for text in part.column("text"):
                    found = find(text.as_py() or "", anchors)
                    named = {k: [f"{k}:{a}:{b}" for a, b in v] for k, v in found.items()}
                    for k in BASE_KINDS:
                        counts[k].append(len(named[k]))
                    base.append(hashlib.sha256(",".join(x for k in BASE_KINDS for x in named[k]).encode()).hexdigest())
                    spans.append(",".join(x for k in KINDS for x in named[k]))
                yield pa.record_batch(
                    [part.column("doc_id").cast(pa.int64()), *[pa.array(counts[k], pa.int64()) for k in BASE_KINDS],
                     pa.array(base, pa.string()), pa.array(spans, pa.string())],
                    names=["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"])

    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string")


@register("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir))
