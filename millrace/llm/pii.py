"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of all kinds in one pass over the
text: at-signs, plus signs, digits, schemes and identifier cues. At each anchor
a deterministic local parser expands to the boundaries and validates. Nothing
scans the text between anchors.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, replace_texts

BASE = ("email", "ip", "card", "phone")
#: Added by the method: links with credentials-bearing schemes, account numbers after a cue, IBANs.
ADDED = ("url", "account", "iban")
RANK = {k: i for i, k in enumerate(BASE + ADDED)}

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
RUN = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_REST = re.compile(r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+")
ACCOUNT_REST = re.compile(r"[\x20:#.=]{1,3}([A-Z0-9][A-Z0-9-]{5,33})(?![A-Za-z0-9])")
IBAN_REST = re.compile(r"[\x20:#=]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
# The anchors.
SCHEMES = ("http://", "https://", "ftp://", "www.")
ACCOUNT_CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "ACCT", "konto", "Konto", "compte", "Compte", "cuenta", "Cuenta")
IBAN_CUES = ("IBAN", "iban", "Iban")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for ch in "0123456789":
        a.add_word(ch, ("d", 1))
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for kind, words in (("u", SCHEMES), ("a", ACCOUNT_CUES), ("i", IBAN_CUES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str, auto: ahocorasick.Automaton) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans), each (kind, start, end) in code points, end exclusive.

    Base kinds equal the leftmost non-overlapping matches of their patterns,
    failing matches dropped without a retry; ``*_to`` is where the last match
    of a kind, kept or dropped, ended.
    """
    base: list[tuple[str, int, int]] = []
    added: list[tuple[str, int, int]] = []
    email_to = ip_to = card_to = phone_to = run_to = url_to = 0
    for end, (kind, width) in auto.iter(text):
        at = end - width + 1
        if kind == "d":
            if at < run_to:
                continue
            run_to = RUN.match(text, at).end()
            if at >= ip_to and (m := QUAD.match(text, at)):
                ip_to = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    base.append(("ip", at, ip_to))
            if at >= card_to and (m := DIGITS.match(text, at)):
                card_to = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    base.append(("card", at, card_to))
        elif kind == "@":
            start = at
            while start > email_to and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_to = m.end()
                base.append(("email", start, email_to))
        elif kind == "+":
            if at >= phone_to and (m := PHONE.match(text, at)):
                phone_to = m.end()
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    base.append(("phone", at, phone_to))
        elif kind == "u":
            if at >= url_to and not (at and text[at - 1].isalnum()) and (m := URL_REST.match(text, end + 1)):
                stop = m.end()
                while stop > end + 1 and text[stop - 1] in ".,;:!?)'":
                    stop -= 1
                if stop > end + 1:
                    url_to = stop
                    added.append(("url", at, stop))
        elif kind == "a":
            if not (at and text[at - 1].isalnum()) and (m := ACCOUNT_REST.match(text, end + 1)) and sum(c.isdigit() for c in m[1]) >= 6:
                added.append(("account", m.start(1), m.end(1)))
        elif not (at and text[at - 1].isalnum()) and (m := IBAN_REST.match(text, end + 1)) and mod97(m[1]):
            added.append(("iban", m.start(1), m.end(1)))
    return base, added


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], RANK[x[0]])))


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts, ``base_sha256``, ``spans``.

    Defined cases: null and empty texts have no spans; null or repeated ids
    keep a row each; an empty table gives an empty result; extra columns are
    ignored. Texts of any length are read whole, a few MB at a time.
    """

    def start():
        auto = automaton()

        def run(texts):
            cols = [[] for _ in range(len(BASE) + 2)]
            for text in texts:
                base, added = find(text, auto) if text else ((), ())
                for i, k in enumerate(BASE):
                    cols[i].append(sum(s[0] == k for s in base))
                cols[-2].append(hashlib.sha256(joined(base).encode()).hexdigest() if base else EMPTY_SHA)
                cols[-1].append(joined([*base, *added]))
            return cols

        return run

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, start, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span in ``text_col`` (a string column) replaced by ``[KIND]``; overlapping spans merge under the first one's kind.

    Defined cases: all columns and rows stay, whatever their ids; null and empty
    texts stay as they are; texts are read whole, a few MB at a time.
    """

    def start():
        auto = automaton()

        def mask(text: str) -> str:
            base, added = find(text, auto) if text else ((), ())
            parts, to = [], 0
            for kind, s, e in sorted([*base, *added], key=lambda x: (x[1], RANK[x[0]])):
                if s >= to:
                    parts += [text[to:s], f"[{kind.upper()}]"]
                to = max(to, e)
            return "".join(parts) + text[to:] if parts else text

        return mask

    return replace_texts(docs, start, text_col)
