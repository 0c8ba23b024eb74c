"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and
identifier cues in one pass; at each anchor a deterministic parser expands to the
left and right as far as its grammar goes and validates what it has. Every
parser goes over a run of characters once, so a text's cost is linear.

Base kinds: email, ip, card, phone. Added kinds: url (scheme addresses), iban
(checked modulo 97), account (an identifier behind a cue such as "passport no"),
secret (keys of public services by their beginnings, values behind "password=").

Edge cases: a null text is the empty text; no finding gives zeros, empty lists and
the digest of the empty string; spans of different kinds may overlap; repeated
rows each get their row; very long texts are read whole; a kept column named found is
replaced by the result, other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialseg.llm.columns import declared, fresh, without

KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "secret")
BASE = KINDS[:4]
#: Cues before identifiers.
CUES = ("ssn", "social security", "passport", "iban", "account", "acct", "konto", "compte", "cuenta", "tax id", "steuer-id", "dni", "nif", "driver license", "driving licence", "national id")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)")
IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
URL = re.compile(r"://[^\s<>\"'`{}|\\^\[\]]++")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){2,8}")
#: Characters of a country's IBAN.
IBAN_LENGTH = {c: int(n) for n, cs in (x.split(":") for x in "15:NO;16:BE;18:DK FI FK FO GL NL SD;19:MK SI;20:AT BA EE KZ LT LU MN XK;21:CH HR LI LV;22:BG BH CR DE GB GE IE ME RS VA;23:AE GI IL IQ OM SO TL;24:AD CZ ES MD PK RO SA SE SK TN VG;25:LY PT ST;26:IS TR;27:BI DJ FR GR IT MC MR SM;28:AL AZ BY CY DO GT HN HU LB NI PL SV;29:BR EG PS QA UA;30:JO KW MU YE;31:MT SC;32:LC;33:RU".split(";")) for c in cs.split()}
IBAN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
AFTER_CUE = re.compile(r"(?:\s{0,2}(?:no|nr|num|number|code|#|nº|n°)\b\.?)?\s{0,2}[:#=]?\s{0,2}([A-Z]{0,3}+[0-9][A-Z0-9-]{4,}+)", re.I)
#: How public services' keys begin, and what follows.
KEYS = {"akia": re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"), "ghp_": re.compile(r"(?<![A-Za-z0-9_])ghp_[A-Za-z0-9]{36,}+"), "sk_live_": re.compile(r"(?<![A-Za-z0-9_])sk_live_[A-Za-z0-9]{16,}+"), "xoxb-": re.compile(r"(?<![A-Za-z0-9-])xoxb-[A-Za-z0-9-]{16,}+"), "-----begin ": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]*PRIVATE KEY-----")}
SECRET_CUES = ("password", "passwd", "secret", "token", "api key", "api_key", "api-key", "apikey")
#: A secret's value stands after a sign; it is long, without blanks, and has a digit.
AFTER_SECRET = re.compile(r"\s{0,2}[:=]\s{0,2}[\"']?([A-Za-z0-9_./+=!@#$%^&*-]{8,}+)")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_AUTOMATON: list = []


def automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for x in ("@", "+", *"0123456789"):
            a.add_word(x, (x if x in "@+" else "0", 1))
        a.add_word("://", (":", 3))
        for c in CUES:
            a.add_word(c, ("cue", len(c)))
        for c in KEYS:
            a.add_word(c, (c, len(c)))
        for c in SECRET_CUES:
            a.add_word(c, ("secret", len(c)))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, at: int) -> int:
    """End of the IBAN that begins at ``at``, or 0: of its country's length, else all that its characters reach."""
    m = IBAN.match(text, at)
    if not m or at and text[at - 1] in IBAN_CHARS and text[max(0, at - 4) : at].upper() != "IBAN":
        return 0
    end, left = at, IBAN_LENGTH.get(text[at : at + 2], 0)
    while left and end < len(text) and (text[end] in IBAN_CHARS or text[end] == " " and text[end - 1] != " "):
        left -= text[end] != " "
        end += 1
    whole = left == 0 and end > at and not (end < len(text) and text[end] in IBAN_CHARS)
    return end if whole and iban_valid(text[at:end]) else m.end() if iban_valid(m[0]) else 0


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start; code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)  # where a kind's next match may begin
    low = text.lower() if text.isascii() else text.translate(ASCII_LOWER)
    for last, (what, n) in automaton().iter(low):
        at = last - n + 1
        if what == "0":
            if at - 2 >= free["iban"] and text[at - 1] in IBAN_CHARS and (end := iban_end(text, at - 2)):
                free["iban"] = end
                found["iban"].append((at - 2, end))
            if at >= free["card"]:
                m = CHAIN.match(text, at)
                free["card"] = m.end() if m else at + 1
                if m and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                    found["card"].append((at, m.end()))
            if at >= free["ip"]:
                m = IP.match(text, at)
                if m:
                    free["ip"] = m.end()
                    if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                        found["ip"].append((at, m.end()))
                else:  # no match can begin later in this run of digits
                    end = at + 1
                    while end < len(text) and "0" <= text[end] <= "9":
                        end += 1
                    free["ip"] = end
        elif what == "@":
            start = at
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at) if start < at else None
            if m:
                found["email"].append((start, m.end()))
            free["email"] = m.end() if m else at + 1
        elif what == "+":
            m = PHONE.match(text, at) if at >= free["phone"] else None
            if m:
                end = m.end()
                while not "0" <= text[end - 1] <= "9":
                    end -= 1
                if end >= at + 4:
                    free["phone"] = end
                    if 9 <= sum("0" <= c <= "9" for c in text[at:end]) <= 15:
                        found["phone"].append((at, end))
        elif what == ":":
            start = at
            while start > free["url"] and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
                start -= 1
            m = URL.match(text, at)
            if m and start < at and text[start].isalpha():
                end = at + len(m[0].rstrip(".,;:!?)"))
                if end > at + 3:
                    found["url"].append((start, end))
                    free["url"] = end
        elif what in KEYS or what == "secret":
            m = KEYS[what].match(text, at) if what in KEYS else AFTER_SECRET.match(text, last + 1)
            span = m.span(m.lastindex or 0) if m else (0, 0)
            if m and span[0] >= free["secret"] and (what in KEYS or any(c.isdigit() for c in m[1])):
                free["secret"] = span[1]
                found["secret"].append(span)
        elif (at == 0 or not low[at - 1].isalnum()) and at >= free["account"]:
            m = AFTER_CUE.match(text, last + 1)
            if m and sum("0" <= c <= "9" for c in m[1]) >= 4:
                free["account"] = m.end(1)
                found["account"].append(m.span(1))
    return [(k, s, e) for k in KINDS for s, e in sorted(found[k])]


def redacted(text: str | None, kinds: tuple[str, ...] = ("email", "ip", "card", "phone", "iban", "account", "secret")) -> str | None:
    """The text with each union of overlapping spans replaced by the kind that begins it, in brackets. Addresses of pages stay, unless they hold another kind."""
    if not text:
        return text
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans(text) if k in kinds):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def join_spans(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find_pii(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and found: array of (kind, start, end)."""
    keep = without(keep, ("found",))
    text = fresh("text", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t.as_py() or "")] for t in b.column(text)]
            yield pa.record_batch([*(b.column(k) for k in keep), pa.array(rows, kind)], names=[*keep, "found"])

    return docs.select(*keep, F.col(text_col).alias(text)).mapInArrow(run, f"{declared(docs, keep)}found array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; all rows and columns stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([redacted(t.as_py()) for t in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def pii_digest(found: DataFrame, keep: list[str]) -> DataFrame:
    """Counts of the base kinds, their digest and all spans as text."""
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select(*keep, *counts, F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"), F.array_join(F.transform("found", shown), ",").alias("spans"))
