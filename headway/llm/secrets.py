"""Secret scans: fixed rules plus a sliding-window entropy scan over candidate strings.

The rules (assignments, access keys, long hexadecimal runs) always stand. The
entropy scan walks every candidate string with a window, keeps the counts of
its characters up to date as it slides, and reports the union of windows whose
Shannon entropy passes the limit of its character class. The allow-list takes
out of a candidate the parts (between separators) that it matches, no more;
what is left on either side is scanned. What a rule span covers of a dense
stretch is reported by the rule, the rest of it as entropy.

Defined results: null and empty texts have no spans; repeated rows are scanned
each; positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# The rule patterns.
_LETTERS = {w: "".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "api", "key")}
ASSIGN = re.compile(
    "(" + "|".join([*(_LETTERS[w] for w in ("password", "passwd", "secret", "token")),
                    _LETTERS["api"] + "_?" + _LETTERS["key"]]) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")       # maximal runs of 24 or more are all the runs that stay
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile("[A-Za-z0-9+/_=-]{20,}")
#: Least entropy in bits per character of a window, by character class of the fragment. Words without
#: digits reach more than random hex does, so letters alone must be nearly all different.
LIMITS = {"hex": 3.0, "upper_digit": 3.4, "lower_digit": 3.4, "mixed": 3.8, "letters": 4.0, "one_case": 4.1}
WINDOW = 20
SEPARATORS = "+/_=-"
#: Parts that look random but are public: placeholders, well-known examples, ordered alphabets.
ALLOWED = [re.compile(p) for p in (
    "(?i)example|sample|dummy|placeholder|changeme|xxxx+", "(?i)abcdefgh|01234567|12345678",
    "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what the rules find, in order."""
    low = text.casefold()       # only to skip texts; casefold keeps ASCII letters findable
    out = []
    if "pass" in low or "secret" in low or "token" in low or "key" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def char_class(s: str) -> str | None:
    """The class whose limit applies; None for strings without letters."""
    digit = any(c.isdigit() for c in s)
    lower, upper = any("a" <= c <= "z" for c in s), any("A" <= c <= "Z" for c in s)
    if not (lower or upper):
        return None
    if not digit:
        return "letters" if lower and upper else "one_case"
    if all(c in "0123456789abcdef" for c in s) or all(c in "0123456789ABCDEF" for c in s):
        return "hex"
    return "mixed" if lower and upper else "lower_digit" if lower else "upper_digit"


def dense_windows(s: str, limit: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged windows of `s` with at least `limit` bits of entropy per character.

    Entropy is log2(w) - sum(c log2 c) / w; one character enters and one leaves
    per step, so only two counts and two terms of the sum change.
    """
    term = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(s):
        if i >= window:
            k = counts[s[i - window]]
            total += term[k - 1] - term[k]
            counts[s[i - window]] = k - 1
        k = counts.get(c, 0)
        total += term[k + 1] - term[k]
        counts[c] = k + 1
        if i >= window - 1 and math.log2(window) - total / window >= limit - 1e-9:
            a = i + 1 - window
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((a, i + 1))
    return out


def entropy_spans(text: str, allowed: list[re.Pattern] | None = None) -> list[tuple[int, int]]:
    """(start, end) of high-entropy stretches of what the allow rules leave of candidate strings."""
    allowed = ALLOWED if allowed is None else allowed
    out = []
    for m in CANDIDATE.finditer(text):
        for at, s in fragments(m[0], allowed):
            if (kind := char_class(s)) is not None:
                at += m.start()
                out += [(at + a, at + b) for a, b in dense_windows(s, LIMITS[kind])]
    return out


def fragments(s: str, allowed: list[re.Pattern], window: int = WINDOW) -> list[tuple[int, str]]:
    """(offset, string) of a candidate without the parts that an allow rule matches; shorter than a window is no fragment."""
    out, at = [], 0
    for a, b in sorted(m.span() for p in allowed for m in p.finditer(s)):
        while a > at and s[a - 1] not in SEPARATORS:
            a -= 1
        if a - at >= window:
            out.append((at, s[at:a]))
        at = max(at, b)
        while at < len(s) and s[at] not in SEPARATORS:
            at += 1
    if len(s) - at >= window:
        out.append((at, s[at:]))
    return out


def outside(spans: list[tuple[int, int]], base: list[tuple[int, int, int]], text: str) -> list[tuple[int, int]]:
    """What the rule spans leave of ordered spans; where one is cut, separators at the ends of the pieces go."""
    out, first = [], 0
    reach = list(accumulate((e for _, _, e in base), max))      # so that spans long past are skipped for good
    for a, b in spans:
        while first < len(base) and reach[first] <= a:
            first += 1
        at, i, pieces = a, first, []
        while i < len(base) and base[i][0] < b:
            pieces.append((at, base[i][0]))
            at = max(at, base[i][2])
            i += 1
        pieces.append((at, b))
        if at == a:
            out.append((a, b))
            continue
        for s, e in pieces:
            piece = text[s:e]
            s += len(piece) - len(piece.lstrip(SEPARATORS))
            if s < e:
                out.append((s, s + len(piece.strip(SEPARATORS))))
    return out


def scan(text: str, allowed: list[re.Pattern] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Rule spans, and all spans: of entropy spans what lies outside the rule spans is added."""
    base = base_spans(text)
    more = [(a, 3, b) for a, b in outside(entropy_spans(text, allowed), base, text)]
    return base, sorted(base + more)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones together, replaced by one mark."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            out += [text[at:a], mark]
        end = at = max(end, b)
    return "".join([*out, text[at:]]) if out else text


def written(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, joined by commas."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, carry: list[str], text: str = "text", clean: bool = False) -> DataFrame:
    """`carry` columns with counts by kind, rule spans, all spans and, if asked, redacted clean_text."""
    def make():
        def run(v: dict) -> list:
            cols: list[list] = [[] for _ in range(7 if clean else 6)]
            for t in v[text]:
                base, spans = scan(t)
                kinds = [k for _, k, _ in spans]
                row = [*(kinds.count(k) for k in range(4)), written(base), written(spans)]
                for c, x in zip(cols, row + [redact(t, spans)] * clean, strict=True):
                    c.append(x)
            return cols
        return run

    results = {"n_assign": "long", "n_access": "long", "n_hex": "long", "n_entropy": "long", "base": "string",
               "spans": "string"} | ({"clean_text": "string"} if clean else {})
    return map_rows(docs, make, [text], carry, results, text)


def op4_secrets(docs: DataFrame) -> DataFrame:
    """One row per document with counts, the digest of the rule spans and all spans."""
    return scan_secrets(docs, ["doc_id"]).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_entropy")
