"""Personal data: fixed rules plus a skip-chain conditional random field.

The field's nodes are the tokens of a document that hold a digit, '@' or '+';
all other tokens are observed as outside and only shape their neighbours'
features. Neighbouring nodes share a chain potential; tokens that repeat, or
write the same digits in another way, share a skip potential with their
previous occurrence, however far away. Loopy belief propagation over a whole
slice of documents at once yields the marginals, so evidence about one mention
reaches all others. The weights are trained piecewise on counts over all
documents, labelled by the rules and leaving out what a rule dropped for its
length; the counts are summed in Spark and do not grow with the corpus.

Defined results: null and empty texts have no spans; repeated rows are scanned
each; positions are code points, ends exclusive; without any node in the
corpus the field adds nothing.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import explode_rows, map_rows

# Kinds in order, the rule patterns and their limits.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match of these two always begins at the start of a run of digits; saying so keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset(LOCAL)
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each '@' the local part reaches left as far as it may."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            end = m.end()
            out.append((a, end))
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of what the rules find, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in IP.finditer(text)
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = _NOT_DIGIT.sub("", m[0])
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def doubtful(text: str) -> list[tuple[int, int]]:
    """Matches that a rule dropped for holding too many digits: they may be several numbers side by side."""
    out = []
    for pattern, most in ((CARD, 19), (PHONE, 15)):
        out += [m.span() for m in pattern.finditer(text) if m.end() - m.start() > most and len(_NOT_DIGIT.sub("", m[0])) > most]
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, joined by commas."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# ---- the field -------------------------------------------------------------------------------

OUTSIDE = 4
TOKEN = re.compile(r"\S+")
NODE = re.compile("[0-9@+]")
EDGE = "\"'<>[]{},;:!?#$%&*|=~^`/\\.…"
SHAPES = (
    ("address", re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]+")), ("at", re.compile(r".*@.*")),
    ("quad", re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")), ("dotted", re.compile(r"[0-9]+(\.[0-9]+)+")),
    ("plus", re.compile(r"\+[0-9]{1,3}")), ("plus_long", re.compile(r"\+[0-9().-]{6,}")),
    ("area", re.compile(r"\([0-9]{2,4}\)")), ("local", re.compile(r"[0-9]{3,4}-[0-9]{3,4}")),
    ("hyphens", re.compile(r"[0-9]+(-[0-9]+){2,}")), ("four", re.compile(r"[0-9]{4}")),
    ("d1_3", re.compile(r"[0-9]{1,3}")), ("d5_7", re.compile(r"[0-9]{5,7}")), ("d8_15", re.compile(r"[0-9]{8,15}")),
    ("d16_19", re.compile(r"[0-9]{16,19}")), ("d20", re.compile(r"[0-9]{20,}")), ("letters", re.compile(r".*[^\W\d_].*")),
)
CHECK_BIT = len(SHAPES)             # 16 to 19 digits whose check digit fits
#: Own shape, check digit, then what stands before and after: nothing or a word, or a node of one of 4 coarse shapes.
WIDTH = len(SHAPES) + 1 + 10
ROUNDS, DAMPING, SURE = 8, 0.5, 0.9


def shape(token: str) -> int:
    """Bit mask of the shapes a token has."""
    mask = sum(1 << i for i, (_, p) in enumerate(SHAPES) if p.fullmatch(token))
    digits = _NOT_DIGIT.sub("", token)
    if 16 <= len(digits) <= 19 and luhn(digits):
        mask |= 1 << CHECK_BIT
    return mask


def _coarse(mask: int | None) -> int:
    if mask is None:
        return 0
    if mask & 0b10000:
        return 1
    return 2 if mask & 0b1000000 else 3 if mask & 0b1000000000 else 4


def nodes(text: str) -> tuple[list[tuple[int, int]], list[int], list[tuple[int, int]], list[tuple[int, int]]]:
    """(spans, feature masks, chain edges, skip edges) of one document."""
    if not NODE.search(text):
        return [], [], [], []
    spans, masks, place, keys = [], [], [], []
    for i, m in enumerate(TOKEN.finditer(text)):
        s = m[0]
        if not NODE.search(s):
            continue
        core = s.strip(EDGE)
        if not core or not NODE.search(core):
            continue
        a = m.start() + s.index(core)
        spans.append((a, a + len(core)))
        masks.append(shape(core))
        place.append(i)
        digits = _NOT_DIGIT.sub("", core)
        keys.append(digits if len(digits) >= 7 and "@" not in core else core.lower())
    chain = [(i, i + 1) for i in range(len(place) - 1) if place[i + 1] == place[i] + 1]
    before, after = [None] * len(masks), [None] * len(masks)
    for i, j in chain:
        before[j], after[i] = masks[i], masks[j]
    full = [m | 1 << (CHECK_BIT + 1 + _coarse(b)) | 1 << (CHECK_BIT + 6 + _coarse(a))
            for m, b, a in zip(masks, before, after, strict=True)]
    last: dict[str, int] = {}
    skip = []
    for i, k in enumerate(keys):
        if k in last and (last[k], i) not in chain[-1:]:
            skip.append((last[k], i))
        last[k] = i
    return spans, full, chain, skip


def labels(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """The kind whose rule span overlaps each token, else outside."""
    order = sorted(base, key=lambda s: s[1])
    out = []
    for a, b in spans:
        out.append(next((k for k, s, e in order if s < b and a < e), OUTSIDE))
    return out


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """what ('unary', 'chain', 'skip'), a, b, n: labelled feature masks and labelled edges of all documents."""
    def make():
        def run(v: dict) -> list:
            c: Counter = Counter()
            for t in v[text]:
                spans, masks, chain, skip = nodes(t)
                if not spans:
                    continue
                y = labels(spans, base_spans(t))
                unsure = doubtful(t)
                sure = [not any(s < b and a < e for s, e in unsure) for a, b in spans] if unsure else [True] * len(y)
                c.update(("unary", m, k) for m, k, ok in zip(masks, y, sure, strict=True) if ok)
                c.update(("chain", y[i], y[j]) for i, j in chain if sure[i] and sure[j])
                c.update(("skip", y[i], y[j]) for i, j in skip if sure[i] and sure[j])
            return [[k[0] for k in c], [k[1] for k in c], [k[2] for k in c], list(c.values())]
        return run

    rows = explode_rows(docs, make, [text], {"what": "string", "a": "long", "b": "long", "n": "long"}, text)
    return rows.groupBy("what", "a", "b").agg(F.sum("n").alias("n"))


def bits(masks) -> np.ndarray:
    """Feature matrix of masks, with a constant column."""
    m = np.asarray(masks, np.int64)
    x = ((m[:, None] >> np.arange(WIDTH)) & 1).astype(np.float64)
    return np.concatenate([x, np.ones((len(m), 1))], axis=1)


class Field:
    """Trained weights: unary (features x kinds), chain and skip (kind x kind)."""

    def __init__(self, rows: list[tuple[str, int, int, int]], steps: int = 400, ridge: float = 1e-4):
        unary = [r for r in rows if r[0] == "unary"]
        self.known = bool(unary)
        if not self.known:
            return
        x = bits([r[1] for r in unary])
        y = np.eye(5)[[r[2] for r in unary]]
        n = np.array([r[3] for r in unary], np.float64)
        n /= n.sum()
        w, m, v = np.zeros((x.shape[1], 5)), 0.0, 0.0
        for t in range(1, steps + 1):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ (n[:, None] * (p - y)) + ridge * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        self.unary = w
        self.chain = self._potential(rows, "chain")
        self.skip = self._potential(rows, "skip")

    @staticmethod
    def _potential(rows, what: str) -> np.ndarray:
        """Log ratio of how often two kinds share an edge to how often chance would put them there."""
        c = np.full((5, 5), 0.5)
        for k, a, b, n in rows:
            if k == what:
                c[a, b] += n
        if what == "skip":
            c = c + c.T
        p = c / c.sum()
        return np.clip(np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))), -4, 4)

    def marginals(self, masks: list[int], chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Sum-product loopy belief propagation; edges are (from, to) rows."""
        log_u = bits(masks) @ self.unary
        log_u -= log_u.max(1, keepdims=True)
        edges = np.concatenate([chain, skip]).astype(np.int64)
        if not len(edges):
            p = np.exp(log_u)
            return p / p.sum(1, keepdims=True)
        pot = np.exp(np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)]))
        e = len(edges)
        src = np.concatenate([edges[:, 0], edges[:, 1]])
        dst = np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        msg = np.zeros((2 * e, 5))                      # log messages src -> dst

        def belief() -> np.ndarray:
            b = log_u.copy()
            np.add.at(b, dst, msg)
            return b

        for _ in range(ROUNDS):
            out = belief()[src] - msg[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.maximum(np.einsum("ei,eij->ej", out, pot), 1e-300))
            new -= new.max(1, keepdims=True)
            msg = DAMPING * msg + (1 - DAMPING) * new
        b = belief()
        p = np.exp(b - b.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def scan(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Rule spans, and all spans, of each text."""
    base = [base_spans(t) for t in texts]
    graphs = [nodes(t) for t in texts]
    total = sum(len(g[0]) for g in graphs)
    if not field.known or not total:
        return [(b, b) for b in base]
    shift = np.cumsum([0, *(len(g[0]) for g in graphs)])
    masks = [m for g in graphs for m in g[1]]
    chain = np.array([(i + s, j + s) for g, s in zip(graphs, shift, strict=False) for i, j in g[2]], np.int64).reshape(-1, 2)
    skip = np.array([(i + s, j + s) for g, s in zip(graphs, shift, strict=False) for i, j in g[3]], np.int64).reshape(-1, 2)
    p = field.marginals(masks, chain, skip)
    best, sure = p.argmax(1), p.max(1)
    out = []
    for b, g, s in zip(base, graphs, shift.tolist(), strict=False):
        linked = {j: i for i, j in g[2]}
        more: list[list[int]] = []
        owner: dict[int, int] = {}
        for i, (a, e) in enumerate(g[0]):
            k = int(best[s + i])
            if k == OUTSIDE or sure[s + i] < SURE or any(x < e and a < y for _, x, y in b):
                continue
            if k != 2 and (q := owner.get(linked.get(i, -1))) is not None and more[q][0] == k:
                more[q][2] = e                          # one mention over several tokens
                owner[i] = q
            else:
                owner[i] = len(more)
                more.append([k, a, e])
        out.append((b, sorted(b + [tuple(m) for m in more])))
    return out


def find_personal_data(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """`carry` columns with counts by kind and spans of the rules, and all spans."""
    rows = [(r.what, r.a, r.b, r.n) for r in counts(docs, text).collect()]      # bounded by the feature masks
    field = Field(sorted(rows))

    def make():
        def run(v: dict) -> list:
            cols: list[list] = [[] for _ in range(6)]
            for base, spans in scan(v[text], field):
                kinds = [k for k, _, _ in base]
                for c, x in zip(cols, [*(kinds.count(k) for k in range(4)), written(base), written(spans)], strict=True):
                    c.append(x)
            return cols
        return run

    return map_rows(docs, make, [text], carry, {"n_email": "long", "n_ip": "long", "n_card": "long", "n_phone": "long",
                                                "base": "string", "spans": "string"}, text)


def op10_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document with counts, the digest of the rule spans and all spans."""
    return find_personal_data(docs, ["doc_id"]).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
