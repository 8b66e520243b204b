"""Personal data: exact base patterns, joined by spans that a semi-Markov CRF adds.

The base finds email, ip, card and phone by fixed patterns. The semi-Markov conditional random
field looks at runs of text that hold digits or an at-sign: every candidate segment of up to
MAX_UNITS units is scored as a whole (its shape, checks, neighbours and the word before), and
dynamic programming chooses boundaries and types of all segments of a run together. Its weights
are learned on the driver from a generated set of lines, by exact likelihood gradients, and
broadcast. Runs are found in linear time. Spans it finds are added where they touch no base span; base spans always stay.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.storage import small_batches

KINDS = ("email", "ip", "card", "phone")
MAX_UNITS, MAX_CHARS, MAX_GROUPS = 16, 80, 6  # of an entity; groups are runs of digits

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # as [0-9]+(\.[0-9]+){3}: no shorter start can fit where a longer one fails
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[(](?:at|AT)[\])]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, in linear time."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            out.append((start, free))
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base's matches, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    out.sort()
    return out


# ---- the semi-Markov CRF -------------------------------------------------------------------

_NUMBERS = re.compile(r"[+(]?[0-9][0-9\x20().+\-]*+")
_AT = re.compile(r"\x20?[\[(](?:at|AT)[\])]\x20?")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++")
_UNIT = re.compile(r"[0-9]+|[A-Za-z_%]+|.", re.S)
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}$")
_N_WORDS, _N_SHAPE = 64, 40
_TYPES = len(KINDS) + 1  # 0: outside


def runs(text: str) -> list[tuple[int, int]]:
    """(start, end) of the runs that may hold entities, in order: addresses spelled with [at], and
    runs of digits and their marks in between. Each bracket walks left at most to the one before."""
    spelled, free = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        after = _AFTER_AT.match(text, m.end()) if start < m.start() else None
        free = after.end() if after else m.end()
        if after:
            spelled.append((start, free))
    out, at = [], 0
    for start, end in [*spelled, (len(text), len(text))]:
        out += [m.span() for m in _NUMBERS.finditer(text, at, start)]
        if end > start:
            out.append((start, end))
        at = end
    return out


def _features(text: str, start: int, end: int) -> list[int]:
    """Whole-span features (indices below _N_SHAPE + _N_WORDS)."""
    span = text[start:end]
    d = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    has = [
        True,
        "@" in span or bool(re.search(r"[\[(](?:at|AT)[\])]", span)),
        span[0] == "+",
        span[0] == "(",
        "(" in span and ")" in span,
        len(d) < 7, 7 <= len(d) <= 9, len(d) == 10, 11 <= len(d) <= 13, 14 <= len(d) <= 16, 17 <= len(d) <= 19, len(d) > 19,
        14 <= len(d) <= 19 and luhn(d),
        13 <= len(d) <= 19 and not luhn(d),
        span.count(".") == 3, span.count(".") == 2, span.count(".") == 1,
        len(groups) == 4 and all(len(g) <= 3 and int(g) < 256 for g in groups) and span.count(".") == 3,
        len(groups) == 1, len(groups) == 2, len(groups) == 3, len(groups) == 4, len(groups) > 4,
        len(groups) >= 2 and {len(g) for g in groups[:-1]} == {4},
        len(groups) >= 2 and [len(g) for g in groups][-2:] == [3, 4],
        len(groups) == 3 and [len(g) for g in groups] == [4, 2, 2],
        "-" in span, " " in span, "  " in span,
        bool(re.search(r"[A-Za-z]", span)),
        start > 0 and (text[start - 1].isalnum() or text[start - 1] in "+.,$#/"),
        end < len(text) and (text[end].isalnum() or (text[end] in ".,:/-" and text[end + 1 : end + 2].isalnum())),
        not span[-1].isalnum(),
    ]
    out = [i for i, x in enumerate(has) if x]
    before = _WORD_BEFORE.search(text, max(0, start - 24), start)
    word = before.group(1).lower() if before else ""
    out.append(_N_SHAPE + int.from_bytes(hashlib.md5(word.encode()).digest()[:2], "big") % _N_WORDS)
    return out


def _lattice(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Unit borders of a run and its candidate segments (first border, last border, features)."""
    units = [(m.start(), m.end()) for m in _UNIT.finditer(text, start, end)]
    borders = [u[0] for u in units] + [end]
    held = [len(_digits(text[s:e])) for s, e in units]
    digits, groups = np.cumsum([0, *held]).tolist(), np.cumsum([0, *(n > 0 for n in held)]).tolist()
    letters = any(text[s].isalpha() for s, _ in units)
    found = []
    for i, (s, _) in enumerate(units):
        if not (text[s].isalnum() or text[s] in "+("):
            continue
        for j in range(i + 1, min(len(units), i + MAX_UNITS) + 1):
            e = borders[j]
            if e - s > MAX_CHARS:
                break
            n = digits[j] - digits[i]
            if n > 19 or groups[j] - groups[i] > MAX_GROUPS:
                break
            if text[e - 1].isalnum() and (7 <= n or letters or text.count(".", s, e) == 3):
                found.append((i, j, _features(text, s, e)))
    return borders, found


def _scores(weights: np.ndarray, found: list) -> list[np.ndarray]:
    return [weights[:, f].sum(1) for _, _, f in found]


def _forward(n: int, arcs: dict[int, list], backward: bool = False) -> np.ndarray:
    out = np.full(n + 1, -np.inf)
    out[n if backward else 0] = 0.0
    for p in range(n - 1, -1, -1) if backward else range(1, n + 1):
        for q, s in arcs.get(p, ()):
            out[p] = np.logaddexp(out[p], out[q] + s)
    return out


def _gradient(weights: np.ndarray, n: int, found: list, gold: set) -> np.ndarray:
    """Of the log-likelihood of the gold segments (first, last, type) of one run."""
    scores = _scores(weights, found)
    into, out_of = {}, {}
    for p in range(n):  # an outside unit scores 0
        into.setdefault(p + 1, []).append((p, 0.0))
        out_of.setdefault(p, []).append((p + 1, 0.0))
    for (i, j, _), s in zip(found, scores, strict=True):
        for x in s[1:]:
            into.setdefault(j, []).append((i, x))
            out_of.setdefault(i, []).append((j, x))
    alpha, beta = _forward(n, into), _forward(n, out_of, backward=True)
    total, grad = alpha[n], np.zeros_like(weights)
    for (i, j, f), s in zip(found, scores, strict=True):
        for t in range(1, _TYPES):
            grad[t, f] += ((i, j, t) in gold) - np.exp(alpha[i] + s[t] + beta[j] - total)
    return grad


def decode(weights: np.ndarray, n: int, found: list) -> list[tuple[int, int, int]]:
    """The best segmentation's entities (first, last, type), by bounded-entity Viterbi."""
    best, back = np.zeros(n + 1), [None] * (n + 1)
    ends: dict[int, list] = {}
    for (i, j, _), s in zip(found, _scores(weights, found), strict=True):
        t = int(np.argmax(s[1:])) + 1
        ends.setdefault(j, []).append((i, t, float(s[t])))
    for p in range(1, n + 1):
        best[p] = best[p - 1]
        for i, t, s in ends.get(p, ()):
            if best[i] + s > best[p]:
                best[p], back[p] = best[i] + s, (i, p, t)
    out, p = [], n
    while p > 0:
        if back[p]:
            out.append(back[p])
            p = back[p][0]
        else:
            p -= 1
    return out[::-1]


def _training_lines(seed: int = 8) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated lines with gold spans (start, type, end): contacts, and numbers that are none."""
    r = random.Random(seed)
    dig = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = r.choice("3456") + dig(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def entity() -> tuple[int, str]:
        k = r.randrange(6)
        if k == 0:
            a, b = r.choice([(" [at] ", " [dot] "), ("[at]", "."), ("(at)", "(dot)"), (" (at) ", ".")])
            return 1, f"{r.choice(['ann', 'bob.w', 'c_d', 'mail'])}{a}{r.choice(['host', 'site-x', 'post'])}{b}{r.choice(['com', 'org', 'net'])}"
        if k == 1:
            return 2, ".".join(str(r.randrange(256)) for _ in range(4))
        if k == 2:
            c, s = card(), r.choice([" ", "-", ""])
            return 3, s.join(c[i : i + 4] for i in range(0, 16, 4))
        if k == 3:
            return 4, f"+{r.randrange(1, 99)} {dig(3)} {dig(3)} {dig(4)}"
        if k == 4:
            return 4, f"({dig(3)}) {dig(3)}-{dig(4)}"
        return 4, f"{dig(3)}{(s := r.choice('-. '))}{dig(3)}{s}{dig(4)}"

    def other() -> str:
        k = r.randrange(7)
        if k == 0:
            return f"{r.randrange(1900, 2100)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}"
        if k == 1:
            return dig(r.randrange(7, 22))
        if k == 2:
            return f"{dig(r.randrange(1, 4))}.{dig(r.randrange(5, 9))}"
        if k == 3:
            return " ".join(dig(r.randrange(1, 5)) for _ in range(r.randrange(4, 9)))
        if k == 4:
            return f"{dig(2)}.{dig(2)}.{dig(4)} {dig(2)}"
        if k == 5:
            return f"{dig(3)} {dig(3)} {dig(3)} {dig(3)}"
        return f"{dig(4)} {dig(4)} {dig(4)} {dig(3)}"

    lines = []
    for _ in range(700):
        lead = r.choice(["the ", "of ", "in "])
        if r.random() < 0.55:
            kind, s = entity()
            lead = r.choice([lead, {1: "mail ", 2: "ip ", 3: "card ", 4: r.choice(["phone ", "call ", "tel "])}[kind]])
            lines.append((f"{lead}{s} and", [(len(lead), kind, len(lead) + len(s))]))
        else:
            lead = r.choice([lead, "order ", "total ", "no ", "version ", "date "])
            lines.append((f"{lead}{other()} and", []))
    return lines


@lru_cache(maxsize=1)
def trained_weights() -> np.ndarray:
    """Weights (types x features), fitted by AdaGrad on the likelihood of the generated lines."""
    weights = np.zeros((_TYPES, _N_SHAPE + _N_WORDS))
    square = np.full_like(weights, 1e-2)
    lattices = []
    for text, gold in _training_lines():
        for start, end in runs(text):
            borders, found = _lattice(text, start, end)
            place = {b: i for i, b in enumerate(borders)}
            want = {(place[s], place[e], k) for s, k, e in gold if s in place and e in place}
            lattices.append((len(borders) - 1, found, want))
    for _ in range(4):
        for n, found, want in lattices:
            g = _gradient(weights, n, found, want) - 1e-3 * weights
            square += g * g
            weights += 0.3 * g / np.sqrt(square)
    return weights


def crf_spans(text: str, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) that the CRF finds in a whole text."""
    out = []
    for start, end in runs(text):
        if end - start < 7:
            continue
        borders, found = _lattice(text, start, end)
        if found:
            out += [(borders[i], t - 1, borders[j]) for i, j, t in decode(weights, len(borders) - 1, found)]
    return out


def all_spans(text: str, weights: np.ndarray) -> tuple[list, list]:
    """(base spans, base and added spans), both sorted by start, then kind."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((s, e) for s, _, e in base)
    starts = [s for s, _ in taken]
    reach = list(np.maximum.accumulate([e for _, e in taken])) if taken else []
    added = []
    for s, k, e in crf_spans(text, weights):
        at = int(np.searchsorted(starts, e))  # base spans that begin before e
        if at == 0 or reach[at - 1] <= s:
            added.append((s, k, e))
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, base counts per kind, n_added, n_spans, base_sha256, spans (all).

    A null text is empty: no spans, the SHA-256 of the empty string. Offsets count code points,
    ends are exclusive. n_* count the base's spans; n_added those that the CRF adds, n_spans all. Rows with
    equal ids each give a row. Other columns are ignored.
    """
    result = "struct<n_email:bigint, n_ip:bigint, n_card:bigint, n_phone:bigint, n_added:bigint, n_spans:bigint, base_sha256:string, spans:string>"

    shared = docs.sparkSession.sparkContext.broadcast(trained_weights())  # types x features

    @F.arrow_udf(result)
    def scan(column: pa.Array) -> pa.Array:
        weights, rows = shared.value, []
        for x in column:
            base, both = all_spans(x.as_py() or "", weights)
            rows.append((*(sum(k == n for _, k, _ in base) for n in range(4)), len(both) - len(base), len(both), hashlib.sha256(joined(base).encode()).hexdigest(), joined(both)))
        cols = list(zip(*rows, strict=True)) or [()] * 8
        return pa.StructArray.from_arrays([pa.array(c, pa.int64() if i < 6 else pa.string()) for i, c in enumerate(cols)], ["n_email", "n_ip", "n_card", "n_phone", "n_added", "n_spans", "base_sha256", "spans"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), scan(F.col(text_col)).alias("__found")).select(id_col, "__found.*")
