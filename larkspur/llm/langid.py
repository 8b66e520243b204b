"""Language identification by error-correcting output codes over byte n-grams.

Every learned language gets a binary codeword. One binary classifier per bit, a naive Bayes
log-odds model over hashed byte n-grams, votes on a whole text; the loss-weighted distance to
each codeword picks the language, and a small margin flags the text as ambiguous. Weights are
integers, so a text's score does not depend on how rows are batched.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import textbytes as tb
from larkspur.llm.storage import small_batches

ORDERS = (2, 3, 4)
SLOTS = 1 << 16
#: Bound of the training sample: about so many documents of each language, of any length. Their
#: grams are counted where the texts are; the driver gets SLOTS counts a language.
SAMPLE_PER_LANGUAGE = 800
#: Languages whose counts a task holds before it passes them on, and parts of a language's counts.
HELD_LANGUAGES, COUNT_PARTS = 32, 8
GAIN = 4.0
UNIT = 1024.0  # weights are stored in 1/UNIT of a nat
#: A text whose best two losses differ by less than this share is ambiguous.
AMBIGUOUS = 0.1

# digits, ASCII punctuation and white space are one symbol; A-Z are lower-cased
_FOLD = tb.LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1. Up to 7 languages: exhaustive codes; more: seeded random codes, rows distinct."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int64)
    if n <= 7:
        bits = (1 << (n - 1)) - 1
        # column j holds the binary digits of j+1 for languages 2..n; the first language is all +1
        table = np.array([[1 - 2 * ((j >> (i - 1)) & 1) if i else 1 for j in range(1, bits + 1)] for i in range(n)])
        return table.astype(np.int64)
    rng, bits = np.random.default_rng(7), 10 * int(np.ceil(np.log2(n)))
    while True:
        table = rng.choice(np.array([-1, 1]), size=(n, bits))
        if len(np.unique(table, axis=0)) == n and (np.abs(table.sum(0)) < n).all():
            return table.astype(np.int64)


def gram_slots(data: np.ndarray, order: int) -> np.ndarray:
    """Slots of the ``order``-byte grams of folded bytes."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, dtype=np.uint32)
    for k in range(order):
        h = h * np.uint32(0x9E3779B1) + data[k : k + n] + np.uint32(1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77) + np.uint32(2 * order)
    return (h >> np.uint32(16)).astype(np.int64) & (SLOTS - 1)


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray  # SLOTS x bits, int32

    def votes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Summed votes (rows x bits) and gram counts of whole texts."""
        offsets, data = tb.buffers(column)
        out = np.zeros((len(column), self.codes.shape[1]), dtype=np.int64)
        count = np.zeros(len(column), dtype=np.int64)
        for i, j in tb.groups(offsets, 1 << 18):
            lo, hi = offsets[i], offsets[j]
            for at in range(lo, hi, tb.PIECE):  # a long text in pieces that overlap by a gram
                piece = _FOLD[data[at : min(hi, at + tb.PIECE + max(ORDERS) - 1)]]
                for n in ORDERS:
                    slots = gram_slots(piece, n)[: tb.PIECE]
                    if not len(slots):
                        continue
                    # grams that begin in a row's last n-1 bytes would run into the next row
                    starts = np.clip(offsets[i:j] - at, 0, len(slots))
                    ends = np.clip(offsets[i + 1 : j + 1] - at - n + 1, 0, len(slots))
                    full = np.flatnonzero(ends > starts)
                    if not len(full):
                        continue
                    cuts = np.stack([starts[full], ends[full]], 1).ravel()
                    votes = np.concatenate([self.weights[slots], np.zeros((1, self.weights.shape[1]), np.int32)])
                    out[i + full] += np.add.reduceat(votes, cuts, axis=0, dtype=np.int64)[0::2]
                    count[i + full] += ends[full] - starts[full]
        return out, count

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score 0 to 1, ambiguous) of each text."""
        votes, count = self.votes(column)
        if len(self.languages) == 1:
            return np.zeros(len(column), np.int64), np.ones(len(column)), np.zeros(len(column), bool)
        # a bit's margin is its mean log-odds per gram, so that long texts are not all certain
        f = GAIN * votes / UNIT / np.maximum(count, 1)[:, None]
        loss = np.log1p(np.exp(-np.clip(f[:, None, :] * self.codes[None], -30, 30))).mean(2)
        best = loss.argmin(1)
        odds = np.exp(-(loss - loss.min(1, keepdims=True)) * self.codes.shape[1])
        ranked = np.sort(loss, 1)
        return best, odds.max(1) / odds.sum(1), ranked[:, 1] - ranked[:, 0] < AMBIGUOUS * np.log(2)


def gram_counts(data: np.ndarray) -> np.ndarray:
    """Counts by slot of all grams of a text's bytes."""
    out = np.zeros(SLOTS, dtype=np.int64)
    for at in range(0, len(data), tb.PIECE):  # in pieces that overlap by a gram
        piece = _FOLD[data[at : at + tb.PIECE + max(ORDERS) - 1]]
        for n in ORDERS:
            out += np.bincount(gram_slots(piece, n)[: tb.PIECE], minlength=SLOTS)
    return out


def fit_counted(counts: Iterable[tuple[str, np.ndarray]]) -> LanguageModel:
    """Learn from (language, counts by slot), each language once; their order does not matter.

    A bit's weights are the log-odds of the mean gram shares of its languages with +1 and with -1;
    languages weigh alike.
    """
    found = sorted(counts, key=lambda x: x[0])
    codes = codewords(len(found))
    if not found:
        return LanguageModel([], np.zeros((0, 1), np.int64), np.zeros((SLOTS, 1), np.int32))
    all_, yes = np.zeros(SLOTS), np.zeros((SLOTS, codes.shape[1]))
    for (_, c), code in zip(found, codes, strict=True):
        share = (c + 0.05) / (c.sum() + 0.05 * SLOTS)
        all_ += share
        yes[:, code > 0] += share[:, None]
    weights = np.zeros_like(yes)
    for b in range(codes.shape[1]):
        n = int((codes[:, b] > 0).sum())
        if 0 < n < len(found):
            weights[:, b] = np.log(yes[:, b] / n) - np.log(np.maximum(all_ - yes[:, b], 1e-300) / (len(found) - n))
    return LanguageModel([x for x, _ in found], codes, np.rint(weights * UNIT).astype(np.int32))


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    """:func:`fit_counted` over (text, language) rows."""
    counts: dict[str, np.ndarray] = {}
    for text, lang in rows:
        c = gram_counts(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8))
        counts[lang] = counts[lang] + c if lang in counts else c
    return fit_counted(counts.items())


def training_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, np.ndarray]]:
    """(language, gram counts) of about SAMPLE_PER_LANGUAGE rows of every language, drawn by a hash of
    id and text. Rows equal in both are drawn together."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language, as the model has
    if not sizes:
        return []
    shares = docs.sparkSession.createDataFrame([(x, SAMPLE_PER_LANGUAGE / n) for x, n in sizes.items()], "l string, share double")
    draw = F.pmod(F.xxhash64("id", "text", F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    # the shares are a row per language of the model, which is broadcast later too
    picked = rows.join(F.broadcast(shares), (F.col("lang") == F.col("l")) & (draw < F.col("share"))).select("lang", "text")
    each = SLOTS // COUNT_PARTS

    def out(held: dict) -> pa.RecordBatch:
        names = [x for x in held for _ in range(COUNT_PARTS)]
        parts = [c[k * each : (k + 1) * each].tobytes() for c in held.values() for k in range(COUNT_PARTS)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(range(COUNT_PARTS)) * len(held), pa.int32()), pa.array(parts, pa.binary())], names=["lang", "part", "counts"])

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            offsets, data = tb.buffers(b.column(1))
            for lang, lo, hi in zip(b.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                held[lang] = held.get(lang, 0) + gram_counts(data[lo:hi])
                if len(held) >= HELD_LANGUAGES:
                    yield out(held)
                    held = {}
            tb.release()
        yield out(held)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(each, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), dtype=np.int64)
        return pa.table({"lang": table.column("lang").slice(0, 1), "part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, part int, counts binary"
    found: dict[str, np.ndarray] = {}
    for r in picked.mapInArrow(count, schema).groupBy("lang", "part").applyInArrow(add, schema).collect():
        found.setdefault(r["lang"], np.zeros(SLOTS, np.int64))[r["part"] * each : (r["part"] + 1) * each] = np.frombuffer(r["counts"], dtype=np.int64)
    return list(found.items())


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Add lang_pred, score (0 to 1) and ambiguous to the rows of ``docs`` (its other columns stay).

    Learned from the rows of ``train`` only. A null text and a text without any letter is ``und``
    with score 0; so is every text if nothing was learned. Null languages are not learned.
    Columns of ``docs`` named like a result are replaced.
    """
    small_batches(docs.sparkSession)
    model = fit_counted(training_counts(train, id_col, text_col, lang_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x bits integers at most

    @F.arrow_udf("struct<lang:string, score:double, ambiguous:boolean>")
    def judge(column: pa.Array) -> pa.Array:
        m = shared.value
        if not m.languages:
            return pa.StructArray.from_arrays([pa.array([None] * len(column), pa.string()), pa.array(np.zeros(len(column))), pa.array([True] * len(column))], ["lang", "score", "ambiguous"])
        best, score, unsure = m.predict(column)
        tb.release()
        return pa.StructArray.from_arrays([pa.array([m.languages[i] for i in best], pa.string()), pa.array(score), pa.array(unsure)], ["lang", "score", "ambiguous"])

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    some = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    found = docs.select(*keep, some.alias("__letters"), judge(F.col(text_col)).alias("__judged"))
    known = F.col("__letters") & F.col("__judged.lang").isNotNull()
    return found.select(
        *keep, F.when(known, F.col("__judged.lang")).otherwise("und").alias("lang_pred"), F.when(known, F.col("__judged.score")).otherwise(0.0).alias("score"), (~known | F.col("__judged.ambiguous")).alias("ambiguous")
    )
