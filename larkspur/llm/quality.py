"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal.

Tokens are runs of letters or digits and runs of other visible bytes, so marks glued to words
count on their own. Features are hashed 1- and 2-grams of tokens (a token repeated at once also
counts as a repeat), with frequencies normalised by the text's length: a score is one sparse
dot product per text. Weights are stored as integers, so scores do not depend on batching.

Every labelled text is learned from. Few are on the driver; more are dealt by their ids to shards,
each of which is learned where it is, and a weight is the mean of its shards', by the squared
gradients that it rests on there: one that a single shard has seen is that shard's.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import textbytes as tb
from larkspur.llm.storage import BitFilter, discard, small_batches, written

SLOTS = 1 << 18
#: A shard of the labelled texts: about so many, and so many bytes of their compressed features, on
#: average. A single one is learned on the driver. Their number follows from the rows alone.
SHARD_DOCS, SHARD_BYTES = 9600, 64 << 20
#: FTRL-proximal: learning rate, its smoothing, L1, L2; passes over a shard.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 1e-4, 1e-4, 4
GAIN = 16.0  # frequencies are multiplied by this
UNIT = float(1 << 20)
THRESHOLD = 0.3

# byte classes: 0 white space, 1 letters, digits and all of UTF-8 beyond ASCII, 2 other marks
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[tb.WHITE] = 0
_CLASS[[i for i in range(256) if i >= 128 or chr(i).isalnum()]] = 1
_REPEAT = 0


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the tokens of one piece."""
    low = tb.LOWER[data]
    kind = _CLASS[low]
    if not len(kind):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cut = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
    end = np.append(cut[1:], len(kind))
    word = kind[cut] != 0
    return tb.run_hashes(low, cut[word], end[word]), cut[word]


def _features(tokens: np.ndarray) -> np.ndarray:
    """Slots of a token sequence: each token, then each pair (2 n - 1 of them)."""
    one = (tokens >> np.uint64(46)).astype(np.int64)
    if len(tokens) < 2:
        return one
    pair = (tb.mix(tokens[:-1] * np.uint64(3) + tokens[1:]) >> np.uint64(46)).astype(np.int64)
    pair[tokens[:-1] == tokens[1:]] = _REPEAT
    return np.concatenate([one, pair])


def each_features(column: pa.Array):
    """Yield the feature slots of every row; long texts are cut between tokens, pairs span the cuts."""
    offsets, data = tb.buffers(column)
    for i, j in tb.groups(offsets):
        lo, hi = offsets[i], offsets[j]
        if j == i + 1 and hi - lo > tb.PIECE:
            parts, at = [], lo
            while at < hi:
                to = min(hi, at + tb.PIECE)
                if to < hi:
                    kind = _CLASS[data[at:to]]
                    back = np.flatnonzero(kind[1:] != kind[:-1])
                    if len(back):
                        to = at + int(back[-1]) + 1
                    else:  # one token to the end of the piece and maybe beyond
                        while to < hi and (more := np.flatnonzero(_CLASS[data[to : to + tb.PIECE]] != kind[0])).size == 0:
                            to = min(hi, to + tb.PIECE)
                        to = to + int(more[0]) if to < hi else hi
                parts.append(_tokens(data[at:to])[0])
                at = to
            yield _features(np.concatenate(parts))
            continue
        cuts = offsets[i : j + 1] - lo
        h, s = _tokens(np.insert(data[lo:hi], cuts[1:-1], 32))
        at = np.searchsorted(s, cuts + np.arange(len(cuts)))
        for k in range(j - i):
            yield _features(h[at[k] : at[k + 1]])


@dataclass
class QualityModel:
    weights: np.ndarray  # int64, in 1/UNIT
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for i, slots in enumerate(each_features(column)):
            x = GAIN * int(self.weights[slots].sum()) / UNIT / max(1, len(slots))
            out[i] = self.bias + x
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def packed(column: pa.Array):
    """Yield (key, features) of every row: distinct slots (as their differences) and their counts, byte by
    byte and compressed, and a digest of them that orders rows in any place."""
    for slots in each_features(column):
        at, count = np.unique(slots, return_counts=True)
        key = hashlib.md5(np.stack([at, count]).astype(np.int32).tobytes(), usedforsecurity=False).digest()
        planes = np.stack([np.diff(at, prepend=0), count]).astype(np.int32).view(np.uint8).reshape(-1, 4).T
        yield key, zlib.compress(planes.tobytes(), 1)


def _unpacked(features: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of :func:`packed`."""
    planes = np.frombuffer(zlib.decompress(features), np.uint8).reshape(4, -1)
    steps, count = np.ascontiguousarray(planes.T).view(np.int32).reshape(2, -1)
    return np.cumsum(steps, dtype=np.int32), count


def _descended(rows: list[tuple[bytes, bytes, int]], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, sums of squared gradients) of the slots and the bias, after all passes over the rows."""
    rows = sorted(rows)
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        for k in rng.permutation(len(rows)):
            _, features, label = rows[k]
            slots, count = _unpacked(features)
            at = np.append(slots, np.int32(SLOTS))
            x = np.append(GAIN * count / max(1, int(count.sum())), 1.0).astype(np.float32)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - label) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[at] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)), n


def fit_packed(rows: list[tuple[bytes, bytes, int]], seed: int = 6) -> QualityModel:
    """FTRL-proximal over (key, features, label 0 or 1) rows of :func:`packed`, in a fixed shuffled order."""
    w, _ = _descended(rows, seed)
    return QualityModel(np.rint(w[:SLOTS] * UNIT).astype(np.int64), float(w[SLOTS]))


def fit(rows: list[tuple[str, int]], seed: int = 6) -> QualityModel:
    """:func:`fit_packed` over (text, label) rows."""
    return fit_packed([(*c, label) for c, (_, label) in zip(packed(pa.array([t for t, _ in rows], pa.string())), rows, strict=True)], seed)


def fit_shards(rows: DataFrame, shards: int, seed: int = 6) -> QualityModel:
    """As :func:`fit_packed`, of every shard of the rows of :func:`training_rows`, in its place, and the
    means of their weights. Sums of whole numbers are combined, so the order of shards does not matter."""

    def fitted(table: pa.Table) -> pa.Table:
        w, n = _descended(list(zip(*(table.column(c).to_pylist() for c in ("key", "features", "label")), strict=True)), seed)
        at = np.flatnonzero(n)
        value, evidence = np.rint(w[at] * UNIT).astype(np.int64), np.maximum(1, np.rint(n[at] * UNIT)).astype(np.int64)
        return pa.table({"slot": pa.array(at, pa.int32()), "value": pa.array(value), "evidence": pa.array(evidence)})

    shard = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards)).cast("int")
    dealt = rows.select(shard.alias("shard"), "key", "features", "label").repartitionById(shards, F.col("shard"))  # a task each
    states = dealt.groupBy("shard").applyInArrow(fitted, "slot int, value bigint, evidence bigint")
    wide = F.col("evidence").cast("decimal(18,0)")
    sums = states.groupBy("slot").agg(F.sum(F.col("value").cast("decimal(18,0)") * wide).cast("double").alias("value"), F.sum(wide).cast("double").alias("evidence"))
    found = sums.toArrow()  # a row per slot at most
    weights = np.zeros(SLOTS + 1, np.int64)
    weights[found["slot"].to_numpy()] = np.rint(found["value"].to_numpy() / found["evidence"].to_numpy())
    return QualityModel(weights[:SLOTS], int(weights[SLOTS]) / UNIT)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, key, features, label) of every document labelled 0 or 1, counted where the texts are: only
    features are shuffled. Of rows with an equal id the one with the largest key counts, of several
    labels the largest."""
    small_batches(docs.sparkSession)
    same = F.col(id_col).cast(docs.select(id_col).schema[0].dataType).cast("string")
    known = labels.where(F.col(label_col).isNotNull()).select(same.alias("known"), F.col(label_col).alias("label")).where("known is not null")
    known = written(known.groupBy("known").agg(F.max("label").cast("int").alias("label")).where("label in (0, 1)"), "quality-labels")
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id")).where("id is not null")

    def count(batches):
        for b in batches:
            found = list(zip(*packed(b.column(0)), strict=True)) or [(), ()]
            tb.release()
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in found), b.column(1)], names=["key", "features", "id"])

    maybe = BitFilter.of(known, "known", "quality-filter").maybe(texts, F.col("id")).select("text", "id")
    found = maybe.mapInArrow(count, "key binary, features binary, id string")
    one = found.groupBy("id").agg(F.max(F.struct("key", "features")).alias("row"))
    # by ids on both sides, as the groups are: labels of any number are not broadcast
    return one.join(known.hint("merge"), F.col("id") == F.col("known")).select("id", "row.key", "row.features", "label")


def _here(rows: DataFrame) -> list[tuple[bytes, bytes, int]]:
    return [(bytes(r["key"]), bytes(r["features"]), r["label"]) for r in rows.collect()]


def training_sample(train: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[bytes, bytes, int]]:
    """(key, features, label) of :func:`training_rows`, all of them, of documents with a label column."""
    return _here(training_rows(train, train, id_col, text_col, label_col))


def scored(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """Add score (0 to 1; higher: label 1 likelier) and predicted to ``docs`` (other columns stay).

    A null or empty text has the score of no features, the model's bias. Columns of ``docs``
    named like a result are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        found = shared.value.scores(column)
        tb.release()
        return pa.array(found)

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*keep, score(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on every labelled document; a document with several labels counts once with the largest, and so
    do documents with the same id."""
    rows = written(training_rows(docs, labels, id_col, text_col, label_col), "quality-rows")
    count, size = rows.agg(F.count("*"), F.sum(F.length("features"))).first()
    shards = max(-(-count // SHARD_DOCS), -(-(size or 0) // SHARD_BYTES))
    model = fit_packed(_here(rows)) if shards <= 1 else fit_shards(rows, shards)
    discard(rows)
    return model
