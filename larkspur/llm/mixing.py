"""Mixing sources to target weights by iterative proportional fitting (raking).

Token counts per cell (source, language, topic) are raked until their marginals meet the targets,
over the cells that occur, whatever the number of values: with numpy up to DRIVER_CELLS of them,
with sums and joins by key beyond;
a document's calibrated probability is proportional to its cell's fitted over observed tokens,
scaled so that the expected number of sampled tokens is a given share, none above 1. Sampling
draws from a hash of the document's id and a seed: it is repeatable and needs no order.

Topics are learned: spherical k-means over hashed words, weighted by their rarity, of every whole
text, which then goes to its nearest topic. Texts are read once, for their tokens and for bags: two
bytes a distinct word, a few more for frequent ones. Every pass of the learning reads all bags where they are; sums of whole numbers
leave a task, so the model depends neither on batches nor on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import textbytes as tb
from larkspur.llm.storage import discard, fresh_name, small_batches, written

#: Cells that occur, up to which they are raked on the driver and broadcast; more of them stay a
#: distributed table. Both ways are exact and give each value its own target.
DRIVER_CELLS = 100_000
DIMENSIONS = ("source", "lang", "topic")
TOLERANCE, MAX_ROUNDS = 1e-9, 500
#: Topics: how many, slots of hashed words, rounds of k-means at most, and the whole numbers that a
#: text's unit vector is summed in.
TOPICS, TOPIC_SLOTS, TOPIC_ROUNDS, UNIT = 8, 1 << 13, 12, 1 << 24
#: An entry of a bag is a slot and, in its lower bits, a digit of its count. The entries of a slot have
#: the digits from the lowest to the highest.
SLOT_BITS = TOPIC_SLOTS.bit_length() - 1
DIGIT_BITS = 16 - SLOT_BITS
DIGIT = (1 << DIGIT_BITS) - 1


@dataclass
class MixTargets:
    """Target weights per dimension: {value: weight}, scaled to sum 1; None is the value of rows without
    one. A dimension without an entry is tempered: its observed token shares to the power ``temper``
    of that dimension. A target on a value that no document has is an error, unless ``strict`` is
    off: then it is spread over the other targets in proportion."""

    weights: dict[str, dict[str | None, float]] = field(default_factory=dict)
    temper: dict[str, float] = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 1.0})
    keep_share: float = 0.5  # expected share of all tokens that is sampled
    seed: int = 10
    strict: bool = True

    def order(self) -> list[str]:
        """The dimensions as a round of raking meets them: stated targets after tempered ones."""
        return sorted(DIMENSIONS, key=lambda d: d in self.weights)


def _slots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _bags(texts: list[np.ndarray]) -> pa.Array:
    """Of texts given as their words' slots: each slot once, in order, with its count."""
    keys = np.repeat(np.arange(len(texts)) << SLOT_BITS, [len(t) for t in texts])
    keys |= np.concatenate([np.zeros(0, np.int64), *texts])
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    keys, n = keys[at], np.diff(at, append=len(keys))
    at = np.flatnonzero(n > DIGIT)
    rest, more = n[at] >> DIGIT_BITS, [(at[:0], at[:0])]
    while len(at):
        more.append((at, rest & DIGIT))
        at, rest = at[rest > DIGIT], rest[rest > DIGIT] >> DIGIT_BITS
    at, digits = (np.concatenate(x) for x in zip(*more, strict=True))
    # further digits of one entry keep their order
    keys, n = np.insert(keys, at + 1, keys[at]), np.insert(n & DIGIT, at + 1, digits)
    entries = ((keys & (TOPIC_SLOTS - 1)) << DIGIT_BITS | n).astype(np.uint16)
    offsets = (2 * np.searchsorted(keys, np.arange(len(texts) + 1) << SLOT_BITS)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(entries)])


def _entries(column: pa.Array):
    """Of bags, some rows at a time: (rows that have words, the first entry of each, slots, counts)."""
    offsets, data = tb.buffers(column)
    for i, j in tb.groups(offsets):
        rows = np.flatnonzero(offsets[i + 1 : j + 1] > offsets[i:j])
        if not len(rows):
            continue
        entries = data[offsets[i] : offsets[j]].view(np.uint16)
        first = (offsets[i + rows] - offsets[i]) // 2
        slots = entries >> DIGIT_BITS
        new = np.ones(len(slots), bool)
        np.not_equal(slots[1:], slots[:-1], out=new[1:])
        new[first] = True
        whole, more = np.flatnonzero(new), np.flatnonzero(~new)
        at, n = slots[whole].astype(np.int64), (entries[whole] & DIGIT).astype(np.int64)
        owner = np.searchsorted(whole, more) - 1
        np.add.at(n, owner, (entries[more] & DIGIT).astype(np.int64) << DIGIT_BITS * (more - whole[owner]))
        first = np.searchsorted(whole, first)
        yield i + rows, first, at, n


def _picked(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A slot's value per entry. All slots are there; numpy is quicker if it need not report others."""
    return table.take(at, mode="wrap")


@dataclass
class TopicModel:
    """Slot weights of every topic (topics x TOPIC_SLOTS, in whole units, so that sums do not depend on
    batches). A text's topic has the largest sum over its words; the first of equals."""

    weights: np.ndarray

    def assign(self, column: pa.Array) -> tuple[list[str | None], np.ndarray]:
        """(topics, words) of whole texts. Without words there is no topic. Words are runs without
        ASCII white space, A-Z lower-cased."""
        found = list(tb.each_words(column))
        return self.assign_bags(_bags([_slots(h) for h in found])), np.array([len(h) for h in found], np.int64)

    def assign_bags(self, column: pa.Array) -> list[str | None]:
        """The topics of texts given as their bags."""
        topics = np.full(len(column), -1)
        for rows, first, at, n in _entries(column):
            topics[rows] = np.stack([np.add.reduceat(_picked(w, at) * n, first) for w in self.weights]).argmax(0)
        return [f"t{t}" if t >= 0 else None for t in topics.tolist()]


def _units(rarity: np.ndarray, first: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Texts of :func:`_entries` as unit vectors; one whose words are in every text stays zero."""
    values = np.sqrt(n) * _picked(rarity, at)
    norms = np.sqrt(np.add.reduceat(values * values, first))
    return values / np.repeat(np.maximum(norms, 1e-12), np.diff(first, append=len(at)))


def _nearness(centres: np.ndarray, units: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cosines, centres x texts. A centre's slots fit into the fastest cache, so one goes after the other."""
    units = units.astype(np.float32)
    return np.stack([np.add.reduceat(_picked(c, at) * units, first) for c in centres])


def _counts(columns: Iterable[pa.Array]) -> np.ndarray:
    """One row: the texts that have each slot, then all texts with words."""
    out = np.zeros((1, TOPIC_SLOTS + 1), np.int64)
    for column in columns:
        for rows, _, at, _ in _entries(column):
            out[0, :-1] += np.bincount(at, minlength=TOPIC_SLOTS)
            out[0, -1] += len(rows)
    return out


def _race(columns: Iterable[pa.Array], rarity: np.ndarray, centres: np.ndarray, seed: int) -> tuple[float, bytes] | None:
    """The next seed, as k-means++ draws it: a text in proportion to its distance from the seeds so far.
    Each text runs with that rate and a number drawn from its bag; the least time wins (equal bags run
    alike). None: no text is apart from the seeds. No rate is above 1, so the distance is found only
    of texts that would not be late at that rate."""
    best = None
    for column in columns:
        for rows, first, at, n in _entries(column):
            drawn = np.add.reduceat(tb.mix((at * (1 << 40) + n).astype(np.uint64)), first) + np.uint64(1000 * seed + len(centres))
            times = -np.log1p(-((tb.mix(drawn) >> np.uint64(11)).astype(np.float64) / float(1 << 53)))
            if best is not None:
                early = times <= best[0]
                if not early.any():
                    continue
                long = np.diff(first, append=len(at))
                these = np.repeat(early, long)
                rows, times, at, n = rows[early], times[early], at[these], n[these]
                first = np.cumsum(long[early]) - long[early]
            units = _units(rarity, first, at, n)
            far = (np.add.reduceat(units, first) > 0).astype(np.float64)
            if len(centres):
                far -= np.where(far > 0, _nearness(centres, units, first, at).max(0), 0)
            times = np.divide(times, far, out=np.full(len(rows), np.inf), where=far > 1e-5)
            k = int(times.argmin())
            if times[k] < np.inf and (best is None or times[k] <= best[0]):
                least = [(float(times[k]), column[int(rows[i])].as_py()) for i in np.flatnonzero(times == times[k])]
                best = min([*least, *([best] if best else [])])
    return best


def _sums(columns: Iterable[pa.Array], rarity: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Topics x slots: the sums of the unit vectors of the texts that are nearest to each centre."""
    out = np.zeros(centres.size, np.int64)
    for column in columns:
        for _, first, at, n in _entries(column):
            units = _units(rarity, first, at, n)
            owner = _nearness(centres, units, first, at).argmax(0)
            place = np.repeat(owner * TOPIC_SLOTS, np.diff(first, append=len(at))) + at
            out += np.bincount(place, np.rint(units * UNIT), len(out)).astype(np.int64)
    return out.reshape(centres.shape)


@dataclass
class _Here:
    """Bags in memory."""

    bags: pa.Array

    def total(self, part: Callable) -> np.ndarray | None:
        return part([self.bags])

    least = total


@dataclass
class _Apart:
    """Bags as a table of one column: what the parts find is combined by row, or the least taken."""

    bags: DataFrame

    def total(self, part: Callable) -> np.ndarray | None:
        def found(batches):
            rows = part(b.column(0) for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["row", "sums"])

        def added(table: pa.Table) -> pa.Table:
            sums = sum(np.frombuffer(v.as_buffer(), np.int64) for v in table.column("sums"))
            return pa.table({"row": table.column("row")[:1], "sums": pa.array([sums.tobytes()], pa.binary())})

        kind = "row int, sums binary"
        rows = self.bags.mapInArrow(found, kind).groupBy("row").applyInArrow(added, kind).collect()
        return np.stack([np.frombuffer(r["sums"], np.int64) for r in sorted(rows, key=lambda r: r["row"])]) if rows else None

    def least(self, part: Callable) -> tuple[float, bytes] | None:
        def found(batches):
            best = part(b.column(0) for b in batches)
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]], pa.float64()), pa.array([best[1]], pa.binary())], names=["time", "bag"])

        rows = self.bags.mapInArrow(found, "time double, bag binary").orderBy("time", "bag").limit(1).collect()
        return (rows[0]["time"], bytes(rows[0]["bag"])) if rows else None


def _learned(bags: _Here | _Apart, seed: int) -> TopicModel:
    """Spherical k-means from k-means++ seeds, over all bags in every pass."""
    counts = bags.total(_counts)
    centres = np.zeros((0, TOPIC_SLOTS), np.float32)
    rarity = np.zeros(TOPIC_SLOTS) if counts is None else np.log((counts[0, -1] + 1) / (counts[0, :-1] + 1.0)) ** 2
    while len(centres) < TOPICS and rarity.any():
        found = bags.least(partial(_race, rarity=rarity, centres=centres, seed=seed))
        if found is None:  # fewer directions than topics
            break
        _, first, at, n = next(_entries(pa.array([found[1]], pa.binary())))
        centre = np.zeros(TOPIC_SLOTS, np.float32)
        centre[at] = _units(rarity, first, at, n)
        centres = np.vstack([centres, centre])
    if not len(centres):
        return TopicModel(np.zeros((1, TOPIC_SLOTS), np.int32))
    for _ in range(TOPIC_ROUNDS):
        sums = bags.total(partial(_sums, rarity=rarity, centres=centres)).astype(np.float64)
        norms = np.sqrt((sums * sums).sum(1))[:, None]
        moved = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres).astype(np.float32)
        if (moved == centres).all():  # further rounds change nothing
            break
        centres = moved
    return TopicModel(np.rint(centres * rarity * 4096).astype(np.int32))


def learn_topics(rows: list[np.ndarray], seed: int = 10) -> TopicModel:
    """Topics of texts given as their words' slots; the order of rows does not matter."""
    return _learned(_Here(_bags(rows)), seed)


def learn_topics_of(bags: DataFrame, seed: int = 10) -> TopicModel:
    """As :func:`learn_topics`, of every row of a table of one column of bags."""
    return _learned(_Apart(bags), seed)


def _scaled(goal: np.ndarray, full: np.ndarray) -> np.ndarray:
    """A dimension's targets, to sum 1 over the values that have tokens."""
    goal = np.where(full, goal, 0.0)
    goal = goal if goal.sum() > 0 else full.astype(float)  # no target on any value that has tokens
    return goal / goal.sum()


def rake_cells(codes: list[np.ndarray], observed: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """Fit cells (``observed``, not negative; ``codes``: their value per dimension) to the marginals.

    A target's weight on a value without tokens is spread over the others in proportion. Of targets that
    contradict each other the last dimension's are met in the end.
    """
    fitted = observed.astype(np.float64).copy()
    if fitted.sum() <= 0:
        return fitted
    goals = [_scaled(t, np.bincount(at, observed, len(t)) > 0) for at, t in zip(codes, targets, strict=True)]
    fitted /= fitted.sum()
    last = np.inf
    for _ in range(MAX_ROUNDS):
        worst = 0.0
        for at, goal in zip(codes, goals, strict=True):
            now = np.bincount(at, fitted, len(goal))
            worst = max(worst, float(np.abs(now - goal).max()))
            fitted *= np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[at]
        if worst < TOLERANCE or abs(last - worst) < TOLERANCE / 10:  # met, or as near as the targets allow
            break
        last = worst
    return fitted


def rake(observed: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """:func:`rake_cells` of an n-dimensional table; empty slices stay empty."""
    return rake_cells([at.ravel() for at in np.indices(observed.shape)], observed.ravel(), targets).reshape(observed.shape)


def calibrated(observed: np.ndarray, fitted: np.ndarray, share: float) -> np.ndarray:
    """Inclusion probabilities: min(1, c * fitted / observed) with c such that the expected tokens are ``share``."""
    total = observed.sum()
    ratio = np.divide(fitted * total, observed, out=np.zeros_like(fitted), where=observed > 0)
    if total <= 0 or ratio.max() <= 0:
        return np.zeros_like(ratio)
    goal = min(share, float(observed[ratio > 0].sum() / total)) * total
    order = np.argsort(-ratio.ravel(), kind="stable")
    r, o = ratio.ravel()[order], observed.ravel()[order].astype(np.float64)
    # with the first k cells at 1, c = (goal - their tokens) / (sum of o * r of the rest)
    head = np.concatenate([[0.0], np.cumsum(o)])
    tail = np.concatenate([np.cumsum((o * r)[::-1])[::-1], [0.0]])
    for k in range(len(r) + 1):
        if tail[k] <= 0:
            return np.minimum(1.0, np.where(ratio >= (r[k - 1] if k else np.inf), 1.0, 0.0))
        c = (goal - head[k]) / tail[k]
        if k == len(r) or c * r[k] <= 1 + 1e-12:
            break
    return np.minimum(1.0, c * ratio)


def with_bags(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic_col: str | None, names: dict[str, str]) -> DataFrame:
    """Add the source, the language, the tokens and the bag under the given names; with a column of
    topics that one instead of the bag."""
    bags = topic_col is None

    @F.arrow_udf("struct<bag:binary, words:bigint>")
    def made(column: pa.Array) -> pa.Array:
        found, words = [], []
        for h in tb.each_words(column):
            if bags:
                found.append(_slots(h))
            words.append(len(h))
        tb.release()
        return pa.StructArray.from_arrays([_bags(found) if bags else pa.nulls(len(words), pa.binary()), pa.array(words, pa.int64())], ["bag", "words"])

    small_batches(docs.sparkSession)
    seen = docs.withColumn(names["made"], made(F.col(text_col).cast("string")))
    last = {names["bag"]: F.col(f"{names['made']}.bag")} if bags else {names["topic"]: F.col(topic_col).cast("string")}
    return seen.withColumns({names["source"]: F.col(source_col).cast("string"), names["lang"]: F.col(lang_col).cast("string"), names["tokens"]: F.col(f"{names['made']}.words"), **last}).drop(names["made"])


def with_topics(bagged: DataFrame, model: TopicModel, names: dict[str, str]) -> DataFrame:
    """The topic of every bag, in its place."""
    shared = bagged.sparkSession.sparkContext.broadcast(model)  # TOPICS x TOPIC_SLOTS

    @F.arrow_udf("string")
    def topic(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.assign_bags(column), pa.string())

    return bagged.withColumn(names["topic"], topic(F.col(names["bag"]))).drop(names["bag"])


def _fitted_here(cells: list, targets: MixTargets) -> list[tuple]:
    """Rows (source, lang, topic, weight, probability) of collected cells (source, lang, topic, n)."""
    cells = sorted(cells, key=lambda r: tuple((r[d] is not None, r[d] or "") for d in DIMENSIONS))
    observed = np.array([float(r["n"] or 0) for r in cells])
    codes, goals = [], []
    for d in targets.order():
        place: dict[str | None, int] = {}
        at = np.array([place.setdefault(r[d], len(place)) for r in cells], dtype=np.int64)
        values, given = list(place), targets.weights.get(d)
        codes.append(at)
        goals.append(np.bincount(at, observed) ** targets.temper[d] if given is None else np.array([float(given.get(v, 0.0)) for v in values]))
    fitted = rake_cells(codes, observed, goals)
    p = calibrated(observed, fitted, targets.keep_share)
    weight = np.divide(fitted * observed.sum(), observed, out=np.zeros_like(fitted), where=observed > 0)
    # a cell whose documents have no words: the overall probability
    p, weight = np.where(observed > 0, p, targets.keep_share), np.where(observed > 0, weight, 1.0)
    return [(*(r[d] for d in DIMENSIONS), float(w), float(x)) for r, w, x in zip(cells, weight, p, strict=True)]


def _same(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join on one column in which nulls are equal; the left one stays."""
    return left.join(right.withColumnRenamed(key, "__right"), F.col(key).eqNullSafe(F.col("__right")), how).drop("__right")


def _fitted_apart(cells: DataFrame, targets: MixTargets) -> DataFrame:
    """As :func:`_fitted_here`, for a table of cells: marginal sums per round, joined back by key."""
    spark, total = cells.sparkSession, float(cells.agg(F.sum("n")).first()[0] or 0)
    n, share = F.col("n").cast("double"), F.lit(float(targets.keep_share))
    if total <= 0:
        return cells.select(*DIMENSIONS, F.lit(1.0).alias("weight"), share.alias("p"))
    goals = {}
    for d in DIMENSIONS:
        sums = cells.where("n > 0").groupBy(d).agg(F.sum(n).alias("n"))
        if d in targets.weights:
            given = spark.createDataFrame([(v, float(w)) for v, w in targets.weights[d].items()], f"{d} string, goal double")
            sums = _same(sums, given, d, "left").select(d, F.coalesce("goal", F.lit(0.0)).alias("goal"))
        else:
            sums = sums.select(d, F.pow("n", F.lit(float(targets.temper[d]))).alias("goal"))
        all_ = sums.agg(F.sum("goal"), F.count("*")).first()
        goals[d] = written(sums.select(d, (F.col("goal") / all_[0] if all_[0] > 0 else F.lit(1.0 / all_[1])).alias("goal")), "mix-goals")
    fit = written(cells.where("n > 0").select(*DIMENSIONS, "n", (n / total).alias("fit")), "mix-cells")
    last = float("inf")
    for _ in range(MAX_ROUNDS):
        worst = 0.0
        for d in targets.order():
            now = written(_same(fit.groupBy(d).agg(F.sum("fit").alias("now")), goals[d], d).select(d, "now", "goal"), "mix-sums")
            worst = max(worst, now.agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0])
            ratio = now.select(d, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("ratio"))
            old, fit = fit, written(_same(fit, ratio, d).select(*DIMENSIONS, "n", (F.col("fit") * F.col("ratio")).alias("fit")), "mix-cells")
            discard(old, now)
        if worst < TOLERANCE or abs(last - worst) < TOLERANCE / 10:
            break
        last = worst
    weighed = written(fit.select(*DIMENSIONS, "n", (F.col("fit") * total / n).alias("weight")), "mix-weights")
    live = weighed.where("weight > 0")
    goal = min(targets.keep_share * total, float(live.agg(F.sum("n")).first()[0]))
    # cells at 1 only become more until c fits the rest
    c, at_one = 0.0, -1
    while True:
        one = F.col("weight") * c >= 1
        head, k, tail = live.agg(F.sum(F.when(one, n).otherwise(0.0)), F.sum(one.cast("long")), F.sum(F.when(one, 0.0).otherwise(n * F.col("weight")))).first()
        if k == at_one or tail <= 0:
            break
        at_one, c = k, max(c, (goal - head) / tail)
    p = F.least(F.lit(1.0), F.col("weight") * c)
    empty = cells.where("coalesce(n, 0) <= 0").select(*DIMENSIONS, F.lit(1.0).alias("weight"), share.alias("p"))
    return written(weighed.select(*DIMENSIONS, "weight", p.alias("p")).unionByName(empty), "mix-fitted")


def _check_targets(cells: DataFrame, targets: MixTargets) -> None:
    for d, given in targets.weights.items():
        wanted = [v for v, w in given.items() if w > 0]
        some = F.col(d).isin([v for v in wanted if v is not None]) | (F.col(d).isNull() & F.lit(None in wanted))
        missing = set(wanted) - {r[0] for r in cells.where(some).select(d).distinct().collect()}
        if missing and targets.strict:
            raise ValueError(f"targets of {d} that no document has: {sorted(map(str, missing))}")


RESULTS = ("topic", "tokens", "weight", "probability", "kept")


def mix(docs: DataFrame, targets: MixTargets | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, columns: list[str] | None = None, prefix: str = "__") -> DataFrame:
    """``docs`` (all columns, or ``columns``) with RESULTS added, their names after ``prefix``.

    Rows without a source, a language or words for a topic are a value of their own, whose target is
    that of None. Every value is weighed by itself, whatever it is called. Where targets contradict each
    other (a topic of one language alone) the stated ones are met and the tempered ones as near as it
    goes. A target on a value that
    no document has is a ValueError, unless the targets are not strict.
    A document without words has no tokens to weigh: it takes its cell's probability. Rows with
    equal ids are drawn alike; null ids are one id. An empty table stays empty. Columns of ``docs``
    may have any names; one named like a result is a ValueError.
    """
    targets = targets or MixTargets()
    spark, keep = docs.sparkSession, list(columns or docs.columns)
    results = {n: prefix + n for n in RESULTS}
    if clash := {c.lower() for c in keep} & {r.lower() for r in results.values()}:
        raise ValueError(f"columns of these names are there already: {sorted(clash)}")
    names = {n: fresh_name([*docs.columns, *results.values()], f"__mix_{n}") for n in (*DIMENSIONS, "tokens", "made", "bag", "id", "weight", "p", *(f"cell_{d}" for d in DIMENSIONS))}
    small_batches(spark)
    celled = with_bags(docs.withColumn(names["id"], F.col(id_col)), text_col, source_col, lang_col, topic_col, names)
    kept = [F.col(f"`{c}`") for c in keep]
    # written once: whole texts go to Python a single time
    celled = written(celled.select(*kept, *[F.col(names[n]) for n in ("id", "source", "lang", "tokens", "topic" if topic_col else "bag")]), "mix-bags")
    if not topic_col:
        celled = with_topics(celled, learn_topics_of(celled.select(names["bag"])), names)
    cells = written(celled.groupBy(*[F.col(names[d]).alias(d) for d in DIMENSIONS]).agg(F.sum(names["tokens"]).alias("n")), "mix-observed")
    count = cells.count()
    if count:  # an empty table has no values to check
        _check_targets(cells, targets)
    cell = [F.col(d).alias(names[f"cell_{d}"]) for d in DIMENSIONS]
    if count <= DRIVER_CELLS:
        fitted = spark.createDataFrame(_fitted_here(cells.collect(), targets), "source string, lang string, topic string, weight double, p double")
    else:
        fitted = _fitted_apart(cells, targets)
    table = fitted.select(*cell, F.col("weight").alias(names["weight"]), F.col("p").alias(names["p"]))
    if count <= DRIVER_CELLS:
        table = F.broadcast(table)
    draw = F.pmod(F.xxhash64(F.col(names["id"]), F.lit(targets.seed)), F.lit(1 << 52)) / float(1 << 52)
    on = [F.col(names[d]).eqNullSafe(F.col(names[f"cell_{d}"])) for d in DIMENSIONS]
    found = celled.join(table, on[0] & on[1] & on[2])
    out = {"topic": F.col(names["topic"]), "tokens": F.col(names["tokens"]), "weight": F.col(names["weight"]), "probability": F.col(names["p"]), "kept": draw < F.col(names["p"])}
    return found.select(*kept, *[c.alias(results[n]) for n, c in out.items()])
