"""Exact n-gram Jaccard join by signature trees; classes of linked documents.

A document is its set of word shingles; equal sets collapse to one representative. Routing is
exact and needs no frequencies: the hash space of shingles is cut into ranges, so that a set
falls into parts. Two sets that differ in at most d shingles have equal contents in all but d
ranges. Sizes are dealt to spaces that double, each with its own number of ranges m; a set emits
the hashes of its d + 1 fullest parts (d: the most that a linked set of this space can differ),
and the parts that it skips are the m - d - 1 lowest in one order of contents. At least m - d
ranges of a linked pair are equal and the longer list of skipped ones is shorter than that, so
linked sets emit a hash in common. A hash covers several shingles at once, so that neither common
shingles nor chance bring strangers together, whatever the size of the corpus.

Sets with a hash in common form stars, their components are coarse classes, a superset of the
links. In a class a signature tree holds, per node, the OR and AND of its sets' parity bitmaps and
their range of sizes; a dual traversal discards node pairs whose largest possible overlap is too
small, and pairs that are already linked; surviving pairs are verified on the whole sets.

A class too large for one task is routed again, within itself, by other ranges. What is still too
large is dealt to cells by size band and a hash; what is outside the class's main component after
the trees of the cells meets the cells of its band and the next ones, in blocks of bounded size. So
no link is lost, no group is gathered in one task, and no pairs are listed within a class: links
of a spanning forest are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import textbytes as tb
from larkspur.llm.graph import connected_components
from larkspur.llm.storage import BitFilter, small_batches, without_keys, written

#: Shingles that one verification task holds; a coarse class beyond it is routed again, then dealt.
CHUNK_SHINGLES = 50_000
#: Seeds of the further routings of classes that are too large.
AGAIN = (1, 2)
#: Rows of ids and hashes in a batch (16 bytes each).
NARROW = 20_000
_LEAF, _FANOUT = 16, 8
_U = np.uint64


# ---- sets and signatures ---------------------------------------------------------------------


def difference(total: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets that hold ``total`` shingles together."""
    return total * (100 - percent) // (100 + percent)


def signature_bits(n: int, percent: int) -> int:
    d = difference(2 * n, percent)
    return 512 if d <= 140 else 4096 if d <= 1100 else 32768


def signature(s: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap: bit b is the parity of the set's members that fall on it (uint64 words)."""
    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return 0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = overlap(a, b)
    return len(a) > 0 and len(b) > 0 and 100 * both >= percent * (len(a) + len(b) - both)


# ---- the signature tree ------------------------------------------------------------------------


class SignatureTree:
    """Documents in order of size; nodes hold OR and AND bitmaps, size range and document range."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        self.sizes, self.maps = sizes, maps
        self.nodes: list[tuple] = []  # (or, and, least size, largest size, lo, hi, children)
        level = []
        for lo in range(0, len(sizes), _LEAF):
            hi = min(len(sizes), lo + _LEAF)
            m = maps[lo:hi]
            level.append(self._add(np.bitwise_or.reduce(m, 0), np.bitwise_and.reduce(m, 0), sizes[lo:hi].min(), sizes[lo:hi].max(), lo, hi, None))
        while len(level) > 1:
            up = []
            for k in range(0, len(level), _FANOUT):
                kids = level[k : k + _FANOUT]
                n = [self.nodes[i] for i in kids]
                up.append(self._add(np.bitwise_or.reduce([x[0] for x in n], 0), np.bitwise_and.reduce([x[1] for x in n], 0), min(x[2] for x in n), max(x[3] for x in n), n[0][4], n[-1][5], kids))
            level = up
        self.root = level[0] if level else None

    def _add(self, either, all_, least, most, lo, hi, kids) -> int:
        self.nodes.append((either, all_, int(least), int(most), lo, hi, kids))
        return len(self.nodes) - 1

    def join(self, percent: int, labels: np.ndarray, confirm: Callable[[int, int], bool] | None) -> list[tuple[int, int]]:
        """Links (positions) that join classes: a spanning forest. ``labels`` are the classes so far
        (changed in place); ``confirm`` verifies a pair that the bitmaps cannot exclude."""
        out: list[tuple[int, int]] = []
        stack = [(self.root, self.root)] if self.root is not None else []
        while stack:
            i, j = stack.pop()
            a, b = self.nodes[i], self.nodes[j]
            if a[3] * 100 < percent * b[2] or b[3] * 100 < percent * a[2]:
                continue
            first = labels[a[4]]
            if (labels[a[4] : a[5]] == first).all() and (i == j or (labels[b[4] : b[5]] == first).all()):
                continue
            if i != j:  # the largest overlap is (|a| + |b| - differing bits) / 2
                apart = int(np.bitwise_count(a[1] & ~b[0]).sum()) + int(np.bitwise_count(b[1] & ~a[0]).sum())
                if apart * (100 + percent) > (a[3] + b[3]) * (100 - percent):
                    continue
            if a[6] is None and b[6] is None:
                self._leaves(a, b, i == j, percent, labels, confirm, out)
            elif i == j:
                kids = a[6]
                stack += [(kids[x], kids[y]) for x in range(len(kids)) for y in range(x, len(kids))]
            elif b[6] is None or (a[6] is not None and a[5] - a[4] >= b[5] - b[4]):
                stack += [(x, j) for x in a[6]]
            else:
                stack += [(i, y) for y in b[6]]
        return out

    def _leaves(self, a, b, same, percent, labels, confirm, out) -> None:
        apart = np.bitwise_count(self.maps[a[4] : a[5], None, :] ^ self.maps[None, b[4] : b[5], :]).sum(2, dtype=np.int64)
        x, y = self.sizes[a[4] : a[5], None], self.sizes[None, b[4] : b[5]]
        fit = (apart * (100 + percent) <= (x + y) * (100 - percent)) & (np.minimum(x, y) * 100 >= percent * np.maximum(x, y))
        if same:
            fit = np.triu(fit, 1)
        for p, q in zip(*np.nonzero(fit), strict=True):
            p, q = a[4] + p, b[4] + q
            if labels[p] != labels[q] and (confirm is None or confirm(p, q)):
                labels[labels == labels[q]] = labels[p]
                out.append((p, q))


def join_sets(ids: list[int], labels: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Id pairs of verified links that join different labels: a spanning forest of them."""
    order = sorted((k for k in range(len(ids)) if len(sets[k])), key=lambda k: (len(sets[k]), ids[k]))
    if len(order) < 2:
        return []
    sizes = np.array([len(sets[k]) for k in order], dtype=np.int64)
    bits = signature_bits(int(sizes[-1]), percent)
    tree = SignatureTree(sizes, np.stack([signature(sets[k], bits) for k in order]))
    found = tree.join(percent, np.array([labels[k] for k in order]), lambda p, q: linked(sets[order[p]], sets[order[q]], percent))
    return [(ids[order[p]], ids[order[q]]) for p, q in found]


# ---- tasks -------------------------------------------------------------------------------------


def _batch(names: list[str], columns: list, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return _batch(["u", "v"], [[r[0] for r in rows], [r[1] for r in rows]], [pa.int64(), pa.int64()])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Of batches sorted by ``keys``: tables that hold whole runs of equal keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if any(last.column(k)[0].as_py() != b.column(k)[0].as_py() for k in keys):
                change = np.concatenate([[0], change])
        if len(change):
            cut = int(change[-1])
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    cols = [table.column(k).to_numpy() for k in keys]
    return np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1, [table.num_rows]])


# ---- routing -----------------------------------------------------------------------------------


def first_bound(percent: int) -> int:
    """Sets up to this size are linked with no set of this size at most but equal ones (or 1)."""
    return max(1, (99 + percent) // (2 * (100 - percent)))


def spaces(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(space, number of ranges, hashes to emit) of a set of n shingles: the space of its size, and
    those of larger sets that it may be linked with. Sizes of a space reach ``first_bound << space``."""
    base = first_bound(percent)
    largest, out = 100 * n // percent, []
    space = ((n + base - 1) // base - 1).bit_length()
    while not out or base << (space - 1) < largest:
        top = base << space
        d = difference(2 * top, percent)
        slack = max(2, (d + 1) // 4)
        out.append((space, d + 1 + slack, difference(n + min(largest, top), percent) + 1 if d else 0))
        space += 1
    return out


def route(s: np.ndarray, percent: int, seed: int = 0) -> np.ndarray:
    """The routing hashes of a set (sorted distinct shingle hashes). None for an empty set, for
    percent 100 and where only equal sets can be linked: those have one representative."""
    if not len(s) or percent >= 100:
        return np.zeros(0, np.int64)
    if seed:
        s = np.sort(tb.mix(s + _U(seed)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(s + _U(1)))])
    out = []
    for space, m, emit in spaces(len(s), percent):
        if not emit:
            continue
        cuts = np.concatenate([[0], np.searchsorted(s, _range_starts(m)), [len(s)]])
        held = np.minimum(np.diff(cuts), 0xFFFF).astype(np.uint64)
        names = tb.mix((total[cuts[1:]] - total[cuts[:-1]]) ^ tb.mix(np.arange(m, dtype=np.uint64) + _U(space << 40)))
        if emit < m:
            names = names[np.argpartition((held << _U(48)) | (names >> _U(16)), m - emit)[m - emit :]]
        out.append(names.view(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@lru_cache(maxsize=256)
def _range_starts(m: int) -> np.ndarray:
    """Where the ranges after the first begin, of m equal ones."""
    return np.array([(k << 64) // m for k in range(1, m)], dtype=np.uint64)


def _listed(columns: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(columns) if columns else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, columns)]), pa.int32()), pa.array(flat, pa.int64()))


def profiles(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows (id, n, set_key, hashes) of documents (id, text): the set's size, a 128-bit key of the
    set and its routing hashes. Empty sets have a null key."""
    names = ["id", "n", "set_key", "hashes"]

    def profile(batches):
        for b in batches:
            n, key, hashes = [], [], []
            for h in tb.each_words(b.column(1)):
                s = tb.shingles(h, words)
                m = tb.mix(s)
                n.append(len(s))
                key.append(m.sum().tobytes() + np.bitwise_xor.reduce(m * _U(0x9E3779B97F4A7C15) ^ (m >> _U(32))).tobytes() if len(s) else None)
                hashes.append(route(s, percent))
            tb.release()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), _listed(hashes)], names=names)

    return docs.select("id", "text").mapInArrow(profile, "id long, n long, set_key binary, hashes array<long>")


def _posts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (id, hashes): (hash, id, null), once per hash and batch; the other sets of the batch
    with that hash are linked to the one named here: (any hash, id, that one). So a hash that many
    sets share is mostly combined before it is shuffled."""
    for b in batches:
        lists = b.column(1)
        at = lists.offsets.to_numpy()
        hashes = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
        ids = np.repeat(b.column(0).to_numpy(), np.diff(at))
        order = np.lexsort((ids, hashes))
        hashes, ids = hashes[order], ids[order]
        head = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
        first = ids[head][np.cumsum(head) - 1]
        linked_ = _pairs(first, ids)
        names = np.concatenate([hashes[head], tb.mix(linked_[:, 1].view(np.uint64)).view(np.int64)])
        firsts = pa.concat_arrays([pa.nulls(int(head.sum()), pa.int64()), pa.array(linked_[:, 0])])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([ids[head], linked_[:, 1]])), firsts], names=["hash", "id", "first"])


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct pairs of different ids, as rows."""
    some = a != b
    return np.unique(np.stack([a[some], b[some]], 1), axis=0) if some.any() else np.zeros((0, 2), np.int64)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From :func:`_posts`' rows, sorted by hash: edges (u, v) from the first id of a hash to all others.
    A run of one hash streams through, whatever its length."""
    last = first = None
    for b in batches:
        plain = b.column(2).is_null().to_numpy(zero_copy_only=False)
        hashes, ids = b.column(0).to_numpy()[plain], b.column(1).to_numpy()[plain]
        made = b.filter(pa.array(~plain))
        found = [_pairs(made.column(2).to_numpy(), made.column(1).to_numpy())]
        if len(hashes):
            head = np.concatenate([[hashes[0] != last], hashes[1:] != hashes[:-1]])
            begin = np.maximum.accumulate(np.where(head, np.arange(len(ids)), -1))
            firsts = np.where(begin >= 0, ids[begin], first if first is not None else 0)
            found.append(_pairs(firsts, ids))
            last, first = hashes[-1], firsts[-1]
        out = np.concatenate(found)
        yield _batch(["u", "v"], [out[:, 0], out[:, 1]], [pa.int64(), pa.int64()])


def _star_edges(sets: DataFrame, label: str) -> DataFrame:
    """Edges that connect all sets (id, hashes) with a hash in common."""
    posts = sets.mapInArrow(_posts, "hash long, id long, first long")
    return written(posts.repartition("hash").sortWithinPartitions("hash", "id").mapInArrow(_stars, "u long, v long"), label, rows=NARROW)


def _again(big: DataFrame, docs: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """Rows (id, coarse, n) of classes that are too large, routed by other ranges within each class."""

    def hashed(batches):
        for b in batches:
            found = []
            for h, own in zip(tb.each_words(b.column(2)), b.column(1).to_pylist(), strict=True):
                r = route(tb.shingles(h, words), percent, seed)
                found.append(tb.mix(r.view(np.uint64) ^ tb.mix(np.array([own], np.int64).view(np.uint64))).view(np.int64))
            tb.release()
            yield pa.RecordBatch.from_arrays([b.column(0), _listed(found)], names=["id", "hashes"])

    texts = BitFilter.of(big, "id", "join-filter").maybe(docs, F.col("id")).join(big.select("id", "coarse"), "id").select("id", "coarse", "text")
    parts = connected_components(_star_edges(written(texts.mapInArrow(hashed, "id long, hashes array<long>"), "join-again"), "join-stars"), "u", "v", contract=True)
    return big.select("id", "n").join(parts, F.col("id") == F.col("node")).select("id", F.col("component").alias("coarse"), "n")


def _exact_edges(words: int, percent: int, keys: list[str]):
    def run(batches):
        for table in _runs(batches, keys):
            at = _bounds(table, keys)
            ids, labels = table.column("id").to_pylist(), table.column("label").to_pylist()
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo < 2:
                    continue
                sets = [tb.shingles(h, words) for h in tb.each_words(table.column("text").slice(lo, hi - lo).combine_chunks())]
                yield _edges(join_sets(ids[lo:hi], labels[lo:hi], sets, percent))
            tb.release()

    return run


# ---- the join ----------------------------------------------------------------------------------


_TASK = ["coarse", "band", "chunk", "other", "part"]


def _verify(tasks: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) found in tasks (id, label and _TASK), each with its whole texts."""
    texts = BitFilter.of(tasks, "id", "join-filter").maybe(docs, F.col("id"))  # so that few other texts are shuffled
    rows = texts.join(tasks, "id").select(*_TASK, "id", "label", "text")
    ordered = rows.repartition(*_TASK).sortWithinPartitions(*_TASK, "id")
    return written(ordered.mapInArrow(_exact_edges(words, percent, _TASK), "u long, v long"), "join-links")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row: id_col, n_shingles, component_id (the smallest id reachable by links).

    Links: 100 * |A & B| >= percent * |A | B| on the sets of ``words``-word shingles, A-Z lower-cased,
    words parted by ASCII white space; a text with fewer words is one shingle. A null text or a
    text without words has no shingles, no links and its own id as component. A null id takes no
    part and gets a null component. Rows that repeat an id are each a row; if their texts differ
    they are searched as separate documents of one name. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = written(profiles(rows, words, percent), "join-profiles")
    keyed = known.where("set_key is not null and id is not null")
    groups = written(keyed.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k"), "join-groups")
    own = F.concat(F.hex("set_key"), F.lit("|"), F.col("id").cast("string"))
    spare = keyed.select("set_key", "id").join(groups, "set_key").where("id <> rep").select(own.alias("own"))
    reps = without_keys(keyed, own, spare, "join-spare").select("id", "hashes")
    coarse = connected_components(_star_edges(reps, "join-stars"), "u", "v", contract=True)
    sizes = keyed.groupBy("id").agg(F.max("n").alias("n"))
    classes = written(coarse.join(sizes, F.col("node") == F.col("id")).select("id", F.col("component").alias("coarse"), "n"), "join-classes")
    for seed in AGAIN:
        large = classes.groupBy("coarse").agg(F.sum("n").alias("load")).where(F.col("load") > CHUNK_SHINGLES).select("coarse")
        if large.isEmpty():
            break
        big = written(classes.join(large, "coarse", "left_semi"), "join-large")
        classes = written(classes.join(large, "coarse", "left_anti").select("id", "coarse", "n").unionByName(_again(big, rows, words, percent, seed)), "join-classes")
    dealt = written(_dealt(classes, percent), "join-dealt")
    links = _verify(dealt.select("id", F.col("id").alias("label"), "coarse", "band", "chunk", F.lit(0).alias("other"), F.lit(0).alias("part")), rows, words, percent)
    if not dealt.where("large").isEmpty():
        links = links.unionByName(_across(dealt.where("large"), links, rows, words, percent))
    found = connected_components(links, "u", "v", contract=True)
    named = known.select("id", "n", "set_key").join(groups, "set_key", "left")
    named = named.withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))).join(found, F.col("rep") == F.col("node"), "left")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def _dealt(classes: DataFrame, percent: int) -> DataFrame:
    """Classes (id, coarse, n) with their cells: band, chunk and whether the class is large. Sizes of
    linked sets are in the same or in adjacent bands."""
    load = classes.groupBy("coarse").agg((F.sum("n") > CHUNK_SHINGLES).alias("large"))
    width = math.log(100 / min(percent, 99)) * (1 + 1e-9)
    band = F.when(F.col("large"), F.floor(F.log("n") / width)).otherwise(0).cast("int")
    banded = classes.join(load, "coarse").withColumn("band", band)
    cells = banded.groupBy("coarse", "band").agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).cast("int").alias("chunks"))
    chunk = F.when(F.col("large"), F.pmod(F.xxhash64("id"), F.col("chunks"))).otherwise(0).cast("int")
    return banded.join(cells, ["coarse", "band"]).select("id", "coarse", "n", "band", chunk.alias("chunk"), "large")


def _across(dealt: DataFrame, links: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between cells of large classes: whatever is outside a class's main component meets the
    cells of its own and of adjacent size bands, in blocks of bounded size."""
    so_far = connected_components(links, "u", "v", contract=True)
    named = written(dealt.join(so_far, F.col("id") == F.col("node"), "left").select("id", "coarse", "n", "band", "chunk", F.coalesce("component", "id").alias("label")), "join-named")
    main = named.groupBy("coarse", "label").agg(F.count("*").alias("k")).groupBy("coarse").agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    open_ = written(named.join(main, "coarse").drop("labels"), "join-open")
    rest = open_.where("label <> main")
    blocks = rest.groupBy("coarse", F.col("band").alias("other")).agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).cast("int").alias("parts"))
    cells = open_.select("coarse", "band", "chunk").distinct()
    pairs = cells.join(blocks, "coarse").where("abs(band - other) <= 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = written(pairs.select(*_TASK, "parts"), "join-pairs")
    home = open_.join(pairs, ["coarse", "band", "chunk"]).select("id", "label", *_TASK)
    away = rest.select("id", "label", "coarse", F.col("band").alias("other")).join(pairs, ["coarse", "other"]).where("part = pmod(xxhash64(id, 1), parts)").select("id", "label", *_TASK)
    return _verify(written(home.unionByName(away).distinct(), "join-tasks"), rows, words, percent)
