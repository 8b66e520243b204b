"""SentencePiece encoding and decoding with the published BPE vocabulary, exact for giant texts.

A segmentation into pieces is the vocabulary's own encoding if and only if every two adjacent
pieces are the encoding of their concatenation, and there is one such segmentation. So encoding
is a path problem in the max-plus semiring: pieces are states, a step scores 0 between compatible
neighbours and minus infinity otherwise. A giant text is split into chunks; each chunk yields the
transfer matrix from the pieces over its left border to those over its right border. Matrices
are combined by an associative scan, which fixes the piece over every border, and each chunk is
then traced back on its own. Texts of one chunk go through the library, the same optimum.

No piece of the vocabulary holds a space mark after another character, so every such place is a
border of all segmentations; between the first and last of a chunk the library encodes directly.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import textbytes as tb
from larkspur.llm.storage import fresh_name, small_batches, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts of more characters than GIANT are split into chunks of CHUNK characters.
GIANT, CHUNK = 1 << 15, 1 << 14
SPACE = "▁"
#: Words whose ids a worker keeps at most (it starts anew beyond).
KEPT_WORDS = 30_000
#: Chunks of giant texts that a worker turns into rows at a time.
CHUNKS_AT_ONCE = 16
_WORD = re.compile("▁*[^▁]+|▁+")
START = (0, 0)  # the state before the first piece

State = tuple[int, int]  # of the piece over border p: (p - its start, its end - p)
Matrix = dict[State, frozenset[State]]  # left state -> right states that score 0; all else scores minus infinity


class Vocabulary:
    """The model with helpers over normalised text (spaces as marks, one mark in front)."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        plain = proto.normalizer_spec.name == "identity" and proto.normalizer_spec.add_dummy_prefix and not proto.normalizer_spec.remove_extra_whitespaces
        if not plain or proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback and the identity normaliser is needed")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        proto.normalizer_spec.add_dummy_prefix = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.bytes = [self.whole.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self._words: dict[str, bytes] = {}
        self._fit: dict[tuple[str, str], bool] = {}
        self._alone: dict[str, bool] = {}

    def alone(self, piece: str) -> bool:
        """Whether the piece is its own encoding."""
        found = self._alone.get(piece)
        if found is None:
            found = self._alone[piece] = self.inner.encode(piece) == [self.ids[piece]]
        return found

    def fit(self, a: str, b: str) -> bool:
        """Whether pieces a, b are the encoding of a + b; characters beyond the vocabulary fit all."""
        if a not in self.ids or b not in self.ids or (b[0] == SPACE and a[-1] != SPACE):
            return True
        found = self._fit.get((a, b))
        if found is None:
            if len(self._fit) > 1 << 20:
                self._fit.clear()
            found = self._fit[a, b] = self.inner.encode(a + b) == [self.ids[a], self.ids[b]]
        return found

    def at(self, text: str, p: int) -> list[str]:
        """Pieces that begin at p; a character beyond the vocabulary stands for itself."""
        found = [s for n in range(1, min(self.longest, len(text) - p) + 1) if (s := text[p : p + n]) in self.ids and self.alone(s)]
        return found if text[p] in self.ids else [text[p], *found]

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of whole texts of one chunk each. Every segmentation breaks before a space
        mark that follows another character, so words between such places are encoded once and kept."""
        known = self._words
        split = [_WORD.findall(normalised(t)) for t in texts]
        if len(known) > KEPT_WORDS:
            known.clear()
        new = list({w for words in split for w in words if w not in known})
        for w, ids in zip(new, self.inner.encode(new, num_threads=1), strict=True):
            known[w] = array("i", ids).tobytes()
        found = [b"".join([known[w] for w in words]) for words in split]
        offsets = np.cumsum([0, *(len(x) // 4 for x in found)])
        return offsets, np.frombuffer(b"".join(found), dtype=np.int32)

    def id_list(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for s in pieces:
            if s in self.ids:
                out.append(self.ids[s])
            else:
                out += [self.bytes[b] for b in s.encode("utf-8")]
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _forced(text: str, p: int) -> bool:
    return 0 < p < len(text) and text[p] == SPACE and text[p - 1] != SPACE


def _paths(v: Vocabulary, text: str, first: list[tuple[int, int]], begin: int, stop: int) -> dict[tuple[int, int], dict]:
    """All pieces reachable from ``first`` (or freely from ``begin``) up to those over ``stop``.

    Returns piece (start, end) -> {its possible predecessors}; None stands for a free start.
    """
    nodes: dict[tuple[int, int], list] = {}
    ends: dict[int, list[tuple[int, int]]] = {}
    for t in first:
        nodes[t] = []
        ends.setdefault(t[1], []).append(t)
    if not first:
        for s in v.at(text, begin):
            t = (begin, begin + len(s))
            nodes[t] = [None]
            ends.setdefault(t[1], []).append(t)
    pos = min(ends) if ends else stop
    while pos < stop:
        here = ends.get(pos)
        if here:
            for s in v.at(text, pos):
                before = [t for t in here if v.fit(text[t[0] : t[1]], s)]
                if before:
                    t = (pos, pos + len(s))
                    nodes[t] = before
                    ends.setdefault(t[1], []).append(t)
        pos += 1
    return nodes


class Chunk:
    """Characters [lo, hi) of a normalised text, with context around; ``whole`` is the text's length."""

    def __init__(self, v: Vocabulary, text: str, lo: int, hi: int, first: bool, last: bool):
        self.v, self.text, self.lo, self.hi, self.first, self.last = v, text, lo, hi, first, last
        a = next((p for p in range(lo, hi) if _forced(text, p)), None)
        b = next((p for p in range(hi - 1, lo - 1, -1) if _forced(text, p)), None) if a is not None else None
        self.head, self.tail = a, b

    def lefts(self) -> list[tuple[int, int]]:
        """Pieces over the left border (the one that holds the character before it)."""
        if self.first:
            return []
        return [(s, s + len(x)) for s in range(max(0, self.lo - self.v.longest), self.lo) for x in self.v.at(self.text, s) if s + len(x) >= self.lo]

    def _state(self, t: tuple[int, int], p: int) -> State:
        return (p - t[0], t[1] - p)

    def _ends(self, nodes, stop: int) -> list[tuple[int, int]]:
        """Pieces over ``stop``; at the end of the text only those that end there."""
        exact = self.last and stop == self.hi
        return [t for t in nodes if t[0] < stop <= t[1] and (t[1] == stop or not exact)]

    def _onward(self, stop: int) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
        """The pieces over the left border, and for each piece up to ``stop`` which of them lead to it, as
        bits: one pass for all."""
        lefts = self.lefts()
        nodes = _paths(self.v, self.text, lefts, self.lo, stop)
        bits = {t: 1 << i for i, t in enumerate(lefts)}
        for t in sorted(nodes):
            for p in nodes[t]:
                bits[t] = bits.get(t, 0) | bits[p]
        return lefts, bits

    def matrix(self) -> Matrix:
        if self.head is None:
            if self.first:
                return {START: frozenset(self._state(x, self.hi) for x in self._ends(_paths(self.v, self.text, [], self.lo, self.hi), self.hi))}
            lefts, bits = self._onward(self.hi)
            ends = [(self._state(x, self.hi), bits[x]) for x in self._ends(bits, self.hi)]
            return {self._state(t, self.lo): frozenset(s for s, b in ends if b >> i & 1) for i, t in enumerate(lefts)}
        right = frozenset(self._state(x, self.hi) for x in self._ends(_paths(self.v, self.text, [], self.tail, self.hi), self.hi))
        if self.first:
            return {START: right}
        lefts, bits = self._onward(self.head)
        there = 0
        for x, b in bits.items():
            there |= b if x[1] == self.head else 0
        return {self._state(t, self.lo): right if there >> i & 1 else frozenset() for i, t in enumerate(lefts)}

    def _trace(self, first: list, begin: int, stop: int, end: tuple[int, int] | None) -> list[str]:
        nodes = _paths(self.v, self.text, first, begin, stop)
        goals = [end] if end else [t for t in nodes if t[1] == stop]

        # walk back; a piece may have several predecessors but one full path exists
        def back(t, acc):
            stack, seen = [(t, acc)], set()
            while stack:
                t, acc = stack.pop()
                if t in seen:
                    continue
                seen.add(t)
                if t in first:
                    return acc
                for p in nodes.get(t, ()):
                    if p is None:
                        return (t, acc)
                    stack.append((p, (t, acc)))
            return False

        for g in goals:
            if g in nodes:
                acc = back(g, None)
                if acc is not False:
                    out = []
                    while acc:
                        out.append(self.text[acc[0][0] : acc[0][1]])
                        acc = acc[1]
                    return out
        raise ValueError("no segmentation between the given states")

    def pieces(self, left: State, right: State) -> list[int]:
        """Ids of the pieces that begin in this chunk, given the pieces over its borders."""
        first = [] if self.first else [(self.lo - left[0], self.lo + left[1])]
        end = (self.hi - right[0], self.hi + right[1])
        if first and first[0] == end:
            return []
        if self.head is None:
            return self.v.id_list(self._trace(first, self.lo, self.hi, end))
        middle = self.v.inner.encode(self.text[self.head : self.tail])
        tail = self.v.id_list(self._trace([], self.tail, self.hi, end))
        if self.first:
            return self.v.inner.encode(self.text[self.lo : self.head]) + middle + tail
        return self.v.id_list(self._trace(first, self.lo, self.head, None)) + middle + tail


def compose(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two transfer matrices (associative)."""
    return {i: frozenset().union(*(b.get(j, frozenset()) for j in js)) for i, js in a.items()}


def scan(parts: list[Matrix]) -> list[Matrix]:
    """All prefix products, by pairwise combination (log depth)."""
    if len(parts) <= 1:
        return parts
    half = scan([compose(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)])
    return [half[i // 2] if i % 2 else compose(half[i // 2 - 1], parts[i]) if i else parts[0] for i in range(len(parts))]


def border_states(parts: list[Matrix]) -> list[State]:
    """The state at every right border of a text's chunks, in order."""
    forward = scan(parts)
    states: list[State] = []
    allowed: frozenset[State] | None = None
    for k in range(len(parts) - 1, -1, -1):
        possible = forward[k][START]
        if allowed is not None:
            possible = frozenset(s for s in possible if parts[k + 1].get(s, frozenset()) & allowed)
        if len(possible) != 1:
            raise ValueError("the segmentation is not unique")
        allowed = possible
        states.append(next(iter(possible)))
    return states[::-1]


def split(text: str, chunk: int, context: int) -> Iterator[tuple[int, bool, str, int, int]]:
    """(number, last, context text, lo, hi) of each chunk of a normalised text."""
    n = -(-len(text) // chunk)
    for k in range(n):
        lo, hi = k * chunk, min(len(text), (k + 1) * chunk)
        at = max(0, lo - context)
        yield k, k == n - 1, text[at : hi + context], lo - at, hi - at


def encode_chunked(text: str, v: Vocabulary, chunk: int) -> list[int]:
    """The whole scheme on one text in one process (for tests and small uses)."""
    if not text:
        return []
    chunks = [Chunk(v, t, lo, hi, k == 0, last) for k, last, t, lo, hi in split(normalised(text), chunk, v.longest)]
    states = border_states([c.matrix() for c in chunks])
    return [i for c, left, right in zip(chunks, [START, *states], states, strict=False) for i in c.pieces(left, right)]


_CHUNKS = pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("text", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())])
_CHUNKS_DDL = "key string, chunk int, last boolean, text string, lo int, hi int"
_MATRIX_DDL = "key string, chunk int, pairs array<int>"


def _encode_giants(giants: DataFrame, model: str, chunk: int) -> DataFrame:
    """Rows (key, ids) of giant texts (key, text)."""

    def cut(batches):
        v = vocabulary(model)
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                key = key.as_py()
                for part in split(normalised(text.as_py()), chunk, v.longest):
                    yield pa.RecordBatch.from_pylist([dict(zip(_CHUNKS.names, (key, *part), strict=True))], schema=_CHUNKS)

    def each(b, extra=()):
        names = ("key", "chunk", "last", "text", "lo", "hi", *extra)
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)

    def few(batches):
        for b in batches:
            for i in range(0, b.num_rows, CHUNKS_AT_ONCE):
                yield b.slice(i, CHUNKS_AT_ONCE)

    def matrices(batches):
        v = vocabulary(model)
        for b in few(batches):
            rows = []
            for key, k, last, text, lo, hi in each(b):
                m = Chunk(v, text, lo, hi, k == 0, last).matrix()
                rows.append({"key": key, "chunk": k, "pairs": [x for i, js in m.items() for j in js or [(-1, -1)] for x in (*i, *j)]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("pairs", pa.list_(pa.int32()))]))

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        parts = []
        for r in rows:
            m: dict = {}
            for a, b, c, d in zip(*[iter(r["pairs"])] * 4, strict=True):
                m.setdefault((a, b), set()).update({(c, d)} if c >= 0 else ())
            parts.append({k: frozenset(x) for k, x in m.items()})
        states = border_states(parts)
        out = [{"key": r["key"], "chunk": r["chunk"], "a": p[0], "b": p[1], "c": q[0], "d": q[1]} for r, p, q in zip(rows, [START, *states], states, strict=False)]
        return pa.Table.from_pylist(out, schema=pa.schema([("key", pa.string()), *((n, pa.int32()) for n in ("chunk", "a", "b", "c", "d"))]))

    def trace(batches):
        v = vocabulary(model)
        for b in few(batches):
            rows = [{"key": key, "chunk": k, "ids": Chunk(v, text, lo, hi, k == 0, last).pieces((a, bb), (c, d))} for key, k, last, text, lo, hi, a, bb, c, d in each(b, ("a", "b", "c", "d"))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    chunks = written(giants.mapInArrow(cut, _CHUNKS_DDL).repartition("key", "chunk"), "piece-chunks")
    # one text's matrices meet in a group: a text is at most 2 GB, so its chunks are bounded
    states = chunks.mapInArrow(matrices, _MATRIX_DDL).groupBy("key").applyInArrow(combine, "key string, chunk int, a int, b int, c int, d int")
    traced = chunks.join(states, ["key", "chunk"]).mapInArrow(trace, "key string, chunk int, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    return traced.groupBy("key").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, check_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col`` array<int> added, the ids of the whole text (other columns stay).

    With ``check_col``, also a boolean of that name: whether decoding the ids gives the text.

    A null or empty text has no ids. The ids equal the library's own encoding of the text. Rows
    with equal ids or texts each keep their row; a column named ``ids_col`` is replaced.
    """
    keep = [f"`{c}`" for c in docs.columns if c not in (ids_col, check_col)]

    @F.arrow_udf("struct<ids:array<int>, same:boolean>")
    def direct(column: pa.Array) -> pa.Array:
        v, ids, counts, same = vocabulary(model), [np.zeros(0, np.int32)], [], []
        for i, j in tb.groups(tb.buffers(column)[0]):  # Python strings and lists of a small part at a time
            texts = [x or "" for x in column.slice(i, j - i).to_pylist()]
            at, part = v.encode_texts(texts)
            ids.append(part)
            counts.append(np.diff(at))
            if check_col:  # here, so that one worker per task does both ways
                back = v.whole.decode([part[m:n].tolist() for m, n in zip(at[:-1], at[1:], strict=True)])
                same += [x == y.replace(SPACE, " ") for x, y in zip(back, texts, strict=True)]
        offsets = np.cumsum(np.concatenate([[0], *counts]))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
        tb.release()
        return pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_()) if check_col else pa.nulls(len(column), pa.bool_())], ["ids", "same"])

    small_batches(docs.sparkSession)
    long = F.coalesce(F.length(text_col), F.lit(0)) > giant
    out = fresh_name(docs.columns, "__made")
    made = docs.where(~long).select(*keep, direct(F.col(text_col)).alias(out))
    small = made.select(*keep, F.col(f"{out}.ids").alias(ids_col), *([F.col(f"{out}.same").alias(check_col)] if check_col else []))
    key, other, found, back, same = (fresh_name([*docs.columns, ids_col, check_col or ""], n) for n in ("__key", "__other", "__ids", "__decoded", "__same"))
    giants = written(docs.where(long).select(F.expr("uuid()").alias(key), *keep), "piece-giants")
    if giants.isEmpty():
        return small
    ids = _encode_giants(giants.select(F.col(key).alias("key"), F.col(text_col).alias("text")), model, chunk)
    large = giants.join(ids.select(F.col("key").alias(other), F.col("ids").alias(found)), F.col(key) == F.col(other))
    if check_col:
        large = decode(large, found, back, model).withColumn(same, came_back(back, text_col))
    return small.unionByName(large.select(*keep, F.col(found).alias(ids_col), *([F.col(same).alias(check_col)] if check_col else [])))


def came_back(decoded: str = "decoded", text: str = "text") -> Column:
    """Whether a decoded text is the text it came from (space marks in it count as spaces)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return (F.col(decoded) == whole) | (F.col(decoded) == F.translate(whole, SPACE, " "))


def decode(docs: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``docs`` with ``text_col`` added: the text of the ids. Null ids give null, no ids the empty text.

    decode(encode(x)) is x, except that a space mark (U+2581) in a text comes back as a space.
    """

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        at, ids = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        there = column.is_valid().to_pylist()
        whole = vocabulary(model).whole
        # one text's ids as a Python list at a time
        found = [whole.decode(ids[i:j].tolist()) if ok else None for i, j, ok in zip(at[:-1], at[1:], there, strict=True)]
        tb.release()
        return pa.array(found, pa.string())

    return docs.withColumn(text_col, text(F.col(ids_col)))
