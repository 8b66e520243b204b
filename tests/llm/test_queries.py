"""The queries op1 to op10 on a small folder of tables: against their SQL, or written out plainly."""

import hashlib
import math
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from larkspur import llm
from larkspur.llm import langid, mixing, pieces, pii, quality
from larkspur.llm.queries import MIX_TARGETS

from test_text import brute_pii, words_of

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The driver's smallest tables with odd rows and columns whose names the operators use."""
    out = tmp_path_factory.mktemp("tables")
    docs = pq.read_table(SF / "documents.parquet").to_pylist()
    odd = [None, "", " \n", "x", "X", "one two", "a@b.co and 10.0.0.1", docs[3]["text"], docs[3]["text"].upper(), "ä" * 40_000, "long text, " * 20_000, "1 2 3 ! ?"]
    docs += [{"doc_id": 10_000 + i, "text": t, "lang": [None, "en"][i % 2], "source": [None, "src1"][i // 2 % 2], "n_chars": None} for i, t in enumerate(odd)]
    for d in docs:
        d |= {"key": "k", "__made": 1, "__key": "z", "__tokens": 2, "id": 3, "hash": 4, "count": 5, "block": 6}
    pq.write_table(pa.Table.from_pylist(docs), out / "documents.parquet", row_group_size=40)
    pages = pq.read_table(SF / "pages.parquet").to_pylist()
    pages += [{"page_id": 900 + i, "url": u, "html": h} for i, (u, h) in enumerate([(None, None), ("", ""), ("http://Net/x", pages[0]["html"]), ("x://a.example.net/en/y?z", pages[0]["html"]), ("nothing", "é" * 70_000)])]
    pq.write_table(pa.Table.from_pylist([p | {"sha": "s", "k": 1, "host": "h", "rule": 2} for p in pages]), out / "pages.parquet")
    vectors = pq.read_table(SF / "embeddings.parquet").to_pylist()
    for i, v in enumerate([None, [None] + [0.1] * 63, [math.nan] + [0.1] * 63, [math.inf] * 64, vectors[50]["embedding"], [5000.0] + [0.0] * 63]):
        vectors.append({"vec_id": 10_000 + 50 * i, "embedding": v, "label": None})
    types = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("pivot", pa.int32())])
    pq.write_table(pa.Table.from_pylist([v | {"pivot": 1} for v in vectors], schema=types), out / "embeddings.parquet")
    pq.write_table(pq.read_table(SF / "labels.parquet"), out / "labels.parquet")
    return out


@pytest.fixture(scope="module")
def oracle(folder):
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def run(spark, folder, name):
    return llm.queries()[name](spark, str(folder))


def documents(folder):
    return {d["doc_id"]: d for d in pq.read_table(folder / "documents.parquet").to_pylist()}


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows_as_the_sql(spark, folder, oracle, name):
    got = run(spark, folder, name)
    cols = ", ".join(f'"{c}"' for c in got.columns)
    want = oracle.sql(f"select {cols} from ({llm.oracle_sql()[name]})")
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_op2(spark, folder):
    docs, v = documents(folder), pieces.vocabulary(pieces.MODEL)
    got = run(spark, folder, "op2_pieces").collect()
    assert len(got) == len(docs) and all(x.round_trip for x in got)
    for x in got:
        ids = v.whole.encode(docs[x.doc_id]["text"] or "")
        assert (x.n_pieces, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_op4(spark, folder):
    """Every text scored alone against codewords, from counts of the learned texts."""
    docs = documents(folder)

    def grams(text):
        data = langid._FOLD[np.frombuffer(text.encode(), np.uint8)]
        return np.concatenate([langid.gram_slots(data, n) for n in langid.ORDERS])

    learned = {}
    for i, d in docs.items():
        if fold(i, 3) != 1 and d["lang"] is not None and d["text"] is not None:
            learned[d["lang"]] = learned.get(d["lang"], 0) + np.bincount(grams(d["text"]), minlength=langid.SLOTS)
    names = sorted(learned)
    share = np.array([(learned[x] + 0.05) / (learned[x] + 0.05).sum() for x in names])
    codes = langid.codewords(len(names))
    weights = np.stack([np.rint(1024.0 * np.log(share[c > 0].mean(0) / share[c < 0].mean(0))) for c in codes.T], 1)
    for x in run(spark, folder, "op4_language").collect():
        text = docs[x.doc_id]["text"]
        assert x.held_out is (fold(x.doc_id, 3) == 1)
        if not any(c.isalpha() for c in text or ""):
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        g = grams(text)
        margin = 4.0 * weights[g].sum(0) / 1024.0 / max(1, len(g))
        loss = [float(np.mean([math.log1p(math.exp(-max(-30, min(30, m * b)))) for m, b in zip(margin, code)])) for code in codes]
        odds = [math.exp(-(v - min(loss)) * codes.shape[1]) for v in loss]
        assert x.lang_pred == names[loss.index(min(loss))] and x.score == pytest.approx(max(odds) / sum(odds), abs=1e-3)


def test_op6(spark, folder):
    """Follow-the-regularised-leader, one weight at a time."""
    docs = documents(folder)
    labels = {x["doc_id"]: x["quality"] for x in pq.read_table(folder / "labels.parquet").to_pylist() if x["quality"] is not None}

    def features(text):
        return quality._features(quality._tokens(np.frombuffer((text or "").encode(), np.uint8))[0])

    rows = []
    for i, y in labels.items():
        if fold(i, 5) != 0 and i in docs:
            at, n = np.unique(features(docs[i]["text"]), return_counts=True)
            key = hashlib.md5(at.astype(np.int32).tobytes() + n.astype(np.int32).tobytes()).digest()
            rows.append((key, at.tolist(), n.tolist(), y))
    rows.sort()
    z, n = {}, {}

    def weight(j):
        v = z.get(j, 0.0)
        return 0.0 if abs(v) <= quality.L1 else -(v - math.copysign(quality.L1, v)) / ((quality.BETA + math.sqrt(n.get(j, 0.0))) / quality.ALPHA + quality.L2)

    rng = np.random.default_rng(6)
    for _ in range(quality.PASSES):
        for k in rng.permutation(len(rows)):
            _, at, counts, y = rows[k]
            x = {j: float(np.float32(quality.GAIN * c / max(1, sum(counts)))) for j, c in zip(at, counts)} | {"bias": 1.0}
            w = {j: weight(j) for j in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[j] * v for j, v in x.items())))))
            for j, v in x.items():
                g = (p - y) * v
                z[j] = z.get(j, 0.0) + g - (math.sqrt(n.get(j, 0.0) + g * g) - math.sqrt(n.get(j, 0.0))) / quality.ALPHA * w[j]
                n[j] = n.get(j, 0.0) + g * g
    final = {j: weight(j) for j in z}
    got = run(spark, folder, "op6_quality").collect()
    assert len(got) == len(docs)
    for x in got:
        f = features(docs[x.doc_id]["text"])
        s = final.get("bias", 0.0) + quality.GAIN * sum(final.get(int(j), 0.0) for j in f) / max(1, len(f))
        assert x.held_out is (fold(x.doc_id, 5) == 0) and x.predicted == int(x.score >= 0.3)
        assert x.score == pytest.approx(1 / (1 + math.exp(-s)), abs=2e-3)


def test_op8(spark, folder):
    docs, weights = documents(folder), pii.trained_weights()
    got = run(spark, folder, "op8_pii").collect()
    assert len(got) == len(docs)
    for x in got:
        text = docs[x.doc_id]["text"] or ""
        base = brute_pii(text)
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert x.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        added = [s for s in pii.crf_spans(text, weights) if all(e <= s[0] or s[2] <= b for b, _, e in base)]
        assert x.spans == pii.joined(sorted(base + added)) and (x.n_added, x.n_spans) == (len(added), len(base) + len(added))


def test_op10(spark, folder):
    """Cells raked with dictionaries, and probabilities by bisection."""
    docs = documents(folder)
    got = run(spark, folder, "op10_mixing").collect()
    assert sorted(x.doc_id for x in got) == sorted(docs)
    cells = {}
    for x in got:
        d = docs[x.doc_id]
        assert (x.source, x.lang, x.n_tokens) == (d["source"], d["lang"], len(words_of(d["text"]))) and (x.topic is None) == (x.n_tokens == 0)
        cells[x.source, x.lang, x.topic] = cells.get((x.source, x.lang, x.topic), 0) + x.n_tokens
    total = sum(cells.values())
    live = {c: n for c, n in cells.items() if n}
    goals = []
    for d, name in enumerate(("source", "lang", "topic")):
        tokens = {}
        for c, n in live.items():
            tokens[c[d]] = tokens.get(c[d], 0) + n
        goal = {v: MIX_TARGETS.weights["lang"].get(v, 0.0) if name == "lang" else n ** MIX_TARGETS.temper[name] for v, n in tokens.items()}
        goals.append({v: g / sum(goal.values()) for v, g in goal.items()})
    fit = {c: n / total for c, n in live.items()}
    for _ in range(500):
        for d in (0, 2, 1):  # stated targets last
            goal = goals[d]
            now = {v: sum(f for c, f in fit.items() if c[d] == v) for v in goal}
            fit = {c: f * goal[c[d]] / now[c[d]] if now[c[d]] else 0.0 for c, f in fit.items()}
    for x in got:
        c = (x.source, x.lang, x.topic)
        assert x.weight == pytest.approx(fit[c] * total / live[c] if c in live else 1.0, rel=1e-2, abs=1e-6)
    for v, g in goals[1].items():
        assert sum(x.n_tokens * x.weight for x in got if x.n_tokens and x.lang == v) / total == pytest.approx(g, abs=1e-6)
    ratio = {c: f * total / live[c] for c, f in fit.items()}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(1.0, mid * r) * live[c] for c, r in ratio.items()) < 0.5 * total else (lo, mid)
    for x in got:
        c = (x.source, x.lang, x.topic)
        assert x.probability == pytest.approx(min(1.0, lo * ratio[c]) if c in live else 0.5, abs=5e-3)
        assert x.kept in (True, False) and (x.kept or x.probability < 1) and (x.probability > 0 or not x.kept)


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_empty_tables(spark, folder, tmp_path, name):
    for p in folder.glob("*.parquet"):
        pq.write_table(pq.read_table(p).slice(0, 0), tmp_path / p.name)
    got = run(spark, tmp_path, name)
    assert got.count() == 0 and got.columns == run(spark, folder, name).columns if name == "op3_url_filter" else got.count() == 0


def test_op10_reaches_its_targets(spark):
    """On whole documents of the driver, whose languages share all sources."""
    got = llm.queries()["op10_mixing"](spark, str(SF)).collect()
    total = sum(x.n_tokens for x in got)
    there = {x.lang for x in got}
    goal = {v: w for v, w in MIX_TARGETS.weights["lang"].items() if v in there}
    for v, w in goal.items():
        assert sum(x.n_tokens * x.weight for x in got if x.lang == v) / total == pytest.approx(w / sum(goal.values()), abs=1e-3)
    assert sum(x.n_tokens * x.probability for x in got) == pytest.approx(total / 2, rel=1e-6)
