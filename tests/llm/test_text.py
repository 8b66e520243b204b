"""Text operators: against brute force, the tokenizer's library, round trips and held-out accuracy."""

import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import langid, mixing, ngram_join, pieces, pii, quality
from larkspur.llm import textbytes as tb

DOCS = "doc_id long, text string, lang string, source string, n long, score double, id long, label int, component long"


def docs_of(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, 0, 0.5, 7, 1, 2) for i, t in texts], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles_of(text, size):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAb \n\té漢\x1c", max_size=30), max_size=12))
def test_word_hashes(texts):
    found = list(tb.each_words(pa.array(texts, pa.string())))
    assert [len(h) for h in found] == [len(words_of(t)) for t in texts]
    names = {}
    for t, h in zip(texts, found):
        for w, x in zip(words_of(t), h):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def near(r, words, changes):
    out = list(words)
    for _ in range(changes):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 50)])
def test_ngram_components(spark, monkeypatch, size, percent):
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", 300)  # several chunks to a class
    r, texts = random.Random(size), []
    vocabulary = [f"w{k}" for k in range(400)]
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randrange(20, 150))]
        texts += [near(r, base, r.randrange(0, 6)) for _ in range(r.randrange(1, 7))]
    crowd = [r.choice(vocabulary) for _ in range(60)]
    texts += [near(r, crowd, r.randrange(0, 3)) for _ in range(60)]
    texts += [None, "", " \n", "one", "ONE", "one two", "One  Two", "a b c", texts[0], texts[0].upper(), "漢 字 é"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    sets = {i: shingles_of(t, size) for i, t in zip(ids, texts)}
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    got = ngram_join.ngram_components(docs_of(spark, list(zip(ids, texts))), words=size, percent=percent).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == {(i, len(sets[i]), top(i)) for i in ids}


def test_ngram_edges(spark):
    assert ngram_join.ngram_components(docs_of(spark, [])).count() == 0
    got = ngram_join.ngram_components(docs_of(spark, [(None, "a b"), (3, "a b"), (3, "a b"), (5, "a b"), (8, "x " * 50_000), (9, "x " * 50_001)]), words=3, percent=90).collect()
    assert sorted((x.doc_id, x.component_id) for x in got if x.doc_id is not None) == [(3, 3), (3, 3), (5, 3), (8, 8), (9, 8)]
    assert [x.component_id for x in got if x.doc_id is None] == [None]


def test_large_class_of_links(spark):
    """More linked documents than a task holds."""
    r = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    texts = list(enumerate(near(r, base, 1) for _ in range(900)))
    texts += [(10_000, "far away from all of this"), (10_001, " ".join(base[:40]))]
    got = ngram_join.ngram_components(docs_of(spark, texts), words=3, percent=90).collect()
    assert {x.component_id for x in got if x.doc_id < 10_000} == {0} and {x.component_id for x in got if x.doc_id >= 10_000} == {10_000, 10_001}


@pytest.mark.parametrize("again", [(), (1, 2)])
def test_large_class_without_links(spark, monkeypatch, again):
    """A class far beyond a task, most of whose documents are linked with nothing; rare links are found."""
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", 400)
    monkeypatch.setattr(ngram_join, "AGAIN", again)
    monkeypatch.setattr(ngram_join, "route", lambda s, percent, seed=0: np.zeros(int(len(s) > 0), np.int64))  # one class
    r = random.Random(5)
    texts = [(i, " ".join(f"v{r.randrange(500)}" for _ in range(r.randrange(20, 60)))) for i in range(0, 300, 2)]
    texts += [(i + 1, near(r, t.split(), r.randrange(0, 2))) for i, t in texts[::5]]
    sets = {i: shingles_of(t, 3) for i, t in texts}
    want = components(sets, [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])])
    got = ngram_join.ngram_components(docs_of(spark, texts), words=3, percent=80).collect()
    assert len(set(want.values())) < len(want) and {x.doc_id: x.component_id for x in got} == want


def components(nodes, pairs):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32), st.sampled_from([50, 80, 90, 95, 99]), st.integers(0, 2))
def test_linked_sets_are_routed_together(n, seed, percent, again):
    """Two different sets that just keep the similarity have a routing hash in common."""
    rng = np.random.default_rng(seed)
    union = np.unique(rng.integers(0, 2**64, 100 * n // percent + 2, dtype=np.uint64, endpoint=False))
    a = np.sort(rng.choice(union, min(n, len(union)), replace=False))
    both = a.copy()
    rng.shuffle(both)
    rest = np.setdiff1d(union, a)
    rng.shuffle(rest)
    tries = [(drop, add) for drop in range(len(a) + 1) for add in range(len(rest) + 1) if drop + add and 100 * (len(a) - drop) >= percent * (len(a) + add)]
    for drop, add in [tries[int(i)] for i in rng.integers(0, len(tries), min(4, len(tries)))] + tries[-2:]:
        b = np.sort(np.concatenate([both[drop:], rest[:add]]))
        if len(b):
            assert ngram_join.linked(a, b, percent)
            assert set(ngram_join.route(a, percent, again).tolist()) & set(ngram_join.route(b, percent, again).tolist()), (len(a), drop, add)


def test_stars_of_batches():
    """Edges from the first id of each hash, wherever batches end, and hashes combined before the shuffle."""
    r = random.Random(8)
    sets = [(i, sorted({r.randrange(40) if r.random() < 0.7 else 5 for _ in range(4)})) for i in range(120)]
    schema = pa.schema([("id", pa.int64()), ("hashes", pa.list_(pa.int64()))])
    want = components(range(120), [(a, b) for a, x in sets for b, y in sets if a < b and set(x) & set(y)])
    for size in (1, 7, 50, 120):
        batches = [pa.RecordBatch.from_pylist([{"id": i, "hashes": h} for i, h in sets[k : k + size]], schema=schema) for k in range(0, 120, size)]
        posts = sorted((x["hash"], x["id"], x["first"]) for b in ngram_join._posts(iter(batches)) for x in b.to_pylist() if x["first"] is None)
        made = [(x["first"], x["id"]) for b in ngram_join._posts(iter(batches)) for x in b.to_pylist() if x["first"] is not None]
        assert len(posts) <= 40 * len(batches)
        for cut in (1, 3, 1000):
            rows = [pa.RecordBatch.from_pylist([dict(zip(("hash", "id", "first"), p)) for p in posts[k : k + cut]], schema=pa.schema([(n, pa.int64()) for n in ("hash", "id", "first")])) for k in range(0, len(posts), cut)]
            edges = [(x["u"], x["v"]) for b in ngram_join._stars(iter(rows)) for x in b.to_pylist()]
            assert components(range(120), edges + made) == want


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_signature_bound(a, b):
    a, b = np.array(sorted(a), np.uint64), np.array(sorted(a ^ b), np.uint64)
    apart = len(set(a.tolist()) ^ set(b.tolist()))
    for bits in (512, 4096):
        x, y = ngram_join.signature(a, bits), ngram_join.signature(b, bits)
        assert int(np.bitwise_count(x ^ y).sum()) <= apart
    assert ngram_join.overlap(a, b) == len(set(a.tolist()) & set(b.tolist()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "the", "ing", "  ", "é", "漢", "\n", "▁", "aaaa", "1", "😀", "\x00"]), max_size=40).map("".join), st.integers(2, 25))
def test_pieces_equal_the_library(text, chunk):
    v = pieces.vocabulary(pieces.MODEL)
    assert pieces.encode_chunked(text, v, chunk) == v.whole.encode(text)
    offsets, ids = v.encode_texts([text])
    assert ids.tolist() == v.whole.encode(text)


def test_compose_is_associative():
    r = random.Random(2)
    s = [(a, b) for a in range(3) for b in range(2)]
    a, b, c = ({x: frozenset(r.sample(s, 2)) for x in s} for _ in range(3))
    assert pieces.compose(pieces.compose(a, b), c) == pieces.compose(a, pieces.compose(b, c))
    assert pieces.scan([a, b, c])[-1] == pieces.compose(pieces.compose(a, b), c)


def test_pieces_in_spark(spark):
    r = random.Random(1)
    texts = [(1, None), (2, ""), (3, " lead and  two"), (4, "".join(r.choice("abc ") for _ in range(900))), (5, "x" * 700), (6, "漢字" * 300), (6, "again"), (7, "a▁b")]
    out = pieces.decode(pieces.encode(docs_of(spark, texts), giant=200, chunk=64)).withColumn("same", pieces.came_back())
    v = pieces.vocabulary(pieces.MODEL)
    got = out.collect()
    assert len(got) == len(texts) and all(x.same for x in got) and "component" in out.columns
    assert sorted((x.doc_id, x.ids) for x in got) == sorted((i, v.whole.encode(t or "")) for i, t in texts)
    both = pieces.encode(docs_of(spark, texts), giant=200, chunk=64, check_col="same").collect()
    assert all(x.same for x in both) and sorted((x.doc_id, x.ids) for x in both) == sorted((x.doc_id, x.ids) for x in got)
    assert pieces.encode(docs_of(spark, []), check_col="same").count() == 0


def brute_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m.group())) <= 15]
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.+- 02(b)9-%é", max_size=60))
def test_pii_base(text):
    assert pii.base_spans(text) == brute_pii(text)


def test_pii_viterbi_is_the_best_segmentation():
    weights = pii.trained_weights()
    text = "call +1 (314) 555-6532 4663 6226 or 12 34"
    borders, found = pii._lattice(text, *pii.runs(text)[0])
    n, scores = len(borders) - 1, pii._scores(weights, found)

    def best(p):
        if p >= n:
            return 0.0
        return max([best(p + 1)] + [best(j) + float(max(s[1:])) for (i, j, _), s in zip(found, scores) if i == p])

    got = sum(float(max(s[1:])) for (i, j, _), s in zip(found, scores) if any((i, j) == (a, b) for a, b, _ in pii.decode(weights, n, found)))
    assert got == pytest.approx(best(0))


def test_pii_runs():
    text = "x ann.w[at]host(dot)com, 12 or mail (at) post.org 3 (at) [at]q.com a[at]b"
    assert [text[i:j] for i, j in pii.runs(text)] == ["ann.w[at]host(dot)com", "12 ", "mail (at) post.org", "3 ("]
    for n in (0, 1, 50):
        assert pii.runs("a" * n + "[at]b.c") == ([(0, n + 7)] if n else [])


@pytest.mark.parametrize("text", ["a" * 10**6 + "7", "a[at]" * 200_000, "ab1" * 300_000, "a@" * 500_000, "(at)" * 250_000, "1 " * 100_000, "+1(" * 300_000])
def test_pii_is_linear_on_long_texts(text):
    began = time.perf_counter()
    base, both = pii.all_spans(text, pii.trained_weights())
    assert time.perf_counter() - began < 20 and len(base) <= len(both)


def test_pii_model_on_unseen_lines():
    weights = pii.trained_weights()
    lines = pii._training_lines(seed=99)
    right = sum([(s, k + 1, e) for s, k, e in pii.crf_spans(t, weights)] == gold for t, gold in lines)
    assert right / len(lines) > 0.9


def test_pii_in_spark(spark):
    texts = [(1, None), (2, ""), (3, "é a@b.co 10.0.0.1, 4111 1111 1111 1111 x +1 (314) 555-6532"), (3, "tel 314-555-6532."), (4, "word " * 60_000 + "z@y.org"), (5, "0" * 50_000), (6, "@" * 5000)]
    got = {(x.doc_id, x.spans): x for x in pii.find_pii(docs_of(spark, texts)).collect()}
    assert len(got) == 7 and [x.spans for x in got.values() if x.doc_id in (1, 2)] == ["", ""]
    row = next(x for x in got.values() if x.doc_id == 3 and x.n_email)
    assert row.spans == "email:2:8,ip:9:17,card:19:38,phone:41:58" and (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert next(x for x in got.values() if x.doc_id == 4).spans == "email:300000:300007"
    assert pii.find_pii(docs_of(spark, [])).count() == 0


SF = Path("/root/testdata/sf0.1")


def table(name):
    import pyarrow.parquet as pq

    if not SF.exists():
        pytest.skip("the driver's tables are not here")
    return pq.read_table(SF / f"{name}.parquet").to_pylist()


def test_codewords():
    for n in (2, 3, 4, 7, 20):
        codes = langid.codewords(n)
        apart = [(codes[i] != codes[j]).sum() for i in range(n) for j in range(i)]
        assert len(codes) == n and min(apart) >= (1 if n == 2 else max(2, codes.shape[1] // 5))


def test_language_held_out():
    docs = table("documents")
    model = langid.fit([(d["text"], d["lang"]) for d in docs[:2000]])
    rest = docs[4000:6000]
    best, score, unsure = model.predict(pa.array([d["text"] for d in rest]))
    right = np.array([model.languages[i] == d["lang"] for i, d in zip(best, rest)])
    assert right.mean() > 0.97 and (score >= 0).all() and (score <= 1).all()
    alone = [model.predict(pa.array([d["text"]])) for d in rest[:50]]
    assert all(a[0][0] == b and a[1][0] == s for a, b, s in zip(alone, best, score))  # whatever the batch


def test_language_edges(spark):
    train = docs_of(spark, [(i, "the cat and the dog") for i in range(20)], "en").unionByName(docs_of(spark, [(i, "der hund und die katze") for i in range(20, 40)], "de")).unionByName(docs_of(spark, [(50, None)], None))
    texts = [(1, None), (2, ""), (3, "123 !!"), (4, "der hund"), (5, "the dog " * 200_000)]
    got = {x.doc_id: x for x in langid.identify(docs_of(spark, texts, None), train).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["und", "und", "und", "de", "en"] and got[1].score == 0.0
    assert [x.lang_pred for x in langid.identify(docs_of(spark, texts, None), train.limit(0)).collect()] == ["und"] * 5
    assert langid.identify(docs_of(spark, []), train).count() == 0


def test_quality_held_out():
    docs, labels = {d["doc_id"]: d["text"] for d in table("documents")}, {x["doc_id"]: x["quality"] for x in table("labels")}
    known = sorted(set(docs) & set(labels))
    model = quality.fit([(docs[i], labels[i]) for i in known[:2500]])
    rest = known[2500:]
    predicted = model.scores(pa.array([docs[i] for i in rest])) >= quality.THRESHOLD
    truth = np.array([labels[i] == 1 for i in rest])
    assert (predicted == truth).mean() > 0.97


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (4, 0)], "doc_id long, quality int")
    docs = docs_of(spark, [(1, "good words here"), (2, "fine text too"), (3, None), (4, "$$$ *** ###"), (5, ""), (6, "w " * 400_000), (6, "x")])
    got = quality.scored(docs, quality.train_on(docs, labels))
    assert got.count() == 7 and {"source", "component"} <= set(got.columns)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.collect())
    none = quality.train_on(docs, labels.limit(0))
    assert {x.score for x in quality.scored(docs, none).collect()} == {0.5}


def test_quality_learns_from_long_texts(spark):
    """Texts of any length are in the sample, and what they alone show is learned."""
    r = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    texts = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(40)]
    texts += [(i, " ".join(r.choice(["spam", "offer", "click"]) for _ in range(6000))) for i in range(40, 60)]
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(60)], "doc_id long, quality int")
    model = quality.train_on(docs_of(spark, texts), labels)
    assert (model.weights == quality.fit([(t, int(i < 40)) for i, t in texts]).weights).all()
    scores = model.scores(pa.array(["offer click spam click offer", " ".join(words[:60])]))
    assert scores[0] < quality.THRESHOLD < scores[1]


def test_raking():
    rng = np.random.default_rng(3)
    observed = rng.integers(1, 1000, (5, 4, 3)).astype(float)
    observed[0, 0] = 0
    goals = [rng.random(n) for n in observed.shape]
    fitted = mixing.rake(observed, goals)
    for d, g in enumerate(goals):
        assert np.allclose(fitted.sum(tuple(a for a in range(3) if a != d)), g / g.sum(), atol=1e-6)
    assert (fitted[0, 0] == 0).all()
    for share in (0.05, 0.5, 0.9, 1.0):
        p = mixing.calibrated(observed, fitted, share)
        assert p.max() <= 1 and (p * observed).sum() == pytest.approx(share * observed.sum(), rel=1e-9)
    assert mixing.rake(np.zeros((2, 2)), [np.ones(2), np.ones(2)]).sum() == 0


def test_mixing(spark):
    r = random.Random(2)
    # one vocabulary, so that no topic is of one source alone
    a = docs_of(spark, [(i, "word " * r.randrange(1, 40)) for i in range(1500)], "en", "big")
    b = docs_of(spark, [(i, "word " * r.randrange(1, 40)) for i in range(1500, 2000)], "en", "small")
    odd = docs_of(spark, [(3000, None), (3001, ""), (3001, "")], None, None)
    targets = mixing.MixTargets(weights={"source": {"big": 1, "small": 1}}, temper={"lang": 1.0, "topic": 1.0}, keep_share=0.4)
    got = mixing.mix(a.unionByName(b).unionByName(odd), targets).collect()
    assert len(got) == 2003 and len({x.__getitem__("__kept") for x in got if x.doc_id == 3001}) == 1
    kept = {s: sum(x["__tokens"] for x in got if x["source"] == s and x["__kept"]) for s in ("big", "small")}
    assert 0.8 < kept["big"] / kept["small"] < 1.25
    assert mixing.mix(docs_of(spark, []), targets).count() == 0


@pytest.mark.parametrize("here", [True, False])
def test_mixing_of_many_values(spark, monkeypatch, here):
    """Every value is weighed by itself, however many there are, on the driver or not."""
    if not here:
        monkeypatch.setattr(mixing, "DRIVER_CELLS", 10)
        monkeypatch.setattr(mixing, "TOLERANCE", 1e-7)
    docs = spark.createDataFrame([(i, "word " * (1 + i // 60), f"l{i % 60}" if i < 590 else "rare", "s") for i in range(600)] + [(900, "", "none", "s")], "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, mixing.MixTargets(keep_share=0.3)).collect()
    seen = {}
    for x in got:
        seen.setdefault(x.lang, [0, x["__weight"], x["__probability"]])[0] += x["__tokens"]
    assert len(got) == 601 and len(seen) == 62 and seen.pop("none")[1:] == [1.0, 0.3]
    total, tempered = sum(v[0] for v in seen.values()), sum(v[0] ** 0.7 for v in seen.values())
    for n, weight, p in seen.values():
        assert weight == pytest.approx(total * n**0.7 / tempered / n, rel=1e-5) and p == pytest.approx(0.3 * weight, rel=1e-5)
    aimed = mixing.mix(docs, mixing.MixTargets(weights={"lang": {"rare": 1, "l0": 3}}, keep_share=0.01)).collect()
    share = {v: sum(x["__tokens"] * x["__weight"] for x in aimed if x.lang == v) for v in ("rare", "l0", "l1")}
    assert share["l1"] == 0 and share["l0"] == pytest.approx(3 * share["rare"]) and all(x["__probability"] > 0 for x in aimed if x.lang == "rare")
    one = mixing.mix(docs, mixing.MixTargets(weights={"lang": {"rare": 1, "l0": 3}}, keep_share=0.05)).collect()
    assert sum(x["__tokens"] * x["__probability"] for x in one) == pytest.approx(min(0.05 * total, seen["rare"][0] + seen["l0"][0])) and max(x["__probability"] for x in one) == 1
    with pytest.raises(ValueError, match="nowhere"):
        mixing.mix(docs, mixing.MixTargets(weights={"lang": {"nowhere": 1, "l0": 1}}))


def test_topics():
    """Texts of different vocabularies part; the order of the sample does not matter; words are counted."""
    r = random.Random(7)
    groups = [[f"{g}{k}" for k in range(60)] for g in "abcd"]
    texts = [" ".join(r.choice(groups[i % 4]) for _ in range(80)) + " the of and" for i in range(200)]
    slots = [mixing._slots(h) for h in tb.each_words(pa.array(texts))]
    model = mixing.learn_topics(slots)
    assert (model.weights == mixing.learn_topics(slots[::-1]).weights).all()
    topics, words = model.assign(pa.array([*texts, "", None, " \n", "the " * 200_000]))
    parts = [set(topics[g:200:4]) for g in range(4)]
    assert sum(map(len, parts)) == len(set().union(*parts)) and topics[200:203] == [None] * 3 and topics[203]
    assert words.tolist() == [83] * 200 + [0, 0, 0, 200_000]
    assert mixing.learn_topics([]).assign(pa.array(["a b"])) == (["t0"], [2])


def test_mixing_of_clashing_names(spark):
    docs = docs_of(spark, [(1, "a b"), (2, "c"), (None, "d"), (3, "word " * 300_000)]).withColumn("__made", F.lit("m")).withColumn("__mix_cell_lang", F.lit("c")).withColumn("topic", F.lit(4)).withColumn("__MIX_id", F.lit(5))
    got = mixing.mix(docs, prefix="out_")
    assert got.columns == [*docs.columns, *(f"out_{n}" for n in mixing.RESULTS)] and {(x["__made"], x.topic) for x in got.collect()} == {("m", 4)}
    assert sorted(x.out_tokens for x in got.collect()) == [1, 1, 2, 300_000]
    with pytest.raises(ValueError, match="__kept"):
        mixing.mix(docs.withColumn("__kept", F.lit(1)))


def test_pieces_of_clashing_names(spark):
    docs = docs_of(spark, [(1, "x" * 700), (2, "y")]).withColumn("key", F.lit("k")).withColumn("__key", F.lit("u")).withColumn("__made", F.lit("m")).withColumn("chunk", F.lit(3)).withColumn("__ids", F.lit(4))
    got = pieces.encode(docs, giant=200, chunk=64, check_col="same")
    assert got.columns == [*docs.columns, "ids", "same"] and all(x.same and (x.key, x["__key"], x["__made"], x.chunk, x["__ids"]) == ("k", "u", "m", 3, 4) for x in got.collect())


def test_matrix_in_one_pass():
    """Chunks without a space: the matrix of all left states is that of each alone."""
    v = pieces.vocabulary(pieces.MODEL)
    text = pieces.normalised("".join(random.Random(3).choice(["the", "ing", "aa", "x", "é", "tion"]) for _ in range(60)))
    for k, last, t, lo, hi in pieces.split(text, 40, v.longest):
        c = pieces.Chunk(v, t, lo, hi, k == 0, last)
        for left, rights in c.matrix().items():
            if k:
                nodes = pieces._paths(v, t, [(lo - left[0], lo + left[1])], lo, hi)
                assert rights == {c._state(x, hi) for x in c._ends(nodes, hi)}


def test_quality_of_one_long_token(spark):
    """A token longer than a piece is one token."""
    for text in ("a" * (3 * tb.PIECE + 5) + " end", "!" * (2 * tb.PIECE) + "ab", "b " + "é" * tb.PIECE):
        whole = quality._features(quality._tokens(np.frombuffer(text.encode(), np.uint8))[0])
        assert (next(quality.each_features(pa.array([text]))) == whole).all()


def test_quality_counts_an_id_once(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    hot = docs_of(spark, [(1, f"text {i}") for i in range(300)] + [(2, "other")])
    assert len(quality.training_sample(hot.withColumn("y", F.lit(1)), "doc_id", "text", "y")) == 2
    assert quality.train_on(hot, labels).weights.any()


def test_languages_have_no_cap(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD_LANGUAGES", 7)
    r = random.Random(3)
    names = ["q" + "".join("abcdefgh"[k // 8**j % 8] for j in range(3)) for k in range(300)]
    rows = [(i, " ".join(f"{n}{r.choice('uvwxyz')}" for _ in range(30)), n) for i, n in enumerate(names * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.training_counts(docs, "doc_id", "text", "lang")) == 300
    got = langid.identify(docs.where("doc_id < 300"), docs.where("doc_id >= 300")).collect()
    assert sum(x.lang_pred == names[x.doc_id] for x in got) > 290


def test_topics_of_every_text(spark):
    """Topics are learned from all texts and all their words, as in memory, whatever the partitions."""
    r = random.Random(11)
    groups = [[f"{g}{k}" for k in range(300)] for g in "abcdefghijkl"]
    texts = [" ".join(r.choice(groups[min(11, int(r.expovariate(0.5)))]) for _ in range(6)) + " the" * r.randrange(9) for _ in range(9000)]
    texts += ["", None, "bell " * 70_000 + "book", *texts[:50]]
    model = mixing.learn_topics([mixing._slots(h) for h in tb.each_words(pa.array(texts))])
    expected, words = model.assign(pa.array(texts))
    assert len(set(expected)) == mixing.TOPICS + 1
    docs = docs_of(spark, list(enumerate(texts)))
    for parts in (1, 7):
        got = mixing.mix(docs.repartition(parts)).collect()
        assert {x.doc_id: (x["__topic"], x["__tokens"]) for x in got} == dict(enumerate(zip(expected, words.tolist())))


def test_bags_keep_every_count():
    rng = np.random.default_rng(0)
    texts = [np.repeat(rng.permutation(mixing.TOPIC_SLOTS)[:k], rng.choice([1, 2, 7, 8, 9, 63, 64, 4095, 4096, 70_000], k)) for k in (5, 0, 3, 1, 0, 300, 0)]
    bags = mixing._bags(texts)
    got = {int(r): (at[p:q].tolist(), n[p:q].tolist()) for rows, first, at, n in mixing._entries(bags.slice(1)) for r, p, q in zip(rows + 1, first, [*first[1:], len(at)])}
    assert got == {i: tuple(x.tolist() for x in np.unique(t, return_counts=True)) for i, t in enumerate(texts) if i and len(t)}
    assert not list(mixing._entries(mixing._bags([]))) and sum(map(len, bags.to_pylist())) < 2 * 6 * 309


def test_topic_passes_do_no_needless_work(spark, monkeypatch):
    """A bag has an entry per distinct word; seeds are those of a race of all texts, and most texts that
    cannot win are left out of it."""
    r = random.Random(13)
    texts = [" ".join(f"{'abcdefghi'[i % 9]}{r.randrange(200)}" for _ in range(40)) + " the" * r.randrange(9) for i in range(12_000)]
    texts += ["", "the " * 1_200_000 + "end"]
    slots = [mixing._slots(h) for h in tb.each_words(pa.array(texts))]
    names = {n: n for n in ("made", "bag", "topic", "source", "lang", "tokens")}
    long = mixing.with_bags(docs_of(spark, [(1, texts[-1])]), "text", "source", "lang", None, names).first()
    assert long.tokens == 1_200_001 and len(long.bag) <= 64

    near, compared, seeds = mixing._nearness, [], []
    monkeypatch.setattr(mixing, "_nearness", lambda centres, units, first, at: (compared.append(len(first)), near(centres, units, first, at))[1])
    monkeypatch.setattr(mixing, "TOPIC_ROUNDS", 0)  # the seeds alone
    weights = mixing.learn_topics(slots).weights
    assert sum(compared) < 0.3 * len(texts) * (mixing.TOPICS - 1)

    counted = [np.unique(s, return_counts=True) for s in slots if len(s)]
    rarity = np.log((len(counted) + 1) / (np.bincount(np.concatenate([a for a, _ in counted]), minlength=mixing.TOPIC_SLOTS) + 1.0)) ** 2
    units = np.zeros((len(counted), mixing.TOPIC_SLOTS), np.float32)
    for u, (a, n) in zip(units, counted):
        u[a] = np.sqrt(n) * rarity[a] / np.linalg.norm(np.sqrt(n) * rarity[a])
    for k in range(mixing.TOPICS):
        drawn = [tb.mix((a * 2**40 + n).astype(np.uint64)).sum() + np.uint64(10_000 + k) for a, n in counted]
        times = -np.log1p(-(tb.mix(np.array(drawn)) >> np.uint64(11)).astype(float) / 2**53)
        far = 1 - (units @ units[seeds].T).max(1) if seeds else np.ones(len(units))
        seeds.append(int(np.divide(times, far, out=np.full(len(units), np.inf), where=far > 1e-5).argmin()))
    assert np.abs(weights - np.rint(units[seeds] * rarity * 4096)).max() <= 1


def test_quality_of_every_label(spark, monkeypatch):
    """Every labelled text is learned from, by shards whose weights do not depend on partitions."""
    texts = [(i, f"a{i} b{i}") for i in range(15_000)]
    docs, labels = docs_of(spark, texts), spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    predicted = quality.train_on(docs, labels).scores(pa.array([t for _, t in texts])) >= quality.THRESHOLD
    assert (predicted == np.arange(15_000) % 2).mean() > 0.97

    monkeypatch.setattr(quality, "SHARD_DOCS", 60)
    few = [*texts[:100], *((i, "both words " * (i % 7) + f"c{i % 5}") for i in range(100, 300)), (300, ""), (301, None)]
    docs = docs_of(spark, few)
    shards = dict(docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(6)), F.lit(6))).collect())
    total, evidence = np.zeros(quality.SLOTS + 1), np.zeros(quality.SLOTS + 1)
    for shard in set(shards.values()):
        mine = [(i, t) for i, t in few if shards[i] == shard]
        w, n = quality._descended([(*c, i % 2) for c, (i, _) in zip(quality.packed(pa.array([t for _, t in mine])), mine)], 6)
        total, evidence = total + w * n, evidence + n
    expected = np.divide(total, evidence, out=np.zeros_like(total), where=evidence > 0)
    models = [quality.train_on(docs.repartition(parts), labels) for parts in (1, 7)]
    assert (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias
    assert np.allclose(models[0].weights / quality.UNIT, expected[:-1], atol=1e-5) and models[0].bias == pytest.approx(expected[-1], abs=1e-5)
