"""Clustering, hard negatives and language codewords against plain restatements and on edge tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

VECTORS = "vec_id long, embedding array<float>, label int"


def lloyd(rows, k, rounds):
    """Every vector against every centroid, with Python's whole numbers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        at = nearest()
        for j in range(len(c)):
            own = [v for (_, v), (_, n) in zip(kept, at, strict=True) if n == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, j, d) for (i, _), (d, j) in zip(kept, nearest(), strict=True)], c


@pytest.mark.parametrize(("k", "rounds", "seed"), [(9, 4, 1), (40, 5, 2), (3, 3, 3), (1, 2, 4)])
def test_clusters_are_those_of_plain_rounds(spark, k, rounds, seed):
    from tesserae.llm import drake

    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 2, (6, 8))
    rows = [(i, (centers[i % 6] + rng.normal(0, 0.6, 8)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [(7, rows[9][1]), (7, rows[7][1])]  # copies, and an id three times
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS).repartition(3)
    seen = []
    got, c = drake.cluster(drake.whole(df, dim=8), k, rounds, dim=8, on_round=lambda *x: seen.append(x))
    want, centroids = lloyd(rows, k, rounds)
    assert c.tolist() == centroids
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got.collect()) == sorted(want)
    assert len(seen) == rounds and all(a[0] >= b[0] for a, b in zip(seen, seen[1:], strict=False))  # bounds only get fewer


def test_bounds_rule_out_centroids():
    """Once centroids settle, few vectors are compared with all of them; every assignment stays the nearest."""
    from tesserae.llm import drake

    rng = np.random.default_rng(3)
    c = rng.integers(-400, 400, (40, 16))
    v = (c[rng.integers(0, 40, 2000)] + rng.integers(-60, 60, (2000, 16))).astype(np.int32)
    s = drake.Bounds.fresh(v, c, 10)
    full = 0
    for step in range(6):
        new = c + rng.integers(-6 // (step + 1), 7, c.shape)
        need = s.advance(v, new, np.sqrt(((new - c) ** 2).sum(1)))
        c = new
        full += int((need > s.near.shape[1]).sum())
        assert (s.own == drake.squares(v, c).argmin(1)).all()
        if step == 2:
            s.shrink(5)
    assert full < 600


def test_far_vectors_are_measured_in_whole_numbers():
    from tesserae.llm import drake

    v = np.array([[1 << 27, -(1 << 27)], [3, 4]], dtype=np.int32)
    c = np.array([[-(1 << 27), 1 << 27], [0, 0]])
    assert drake.squares(v, c).tolist() == [[2 * (1 << 28) ** 2, 2 * (1 << 27) ** 2], [(3 + (1 << 27)) ** 2 + (4 - (1 << 27)) ** 2, 25]]


def test_cluster_edges(spark):
    from tesserae.llm import drake

    assert drake.digest(*drake.cluster(drake.whole(spark.createDataFrame([], VECTORS)), 40, 5)).count() == 0
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [0.0, 0.0]), (8, [3e9, 0.0]), (9, [-0.001, 5.0])]
    df = spark.createDataFrame([(*r, None) for r in rows], VECTORS).selectExpr("*", "'x' AS v", "1 AS cluster", "'y' AS near", "2 AS before", "'z' AS c")
    assigned, c = drake.cluster(drake.whole(df, dim=2), 40, 5, dim=2)
    got = drake.digest(assigned, c).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 1), (False, 1), (False, 9), (True, 0)]
    assert all(r.distance == 0 == r.inertia for r in got) and len(c) == 4
    nine = next(r for r in got if r.vec_id == 9)
    assert nine.centroid_sha256 == hashlib.sha256(b"-1,1280").hexdigest()  # floor, not truncation
    assert len({r.cluster for r in got if r.vec_id == 1}) == 1  # equal centroids: the smaller number


def mined(rows, anchor=lambda i: i % 10 == 0, n_pos=5, n_neg=10):
    one = {}
    for i, lab, v in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * x) for x in v]
        one[i] = min(one.get(i, (w, lab)), (w, lab))
    out = []
    for a, (v, lab) in one.items():
        if not anchor(a):
            continue
        s = {b: (sum(x * y for x, y in zip(v, w, strict=True)), own) for b, (w, own) in one.items() if b != a and len(w) == len(v)}
        order = sorted(s, key=lambda b: (-s[b][0], b))
        for p in [b for b in order if s[b][1] == lab][:n_pos]:
            fit = [b for b in order if s[b][1] != lab and 30 * s[p][0] <= 100 * s[b][0] <= 90 * s[p][0]][:n_neg]
            out += [(a, p, k + 1, b, s[p][0], s[b][0]) for k, b in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("per_pivot", [8192, 20])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, per_pivot):
    from tesserae.llm import idistance

    rng = np.random.default_rng(8)
    centers = rng.normal(0, 1, (5, 6))
    rows = [(i - 60, int(rng.integers(0, 4)), np.round(centers[i % 5] * rng.choice([0.5, 1, 2]) + rng.normal(0, 0.3, 6), 2).astype(np.float32).tolist()) for i in range(260)]
    rows += [(400 + i, 1, rows[0][2]) for i in range(60)]  # one vector very often: ties go to the smaller id
    rows += [(1000 + i, 2 + i % 2, [0.5 * i, 1.0]) for i in range(12)] + [(2000, 1, [0.0] * 6), (2010, 3, []), (2011, 2, [])]
    rows += [(3000, 5, rows[3][2]), (3001, 5, rows[4][2])]  # a label with fewer rows than positives
    rows += [(-60, 0, rows[2][2])]  # an id twice
    monkeypatch.setattr(idistance, "BYTES", 64 * 48)
    made = idistance.index
    monkeypatch.setattr(idistance, "index", lambda v: made(v, per_pivot))
    df = spark.createDataFrame([(i, v, lab) for i, lab, v in rows], VECTORS)
    vectors = idistance.whole(df)
    got = idistance.hard_negatives(vectors, vectors.filter("vec_id % 10 = 0").select("vec_id"))
    want = mined(rows)
    assert len(want) > 200
    assert sorted(tuple(r) for r in got.collect()) == want


def test_key_intervals_rule_blocks_out(spark):
    """Near queries of clustered vectors look at a part of the blocks, and still find the nearest."""
    from tesserae.llm import idistance

    rng = np.random.default_rng(2)
    dist = np.sort(rng.random(500)) * 10
    block = {"ids": np.arange(500), "labels": np.zeros(500, dtype=np.int64), "dist": dist, "v": rng.integers(-50, 50, (500, 4))}
    q = rng.integers(-50, 50, (3, 4))
    lo, hi = np.array([2.0, 0.0, 9.0]), np.array([3.0, 10.0, 8.0])  # the last interval is empty
    a, row, score = idistance.best_in_block(block, np.array([-1, -2, -3]), np.zeros(3, dtype=np.int64), q, np.array([0, 1, 2]), np.full(3, -idistance.FAR), np.full(3, idistance.FAR), True, 4, (lo, hi))
    for i in range(3):
        inside = [(-int(q[i] @ block["v"][j]), j) for j in range(500) if lo[i] <= dist[j] <= hi[i]]
        assert [(-s, r) for s, r in zip(score[a == i].tolist(), row[a == i].tolist(), strict=True)] == sorted(inside)[:4]


def test_hard_negative_edges(spark):
    from tesserae.llm import idistance

    empty = idistance.whole(spark.createDataFrame([], VECTORS))
    assert idistance.hard_negatives(empty, empty.select("vec_id")).count() == 0
    nan = float("nan")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.5]), (3, None, [0.6, 0.0]), (4, 2, None), (5, 2, [nan, 1.0]), (6, 2, [None, 1.0]), (None, 2, [0.5, 0.1]), (7, 2, [1e30, 0.0]), (10, 1, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, lab) for i, lab, v in rows], VECTORS).selectExpr("*", "'x' AS slot", "1 AS block", "'y' AS v", "2 AS pivot", "3 AS dim", "4 AS score")
    vectors = idistance.whole(df)
    got = idistance.hard_negatives(vectors, vectors.filter("vec_id % 10 = 0").select("vec_id")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 32768)]  # scores under zero leave nothing between


LANGS = {"xa": "abcde", "xb": "efghi", "xc": "ijklm", "xd": "mnopé"}


def speak(r, lang, n):
    return " ".join("".join(r.choice(LANGS[lang]) for _ in range(r.randint(2, 7))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    from tesserae.llm import ecoc_lang

    r = random.Random(4)
    rows = [(i, speak(r, lang, r.randint(1, 60)), lang) for i in range(600) for lang in [r.choice(list(LANGS))]]
    rows[5] = (5, "9 + 9 = 18 !!", "xa")
    rows[6] = (6, None, "xb")
    wrong = [(i, t, lang if zlib.crc32(str(i).encode()) % 3 != 1 else "zz") for i, t, lang in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ecoc_lang.train(df)
    got = {x.doc_id: x for x in ecoc_lang.predict(df, model).collect()}
    assert len(got) == 600
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items())
    assert (got[5].lang_pred, got[5].score, got[6].lang_pred) == ("und", 0.0, "und")
    held = [(got[i], lang) for i, t, lang in rows if got[i].held_out and got[i].lang_pred != "und"]
    assert sum(x.lang_pred == lang for x, lang in held) >= 0.97 * len(held)
    sure = [x.lang_pred == lang for x, lang in held if x.score >= 0.9]
    assert len(sure) > 0.7 * len(held) and np.mean(sure) >= 0.98
    assert all(x.score < 0.76 for x, _ in held if x.ambiguous)
    again = ecoc_lang.train(spark.createDataFrame(wrong, "doc_id long, text string, lang string").repartition(5))  # labels of held-out rows are not seen, nor is the order of rows
    assert model["names"] == again["names"] and (model["w"] == again["w"]).all() and (model["slope"] == again["slope"]).all()


def plain_grams(text):
    """A text's n-grams one by one."""
    low = "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in f" {text.lower()} ").encode()
    while b"  " in low:
        low = low.replace(b"  ", b" ")
    return Counter(low[i : i + n] for n in (2, 3, 4) for i in range(len(low) - n + 1))


def test_grams_counts_and_decoding_restated(spark):
    from tesserae.llm import ecoc_lang as e

    texts = ["Ab-cD 12 é!", "", "x", "ßß ÇA  ça", "end"]
    lower = [t.lower().encode() for t in texts]
    found = e.grams(lower)
    for i, t in enumerate(texts):
        assert sum(int((o == i).sum()) for o, _ in found) == sum(plain_grams(t).values())
        alone = sorted(b for _, x in e.grams([lower[i]]) for b in x.tolist())
        assert alone == sorted(b for o, x in found for b in x[o == i].tolist())  # no n-gram crosses texts
    row, bucket, share = e.shares(lower)
    for i, t in enumerate(texts):
        want, total = Counter(), sum(plain_grams(t).values())
        for g, n in plain_grams(t).items():
            own = e.grams([g.strip()])
            want[next(int(b) for k, (o, x) in enumerate(own) if k == len(g) - 2 for b, at in zip(x, _grams_of(g.strip()), strict=False) if at[k] == g)] += n
        assert {int(b): int(s) for r, b, s in zip(row, bucket, share, strict=True) if r == i} == {b: n * e.SHARE // total for b, n in want.items()}
    code = e.codewords(4)
    assert code.shape == (4, 7) and all(len({*map(tuple, e.codewords(n))}) == n for n in (2, 3, 5, 6, 13, 40))
    assert min(int((code[a] != code[b]).sum()) for a in range(4) for b in range(a)) == 4
    margins = np.random.default_rng(1).normal(0, 2, (50, 7))
    best, score, other, gap = e.decode(margins, code)
    for m, b, s, o, g in zip(margins, best, score, other, gap, strict=True):
        loss = [sum(math.log1p(math.exp(-x * y)) for x, y in zip(m, c, strict=True)) for c in code.tolist()]
        order = sorted(range(4), key=lambda k: loss[k])
        assert (b, o) == (order[0], order[1]) and s == pytest.approx(math.exp(-loss[b]) / sum(math.exp(-x) for x in loss)) and g == pytest.approx(loss[o] - loss[b])


def _grams_of(word):
    """For each start the 2-, 3- and 4-gram of a word between spaces."""
    low = b" " + word + b" "
    return [[low[i : i + n] for n in (2, 3, 4)] for i in range(len(low))]


def test_language_edges(spark):
    from tesserae.llm import ecoc_lang

    schema = "doc_id long, text string, lang string"
    empty = spark.createDataFrame([], schema)
    assert ecoc_lang.predict(empty, ecoc_lang.train(empty)).count() == 0
    long_ = "lorem ipsum dolor " * 120_000  # 2 MB
    rows = [(None, "abc abd", "xa"), (2, None, "xa"), (2, "", None), (3, "123", "xb"), (4, long_, "xb"), (4, long_, "xb"), (6, "abc", None)]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS lettered", "1 AS score", "'y' AS x", "'z' AS n", "2 AS bucket")
    got = ecoc_lang.predict(df, ecoc_lang.train(df)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in got if r.doc_id in (2, 3)] == ["und"] * 3
    none = ecoc_lang.predict(df, ecoc_lang.train(df.withColumn("lang", df.lang.substr(9, 0).cast("string")).filter("false"))).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in none)
    single = ecoc_lang.predict(df, ecoc_lang.train(df.filter("lang = 'xa' and text is not null"))).collect()
    assert all((r.lang_pred, r.score) in (("xa", 1.0), ("und", 0.0)) for r in single) and any(r.lang_pred == "xa" for r in single)


def test_words_that_a_polynomial_confuses(spark):
    """Thue-Morse words collide under every polynomial modulo 2**64; documents of them share no shingle."""
    from tesserae.llm import hyperminhash, shingles

    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join(word + str(i) for i in range(9))), (2, " ".join(other + str(i) for i in range(9))), (3, word), (4, other), (5, word[:128] + " x"), (6, other[:128] + " x")]
    got = {r.doc_id: (r.component_id, r.kept) for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i, True) for i in range(1, 7)}
    words = [bytes([x]) * n for x in (97, 98) for n in range(1, 600, 7)] + [word[:k].encode() for k in (2, 63, 64, 65, 255, 256, 257, 1024)] + [other[:k].encode() for k in (64, 256, 1024)]
    for family in (0, 1):
        data = np.frombuffer(b" ".join(words), dtype=np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        h = shingles.word_hashes(data, ends - [len(w) for w in words], ends, family)
        assert len(set(h.tolist())) == len(set(words))
        assert h[0] == shingles.word_hashes(np.frombuffer(b"xx a", dtype=np.uint8), np.array([3]), np.array([4]), family)[0]  # not where it stands, nor what is around it


def test_long_texts_of_a_bucket_are_bounded_by_bytes(spark, monkeypatch):
    from tesserae.llm import hyperminhash

    r = random.Random(6)
    base = [str(r.randint(0, 10**6)) for _ in range(4000)]
    rows = [(i, " ".join(base[: 3000 + 10 * i])) for i in range(12)]
    monkeypatch.setattr(hyperminhash, "CHUNK_BYTES", 40_000)
    links = hyperminhash._within(
        spark.createDataFrame([(1, i, i) for i in range(12)], "band long, node long, label long"), spark.createDataFrame(rows, "node long, text string"), 85, 100
    ).collect()
    seen = {i: i for i in range(12)}
    for a, b in links:
        seen = {k: min(seen[a], seen[b]) if v in (seen[a], seen[b]) else v for k, v in seen.items()}
    assert set(seen.values()) == {0}
