"""Frames and vectors in blocks, readers that keep rejects, the ledger, the generation loop, quantiles, the vote stream, classifiers."""

import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import arrays as A
from tesserae.functions import perm as P
from tesserae.operators import classify, frames, image, metrics, vectors, votes
from tesserae.sources import checked, generate, tables
from tesserae.sources.ledger import Ledger


def png(path, px):
    """Write (height, width, 3) bytes as a PNG."""
    h, w, _ = px.shape
    raw = np.concatenate((np.zeros((h, 1), np.uint8), px.reshape(h, -1)), 1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 1)) + part(b"IEND", b""))


# ---- frames ----------------------------------------------------------------------------------


def plain_measures(g):
    h, w = g.shape
    bins = np.minimum(np.floor(g.ravel().astype(float) * 64 / 255.0), 63).astype(int)
    share = np.bincount(bins)[np.bincount(bins) > 0] / g.size
    bright = g.mean(1) >= 8
    ends = []
    for b in (bright, bright[::-1]):
        n = 0
        while n < h and not b[n]:
            n += 1
        ends.append(min(n, h // 3))
    return float(g.astype(float).std()), abs(float(-(share * np.log2(share)).sum())), *ends


def test_one_pass_over_a_frame(spark, monkeypatch):
    rng = np.random.default_rng(1)
    noise = rng.integers(60, 256, (120, 160)).astype(np.uint8)
    boxed = noise.copy()
    boxed[:20], boxed[-15:] = 0, 3
    near = np.clip(noise.astype(int) + 5, 0, 255).astype(np.uint8)
    some = {"noise": noise, "boxed": boxed, "near": near, "black": np.zeros((40, 30), np.uint8), "flat": np.full((9, 7), 200, np.uint8), "tiny": np.array([[0, 255]], np.uint8), "other": rng.integers(0, 256, (333, 77)).astype(np.uint8)}
    monkeypatch.setattr(frames, "STRIP", 1000)  # many strips
    local = {n: frames.measures(g) for n, g in some.items()}
    for n, g in some.items():
        assert local[n][:4] == pytest.approx(plain_measures(g), abs=1e-9)
    assert local["flat"][0] == 0.0 == local["flat"][1] and local["black"][2:4] == (13, 13)
    dist = lambda a, b: bin((local[a][4] ^ local[b][4]) & (2**64 - 1)).count("1")
    assert dist("noise", "near") <= 6 < dist("noise", "other")
    assert bin((local["noise"][4] ^ image.phash_array(noise)) & (2**64 - 1)).count("1") <= 2  # the same hash by another sum
    rows = [(n, g.shape[1], g.shape[0], bytearray(g.tobytes()), 1) for n, g in some.items()] + [("null", None, None, None, 2), ("empty", 0, 0, bytearray(), 3)]
    df = spark.createDataFrame(rows, "id string, width int, height int, gray binary, std_ int")
    got = {r.id: r for r in frames.features(df).collect()}
    assert len(got) == len(rows) and got["null"].std is None and got["empty"].phash is None and got["null"].low_info is None
    for n in some:
        assert (got[n].std, got[n].entropy, got[n].top, got[n].bottom, got[n].phash) == pytest.approx(frames.measures(some[n]))
    assert got["flat"].low_info and not got["noise"].low_info
    assert frames.features(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="no frame of"):
        frames.features(spark.createDataFrame([("x", 3, 3, bytearray(8))], "id string, width int, height int, gray binary")).collect()


def test_scaled_is_the_area_mean(monkeypatch):
    rng = np.random.default_rng(2)
    px = rng.integers(0, 256, (61, 83, 3)).astype(np.uint8)
    monkeypatch.setattr(frames, "STRIP", 83 * 3 * 7)
    want = np.stack([image.area_means(px[:, :, c].astype(float), 17, 23) for c in range(3)], 2)
    assert np.abs(frames.scaled(px, 17, 23).astype(float) - want).max() <= 0.51
    assert (frames.luma(px[:, :, ::-1]) == np.rint(px @ np.array([0.299, 0.587, 0.114]))).mean() > 0.98


def test_frames_large_broken_and_undecodable(spark, tmp_path):
    rng = np.random.default_rng(3)
    big = np.repeat(np.repeat(rng.integers(0, 256, (80, 100, 3)).astype(np.uint8), 50, 0), 50, 1)  # 4000 x 5000: 20 megapixels
    small = np.full((12, 6, 3), (200, 100, 50), np.uint8)
    small[:2] = small[-2:] = 0
    (tmp_path / "in").mkdir()
    png(tmp_path / "in/big.png", big)
    png(tmp_path / "in/small.png", small)
    (tmp_path / "in/broken.png").write_bytes((tmp_path / "in/small.png").read_bytes()[:40])
    (tmp_path / "in/text.png").write_bytes(b"not an image")
    good, bad = checked.read_frames(spark, str(tmp_path / "in"), gray=False, crop=True, most=0.5)
    by = {r.path.rsplit("/", 1)[1]: r for r in good.collect()}
    assert sorted(by) == ["big.png", "small.png"] and (by["small.png"].width, by["small.png"].height) == (6, 8) and by["small.png"].pixels == bytes((200, 100, 50)) * 48
    assert by["big.png"].width * by["big.png"].height <= 250_880 and len(by["big.png"].pixels) == 3 * by["big.png"].width * by["big.png"].height
    assert sorted(r.source.rsplit("/", 1)[1] for r in bad.collect()) == ["broken.png", "text.png"] and all(r.reason for r in bad.collect())
    with pytest.raises(ValueError, match="2 of 4"):
        checked.read_frames(spark, str(tmp_path / "in"))

    def own(data):  # a format of the caller's: width, then gray bytes
        if data[:1] == b"n":
            raise OSError("unknown format")
        return np.frombuffer(data[1:], np.uint8).reshape(-1, data[0])

    (tmp_path / "own").mkdir()
    (tmp_path / "own/a.raw").write_bytes(bytes([4]) + bytes(range(12)))
    (tmp_path / "own/b.raw").write_bytes(b"no")
    (tmp_path / "own/c.raw").write_bytes(bytes([5]) + bytes(7))
    good, bad = checked.read_frames(spark, str(tmp_path / "own"), decode=own, most=0.9)
    assert [(r.width, r.height, bytes(r.pixels)) for r in good.collect()] == [(4, 3, bytes(range(12)))]
    assert sorted(r.reason.split(":")[0] for r in bad.collect()) == ["OSError", "ValueError"]
    stats = frames.features(good.withColumnRenamed("pixels", "gray")).first()
    assert (stats.width, stats.height) == (4, 3) and stats.std == pytest.approx(np.arange(12).std())


# ---- vectors ---------------------------------------------------------------------------------


@pytest.mark.parametrize("dim", [5, 768])
def test_vector_kernels_are_the_expressions(spark, monkeypatch, dim):
    rng = np.random.default_rng(dim)
    names = [f"e{i}" for i in range(8)]
    rows = [(i, *[rng.normal(0, 1, dim).astype(np.float32).tolist() for _ in names]) for i in range(23)]
    rows[3] = (3, *[rows[3][1]] * 8)  # all equal: ties
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} array<float>" for n in names))
    monkeypatch.setattr(vectors, "CELLS", 8 * dim * 4)
    fr, ev = [F.col(n) for n in names[:4]], [F.col(n) for n in names[4:7]]
    got = {r.id: r for r in vectors.semantic_features(df, names[:4], names[4:7], "e7").collect()}
    m, ff = [A.event_match(f, ev) for f in fr], A.frame_similarity(fr)
    fc = [A.dot(f, F.col("e7")) for f in fr]
    want = df.select("id", ff["ff_max"], ff["ff_mean"], ff["ff_min"], A.collision([x[0] for x in m], 3), F.least(*[x[1] for x in m]), A.mean([x[2] for x in m]), F.least(*fc), A.mean(fc))
    for r in want.collect():
        assert tuple(got[r[0]])[1:] == pytest.approx(tuple(r)[1:], rel=1e-9, abs=1e-9)
    per = {(r.id, r.frame): r for r in vectors.embedding_scalars(df, names[:4], names[4:7]).collect()}
    assert len(per) == 23 * 4
    for i in range(4):
        for r in df.select("id", *A.per_frame_similarity(fr, i), *A.event_match(fr[i], ev)[1:]).collect():
            assert tuple(per[(r[0], i)])[2:] == pytest.approx(tuple(r)[1:], rel=1e-9, abs=1e-9)
    unit = {r.id: r.e0 for r in vectors.unit_vectors(df, "e0").collect()}
    assert all(math.isclose(sum(x * x for x in u), 1) for u in unit.values())


def test_vector_edges(spark):
    names = [f"e{i}" for i in range(6)]
    schema = "id long, " + ", ".join(f"{n} array<double>" for n in names)
    rows = [(1, [1.0, 0.0], None, [0.0, None], [0.0, 0.0], [1.0, 0.0], [1.0, 1.0]), (2, *[None] * 6), (3, *[[1.0, 2.0, 2.0]] * 6), (4, *[[]] * 6)]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: r for r in vectors.semantic_features(df, names[:4], names[4:5], "e5").collect()}
    assert got[2].ff_max_sim is None and got[1].ff_max_sim == 0 and got[1].fe_collision == 4 and got[1].fe_mean_margin == 0 and got[3].ff_min_sim == 9 and got[4].fc_min_sim == 0
    assert vectors.semantic_features(df.limit(0), names[:4], names[4:5], "e5").count() == 0
    unit = {r.id: r.e0 for r in vectors.unit_vectors(df, "e0").collect()}
    assert unit[1] == [1.0, 0.0] and unit[2] is None and unit[3] == pytest.approx([1 / 3, 2 / 3, 2 / 3]) and unit[4] == []
    with pytest.raises(Exception, match="differ in length"):
        vectors.unit_vectors(spark.createDataFrame([(1, [1.0], [1.0, 2.0], [0.0], [0.0], [0.0], [0.0])], schema), "e0").unionByName(vectors.semantic_features(spark.createDataFrame([(1, [1.0], [1.0, 2.0], [0.0], [0.0], [0.0], [0.0])], schema), names[:4], names[4:5], "e5").select("id", F.array(F.col("ff_max_sim")).alias("e0"))).collect()


# ---- rejects, ledger, generation ----------------------------------------------------------------


def test_good_and_rejected_add_up(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"Id": "a", "n": 1}\nbroken\n\n{"Id": "b", "n": "x"}\n{"Id": "c"}\n')
    (tmp_path / "b.csv").write_text("Id,n\na,1\nb,zz\nc,3,4,5\n")
    good, bad = checked.read_checked(spark, str(tmp_path / "a.jsonl"), "Id string, n int", most=0.5)
    assert sorted(r.Id for r in good.collect()) == ["a", "c"] and good.columns == ["Id", "n"]
    assert sorted(r.record for r in bad.collect()) == ["broken", '{"Id": "b", "n": "x"}'] and all(r.source.endswith("a.jsonl") for r in bad.collect())
    good, bad = checked.read_checked(spark, str(tmp_path / "b.csv"), "Id string, n int", kind="csv", most=0.9)
    assert [r.Id for r in good.collect()] == ["a"] and bad.count() == 2
    with pytest.raises(ValueError, match="2 of 4"):
        checked.read_checked(spark, str(tmp_path / "a.jsonl"), "Id string, n int", most=0.4)


def test_a_stopped_batch_does_not_exist(spark, tmp_path, monkeypatch):
    schema = "id string, perm array<int>, text string"
    book = Ledger(spark, str(tmp_path / "votes"), schema)
    jobs = spark.createDataFrame([(f"s{i}", [0, 1, 2, 3]) for i in range(10)], "id string, perm array<int>")
    done = lambda df: df.withColumn("text", F.concat(F.lit("vote "), "id"))
    assert book.rows().count() == 0 and book.pending(jobs, ["id", "perm"]).count() == 10
    assert book.append(done(jobs.filter("id < 's3'")), "r1", 0) == 3

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # the data is written, the manifest is not
        m.setattr(book, "_list", killed)
        with pytest.raises(KeyboardInterrupt):
            book.append(done(book.pending(jobs, ["id", "perm"]).filter("id < 's6'")), "r1", 1)
    again = Ledger(spark, str(tmp_path / "votes"), schema)
    assert again.rows().count() == 3 and again.pending(jobs, ["id", "perm"]).count() == 7
    assert again.append(done(again.pending(jobs, ["id", "perm"])), "r1", 1) == 7
    assert again.append(done(jobs), "r1", 1) == 0  # listed already
    rows = again.rows().collect()
    assert sorted((r.id, tuple(r.perm)) for r in rows) == [(f"s{i}", (0, 1, 2, 3)) for i in range(10)]
    assert again.pending(jobs, ["id", "perm"]).count() == 0 and '"n": 7' in again.describe()


def test_generation_asks_once_and_tries_again(spark, tmp_path):
    rows = [(i, "system", f"prompt {i % 20}") for i in range(60)] + [(99, "system", "never"), (100, None, "x"), (101, "", "x")]
    prompts = spark.createDataFrame(rows, "id long, system string, user string")
    log = tmp_path / "log"
    log.mkdir()

    def transport(system, user):
        """Every third call fails, one prompt always, one gives what the check refuses at first; calls leave a file each."""
        n = len(list(log.iterdir()))
        (log / f"{n}-{random.random()}").write_text(user)
        seen = sum(p.read_text() == user for p in log.iterdir())
        if user == "never" or (user.startswith("prompt") and int(user.split()[1]) % 3 == 0 and seen == 1):
            raise TimeoutError(user)
        return "" if user == "prompt 1" and seen == 1 else f"reply to {user}"

    book = Ledger(spark, str(tmp_path / "replies"), generate.REPLIES)
    out, failed = generate.generate(prompts, transport, book, "r1", chunk=8, tries=3, pause=0.01, accept=lambda r: len(r) > 0)
    got = {r.id: r.reply for r in out.collect()}
    assert len(got) == 63 and got[99] is None and all(got[i] == f"reply to prompt {i % 20}" for i in range(60)) and got[100] == got[101] == "reply to x"
    assert [r.error for r in failed.collect()] == ["TimeoutError: never"]
    calls = [p.read_text() for p in log.iterdir()]
    assert len(calls) == 22 + 7 + 1 + 2  # distinct prompts, first failures, the refused one, two more tries of the last
    out, failed = generate.generate(prompts, transport, Ledger(spark, str(tmp_path / "replies"), generate.REPLIES), "r2", tries=1)
    assert {r.id: r.reply for r in out.collect()} == got and failed.count() == 1
    assert len(list(log.iterdir())) == len(calls) + 1  # only what has no reply is asked again
    nothing, failed = generate.generate(prompts.limit(0), transport, book, "r3")
    assert nothing.count() == 0 and failed.count() == 0


# ---- quantiles, stream, classifiers ----------------------------------------------------------------


@pytest.mark.parametrize("few", [10_000, 8])
def test_quartiles_without_a_buffer(spark, few):
    r = random.Random(few)
    for values in ([r.gauss(0, 1) for _ in range(5000)], [float(r.randint(0, 5)) for _ in range(3000)], [2.5], [1.0, 4.0], [7.0] * 50 + [None] * 9, [], [None]):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
        have = sorted(v for v in values if v is not None)
        places = sorted({0, len(have) // 4, len(have) // 2, len(have) - 1}) if have else []
        assert metrics.order_statistics(df, "x", places, few=few, accuracy=100) == {k: have[k] for k in places}
        got, want = metrics.summary(df, "x").first(), df.agg(F.percentile("x", 0.25), F.percentile("x", 0.5), F.percentile("x", 0.75)).first()
        assert (got.p25, got.p50, got.p75) == pytest.approx(tuple(want)) if have else got.p25 is None
        assert got["count"] == len(have) and got.min == (have[0] if have else None)


def test_stream_state_is_a_row_a_sample(spark, tmp_path):
    from tesserae.streaming.vote_stream import decide_stream, read_votes

    r = random.Random(2)
    perms = [list(p) for p in itertools.permutations(range(4))][:6]
    rows = [(f"s{i}", p, r.choice(["[2, 1, 3, 4]", "[1, 2, 3, 4]", "garbage", "UNORDERABLE [1, 2, 3, 4]"])) for i in range(8) for p in perms]
    rows += [("odd", [0, 0, 1, 2], "[1, 2, 3, 4]"), ("odd", None, "[1, 2, 3, 4]")]
    path = str(tmp_path / "in")
    for part in (rows[:20], rows[20:], rows[5:40], rows):  # delivered again and again
        spark.createDataFrame(part, tables.VOTE).coalesce(1).write.mode("append").json(path)
    out = {}
    q = decide_stream(read_votes(spark, path, files_per_batch=1), str(tmp_path / "ck"), lambda df, n: out.update({x.id: x for x in df.collect()}))
    q.awaitTermination()
    want = {x.id: x for x in votes.decide(votes.tally(votes.parse_votes(spark.createDataFrame(rows[:-2], tables.VOTE).withColumnRenamed("Id", "id")))).collect()}
    assert out.keys() == want.keys() and all((out[k]["rank"], out[k].reason, out[k].n_votes, list(out[k].counts)) == (want[k]["rank"], want[k].reason, want[k].n_votes, list(want[k].counts)) for k in want)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) == 8


def test_cross_validation_by_hand(spark):
    """Folds hold every row once; a feature that gives the label away has AUC 1, one that says nothing about a half."""
    r = random.Random(7)
    rows = [(i, r.random() < 0.4, r.random()) for i in range(300)]
    df = spark.createDataFrame([(i, int(y), 3.0 * y + 0.1 * z, z) for i, y, z in rows], "id long, label int, told double, noise double")
    told, noise = ({x.fold: (x.auc, x.f1) for x in classify.cross_validate(df, [c]).collect()} for c in ("told", "noise"))
    assert len(told) == 5 and all(a == pytest.approx(1.0) for a, _ in told.values()) and all(f == pytest.approx(1.0) for _, f in told.values())
    assert 0.35 < np.mean([a for a, _ in noise.values()]) < 0.65
    flipped = classify.cross_validate(df.withColumn("told", -F.col("told")), ["told"], kind="trees").collect()
    assert all(x.auc > 0.99 for x in flipped)  # trees split between bins of a column


def test_rank_constants(spark):
    got = spark.range(26).select(P.rank_at(F.col("id")).alias("r"), P.index_of(P.rank_at(F.col("id"))).alias("i")).collect()
    assert [r.r for r in got[:24]] == P.PERMS and [r.i for r in got[:24]] == list(range(24)) and got[24].r is None


def test_frames_of_one_size_are_measured_together():
    rng = np.random.default_rng(4)
    some = rng.integers(0, 256, (50, 24, 32)).astype(np.uint8)
    some[3], some[4], some[5, :9], some[6, -4:] = 0, 200, 2, 7
    got = list(zip(*frames.many(some), [frames.hashed(g) for g in some], strict=True))
    for g, x in zip(some, got, strict=True):
        want = frames.measures(g)
        assert x[2:] == want[2:] and x[:2] == pytest.approx(want[:2], abs=1e-12)


@pytest.mark.parametrize("name", ["frames", "captions"])
def test_rows_of_one_small_file_go_to_every_core(spark, name):
    from tesserae.plans import fixtures

    df = getattr(fixtures, name)(spark, "/root/testdata/sf0.01")
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


def test_noise_policy_measures_frames_once(spark, monkeypatch):
    from tesserae.plans import catalogue

    calls, plain = [], catalogue.fx.frames

    def counted(s, d):
        n = s.sparkContext.accumulator(0)
        calls.append(n)

        def run(batches):
            for b in batches:
                n.add(b.num_rows)
                yield b

        x = plain(s, d)
        return x.mapInArrow(run, x.schema)

    monkeypatch.setattr(catalogue.fx, "frames", counted)
    got = {r.policy: (r.n, r.weight) for r in catalogue.QUERIES["noise_policy"](spark, "/root/testdata/sf0.001").collect()}
    total = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert got["c"] == (total, float(total)) and got["b"][0] == total and sum(n.value for n in calls) == total
