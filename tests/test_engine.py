"""The engine's functions and operators on literal cases."""

import itertools

import pytest
from pyspark.sql import functions as F

from tesserae.functions import arrays as A
from tesserae.functions import perm as P
from tesserae.functions import text as X
from tesserae.operators import calibrate, hardcases, image, loglik, metrics, similarity, votes
from tesserae.sources import tables

IDENT = [1, 2, 3, 4]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_permutations(spark):
    dim = P.perm_dim(spark)
    rows = dim.select("rank", P.invert(P.invert(F.col("rank"))).alias("back"), P.parse_last(F.concat(F.lit("x [9] "), "key")).alias("parsed"), P.index_of(F.col("rank")).alias("i"), "idx").collect()
    assert [r["rank"] for r in rows] == [list(p) for p in itertools.permutations(IDENT)]
    assert all(r.back == r["rank"] == r.parsed and r.i == r.idx for r in rows)
    v = spark.createDataFrame([(list(p), list(q)) for p in itertools.permutations(IDENT) for q in itertools.permutations(range(4))], "r array<int>, p array<int>")
    s = v.select("r", "p", P.shuffle(F.col("r"), F.col("p")).alias("s")).select("r", "s", "p", P.unshuffle(F.col("s"), F.col("p")).alias("b")).collect()
    assert all(x.b == x.r and x.s == [x.r[j] for j in x.p] for x in s)


@pytest.mark.parametrize(("text", "want"), [("[1, 2, 3, 4] then [3, 1, 2, 4]", [3, 1, 2, 4]), ("[3, 1, 2, 4] then [1, 1, 2, 3]", [3, 1, 2, 4]), ("[1, 2, 3]", None), ("", None), (None, None), ("[2,1,4,3]", [2, 1, 4, 3]), ("[1, 'a', 2, 3]", None), ("[ 4 ,3,2,1, ]", [4, 3, 2, 1])])
def test_parse(spark, text, want):
    assert one(spark, P.parse_last(F.lit(text).cast("string")).alias("x")).x == want


def test_parse_variants_of_failure(spark):
    assert one(spark, P.parse_outermost(F.lit("a [2, 3, 4, 1] b")).alias("x")).x == [4, 1, 2, 3]
    assert one(spark, P.parse_outermost(F.lit("[1] [2, 3, 4, 1]")).alias("x")).x == IDENT
    with pytest.raises(Exception, match="not a permutation"):
        one(spark, P.parse_answer(F.lit("nope")).alias("x"))


def test_views():
    assert P.views(8)[:4] == P.views(4) and P.views(1) == [[0, 1, 2, 3]] and len({tuple(p) for p in P.views(24)}) == 24
    with pytest.raises(ValueError, match="between"):
        P.views(25)


def test_augment_never_gives_identity(spark):
    dim = P.perm_dim(spark).crossJoin(spark.range(50).withColumnRenamed("id", "draw"))
    perm, rank = P.augment(F.col("rank"), F.lit(False), F.col("draw"))
    got = dim.select("rank", perm.alias("p"), rank.alias("n")).collect()
    assert all(r.n != IDENT and r.n == [r["rank"][j] for j in r.p] for r in got)


@pytest.mark.parametrize(("caption", "events"), [
    ("A man runs then jumps.", ["A man runs", "jumps"]), ("He sits followed by a nap, and finally wakes", ["He sits", "a nap", "wakes"]), ("A dog barks before it eats", ["A dog barks", "it eats"]),
    ("He eats after cooking", ["cooking", "He eats"]), ("After cooking, he eats, then sleeps.", ["cooking", "he eats", "sleeps"]), ("Before he eats, he cooks.", ["he cooks", "he eats"]), ("He sings as she dances", ["He sings as she dances"]),
    ("", []), (None, []), ("  ", []), ("One; two, next, three", ["One", "two", "three"]),
])
def test_events(spark, caption, events):
    assert one(spark, X.split_events(F.lit(caption).cast("string")).alias("x")).x == events


def test_variants_split_back(spark):
    df = spark.createDataFrame([("A cat sits, then it jumps, then it sleeps.",), ("single clause.",), ("a then b",)], "c string").withColumn("e", X.split_events(F.col("c")))
    rows = df.select("c", "e", X.caption_variants(F.col("c"), F.col("e")).alias("v")).collect()
    assert rows[0].v[0] == "A cat sits, followed by it jumps, followed by it sleeps." and rows[1].v == [] and rows[2].v[0] == "a, then b."
    back = df.select("e", F.explode(X.caption_variants(F.col("c"), F.col("e"))).alias("v")).select("e", X.split_events(F.col("v")).alias("s")).collect()
    assert all(r.e == r.s for r in back)


def test_targets(spark):
    ev, r = F.array(F.lit("x"), F.lit("y")), P.ints([2, 1, 4, 3])
    assert one(spark, X.build_target("mid", ev, r, F.lit(False)).alias("t")).t == "Order: Frame 2 -> Frame 1 -> Frame 4 -> Frame 3\nConclusion: ORDERABLE\nAnswer: [2, 1, 4, 3]"
    assert one(spark, X.build_target("short", ev, r, F.lit(True)).alias("t")).t == "Conclusion: UNORDERABLE\nAnswer: [1, 2, 3, 4]"
    cot = one(spark, X.build_target("cot", ev, r, F.lit(False)).alias("t")).t
    assert "  E2. y\n" in cot and "Step 3 - Temporal position of each frame: Frame 1 -> 2nd, Frame 2 -> 1st" in cot and cot.endswith("Answer: [2, 1, 4, 3]")
    with pytest.raises(ValueError, match="style"):
        X.build_target("plain", ev, r, F.lit(False))
    assert [m.role for m in one(spark, X.build_messages(F.array(F.lit("a.jpg")), F.lit("c"), "mid", F.lit("t")).alias("m")).m] == ["user", "assistant"]


def test_variant_fields(spark):
    p = lambda t: one(spark, X.parse_variants(F.lit(t)).alias("x")).x
    assert p('ok {"variants": ["a ", "", "b"]} end') == ["a", "b"] and p('["x"]') == ["x"] and p("none") == []
    n = lambda t, s=True: one(spark, X.normalise_variants(F.lit(t).cast("string"), s).alias("x")).x
    assert n('["a", " b "]') == ["a", "b"] and n("a ||| b|||") == ["a", "b"] and n(None) == [] and n('{"k": 1}') == ['{"k": 1}'] and n("3", False) == []
    ok = lambda c, o: one(spark, X.is_valid_variant(F.lit(c), F.lit(o)).alias("x")).x
    assert ok("A tall man walks home slowly", "A tall man walks home") and not ok("The answer is a tall man walks home", "A tall man walks home") and not ok("Birds fly", "A tall man walks home") and not ok(" a tall MAN walks home", "A tall man walks home")
    assert one(spark, X.clamp01(F.lit("bad"), True).alias("x")).x == 0.0 and one(spark, X.hard_score(F.lit(""), F.lit("no"), F.lit(None).cast("string")).alias("x")).x == 1.0


def decide(spark, cast, **kw):
    rows = [("s", "fail" if r is None else "unorderable" if r == "u" else "orderable", r if isinstance(r, list) else None) for r in cast]
    return votes.decide(votes.tally(spark.createDataFrame(rows, "id string, kind string, rank array<int>")), **kw).first()


A1, A2, A3 = [2, 1, 3, 4], [2, 1, 4, 3], [4, 3, 2, 1]


@pytest.mark.parametrize(("cast", "kw", "reason", "rank"), [
    ([None, None], {}, "parse_fail", IDENT), (["u", "u", A1], {}, "unorderable_majority", IDENT), (["u", A1, A1], {}, "mode", A1), (["u", A1], {"disperse_gate": False}, "mode", A1),
    ([A1, A2, A3], {}, "disperse_gate", IDENT), ([A1, A1, A2, A2, A3], {}, "borda_tie", A2), ([IDENT, IDENT, A1], {"ban_identity": True, "disperse_gate": False}, "mode", A1),
    ([IDENT, IDENT], {"ban_identity": True}, "all_identity_votes", IDENT), ([IDENT, IDENT, A1, A1, A1], {"identity_quota": 2}, "identity_quota", IDENT), ([A1, A1, A3, A3], {}, "borda_tie", A1),
])
def test_decision(spark, cast, kw, reason, rank):
    got = decide(spark, cast, **kw)
    assert got.reason == reason and got["rank"] == rank


def test_votes_end_to_end_ignore_order(spark):
    truth = [3, 1, 4, 2]
    rows = [("a", p, f"Conclusion: ORDERABLE\nAnswer: {[truth[j] for j in p]}") for p in P.views(4)] + [("b", [0, 1, 2, 3], "?"), ("b", [1, 0, 2, 3], None), ("c", [0, 1, 2, 3], "Conclusion: UNORDERABLE\nAnswer: [1, 2, 3, 4]")]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "id string, perm array<int>, text string").repartition(3)
        got = {r.id: (r["rank"], r.reason, r.consensus) for r in votes.decide(votes.tally(votes.parse_votes(df))).collect()}
        assert got == {"a": (truth, "mode", 4), "b": (IDENT, "parse_fail", 0), "c": (IDENT, "unorderable_majority", 0)}


def test_tau(spark):
    assert one(spark, P.kendall_tau(P.identity(), P.identity()).alias("x")).x == 1.0 and one(spark, P.kendall_tau(P.identity(), P.ints([4, 3, 2, 1])).alias("x")).x == -1.0


def test_evaluate(spark):
    truth = spark.createDataFrame([("a", A1, False), ("b", A2, False), ("c", IDENT, True)], "id string, truth array<int>, no_ordering boolean")
    pred = spark.createDataFrame([("a", A1), ("b", IDENT), ("c", IDENT)], "id string, rank array<int>")
    m = metrics.evaluate(metrics.scored(pred, truth)).first()
    assert (m.n, round(m.em, 4), m.em_orderable, m.em_no_ordering, m.gate_precision, m.gate_recall) == (3, 0.6667, 0.5, 1.0, 0.5, 1.0)
    none = metrics.evaluate(metrics.scored(pred.filter("id = 'a'"), truth.filter("id = 'a'"))).first()
    assert none.gate_precision != none.gate_precision
    for bad in (pred.filter("id <> 'b'"), pred.filter("id <> 'b'").union(spark.createDataFrame([("b", [1, 1, 2, 3])], pred.schema))):
        with pytest.raises(Exception, match="missing or invalid"):
            metrics.evaluate(metrics.scored(bad, truth)).collect()


def test_projection_and_one_to_one(spark):
    val = spark.createDataFrame([(4, 1), (4, 1), (2, 0), (2, 1)], "consensus int, em int")
    test = spark.createDataFrame([(4,)] * 3 + [(2,)] + [(3,)] * 4, "consensus int")
    assert metrics.project(val, test).first().projected == round((3 * 1.0 + 0.5 + 4 * 0.75) / 8, 4)
    a = spark.createDataFrame([(1,), (2,)], "id int")
    assert metrics.one_to_one(a, a).count() == 2
    for left, right in ((a.union(a), a), (a, a.filter("id = 1"))):
        with pytest.raises(Exception, match="repeats a key|no match"):
            metrics.one_to_one(left, right).collect()


def ll_frame(spark, rows):
    return loglik.from_long(spark.createDataFrame(rows, "id string, key string, lp double, n int"), True)


def view(best, unord=-60.0, i="s", lead=-10.0, n=10):
    return [(i, k, lead if k == best else -500.0, n) for k in loglik.KEYS] + [(i, "unorderable", unord, n)]


def test_log_likelihoods(spark):
    key = "[2, 1, 3, 4]"
    assert loglik.decide_ll(ll_frame(spark, view(key))).first()["rank"] == A1
    assert loglik.decide_ll(ll_frame(spark, view(key, -10.0))).first()["rank"] == A1  # strict margin
    assert loglik.decide_ll(ll_frame(spark, view(key, -9.0))).first()["rank"] == IDENT
    assert loglik.decide_ll(ll_frame(spark, view(key, -9.0)), margin=0.2).first()["rank"] == A1
    banned = loglik.decide_ll(ll_frame(spark, view("[1, 2, 3, 4]", -900.0)), ban_identity=True).first()["rank"]
    assert banned == [1, 2, 4, 3]
    assert loglik.decide_ll(ll_frame(spark, view("[1, 2, 3, 4]")), ban_identity=True).first()["rank"] == IDENT  # by the gate
    two = ll_frame(spark, view(key) + view(key, lead=-30.0)).first()
    assert two["scores"][6] == -2.0
    raw = spark.createDataFrame([("s", {"unorderable": (-3.0, 2), key: (-4.0, 4)})], "id string, lls map<string, struct<lp: double, n: int>>")
    got = loglik.aggregate_ll(raw, False).first()
    assert got["unord"] == -3.0 and got["scores"][6] == -4.0 and got["scores"][0] is None


def test_fusion(spark):
    v = spark.createDataFrame([(i, "orderable", r) for i, rs in {"x": [A1, A1, A1], "y": [A1, A2], "z": [A2, A2]}.items() for r in rs], "id string, kind string, rank array<int>")
    v = votes.decide(votes.tally(v), disperse_gate=False)
    ll = ll_frame(spark, view("[4, 3, 2, 1]", -900.0, i="x") + view("[4, 3, 2, 1]", -900.0, i="y"))
    get = lambda policy, **kw: {r.id: r["rank"] for r in loglik.fuse(v, ll, policy, **kw).collect()}
    assert get("vote") == {"x": A1, "y": A1, "z": A2}
    assert get("ll") == {"x": A3, "y": A3}
    assert get("h1") == {"x": A1, "y": A3, "z": A2}
    assert get("h2") == {"x": A1, "y": A1, "z": A2}  # y voted for A1 and A2, whose scores tie: the smaller rank
    with pytest.raises(ValueError, match="policy"):
        get("both")
    truth = spark.createDataFrame([("x", A1), ("y", A3)], "id string, truth array<int>")
    table = loglik.sweep_policies(v, ll, truth, [-100.0, 0.0, 1.0]).collect()
    assert len(table) == 15 and [r.em for r in table] == sorted((r.em for r in table), reverse=True)
    by = {(r.policy, r.k, r.ban_identity): (r.margin, r.em) for r in table}
    assert by["vote", None, None] == (None, 0.5) and by["h1", 2, False] == by["h1", 3, False] == (0.0, 1.0) and by["h2", 2, False] == (-100.0, 0.5)
    for (policy, k, ban), (margin, em) in by.items():
        if policy != "vote":
            one_by_one = [(m, metrics.evaluate(metrics.scored(loglik.fuse(v, ll, policy, k=k or 3, margin=m, ban_identity=ban).filter("id <> 'z'"), truth.withColumn("no_ordering", F.lit(False)))).first().em) for m in (-100.0, 0.0, 1.0)]
            assert (margin, em) == max(one_by_one, key=lambda x: (x[1], -x[0])), (policy, k, ban)


def test_hard_cases(spark):
    truth = spark.createDataFrame([(1, A1, False), (2, A1, False), (3, IDENT, True), (4, A1, False)], "id int, truth array<int>, no_ordering boolean")
    pred = spark.createDataFrame([(1, A1), (2, IDENT), (3, A3)], "id int, rank array<int>")
    got = {r.id: (r.em, r.hard_score, r.caption_aug_repeats) for r in hardcases.hard_cases(truth, pred).collect()}
    assert got == {1: (True, 0.0, 1), 2: (False, 0.75, 4), 3: (False, 1.0, 5), 4: (False, 1.0, 5)}
    rec = spark.createDataFrame([(1, 2, False), (2, 9, True), (3, None, True)], "id int, caption_aug_repeats int, no_ordering boolean")
    assert hardcases.expand(rec, 2).groupBy("id").count().orderBy("id").collect() == [(1, 2), (2, 10), (3, 2)]
    calls = spark.createDataFrame([("r", 1, 100, 0), ("r", 2, 900, 0), ("r", 3, 50, 0)], "run string, pos int, tokens_in int, tokens_out int")
    plan = hardcases.budget_plan(calls, max_cost_krw=160 * 0.1 / 1e6 * 1400).orderBy("pos").collect()
    assert [p.status for p in plan] == ["called", "skipped_budget", "called"]


def test_groups_and_split(spark):
    rows = [(i, f"a quick brown fox number{i // 3} jumps over lazy dogs again {i // 3}{i // 3}{i // 3}") for i in range(60)] + [(90, None), (91, ""), (92, "zz zz")]
    df = spark.createDataFrame(rows, "id long, text string")
    groups = similarity.caption_groups(df)
    by = {r.id: r.grp for r in groups.collect()}
    assert all(by[i] == by[i // 3 * 3] for i in range(60)) and by[90] == 90 and by[91] == 91
    split = similarity.group_split(groups, 0.2)
    assert similarity.leaks(split).count() == 0 and split.filter("fold = 'val'").count() >= 12
    naive = {}
    v = similarity.vectors(df, similarity.vocabulary(df)).collect()
    for r in v:
        naive.setdefault(r.id, {})[r.term] = r.w
    want = {(a, b) for a in naive for b in naive if a < b and sum(w * naive[b].get(t, 0) for t, w in naive[a].items()) >= 0.8 - 1e-9}
    got = {(r.a, r.b) for r in similarity.similar_pairs(similarity.vectors(df, similarity.vocabulary(df)), None, 0.8).collect()}
    assert got == want
    folds = similarity.stratified_folds(df.withColumn("y", F.col("id") % 2), "y").groupBy("y", "fold").count().collect()
    assert max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 1


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.range(n - 1).select((F.col("id") * 7 % n).alias("a"), ((F.col("id") + 1) * 7 % n).alias("b"))
    assert {r.grp for r in similarity.components(spark.range(n), edges).collect()} == {0}


def test_calibration(spark):
    onehot = [[10.0 if r == p - 1 else 0.0 for r in range(4)] for p in A1]
    rows = [(1, onehot, 0.05, 6), (2, onehot, 0.10, 6), (3, onehot, 0.95, 0), (4, onehot, 0.90, 0)]
    df = spark.createDataFrame(rows, "id int, logits array<array<double>>, gate double, target int").withColumn("scores", A.perm_scores(F.col("logits")))
    best = calibrate.calibrate(df).first()
    assert best.em == 1.0 and best.tau == 0.1
    assert calibrate.permutation_accuracy(df).first()[0] == 1.0
    assert [r.em for r in calibrate.ablation(df).orderBy("ban_identity", "gate").collect()] == [0.5, 1.0, 0.5, 1.0]


def test_frames(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    noise = rng.integers(60, 256, (120, 160))
    boxed = noise.copy()
    boxed[:20], boxed[-15:] = 0, 0
    near = np.clip(noise + 5, 0, 255)
    df = spark.createDataFrame([(n, g.tolist()) for n, g in {"black": np.zeros((120, 160), int), "noise": noise, "boxed": boxed, "near": near, "other": rng.integers(0, 256, (120, 160))}.items()], "id string, gray array<array<int>>")
    top, bottom = A.letterbox(F.col("gray"))
    got = {r.id: r for r in image.phash(df).select("id", "phash", A.is_low_info(F.col("gray")).alias("low"), top.alias("top"), bottom.alias("bottom"), F.size(A.crop(F.col("gray"), top, bottom)).alias("left")).collect()}
    assert got["black"].low and not got["noise"].low and (got["black"].top, got["black"].bottom) == (40, 40)
    assert (got["boxed"].top, got["boxed"].bottom, got["boxed"].left) == (20, 15, 85) and (got["noise"].top, got["noise"].bottom) == (0, 0)
    dist = lambda a, b: bin((got[a].phash ^ got[b].phash) & (2**64 - 1)).count("1")
    assert dist("noise", "near") <= 6 < dist("noise", "other")
    caps = [one(spark, *[c.alias(f"c{i}") for i, c in enumerate(A.cap_pixels(F.lit(w), F.lit(h)))]) for w, h in ((1920, 1080), (640, 360), (100, 100))]
    assert caps[0].c0 * caps[0].c1 <= 250_880 and tuple(caps[1]) == (640, 360) and tuple(caps[2]) == (100, 100)


def test_tables(spark, tmp_path):
    (tmp_path / "train.csv").write_text('Id,Input_1,Input_2,Input_3,Input_4,Sentence,Answer,No_ordering\na,1.jpg,2.jpg,3.jpg,4.jpg,"He said ""hi"", then left","[2, 1, 3, 4]",False\n')
    df = tables.load_split(spark, "train", tables.Paths(root=str(tmp_path)))
    row = df.first()
    assert row.Sentence == 'He said "hi", then left' and row.paths[1].endswith("train/a/2.jpg") and row.No_ordering is False
    with pytest.raises(ValueError, match="split"):
        tables.load_split(spark, "val", tables.Paths(root="."))
    raw = spark.createDataFrame([("a", [0, 1, 2, 3], "Answer: [2, 1, 3, 4] é")], tables.VOTE)
    tables.write_jsonl(raw, str(tmp_path / "v"))
    votes_in = tables.load_votes(spark, str(tmp_path / "v"))
    assert votes_in.first().text.endswith("é")
    done = votes_in.select("id", "perm")
    jobs = spark.createDataFrame([("a", [0, 1, 2, 3]), ("a", [1, 0, 2, 3])], done.schema)
    assert tables.pending(jobs, done).collect() == [("a", [1, 0, 2, 3])]
    test = spark.createDataFrame([(0, "b"), (1, "a")], "pos int, id string")
    pred = spark.createDataFrame([("a", A1), ("b", IDENT)], "id string, rank array<int>")
    sub = tables.submission(test, pred)
    with pytest.warns(UserWarning, match="share of identities"):
        found = tables.write_submission(test, pred, str(tmp_path / "sub"))
    assert found["n"] == 2 and found["n_misplaced"] == 0
    assert [r.Id for r in tables.read_csv(spark, str(tmp_path / "sub"), tables.PREDICTION).collect()] == ["b", "a"]
    assert {r.id: r["rank"] for r in tables.load_predictions(spark, str(tmp_path / "sub")).collect()} == {"a": A1, "b": IDENT}
    (tmp_path / "p.csv").write_text('Id,Answer\na,"[1, 2, 3, 4]"\nb,nothing\na,"[2, 1, 3, 4]"\n')
    assert {r.id: r["rank"] for r in tables.load_predictions(spark, str(tmp_path / "p.csv"), strict=False).collect()} == {"a": A1, "b": None}
    with pytest.raises(Exception, match="not a permutation"):
        tables.load_predictions(spark, str(tmp_path / "p.csv")).collect()
    rep = tables.submission_report(test, sub).first()
    assert (rep.n, rep.n_missing, rep.n_invalid, rep.n_misplaced, rep.share_ok) == (2, 0, 0, 0, False)
    with pytest.raises(Exception, match="missing or invalid"):
        tables.submission(test, pred.filter("id = 'a'")).collect()
    hard = spark.createDataFrame([(1, "a", None, "2"), (2, None, "a", ""), (3, "b", None, "5")], "pos int, Id string, other string, caption_aug_repeats string")
    assert {r.Id: r.caption_aug_repeats for r in tables.hard_lookup(hard, ["caption_aug_repeats"]).collect()} == {"a": "2", "b": "5"}
    assert tables.complete_text(spark.createDataFrame([("s", "u")], "system string, user string"), lambda a, b: a + b).first().reply == "su"


def test_stream(spark, tmp_path):
    from tesserae.streaming.vote_stream import decide_stream, read_votes

    rows = [("a", [0, 1, 2, 3], "[2, 1, 3, 4]"), ("a", [0, 1, 2, 3], "[2, 1, 3, 4]"), ("a", [1, 0, 2, 3], "[1, 2, 3, 4]")]
    spark.createDataFrame(rows, tables.VOTE).write.json(str(tmp_path / "in"))
    out = []
    decide_stream(read_votes(spark, str(tmp_path / "in")), str(tmp_path / "ck"), lambda df, n: out.extend(df.collect())).awaitTermination()
    assert [(r.id, r.n_votes, r["rank"]) for r in out] == [("a", 2, A1)]


def test_budget_plan_covers_every_call(spark):
    """All 20,000 calls of sf0.1, against the fold in plain Python."""
    from tesserae.operators.hardcases import cost_usd
    from tesserae.plans import catalogue, fixtures

    sf = "/root/testdata/sf0.1"
    c = fixtures.captions(spark, sf).select("id", cost_usd((F.length("caption") * (1 + F.col("id") % 3)).cast("long"), F.lit(900).cast("long")).alias("usd"))
    want, spent = {}, [0.0] * 8
    for r in sorted(c.collect()):
        fits = (spent[r.id % 8] + r.usd) * 1400.0 <= 40.0
        spent[r.id % 8] += r.usd if fits else 0.0
        want[r.id] = (r.id % 8, round(r.usd, 9), "called" if fits else "skipped_budget")
    got = {r.pos: (r.run, r.usd, r.status) for r in catalogue.QUERIES["budget_plan"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/part.parquet").count() > 2000
    assert got == want and {x[2] for x in want.values()} == {"called", "skipped_budget"}


def test_phash_pairs_of_every_sample(spark):
    """Every part row has a frame, every four frames six pairs."""
    import numpy as np

    from tesserae.plans import catalogue

    sf = "/root/testdata/sf0.001"
    ids = sorted(r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect())

    def frame(n):
        r, c = np.mgrid[:24, :32]
        px = 30 + (r + c) % 4 if n % 3 == 0 else (r * 37 + c * 11 + n * 7) % 256
        return np.where((r < n % 9) | (r >= 24 - n % 5), 2, px)

    hashes = {n: image.phash_array(frame(n)) for n in ids}
    want = {(a, b, bin((hashes[a] ^ hashes[b]) & (2**64 - 1)).count("1")) for a in ids for b in ids if a < b and a // 4 == b // 4}
    got = [(r.id, r.mate, r.distance) for r in catalogue.QUERIES["phash_pairs"](spark, sf).collect()]
    assert len(got) == len(want) == len(ids) // 4 * 6 and set(got) == want


def test_predictions_and_metrics_sinks(spark, tmp_path):
    pred = spark.createDataFrame([("a", A1), ("b", IDENT)], "id string, rank array<int>")
    tables.write_predictions(pred, str(tmp_path / "p"))
    assert {r.id: r["rank"] for r in tables.load_predictions(spark, str(tmp_path / "p")).collect()} == {"a": A1, "b": IDENT}
    tables.write_metrics(spark.createDataFrame([(3, 0.5)], "n int, em double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().asDict() == {"n": 3, "em": 0.5}


def test_stored_log_likelihoods(spark, tmp_path):
    (tmp_path / "ll.jsonl").write_text('{"Id": "s", "perm": [0, 1, 2, 3], "ll": {"[2, 1, 3, 4]": [-10.0, 10], "unorderable": [-60.0, 10]}}\n\nbroken\n')
    got = loglik.aggregate_ll(tables.load_ll(spark, str(tmp_path / "ll.jsonl")).filter("id is not null")).first()
    assert got["scores"][6] == -1.0 and got["unord"] == -6.0
    assert tables.read_jsonl(spark, str(tmp_path / "ll.jsonl"), tables.LL, skip_bad=True).count() == 1
    assert tables.read_jsonl(spark, str(tmp_path / "ll.jsonl"), tables.LL).count() == 2


def test_read_by_extension(spark, tmp_path):
    (tmp_path / "a.JSONL").write_text('{"Id": "x", "Answer": "y"}\n')
    (tmp_path / "a.csv").write_text('Id,Answer\nx,y\n')
    for name in ("a.JSONL", "a.csv"):
        assert tables.read_table(spark, str(tmp_path / name), tables.PREDICTION).collect() == [("x", "y")]


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("# top\nroot: /data  # here\ntrain: 'a b.csv'\nhead:\n  layers: 2\n  rate: 1e-3\n  use: true\n  inner:\n    names: [x, 'y']\ntau: null\nfolds:\n  - 1\n  - 2\nlast: z\n")
    got = tables.load_config(str(tmp_path / "c.yaml"), tau=0.5, last=None)
    assert got == {"root": "/data", "train": "a b.csv", "head": {"layers": 2, "rate": 0.001, "use": True, "inner": {"names": ["x", "y"]}}, "tau": 0.5, "folds": [1, 2], "last": "z"}
    monkeypatch.setenv("TESSERAE_PATHS", str(tmp_path / "c.yaml"))
    assert tables.Paths.load().at("train") == "/data/a b.csv" and tables.Paths.load().test == "test.csv"
    (tmp_path / "d.yaml").write_text("train: other.csv\n")
    assert tables.Paths.load(str(tmp_path / "d.yaml"), root="r").at("train") == "r/other.csv"


def png(path, pixels):
    """Write rows of (r, g, b) as a PNG."""
    import struct
    import zlib

    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(c for p in row for c in p) for row in pixels)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_images(spark, tmp_path):
    """Red-green-blue frames: dark bands cropped, capped by area, broken files skipped; gray by luma."""
    px = [[(0, 0, 0)] * 6] * 2 + [[(200, 100, 50)] * 6] * 8 + [[(0, 0, 0)] * 6] * 2
    png(tmp_path / "a.png", px)
    (tmp_path / "broken.png").write_bytes(b"not an image")
    gray = tables.read_gray(spark, str(tmp_path)).collect()
    assert len(gray) == 1 and (gray[0].width, gray[0].height) == (6, 12) and gray[0].gray[5] == [round(0.299 * 200 + 0.587 * 100 + 0.114 * 50)] * 6
    whole = tables.read_rgb(spark, str(tmp_path)).collect()
    assert len(whole) == 1 and (whole[0].width, whole[0].height) == (6, 12) and whole[0].rgb[6 * 3 * 5 :][:3] == bytes((200, 100, 50))
    cut = tables.read_rgb(spark, str(tmp_path), crop=True).first()
    assert (cut.width, cut.height) == (6, 8) and cut.rgb == bytes((200, 100, 50)) * 48
    small = tables.read_rgb(spark, str(tmp_path), crop=True, limit=12).first()
    assert small.width * small.height <= 12 and (small.width, small.height) == (3, 4) and small.rgb == bytes((200, 100, 50)) * 12


def test_chunks(spark, tmp_path):
    ids = spark.range(25).select(F.col("id").alias("pos"), F.concat(F.lit("s"), "id").alias("id"))
    rows = ids.withColumn("img", F.array(F.col("pos").cast("double")))
    at = str(tmp_path / "c")
    tables.write_chunks(rows.filter("pos < 10"), at, 5)
    tables.write_chunks(rows, at, 5)  # the first two are there already
    got = tables.merge_chunks(ids, at).collect()
    assert [r.pos for r in got] == list(range(25)) and got[7].img == [7.0] and len(got) == 25
    for bad in (ids.filter("pos < 24"), ids.withColumn("id", F.when(F.col("pos") == 3, "other").otherwise(F.col("id"))), spark.range(26).select(F.col("id").alias("pos"), F.concat(F.lit("s"), "id").alias("id"))):
        with pytest.raises(Exception, match="chunks do not match"):
            tables.merge_chunks(bad, at).collect()


def test_joins_that_must_be_total(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "pos int, id string")
    b = spark.createDataFrame([("y", 2), ("x", 1)], "id string, v int")
    assert [r.v for r in tables.ordered_lookup(a, b).collect()] == [1, 2]
    with pytest.raises(Exception, match="no row"):
        tables.ordered_lookup(a, b.filter("v = 1")).collect()
    assert tables.left_total(a, b, "id", "v").count() == 2
    with pytest.raises(Exception, match="no v for a key"):
        tables.left_total(a, b.filter("v = 1"), "id", "v").collect()
    assert tables.coverage(a, b.filter("v = 1")).first().asDict() == {"n": 2, "n_covered": 1, "complete": False}
    assert [r.pos for r in tables.with_position(spark.range(50).repartition(7), "id").orderBy("id").collect()] == list(range(50))
    with pytest.raises(Exception, match="merge check failed"):
        metrics.merge_check(spark.createDataFrame([(True,)] * 3 + [(False,)] * 7, "match boolean")).collect()


def test_submission_is_read_back(spark, tmp_path, monkeypatch):
    test = spark.createDataFrame([(5, "b"), (9, "a"), (2, "c")], "pos int, id string")
    pred = spark.createDataFrame([("a", A1), ("b", IDENT), ("c", A2)], "id string, rank array<int>")
    monkeypatch.setattr(tables, "SHARE", (0.0, 1.0))
    assert tables.write_submission(test, pred, str(tmp_path / "s"))["share_ok"]
    assert [r.Id for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()] == ["c", "b", "a"]
    monkeypatch.setattr(tables, "submission", lambda t, p: t.select("pos", F.col("id").alias("Id"), F.lit("[1, 1, 2, 3]").alias("Answer")))
    with pytest.raises(ValueError, match="written submission is wrong"):
        tables.write_submission(test, pred, str(tmp_path / "t"))


def test_chat_connector(spark):
    sent = []

    def transport(url, headers, body):
        import json

        sent.append((url, headers, json.loads(body)))
        return json.dumps({"choices": [{"message": {"content": [{"type": "text", "text": "a"}, "b", {"text": "c"}]}}]})

    call = tables.chat_caller(transport, "http://localhost:8000/v1/", "m", json_mode=True, temperature=0.1, max_tokens=5)
    assert call("s", "u") == "abc"
    url, headers, payload = sent[0]
    assert url == "http://localhost:8000/v1/chat/completions" and "Authorization" not in headers
    assert payload == {"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}], "temperature": 0.1, "max_tokens": 5, "response_format": {"type": "json_object"}}
    with pytest.raises(ValueError, match="key"):
        tables.chat_request("https://api.example.org", "m", "s", "u")
    assert tables.chat_request("https://api.example.org/chat/completions", "m", "s", "u", key="k")[1]["Authorization"] == "Bearer k"
    assert tables.chat_content('{"choices": [{"message": {"content": "plain"}}]}') == "plain"


def test_group_folds_deal_as_one_by_one(spark):
    import random

    rng = random.Random(3)
    for _ in range(40):
        k = rng.randint(2, 6)
        sizes = [rng.choice([1, 1, 1, 2, 3, 7, 40]) for _ in range(rng.randint(1, 120))]
        load = [0] * k
        want = {}
        for size in sorted(sizes, reverse=True):
            f = load.index(min(load))
            load[f] += size
            want[size, f] = want.get((size, f), 0) + 1
        kinds = [(x, sizes.count(x)) for x in set(sizes)]
        assert {(size, f): high - low for size, f, low, high in similarity.fold_quotas(kinds, k)} == want
    g = spark.range(400).select("id", (F.col("id") % 61).alias("grp"))
    folds = similarity.group_folds(g, 4).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("grp").alias("g")).collect()
    assert sum(r.g for r in folds) == 61 and max(r.n for r in folds) - min(r.n for r in folds) <= 7


def test_nearest_is_exact(spark):
    import random

    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    rows = [(i, " ".join(rng.sample(words, rng.randint(1, 40)))) for i in range(150)] + [(200, None), (201, ""), (202, "alone xyz")]
    df = spark.createDataFrame(rows, "id long, text string")
    vec = {}
    for r in similarity.vectors(df, similarity.vocabulary(df)).collect():
        vec.setdefault(r.id, {})[r.term] = r.w
    for k in (1, 10):
        got = similarity.nearest(df.filter("id % 5 = 0"), df, k).collect()
        want = []
        for q in (i for i in vec if i % 5 == 0):
            sims = sorted((-round(sum(w * vec[m].get(t, 0.0) for t, w in vec[q].items()), 6), m) for m in vec if m != q and vec[q].keys() & vec[m].keys())
            want += [(q, n + 1, m, -x) for n, (x, m) in enumerate(sims[:k])]
        assert {(r.id, r["rank"], r.mate, r.sim) for r in got} == set(want)


def test_similar_pairs_are_exact_at_any_cut(spark):
    import random

    rng = random.Random(9)
    base = [[f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.randint(1, 60))] for _ in range(60)]
    texts = base + [[w if rng.random() < 0.9 else "zz" for w in b] for b in base] + [["aa", "bb"]] * 4
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    v = similarity.vectors(df, similarity.vocabulary(df))
    vec = {}
    for r in v.collect():
        vec.setdefault(r.id, {})[r.term] = r.w
    want = {(a, b) for a in vec for b in vec if a < b and round(sum(w * vec[b].get(t, 0.0) for t, w in vec[a].items()), 6) >= 0.8}
    for common in (1, 6, 10_000):
        assert {(r.a, r.b) for r in similarity.similar_pairs(v, None, 0.8, common).collect()} == want and len(want) > 20
    reps = similarity.classes(df).collect()
    assert {r.rep for r in reps if r.id >= 120} == {120}


def test_loss_value(spark):
    import math

    logits, rank = [[1.0, 0.0, 2.0, -1.0], [0.5, 0.5, 0.0, 0.0], [0.0, 3.0, 0.0, 1.0], [0.0, 0.0, 0.0, 0.0]], [3, 1, 2, 4]
    rows = [(logits, 0.7, rank, 12, False, 1.0), (logits, -0.2, IDENT, 0, True, 0.5)]
    df = spark.createDataFrame(rows, "logits array<array<double>>, gate_logit double, rank array<int>, target int, no_ordering boolean, weight double")
    got = calibrate.multi_task_loss(df.withColumn("scores", A.perm_scores(F.col("logits"))), pos_weight=3.0).first().loss
    ls = [[x - math.log(sum(map(math.exp, row))) for x in row] for row in logits]
    scores = [sum(ls[i][p[i] - 1] for i in range(4)) for p in itertools.permutations(IDENT)]
    z = math.log(sum(map(math.exp, scores)))
    perm = 0.95 * (z - scores[12]) + 0.05 * sum(z - x for x in scores) / 24
    assert list(itertools.permutations(IDENT))[12] == tuple(rank)
    frame = -sum(ls[i][rank[i] - 1] for i in range(4)) / 4
    gate = (math.log1p(math.exp(0.7)) + 0.5 * 3.0 * math.log1p(math.exp(0.2))) / 2
    assert abs(got - (gate + perm + 0.5 * frame)) < 1e-9


def test_every_registered_query_has_sql_or_is_known(spark):
    import __spark_entry__ as entry

    missing = {n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"}
    assert missing == {"phash_pairs", "stratified_cv_auc", "boosted_trees_auc", "ordering_head"}
