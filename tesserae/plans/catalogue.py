"""The engine's queries by name, each over its whole derived table."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import perm as P
from ..functions import text as X
from ..operators import calibrate, classify, frames, hardcases, image, loglik, metrics, orderhead, similarity, vectors, votes
from ..sources import tables
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
long = lambda c, name=None: F.col(c).cast("long").alias(name or c) if isinstance(c, str) else c.cast("long").alias(name)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _fmt(c: str = "rank", name: str = "answer"):
    return P.format_rank(F.col(c)).alias(name)


def _tallies(s: SparkSession, d: str) -> DataFrame:
    return votes.tally(votes.parse_votes(fx.votes(s, d)))


def _decided(s: SparkSession, d: str, **kw) -> DataFrame:
    return votes.decide(_tallies(s, d), **kw)


def _scored(s: SparkSession, d: str, **kw) -> DataFrame:
    return metrics.scored(_decided(s, d, **kw), fx.truth(s, d), ["consensus", "reason"])


def _ll(s: SparkSession, d: str, norm: bool = True) -> DataFrame:
    return loglik.from_long(fx.ll_rows(s, d), norm)


# ---- permutations -------------------------------------------------------------------------------


@query
def perm_roundtrip(s, d):
    dim = P.perm_dim(s)
    pairs = dim.select("idx", "rank").crossJoin(dim.select(F.col("idx").alias("view"), F.transform("rank", lambda x: x - 1).alias("perm")))
    x = pairs.withColumn("label", P.shuffle(F.col("rank"), F.col("perm")))
    return x.select("idx", "view", _fmt("label", "shown"), P.format_rank(P.unshuffle(F.col("label"), F.col("perm"))).alias("back"), P.format_rank(P.invert(F.col("rank"))).alias("rank_order"))


@query
def parse_last_list(s, d):
    e = tables.table(s, d, "events").select("event_id", F.expr(fx.LISTS).alias("t"))
    return e.select("event_id", P.format_rank(P.parse_last(F.col("t"))).alias("answer"), P.is_unorderable(F.col("t")).alias("unorderable"))


@query
def parse_baseline(s, d):
    return tables.table(s, d, "events").select("event_id", P.format_rank(P.parse_outermost(F.expr(fx.LISTS))).alias("answer"))


def _target(style):
    def run(s, d):
        return fx.captions(s, d).select("id", X.build_target(style, F.col("events"), F.col("rank"), F.col("no_ordering")).alias("target"))

    return run


for _style in X.STYLES:
    QUERIES[f"format_target_{_style}"] = _target(_style)


@query
def instruction_text(s, d):
    return fx.captions(s, d).select("id", *[X.build_instruction(st, F.col("caption")).alias(st) for st in X.STYLES])


@query
def rewrite_prompts(s, d):
    p = X.rewrite_prompt(F.col("caption"), F.col("events"), F.lit(3))
    return fx.captions(s, d).select("id", p.alias("prompt"), X.token_estimate(F.concat(F.lit(X.REWRITE_SYSTEM + "\n"), p)).alias("tokens"))


@query
def candidate_texts(s, d):
    samples = fx.truth(s, d).select("id")
    views = P.perm_dim(s).filter("idx in (0, 7, 14, 21)").select(F.col("idx").alias("view"), F.transform("rank", lambda x: x - 1).alias("perm"))
    return loglik.candidates(samples, views, P.perm_dim(s))


@query
def augment_perm(s, d):
    perm, rank = P.augment(F.col("truth"), F.col("no_ordering"), P.hash_int(F.lit(42), F.col("id")))
    return fx.truth(s, d).select("id", P.format_rank(F.transform(perm, lambda x: x + 1)).alias("view"), P.format_rank(rank).alias("new_rank"))


# ---- votes ------------------------------------------------------------------------------------------


@query
def vote_parse(s, d):
    v = fx.votes(s, d)
    return votes.parse_votes(v).groupBy("id", "kind", _fmt()).agg(F.count(F.lit(1)).alias("n"))


def _decision(**kw):
    return lambda s, d: _decided(s, d, **kw).select("id", _fmt(), "reason", "consensus")


QUERIES["vote_decision"] = _decision()
QUERIES["vote_decision_ban_identity"] = _decision(ban_identity=True)
QUERIES["vote_decision_no_gate"] = _decision(disperse_gate=False)
QUERIES["vote_decision_quota"] = _decision(identity_quota=1)


@query
def vote_stats(s, d):
    return _decided(s, d).select("id", "n_votes", "n_fail", "n_unorderable", "consensus", "identity_votes", _fmt(), (F.col("rank") == P.identity()).alias("pred_identity"), "reason")


@query
def vote_profile(s, d):
    return votes.profile(_decided(s, d))


@query
def consensus_hist(s, d):
    return votes.share(_decided(s, d), "consensus")


@query
def reason_counts(s, d):
    return votes.share(_decided(s, d), "reason")


@query
def em_overall(s, d):
    return metrics.evaluate(_scored(s, d))


@query
def em_by_consensus(s, d):
    bins = s.range(0, 6).select(F.col("id").alias("consensus"))
    return metrics.em_by(_scored(s, d), "consensus", bins)


@query
def em_by_reason(s, d):
    return metrics.em_by(_scored(s, d), "reason")


@query
def kendall_tau(s, d):
    return _scored(s, d).select("id", "em", F.round("tau", 6).alias("tau"))


@query
def project_score(s, d):
    x = _scored(s, d)
    return metrics.project(x.filter("fold = 'val'"), x.filter("fold = 'test'"))


@query
def corr_consensus_em(s, d):
    return _scored(s, d).agg(F.round(F.corr("consensus", "em"), 6).alias("corr"))


# ---- log-likelihoods and fusion -----------------------------------------------------------------------


@query
def ll_aggregate(s, d):
    x = _ll(s, d)
    long_ = x.select("id", F.posexplode("scores").alias("at", "score")).select("id", long("at", "rank_idx"), F.round("score", 6).alias("score"))
    return long_.unionByName(x.select("id", F.lit(24).cast("long").alias("rank_idx"), F.round("unord", 6).alias("score")))


@query
def ll_decide(s, d):
    return loglik.decide_ll(_ll(s, d), margin=-0.4).select("id", _fmt())


@query
def ll_margin_sweep(s, d):
    t = fx.truth(s, d)
    return loglik.sweep_margins(_ll(s, d), t, loglik.margin_grid()).select(F.round("margin", 6).alias("margin"), F.round("em", 6).alias("em"))


def _fuse(policy, **kw):
    return lambda s, d: loglik.fuse(_decided(s, d), _ll(s, d), policy, margin=-0.4, **kw).select("id", _fmt())


QUERIES["fuse_h1"] = _fuse("h1")
QUERIES["fuse_h2"] = _fuse("h2", k=2)
QUERIES["fuse_ll_ban"] = _fuse("ll", ban_identity=True)


@query
def ll_best_margin(s, d):
    t = fx.truth(s, d)
    return loglik.best_margin(loglik.sweep_margins(_ll(s, d), t, loglik.margin_grid())).select(F.round("margin", 6).alias("margin"), F.round("em", 6).alias("em"))


@query
def fuse_sweep(s, d):
    out = loglik.sweep_policies(_decided(s, d), _ll(s, d), fx.truth(s, d), loglik.margin_grid())
    return out.select("policy", long("k"), "ban_identity", F.round("margin", 6).alias("margin"), F.round("em", 6).alias("em"))


# ---- captions ----------------------------------------------------------------------------------------


@query
def caption_events(s, d):
    return fx.captions(s, d).select("id", F.array_join("events", " | ").alias("events"), long(F.size("events"), "n_events"))


@query
def event_count_hist(s, d):
    return votes.share(fx.captions(s, d).select(long(F.size("events"), "n_events")), "n_events")


@query
def caption_variants(s, d):
    c = fx.captions(s, d)
    v = X.caption_variants(F.col("caption"), F.col("events"))
    return c.select("id", v.alias("v")).select("id", F.array_join("v", " | ").alias("variants"), long(F.size("v"), "n_variants"))


@query
def caption_pick(s, d):
    c = fx.captions(s, d).withColumn("v", X.caption_variants(F.col("caption"), F.col("events")))
    got = X.pick(F.col("v"), F.col("caption"), P.hash_int(F.lit(7), F.col("id")))
    return c.select("id", got.alias("picked"), long(X.word_count(F.col("caption")), "n_words"))


@query
def variant_validity(s, d):
    c = fx.captions(s, d)
    cand = F.expr("CASE k % 5 WHEN 0 THEN caption WHEN 1 THEN p_name || ' and ' || p_type WHEN 2 THEN 'the answer is ' || caption WHEN 3 THEN p_brand ELSE p_type || ' goes with ' || p_name || ' slowly' END")
    c = c.withColumn("cand", cand)
    return c.select("id", X.is_valid_variant(F.col("cand"), F.col("caption")).alias("valid"), long(F.size(X.content_tokens(F.col("caption"))), "n_tokens"))


@query
def llm_variants_json(s, d):
    c = fx.captions(s, d).withColumn("t", F.expr(fx.VARIANT))
    j = lambda a: F.array_join(a, "|")
    return c.select("id", j(X.parse_variants(F.col("t"))).alias("parsed"), j(X.normalise_variants(F.expr("CASE WHEN k % 6 IN (2, 3, 4, 5) THEN t END"))).alias("normalised"))


@query
def event_props(s, d):
    e = tables.table(s, d, "events").select("event_type", F.from_json("props", "map<string, bigint>").alias("m"))
    return e.select("event_type", F.explode("m").alias("key", "v")).groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


# ---- hard cases and expansion ------------------------------------------------------------------------


@query
def hard_cases(s, d):
    out = hardcases.hard_cases(fx.truth(s, d), _decided(s, d).filter("id % 31 <> 0"))
    return out.select("id", "em", "tau", "no_ordering", "pred", "truth", "hard_score", long("caption_aug_repeats"), "caption_aug_prob")


@query
def variant_plan(s, d):
    h = hardcases.hard_cases(fx.truth(s, d), _decided(s, d))
    return h.select("id", long(hardcases.variant_budget(F.col("hard_score"), 1, 3, 4), "n_variants"))


@query
def annotate_hard(s, d):
    rec = fx.truth(s, d).select("id")
    hard = fx.truth(s, d).selectExpr("id", "CASE WHEN id % 4 = 0 THEN CAST((id % 15) / 10.0 AS STRING) ELSE '' END AS hard_score", "CASE WHEN id % 3 = 0 THEN 'True' WHEN id % 3 = 1 THEN 'no' END AS em", "CASE WHEN id % 5 = 0 THEN 'y' END AS correct", "CASE WHEN id % 7 = 0 THEN '9' END AS caption_aug_repeats", "CASE WHEN id % 6 = 0 THEN '1.5' ELSE '' END AS caption_aug_prob").filter("id % 10 <> 9")
    return hardcases.annotate(rec, hard).select("id", long("caption_aug_repeats"), "caption_aug_prob", "hard_score")


@query
def repeat_oversample(s, d):
    h = hardcases.hard_cases(fx.truth(s, d), _decided(s, d)).select("id", "no_ordering", "caption_aug_repeats")
    return hardcases.expand(h, oversample=3).select("id", long("part"), long("copy"))


@query
def override_merge(s, d):
    rec = fx.truth(s, d).select("id", F.lit(1).alias("caption_aug_repeats"), F.lit(0.3).alias("caption_aug_prob"))
    e = tables.table(s, d, "events").selectExpr("event_id AS pos", "event_id div 4 AS id", "CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 5 AS INT) END AS caption_aug_repeats", "CASE WHEN event_id % 5 < 2 THEN (event_id % 10) / 10.0D END AS caption_aug_prob", "event_type").filter("event_type = 'click' OR event_type = 'error'")
    out = hardcases.merge_overrides(rec, e, ["caption_aug_repeats", "caption_aug_prob"])
    return out.select("id", long("caption_aug_repeats"), F.round("caption_aug_prob", 6).alias("caption_aug_prob"))


@query
def budget_plan(s, d):
    c = fx.captions(s, d).select((F.col("id") % 8).alias("run"), F.col("id").alias("pos"), (F.length("caption") * (1 + F.col("id") % 3)).cast("long").alias("tokens_in"), F.lit(900).cast("long").alias("tokens_out"))
    return hardcases.budget_plan(c, max_cost_krw=40.0).select("run", "pos", F.round("usd", 9).alias("usd"), "status")


@query
def sample_subset(s, d):
    t = fx.truth(s, d).select("id")
    return hardcases.sample_rows(t, 100, P.hash_int(F.lit(3), F.col("id")))


# ---- similarity, groups and splits ---------------------------------------------------------------------


@query
def tfidf_pairs(s, d):
    """Pairs of class representatives; tfidf_classes says whom they stand for."""
    return similarity.class_pairs(fx.texts(s, d), 0.8).select("a", "b", F.round("sim", 6).alias("sim"))


@query
def tfidf_classes(s, d):
    return similarity.classes(fx.texts(s, d))


@query
def knn_captions(s, d):
    """The ten nearest captions of every twentieth one, among all."""
    docs = fx.texts(s, d)
    return similarity.nearest(docs.filter("id % 20 = 0"), docs, 10).select("id", long("rank"), "mate", "sim")


@query
def caption_groups(s, d):
    return similarity.caption_groups(fx.texts(s, d))


@query
def group_split(s, d):
    return similarity.group_split(similarity.caption_groups(fx.texts(s, d)))


@query
def fold_rates(s, d):
    x = similarity.group_split(similarity.caption_groups(fx.texts(s, d)))
    return x.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("grp").alias("groups"), F.round(F.avg((F.col("id") % 13 < 2).cast("double")), 6).alias("no_ordering_rate"))


@query
def leak_check(s, d):
    x = similarity.group_split(similarity.caption_groups(fx.texts(s, d)))
    return similarity.leaks(x).agg(F.count(F.lit(1)).alias("n_leaks"))


@query
def nearest_train_similarity(s, d):
    h = fx.texts(s, d)
    return similarity.nearest_similarity(h.filter("id % 10 = 0"), h.filter("id % 10 <> 0")).select("id", F.round("sim", 6).alias("sim"))


@query
def sim_bins(s, d):
    n = nearest_train_similarity(s, d).select(similarity.sim_bin(F.col("sim")).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = s.range(5).select(F.get(F.array(*[F.lit(b) for b in similarity.BINS]), F.col("id").cast("int")).alias("bin"))
    return bins.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query
def stratified_folds(s, d):
    t = fx.truth(s, d)
    return similarity.stratified_folds(t, "no_ordering").select("id", long("fold"))


@query
def group_kfold(s, d):
    g = fx.truth(s, d).select("id", (F.col("id") % 97).alias("grp"))
    return similarity.group_folds(g).select("id", "grp", long("fold"))


# ---- logits and embeddings --------------------------------------------------------------------------------


def _perm_rows(s, d):
    return fx.logits(s, d).withColumn("scores", A.perm_scores(F.col("logits")))


@query
def perm_scores(s, d):
    return _perm_rows(s, d).select("id", F.posexplode("scores").alias("at", "v")).select("id", long("at", "rank_idx"), F.round("v", 6).alias("score"))


@query
def perm_nll(s, d):
    return _perm_rows(s, d).select("id", F.round(A.perm_nll(F.col("scores"), F.col("target")), 6).alias("nll"))


@query
def decode_gate(s, d):
    return calibrate.decode(_perm_rows(s, d), 0.6, ban_identity=True).select("id", _fmt())


@query
def tau_curve(s, d):
    return calibrate.tau_curve(_perm_rows(s, d)).select("tau", F.round("em", 6).alias("em"))


@query
def calibrate_tau(s, d):
    return calibrate.calibrate(_perm_rows(s, d)).select("tau", F.round("em", 6).alias("em"))


@query
def decode_ablation(s, d):
    return calibrate.ablation(_perm_rows(s, d)).select("ban_identity", "gate", F.round("em", 6).alias("em"))


@query
def perm_accuracy(s, d):
    return calibrate.permutation_accuracy(_perm_rows(s, d)).select(F.round("perm_acc", 6).alias("perm_acc"))


@query
def ordering_head(s, d):
    """A note of every epoch of training the head on the samples' embeddings; val is three ids in ten."""
    e = fx.embeddings(s, d)
    near = vectors.embedding_scalars(e, _FRAMES, _EVENTS).groupBy("id").agg(*[F.max(F.when(F.col("frame") == i, F.col(c))).alias(f"{c}{i}") for i in range(4) for c in vectors.SCALARS])
    scalars = [[F.col(f"{c}{i}") for c in vectors.SCALARS] for i in range(4)]
    fold = F.when(F.col("id") % 10 < 3, "val").otherwise("train")
    e = e.join(near, "id")
    rows = e.select("id", fold.alias("fold"), orderhead.inputs([F.col(c) for c in _FRAMES], [F.col(c) for c in _EVENTS], F.col("e7"), scalars).alias("inputs"), F.expr(fx.TRUTH_AT).cast("int").alias("target"), F.when(F.col("id") % 11 == 0, 0.5).otherwise(1.0).alias("weight"))
    notes = orderhead.train(rows).history
    out = s.createDataFrame([(n["epoch"], n["loss"], n["em"], n["tau"], n["perm_acc"], n["best"]) for n in notes], "epoch long, loss double, val_em double, tau double, perm_acc double, best boolean")
    return out.select("epoch", F.round("loss", 6).alias("loss"), F.round("val_em", 6).alias("val_em"), "tau", F.round("perm_acc", 6).alias("perm_acc"), "best")


_FRAMES, _EVENTS = [f"e{i}" for i in range(4)], [f"e{i}" for i in range(4, 7)]


@query
def embedding_scalars(s, d):
    x = vectors.embedding_scalars(fx.embeddings(s, d), _FRAMES, _EVENTS)
    return x.select("id", "frame", *[F.round(c, 6).alias(c) for c in vectors.SCALARS])


@query
def semantic_features(s, d):
    x = vectors.semantic_features(fx.embeddings(s, d), _FRAMES, _EVENTS, "e7")
    return x.select("id", *[c if c == "fe_collision" else F.round(c, 6).alias(c) for c in vectors.SEMANTIC])


# ---- frames, submission, budget ---------------------------------------------------------------------------


@query
def gray_stats(s, d):
    g = frames.features(fx.frames(s, d), hashes=False)
    return g.select("id", F.round("std", 6).alias("std"), F.round("entropy", 6).alias("entropy"), "low_info", long("width"), long("height"))


@query
def letterbox(s, d):
    return frames.features(fx.frames(s, d), hashes=False).select("id", long("top"), long("bottom"), long(F.col("height") - F.col("top") - F.col("bottom"), "rows_left"))


@query
def pixel_cap(s, d):
    p = tables.table(s, d, "part").select(F.col("p_partkey").alias("id"), (100 + F.col("p_partkey") % 1900).cast("int").alias("w"), (80 + F.col("p_size") * 20).cast("int").alias("h"))
    w, h = A.cap_pixels(F.col("w"), F.col("h"))
    return p.select("id", long(w, "width"), long(h, "height"))


@query
def phash_pairs(s, d):
    """Frames 4k to 4k + 3 are a sample; its six pairs, or those it has."""
    g = frames.features(fx.frames(s, d)).groupBy(F.floor(F.col("id") / 4).alias("sample")).agg(*[F.max(F.when(F.pmod("id", F.lit(4)) == i, F.col("phash"))).alias(f"h{i}") for i in range(4)])
    pairs = zip(itertools.combinations(range(4), 2), image.pair_distances([F.col(f"h{i}") for i in range(4)]), strict=True)
    x = g.select("sample", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), long(dist, "distance")) for (i, j), dist in pairs])))
    return x.filter("distance is not null").select(long(F.col("sample") * 4 + F.col("i"), "id"), long(F.col("sample") * 4 + F.col("j"), "mate"), "distance")


@query
def resume_anti_join(s, d):
    jobs = fx.votes(s, d).select("id", "perm")
    done = fx.votes(s, d).filter("view < 2").select("id", "perm")
    return tables.pending(jobs, done).select("id", P.format_rank(F.transform("perm", lambda x: x + 1)).alias("view"))


def _test(s, d):
    return fx.truth(s, d).filter("fold = 'test'").select(F.col("id").alias("pos"), "id")


@query
def submission_rows(s, d):
    return tables.submission(_test(s, d), _decided(s, d))


@query
def submission_check(s, d):
    return tables.submission_report(_test(s, d), tables.submission(_test(s, d), _decided(s, d)))


@query
def budget_estimate(s, d):
    t = tables.table(s, d, "part").select((F.col("p_partkey") - 1).alias("pos"), (F.col("p_size") + 1.5).alias("seconds"))
    return metrics.budget_estimate(t)


@query
def describe_hard_score(s, d):
    out = metrics.summary(hardcases.hard_cases(fx.truth(s, d), _decided(s, d)), "hard_score")
    return out.select("count", *[F.round(c, 6).alias(c) for c in out.columns if c != "count"])


@query
def noise_policy(s, d):
    g = frames.features(fx.frames(s, d), hashes=False).groupBy(F.col("low_info").alias("noise_flag")).agg(F.count(F.lit(1)).alias("n"))
    g = tables.saved(g)  # frames are measured once; a row a flag
    parts = [calibrate.noise_policy(g, p).agg(F.lit(p).alias("policy"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("weight") * F.col("n")).alias("weight")) for p in "abc"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def quality_rows(s, d):
    """(id, n_chars, n_words, n_lines, label) of the labelled documents."""
    n = lambda pattern: F.size(F.split("text", pattern)).cast("double")
    docs = tables.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("double").alias("n_chars"), n(r"\s+").alias("n_words"), n(r"\n").alias("n_lines"))
    lab = tables.table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return docs.join(lab, "id")


@query
def stratified_cv_auc(s, d):
    out = classify.cross_validate(quality_rows(s, d), ["n_chars", "n_words", "n_lines"])
    return out.select(long("fold"), F.round("auc", 6).alias("auc"), F.round("f1", 6).alias("f1"))
