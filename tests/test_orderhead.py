"""The ordering head: gradient, loss and training against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import arrays as A
from tesserae.functions.perm import PERMS, rank_at
from tesserae.operators import calibrate, orderhead

SCHEMA = "id long, fold string, inputs array<array<double>>, target int, weight double"


def samples(n, seed, width=6, noise=0.3):
    """The rank of a frame shows in its first numbers; the identity, in a number of the caption."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        t = 0 if i % 5 == 0 else int(rng.integers(1, 24))
        x = rng.normal(0, noise, (4, width))
        for f in range(4):
            x[f, 0] += PERMS[t][f] - 2.5
            x[f, 1] += 2.0 if t == 0 else -1.0
        out.append((i, "val" if i % 4 == 0 else "train", x.tolist(), t, 1.0 if i % 3 else 0.5))
    return out


def plain_loss(p, rows, pos_weight, s):
    """The loss from its formula, sample by sample."""
    gate, perm, frame, some = 0.0, 0.0, 0.0, 0
    for _, _, x, t, w in rows:
        h = np.tanh(np.array(x, dtype=np.float32).astype(float) @ p["w1"] + p["b1"])
        logits, g = h @ p["w2"] + p["b2"], np.tanh(h.mean(0) @ p["g1"] + p["c1"]) @ p["g2"][:, 0] + p["c2"][0]
        q = 1 / (1 + np.exp(-g))
        gate -= w * (pos_weight * np.log(q) if t == 0 else np.log(1 - q))
        if t:
            some += 1
            ls = logits - np.log(np.exp(logits).sum(1, keepdims=True))
            sc = np.array([sum(ls[i][r[i] - 1] for i in range(4)) for r in PERMS])
            sc -= np.log(np.exp(sc).sum())
            perm -= w * ((1 - s.smoothing) * sc[t] + s.smoothing * sc.mean())
            frame -= w * np.mean([ls[i][PERMS[t][i] - 1] for i in range(4)])
    return s.gate_w * gate / max(len(rows), 1) + (perm + s.aux_w * frame) / max(some, 1)


def test_gradient_is_that_of_the_loss(spark):
    s = orderhead.Settings(hidden=5, gate_hidden=3, steps=1, groups=2)
    rows = [(i, "train", *r[2:]) for i, r in enumerate(samples(40, 1))]
    p = orderhead.first_params(6, s)
    blocks = orderhead.packed_rows(spark.createDataFrame(rows, SCHEMA).repartition(3), 1)
    loss, g, n = orderhead.gradient(blocks, p, 2.5, s)
    assert n == 40 and loss == pytest.approx(plain_loss(p, rows, 2.5, s), abs=1e-9)
    for k, v in p.items():
        for at in list(np.ndindex(v.shape))[::7]:
            near = []
            for step in (1e-5, -1e-5):
                q = {name: x.copy() for name, x in p.items()}
                q[k][at] += step
                near.append(plain_loss(q, rows, 2.5, s))
            assert g[k][at] == pytest.approx((near[0] - near[1]) / 2e-5, abs=1e-6)


def test_loss_is_the_engines(spark):
    s = orderhead.Settings(hidden=5, gate_hidden=3)
    rows = samples(60, 2)
    p = orderhead.first_params(6, s)
    x, target, w = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], dtype=np.int32), np.array([r[4] for r in rows])
    logits, gate, _ = orderhead.forward(p, x)
    sums, *_ = orderhead.loss_sums(logits, gate, target, w, 3.0, s)
    df = spark.createDataFrame([(z.tolist(), float(g), int(t), bool(t == 0), float(v)) for z, g, t, v in zip(logits, gate, target, w, strict=True)], "logits array<array<double>>, gate_logit double, target int, no_ordering boolean, weight double")
    df = df.withColumn("rank", rank_at(F.col("target"))).withColumn("scores", A.perm_scores(F.col("logits")))
    want = calibrate.multi_task_loss(df, pos_weight=3.0).first().loss
    some = (target != 0).sum()
    assert sums[0] / len(rows) + sums[1] / some + 0.5 * sums[2] / some == pytest.approx(want, abs=1e-9)


def test_training_is_that_of_one_process(spark):
    """Epochs over Spark equal the same epochs in one numpy loop, and val EM rises to what the data allow."""
    s = orderhead.Settings(hidden=16, gate_hidden=8, epochs=6, steps=2, rate=0.05, patience=9, groups=3)
    rows = samples(400, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    head = orderhead.train(df.repartition(4), s)
    assert [h["epoch"] for h in head.history] == list(range(6)) and head.history[-1]["em"] > 0.9 and head.history[0]["loss"] > head.history[-1]["loss"]
    assert head.history[-1]["perm_acc"] > 0.9 and sum(h["best"] for h in head.history) >= 1
    train = [r for r in rows if r[1] == "train"]
    steps = {r.id: r.k for r in df.select("id", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2)).alias("k")).collect()}
    p, opt, rng = orderhead.first_params(6, s), orderhead.AdamW(s.rate, s.decay, 12), np.random.default_rng(s.seed)
    none = sum(r[3] == 0 for r in train)
    pos_weight = (len(train) - none) / none
    for epoch in range(6):
        losses = []
        for k in rng.permutation(2):
            part = sorted(r for r in train if steps[r[0]] == k)
            x = np.array([r[2] for r in part], dtype=np.float32).astype(float)
            sums = orderhead.block_gradient(p, x, np.array([r[3] for r in part]), np.array([r[4] for r in part]), pos_weight, s)
            losses.append(plain_loss(p, part, pos_weight, s))
            size, g, at = sum(v.size for v in p.values()), {}, 0
            flat = s.gate_w * sums[5 : 5 + size] / sums[0] + sums[5 + size :] / sums[1]
            for name, v in p.items():
                g[name] = flat[at : at + v.size].reshape(v.shape)
                at += v.size
            p = opt.step(p, g)
        assert head.history[epoch]["loss"] == pytest.approx(np.mean(losses), rel=1e-6)


def test_training_stops_early_and_without_rows(spark):
    s = orderhead.Settings(hidden=4, gate_hidden=2, epochs=9, steps=1, rate=0.0, patience=2, min_epochs=1, groups=2)
    rows = samples(60, 4)
    head = orderhead.train(spark.createDataFrame(rows, SCHEMA), s)
    assert len(head.history) == 3 and head.history[0]["best"] and not head.history[2]["best"]  # no progress at a rate of nothing
    only_train = orderhead.train(spark.createDataFrame([(i, "train", *r[2:]) for i, r in enumerate(rows)], SCHEMA), orderhead.Settings(hidden=4, gate_hidden=2, epochs=2, steps=3))
    assert [h["em"] for h in only_train.history] == [None, None]
    nothing = orderhead.train(spark.createDataFrame([], SCHEMA), orderhead.Settings(hidden=4, gate_hidden=2, epochs=1))
    assert nothing.history[0]["loss"] is None
