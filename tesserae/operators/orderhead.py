"""Training of the ordering head: four frames, their events and caption to 4 x 4 rank logits and a gate.

The head is one hidden layer a frame, shared by the four, over the frame's vector, the caption, the mean
of the events and the frame's similarities; a linear map gives a frame's four rank logits, and
another hidden layer over the mean of the frames and the caption gives the gate's logit.  Its loss is that of
calibrate.multi_task_loss: weighted gate loss, smoothed loss of the 24 ranks, loss of the frames.

Training is synchronous: rows are written once, in as many parts as an epoch has steps (by a hash
of the id), as packed blocks of numbers.  A step reads its part only; every task adds up the gradient of its
rows, tasks are summed in groups, and the driver gets one sum a group: parameters, not rows.  Sums are taken in a fixed order, so a
run repeats.  The step is AdamW with a cosine rate.  After an epoch the val rows are scored by the same
head and decoded by calibrate; the parameters of the best val EM are kept, and training stops after
``patience`` epochs without progress (EM, then the accuracy of the rank alone).

Defined results: rows whose fold is neither train nor val take no part; a null or short vector is refused by
packing; with no train rows the first parameters stay; with no val rows all epochs run and the last ones stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import best_index, perm_scores
from ..functions.perm import PERMS
from ..sources.tables import discard, saved
from . import calibrate

N = 4
_RANKS = np.array(PERMS) - 1  #: (24, 4), a frame's rank from 0
ROWS = 512  #: samples of a block


@dataclass
class Settings:
    hidden: int = 48
    gate_hidden: int = 24
    epochs: int = 12
    steps: int = 2  #: of an epoch
    rate: float = 0.01
    decay: float = 0.01
    gate_w: float = 1.0
    aux_w: float = 0.5
    smoothing: float = 0.05
    patience: int = 4
    min_epochs: int = 4
    ban_identity: bool = False
    seed: int = 42
    groups: int = 16  #: sums that reach the driver a step


@dataclass
class Head:
    """Parameters by name, and what training noted of every epoch."""

    params: dict[str, np.ndarray]
    history: list[dict] = field(default_factory=list)


def first_params(width: int, s: Settings) -> dict[str, np.ndarray]:
    """``width`` is that of a frame's input; the gate sees the mean hidden layer of the frames."""
    rng = np.random.default_rng(s.seed)
    draw = lambda a, b: rng.normal(0, 1 / math.sqrt(a), (a, b))
    return {"w1": draw(width, s.hidden), "b1": np.zeros(s.hidden), "w2": draw(s.hidden, N) * 0.1, "b2": np.zeros(N), "g1": draw(s.hidden, s.gate_hidden), "c1": np.zeros(s.gate_hidden), "g2": draw(s.gate_hidden, 1) * 0.1, "c2": np.zeros(1)}


def forward(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(n, 4, 4) logits and (n,) gate logits of inputs (n, 4, width), and what the gradient needs."""
    h = np.tanh(x @ p["w1"] + p["b1"])
    pooled = h.mean(1)
    g = np.tanh(pooled @ p["g1"] + p["c1"])
    return h @ p["w2"] + p["b2"], (g @ p["g2"])[:, 0] + p["c2"][0], (h, pooled, g)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(-1, keepdims=True)
    return z - np.log(np.exp(z).sum(-1, keepdims=True))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def loss_sums(logits: np.ndarray, gate: np.ndarray, target: np.ndarray, weight: np.ndarray, pos_weight: float, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Summed losses (gate of all rows; ranks and frames of the orderable ones, unweighted by gate_w and aux_w), and their gradients by the gate logit and by the logits, split in two: (gate by gate logit), (ranks and frames by logits).  Target 0 is the identity: no ordering."""
    none = target == 0
    soft = np.logaddexp(0, -np.abs(gate)) + np.maximum(gate, 0)  # log(1 + e^gate)
    gate_loss = np.where(none, pos_weight * (soft - gate), soft) * weight
    by_gate = np.where(none, pos_weight * (_sigmoid(gate) - 1), _sigmoid(gate)) * weight
    ls = _log_softmax(logits)
    scores = ls[:, np.arange(N)[None, :], _RANKS].sum(2)  # (n, 24)
    sc = _log_softmax(scores)
    goal = np.full(sc.shape, s.smoothing / len(_RANKS))
    goal[np.arange(len(goal)), target] += 1 - s.smoothing
    w = np.where(none, 0.0, weight)
    perm_loss = -(goal * sc).sum(1) * w
    chosen = _RANKS[target]
    frame_loss = -np.take_along_axis(ls, chosen[:, :, None], 2)[:, :, 0].mean(1) * w
    by_scores = (np.exp(sc) - goal) * w[:, None]
    by_ls = np.zeros_like(ls)
    for k, rank in enumerate(_RANKS):
        by_ls[:, np.arange(N), rank] += by_scores[:, k, None]
    one = np.zeros_like(ls)
    np.put_along_axis(one, chosen[:, :, None], 1.0, 2)
    by_ls -= one * (s.aux_w * w / N)[:, None, None]
    by_logits = by_ls - np.exp(ls) * by_ls.sum(-1, keepdims=True)
    return np.array([gate_loss.sum(), perm_loss.sum(), frame_loss.sum()]), by_gate, by_logits


def backward(p: dict[str, np.ndarray], x: np.ndarray, kept: tuple, by_logits: np.ndarray, by_gate: np.ndarray) -> dict[str, np.ndarray]:
    """Summed gradients by every parameter."""
    h, pooled, g = kept
    by_g = by_gate[:, None] * p["g2"][:, 0] * (1 - g * g)
    by_h = by_logits @ p["w2"].T + (by_g @ p["g1"].T)[:, None, :] / N
    by_z = by_h * (1 - h * h)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    return {
        "w1": flat(x).T @ flat(by_z), "b1": flat(by_z).sum(0), "w2": flat(h).T @ flat(by_logits), "b2": flat(by_logits).sum(0),
        "g1": pooled.T @ by_g, "c1": by_g.sum(0), "g2": g.T @ by_gate[:, None], "c2": np.array([by_gate.sum()]),
    }


def block_gradient(p: dict[str, np.ndarray], x: np.ndarray, target: np.ndarray, weight: np.ndarray, pos_weight: float, s: Settings) -> np.ndarray:
    """[rows, orderable rows, three losses, gradient of the gate loss, gradient of the others], summed over a block.

    The two gradients stay apart because one is divided by all rows, the other by the orderable ones.
    """
    logits, gate, kept = forward(p, x)
    losses, by_gate, by_logits = loss_sums(logits, gate, target, weight, pos_weight, s)
    parts = (backward(p, x, kept, np.zeros_like(by_logits), by_gate), backward(p, x, kept, by_logits, np.zeros_like(by_gate)))
    return np.concatenate(([len(x), (target != 0).sum()], losses, *[part[k].ravel() for part in parts for k in p]))


def packed_rows(rows: DataFrame, steps: int) -> DataFrame:
    """(fold, step, n, ids, x, target, weight): blocks of at most ROWS samples of (id, fold, inputs array<array<double>> 4 x width, target, weight)."""

    def run(batches):
        import pyarrow as pa

        names = ["fold", "step", "n", "ids", "x", "target", "weight"]
        for b in batches:
            fold, step = np.array(b.column("fold").to_pylist(), dtype=object), b.column("step").to_numpy()
            for key in sorted({*zip(fold.tolist(), step.tolist(), strict=True)}):
                at = np.flatnonzero((fold == key[0]) & (step == key[1]))
                for lo in range(0, len(at), ROWS):
                    part = b.take(pa.array(at[lo : lo + ROWS]))
                    order = np.argsort(part.column("id").to_numpy(), kind="stable")  # sums in a fixed order
                    x = part.column("inputs").flatten().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, N, -1)[order]
                    pick = lambda c: part.column(c).to_numpy(zero_copy_only=False)[order]  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([pick("id").astype(np.int64).tobytes()], pa.binary()), pa.array([x.astype(np.float32).tobytes()], pa.binary()), pa.array([pick("target").astype(np.int32).tobytes()], pa.binary()), pa.array([pick("weight").astype(np.float64).tobytes()], pa.binary())], names=names)

    step = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(steps)).cast("int")
    spread = max(1, -(-rows.count() // (16 * ROWS)))  # tasks that read a part grow with the rows
    some = rows.filter("fold in ('train', 'val')").select("id", "fold", F.when(F.col("fold") == "train", step).otherwise(-1).cast("int").alias("step"), "inputs", "target", "weight")
    return some.repartition("fold", "step", F.pmod(F.xxhash64("id"), F.lit(spread))).sortWithinPartitions("fold", "step", "id").mapInArrow(run, "fold string, step int, n int, ids binary, x binary, target binary, weight binary")


def _unpacked(b, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = b.column("n")[i].as_py()
    x = np.frombuffer(b.column("x")[i].as_py(), dtype=np.float32).reshape(n, N, -1).astype(np.float64)
    return x, np.frombuffer(b.column("target")[i].as_py(), dtype=np.int32), np.frombuffer(b.column("weight")[i].as_py(), dtype=np.float64)


def gradient(blocks: DataFrame, p: dict[str, np.ndarray], pos_weight: float, s: Settings) -> tuple[float, dict[str, np.ndarray], int]:
    """(loss, gradient, rows) of the mean loss over blocks: summed in tasks, then in ``groups``, then here."""

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = 0
        for b in batches:
            for i in range(b.num_rows):
                total = total + block_gradient(p, *_unpacked(b, i), pos_weight, s)
        if not isinstance(total, int):
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part % s.groups], pa.int32()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["grp", "part", "sums"])

    def join(t):
        import pyarrow as pa

        t = t.sort_by("part")
        total = np.sum([np.frombuffer(x) for x in t["sums"].to_pylist()], axis=0)
        return pa.table({"grp": t["grp"][:1], "part": t["part"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "grp int, part int, sums binary"
    got = blocks.select("n", "x", "target", "weight").mapInArrow(task, schema).groupBy("grp").applyInArrow(join, schema).collect()  # ``groups`` rows
    size = sum(v.size for v in p.values())
    total = np.sum([np.frombuffer(r.sums) for r in sorted(got, key=lambda r: r.grp)], axis=0) if got else np.zeros(5 + 2 * size)
    n, some = max(total[0], 1), max(total[1], 1)
    loss = s.gate_w * total[2] / n + total[3] / some + s.aux_w * total[4] / some
    flat, out, at = s.gate_w * total[5 : 5 + size] / n + total[5 + size :] / some, {}, 0
    for k, v in p.items():
        out[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return float(loss), out, int(total[0])


def predict(blocks: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """(id, logits, gate, target) of the samples in blocks; the gate as a probability."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                x, target, _ = _unpacked(b, i)
                logits, gate, _ = forward(p, x)
                inner = pa.ListArray.from_arrays(np.arange(0, logits.size + 1, N, dtype=np.int32), logits.ravel())
                outer = pa.ListArray.from_arrays(np.arange(0, N * len(x) + 1, N, dtype=np.int32), inner)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b.column("ids")[i].as_py(), dtype=np.int64)), outer, pa.array(_sigmoid(gate)), pa.array(target)], names=["id", "logits", "gate", "target"])

    return blocks.select("n", "ids", "x", "target", "weight").mapInArrow(run, "id long, logits array<array<double>>, gate double, target int")


def evaluate(scored: DataFrame, ban_identity: bool = False) -> dict:
    """{tau, em, perm_acc} of scored rows (logits, gate, target): the first best threshold, and the accuracy of the rank alone over orderable rows."""
    rows = saved(scored.select("gate", "target", perm_scores(F.col("logits")).alias("scores")))
    best = calibrate.calibrate(rows, ban_identity).first()
    hit = (best_index(F.col("scores"), ban_identity) == F.col("target")).cast("int")
    acc = rows.filter("target <> 0").agg(F.avg(hit)).first()[0]
    discard(rows)
    return {"tau": best.tau, "em": best.em, "perm_acc": acc}


class AdamW:
    def __init__(self, rate: float, decay: float, steps: int) -> None:
        self.rate, self.decay, self.steps, self.at, self.m, self.v = rate, decay, max(1, steps), 0, {}, {}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        rate = self.rate * 0.5 * (1 + math.cos(math.pi * min(self.at, self.steps) / self.steps))
        self.at += 1
        out = {}
        for k, x in p.items():
            self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * g[k]
            self.v[k] = 0.999 * self.v.get(k, 0.0) + 0.001 * g[k] ** 2
            m, v = self.m[k] / (1 - 0.9**self.at), self.v[k] / (1 - 0.999**self.at)
            out[k] = x * (1 - rate * self.decay) - rate * m / (np.sqrt(v) + 1e-8)
        return out


def train(rows: DataFrame, s: Settings | None = None) -> Head:
    """The head with the best val EM over rows (id, fold, inputs, target, weight); target is the rank's number, 0 the identity."""
    s = s or Settings()
    blocks = saved(packed_rows(rows, s.steps))
    counts = rows.filter("fold = 'train'").agg(F.count(F.lit(1)), F.count_if(F.col("target") == 0), F.max(F.size(F.get("inputs", F.lit(0))))).first()
    width = counts[2] or rows.agg(F.max(F.size(F.get("inputs", F.lit(0))))).first()[0] or 1
    pos_weight = (counts[0] - counts[1]) / max(counts[1], 1)
    head, train_, val = Head(first_params(width, s)), blocks.filter("fold = 'train'"), blocks.filter("fold = 'val'")
    has_val, step, rng = not val.isEmpty(), AdamW(s.rate, s.decay, s.epochs * s.steps), np.random.default_rng(s.seed)
    p, best, progress, left = head.params, -1.0, -1.0, s.patience
    for epoch in range(s.epochs):
        losses = []
        for k in rng.permutation(s.steps):
            loss, g, n = gradient(train_.filter(F.col("step") == int(k)), p, pos_weight, s)
            if n:
                p, losses = step.step(p, g), [*losses, loss]
        note = {"epoch": epoch, "loss": float(np.mean(losses)) if losses else None}
        if not has_val:
            head.params = p
            head.history.append(note | {"em": None, "tau": None, "perm_acc": None, "best": epoch == s.epochs - 1})
            continue
        note |= evaluate(predict(val, p), s.ban_identity)
        note["best"] = note["em"] > best
        if note["best"]:
            best, head.params = note["em"], p
        now = note["em"] + 0.1 * (note["perm_acc"] or 0.0)
        if now > progress + 1e-6:
            progress, left = now, s.patience
        elif epoch + 1 >= s.min_epochs:
            left -= 1
        head.history.append(note)
        if left <= 0:
            break
    discard(blocks)
    return head


def inputs(frames: list[Column], events: list[Column], caption: Column, scalars: list[list[Column]]) -> Column:
    """array<array<double>>: what the head sees of each frame: its vector, the caption's, the mean of the events', and the frame's scalars."""
    double = lambda v: v.cast("array<double>")
    mean = F.transform(double(events[0]), lambda x: x / float(len(events)))
    for e in events[1:]:
        mean = F.zip_with(mean, double(e), lambda a, b: a + b / float(len(events)))
    return F.array(*[F.concat(double(f), double(caption), mean, F.array(*[x.cast("double") for x in s])) for f, s in zip(frames, scalars, strict=True)])
