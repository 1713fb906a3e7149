"""Gate decoding over permutation scores, threshold calibration and the decode ablation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import best_index, frame_loss, gate_loss, perm_nll
from ..functions.perm import rank_at

TAUS = [round(0.02 * i, 2) for i in range(51)] + [1.1]


def decode(rows: DataFrame, tau: float, ban_identity: bool = True) -> DataFrame:
    """rows (id, scores, gate, …) plus (at, rank): identity where the gate exceeds tau, else the best rank."""
    at = F.when(F.col("gate") > tau, 0).otherwise(best_index(F.col("scores"), ban_identity))
    return rows.withColumn("at", at).withColumn("rank", rank_at(F.col("at")))


def tau_curve(rows: DataFrame, taus: list[float] = TAUS, ban_identity: bool = True) -> DataFrame:
    """(tau, em) over rows (scores, gate, target): the hits are computed once, each tau is one aggregate."""
    x = rows.select("gate", (best_index(F.col("scores"), ban_identity) == F.col("target")).cast("int").alias("hit"), (F.col("target") == 0).cast("int").alias("id_hit"))
    row = x.agg(*[F.avg(F.when(F.col("gate") > t, F.col("id_hit")).otherwise(F.col("hit"))).alias(f"t{i}") for i, t in enumerate(taus)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"t{i}").alias("em")) for i, t in enumerate(taus)])))


def calibrate(rows: DataFrame, ban_identity: bool = True) -> DataFrame:
    """(tau, em): the first tau of the greatest EM."""
    best = tau_curve(rows, ban_identity=ban_identity).agg(F.max(F.struct("em", (-F.col("tau")).alias("low"))).alias("b"))
    return best.select((-F.col("b.low")).alias("tau"), F.col("b.em").alias("em"))


def ablation(rows: DataFrame) -> DataFrame:
    """(ban_identity, gate, em) with the gate off (tau 1.1) and at its best tau."""
    out = None
    for ban in (False, True):
        curve = tau_curve(rows, ban_identity=ban)
        part = curve.agg(F.max(F.when(F.col("tau") > 1, F.col("em"))).alias("off"), F.max("em").alias("on")).select(F.inline(F.array(*[F.struct(F.lit(ban).alias("ban_identity"), F.lit(g).alias("gate"), F.col("on" if g else "off").alias("em")) for g in (False, True)])))
        out = part if out is None else out.unionByName(part)
    return out


def permutation_accuracy(rows: DataFrame) -> DataFrame:
    """EM of the best rank alone over orderable rows."""
    hit = (best_index(F.col("scores"), False) == F.col("target")).cast("int")
    return rows.filter("target <> 0").agg(F.avg(hit).alias("perm_acc"))


def multi_task_loss(rows: DataFrame, pos_weight: float = 1.0, gate_w: float = 1.0, aux_w: float = 0.5, smoothing: float = 0.05) -> DataFrame:
    """(loss) over rows (logits, scores, gate_logit, rank, target, no_ordering, weight): the weighted gate loss of all rows
    plus, over the orderable ones, the smoothed loss of the 24 ranks and aux_w times that of the frames."""
    w, orderable = F.col("weight"), ~F.col("no_ordering")
    gate = F.avg(gate_loss(F.col("gate_logit"), F.col("no_ordering"), pos_weight) * w)
    perm = F.avg(F.when(orderable, perm_nll(F.col("scores"), F.col("target"), smoothing) * w))
    frame = F.avg(F.when(orderable, frame_loss(F.col("logits"), F.col("rank")) * w))
    none = F.lit(0.0)
    return rows.agg((gate * gate_w + F.coalesce(perm, none) + aux_w * F.coalesce(frame, none)).alias("loss"))


def noise_policy(rows: DataFrame, policy: str) -> DataFrame:
    """a drops flagged rows, b gives them half weight, c keeps them."""
    if policy == "a":
        return rows.filter(~F.col("noise_flag")).withColumn("weight", F.lit(1.0))
    if policy not in ("b", "c"):
        raise ValueError("policy must be a, b or c")
    return rows.withColumn("weight", F.when(F.col("noise_flag") & F.lit(policy == "b"), 0.5).otherwise(1.0))
