"""Scores of answers, formats and policies as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Eleven thresholds from 0.5 to 0.95 in equal steps.
ACCURACY_STEPS = tuple(0.5 + 0.045 * i for i in range(11))


def kl(logp: Column, reference: Column, kind: str) -> Column:
    """Estimators of the divergence of two log-probabilities."""
    d = logp - reference
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        r = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), -d))
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(r) - r - 1))
    raise ValueError(f"no such estimator: {kind}")


def policy_loss(new: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> tuple[Column, Column]:
    """The clipped loss, bounded again where the advantage is negative; and whether the clip took effect."""
    ratio = F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), new - old)))
    plain = -advantage * ratio
    bound = -advantage * F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio))
    worse = F.greatest(plain, bound)
    return F.when(advantage < 0, F.least(worse, -advantage * dual)).otherwise(worse), plain < bound


def value_loss(pred: Column, returns: Column, old: Column, clip: float) -> tuple[Column, Column]:
    """The larger squared error of a prediction and of the one held near the old value; and whether the clip took effect."""
    held = F.greatest(old - clip, F.least(old + clip, pred))
    plain, bound = (pred - returns) * (pred - returns), (held - returns) * (held - returns)
    return F.greatest(plain, bound), plain < bound


def count_reward(pred: Column, target: Column) -> Column:
    e = F.abs(pred - target)
    return F.when(e <= 1e-6, 1.0).when(e <= 1.0, 0.3).when(e <= 2.0, 0.1).otherwise(0.0)


def relative_accuracy(pred: Column, target: Column) -> Column:
    """Share of the thresholds that one less the relative error reaches; 0 for what is no number."""
    e = F.abs(pred - target) / F.greatest(target, F.lit(1e-9))
    hits = [F.when(e <= 1 - t, 1.0).otherwise(0.0) for t in ACCURACY_STEPS]
    return F.coalesce(sum(hits[1:], hits[0]) / len(hits), F.lit(0.0))


def direction_reward(got: Column, want: Column) -> Column:
    """1 for equal direction sets."""
    return F.when(got == want, 1.0).otherwise(0.0)


def partial_direction_reward(got: Column, want: Column) -> Column:
    """Equal sets 1; two of three 1; one of two 0.1."""
    inside = F.size(F.array_except(got, want)) == 0
    return (
        F.when((F.size(got) == 0) | (F.size(want) == 0), 0.0)
        .when(got == want, 1.0)
        .when((F.size(want) == 3) & (F.size(got) == 2) & inside, 1.0)
        .when((F.size(want) == 2) & (F.size(got) == 1) & inside, 0.1)
        .otherwise(0.0)
    )


def validity_factor(task: Column, is_valid: Column, truth: Column, number: Column) -> Column:
    """How much a question is worth, by its task and true answer."""
    token = F.regexp_replace(F.translate(F.lower(F.trim(F.coalesce(truth, F.lit("")))), "- ", "__"), "_+", "_")
    return (
        F.when(~is_valid | (task == "unknown"), 0.0)
        .when(task == "object_counting", F.when(number == 0, 0.0).when(number == 1, 0.5).otherwise(1.0))
        .when(task == "depth_order_obj_obj", F.when(token == "same", 0.5).otherwise(1.0))
        .when(task == "elevation_cam_cam", F.when(token == "same_level", 0.0).otherwise(1.0))
        .when(task == "visibility_compare", F.when(token.isin("same", "neither"), 0.5).otherwise(1.0))
        .otherwise(1.0)
    )


def format_factor(response: Column, score: Column, questions: Column) -> Column:
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))))
    return F.when((F.trim(F.coalesce(response, F.lit(""))) == "") | (questions > 1), 0.0).otherwise(clamped)


def first_round(fmt: Column, valid: Column, observation: Column, eligible: Column, broken: Column, floor: float = 0.1) -> Column:
    """Format and gated observation; -1 for a broken answer."""
    seen = F.when(eligible, F.greatest(F.lit(floor), observation)).otherwise(observation)
    return F.when(broken, -1.0).otherwise(fmt * 0.1 + valid * seen * 0.9)


def second_round(fmt: Column, content: Column, failed: Column) -> Column:
    return F.when(failed, -1.0).otherwise(0.1 * fmt + 0.9 * content)


def snap(score: Column, levels: tuple[float, ...] = (0.0, 0.3, 0.6, 1.0)) -> Column:
    """The nearest level, the lower of two equally near."""
    return F.array_min(F.array(*[F.struct(F.abs(score - v).alias("d"), F.lit(v).alias("v")) for v in levels]))["v"]


def next_coefficient(value: float, kl_now: float, target: float, horizon: float, steps: int) -> float:
    """The adaptive penalty's next coefficient; the error is held within a fifth."""
    error = max(-0.2, min(0.2, kl_now / target - 1))
    return value * (1 + error * steps / horizon)
