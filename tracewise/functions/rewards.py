"""Reward functions: numbers from scores, all built-in expressions.

Null in, null out. Where `greatest` would skip a null or keep a NaN, a guard gives the defined value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewise.functions import text as X


def num(c: Column) -> Column:
    """As a number; what is none is null. NaN and infinities stay."""
    return c.try_cast("double")


def finite(c: Column) -> Column:
    """As a finite number, else null."""
    v = num(c)
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def clamp01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def check_kappa(kappa: float) -> float:
    if not 0 <= kappa < 1:
        raise ValueError(f"kappa must be in [0, 1): {kappa}")
    return kappa


def scale_reward(c: Column, kappa: float = 0.0) -> Column:
    """max(0, c - kappa) / (1 - kappa); NaN gives 0."""
    check_kappa(kappa)
    return F.when(F.isnan(c), F.lit(0.0)).when(c.isNotNull(), F.greatest(F.lit(0.0), c - kappa) / (1.0 - kappa))


def nli_heuristic(e_ab: Column, e_ba: Column, c_ab: Column, c_ba: Column) -> Column:
    """Mean entailment less the larger contradiction, not clamped."""
    worst = F.when(c_ab.isNotNull() & c_ba.isNotNull(), F.greatest(c_ab, c_ba))
    return 0.5 * e_ab + 0.5 * e_ba - worst


def _calm(mean: Column, c_ab: Column, c_ba: Column) -> Column:
    return clamp01(mean - 0.5 * F.when(c_ab.isNotNull() & c_ba.isNotNull(), F.greatest(c_ab, c_ba)))


def nli_coverage(e_ab: Column, e_ba: Column, c_ab: Column, c_ba: Column) -> Column:
    """Entailment, the forward one weighing more, less half the larger contradiction; in [0, 1]."""
    return _calm(0.7 * e_ab + 0.3 * e_ba, c_ab, c_ba)


def nli_equiv(e_ab: Column, e_ba: Column, c_ab: Column, c_ba: Column) -> Column:
    """Mean entailment less half the larger contradiction; in [0, 1]."""
    return _calm(0.5 * e_ab + 0.5 * e_ba, c_ab, c_ba)


def nli_features(e_ab: Column, e_ba: Column, c_ab: Column, c_ba: Column, n_ab: Column, n_ba: Column) -> Column:
    """(E_ab, E_ba, C_max, N_max); null if any input is."""
    parts = (e_ab, e_ba, c_ab, c_ba, n_ab, n_ba)
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known &= p.isNotNull()
    return F.when(known, F.array(e_ab, e_ba, F.greatest(c_ab, c_ba), F.greatest(n_ab, n_ba)))


def logistic_score(features: Column, weights: tuple[float, ...], bias: float) -> Column:
    terms = [w * features[i] for i, w in enumerate(weights)]
    return sigmoid(sum(terms[1:], terms[0]) + bias)


def pair_type(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    return F.when(t.isin("positive", "positive_pair"), "positive").when(t.isin("negative", "negative_pair"), "negative").otherwise(t)


def reward_value(scorer: Column, field: Column, raw: Column, heuristic: Column) -> Column:
    """The reward of a score field: NLI by its heuristic, the reranker by a sigmoid, others as they are."""
    return F.when((scorer == "nli") & (field == "nli_heuristic"), heuristic).when((scorer == "bge_reranker") & (field == "sigmoid_raw_score"), sigmoid(raw)).otherwise(raw)


def accuracy_reward(solution: Column, truth: Column) -> Column:
    """1 for equal normalised answers, or first numbers that are close; else 0."""
    p, t = X.normalize_answer(solution), X.normalize_answer(truth)
    a, b = X.first_number(solution), X.first_number(truth)
    near = F.abs(a - b) <= F.greatest(1e-4 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-6), F.abs(b) * 1e-4)
    return F.when((p == "") | (t == ""), 0.0).when(p == t, 1.0).when(a.isNotNull() & b.isNotNull() & near, 1.0).otherwise(0.0)


def format_reward(solution: Column) -> Column:
    """1 with an answer tag or ####, 0.5 for other text, 0 for none."""
    plain = X.coerce_text(solution)
    tagged = plain.rlike(r"####\s*\S+")
    for t in X.ANSWER_TAGS:
        tagged |= plain.rlike(f"(?s)<{t}>.*?</{t}>")
    return F.when(plain == "", 0.0).when(tagged, 1.0).otherwise(0.5)


def composite_reward(solution: Column, truth: Column, components: tuple[str, ...] = ("accuracy", "format")) -> Column:
    """The mean of the named components; 0 without any."""
    known = {"accuracy": lambda: accuracy_reward(solution, truth), "format": lambda: format_reward(solution)}
    if bad := [c for c in components if c not in known]:
        raise ValueError(f"unknown reward component: {bad[0]}")
    parts = [known[c]() for c in components]
    return sum(parts[1:], parts[0]) / len(parts) if parts else F.lit(0.0)


def log_loss(p: Column, label: Column, epsilon: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(epsilon)), F.lit(1.0 - epsilon))
    return F.when(label == 1, -F.ln(q)).otherwise(-F.ln(1.0 - q))


def margin_prediction(p: Column, threshold: float = 0.0) -> Column:
    """1 if the margin p - (1 - p) is above threshold, else -1."""
    return F.when(p - (1.0 - p) > threshold, 1).otherwise(-1)


def max_steps(budget: int, seq_len: int, batch: int = 1, accumulate: int = 1, world: int = 1) -> int:
    """Optimizer steps that a token budget fills."""
    return math.ceil(budget / (seq_len * batch * accumulate * world))


def noisy_or(weights: Column) -> Column:
    """1 - prod(1 - w) over an array."""
    return 1.0 - F.aggregate(weights, F.lit(1.0), lambda a, w: a * (1.0 - w))


def f_beta(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0))


def tau_score(c: Column, tau: float, mode: str = "scaled") -> Column:
    """A score by threshold: none as it is, hard 0 below tau, scaled as the share of the way from tau to 1."""
    if not 0 <= tau < 1:
        raise ValueError(f"tau must be in [0, 1): {tau}")
    if mode == "none":
        return c
    if mode == "hard":
        return F.when(c >= tau, c).when(c.isNotNull(), F.lit(0.0))
    if mode == "scaled":
        return scale_reward(c, tau)
    raise ValueError(f"unknown mode: {mode}")


def coverage_recall(weights: Column) -> Column:
    """Of an array of rows of edge weights, a row for each reference segment: the mean of their noisy-or; 0 without rows."""
    total = F.aggregate(F.transform(weights, noisy_or), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(total, F.size(weights).cast("double")), F.lit(0.0))


def support_precision(weights: Column) -> Column:
    """Of the same array: the mean over candidate segments of their best weight; 0 without candidates."""
    columns = F.transform(F.sequence(F.lit(0), F.size(F.get(weights, 0)) - 1), lambda j: F.array_max(F.transform(weights, lambda row: F.get(row, j))))
    total = F.aggregate(columns, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.coalesce(F.size(F.get(weights, 0)), F.lit(0)) > 0, total / F.size(columns)).otherwise(0.0)


def compute_score(data_source: Column, solution: Column, truth: Column, extra_info: Column | None = None, components: tuple[str, ...] = ("accuracy", "format")) -> Column:
    """The reward function that trainers call: the mean of components. extra_info may name a row's own, as an array `components`; an unknown one raises. data_source is not used."""
    if extra_info is None:
        return composite_reward(solution, truth, components)
    own = F.coalesce(extra_info.getField("components"), F.array(*[F.lit(c) for c in components]))
    known = F.create_map(F.lit("accuracy"), accuracy_reward(solution, truth), F.lit("format"), format_reward(solution))
    wrong = F.exists(own, lambda c: ~F.map_contains_key(known, c))
    total = F.aggregate(own, F.lit(0.0), lambda a, c: a + F.coalesce(F.try_element_at(known, c), F.lit(0.0)))
    return F.when(wrong, F.raise_error(F.lit("unknown reward component")).cast("double")).when(F.size(own) > 0, total / F.size(own)).otherwise(0.0)


def unit_interval(name: str, value: float, open_end: bool = False) -> float:
    """A number in [0, 1], or below 1 with open_end; else ValueError."""
    if not 0 <= value <= 1 or (open_end and value == 1):
        raise ValueError(f"{name} must be in [0, 1{')' if open_end else ']'}: {value}")
    return value


def ratio(text: str | float) -> float:
    """A number in (0, 1], else ValueError."""
    value = float(text)
    if not 0 < value <= 1:
        raise ValueError(f"a ratio must be in (0, 1]: {value}")
    return value


def positive_int(text: str | int) -> int:
    value = int(text)
    if value <= 0:
        raise ValueError(f"a count must be positive: {value}")
    return value
