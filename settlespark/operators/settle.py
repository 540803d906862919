"""Settle detection: when a wave enters its final band and stays there.

Each rule needs only ``j``, the last position outside the band:

``hold``    target = median of the tail, |v - target| > tol is out,
            index j + M (M clean samples are required)
``exit``    target = mean of the tail, outside [target - tol, target + tol],
            index j + 1
``suffix``  target = mean of the last 10, band max(3 std, 1e-12),
            index j + 1
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlespark.functions.scalar import clamp_index, grid_scale, on_grid, tail_length
from settlespark.plans.skew import N, POS, Part
from settlespark.signals import Signals

LAST = 10          # samples behind the suffix rule's mean
MIN_BAND = 1e-12   # floor of the suffix rule's band


@dataclass(frozen=True)
class Rule:
    """A settle rule.

    ``tol`` is relative to the target, ``abs_tol`` a floor for the tolerance.
    ``anchor="exit"`` makes the hold rule report j + 1 instead of j + M.
    ``never_out="last"`` reports the last sample, not the first, for waves that
    never leave the band.
    """

    rule: str = "hold"
    tol: float = 0.01
    hold: int = 50
    tail: float = 0.1
    anchor: str = "hold"
    abs_tol: float = 0.0
    min_tail: int = 0
    never_out: str = "first"

    def __post_init__(self):
        for name, allowed in (
            ("rule", ("hold", "exit", "suffix")),
            ("anchor", ("hold", "exit")),
            ("never_out", ("first", "last")),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {getattr(self, name)!r}")


class Names:
    """Columns a rule adds to the samples; ``tag`` keeps two rules apart."""

    def __init__(self, tag: str = ""):
        self.target, self.tol = f"_target{tag}", f"_tol{tag}"
        self.last_out, self.index = f"_last_out{tag}", f"_settle_idx{tag}"
        self.gap = f"_gap{tag}"
        self.top, self.sum, self.squares, self.count = (
            f"_{name}{tag}" for name in ("top", "sum", "squares", "count"))


Rules = dict[str, Rule]  # by tag


def with_targets(part: Part, rules: Rules) -> Part:
    """Attach the target value and the tolerance of each rule.

    Means and deviations that decide about samples on the band come from exact
    integer sums, which no plan and no order of summation can change.
    """
    value, missing = part.value, part.sig.missing == "propagate"
    aggregates: dict[str, Column] = {}
    medians: dict[str, Column] = {}
    averaged: dict[str, Column] = {}
    for tag, rule in rules.items():
        at = Names(tag)
        if rule.rule == "suffix":
            averaged[tag] = F.when(F.col(POS) >= F.col(N) - LAST, value)
            aggregates[at.top] = F.max(F.abs(averaged[tag]))
            continue
        in_tail = F.col(POS) >= F.col(N) - tail_length(F.col(N), rule.tail, rule.min_tail)
        tail = F.when(in_tail, value)
        if rule.rule == "exit":
            averaged[tag] = tail
            aggregates[at.top] = F.max(F.abs(tail))
        else:
            medians[at.target] = tail
            if missing:
                # median() ranks NaN last instead of passing it on
                aggregates[at.gap] = F.max(F.isnan(tail))
    part = part.attach(medians, **aggregates)
    if averaged:
        part = _with_means(part, rules, averaged)
    if missing:
        nan = F.lit(float("nan"))
        part = part.with_columns(**{
            Names(tag).target: F.when(F.col(Names(tag).gap), nan).otherwise(F.col(Names(tag).target))
            for tag, rule in rules.items() if rule.rule == "hold"
        })
    return part.with_columns(**{Names(tag).tol: _tolerance(rule, tag) for tag, rule in rules.items()})


def _with_means(part: Part, rules: Rules, averaged: dict[str, Column]) -> Part:
    """Attach the mean of some samples as target, and for the suffix rule their deviation."""
    sums: dict[str, Column] = {}
    for tag, samples in averaged.items():
        at = Names(tag)
        q = on_grid(samples, F.col(at.top))
        sums |= {at.sum: F.sum(q), at.count: F.count(q)}
        if rules[tag].rule == "suffix":
            sums[at.squares] = F.sum(q * q)
    part = part.attach(**sums)
    figures: dict[str, Column] = {}
    for tag in averaged:
        at = Names(tag)
        n, scale = F.col(at.count), grid_scale(F.col(at.top))
        mean = F.col(at.sum).cast("double") / n / scale
        figures[at.target] = F.when(n > 0, mean).otherwise(F.lit(float("nan")))
        if rules[tag].rule == "suffix":
            # n times the sum of squared deviations, still an integer
            spread = F.col(at.squares) * n - F.col(at.sum) * F.col(at.sum)
            figures[at.tol] = F.when(
                n > 0, F.sqrt(spread.cast("double")) / n / scale).otherwise(F.lit(float("nan")))
    used = [c for tag in averaged for c in (Names(tag).top, Names(tag).sum, Names(tag).squares, Names(tag).count)]
    part = part.with_columns(**figures)
    return replace(part, df=part.df.drop(*used))


def _tolerance(rule: Rule, tag: str) -> Column:
    if rule.rule == "suffix":
        return F.greatest(F.col(Names(tag).tol) * 3.0, F.lit(MIN_BAND))
    tol = F.abs(F.col(Names(tag).target) * F.lit(float(rule.tol)))
    return F.greatest(tol, F.lit(float(rule.abs_tol))) if rule.abs_tol else tol


def out_of_band(value: Column, rule: Rule, tag: str) -> Column:
    """Whether a sample lies outside the band.

    Every comparison with a missing number is false, which makes a missing
    sample inside for hold and exit and outside for suffix.
    """
    target, tol = F.col(Names(tag).target), F.col(Names(tag).tol)
    known = ~F.isnan(value) & ~F.isnan(target)
    if rule.rule == "hold":
        return known & (F.abs(value - target) > tol)
    if rule.rule == "exit":
        return known & ((value < target - tol) | (value > target + tol))
    return ~(known & (F.abs(value - target) <= tol))


def settle_index(rule: Rule, tag: str) -> Column:
    """The settle position from the last excursion."""
    n, j = F.col(N), F.col(Names(tag).last_out)
    never = F.lit(0) if rule.never_out == "first" else n - 1
    if rule.rule != "hold":
        return F.when(j.isNull(), never).otherwise(clamp_index(j + 1, n))
    after = j + (rule.hold if rule.anchor == "hold" else 1)
    return (
        F.when(n < rule.hold, n - 1)
        .when(j.isNull(), never)
        .when(j >= n - rule.hold, n - 1)
        .otherwise(clamp_index(after, n))
    )


def with_settle(part: Part, rules: Rules) -> Part:
    """Attach target, tolerance, last excursion and settle position of each rule."""
    part = with_targets(part, rules)
    part = part.attach(**{
        Names(tag).last_out: F.max(F.when(out_of_band(part.value, rule, tag), F.col(POS)))
        for tag, rule in rules.items()
    })
    return part.with_columns(**{
        Names(tag).index: settle_index(rule, tag).cast("long") for tag, rule in rules.items()
    })


def wait_time(part: Part, tag: str = "") -> Column:
    """Aggregate: the time at the settle position."""
    return F.max(F.when(F.col(POS) == F.col(Names(tag).index), F.col(part.sig.time)))


def targets(sig: Signals, rule: Rule = Rule()) -> DataFrame:
    """Per wave the target and the tolerance."""
    at = Names()
    return sig.per_part(
        lambda p: with_targets(p, {"": rule}).collapse(
            target=F.first(at.target), tolerance=F.first(at.tol)
        )
    )


def settle(sig: Signals, rule: Rule = Rule()) -> DataFrame:
    """Per wave: length, target, tolerance, last excursion, settle index and time."""
    at = Names()

    def figures(p: Part) -> DataFrame:
        p = with_settle(p, {"": rule})
        return p.collapse(
            n=F.first(N), target=F.first(at.target), tolerance=F.first(at.tol),
            last_out=F.first(at.last_out), settle_idx=F.first(at.index),
            wait_time_ms=wait_time(p),
        )
    return sig.per_part(figures)


def labels(sig: Signals, rule: Rule = Rule()) -> DataFrame:
    """The label table: wave id and wait time."""
    def label(p: Part) -> DataFrame:
        p = with_settle(p, {"": rule})
        return p.collapse(wait_time_ms=wait_time(p))
    return sig.per_part(label)
