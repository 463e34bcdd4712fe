"""SQL text over array columns: bindings and running values.

Long expressions are written as SQL text with named lambda variables and parsed once; built call by call they would take thousands of
calls into the JVM for each plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block. A running value is that of the blocks before and of the block's elements up to it, so that n elements take about
#: n * BLOCK / 2 + (n / BLOCK)^2 / 2 steps and no list is ever copied; an accumulator that grows by an element a step would be copied n times.
BLOCK = 128


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """body, in which name stands for value, computed once a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def over(value: Column, name: str, body: str) -> Column:
    """body as a column, in which name stands for value."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), 1)


def _running(values: str, zero: str, step: str) -> str:
    fold = lambda some: f"aggregate({some}, {zero}, (acc_, el_) -> {step})"
    within = fold(f"slice({values}, at_ - at_ % {BLOCK} + 1, at_ % {BLOCK} + 1)")
    every, blocks = f"sequence(0, size({values}) - 1)", f"sequence(0, cast((size({values}) - 1) div {BLOCK} AS int))"
    totals = f"transform({blocks}, bl_ -> {fold(f'slice({values}, bl_ * {BLOCK} + 1, {BLOCK})')})"
    before = f"transform({blocks}, bl_ -> {fold('slice(tot_, 1, bl_)')})"
    op = step.replace("acc_", f"pre_[cast(at_ div {BLOCK} AS int)]").replace("el_", within)
    many = let(totals, "tot_", let(before, "pre_", f"transform({every}, at_ -> {op})"))
    return f"CASE WHEN size({values}) = 0 THEN {values} WHEN size({values}) <= {BLOCK} THEN transform({every}, at_ -> {within}) ELSE {many} END"


def running_sum(values: str) -> str:
    """For each element of the array of ints that the name values stands for, the sum up to it."""
    return _running(values, "0", "acc_ + el_")


def running_max(values: str) -> str:
    return _running(values, "-1", "greatest(acc_, el_)")
