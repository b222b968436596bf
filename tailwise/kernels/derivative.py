"""Numerical differentiation of a function of one number."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Derivative:
    """What is known of f at a point. code: 0 converged, 1 out of rounds, 2 no step found."""

    value: float
    intercept: float
    slope: float
    step: float
    rounds: int
    code: int
    left: float
    right: float
    mean: float
    left_inferred: float
    right_inferred: float
    mean_inferred: float
    complex_step: float


def _root(f: Callable[[float], float], reach: float, scale: float) -> float:
    """A sign change of f in an interval around 0 that doubles until it has one. Differences over steps below the scale's
    half digits are noise, so an interval around 0 of that size counts as 0."""
    lo, hi, noise = -reach, reach, 1e-8 * scale
    try:
        for _ in range(100):
            a, b = f(lo), f(hi)
            if math.isfinite(a) and math.isfinite(b) and a * b <= 0:
                break
            lo, hi = 2 * lo, 2 * hi
        else:
            return math.nan
        if a == 0 or b == 0:
            return lo if a == 0 else hi
        while hi - lo > noise:
            mid = (lo + hi) / 2
            if abs(mid) < noise / 8:
                mid = lo + 0.375 * (hi - lo)
            v = f(mid)
            if v == 0:
                return mid
            lo, hi = (mid, hi) if (v > 0) == (a > 0) else (lo, mid)
        return 0.0 if lo <= noise and hi >= -noise else (lo + hi) / 2
    except (ArithmeticError, ValueError):
        return math.nan


def _steps(f: Callable, x: float, h: float) -> tuple[float, float, float]:
    left, right = (f(x) - f(x - h)) / h, (f(x + h) - f(x)) / h
    return left, right, (left + right) / 2


def derivative(f: Callable, x: float, h: float | None = None, tolerance: float = 1e-10, rounds: int = 100) -> Derivative:
    """Secants left and right of x meet the axis at two heights; the height between them is halved until the step whose
    secant has it is as good as none. The slope is that of the line from there to f(x)."""
    h = abs(x) * 0.1 + 0.01 if h is None else h
    if h <= 0 or tolerance <= 0 or rounds < 1:
        raise ValueError("h, tolerance and rounds must be positive")
    y, first = float(f(x)), _steps(f, x, h)
    none = (math.nan,) * 3
    left, right = y - first[0] * x, y - first[1] * x
    low, high = min(left, right), max(left, right)
    if math.isclose(low, high, rel_tol=math.sqrt(np.finfo(float).eps)):
        return Derivative(y, left, first[2], 0.0, 0, 0, *first, *none, math.nan)
    step, code, n = math.nan, 2, 1
    middle = (low + high) / 2
    while True:
        step = _root(lambda t, b=middle: -y + (y - f(x - t)) / t * x + b, 2 * h, max(1.0, abs(x)))
        if not math.isfinite(step):
            break
        if abs(step) < tolerance or n >= rounds:
            code = 0 if abs(step) < tolerance else 1
            break
        if (step < 0) == (left == high):
            low = middle
        else:
            high = middle
        middle, n = (low + high) / 2, n + 1
    intercept = (low + high) / 2
    slope = first[2] if abs(x) < math.sqrt(np.finfo(float).eps) else (y - intercept) / x
    step, inferred, complex_step = abs(step), none, math.nan
    if math.isfinite(step) and step:
        inferred = _steps(f, x, step)
        try:
            complex_step = float(np.imag(f(complex(x, step))) / step)
        except (ArithmeticError, ValueError, TypeError):
            complex_step = math.nan
    return Derivative(y, intercept, slope, step, n, code, *first, *inferred, complex_step)
