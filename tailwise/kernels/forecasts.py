"""Which lags and which method forecast one series best, by the end of it that is held out."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from tailwise.kernels import regression, series
from tailwise.kernels.stats import gravity

METHODS = ["lin", "nonlin", "both"]


def predict(x: np.ndarray, h: int, lags: list[int], method: str, weights: np.ndarray | None = None, negative: bool = False, shrink: bool = False) -> np.ndarray:
    w = series.lag_weights(x, lags) if weights is None else weights
    if method == "lin":
        return series.forecast(x, h, lags, "lin", w, negative, shrink)
    return regression.forecast_nonlinear(x, h, lags, w, negative, method == "both", shrink)


def relative_error(predicted: np.ndarray, actual: np.ndarray) -> float:
    """Mean squared error over the concordant co-moments of both; infinite where they have none."""
    a, b = predicted - predicted.mean(), actual - actual.mean()
    together = float(np.mean(np.where(a * b > 0, a * b, 0.0)))
    return float(np.mean((predicted - actual) ** 2)) / together if together > 0 else math.inf


@dataclass
class Choice:
    lags: list[int]
    method: str
    weights: np.ndarray | None
    error: float
    shrink: bool
    bias: float
    width: float

    def forecast(self, x: np.ndarray, h: int, negative: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimates, and the bounds of their interval."""
        out = predict(x, h, self.lags, self.method, self.weights, negative, self.shrink) - self.bias
        low, high = out - self.width, out + self.width
        return (out, low, high) if negative else tuple(np.maximum(0.0, v) for v in (out, low, high))


def candidates(lags: list[int], training: int) -> list[int]:
    """Lags that leave at least three or four values of each subsequence."""
    limit = training / min(4, max(3, math.floor(training / 100 + 0.5)))
    found = sorted({int(k) for k in lags if k <= limit})
    if not found:
        raise ValueError(f"no lag is {limit:g} or less")
    return found


def choose(x: np.ndarray, held: int, lags: list[int], negative: bool = False, linear_only: bool = False, interval: float = 0.95) -> Choice:
    """Lags are added one by one while the linear forecast of the held values improves; the other methods are tried with
    the lags so found. Then equal weights, a shift by the errors' gravity and shrinking to means are taken where they
    help."""
    train, actual = x[: len(x) - held], x[len(x) - held :]
    if not 0 < held < len(x) / 2:
        raise ValueError("hold out less than half of the series, and one value at least")
    left, chosen, best = candidates(lags, len(train)), [], math.inf
    while left:
        scored = [(relative_error(predict(train, held, [*chosen, k], "lin", None, negative), actual), i) for i, k in enumerate(left)]
        error, i = min(scored)
        if chosen and error > best:
            break
        chosen, best = [*chosen, left.pop(i)], error
    tried = {"lin": best}
    if not linear_only:
        linear = predict(train, held, chosen, "lin", None, negative)
        curved = predict(train, held, chosen, "nonlin", None, negative)
        tried |= {"nonlin": relative_error(curved, actual), "both": relative_error((linear + curved) / 2, actual)}
    method = min(METHODS[: len(tried)], key=lambda m: tried[m])
    error, weights = tried[method], None
    guess = predict(train, held, chosen, method, None, negative)
    if len(chosen) > 1:
        even = np.full(len(chosen), 1 / len(chosen))
        other = predict(train, held, chosen, method, even, negative)
        if relative_error(other, actual) < min(error, relative_error(guess, actual)):
            weights, guess = even, other
    errors = guess - actual
    shift = gravity(errors)
    bias = shift if math.isfinite(shift) and relative_error(guess - shift, actual) <= min(error, relative_error(guess, actual)) else 0.0
    shrink = relative_error(predict(train, held, chosen, method, weights, negative, True), actual) < error
    width = abs(float(np.quantile(errors, 1 - (1 - interval) / 2))) + abs(bias)
    return Choice(chosen, method, weights, error, shrink, bias, width)


def seasonal_lags(x: np.ndarray, most: int | None = 1) -> tuple[list[int], np.ndarray]:
    """Periods whose subsequences vary no more than the series, the most steadiest of them (None: all), and their
    weights; 1 if there is none."""

    def spread(v: np.ndarray) -> float:
        return abs(float(np.std(v, ddof=1)) / float(np.mean(v))) if len(v) > 1 and np.mean(v) else math.nan

    n, base, back, found = len(x), spread(x), x[::-1], []
    for p in range(1, n // 2 + 1) if n >= 5 and math.isfinite(base) else ():
        own = [spread(back[s::p]) for s in range(3)]
        own = [v if math.isfinite(v) else base for v in own]
        if max(own) <= base * (1 + 1e-12) and p < n / 2:
            found.append((float(np.mean(own)), p))
    if not found:
        return [1], np.ones(1)
    cv, lags = (np.array(v) for v in zip(*sorted(found)[:most], strict=True))
    w = (base - cv) / np.sqrt(lags)
    return lags.astype(int).tolist(), w / w.sum() if w.sum() else np.zeros(len(w))
