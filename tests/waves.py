"""Random and hand-made waves, and direct numpy statements of the rules."""

import numpy as np
import pandas as pd

NAN = float("nan")


def frame(waves: dict[int, np.ndarray], dt: float = 0.01) -> pd.DataFrame:
    parts = [
        pd.DataFrame({
            "wave_id": np.int64(k), "sample": np.arange(len(x), dtype="int64"),
            "time_ms": np.arange(len(x)) * dt, "value": np.asarray(x, dtype="float64"),
        })
        for k, x in waves.items() if len(x)
    ]
    return pd.concat(parts, ignore_index=True)


def random_waves(count: int = 60, seed: int = 1, gaps: bool = False) -> dict[int, np.ndarray]:
    rng = np.random.default_rng(seed)
    lengths = [1, 2, 4, 5, 9, 10, 11, 49, 50, 51, 99, 100, 101, 149, 150, 151, 200]
    waves = {}
    for k in range(count):
        n = lengths[k % len(lengths)]
        t = np.arange(n)
        level = rng.choice([-2.0, 0.0, 1.0, 3.0])
        x = level + rng.normal(0, 1) * np.exp(-t / rng.uniform(3, 40)) * np.cos(t / 3)
        x = np.round(x + rng.normal(0, rng.choice([0.0, 0.004, 0.02]), n), 6)
        if gaps and k % 3 == 0:
            x[rng.random(n) < 0.05] = NAN
        waves[k] = x
    return waves


def tail_of(x):
    k = int(len(x) * 0.1)
    return x[len(x) - k:] if k else x


def index_after(out, step, reset=0):
    """Index ``step`` after the last true element, ``reset`` if there is none."""
    n = len(out)
    hits = np.flatnonzero(out)
    return min(hits[-1] + step, n - 1) if len(hits) else reset


def hold_index(x, m=50, tol=0.01):
    target = np.median(tail_of(x))
    with np.errstate(invalid="ignore"):
        out = np.abs(x - target) > abs(target * tol)
    n = len(x)
    if n < m:
        return n - 1
    windows = np.lib.stride_tricks.sliding_window_view(out, m).any(axis=1)
    return index_after(np.append(windows, [False] * (m - 1)), m)


def exit_index(x, pct=1.0, reset=0):
    target = np.mean(tail_of(x))
    tol = abs(target * (pct / 100.0))
    with np.errstate(invalid="ignore"):
        out = (x < target - tol) | (x > target + tol)
    return index_after(out, 1, reset)


def suffix_index(x):
    last = x[-10:]
    with np.errstate(invalid="ignore"):
        inside = np.abs(x - last.mean()) <= max(3 * last.std(), 1e-12)
    ok = np.logical_and.accumulate(inside[::-1])[::-1]
    return int(np.argmax(ok)) if ok.any() else len(x) - 1


def current_features(x):
    a, b, d = x[-50:], x[-150:], np.diff(x)
    return {
        "x_end": x[-1], "std_all": x.std(), "std_tail_50": a.std(),
        "max_dev_tail_50": np.abs(a - x[-1]).max(),
        "settling_trend": b.std() / (a.std() + 1e-9),
        "ringing_energy": np.abs(d[3:]).sum(), "max_slope": d.max(),
        "stability_ratio": a.std() / (x.std() + 1e-9),
    }


def classic_features(x):
    last, d = x[-10:], np.diff(x)
    return {
        "x0": x[0], "x_end": x[-1], "mean_all": x.mean(), "std_all": x.std(),
        "mean_last": last.mean(), "std_last": last.std(), "peak_rel": x.max() - last.mean(),
        "trough_rel": last.mean() - x.min(), "max_slope": d.max(), "min_slope": d.min(),
        "ringing_energy": np.abs(d[3:]).sum(), "settle_idx": suffix_index(x),
        "band_3std_last": max(3 * last.std(), 1e-12),
    }
