"""Daily bars at the last bar of each month: trailing windows are taken there only, not on each day.

A code's bars are one list, so its work is that of one code, and a list has a bar a day at most."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Month ends whose windows are held at once.
BLOCK = 1 << 12
DOUBLES = """close volume return_20d prior_return_20d kline_return_3d kline_return_5d kline_return_60d kline_return_120d rsi14 atr20_pct drawdown60
kline_efficiency_20d kline_reversal_rate_20d kline_volatility_ratio_20_60 kline_volatility_ratio_3_20 volume_ratio20 ma200_slope20
upper_overhang lower_support winner_rate_pct cost_band_width chip_range_position cost_position""".split()
KIND = f"array<struct<date date, close_above_ma200 boolean, {', '.join(f'{c} double' for c in DOUBLES)}>>"


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(np.abs(b) > 1e-12, a / b, np.nan)


def _windows(day: dict[str, np.ndarray], first: np.ndarray, at: np.ndarray, near: int) -> dict[str, np.ndarray]:
    """Indicators at the bars at; a window that reaches before a code's first bar, or over an
    unknown value, has no value."""

    def last(x: str, n: int, ends: np.ndarray = at) -> np.ndarray:
        rows = ends[:, None] + np.arange(1 - n, 1)
        return np.where(rows >= first[at][:, None], day[x][np.maximum(rows, 0)], np.nan)

    def back(n: int) -> np.ndarray:
        return np.where(at - n >= first[at], day["close"][np.maximum(at - n, 0)], np.nan)

    mean = lambda x, n, ends=at: last(x, n, ends).sum(axis=1) / n
    c, gain, loss = day["close"][at], mean("up", 14), mean("down", 14)
    average, steps = mean("close", 200), last("step", 20)
    known = ~np.isnan(steps).any(axis=1)
    spread = {n: last("r", n).std(axis=1) for n in (3, 20, 60)}
    close, volume = last("close", near), last("volume", near)
    held = lambda test: np.where(test, volume, 0.0).sum(axis=1)
    inside = at[:, None] + np.arange(1 - near, 1) >= first[at][:, None]
    whole, low, high = held(inside), np.fmin.reduce(close, axis=1), np.fmax.reduce(close, axis=1)
    cost = np.where(inside, close * volume, 0.0).sum(axis=1)
    out = {name: 100 * (c / back(n) - 1) for name, n in (("prior_return_20d", 20), ("kline_return_3d", 3), ("kline_return_5d", 5), ("kline_return_60d", 60), ("kline_return_120d", 120))}
    return out | {
        "rsi14": np.where(loss > 0, 100 - 100 / (1 + gain / loss), np.nan),
        "atr20_pct": 100 * mean("reach", 20) / c,
        "drawdown60": 100 * (c / last("close", 60).max(axis=1) - 1),
        "ma200": average,
        "ma200_slope20": 100 * (average / mean("close", 200, at - 20) - 1),
        "kline_efficiency_20d": _ratio(np.abs(c - back(20)), np.abs(steps).sum(axis=1)),
        "kline_reversal_rate_20d": np.where(known, mean("turn", 20), np.nan),
        "kline_volatility_ratio_20_60": _ratio(spread[20], spread[60]),
        "kline_volatility_ratio_3_20": _ratio(spread[3], spread[20]),
        "volume_ratio20": _ratio(day["volume"][at], mean("volume", 20)),
        "upper_overhang": held(close > 1.1 * c[:, None]) / whole,
        "lower_support": held((close >= 0.9 * c[:, None]) & (close <= c[:, None])) / whole,
        "winner_rate_pct": 100 * held(close <= c[:, None]) / whole,
        "cost_band_width": (high - low) / c,
        "chip_range_position": _ratio(c - low, high - low),
        "cost_position": _ratio(cost / whole - low, high - low),
    }


def _exact(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums from each start to the next, of what is known, to four digits: whatever the order."""
    total = np.add.reduceat(np.rint(np.nan_to_num(x) * 1e4).astype(np.int64), starts) / 1e4
    return np.where(np.add.reduceat((~np.isnan(x)).astype(np.int64), starts) > 0, total, np.nan)


@np.errstate(all="ignore")
def month_ends(bars: pa.Array, near: int) -> pa.Array:
    """For each list of bars (date, high, low, close, volume, amount; in any order) its months: the
    date of the first day, the month's close, volume and return to the next, and the indicators."""
    sizes = bars.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, code = bars.flatten(), np.repeat(np.arange(len(sizes)), sizes)
    dates = pc.fill_null(flat.field("date").cast(pa.int32()), -(1 << 24)).to_numpy(zero_copy_only=False).astype(np.int64)  # unknown ones come first
    order = np.lexsort((dates, code))
    dates = dates[order]
    day = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64)[order] for c in ("high", "low", "close", "volume", "amount")}
    start = np.cumsum(sizes) - sizes
    first, place = start[code], np.arange(len(code))
    months = dates.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64)
    new = np.append(True, (code[1:] != code[:-1]) | (months[1:] != months[:-1]))[: len(code)]
    before = lambda x: np.where(place > first, x[np.maximum(place - 1, 0)], np.nan)
    was = before(day["close"])
    day["step"] = day["close"] - was
    day["r"] = 100 * (day["close"] / was - 1)
    day["turn"] = (np.sign(day["step"]) * before(np.sign(day["step"])) < 0).astype(np.float64)
    day["up"], day["down"] = (np.where(np.isnan(was), np.nan, np.fmax(x, 0.0)) for x in (day["step"], -day["step"]))
    day["reach"] = np.fmax(np.fmax(day["high"] - day["low"], np.abs(day["high"] - was)), np.abs(day["low"] - was))

    starts = np.flatnonzero(new)
    at = np.append(starts[1:], len(code))[: len(starts)] - 1
    parts = [_windows(day, first, at[i : i + BLOCK], near) for i in range(0, max(len(at), 1), BLOCK)]
    out = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    out["volume"] = _exact(day["volume"], starts) if len(starts) else np.zeros(0)
    out["close"] = _exact(day["amount"], starts) / out["volume"] if len(starts) else np.zeros(0)
    following = np.append(out["close"][1:], np.nan)[: len(at)]
    out["return_20d"] = np.where(np.append(code[at][1:] == code[at][:-1], False)[: len(at)], 100 * (following / out["close"] - 1), np.nan)
    above = pa.array(day["close"][at] > out["ma200"], mask=np.isnan(day["close"][at]) | np.isnan(out["ma200"]))

    known = dates[at] > -(1 << 24)
    columns = [pa.array(months[at].astype("datetime64[M]").astype("datetime64[D]")), above, *(pa.array(out[c], mask=np.isnan(out[c])) for c in DOUBLES)]
    kept = [c.filter(pa.array(known)) for c in columns]
    ends = np.append(0, np.cumsum(np.bincount(code[at][known], minlength=len(sizes))))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(kept, ["date", "close_above_ma200", *DOUBLES]))
