"""Families of published factors as formulas over bars."""

from __future__ import annotations

#: Windows of the families that have one; fixed values.
WINDOWS = (5, 10, 20, 30, 60)
_GAIN, _FALL, _MOVE = "max({x} - ts_delay({x}, 1), 0)", "max(ts_delay({x}, 1) - {x}, 0)", "abs({x} - ts_delay({x}, 1))"
_SPAN = "(high - low + 1e-12)"

#: The 158 price and volume factors of the published Qlib set; fixed values.
BARS = {
    "kmid": "(close - open) / open",
    "klen": "(high - low) / open",
    "kmid_2": f"(close - open) / {_SPAN}",
    "kup": "(high - max(open, close)) / open",
    "kup_2": f"(high - max(open, close)) / {_SPAN}",
    "klow": "(min(open, close) - low) / open",
    "klow_2": f"(min(open, close) - low) / {_SPAN}",
    "ksft": "(close * 2 - high - low) / open",
    "ksft_2": f"(close * 2 - high - low) / {_SPAN}",
    "open_0": "open / close",
    "high_0": "high / close",
    "low_0": "low / close",
    "vwap_0": "if_else((volume > 0) and (raw_close > 0) and (abs((amount / (volume * 100)) / raw_close - 1) > 0.2), 1, (amount / (volume * 100)) / raw_close)",
}


def _up(x: str, n: int) -> str:
    return f"ts_sum({_GAIN.format(x=x)}, {n})"


def _down(x: str, n: int) -> str:
    return f"ts_sum({_FALL.format(x=x)}, {n})"


def _all(x: str, n: int) -> str:
    return f"(ts_sum({_MOVE.format(x=x)}, {n}) + 1e-12)"


def windowed(n: int) -> dict[str, str]:
    flow = "abs(close / ts_delay(close, 1) - 1) * volume"
    return {
        "roc": f"ts_delay(close, {n}) / close",
        "ma": f"ts_mean(close, {n}) / close",
        "std": f"ts_std0(close, {n}) / close",
        "beta": f"ts_slope(close, {n}) / close",
        "rsqr": f"ts_rsquare(close, {n})",
        "resi": f"ts_resi(close, {n}) / close",
        "max": f"ts_max(high, {n}) / close",
        "min": f"ts_min(low, {n}) / close",
        "qtlu": f"ts_qlinear(close, {n}, 0.8) / close",
        "qtld": f"ts_qlinear(close, {n}, 0.2) / close",
        "rank": f"ts_pctrank(close, {n})",
        "rsv": f"(close - ts_min(low, {n})) / (ts_max(high, {n}) - ts_min(low, {n}) + 1e-12)",
        "imax": f"ts_argmax(high, {n}) / {n}",
        "imin": f"ts_argmin(low, {n}) / {n}",
        "imxd": f"(ts_argmax(high, {n}) - ts_argmin(low, {n})) / {n}",
        "corr": f"ts_corr(close, log(volume + 1), {n})",
        "cord": f"ts_corr(close / ts_delay(close, 1), log(volume / ts_delay(volume, 1) + 1), {n})",
        "cntp": f"ts_mean(close > ts_delay(close, 1), {n})",
        "cntn": f"ts_mean(close < ts_delay(close, 1), {n})",
        "cntd": f"ts_mean(close > ts_delay(close, 1), {n}) - ts_mean(close < ts_delay(close, 1), {n})",
        "sump": f"{_up('close', n)} / {_all('close', n)}",
        "sumn": f"{_down('close', n)} / {_all('close', n)}",
        "sumd": f"({_up('close', n)} - {_down('close', n)}) / {_all('close', n)}",
        "vma": f"ts_mean(volume, {n}) / (volume + 1e-12)",
        "vstd": f"ts_std0(volume, {n}) / (volume + 1e-12)",
        "wvma": f"ts_std0({flow}, {n}) / (ts_mean({flow}, {n}) + 1e-12)",
        "vsump": f"{_up('volume', n)} / {_all('volume', n)}",
        "vsumn": f"{_down('volume', n)} / {_all('volume', n)}",
        "vsumd": f"({_up('volume', n)} - {_down('volume', n)}) / {_all('volume', n)}",
    }


def alpha158(windows: tuple[int, ...] = WINDOWS) -> dict[str, str]:
    """Name to formula, over open, high, low, close, volume, amount and raw_close."""
    out = {f"a158_{k}": v for k, v in BARS.items()}
    for n in windows:
        out |= {f"a158_{k}_{n}": v for k, v in windowed(n).items()}
    return out


_TINY = "0.000000000001"
_PLACE = f"((close - low) - (high - close)) / (high - low + {_TINY})"
#: Factors of the published set of 191 that need daily bars alone; fixed values.
GTJA = {
    "gtja_2": f"-1 * ts_delta((close - low) - (high - close), 1) / (high - low + {_TINY})",
    "gtja_3": "ts_sum((close == ts_max(high, 6)) * 1.0, 6) + ts_sum((close == ts_min(low, 6)) * 1.0, 6)",
    "gtja_5": "-1 * ts_max(ts_corr(ts_pctrank(volume, 5), ts_pctrank(high, 5), 5), 3)",
    "gtja_6": "-1 * rank(ts_delta(0.85 * open + 0.15 * high, 4))",
    "gtja_11": f"(rank(ts_sum({_PLACE} * volume, 6)) / rank(ts_sum({_PLACE} * volume, 6) + {_TINY})) * 100",
    "gtja_14": "close - ts_delay(close, 5) + ts_delta(ts_corr(high, volume, 10), 1)",
    "gtja_18": "close / ts_delay(close, 5) * ts_pctrank(volume, 5)",
    "gtja_19": "(close < ts_delay(close, 5)) * 1.0 + (close == ts_delay(close, 5)) * 1.0 - (close > ts_delay(close, 5)) * 1.0 + (close <= ts_delay(close, 5)) * 1.0",
    "gtja_20": "(close - ts_delay(close, 6)) / ts_delay(close, 6) * 100",
    "gtja_34": "ts_mean(close, 12) / close",
    "gtja_37": f"-1 * rank(ts_delta(open, 1)) * (rank(ts_sum(volume, 15)) / rank(ts_sum(volume, 15) + {_TINY}))",
    "gtja_49": f"ts_sum(((high + low) / 2 - (ts_delay(high, 1) + ts_delay(low, 1)) / 2) / (high - low + {_TINY}) * ts_delta(volume, 1), 12) / (ts_sum(volume, 12) + {_TINY})",
    "gtja_54": f"-1 * (ts_max(close, 10) - close) / ((ts_max(close, 10) + {_TINY}) * (close + {_TINY}))",
}
#: Members of the set whose definition can't be followed with such bars; they are refused, not approximated.
BLOCKED = ("gtja_15", "gtja_32", "gtja_38", "gtja_55")


def gtja(name: str) -> str:
    """The formula of one; refuses the blocked ones."""
    if name in BLOCKED:
        raise ValueError(f"{name} can't be computed from daily bars, and is not approximated")
    return GTJA[name]
