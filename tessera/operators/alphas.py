"""Formulas published in "101 Formulaic Alphas" (2015), as stages over staged bars: each stage adds columns that later
ones read, as a window cannot hold a window. vwap is amount over volume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import cross, series
from tessera.functions.series import div, tidy

Stage = dict[str, Callable[[], Column]]


def _turning(n: int) -> list[Stage]:
    step = F.col
    same = lambda: F.when(series.ts_min("dc", n) > 0, step("dc")).when(series.ts_max("dc", n) < 0, step("dc")).otherwise(-step("dc"))
    return [{"dc": lambda: series.delta("close", 1)}, {"value": same}]


def _ranked_corr(a: Callable[[], Column], b: Callable[[], Column], n: int) -> list[Stage]:
    return [{"p": a, "q": b}, {"p": lambda: cross.rank("p"), "q": lambda: cross.rank("q")}, {"value": lambda: -series.ts_corr("p", "q", n)}]


def _ranked_cov(a: str, n: int) -> list[Stage]:
    return [
        {"p": lambda: cross.rank(a), "q": lambda: cross.rank("volume")},
        {"cov": lambda: tidy(series.ts_cov("p", "q", n))},
        {"value": lambda: -cross.rank("cov")},
    ]


def _ranks(*names: str) -> Stage:
    return {n: lambda n=n: cross.rank(n) for n in names}


def _vwap() -> Column:
    return div(c("amount"), c("volume"))


def _adv() -> Column:
    """Mean volume of twenty bars."""
    return series.ts_mean("volume", 20)


def _bend(low: float, high: float | None = None) -> list[Stage]:
    """How the fall of the last ten bars differs from that of the ten before: below `low` 1, above `high` -1, else minus
    the last change (also where history is too short)."""
    late, early = lambda: series.delay("close", 10) - c("close"), lambda: series.delay("close", 20) - series.delay("close", 10)

    def value() -> Column:
        rule = F.when(c("p") < low, 1.0)
        return (rule.when(c("p") > high, -1.0) if high is not None else rule).otherwise(c("pc") - c("close"))

    return [{"p": lambda: early() / 10 - late() / 10}, {"value": value}]


c = F.col
ALPHAS: dict[str, Callable[[], list[Stage]]] = {
    "002": lambda: _ranked_corr(lambda: tidy(cross.log("volume") - series.delay(cross.log("volume"), 2)), lambda: c("oc"), 6),
    "003": lambda: _ranked_corr(lambda: c("open"), lambda: c("volume"), 10),
    "004": lambda: [{"p": lambda: cross.rank("low")}, {"value": lambda: -series.ts_rank("p", 9)}],
    "006": lambda: [{"value": lambda: -series.ts_corr("open", "volume", 10)}],
    "009": lambda: _turning(5),
    "010": lambda: [*_turning(4), {"value": lambda: cross.rank("value")}],
    "012": lambda: [{"value": lambda: -F.signum(series.delta("volume", 1)) * series.delta("close", 1)}],
    "013": lambda: _ranked_cov("close", 5),
    "016": lambda: _ranked_cov("high", 5),
    "023": lambda: [{"value": lambda: F.when(series.ts_mean("high", 20) < c("high"), -series.delta("high", 2)).otherwise(0.0)}],
    "033": lambda: [{"p": lambda: div(c("open"), c("close")) - 1}, {"value": lambda: cross.rank("p")}],
    "041": lambda: [{"value": lambda: F.sqrt(c("high") * c("low")) - div(c("amount"), c("volume"))}],
    "042": lambda: [
        {"p": lambda: tidy(div(c("amount"), c("volume")) - c("close")), "q": lambda: tidy(div(c("amount"), c("volume")) + c("close"))},
        {"p": lambda: cross.rank("p"), "q": lambda: cross.rank("q")},
        {"value": lambda: div(c("p"), c("q"))},
    ],
    "044": lambda: [{"q": lambda: cross.rank("volume")}, {"value": lambda: -series.ts_corr("high", "q", 5)}],
    "053": lambda: [{"p": lambda: div((c("close") - c("low")) - (c("high") - c("close")), c("close") - c("low"))}, {"value": lambda: -series.delta("p", 9)}],
    "054": lambda: [{"value": lambda: div(-(c("low") - c("close")) * F.pow("open", F.lit(5.0)), (c("low") - c("high")) * F.pow("close", F.lit(5.0)))}],
    "005": lambda: [
        {"vw": _vwap},
        {"p": lambda: tidy(c("open") - series.ts_sum("vw", 10) / 10), "q": lambda: tidy(c("close") - c("vw"))},
        _ranks("p", "q"),
        {"value": lambda: -c("p") * F.abs("q")},
    ],
    "007": lambda: [
        {"p": lambda: series.delta("close", 7), "r": _adv},
        {"q": lambda: F.abs("p")},
        {"value": lambda: F.when(c("r") < c("volume"), -series.ts_rank("q", 60) * F.signum("p")).otherwise(-1.0)},
    ],
    "008": lambda: [
        {"p": lambda: series.ts_sum("open", 5) * series.ts_sum("ret", 5)},
        {"q": lambda: tidy(series.delta("p", 10))},
        {"value": lambda: -cross.rank("q")},
    ],
    "011": lambda: [
        {"vw": lambda: _vwap() - c("close"), "r": lambda: series.delta("volume", 3)},
        {"p": lambda: tidy(series.ts_max("vw", 3)), "q": lambda: tidy(series.ts_min("vw", 3))},
        _ranks("p", "q", "r"),
        {"value": lambda: (c("p") + c("q")) * c("r")},
    ],
    "014": lambda: [
        {"p": lambda: tidy(series.delta("ret", 3)), "q": lambda: series.ts_corr("open", "volume", 10)},
        _ranks("p"),
        {"value": lambda: -c("p") * c("q")},
    ],
    "015": lambda: [
        {"p": lambda: cross.rank("high"), "q": lambda: cross.rank("volume")},
        {"k": lambda: tidy(series.ts_corr("p", "q", 3))},
        _ranks("k"),
        {"value": lambda: -series.ts_sum("k", 3)},
    ],
    "017": lambda: [
        {"p": lambda: series.ts_rank("close", 10), "q": lambda: series.delta("close", 1), "r": lambda: tidy(div(c("volume"), _adv()))},
        {"q": lambda: tidy(series.delta("q", 1)), "r": lambda: series.ts_rank("r", 5)},
        _ranks("p", "q", "r"),
        {"value": lambda: -c("p") * c("q") * c("r")},
    ],
    "018": lambda: [
        {"p": lambda: F.abs(c("close") - c("open"))},
        {"q": lambda: tidy(series.ts_std("p", 5) + (c("close") - c("open")) + series.ts_corr("close", "open", 10))},
        {"value": lambda: -cross.rank("q")},
    ],
    "020": lambda: [
        {n: lambda x=x: c("open") - c(x) for n, x in (("p", "ph"), ("q", "pc"), ("r", "pl"))},
        _ranks("p", "q", "r"),
        {"value": lambda: -c("p") * c("q") * c("r")},
    ],
    "022": lambda: [
        {"p": lambda: series.ts_corr("high", "volume", 5), "q": lambda: tidy(series.ts_std("close", 20))},
        {"p": lambda: series.delta("p", 5), "q": lambda: cross.rank("q")},
        {"value": lambda: -c("p") * c("q")},
    ],
    "025": lambda: [{"p": lambda: tidy(-c("ret") * _adv() * _vwap() * (c("high") - c("close")))}, {"value": lambda: cross.rank("p")}],
    "026": lambda: [
        {"p": lambda: series.ts_rank("volume", 5), "q": lambda: series.ts_rank("high", 5)},
        {"k": lambda: series.ts_corr("p", "q", 5)},
        {"value": lambda: -series.ts_max("k", 3)},
    ],
    "028": lambda: [
        {"r": _adv},
        {"p": lambda: series.ts_corr("r", "low", 5) + (c("high") + c("low")) / 2 - c("close")},
        {"value": lambda: cross.scale("p")},
    ],
    "030": lambda: [
        {"p": lambda: F.signum(c("close") - c("pc"))},
        {"q": lambda: c("p") + series.delay("p", 1) + series.delay("p", 2)},
        _ranks("q"),
        {"value": lambda: div((1 - c("q")) * series.ts_sum("volume", 5), series.ts_sum("volume", 20))},
    ],
    "034": lambda: [
        {"p": lambda: tidy(div(series.ts_std("ret", 2), series.ts_std("ret", 5))), "q": lambda: series.delta("close", 1)},
        _ranks("p", "q"),
        {"k": lambda: tidy(2 - c("p") - c("q"))},
        {"value": lambda: cross.rank("k")},
    ],
    "038": lambda: [
        {"p": lambda: series.ts_rank("close", 10), "q": lambda: div(c("close"), c("open"))},
        _ranks("p", "q"),
        {"value": lambda: -c("p") * c("q")},
    ],
    "040": lambda: [
        {"p": lambda: tidy(series.ts_std("high", 10)), "q": lambda: series.ts_corr("high", "volume", 10)},
        _ranks("p"),
        {"value": lambda: -c("p") * c("q")},
    ],
    "043": lambda: [
        {"p": lambda: tidy(div(c("volume"), _adv())), "q": lambda: -series.delta("close", 7)},
        {"value": lambda: series.ts_rank("p", 20) * series.ts_rank("q", 8)},
    ],
    "046": lambda: _bend(0.0, 0.25),
    "047": lambda: [
        {"p": lambda: div(F.lit(1.0), c("close")), "q": lambda: c("high") - c("close"), "r": lambda: tidy(_vwap() - series.delay(_vwap(), 5))},
        _ranks("p", "q", "r"),
        {"value": lambda: div(c("p") * c("volume"), _adv()) * div(c("high") * c("q"), series.ts_sum("high", 5) / 5) - c("r")},
    ],
    "049": lambda: _bend(-0.1),
    "050": lambda: [
        {"p": lambda: c("volume"), "q": lambda: tidy(_vwap())},
        _ranks("p", "q"),
        {"k": lambda: tidy(series.ts_corr("p", "q", 5))},
        _ranks("k"),
        {"value": lambda: -series.ts_max("k", 5)},
    ],
    "051": lambda: _bend(-0.05),
    "055": lambda: _ranked_corr(
        lambda: tidy(div(c("close") - series.ts_min("low", 12), series.ts_max("high", 12) - series.ts_min("low", 12))), lambda: c("volume"), 6
    ),
    "060": lambda: [
        {"p": lambda: tidy(div((c("close") - c("low")) - (c("high") - c("close")), c("high") - c("low")) * c("volume")), "q": lambda: series.ts_argmax("close", 10)},
        _ranks("p", "q"),
        {"p": lambda: cross.scale("p"), "q": lambda: cross.scale("q")},
        {"value": lambda: c("q") - 2 * c("p")},
    ],
    "083": lambda: [
        {"p": lambda: div(c("high") - c("low"), series.ts_sum("close", 5) / 5), "k": lambda: tidy(_vwap() - c("close"))},
        {"q": lambda: tidy(series.delay("p", 2)), "r": lambda: cross.rank("volume")},
        _ranks("q", "r"),
        {"value": lambda: div(c("q") * c("r"), div(c("p"), c("k")))},
    ],
    "101": lambda: [{"value": lambda: (c("close") - c("open")) / (c("high") - c("low") + 0.001)}],
}


def alpha(bars: DataFrame, number: str) -> DataFrame:
    """Staged bars with `value` for one formula."""
    for stage in ALPHAS[number]():
        bars = bars.withColumns({n: build() for n, build in stage.items()})
    return bars


def select(names: list[str], wanted: str | list[str] = "all", exclude: list[str] | None = None) -> list[str]:
    """Names to compute: all or those listed, less exclusions, in the library's order; an unknown name is an error."""
    asked = list(names) if wanted == "all" else list(wanted)
    unknown = sorted((set(asked) | set(exclude or ())) - set(names))
    if unknown:
        raise ValueError(f"unknown names: {', '.join(unknown)}")
    return [n for n in names if n in asked and n not in (exclude or ())]
