"""Date-hiding scenarios: which observations a method may see, and which it is scored on.

``make_scenario`` tags observations with ``role``: one row for each role an observation has. Every strategy
is a predicate on dates or a semi or anti join on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamcube.functions.scalars import hashed_unit
from loamcube.operators import joins, sampling, timeops
from loamcube.schemas import PIXEL, SERIES, HidingParameters

# The weighted list that random scenarios are drawn from.
DRAWN = ("RANDOM",) * 8 + ("GAPS",) * 4 + ("NOHR", "NOLR", "FORECAST", "BACKCAST")
STRATEGIES = (
    "ALL", "RANDOM", "RANDOM_ALL_DOYS", "GAPS", "NOHR", "NOLR", "FORECAST", "BACKCAST", "DEEPHARMO", "CONJLRuHR2HR", "CONJLR2HR",
    "LRuHRNOCONJ2HR", "HRNOCONJ2HR", "ALLHR2ALLHR", "ALL2CONJHR", "L3A", "L3A_10D", "CONTEXT", "CUSTOM",
)


def _tag(df: DataFrame, role: str) -> DataFrame:
    return df.withColumn("role", F.lit(role))


def _roles(inputs: list[DataFrame], targets: list[DataFrame]) -> DataFrame:
    out = None
    for role, parts in (("input", inputs), ("target", targets)):
        for df in parts:
            one = _tag(df, role)
            out = one if out is None else out.unionByName(one)
    return out


def _bands(obs: DataFrame) -> list[str]:
    return [c for c in obs.columns if c not in (*PIXEL, "doy", "masked")]


def _dummy_hr(obs: DataFrame, calendar: DataFrame) -> DataFrame:
    """A fully masked HR series on calendar dates."""
    px = obs.where("sensor = 'hr'").select(*PIXEL).distinct()
    grid = joins.query_grid(px, calendar)
    return grid.withColumns({**{b: F.lit(0.0) for b in _bands(obs)}, "masked": F.lit(True)}).select(obs.columns)


def _context(obs: DataFrame, p: HidingParameters) -> tuple[DataFrame, DataFrame]:
    """Per series: the dates around a period as input, those inside as further targets."""
    end = p.start + p.reference_size
    dates = obs.select(*SERIES, "doy").distinct()
    w = W.partitionBy(*SERIES)
    n = dates.withColumn("i", F.row_number().over(w.orderBy("doy")))
    # without a date on one side the series' end stands in
    first = F.coalesce(F.max(F.when(F.col("doy") <= p.start, F.col("i"))).over(w), F.lit(1))
    last = F.coalesce(F.min(F.when(F.col("doy") >= end, F.col("i"))).over(w), F.max("i").over(w))
    n = n.withColumns({"first": first, "last": last})
    before = F.col("i").between(F.col("first") + 1 - p.n_context, F.col("first"))
    after = F.col("i").between(F.col("last"), F.col("last") + p.n_context - 1)
    inside = (F.col("i") > F.col("first")) & (F.col("i") < F.col("last"))
    return n.where(before | after).select(*SERIES, "doy"), n.where(before | after | inside).select(*SERIES, "doy")


def seen_rows(p: HidingParameters) -> Column | None:
    """Which observations are inputs, by their own sensor and date; null for strategies that need more, or whose targets aren't all observations."""
    match p.strategy:
        case "ALL":
            return F.lit(True)
        case "GAPS":
            return ~timeops.hidden_by_gaps(F.col("doy"), p.gap, p.horizon)
        case "NOHR":
            return F.col("sensor") == "lr"
        case "NOLR":
            return F.col("sensor") == "hr"
        case "FORECAST":
            return F.col("doy") <= p.start
        case "BACKCAST":
            return F.col("doy") >= p.start
    return None


def make_scenario(obs: DataFrame, p: HidingParameters, origin: str | None = None) -> DataFrame:
    """Rows of ``obs`` with ``role``; an unknown strategy is an error.

    ``obs`` has site, px, sensor, doy, bands, masked. ``origin`` is the date of ``doy`` 0 for calendar strategies.
    """
    lr, hr = obs.where("sensor = 'lr'"), obs.where("sensor = 'hr'")
    conj, other = lambda s: joins.conjunctions(obs, s).select(obs.columns), lambda s: joins.non_conjunctions(obs, s).select(obs.columns)
    origin = origin or f"{p.year}-01-01"
    seen = seen_rows(p)
    if seen is not None:
        return _roles([obs.where(seen)], [obs])
    match p.strategy:
        case "RANDOM" | "RANDOM_ALL_DOYS":
            dates = obs.select(*SERIES, "doy").distinct()
            hidden = sampling.random_dates(dates, p.rate, p.seed)
            seen = obs.join(hidden, [*SERIES, "doy"], "left_anti").select(obs.columns)
            if p.strategy == "RANDOM":
                return _roles([seen], [obs])
            every = obs.select("site", "doy").distinct()
            return _roles([seen], [joins.calendar_join(obs, every, _bands(obs)).select(obs.columns)])
        case "DEEPHARMO":
            return _roles([lr, other("hr")], [obs])
        case "CONJLRuHR2HR":
            return _roles([conj("lr"), other("hr")], [conj("hr")])
        case "CONJLR2HR":
            return _roles([conj("lr")], [conj("hr")])
        case "LRuHRNOCONJ2HR":
            return _roles([lr, other("hr")], [conj("hr")])
        case "HRNOCONJ2HR":
            return _roles([other("hr")], [conj("hr")])
        case "ALLHR2ALLHR":
            return _roles([hr], [hr])
        case "ALL2CONJHR":
            return _roles([obs], [conj("hr")])
        case "L3A":
            return _roles([obs], [_dummy_hr(obs, timeops.half_month_calendar(obs.sparkSession, p.year, origin))])
        case "L3A_10D":
            return _roles([obs], [_dummy_hr(obs, timeops.regular_calendar(obs.sparkSession))])
        case "CONTEXT":
            given, scored = _context(obs, p)
            return _roles([joins.calendar_join(obs, given, _bands(obs)).select(obs.columns)], [joins.calendar_join(obs, scored, _bands(obs)).select(obs.columns)])
        case "CUSTOM":
            return _roles([obs], [joins.calendar_join(obs, timeops.listed_calendar(obs.sparkSession, p.dates), _bands(obs)).select(obs.columns)])
    raise ValueError(f"unknown strategy {p.strategy}")


def draw_scenarios(sites: DataFrame, seed: int = 0) -> DataFrame:
    """For each site a strategy from the weighted list and its parameters, by hash."""
    u = lambda what: hashed_unit(seed, F.lit(what), F.col("site"))
    names = F.array(*[F.lit(s) for s in DRAWN])
    return sites.select(
        "site",
        F.element_at(names, (F.floor(u("strategy") * len(DRAWN)) + 1).cast("int")).alias("strategy"),
        (0.2 + 0.5 * u("rate")).alias("rate"),
        F.floor(65 + 236 * u("start")).cast("int").alias("start"),
        F.floor(30 + 61 * u("gap")).cast("int").alias("gap"),
    )
