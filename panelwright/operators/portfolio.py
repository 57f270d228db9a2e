"""Scores, budgets, capped weights, books, turnover and P&L.

Scenario columns may be part of every key ``x``; a sweep over settings is the
same plan with more keys. Selected books hold at most a few dozen names per
scenario and date, so the windows that size them stay small whatever the
universe; the universe itself is only ever ranked by ``xsection``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import clip, let, sigmoid
from .xsection import DATE, cs_rank

# fixed values: sizes, caps and cost of the book
LONG_NAMES, SHORT_NAMES, KEEP_RANK = 20, 5, 30
STOCK_CAP, SECTOR_CAP, MAX_SINGLE, MAX_LEVERAGE = 0.08, 0.25, 0.10, 1.0
MOMENTUM_SPLIT, FRICTION_BPS, CAPITAL = 0.80, 15.0, 1_000_000.0
LONG_GROSS = {"BULL": 1.00, "CHOP": 0.30, "BEAR": 0.40}
SHORT_GROSS = {"BULL": 0.0, "CHOP": 0.0, "BEAR": 0.0}


# P01
def structure_score(df: DataFrame) -> DataFrame:
    vacuum = F.col("structure") == "VACUUM"
    strong = vacuum & (F.col("mom20") > 0) & (F.col("above200") >= 0.5)
    return df.withColumn("structure_score", F.when(strong, 1.0).when(vacuum, 0.7).otherwise(0.35))


# P02
def penalties(df: DataFrame) -> DataFrame:
    rsi, m = F.col("rsi14"), F.col("mom5")
    return df.withColumns({
        "rsi_penalty_long": F.when(rsi > 75, -0.15).when(rsi > 70, -0.05).otherwise(0.0),
        "rsi_penalty_short": F.when(rsi < 25, -0.15).when(rsi < 30, -0.05).otherwise(0.0),
        "mom5_penalty": F.when(m < -0.08, -0.10).when(m < -0.04, -0.05).otherwise(0.0)})


RANKED = ("fip", "fip_z", "mom20", "mom60", "vol20", "vol20_z", "beta", "adv20", "structure_score", "rsi14")
DEFENSIVE = {"pct_vol": ("vol252", False), "pct_max_dd": ("max_dd", True), "pct_r2": ("r2", True)}


def _r(col: str, *fallbacks) -> Column:
    return F.coalesce(F.col(f"rank_{col}"), *[F.col(f"rank_{f}") if isinstance(f, str) else F.lit(f) for f in fallbacks])


def with_ranks(df: DataFrame, x=DATE, defensive: bool = True) -> DataFrame:
    """All ranks the scores need, in one ranking pass.

    Momentum is to be ranked after standardising it within the date, with the
    plain rank where that is missing. Standardising keeps the order of the
    names, so both ranks are the same number and the plain one is used.
    """
    df = penalties(structure_score(df))
    wanted = {f"rank_{c}": (c, True) for c in RANKED}
    return cs_rank(df, {**wanted, **(DEFENSIVE if defensive else {})}, x)


# P03
def long_score(df: DataFrame) -> DataFrame:
    return df.withColumn("long_score", (
        0.28 * _r("mom60") + 0.18 * _r("mom20") + 0.10 * _r("fip_z", "fip")
        + 0.10 * _r("structure_score") + 0.12 * (1.0 - _r("vol20_z", "vol20")) + 0.06 * (1.0 - _r("beta", 0.5))
        + 0.06 * _r("adv20") + 0.10 * (1.0 - _r("rsi14", 0.5)) + F.col("rsi_penalty_long") + F.col("mom5_penalty")))


# P04
def short_score(df: DataFrame) -> DataFrame:
    return df.withColumn("short_score", (
        0.28 * (1.0 - _r("mom60")) + 0.18 * (1.0 - _r("mom20")) + 0.10 * (1.0 - _r("fip_z", "fip"))
        + 0.10 * (1.0 - _r("structure_score")) + 0.14 * _r("vol20_z", "vol20") + 0.10 * _r("beta", 0.5)
        + 0.05 * (1.0 - _r("adv20")) + 0.05 * _r("rsi14", 0.5) + F.col("rsi_penalty_short")))


# P05
def defensive_score(df: DataFrame) -> DataFrame:
    half = F.lit(0.5)
    return df.withColumn("defensive_score", 0.4 * F.coalesce("pct_r2", half) + 0.3 * F.coalesce("pct_vol", half)
                         + 0.3 * F.coalesce("pct_max_dd", half))


def score(df: DataFrame, x=DATE) -> DataFrame:
    return defensive_score(short_score(long_score(with_ranks(df, x))))


# P06
def model_score(df: DataFrame, pred: str, x=DATE) -> DataFrame:
    """Scores from the rank of a model's prediction; penalties as before."""
    df = cs_rank(penalties(df), {"rank_pred": (pred, True)}, x)
    return df.withColumns({"long_score": F.col("rank_pred") + F.col("rsi_penalty_long") + F.col("mom5_penalty"),
                           "short_score": 1.0 - F.col("rank_pred") + F.col("rsi_penalty_short")})


# P21
def sweep(df: DataFrame, scenarios: list[dict]) -> DataFrame:
    """One copy of each row per scenario, settings as columns. The list is a literal in the plan."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in scenarios])
    return df.withColumn("__s", F.explode(rows)).select(*df.columns, "__s.*")


# P07
def gross_budget(df: DataFrame, constant: float = 0.7731, long_gross=None, short_gross=None) -> DataFrame:
    """Long and short budget of a scenario and date.

    Reads ``exposure_mode`` and ``gold_model`` from the row, and long_count,
    short_count, regime, regime_confidence, vix, breadth, p_bear, transition_risk.
    """
    lg, sg = long_gross or LONG_GROSS, short_gross or SHORT_GROSS
    mode, state = F.col("exposure_mode"), F.col("regime")
    scale = 0.75 + 0.50 * clip("regime_confidence", 0.0, 1.0)
    has_l, has_s = F.col("long_count") > 0, F.col("short_count") > 0
    band_l = F.when(state == "BULL", lg["BULL"]).when(~has_l, 0.0).when(state == "BEAR", lg["BEAR"]).otherwise(lg["CHOP"]) * scale
    band_s = F.when(~has_s, 0.0).when(state == "BULL", sg["BULL"]).when(state == "BEAR", sg["BEAR"]).otherwise(sg["CHOP"]) * scale
    kappa = clip(1.0 - 0.02 * (F.coalesce("vix", F.lit(15.0)) - 15.0) + 0.05 * (F.coalesce("breadth", F.lit(0.43)) - 0.43), 0.20, 1.00)
    model = clip(1.0 - F.coalesce("p_bear", F.lit(0.0)) * 0.5, 0.3, 1.0)
    long = F.when(mode == "CONSTANT_DELEVERAGE", constant).when(mode == "DYNAMIC_GEOMETRY", kappa).when(mode == "MODEL", model).otherwise(band_l)
    short = F.when(mode == "REGIME_BANDS", band_s).otherwise(0.0)
    t = F.coalesce("transition_risk", F.lit(0.0))
    long = F.when(t >= 0.60, long * F.greatest(F.lit(0.40), 1.0 - 0.60 * t)).otherwise(long)
    short = F.when(t >= 0.60, short * F.greatest(F.lit(0.25), 1.0 - 0.80 * t)).otherwise(short)
    plain = F.col("gold_model") == "no_gold"
    df = df.withColumn("long_budget", F.when(plain, 1.0).otherwise(long))
    return df.withColumn("short_budget", F.when(plain, 0.0).otherwise(F.least(short, F.col("long_budget") * 0.30)))


# P08
def risk_budget(df: DataFrame, kappa: str = "kappa", low: float = 0.20, high: float = 1.00) -> DataFrame:
    k = clip(kappa, low, high)
    return df.withColumns({"gross_leverage": k, "max_single_stock": clip(0.05 * k, 0.02, 0.05),
                           "sector_limit": clip(0.25 * k, 0.12, 0.25), "cash_buffer": 1.0 - k})


# P09
def blend_weights(df: DataFrame, score_col: str = "score", mix=0.60, x=("date", "sleeve")) -> DataFrame:
    """Share of shifted score blended with share of inverse deviation; adds ``raw``, which sums to 1.

    ``mix`` is a number or a column. ``x`` must describe a selected sleeve.
    """
    m = mix if isinstance(mix, Column) else F.lit(float(mix))
    w = Window.partitionBy(*x)
    df = df.withColumns({"__s": F.greatest(F.col(score_col) - F.min(score_col).over(w) + 1e-6, F.lit(1e-6)),
                         "__v": 1.0 / F.coalesce(F.nullif(F.col("vol20"), F.lit(0.0)), F.median("vol20").over(w))})
    df = df.withColumns({"__ss": F.sum("__s").over(w), "__sv": F.sum("__v").over(w)})
    df = df.withColumn("__b", m * F.col("__s") / F.col("__ss") + (1.0 - m) * F.col("__v") / F.col("__sv"))
    return df.withColumn("raw", F.col("__b") / F.sum("__b").over(w)).drop("__s", "__v", "__ss", "__sv", "__b")


# P10
def cap_iterate(df: DataFrame, budget: str = "budget", rounds: int = 5, x=("date", "sleeve"), sector_caps: Column | None = None,
                stock: float = STOCK_CAP, sector: float = SECTOR_CAP) -> DataFrame:
    """Up to ``rounds`` of clipping single shares and scaling breached sectors, each followed by renormalising.

    A round that finds nothing to do leaves the shares as they are, so all
    rounds run without a stop flag. All windows share one partitioning and one
    sort. ``sector_caps`` is false for sleeves without a sector rule.
    """
    g, gs = Window.partitionBy(*x), Window.partitionBy(*x, "sector")
    ruled = F.lit(True) if sector_caps is None else sector_caps
    base = F.greatest(F.lit(1e-5), F.col(budget))
    df = df.withColumns({"__cap": stock / base, "__scap": sector / base, "__mx": F.max("raw").over(g)})
    for _ in range(rounds):
        clipped = F.col("__mx") > F.col("__cap") + 1e-4
        df = df.withColumn("__c", F.when(clipped, F.least("raw", "__cap")).otherwise(F.col("raw")))
        df = df.withColumns({"__t": F.sum("__c").over(g), "__z": F.sum("__c").over(gs)})
        total = F.when(clipped, F.col("__t")).otherwise(F.lit(1.0))
        df = df.withColumns({"__n": F.col("__c") / total, "__z": F.col("__z") / total})
        breach = ruled & (F.col("__z") > F.col("__scap") + 1e-4)
        df = df.withColumns({"__k": F.when(breach, F.col("__n") * F.col("__scap") / F.col("__z")).otherwise(F.col("__n")),
                             "__br": breach.cast("int")})
        df = df.withColumns({"__any": F.max("__br").over(g), "__t": F.sum("__k").over(g),
                             "__mk": F.max("__k").over(g), "__mn": F.max("__n").over(g)})
        scaled = F.col("__any") > 0
        df = df.withColumns({"raw": F.when(scaled, F.col("__k") / F.col("__t")).otherwise(F.col("__n")),
                             "__mx": F.when(scaled, F.col("__mk") / F.col("__t")).otherwise(F.col("__mn"))})
    return df.drop("__cap", "__scap", "__mx", "__c", "__t", "__z", "__n", "__k", "__br", "__any", "__mk", "__mn")


# P11
def adjust(df: DataFrame, budget: str = "budget") -> DataFrame:
    """Position weight from its share: fear cut, structure bonus, single cap, sign."""
    short = F.col("sleeve") == "SHORT"
    base = F.col(budget) * F.col("raw")
    cut = F.when(F.coalesce(F.col("vix") > 24, F.lit(False)), F.when(short, 0.85).otherwise(0.75)).otherwise(1.0)
    good_long = (F.col("sleeve") == "MOMENTUM") & (F.col("structure") == "VACUUM") & (F.col("fip") > 0)
    good_short = short & (F.col("structure") == "TRAPPED") & (F.col("mom60") < 0)
    bonus = F.when(F.coalesce(good_long | good_short, F.lit(False)), 1.10).otherwise(1.0)
    w = F.least(base * cut * bonus, F.lit(MAX_SINGLE))
    return df.withColumns({"base_weight": base, "weight": F.when(short, -w).otherwise(w)})


# U02
SLEEVE_ORDER = {"SHORT": 0, "MOMENTUM": 1, "DEFENSIVE": 2}


def merge_sleeves(df: DataFrame, x=DATE, keep=("score",)) -> DataFrame:
    """One row per name: long sleeves add up, a short position replaces them.

    The attributes in ``keep`` come from the first sleeve in SLEEVE_ORDER.
    """
    rank = F.create_map(*[F.lit(v) for kv in SLEEVE_ORDER.items() for v in kv])[F.col("sleeve")]
    short = F.col("sleeve") == "SHORT"
    any_short = F.max(short.cast("int"))
    def total(c):
        return F.when(any_short > 0, F.sum(F.when(short, F.col(c)))).otherwise(F.sum(c)).alias(c)
    return df.withColumn("__o", rank).groupBy(*x, "ticker").agg(
        total("weight"), total("base_weight"), F.min_by("sleeve", "__o").alias("sleeve"),
        *[F.min_by(c, "__o").alias(c) for c in keep]).withColumn("side", F.when(F.col("sleeve") == "SHORT", "SHORT").otherwise("LONG"))


# U04
def minus(a: DataFrame, b: DataFrame, keys=("date", "ticker")) -> DataFrame:
    return a.join(b.select(*keys), list(keys), "left_anti")


# P12
def gold_weight(df: DataFrame, cap: float = 0.25) -> DataFrame:
    """Weight of the gold sleeve by ``gold_model``; below 0.5% there is none."""
    rest, p = (1.0 - F.col("long_budget")) * F.col("p_bear"), F.col("p_bear")
    m = F.col("gold_model")
    w = (F.when(m == "no_gold", 0.0).when(m == "capped", F.least(rest, F.lit(0.20)))
         .when(m == "sigmoid", 0.35 * sigmoid(4.0 * (p - 0.5))).otherwise(rest))
    return df.withColumn("gold_weight", F.least(w, F.lit(cap))).withColumn(
        "gold_weight", F.when(F.col("gold_weight") > 0.005, F.col("gold_weight")).otherwise(0.0))


def gold_rows(df: DataFrame, x=DATE) -> DataFrame:
    """The gold position as book rows."""
    g = df.where(F.col("gold_weight") > 0)
    return g.select(*x, F.lit("GOLDBEES").alias("ticker"), F.lit("GOLD").alias("side"), F.lit("GOLD").alias("sleeve"),
                    F.lit("GOLD").alias("sector"), F.col("gold_weight").alias("weight"), F.col("gold_weight").alias("base_weight"),
                    F.lit(0.0).alias("score"))


# P13
def book_caps(df: DataFrame, sector: float = SECTOR_CAP, gross: float = MAX_LEVERAGE, x=DATE) -> DataFrame:
    """Scales sectors above the cap (gold exempt), then the whole book above the gross limit."""
    gold = F.col("side") == "GOLD"
    gs, g = Window.partitionBy(*x, "sector", gold), Window.partitionBy(*x)
    df = df.withColumn("__s", F.sum(F.abs("weight")).over(gs))
    df = df.withColumn("weight", F.when(~gold & (F.col("__s") > sector), F.col("weight") * sector / F.col("__s")).otherwise(F.col("weight")))
    df = df.withColumn("__g", F.sum(F.abs("weight")).over(g))
    return df.withColumn("weight", F.when(F.col("__g") > gross, F.col("weight") * gross / F.col("__g")).otherwise(F.col("weight"))).drop("__s", "__g")


# P14
def turnover_cost(delta: DataFrame, capital: float = CAPITAL, bps: float = FRICTION_BPS, x=DATE) -> DataFrame:
    """Turnover and its cost from old and new weights."""
    out = delta.groupBy(*x).agg(F.sum(F.abs("delta")).alias("turnover"))
    return out.withColumn("friction_cost", F.col("turnover") * capital * (bps / 10000.0))


# P15
def forward_open_return(weights: DataFrame, panel: DataFrame, rebal: DataFrame) -> DataFrame:
    """Open-to-open return to the next rebalance date; unknown or non-positive opens give 0.

    The two prices of a name and week come from one grouped pass over the
    panel's rebalance rows instead of two joins.
    """
    days = F.broadcast(rebal.select("date", "next_date"))
    opens = panel.select("ticker", "date", "open").where(F.col("open").isNotNull())
    entry = opens.join(days.where(F.col("next_date").isNotNull()), "date").select("ticker", "date", F.col("open").alias("entry"), F.lit(None).cast("double").alias("exit"))
    leave = opens.join(days.select(F.col("date").alias("__from"), F.col("next_date").alias("date")), "date").select(
        "ticker", F.col("__from").alias("date"), F.lit(None).cast("double").alias("entry"), F.col("open").alias("exit"))
    both = entry.unionByName(leave).groupBy("ticker", "date").agg(F.max("entry").alias("entry_price"), F.max("exit").alias("exit_price"))
    good = (F.col("entry_price") > 0) & F.col("exit_price").isNotNull()
    out = weights.join(both, ["ticker", "date"], "left")
    return out.withColumn("fwd_return", F.when(good, F.col("exit_price") / F.col("entry_price") - 1.0).otherwise(0.0))


# P16
def pnl(df: DataFrame, capital: float = CAPITAL) -> DataFrame:
    return df.withColumns({"gross_weight": F.abs("weight"), "gross_pnl": capital * F.col("weight") * F.col("fwd_return"),
                           "leverage_mult": F.abs("weight") / F.greatest(F.lit(1e-9), F.col("base_weight"))})


def weekly_book_returns(book: DataFrame, costs: DataFrame, capital: float = CAPITAL, x=DATE) -> DataFrame:
    """Weekly rows: return after cost, exposures, turnover."""
    per = book.groupBy(*x).agg(F.sum("gross_pnl").alias("gross_pnl"), F.sum(F.abs("weight")).alias("gross_exposure"),
                               F.sum("weight").alias("net_exposure"))
    out = per.join(costs, list(x), "left")
    net = F.col("gross_pnl") - F.coalesce("friction_cost", F.lit(0.0))
    return out.withColumns({"net_pnl": net, "portfolio_return": net / capital})


# P17
def with_cash_rows(book: DataFrame, dates: DataFrame, x=DATE) -> DataFrame:
    """A CASH row of weight 0 on dates without a position."""
    empty = dates.select(*x).join(book.select(*x).distinct(), list(x), "left_anti")
    cash = empty.withColumns({"ticker": F.lit("CASH"), "side": F.lit("CASH"), "weight": F.lit(0.0)})
    return book.unionByName(cash, allowMissingColumns=True)


# P18
def rank_buffer(cands: DataFrame, keep: int = KEEP_RANK, n: int = LONG_NAMES, score_col: str = "score", by=("scenario",), turn: str | None = None) -> DataFrame:
    """Selection with memory: held names ranked within ``keep`` stay, free places go to the best others.

    At most ``n`` names are held, so the best ``max(keep, 2n)`` of each date
    decide the outcome; only those reach the walk, which takes the dates of
    one scenario in order. ``turn`` numbers the dates that have a book: nothing is held
    after a turn without candidates. Without it such dates leave the holdings as they are.
    """
    from .xsection import top_k
    extra = [turn] if turn else []
    short = top_k(cands.select(*by, "date", "ticker", score_col, *extra), score_col, max(keep, 2 * n), (*by, "date"), rank="place")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        held, picks, last = set(), [], None
        for _, day in pdf.sort_values(["date", "place"]).groupby("date", sort=True):
            if turn:
                now = day[turn].iloc[0]
                held, last = held if last is not None and now == last + 1 else set(), now
            picked = choose(day["ticker"].tolist(), held, keep, n)
            held = set(picked)
            picks.append(day[day["ticker"].isin(held)])
        return pd.concat(picks)

    return short.groupBy(*by).applyInPandas(walk, short.schema)


def choose(ranked: list, held: set, keep: int, n: int) -> list:
    """One date of the rank buffer: names in rank order and the names held before."""
    kept = [t for t in ranked[:keep] if t in held]
    if len(kept) >= n:
        return kept[:n]
    return kept + [t for t in ranked if t not in held][: n - len(kept)]


# P19
def cov_matrix(r: np.ndarray, estimator: str = "sample", span: int = 63, ridge: float = 1e-4) -> np.ndarray:
    """Covariance of return columns; a small diagonal is added for stability."""
    n, p = r.shape
    if estimator == "ewma":
        k = 1.0 - 2.0 / (span + 1.0)
        w = k ** np.arange(n - 1, -1, -1.0)
        d = r - (w @ r) / w.sum()
        cov = (d * w[:, None]).T @ d / w.sum()
        bias = w.sum() ** 2 - (w ** 2).sum()
        cov = cov * (w.sum() ** 2 / bias) if bias > 0 else np.full((p, p), np.nan)
    else:
        c = r - r.mean(axis=0)
        s = c.T @ c
        if estimator == "sample":
            cov = s / (n - 1) if n > 1 else np.full((p, p), np.nan)
        else:
            s = s / n
            mu = np.trace(s) / p
            if estimator == "oas":
                a = (s ** 2).mean()
                den = (n + 1.0) * (a - mu ** 2 / p)
                rho = 1.0 if den == 0 else min((a + mu ** 2) / den, 1.0)
            else:
                d = ((s ** 2).sum() - 2 * mu * np.trace(s) + p * mu ** 2) / p
                b = min(((c ** 2).T @ (c ** 2) / n - s ** 2).sum() / (p * n), d)
                rho = 0.0 if d == 0 else b / d
            cov = (1 - rho) * s
            cov[np.diag_indices(p)] += rho * mu
    return np.nan_to_num(cov) + ridge * np.eye(p)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def covariance(selected: DataFrame, estimator: str = "sample", past: str = "past", x=DATE, span: int = 63, ridge: float = 1e-4) -> DataFrame:
    """Entries i <= j of the trailing covariance of a date's selected names (J14 arrays, one length per date), with a small diagonal.

    ``estimator``: sample, ewma, oas or ledoit_wolf. A selection has a few dozen names per date, whose past values travel as one
    array each; the panel is not joined with itself. Pairs of names are sums over two arrays; what shrinkage
    needs of the whole matrix (trace, squares) are sums over the date's pairs, each off the diagonal counted twice.
    """
    n = F.size(past)
    rows = selected.where(n > 1).select(*x, "ticker", F.col(past).alias("__p"), n.alias("__n"))
    if estimator == "ewma":
        decay = 1.0 - 2.0 / (span + 1.0)
        weights = F.transform(F.sequence(F.lit(1), F.col("__n")), lambda i: F.pow(F.lit(decay), F.col("__n") - i))
        total = (1.0 - F.pow(F.lit(decay), F.col("__n"))) / (1.0 - decay)
        squares = (1.0 - F.pow(F.lit(decay), 2 * F.col("__n"))) / (1.0 - decay ** 2)
        # each side carries the root of the weight, so a pair is a plain sum of products
        centred = let(weights, lambda w: let(_dot(F.col("__p"), w) / total, lambda m: F.zip_with(F.col("__p"), w, lambda v, u: (v - m) * F.sqrt(u))))
        scale = F.when(total * total - squares > 0, total / (total * total - squares))
    else:
        centred = let(F.aggregate("__p", F.lit(0.0), lambda s, v: s + v) / F.col("__n"), lambda m: F.transform("__p", lambda v: v - m))
        scale = 1.0 / (F.col("__n") - 1) if estimator == "sample" else 1.0 / F.col("__n")
    rows = rows.withColumns({"__c": centred, "__k": scale}).drop("__p")
    left = rows.select(*x, F.col("ticker").alias("ticker_i"), F.col("__c").alias("__a"), "__n", "__k")
    right = rows.select(*x, F.col("ticker").alias("ticker_j"), F.col("__c").alias("__b"))
    pairs = left.join(right, list(x)).where("ticker_i <= ticker_j")
    cov = {"__s": _dot(F.col("__a"), F.col("__b")) * F.col("__k")}
    if estimator == "ledoit_wolf":
        cov["__q"] = F.aggregate(F.zip_with("__a", "__b", lambda v, u: v * v * u * u), F.lit(0.0), lambda s, v: s + v) / F.col("__n")
    pairs = pairs.select(*x, "ticker_i", "ticker_j", "__n", *[c.alias(o) for o, c in cov.items()])
    same = F.col("ticker_i") == F.col("ticker_j")
    if estimator in ("sample", "ewma"):
        value = F.coalesce("__s", F.lit(0.0))
    else:
        twice = F.when(same, 1.0).otherwise(2.0)
        one = Window.partitionBy(*x)  # the pairs of one selection
        sums = {"__p": F.sum(same.cast("long")).over(one), "__tr": F.sum(F.when(same, F.col("__s")).otherwise(0.0)).over(one), "__ss": F.sum(twice * F.col("__s") * F.col("__s")).over(one)}
        if estimator == "ledoit_wolf":
            sums["__qq"] = F.sum(twice * F.col("__q")).over(one)
        pairs = pairs.withColumns(sums)
        p, number, square = F.col("__p"), F.col("__n"), F.col("__ss")
        mu = F.col("__tr") / p
        if estimator == "oas":
            mean = square / (p * p)
            below = (number + 1.0) * (mean - mu * mu / p)
            rho = F.when(below == 0, 1.0).otherwise(F.least(F.try_divide(mean + mu * mu, below), F.lit(1.0)))
        else:
            apart = (square - 2 * mu * F.col("__tr") + p * mu * mu) / p
            noise = F.least((F.col("__qq") - square) / (p * number), apart)
            rho = F.when(apart == 0, 0.0).otherwise(F.try_divide(noise, apart))
        pairs = pairs.withColumns({"__mu": mu, "__rho": rho})
        value = (1.0 - F.col("__rho")) * F.col("__s") + F.when(same, F.col("__rho") * F.col("__mu")).otherwise(0.0)
    return pairs.select(*x, "ticker_i", "ticker_j", (value + F.when(same, ridge).otherwise(0.0)).alias("cov"))


# P20
def _to_budget(v: np.ndarray, cap: float, total: float) -> np.ndarray:
    """Nearest point with entries in 0..cap that adds up to ``total``."""
    lo, hi = v.min() - cap, v.max()
    for _ in range(50):
        mid = (lo + hi) / 2
        if np.clip(v - mid, 0, cap).sum() > total:
            lo = mid
        else:
            hi = mid
    return np.clip(v - (lo + hi) / 2, 0, cap)


def _project(v, groups, cap, sector, total, rounds=12):
    """Nearest feasible point by alternating corrected projections."""
    p, q, x = np.zeros_like(v), np.zeros_like(v), v
    for _ in range(rounds):
        y = _to_budget(x + p, cap, total)
        p = x + p - y
        x = y + q
        for idx in groups:
            over = x[idx].sum() - sector
            if over > 0:
                x[idx] -= over / len(idx)
        q = y + q - x
        if np.abs(x - y).max() < 1e-9:
            break
    return _to_budget(x, cap, total)


def solve_weights(mu, cov, prev, sectors, total, lam=1.0, gamma=0.005, cap=STOCK_CAP, sector=SECTOR_CAP, steps=150):
    """Long-only weights that trade return against risk and smoothed turnover; equal weights if the caps cannot hold."""
    n = len(mu)
    groups = [np.where(sectors == s)[0] for s in np.unique(sectors)]
    room = sum(min(sector, cap * len(g)) for g in groups)
    if total > room + 1e-12 or total <= 0:
        return np.full(n, total / n), False
    w = _project(np.full(n, total / n), groups, cap, sector, total)
    rate = 1.0 / (lam * np.linalg.norm(cov, 2) + gamma / 1e-3)
    for _ in range(steps):
        d = w - prev
        grad = -mu + lam * cov @ w + gamma * d / np.sqrt(d * d + 1e-6)
        new = _project(w - rate * grad, groups, cap, sector, total)
        if np.abs(new - w).max() < 1e-8:
            return new, True
        w = new
    return w, True


def mean_variance(selected: DataFrame, estimator: str = "sample", lam: float = 1.0, gamma: float = 0.005, x=DATE, past: str = "past") -> DataFrame:
    """Independent small optimisations, one per key. Columns: ticker, sector, mu, prev_weight, budget and the past returns."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ticker")
        cov = cov_matrix(np.array(pdf[past].tolist(), dtype=float).T, estimator)
        w, ok = solve_weights(pdf["mu"].to_numpy(float), cov, pdf["prev_weight"].to_numpy(float), pdf["sector"].to_numpy(), float(pdf["budget"].iloc[0]),
                              lam, gamma)
        return pdf[[*x, "ticker", "sector"]].assign(weight=w, feasible=ok)

    keys = ", ".join(f"`{k}` {selected.schema[k].dataType.simpleString()}" for k in x)
    cols = [*x, "ticker", "sector", "mu", "prev_weight", "budget", past]
    return selected.where(F.size(past) > 1).select(*cols).groupBy(*x).applyInPandas(
        work, f"{keys}, ticker string, sector string, weight double, feasible boolean")


# P22
def counterfactual(df: DataFrame, exposure, risk_free: float = 0.05) -> DataFrame:
    """What the week would have returned at another exposure, less the weekly risk-free rate."""
    e = clip(exposure if isinstance(exposure, (str, Column)) else F.lit(float(exposure)), 0.0, 1.0)
    base = F.col("portfolio_return") / F.greatest(F.lit(0.01), F.col("gross_exposure"))
    return df.withColumns({"base_return": base, "agent_return": base * e, "reward": base * e - risk_free / 52.0})


# P23
def attribution(df: DataFrame) -> DataFrame:
    """Parts of a holding's score; what they do not explain is the residual."""
    parts = {"momentum_part": F.coalesce("mom_z", F.lit(0.0)) * 0.4, "macro_part": F.coalesce("macro_score", F.lit(0.0)) * 0.2,
             "regime_part": F.coalesce("regime_confidence", F.lit(0.0)) * 0.2}
    df = df.withColumns(parts)
    return df.withColumn("residual", F.col("score") - sum([F.col(c) for c in list(parts)[1:]], F.col("momentum_part")))
