"""The whole research run: price panel -> features -> regime -> scores -> books -> weekly returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rolling import with_zscore
from ..operators import aggregates as A, filters as S, joins as J, portfolio as P, regime as G, timeseries as W
from ..session import materialise
from . import backtest


def broad_series(aligned_roles: DataFrame) -> DataFrame:
    """Daily and 20-day return of the market, one row per date."""
    b = aligned_roles.where("role = 'broad'")
    return W.pcts(b, {"ret": ("close", 1), "mom20": ("close", 20)}, ("role",)).select("date", "ret", "mom20")


def feature_panel(aligned: DataFrame, broad: DataFrame) -> DataFrame:
    """All features of each series and date.

    Every window is partitioned by series, so the panel is shuffled once, for
    the alignment, and stays in that layout.
    """
    df = W.pcts(aligned, {"ret": ("close", 1), "mom5": ("close", 5), "mom20": ("close", 20), "mom60": ("close", 60)})
    df = J.with_broad(df, broad, ("ret", "mom20"))
    df = W.vol(df, "ret", {20: 10, 100: 50, 252: 126})
    df = W.adv_rvol(df)
    df = W.above_sma(df)
    df = W.structure(df)
    df = W.beta(df, "ret", "broad_ret")
    df = W.trailing_max_dd(df)
    df = W.efficiency(df, {"er20": (20, 10, "open")})
    df = W.trend_r2(df)
    df = W.excess(W.vol_comp(df))
    df = W.rsi_wilder(W.fip(df))
    return with_zscore(df, {"mom20_z": "mom20", "mom60_z": "mom60", "vol20_z": "vol20", "fip_z": "fip"}, 60)


def signal_rows(features: DataFrame, rebal: DataFrame) -> DataFrame:
    """Features of the day before each rebalance date, under that date."""
    marks = rebal.select(F.col("date").alias("__d"), (F.col("idx") - 1).alias("idx"))
    return features.join(F.broadcast(marks), "idx").drop("date", "idx").withColumnRenamed("__d", "date")


def daily_regime(roles: DataFrame, features: DataFrame) -> DataFrame:
    """Regime record of every day (G01-G06) with breadth from the feature panel."""
    return G.classify(G.market_frame(roles), A.breadth(features))


def backtest_run(panel: DataFrame, roles: DataFrame, cal: DataFrame, sectors: DataFrame, scenarios: list[dict],
                 min_adv: float, min_price: float, min_history: int, short_gross: dict | None = None, aliases: DataFrame | None = None) -> dict:
    """Tables of one run: ``book``, ``trades`` (with CASH rows on dates without a book), ``weekly``, ``regime``.

    The feature panel and the aligned roles are stored, since the regime and the
    weekly rows both read them; the weekly regime chain compares with the
    week before. ``aliases`` (candidate names of indices and macro series) leave the universe before anything is computed of them.
    """
    if aliases is not None:
        panel = S.exclude(panel, aliases)
    role_rows = materialise(J.align(roles, cal, ("role",)), "roles")
    kept = S.min_history_aligned(J.align(panel, cal), min_history)
    features = materialise(feature_panel(kept, broad_series(role_rows)), "features")
    rebal = W.rebalance_dates(cal)
    marks = F.broadcast(rebal.select(F.col("date").alias("__d"), (F.col("idx") - 1).alias("__i")))
    days = cal.join(marks, F.col("idx") == F.col("__i")).select("date", "__d")
    daily = G.regime_probs(G.regime_inputs(G.macro_score(G.market_wide(G.market_frame(role_rows))), A.breadth(features)))
    weekly = G.gate(G.transition_risk(daily.join(F.broadcast(days), "date").drop("date").withColumnRenamed("__d", "date")))
    regime = materialise(weekly, "regime")
    universe = S.complete(S.liquid(signal_rows(features, rebal), min_adv, min_price))
    scored = backtest.store_scores(universe)
    sleeves = backtest.select_sleeves(scored, sectors, regime)
    budget = materialise(backtest.budgets(sleeves, regime, scenarios, short_gross), "budgets")
    book = materialise(backtest.book(sleeves, budget), "book")
    opens = backtest.with_gold(features, role_rows.where("role = 'gold'"))
    weekly_dates = backtest.rebalances(rebal)
    dates = P.sweep(regime.select("date"), [{"scenario": s["scenario"]} for s in scenarios])
    trades = P.with_cash_rows(backtest.trades(book, opens, weekly_dates), dates, backtest.BY_DATE)
    return {"book": book, "regime": regime, "trades": trades, "weekly": backtest.weekly_returns(book, opens, weekly_dates)}
