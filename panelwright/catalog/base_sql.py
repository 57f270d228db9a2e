"""SQL for the inputs that ``plans.tables`` builds, written against the raw tables."""

from .registry import part

SEQ = ("l_orderkey * 8388608 + l_linenumber * 1048576 + "
       "((l_partkey * 31 + l_suppkey * 7 + CAST(round(l_extendedprice * 100) AS BIGINT)) % 1048576)")
FRI = "CAST({0} AS DATE) + CAST((5 - isodow(CAST({0} AS DATE)) + 7) % 7 AS INTEGER)"

part("b_ticks", f"""
SELECT 'N' || s_nationkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price,
       l_quantity AS qty, {SEQ} AS seq, p_type
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey""")

BAR = ("arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, "
       "arg_max(price, seq) AS close, sum(qty) AS volume")
part("b_panel", f"SELECT ticker, date, {BAR} FROM b_ticks GROUP BY ticker, date")
part("b_broad", f"SELECT date, {BAR} FROM b_ticks GROUP BY date")
part("b_roles", f"""
SELECT role, date, open / k AS open, high / k AS high, low / k AS low, close / k AS close, volume FROM (
  SELECT role, date, CASE WHEN role = 'fear' THEN 200.0 ELSE 1.0 END AS k, {BAR} FROM (
    SELECT 'broad' AS role, date, price, qty, seq FROM b_ticks
    UNION ALL
    SELECT CASE p_type WHEN 'ECONOMY' THEN 'risk' WHEN 'STANDARD' THEN 'fear' WHEN 'SMALL' THEN 'usd'
                       WHEN 'PROMO' THEN 'us10y' WHEN 'MEDIUM' THEN 'gold' END, date, price, qty, seq
    FROM b_ticks WHERE p_type IN ('ECONOMY', 'STANDARD', 'SMALL', 'PROMO', 'MEDIUM'))
  GROUP BY role, date)""")
part("b_cal", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM b_ticks)")
part("b_grid", "SELECT ticker, date, idx FROM (SELECT DISTINCT ticker FROM b_panel), b_cal")
part("b_aligned", """
SELECT g.ticker, g.date, g.idx, p.open, p.high, p.low, p.close, p.volume
FROM b_grid g LEFT JOIN b_panel p ON p.ticker = g.ticker AND p.date = g.date""")
part("b_ret", """
SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM b_aligned""")
part("b_rolegrid", """
SELECT r.role, c.date, c.idx, p.open, p.high, p.low, p.close, p.volume FROM (SELECT DISTINCT role FROM b_roles) r, b_cal c
LEFT JOIN b_roles p ON p.role = r.role AND p.date = c.date""")
part("b_sectors", "SELECT 'N' || n_nationkey AS ticker, 'R' || n_regionkey AS sector FROM nation")
part("b_rebal", """
SELECT date, idx, lead(date) OVER (ORDER BY date) AS next_date, lead(idx) OVER (ORDER BY date) AS next_idx FROM (
  SELECT max(date) AS date, max(idx) AS idx FROM b_cal GROUP BY date + CAST((5 - isodow(date) + 7) % 7 AS INTEGER))""")

part("b_wraw", f"""
SELECT date, ticker, count(*) AS n, sum(l_quantity) AS q, round(sum(l_discount) / count(*), 9) AS d, round(sum(l_tax) / count(*), 9) AS t,
  round(sum(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*), 9) AS a,
  round(sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*), 9) AS r,
  round(sum(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*), 9) AS o,
  round(sum(l_linenumber)::DOUBLE / count(*), 9) AS ln, max(price) AS hi, min(price) AS lo
FROM (SELECT {FRI.format('l_shipdate')} AS date, 'N' || s_nationkey AS ticker, l_extendedprice / l_quantity AS price, *
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
GROUP BY date, ticker""")
part("b_features", """
SELECT date, ticker, n, (d * 4 - 0.2) AS mom60, (t * 5 - 0.2) AS mom20, ((d - t) * 2 - 0.02) AS mom5,
  (a - r) AS fip, CASE WHEN n > 1 THEN (a * 2 - 0.7) END AS fip_z, ((d - 0.05) * 30) AS mom60_z,
  ((t - 0.04) * 30) AS mom20_z, (0.1 + t * 4) AS vol20, CASE WHEN n > 2 THEN ((t - d) * 20) END AS vol20_z,
  (0.15 + d * 3) AS vol252, CASE WHEN n > 1 THEN (0.4 + o) END AS beta, q AS adv20, (ln * 12.5 + 5) AS rsi14,
  CASE WHEN o >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS above200,
  CASE WHEN a > r THEN 'VACUUM' WHEN a < r THEN 'TRAPPED' ELSE 'UNKNOWN' END AS structure,
  (-(t * 5 + d)) AS max_dd, (a * 0.9) AS r2, (r) AS er20, (0.5 + o) AS vol_comp,
  (q / 100.0) AS rvol20, (t * 5 - d * 4) AS excess20, (hi) AS close, (lo) AS open,
  ((d - 0.05) * 2 + (o - 0.5) * 0.1) AS fwd_ret
FROM b_wraw""")
part("b_names", f"""
SELECT date, ticker, (round(d / n, 9) - 0.05) * 2 + (round(o / n, 9) - 0.5) * 0.1 AS fwd_ret
FROM (SELECT {FRI.format('l_shipdate')} AS date, 'S' || l_suppkey AS ticker, count(*) AS n, sum(l_discount) AS d, sum(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END)::DOUBLE AS o
      FROM lineitem GROUP BY ALL)""")
part("b_wreg", f"""
SELECT date, round(sum(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*), 9) AS p1,
  round(sum(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*), 9) AS p2,
  round(sum(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*), 9) AS o,
  round(sum(l_tax) / count(*), 9) AS t, round(sum(l_discount) / count(*), 9) AS d, round(sum(l_quantity) / count(*), 9) AS q
FROM (SELECT {FRI.format('l_shipdate')} AS date, * FROM lineitem) GROUP BY date""")
part("b_regime", """
SELECT date, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 'BULL' WHEN p2 >= p1 AND p2 >= p3 THEN 'CHOP' ELSE 'BEAR' END AS regime,
  p1 AS p_bull, p2 AS p_chop, p3 AS p_bear, (t * 12) AS regime_confidence, (d * 12) AS transition_risk,
  o AS breadth, q AS vix, (t - 0.04) AS macro_score, ((d - 0.05) * 10) AS news_bias, (o * 1.1) AS suppression_score,
  CASE WHEN p1 >= p2 AND p1 >= p3 THEN 'Probabilistic bull regime' WHEN p2 >= p1 AND p2 >= p3 THEN 'Probabilistic mixed/chop regime'
       ELSE 'Probabilistic bear regime' END AS regime_reason
FROM (SELECT *, round(1 - p1 - p2, 9) AS p3 FROM b_wreg)""")
part("b_trades", """
SELECT *, 1e6 * weight * fwd_return AS net_pnl, abs(weight) AS gross_weight,
       CASE WHEN weight >= 0 THEN 'LONG' ELSE 'SHORT' END AS side FROM (
SELECT f.date, f.ticker, f.close, CASE WHEN n > 1 THEN (vol252 - 0.30) * 0.4 ELSE 0.0 END::DOUBLE AS weight, f.fwd_ret AS fwd_return,
  CASE WHEN (length(f.ticker) + n) % 3 = 0 THEN 'CHOP' ELSE g.regime END AS market_state, g.regime_confidence,
  p_bull - p_bear AS regime_score, p_bull, p_chop, p_bear, transition_risk, breadth, macro_score, news_bias, suppression_score,
  f.mom60_z AS mom_z, f.r2 AS efficiency, f.rsi14 / 100 AS score
FROM b_features f JOIN b_regime g ON f.date = g.date)""")
part("b_returns", f"""
SELECT 'S' || l_linenumber AS strategy, date, round((sum(l_tax) / count(*) - 0.04) + (sum(l_discount) / count(*) - 0.049), 9) AS portfolio_return
FROM (SELECT {FRI.format('l_shipdate')} AS date, * FROM lineitem) GROUP BY l_linenumber, date""")
part("b_articles", """
SELECT doc_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (doc_id % 30) DAY + INTERVAL ((doc_id * 7919) % 86400) SECOND AS published_at,
  'https://' || upper(source) || '.example.com/' || lang || '/' || (doc_id - doc_id % 2) AS url, source,
  split_part(text, chr(10), 1) AS title, text AS description, lang AS language FROM documents""")
part("b_sentiment", """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
  0.5 + (doc_id % 50) / 100.0 AS score FROM labels""")
