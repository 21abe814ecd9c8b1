"""DuckDB SQL over the same tables, one text per query, for checking results."""

from __future__ import annotations

# --- Fixed values: feature names and answer texts, written out so that they check the engine's
LABELS = {
    "rolling_avg_30d": "Monthly Sales Momentum",
    "rolling_avg_7d": "Weekly Sales Momentum",
    "revenue_lag_7": "Sales from Previous Week",
    "revenue_lag_1": "Sales from Yesterday",
    "revenue_lag_30": "Sales from Last Month",
    "day_of_month": "Payday / Time of Month",
    "day_of_week": "Day of the Week",
    "is_weekend": "Weekend Effect",
    "revenue_lag_14": "Sales from 2 Weeks Ago",
}
PAYMENT = (
    "Based on the currently selected data, **%s** is your most popular payment method, "
    "accounting for **%s%%** of all transactions. I recommend ensuring your %s checkout "
    "flow is completely frictionless."
)
REFUND_HIGH = (
    "I noticed your refund rate is currently at **%s%%**, which is higher than the platform "
    "average of 2.5%%. This is negatively impacting your net revenue. The anomaly detection "
    "system flags spikes primarily on weekends."
)
REFUND_HEALTHY = (
    "Your refund rate is healthy at **%s%%**. I don't see any major anomalies causing revenue "
    "drops in this period."
)
FORECAST = (
    "Looking ahead %s days, our Gradient Boosting model expects stable growth driven by strong "
    "monthly momentum. However, expect a slight dip on weekends based on your historical patterns."
)
DEFAULT = (
    "That's a great question about your data. In this specific period, you processed **%s** "
    "payments totaling **₹%s Cr**. Try asking me specifically about payment methods, refunds, "
    "or future forecasts!"
)

MERCHANTS = """merchants AS (
  SELECT c_custkey AS merchant_id, c_name AS merchant_name, c_mktsegment AS business_category,
         CASE WHEN c_acctbal >= 9000 THEN 'Enterprise' WHEN c_acctbal >= 6000 THEN 'Mid-Market'
              ELSE 'SMB' END AS business_size
  FROM customer)"""

RAW = """raw AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS merchant_id, o_orderdate AS transaction_date,
         CAST(o_orderdate AS DATE) AS agg_date,
         CAST(o_totalprice AS DECIMAL(18,2)) AS transaction_amount,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL
              WHEN o_orderpriority = '1-URGENT' THEN 'Credit Card'
              WHEN o_orderpriority = '2-HIGH' THEN 'Debit Card'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'UPI'
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Net Banking'
              WHEN o_orderpriority = '5-LOW' THEN 'Wallet' END AS payment_method,
         CASE WHEN o_orderkey % 100 < 7 THEN 'Failed' WHEN o_orderkey % 100 < 10 THEN 'Refunded'
              ELSE 'Successful' END AS payment_status
  FROM orders)"""

TXNS = (
    RAW
    + """, priced AS (
  SELECT *,
         CASE WHEN payment_status = 'Successful'
              THEN CAST(round(transaction_amount * CAST(
                     CASE payment_method WHEN 'UPI' THEN 0.000 WHEN 'Credit Card' THEN 0.020
                       WHEN 'Debit Card' THEN 0.009 WHEN 'Net Banking' THEN 0.015
                       ELSE 0.018 END AS DECIMAL(4,3)), 2) AS DECIMAL(18,2))
              ELSE CAST(0 AS DECIMAL(18,2)) END AS processing_fee,
         CASE WHEN payment_status = 'Refunded' THEN transaction_amount
              ELSE CAST(0 AS DECIMAL(18,2)) END AS refund_amount
  FROM raw), txns AS (
  SELECT *,
         CASE WHEN payment_status IN ('Successful', 'Refunded')
              THEN transaction_amount - processing_fee - refund_amount
              ELSE CAST(0 AS DECIMAL(18,2)) END AS settlement_amount
  FROM priced)"""
)

DAILY = (
    TXNS
    + """, daily AS (
  SELECT agg_date, merchant_id,
         sum(CASE WHEN payment_status = 'Successful' THEN transaction_amount ELSE 0 END) AS gross,
         sum(settlement_amount) AS net,
         count(*) AS total,
         count(*) FILTER (payment_status = 'Successful') AS succ,
         count(*) FILTER (payment_status = 'Failed') AS fail,
         count(*) FILTER (payment_status = 'Refunded') AS ref,
         sum(processing_fee) AS fees, sum(refund_amount) AS refunds
  FROM txns GROUP BY agg_date, merchant_id)"""
)

JOINED = f"""{DAILY}, {MERCHANTS}, joined AS (
  SELECT d.*, m.merchant_name, m.business_category, m.business_size
  FROM daily d JOIN merchants m ON d.merchant_id = m.merchant_id)"""

IN_PERIOD = "agg_date BETWEEN DATE '2000-10-01' AND DATE '2000-12-31'"
TS_PERIOD = (
    "transaction_date >= TIMESTAMP '2000-10-01' AND transaction_date < TIMESTAMP '2000-12-31'"
)

CATEGORY_SERIES = f"""{JOINED}, series AS (
  SELECT business_category AS series_key, agg_date, CAST(sum(net) AS DOUBLE) AS net_revenue
  FROM joined GROUP BY ALL)"""

MERCHANT_SERIES = f"""{DAILY}, series AS (
  SELECT CAST(merchant_id AS VARCHAR) AS series_key, agg_date, CAST(net AS DOUBLE) AS net_revenue
  FROM daily)"""

PLATFORM_SERIES = f"""{DAILY}, series AS (
  SELECT 'Platform' AS series_key, agg_date, CAST(sum(net) AS DOUBLE) AS net_revenue
  FROM daily GROUP BY ALL)"""

SPINE = """spine AS (
  SELECT k.series_key, CAST(g.day AS DATE) AS agg_date
  FROM (SELECT DISTINCT series_key FROM series) k,
       (SELECT unnest(generate_series(min(agg_date), max(agg_date), INTERVAL 1 DAY)) AS day
        FROM series) g), filled AS (
  SELECT p.series_key, p.agg_date, coalesce(s.net_revenue, 0.0) AS net_revenue
  FROM spine p LEFT JOIN series s USING (series_key, agg_date))"""

FEATURES = """framed AS (
  SELECT *, isodow(agg_date) - 1 AS day_of_week, day(agg_date) AS day_of_month,
         month(agg_date) AS month, CASE WHEN isodow(agg_date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         lag(net_revenue, 1) OVER w AS revenue_lag_1, lag(net_revenue, 7) OVER w AS revenue_lag_7,
         lag(net_revenue, 14) OVER w AS revenue_lag_14,
         lag(net_revenue, 30) OVER w AS revenue_lag_30,
         CASE WHEN count(net_revenue) OVER w7 = 7 THEN avg(net_revenue) OVER w7 END
           AS rolling_avg_7d,
         CASE WHEN count(net_revenue) OVER w30 = 30 THEN avg(net_revenue) OVER w30 END
           AS rolling_avg_30d
  FROM filled
  WINDOW w AS (PARTITION BY series_key ORDER BY agg_date),
         w7 AS (PARTITION BY series_key ORDER BY agg_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
         w30 AS (PARTITION BY series_key ORDER BY agg_date
                 ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))"""


def day_text(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d')"


def pct(part: str, whole: str) -> str:
    return (
        f"CAST(100 AS DOUBLE) * CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0)"
    )


def baseline(horizon: int) -> str:
    """Common table ``predicted`` over ``series``."""
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY agg_date DESC) AS age FROM series),
base AS (
  SELECT series_key, max(agg_date) AS last_date,
         CASE WHEN count(net_revenue) = 30 THEN avg(net_revenue) END AS base
  FROM ranked WHERE age <= 30 GROUP BY series_key),
days AS (
  SELECT series_key, base, last_date + CAST(step AS INTEGER) AS target_date
  FROM base, (SELECT unnest(range(1, {horizon + 1})) AS step)),
predicted AS (
  SELECT series_key, target_date,
         base * CASE WHEN isodow(target_date) >= 6 THEN CAST(0.8 AS DOUBLE)
                     ELSE CAST(1.1 AS DOUBLE) END AS predicted_revenue
  FROM days)"""


def forecast_rows(level: str) -> str:
    return f"""{day_text('target_date')} AS target_date, '{level}' AS forecast_level, series_key,
  'Baseline_EWMA' AS model_name, round(predicted_revenue, 4) AS predicted_revenue,
  round(predicted_revenue * CAST(0.8 AS DOUBLE), 4) AS confidence_lower,
  round(predicted_revenue * CAST(1.2 AS DOUBLE), 4) AS confidence_upper"""


COMPARE = f"""{JOINED}, sums AS (
  SELECT sum(net) FILTER ({IN_PERIOD}) AS cur,
         sum(net) FILTER (agg_date BETWEEN DATE '2000-07-02' AND DATE '2000-10-01') AS prev,
         CAST(sum(total) FILTER ({IN_PERIOD}) AS BIGINT) AS total_txns,
         sum(succ) FILTER ({IN_PERIOD}) AS succ, sum(ref) FILTER ({IN_PERIOD}) AS ref
  FROM joined), figures AS (
  SELECT CAST(cur AS DOUBLE) AS total_rev,
         CASE WHEN prev IS NULL OR prev = 0 THEN CAST(cur AS DOUBLE)
              ELSE CAST(prev AS DOUBLE) END AS prev_rev,
         CASE WHEN cur IS NULL THEN NULL WHEN prev IS NULL OR prev = 0 THEN CAST(0 AS DOUBLE)
              ELSE (CAST(cur AS DOUBLE) - CAST(prev AS DOUBLE)) / CAST(prev AS DOUBLE)
                   * CAST(100 AS DOUBLE) END AS rev_trend,
         total_txns, {pct('succ', 'total_txns')} AS success_rate,
         {pct('ref', 'total_txns')} AS refund_rate
  FROM sums)"""


def contains_any(*words: str) -> str:
    return " OR ".join(f"contains(lower(text), '{word}')" for word in words)


ROUTED = f"""routed AS (
  SELECT conv_id, turn, role,
         CASE WHEN {contains_any('ouè', 'méthode')} THEN 'payment'
              WHEN {contains_any('ment')} THEN 'refund'
              WHEN {contains_any('the')} THEN 'forecast' ELSE 'default' END AS intent
  FROM conversations WHERE role = 'user')"""


def answer(template: str, *values: str) -> str:
    """A template with its %s filled in by SQL expressions."""
    parts = template.replace("%%", "%").split("%s")
    out = []
    for index, part in enumerate(parts):
        quoted = part.replace("'", "''")
        out.append(f"'{quoted}'")
        if index < len(values):
            out.append(values[index])
    return " || ".join(out)


MIX = f"""mix AS (
  SELECT payment_method, count(*) AS txn_count,
         CAST(sum(count(*)) OVER () AS BIGINT) AS total_txns
  FROM txns WHERE {TS_PERIOD} GROUP BY payment_method)"""

TOP = f"""top AS (
  SELECT payment_method AS top_method, txn_count, {pct('txn_count', 'total_txns')} AS top_share
  FROM mix ORDER BY txn_count DESC, payment_method ASC NULLS LAST LIMIT 1)"""



def _back(k: int) -> str:
    return f"CASE WHEN len(h) >= {k} THEN h[-{k}] ELSE h[-1] END"


#: Thirty days of a fixed linear score, each day's value the last of the next day's history.
LINEAR_STEPS = f"""steps(series_key, target_date, h, n, p) AS (
  SELECT series_key, max(agg_date), list(net_revenue ORDER BY agg_date)[-30:], 0,
         CAST(NULL AS DOUBLE)
  FROM series GROUP BY series_key
  UNION ALL
  SELECT series_key, target_date + 1, list_append(h, v)[-30:], n + 1, v FROM (
    SELECT series_key, target_date, h, n, greatest(CAST(0 AS DOUBLE),
             2.0::DOUBLE / 7 * ({_back(1)}) + 1.0::DOUBLE / 7 * ({_back(7)})
             + 1.0::DOUBLE / 11 * ({_back(14)}) + 1.0::DOUBLE / 13 * ({_back(30)})
             + 3.0::DOUBLE / 17 * list_avg(h[-7:]) + 3.0::DOUBLE / 19 * list_avg(h)
             + 10 * (isodow(target_date + 1) - 1) - 5 * day(target_date + 1)
             + 2 * month(target_date + 1)
             - CASE WHEN isodow(target_date + 1) >= 6 THEN 100 ELSE 0 END) AS v
    FROM steps WHERE n < 30))"""

Z_WINDOW = (
    "PARTITION BY series_key ORDER BY agg_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING"
)


def z_score(metric: str) -> str:
    return f"""CASE WHEN count({metric}) OVER w = 30
       THEN ({metric} - avg({metric}) OVER w) / nullif(stddev_samp({metric}) OVER w, 0) END
       AS z_{metric}"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # --- Load, quality, row rules
    sql["settlements"] = f"""WITH {TXNS}
SELECT transaction_id, payment_method, payment_status,
       CAST(transaction_amount AS DOUBLE) AS transaction_amount,
       CAST(processing_fee AS DOUBLE) AS processing_fee,
       CAST(refund_amount AS DOUBLE) AS refund_amount,
       CAST(settlement_amount AS DOUBLE) AS settlement_amount FROM txns"""
    sql["row_counts"] = f"""WITH {DAILY}
SELECT 'merchants' AS table_name, count(*) AS row_count FROM customer
UNION ALL SELECT 'transactions', count(*) FROM orders
UNION ALL SELECT 'daily_aggregates', count(*) FROM daily"""
    for prefix, known in (("orphan_{}", ""), ("{}_out_of_standing", "c_acctbal >= 0 AND ")):
        unknown = f"NOT EXISTS (SELECT 1 FROM customer WHERE {known}c_custkey = o_custkey)"
        sql[prefix.format("transactions")] = f"""SELECT o_orderkey AS transaction_id,
       o_custkey AS merchant_id FROM orders WHERE {unknown}"""
        sql[prefix.format("merchants")] = f"""SELECT o_custkey AS merchant_id, count(*) AS row_count
FROM orders WHERE {unknown} GROUP BY o_custkey"""
    sql["duplicate_keys"] = f"""WITH {RAW}
SELECT merchant_id, {day_text('agg_date')} AS agg_date, count(*) AS row_count
FROM raw GROUP BY merchant_id, raw.agg_date HAVING count(*) > 1"""
    sql["duplicate_transactions"] = """SELECT o_orderkey AS transaction_id, count(*) AS row_count
FROM orders GROUP BY o_orderkey HAVING count(*) > 1"""
    faulty = f"""{RAW}, known AS (SELECT c_custkey AS merchant_id FROM customer WHERE c_acctbal >= 0),
faulty AS (
  SELECT * FROM raw
  UNION ALL SELECT * FROM raw WHERE transaction_id % 75 = 0
  UNION ALL SELECT * REPLACE (CAST(transaction_amount + 1 AS DECIMAL(18,2)) AS transaction_amount)
    FROM raw WHERE transaction_id % 50 = 0
  UNION ALL SELECT * REPLACE (NULL AS payment_method) FROM raw WHERE transaction_id % 125 = 0
  UNION ALL SELECT * REPLACE (NULL AS transaction_id) FROM raw WHERE transaction_id % 301 = 0
  UNION ALL SELECT * REPLACE (-transaction_id AS transaction_id, NULL AS merchant_id)
    FROM raw WHERE transaction_id % 302 = 0), judged AS (
  SELECT *, CASE WHEN transaction_id IS NULL THEN 'missing_key'
                 WHEN merchant_id IS NULL THEN 'missing_parent'
                 WHEN merchant_id NOT IN (SELECT merchant_id FROM known) THEN 'unknown_parent' END AS fault
  FROM faulty), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fault IS NULL, transaction_id
      ORDER BY merchant_id NULLS FIRST, transaction_date NULLS FIRST, transaction_amount NULLS FIRST,
               payment_method NULLS FIRST, payment_status NULLS FIRST) AS place
  FROM judged)"""
    loaded = f"""transaction_id, merchant_id, {day_text('agg_date')} AS transaction_date,
       CAST(transaction_amount AS DOUBLE) AS transaction_amount, payment_method, payment_status"""
    sql["loaded_accepted"] = f"""WITH {faulty}
SELECT {loaded} FROM ranked WHERE fault IS NULL AND place = 1"""
    sql["loaded_rejected"] = f"""WITH {faulty}
SELECT {loaded}, coalesce(fault, 'repeated_key') AS reason, count(*) AS copies
FROM ranked WHERE fault IS NOT NULL OR place > 1 GROUP BY ALL"""
    columns = (
        "transaction_id",
        "merchant_id",
        "transaction_date",
        "transaction_amount",
        "payment_method",
        "payment_status",
    )
    sql["null_rates"] = f"WITH {RAW}\n" + "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count,
       count(*) FILTER ({c} IS NULL) AS null_count,
       CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS null_rate
FROM raw"""
        for c in columns
    )
    def factor(kind: str, rows: str, ratio: str) -> str:
        """Common table ``<kind>``: the factor of each level, from a ratio of the table ``rows``."""
        return f"""{kind}_mean AS (
  SELECT business_category, {kind}, avg({ratio}) AS mean FROM {rows} GROUP BY ALL), {kind}_factors AS (
  SELECT business_category, {kind},
         coalesce(mean / avg(mean) OVER (PARTITION BY business_category), 1) AS {kind}_factor
  FROM {kind}_mean)"""

    def centred(value: str, rows: int) -> str:
        window = f"""OVER (PARTITION BY business_category ORDER BY agg_date
    ROWS BETWEEN {rows // 2} PRECEDING AND {rows // 2} FOLLOWING)"""
        return f"{value} / CASE WHEN count({value}) {window} = {rows} THEN avg({value}) {window} END"

    decomposed = f"""{JOINED}, days AS (
  SELECT business_category, agg_date, CAST(sum(total) AS BIGINT) AS total_transactions,
         CAST(sum(total) AS DOUBLE) AS y, CAST(isodow(agg_date) - 1 AS INTEGER) AS weekday,
         CAST(day(agg_date) AS INTEGER) AS day_of_month, CAST(month(agg_date) AS INTEGER) AS month
  FROM joined GROUP BY business_category, agg_date), timed AS (
  SELECT *, date_diff('day', min(agg_date) OVER (PARTITION BY business_category), agg_date) AS t
  FROM days), line AS (
  SELECT business_category, regr_slope(y, t) AS slope, avg(y) AS level, avg(t) AS middle
  FROM timed GROUP BY business_category), trended AS (
  SELECT timed.*, slope, level, level + slope * (t - middle) AS trend
  FROM timed JOIN line USING (business_category)), week AS (
  SELECT *, {centred('y', 7)} AS ratio FROM trended),
{factor('weekday', 'week', 'ratio')}, week_out AS (
  SELECT trended.*, weekday_factor, y / weekday_factor AS v
  FROM trended JOIN weekday_factors USING (business_category, weekday)), month_ratio AS (
  SELECT *, {centred('v', 35)} AS ratio FROM week_out),
{factor('day_of_month', 'month_ratio', 'ratio')}, month_out AS (
  SELECT week_out.*, day_of_month_factor, v / day_of_month_factor / trend AS ratio
  FROM week_out JOIN day_of_month_factors USING (business_category, day_of_month)),
{factor('month', 'month_out', 'ratio')}, decomposed AS (
  SELECT month_out.*, month_factor, weekday_factor * day_of_month_factor * month_factor AS expected,
         y / trend AS observed
  FROM month_out JOIN month_factors USING (business_category, month))"""
    sql["seasonal_index"] = f"""WITH {decomposed}
SELECT business_category, {day_text('agg_date')} AS agg_date, total_transactions,
       round(weekday_factor, 6) AS weekly_mult, round(day_of_month_factor, 6) AS monthly_mult,
       round(month_factor, 6) AS festive_mult, round(expected, 6) AS expected_index,
       round(observed, 6) AS observed_index
FROM decomposed"""
    sql["seasonal_decomposition"] = f"""WITH {decomposed}
SELECT business_category, {day_text('agg_date')} AS agg_date, total_transactions,
       round(trend, 6) AS trend, round(observed / expected, 6) AS irregular,
       round(slope * 365 / level, 6) AS annual_growth
FROM decomposed"""
    sql["seasonal_factors"] = f"WITH {decomposed}\n" + " UNION ALL ".join(
        f"""SELECT business_category, '{kind}' AS kind, {kind} AS level,
       round(min({kind}_factor), 6) AS factor, count(*) AS days
FROM decomposed GROUP BY business_category, {kind}"""
        for kind in ("weekday", "day_of_month", "month")
    )
    sql["event_effect"] = f"""WITH {TXNS}, observed AS (
  SELECT agg_date, payment_method, count(*) AS total,
         count(*) FILTER (payment_status = 'Failed') AS fail,
         count(*) FILTER (payment_status = 'Refunded') AS ref
  FROM txns GROUP BY agg_date, payment_method), expected AS (
  SELECT *, CASE WHEN agg_date = DATE '1997-05-12' THEN CAST(0.2 AS DOUBLE)
              WHEN agg_date = DATE '1999-07-15' THEN CAST(3 AS DOUBLE)
              ELSE CAST(1 AS DOUBLE) END AS volume_mult,
         CASE WHEN agg_date = DATE '1998-08-05' AND payment_method = 'UPI' THEN CAST(0.6 AS DOUBLE)
              WHEN payment_method = 'UPI' THEN CAST(0.95 AS DOUBLE)
              WHEN payment_method LIKE '%Card%' THEN CAST(0.92 AS DOUBLE)
              ELSE CAST(0.9 AS DOUBLE) END AS success_prob,
         CASE WHEN agg_date = DATE '2000-01-05' THEN CAST(0.15 AS DOUBLE)
              ELSE CAST(0.03 AS DOUBLE) END AS refund_prob,
         CASE WHEN agg_date = DATE '1997-05-12' THEN 'Gateway outage'
              WHEN agg_date = DATE '1999-07-15' THEN 'Viral event'
              WHEN agg_date = DATE '1998-08-05' AND payment_method = 'UPI' THEN 'High failure rate'
              WHEN agg_date = DATE '2000-01-05' THEN 'High refund day' END AS event_label
  FROM observed)
SELECT {day_text('agg_date')} AS agg_date, payment_method, total AS total_transactions,
       volume_mult, event_label, {pct('(total - fail)', 'total')} AS observed_success_rate,
       {pct('ref', '(total - fail)')} AS observed_refund_rate,
       CAST(100 AS DOUBLE) * success_prob AS expected_success_rate,
       CAST(100 AS DOUBLE) * refund_prob AS expected_refund_rate
FROM expected"""

    # --- Filters
    sql["category_options"] = "SELECT DISTINCT c_mktsegment AS business_category FROM customer"
    sql["merchant_options"] = "SELECT c_name AS merchant_name FROM customer"
    sql["merchants_in_category"] = (
        "SELECT c_name AS merchant_name FROM customer WHERE c_mktsegment = 'BUILDING'"
    )
    kpi_columns = """CAST(gross AS DOUBLE) AS gross_revenue, CAST(net AS DOUBLE) AS net_revenue,
       total AS total_transactions, succ AS successful_transactions, fail AS failed_transactions,
       ref AS refunded_transactions,
       CAST(gross AS DOUBLE) / nullif(CAST(succ AS DOUBLE), 0) AS avg_transaction_value,
       CAST(fees AS DOUBLE) AS processing_fees, CAST(refunds AS DOUBLE) AS refund_total"""
    sql["filtered_daily"] = f"""WITH {JOINED}
SELECT {day_text('agg_date')} AS agg_date, merchant_id, {kpi_columns},
       merchant_name, business_category, business_size
FROM joined WHERE {IN_PERIOD} AND business_category = 'BUILDING'"""
    sql["export_report"] = f"""WITH {JOINED}
SELECT {day_text('agg_date')} AS agg_date, CAST(net AS DOUBLE) AS net_revenue,
       total AS total_transactions
FROM joined WHERE {IN_PERIOD}"""

    # --- KPIs
    sql["daily_kpis"] = f"""WITH {DAILY}
SELECT {day_text('agg_date')} AS agg_date, merchant_id, {kpi_columns} FROM daily"""
    trend = f"""SELECT {day_text('agg_date')} AS agg_date, CAST(sum(gross) AS DOUBLE) AS total_revenue,
       CAST(sum(total) AS BIGINT) AS total_txns FROM daily"""
    sql["platform_trend"] = f"WITH {DAILY}\n{trend} GROUP BY daily.agg_date"
    rates = f"""WITH {DAILY}
SELECT {day_text('agg_date')} AS agg_date, {pct('sum(succ)', 'sum(total)')} AS success_rate,
       {pct('sum(fail)', 'sum(total)')} AS failure_rate,
       {pct('sum(ref)', 'sum(total)')} AS refund_rate
FROM daily GROUP BY daily.agg_date"""
    sql["daily_status_rates"] = rates
    sql["headline_kpis"] = f"""WITH {JOINED}
SELECT CAST(sum(net) AS DOUBLE) AS total_rev, CAST(sum(total) AS BIGINT) AS total_txns,
       {pct('sum(succ)', 'sum(total)')} AS success_rate,
       {pct('sum(ref)', 'sum(total)')} AS refund_rate, sum(net) IS NOT NULL AS has_data
FROM joined WHERE {IN_PERIOD} AND business_category = 'BUILDING'"""
    sql["period_compare"] = f"""WITH {COMPARE}
SELECT total_rev, prev_rev, rev_trend, CASE WHEN rev_trend >= 0 THEN 'up' WHEN rev_trend < 0
       THEN 'down' END AS direction, total_txns, success_rate, refund_rate,
       coalesce(refund_rate > 4.0, false) AS refund_alert, total_rev IS NOT NULL AS has_data,
       '2000-07-02' AS prev_start, '2000-10-01' AS prev_end
FROM figures"""
    sql["kpi_cards"] = f"""WITH {COMPARE}
SELECT '₹' || printf('%.2f', round(total_rev / 1e7, 2)) || ' Cr' AS earnings,
       CASE WHEN rev_trend >= 0 THEN '▲ ' ELSE '▼ ' END
         || printf('%.1f', round(abs(rev_trend), 1)) || '%' AS trend,
       format('{{:,}}', total_txns) AS payments,
       printf('%.1f', round(success_rate, 1)) || '%' AS success,
       printf('%.1f', round(refund_rate, 1)) || '%' AS refund
FROM figures WHERE total_rev IS NOT NULL"""
    sql["revenue_series"] = f"""WITH {JOINED}
SELECT {day_text('agg_date')} AS agg_date, CAST(sum(net) AS DOUBLE) AS net_rev
FROM joined WHERE {IN_PERIOD} AND business_category = 'BUILDING' GROUP BY joined.agg_date"""

    # --- Segments
    sql["revenue_by_category"] = f"""WITH {JOINED}
SELECT business_category, CAST(sum(net) AS DOUBLE) AS total_net_revenue
FROM joined GROUP BY business_category"""
    for name, segment, condition in (
        ("top_categories", "business_category", ""),
        ("top_merchants_in_category", "merchant_name", "AND business_category = 'BUILDING'"),
    ):
        sql[name] = f"""WITH {JOINED}
SELECT {segment} AS segment, CAST(sum(net) AS DOUBLE) AS rev
FROM joined WHERE {IN_PERIOD} {condition}
GROUP BY {segment} ORDER BY rev DESC NULLS LAST, segment ASC LIMIT 10"""
    sql["payment_distribution"] = f"""WITH {TXNS}, grouped AS (
  SELECT payment_method, count(*) AS txn_count, sum(transaction_amount) AS amount
  FROM txns WHERE payment_method IS NOT NULL GROUP BY payment_method)
SELECT payment_method, txn_count, CAST(amount AS DOUBLE) AS total_amount,
       {pct('txn_count', 'sum(txn_count) OVER ()')} AS count_share,
       {pct('amount', 'sum(amount) OVER ()')} AS amount_share FROM grouped"""
    sql["payment_mix"] = f"WITH {TXNS}, {MIX}\nSELECT * FROM mix"
    sql["payment_mix_in_category"] = f"""WITH {TXNS}, {MERCHANTS}
SELECT payment_method, count(*) AS txn_count,
       CAST(sum(count(*)) OVER () AS BIGINT) AS total_txns
FROM txns JOIN merchants USING (merchant_id)
WHERE transaction_date >= TIMESTAMP '2000-10-01' AND transaction_date < TIMESTAMP '2001-01-01'
  AND business_category = 'BUILDING'
GROUP BY payment_method"""
    sql["top_payment_method"] = f"WITH {TXNS}, {MIX}, {TOP}\nSELECT * FROM top"
    sql["merchant_size_band"] = f"""WITH {DAILY}, volume AS (
  SELECT merchant_id, CAST(sum(total) AS BIGINT) AS total_transactions, count(*) AS active_days
  FROM daily GROUP BY merchant_id)
SELECT *, CAST(total_transactions AS DOUBLE) / CAST(active_days AS DOUBLE) AS mean_daily,
       CASE WHEN total_transactions >= 15 THEN 'Enterprise'
            WHEN total_transactions >= 10 THEN 'Mid-Market' ELSE 'SMB' END AS size_band
FROM volume"""

    # --- Series and features
    dated = f"SELECT series_key, {day_text('agg_date')} AS agg_date, net_revenue"
    sql["daily_series_platform"] = f"WITH {PLATFORM_SERIES}\n{dated} FROM series"
    sql["daily_series_category"] = f"WITH {CATEGORY_SERIES}\n{dated} FROM series"
    sql["daily_series_merchant"] = f"""WITH {DAILY}
SELECT CAST(merchant_id AS VARCHAR) AS series_key, {day_text('agg_date')} AS agg_date,
       CAST(net AS DOUBLE) AS net_revenue FROM daily"""
    sql["date_spine"] = f"WITH {CATEGORY_SERIES}, {SPINE}\n{dated} FROM filled"
    unfilled = "filled AS (SELECT * FROM series)"
    sql["lag_features"] = f"""WITH {CATEGORY_SERIES}, {unfilled}, {FEATURES}
{dated}, revenue_lag_1, revenue_lag_7, revenue_lag_14, revenue_lag_30 FROM framed"""
    sql["rolling_features"] = f"""WITH {CATEGORY_SERIES}, {unfilled}, {FEATURES}
{dated}, round(rolling_avg_7d, 4) AS rolling_avg_7d, round(rolling_avg_30d, 4) AS rolling_avg_30d
FROM framed"""
    sql["feature_frame"] = f"""WITH {CATEGORY_SERIES}, {SPINE}, {FEATURES}
{dated}, CAST(day_of_week AS INTEGER) AS day_of_week, CAST(day_of_month AS INTEGER) AS day_of_month,
       CAST(month AS INTEGER) AS month, is_weekend,
       revenue_lag_1, revenue_lag_7, revenue_lag_14, revenue_lag_30,
       round(rolling_avg_7d, 4) AS rolling_avg_7d, round(rolling_avg_30d, 4) AS rolling_avg_30d
FROM framed WHERE revenue_lag_30 IS NOT NULL"""

    # --- Forecasts
    sql["future_dates"] = f"""WITH {CATEGORY_SERIES}, {baseline(30)}
SELECT series_key, {day_text('target_date')} AS target_date FROM days"""
    sql["baseline_forecast"] = f"""WITH {CATEGORY_SERIES}, {baseline(30)}
SELECT {forecast_rows('Category')} FROM predicted"""
    sql["forecast_window"] = f"""WITH {PLATFORM_SERIES}, {baseline(90)}
SELECT {forecast_rows('Platform')} FROM predicted p
WHERE p.target_date <= DATE '2001-08-01' + 14"""
    sql["forecast_overlay"] = f"""WITH {JOINED}, series AS (
  SELECT 'Platform' AS series_key, agg_date, CAST(sum(net) AS DOUBLE) AS net_revenue
  FROM daily GROUP BY ALL), {baseline(30)}
SELECT {day_text('agg_date')} AS day, 'actual' AS kind, round(CAST(sum(net) AS DOUBLE), 4) AS revenue,
       CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper
FROM joined WHERE agg_date BETWEEN DATE '2001-05-01' AND DATE '2001-08-01'
GROUP BY joined.agg_date
UNION ALL
SELECT {day_text('target_date')}, 'forecast', round(predicted_revenue, 4),
       round(predicted_revenue * CAST(0.8 AS DOUBLE), 4),
       round(predicted_revenue * CAST(1.2 AS DOUBLE), 4)
FROM predicted p WHERE p.target_date <= DATE '2001-08-01' + 30"""
    sql["baseline_backtest"] = f"""WITH {CATEGORY_SERIES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY agg_date DESC) AS age FROM series),
base AS (
  SELECT series_key, CASE WHEN count(net_revenue) = 30 THEN avg(net_revenue) END AS base
  FROM ranked WHERE age BETWEEN 31 AND 60 GROUP BY series_key), errors AS (
  SELECT series_key, abs((net_revenue - base * CASE WHEN isodow(agg_date) >= 6
           THEN CAST(0.8 AS DOUBLE) ELSE CAST(1.1 AS DOUBLE) END) / nullif(net_revenue, 0)) AS error
  FROM ranked JOIN base USING (series_key) WHERE age <= 30)
SELECT series_key, count(error) AS scored_days, round(avg(error), 6) AS mape
FROM errors GROUP BY series_key"""
    sql["stored_forecasts"] = f"""WITH {DAILY}, series AS (
  SELECT CAST(merchant_id AS VARCHAR) AS series_key, agg_date, CAST(net AS DOUBLE) AS net_revenue
  FROM daily), {baseline(7)}
SELECT count(*) AS row_count, count(predicted_revenue) AS predicted, count(*) AS distinct_ids,
       {day_text('min(target_date)')} AS first_day, {day_text('max(target_date)')} AS last_day
FROM predicted"""
    place = "row_number() OVER (PARTITION BY series_key ORDER BY target_date) AS place"
    sql["stored_forecast_levels"] = " UNION ALL ".join(
        f"""SELECT * FROM (WITH {series}, {baseline(30)}
SELECT {forecast_rows(level)}, {place} FROM predicted)"""
        for series, level in ((CATEGORY_SERIES, "Category"), (PLATFORM_SERIES, "Platform"))
    )
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())
    names = (
        "day_of_week day_of_month month is_weekend revenue_lag_1 revenue_lag_7 revenue_lag_14 "
        "revenue_lag_30 rolling_avg_7d rolling_avg_30d"
    ).split()
    weights = "\n  UNION ALL ".join(
        f"""SELECT '{f}' AS feature, abs(corr(CAST({f} AS DOUBLE), net_revenue)) AS importance
  FROM framed WHERE revenue_lag_30 IS NOT NULL"""
        for f in names
    )
    sql["importance_labelled"] = f"""WITH {CATEGORY_SERIES}, {SPINE}, {FEATURES}, weights AS (
  {weights}), shares AS (
  SELECT feature, {pct('importance', 'sum(importance) OVER ()')} AS impact FROM weights)
SELECT feature, CASE feature {labels} ELSE feature END AS feature_friendly,
       round(impact, 4) AS impact
FROM shares ORDER BY shares.impact DESC, feature LIMIT 6"""

    sql["importance_csv"] = sql["importance_labelled"]

    def back(k: int) -> str:
        return f"coalesce(max(net) FILTER (age = {k}), max(net) FILTER (age = 1))"

    for name, series in (
        ("next_day_inputs", MERCHANT_SERIES),
        ("next_day_inputs_category", CATEGORY_SERIES),
    ):
        sql[name] = f"""WITH {series}, ranked AS (
  SELECT series_key, agg_date, net_revenue AS net,
         row_number() OVER (PARTITION BY series_key ORDER BY agg_date DESC) AS age
  FROM series), last AS (
  SELECT series_key, max(agg_date) + 1 AS target_date,
         {back(1)} AS revenue_lag_1, {back(7)} AS revenue_lag_7,
         {back(14)} AS revenue_lag_14, {back(30)} AS revenue_lag_30,
         round(avg(net) FILTER (age <= 7), 6) AS rolling_avg_7d,
         round(avg(net) FILTER (age <= 30), 6) AS rolling_avg_30d
  FROM ranked GROUP BY series_key)
SELECT * REPLACE ({day_text('target_date')} AS target_date),
       CAST(isodow(last.target_date) - 1 AS INTEGER) AS day_of_week,
       CAST(day(last.target_date) AS INTEGER) AS day_of_month,
       CAST(month(last.target_date) AS INTEGER) AS month,
       CASE WHEN isodow(last.target_date) >= 6 THEN 1 ELSE 0 END AS is_weekend
FROM last"""

    for name, series, level in (
        ("linear_forecast", CATEGORY_SERIES, "Category"),
        ("linear_forecast_merchant", MERCHANT_SERIES, "Merchant"),
    ):
        sql[name] = f"""WITH RECURSIVE {series}, {LINEAR_STEPS}
SELECT series_key, {day_text('target_date')} AS target_date, '{level}' AS forecast_level,
       'Linear' AS model_name, round(p, 2) AS predicted_revenue,
       round(p * CAST(0.85 AS DOUBLE), 2) AS confidence_lower,
       round(p * CAST(1.15 AS DOUBLE), 2) AS confidence_upper
FROM steps WHERE n > 0"""

    def choice(series: str, origins: int, step: int, horizon: int) -> str:
        """Common tables up to ``choice``: the errors at rolling origins and the better model."""
        return f"""{series.replace('series AS (', 'whole AS (')}, aged AS (
  SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY agg_date DESC) AS age FROM whole),
origins AS (
  SELECT origin || ':' || series_key AS series_key, series_key AS own, agg_date, net_revenue,
         age - origin * {step} - {horizon} AS before
  FROM aged, (SELECT unnest(range({origins})) AS origin)
  WHERE age - origin * {step} - {horizon} BETWEEN {1 - horizon} AND 30),
series AS (SELECT series_key, agg_date, net_revenue FROM origins WHERE before > 0),
{LINEAR_STEPS}, base AS (
  SELECT series_key, max(agg_date) AS last_date,
         CASE WHEN count(net_revenue) = 30 THEN avg(net_revenue) END AS base
  FROM series GROUP BY series_key), held AS (
  SELECT o.own, o.net_revenue AS actual, s.p AS linear,
         base * CASE WHEN isodow(last_date + 1 - before) >= 6 THEN CAST(0.8 AS DOUBLE)
                     ELSE CAST(1.1 AS DOUBLE) END AS plain
  FROM (SELECT * REPLACE (before::INTEGER AS before) FROM origins WHERE before <= 0) o
  JOIN base USING (series_key) JOIN steps s ON s.series_key = o.series_key AND s.n = 1 - before),
errors AS (
  SELECT own, count(abs((actual - plain) / nullif(actual, 0))) AS days_baseline,
         count(abs((actual - linear) / nullif(actual, 0))) AS days_model,
         avg(abs((actual - plain) / nullif(actual, 0))) AS mape_baseline,
         avg(abs((actual - linear) / nullif(actual, 0))) AS mape_model
  FROM held GROUP BY own), choice AS (
  SELECT k.series_key, coalesce(days_baseline, 0) AS days_baseline, coalesce(days_model, 0) AS days_model,
         mape_baseline, mape_model,
         CASE WHEN mape_model IS NOT NULL AND (mape_baseline IS NULL OR mape_model < mape_baseline)
              THEN 'Linear' ELSE 'Baseline_EWMA' END AS model_name
  FROM (SELECT DISTINCT series_key FROM whole) k LEFT JOIN errors ON own = k.series_key)"""

    sql["model_choice"] = f"""WITH RECURSIVE {choice(CATEGORY_SERIES, 3, 10, 10)}
SELECT * REPLACE (round(mape_baseline, 6) AS mape_baseline, round(mape_model, 6) AS mape_model) FROM choice"""
    banded = f"""{day_text('target_date')} AS target_date, 'Merchant' AS forecast_level, series_key,
       model_name, round(p, 2) AS predicted_revenue, round(p * (1 - band), 2) AS confidence_lower,
       round(p * (1 + band), 2) AS confidence_upper"""
    sql["chosen_forecast"] = f"""WITH chosen AS (
  SELECT series_key, model_name FROM (WITH RECURSIVE {choice(MERCHANT_SERIES, 2, 3, 3)} SELECT * FROM choice)),
linear AS (
  SELECT series_key, target_date, p, 0.15::DOUBLE AS band
  FROM (WITH RECURSIVE {MERCHANT_SERIES}, {LINEAR_STEPS} SELECT * FROM steps WHERE n BETWEEN 1 AND 7)),
plain AS (
  SELECT series_key, target_date, predicted_revenue AS p, 0.2::DOUBLE AS band
  FROM (WITH {MERCHANT_SERIES}, {baseline(7)} SELECT * FROM predicted)), every AS (
  SELECT *, 'Linear' AS model_name FROM linear UNION ALL SELECT *, 'Baseline_EWMA' FROM plain)
SELECT {banded} FROM every JOIN chosen USING (series_key, model_name)"""

    # --- Alerts and answers
    sql["refund_alerts"] = f"""WITH {DAILY}, months AS (
  SELECT date_trunc('month', agg_date) AS month, CAST(sum(total) AS BIGINT) AS total_transactions,
         CAST(sum(ref) AS BIGINT) AS refunded_transactions,
         {pct('sum(ref)', 'sum(total)')} AS refund_rate
  FROM daily GROUP BY ALL)
SELECT {day_text('month')} AS month, total_transactions, refunded_transactions, refund_rate
FROM months WHERE refund_rate > 4.0"""
    sql["question_intents"] = f"WITH {ROUTED}\nSELECT conv_id, turn, intent FROM routed"
    refund = "printf('%.1f', round(refund_rate, 1))"
    share = "printf('%.1f', round(top_share, 1))"
    method = "coalesce(top_method, 'None')"
    sql["question_answers"] = f"""WITH {JOINED}, {MIX}, {TOP}, {ROUTED}, kpi AS (
  SELECT CAST(sum(net) AS DOUBLE) AS total_rev, CAST(sum(total) AS BIGINT) AS total_txns,
         {pct('sum(ref)', 'sum(total)')} AS refund_rate
  FROM joined WHERE {IN_PERIOD})
SELECT conv_id, turn, intent, CASE intent
  WHEN 'payment' THEN {answer(PAYMENT, method, share, method)}
  WHEN 'refund' THEN CASE WHEN refund_rate > 3.0
    THEN {answer(REFUND_HIGH, refund)}
    ELSE {answer(REFUND_HEALTHY, refund)} END
  WHEN 'forecast' THEN {answer(FORECAST, "'30'")}
  ELSE {answer(DEFAULT, "format('{:,}', total_txns)",
               "printf('%.2f', round(total_rev / 1e7, 2))")} END AS answer
FROM routed, kpi, top"""
    sql["question_answers_empty"] = f"""WITH {ROUTED}
SELECT conv_id, turn, intent, 'No data found for the selected filters.' AS answer FROM routed"""
    one = "merchant_name = 'Customer#000001443'"
    sql["headline_merchant"] = f"""WITH {JOINED}
SELECT CAST(sum(net) AS DOUBLE) AS total_rev, CAST(sum(total) AS BIGINT) AS total_txns,
       {pct('sum(succ)', 'sum(total)')} AS success_rate,
       {pct('sum(ref)', 'sum(total)')} AS refund_rate, sum(net) IS NOT NULL AS has_data
FROM joined WHERE {IN_PERIOD} AND {one}"""
    sql["revenue_series_merchant"] = f"""WITH {JOINED}
SELECT {day_text('agg_date')} AS agg_date, CAST(sum(net) AS DOUBLE) AS net_rev
FROM joined WHERE {IN_PERIOD} AND {one} GROUP BY agg_date"""
    sql["date_spine_merchant"] = f"""WITH {DAILY}, {MERCHANTS}, days AS (
  SELECT CAST(unnest(generate_series(TIMESTAMP '2000-10-01', TIMESTAMP '2000-12-31',
                                     INTERVAL 1 DAY)) AS DATE) AS agg_date)
SELECT CAST(m.merchant_id AS VARCHAR) AS series_key, {day_text('days.agg_date')} AS agg_date,
       coalesce(CAST(net AS DOUBLE), CAST(0 AS DOUBLE)) AS net_revenue
FROM merchants m CROSS JOIN days
LEFT JOIN daily ON daily.merchant_id = m.merchant_id AND daily.agg_date = days.agg_date"""
    metrics = ("net_revenue", "failure_rate", "refund_rate")
    sql["revenue_anomalies"] = f"""WITH {JOINED}, series AS (
  SELECT business_category AS series_key, agg_date, CAST(sum(net) AS DOUBLE) AS net_revenue,
         {pct('sum(fail)', 'sum(total)')} AS failure_rate,
         {pct('sum(ref)', 'sum(total)')} AS refund_rate
  FROM joined GROUP BY ALL), scored AS (
  SELECT *, {', '.join(z_score(m) for m in metrics)}
  FROM series WINDOW w AS ({Z_WINDOW}))
{dated}, failure_rate, refund_rate,
       {', '.join(f'round(z_{m}, 6) AS z_{m}' for m in metrics)}
FROM scored WHERE {' OR '.join(f'abs(z_{m}) > 3' for m in metrics)}"""

    methods = ("UPI", "Credit Card", "Debit Card", "Net Banking", "Wallet", "Other")

    def mix_anomalies(rows: str) -> str:
        """Over ``rows``: series_key, agg_date, payment_method, total."""
        sums = ", ".join(f"sum(total) FILTER (method = '{m}') AS c{n}" for n, m in enumerate(methods))
        filled = ", ".join(f"coalesce(c{n}, 0) AS c{n}" for n in range(6))
        before = ", ".join(f"sum(c{n}) OVER w + 0.5::DOUBLE AS b{n}" for n in range(6))
        each = [f"(c{n} - n * b{n} / usual) * (c{n} - n * b{n} / usual) / (n * b{n} / usual)" for n in range(6)]
        psi = " + ".join(
            f"((c{n} + 0.5::DOUBLE) / (n + 3) - b{n} / usual)"
            f" * ln(((c{n} + 0.5::DOUBLE) / (n + 3)) / (b{n} / usual))"
            for n in range(6)
        )
        listed = ", ".join(f"{{'d': round({d}, 9), 'm': '{m}'}}" for d, m in zip(each, methods))
        return f"""named AS (
  SELECT *, CASE WHEN payment_method IN {methods[:5]} THEN payment_method ELSE 'Other' END AS method
  FROM {rows}), sums AS (SELECT series_key, agg_date, {sums} FROM named GROUP BY ALL), filled AS (
  SELECT series_key, agg_date, {filled} FROM sums), windowed AS (
  SELECT *, c0 + c1 + c2 + c3 + c4 + c5 AS n, {before}, count(*) OVER w AS depth FROM filled
  WINDOW w AS ({Z_WINDOW})), totals AS (
  SELECT *, b0 + b1 + b2 + b3 + b4 + b5 AS usual FROM windowed WHERE depth = 30), scored AS (
  SELECT *, {' + '.join(each)} AS chi, {psi} AS psi, [{listed}] AS departures FROM totals)
SELECT series_key, {day_text('agg_date')} AS agg_date, CAST(n AS BIGINT) AS total_transactions,
       round(chi, 6) AS chi_square, round((chi - 5) / sqrt(10::DOUBLE), 6) AS z_mix,
       round(psi, 6) AS psi,
       list_sort(list_transform(departures, lambda x: {{'d': -x.d, 'm': x.m}}))[1].m AS method
FROM scored WHERE (chi - 5) / sqrt(10::DOUBLE) > 3"""

    sql["payment_mix_anomalies"] = f"""WITH {TXNS}, counted AS (
  SELECT 'Platform' AS series_key, agg_date, payment_method, 1 AS total FROM txns),
{mix_anomalies('counted')}"""
    sql["payment_mix_anomalies_category"] = f"""WITH {TXNS}, {MERCHANTS}, counted AS (
  SELECT business_category AS series_key, agg_date, payment_method, 1 AS total
  FROM txns JOIN merchants USING (merchant_id)),
{mix_anomalies('counted')}"""

    sql["headline_sql"] = sql["headline_merchant"]
    sql["revenue_series_sql"] = sql["revenue_series"]

    # --- Sources and sinks
    sql["stored_daily"] = f"WITH {DAILY}\n{trend} WHERE {IN_PERIOD} GROUP BY daily.agg_date"
    sql["appended_transactions"] = sql["platform_trend"]
    sql["stored_transactions"] = sql["payment_mix"]
    sql["csv_transactions"] = f"""SELECT * REPLACE (CAST(merchant_id AS VARCHAR) AS merchant_id)
FROM ({sql['daily_kpis']})"""
    sql["refreshed_daily"] = sql["csv_transactions"]
    sql["csv_merchants"] = f"""WITH {MERCHANTS}
SELECT CAST(merchant_id AS VARCHAR) AS merchant_id, merchant_name, business_category, business_size,
       CASE WHEN merchants.merchant_id % 7 <> 0 THEN strftime(
         DATE '2022-01-01' + CAST(merchants.merchant_id % 365 AS INTEGER), '%Y-%m-%d') END AS onboarding_date
FROM merchants"""
    return sql
