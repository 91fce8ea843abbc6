"""The same queries as SQL over the driver's tables.

Written straight from the typed columns: no JSON payload, no shared code with the
DataFrame side, and the status join spelled out literally.
"""

from __future__ import annotations

from hopmetrics.fixtures.feeds import AS_OF, END, MID_END, MID_START, START

TRANSFER_ROWS = """
raw_transfers AS (
  SELECT 'T' || l_orderkey AS id, l_shipdate AS created_at, c_name AS recipient_address,
         '0x' || upper(p_name) AS sender_address,
         CASE WHEN l_linestatus = 'F' THEN 'executed' ELSE 'pending' END AS status,
         CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'received' END AS simplified_status,
         CASE l_linenumber WHEN 6 THEN 'n/a' WHEN 7 THEN '[1,2]'
              ELSE CAST(l_quantity AS VARCHAR) END AS amount_text,
         CASE WHEN l_linenumber NOT IN (6, 7) THEN l_quantity END AS amount,
         p_retailprice AS price, l_tax AS fee,
         cn.n_name AS source_name, sn.n_name AS destination_name,
         CASE p_type WHEN 'PROMO' THEN 'uusdc' WHEN 'LARGE' THEN 'weth-wei'
              WHEN 'SMALL' THEN 'factory/sei10hubX' WHEN 'ECONOMY' THEN 'uatom'
              WHEN 'MEDIUM' THEN 'other-medium' END AS asset
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN part ON l_partkey = p_partkey),
transfer_rows AS (
  SELECT created_at, lower(source_name) AS source_chain, lower(destination_name) AS destination_chain,
         recipient_address AS wallet, amount, amount * price AS amount_usd, fee, id,
         'Token Transfers' AS service, asset AS raw_asset
  FROM raw_transfers
  WHERE status = 'executed' AND simplified_status = 'received'
    AND (sender_address ILIKE '%red%' OR sender_address ILIKE '%blue%' OR sender_address ILIKE '%green%'))
"""

MESSAGE_ROWS = """
raw_messages AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'executed' END AS status,
         'received' AS simplified_status,
         'G' || event_id AS id, '0x' || upper(event_type) AS contract_address
  FROM events),
message_rows AS (
  SELECT ts AS created_at, 'NATION_' || (k % 25) AS source_chain,
         'NATION_' || (user_id % 25) AS destination_chain,
         CASE WHEN user_id % 50 <> 0 THEN 'U' || user_id END AS wallet,
         value AS amount, round(value * k, 2) AS amount_usd,
         CASE WHEN k < 90 THEN k * value WHEN k >= 95 THEN CAST(k AS DOUBLE) END AS fee, id,
         'GMP' AS service, upper(event_type) AS raw_asset
  FROM raw_messages
  WHERE status = 'executed' AND event_type IN ('click', 'view', 'purchase'))
"""

RELATION = f"""
WITH {TRANSFER_ROWS}, {MESSAGE_ROWS},
bridges AS (SELECT * FROM transfer_rows UNION ALL SELECT * FROM message_rows),
lowered AS (
  SELECT * REPLACE (lower(source_chain) AS source_chain, lower(destination_chain) AS destination_chain)
  FROM bridges),
ranged AS (
  SELECT * FROM bridges
  WHERE CAST(created_at AS DATE) BETWEEN DATE '{START}' AND DATE '{END}')
"""

USD_SUM = "CAST(round(sum(CAST(amount_usd AS DECIMAL(28,6)))) AS DOUBLE)"

STATUS_JOIN = """
first_seen AS (SELECT wallet, min(created_at) AS first_ts FROM lowered GROUP BY wallet),
joined AS (
  SELECT a.*, a.wallet = b.wallet AS is_new
  FROM lowered a LEFT JOIN first_seen b ON a.created_at = b.first_ts),
labelled AS (
  SELECT *, CASE WHEN is_new THEN 'New Users' ELSE 'Returning Users' END AS user_status
  FROM joined
  WHERE CAST(created_at AS DATE) BETWEEN DATE '{start}' AND DATE '{end}')
""".format(start=START, end=END)


def _period(grain: str, column: str = "created_at") -> str:
    return f"CAST(date_trunc('{grain}', {column}) AS TIMESTAMP)"


def _trailing(days: int) -> str:
    return f"""{RELATION}
SELECT count(DISTINCT id) AS bridges, count(DISTINCT wallet) AS users, {USD_SUM} AS volume
FROM bridges WHERE CAST(created_at AS DATE) >= DATE '{AS_OF}' - {days - 1}"""


def _activity(grain: str) -> str:
    return f"""{RELATION}
SELECT {_period(grain)} AS date, count(DISTINCT id) AS bridges, {USD_SUM} AS volume,
       round(median(amount_usd)) AS median_amount, count(DISTINCT wallet) AS users
FROM ranged GROUP BY 1 ORDER BY 1"""


def _growth(grain: str) -> str:
    return f"""{RELATION},
totals AS (
  SELECT {_period(grain)} AS date, count(DISTINCT wallet) AS total FROM ranged GROUP BY 1),
firsts AS (
  SELECT wallet, min(CAST(created_at AS DATE)) AS first_date FROM bridges GROUP BY 1),
news AS (
  SELECT {_period(grain, "first_date")} AS date, count(DISTINCT wallet) AS new FROM firsts
  WHERE first_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1)
SELECT t.date, total, new, total - new AS returning,
       CAST(sum(new) OVER (ORDER BY t.date) AS BIGINT) AS growth
FROM totals t LEFT JOIN news n ON t.date = n.date ORDER BY 1"""


def _status_by_period(grain: str) -> str:
    return f"""{RELATION}, {STATUS_JOIN}
SELECT {_period(grain)} AS date, user_status, {USD_SUM} AS volume
FROM labelled GROUP BY 1, 2 ORDER BY 1, 2"""


STATUS_VOLUME = f"""{RELATION}, {STATUS_JOIN}
SELECT user_status, {USD_SUM} AS volume FROM labelled GROUP BY 1"""


def _chain(column: str) -> str:
    return f"""{RELATION}
SELECT {column}, count(DISTINCT id) AS bridges, count(DISTINCT wallet) AS users, {USD_SUM} AS volume
FROM ranged GROUP BY 1 ORDER BY 2 DESC, 1"""


LABEL = """CASE WHEN raw_asset = 'uusdc' THEN 'USDC' WHEN raw_asset = 'weth-wei' THEN 'WETH'
     WHEN raw_asset ILIKE 'factory/sei10hub%' THEN 'SEILOR' WHEN raw_asset = 'uatom' THEN 'ATOM'
     ELSE raw_asset END"""

ASSETS = f"""{RELATION}
SELECT {LABEL} AS symbol, count(DISTINCT id) AS bridges, {USD_SUM} AS volume
FROM ranged WHERE raw_asset IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1"""

TXN_BUCKETS = f"""{RELATION},
classes(txn_bucket, least, most) AS (VALUES
  ('A:1 Txn', 1, 1), ('B: 2-5 Txns', 2, 5), ('C: 6-10 Txns', 6, 10),
  ('D: 11-20 Txns', 11, 20), ('E: 21-100 Txns', 21, 100), ('F: >100 Txns', 101, NULL)),
per_wallet AS (SELECT wallet, count(DISTINCT id) AS n FROM ranged GROUP BY 1)
SELECT txn_bucket, count(DISTINCT wallet) AS users
FROM per_wallet LEFT JOIN classes ON n >= least AND n <= coalesce(most, n)
GROUP BY 1 ORDER BY 2 DESC, 1"""

AMOUNT_BUCKETS = f"""{RELATION},
classes(amount_bucket, above, upto) AS (VALUES
  ('A: V<=$10', NULL, 10), ('B: $10<V<=$100', 10, 100), ('C: $100<V<=$1K', 100, 1000),
  ('D: $1K<V<=$10K', 1000, 10000), ('E: $10K<V<=$100K', 10000, 100000), ('F: V>$100K', 100000, NULL))
SELECT amount_bucket, count(DISTINCT id) AS transactions
FROM ranged JOIN classes ON amount_usd > coalesce(above, amount_usd - 1) AND amount_usd <= coalesce(upto, amount_usd)
GROUP BY 1 ORDER BY 2 DESC, 1"""

PERIOD_KPIS = f"""{RELATION}
SELECT count(DISTINCT id) AS bridges, count(DISTINCT wallet) AS users, {USD_SUM} AS volume,
       count(DISTINCT raw_asset) AS tokens, round(max(amount_usd)) AS max_amount,
       round(CAST(sum(CAST(amount_usd AS DECIMAL(28,6))) AS DOUBLE) / count(amount_usd)) AS avg_amount,
       round(median(amount_usd)) AS median_amount,
       count(DISTINCT source_chain || '➡' || destination_chain) AS routes
FROM ranged"""

CHAIN_STATUS_USERS = f"""{RELATION}, {STATUS_JOIN}
SELECT source_chain, CASE WHEN is_new THEN 'New' ELSE 'Old' END AS user_status,
       count(DISTINCT wallet) AS users
FROM labelled GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2"""


def _each(rows: str) -> str:
    return f"""{RELATION}, {STATUS_JOIN}
SELECT id, created_at, CASE WHEN is_new THEN 'New Users' ELSE 'Returning Users' END AS user_status,
       count(*) AS copies
FROM {rows} GROUP BY 1, 2, 3"""


def _shares(report: str, keys: str, values: list[str]) -> str:
    columns = ", ".join(f"{v} / sum({v}) OVER () * 100 AS {v}_share" for v in values)
    return f"SELECT {keys}, {', '.join(values)}, {columns} FROM ({report})"


def _leaf_counts(feed: str, rows: str, leaves: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{feed}' AS feed, '{name}' AS leaf, count(*) AS rows, count({expression}) AS non_null FROM {rows}"
        for name, expression in leaves.items()
    )


# Typed stand-ins for the payload leaves, as text.
MESSAGE_LEAF_TEXT = {
    "amount": "CAST(value AS VARCHAR)",
    "value": "CAST(round(value * k, 2) AS VARCHAR)",
    "symbol": "upper(event_type)",
    "gas_used": "CASE WHEN k < 90 THEN CAST(k AS VARCHAR) END",
    "token_usd": "CAST(value AS VARCHAR)",
    "express_fee": "CASE WHEN k >= 95 THEN CAST(k AS VARCHAR) END",
    "contract_address": "contract_address",
    "source_chain": "'NATION_' || (k % 25)",
    "destination_chain": "'NATION_' || (user_id % 25)",
    "sender": "CASE WHEN user_id % 50 <> 0 THEN 'U' || user_id END",
}
TRANSFER_LEAF_TEXT = {
    "amount": "amount_text",
    "source_chain": "source_name",
    "destination_chain": "destination_name",
    "fee_value": "CAST(fee AS VARCHAR)",
    "price": "CAST(price AS VARCHAR)",
    "asset": "asset",
}


def _scan(rows: str) -> str:
    return f"""WITH {TRANSFER_ROWS}, {MESSAGE_ROWS}
SELECT status, simplified_status, count(*) AS rows FROM {rows} GROUP BY 1, 2"""


def _columns(leaves: dict[str, str]) -> str:
    return ", ".join(f"{expression} AS p_{name}" for name, expression in leaves.items())


CANONICAL = (
    "created_at, source_chain, destination_chain, wallet, amount, amount_usd, fee, id, service, raw_asset"
)


def oracle_sql() -> dict[str, str]:
    whole = _whole_range()
    mid_range = {f"{name}_mid_range": _moved(whole[name]) for name in RANGED}
    mid_range["status_rows_each_mid_range"] = _moved(_each("labelled"))
    for name in ("user_growth", "status_volume_by_period", "status_volume", "source_chain_status_users"):
        mid_range[f"{name}_from_state"] = _moved(whole[name])
    return {**whole, **mid_range}


RANGED = (
    "period_kpis",
    "activity_by_period",
    "user_growth",
    "status_volume_by_period",
    "status_volume",
    "source_chain_status_users",
    "txn_count_buckets",
    "amount_buckets",
    "asset_breakdown",
    "source_chain_breakdown",
    "dest_chain_breakdown",
)


def _moved(sql: str) -> str:
    """The same query over the middle range."""
    return sql.replace(f"DATE '{START}'", f"DATE '{MID_START}'").replace(
        f"DATE '{END}'", f"DATE '{MID_END}'"
    )


def _whole_range() -> dict[str, str]:
    return {
        "period_kpis": PERIOD_KPIS,
        "kpis_7d": _trailing(7),
        "kpis_30d": _trailing(30),
        "activity_by_period": _activity("month"),
        "activity_by_period_week": _activity("week"),
        "activity_by_period_day": _activity("day"),
        "user_growth": _growth("month"),
        "user_growth_week": _growth("week"),
        "user_growth_day": _growth("day"),
        "status_volume_by_period": _status_by_period("month"),
        "status_volume_by_period_week": _status_by_period("week"),
        "status_volume_by_period_day": _status_by_period("day"),
        "status_volume": STATUS_VOLUME,
        "source_chain_status_users": CHAIN_STATUS_USERS,
        "txn_count_buckets": TXN_BUCKETS,
        "amount_buckets": AMOUNT_BUCKETS,
        "asset_breakdown": ASSETS,
        "source_chain_breakdown": _chain("source_chain"),
        "dest_chain_breakdown": _chain("destination_chain"),
        # single operators
        "scan_transfers": _scan("raw_transfers"),
        "scan_messages": _scan("raw_messages"),
        "payload_decode": f"""WITH {TRANSFER_ROWS}, {MESSAGE_ROWS}
{_leaf_counts("transfers", "raw_transfers", TRANSFER_LEAF_TEXT)}
UNION ALL {_leaf_counts("messages", "raw_messages", MESSAGE_LEAF_TEXT)}""",
        "payload_paths": f"WITH {MESSAGE_ROWS} SELECT id, {_columns(MESSAGE_LEAF_TEXT)} FROM raw_messages",
        "payload_paths_transfers": f"""WITH {TRANSFER_ROWS}
SELECT id, {_columns(TRANSFER_LEAF_TEXT)} FROM raw_transfers""",
        "numeric_clean": f"""WITH {TRANSFER_ROWS}
SELECT id, amount_text, amount, price, amount * price AS product FROM raw_transfers""",
        "settled_transfers": f"""WITH {TRANSFER_ROWS}
SELECT id FROM raw_transfers WHERE status = 'executed' AND simplified_status = 'received'""",
        "router_transfers": f"""WITH {TRANSFER_ROWS}
SELECT id, sender_address FROM raw_transfers
WHERE sender_address ILIKE '%red%' OR sender_address ILIKE '%blue%' OR sender_address ILIKE '%green%'""",
        "router_messages": f"""WITH {MESSAGE_ROWS}
SELECT id, contract_address FROM raw_messages
WHERE contract_address ILIKE '%click%' OR contract_address ILIKE '%view%'
   OR contract_address ILIKE '%purchase%'""",
        "date_range": f"{RELATION} SELECT service, count(*) AS rows FROM ranged GROUP BY 1",
        "trailing_days": f"""{RELATION}
SELECT service, count(*) AS rows FROM bridges
WHERE CAST(created_at AS DATE) >= DATE '{AS_OF}' - 6 GROUP BY 1""",
        "transfers_normalized": f"{RELATION} SELECT {CANONICAL} FROM transfer_rows",
        "messages_normalized": f"{RELATION} SELECT {CANONICAL} FROM message_rows",
        "bridges_union": f"""{RELATION}
SELECT service, count(*) AS rows, count(DISTINCT id) AS ids FROM bridges GROUP BY 1""",
        "service_summary": f"""{RELATION}
SELECT service, count(*) AS rows, count(amount) AS amounts, count(fee) AS fees,
       CAST(sum(CAST(amount_usd AS DECIMAL(28,6))) AS DOUBLE) AS volume,
       CAST(sum(CAST(fee AS DECIMAL(28,6))) AS DOUBLE) AS fee_total
FROM bridges GROUP BY 1""",
        # Whole amounts, added as integers; the text makes the nearest double of them.
        "large_totals": f"""{RELATION}, dollars AS (
  SELECT service, CAST(floor(amount_usd) AS HUGEINT) AS d FROM bridges WHERE amount_usd IS NOT NULL)
SELECT service, CAST(CAST(sum(d * 1000000000000) AS VARCHAR) AS DOUBLE) AS total,
       CAST(CAST(sum(abs(d) * (2 * 1208925819614629174706176::HUGEINT + 1000000000000)) AS VARCHAR)
            AS DOUBLE) AS turnover
FROM dollars GROUP BY 1""",
        "message_fee": f"{RELATION} SELECT id, fee FROM message_rows",
        "chain_case": f"""{RELATION}
SELECT 'as spelled' AS variant, source_chain, count(*) AS rows FROM bridges GROUP BY 2
UNION ALL
SELECT 'lower case' AS variant, source_chain, count(*) AS rows FROM lowered GROUP BY 2""",
        "unique_routes": f"""{RELATION}
SELECT 'as spelled' AS variant,
       count(DISTINCT source_chain || '➡' || destination_chain) AS routes FROM bridges
UNION ALL
SELECT 'lower case' AS variant,
       count(DISTINCT source_chain || '➡' || destination_chain) AS routes FROM lowered""",
        "median_by_period": f"""{RELATION}
SELECT {_period("month")} AS date, median(amount_usd) AS median
FROM ranged WHERE amount_usd IS NOT NULL GROUP BY 1""",
        "first_activity_ts": f"{RELATION} SELECT wallet, min(created_at) AS first_ts FROM bridges GROUP BY 1",
        "first_activity_date": f"""{RELATION}
SELECT wallet, min(CAST(created_at AS DATE)) AS first_date FROM bridges GROUP BY 1""",
        "users_by_period": f"""{RELATION}
SELECT {_period("month")} AS date, count(DISTINCT wallet) AS total FROM ranged GROUP BY 1""",
        "new_users_by_period": f"""{RELATION},
firsts AS (SELECT wallet, min(CAST(created_at AS DATE)) AS first_date FROM bridges GROUP BY 1)
SELECT {_period("month", "first_date")} AS date, count(DISTINCT wallet) AS new FROM firsts
WHERE first_date BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1""",
        "status_join": f"""{RELATION}, {STATUS_JOIN}
SELECT CASE WHEN is_new THEN 'New Users' ELSE 'Returning Users' END AS user_status, count(*) AS rows
FROM joined GROUP BY 1""",
        "status_rows_each": _each("joined"),
        "status_volume_share": f"""
SELECT date, user_status, volume, volume / sum(volume) OVER (PARTITION BY date) * 100 AS percentage
FROM ({_status_by_period("month")})""",
        "share_of_total": _shares(_chain("source_chain"), "source_chain", ["volume", "bridges"]),
        "dest_chain_share": _shares(_chain("destination_chain"), "destination_chain", ["volume", "bridges"]),
        "asset_share": _shares(ASSETS, "symbol", ["volume", "bridges"]),
        "amount_bucket_share": _shares(AMOUNT_BUCKETS, "amount_bucket", ["transactions"]),
        "txn_bucket_share": _shares(TXN_BUCKETS, "txn_bucket", ["users"]),
        "status_share": _shares(STATUS_VOLUME, "user_status", ["volume"]),
        "status_volume_wide": f"""
SELECT date, max(CASE WHEN user_status = 'New Users' THEN volume END) AS new_volume,
       max(CASE WHEN user_status = 'Returning Users' THEN volume END) AS returning_volume
FROM ({_status_by_period("month")}) GROUP BY 1""",
        "status_volume_total": f"""
SELECT user_status, coalesce(sum(volume), 0) AS volume FROM ({STATUS_VOLUME}) GROUP BY 1""",
        "asset_label": f"""{RELATION}
SELECT raw_asset, {LABEL} AS label, count(*) AS rows FROM bridges GROUP BY 1, 2""",
        "first_activity_state": f"{RELATION} SELECT wallet, min(created_at) AS first_ts FROM bridges GROUP BY 1",
        "status_volume_by_period_from_totals": _status_by_period("month"),
        "status_volume_from_totals": STATUS_VOLUME,
        "bridge_table": _activity("month"),
        "bridge_table_refresh": _activity("month"),
    }
