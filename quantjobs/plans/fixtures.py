"""Domain tables derived from the given parquet tables, as SQL that Spark and DuckDB both accept."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

BASE = ("part", "lineitem", "orders", "events")
VIEWS = {
    "symbols": """SELECT p_partkey, upper(substr(p_type, 1, 4)) || substr(p_brand, 7) || '.SA' AS symbol,
        'SEC' || CAST(CAST(substr(p_brand, 7) AS INT) % 8 AS STRING) AS sector, p_brand AS industry, p_name FROM part""",
    "bars": """SELECT s.symbol, CAST(l.l_shipdate AS DATE) AS date,
        ROUND(50 + 100 * AVG(l.l_discount) + 50 * AVG(l.l_tax), 6) AS close, CAST(SUM(l.l_quantity) AS DOUBLE) AS volume
        FROM lineitem l JOIN symbols s ON l.l_partkey = s.p_partkey GROUP BY s.symbol, CAST(l.l_shipdate AS DATE)""",
    "instruments": "SELECT symbol, MIN(sector) AS sector, MIN(industry) AS industry, MIN(p_name) AS name FROM symbols GROUP BY symbol",
    "snapshots": """SELECT s.symbol, p.p_partkey AS seq, CAST(p.p_size - 5 AS DOUBLE) AS forward_pe,
        CAST(p.p_retailprice / 100 AS DOUBLE) AS forward_eps, CAST(p.p_partkey % 12 AS DOUBLE) AS dividend_yield,
        CAST((p.p_partkey % 40) * 10000 AS DOUBLE) AS average_volume,
        CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE 20 + CAST(p.p_partkey % 200 AS DOUBLE) END AS target_mean_price,
        DATE '2001-06-01' + CAST(p.p_partkey % 150 AS INT) AS last_updated
        FROM part p JOIN symbols s ON p.p_partkey = s.p_partkey""",
    "fundamentals": """SELECT symbol, forward_pe, forward_eps, dividend_yield, average_volume, target_mean_price, last_updated FROM
        (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY last_updated DESC, seq DESC) AS rn FROM snapshots) t WHERE rn = 1""",
    "trades": """SELECT CAST(o.o_custkey AS STRING) AS portfolio_id, o.o_orderkey AS document,
        CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice) AS INT) AS seq,
        CAST(o.o_orderdate AS DATE) AS trade_date, s.symbol, CASE WHEN l.l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
        CAST(l.l_quantity AS DOUBLE) AS quantity, CAST(50 + 100 * l.l_discount + 50 * l.l_tax AS DECIMAL(18, 4)) AS unit_price,
        CAST(l.l_quantity * (50 + 100 * l.l_discount + 50 * l.l_tax) AS DECIMAL(18, 2)) AS gross_value
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN symbols s ON l.l_partkey = s.p_partkey""",
    "fees": """SELECT o_orderkey AS document, 'Emolumentos' AS fee_type, CAST(ROUND(o_totalprice * 0.0003, 2) AS DECIMAL(18, 2)) AS amount FROM orders
        UNION ALL SELECT o_orderkey, 'Taxa de registro', CAST(ROUND(o_totalprice * 0.0001, 2) AS DECIMAL(18, 2)) FROM orders""",
    "movements": """SELECT CAST(user_id AS STRING) AS portfolio_id, event_id AS seq, CAST(ts AS DATE) AS date,
        CASE event_type WHEN 'signup' THEN 'APORTE' WHEN 'error' THEN 'SAQUE' WHEN 'click' THEN 'DIVIDENDO'
        WHEN 'view' THEN 'APLICACAO_FUNDO' ELSE 'BOLSA' END AS operation,
        CAST(CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN -value ELSE value END AS DOUBLE) AS value FROM events""",
    "history": """SELECT CAST(user_id AS STRING) AS portfolio_id, event_id AS run_id, ts AS timestamp, CAST(ts AS DATE) AS date,
        CASE event_type WHEN 'signup' THEN 'HOLD' WHEN 'error' THEN 'WATCH' WHEN 'click' THEN 'PARTIAL_REBALANCE' ELSE 'REBALANCE' END AS decision,
        CAST((value - 40) / 10 AS DOUBLE) AS gain, CAST(1 + event_id % 3 AS DOUBLE) AS hurdle, CAST(value AS DOUBLE) AS turnover FROM events""",
    # Further tables used by several queries.
    "cal": "SELECT date, CAST(row_number() OVER (ORDER BY date) AS INT) AS idx FROM (SELECT DISTINCT date FROM bars) d",
    "ret": """SELECT symbol, date, idx, close, CASE WHEN idx - prev_idx = 1 THEN close / prev - 1 END AS ret FROM
        (SELECT b.symbol, b.date, b.close, c.idx, lag(b.close) OVER (PARTITION BY b.symbol ORDER BY b.date) AS prev,
         lag(c.idx) OVER (PARTITION BY b.symbol ORDER BY b.date) AS prev_idx FROM bars b JOIN cal c ON b.date = c.date) t""",
    "bench": "SELECT date, ROUND(AVG(close), 6) AS close FROM bars GROUP BY date",
    "bench_ret": "SELECT date, ret FROM (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM bench) t WHERE ret IS NOT NULL",
    "last_price": "SELECT symbol, close AS price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) t WHERE rn = 1",
    "sector_pe": """SELECT i.sector, median(f.forward_pe) AS sector_pe FROM instruments i JOIN fundamentals f ON i.symbol = f.symbol
        WHERE f.forward_pe > 0 GROUP BY i.sector""",
    "risk": """SELECT symbol, avg(ret) * 252 AS annual_mean, stddev_samp(ret) * sqrt(252) AS annual_std,
        CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)) ELSE 0 END AS sharpe FROM ret GROUP BY symbol""",
    "trend": "SELECT symbol, b / a - 1 AS momentum FROM (SELECT symbol, max(CASE WHEN pos = 1 THEN close END) AS b, max(CASE WHEN pos = 30 THEN close END) AS a FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS pos FROM bars) t GROUP BY symbol) u",
    "facts": """SELECT i.symbol, i.sector, i.industry, i.name, p.price, f.target_mean_price, f.forward_pe, f.forward_eps, f.dividend_yield, f.average_volume,
        f.last_updated, q.sector_pe, k.annual_mean, k.annual_std, k.sharpe, m.momentum FROM instruments i JOIN last_price p ON i.symbol = p.symbol
        JOIN fundamentals f ON i.symbol = f.symbol LEFT JOIN sector_pe q ON i.sector = q.sector LEFT JOIN risk k ON i.symbol = k.symbol LEFT JOIN trend m ON i.symbol = m.symbol""",
    "upsides": """SELECT *, CASE WHEN source = 'YahooFinance' THEN target_mean_price WHEN source = 'SectorPE_Fallback' THEN price * (1 + upside) END AS target_price FROM
        (SELECT *, CASE WHEN source = 'YahooFinance' THEN least(greatest(target_mean_price / price - 1, -0.99), 10) WHEN source = 'SectorPE_Fallback' THEN least(greatest(sector_pe / forward_pe - 1, -0.99), 10) ELSE 0 END AS upside FROM
        (SELECT *, CASE WHEN target_mean_price > 0 AND price > 0 THEN 'YahooFinance' WHEN sector_pe IS NOT NULL AND forward_pe <> 0 THEN 'SectorPE_Fallback' ELSE 'None' END AS source FROM facts) t) u""",
    "normed": """SELECT u.*, CASE WHEN sharpe IS NULL THEN 0 WHEN s2 = s1 OR s1 IS NULL THEN 0.5 ELSE (sharpe - s1) / (s2 - s1) END AS sharpe_norm,
        CASE WHEN upside IS NULL THEN 0 WHEN u2 = u1 OR u1 IS NULL THEN 0.5 ELSE (upside - u1) / (u2 - u1) END AS upside_norm,
        CASE WHEN momentum IS NULL THEN 0 WHEN m2 = m1 OR m1 IS NULL THEN 0.5 ELSE (momentum - m1) / (m2 - m1) END AS momentum_norm
        FROM upsides u CROSS JOIN (SELECT min(sharpe) AS s1, max(sharpe) AS s2, min(upside) AS u1, max(upside) AS u2, min(momentum) AS m1, max(momentum) AS m2 FROM upsides) x""",
    "composite": "SELECT n.*, 0.4 * sharpe_norm + 0.35 * upside_norm + 0.25 * momentum_norm AS score FROM normed n",
    "best": "SELECT symbol, sector, pos FROM (SELECT symbol, sector, row_number() OVER (ORDER BY score DESC, symbol) AS pos FROM composite) t WHERE pos <= 50",
    # Five equal weights over the symbols traded most often, and five over the next ones.
    "ranked": "SELECT symbol, row_number() OVER (ORDER BY n DESC, symbol) AS pos FROM (SELECT symbol, COUNT(*) AS n FROM bars GROUP BY symbol) t",
    "weights": "SELECT symbol, CAST(0.2 AS DOUBLE) AS weight FROM ranked WHERE pos <= 5",
    "ideal": "SELECT symbol, CAST(CASE WHEN pos = 4 THEN 0.3 WHEN pos = 5 THEN 0.2 ELSE 0.25 END AS DOUBLE) AS weight FROM ranked WHERE pos BETWEEN 4 AND 7",
    "port_ret": "SELECT r.date, SUM(w.weight * r.ret) AS ret FROM ret r JOIN weights w ON r.symbol = w.symbol WHERE r.ret IS NOT NULL GROUP BY r.date",
    "net": """SELECT portfolio_id, symbol, SUM(CASE WHEN side = 'SELL' THEN -quantity ELSE quantity END) AS qty,
        CAST(SUM(CASE WHEN side = 'SELL' THEN -gross_value ELSE gross_value END) AS DOUBLE) AS invested FROM trades GROUP BY portfolio_id, symbol""",
    "held": "SELECT n.portfolio_id, n.symbol, n.qty, p.price, n.qty * p.price AS value FROM net n JOIN last_price p ON n.symbol = p.symbol WHERE n.qty > 0",
    "hold_w": "SELECT portfolio_id, symbol, qty, price, value, value / SUM(value) OVER (PARTITION BY portfolio_id) AS weight FROM held",
}


#: What Spark reads instead of a view's own FROM clause, with equal rows: lines meet their parts first, so that a shuffle by
#: order serves the join, the lines' numbers and all that goes by document; a shuffle by portfolio serves pairs and weights.
#: Facts are joined from tables of one row an instrument, small ones whatever the input, without a sort for each side.
ARRANGED = {
    "trades": ("lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN symbols s ON l.l_partkey = s.p_partkey", "lineitem l JOIN symbols s ON l.l_partkey = s.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey"),
    "net": ("FROM trades", "FROM (SELECT /*+ REPARTITION(portfolio_id) */ portfolio_id, symbol, side, quantity, gross_value FROM trades) t"),
    "facts": ("SELECT i.symbol,", "SELECT /*+ BROADCAST(p, f, q, k, m) */ i.symbol,"),
}
#: Tables that many queries share: kept by Spark once they are made, instead of being derived anew for each mention.
SHARED = ("bars", "cal", "ret", "trades", "facts", "upsides", "best", "hold_w", "instruments")
_kept: dict[tuple[str, str, str], DataFrame] = {}


def needed(*names: str) -> list[str]:
    """The views that ``names`` depend on, in an order in which they can be made."""
    import re

    out: list[str] = []

    def visit(name: str) -> None:
        for other in VIEWS:
            if other != name and re.search(rf"\b(FROM|JOIN)\s+{other}\b", VIEWS[name], re.I) and other not in out:
                visit(other)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return out


def with_views(sql: str) -> str:
    """``sql`` behind the common table expressions that it uses."""
    import re

    used = needed(*[v for v in VIEWS if re.search(rf"\b(FROM|JOIN)\s+{v}\b", sql, re.I)])
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    sql = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.upper().startswith(start):
            return f"{start}{head},\n{sql[len(start):]}" if head else sql
    return f"WITH {head}\n{sql}" if head else sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table or a given one, planned once. Shared ones stay in memory or on the executors' disks; lost parts are derived anew."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        for old in [k for k in _kept if k[0] != key[0]]:
            del _kept[old]
        _kept[key] = _derived(spark, sf_dir, name) if name in VIEWS else spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in SHARED and _kept[key].storageLevel == StorageLevel.NONE:
        _kept[key].persist(StorageLevel.MEMORY_AND_DISK)
    return _kept[key]


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables that it names, each of them a DataFrame: common table expressions that nest deeply slow the optimiser down."""
    import re

    sql = VIEWS[name].replace(*ARRANGED[name]) if name in ARRANGED else VIEWS[name]
    found = {b for b in (*BASE, *VIEWS) if b != name and re.search(rf"\b(FROM|JOIN)\s+{b}\b", sql)}
    for b in found:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{b}\b", rf"\1 {{{b}}}", sql)
    return spark.sql(sql, **{b: table(spark, sf_dir, b) for b in found})
