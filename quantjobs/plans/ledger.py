"""Queries of the ledger operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantjobs.functions.text import parse_amount, parse_date
from quantjobs.operators import ledger as lg
from quantjobs.operators import timeseries as ts
from quantjobs.plans.fixtures import table
from quantjobs.plans.market import r6
from quantjobs.sources.tables import scratch

END = "1995-12-31"


def lg1(s, d):
    o = table(s, d, "orders")
    amount = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "R$ ").otherwise(""), F.translate(F.format_number(F.floor("o_totalprice"), 2), ",.", ".,"), F.when(F.col("o_orderkey") % 5 == 0, "-").otherwise(""))
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 7 == 0, F.lit("31/02/x")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", parse_amount(amount).cast("double").alias("amount"), parse_date(day).alias("day"))


def _notes(s, d):
    comma = lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    t = table(s, d, "trades").withColumn("quantity", F.col("quantity").cast("int"))
    line = F.concat(F.when(F.col("seq") % 2 == 0, "1-BOVESPA ").otherwise(""), F.col("symbol"), F.lit(" ON NM "), comma("quantity"), F.lit(" "), comma("unit_price"), F.lit(" "), comma("gross_value"), F.when(F.col("side") == "BUY", " D").otherwise(" C"))
    body = t.groupBy("document").agg(F.min("trade_date").alias("d"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    fee = table(s, d, "fees").groupBy("document").agg(F.array_join(F.array_sort(F.collect_list(F.concat("fee_type", F.lit(" "), comma("amount"), F.lit(" D")))), "\n").alias("fees"))
    text = F.concat(F.lit("NOTA DE CORRETAGEM\nData pregao: "), F.date_format("d", "dd/MM/yyyy"), F.lit("\n"), "body", F.lit("\nResumo\n"), "fees")
    return body.join(fee, "document").select("document", text.alias("text"))


def lg2(s, d):
    t = lg.note_trades(_notes(s, d))
    return t.select("document", "seq", "trade_date", "side", "name", *[F.col(c).cast("double").alias(c) for c in ("quantity", "unit_price", "gross_value")])


def lg3(s, d):
    m = table(s, d, "movements").withColumn("value", F.floor(F.abs("value")) * F.signum("value"))
    word = F.element_at(F.create_map(*[F.lit(x) for x in ("APORTE", "TED RECEBIDA", "SAQUE", "SAQUE CONTA", "DIVIDENDO", "DIVIDENDO XPTO", "APLICACAO_FUNDO", "APLICACAO EM FUNDO", "BOLSA", "NOTA PREGAO")]), F.col("operation"))
    lines = m.groupBy("portfolio_id", "date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("  "), word, F.lit("  "), F.col("value").cast("int").cast("string"), F.lit(",00")).alias("l")))), lambda x: x["l"]), "\n").alias("b"))
    block = F.concat(F.date_format("date", "dd/MM/yyyy"), F.lit(" SALDO ANTERIOR\n"), "b")
    docs = lines.groupBy(F.col("portfolio_id").alias("document")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", block.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return lg.statement_movements(docs).select("document", "date", "operation", "value", "description")


def _alloc(s, d):
    return lg.allocate_fees(table(s, d, "trades"), table(s, d, "fees"))


def _ledger(s, d):
    return lg.fee_ledger(table(s, d, "trades"), table(s, d, "fees"))


def lg7(s, d):
    out = _ledger(s, d)
    return out.select("document", "seq", *[F.col(c).cast("double").alias(c) for c in ("allocated_fees", "total_cost", "net_cash_flow", "effective_price")])


def _named(s, d):
    i, t = table(s, d, "instruments"), table(s, d, "trades")
    name = F.when(F.col("seq") % 5 == 4, F.lit("CDB BANCO")).when(F.col("seq") % 5 == 3, F.lit("QQQ ZZZ")).when(F.col("seq") % 2 == 0, F.concat("name", F.lit(" ON NM"))).otherwise(F.upper("name"))
    return t.join(i.select("symbol", "name"), "symbol").select("portfolio_id", "document", "seq", "side", "quantity", name.alias("raw_name"))


def _dim(s, d):
    return table(s, d, "instruments").withColumn("broker_name", F.col("name"))


def lg8(s, d):
    return lg.resolve_symbols(_named(s, d), _dim(s, d)).select("document", "seq", "raw_name", "symbol")


def lg9(s, d):
    names = table(s, d, "part").select(F.concat("p_name", F.lit(" ON EDS NM")).alias("name"))
    return lg.suggest_symbols(names, table(s, d, "instruments"))


def lg9_queue(s, d):
    named = _named(s, d).groupBy("raw_name", "side").agg(F.sum("quantity").alias("quantity"))  # names are resolved alike in all trades
    ledger = lg.resolve_symbols(scratch(named, "named"), _dim(s, d))
    previous = ledger.sparkSession.createDataFrame([("CDB BANCO", "ignored")], "name string, status string")
    return lg.review_queue(ledger, table(s, d, "instruments"), previous).select("name", "qty", "score", "confidence", "status")


def _positions(s, d):
    return lg.positions(table(s, d, "trades"), table(s, d, "last_price"), table(s, d, "upsides"))


def r2(df, *cols):
    return df.withColumns({c: F.round(c, 2) for c in cols})


def lg11(s, d):
    rows = lg.cost_basis(_ledger(s, d))
    return r2(rows.groupBy("portfolio_id", "symbol").agg(F.max_by("qty", "date").alias("qty"), F.max_by("basis", "date").alias("basis")).withColumn("basis", F.col("basis").cast("decimal(28,9)")), "basis").withColumn("basis", F.col("basis").cast("double"))


def _history(s, d):
    return lg.holdings_history(_ledger(s, d), table(s, d, "bars"), END)


def lg14(s, d):
    m = table(s, d, "movements").withColumn("date", F.add_months("date", -12 * 29))
    fund = table(s, d, "bench_ret").select("date", (F.col("ret") / 10).alias("fund_return"))
    out = lg.real_daily(_history(s, d), table(s, d, "trades").where(F.col("trade_date") <= END), m, table(s, d, "bench_ret"), fund)
    return r2(out.drop("benchmark_return", "cost_basis"), "portfolio_value", "fund_value", "cash_value", "total_value", "cash_flow").withColumns({c: F.round(c, 8) for c in ("portfolio_return", "consolidated_return")})


def lg15(s, d):
    t = table(s, d, "trades").select("portfolio_id", "symbol", "trade_date", F.when(F.col("side") == "BUY", "C").otherwise("V").alias("side"), "quantity", F.col("gross_value").cast("double").alias("gross_value"), F.lit(1.0).alias("fees"))
    return lg.monthly_twr_from_trades(t, table(s, d, "bars"), "1995-01-01", "1996-12-31", ["portfolio_id"]).select("portfolio_id", "month", "value_start", "flows", "value_end", "ret")


def lg16(s, d):
    daily = ts.daily_returns(table(s, d, "bars")).select("symbol", "date", "ret", F.lit(0.0004).alias("rf"))
    return lg.monthly_twr_from_daily(daily, ["symbol"])


def lg17(s, d):
    daily = table(s, d, "trades").groupBy("portfolio_id", F.col("trade_date").alias("date")).agg(F.sum(F.col("gross_value").cast("double")).alias("total_value"))
    m = table(s, d, "movements").withColumn("date", F.add_months("date", -12 * 29))
    return r2(lg.modified_dietz(daily, m), "v0", "v1", "flow").withColumn("ret", F.round("ret", 8)).drop("ret_cum")


WEEKDAY = "isodow({}) < 6"
ALLOC = """tf AS (SELECT t.document, t.seq, t.gross_value AS g, sum(t.gross_value) OVER (PARTITION BY t.document) AS total, count(*) OVER (PARTITION BY t.document) AS n, max(t.seq) OVER (PARTITION BY t.document) AS last FROM trades t),
ff AS (SELECT document, fee_type, sum(amount) AS amount FROM fees GROUP BY 1, 2),
sh AS (SELECT tf.document, tf.seq, last, fee_type, amount, CASE WHEN tf.seq < last THEN CAST(CAST(CASE WHEN total = 0 THEN (2 * CAST(amount * 100 AS HUGEINT) + n) // (2 * n) ELSE (2 * CAST(amount * 100 AS HUGEINT) * CAST(g * 100 AS HUGEINT) + CAST(total * 100 AS HUGEINT)) // (2 * CAST(total * 100 AS HUGEINT)) END AS DOUBLE) / 100 AS DECIMAL(18, 2)) ELSE 0 END AS s FROM tf JOIN ff ON tf.document = ff.document),
alloc AS (SELECT document, seq, fee_type, CAST(CASE WHEN seq = last THEN amount - sum(s) OVER (PARTITION BY document, fee_type) ELSE s END AS DECIMAL(18, 2)) AS fee FROM sh),
led AS (SELECT t.*, coalesce(a.f, 0) AS allocated_fees, CASE WHEN side = 'BUY' THEN gross_value + coalesce(a.f, 0) ELSE gross_value - coalesce(a.f, 0) END AS total_cost FROM trades t LEFT JOIN (SELECT document, seq, sum(fee) AS f FROM alloc GROUP BY 1, 2) a ON t.document = a.document AND t.seq = a.seq)"""
HIST = f"""ch AS (SELECT portfolio_id, symbol, trade_date AS date, sum(CASE WHEN side = 'SELL' THEN -quantity ELSE quantity END) AS dq FROM trades WHERE isodow(trade_date) < 6 AND trade_date <= DATE '{END}' GROUP BY 1, 2, 3),
st AS (SELECT *, sum(dq) OVER w AS qty, coalesce(lead(date) OVER w - 1, DATE '{END}') AS until FROM ch WINDOW w AS (PARTITION BY portfolio_id, symbol ORDER BY date)),
dy AS (SELECT portfolio_id, symbol, qty, CAST(unnest(generate_series(CAST(date AS TIMESTAMP), CAST(until AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM st WHERE qty > 0 AND until >= date),
hist AS (SELECT d.portfolio_id, d.date, d.symbol, d.qty, b.close AS price, d.qty * b.close AS value FROM (SELECT * FROM dy WHERE isodow(date) < 6) d ASOF JOIN bars b ON d.symbol = b.symbol AND d.date >= b.date WHERE d.date - b.date <= 10)"""
SHIFT = "mv AS (SELECT portfolio_id, CAST(date - INTERVAL 29 YEAR AS DATE) AS date, operation, value FROM movements)"

QUERIES = {
    "lg1_parse": (lg1, """SELECT o_orderkey, CAST(floor(o_totalprice) * CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END AS DOUBLE) AS amount, CASE WHEN o_orderkey % 2 > 0 AND o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders"""),
    "lg2_note_trades": (lg2, "SELECT document, seq, min(trade_date) OVER (PARTITION BY document) AS trade_date, side, symbol || ' ON NM' AS name, quantity, CAST(unit_price AS DOUBLE) AS unit_price, CAST(gross_value AS DOUBLE) AS gross_value FROM trades"),
    "lg2_note_fees": (lambda s, d: lg.note_fees(_notes(s, d)).withColumn("amount", F.col("amount").cast("double")), "SELECT document, fee_type, CAST(amount AS DOUBLE) AS amount FROM fees WHERE amount > 0 AND document IN (SELECT document FROM trades)"),
    "lg3_statement_movements": (lg3, """SELECT portfolio_id AS document, date, operation, CAST(CASE WHEN operation = 'BOLSA' THEN floor(abs(value)) * sign(value) ELSE floor(abs(value)) END AS DOUBLE) AS value,
        CASE operation WHEN 'APORTE' THEN 'TED RECEBIDA' WHEN 'SAQUE' THEN 'SAQUE CONTA' WHEN 'DIVIDENDO' THEN 'DIVIDENDO XPTO' WHEN 'APLICACAO_FUNDO' THEN 'APLICACAO EM FUNDO' ELSE 'NOTA PREGAO' END AS description FROM movements"""),
    "lg4_classify_movements": (lambda s, d: _classified(s, d), """SELECT seq, CASE seq % 7 WHEN 0 THEN 'DIVIDENDO' WHEN 1 THEN 'RESGATE_FUNDO' WHEN 2 THEN 'APLICACAO_FUNDO' WHEN 3 THEN 'BOLSA' WHEN 4 THEN 'SAQUE' WHEN 5 THEN 'APORTE' END AS operation, CASE WHEN seq % 7 = 3 THEN value ELSE abs(value) END AS value FROM movements WHERE seq % 7 < 6"""),
    "lg5_dedupe_movements": (lambda s, d: lg.dedupe_movements(table(s, d, "movements"), ["portfolio_id", "date", "operation"]).select("portfolio_id", "date", "operation", "value", "seq"), "SELECT portfolio_id, date, operation, arg_min(value, seq) AS value, min(seq) AS seq FROM movements GROUP BY 1, 2, 3"),
    "lg5_new_documents": (lambda s, d: lg.new_documents(table(s, d, "trades").select("document", "seq"), table(s, d, "fees").where("document % 3 = 0")), "SELECT document, seq FROM trades WHERE document % 3 <> 0"),
    "lg6_allocate_fees": (lambda s, d: _alloc(s, d).withColumn("fee", F.col("fee").cast("double")), f"WITH {ALLOC} SELECT document, seq, fee_type, CAST(fee AS DOUBLE) AS fee FROM alloc"),
    "lg7_build_ledger": (lg7, f"WITH {ALLOC} SELECT document, seq, CAST(allocated_fees AS DOUBLE) AS allocated_fees, CAST(total_cost AS DOUBLE) AS total_cost, CAST(CASE WHEN side = 'BUY' THEN -total_cost ELSE total_cost END AS DOUBLE) AS net_cash_flow, sign(total_cost) * CAST((200 * CAST(abs(total_cost) * 100 AS HUGEINT) + CAST(quantity AS HUGEINT)) // (2 * CAST(quantity AS HUGEINT)) AS DOUBLE) / 10000 AS effective_price FROM led"),
    "lg7_ledger_summary": (lambda s, d: r2(lg.ledger_summary(_ledger(s, d), ["symbol"]), "gross", "fees", "cost"), f"WITH {ALLOC} SELECT symbol, sum(quantity) AS quantity, round(CAST(sum(gross_value) AS DOUBLE), 2) AS gross, round(CAST(sum(allocated_fees) AS DOUBLE), 2) AS fees, round(CAST(sum(total_cost) AS DOUBLE), 2) AS cost FROM led WHERE side = 'BUY' GROUP BY 1"),
    "lg8_resolve_symbols": (lg8, """WITH k AS (SELECT trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')) AS k, min(symbol) AS symbol FROM instruments GROUP BY 1), t AS (SELECT t.document, t.seq, i.name FROM trades t JOIN instruments i ON t.symbol = i.symbol)
        SELECT document, seq, CASE WHEN seq % 5 = 4 THEN 'CDB BANCO' WHEN seq % 5 = 3 THEN 'QQQ ZZZ' WHEN seq % 2 = 0 THEN name || ' ON NM' ELSE upper(name) END AS raw_name, CASE WHEN seq % 5 < 3 THEN k.symbol END AS symbol FROM t JOIN k ON trim(regexp_replace(upper(t.name), '[^A-Z0-9]+', ' ', 'g')) = k.k"""),
    "lg9_suggest_symbols": (lg9, """WITH a AS (SELECT DISTINCT name, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3))) AS t FROM (SELECT DISTINCT p_name || ' ON EDS NM' AS name FROM part)),
        b AS (SELECT symbol, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3))) AS t FROM instruments), s AS (SELECT name, symbol, count(*) AS score FROM a JOIN b ON a.t = b.t GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, symbol) AS n FROM s)
        SELECT d.name, r.symbol, coalesce(r.score, 0) AS score, CASE WHEN coalesce(r.score, 0) >= 2 THEN 'review' WHEN r.score = 1 THEN 'low' ELSE 'missing' END AS confidence FROM (SELECT DISTINCT p_name || ' ON EDS NM' AS name FROM part) d LEFT JOIN (SELECT * FROM r WHERE n = 1) r ON d.name = r.name"""),
    "lg9_review_queue": (lg9_queue, """SELECT CASE WHEN seq % 5 = 4 THEN 'CDB BANCO' ELSE 'QQQ ZZZ' END AS name, sum(CASE WHEN side = 'SELL' THEN -quantity ELSE quantity END) AS qty, CAST(0 AS BIGINT) AS score, 'missing' AS confidence, any_value(CASE WHEN seq % 5 = 4 THEN 'ignored' ELSE 'pending' END) AS status FROM trades WHERE seq % 5 >= 3 GROUP BY 1"""),
    "lg10_positions": (lambda s, d: r2(_positions(s, d).drop("target_price"), "net_invested", "value").withColumn("avg_price", F.round("avg_price", 4)), """WITH n AS (SELECT portfolio_id, symbol, sum(CASE WHEN side = 'SELL' THEN -quantity ELSE quantity END) AS net_qty, sum(CASE WHEN side = 'SELL' THEN -CAST(gross_value AS DOUBLE) ELSE CAST(gross_value AS DOUBLE) END) AS net_invested,
        sum(CASE WHEN side = 'BUY' THEN CAST(gross_value AS DOUBLE) END) / sum(CASE WHEN side = 'BUY' THEN quantity END) AS avg_price FROM trades GROUP BY 1, 2) SELECT n.portfolio_id, n.symbol, net_qty, round(net_invested, 2) AS net_invested, round(avg_price, 4) AS avg_price, p.price, round(net_qty * p.price, 2) AS value FROM n JOIN last_price p ON n.symbol = p.symbol WHERE net_qty > 0"""),
    "lg10_position_totals": (lambda s, d: r2(lg.position_totals(_positions(s, d)), "invested", "value", "pnl").withColumn("target_value", F.round("target_value", 5)), """SELECT portfolio_id, count(*) AS n, round(sum(invested), 2) AS invested, round(sum(qty * p.price), 2) AS value, round(sum(qty * coalesce(u.target_price, p.price)), 5) AS target_value, round(sum(qty * p.price - invested), 2) AS pnl
        FROM net n JOIN last_price p ON n.symbol = p.symbol JOIN upsides u ON n.symbol = u.symbol WHERE qty > 0 GROUP BY 1"""),
    "lg11_cost_basis": (lg11, f"""WITH {ALLOC}, g AS (SELECT portfolio_id, symbol, list({{'sell': side = 'SELL', 'q': quantity, 'c': CAST(total_cost AS DOUBLE), 'qty': CAST(0 AS DOUBLE), 'basis': CAST(0 AS DOUBLE)}} ORDER BY trade_date, document, seq) AS ts FROM led GROUP BY 1, 2),
        f AS (SELECT portfolio_id, symbol, list_reduce(ts, lambda a, t: {{'sell': t.sell, 'q': t.q, 'c': t.c, 'qty': CASE WHEN t.sell THEN a.qty - t.q ELSE a.qty + t.q END,
        'basis': CASE WHEN t.sell THEN a.basis - CASE WHEN a.qty > 0 THEN a.basis / a.qty * t.q ELSE 0 END ELSE a.basis + t.c END}}, {{'sell': false, 'q': CAST(0 AS DOUBLE), 'c': CAST(0 AS DOUBLE), 'qty': CAST(0 AS DOUBLE), 'basis': CAST(0 AS DOUBLE)}}) AS s FROM g)
        SELECT portfolio_id, symbol, s.qty AS qty, CAST(round(CAST(s.basis AS DECIMAL(28, 9)), 2) AS DOUBLE) AS basis FROM f"""),
    "lg12_holdings_history": (lambda s, d: r6(_history(s, d).drop("cost_basis"), "value"), f"WITH {HIST} SELECT portfolio_id, date, symbol, qty, price, round(value, 6) AS value FROM hist"),
    "lg12_holdings_totals": (lambda s, d: r2(lg.holdings_totals(_history(s, d)), "market_value").select("portfolio_id", "date", "market_value"), f"WITH {HIST} SELECT portfolio_id, date, round(sum(value), 2) AS market_value FROM hist GROUP BY 1, 2"),
    "lg13_transaction_cost_pct": (lambda s, d: lg.transaction_cost_pct(_ledger(s, d), "2001-06-30").withColumn("cost_pct", F.round("cost_pct", 4)), f"""WITH {ALLOC}, x AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY trade_date DESC, document DESC, seq DESC) AS n FROM led),
        g AS (SELECT portfolio_id, count_if(n <= 20) AS na, count_if(trade_date >= DATE '2001-06-30' - 180) AS nb, sum(CASE WHEN n <= 20 THEN CAST(allocated_fees AS DOUBLE) END) AS fa, sum(CASE WHEN n <= 20 THEN CAST(gross_value AS DOUBLE) END) AS ga,
        sum(CASE WHEN trade_date >= DATE '2001-06-30' - 180 THEN CAST(allocated_fees AS DOUBLE) END) AS fb, sum(CASE WHEN trade_date >= DATE '2001-06-30' - 180 THEN CAST(gross_value AS DOUBLE) END) AS gb FROM x GROUP BY 1)
        SELECT portfolio_id, round(CASE WHEN nb > na THEN fb / gb ELSE fa / ga END * 100, 4) AS cost_pct FROM g"""),
    "lg14_real_daily": (lg14, f"""WITH {HIST}, {SHIFT}, eq AS (SELECT portfolio_id, date, sum(value) AS pv FROM hist GROUP BY 1, 2), fl AS (SELECT portfolio_id, trade_date AS date, sum(CASE WHEN side = 'SELL' THEN -CAST(gross_value AS DOUBLE) ELSE CAST(gross_value AS DOUBLE) END) AS cf FROM trades WHERE trade_date <= DATE '{END}' GROUP BY 1, 2),
        op AS (SELECT portfolio_id, date, sum(CASE operation WHEN 'APORTE' THEN value WHEN 'SAQUE' THEN -value ELSE 0 END) AS ext, sum(CASE operation WHEN 'DIVIDENDO' THEN value ELSE 0 END) AS dv, sum(CASE operation WHEN 'SAQUE' THEN -value WHEN 'APLICACAO_FUNDO' THEN -value ELSE value END) AS cash, sum(CASE operation WHEN 'APLICACAO_FUNDO' THEN value ELSE 0 END) AS fund FROM mv GROUP BY 1, 2),
        dd AS (SELECT portfolio_id, date FROM eq UNION SELECT portfolio_id, date FROM fl UNION SELECT portfolio_id, date FROM op),
        j AS (SELECT dd.portfolio_id, dd.date, pv, coalesce(cf, 0) AS cf, coalesce(ext, 0) AS ext, coalesce(dv, 0) AS dv, coalesce(cash, 0) AS cash, coalesce(fund, 0) AS fund, coalesce(b.ret / 10, 0) AS fr FROM dd LEFT JOIN eq ON dd.portfolio_id = eq.portfolio_id AND dd.date = eq.date LEFT JOIN fl ON dd.portfolio_id = fl.portfolio_id AND dd.date = fl.date LEFT JOIN op ON dd.portfolio_id = op.portfolio_id AND dd.date = op.date LEFT JOIN bench_ret b ON dd.date = b.date),
        k AS (SELECT *, product(1 + fr) OVER w AS g, sum(cash) OVER w AS cv FROM j WINDOW w AS (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING)),
        l AS (SELECT *, g * sum(fund / g) OVER (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS fv FROM k), m AS (SELECT *, pv + cv + fv AS tv FROM l WHERE pv IS NOT NULL),
        n AS (SELECT *, lag(pv) OVER (PARTITION BY portfolio_id ORDER BY date) AS pp, lag(tv) OVER (PARTITION BY portfolio_id ORDER BY date) AS pt FROM m)
        SELECT portfolio_id, date, round(pv, 2) AS portfolio_value, round(fv, 2) AS fund_value, round(cv, 2) AS cash_value, round(tv, 2) AS total_value, round(cf, 2) AS cash_flow, round(CASE WHEN pp + cf - dv > 0 THEN pv / (pp + cf - dv) - 1 END, 8) AS portfolio_return, round(CASE WHEN pt + ext > 0 THEN tv / (pt + ext) - 1 END, 8) AS consolidated_return FROM n"""),
    "lg15_monthly_twr_from_trades": (lg15, """WITH t AS (SELECT portfolio_id, symbol, CAST(date_trunc('month', trade_date) AS DATE) AS m, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS dq, sum(CASE WHEN side = 'BUY' THEN CAST(gross_value AS DOUBLE) + 1 ELSE 0 END) AS b, sum(CASE WHEN side = 'BUY' THEN 0 ELSE CAST(gross_value AS DOUBLE) - 1 END) AS s FROM trades GROUP BY 1, 2, 3),
        sp AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-12-01', INTERVAL 1 MONTH)) AS DATE) AS m), px AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS m, arg_max(close, date) AS c FROM bars GROUP BY 1, 2),
        gr AS (SELECT p.portfolio_id, p.symbol, sp.m, coalesce(t.dq, 0) AS dq, coalesce(t.b, 0) AS b, coalesce(t.s, 0) AS s, px.c FROM (SELECT DISTINCT portfolio_id, symbol FROM trades) p CROSS JOIN sp LEFT JOIN t ON t.portfolio_id = p.portfolio_id AND t.symbol = p.symbol AND t.m = sp.m LEFT JOIN px ON px.symbol = p.symbol AND px.m = sp.m),
        v AS (SELECT *, sum(dq) OVER w AS q, last_value(c IGNORE NULLS) OVER w AS p FROM gr WINDOW w AS (PARTITION BY portfolio_id, symbol ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        mo AS (SELECT portfolio_id, m, sum(CASE WHEN abs(q) > 0.001 THEN q * coalesce(p, 0) ELSE 0 END) AS ve, sum(b) AS b, sum(s) AS s FROM v GROUP BY 1, 2), st AS (SELECT *, coalesce(lag(ve) OVER (PARTITION BY portfolio_id ORDER BY m), 0) AS vs FROM mo)
        SELECT portfolio_id, strftime(m, '%Y-%m') AS month, round(vs, 2) AS value_start, round(b - s, 2) AS flows, round(ve, 2) AS value_end, round(CASE WHEN ve = 0 AND s > 0 AND vs + b > 0 THEN s / (vs + b) - 1 WHEN vs + b - s > 0 THEN ve / (vs + b - s) - 1 ELSE 0 END, 6) AS ret FROM st"""),
    "lg16_monthly_twr_from_daily": (lg16, """WITH g AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS m, product(1 + ret) - 1 AS r, product(1.0004::DOUBLE) - 1 AS f, count(*) AS n FROM ret WHERE ret IS NOT NULL GROUP BY 1, 2),
        sp AS (SELECT symbol, CAST(unnest(generate_series(CAST(min(m) AS TIMESTAMP), CAST(max(m) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM g GROUP BY 1), x AS (SELECT sp.symbol, sp.m, coalesce(n, 0) AS n, coalesce(r, 0) AS r, coalesce(f, 0) AS f FROM sp LEFT JOIN g ON sp.symbol = g.symbol AND sp.m = g.m)
        SELECT symbol, strftime(m, '%Y-%m') AS month, n AS sessions, round(r, 6) AS ret, round(f, 6) AS rf, round(product(1 + r) OVER w - 1, 6) AS ret_cum, round(product(1 + f) OVER w - 1, 6) AS rf_cum FROM x WINDOW w AS (PARTITION BY symbol ORDER BY m ROWS UNBOUNDED PRECEDING)"""),
    "lg17_modified_dietz": (lg17, f"""WITH {SHIFT}, dl AS (SELECT portfolio_id, trade_date AS date, sum(CAST(gross_value AS DOUBLE)) AS tv FROM trades GROUP BY 1, 2), v AS (SELECT portfolio_id, CAST(date_trunc('month', date) AS DATE) AS m, arg_max(tv, date) AS v1 FROM dl GROUP BY 1, 2),
        f AS (SELECT portfolio_id, CAST(date_trunc('month', date) AS DATE) AS m, sum(CASE operation WHEN 'APORTE' THEN value ELSE -value END) AS f, sum(CASE operation WHEN 'APORTE' THEN value ELSE -value END * (day(last_day(date)) - day(date)) / day(last_day(date))) AS w FROM mv WHERE operation IN ('APORTE', 'SAQUE') GROUP BY 1, 2),
        x AS (SELECT v.portfolio_id, v.m, v1, coalesce(f, 0) AS f, coalesce(w, 0) AS w, coalesce(lag(v1) OVER (PARTITION BY v.portfolio_id ORDER BY v.m), 0) AS v0 FROM v LEFT JOIN f ON v.portfolio_id = f.portfolio_id AND v.m = f.m)
        SELECT portfolio_id, strftime(m, '%Y-%m') AS month, round(v0, 2) AS v0, round(v1, 2) AS v1, round(f, 2) AS flow, round(CASE WHEN v0 + w > 0 THEN (v1 - v0 - f) / (v0 + w) ELSE 0 END, 8) AS ret FROM x"""),
}


def _classified(s, d):
    texts = ["RENDIMENTO FII", "Resgate fundo DI", "APLICACAO FUNDO", "NOTA 123 BOLSA", "RETIRADA", "PIX recebido", "TARIFA"]
    word = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("seq") % 7 + 1).cast("int"))
    return lg.classify_movements(table(s, d, "movements").withColumn("description", word)).select("seq", "operation", "value")
