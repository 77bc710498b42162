"""From signals to trades, and trades to performance metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.strategy import with_strategy_returns
from tidemark.operators.windows import Series

CAPITAL = 10_000.0


def positions(signal: Column, threshold: float = 0.0) -> Column:
    """'long' above the threshold, 'short' below its negative, else 'flat', also for null and NaN."""
    known = signal.isNotNull() & ~F.isnan(signal)
    return F.when(known & (signal > threshold), "long").when(known & (signal < -threshold), "short").otherwise("flat")


def trade_table(bars: DataFrame, s: Series, signal: str = "signal", threshold: float = 0.0) -> DataFrame:
    """Trades of a signal, filled at the close of the bar that changes position.

    A trade is a stretch of rows in one position other than flat; it is entered at its
    first row and left at the first row after it. One still open at the end is no
    trade. Result: keys, ``entry_time``, ``exit_time``, ``entry_price``, ``exit_price``,
    ``position``, ``trade_size``, ``pnl``, ``return_pct``, ``result``,
    ``holding_hours``, ``entry_signal``, ``exit_signal``. A return on an entry price not
    above 0 is 0.
    """
    w = s.all()
    time = s.order[0]
    sized = F.col(signal).cast("double")
    placed = bars.withColumn("position", positions(sized, threshold))
    turns = placed.withColumn("__tm_was", F.coalesce(F.lag("position").over(w), F.lit("flat"))).where("position <> __tm_was")
    nxt = {"exit_time": F.lead(time).over(w), "exit_price": F.lead("close").over(w), "exit_signal": F.lead(sized).over(w)}
    open_ = turns.withColumns(nxt).where("position <> 'flat' AND exit_time IS NOT NULL")
    pnl = F.when(F.col("position") == "long", F.col("exit_price") - F.col("close")).otherwise(F.col("close") - F.col("exit_price"))
    micros = F.unix_micros(F.col("exit_time").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
    return open_.withColumn("pnl", pnl).select(
        *s.keys, F.col(time).alias("entry_time"), "exit_time", F.col("close").alias("entry_price"), "exit_price", "position",
        F.abs(sized).alias("trade_size"), "pnl",
        F.when(F.col("close") > 0, F.col("pnl") / F.col("close")).otherwise(0.0).alias("return_pct"),
        F.when(F.col("pnl") > 0, "WIN").when(F.col("pnl") < 0, "LOSS").otherwise("BREAKEVEN").alias("result"),
        (micros / 3.6e9).alias("holding_hours"), sized.alias("entry_signal"), "exit_signal",
    )


def trade_pnl_curve(bars: DataFrame, s: Series, signal: str = "signal", threshold: float = 0.0) -> DataFrame:
    """Keys, order columns and ``cum_pnl``: profit of the trades left so far, booked at each one's exit bar; 0 before the first."""
    time = s.order[0]
    exits = trade_table(bars, s, signal, threshold).groupBy(*s.keys, F.col("exit_time").alias(time)).agg(F.sum("pnl").alias("__tm_pnl"))
    first = Window.partitionBy(*s.keys, time).orderBy(*s.order)
    booked = bars.select(*s.keys, *s.order).withColumn("__tm_1", F.row_number().over(first)).join(exits, [*s.keys, time], "left")
    gained = F.when(F.col("__tm_1") == 1, F.coalesce("__tm_pnl", F.lit(0.0))).otherwise(0.0)
    return booked.withColumn("cum_pnl", F.sum(gained).over(s.upto())).select(*s.keys, *s.order, "cum_pnl")


def equity_curve(bars: DataFrame, s: Series, signal: str = "signal") -> DataFrame:
    """Keys, order columns and ``equity``: summed log returns under the signal of the bar before."""
    done = with_strategy_returns(bars, s, signal)
    return done.withColumn("equity", F.sum("strategy_ret").over(s.upto())).select(*s.keys, *s.order, "equity")


def last_signals(bars: DataFrame, s: Series, signal: str = "signal") -> DataFrame:
    """The signal of each series' last bar."""
    return bars.groupBy(*s.keys).agg(F.max_by(signal, F.struct(*s.order)).alias(signal))


def paper_bars(bars: DataFrame, s: Series, target: str = "target", cost_bps: float = 1.0) -> DataFrame:
    """``bars`` with ``held`` (the target decided at the bar before), ``flip`` (change of what is held), ``gross`` and ``net`` profit in price points.

    A flip costs ``cost_bps`` of the close for each unit. Targets missing count as 0.
    """
    held = F.coalesce(F.lag(target).over(s.all()), F.lit(0.0)).cast("double")
    out = bars.withColumn("held", held)
    out = out.withColumn("flip", F.abs(F.col("held") - F.coalesce(F.lag("held").over(s.all()), F.lit(0.0))))
    out = out.withColumn("gross", F.col("held") * F.coalesce(F.col("close") - F.lag("close").over(s.all()), F.lit(0.0)))
    return out.withColumn("net", F.col("gross") - F.col("flip") * F.lit(cost_bps / 1e4) * F.col("close"))


def paper_fills(papered: DataFrame, s: Series) -> DataFrame:
    """The journal of ``paper_bars``: keys, order columns, ``side``, ``price``, ``target_position``, a row for each flip."""
    side = F.when(F.col("held") > 0, "LONG").when(F.col("held") < 0, "SHORT").otherwise("FLAT")
    return papered.where("flip > 0").select(*s.keys, *s.order, side.alias("side"), F.col("close").alias("price"), F.col("held").alias("target_position"))


def paper_summary(papered: DataFrame, s: Series) -> DataFrame:
    """Per series: ``n_bars``, ``n_flips``, ``gross_pnl``, ``net_pnl``, ``win_rate`` (percent of bars with a result other than 0; 0 if none) and ``sharpe`` per bar by the population deviation (0 without one)."""
    net = F.col("net")
    active, dev = F.count_if(net != 0), F.stddev_pop(net)
    return papered.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n_bars"), F.count_if(F.col("flip") > 0).alias("n_flips"), F.sum("gross").alias("gross_pnl"), F.sum("net").alias("net_pnl"),
        F.when(active > 0, F.count_if(net > 0) * 100.0 / F.when(active > 0, active)).otherwise(0.0).alias("win_rate"),
        F.when(dev > 0, F.avg(net) / F.when(dev > 0, dev)).otherwise(0.0).alias("sharpe"),
    )


def latest_pnl(reports: DataFrame, group: list[str], ticker: str, order: str, realized: str, unrealized: str) -> DataFrame:
    """Total realised and unrealised profit of each group: of each ticker's latest report, summed; ticker -1 is none."""
    last = F.max_by(F.struct(realized, unrealized), order)
    per = reports.where((F.col(ticker) != -1) & F.col(order).isNotNull()).groupBy(*group, ticker).agg(last.alias("__tm_l"))
    return per.groupBy(*group).agg(F.count(F.lit(1)).alias("n_tickers"), F.sum(f"__tm_l.{realized}").alias("realized"), F.sum(f"__tm_l.{unrealized}").alias("unrealized"))


def _longest(df: DataFrame, keys: list[str], order: list[str], flag: Column, out: str) -> DataFrame:
    """Longest run of rows with ``flag``, per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__tm_f", F.coalesce(flag, F.lit(False)))
    runs = marked.withColumn("__tm_i", F.sum(F.when(F.col("__tm_f"), 0).otherwise(1)).over(w)).where("__tm_f")
    return runs.groupBy(*keys, "__tm_i").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias(out))


def performance(bars: DataFrame, s: Series, signal: str = "signal", threshold: float = 0.0) -> DataFrame:
    """Metrics of each series' trades and of its bar returns under the signal; series without a trade have none but counts of 0.

    Averages over no trade are 0; a ratio whose divisor is 0 is 0, but infinite for
    ``payoff_ratio`` and, with gains, ``profit_factor``. Sharpe and Sortino are
    annualised by 252 bars whatever their length. Drawdown is in percent of 10 000 plus
    realised profit, booked from the exit bar on.
    """
    k = s.keys
    time = s.order[0]
    trades = trade_table(bars, s, signal, threshold)
    p, r = F.col("pnl"), F.col("return_pct")
    zero = F.lit(0.0)
    wealth = F.when(1 + r > 0, 1 + r)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(0.0)

    long_, short = F.col("position") == "long", F.col("position") == "short"
    t = trades.groupBy(*k).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(p > 0).alias("winning_trades"), F.count_if(p < 0).alias("losing_trades"),
        F.coalesce(F.avg(F.when(p > 0, p)), zero).alias("avg_win"), F.coalesce(F.avg(F.when(p < 0, p)), zero).alias("avg_loss"),
        F.sum(p).alias("total_pnl"), F.avg(p).alias("average_pnl"),
        F.coalesce(F.sum(F.when(p > 0, p)), zero).alias("__tm_gain"), F.coalesce(-F.sum(F.when(p < 0, p)), zero).alias("__tm_pain"),
        F.coalesce(F.max(F.when(p > 0, p)), zero).alias("largest_win"), F.coalesce(F.min(F.when(p < 0, p)), zero).alias("largest_loss"),
        F.coalesce(F.avg(F.log(wealth)), F.lit(float("-inf"))).alias("log_utility"), F.coalesce(F.avg(1 - 1 / wealth), F.lit(float("-inf"))).alias("crra_utility"),
        F.avg("holding_hours").alias("avg_hold_hours"), F.min("holding_hours").alias("min_hold_hours"), F.max("holding_hours").alias("max_hold_hours"),
        F.count_if(long_).alias("long_trades"), F.count_if(short).alias("short_trades"),
        F.count_if(long_ & (p > 0)).alias("__tm_lw"), F.count_if(short & (p > 0)).alias("__tm_sw"),
        F.coalesce(F.avg(F.when(long_, p)), zero).alias("long_avg_pnl"), F.coalesce(F.avg(F.when(short, p)), zero).alias("short_avg_pnl"),
    )
    order = ["exit_time", "entry_time"]
    t = t.join(_longest(trades, k, order, p > 0, "max_consecutive_wins"), k, "left").join(_longest(trades, k, order, p < 0, "max_consecutive_losses"), k, "left")

    x = F.col("strategy_ret")
    returns = with_strategy_returns(bars, s, signal)
    exits = trades.groupBy(*k, F.col("exit_time").alias(time)).agg(F.sum("pnl").alias("__tm_pnl"))
    first = Window.partitionBy(*k, time).orderBy(*s.order)
    booked = returns.withColumn("__tm_1", F.row_number().over(first)).join(exits, [*k, time], "left")
    equity = F.lit(CAPITAL) + F.sum(F.when(F.col("__tm_1") == 1, F.coalesce("__tm_pnl", zero)).otherwise(0.0)).over(s.upto())
    curve = booked.withColumn("__tm_eq", equity).withColumn("__tm_peak", F.max("__tm_eq").over(s.upto()))
    curve = curve.withColumn("__tm_dd", (F.col("__tm_peak") - F.col("__tm_eq")) / F.col("__tm_peak") * 100)
    days = F.floor((F.unix_micros(F.max(F.col(time).cast("timestamp"))) - F.unix_micros(F.min(F.col(time).cast("timestamp")))) / 86_400_000_000)
    b = curve.groupBy(*k).agg(
        F.avg(x).alias("avg_return"), F.stddev_samp(x).alias("volatility"), F.stddev_samp(F.when(x < 0, x)).alias("__tm_down"),
        F.sum(x).alias("__tm_sum"), days.alias("__tm_days"), F.max("__tm_dd").alias("max_drawdown"),
    )
    b = b.join(_longest(curve, k, s.order, F.col("__tm_dd") > 0, "max_drawdown_bars"), k, "left")
    m = b.join(t, k, "left").na.fill(0, ["total_trades", "winning_trades", "losing_trades", "max_consecutive_wins", "max_consecutive_losses", "max_drawdown_bars", "long_trades", "short_trades"])
    rate = share(F.col("winning_trades"), F.col("total_trades"))
    win, loss = F.col("avg_win"), F.col("avg_loss")
    year = F.sqrt(F.lit(252.0))
    yearly = F.when(F.col("__tm_days") > 0, F.col("__tm_sum") / (F.when(F.col("__tm_days") > 0, F.col("__tm_days")) / 365.25)).otherwise(0.0)
    return m.withColumns(
        {
            "win_rate": rate,
            "payoff_ratio": F.when(loss != 0, win / F.when(loss != 0, loss)).when(loss == 0, F.lit(float("inf"))),
            "profit_factor": F.when(F.col("__tm_pain") > 0, F.col("__tm_gain") / F.when(F.col("__tm_pain") > 0, F.col("__tm_pain"))).when(F.col("__tm_gain") > 0, F.lit(float("inf"))).when(F.col("__tm_gain") == 0, 0.0),
            "expectancy": rate * win + (1 - rate) * loss,
            "kelly": F.when((win != 0) & (loss != 0), rate / F.abs(F.when(loss != 0, loss)) - (1 - rate) / F.abs(F.when(win != 0, win))).otherwise(0.0),
            "sharpe_ratio": F.when(F.col("volatility") > 0, F.col("avg_return") / F.when(F.col("volatility") > 0, F.col("volatility")) * year).otherwise(0.0),
            "sortino_ratio": F.when(F.col("__tm_down") > 0, F.col("avg_return") / F.when(F.col("__tm_down") > 0, F.col("__tm_down")) * year).otherwise(0.0),
            "calmar_ratio": F.when(F.col("max_drawdown") > 0, yearly / F.when(F.col("max_drawdown") > 0, F.col("max_drawdown"))).otherwise(0.0),
            "adequate_sample": F.col("total_trades") >= 30,
            "long_win_rate": share(F.col("__tm_lw"), F.col("long_trades")),
            "short_win_rate": share(F.col("__tm_sw"), F.col("short_trades")),
        }
    ).drop("__tm_gain", "__tm_pain", "__tm_down", "__tm_sum", "__tm_days", "__tm_lw", "__tm_sw")
