"""From predictions to settled bets: recommendations, stakes, results and weekly reports, kept in tables on a store."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialised
from ..sources import sinks, versions
from .portfolio import portfolio_stakes

BET = ["day", "match_id", "market"]
#: Columns of a saved recommendation.
SAVED = [*BET, "league", "home", "away", "p", "odds", "edge", "stake", "bound", "place"]


def recommendations(candidates: DataFrame, least_edge: float = 0.05, **limits) -> DataFrame:
    """Bets of (day, match_id, market, league, round, home, away, p, odds) whose edge is no less than that, with stakes under the
    portfolio's ``limits`` and their place by edge in the day. A price that is none, or a null probability, is no bet."""
    edge = F.col("p") - 1 / F.col("odds")
    c = candidates.where((F.col("odds") > 1) & (edge >= least_edge))
    out = portfolio_stakes(c, ["day"], ["match_id", "market"], "p", "odds", "home", "away", "round", "league", **limits)
    place = F.row_number().over(W.partitionBy("day").orderBy(F.desc("edge"), "match_id", "market"))
    return out.withColumn("place", place).select(*SAVED)


class Book:
    """Recommendations and settled bets below a folder that driver and executors share. Days are its buckets by month, so a day's
    change rewrites its month; what was saved or settled twice is there once."""

    def __init__(self, spark: SparkSession, root: str, bankroll: float = 1000.0):
        self.spark, self.root, self.bankroll = spark, root, bankroll
        self.month = {"bucket": F.date_format("day", "yyyy-MM")}

    def save(self, bets: DataFrame) -> None:
        sinks.append_keep_last(bets, f"{self.root}/recommendations", BET, **self.month)

    def open_bets(self) -> DataFrame:
        """Recommendations without a result."""
        bets = sinks.read_table(self.spark, f"{self.root}/recommendations")
        if not versions.exists(self.spark, f"{self.root}/settled"):
            return bets
        return bets.join(self.settled().select(*BET), BET, "left_anti")

    def settle(self, results: DataFrame, outcome: Mapping[str, str]) -> None:
        """Settles the open bets whose match has a row in ``results`` (match_id, result, closing); bets of other matches stay open.
        ``outcome`` maps markets to the result that wins them; a market that it lacks loses."""
        names = F.create_map(*[F.lit(x) for kv in outcome.items() for x in kv])
        one = results.where("result is not null").groupBy("match_id").agg(F.max(F.struct("result", "closing")).alias("r")).select("match_id", "r.*")
        won = F.coalesce(F.try_element_at(names, F.col("market")) == F.col("result"), F.lit(False))
        stake = F.col("stake") * self.bankroll
        done = self.open_bets().join(one, "match_id").withColumns({
            "hit": won, "staked": F.round(stake, 2), "pnl": F.round(F.when(won, stake * (F.col("odds") - 1)).otherwise(-stake), 2), "clv": F.round(F.col("p") - F.when(F.col("closing") > 1, 1 / F.col("closing")), 6),
        })
        sinks.append_keep_last(done.select(*SAVED, "result", "closing", "hit", "staked", "pnl", "clv"), f"{self.root}/settled", BET, **self.month)

    def settled(self) -> DataFrame:
        return sinks.read_table(self.spark, f"{self.root}/settled")

    def weekly(self) -> DataFrame:
        """A row for each week with settled bets: numbers, return, mean closing value, bankroll before and after, results by league and
        market, and the three best and worst bets. The bankroll runs over weeks, of which there are few."""
        s = self.settled().withColumn("week", F.to_date(F.date_trunc("week", "day")))
        rank = lambda *order: F.row_number().over(W.partitionBy("week").orderBy(*order))
        best, worst = (F.desc("pnl"), "match_id", "market"), ("pnl", "match_id", "market")
        # closing values are added from the worst bet on, so that rounded means don't depend on the order in which rows come
        running = F.sum("clv").over(W.partitionBy("week").orderBy(*worst).rowsBetween(W.unboundedPreceding, 0))
        s = s.withColumns({"b": rank(*best), "w": rank(*worst), "run": running})
        clv = F.try_divide(F.max_by("run", "w"), F.count("clv"))
        told = s.groupBy("week").agg(
            F.count("*").alias("bets"), F.sum(F.col("hit").cast("long")).alias("wins"), F.round(F.sum("pnl"), 2).alias("pnl"), F.sum("staked").alias("staked"), F.coalesce(clv, F.lit(0.0)).alias("clv"),
        )
        before = F.coalesce(F.sum("pnl").over(W.orderBy("week").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) + self.bankroll
        told = told.withColumn("bankroll_start", F.round(before, 2)).withColumn("bankroll_end", F.round(F.col("bankroll_start") + F.col("pnl"), 2))
        told = told.withColumns({"losses": F.col("bets") - F.col("wins"), "roi": F.when(F.col("staked") > 0, F.col("pnl") / F.col("staked")).otherwise(0.0)})
        # only six bets of a week are gathered
        name = F.concat_ws(":", "match_id", "market")
        three = lambda n: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(n) <= 3, F.struct(F.col(n).alias("n"), name.alias("x"))))), lambda v: v["x"]), " ")
        ends = s.where("b <= 3 or w <= 3").groupBy("week").agg(three("b").alias("best"), three("w").alias("worst"))
        return told.join(ends, "week").join(self._by(s, "league"), "week").join(self._by(s, "market"), "week").drop("staked")

    @staticmethod
    def _by(s: DataFrame, name: str) -> DataFrame:
        """(week, by_<name>): ``value=bets/pnl`` of each value, in order."""
        each = s.groupBy("week", name).agg(F.count("*").alias("n"), F.sum("pnl").alias("x"))
        told: Column = F.concat(F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit("="), F.col("n"), F.lit("/"), F.format_string("%.2f", F.round("x", 2)))
        return each.select("week", told.alias("t")).groupBy("week").agg(F.array_join(F.sort_array(F.collect_list("t")), " ").alias(f"by_{name}"))


def running_totals(settled: DataFrame, order: list[str], bankroll: float = 1000.0) -> DataFrame:
    """One row of totals of settled bets (day, hit, pnl, staked, clv), which follow each other by day and ``order``: bets, wins, losses, hit rate,
    pnl, return, mean closing value, bankroll, largest drawdown as a share of the peak before it, and the signed run of equal outcomes at the end.

    Days are summed first; what the bankroll and its peak are when a day begins follows from the days alone, which are few. Inside a day
    the running sums start from there, so no task follows all bets. Without a bet all are 0 and the bankroll is what it was."""
    s = settled.select("day", F.struct(*order).alias("o"), F.col("hit").cast("int").alias("hit"), "pnl", "staked", "clv")
    on = W.partitionBy("day").orderBy("o").rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy("day").orderBy(F.desc("o"))
    s = s.withColumns({"sum": F.sum("pnl").over(on), "last": F.first("hit").over(back)})
    s = s.withColumns({"top": F.max("sum").over(on), "broken": F.sum((F.col("hit") != F.col("last")).cast("int")).over(back.rowsBetween(W.unboundedPreceding, 0))})
    days = s.groupBy("day").agg(
        F.count("*").alias("n"), F.sum("hit").alias("wins"), F.sum("pnl").alias("total"), F.sum("staked").alias("staked"), F.sum("clv").alias("clv"), F.count("clv").alias("n_clv"), F.max("sum").alias("highest"),
        F.max("last").alias("last"), F.sum((F.col("broken") == 0).cast("int")).alias("run"),
    )
    before, later = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.desc("day"))
    days = days.withColumn("start", bankroll + F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    days = days.withColumn("peak", F.greatest(F.lit(bankroll), F.coalesce(F.max(F.col("start") + F.col("highest")).over(before), F.lit(bankroll))))
    # the run at the end goes on through days that hold nothing else
    days = days.withColumn("sign", F.first("last").over(later))
    whole = (F.col("last") == F.col("sign")) & (F.col("run") == F.col("n"))
    days = days.withColumn("joined", F.coalesce(F.min(whole.cast("int")).over(later.rowsBetween(W.unboundedPreceding, -1)), F.lit(1)))
    days = materialised(days)
    end = F.when((F.col("joined") == 1) & (F.col("last") == F.col("sign")), F.col("run")).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    told = days.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("bets"), F.coalesce(F.sum("wins"), F.lit(0)).alias("wins"), zero(F.sum("wins") / F.sum("n")).alias("hit_rate"), F.round(zero(F.sum("total")), 2).alias("pnl"),
        zero(F.try_divide(F.sum("total"), F.sum("staked"))).alias("roi"), zero(F.try_divide(F.sum("clv"), F.sum("n_clv"))).alias("mean_clv"), F.round(bankroll + zero(F.sum("total")), 2).alias("bankroll"),
        F.coalesce(F.sum(end) * F.max(F.when(F.col("sign") == 1, 1).otherwise(-1)), F.lit(0)).alias("streak"),
    )
    rows = s.join(days.select("day", "start", "peak"), "day")
    peak = F.greatest("peak", F.col("start") + F.col("top"))
    fall = rows.agg(zero(F.max(F.when(peak > 0, (peak - F.col("start") - F.col("sum")) / peak))).alias("max_drawdown"))
    return told.crossJoin(F.broadcast(fall)).withColumn("losses", F.col("bets") - F.col("wins"))  # one row each


def breakdown(settled: DataFrame, key: Column, name: str) -> DataFrame:
    """(name, bets, win_rate, roi_pct, profit) of each value of ``key``, such as a month or a league; values without bets are left out."""
    s = settled.groupBy(key.alias(name))
    return s.agg(F.count("*").alias("bets"), F.avg(F.col("hit").cast("double")).alias("win_rate"), (100 * F.try_divide(F.sum("pnl"), F.sum("staked"))).alias("roi_pct"), F.round(F.sum("pnl"), 2).alias("profit"))
