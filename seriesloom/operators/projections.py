"""Projections, predicates and reshapes that depend on which columns a frame has.

They are resolved while the plan is built, from the schema alone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import checkpointed
from ..sources.files import require
from .selection import exact_quantiles


def prefixed(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    """All columns but ``keep`` under a prefix."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keep})


def both_sides(df: DataFrame, dim: DataFrame, key: str, sides: Sequence[str] = ("home", "away")) -> DataFrame:
    """A dimension left-joined to each side's key, its other columns under the side's prefix."""
    for s in sides:
        d = prefixed(dim, f"{s}_", key).withColumnRenamed(key, f"__{s}")
        df = df.join(d, F.col(s).eqNullSafe(F.col(f"__{s}")), "left").drop(f"__{s}")
    return df


def optional(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Adds target columns of those sources that are there."""
    return df.withColumns({target: F.col(source) for target, source in names.items() if source in df.columns})


def first_present(df: DataFrame, candidates: Sequence[str], positive: bool = False) -> Column:
    """The first candidate that the frame has, as a number; nulls are not filled from the others."""
    for c in candidates:
        if c in df.columns:
            x = F.col(c).cast("string").try_cast("double")
            return F.nullif(x, F.lit(0.0)) if positive else x
    return F.lit(None).cast("double")


def fallback_columns(df: DataFrame, *maps: Mapping[str, str]) -> dict[str, str]:
    """Source of each target: of the first map that has one; no map after one that is there as a whole is asked."""
    found: dict[str, str] = {}
    for m in maps:
        there = {t: s for t, s in m.items() if s in df.columns}
        found = {**there, **found}
        if len(there) == len(m):
            break
    return found


def coalesced(df: DataFrame, columns: Sequence[str]) -> Column:
    """The first value of a row that is a number."""
    return F.coalesce(*[F.col(c).cast("string").try_cast("double") for c in columns if c in df.columns], F.lit(None).cast("double"))


def active(df: DataFrame, column: str) -> DataFrame:
    """Rows with a value above 0; all of them without that column."""
    return df.where(F.col(column) > 0) if column in df.columns else df


def upcoming(df: DataFrame, target: str, day: str, at: str) -> DataFrame:
    """Rows without a target or of that day or later; only those of the day itself if there are any."""
    date = F.lit(at).cast("date")
    some = df.where(F.col(target).isNull() | (F.col(day) >= date))
    same = F.broadcast(some.agg(F.coalesce(F.bool_or(F.col(day) == date), F.lit(False)).alias("__same")))  # one row
    return some.crossJoin(same).where((~F.col("__same")) | (F.col(day) == date)).drop("__same")


def recent_training(df: DataFrame, target: str, classes: Sequence, day: str, at: str, season: str, seasons: int = 2) -> DataFrame:
    """Labelled rows before a day, of the largest seasons among them."""
    some = df.where(F.col(target).isin(list(classes)) & (F.col(day) < F.lit(at).cast("date")))
    last = some.select(season).distinct().orderBy(F.desc(season)).limit(seasons)
    return some.join(F.broadcast(last), season, "left_semi")


def feature_columns(df: DataFrame, excluded: Sequence[str] = (), most_missing: float = 0.5) -> list[str]:
    """Numeric columns of which no more than that share is null or NaN; one aggregation."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in excluded]
    if not numeric:
        return []
    gone = lambda c: F.isnull(c) | F.isnan(F.col(c).cast("double"))
    share = df.agg(*[F.avg(gone(c).cast("double")).alias(c) for c in numeric]).first()
    return [c for c in numeric if share[c] is None or share[c] <= most_missing]


def side_pairs(df: DataFrame, marks: Sequence[str], sides: tuple[str, str] = ("home_", "away_")) -> list[tuple[str, str, str]]:
    """(base, home column, away column) of numeric columns on both sides whose base holds a mark."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    bases = [c.removeprefix(sides[0]) for c in df.columns if c.startswith(sides[0]) and c in numeric]
    return [(b, sides[0] + b, sides[1] + b) for b in bases if sides[1] + b in numeric and any(m in b for m in marks)]


def stat_bases(df: DataFrame, known: Sequence[str], sides: tuple[str, str] = ("home_", "away_")) -> list[str]:
    """The known bases, then any other that both sides have, by name."""
    there = {c.removeprefix(sides[0]) for c in df.columns if c.startswith(sides[0])}
    both = {b for b in there if sides[1] + b in df.columns}
    return [*[b for b in known if b in both], *sorted(both - set(known))]


def side_differences(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    return df.withColumns({f"diff_{b}": F.col(h) - F.col(a) for b, h, a in pairs})


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Products of those pairs of which both columns are there."""
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs if a in df.columns and b in df.columns})


def with_stubs(df: DataFrame, stubs: Mapping[str, str], *required: str) -> DataFrame:
    """Required columns checked, absent ones added as nulls of a type."""
    require(df.columns, required)
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in stubs.items() if c not in df.columns})


def market_scan(df: DataFrame, markets: Sequence[tuple[str, str, Sequence[str]]], least_edge: float) -> DataFrame:
    """Rows of (name, probability column, price columns of its bookmakers) whose edge is at least that."""
    each = F.array(*[F.struct(F.lit(m).alias("market"), F.col(p).alias("p"), best_of(prices).alias("best")) for m, p, prices in markets])
    out = df.withColumn("__m", F.explode(each)).select(*df.columns, "__m.market", "__m.p", F.col("__m.best.name").alias("book"), F.col("__m.best.price").alias("price"))
    return out.withColumn("edge", F.col("p") - 1 / F.col("price")).where(F.col("edge") >= least_edge)


def best_of(prices: Sequence[str]) -> Column:
    """struct(price, order, name) of the highest price above 1; the first wins ties. Null if there is none."""
    each = F.array(*[F.struct(F.col(c).cast("double").alias("price"), F.lit(-i).alias("order"), F.lit(c).alias("name")) for i, c in enumerate(prices)])
    return F.array_max(F.filter(each, lambda x: x["price"] > 1.0))


def one_hot_rows(df: DataFrame, p: str, y: str) -> DataFrame:
    """A row for each class of a probability array: (k, p, hit)."""
    return df.select(*[c for c in df.columns if c != p], F.posexplode(p).alias("k", "p")).withColumn("hit", (F.col("k") == F.col(y)).cast("int"))


def gathered(p: Column, y: Column) -> Column:
    """The element of the actual class, counted from 0."""
    return F.try_element_at(p, (y + 1).cast("int"))


def membership(label: Column, **sets: Sequence[str]) -> list[Column]:
    """A flag for each set of labels; null stays null."""
    return [label.isin(list(s)).alias(n) for n, s in sets.items()]


def budget_scaled(x: Column, budget: float, total: Column) -> Column:
    return x * F.least(F.lit(1.0), F.try_divide(F.lit(budget), total))


def composite_key(*parts: Column | str, unordered: bool = False, by: str = "_") -> Column:
    """Parts joined; ``unordered`` ones are sorted, so that both orders have one key."""
    parts = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.sort_array(F.array(*parts)), by) if unordered else F.concat_ws(by, *parts)


def aliased_rows(df: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """All rows, and those with an alias once more for each (name, alias); Spark broadcasts the aliases if they are few."""
    more = df.join(aliases.select(F.col("name").alias(name), "alias"), name)
    return df.unionByName(more.withColumn(name, F.col("alias")).select(*df.columns))


def one_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """The first row of each key by ``order``, or the last."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(*[c.desc() for c in order] if last else order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def tail(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The last n rows of each key."""
    i = F.row_number().over(W.partitionBy(*key).orderBy(*[c.desc() for c in order]))
    return df.withColumn("__n", i).where(F.col("__n") <= n).drop("__n")


def unique_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that fails if the right side repeats a key, so no row multiplies."""
    twice = right.groupBy(*on).count().where("count > 1").select(*on).head(1)
    if twice:
        raise ValueError(f"key {twice[0].asDict()} is repeated")
    return left.join(right, list(on), "left")


def closing_prices(df: DataFrame, sharp: Sequence[str], market: Sequence[str]) -> DataFrame:
    """Per column: the sharp price, else the market's, else the median of what there is of both (one row, by selection)."""
    filled = df.withColumns({s: F.coalesce(s, m) for s, m in zip(sharp, market, strict=True)})
    medians = exact_quantiles(filled, sharp).withColumnsRenamed({s: f"__{s}" for s in sharp})
    return filled.crossJoin(F.broadcast(medians)).withColumns({s: F.coalesce(s, f"__{s}") for s in sharp}).drop(*[f"__{s}" for s in sharp])


def closing_value(p: Column, closing: Column) -> Column:
    """Probability less the closing price's; null for a price that is none."""
    return p - F.when(closing > 0, 1 / closing)


def join_closing(df: DataFrame, odds: DataFrame, on: Sequence[str], suffix: str = "_odds") -> DataFrame:
    """Left join of closing prices; columns that clash get a suffix, and ``matched`` tells hits."""
    require(df.columns, on)
    require(odds.columns, on)
    clash = {c: c + suffix for c in odds.columns if c in df.columns and c not in on}
    return df.join(odds.withColumnsRenamed(clash).withColumn("matched", F.lit(True)), list(on), "left").na.fill({"matched": False})


def game_key(text: Column, known: Sequence[str]) -> Column:
    """struct(day, home, away) of ``YYYY-MM-DD home-away``: the hyphen that leaves most known names,
    the first of the best; the last hyphen if there is none. Null if the text has another form."""
    day, teams = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}) (.+)$", 1), F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}) (.+)$", 2)
    names = F.array(*[F.lit(k) for k in known])
    # what is needed more often is computed once, as the argument of a function
    let = lambda x, f: F.transform(F.array(x), f)[0]
    side = lambda parts, a, n: F.trim(F.array_join(F.slice(parts, a, n), "-"))
    hit = lambda x: F.array_contains(names, x).cast("int")
    cut = lambda parts, i: let(
        F.struct(side(parts, F.lit(1), i).alias("home"), side(parts, i + 1, F.size(parts) - i).alias("away")),
        lambda s: F.struct((hit(s["home"]) + hit(s["away"])).alias("n"), (-i).alias("order"), s["home"].alias("home"), s["away"].alias("away")),
    )
    cuts = lambda parts: F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: cut(parts, i))
    pick = lambda each: let(F.array_max(each), lambda best: F.when(best["n"] > 0, best).otherwise(F.element_at(each, -1)))
    named = lambda parts: let(let(cuts(parts), pick), lambda x: F.when((day != "") & (F.size(parts) > 1), F.struct(day.alias("day"), x["home"].alias("home"), x["away"].alias("away"))))
    return let(F.split(teams, "-"), named)


def verdicts(spikes: DataFrame, correlations: DataFrame, probes: DataFrame) -> DataFrame:
    """(feature, verdict, correlation, reasons) from three tables of (feature, value, flagged): leaker if
    the first two flag it, suspicious if any does; worst first, then by correlation."""
    names = ("spike", "correlation", "probe")
    out = None
    for name, df in zip(names, (spikes, correlations, probes), strict=True):
        one = df.select("feature", F.col("value").alias(name), F.col("flagged").alias(f"{name}_flag"))
        out = one if out is None else out.join(one, "feature", "full")
    flag = lambda n: F.coalesce(f"{n}_flag", F.lit(False))
    verdict = F.when(flag("spike") & flag("correlation"), "leaker").when(flag("spike") | flag("correlation") | flag("probe"), "suspicious").otherwise("safe")
    reasons = F.concat_ws("; ", *[F.when(flag(n), n) for n in names])
    out = out.select("feature", verdict.alias("verdict"), "correlation", reasons.alias("reasons"))
    return out.orderBy(F.when(F.col("verdict") == "leaker", 0).when(F.col("verdict") == "suspicious", 1).otherwise(2), F.desc_nulls_last("correlation"), "feature")


def run_stages(df: DataFrame, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], run: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """Stages one after the other; one whose plan can't be built leaves the frame as it is and is reported.

    With ``run`` each stage's frame is computed and kept (a reliable checkpoint, which is complete or not there), so that an
    error in a task, too, leaves the frame of the last good stage, and no later stage computes an earlier one again."""
    failed = {}
    for name, stage in stages:
        try:
            df = checkpointed(stage(df)) if run else stage(df)
        except Exception as e:
            failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0]}"
    return df, failed
