"""Joins that prefer: by a folded name with a preference of the left row, and by a fine key before a coarse one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import safe_divide
from ..session import dealt


#: Rows that a task of a lookup sorts.
TASK_ROWS = 250_000


def folded_key(name: Column) -> Column:
    """The name without case and spaces at its ends; null if nothing is left."""
    key = F.lower(F.trim(name))
    return F.when(key != "", key)


def preferred_match(
    left: DataFrame, right: DataFrame, name: tuple[str, str], season: tuple[str, str], rating: str, identity: Sequence[str], order: Sequence[str] = (),
) -> DataFrame:
    """Left rows that have a namesake on the right, with its columns: of the namesakes first those of the left row's own
    season, then the highest ``rating``, then the first by ``order``. One row for each ``identity``: of rows that repeat it the
    one with a namesake of its season, then of the highest rating, then the first by all left columns.

    Names meet without case and outer spaces; rows without a name match nothing. The right side is reduced before the join,
    once to the best of each (name, season) and once to the best of each name, so that namesakes never multiply;
    right columns that clash are left out."""
    (a, b), (own, of) = name, season
    first = [F.desc_nulls_last(rating), *[F.asc_nulls_last(c) for c in order]]
    more = [c for c in right.columns if c not in left.columns]
    r = right.withColumn("__k", folded_key(F.col(b))).where("__k is not null")
    best = lambda *by: r.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*first))).where("__n = 1")
    pick = F.struct(F.col(rating).alias("__rating"), *more)
    same = best("__k", of).where(F.col(of).isNotNull()).select("__k", F.col(of).alias("__s"), pick.alias("__same"))
    any_ = best("__k").select("__k", pick.alias("__any"))
    out = left.withColumns({"__k": folded_key(F.col(a)), "__s": F.col(own)}).where("__k is not null")
    out = out.join(any_, "__k").join(same, ["__k", "__s"], "left").withColumn("__hit", F.coalesce("__same", "__any"))
    one = W.partitionBy(*identity).orderBy(F.desc(F.col("__same").isNotNull()), F.desc_nulls_last("__hit.__rating"), *[F.asc_nulls_last(F.col(f"`{c}`")) for c in left.columns])
    out = out.withColumn("__n", F.row_number().over(one)).where("__n = 1")
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"__hit.`{c}`").alias(c) for c in more])


def two_level_lookup(left: DataFrame, sides: Mapping[str, tuple[DataFrame, Sequence[str]]], coarse: Sequence[str], fine: Sequence[str], order: Sequence[str] = (), rows: int = 0) -> DataFrame:
    """Left rows with the columns of each side: of the side's row that has the same coarse and fine key, else of the last row, by
    fine key and ``order``, that has the same coarse key; nulls without either. A side's columns get its name and ``_`` in front.

    All sides and the left rows come under each other and are shuffled once, by the coarse key; the fine key is a finer window in the
    same partitions. Of rows of a side with both keys equal the last by ``order`` counts. A row with a null in its coarse
    key meets nothing and isn't shuffled; one with a null fine key has only the coarse one.

    A task sorts what it gets, so tell with ``rows`` about how many rows come together: there are then partitions enough for
    TASK_ROWS in each, where a fixed number of them would grow with the tables."""
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    frames = [left.where(_all_known(coarse)).select(*coarse, *fine, row.alias("__l"), *[F.lit(None).alias(f"__{s}") for s in sides])]
    for name, (df, columns) in sides.items():
        at = F.struct(F.struct(*fine, *order).alias("o"), F.struct(*columns).alias("v"))
        frames.append(df.where(_all_known(coarse)).select(*coarse, *fine, F.lit(None).alias("__l"), *[(at if s == name else F.lit(None)).alias(f"__{s}") for s in sides]))
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    every = dealt(every, rows, *coarse, most=TASK_ROWS)
    near, far = W.partitionBy(*coarse, *fine), W.partitionBy(*coarse)
    known = _all_known(fine)
    found = {f"__{s}": F.coalesce(F.when(known, F.max(f"__{s}").over(near)), F.max(f"__{s}").over(far)) for s in sides}
    out = every.select("__l", *[c.alias(n) for n, c in found.items()]).where("__l is not null")
    named = [F.col(f"__{s}.v.`{c}`").alias(f"{s}_{c}") for s, (_, columns) in sides.items() for c in columns]
    out = out.select("__l.*", *named)
    rest = left.where(~_all_known(coarse))
    return out.unionByName(rest.select("*", *[F.lit(None).cast(df.schema[c].dataType).alias(f"{s}_{c}") for s, (df, columns) in sides.items() for c in columns]))


def _all_known(names: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).isNotNull()
    return out


#: Ratio, numerator, denominator.
SET_PIECES = (
    ("corner_attack_effectiveness", "goals_from_corners", "corners_won"),
    ("corner_xg_efficiency", "xg_from_corners", "corners_won"),
    ("corner_defense", "goals_conceded_from_corners", "opponent_corners"),
    ("fk_effectiveness", "goals_from_fk", "shots_from_fk"),
    ("setpiece_dependency", "goals_from_setpieces", "total_goals"),
    ("open_play_efficiency", "goals_open_play", "shots_open_play"),
    ("xg_per_corner_shot", "xg_from_corners", "shots_from_corners"),
    ("xg_per_fk_shot", "xg_from_fk", "shots_from_fk"),
    ("xg_per_open_play_shot", "xg_open_play", "shots_open_play"),
)


def set_piece_ratios(df: DataFrame) -> DataFrame:
    """df with those ratios whose columns it has, null where nothing is divided by, and the set-piece goals conceded."""
    out = {n: safe_divide(F.col(a), F.col(b)) for n, a, b in SET_PIECES if a in df.columns and b in df.columns}
    if "goals_conceded_from_setpieces" in df.columns:
        out["sp_defensive_vulnerability"] = F.col("goals_conceded_from_setpieces").cast("double")
    return df.withColumns(out)
