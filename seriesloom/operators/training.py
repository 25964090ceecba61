"""Tables for training: which columns are features and what fills their gaps, fitted once and kept."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .selection import exact_quantiles


def _missing(c: str, kind: T.DataType) -> Column:
    x = F.col(f"`{c}`")
    return x.isNull() | F.isnan(x) if isinstance(kind, (T.DoubleType, T.FloatType)) else x.isNull()


class _Columns(Params):
    excluded = Param(Params._dummy(), "excluded", "numeric columns that are no features", TypeConverters.toListString)
    mostMissing = Param(Params._dummy(), "mostMissing", "share of missing values from above which a column is dropped", TypeConverters.toFloat)


class TrainingColumns(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Chooses the numeric columns that aren't excluded and of whose values at most ``mostMissing`` are missing, in the order of
    their names, and finds the exact median of each. Nulls and NaN are missing; a frame without rows gives no columns."""

    def __init__(self, excluded: Sequence[str] = (), mostMissing: float = 0.5):
        super().__init__()
        self._setDefault(excluded=[], mostMissing=0.5)
        self._set(excluded=list(excluded), mostMissing=float(mostMissing))

    def _fit(self, df: DataFrame) -> TrainingColumnsModel:
        without = set(self.getOrDefault(self.excluded))
        numeric = sorted((f.name, f.dataType) for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in without) if df.columns else []
        # one aggregation for all columns
        shares = df.agg(F.count("*").alias("n"), *[F.avg(_missing(c, k).cast("double")).alias(f"c{i}") for i, (c, k) in enumerate(numeric)]).first()
        kept = [c for i, (c, _) in enumerate(numeric) if shares["n"] and shares[f"c{i}"] <= self.getOrDefault(self.mostMissing)]
        medians = exact_quantiles(df, kept).first() if kept else []
        # a column without any value has none: then 0
        return TrainingColumnsModel(kept, [0.0 if m is None else float(m) for m in medians])


class TrainingColumnsModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fills the chosen columns' gaps, as doubles. A column that a frame lacks is all gaps; columns that weren't chosen
    stay as they are."""

    columns = Param(Params._dummy(), "columns", "feature columns", TypeConverters.toListString)
    medians = Param(Params._dummy(), "medians", "what fills their gaps", TypeConverters.toListFloat)

    def __init__(self, columns: Sequence[str] = (), medians: Sequence[float] = ()):
        super().__init__()
        self._set(columns=list(columns), medians=[float(m) for m in medians])

    @property
    def features(self) -> list[str]:
        return self.getOrDefault(self.columns)

    def _transform(self, df: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in df.schema}
        filled = {}
        for c, m in zip(self.features, self.getOrDefault(self.medians), strict=True):
            x = F.col(f"`{c}`").cast("double") if c in kinds else F.lit(None).cast("double")
            filled[c] = F.when(_missing(c, kinds[c]), F.lit(m)).otherwise(x) if c in kinds else F.lit(m)
        return df.withColumns(filled)


def labelled(df: DataFrame, target: str, classes: Mapping[str, int], where: Mapping[str, Sequence] | None = None, name: str = "target") -> DataFrame:
    """The rows of the wanted groups (``where``: column to values, pushed down to the scan) whose target is one of
    ``classes``, with its number."""
    for c, values in (where or {}).items():
        df = df.where(F.col(c).isin(list(values)))
    number = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    return df.where(F.col(target).isin(list(classes))).withColumn(name, F.try_element_at(number, F.col(target)).cast("int"))


def with_targets(df: DataFrame, home: str = "home_goals", away: str = "away_goals", half: tuple[str, str] | None = None) -> DataFrame:
    """df with twelve targets of a match, and two of its first half if told its columns; all null where a score is."""
    h, a = F.col(home), F.col(away)
    both = h + a
    flag = lambda test: F.when(both.isNotNull(), test.cast("int"))
    out = {
        "result_1x2": _three_way(h, a), "over_1_5": flag(both > 1.5), "over_2_5": flag(both > 2.5), "over_3_5": flag(both > 3.5), "btts": flag((h > 0) & (a > 0)),
        "home_goals_over_1_5": F.when(h.isNotNull(), (h > 1.5).cast("int")), "away_goals_over_0_5": F.when(a.isNotNull(), (a > 0.5).cast("int")),
        "home_or_draw": flag(h >= a), "home_or_away": flag(h != a), "draw_or_away": flag(h <= a), "margin": h - a, "total_goals": both,
    }
    if half:
        x, y = (F.col(c) for c in half)
        out |= {"ht_result_1x2": _three_way(x, y), "ht_over_0_5": F.when((x + y).isNotNull(), (x + y > 0.5).cast("int"))}
    return df.withColumns(out)


def _three_way(h: Column, a: Column) -> Column:
    return F.when(h > a, "H").when(h == a, "D").when(h < a, "A")


def training_table(df: DataFrame, target: str, classes: Mapping[str, int], where: Mapping[str, Sequence] | None = None, excluded: Sequence[str] = (), order: Sequence[str] = ()) -> tuple[DataFrame, TrainingColumnsModel]:
    """Labelled rows of the wanted groups with clean features, in order, and the model that made them: fit it on the rows that
    may be learned from, and apply it to others."""
    rows = labelled(df, target, classes, where)
    model = TrainingColumns([*excluded, "target"]).fit(rows)
    out = model.transform(rows)
    return (out.orderBy(*order) if order else out), model
