"""Row functions: odds, stakes, labels, dates, text. All are column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def implied(odds: Column) -> Column:
    return F.when(odds > 0, 1 / odds)


def overround(*odds: Column) -> Column:
    return sum((implied(o) for o in odds[1:]), implied(odds[0])) - 1


def fair(i: int, *odds: Column) -> Column:
    """The i-th implied probability over the sum of those there are."""
    total = sum((F.coalesce(implied(o), F.lit(0.0)) for o in odds), F.lit(0.0))
    return F.when(total > 0, implied(odds[i]) / total)


def mean_of(*xs: Column) -> Column:
    """Mean of those that are not null; null if none is."""
    n = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)) / n)


def safe_divide(a: Column, b: Column, positive: bool = False) -> Column:
    """Null where b is 0 (or not above 0)."""
    return F.when(b > 0 if positive else b != 0, a / b)


def kelly(p: Column, odds: Column) -> Column:
    b = odds - 1
    return F.when(odds > 1, F.greatest((p * b - (1 - p)) / b, F.lit(0.0))).otherwise(0.0)


def shrunk_stake(p: Column, odds: Column, error: Column, bankroll: float, z: float = 1.0, fraction: float = 0.25, cap: float = 0.03, hook: Callable[[Column], Column] | None = None) -> Column:
    """Fractional Kelly stake on a probability less z calibration errors, capped. ``hook`` may change
    the Kelly fraction before that, but never raises it."""
    f = kelly(F.greatest(p - z * error, F.lit(0.01)), odds)
    f = F.least(f, hook(f)) if hook else f
    return F.least(fraction * f * bankroll, F.lit(cap * bankroll))


def edge_ramp(edge: Column, odds: Column, most: float) -> Column:
    """Factor on a stake: falls beyond the highest believable edge, halves at extreme odds."""
    over = F.greatest(edge - most, F.lit(0.0)) / most
    return F.greatest(1 - 0.5 * over, F.lit(0.0)) * F.when((odds < 1.2) | (odds > 5), 0.5).otherwise(1.0)


def group_cap(x: Column, cap: float, *by: str) -> Column:
    """x scaled so that each group sums to the cap at most; rows with a null key stay."""
    total = F.sum(x).over(W.partitionBy(*by))
    known = F.lit(True)
    for k in by:
        known = known & F.col(k).isNotNull()
    return F.when(known & (total > cap), x * cap / total).otherwise(x)


def points(own: Column, other: Column) -> Column:
    return F.when(own > other, 3).when(own == other, 1).otherwise(0)


def three_way(own: Column, other: Column) -> Column:
    return F.when(own > other, "H").when(own == other, "D").when(own < other, "A")


def both_positive(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), (a > 0) & (b > 0))


def normalised(p: Column) -> Column:
    """An array clipped to [1e-6, 1] and divided by its sum."""
    c = F.transform(p, lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1.0)))
    return F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda a, v: a + v))


def season_code(day: Column, first_month: int = 8) -> Column:
    """Two-digit years of the season a day is in, such as 2324."""
    y = F.year(day) - F.when(F.month(day) < first_month, 1).otherwise(0)
    two = lambda v: F.lpad(F.pmod(v, F.lit(100)).cast("string"), 2, "0")
    return F.concat(two(y), two(y + 1))


def round_phase(n: Column) -> Column:
    return F.when(n <= 12, 0).when(n <= 26, 1).otherwise(2)


def holidays(day: Column) -> Column:
    return ((F.month(day) == 12) & (F.dayofmonth(day) >= 20)) | ((F.month(day) == 1) & (F.dayofmonth(day) <= 3))


def any_date(text: Column, *formats: str) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def number(text: Column) -> Column:
    """A number, perhaps with a percent sign; null if it is none."""
    return F.regexp_replace(F.trim(text), "%$", "").try_cast("double")


def formation(text: Column) -> Column:
    """struct(defence, midfield, attack) of a text such as 4-2-3-1 Attacking."""
    n = F.transform(F.regexp_extract_all(F.split(F.trim(text), " ")[0], F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    mid = F.aggregate(F.slice(n, F.lit(2), F.greatest(F.size(n) - 2, F.lit(0))), F.lit(0), lambda a, v: a + v)
    return F.when(F.size(n) >= 3, F.struct(F.get(n, F.lit(0)).alias("defence"), mid.alias("midfield"), F.element_at(n, -1).alias("attack")))


ACCENTS, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ", "aaaaaaeeeeiiiiooooouuuuncyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def without_accents(name: Column) -> Column:
    name = F.translate(name, ACCENTS, PLAIN)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return name


def resolved_name(name: Column, explicit: dict[str, str], known: Sequence[str]) -> Column:
    """The explicit map's name, as is or without accents; else the known name that equals it, as is or
    without the accents of both; else the name itself."""
    name = F.trim(name)
    plain = without_accents(name)
    table = F.create_map(*[F.lit(x) for kv in explicit.items() for x in kv])
    names = F.array(*[F.lit(k) for k in known])
    same = F.get(F.filter(names, lambda k: without_accents(k) == plain), F.lit(0))
    return F.coalesce(F.try_element_at(table, name), F.try_element_at(table, plain), F.when(F.array_contains(names, name), name), same, name)


def canonical_name(name: Column, known: dict[str, str]) -> Column:
    """A small fixed alias map, tried as is and without accents; else the name itself."""
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    plain = F.replace(F.translate(F.trim(name), "áàâäéèêëíóôöúüñç", "aaaaeeeeiooouunc"), F.lit("ß"), F.lit("ss"))
    return F.coalesce(F.try_element_at(table, F.trim(name)), F.try_element_at(table, plain), F.trim(name))


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that is found."""
    c = None
    for pattern, label in rules:
        hit = text.rlike(pattern)
        c = F.when(hit, label) if c is None else c.when(hit, label)
    return c.otherwise(default)
