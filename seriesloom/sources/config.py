"""Experiment settings from a JSON document, checked as they are read."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession


class BadConfig(ValueError):
    """A setting is missing, unknown or out of range."""


@dataclass(frozen=True)
class Stakes:
    fraction: float = 0.25
    cap: float = 0.03
    least_edge: float = 0.02

    def __post_init__(self) -> None:
        if not 0 < self.fraction <= 1:
            raise BadConfig("fraction must be above 0 and at most 1")
        if not 0 < self.cap <= 1:
            raise BadConfig("cap must be above 0 and at most 1")


@dataclass(frozen=True)
class Experiment:
    name: str
    groups: tuple[str, ...]
    seasons: tuple[str, ...]
    models: tuple[str, ...] = ("logistic",)
    train_seasons: int = 3
    stakes: Stakes = field(default_factory=Stakes)

    def __post_init__(self) -> None:
        bad = [s for s in self.seasons if len(s) != 4 or not s.isdigit()]
        if bad:
            raise BadConfig(f"seasons have four digits, not {', '.join(bad)}")
        if not self.groups or not self.seasons or not self.models:
            raise BadConfig("groups, seasons and models must not be empty")
        if self.train_seasons < 1:
            raise BadConfig("train_seasons must be at least 1")


def _built(kind: type, told: dict):
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(told) - known):
        raise BadConfig(f"unknown settings: {', '.join(unknown)}")
    try:
        return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in told.items()})
    except TypeError as e:
        raise BadConfig(str(e)) from e


def read_experiment(spark: SparkSession, path: str) -> Experiment:
    """The settings of one document, wherever Spark can read it."""
    try:
        told = json.loads(spark.read.text(path, wholetext=True).first().value)
    except json.JSONDecodeError as e:
        raise BadConfig(str(e)) from e
    if "stakes" in told:
        told["stakes"] = _built(Stakes, told["stakes"])
    return _built(Experiment, told)
