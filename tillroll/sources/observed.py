"""Counts that are taken while a table is written, so that checking them later costs no pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

ROWS = "n_rows"


@dataclass(frozen=True)
class Figures:
    """Rows of a written table and NULLs of each of its columns."""

    rows: int
    nulls: dict[str, int]


def _counts(columns: list[str]) -> tuple[list, dict[str, str]]:
    places = {f"c{k}": column for k, column in enumerate(columns)}
    nulls = [F.count_if(F.col(f"`{column}`").isNull()).alias(place) for place, column in places.items()]
    return [F.count(F.lit(1)).alias(ROWS), *nulls], places


def _figures(seen: dict, places: dict[str, str]) -> Figures:
    return Figures(seen.get(ROWS) or 0, {column: seen.get(place) or 0 for place, column in places.items()})


def scanned(df: DataFrame) -> Figures:
    """The same figures by a pass over ``df``."""
    counts, places = _counts(df.columns)
    return _figures(df.agg(*counts).first().asDict(), places)


def counted(
    df: DataFrame, name: str, write: Callable[[DataFrame, str], DataFrame]
) -> tuple[DataFrame, Figures]:
    """What ``write`` returns for ``df``, and the figures of the rows it wrote.

    The counts ride on the tasks that write: they sit on top of the plan, in its last stage, whose
    finished tasks count once however often a task is tried or an earlier stage runs again.
    """
    watched = Observation(f"written {name}")
    counts, places = _counts(df.columns)
    written = write(df.observe(watched, *counts), name)
    return written, _figures(watched.get, places)
