"""User-defined measurements: an explicit registry, and both ways of running them.

A plugin is either a builder of column expressions over points and scales, which Catalyst plans like the library's own,
or a NumPy function of one face, which runs in one shared Arrow UDF. A NumPy plugin that fails gives NULLs for that row.
"""

from __future__ import annotations

import importlib.util
import logging
from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morpholake.operators.features import FEATURES

SCALES = ("bizyg", "face_h", "midface_h", "mouth_w")
Points = Callable[[int, str], Column]


class Plugin(NamedTuple):
    group: str
    columns: tuple[str, ...]
    function: Callable[..., dict[str, Any]]
    native: bool
    hpo_terms: tuple[str, ...]


class Registry:
    """Plugins in order of registration. freeze() fixes the columns; after it nothing can be added."""

    def __init__(self, base: Sequence[str] = tuple(FEATURES), groups: Sequence[str] = ()):
        self.base, self.groups, self.frozen = frozenset(base), frozenset(groups), False
        self.plugins: dict[str, Plugin] = {}

    def register(self, *, group: str, columns: Sequence[str], native: bool = False, hpo_terms: Sequence[str] | None = None) -> Callable:
        """A decorator. native: function(point, scales) -> {column: Column}; else function(points array, scales dict) -> {column: number}."""
        if not isinstance(group, str) or not group:
            raise ValueError("group must be a non-empty string")
        if isinstance(columns, str) or not columns or not all(isinstance(c, str) and c for c in columns):
            raise ValueError("columns must be a non-empty sequence of names")

        def add(function: Callable) -> Callable:
            if self.frozen:
                raise RuntimeError("the registry is frozen")
            if group in self.plugins:
                raise ValueError(f"a plugin is registered for {group!r} already")
            if twice := sorted(set(columns) & set(self.columns())):
                raise ValueError(f"columns of another plugin: {twice}")
            if twice := sorted(set(columns) & self.base):
                raise ValueError(f"columns of the base measurements: {twice}")
            if group in self.groups:
                raise ValueError(f"{group!r} is a feature group already")
            if not self.groups:
                logging.getLogger(__name__).warning("no table of feature groups: names are not checked against it")
            self.plugins[group] = Plugin(group, tuple(columns), function, native, tuple(hpo_terms or ()))
            return function

        return add

    def get(self, group: str) -> Plugin | None:
        return self.plugins.get(group)

    def columns(self) -> list[str]:
        return [c for p in self.plugins.values() for c in p.columns]

    def freeze(self) -> list[str]:
        """The columns in order. Freezing again changes nothing."""
        self.frozen = True
        return self.columns()

    def clear(self) -> None:
        self.plugins, self.frozen = {}, False

    def table(self, spark) -> DataFrame:
        """(plugin, csv_column) rows."""
        return spark.createDataFrame([(p.group, c) for p in self.plugins.values() for c in p.columns], "plugin string, csv_column string")


def load_plugins(path: str) -> None:
    """Runs a Python file that registers plugins. It is arbitrary code: load only files that you trust."""
    spec = importlib.util.spec_from_file_location("user_plugins", path)
    if spec is None or spec.loader is None:
        raise ValueError(f"cannot load {path}")
    spec.loader.exec_module(importlib.util.module_from_spec(spec))


def with_plugins(df: DataFrame, registry: Registry) -> DataFrame:
    """Adds every plugin's columns to df, which has canon and the scales."""
    registry.freeze()
    point = lambda i, axis: F.col("canon")[i][axis]
    for p in (p for p in registry.plugins.values() if p.native):
        got = p.function(point, {s: F.col(s) for s in SCALES})
        df = df.withColumns({c: F.coalesce(got[c].cast("double"), F.lit(None)) if c in got else F.lit(None).cast("double") for c in p.columns})
    shipped = [(p.columns, p.function) for p in registry.plugins.values() if not p.native]
    if not shipped:
        return df
    names = [c for columns, _ in shipped for c in columns]

    @F.pandas_udf(", ".join(f"`{c}` double" for c in names))
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for xs, ys, *scales in parts:
            rows = []
            for n, (x, y) in enumerate(zip(xs, ys, strict=True)):
                row: dict[str, float | None] = dict.fromkeys(names)
                for columns, function in shipped:
                    try:
                        got = function(np.column_stack((x, y)), {s: v.iloc[n] for s, v in zip(SCALES, scales, strict=True)})
                        row |= {c: None if got.get(c) is None else float(got[c]) for c in columns}
                    except Exception:  # a plugin's fault is its own
                        logging.getLogger(__name__).exception("a plugin failed")
                rows.append(row)
            yield pd.DataFrame(rows, columns=names).astype("float64")

    axis = lambda a: F.transform("canon", lambda p: p[a])
    out = df.withColumn("_plugins", run(axis("x"), axis("y"), *SCALES))
    return out.withColumns({c: F.when(~F.isnan(F.col("_plugins")[c]), F.col("_plugins")[c]) for c in names}).drop("_plugins")
