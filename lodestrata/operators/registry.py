"""The operators by name. An operator is a function of a DataFrame and keyword parameters that returns a DataFrame."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


class NotSupported(RuntimeError):
    """The operator needs a library or format that isn't here; the message says which."""


@dataclass(frozen=True)
class Operator:
    name: str
    family: str
    run: Callable[..., DataFrame]

    @property
    def params(self) -> dict[str, object]:
        """Parameters and their defaults."""
        return {k: p.default for k, p in list(inspect.signature(self.run).parameters.items())[1:]}


OPERATORS: dict[str, Operator] = {}


def operator(name: str, family: str) -> Callable:
    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        OPERATORS[name] = Operator(name, family, f)
        return f

    return wrap


def apply(name: str, df: DataFrame, **params) -> DataFrame:
    """Run the operator; parameters it doesn't have are an error."""
    if name not in OPERATORS:
        raise KeyError(f"no operator {name}")
    op = OPERATORS[name]
    if extra := set(params) - set(op.params):
        raise TypeError(f"{name} has no parameter {', '.join(sorted(extra))}")
    return op.run(df, **params)
