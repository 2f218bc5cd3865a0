"""Operators by name, and the order in which the statistics they need are produced."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Operator:
    """A DataFrame-to-DataFrame step: the columns it adds, the columns it needs, the grain of its rows."""

    name: str
    apply: Callable[..., DataFrame]
    produces: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()
    level: str = "sequence"


@dataclass
class Registry:
    operators: dict[str, Operator] = field(default_factory=dict)

    def add(self, operator: Operator) -> Operator:
        if operator.name in self.operators:
            raise ValueError(f"operator {operator.name} is registered twice")
        self.operators[operator.name] = operator
        return operator

    def get(self, name: str) -> Operator:
        try:
            return self.operators[name]
        except KeyError:
            raise KeyError(f"no operator {name}; known: {', '.join(sorted(self.operators))}") from None

    def producers(self) -> dict[str, Operator]:
        """Of operators that produce the same column, the later one counts."""
        return {column: op for op in self.operators.values() for column in op.produces}

    def plan(self, wanted: Iterable[str], given: Iterable[str] = ()) -> list[Operator]:
        """The operators that produce `wanted` from the `given` columns, each once, after what it needs."""
        made, producers, order, open_now = set(given), self.producers(), [], []

        def visit(column: str) -> None:
            if column in made:
                return
            if column in open_now:
                raise ValueError(f"cyclic dependency: {' -> '.join([*open_now, column])}")
            if column not in producers:
                raise KeyError(f"nothing produces {column}")
            open_now.append(column)
            op = producers[column]
            for need in op.requires:
                visit(need)
            open_now.pop()
            if op not in order:
                order.append(op)
            made.update(op.produces)

        for column in wanted:
            visit(column)
        return order

    def run(self, df: DataFrame, wanted: Iterable[str]) -> DataFrame:
        """`df` with the wanted columns; existing columns are never overwritten."""
        for op in self.plan(wanted, df.columns):
            before = df.columns
            df = op.apply(df)
            if lost := set(before) - set(df.columns):
                raise ValueError(f"{op.name} dropped {sorted(lost)}")
        return df
