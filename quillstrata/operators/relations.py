"""References between tables, and what a deletion does to the rows that refer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RestrictedError(ValueError):
    """Rows that may not lose what they refer to still refer to it."""


@dataclass(frozen=True)
class Reference:
    """child.column refers to parent.key; action: cascade, set_null or restrict."""

    child: str
    column: str
    parent: str
    key: str
    action: str = "cascade"

    def __post_init__(self) -> None:
        if self.action not in ("cascade", "set_null", "restrict"):
            raise ValueError(f"unknown action {self.action}")


def delete(tables: dict[str, DataFrame], references: list[Reference], table: str, key: str, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of `table` whose key is in `gone`, and with what
    follows: rows that refer to them go too, or lose the reference, or (restrict) stop the
    deletion.  Every step is a semi or anti join on the reference, so nothing is
    collected; references may not run in a circle through cascades."""
    out = dict(tables)

    def keys_of(rows: DataFrame, column: str) -> DataFrame:
        return rows.select(F.col(column).alias("__key")).where(F.col("__key").isNotNull()).distinct()

    def follow(name: str, rows: DataFrame, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError(f"references run in a circle: {' > '.join((*path, name))}")
        for r in (r for r in references if r.parent == name):
            keys, child = keys_of(rows, r.key), out[r.child]
            met = F.col(r.column) == F.col("__key")
            if r.action == "set_null":
                marked = child.join(keys, met, "left").withColumn(r.column, F.when(F.col("__key").isNull(), F.col(r.column)))
                out[r.child] = marked.select(child.columns)
                continue
            hit = child.join(keys, met, "left_semi")
            if r.action == "restrict":
                if not hit.isEmpty():
                    raise RestrictedError(f"{r.child}.{r.column} still refers to {name}")
                continue
            follow(r.child, hit, (*path, name))
            out[r.child] = out[r.child].join(keys, met, "left_anti")

    first = keys_of(gone, key)
    follow(table, tables[table].join(first, F.col(key) == F.col("__key"), "left_semi"), ())
    out[table] = out[table].join(first, F.col(key) == F.col("__key"), "left_anti")
    return out
