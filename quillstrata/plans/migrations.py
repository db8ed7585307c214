"""Schema migrations of a store: an ordered list, a ledger, and plans up and down.

A catalogue is made in code, or read from a folder of SQL scripts `<id>.up.sql` and
`<id>.down.sql`, whose first line is `-- uuid7: <uuid>` and whose id is the short form of
that uuid.  Scripts run over the tables as temporary views; a view that a script makes or
replaces is the table after it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.functions.ids import short_id_of
from quillstrata.functions.text import normalize_sql, sql_checksum

VIEW = re.compile(r"CREATE\s+OR\s+REPLACE\s+TEMP(?:ORARY)?\s+VIEW\s+(\w+)\s+AS\s+(.*)", re.I | re.S)
LEDGER = "position int, id string, checksum string"


class MigrationError(ValueError):
    """Migrations out of order, without a pair, or changed after they were applied."""


@dataclass(frozen=True)
class Migration:
    id: str
    checksum: str
    up: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
    down: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None


def run_script(spark: SparkSession, script: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after the statements of a script (one that ends a line with `;` ends there)."""
    before = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        for statement in re.split(r";[ \t]*(?:\n|\Z)", script):
            bare = re.sub(r"^(?:\s|--[^\n]*(?:\n|\Z))+", "", statement)
            made = VIEW.match(bare)
            if made:  # by its plan, so that a table may be made of itself
                spark.sql(made[2]).createOrReplaceTempView(made[1])
            elif bare:
                spark.sql(bare)
        now = {t.name for t in spark.catalog.listTables() if t.isTemporary} - before | set(tables)
        return {name: spark.table(name) for name in sorted(now) if spark.catalog.tableExists(name)}
    finally:
        for t in {t.name for t in spark.catalog.listTables() if t.isTemporary} - before | set(tables):
            spark.catalog.dropTempView(t)


def read_scripts(spark: SparkSession, folder: str) -> list[Migration]:
    """The catalogue of a folder, in order.  A script without its header, with another id
    than its uuid's, or whose pair names another uuid, is an error."""
    found = spark.read.text(folder, wholetext=True, pathGlobFilter="*.sql")
    rows = found.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), "value", normalize_sql(F.col("value")).alias("sql"), sql_checksum(F.col("value")).alias("sum")).collect()  # as many as there are scripts
    scripts: dict[str, dict[str, tuple]] = {"up": {}, "down": {}}
    for r in rows:
        named = re.fullmatch(r"(\w+)\.(up|down)\.sql", r["file"])
        if named is None:
            raise MigrationError(f"{r['file']} is neither .up.sql nor .down.sql")
        header = re.match(r"--\s*uuid7:\s*([0-9a-fA-F-]{36})\s*$", r["value"].split("\n", 1)[0].strip())
        if header is None:
            raise MigrationError(f"{r['file']} does not begin with `-- uuid7: <uuid>`")
        own = uuid.UUID(header[1])
        if short_id_of(own) != named[1]:
            raise MigrationError(f"{r['file']} is of {short_id_of(own)}")
        scripts[named[2]][named[1]] = (own, r["sql"], r["sum"])
    if not scripts["up"]:
        raise MigrationError("no .up.sql scripts")
    if lone := set(scripts["down"]) - set(scripts["up"]):
        raise MigrationError(f"no way up for {', '.join(sorted(lone))}")
    out = []
    for i, (own, sql, total) in sorted(scripts["up"].items()):
        down = scripts["down"].get(i)
        if down and down[0] != own:
            raise MigrationError(f"the scripts of {i} name different uuids")
        out.append(Migration(i, total, partial(run_script, spark, sql), partial(run_script, spark, down[1]) if down else None))
    return out


def validate(catalogue: list[Migration]) -> None:
    ids = [m.id for m in catalogue]
    if ids != sorted(set(ids)):
        raise MigrationError("ids must rise")
    if any(m.down is None for m in catalogue[1:]):
        raise MigrationError("only the first may have no way down")


def pending(catalogue: DataFrame, ledger: DataFrame) -> DataFrame:
    """Migrations (id, checksum) not applied yet, in order."""
    return catalogue.join(ledger.select("id"), "id", "left_anti").orderBy("id")


def changed(catalogue: DataFrame, ledger: DataFrame) -> DataFrame:
    """Applied migrations whose checksum is another one now."""
    return ledger.select("id", F.col("checksum").alias("applied")).join(catalogue, "id").where(F.col("applied") != F.col("checksum"))


def ledger_checksum(ledger: DataFrame) -> DataFrame:
    """One row: sha256 of id:checksum in order, joined by |."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "id", "checksum"))), lambda x: F.concat_ws(":", x["id"], x["checksum"]))
    return ledger.agg(F.sha2(F.array_join(parts, "|").cast("binary"), 256).alias("checksum"))


def upgrade(catalogue: list[Migration], applied: list[str], tables: dict[str, DataFrame], steps: int | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    validate(catalogue)
    done = list(applied)
    for m in [m for m in catalogue if m.id not in applied][:steps]:
        tables = m.up(tables)
        done.append(m.id)
    return tables, done


def downgrade(catalogue: list[Migration], applied: list[str], tables: dict[str, DataFrame], steps: int = 1) -> tuple[dict[str, DataFrame], list[str]]:
    """Takes back the last steps; the first migration stays."""
    validate(catalogue)
    done, by = list(applied), {m.id: m for m in catalogue}
    for _ in range(steps):
        if len(done) <= 1:
            break
        tables = by[done[-1]].down(tables)
        done.pop()
    return tables, done
