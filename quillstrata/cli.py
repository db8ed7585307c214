"""The command line over a workspace.  Every command prints JSON lines and ends with 0, or
prints what is wrong and ends with 1."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from quillstrata.operators.batches import BatchError
from quillstrata.operators.embedding import HashProvider, HttpProvider, Provider, ProviderError
from quillstrata.operators.parsers.base import Limits
from quillstrata.operators.vectors import VectorError
from quillstrata.plans.workspace import Workspace, WorkspaceError
from quillstrata.sources.storage import LockedError

FAILURES = (BatchError, LockedError, ProviderError, PySparkException, VectorError, WorkspaceError)


def provider(args: argparse.Namespace) -> Provider:
    if args.provider == "hash":
        return HashProvider(args.dim)
    return HttpProvider(args.url, args.key_name, args.timeout)


def rows(df: DataFrame) -> Iterable[dict[str, Any]]:
    """A small report, row by row."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def _sources(w: Workspace, a: argparse.Namespace) -> Iterable[dict[str, Any]]:
    return ({"name": n, **s} for n, s in sorted(w.sources().items()))


def _done(call: Callable[..., object], *names: str) -> Callable:
    """A command that calls a method of the workspace with some of its arguments."""

    def run(w: Workspace, a: argparse.Namespace) -> Iterable[dict[str, Any]]:
        got = call(w, *(getattr(a, n) for n in names))
        return [got if isinstance(got, dict) else {"result": got if got is not None else "ok"}]

    return run


def _cap(text: str) -> int | str:
    return text if text == "auto" else int(text)


def _parse(w: Workspace, a: argparse.Namespace) -> Iterable[dict[str, Any]]:
    batch = w.parse(a.name, a.scope, Limits(a.max_tokens), a.fail_fast)
    return rows(w.table("run_log").where(f"batch_id = '{batch}'"))


def _sync(w: Workspace, a: argparse.Namespace) -> Iterable[dict[str, Any]]:
    return [w.sync(a.name, provider(a), a.recompute, a.limit, a.dry_run, a.unsymbolized)]


def _search(w: Workspace, a: argparse.Namespace) -> Iterable[dict[str, Any]]:
    return rows(w.search(a.name, provider(a), [a.text], a.k))


def _run(w: Workspace, a: argparse.Namespace) -> Iterable[dict[str, Any]]:
    with open(a.script, encoding="utf-8") as f:
        return [r for df in w.run_sql(f.read()) for r in rows(df)]


def build() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillstrata", description=__doc__)
    top.add_argument("--workspace", default=".", help="folder of the workspace")
    groups = top.add_subparsers(dest="group", required=True)

    def group(name: str) -> Callable[..., argparse.ArgumentParser]:
        inner = groups.add_parser(name).add_subparsers(dest="command", required=True)

        def command(named: str, run: Callable, *positional: str) -> argparse.ArgumentParser:
            p = inner.add_parser(named)
            for x in positional:
                p.add_argument(x)
            p.set_defaults(run=run)
            return p

        return command

    def provided(p: argparse.ArgumentParser) -> argparse.ArgumentParser:
        p.add_argument("--provider", choices=("hash", "http"), default="hash")
        p.add_argument("--url", default="")
        p.add_argument("--key-name", default="EMBEDDINGS_API_KEY")
        p.add_argument("--timeout", type=float, default=30.0)
        p.add_argument("--dim", type=int, default=16)
        return p

    source = group("source")
    source("list", _sources)
    source("add", _done(Workspace.add_source, "name", "path"), "name", "path")
    source("target", _done(Workspace.retarget, "name", "path"), "name", "path")
    source("rename", _done(Workspace.rename, "name", "new"), "name", "new")
    source("remove", _done(Workspace.remove_source, "name"), "name")
    source("enable", _done(Workspace.enable, "name"), "name")
    source("disable", _done(lambda w, n: w.enable(n, False), "name"), "name")

    parser = group("parser")
    p = parser("parse", _parse, "name")
    p.add_argument("scope", nargs="*")
    p.add_argument("--max-tokens", type=_cap, default=2000)
    p.add_argument("--fail-fast", action="store_true")
    parser("info", lambda w, a: rows(w.table("run_log")))
    parser("batches", lambda w, a: rows(w.batch_summary(a.limit))).add_argument("--limit", type=int, default=10)
    parser("remove", _done(Workspace.remove_batch, "batch", "force"), "batch").add_argument("--force", action="store_true")

    vdb = group("vdb")
    p = vdb("create", _done(Workspace.create_vdb, "name", "selector", "provider", "model", "dim", "metric"), "name", "selector", "model")
    p.add_argument("--metric", default="cosine")
    provided(p)
    p = provided(vdb("sync", _sync, "name"))
    p.add_argument("--limit", type=int)
    for flag in ("--recompute", "--dry-run", "--unsymbolized"):
        p.add_argument(flag, action="store_true")
    vdb("info", lambda w, a: rows(w.table("vdbs").join(w.table("index_meta").withColumnRenamed("vdb_id", "id").drop("provider", "dim", "metric"), "id", "left")))
    vdb("reset", _done(Workspace.reset_vdb, "name", "drop"), "name").add_argument("--drop", action="store_true")
    p = provided(vdb("search", _search, "name", "text"))
    p.add_argument("-k", type=int, default=5)

    db = group("db")
    p = db("info", lambda w, a: rows(w.store.info(a.limit, a.seconds)))
    p.add_argument("--limit", type=int, default=500_000)
    p.add_argument("--seconds", type=float, default=1.0)
    db("vacuum", _done(lambda w, t, n: w.store.vacuum(t, n), "table", "files"), "table").add_argument("--files", type=int, default=1)
    db("run", _run, "script")
    groups.add_parser("checkhealth").set_defaults(run=lambda w, a: rows(w.checkhealth()))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillstrata").getOrCreate()
    try:
        for line in args.run(Workspace(spark, args.workspace), args):
            print(json.dumps(line, default=str, ensure_ascii=False))
    except FAILURES as e:
        lines = str(e).strip().splitlines()  # of an error in a worker the last line says what it was
        print(f"{type(e).__name__}: {next((x for x in reversed(lines) if 'Error:' in x), lines[0] if lines else '')}", file=sys.stderr)
        return 1
    return 0
