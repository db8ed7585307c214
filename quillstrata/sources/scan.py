"""File scans: recursive binary reads, ignore rules, scopes, and a plan of what to parse."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.functions import text as T
from quillstrata.operators.parsers import resolve

#: Files of the workspace itself.
WORKSPACE_FILES = ["db.sqlite3*", "manifest.json*"]


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), size_bytes, modified_at, content of every file whose name does
    not begin with a dot or an underscore."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?", "")
    base = re.sub(r"^[a-z]+:(//[^/]*)?", "", root).rstrip("/")
    return raw.select(F.substring(full, F.lit(len(base) + 2), F.length(full)).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")


def ignore_regex(pattern: str, folder: str = "") -> str | None:
    """An ignore-file line as a regular expression over paths below the root; folder is
    where its file lies.  None for blanks and comments; a leading ! is left to the caller."""
    line = pattern.rstrip()
    if not line or line.startswith("#"):
        return None
    line = line.removeprefix("!")
    only_folders, line = line.endswith("/"), line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in line[i + 2 :]:
            j = line.index("]", i + 2)
            body = line[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", j + 1
        else:
            out, i = out + re.escape(c), i + 1
    prefix = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
    return f"^{prefix}{'' if anchored else '(?:.*/)?'}{out}{'/.*' if only_folders else '(?:/.*)?'}$"


def ignored(path: Column, patterns: list[tuple[str, str]]) -> Column:
    """Is the path ignored by (folder, pattern) lines?  Within a file the last line that
    fits decides, so ! takes back; across files any that ignores is enough."""
    by: dict[str, Column] = {}
    for folder, p in patterns:
        r = ignore_regex(p, folder)
        if r is None:
            continue
        old = by.get(folder, F.lit(False))
        by[folder] = F.when(path.rlike(r), F.lit(not p.startswith("!"))).otherwise(old)
    out = F.lit(False)
    for c in by.values():
        out = out | c
    return out


def read_ignore_files(spark: SparkSession, root: str, name: str = ".gitignore") -> list[tuple[str, str]]:
    """(folder, line) of the ignore files below a root.  Spark's readers pass over names
    that begin with a dot, so these small files are read through the file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    base = fs.makeQualified(top).toUri().getPath().rstrip("/")
    found, files = [], fs.listFiles(top, True)
    while files.hasNext():
        path = files.next().getPath()
        if path.getName() == name:
            stream = fs.open(path)
            try:
                text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
            finally:
                stream.close()
            folder = path.getParent().toUri().getPath()[len(base) :].strip("/")
            found += [(folder, line) for line in text.splitlines()]
    return sorted(found, key=lambda x: x[0])


def visible(found: DataFrame, repo: list[tuple[str, str]], workspace: list[str] = [], mode: str = "combined") -> DataFrame:  # noqa: B006
    """Files that neither ignore files (mode repo or combined) nor workspace patterns
    (workspace or combined) leave out."""
    if mode not in ("repo", "workspace", "combined"):
        raise ValueError(f"unknown mode {mode}")
    lines = repo if mode != "workspace" else []
    own = [("", p) for p in (*WORKSPACE_FILES, *workspace)] if mode != "repo" else []
    return found.where(~(ignored(F.col("path"), lines) | ignored(F.col("path"), own)))


def scoped(found: DataFrame, scope: list[str]) -> DataFrame:
    """Files that are, or lie below, one of the scope's paths; all without a scope."""
    if not scope:
        return found
    keep = F.lit(False)
    for s in scope:
        s = s.strip("/")
        keep = keep | (F.col("path") == s) | F.col("path").startswith(s + "/")
    return found.where(keep)


def plan(found: DataFrame, version: str = "1.0.0", enabled: set[str] | None = None) -> DataFrame:
    """Each file with its handler, why, and its versioned hash."""
    # only a first line that begins with #! matters, however long it is
    line = F.substring_index(F.when(F.substring(F.col("content"), 1, 2) == F.lit(b"#!"), F.col("content").cast("string")), "\n", 1)
    handler, reason = resolve(F.col("path"), F.coalesce(F.try_validate_utf8(line), F.lit("")), enabled=enabled)
    return found.withColumns({"handler": handler, "reason": reason, "file_sha": T.versioned_hash(version, F.col("content"), F.col("path"), binary=True)})


def unchanged(planned: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose hash is known, which need not be parsed again, only touched."""
    return planned.join(known.select(F.col("repo_path").alias("path"), "file_sha"), ["path", "file_sha"], "left_semi")
