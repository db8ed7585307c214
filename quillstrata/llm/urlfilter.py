"""URL filters by a sorted digest array.

Rules are strings host + path (a path starts with `/`, a host holds none, so a rule
splits in one way).  Their 64-bit xxhash digests form one sorted array in a file that
every worker memory-maps; beside it lie the rules themselves.  A url gives one
candidate for each suffix of its host with as many labels as some rule's host and each
rule-path length, and the digests of all candidates of a batch are found by one
vectorised binary search.  Every digest found is confirmed against the stored string, so
collisions cannot decide.  Among the rules that fit, the longest wins.

The file is written in a temporary folder of the driver, which SparkContext.addFile
serves to the executors, those that join later too.  Rules come as a list, or as a
DataFrame (verdict, rule) of any size; above `FILE_BYTES` the rules are joined on the
digest instead, with the same candidates.

Defined results
    null url or no `://`   host and path empty; no rule; the default verdict
    no rule fits           rule null, the default verdict
    equal rules            the verdict of the one first in order (block before allow)
    rule without `/`       a host with the empty path: fits all paths
    null rule              no rule
    empty rules or table   the default for all; no rows
    repeated rows          each gets its row
    extra columns          ignored
"""

from __future__ import annotations

import json
import os
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.llm.common import LOWER, UPPER

Rule = tuple[str, str]  # verdict, host + path

#: Size of the index up to which it goes to every executor as a file.
FILE_BYTES = 512 << 20
DEFAULT = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


def pack(rules: list[Rule]) -> bytes:
    """Header (count, length of the JSON part), digests in order, offsets of the rules'
    strings, strings, JSON of verdicts and path lengths."""
    best: dict[str, str] = {}
    for verdict, rule in rules:
        if "block" in (verdict, best.get(rule)):
            best[rule] = "block"
        else:
            best[rule] = verdict
    ordered = sorted(best, key=lambda r: (digest(r), r))
    strings = [r.encode() for r in ordered]
    hosts = [r.partition("/")[0] for r in ordered]
    lengths = sorted({len(r) - len(h) for r, h in zip(ordered, hosts, strict=True)})
    labels = sorted({h.count(".") + 1 for h in hosts})
    meta = json.dumps({"verdicts": [best[r] for r in ordered], "lengths": lengths, "labels": labels}).encode()
    offsets = np.cumsum([0, *map(len, strings)], dtype=np.int64)
    digests = np.array([digest(r) for r in ordered], np.uint64)
    return struct.pack("<qq", len(ordered), len(meta)) + digests.tobytes() + offsets.tobytes() + b"".join(strings) + meta


class Index:
    """A memory-mapped file that pack() made."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, tail = struct.unpack("<qq", raw[:16].tobytes())
        self.digests = raw[16 : 16 + 8 * n].view(np.uint64)
        self.offsets = raw[16 + 8 * n : 24 + 16 * n].view(np.int64)
        self.strings = raw[24 + 16 * n : len(raw) - tail]
        meta = json.loads(raw[len(raw) - tail :].tobytes())
        self.verdicts, self.lengths, self.labels = meta["verdicts"], meta["lengths"], meta["labels"]

    def rule(self, i: int) -> bytes:
        return self.strings[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def find(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """The winning rule and its verdict of each url."""
        texts, owner = [], []
        for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for text in candidates(host, path, self.lengths, self.labels):
                texts.append(text)
                owner.append(k)
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        if not texts or not len(self.digests):
            return rules, verdicts
        probe = np.fromiter(map(digest, texts), np.uint64, len(texts))
        first, last = np.searchsorted(self.digests, probe, "left"), np.searchsorted(self.digests, probe, "right")
        for j in np.flatnonzero(last > first):
            text = texts[j].encode()
            for i in range(first[j], last[j]):  # more than one only where digests collide
                if self.rule(i) == text and len(texts[j]) > len(rules[owner[j]] or ""):
                    rules[owner[j]], verdicts[owner[j]] = texts[j], self.verdicts[i]
        return rules, verdicts


def candidates(host: str, path: str, lengths: list[int], labels: list[int]) -> Iterator[str]:
    """Every host suffix of a rule's number of labels with every path beginning of a
    rule's length."""
    heads = [path[:n] for n in lengths if n <= len(path)]
    parts = host.split(".")
    for n in labels:
        if n <= len(parts):
            suffix = ".".join(parts[len(parts) - n :])
            for head in heads:
                yield suffix + head


def _file(spark: SparkSession, packed: bytes) -> str:
    """Hands the index to all executors; returns the name to ask SparkFiles for."""
    name = f"urls-{uuid.uuid4().hex}.idx"
    path = os.path.join(tempfile.mkdtemp(prefix="quillstrata-urls-"), name)
    with open(path, "wb") as f:
        f.write(packed)
    spark.sparkContext.addFile(path)
    return name


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every url."""
    spark = pages.sparkSession
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("__url"))
    host, path = split_url(F.col("__url"))
    parts = slim.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    if isinstance(rules, DataFrame):
        rules = rules.where(F.col("rule").isNotNull()).select("verdict", "rule")
        if (rules.agg(F.sum(F.octet_length("rule") + 40)).first()[0] or 0) > FILE_BYTES:
            return judge_by_join(parts, rules, default)
        rules = [tuple(r) for r in rules.collect()]  # at most FILE_BYTES
    rules = [r for r in rules if r[1] is not None]
    packed = pack(rules)
    if len(packed) > FILE_BYTES:
        return judge_by_join(parts, spark.createDataFrame(rules, "verdict string, rule string"), default)
    name = _file(spark, packed)
    kind = parts.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(SparkFiles.get(name))
        for b in batches:
            found, verdicts = index.find(b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array([v or default for v in verdicts], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def judge_by_join(parts: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The same verdicts for rule lists of any size: candidates meet rules in a join on
    the digest, strings confirm, and the longest rule wins by a grouped maximum."""
    best = rules.groupBy("rule").agg(F.max(F.col("verdict") == "block").alias("b"))
    best = best.select("rule", F.when(F.col("b"), "block").otherwise("allow").alias("verdict"), F.xxhash64("rule").alias("digest"))
    rows = parts.withColumn("row", F.struct(F.monotonically_increasing_id(), "page_id", "host", "path"))
    # what a url can be asked about: one row for each number of labels and path length of a rule
    host = F.substring_index("rule", "/", 1)
    counts = F.size(F.split(host, r"\."))
    labels = sorted(r[0] for r in best.select(counts.alias("n")).distinct().collect())  # at most the labels of the longest host
    lengths = sorted(r[0] for r in best.select((F.length("rule") - F.length(host)).alias("n")).distinct().collect())  # at most the longest path
    if not labels:
        return parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    suffixes = F.transform(F.filter(F.lit(labels), lambda n: n <= F.size(F.split("host", r"\."))), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    heads = F.transform(F.filter(F.lit(lengths), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    texts = rows.select("row", F.explode_outer(suffixes).alias("s"), heads.alias("h")).select("row", F.explode_outer("h").alias("h"), "s")
    texts = texts.select("row", F.concat("s", "h").alias("text")).withColumn("digest", F.xxhash64("text"))
    hits = texts.join(best, (texts["digest"] == best["digest"]) & (F.col("text") == F.col("rule")), "left")
    top = hits.groupBy("row").agg(F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("w"))
    return top.select("row.page_id", "row.host", "row.path", F.col("w.rule").alias("rule"), F.coalesce("w.verdict", F.lit(default)).alias("verdict"))
