"""Files of a git repository's branches, on the driver: lists of paths are small, contents are read by the tasks' rows."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treeline.sources.code import MOST_BYTES


def _git(root: str, *args: str, check: bool = True) -> bytes:
    out = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    if check and out.returncode:
        raise ValueError(out.stderr.decode(errors="replace").strip() or f"git {args[0]} failed")
    return out.stdout


def paths(root: str, branch: str) -> list[str]:
    """The files of a branch."""
    return [p for p in _git(root, "ls-tree", "-r", "-z", "--name-only", branch).decode(errors="surrogateescape").split("\0") if p]


def blobs(spark: SparkSession, root: str, branch: str, partitions: int | None = None) -> DataFrame:
    """(path, content) of a branch's text files of at most a MiB; ``root`` is a folder that every executor sees."""
    names = paths(root, branch)
    frame = spark.createDataFrame([(p,) for p in names], "path string")
    frame = frame.repartition(partitions or max(1, min(len(names), spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts = [], []
            for path in batch.column(0).to_pylist():
                raw = _git(root, "show", f"{branch}:{path}")
                if len(raw) <= MOST_BYTES and b"\0" not in raw[:8192]:
                    kept.append(path)
                    texts.append(raw.decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(texts, pa.string())], ["path", "content"])

    return frame.mapInArrow(run, "path string, content string")


def branch_chain(root: str, branch: str, most: int = 32) -> list[str]:
    """A branch and the ones it tracks, one after the other, until one tracks none or was met before."""
    chain = [branch]
    while len(chain) < most:
        up = _git(root, "rev-parse", "--abbrev-ref", f"{chain[-1]}@{{upstream}}", check=False).decode().strip()
        if not up or up in chain:
            break
        chain.append(up)
    return chain


def unmerged(root: str) -> list[str]:
    """Paths that a merge has left in conflict."""
    return [p for p in _git(root, "diff", "--name-only", "--diff-filter=U", "-z").decode().split("\0") if p]


def ignore_lines(root: str) -> list[str]:
    """The patterns of a repository's top ignore file; none without one."""
    try:
        with open(f"{root}/.gitignore", encoding="utf-8", errors="replace") as f:
            return f.read().splitlines()
    except FileNotFoundError:
        return []
