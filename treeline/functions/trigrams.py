"""Which files can't match a pattern, told by the trigrams they lack.

A file's trigrams of bytes, A-Z lower-cased, are bits of a bitmap as large as it
needs (at least eight bits a trigram, up to 2^20). Whatever a pattern's every
match must hold is a tree of literals; a file stays if it has the bits of their
trigrams. That only ever lets too many files through: what can't be said of a
pattern (inverted matches, short literals, syntax in doubt) keeps all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.plans.selector import Grep

_MOST_BITS = 1 << 20
_SLICE = 1 << 22
#: Letters that letters beyond ASCII match when case doesn't count.
_FOLDED = frozenset(b"iks")


def _hash(a: np.ndarray) -> np.ndarray:
    code = a[:-2].astype(np.uint64) << np.uint64(16) | a[1:-1].astype(np.uint64) << np.uint64(8) | a[2:].astype(np.uint64)
    return code * np.uint64(2654435761) % np.uint64(2**32) >> np.uint64(8)


def bitmap(text: str) -> list[int]:
    """The text's trigrams as 64-bit words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    seen = np.empty(0, np.uint64)
    for at in range(0, max(0, len(raw) - 2), _SLICE):
        seen = np.union1d(seen, _hash(raw[at : at + _SLICE + 2]))
    size = 1024
    while size < min(8 * len(seen), _MOST_BITS):
        size *= 2
    at = seen & np.uint64(size - 1)
    words = np.zeros(size // 64, np.uint64)
    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return words.view(np.int64).tolist()


def index(texts: DataFrame) -> DataFrame:
    """(file_id, bits) of files (file_id, text); one without text has no bits set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bitmap(t or "") for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], ["file_id", "bits"])

    return texts.select(F.col("file_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file_id long, bits array<long>")


def _tree(parsed) -> list | None:
    """What each match of a parsed pattern holds: ["and" | "or", ...] of texts and such lists; null for nothing certain."""
    parts, run = [], []

    def close() -> None:
        if len(run) > 2:
            parts.append("".join(run))
        run.clear()

    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            run.append(chr(arg))
            continue
        close()
        inner = None
        if name == "SUBPATTERN" and not (arg[1] or arg[2]):
            inner = _tree(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            inner = _tree(arg[2])
        elif name == "BRANCH":
            each = [_tree(x) for x in arg[1]]
            inner = ["or", *each] if all(each) else None
        if inner:
            parts.append(inner)
    close()
    return ["and", *parts] if parts else None


def required(g: Grep) -> list | None:
    """The tree of literals of a search; null if it names none."""
    if g.invert:
        return None
    if not g.regex:
        return ["and", g.pattern] if len(g.pattern) > 2 else None
    # Classes within classes mean something else to the parser at hand.
    if re.search(r"\[[^\]]*\[", g.pattern):
        return None
    try:
        parsed = re._parser.parse(g.pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    if parsed.state.flags & ~re.UNICODE:  # flags within the pattern
        return None
    return _tree(parsed)


def _has(bits: Column, code: int) -> Column:
    size = F.size(bits) * 64 - 1
    word = F.get(bits, F.shiftright(F.lit(code).bitwiseAND(size), 6))
    return F.shiftright(word, code & 63).bitwiseAND(F.lit(1).cast("long")) == 1


def may_hold(bits: Column, tree: list | str, ignore_case: bool) -> Column:
    """Whether a file with these bits may hold what the tree asks for."""
    if isinstance(tree, str):
        raw = np.frombuffer(tree.encode("utf-8", "surrogatepass").lower(), np.uint8)
        out = F.lit(True)
        for i, code in enumerate(_hash(raw).tolist() if len(raw) > 2 else []):
            if not ignore_case or not any(b > 127 or b in _FOLDED for b in raw[i : i + 3].tolist()):
                out = out & _has(bits, code)
        return out
    op, *parts = tree
    each = [may_hold(bits, p, ignore_case) for p in parts]
    out = each[0]
    for x in each[1:]:
        out = out & x if op == "and" else out | x
    return out


def fitting(grams: DataFrame, g: Grep) -> DataFrame | None:
    """(file_id): files of an index that may match a search; null if all may."""
    tree = required(g)
    return None if tree is None else grams.where(may_hold(F.col("bits"), tree, g.ignore_case)).select("file_id")
