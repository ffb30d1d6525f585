"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "minhash",
    "vptree",
    "urlfilter",
    "spm",
    "decontaminate",
    "linededup",
    "htmltext",
    "tokencounts",
    "toxicity",
    "quality",
    "variants",
    "packing",
    "collocations",
)


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"treeline.llm.{name}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
