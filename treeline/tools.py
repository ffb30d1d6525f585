"""The operators by name, with their parameters checked: what a service over the engine would offer."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from treeline.operators import edits, patches, read, references, results, text, walks
from treeline.plans import compiler, legacy
from treeline.workspace import Workspace

#: Each takes a workspace first; what else it takes is in its signature.
TOOLS: dict[str, Callable] = {
    "query": compiler.query,
    "page": results.page,
    "walk": walks.walk,
    "explain": results.explain,
    "cost": results.cost,
    "hint": results.hint,
    "notes": walks.notes,
    "legacy_query": legacy.query,
    "search": text.search,
    "structure": text.structure,
    "outline": text.file_outline,
    "read": read.read,
    "symbols": read.symbols_of,
    "references_at": read.references_at,
    "mentions": read.mentions,
    "workspace_symbols": references.workspace_symbols,
    "occurrences": references.occurrences,
    "rename": edits.rename_plan,
    "signature": patches.signature_plan,
    "comment_mentions": patches.comment_mentions,
}


def parameters(name: str) -> dict[str, bool]:
    """The parameters of a tool, and whether each must be given."""
    if name not in TOOLS:
        raise ValueError(f"no tool {name!r}; there are {', '.join(sorted(TOOLS))}")
    own = list(inspect.signature(TOOLS[name]).parameters.values())[1:]
    return {p.name: p.default is inspect.Parameter.empty for p in own}


def call(ws: Workspace, name: str, **given):
    """A tool's result. Unknown parameters and missing ones are told all at once."""
    known = parameters(name)
    unknown, missing = sorted(set(given) - set(known)), sorted(k for k, must in known.items() if must and k not in given)
    if unknown or missing:
        told = [f"unknown: {', '.join(unknown)}"] * bool(unknown) + [f"missing: {', '.join(missing)}"] * bool(missing)
        raise ValueError(f"{name} takes {', '.join(known) or 'nothing'}; {'; '.join(told)}")
    return TOOLS[name](ws, **given)
