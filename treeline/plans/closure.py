"""What a set of nodes reaches, as a set: no pairs of start and end.

Nodes are visited once, a round a step; long chains would take a round a link.
After some rounds, chains (nodes with one way out) are followed by doubling: a
table leads two links ahead, the next four, and so on, and each is taken once
over all that is reached, so a chain of n links takes a logarithm of n rounds.
Tables have a row for each node of a chain, log n times. They aren't made where
the rounds before suffice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.workspace import written

#: Rounds of single steps before chains are doubled, and between two such.
PATIENCE = 4


def ends(nodes: DataFrame, links: DataFrame, groups: DataFrame | None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id): the far ends of links (host, far, group) of nodes (keys, id), those of a group once for all nodes that have it."""
    out = nodes.join(links, F.col("id") == F.col("host")).select(*keys, "far", "group")
    near = out.where("far is not null").select(*keys, F.col("far").alias("id"))
    if groups is None:
        return near.distinct()
    many = out.where(F.col("group").isNotNull()).select(*keys, "group").distinct().join(groups.select("group", "far"), "group")
    return near.union(many.select(*keys, F.col("far").alias("id"))).distinct()


def chains(links: DataFrame) -> list[DataFrame]:
    """(host, far) one, two, four ... links ahead, of nodes with one way out; ends with the last table that leads anywhere new."""
    one = links.groupBy("host").agg(F.min("far").alias("far"), F.max("far").alias("most"), F.max("group").alias("group"))
    tables = [written(one.where("far = most and group is null and far <> host").select("host", "far"))]
    # A chain that runs into a circle never ends: no longer one than there are nodes.
    for _ in range(max(1, tables[0].count()).bit_length()):
        last = tables[-1]
        beyond = last.select(F.col("host").alias("far"), F.col("far").alias("beyond"))
        ahead = written(last.join(beyond, "far").select("host", F.col("beyond").alias("far")))
        if not ahead.limit(1).count():
            break
        tables.append(ahead)
    return tables


def closure(start: DataFrame, links: DataFrame, groups: DataFrame | None, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id): start (id) and all that its links lead to; ``above`` adds to nodes what is reached with them."""
    widened = (lambda df: df) if above is None else above
    seen = frontier = written(widened(start.select("id").distinct()).distinct())
    parts, rounds, ahead = [seen], 0, None
    while True:
        rounds += 1
        new = widened(ends(frontier, links, groups)).distinct()
        if rounds % PATIENCE == 0:
            ahead = chains(links) if ahead is None else ahead
            for table in ahead:
                near = new.join(table, F.col("id") == F.col("host")).select(F.col("far").alias("id"))
                new = written(new.union(near).distinct())
            new = widened(new).distinct()
        frontier = written(new.join(seen, "id", "left_anti"))
        if not frontier.limit(1).count():
            return seen
        parts.append(frontier)
        if len(parts) == 8:  # else each round reads all parts before it
            parts = [written(seen.union(frontier))]
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.union(p)
