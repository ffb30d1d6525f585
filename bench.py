"""Runs the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from treeline import catalog
from treeline.plans.compiler import query
from treeline.sources import code, tables
from treeline.workspace import StoredWorkspace

HEADLINE = ("q_grep_lines", "q_grep_rollup", "q_contains", "q_child", "q_descendant", "q_depth_range", "q_attr_regex", "q_union", "q_any", "q_all", "q_in_call", "q_cross", "q_hops", "q_name_freq", "q_search", "q_walk", "q_reachable", "q_parents", "q_code_symbols", "q_code_arity", "q_code_signature", "q_code_in_call", "q_code_hot")


SHAPES = {"tag": "func", "path_scoped": "file[path$=m01.go] func", "attr_exact": "func[name=Step7]", "attr_regex": "func[name~='Step1|Step2|Step3']", "star": "*", "grep": "file::grep('-E Step1[0-9]')", "edge_anchored": "#'m01.go#Step5'::in.call", "edge_crossed": "#'m01.go#Step5'::in.call > *", "generated_body": "func::body"}


def shapes(spark: SparkSession) -> dict[str, float]:
    """Seconds of nine shapes of selector on fifty small source files, in a workspace that is written once: the median of three runs each."""
    files = [(f"m{i:02d}.go", "package m\n" + "".join(f"\ntype Part{i}x{j} struct {{\n\tA int\n}}\n\nfunc Step{5 * i + j}(n int) int {{\n\treturn Step{(5 * i + j + 1) % 250}(n)\n}}\n\nvar Last{i}x{j} = Step{5 * i + j}\n" for j in range(5))) for i in range(50)]
    frame = spark.createDataFrame(files, "path string, content string")
    ws = StoredWorkspace(lambda: code.workspace(frame))
    ws.nodes.count(), ws.edges.count()
    took = {}
    for name, selector in SHAPES.items():
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            query(ws, selector).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(sorted(runs)[1], 3)
    return took


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # the session's own start isn't a query's
    if os.environ.get("BENCH_SHAPES"):
        print(json.dumps(shapes(spark)))
        spark.stop()
        return
    build, took = {}, {}
    # The workspaces that the queries share are built and written once, told apart from the queries.
    for workspace in (tables.documents, tables.trade, tables.conversations, tables.events, catalog.code_tree):
        start = time.perf_counter()
        ws = catalog.kept(workspace, spark, sf)
        ws.nodes, ws.edges, ws.groups
        build[workspace.__name__] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline selector queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "build": build, "build_total": round(sum(build.values()), 3), "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
