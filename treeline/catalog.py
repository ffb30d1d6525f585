"""Registered queries of the selector engine over the tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import trigrams
from treeline.operators import conflicts, edits, incremental, patches, read, references, results, text, walks
from treeline.plans.compiler import query, tally
from treeline.sources import bindings, code, tables
from treeline.streaming import snapshots, state
from treeline.workspace import StoredWorkspace, nodes_of, scratch_root

_LINES = f"lines AS (SELECT node, CAST(line AS INTEGER) AS line, text, lang FROM (SELECT source || '/' || doc_id AS node, lang, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts FROM documents)))"
_PLACES = "people AS (SELECT c_custkey, c_name, r_name, n_name, r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_ITEMS = "items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS l_at FROM lineitem)"
_SUPPLIERS = "suppliers AS (SELECT s_suppkey, r_name || '/' || n_name || '/' || s_name AS node FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_NEXT = "pairs AS (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)"
_TURNS = "turns AS (SELECT conv_id, turn, role, 'conv/' || conv_id || '#' || role || '.' || turn AS node FROM conversations)"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None, run: Callable[[SparkSession, str], DataFrame]) -> None:
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


_KEPT: dict[tuple, tuple[tuple, StoredWorkspace]] = {}


def _stamp(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of a folder's tables: another one means that they have changed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def kept(workspace: Callable, spark: SparkSession, sf_dir: str, indexed: bool = False) -> StoredWorkspace:
    """The workspace over a folder's tables, built once in a session and anew when they change; indexed: with the files' trigrams."""
    key, stamp = (spark.sparkContext.applicationId, workspace.__name__, sf_dir, indexed), _stamp(spark, sf_dir)
    if key not in _KEPT or _KEPT[key][0] != stamp:
        _KEPT[key] = stamp, StoredWorkspace(lambda: workspace(spark, sf_dir), trigrams.index if indexed else None)
    return _KEPT[key][1]


def _select(name: str, workspace: Callable, selector: str, columns: list[str], sql: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(kept(workspace, spark, sf_dir), selector)
        return (shape(out) if shape else out).select(*columns)

    _add(name, sql, run)


_select("q_grep_lines", tables.documents, "file.en::grep('-i -w the')", ["node", "line", "text"], f"WITH {_LINES} SELECT node, line, text FROM lines WHERE lang = 'en' AND regexp_matches(text, '(?i)\\bthe\\b')")
_select("q_grep_context", tables.documents, "file::grep('-A1 -B2 License')", ["node", "line", "text", "before", "after"], f"WITH {_LINES}, framed AS (SELECT *, list(text) OVER (PARTITION BY node ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b, list(text) OVER (PARTITION BY node ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS a FROM lines) SELECT node, line, text, coalesce(array_to_string(b, chr(10)), '') AS before, coalesce(array_to_string(a, chr(10)), '') AS after FROM framed WHERE contains(text, 'License')", lambda d: d.withColumn("before", F.array_join("before", "\n")).withColumn("after", F.array_join("after", "\n")))
_select("q_grep_unicode", tables.documents, "file::grep('-i -E ÉT|Ü[a-z]+N')", ["node", "line"], f"WITH {_LINES} SELECT node, line FROM lines WHERE regexp_matches(text, '(?i)ÉT|Ü[a-z]+N')")
_select("q_grep_rollup", tables.documents, "file::grep('the')", ["node", "n"], f"WITH {_LINES} SELECT node, count(*) AS n FROM lines WHERE contains(text, 'the') GROUP BY node", text.rollup)
_select("q_grep_first", tables.documents, "file::grep('-v the'):first", ["node", "line", "text"], f"WITH {_LINES} SELECT node, line, text FROM lines WHERE NOT contains(text, 'the') QUALIFY row_number() OVER (PARTITION BY node ORDER BY line) = 1")
_select("q_contains", tables.documents, "file:contains('-i license')", ["node"], f"WITH {_LINES} SELECT DISTINCT node FROM lines WHERE contains(lower(text), 'license')")
_select("q_not_contains", tables.documents, "file:not(:contains('the'))", ["node"], f"WITH {_LINES} SELECT DISTINCT source || '/' || doc_id AS node FROM documents WHERE source || '/' || doc_id NOT IN (SELECT node FROM lines WHERE contains(text, 'the'))")
_select("q_child", tables.trade, "dir#NATION_7 > file", ["node"], f"WITH {_PLACES}, {_SUPPLIERS} SELECT path AS node FROM people WHERE n_name = 'NATION_7' UNION ALL SELECT node FROM suppliers WHERE node LIKE '%/NATION=_7/%' ESCAPE '='")
_select("q_descendant", tables.trade, "dir#ASIA struct", ["node"], f"WITH {_PLACES} SELECT path || '#o' || o_orderkey AS node FROM orders JOIN people ON o_custkey = c_custkey WHERE r_name = 'ASIA'")
_select("q_depth_range", tables.trade, "dir#EUROPE > *{1,2}", ["node", "type"], f"WITH {_PLACES}, {_SUPPLIERS} SELECT path AS node, 'file' AS type FROM people WHERE r_name = 'EUROPE' UNION ALL SELECT node, 'file' FROM suppliers WHERE node LIKE 'EUROPE/%' UNION ALL SELECT r_name || '/' || n_name, 'dir' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
_select("q_union", tables.documents, "file.de, file.fr, dir", ["node", "type"], "SELECT source || '/' || doc_id AS node, 'file' AS type FROM documents WHERE lang IN ('de', 'fr') UNION ALL SELECT DISTINCT source, 'dir' FROM documents")
_select("q_attr_bool", tables.documents, "file[(name^=1 | name$=7) & path*=src1]", ["node"], "SELECT source || '/' || doc_id AS node FROM documents WHERE (starts_with(CAST(doc_id AS VARCHAR), '1') OR ends_with(CAST(doc_id AS VARCHAR), '7')) AND contains(source || '/' || doc_id, 'src1')")
_select("q_attr_regex", tables.documents, "file[name~='^[1-4]+$']", ["node"], "SELECT source || '/' || doc_id AS node FROM documents WHERE regexp_matches(CAST(doc_id AS VARCHAR), '^[1-4]+$')")
_select("q_path_scoped", tables.trade, "dir#AFRICA dir file[name$=1]", ["node"], f"WITH {_PLACES}, {_SUPPLIERS} SELECT path AS node FROM people WHERE r_name = 'AFRICA' AND ends_with(c_name, '1') UNION ALL SELECT node FROM suppliers WHERE starts_with(node, 'AFRICA/') AND ends_with(node, '1')")
_select("q_any", tables.trade, "file:any(> struct field#l7)", ["node"], f"WITH {_PLACES} SELECT DISTINCT path AS node FROM people JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 7")
_select("q_empty", tables.conversations, "file:empty(method#system)", ["node"], "SELECT DISTINCT 'conv/' || conv_id AS node FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
_select("q_all", tables.conversations, "file:all(> method[name^=user | name^=assistant])", ["node"], "SELECT 'conv/' || conv_id AS node FROM conversations GROUP BY conv_id HAVING bool_and(starts_with(role, 'user') OR starts_with(role, 'assistant'))")
_select("q_first", tables.conversations, "file > method#user:first", ["node"], f"WITH {_TURNS} SELECT node FROM turns WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
_select("q_last", tables.conversations, "file > method:last", ["node"], f"WITH {_TURNS} SELECT node FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
_select("q_out_call", tables.conversations, "method#assistant::out.call", ["host", "type", "far"], f"WITH {_TURNS}, told AS (SELECT role, node, lag(node) OVER (PARTITION BY conv_id ORDER BY turn) AS far FROM turns) SELECT node AS host, '::out.call' AS type, far FROM told WHERE role = 'assistant' AND far IS NOT NULL", lambda d: d.withColumn("far", F.array_join("far", ",")))
_add("q_in_call", f"WITH {_SUPPLIERS} SELECT count(*) AS n, node AS host FROM lineitem JOIN suppliers ON l_suppkey = s_suppkey GROUP BY node", lambda s, d: tally(kept(tables.trade, s, d), "file[name^=Supplier]::in.call").select("n", "host"))
_select("q_cross", tables.trade, "field#l1::out.call > file", ["node"], f"WITH {_SUPPLIERS} SELECT DISTINCT node FROM lineitem JOIN suppliers ON l_suppkey = s_suppkey WHERE l_linenumber = 1")
_select("q_hops", tables.events, "field#purchase::out.call{2,3} > *", ["node"], f"WITH {_NEXT}, two AS (SELECT a.src, b.dst FROM pairs a JOIN pairs b ON a.dst = b.src), three AS (SELECT t.src, c.dst FROM two t JOIN pairs c ON t.dst = c.src), far AS (SELECT DISTINCT dst FROM (SELECT * FROM two UNION ALL SELECT * FROM three) JOIN events e ON e.event_id = src WHERE e.event_type = 'purchase' AND dst IS NOT NULL) SELECT 'user/' || user_id || '#' || event_id AS node FROM far JOIN events ON event_id = dst")
_select("q_reachable", tables.conversations, "method#system::in.call{1,} > *", ["node"], f"WITH {_TURNS} SELECT t.node FROM turns t WHERE EXISTS (SELECT 1 FROM turns s WHERE s.conv_id = t.conv_id AND s.role = 'system' AND s.turn < t.turn)")
_select("q_dead_code", tables.conversations, "method:where(::in:empty)", ["node"], f"WITH {_TURNS} SELECT node FROM turns QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)")
_select("q_parents", tables.documents, "file.fr::out.import > file:parents(dir)", ["node"], "WITH RECURSIVE copies AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS before, source, lang FROM documents), start AS (SELECT before AS id FROM copies WHERE lang = 'fr' AND before IS NOT NULL), up AS (SELECT id FROM start UNION SELECT c.doc_id FROM up JOIN copies c ON c.before = up.id) SELECT DISTINCT d.source AS node FROM up JOIN documents d ON d.doc_id = up.id")
_select("q_copies_in", tables.documents, "file:any(::in.import)", ["node"], "SELECT source || '/' || doc_id AS node FROM documents QUALIFY lead(doc_id) OVER (PARTITION BY text ORDER BY doc_id) IS NOT NULL")
_select("q_is_chain", tables.documents, "file:is(dir#src0 > file)", ["node"], "SELECT source || '/' || doc_id AS node FROM documents WHERE source = 'src0'")
_select("q_group", tables.trade, "(dir dir){1}", ["node"], "SELECT r_name || '/' || n_name AS node FROM nation JOIN region ON n_regionkey = r_regionkey")
_select("q_group_repeated", tables.trade, "(*){3,}", ["node", "type"], f"WITH {_PLACES}, {_SUPPLIERS}, {_ITEMS}, placed AS (SELECT o_orderkey, path || '#o' || o_orderkey AS node FROM orders JOIN people ON o_custkey = c_custkey) SELECT path AS node, 'file' AS type FROM people UNION ALL SELECT node, 'file' FROM suppliers UNION ALL SELECT node, 'struct' FROM placed UNION ALL SELECT node || '.l' || l_linenumber || '.' || l_at, 'field' FROM items JOIN placed ON l_orderkey = o_orderkey")

_add("q_class_counts", "SELECT 'project' AS type, 1 AS n UNION ALL SELECT 'dir', count(*) + 1 + (SELECT count(*) FROM region) FROM nation UNION ALL SELECT 'file', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'struct', count(*) FROM orders UNION ALL SELECT 'field', count(*) FROM lineitem UNION ALL SELECT 'type', count(*) FROM part", lambda s, d: text.class_counts(kept(tables.trade, s, d)))
_NAMES = f"WITH {_LINES}, names AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM lines)"
_add("q_name_freq", f"{_NAMES} SELECT name, count(*) AS n FROM names GROUP BY name", lambda s, d: text.name_freq(kept(tables.documents, s, d)))
_add("q_cardinality", f"{_NAMES} SELECT count(DISTINCT name) AS n FROM names", lambda s, d: text.cardinality(kept(tables.documents, s, d)))
_add("q_search", f"WITH {_LINES}, ok AS (SELECT * FROM lines WHERE node NOT IN (SELECT node FROM lines WHERE strlen(text) > 5000)), hits AS (SELECT node, line, unnest(regexp_extract_all(text, 'License|password')) AS hit FROM ok) SELECT node AS path, line, hit, count(*) AS n FROM hits GROUP BY ALL", lambda s, d: text.search(kept(tables.documents, s, d), "License|password").groupBy("path", "line", "hit").agg(F.count(F.lit(1)).alias("n")))
_add("q_search_indexed", f"WITH {_LINES}, ok AS (SELECT * FROM lines WHERE node NOT IN (SELECT node FROM lines WHERE strlen(text) > 5000)), hits AS (SELECT node, line, unnest(regexp_extract_all(text, 'License|password')) AS hit FROM ok) SELECT node AS path, line, hit, count(*) AS n FROM hits GROUP BY ALL", lambda s, d: text.search(kept(tables.documents, s, d, indexed=True), "License|password").groupBy("path", "line", "hit").agg(F.count(F.lit(1)).alias("n")))
_add("q_histogram", f"WITH {_PLACES} SELECT path, 'struct' AS type, count(*) AS n FROM people JOIN orders ON o_custkey = c_custkey GROUP BY path UNION ALL SELECT path, 'field', count(*) FROM people JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY path UNION ALL SELECT 'parts', 'type', count(*) FROM part", lambda s, d: text.histogram(kept(tables.trade, s, d)))
_add("q_tree_sizes", f"WITH {_PLACES}, {_SUPPLIERS}, n AS (SELECT path AS node, 1 + count(DISTINCT o_orderkey) + count(l_orderkey) AS n FROM people LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY path UNION ALL SELECT node, 1 FROM suppliers), nations AS (SELECT r_name, n_name, 1 + coalesce(sum(n), 0) AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN n ON starts_with(node, r_name || '/' || n_name || '/') GROUP BY ALL), regions AS (SELECT region.r_name, 1 + coalesce(sum(n), 0) AS n FROM region LEFT JOIN nations USING (r_name) GROUP BY ALL) SELECT node, 'file' AS type, CAST(n AS BIGINT) AS n FROM n UNION ALL SELECT r_name || '/' || n_name, 'dir', CAST(n AS BIGINT) FROM nations UNION ALL SELECT r_name, 'dir', CAST(n AS BIGINT) FROM regions UNION ALL SELECT 'parts', 'dir', count(*) + 1 FROM part UNION ALL SELECT 'trade', 'project', CAST((SELECT sum(n) FROM regions) + (SELECT count(*) FROM part) + 2 AS BIGINT)", lambda s, d: text.tree_sizes(kept(tables.trade, s, d)))
_add("q_debounce", "WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS cut FROM events), r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM e) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, run", lambda s, d: incremental.debounce(tables.table(s, d, "events"), "user_id", "ts", 3_600_000))
_add("q_latest_state", "SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY user_id", lambda s, d: incremental.latest(tables.table(s, d, "events").select("user_id", "ts", "event_type"), "user_id", ["ts"]))
_add("q_lookup_dedup", "SELECT conv_id, CAST(length(text) AS INTEGER) AS size, role, max(turn) AS turn FROM conversations GROUP BY ALL", lambda s, d: incremental.lookup(tables.table(s, d, "conversations").select(F.col("conv_id").alias("path"), F.length("text").alias("line"), F.col("role").alias("col"), F.col("turn").alias("conf"), F.col("role").alias("name"))).select(F.col("path").alias("conv_id"), F.col("line").alias("size"), F.col("col").alias("role"), F.col("conf").alias("turn")))
_add("q_replace_keys", "SELECT user_id, event_type, value FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, event_type, value FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')", lambda s, d: incremental.replace_keys(*(lambda e: (e, e.where("event_type = 'purchase'")))(tables.table(s, d, "events").select("user_id", "event_type", "value")), "user_id"))
_add("q_fold", "WITH log AS (SELECT event_id AS seq, user_id, event_type FROM events) SELECT CAST(user_id AS VARCHAR) AS \"table\", event_type AS \"column\", max(seq) AS seq FROM log GROUP BY user_id, event_type HAVING arg_max(seq, seq) % 3 <> 0", lambda s, d: incremental.fold(_ddl(tables.table(s, d, "events"))))

_add("q_page", f"WITH {_TURNS} SELECT node FROM turns WHERE role = 'user' ORDER BY conv_id, turn LIMIT 20 OFFSET 40", lambda s, d: results.page(kept(tables.conversations, s, d), "method#user", 20, 40).rows.select("node"))
_add("q_languages", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang", lambda s, d: references.languages(kept(tables.documents, s, d)))
_add("q_symbol_search", f"{_NAMES.replace('SELECT unnest', 'SELECT node, line, unnest')} SELECT name, node AS path, line, count(*) AS n FROM names WHERE contains(lower(name), 'licen') GROUP BY ALL", lambda s, d: references.workspace_symbols(kept(tables.documents, s, d), "licen").groupBy("name", "path", "line").agg(F.count(F.lit(1)).alias("n")))
_add("q_ambiguous", f"WITH {_PLACES} SELECT 'l' || l_linenumber AS leaf, count(DISTINCT r_name || '/' || n_name) AS n_dirs FROM people JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(DISTINCT r_name || '/' || n_name) > 1", lambda s, d: references.ambiguous(kept(tables.trade, s, d)))
_add("q_explain", "SELECT 1 AS alternative, 1 AS step, 'node' AS element, count(*) AS rows FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 1, 2, 'node', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", lambda s, d: results.explain(kept(tables.trade, s, d), "dir#ASIA > dir"))
_add("q_structure", f"WITH {_SUPPLIERS} SELECT node, 'file' AS type FROM suppliers UNION SELECT DISTINCT unnest([split_part(node, '/', 1), split_part(node, '/', 1) || '/' || split_part(node, '/', 2)]), 'dir' FROM suppliers", lambda s, d: text.structure(kept(tables.trade, s, d), pattern="^Supplier#", limit=None).select("node", "type"))
_add("q_structure_all", f"WITH {_PLACES}, {_SUPPLIERS}, {_ITEMS}, placed AS (SELECT o_orderkey, path || '#o' || o_orderkey AS node FROM orders JOIN people ON o_custkey = c_custkey) SELECT r_name AS node, 'dir' AS type, CAST(1 AS INTEGER) AS depth FROM region UNION ALL SELECT 'parts', 'dir', 1 UNION ALL SELECT r_name || '/' || n_name, 'dir', 2 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'parts#p' || p_partkey, 'type', 2 FROM part UNION ALL SELECT path, 'file', 3 FROM people UNION ALL SELECT node, 'file', 3 FROM suppliers UNION ALL SELECT node, 'struct', 4 FROM placed UNION ALL SELECT node || '.l' || l_linenumber || '.' || l_at, 'field', 5 FROM items JOIN placed ON l_orderkey = o_orderkey", lambda s, d: text.structure(kept(tables.trade, s, d), limit=None))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): three source files for every document, named by its id, and one with a merge conflict."""
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("i"), "lang")
    go = "package stock\n\n// Item%s is about %s.\n// It is kept.\ntype Item%s struct {\n\tNext *Item%s `json:\"next\" db:\"n%s\"`\n}\n\n// Get%s finds it.\nfunc Get%s(key string, item Item%s) (Item%s, error) { // always\n\tif key == \"\" {\n\t\treturn item, nil\n\t}\n\treturn Item%s{}, nil\n}\n\nfunc use%s() { Get%s(\"k\", nil) }\n"
    java = "package box;\n\n@Stored(\"b%s\")\npublic class Box%s {\n  @Override\n  public void go(int a) { go(a, 1); }\n  Box%s go(int a, int b) { return null; }\n}\n"
    merged = "head %s\n<<<<<<< ours\nmine %s\n||||||| base\nold %s\n=======\ntheirs %s\nmore %s\n>>>>>>> branch\ntail\n"
    filled = lambda text, lang_at=None: F.format_string(text, *["lang" if n == lang_at else "i" for n in range(text.count("%s"))])
    docs = docs.withColumn("lang", F.coalesce("lang", F.lit("none")))
    rows = [("go", filled(go, 1)), ("java", filled(java)), ("txt", filled(merged))]
    each = docs.select("i", F.explode(F.array(*[F.struct(F.lit(x).alias("ext"), t.alias("content")) for x, t in rows])).alias("x"))
    return each.select(F.concat(F.lit("src/"), "x.ext", F.lit("/f"), "i", F.lit("."), "x.ext").alias("path"), "x.content")


def code_tree(spark: SparkSession, sf_dir: str):
    return code.workspace(code_files(spark, sf_dir))


_IDS = "ids AS (SELECT CAST(doc_id AS VARCHAR) AS i, coalesce(lang, 'none') AS lang FROM documents)"
_GO, _JAVA, _TXT = (f"'src/{x}/f' || i || '.{x}'" for x in ("go", "java", "txt"))
_select("q_code_symbols", code_tree, "dir#go > file > *", ["node", "type", "start", "end"], f"WITH {_IDS} SELECT {_GO} || '#' || unnest(['stock', 'Item' || i, 'Get' || i, 'use' || i]) AS node, unnest(['module', 'struct', 'func', 'func']) AS type, CAST(unnest([1, 5, 10, 17]) AS INTEGER) AS start, CAST(unnest([1, 7, 15, 17]) AS INTEGER) AS \"end\" FROM ids")
_select("q_code_arity", code_tree, "method:arity(2)", ["node"], f"WITH {_IDS} SELECT {_JAVA} || '#Box' || i || '.go[2]' AS node FROM ids")
_select("q_code_arguments", code_tree, "method > argument", ["node"], f"WITH {_IDS} SELECT {_JAVA} || '#Box' || i || unnest(['.go[1].a', '.go[2].a', '.go[2].b']) AS node FROM ids")
_select("q_code_returns", code_tree, "func > return, method > return", ["node"], f"WITH {_IDS} SELECT {_GO} || '#Get' || i || '.' || unnest(['Item' || i, 'error']) AS node FROM ids UNION ALL SELECT {_JAVA} || '#Box' || i || '.go[2].Box' || i FROM ids")
_select("q_code_annotations", code_tree, "annotation", ["node"], f"WITH {_IDS} SELECT {_GO} || '#Item' || i || '.Next.' || unnest(['json', 'db']) AS node FROM ids UNION ALL SELECT {_JAVA} || '#Box' || i || unnest(['.Stored', '.go[1].Override']) FROM ids")
_select("q_code_annotated", code_tree, "class:annotated('Stored'), method:annotated('@Override')", ["node"], f"WITH {_IDS} SELECT {_JAVA} || '#Box' || i || unnest(['', '.go[1]', '.go[2]']) AS node FROM ids")
_select("q_code_comment", code_tree, "struct::comment, func::comment", ["node", "line", "text"], f"WITH {_IDS} SELECT {_GO} || '#Item' || i AS node, CAST(3 AS INTEGER) AS line, '// Item' || i || ' is about ' || lang || '.' || chr(10) || '// It is kept.' AS text FROM ids UNION ALL SELECT {_GO} || '#Get' || i, 9, '// Get' || i || ' finds it.' FROM ids")
_select("q_code_signature", code_tree, "func::signature", ["node", "text"], f"WITH {_IDS} SELECT {_GO} || '#Get' || i AS node, 'func Get' || i || '(key string, item Item' || i || ') (Item' || i || ', error) {{ // always' AS text FROM ids UNION ALL SELECT {_GO} || '#use' || i, 'func use' || i || '() {{ Get' || i || '(\"k\", nil) }}' FROM ids")
_select("q_code_body", code_tree, "func[name^=Get]::body", ["node", "line", "text"], f"WITH {_IDS} SELECT {_GO} || '#Get' || i AS node, CAST(11 AS INTEGER) AS line, chr(9) || 'if key == \"\" {{' || chr(10) || chr(9) || chr(9) || 'return item, nil' || chr(10) || chr(9) || '}}' || chr(10) || chr(9) || 'return Item' || i || '{{}}, nil' AS text FROM ids")
_select("q_code_in_return", code_tree, "struct::in.return > func", ["node"], f"WITH {_IDS} SELECT {_GO} || '#Get' || i AS node FROM ids")
_select("q_code_in_param", code_tree, "struct::in.param > *", ["node"], f"WITH {_IDS} SELECT {_GO} || '#Get' || i AS node FROM ids")
_select("q_code_in_field", code_tree, "struct::in.field > *", ["node"], f"WITH {_IDS} SELECT {_GO} || '#Item' || i || '.Next' AS node FROM ids")
_select("q_code_in_call", code_tree, "func::in.call > func", ["node"], f"WITH {_IDS} SELECT {_GO} || '#use' || i AS node FROM ids")
_select("q_code_hot", code_tree, "method::in.call > method", ["node"], f"WITH {_IDS} SELECT {_JAVA} || '#Box' || i || '.go[1]' AS node FROM ids")
_select("q_code_uncalled", code_tree, "func:where(::in:empty)", ["node"], f"WITH {_IDS} SELECT {_GO} || '#use' || i AS node FROM ids")
_select("q_conflict_sides", code_tree, "file::mine, file::theirs", ["node", "line", "text"], f"WITH {_IDS} SELECT {_TXT} AS node, CAST(3 AS INTEGER) AS line, 'mine ' || i AS text FROM ids UNION ALL SELECT {_TXT}, 7, 'theirs ' || i || chr(10) || 'more ' || i FROM ids")
_add("q_conflict_resolved", f"WITH {_IDS} SELECT {_TXT} AS path, string_agg(x, chr(10) ORDER BY n) AS text FROM (SELECT i, unnest([1, 2, 3, 4]) AS n, unnest(['head ' || i, 'theirs ' || i, 'more ' || i, 'tail']) AS x FROM ids) GROUP BY i", lambda s, d: _resolved(kept(code_tree, s, d)))
_add("q_rename_plan", f"WITH {_IDS} SELECT {_GO} AS path, CAST(unnest([10, 11]) AS INTEGER) AS line, CAST(unnest([10, 5]) + length(i) * unnest([1, 0]) AS INTEGER) AS col, 'edit' AS action FROM ids", lambda s, d: edits.rename_plan(kept(code_tree, s, d), "key", "name").select("path", F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), "action"))
_add("q_ignored", "SELECT 'src/go/f' || doc_id || '.go' AS path FROM documents", lambda s, d: (lambda f: f.where(~code.ignored(F.col("path"), ["*.java", "src/t?t/", "!src/txt/keep"])).select("path"))(code_files(s, d)))
_add("q_clean_files", "SELECT 'src/' || x || '/f' || doc_id || '.' || x AS path, x = 'go' OR doc_id % 3 <> 0 AS clean FROM documents, (VALUES ('go'), ('java')) t(x)", lambda s, d: code.clean_files(_faulty(code_files(s, d))).select("path", "clean"))


_add("q_signature_plan", f"WITH {_IDS} SELECT {_JAVA} AS path, CAST(6 AS INTEGER) AS line, CAST(30 AS INTEGER) AS col, 'a, 1' AS old, '1, false' AS new, 'edit' AS action FROM ids", lambda s, d: patches.signature_plan(kept(code_tree, s, d), code_files(s, d), "go", ["a int", "b int"], ["b int", "quiet boolean"], "java"))
_add("q_patched", f"WITH {_IDS} SELECT {_TXT} AS path, replace(replace('top ' || i || chr(10) || '<<<<<<< ours', '<<<<<<< ours', '<<<<<<< ours' || chr(10) || 'mine too'), '!', '') AS head FROM ids", lambda s, d: _patched(s, d))
_add("q_resolved_addresses", f"WITH {_IDS} SELECT {_JAVA} || '#Box' || i || unnest(['.go[1]', '.go[2]', '']) AS addr, unnest(['method', 'method', 'class']) AS cls FROM ids", lambda s, d: _addresses(kept(code_tree, s, d)))
_add("q_entities", "SELECT 'api/f' || doc_id || '.proto' AS path, unnest(['Item' || doc_id, 'Stock' || doc_id, 'Find' || doc_id]) AS name, unnest(['message', 'service', 'rpc']) AS kind, CAST(unnest([3, 4, 4]) AS INTEGER) AS line FROM documents", lambda s, d: bindings.entities(schema_files(s, d)).select("path", "name", "kind", "line"))
_add("q_promoted", f"WITH {_IDS} SELECT 'Item' || i AS name, {_GO} AS path, CAST(unnest([3, 5, 6, 10, 14]) AS INTEGER) AS line, 'promoted' AS conf FROM ids UNION ALL SELECT 'Item' || i, 'api/f' || i || '.proto', 3, 'declared' FROM ids", lambda s, d: bindings.promoted(kept(code_tree, s, d), bindings.entities(schema_files(s, d)).where("kind = 'message'")))
_add("q_regex_names", f"WITH {_LINES} SELECT node AS path, line, unnest(regexp_extract_all(text, '(\\w+) License', 1)) AS name FROM lines", lambda s, d: bindings.regex_names(kept(tables.documents, s, d), r"(\w+) License"))
_add("q_walk", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), b AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN rn END) OVER (PARTITION BY user_id ORDER BY rn) AS bought FROM e) SELECT 'user/' || user_id || '#' || event_id AS host, 'user/' || user_id || '#' || nxt AS far, CAST(rn - bought + 1 AS INTEGER) AS hop FROM b WHERE nxt IS NOT NULL AND rn - bought + 1 <= 3", lambda s, d: walks.walk(kept(tables.events, s, d), "field#purchase::out.call{1,3}").select("host", F.array_join("far", ",").alias("far"), "hop"))
_add("q_walk_via", "WITH e AS (SELECT *, row_number() OVER w AS rn, lead(event_id) OVER w AS nxt, lag(event_id) OVER w AS prv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN rn END) OVER (PARTITION BY user_id ORDER BY rn) AS bought FROM e) SELECT 'user/' || user_id || '#' || event_id AS host, 'user/' || user_id || '#' || nxt AS far, CAST(rn - bought + 1 AS INTEGER) AS hop, CASE WHEN rn > bought THEN 'user/' || user_id || '#' || prv END AS via_host FROM b WHERE nxt IS NOT NULL AND rn - bought + 1 <= 3", lambda s, d: _via(walks.walk(kept(tables.events, s, d), "field#purchase::out.call{1,3}")))
_add("q_snapshots", "WITH w AS (SELECT user_id, event_id, event_type, event_id % 4 AS wave FROM events WHERE user_id % 7 <> 0) SELECT user_id, event_id, event_type FROM w QUALIFY wave = max(wave) OVER (PARTITION BY user_id)", lambda s, d: _snapshot(s, d))
_add("q_capped_lines", f"WITH {_LINES}, hits AS (SELECT node, line, text, length(text) AS n, strpos(text, 'the') AS pos FROM lines WHERE contains(text, 'the')) SELECT node, line, CASE WHEN n <= 60 THEN text ELSE substring(text, CAST(greatest(1, least(pos - 28, n - 59)) AS INTEGER), 60) || ' (+' || (n - 60) || ' chars)' END AS text FROM hits", lambda s, d: query(kept(tables.documents, s, d), "file::grep('the')").select("node", "line", read.capped(F.col("text"), F.locate("the", F.col("text")), F.lit(3), 60).alias("text")))
_add("q_near_context", f"WITH {_LINES}, framed AS (SELECT node, line, text, lag(text) OVER w AS b, lead(text) OVER w AS a FROM lines WINDOW w AS (PARTITION BY node ORDER BY line)), hits AS (SELECT *, 120 - strlen(text) AS room FROM framed WHERE contains(text, 'License')), after AS (SELECT *, a IS NOT NULL AND strlen(a) + 1 <= room AS fits_a FROM hits) SELECT node, line, CASE WHEN fits_a THEN a ELSE '' END AS after, CASE WHEN b IS NOT NULL AND (a IS NULL OR fits_a) AND strlen(b) + 1 <= room - CASE WHEN fits_a THEN strlen(a) + 1 ELSE 0 END THEN b ELSE '' END AS before FROM after", lambda s, d: _near(query(kept(tables.documents, s, d), "file::grep('-C1 License')")))
_add("q_new_diagnostics", "WITH b AS (SELECT text, count(*) AS was FROM conversations WHERE role = 'user' GROUP BY text), a AS (SELECT text, count(*) AS now FROM conversations WHERE role = 'assistant' GROUP BY text) SELECT a.text, now - coalesce(was, 0) AS n FROM a LEFT JOIN b ON a.text IS NOT DISTINCT FROM b.text WHERE now > coalesce(was, 0)", lambda s, d: (lambda t: read.missing(t.where("role = 'user'"), t.where("role = 'assistant'"), ["text"]))(tables.table(s, d, "conversations")))
_add("q_settled", "WITH one AS (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts) SELECT * FROM one QUALIFY epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) >= 3600000000", lambda s, d: state.settled(tables.table(s, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", 3_600_000))
_add("q_transitions", "WITH f AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS entered FROM events) SELECT user_id, ts, entered FROM f QUALIFY coalesce(lag(entered) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) <> entered", lambda s, d: state.transitions(tables.table(s, d, "events").withColumn("bought", F.col("event_type") == "purchase"), "user_id", "ts", "bought", ["event_id"]))
_add("q_sibling_rollup", "WITH g AS (SELECT conv_id, max(turn) AS gen FROM conversations GROUP BY conv_id), b AS (SELECT conv_id, max(turn) AS gen FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT CAST(g.conv_id AS VARCHAR) AS path, g.gen FROM g LEFT JOIN b USING (conv_id) WHERE b.gen IS NULL OR g.gen > b.gen", lambda s, d: (lambda t: state.sibling_rollup(*[x.groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.max("turn").alias("gen")) for x in (t, t.where("role = 'user'"))]))(tables.table(s, d, "conversations")))
_add("q_idle", "WITH k AS (SELECT user_id, ts, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS h FROM events), m AS (SELECT max(ts) AS now FROM events) SELECT CAST(user_id AS VARCHAR) AS root, max(ts) AS last FROM k, m GROUP BY user_id, now HAVING sum(h) <= 0 AND epoch_ms(now) - epoch_ms(max(ts)) >= 86400000", lambda s, d: _idle(tables.table(s, d, "events")))


def schema_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a schema file for every document."""
    text_ = 'syntax = "proto3";\n// message Not%s {}\nmessage Item%s { string id = 1; }\nservice Stock%s { rpc Find%s (Item%s) returns (Item%s); }\n'
    i = F.col("doc_id").cast("string")
    return tables.table(spark, sf_dir, "documents").select(F.concat(F.lit("api/f"), i, F.lit(".proto")).alias("path"), F.format_string(text_, *[i] * 6).alias("content"))


def _faulty(files: DataFrame) -> DataFrame:
    """The files with the last brace gone from every third Java file."""
    hurt = F.coalesce(F.regexp_extract("path", r"f(\d+)\.java$", 1).try_cast("long") % 3 == 0, F.lit(False))
    return files.withColumn("content", F.when(hurt, F.regexp_replace("content", r"\}\s*$", "")).otherwise(F.col("content")))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in four waves by a hash, each replacing its users' rows, and a fifth that deletes every seventh user: the last generation."""
    rows = tables.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    table = snapshots.Snapshots(spark, f"{scratch_root(spark)}/snapshots-{uuid.uuid4().hex}", "user_id", f"user_id {rows.schema['user_id'].dataType.simpleString()}, event_id long, event_type string", fanout=3)
    for n in range(4):
        table.apply(rows.where(F.col("event_id") % 4 == n))
    table.apply(rows.limit(0), rows.where("user_id % 7 = 0").select("user_id"))
    return table.read()


def _via(walked: DataFrame) -> DataFrame:
    before = walked.select(F.col("edge").alias("via"), F.col("host").alias("via_host"))
    return walked.join(before, "via", "left").select("host", F.array_join("far", ",").alias("far"), "hop", "via_host")


def _patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir).where("path like '%.txt'")
    i = F.regexp_extract("path", r"f(\d+)\.txt$", 1)
    diff = F.format_string("@@ -1,2 +1,3 @@\n-head %s\n+top %s\n <<<<<<< ours\n+mine too", i, i)
    return files.select("path", F.array_join(F.slice(F.split(patches.patched(F.col("content"), diff), "\n"), 1, 3), "\n").alias("head"))


def _addresses(ws) -> DataFrame:
    wanted = nodes_of(ws, {"class", "method"}).select("addr", F.col("start").alias("line"))
    return read.resolved(ws, wanted).select("addr", "cls")


def _near(hits: DataFrame) -> DataFrame:
    before, after = read.budgeted(F.col("before"), F.col("text"), F.col("after"), 120)
    return hits.select("node", "line", F.array_join(before, "\n").alias("b"), F.array_join(after, "\n").alias("a")).withColumnsRenamed({"b": "before", "a": "after"})


def _idle(events: DataFrame) -> DataFrame:
    now = events.agg(F.max("ts")).first()[0]
    kind = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "close").otherwise("use")
    return state.idle(events.select(F.col("user_id").cast("string").alias("root"), "ts", kind.alias("kind")), now, 86_400_000)


def _resolved(ws) -> DataFrame:
    files = nodes_of(ws, {"file"}).where("path like '%.txt'").select("file_id", "path")
    lines = conflicts.resolved(ws.lines.join(files, "file_id", "left_semi"), "theirs").join(files, "file_id")
    return lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x.text), "\n").alias("text"))


def _ddl(events: DataFrame) -> DataFrame:
    """Events as a log: every third drops the column that its type names, others add it; users are tables made at the start."""
    log = events.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "drop").otherwise("add").alias("op"), F.col("user_id").cast("string").alias("table"), F.col("event_type").alias("column"))
    made = log.select(F.lit(-1).cast("long").alias("seq"), F.lit("create").alias("op"), "table", F.lit(None).cast("string").alias("column")).distinct()
    return log.unionByName(made)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["q_grep_lines"](spark, sf_dir)
