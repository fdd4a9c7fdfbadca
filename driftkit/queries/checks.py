"""Counts, keys, NULLs, foreign keys, expectations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from driftkit.functions import change_text
from driftkit.operators import checks as C
from driftkit.operators import keys as K
from driftkit.operators import schema_diff as S
from driftkit.operators import validation as V
from driftkit.plans import compare as P
from driftkit.queries import inputs as I
from driftkit.queries.base import derive, duck, query, table, tables
from driftkit.queries.schema import KEYS, diff_ctes, live_changes, of_fleet
from driftkit.sources.catalog import catalog

_REFERENCE = ("customer", "documents", "labels", "lineitem", "orders")


def _backup(spark, sf_dir):
    return {
        **tables(spark, sf_dir, "customer"),
        "orders": derive(spark, sf_dir, I.ORDERS_AFTER),
        "lineitem": derive(spark, sf_dir, I.LINEITEM_BACKUP),
        "documents": derive(spark, sf_dir, I.DOCUMENTS_BACKUP),
    }


@query("row_count_compare", f"""
    WITH b AS (
        SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
        UNION ALL SELECT 'lineitem', count(*) FROM {duck(I.LINEITEM_BACKUP)}
        UNION ALL SELECT 'documents', count(DISTINCT text) FROM documents),
    r AS ({" UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in _REFERENCE)})
    SELECT r.t AS "table", coalesce(b.n, 0) AS backup_rows, r.n AS reference_rows,
           coalesce(b.n = r.n, false) AS rows_match
    FROM r LEFT JOIN b ON r.t = b.t""")
def row_count_compare(spark, sf_dir):
    return C.compare_row_counts(_backup(spark, sf_dir), tables(spark, sf_dir, *_REFERENCE))


RELATIONS = [
    C.ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    C.ForeignKey("lineitem", ("l_partkey",), "part", ("p_partkey",)),
    C.ForeignKey("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    C.ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
    # Not enforced by the data: customers as suppliers, documents that want a label,
    # buyers found among the users, lines found among the lines of a backup.
    C.ForeignKey("orders", ("o_custkey",), "supplier", ("s_suppkey",)),
    C.ForeignKey("documents", ("doc_id",), "labels", ("doc_id",)),
    C.ForeignKey("customer", ("c_custkey",), "events", ("user_id",)),
    C.ForeignKey("lineitem", ("l_suppkey", "l_linenumber"), "supplier_lines", ("s_nationkey", "line")),
]
_SUPPLIER_LINES = "SELECT s_nationkey, CAST(s_suppkey % 7 AS INT) AS line FROM {supplier}"
_ROW_KEYS = {
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "orders": ["o_orderkey"],
    "documents": ["doc_id"], "customer": ["c_custkey"],
}


def _related(spark, sf_dir):
    loaded = tables(
        spark, sf_dir, "lineitem", "orders", "part", "supplier", "customer", "documents", "labels", "events"
    )
    return {**loaded, "supplier_lines": derive(spark, sf_dir, _SUPPLIER_LINES)}


def _orphans(fk):
    match = " AND ".join(f"c.{a} = p.{b}" for a, b in zip(fk.columns, fk.parent_columns, strict=True))
    parent = duck(_SUPPLIER_LINES) if fk.parent == "supplier_lines" else fk.parent
    filled = " AND ".join(f"c.{a} IS NOT NULL" for a in fk.columns)
    return f"FROM {fk.child} c WHERE {filled} AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {match})"


def _names(fk):
    return f"""'{fk.child}' AS child, '{", ".join(fk.columns)}' AS "columns", '{fk.parent}' AS parent"""


@query("fk_check", " UNION ALL ".join(
    f"SELECT {_names(fk)}, count(DISTINCT ({', '.join(fk.columns)})) AS orphan_keys, count(*) AS orphan_rows "
    f"{_orphans(fk)}" for fk in RELATIONS))
def fk_check(spark, sf_dir):
    return C.fk_check(_related(spark, sf_dir), RELATIONS)


def _text(columns):
    return " || ', ' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)


@query("fk_check_sample", " UNION ALL ".join(
    f"""SELECT * FROM (SELECT {_names(fk)}, {_text(fk.columns)} AS key, {_text(_ROW_KEYS[fk.child])} AS row_key,
                              count(*) OVER () AS violations {_orphans(fk)}
                       ORDER BY {", ".join([*fk.columns, *_ROW_KEYS[fk.child]])} LIMIT 5)""" for fk in RELATIONS))
def fk_check_sample(spark, sf_dir):
    return C.fk_sample(_related(spark, sf_dir), RELATIONS, _ROW_KEYS)


# Ranges as a table of expectations: per order state and priority, from the customers' segments.
_RANGES = """
    SELECT concat('orders_', lower(o_orderstatus)) AS "table",
           CASE WHEN max(o_totalprice) < 499990 THEN NULL ELSE count(DISTINCT o_custkey) * 3 END AS min_rows,
           count(DISTINCT o_custkey) * 5 AS max_rows
    FROM {orders} GROUP BY o_orderstatus
    UNION ALL
    SELECT concat('events_', event_type) AS "table", count(DISTINCT user_id) AS min_rows,
           CASE WHEN event_type = 'error' THEN NULL ELSE CAST(2000 AS BIGINT) END AS max_rows
    FROM {events} GROUP BY event_type
    UNION ALL
    SELECT concat('pages_', count(DISTINCT url)) AS "table", count(*) AS min_rows, NULL AS max_rows FROM {pages}"""
_COUNTS = """
    SELECT concat('orders_', lower(o_orderstatus)) AS "table", count(*) AS rows FROM {orders} GROUP BY o_orderstatus
    UNION ALL
    SELECT concat('events_', event_type) AS "table", count(*) AS rows FROM {events} GROUP BY event_type"""


@query("row_count_range", f"""
    SELECT 'row count out of range' AS kind, r."table", CAST(NULL AS VARCHAR) AS subject,
           concat(coalesce(rows, 0), ' not in ', min_rows, '..', max_rows) AS detail
    FROM {duck(_RANGES)} r LEFT JOIN {duck(_COUNTS)} c ON r."table" = c."table"
    WHERE coalesce(rows, 0) < min_rows OR coalesce(rows, 0) > max_rows""")
def row_count_range(spark, sf_dir):
    return C.check_row_ranges(derive(spark, sf_dir, _COUNTS), derive(spark, sf_dir, _RANGES))


@query("pk_unique_check", """
    WITH d AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    SELECT count(*) AS duplicate_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows,
           count(*) = 0 AS is_unique FROM d""")
def pk_unique_check(spark, sf_dir):
    return C.pk_unique_check(table(spark, sf_dir, "lineitem"), I.LINEITEM_KEYS)


@query("duplicate_keys", """
    SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    return C.duplicate_keys(table(spark, sf_dir, "lineitem"), I.LINEITEM_KEYS)


_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("not_null_check", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS rows FROM {duck(I.EVENTS_AFTER)}"
    for c in _EVENT_COLUMNS))
def not_null_check(spark, sf_dir):
    return C.not_null_check(derive(spark, sf_dir, I.EVENTS_AFTER), _EVENT_COLUMNS)


@query("backup_check", f"""
    WITH d AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1),
    e AS (
        SELECT concat('orders: ', count(*), ' duplicate key(s), ', CAST(sum(n - 1) AS BIGINT), ' extra row(s)') AS error
        FROM d HAVING count(*) > 0
        UNION ALL
        SELECT concat('events.user_id: ', count(*), ' NULL(s)') FROM {duck(I.EVENTS_AFTER)}
        WHERE user_id IS NULL HAVING count(*) > 0),
    c AS (SELECT (SELECT count(*) FROM {duck(I.LINEITEM_BACKUP)}) AS b, (SELECT count(*) FROM lineitem) AS r)
    SELECT (SELECT count(*) FROM e) = 0 AS integrity_ok,
           (SELECT string_agg(error, '; ' ORDER BY error) FROM e) AS integrity_errors,
           false AS schema_ok, CAST(8 AS BIGINT) AS schema_changes,
           (SELECT b = r FROM c) AS data_ok,
           (SELECT concat('customer ', n, ' ', n, ' true; ') FROM (SELECT count(*) AS n FROM customer))
           || (SELECT concat('events ', n, ' ', n, ' true; ') FROM (SELECT count(*) AS n FROM events))
           || (SELECT concat('lineitem ', b, ' ', r, ' ', b = r, '; ') FROM c)
           || (SELECT concat('orders ', n, ' ', n, ' true') FROM (SELECT count(*) AS n FROM orders)) AS tables,
           false AS passed""")
def backup_check(spark, sf_dir):
    backup = {
        **tables(spark, sf_dir, "customer", "orders"),
        "events": derive(spark, sf_dir, I.EVENTS_AFTER),
        "lineitem": derive(spark, sf_dir, I.LINEITEM_BACKUP),
    }
    reference = tables(spark, sf_dir, "customer", "events", "lineitem", "orders")
    keys = {"customer": ["c_custkey"], "orders": ["o_custkey"], "lineitem": I.LINEITEM_KEYS}
    report = P.check(spark, backup, reference, True, keys, {"events": ["user_id"]})

    def line(t):
        return F.concat_ws(" ", t["table"], t["backup_rows"], t["reference_rows"], t["rows_match"].cast("string"))

    return report.select(
        "integrity_ok", F.array_join("integrity_errors", "; ").alias("integrity_errors"), "schema_ok",
        "schema_changes", "data_ok", F.array_join(F.transform("tables", line), "; ").alias("tables"), "passed",
    )


_DB_KEYS = {"orders": ["o_orderkey"], "documents": ["doc_id"]}


@query("diff_database", f"""
    WITH o AS (SELECT count(*) FILTER (o.o_orderkey IS NULL) AS a, count(*) FILTER (n.o_orderkey IS NULL) AS r,
                      count(*) FILTER (o.o_orderkey IS NOT NULL AND n.o_orderkey IS NOT NULL AND (
                          o.o_totalprice <> n.o_totalprice OR o.o_orderpriority <> n.o_orderpriority)) AS c
               FROM orders o FULL JOIN {duck(I.ORDERS_AFTER)} n ON o.o_orderkey = n.o_orderkey)
    SELECT 'data' AS part, 'customer' AS "table", NULL AS change, CAST(0 AS BIGINT) AS added, count(*) AS removed,
           CAST(0 AS BIGINT) AS changed FROM customer
    UNION ALL SELECT 'data', 'labels', NULL, count(*), 0, 0 FROM labels
    UNION ALL SELECT 'data', 'orders', NULL, a, r, c FROM o WHERE a + r + c > 0
    UNION ALL SELECT 'data', 'documents', NULL, a, r, c FROM (
        SELECT 0 AS a, (SELECT count(*) FROM documents) - (SELECT count(DISTINCT text) FROM documents) AS r, 0 AS c)
        WHERE r > 0
    UNION ALL SELECT 'schema', t, c, NULL, NULL, NULL FROM (VALUES
        ('customer', 'customer: table removed'), ('labels', 'labels: table added'),
        ('documents', 'documents.lang: column removed '), ('documents', 'documents.source: column removed '),
        ('documents', 'documents.n_chars: column removed ')) v(t, c)""")
def diff_database(spark, sf_dir):
    old = tables(spark, sf_dir, "customer", "documents", "events", "orders")
    new = {
        **tables(spark, sf_dir, "events", "labels"),
        "documents": derive(spark, sf_dir, I.DOCUMENTS_BACKUP),
        "orders": derive(spark, sf_dir, I.ORDERS_AFTER),
    }
    diff = P.diff_database(spark, old, new, {**_DB_KEYS, "events": ["event_id"]})
    none = F.lit(None)
    schema = diff.schema.select(
        F.lit("schema").alias("part"), "table",
        change_text(F.col("table"), F.col("subject"), F.col("kind"), F.col("detail")).alias("change"),
        *[none.cast("bigint").alias(c) for c in ("added", "removed", "changed")],
    )
    return schema.unionByName(
        diff.data.select(F.lit("data").alias("part"), "table", none.cast("string").alias("change"),
                         "added", "removed", "changed")
    )


@query("diff_database_declared", f"""
    WITH o AS (SELECT count(*) FILTER (o.o_orderkey IS NULL) AS a, count(*) FILTER (n.o_orderkey IS NULL) AS r,
                      count(*) FILTER (o.o_orderkey IS NOT NULL AND n.o_orderkey IS NOT NULL AND (
                          o.o_totalprice <> n.o_totalprice OR o.o_orderpriority <> n.o_orderpriority)) AS c
               FROM orders o FULL JOIN {duck(I.ORDERS_AFTER)} n ON o.o_orderkey = n.o_orderkey),
    e AS (SELECT count(*) AS c FROM events o JOIN {duck(I.EVENTS_AFTER)} n ON o.event_id = n.event_id
          WHERE o.user_id IS DISTINCT FROM n.user_id OR o.props IS DISTINCT FROM n.props),
    t AS (SELECT count(*) AS c FROM conversations WHERE role = 'user')
    SELECT 'orders' AS "table", a AS added, r AS removed, c AS changed FROM o WHERE a + r + c > 0
    UNION ALL SELECT 'events', 0, 0, c FROM e WHERE c > 0
    UNION ALL SELECT 'conversations', 0, 0, c FROM t WHERE c > 0""")
def diff_database_declared(spark, sf_dir):
    """No key is given; the catalog declares them, one of two columns among them."""
    old = tables(spark, sf_dir, "orders", "events", "conversations", "nation")
    new = {
        **tables(spark, sf_dir, "nation"),
        "orders": derive(spark, sf_dir, I.ORDERS_AFTER), "events": derive(spark, sf_dir, I.EVENTS_AFTER),
        "conversations": derive(spark, sf_dir, I.CONVERSATIONS_AFTER),
    }
    declared = catalog(spark, old, "main", {t: KEYS[t] for t in old})
    return P.diff_database(spark, old, new, declared=declared).data


_SEARCHED = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": _EVENT_COLUMNS, "conversations": ["conv_id", "turn", "role", "text"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
}
_SETS = [(t, s) for t, c in _SEARCHED.items() for n in (1, 2) for s in combinations(c, n)]


@query("key_candidates", "WITH sets AS (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", [{", ".join(f"'{c}'" for c in s)}] AS cols,
               count(*) > 0 AND count(*) = count(DISTINCT ({", ".join(s)})) AND {" AND ".join(f"count(*) = count({c})" for c in s)} AS is_key
        FROM {t}""" for t, s in _SETS) + """)
    SELECT "table", array_to_string(cols, ', ') AS key FROM sets s
    WHERE is_key AND NOT EXISTS (SELECT 1 FROM sets p WHERE p."table" = s."table" AND p.is_key
                                 AND len(p.cols) < len(s.cols) AND list_has_all(s.cols, p.cols))""")
def key_candidates(spark, sf_dir):
    """The minimal keys of up to two columns that the rows of five tables show."""
    loaded = tables(spark, sf_dir, *_SEARCHED)
    found = [(t, ", ".join(key)) for t, c in _SEARCHED.items() for key in K.key_candidates(loaded[t], 2, c)]
    return spark.createDataFrame(found, "`table` string, key string")


# The changes that were expected are those of a later live state.
_EXPECTED = diff_ctes(new=I.LATE, new_indexes=I.LATE_INDEXES, p="e")
_VALIDATED = f"""
    WITH {diff_ctes()}, {_EXPECTED},
    a AS (SELECT *, row_number() OVER (PARTITION BY {{key}} ORDER BY detail NULLS FIRST) AS i FROM changes),
    e AS (SELECT *, row_number() OVER (PARTITION BY {{key}}) AS i FROM echanges),
    matched AS (
        SELECT CASE WHEN e.kind IS NULL THEN 'unexpected' WHEN a.kind IS NULL THEN 'missing' ELSE 'confirmed' END
                   AS verdict, {{shown}}, a.detail AS detail
        FROM a FULL JOIN e ON {{on}} AND a.i = e.i)"""


def _validated(key):
    return _VALIDATED.format(
        key=", ".join(key),
        shown=", ".join(f"coalesce(a.{k}, e.{k}) AS {k}" for k in key),
        on=" AND ".join(f"a.{k} IS NOT DISTINCT FROM e.{k}" for k in key),
    )


_SPEC_KEY = ["database", "kind", '"table"', "subject"]


def _expected(spark, sf_dir):
    inputs, n = of_fleet(spark, sf_dir, I.BASELINE, I.LATE, I.BASELINE_INDEXES, I.LATE_INDEXES)
    return S.schema_diff(*inputs, partitions=n)


@query("validate_spec", _validated(_SPEC_KEY) + f"""
    SELECT verdict, {", ".join(_SPEC_KEY)}, detail, count(*) AS copies FROM matched GROUP BY ALL""")
def validate_spec(spark, sf_dir):
    return V.validate(live_changes(spark, sf_dir), _expected(spark, sf_dir), by=["database"])


@query("validate_spec_repeats", _validated(_SPEC_KEY[1:]) + f"""
    SELECT verdict, {", ".join(_SPEC_KEY[1:])}, detail, count(*) AS copies FROM matched GROUP BY ALL""")
def validate_spec_repeats(spark, sf_dir):
    return V.validate(live_changes(spark, sf_dir), _expected(spark, sf_dir))


@query("validate_verdict", _validated(_SPEC_KEY) + """
    SELECT database, count(*) FILTER (verdict = 'confirmed') AS confirmed,
           count(*) FILTER (verdict = 'unexpected') AS unexpected, count(*) FILTER (verdict = 'missing') AS missing,
           count(*) FILTER (verdict <> 'confirmed') = 0 AS passed
    FROM matched GROUP BY database""")
def validate_verdict(spark, sf_dir):
    result = V.validate(live_changes(spark, sf_dir), _expected(spark, sf_dir), by=["database"])
    return V.validation_passed(result, by=["database"])


# The tables of the live state are to keep at least the rows of the baseline.
_TABLE_COUNTS = f"""
    SELECT concat('cust_', o_custkey) AS database, {I.fleet_table(I.LIVE_LIMIT)} AS "table", count(*) AS rows
    FROM {{orders}} GROUP BY concat('cust_', o_custkey), {I.fleet_table(I.LIVE_LIMIT)}"""
_TABLE_RANGES = f"""
    SELECT concat('cust_', o_custkey) AS database, {I.fleet_table(I.BASE_LIMIT)} AS "table",
           count(*) AS min_rows, CAST(NULL AS BIGINT) AS max_rows
    FROM {{orders}} GROUP BY concat('cust_', o_custkey), {I.fleet_table(I.BASE_LIMIT)}"""


@query("validate_data", _validated(_SPEC_KEY) + f""",
    r AS (SELECT database, "table", coalesce(rows, 0) || ' not in ' || min_rows || '..' AS detail
          FROM {duck(_TABLE_RANGES)} LEFT JOIN {duck(_TABLE_COUNTS)} USING (database, "table")
          WHERE coalesce(rows, 0) < min_rows)
    SELECT verdict, {", ".join(_SPEC_KEY)}, detail, count(*) AS copies FROM matched GROUP BY ALL
    UNION ALL
    SELECT 'unexpected', database, 'row count out of range', "table", NULL, detail, 1 FROM r""")
def validate_data(spark, sf_dir):
    return P.validate_data(
        live_changes(spark, sf_dir), _expected(spark, sf_dir), derive(spark, sf_dir, _TABLE_COUNTS),
        derive(spark, sf_dir, _TABLE_RANGES), by=["database"],
    )


def _agg(kind, text):
    return f"coalesce(string_agg({text}, '; ' ORDER BY subject) FILTER (kind = '{kind}'), '')"


@query("spec_from_diff", f"""
    WITH {diff_ctes()}
    SELECT database, "table",
           {_agg("column added", "subject || ' ' || new_type")} AS added_columns,
           {_agg("column removed", "subject")} AS removed_columns,
           {_agg("column type changed", "subject || ' ' || new_type")} AS changed_columns,
           {_agg("index added", "subject || ' ' || is_unique")} AS added_indexes,
           {_agg("index removed", "subject")} AS removed_indexes
    FROM changes WHERE kind NOT LIKE 'table%' GROUP BY database, "table" """)
def spec_from_diff(spark, sf_dir):
    spec = V.spec_from_diff(live_changes(spark, sf_dir), by=["database"])

    def line(field, second):
        return F.array_join(F.transform(f"m.{field}", lambda c: F.concat_ws(" ", c["name"], c[second].cast("string"))),
                            "; ").alias(field)

    return spec.select("database", F.explode("schema.modified_tables").alias("m")).select(
        "database", "m.table", line("added_columns", "type"), line("removed_columns", "type"),
        line("changed_columns", "type"), line("added_indexes", "unique"), line("removed_indexes", "unique"),
    )


@query("spec_changes", f"""WITH {diff_ctes()} SELECT database, kind, "table", subject FROM changes""")
def spec_changes(spark, sf_dir):
    return V.spec_changes(V.spec_from_diff(live_changes(spark, sf_dir), by=["database"]))
