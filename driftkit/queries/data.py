"""Row-level comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkit.operators import data_diff as D
from driftkit.operators import order_index as O
from driftkit.queries import inputs as I
from driftkit.queries.base import TABLES, derive, duck, query, table, tables
from driftkit.sources.tables import load_tables

_NEW = duck(I.ORDERS_AFTER)
_VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _differs(columns, a="o", b="n"):
    return "(" + " OR ".join(f"{a}.{c} IS DISTINCT FROM {b}.{c}" for c in columns) + ")"


@query("data_diff_counts", f"""
    SELECT count(*) FILTER (o.o_orderkey IS NULL) AS added,
           count(*) FILTER (n.o_orderkey IS NULL) AS removed,
           count(*) FILTER (o.o_orderkey IS NOT NULL AND n.o_orderkey IS NOT NULL
                            AND {_differs(_VALUES)}) AS changed
    FROM orders o FULL JOIN {_NEW} n ON o.o_orderkey = n.o_orderkey""")
def data_diff_counts(spark, sf_dir):
    return D.diff_counts(table(spark, sf_dir, "orders"), derive(spark, sf_dir, I.ORDERS_AFTER), I.ORDERS_KEYS)


_DOC_NEW = duck(I.DOCUMENTS_AFTER)


@query("data_diff_counts_documents", f"""
    SELECT count(*) FILTER (o.doc_id IS NULL) AS added,
           count(*) FILTER (n.doc_id IS NULL) AS removed,
           count(*) FILTER (o.doc_id IS NOT NULL AND n.doc_id IS NOT NULL
                            AND {_differs(["text", "lang", "source", "n_chars"])}) AS changed
    FROM documents o FULL JOIN {_DOC_NEW} n ON o.doc_id = n.doc_id""")
def data_diff_counts_documents(spark, sf_dir):
    return D.diff_counts(
        table(spark, sf_dir, "documents"), derive(spark, sf_dir, I.DOCUMENTS_AFTER), ["doc_id"]
    )


_LINE_COLUMNS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
                 "l_tax, l_returnflag, l_linestatus, l_shipdate")


def _net_sql(old, new, columns):
    return f"""
        SELECT {columns}, CAST(sum(d) AS BIGINT) AS net FROM (
            SELECT {columns}, -1 AS d FROM {old} UNION ALL SELECT {columns}, 1 AS d FROM {new})
        GROUP BY ALL HAVING sum(d) <> 0"""


_LINE_NET = _net_sql("lineitem", duck(I.LINEITEM_AFTER), _LINE_COLUMNS)


@query("data_diff_repeated_keys", f"""
    WITH net AS ({_LINE_NET}),
    per_key AS (
        SELECT sum(greatest(-net, 0)) AS lost, sum(greatest(net, 0)) AS gained
        FROM net GROUP BY l_orderkey, l_linenumber)
    SELECT CAST(coalesce(sum(CASE WHEN lost = 1 AND gained = 1 THEN 0 ELSE gained END), 0) AS BIGINT) AS added,
           CAST(coalesce(sum(CASE WHEN lost = 1 AND gained = 1 THEN 0 ELSE lost END), 0) AS BIGINT) AS removed,
           count(*) FILTER (lost = 1 AND gained = 1) AS changed
    FROM per_key""")
def data_diff_repeated_keys(spark, sf_dir):
    return D.diff_counts(
        table(spark, sf_dir, "lineitem"), derive(spark, sf_dir, I.LINEITEM_AFTER), I.LINEITEM_KEYS
    )


@query("data_diff_added", f"""
    SELECT * FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = n.o_orderkey)""")
def data_diff_added(spark, sf_dir):
    return D.added_rows(table(spark, sf_dir, "orders"), derive(spark, sf_dir, I.ORDERS_AFTER), I.ORDERS_KEYS)


@query("data_diff_removed", f"""
    SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM {_NEW} n WHERE o.o_orderkey = n.o_orderkey)""")
def data_diff_removed(spark, sf_dir):
    return D.removed_rows(table(spark, sf_dir, "orders"), derive(spark, sf_dir, I.ORDERS_AFTER), I.ORDERS_KEYS)


def _flat(rows, keys, values):
    """A row diff with one column per value, old and new."""
    return rows.select(
        "status", "copies",
        *[F.col(f"key.{k}").alias(k) for k in keys],
        *[F.col(f"{side}.{v}").alias(f"{side}_{v}") for side in ("old", "new") for v in values],
    )


_SIDES = ", ".join(f"o.{v} AS old_{v}, n.{v} AS new_{v}" for v in _VALUES)
_ROWS_SQL = f"""
    SELECT CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed'
                ELSE 'changed' END AS status,
           CAST(1 AS BIGINT) AS copies, coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, {_SIDES}
    FROM orders o FULL JOIN {_NEW} n ON o.o_orderkey = n.o_orderkey
    WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR {_differs(_VALUES)}"""


@query("data_diff_rows", _ROWS_SQL)
def data_diff_rows(spark, sf_dir):
    rows = D.diff_rows(table(spark, sf_dir, "orders"), derive(spark, sf_dir, I.ORDERS_AFTER), I.ORDERS_KEYS)
    return _flat(rows, I.ORDERS_KEYS, _VALUES)


@query("data_diff_limit", _ROWS_SQL + " ORDER BY o_orderkey, status LIMIT 100")
def data_diff_limit(spark, sf_dir):
    rows = D.diff_rows(
        table(spark, sf_dir, "orders"), derive(spark, sf_dir, I.ORDERS_AFTER), I.ORDERS_KEYS, limit=100
    )
    return _flat(rows, I.ORDERS_KEYS, _VALUES)


_DOC_VALUES = ["text", "lang", "source", "n_chars"]


@query("data_diff_rows_documents", f"""
    SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS status,
           CAST(1 AS BIGINT) AS copies, coalesce(o.doc_id, n.doc_id) AS doc_id,
           {", ".join(f"o.{v} AS old_{v}, n.{v} AS new_{v}" for v in _DOC_VALUES)}
    FROM documents o FULL JOIN {_DOC_NEW} n ON o.doc_id = n.doc_id
    WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR {_differs(_DOC_VALUES)}""")
def data_diff_rows_documents(spark, sf_dir):
    rows = D.diff_rows(
        table(spark, sf_dir, "documents"), derive(spark, sf_dir, I.DOCUMENTS_AFTER), ["doc_id"]
    )
    return _flat(rows, ["doc_id"], _DOC_VALUES)


_CUSTOMER_VALUES = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_CUSTOMER_NET = _net_sql(
    duck(I.CUSTOMER_NULLS_BEFORE), duck(I.CUSTOMER_NULLS_AFTER),
    "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment",
)
_CUSTOMER_OLD = ", ".join(f"CASE WHEN net < 0 THEN {v} END AS old_{v}" for v in _CUSTOMER_VALUES)
_CUSTOMER_NEW = ", ".join(f"CASE WHEN net > 0 THEN {v} END AS new_{v}" for v in _CUSTOMER_VALUES)
_CUSTOMER_PAIR = ", ".join(
    f"max(CASE WHEN net < 0 THEN {v} END) AS old_{v}, max(CASE WHEN net > 0 THEN {v} END) AS new_{v}"
    for v in _CUSTOMER_VALUES
)


@query("data_diff_null_keys", f"""
    WITH net AS ({_CUSTOMER_NET}),
    per_key AS (
        SELECT c_custkey, sum(greatest(-net, 0)) AS lost, sum(greatest(net, 0)) AS gained, {_CUSTOMER_PAIR}
        FROM net GROUP BY c_custkey)
    SELECT CASE WHEN lost = 1 AND gained = 1 THEN 'changed' WHEN gained = 1 THEN 'added'
                ELSE 'removed' END AS status,
           CAST(1 AS BIGINT) AS copies, c_custkey,
           {", ".join(f"{side}_{v}" for side in ("old", "new") for v in _CUSTOMER_VALUES)}
    FROM per_key WHERE lost <= 1 AND gained <= 1
    UNION ALL
    SELECT CASE WHEN net > 0 THEN 'added' ELSE 'removed' END, abs(net), net.c_custkey,
           {_CUSTOMER_OLD}, {_CUSTOMER_NEW}
    FROM net JOIN per_key ON net.c_custkey IS NOT DISTINCT FROM per_key.c_custkey
    WHERE lost > 1 OR gained > 1""")
def data_diff_null_keys(spark, sf_dir):
    rows = D.diff_rows(
        derive(spark, sf_dir, I.CUSTOMER_NULLS_BEFORE), derive(spark, sf_dir, I.CUSTOMER_NULLS_AFTER), ["c_custkey"]
    )
    return _flat(rows, ["c_custkey"], _CUSTOMER_VALUES)


def _cells_sql(old, new, key, columns, text):
    return " UNION ALL ".join(
        f"""SELECT o.{key}, '{c}' AS "column", {text(f"o.{c}")} AS old, {text(f"n.{c}")} AS new
            FROM {old} o JOIN {new} n ON o.{key} = n.{key} WHERE o.{c} IS DISTINCT FROM n.{c}"""
        for c in columns
    )


def _duck_text(c):
    """DuckDB's printed form without the fraction of whole numbers."""
    return f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"


@query("cell_diff", _cells_sql("orders", _NEW, "o_orderkey", _VALUES, _duck_text))
def cell_diff(spark, sf_dir):
    return D.diff_cells(table(spark, sf_dir, "orders"), derive(spark, sf_dir, I.ORDERS_AFTER), I.ORDERS_KEYS)


@query("cell_diff_events", _cells_sql(
    "events", duck(I.EVENTS_AFTER), "event_id", ["user_id", "props"], lambda c: f"CAST({c} AS VARCHAR)"))
def cell_diff_events(spark, sf_dir):
    return D.diff_cells(table(spark, sf_dir, "events"), derive(spark, sf_dir, I.EVENTS_AFTER), ["event_id"])


_RELOADED = duck(I.ORDERS_RELOADED)


@query("data_diff_text", f"""
    SELECT CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed'
                ELSE 'changed' END AS status,
           coalesce(CAST(o.o_orderkey AS VARCHAR), n.o_orderkey) AS o_orderkey,
           CAST(o.o_custkey AS VARCHAR) AS old_o_custkey, n.o_custkey AS new_o_custkey
    FROM orders o FULL JOIN {_RELOADED} n ON CAST(o.o_orderkey AS VARCHAR) = n.o_orderkey
    WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR CAST(o.o_custkey AS VARCHAR) <> n.o_custkey""")
def data_diff_text(spark, sf_dir):
    rows = D.diff_rows(
        table(spark, sf_dir, "orders"), derive(spark, sf_dir, I.ORDERS_RELOADED), I.ORDERS_KEYS, compare="text"
    )
    return rows.select(
        "status", F.col("key.o_orderkey").alias("o_orderkey"),
        F.col("old.o_custkey").alias("old_o_custkey"), F.col("new.o_custkey").alias("new_o_custkey"),
    )


@query("data_diff_text_numbers", f"""
    SELECT 'changed' AS status, CAST(o.o_orderkey AS VARCHAR) AS o_orderkey,
           CAST(o.big AS VARCHAR) AS old_big, CAST(CAST(n.big AS BIGINT) AS VARCHAR) AS new_big,
           CAST(o.o_orderkey AS VARCHAR) AS old_amount, CAST(n.amount AS VARCHAR) AS new_amount,
           CAST(1 AS BIGINT) AS copies
    FROM {duck(I.ORDERS_MEASURED)} o JOIN {duck(I.ORDERS_REMEASURED)} n ON o.o_orderkey = n.o_orderkey
    WHERE o.big <> n.big OR o.amount <> n.amount""")
def data_diff_text_numbers(spark, sf_dir):
    """Integers against doubles on both sides of 10^15, decimals against integers: only real changes show."""
    rows = D.diff_rows(
        derive(spark, sf_dir, I.ORDERS_MEASURED), derive(spark, sf_dir, I.ORDERS_REMEASURED), I.ORDERS_KEYS, compare="text"
    )
    shown = {f"{side}_{v}": F.col(f"{side}.{v}") for v in ("big", "amount") for side in ("old", "new")}
    return rows.select("status", "copies", F.col("key.o_orderkey").alias("o_orderkey"), *[c.alias(n) for n, c in shown.items()])


@query("data_diff_retyped", f"""
    WITH o AS (SELECT * FROM {duck(I.ORDERS_CODED)}), n AS (SELECT * FROM {duck(I.ORDERS_RENUMBERED)})
    SELECT CASE WHEN o.code IS NULL THEN 'added' WHEN n.code IS NULL THEN 'removed' ELSE 'changed' END AS status,
           coalesce(CAST(n.code AS VARCHAR), o.code) AS code, o.o_custkey AS old_o_custkey, n.o_custkey AS new_o_custkey
    FROM o FULL JOIN n ON TRY_CAST(o.code AS BIGINT) = n.code
    WHERE o.code IS NULL OR n.code IS NULL OR o.o_custkey <> n.o_custkey""")
def data_diff_retyped(spark, sf_dir):
    """A text key that became a number: what is no number is removed, and shown."""
    rows = D.diff_rows(derive(spark, sf_dir, I.ORDERS_CODED), derive(spark, sf_dir, I.ORDERS_RENUMBERED), ["code"])
    return rows.select(
        "status", F.col("key.code").alias("code"),
        F.col("old.o_custkey").alias("old_o_custkey"), F.col("new.o_custkey").alias("new_o_custkey"),
    )


@query("data_diff_retyped_keys", f"""
    WITH o AS (SELECT * FROM {duck(I.ORDERS_CODED)}), n AS (SELECT * FROM {duck(I.ORDERS_RENUMBERED)})
    SELECT 'added' AS side, CAST(code AS VARCHAR) AS code, o_custkey FROM n
    WHERE NOT EXISTS (SELECT 1 FROM o WHERE TRY_CAST(o.code AS BIGINT) = n.code)
    UNION ALL
    SELECT 'removed', code, o_custkey FROM o
    WHERE NOT EXISTS (SELECT 1 FROM n WHERE TRY_CAST(o.code AS BIGINT) = n.code)""")
def data_diff_retyped_keys(spark, sf_dir):
    sides = [derive(spark, sf_dir, t) for t in (I.ORDERS_CODED, I.ORDERS_RENUMBERED)]

    def listed(rows, side):
        return rows.select(F.lit(side).alias("side"), F.col("code").cast("string").alias("code"), "o_custkey")

    added, removed = D.added_rows(*sides, ["code"]), D.removed_rows(*sides, ["code"])
    return listed(added, "added").unionByName(listed(removed, "removed"))


@query("data_diff_keyless", """
    WITH d AS (SELECT (SELECT count(*) FROM labels) - (SELECT count(*) FROM documents) AS n)
    SELECT greatest(n, 0) AS added, greatest(-n, 0) AS removed, CAST(0 AS BIGINT) AS changed FROM d""")
def data_diff_keyless(spark, sf_dir):
    return D.diff_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("data_diff_multiset", f"""
    WITH net AS ({_net_sql("documents", duck(I.DOCUMENTS_AFTER), "text, lang, source, n_chars")})
    SELECT text, lang, source, n_chars, CASE WHEN net > 0 THEN 'added' ELSE 'removed' END AS status, abs(net) AS copies
    FROM net""")
def data_diff_multiset(spark, sf_dir):
    return D.diff_multiset(
        table(spark, sf_dir, "documents").drop("doc_id"), derive(spark, sf_dir, I.DOCUMENTS_AFTER).drop("doc_id")
    )


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES))
def row_counts(spark, sf_dir):
    return D.row_counts(tables(spark, sf_dir))


@query("table_set", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS columns FROM {t}"
    for t in TABLES))
def table_set(spark, sf_dir):
    """All tables found in the folder, with their rows and columns."""
    found = load_tables(spark, sf_dir)
    columns = spark.createDataFrame([(t, len(df.columns)) for t, df in found.items()], "`table` string, columns bigint")
    return D.row_counts(found).join(columns, "table")


@query("data_diff_tables", f"""
    SELECT 'customer' AS "table", CAST(0 AS BIGINT) AS added, count(*) AS removed, CAST(0 AS BIGINT) AS changed
    FROM customer
    UNION ALL SELECT 'documents', 0, 0, count(*) FROM documents WHERE lang = 'de' HAVING count(*) > 0
    UNION ALL SELECT 'labels', count(*), 0, 0 FROM labels
    UNION ALL
    SELECT * FROM (
        SELECT 'orders',
               count(*) FILTER (o.o_orderkey IS NULL) AS a, count(*) FILTER (n.o_orderkey IS NULL) AS r,
               count(*) FILTER (o.o_orderkey IS NOT NULL AND n.o_orderkey IS NOT NULL AND {_differs(_VALUES)}) AS c
        FROM orders o FULL JOIN {_NEW} n ON o.o_orderkey = n.o_orderkey) WHERE a + r + c > 0""")
def data_diff_tables(spark, sf_dir):
    old = tables(spark, sf_dir, "customer", "documents", "events", "orders")
    new = {
        **tables(spark, sf_dir, "events", "labels"),
        "documents": derive(spark, sf_dir, I.DOCUMENTS_AFTER),
        "orders": derive(spark, sf_dir, I.ORDERS_AFTER),
    }
    keys = {"documents": ["doc_id"], "events": ["event_id"], "orders": I.ORDERS_KEYS}
    return D.diff_tables_data(old, new, keys)


@query("table_preview_page", """
    SELECT *, (SELECT count(*) FROM lineitem) AS total FROM lineitem
    ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 100 OFFSET 200""")
def table_preview_page(spark, sf_dir):
    rows, total = D.page(
        table(spark, sf_dir, "lineitem"),
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
        limit=100, offset=200,
    )
    return rows.withColumn("total", total.scalar())


_PLACED = """
    SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
                                          l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS position
    FROM lineitem"""


@query("table_pages", f"SELECT *, position // 100 AS page FROM ({_PLACED})")
def table_pages(spark, sf_dir):
    """The whole table cut into pages of 100 rows, over tied dates."""
    return O.pages(O.order_index(table(spark, sf_dir, "lineitem"), ["l_shipdate"]), 100)


@query("table_page_at", f"""
    SELECT p.* FROM ({_PLACED}) p, (SELECT count(*) AS n FROM lineitem)
    WHERE position < 100 OR position // 100 = n // 200 OR position >= n - n % 100 - 100""")
def table_page_at(spark, sf_dir):
    """The first page, the one in the middle and the last two, each read through the index."""
    index = O.order_index(table(spark, sf_dir, "lineitem"), ["l_shipdate"])
    n = index.total()
    wanted = [(0, 100), (n // 200 * 100, 100), (max(n - n % 100 - 100, 0), 200)]
    return reduce(DataFrame.unionByName, [O.page_at(index, *page) for page in wanted])
