"""Catalogs and schema comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftkit.operators import data_diff as D
from driftkit.operators import schema_diff as S
from driftkit.queries import inputs as I
from driftkit.queries.base import TABLES, derive, duck, query, tables, tasks
from driftkit.sources.catalog import catalog

# Unique keys of the given tables.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"],
    "labels": ["doc_id"], "pages": ["page_id"], "embeddings": ["vec_id"], "benchmark": ["item_id"],
    "conversations": ["conv_id", "turn"],
}

_PK = " ".join(
    f"WHEN table_name = '{t}' AND column_name = '{c}' THEN {i + 1}" for t, cols in KEYS.items() for i, c in enumerate(cols)
)
_ROWS = " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in TABLES)


@query("catalog_capture", f"""
    SELECT 'main' AS database, table_name AS "table", CAST(ordinal_position AS INT) AS ordinal,
           column_name AS "column",
           CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
                          WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS type,
           false AS not_null, CAST(CASE {_PK} ELSE 0 END AS INT) AS pk, n AS rows
    FROM information_schema.columns JOIN ({_ROWS}) ON table_name = t""")
def catalog_capture(spark, sf_dir):
    loaded = tables(spark, sf_dir)
    return (
        catalog(spark, loaded, "main", KEYS)
        .join(D.row_counts(loaded), "table")
        .select("database", "table", "ordinal", "column", "type", "not_null", "pk", "rows")
    )


@query("user_tables", f"""
    SELECT database, "table", "column", type FROM {duck(I.INTERNAL_TABLES)}
    WHERE NOT starts_with("table", 'sqlite_') AND NOT starts_with("table", '_cf_')""")
def user_tables(spark, sf_dir):
    return S.user_tables(derive(spark, sf_dir, I.INTERNAL_TABLES)).select("database", "table", "column", "type")


def of_fleet(spark, sf_dir, *texts):
    """Inputs drawn from the orders of each customer, and the partitions to compare them in.

    The orders lie by customer in as many partitions as their number asks for, which
    serves the grouping of each input.
    """
    n = tasks(spark, sf_dir, "orders")
    return [derive(spark, sf_dir, t, {"orders": (n, "o_custkey")}) for t in texts], n


def _pair(spark, sf_dir):
    return of_fleet(spark, sf_dir, I.BASELINE, I.LIVE)


def _all(spark, sf_dir):
    return of_fleet(spark, sf_dir, I.BASELINE, I.LIVE, I.BASELINE_INDEXES, I.LIVE_INDEXES)


def diff_ctes(old=I.BASELINE, new=I.LIVE, old_indexes=I.BASELINE_INDEXES, new_indexes=I.LIVE_INDEXES, p=""):
    """CTEs up to ``{p}changes``, the change list of two catalogs."""
    return f"""
    {p}o AS {duck(old)}, {p}n AS {duck(new)}, {p}oi AS {duck(old_indexes)}, {p}ni AS {duck(new_indexes)},
    {p}ot AS (SELECT database, "table", count(*) AS columns FROM {p}o GROUP BY ALL),
    {p}nt AS (SELECT database, "table", count(*) AS columns FROM {p}n GROUP BY ALL),
    {p}tables AS (
        SELECT database, "table", 'table added' AS kind, columns FROM {p}nt ANTI JOIN {p}ot USING (database, "table")
        UNION ALL
        SELECT database, "table", 'table removed', columns FROM {p}ot ANTI JOIN {p}nt USING (database, "table")),
    {p}shared AS (SELECT database, "table" FROM {p}ot JOIN {p}nt USING (database, "table")),
    {p}columns AS (
        SELECT database, "table", "column" AS subject,
               CASE WHEN {p}o.type IS NULL THEN 'column added' WHEN {p}n.type IS NULL THEN 'column removed'
                    ELSE 'column type changed' END AS kind,
               {p}o.type AS old_type, {p}n.type AS new_type,
               {p}o.not_null AS old_not_null, {p}n.not_null AS new_not_null,
               {p}n.default_value AS new_default
        FROM {p}o FULL JOIN {p}n USING (database, "table", "column") SEMI JOIN {p}shared USING (database, "table")
        WHERE {p}o.type IS NULL OR {p}n.type IS NULL OR {p}o.type <> {p}n.type OR {p}o.not_null <> {p}n.not_null),
    {p}indexes AS (
        SELECT database, "table", "index" AS subject,
               CASE WHEN {p}oi.is_unique IS NULL THEN 'index added' ELSE 'index removed' END AS kind,
               {p}ni.is_unique AS is_unique
        FROM {p}oi FULL JOIN {p}ni USING (database, "table", "index") SEMI JOIN {p}shared USING (database, "table")
        WHERE {p}oi.is_unique IS NULL OR {p}ni.is_unique IS NULL),
    {p}changes AS (
        SELECT database, kind, "table", NULL AS subject, NULL AS detail, NULL AS old_type, NULL AS new_type,
               NULL AS old_not_null, NULL AS new_not_null, NULL AS new_default, NULL AS is_unique FROM {p}tables
        UNION ALL
        SELECT database, kind, "table", subject,
               CASE WHEN kind = 'column type changed' THEN old_type || '→' || new_type END,
               old_type, new_type, old_not_null, new_not_null, new_default, NULL FROM {p}columns
        UNION ALL
        SELECT database, kind, "table", subject, NULL, NULL, NULL, NULL, NULL, NULL, is_unique FROM {p}indexes)"""


CHANGES = f"WITH {diff_ctes()}"


def live_changes(spark, sf_dir):
    """Changes of the fleet from its baseline to its live state."""
    inputs, n = _all(spark, sf_dir)
    return S.schema_diff(*inputs, partitions=n)


def flat(changes):
    """The change table with one column per compared property."""
    return changes.select(
        "database", "kind", "table", "subject", "detail",
        F.col("old.type").alias("old_type"), F.col("new.type").alias("new_type"),
        F.col("old.not_null").alias("old_not_null"), F.col("new.not_null").alias("new_not_null"),
    )


@query("schema_diff_tables", CHANGES + """SELECT database, kind, "table", columns FROM tables""")
def schema_diff_tables(spark, sf_dir):
    inputs, _ = _pair(spark, sf_dir)
    return S.diff_tables(*inputs)


_FLAT = 'database, kind, "table", subject, detail, old_type, new_type, old_not_null, new_not_null'


@query("schema_diff_columns", CHANGES + f"SELECT {_FLAT} FROM changes WHERE kind LIKE 'column%'")
def schema_diff_columns(spark, sf_dir):
    inputs, n = _pair(spark, sf_dir)
    return flat(S.diff_columns(*inputs, partitions=n))


@query("index_diff", CHANGES + """SELECT database, kind, "table", subject FROM indexes""")
def index_diff(spark, sf_dir):
    (old, new, old_indexes, new_indexes), n = _all(spark, sf_dir)
    changes = S.diff_indexes(old_indexes, new_indexes, old, new, partitions=n)
    return changes.select("database", "kind", "table", "subject")


@query("change_list", CHANGES + f"SELECT {_FLAT} FROM changes")
def change_list(spark, sf_dir):
    return flat(live_changes(spark, sf_dir))


# Counts of rows per database and table, and how they moved.
TABLE_ROWS = """
    SELECT concat('cust_', o_custkey) AS database, concat('orders_', lower(o_orderstatus)) AS "table",
           count(CASE WHEN o_totalprice >= 400000 THEN 1 END) AS added,
           count(CASE WHEN o_totalprice < 20000 THEN 1 END) AS removed, CAST(0 AS BIGINT) AS changed
    FROM {orders} GROUP BY o_custkey, o_orderstatus"""


@query("change_summary", CHANGES + f"""
    , d AS {duck(TABLE_ROWS)},
    s AS (SELECT database, count(*) FILTER (kind = 'table added') AS tables_added,
                 count(*) FILTER (kind = 'table removed') AS tables_removed,
                 count(DISTINCT "table") FILTER (kind NOT LIKE 'table%') AS tables_modified
          FROM changes GROUP BY database),
    w AS (SELECT database, count(*) FILTER (added + removed + changed > 0) AS n FROM d GROUP BY database)
    SELECT database, coalesce(tables_added, 0) AS tables_added, coalesce(tables_removed, 0) AS tables_removed,
           coalesce(tables_modified, 0) AS tables_modified, coalesce(n, 0) AS tables_with_data_changes
    FROM s FULL JOIN w USING (database)""")
def change_summary(spark, sf_dir):
    return S.change_summary(live_changes(spark, sf_dir), derive(spark, sf_dir, TABLE_ROWS))


@query("change_detail", CHANGES + """
    SELECT database, "table", count(*) FILTER (kind LIKE 'column%') AS column_changes,
           count(*) FILTER (kind LIKE 'index%') AS index_changes
    FROM changes WHERE kind NOT LIKE 'table%' GROUP BY database, "table" """)
def change_detail(spark, sf_dir):
    return S.change_detail(live_changes(spark, sf_dir))


@query("verify_schema", f"""
    WITH {diff_ctes(old=I.LATE, new=I.LIVE, old_indexes=I.LATE_INDEXES)},
    known AS (SELECT database FROM o UNION SELECT database FROM n),
    bad AS (SELECT database, count(DISTINCT "table") AS n FROM changes GROUP BY database)
    SELECT database, coalesce(n, 0) AS tables_differing, n IS NULL AS matches FROM known LEFT JOIN bad USING (database)""")
def verify_schema(spark, sf_dir):
    inputs, n = of_fleet(spark, sf_dir, I.LATE, I.LIVE, I.LATE_INDEXES, I.LIVE_INDEXES)
    return S.verify_schema(*inputs, partitions=n)
