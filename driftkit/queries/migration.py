"""Migration plans, their risks, and rebuilt tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkit.functions import risk_text
from driftkit.operators import dependencies as Y
from driftkit.operators import layout as C
from driftkit.operators import migration as G
from driftkit.operators import narrowing as N
from driftkit.queries import inputs as I
from driftkit.queries.base import derive, duck, query, table
from driftkit.queries.schema import diff_ctes, live_changes, of_fleet
from driftkit.sources.catalog import catalog

_PLAN = f"""
    WITH {diff_ctes()},
    defs AS (
        SELECT database, "table",
               string_agg("column" || ' ' || type || CASE WHEN not_null THEN ' NOT NULL' ELSE '' END
                          || coalesce(' DEFAULT ' || default_value, ''), ', ' ORDER BY ordinal) AS definition,
               coalesce(string_agg("column", ',' ORDER BY pk) FILTER (pk > 0), '') AS key
        FROM n GROUP BY database, "table"),
    t AS (
        SELECT database, "table",
               bool_or(kind IN ('column removed', 'column type changed')) AS rebuild,
               string_agg(CASE kind WHEN 'column removed' THEN 'remove column ' || subject
                                    WHEN 'column type changed' THEN 'change ' || subject || ' type ' || detail
                                    ELSE 'add column ' || subject END, ', '
                          ORDER BY CASE kind WHEN 'column removed' THEN 1 WHEN 'column type changed' THEN 2 ELSE 3 END,
                                   subject) FILTER (kind LIKE 'column%') AS described,
               string_agg('drops column ' || "table" || '.' || subject || ' and its data', '; ' ORDER BY subject)
                   FILTER (kind = 'column removed') AS losses
        FROM changes GROUP BY database, "table"),
    s AS (
        SELECT database, "table", 1 AS part, '' AS ord, 'create table' AS action, key, definition AS detail,
               NULL AS warning
        FROM tables JOIN defs USING (database, "table") WHERE kind = 'table added'
        UNION ALL SELECT database, "table", 1, '', 'drop table', NULL, NULL,
                         'drops table ' || "table" || ' and ALL its data permanently'
        FROM tables WHERE kind = 'table removed'
        UNION ALL SELECT database, "table", 1, '', 'rebuild table', key, described, losses
        FROM t JOIN defs USING (database, "table") WHERE rebuild
        UNION ALL SELECT database, "table", 1, subject, 'add column', NULL, subject, NULL
        FROM columns JOIN t USING (database, "table") WHERE kind = 'column added' AND NOT rebuild
        UNION ALL SELECT database, "table", 2, subject, 'drop index', NULL, subject, NULL
        FROM indexes WHERE kind = 'index removed'
        UNION ALL SELECT database, "table", 3, subject, 'note new index', NULL, subject, NULL
        FROM indexes WHERE kind = 'index added'),
    plan AS (
        SELECT database, CAST(row_number() OVER (PARTITION BY database ORDER BY "table", part, ord) AS INT) AS step,
               "table", action, key, detail, warning FROM s)"""


def _plan(spark, sf_dir):
    (live,), _ = of_fleet(spark, sf_dir, I.LIVE)
    plan = G.migration_plan(live_changes(spark, sf_dir), live)
    return plan.withColumn("key", F.array_join("key", ","))


@query("migration_plan", _PLAN + "SELECT * FROM plan")
def migration_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


def _levels(tables, fks):
    """CTEs up to ``levels``: what reaches what, components of what reaches itself, longest ways between them."""
    return f"""
    every AS (SELECT DISTINCT database, "table" FROM {duck(tables)}),
    edges AS (SELECT DISTINCT f.database, f."table" AS child, f.parent FROM {duck(fks)} f
              SEMI JOIN every a ON a.database = f.database AND a."table" = f."table"
              SEMI JOIN every b ON b.database = f.database AND b."table" = f.parent WHERE f."table" <> f.parent),
    ways AS (SELECT database, child, parent FROM edges UNION
             SELECT w.database, w.child, e.parent FROM ways w JOIN edges e ON w.database = e.database AND w.parent = e.child),
    mutual AS (SELECT w.database, w.child AS "table", min(w.parent) AS other FROM ways w
               JOIN ways b ON w.database = b.database AND w.child = b.parent AND w.parent = b.child AND w.child <> w.parent GROUP BY ALL),
    members AS (SELECT e.database, e."table", least(e."table", coalesce(other, e."table")) AS component, other IS NOT NULL AS in_cycle
                FROM every e LEFT JOIN mutual m ON e.database = m.database AND e."table" = m."table"),
    over_edges AS (SELECT DISTINCT e.database, c.component AS child, p.component AS parent FROM edges e
              JOIN members c ON c.database = e.database AND c."table" = e.child
              JOIN members p ON p.database = e.database AND p."table" = e.parent WHERE c.component <> p.component),
    climbs AS (SELECT DISTINCT database, component, 0 AS level FROM members UNION
               SELECT o.database, o.child, level + 1 FROM climbs c JOIN over_edges o ON o.database = c.database AND o.parent = c.component),
    levels AS (SELECT m.database, m."table", CAST(max(level) AS INT) AS level, m.component, m.in_cycle
               FROM members m JOIN climbs c ON c.database = m.database AND c.component = m.component GROUP BY ALL)"""


@query("dependency_levels", f"WITH RECURSIVE {_levels(I.LINE_TABLES, I.LINE_KEYS)} SELECT * FROM levels")
def dependency_levels(spark, sf_dir):
    return Y.dependency_levels(derive(spark, sf_dir, I.LINE_TABLES), derive(spark, sf_dir, I.LINE_KEYS))


@query("migration_order", _PLAN.replace("WITH ", f"WITH RECURSIVE {_levels(I.FLEET_TABLES, I.FLEET_KEYS)}, ", 1).replace(
    'PARTITION BY database ORDER BY "table", part, ord', f"""PARTITION BY database ORDER BY
        CASE action WHEN 'create table' THEN 0 WHEN 'drop table' THEN 2 ELSE 1 END,
        (SELECT CASE action WHEN 'drop table' THEN -level ELSE level END FROM levels l
         WHERE l.database = s.database AND l."table" = s."table"), "table", part, ord""") + "SELECT * FROM plan")
def migration_order(spark, sf_dir):
    """The plan with tables created after those they refer to and dropped before them."""
    levels = Y.dependency_levels(derive(spark, sf_dir, I.FLEET_TABLES), derive(spark, sf_dir, I.FLEET_KEYS))
    (live,), _ = of_fleet(spark, sf_dir, I.LIVE)
    plan = G.migration_plan(live_changes(spark, sf_dir), live, levels)
    return plan.withColumn("key", F.array_join("key", ","))


@query("migration_warnings", _PLAN + "SELECT * FROM plan WHERE warning IS NOT NULL")
def migration_warnings(spark, sf_dir):
    return G.plan_warnings(_plan(spark, sf_dir))


# Rows per table before the migration; tables of the smaller customers are not known.
# The rows of a table are the lines of its orders: none for some, unknown for tables that are new.
_ROWS = """
    SELECT concat('cust_', o_custkey) AS database, concat('orders_', lower(o_orderstatus)) AS "table", count(l_orderkey) AS rows
    FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderstatus"""


@query("migration_risks", f"""
    WITH {diff_ctes()}, counts AS {duck(_ROWS)},
    r AS (
        SELECT database, "table", subject, detail, old_not_null, new_not_null,
               CASE WHEN kind = 'table removed' THEN 'DROP TABLE' WHEN kind = 'column removed' THEN 'DROP COLUMN'
                    WHEN kind = 'column type changed' AND old_type <> new_type THEN 'TYPE CHANGE'
                    WHEN kind = 'column type changed' THEN 'NULLABILITY CHANGE'
                    WHEN kind = 'column added' AND new_not_null AND new_default IS NULL THEN 'ADD COLUMN' END AS risk
        FROM (SELECT c.* REPLACE (k.not_null AS new_not_null, k.default_value AS new_default)
              FROM changes c LEFT JOIN n k ON c.database = k.database AND c."table" = k."table" AND c.subject = k."column"))
    SELECT database, "table", risk, d || coalesce(' (' || rows || ' rows affected)', '') AS description, rows
    FROM (SELECT r.database, r."table", risk, rows,
                 CASE risk WHEN 'DROP TABLE' THEN 'DROP TABLE ' || r."table" || ' — all data permanently lost'
                           WHEN 'DROP COLUMN' THEN 'DROP COLUMN ' || r."table" || '.' || subject
                                                   || ' — column data permanently lost'
                           WHEN 'TYPE CHANGE' THEN 'TYPE CHANGE ' || r."table" || '.' || subject || ' ' || detail
                                                   || ' — values may be coerced'
                           WHEN 'NULLABILITY CHANGE' THEN 'NULLABILITY CHANGE ' || r."table" || '.' || subject || ' '
                                || CASE WHEN old_not_null THEN 'NOT NULL→NULL' ELSE 'NULL→NOT NULL' END
                           ELSE 'ADD COLUMN ' || r."table" || '.' || subject
                                || ' NOT NULL without DEFAULT — rebuild will fail on existing rows' END AS d
          FROM r LEFT JOIN counts c ON r.database = c.database AND r."table" = c."table"
          WHERE risk IS NOT NULL AND (risk <> 'ADD COLUMN' OR rows > 0))""")
def migration_risks(spark, sf_dir):
    risks = G.migration_risks(live_changes(spark, sf_dir), derive(spark, sf_dir, _ROWS))
    return risks.withColumn("description", risk_text(F.col("description"), F.col("rows")))


# A table as text, as a loose database would keep it.
_LOOSE_ORDERS = """
    SELECT concat('', o_orderkey) AS o_orderkey,
           CASE o_orderpriority WHEN '1-URGENT' THEN concat('0', o_custkey) WHEN '5-LOW' THEN concat('c', o_custkey)
                                ELSE concat('', o_custkey) END AS o_custkey,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice,
           o_orderstatus, o_orderpriority
    FROM {orders}"""
_LOOSE = duck(_LOOSE_ORDERS)


@query("coercion_loss", f"""
    SELECT 'o_orderkey' AS "column", 'bigint' AS new_type, count(*) AS rows, CAST(0 AS BIGINT) AS lost,
           CAST(0 AS BIGINT) AS altered FROM {_LOOSE}
    UNION ALL
    SELECT 'o_custkey', 'bigint', count(*),
           count(*) FILTER (o_custkey IS NOT NULL AND TRY_CAST(o_custkey AS BIGINT) IS NULL),
           count(*) FILTER (CAST(TRY_CAST(o_custkey AS BIGINT) AS VARCHAR) <> o_custkey) FROM {_LOOSE}
    UNION ALL
    SELECT 'o_totalprice', 'bigint', count(*), 0, count(*) FILTER (trunc(o_totalprice) <> o_totalprice) FROM {_LOOSE}
    UNION ALL
    SELECT 'o_orderstatus', 'int', count(*), count(*), 0 FROM {_LOOSE}""")
def coercion_loss(spark, sf_dir):
    return G.coercion_loss(
        derive(spark, sf_dir, _LOOSE_ORDERS),
        {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "bigint", "o_orderstatus": "int"},
    )


# Lines with some columns as text, as a dump holds them.
_DUMPED = """
    SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_shipdate, l_returnflag,
           concat('', l_partkey) AS part_text, concat('', CAST(l_tax AS DECIMAL(12,2))) AS tax_text,
           concat('', CAST(l_shipdate AS DATE)) AS day_text, concat('0', l_suppkey) AS padded,
           CASE WHEN l_linestatus = 'F' THEN 'true' ELSE 'false' END AS final, CAST(l_extendedprice AS DECIMAL(38,10)) AS price,
           CASE WHEN l_returnflag = 'never' THEN l_tax END AS empty
    FROM {lineitem}"""


def _narrow(column, own, *choices):
    """The first of the choices (type, what rules a value out) that no value rules out."""
    cases = " ".join(f"WHEN count(*) FILTER ({column} IS NOT NULL AND ({out})) = 0 THEN '{t}'" for t, out in choices)
    return f"""
        SELECT '{column}' AS "column", '{own}' AS type, CASE WHEN count({column}) = 0 THEN 'void' {cases} ELSE '{own}' END AS narrowest,
               count(*) AS rows, count(*) - count({column}) AS nulls FROM d"""


def _wholes(value):
    return [(t, f"{value} NOT BETWEEN -{1 << b} AND {(1 << b) - 1}") for t, b in (("tinyint", 7), ("smallint", 15), ("int", 31))]


@query("narrowest_types", f"WITH d AS {duck(_DUMPED)}" + " UNION ALL ".join([
    _narrow("l_orderkey", "bigint", *_wholes("l_orderkey")), _narrow("l_linenumber", "int", *_wholes("l_linenumber")[:2]),
    _narrow("l_quantity", "double", *[(t, f"l_quantity <> trunc(l_quantity) OR {out}") for t, out in _wholes("l_quantity")],
            ("float", "CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) <> l_quantity")),
    _narrow("l_tax", "double", *[(t, f"l_tax <> trunc(l_tax) OR {out}") for t, out in _wholes("l_tax")],
            ("float", "CAST(CAST(l_tax AS FLOAT) AS DOUBLE) <> l_tax")),
    _narrow("l_shipdate", "timestamp_ntz", ("date", "CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) <> l_shipdate")),
    _narrow("l_returnflag", "string"), _narrow("part_text", "string", *_wholes("CAST(part_text AS BIGINT)")),
    _narrow("tax_text", "string", ("decimal(2,2)", "CAST(tax_text AS DECIMAL(12,2)) >= 1")),
    _narrow("day_text", "string", ("date", "CAST(CAST(day_text AS DATE) AS VARCHAR) <> day_text")), _narrow("padded", "string"),
    _narrow("final", "string", ("boolean", "final NOT IN ('true', 'false')")), _narrow("empty", "double"),
    """
        SELECT 'price', 'decimal(38,10)', 'decimal(' || (max(length(CAST(trunc(price) AS VARCHAR)) - CASE WHEN price < 1 THEN 1 ELSE 0 END
               - position('.' IN reverse(CAST(trunc(price) AS VARCHAR)))) + max(length(rtrim(split_part(CAST(price AS VARCHAR), '.', 2), '0'))))
               || ',' || max(length(rtrim(split_part(CAST(price AS VARCHAR), '.', 2), '0'))) || ')', count(*), 0 FROM d"""]))
def narrowest_types(spark, sf_dir):
    return N.narrowest_types(derive(spark, sf_dir, _DUMPED))


_TARGET = T.StructType([
    T.StructField("o_orderkey", T.LongType(), False),
    T.StructField("region", T.StringType(), False),
    T.StructField("o_custkey", T.LongType()),
    T.StructField("o_totalprice", T.LongType()),
    T.StructField("note", T.StringType()),
])


@query("rebuild_table", f"""
    SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, 'none' AS region, TRY_CAST(o_custkey AS BIGINT) AS o_custkey,
           CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice, CAST(NULL AS VARCHAR) AS note FROM {_LOOSE}""")
def rebuild_table(spark, sf_dir):
    return G.rebuild_table(derive(spark, sf_dir, _LOOSE_ORDERS), _TARGET, {"region": "none"}, on_bad="null")


# What orders are declared to look like, with two columns that the loose table lacks.
_DECLARED = """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 'none' AS region, CAST(0.5 AS DOUBLE) AS share FROM {orders}"""


def _orders_layout(spark, sf_dir):
    declared = catalog(
        spark, {"orders": derive(spark, sf_dir, _DECLARED)}, "main", {"orders": ["o_orderkey"]},
        {"orders": {"region": "concat('no', 'ne')", "share": "1 / 4"}},
    )
    return C.compile_layouts(declared.withColumn("not_null", F.col("column") == "o_totalprice"))["orders"]


@query("rebuild_from_catalog", f"""
    SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, TRY_CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, o_totalprice,
           CAST(NULL AS TIMESTAMP) AS o_orderdate, o_orderpriority, 'none' AS region, CAST(0.25 AS DOUBLE) AS share
    FROM {_LOOSE}""")
def rebuild_from_catalog(spark, sf_dir):
    """A loose table in the layout that a catalog declares for it."""
    layout = _orders_layout(spark, sf_dir)
    return G.rebuild_table(derive(spark, sf_dir, _LOOSE_ORDERS), layout.schema, layout.defaults, on_bad="null")


@query("dry_run_from_catalog", f"""
    SELECT o_orderpriority, count(*) AS rows, count(*) FILTER (TRY_CAST(o_custkey AS BIGINT) IS NULL) AS lost_casts,
           count(*) FILTER (o_totalprice IS NULL) AS null_violations, CAST(0 AS BIGINT) AS duplicate_keys,
           CAST(0 AS BIGINT) AS orphan_rows,
           count(*) FILTER (TRY_CAST(o_custkey AS BIGINT) IS NULL OR o_totalprice IS NULL) = 0 AS ok
    FROM {_LOOSE} GROUP BY o_orderpriority""")
def dry_run_from_catalog(spark, sf_dir):
    layout = _orders_layout(spark, sf_dir)
    loose = derive(spark, sf_dir, _LOOSE_ORDERS)
    return G.migration_dry_run(loose, layout.schema, "o_orderpriority", layout.defaults, layout.key)


# Parts as columns of a database per brand, in types of several engines and some that are none; names repeat but for case.
_FOREIGN_CATALOG = """
    SELECT p_brand AS database, concat('t', p_size) AS "table",
           CASE WHEN p_retailprice < 1000 THEN upper(p_name) ELSE p_name END AS "column",
           CASE p_type WHEN 'SMALL' THEN 'INTEGER' WHEN 'LARGE' THEN 'decimal(12,2)' WHEN 'MEDIUM' THEN 'VARCHAR(20)'
                       WHEN 'PROMO' THEN 'decimal(12,99)' WHEN 'ECONOMY' THEN 'array<text' ELSE 'TEXT' END AS type
    FROM {part}"""


@query("layout_problems", f"""
    WITH c AS {duck(_FOREIGN_CATALOG)}
    SELECT DISTINCT database, "table", "column", 'unreadable type ' || type AS problem FROM c
    WHERE type IN ('decimal(12,99)', 'array<text')
    UNION ALL
    SELECT database, "table", min("column"), 'repeated column' FROM c GROUP BY database, "table", lower("column") HAVING count(*) > 1""")
def layout_problems(spark, sf_dir):
    return C.layout_problems(derive(spark, sf_dir, _FOREIGN_CATALOG))


_STRICT = T.StructType([
    T.StructField("o_orderkey", T.LongType(), False),
    T.StructField("o_custkey", T.LongType()),
    T.StructField("o_totalprice", T.DoubleType(), False),
    T.StructField("o_orderpriority", T.StringType()),
])
_MEMBERS = _LOOSE_ORDERS.replace(
    "FROM {orders}", ", CASE WHEN o_orderdate < DATE '1996-01-01' THEN 'old' ELSE o_orderpriority END AS member FROM {orders}"
)
# Each member's own list of known parties.
_PARTIES = """
    SELECT DISTINCT o_orderpriority AS member, concat('', o_custkey) AS party FROM {orders}
    UNION ALL SELECT 'old' AS member, concat('', c_custkey) AS party FROM {customer}"""


@query("migration_dry_run", f"""
    WITH m AS {duck(_MEMBERS)}, p AS {duck(_PARTIES)},
    k AS (SELECT member, count(*) AS n FROM (
              SELECT member FROM m WHERE TRY_CAST(o_custkey AS BIGINT) IS NOT NULL
              GROUP BY member, TRY_CAST(o_custkey AS BIGINT), o_orderstatus
              HAVING count(*) > 1) GROUP BY member),
    f AS (SELECT member, count(*) AS n FROM m WHERE TRY_CAST(o_custkey AS BIGINT) IS NOT NULL AND NOT EXISTS (
              SELECT 1 FROM p WHERE p.member = m.member AND TRY_CAST(p.party AS BIGINT) = TRY_CAST(m.o_custkey AS BIGINT))
          GROUP BY member),
    b AS (SELECT member, count(*) AS rows, count(*) FILTER (TRY_CAST(o_custkey AS BIGINT) IS NULL) AS lost_casts,
                 count(*) FILTER (o_totalprice IS NULL) AS null_violations FROM m GROUP BY member)
    SELECT b.member AS member, rows, lost_casts, null_violations, coalesce(k.n, 0) AS duplicate_keys,
           coalesce(f.n, 0) AS orphan_rows,
           lost_casts + null_violations + coalesce(k.n, 0) + coalesce(f.n, 0) = 0 AS ok
    FROM b LEFT JOIN k ON b.member = k.member LEFT JOIN f ON b.member = f.member""")
def migration_dry_run(spark, sf_dir):
    return G.migration_dry_run(
        derive(spark, sf_dir, _MEMBERS), _STRICT, "member", keys=["o_custkey", "o_orderstatus"],
        parents=[G.Parent(("o_custkey",), derive(spark, sf_dir, _PARTIES), ("party",))],
    )


@query("rollout_dry_run", """
    SELECT c_mktsegment, count(*) AS rows, CAST(0 AS BIGINT) AS lost_casts,
           count(*) FILTER (c_acctbal < 0 AND c_mktsegment = 'BUILDING') AS null_violations,
           CAST(0 AS BIGINT) AS duplicate_keys, CAST(0 AS BIGINT) AS orphan_rows,
           count(*) FILTER (c_acctbal < 0 AND c_mktsegment = 'BUILDING') = 0 AS ok,
           CASE WHEN count(*) FILTER (c_acctbal < 0 AND c_mktsegment = 'BUILDING') = 0 THEN 'dry-run' ELSE 'failed'
           END AS state
    FROM customer GROUP BY c_mktsegment""")
def rollout_dry_run(spark, sf_dir):
    members = table(spark, sf_dir, "customer").withColumn(
        "c_acctbal", F.when((F.col("c_acctbal") >= 0) | (F.col("c_mktsegment") != "BUILDING"), F.col("c_acctbal"))
    )
    target = T.StructType([
        T.StructField("c_custkey", T.StringType(), False), T.StructField("c_acctbal", T.DoubleType(), False),
    ])
    return G.rollout_dry_run(members, target, "c_mktsegment", keys=["c_custkey"])


@query("migration_dry_run_lines", """
    SELECT l_shipdate, count(*) AS rows, CAST(0 AS BIGINT) AS lost_casts, CAST(0 AS BIGINT) AS null_violations,
           CAST(0 AS BIGINT) AS duplicate_keys, CAST(0 AS BIGINT) AS orphan_rows, true AS ok
    FROM lineitem GROUP BY l_shipdate""")
def migration_dry_run_lines(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    target = T.StructType([
        T.StructField("l_orderkey", T.StringType(), False), T.StructField("l_quantity", T.IntegerType(), False),
    ])
    return G.migration_dry_run(
        lines, target, "l_shipdate", parents=[G.Parent(("l_orderkey",), orders, ("o_orderkey",))]
    )
