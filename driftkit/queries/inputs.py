"""Versions of tables, catalogs and fleets derived from the given tables.

Every input reads its whole tables. A later version of a table re-keys some
rows (which removes and adds them) and edits others; nothing is filtered out.
"""

ORDERS_KEYS = ["o_orderkey"]

ORDERS_AFTER = """
    SELECT CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
                THEN -1 - o_orderkey ELSE o_orderkey END AS o_orderkey,
           o_custkey, o_orderstatus,
           CASE WHEN o_orderstatus <> 'P' AND o_orderpriority = '5-LOW'
                THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
           o_orderdate,
           CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('3-MEDIUM', '5-LOW')
                THEN '9-LATER' ELSE o_orderpriority END AS o_orderpriority
    FROM {orders}"""

# The key as text, one column gone, one new: what a dump and reload leaves behind.
ORDERS_RELOADED = """
    SELECT CASE WHEN o_orderpriority = '2-HIGH' THEN concat('x', o_orderkey)
                ELSE concat('', o_orderkey) END AS o_orderkey,
           CASE WHEN o_orderstatus = 'F' THEN concat('0', o_custkey)
                ELSE concat('', o_custkey) END AS o_custkey,
           o_orderstatus, o_orderpriority, 1 AS batch
    FROM {orders}"""

EVENTS_AFTER = """
    SELECT event_id, ts,
           CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS user_id,
           event_type, value,
           CASE WHEN event_type = 'signup' THEN concat(props, ' ') ELSE props END AS props
    FROM {events}"""

DOCUMENTS_AFTER = """
    SELECT doc_id,
           CASE WHEN lang = 'de' THEN concat(text, '.') ELSE text END AS text,
           lang, source,
           CASE WHEN lang = 'de' THEN n_chars + 1 ELSE n_chars END AS n_chars
    FROM {documents}"""

LINEITEM_KEYS = ["l_orderkey", "l_linenumber"]

LINEITEM_AFTER = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CASE WHEN l_returnflag = 'R' THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag,
           CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN NULL ELSE l_linestatus END AS l_linestatus,
           l_shipdate
    FROM {lineitem}"""

# NULL keys and NULL values on both sides.
CUSTOMER_NULLS_BEFORE = """
    SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_custkey END AS c_custkey,
           c_name, c_nationkey,
           CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment
    FROM {customer}"""

CUSTOMER_NULLS_AFTER = """
    SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_custkey END AS c_custkey,
           c_name, c_nationkey,
           CASE WHEN c_acctbal < 100 THEN NULL ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS c_mktsegment
    FROM {customer}"""

# A fleet: each customer is a database, its order states are tables, the
# priorities seen are columns typed by the prices seen, the months are indexes.
# Every version is drawn from all orders; a later one files the dearer orders
# under other tables, columns and indexes, which adds, removes and retypes some.
def _dearer(limit: int | None, condition: str, then: str, usual: str) -> str:
    return f"CASE WHEN {condition} AND o_totalprice >= {limit} THEN {then} ELSE {usual} END" if limit else usual


def _status(limit: int | None) -> str:
    return _dearer(limit, "o_orderstatus = 'P'", "'X'", "o_orderstatus")


def _priority(limit: int | None) -> str:
    return _dearer(limit, "o_orderstatus = 'F'", "'9-LATER'", "o_orderpriority")


def _month(limit: int | None) -> str:
    return _dearer(limit, "o_orderdate IS NOT NULL", "12 + month(o_orderdate)", "month(o_orderdate)")


def fleet_table(limit: int | None) -> str:
    """The name of the table an order belongs to."""
    return f"concat('orders_', lower({_status(limit)}))"


def catalog_of(limit: int | None, days: int) -> str:
    return f"""
    SELECT concat('cust_', o_custkey) AS database, {fleet_table(limit)} AS "table",
           CAST(substr({_priority(limit)}, 1, 1) AS INT) AS ordinal, {_priority(limit)} AS "column",
           CASE WHEN max(o_totalprice) >= 400000 THEN 'decimal(12,2)'
                WHEN max(o_totalprice) >= 200000 THEN 'double' ELSE 'int' END AS type,
           min(o_totalprice) >= {145000 if limit else 150000} AS not_null,
           CASE WHEN count(*) > 1 THEN '0' ELSE NULL END AS default_value,
           CASE WHEN substr({_priority(limit)}, 1, 1) = '1' THEN 1 ELSE 0 END AS pk,
           max(max(o_orderdate)) OVER (PARTITION BY o_custkey) + INTERVAL '{days}' DAY AS captured_at,
           CAST(NULL AS STRING) AS error
    FROM {{orders}}
    GROUP BY o_custkey, {_status(limit)}, {_priority(limit)}"""


def indexes_of(limit: int | None) -> str:
    return f"""
    SELECT concat('cust_', o_custkey) AS database, {fleet_table(limit)} AS "table",
           concat('ix_', {_month(limit)}) AS "index", count(*) = 1 AS is_unique
    FROM {{orders}}
    GROUP BY o_custkey, {_status(limit)}, {_month(limit)}"""


BASE_LIMIT, LIVE_LIMIT, LATE_LIMIT = None, 450000, 420000
BASELINE, BASELINE_INDEXES = catalog_of(BASE_LIMIT, 0), indexes_of(BASE_LIMIT)
LIVE, LIVE_INDEXES = catalog_of(LIVE_LIMIT, 30), indexes_of(LIVE_LIMIT)
LATE, LATE_INDEXES = catalog_of(LATE_LIMIT, 60), indexes_of(LATE_LIMIT)

# Event types as tables of a database per user, two of them internal.
INTERNAL_TABLES = """
    SELECT concat('user_', user_id) AS database,
           CASE event_type WHEN 'error' THEN 'sqlite_stat1' WHEN 'view' THEN '_cf_KV'
                           WHEN 'click' THEN 'sqliteXfoo' ELSE event_type END AS "table",
           CAST(1 AS INT) AS ordinal, 'value' AS "column",
           CASE WHEN max(value) >= 100 THEN 'double' ELSE 'float' END AS type
    FROM {events} GROUP BY user_id, event_type"""

# Backups: lineitem without its repeated keys, documents once per text, labels as the last one left.
LINEITEM_BACKUP = """
    SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice
    FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

DOCUMENTS_BACKUP = "SELECT text, min(doc_id) AS doc_id FROM {documents} GROUP BY text"

# Members of a fleet: the customers, spread over providers by their segment, and the suppliers.
REGISTRY = """
    SELECT c_custkey AS pos, concat('cust_', c_custkey) AS name,
           CASE c_mktsegment WHEN 'BUILDING' THEN concat('turso://tok', c_custkey, '@org/db', c_custkey)
                             WHEN 'MACHINERY' THEN concat('d1://tok@acc/', c_custkey)
                             ELSE concat('/fleet/', c_custkey, '.db') END AS dsn,
           CASE WHEN c_acctbal < 0 THEN NULL ELSE concat('/base/', c_custkey) END AS baseline,
           CASE WHEN c_acctbal < 500 THEN NULL ELSE split(concat(lower(c_mktsegment), ',nation:', c_nationkey), ',') END AS tags
    FROM {customer}
    UNION ALL
    SELECT -1 - s_suppkey AS pos, concat('supp_', s_suppkey) AS name, concat('/fleet/s', s_suppkey, '.db') AS dsn,
           NULL AS baseline, split('supplier', ',') AS tags
    FROM {supplier}"""

# Newcomers and updates: the buyers, in the order they bought, some with tags.
INCOMING = """
    SELECT o_orderkey AS pos, concat('cust_', o_custkey * 3) AS name, concat('/moved/', o_orderkey) AS dsn,
           concat('/base/o', o_orderkey) AS baseline,
           CASE o_orderstatus WHEN 'F' THEN split(concat('moved,', o_orderpriority), ',') ELSE NULL END AS tags
    FROM {orders}"""

# A registry kept without care: parts share names, some lack one, some lack an address.
CARELESS_REGISTRY = """
    SELECT CASE WHEN p_brand = 'Brand#1' THEN '' ELSE p_name END AS name,
           CASE WHEN p_type = 'SMALL' AND p_size > 40 THEN NULL ELSE concat('/fleet/', p_partkey, '.db') END AS dsn
    FROM {part}"""

# One snapshot of a customer's catalog per year with orders.
SNAPSHOTS = """
    SELECT concat('cust_', o_custkey) AS database, concat('orders_', lower(o_orderstatus)) AS "table",
           o_orderpriority AS "column", CAST(concat(year(o_orderdate), '-01-01') AS DATE) AS captured_at, count(*) AS seen,
           CASE WHEN min(o_totalprice) < 1500 THEN 'file is not a database' ELSE NULL END AS error
    FROM {orders} GROUP BY o_custkey, o_orderstatus, o_orderpriority, year(o_orderdate)"""

# Captures of many databases over the years: closed orders are one database, captured every day of an order, which
# is about half of all captures; the others are captured by month. Some captures could not be read.
_CAPTURED = """
    SELECT CASE WHEN o_orderstatus = 'F' THEN 'hot' ELSE concat('nation_', o_custkey % 25) END AS database,
           concat('orders_', lower(substr(o_orderpriority, 3, 3))) AS "table", o_orderstatus AS "column",
           o_totalprice AS price, o_orderdate,
           CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE)
                ELSE CAST(concat(year(o_orderdate), '-', lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0'), '-01') AS DATE)
           END AS captured_at
    FROM {orders}"""
CAPTURES = f"""
    SELECT database, "table", "column",
           CASE WHEN max(price) >= 400000 THEN 'decimal(12,2)' WHEN max(price) >= 100000 THEN 'double' ELSE 'int' END AS type,
           min(price) >= 200000 AS not_null, captured_at,
           CASE WHEN max(price) >= 499900 THEN 'unable to open database file' ELSE NULL END AS error
    FROM ({_CAPTURED}) AS o GROUP BY database, "table", "column", captured_at"""
# A baseline is the first capture of each year.
BASES = f"""
    SELECT * FROM (
        SELECT database, "table", "column", type, not_null, captured_at,
               min(captured_at) OVER (PARTITION BY database, year(captured_at)) AS first
        FROM ({CAPTURES}) AS c WHERE error IS NULL) AS f
    WHERE captured_at = first"""

# Incoming members of which the urgent ones have lost their position.
UNPLACED = """
    SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderkey END AS pos, concat('cust_', o_custkey * 3) AS name,
           concat('/moved/', o_orderkey) AS dsn, concat('/base/o', o_orderkey) AS baseline,
           CASE o_orderstatus WHEN 'F' THEN split(concat('moved,', o_orderpriority), ',') ELSE NULL END AS tags
    FROM {orders}"""

# Live catalogs with members that could not be read: customers deep in debt.
UNREADABLE = """
    SELECT concat('cust_', c_custkey) AS database, 'unable to open database file' AS error
    FROM {customer} WHERE c_acctbal < -500"""

# Checks of many sources: each event is a check, an error event found drift.
HISTORY = """
    SELECT concat('db_', user_id) AS source, ts AS checked_at, event_type = 'error' AS has_drift, event_id
    FROM {events}"""

# Outcomes of a rollout: each user is a fleet, each event a member.
OUTCOMES = """
    SELECT user_id AS fleet, event_id AS pos, event_type <> 'error' AS ok FROM {events}"""


# Foreign keys: in the database of an order a line refers to an earlier one, which its quantity names; returned lines
# are referred to as well, undiscounted ones refer to themselves.
LINE_TABLES = """
    SELECT concat('order_', l_orderkey) AS database, concat('t', l_linenumber) AS "table" FROM {lineitem}"""
LINE_KEYS = """
    SELECT concat('order_', l_orderkey) AS database, concat('t', l_linenumber) AS "table",
           concat('t', CASE WHEN l_discount = 0 THEN l_linenumber ELSE CAST(l_quantity AS INT) % l_linenumber END) AS parent
    FROM {lineitem}
    UNION ALL
    SELECT concat('order_', l_orderkey) AS database, concat('t', CAST(l_quantity AS INT) % l_linenumber) AS "table",
           concat('t', l_linenumber) AS parent
    FROM {lineitem} WHERE l_returnflag = 'R' AND l_linestatus = 'F'"""

CONVERSATIONS_AFTER = """
    SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN concat(text, '.') ELSE text END AS text FROM {conversations}"""

# Orders with large whole numbers and decimals, and the same read back from another engine, some changed.
ORDERS_MEASURED = """
    SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 1000000000000 AS big, CAST(o_orderkey AS DECIMAL(20,2)) AS amount
    FROM {orders}"""
ORDERS_REMEASURED = """
    SELECT o_orderkey,
           CAST(CAST(o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) * 1000000000000 AS DOUBLE) AS big,
           CAST(o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS amount
    FROM {orders}"""

# Orders by a code that is text, some of it no number, and later by a number.
ORDERS_CODED = """
    SELECT CASE WHEN o_orderkey % 13 = 0 THEN concat('x', o_orderkey) ELSE CAST(o_orderkey AS VARCHAR(20)) END AS code, o_custkey
    FROM {orders} WHERE o_orderkey % 17 <> 0"""
ORDERS_RENUMBERED = """
    SELECT CAST(o_orderkey AS BIGINT) AS code, o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS o_custkey
    FROM {orders} WHERE o_orderkey % 19 <> 0"""

# Rollouts of the events of each user, ten to a position.
TIED_OUTCOMES = """
    SELECT user_id AS fleet, CAST(floor(event_id / 10) AS BIGINT) AS pos, concat('m', event_id) AS name,
           event_type <> 'error' AS ok
    FROM {events}"""

# Tables of the fleet before and after, and what they refer to: an order of some priority names the other table.
FLEET_TABLES = f"""
    SELECT database, "table" FROM ({BASELINE}) AS b UNION SELECT database, "table" FROM ({LIVE}) AS l"""
FLEET_KEYS = f"""
    SELECT concat('cust_', o_custkey) AS database, {fleet_table(LIVE_LIMIT)} AS "table",
           concat('orders_', CASE o_orderpriority WHEN '1-URGENT' THEN 'f' WHEN '2-HIGH' THEN 'o' WHEN '3-MEDIUM' THEN 'p'
                                                  ELSE 'x' END) AS parent
    FROM {{orders}} WHERE o_orderstatus <> 'O'"""
