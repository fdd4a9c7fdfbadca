"""Registries, baselines, drift, history, rollouts."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftkit import model as M
from driftkit.functions import change_text
from driftkit.operators import drift as R
from driftkit.operators import fleet as L
from driftkit.operators.validation import spec_from_diff
from driftkit.queries import inputs as I
from driftkit.queries.base import derive, duck, query
from driftkit.queries.schema import CHANGES, diff_ctes, live_changes, of_fleet
from driftkit.session import work_dir
from driftkit.sources import intervals as V
from driftkit.sources.history import append_report, load_history, to_json_report
from driftkit.sources.registry import load_registry, save_registry
from driftkit.sources.snapshots import load_snapshots, save_snapshot
from driftkit.sources.specs import load_spec, save_spec
from driftkit.streaming import transitions as W
from driftkit.streaming.alerts import alert_payload as alerts
from driftkit.streaming.alerts import drift_lines
from driftkit.streaming.watch import snapshot_stream, watch

_MEMBERS = duck(I.REGISTRY)


def _registry(spark, sf_dir):
    return derive(spark, sf_dir, I.REGISTRY)


def _tags(column="tags"):
    return F.array_join(column, ",").alias("tags")


@query("fleet_filter", f"""
    SELECT name, array_to_string(tags, ',') AS tags FROM {_MEMBERS} WHERE list_contains(tags, 'building')""")
def fleet_filter(spark, sf_dir):
    return L.fleet_filter(_registry(spark, sf_dir), "building").select("name", _tags())


@query("fleet_provider", f"""
    SELECT name, CASE WHEN starts_with(dsn, 'turso://') THEN 'turso' WHEN starts_with(dsn, 'd1://') THEN 'd1'
                      ELSE 'local' END AS provider FROM {_MEMBERS}""")
def fleet_provider(spark, sf_dir):
    return L.with_provider(_registry(spark, sf_dir)).select("name", "provider")


@query("fleet_config_check", f"""
    WITH r AS {duck(I.CARELESS_REGISTRY)}
    SELECT 'no databases' AS problem, NULL AS name, count(*) AS members FROM r HAVING count(*) = 0
    UNION ALL SELECT 'no name', name, 1 FROM r WHERE name = ''
    UNION ALL SELECT 'no dsn', name, 1 FROM r WHERE dsn IS NULL AND name <> ''
    UNION ALL SELECT 'duplicate name', name, count(*) FROM r WHERE name <> '' GROUP BY name HAVING count(*) > 1""")
def fleet_config_check(spark, sf_dir):
    return L.registry_problems(derive(spark, sf_dir, I.CARELESS_REGISTRY))


@query("fleet_status", f"""
    SELECT name, captured_at IS NOT NULL AS has_baseline, captured_at AS baseline_at,
           array_to_string(tags, ',') AS tags
    FROM {_MEMBERS} LEFT JOIN (SELECT database, max(captured_at) AS captured_at FROM {duck(I.BASELINE)} GROUP BY database)
         ON name = database""")
def fleet_status(spark, sf_dir):
    status = L.fleet_status(_registry(spark, sf_dir), derive(spark, sf_dir, I.BASELINE))
    return status.select("name", "has_baseline", "baseline_at", _tags())


_MERGED = f"""
    WITH e AS {_MEMBERS}, i AS {duck(I.INCOMING)},
    c AS (SELECT name, min(pos) AS pos, arg_max(dsn, pos) AS dsn, arg_min(baseline, pos) AS baseline,
                 arg_max(tags, pos) FILTER (tags IS NOT NULL) AS tags, count(*) AS n FROM i GROUP BY name),
    m AS (SELECT coalesce(e.pos, c.pos) AS pos, coalesce(e.name, c.name) AS name, coalesce(c.dsn, e.dsn) AS dsn,
                 CASE WHEN e.name IS NULL THEN c.baseline ELSE e.baseline END AS baseline,
                 array_to_string(coalesce(c.tags, e.tags), ',') AS tags,
                 CAST(CASE WHEN e.name IS NULL THEN 1 ELSE 0 END AS BIGINT) AS added,
                 coalesce(c.n, 0) - CASE WHEN e.name IS NULL THEN 1 ELSE 0 END AS updated
          FROM e FULL JOIN c ON e.name = c.name)"""


@query("fleet_merge", _MERGED + "SELECT * FROM m")
def fleet_merge(spark, sf_dir):
    merged = L.fleet_merge(_registry(spark, sf_dir), derive(spark, sf_dir, I.INCOMING))
    return merged.withColumn("tags", _tags())


@query("fleet_merge_counts", _MERGED + """
    SELECT CAST(sum(added) AS BIGINT) AS added, CAST(sum(updated) AS BIGINT) AS updated FROM m""")
def fleet_merge_counts(spark, sf_dir):
    return L.merge_counts(L.fleet_merge(_registry(spark, sf_dir), derive(spark, sf_dir, I.INCOMING)))


@query("fleet_merge_unplaced", f"""
    WITH e AS {_MEMBERS}, i AS {duck(I.UNPLACED)},
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos NULLS LAST, dsn) AS turn FROM i),
    c AS (SELECT name, min(pos) AS pos, arg_max(dsn, turn) AS dsn, arg_min(baseline, turn) AS baseline,
                 arg_max(tags, turn) FILTER (tags IS NOT NULL) AS tags, count(*) AS n FROM r GROUP BY name)
    SELECT coalesce(e.pos, c.pos) AS pos, coalesce(e.name, c.name) AS name, coalesce(c.dsn, e.dsn) AS dsn,
           CASE WHEN e.name IS NULL THEN c.baseline ELSE e.baseline END AS baseline,
           array_to_string(coalesce(c.tags, e.tags), ',') AS tags,
           CAST(CASE WHEN e.name IS NULL THEN 1 ELSE 0 END AS BIGINT) AS added,
           coalesce(c.n, 0) - CASE WHEN e.name IS NULL THEN 1 ELSE 0 END AS updated
    FROM e FULL JOIN c ON e.name = c.name""")
def fleet_merge_unplaced(spark, sf_dir):
    """Members that come in without a position are applied last and keep their address."""
    return L.fleet_merge(_registry(spark, sf_dir), derive(spark, sf_dir, I.UNPLACED)).withColumn("tags", _tags())


@query("snapshot_latest", f"""
    SELECT database, "table", "column", captured_at FROM {duck(I.SNAPSHOTS)}
    QUALIFY rank() OVER (PARTITION BY database ORDER BY captured_at DESC) = 1""")
def snapshot_latest(spark, sf_dir):
    newest = R.latest_snapshot(derive(spark, sf_dir, I.SNAPSHOTS))
    return newest.select("database", "table", "column", "captured_at")


# What a scan yields: columns of readable members, one error row of the others.
_SCAN = f"""
    SELECT database, "table", CAST(NULL AS STRING) AS error
    FROM ({I.LIVE}) AS l WHERE database NOT IN (SELECT database FROM ({I.UNREADABLE}) AS u)
    UNION ALL SELECT database, CAST(NULL AS STRING) AS "table", error FROM ({I.UNREADABLE}) AS u"""


@query("fleet_snapshot_report", f"""
    SELECT database, count(DISTINCT "table") AS tables, max(error) AS error FROM {duck(_SCAN)} GROUP BY database""")
def fleet_snapshot_report(spark, sf_dir):
    return L.snapshot_report(derive(spark, sf_dir, _SCAN))


def _drift(spark, sf_dir):
    inputs, n = of_fleet(spark, sf_dir, I.BASELINE, I.LIVE, I.BASELINE_INDEXES, I.LIVE_INDEXES)
    return R.drift(*inputs, partitions=n)


_CHANGE_LINE = """kind || ' ' || "table" || coalesce('.' || subject, '') || coalesce(' ' || detail, '')"""
_DRIFT = f"""
    WITH {diff_ctes()},
    b AS (SELECT database, max(captured_at) AS baseline_at FROM o GROUP BY database),
    l AS (SELECT database, max(captured_at) AS checked_at FROM n GROUP BY database),
    c AS (SELECT database, count(*) AS n,
                 string_agg({_CHANGE_LINE}, '; ' ORDER BY kind, "table", subject NULLS FIRST) AS changes
          FROM changes GROUP BY database),
    d AS (SELECT b.database AS source, baseline_at,
                 coalesce(checked_at, (SELECT max(checked_at) FROM l)) AS checked_at, coalesce(n, 0) > 0 AS has_drift,
                 coalesce(changes, '') AS changes
          FROM b LEFT JOIN l ON b.database = l.database LEFT JOIN c ON b.database = c.database)"""


@query("drift_check", _DRIFT + "SELECT * FROM d")
def drift_check(spark, sf_dir):
    return _change_lines(_drift(spark, sf_dir)).drop("error")


# Every capture against the baseline in force: as-of join, then the two schemas side by side.
_IN_FORCE = f"""
    WITH caps AS {duck(I.CAPTURES)}, bases AS {duck(I.BASES)},
    checks AS (SELECT database, captured_at, max(error) AS error FROM caps GROUP BY ALL),
    times AS (SELECT DISTINCT database, captured_at FROM bases),
    pairs AS (SELECT c.database, c.captured_at, c.error, t.captured_at AS baseline_at
              FROM checks c ASOF JOIN times t ON c.database = t.database AND c.captured_at >= t.captured_at),
    o AS (SELECT p.database, p.captured_at, b."table", b."column", b.type, b.not_null
          FROM pairs p JOIN bases b ON b.database = p.database AND b.captured_at = p.baseline_at WHERE p.error IS NULL),
    n AS (SELECT p.database, p.captured_at, c."table", c."column", c.type, c.not_null
          FROM pairs p JOIN caps c ON c.database = p.database AND c.captured_at = p.captured_at WHERE p.error IS NULL),
    both_sides AS (SELECT database, captured_at, "table", o.type IS NOT NULL AS old, n.type IS NOT NULL AS new, "column",
                 o.type AS old_type, n.type AS new_type, o.not_null AS old_null, n.not_null AS new_null,
                 bool_or(o.type IS NOT NULL) OVER w AS in_old, bool_or(n.type IS NOT NULL) OVER w AS in_new
          FROM o FULL JOIN n USING (database, captured_at, "table", "column")
          WINDOW w AS (PARTITION BY database, captured_at, "table")),
    changes AS (
        SELECT DISTINCT database, captured_at, CASE WHEN in_new THEN 'table added' ELSE 'table removed' END AS kind, "table",
               CAST(NULL AS VARCHAR) AS subject, CAST(NULL AS VARCHAR) AS detail FROM both_sides WHERE in_old <> in_new
        UNION ALL
        SELECT database, captured_at, CASE WHEN NOT old THEN 'column added' WHEN NOT new THEN 'column removed'
                                           ELSE 'column type changed' END, "table", "column",
               CASE WHEN old AND new THEN old_type || '→' || new_type END
        FROM both_sides WHERE in_old AND in_new
          AND (old <> new OR old_type IS DISTINCT FROM new_type OR old_null IS DISTINCT FROM new_null)),
    listed AS (SELECT database, captured_at, string_agg({_CHANGE_LINE}, '; ' ORDER BY kind, "table", subject NULLS FIRST) AS changes
               FROM changes GROUP BY ALL),
    reports AS (SELECT p.database AS source, baseline_at, p.captured_at AS checked_at,
                       CASE WHEN error IS NULL THEN changes IS NOT NULL END AS has_drift, coalesce(changes, '') AS changes, error
                FROM pairs p LEFT JOIN listed l ON p.database = l.database AND p.captured_at = l.captured_at)"""


def _change_lines(report):
    def line(c):
        subject = F.coalesce(F.concat(F.lit("."), c["subject"]), F.lit(""))
        detail = F.coalesce(F.concat(F.lit(" "), c["detail"]), F.lit(""))
        return F.concat(c["kind"], F.lit(" "), c["table"], subject, detail)

    return report.withColumn("changes", F.array_join(F.transform("changes", line), "; "))


def _captures(spark, sf_dir):
    return derive(spark, sf_dir, I.BASES).drop("first"), derive(spark, sf_dir, I.CAPTURES)


@query("drift_in_force", _IN_FORCE + "SELECT * FROM reports")
def drift_in_force(spark, sf_dir):
    """Captures of years, each against the baseline that was in force when it was taken."""
    return _change_lines(R.drift_in_force(*_captures(spark, sf_dir)))


def _states(spark, sf_dir):
    (baselines, live), n = of_fleet(spark, sf_dir, I.BASELINE, I.LIVE)
    live = live.unionByName(derive(spark, sf_dir, I.UNREADABLE), allowMissingColumns=True)
    return L.fleet_check(_registry(spark, sf_dir), baselines, live, partitions=n)


_STATES = f"""
    WITH {diff_ctes()},
    s AS (SELECT database, count(*) FILTER (kind = 'table added') AS a,
                 count(*) FILTER (kind = 'table removed') AS r,
                 count(DISTINCT "table") FILTER (kind LIKE 'column%') AS m
          FROM changes WHERE kind NOT LIKE 'index%' GROUP BY database),
    f AS (
        SELECT r.name AS database, replace(replace(r.dsn, 'tok@', ''), 'tok' || r.pos || '@', '') AS dsn,
               CASE WHEN r.name NOT IN (SELECT database FROM o) THEN 'no-baseline'
                    WHEN u.error IS NOT NULL THEN 'error' WHEN s.database IS NOT NULL THEN 'drift'
                    ELSE 'ok' END AS state, u.error AS e, s.a, s.r, s.m
        FROM {_MEMBERS} r LEFT JOIN {duck(I.UNREADABLE)} u ON r.name = u.database LEFT JOIN s ON r.name = s.database)"""


@query("fleet_check", _STATES + """
    SELECT database, dsn, state, CASE WHEN state = 'error' THEN e END AS error,
           CASE WHEN state IN ('drift', 'ok') THEN coalesce(a, 0) END AS tables_added,
           CASE WHEN state IN ('drift', 'ok') THEN coalesce(r, 0) END AS tables_removed,
           CASE WHEN state IN ('drift', 'ok') THEN coalesce(m, 0) END AS tables_modified FROM f""")
def fleet_check(spark, sf_dir):
    return _states(spark, sf_dir)


@query("fleet_state_counts", _STATES + """
    SELECT count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (state = 'drift') AS drift,
           count(*) FILTER (state = 'no-baseline') AS no_baseline, count(*) FILTER (state = 'error') AS error,
           count(*) FILTER (state IN ('drift', 'error')) > 0 AS has_problems FROM f""")
def fleet_state_counts(spark, sf_dir):
    return L.fleet_counts(_states(spark, sf_dir))


def _rollout_sql(canary, dry_run):
    """The rollout walked in order with running aggregates."""
    if dry_run:
        return f"SELECT *, CASE WHEN ok THEN 'dry-run' ELSE 'failed' END AS state FROM {duck(I.OUTCOMES)}"
    earlier = "OVER (PARTITION BY fleet ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
        SELECT fleet, pos, ok, CASE WHEN halted THEN 'skipped' WHEN held THEN 'canary' WHEN ok THEN 'applied'
                                    ELSE 'failed' END AS state
        FROM (SELECT *, coalesce(bool_or(NOT ok AND NOT held) {earlier}, false) AS halted
              FROM (SELECT *, {canary} > 0 AND coalesce(sum(CAST(ok AS INT)) {earlier}, 0) >= {canary} AS held
                    FROM {duck(I.OUTCOMES)}))"""


def _rolled(spark, sf_dir, canary=0, dry_run=False):
    return L.rollout_states(derive(spark, sf_dir, I.OUTCOMES), canary, dry_run)


@query("rollout_states", _rollout_sql(0, False))
def rollout_states(spark, sf_dir):
    return _rolled(spark, sf_dir)


@query("rollout_states_canary", _rollout_sql(3, False))
def rollout_states_canary(spark, sf_dir):
    return _rolled(spark, sf_dir, canary=3)


@query("rollout_states_dry_run", _rollout_sql(3, True))
def rollout_states_dry_run(spark, sf_dir):
    return _rolled(spark, sf_dir, canary=3, dry_run=True)


@query("rollout_states_ties", f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY fleet ORDER BY pos, name) AS i FROM {duck(I.TIED_OUTCOMES)}),
    s AS (SELECT fleet, min(i) FILTER (NOT ok) AS fail FROM r GROUP BY fleet),
    h AS (SELECT fleet, i AS hold FROM (SELECT *, row_number() OVER (PARTITION BY fleet ORDER BY i) AS n FROM r WHERE ok) WHERE n = 5)
    SELECT fleet, pos, name, ok,
           CASE WHEN fail < coalesce(hold, fail + 1) THEN CASE WHEN i = fail THEN 'failed' WHEN i > fail THEN 'skipped' ELSE 'applied' END
                WHEN i > hold THEN 'canary' ELSE 'applied' END AS state
    FROM r JOIN s USING (fleet) LEFT JOIN h USING (fleet)""")
def rollout_states_ties(spark, sf_dir):
    """Members that share positions go by name."""
    return L.rollout_states(derive(spark, sf_dir, I.TIED_OUTCOMES), canary=5)


@query("rollout_counts", f"""
    SELECT fleet, count(*) FILTER (state = 'applied') AS applied, count(*) FILTER (state = 'failed') AS failed,
           count(*) FILTER (state IN ('skipped', 'canary')) AS skipped
    FROM ({_rollout_sql(3, False)}) GROUP BY fleet""")
def rollout_counts(spark, sf_dir):
    return L.rollout_counts(_rolled(spark, sf_dir, canary=3), by=["fleet"])


_HISTORY = duck(I.HISTORY)


@query("history_summary", f"""
    SELECT source, count(*) AS total_checks, count(*) FILTER (has_drift) AS drift_count,
           max(checked_at) AS last_checked, max(checked_at) FILTER (has_drift) AS last_drift
    FROM {_HISTORY} GROUP BY source""")
def history_summary(spark, sf_dir):
    return R.history_summary(derive(spark, sf_dir, I.HISTORY))


@query("history_last_n", f"""
    SELECT * FROM {_HISTORY}
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY checked_at DESC, event_id DESC) <= 3""")
def history_last_n(spark, sf_dir):
    return R.history_last(derive(spark, sf_dir, I.HISTORY), 3, ["event_id"])


@query("history_last_many", f"""
    SELECT * FROM {_HISTORY}
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY checked_at DESC, event_id DESC) <= 1200""")
def history_last_many(spark, sf_dir):
    """More of a source than a task should rank."""
    return R.history_last(derive(spark, sf_dir, I.HISTORY), 1200, ["event_id"])


def _typed(catalog):
    return catalog.select(*[F.col(f.name).cast(f.dataType) for f in M.CATALOG.fields])


def _taken(day):
    return F.lit(day).cast("timestamp")


def _new_folder(spark, name):
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("history_timeline", f"SELECT source, checked_at, has_drift FROM {_HISTORY}")
def history_timeline(spark, sf_dir):
    path = _new_folder(spark, "history")
    checks = derive(spark, sf_dir, I.HISTORY).select(
        *[(F.col(f.name) if f.name in ("source", "checked_at", "has_drift") else F.lit(None)).cast(f.dataType).alias(f.name)
          for f in M.DRIFT_REPORT.fields]
    )
    append_report(checks, path)
    return load_history(spark, path, ordered=True).select(
        "source", F.col("checked_at").cast("timestamp_ntz").alias("checked_at"), "has_drift"
    )


@query("report_json", CHANGES + """
    SELECT '{"database":"' || database || '","kind":"' || kind || '","table":"' || "table" || '"'
           || coalesce(',"subject":"' || subject || '"', '') || coalesce(',"detail":"' || detail || '"', '') || '}' AS json
    FROM changes""")
def report_json(spark, sf_dir):
    return to_json_report(live_changes(spark, sf_dir).select("database", "kind", "table", "subject", "detail"))


@query("change_text", CHANGES + """
    SELECT CASE WHEN subject IS NULL THEN "table" || ': ' || kind
                ELSE "table" || '.' || subject || ': ' || kind || ' ' || coalesce(detail, '') END AS line,
           count(*) AS databases
    FROM changes GROUP BY 1""")
def change_lines(spark, sf_dir):
    line = change_text(F.col("table"), F.col("subject"), F.col("kind"), F.col("detail"))
    return live_changes(spark, sf_dir).groupBy(line.alias("line")).agg(F.count(F.lit(1)).alias("databases"))


_LINES = _DRIFT + """,
    t AS (SELECT database, "table", bool_or(kind = 'table added') AS a, bool_or(kind = 'table removed') AS r,
                 count(*) FILTER (kind LIKE 'column%') AS c, count(*) FILTER (kind LIKE 'index%') AS i
          FROM changes GROUP BY database, "table"),
    w AS (SELECT database, count(*) AS tables, string_agg(
              '• `' || "table" || '` ' || CASE WHEN a THEN '*added*' WHEN r THEN '*removed*' ELSE 'modified — '
              || concat_ws(', ', CASE WHEN c > 0 THEN c || ' column change(s)' END,
                           CASE WHEN i > 0 THEN i || ' index change(s)' END) END, chr(10) ORDER BY "table") AS lines
          FROM t GROUP BY database),
    p AS (SELECT source, baseline_at, checked_at, tables, lines FROM d JOIN w ON source = database WHERE has_drift)"""


@query("alert_lines", _LINES + "SELECT source, checked_at, tables, lines FROM p")
def alert_lines(spark, sf_dir):
    return drift_lines(_drift(spark, sf_dir)).select("source", "checked_at", "tables", "lines")


_AT = "strftime({}, '%Y-%m-%d %H:%M UTC')"


@query("alert_payload", _LINES + f"""
    SELECT source, checked_at,
           '{{"text":"⚠️ Schema drift detected in `' || source || '`","blocks":['
           || '{{"type":"header","text":{{"type":"plain_text","text":"⚠️ Schema Drift Detected"}}}},'
           || '{{"type":"section","fields":['
           || '{{"type":"mrkdwn","text":"*Source*\\n`' || source || '`"}},'
           || '{{"type":"mrkdwn","text":"*Changes*\\n' || tables || ' table(s)"}},'
           || '{{"type":"mrkdwn","text":"*Baseline*\\n' || {_AT.format("baseline_at")} || '"}}'
           || ',{{"type":"mrkdwn","text":"*Detected*\\n' || {_AT.format("checked_at")} || '"}}]}},'
           || '{{"type":"section","text":{{"type":"mrkdwn","text":"' || replace(lines, chr(10), '\\n') || '"}}}}]}}' AS payload
    FROM p""")
def alert_payload(spark, sf_dir):
    return alerts(_drift(spark, sf_dir), "slack")


_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.000')"


@query("alert_payload_generic", _DRIFT + f""",
    j AS (SELECT database, count(DISTINCT "table") AS tables, string_agg(
              '{{"kind":"' || kind || '","table":"' || "table" || '"' || coalesce(',"subject":"' || subject || '"', '')
              || coalesce(',"detail":"' || detail || '"', '') || '}}', ',' ORDER BY kind, "table", subject NULLS FIRST)
              AS items
          FROM changes GROUP BY database)
    SELECT source, checked_at,
           '{{"text":"Schema drift detected in ' || source || ' (' || tables || ' changes)","result":{{"source":"' || source
           || '","baseline_at":"' || {_ISO.format("baseline_at")} || '"'
           || ',"checked_at":"' || {_ISO.format("checked_at")} || '"'
           || ',"has_drift":true,"changes":[' || items || ']}}}}' AS payload
    FROM d JOIN j ON source = database WHERE has_drift""")
def alert_payload_generic(spark, sf_dir):
    return alerts(_drift(spark, sf_dir))


@query("watch_drift", f"""
    WITH {diff_ctes()},
    b AS (SELECT database, max(captured_at) AS baseline_at FROM o GROUP BY database),
    c AS (SELECT database, count(*) AS n FROM changes WHERE kind NOT LIKE 'index%' GROUP BY database)
    SELECT b.database AS source, baseline_at, TIMESTAMP '2001-09-01' AS checked_at, coalesce(n, 0) > 0 AS has_drift,
           coalesce(n, 0) AS changes
    FROM b SEMI JOIN n ON b.database = n.database LEFT JOIN c ON b.database = c.database""")
def watch_drift(spark, sf_dir):
    arrived, report, checkpoint = (_new_folder(spark, f"watch-{n}") for n in ("in", "out", "checkpoint"))
    save_snapshot(_typed(derive(spark, sf_dir, I.LIVE)).withColumn("captured_at", _taken("2001-09-01")), arrived)
    baseline = _typed(derive(spark, sf_dir, I.BASELINE))
    watch(snapshot_stream(spark, arrived), baseline, report, checkpoint).awaitTermination()
    return load_history(spark, report).select(
        "source", F.col("baseline_at").cast("timestamp_ntz").alias("baseline_at"),
        F.col("checked_at").cast("timestamp_ntz").alias("checked_at"), "has_drift",
        F.size("changes").cast("bigint").alias("changes"),
    )


_DELAY = 30
# Verdicts of captures in time order, as far as the watermark has come, and those that differ from the one before.
_TRANSITIONS = f"""
    WITH caps AS {duck(I.CAPTURES)}, bases AS {duck(I.BASES)},
    line AS (SELECT max(captured_at) - {_DELAY} AS seen FROM caps),
    checks AS (SELECT database, captured_at, max(error) AS error FROM caps, line WHERE captured_at <= seen GROUP BY ALL),
    times AS (SELECT DISTINCT database, captured_at FROM bases),
    pairs AS (SELECT c.database, c.captured_at, c.error, t.captured_at AS baseline_at
              FROM checks c ASOF JOIN times t ON c.database = t.database AND c.captured_at >= t.captured_at),
    differing AS (
        SELECT database, captured_at, new, l FROM (
            SELECT p.database, p.captured_at, true AS new, [c."table", c."column", c.type, CAST(c.not_null AS VARCHAR)] AS l
            FROM pairs p JOIN caps c ON c.database = p.database AND c.captured_at = p.captured_at AND c.error IS NULL
            UNION ALL
            SELECT p.database, p.captured_at, false, [b."table", b."column", b.type, CAST(b.not_null AS VARCHAR)]
            FROM pairs p JOIN bases b ON b.database = p.database AND b.captured_at = p.baseline_at)
        QUALIFY count(*) OVER (PARTITION BY database, captured_at, l) = 1),
    sums AS (SELECT database, captured_at, count(*) FILTER (new) AS appeared, count(*) FILTER (NOT new) AS vanished,
                    string_agg(new || array_to_string(l, chr(1)), chr(2) ORDER BY new, l) AS text FROM differing GROUP BY ALL),
    judged AS (SELECT p.*, appeared, vanished, CASE WHEN p.error IS NOT NULL THEN 'error' WHEN text IS NULL THEN 'ok' ELSE 'drift' END AS state,
                      coalesce(p.error, text, '') AS verdict
               FROM pairs p LEFT JOIN sums s ON p.database = s.database AND p.captured_at = s.captured_at),
    told AS (SELECT *, lag(state, 1, 'ok') OVER w AS before, lag(verdict, 1, '') OVER w AS last FROM judged
             WINDOW w AS (PARTITION BY database ORDER BY captured_at))
    SELECT database AS source, CAST(baseline_at AS TIMESTAMP) AS baseline_at, CAST(captured_at AS TIMESTAMP) AS checked_at, state, before,
           CASE WHEN error IS NULL THEN coalesce(appeared, 0) END AS appeared,
           CASE WHEN error IS NULL THEN coalesce(vanished, 0) END AS vanished, error
    FROM told WHERE state <> before OR verdict <> last"""


@query("watch_transitions", _TRANSITIONS)
def watch_transitions(spark, sf_dir):
    """Captures arrive by year in two runs; with the second come late copies of the first that say something else."""
    arrived, closed, report, first, second = (_new_folder(spark, f"transitions-{n}") for n in ("in", "closed", "out", "c1", "c2"))
    bases, caps = _captures(spark, sf_dir)
    rows = caps.withColumn("is_baseline", F.lit(False)).unionByName(
        bases.withColumn("is_baseline", F.lit(True)), allowMissingColumns=True
    )
    rows = rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in W.ARRIVING.fields
    ])
    early = F.year("captured_at") < 1999
    late = rows.filter(early & (F.year("captured_at") < 1998)).withColumn("type", F.lit("late"))
    repeated = rows.filter(F.year("captured_at") == 1999)
    for arrivals in (rows.filter(early), rows.filter(~early).unionByName(late).unionByName(repeated)):
        arrivals.repartition("database", "captured_at").write.mode("append").parquet(arrived)
        W.closed_captures(W.arriving(spark, arrived), f"{_DELAY} days", closed, first).awaitTermination()
        W.watch_transitions(spark, closed, report, second).awaitTermination()
    return spark.read.schema(W.TRANSITIONS).parquet(report).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("baseline_at", "checked_at")}
    )


@query("snapshot_round_trip", f"""
    SELECT database, "table", "column", type, not_null FROM {duck(I.BASELINE)}""")
def snapshot_round_trip(spark, sf_dir):
    path = _new_folder(spark, "snapshots")
    save_snapshot(_typed(derive(spark, sf_dir, I.BASELINE)).withColumn("captured_at", _taken("1998-04-15")), path)
    return load_snapshots(spark, path).select("database", "table", "column", "type", "not_null")


def _stored_captures(spark, sf_dir):
    """All captures in a store, appended in three parts."""
    path = _new_folder(spark, "captures")
    rows = derive(spark, sf_dir, I.CAPTURES)
    # A capture with a member that could not be read is no capture.
    whole = rows.withColumn("error", F.max("error").over(Window.partitionBy("database", "captured_at")))
    year = F.year("captured_at")
    for part in (year < 1997, (year >= 1997) & (year < 2001), year >= 2001):
        V.append_captures(_typed(whole.select("*", *[F.lit(None).alias(c) for c in ("ordinal", "default_value", "pk")]).filter(part)), path)
    return V.open_store(spark, path)


_SOUND = f"""
    WITH caps AS (SELECT database, "table", "column", type, not_null, captured_at FROM {duck(I.CAPTURES)}
                  QUALIFY max(error) OVER (PARTITION BY database, captured_at) IS NULL),
    numbered AS (SELECT database, captured_at, row_number() OVER (PARTITION BY database ORDER BY captured_at) AS k,
                        lead(captured_at) OVER (PARTITION BY database ORDER BY captured_at) AS following
                 FROM (SELECT DISTINCT database, captured_at FROM caps))"""


@query("snapshot_rebuilt", _SOUND + """
    SELECT database, "table", "column", type, not_null, CAST(captured_at AS TIMESTAMP) AS captured_at FROM caps""")
def snapshot_rebuilt(spark, sf_dir):
    """Every capture, read back from what changed between them."""
    rows = V.every_capture(_stored_captures(spark, sf_dir))
    return rows.select("database", "table", "column", "type", "not_null", F.col("captured_at").cast("timestamp_ntz").alias("captured_at"))


@query("snapshot_intervals", _SOUND + """,
    islands AS (SELECT c.*, n.following, k - row_number() OVER (
                    PARTITION BY c.database, "table", "column", type, not_null ORDER BY k) AS island
                FROM caps c JOIN numbered n ON c.database = n.database AND c.captured_at = n.captured_at)
    SELECT database, "table", "column", type, not_null, CAST(min(captured_at) AS TIMESTAMP) AS valid_from,
           CAST(max(following) FILTER (captured_at = final) AS TIMESTAMP) AS valid_to
    FROM (SELECT *, max(captured_at) OVER (PARTITION BY database, "table", "column", type, not_null, island) AS final FROM islands)
    GROUP BY database, "table", "column", type, not_null, island""")
def snapshot_intervals(spark, sf_dir):
    """When each column was there, gaps and islands over the captures of its database."""
    spans = V.intervals(_stored_captures(spark, sf_dir)).withColumn("c", F.from_json("line", V.LINE))
    return spans.select("database", *[f"c.{c}" for c in ("table", "column", "type", "not_null")], *[
        F.col(c).cast("timestamp_ntz").alias(c) for c in ("valid_from", "valid_to")
    ])


@query("snapshot_as_of", _SOUND + """
    SELECT database, "table", "column", type, not_null FROM caps
    WHERE captured_at <= DATE '1999-06-15'
    QUALIFY rank() OVER (PARTITION BY database ORDER BY captured_at DESC) = 1""")
def snapshot_as_of(spark, sf_dir):
    rows = V.captures_as_of(_stored_captures(spark, sf_dir), datetime.datetime(1999, 6, 15))
    return rows.select("database", "table", "column", "type", "not_null")


@query("registry_round_trip", f"""
    SELECT pos, name, replace(replace(dsn, 'tok@', ''), 'tok' || pos || '@', '') AS dsn, baseline,
           array_to_string(tags, ',') AS tags FROM {_MEMBERS}""")
def registry_round_trip(spark, sf_dir):
    """Members stored and read again; the tokens in their addresses stay out."""
    path = _new_folder(spark, "registry")
    save_registry(_registry(spark, sf_dir), path)
    return load_registry(spark, path).withColumn("tags", _tags())


@query("spec_round_trip", CHANGES + """SELECT database, kind, "table", subject FROM changes""")
def spec_round_trip(spark, sf_dir):
    """Specs of what changed, stored and read again, expect those changes."""
    path = _new_folder(spark, "specs")
    save_spec(spec_from_diff(live_changes(spark, sf_dir), by=["database"]), path)
    return load_spec(spark, path, lines=True)[0].select("database", "kind", "table", "subject")


@query("watch_errors", f"""
    WITH {diff_ctes()}, u AS {duck(I.UNREADABLE)},
    b AS (SELECT database, max(captured_at) AS baseline_at FROM o GROUP BY database),
    c AS (SELECT database, count(*) AS n FROM changes WHERE kind NOT LIKE 'index%' GROUP BY database),
    s AS (SELECT DISTINCT database FROM n UNION SELECT database FROM u)
    SELECT b.database AS source, baseline_at, u.error IS NULL AS readable, u.error AS error,
           CASE WHEN u.error IS NULL THEN coalesce(n, 0) > 0 END AS has_drift,
           CASE WHEN u.error IS NULL THEN coalesce(n, 0) ELSE 0 END AS changes
    FROM b SEMI JOIN s ON b.database = s.database LEFT JOIN u ON b.database = u.database LEFT JOIN c ON b.database = c.database""")
def watch_errors(spark, sf_dir):
    """Members that could not be read are reported with their error, and the watch goes on."""
    arrived, report, checkpoint = (_new_folder(spark, f"errors-{n}") for n in ("in", "out", "checkpoint"))
    failed = derive(spark, sf_dir, I.UNREADABLE)
    live = derive(spark, sf_dir, I.LIVE).join(failed.select("database"), "database", "left_anti")
    rows = live.unionByName(failed, allowMissingColumns=True)
    _typed(rows).withColumn("captured_at", _taken("2001-09-01")).repartition("database").write.parquet(arrived)
    watch(snapshot_stream(spark, arrived), _typed(derive(spark, sf_dir, I.BASELINE)), report, checkpoint).awaitTermination()
    return load_history(spark, report).select(
        "source", F.col("baseline_at").cast("timestamp_ntz").alias("baseline_at"), F.col("error").isNull().alias("readable"),
        "error", "has_drift", F.size("changes").cast("bigint").alias("changes"),
    )
