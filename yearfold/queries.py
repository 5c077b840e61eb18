"""All queries of the engine, by name, with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from yearfold import more_queries
from yearfold.functions import scalars
from yearfold.operators import catalog, integrity, layout, propagate, retention
from yearfold.plans import rebuild
from yearfold.sources import storage

AS_OF = dt.date(2001, 12, 31)
KEYS = [("l_orderkey", "o_orderkey")]
HELPER = scalars.helper_name("o_orderdate", "fk_orders")
CASES = "VALUES ('Cascade', ' 10,5 ', 'C_Order-Line', 'VARCHAR', 'c'), ('setnull', '', 'ÄB c', 'decimal', 'n'), ('SET NULL', '32', 'plain_1', 'TIMESTAMP', 'r'), ('restrict', '7.4', NULL, 'Integer', 'd'), ('', '7.5', 'x', 'GEOMETRY', 'a'), (NULL, NULL, 'y z', 'BLOB', 'z')"
TABLES = "VALUES ('t1', 'C_Order'), ('t2', 'C_Invoice'), ('t3', 'C_Line')"
COLUMNS = "VALUES ('k1', 't1', 'C_Order_ID', 'Y'), ('k2', 't1', 'DateOrdered', 'N'), ('k3', 't1', 'Created', 'N'), ('k4', 't2', 'C_Invoice_ID', 'Y'), ('k5', 't2', 'DateInvoiced', 'N'), ('k6', 't3', 'C_Line_ID', 'Y')"
CONFIG = "VALUES ('t1', 'k2'), ('t1', 'k3'), ('t2', 'k5'), ('t2', 'k5')"
USAGE = "VALUES ('public', 'line', 'fk_b', 2, 'helper', 'orders', 'odate', false), ('public', 'line', 'fk_b', 1, 'order_id', 'orders', 'id', false), ('public', 'ship_y2001', 'fk_a', 1, 'o_id', 'ORDERS', 'id', true), ('public', 'ship_y2002', 'fk_a', 1, 'o_id', 'orders', 'id', true), ('public', 'other', 'fk_c', 1, 'x', 'customers', 'id', false)"
INHERITS = "VALUES ('ship_y2001', 'ship'), ('ship_y2002', 'ship')"
DEFS = "VALUES ('t', 'A', 1, 0, 'VARCHAR', 'true'), ('t', 'b', 1, 1, 'DECIMAL', 'false'), ('t', 'a', 0, 5, 'CLOB', 'false'), ('t', 'B', 2, 0, 'DATE', 'true'), ('u', 'a', 3, 0, 'CHAR', 'false')"
ACTUAL = "VALUES ('A'), ('c'), ('d')"
KEYROWS = "VALUES ('C_Line', 'FK_Line', 'c_order_id', 'cascade', 'dateordered'), ('C_Line', 'FK_Line', 'c_order_id', 'cascade', 'dateordered'), ('C_Ship', 'FK-Ship', 'order_id', NULL, 'dateordered')"
OUTCOMES = "VALUES ('a', 'SUCCESS', 10), ('b', 'SUCCESS', 5), ('c', 'SKIPPED', 0), ('d', 'FAILURE', 0)"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _v(spark, values, names):
    return spark.sql(f"SELECT * FROM {values} AS t({names})")


def _child(spark, d):
    """lineitem with a helper that is set on every second order."""
    li = _t(spark, d, "lineitem")
    return li.withColumn(HELPER, F.when(F.col("l_orderkey") % 2 == 0, F.col("l_shipdate")))


def _rewritten(spark, d, name, field):
    path = storage.work_dir(spark)
    storage.write_partitioned(_t(spark, d, name), field, path)
    return path


def _pairs(df):
    return df.select("l_orderkey", "l_linenumber", "l_partkey", HELPER)


def _gone(spark, d):
    return _t(spark, d, "orders").where(F.year("o_orderdate") == 1997)


def _unpartitioned(s, d):
    path = _rewritten(s, d, "orders", "o_orderdate")
    storage.unpartition_table(s, path)
    return s.read.parquet(path)


def _planted(s, d):
    """lineitem with orders that don't exist, and some without an order."""
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber").withColumn("l_orderkey", F.expr("CASE WHEN l_orderkey % 97 = 0 THEN -l_orderkey WHEN l_orderkey % 101 = 0 THEN NULL ELSE l_orderkey END"))


def _events(s, d):
    return _t(s, d, "events").select(F.col("user_id").alias("table_name"), F.col("ts").alias("created_at"), F.col("event_id").alias("backup_name"))


def _last(s, d, cond):
    return _t(s, d, "events").where(cond).groupBy("user_id").agg(F.max("ts").alias("last_processed"))


def _functions(s, d):
    c = _v(s, CASES, "act, size, name, kind, code")
    return c.select("act", scalars.on_delete(F.col("act")).alias("on_delete"), scalars.lenient_int(F.col("size")).alias("size"), scalars.sanitized(F.col("name")).alias("name"), scalars.stored_type(F.col("kind")).alias("kind"), scalars.delete_code(F.col("code")).alias("code"))


def _skip(s, d):
    b = s.sql("SELECT * FROM VALUES (true), (false) AS a(incomplete) CROSS JOIN VALUES (true), (false) AS b(first_run) CROSS JOIN VALUES (true), (false) AS c(unchanged)")
    return b.withColumn("skip", rebuild.skip_decision(F.col("incomplete"), F.col("first_run"), F.col("unchanged")))


def _usage(s):
    return _v(s, USAGE, "table_schema, table_name, constraint_name, ordinal, column_name, referenced_table, referenced_column, can_defer")


def _defs(s):
    return _v(s, DEFS, "table_name, column_name, file_order, place, type, required")


def _keyrows(s):
    return _v(s, KEYROWS, "table_name, key_name, column_name, on_delete, field")


def queries() -> dict:
    return _queries() | more_queries.queries()


def _queries() -> dict:
    o = lambda s, d: _t(s, d, "orders")
    li = lambda s, d: _t(s, d, "lineitem")
    return {
        "year_range": lambda s, d: layout.year_range(o(s, d), "o_orderdate", AS_OF),
        "year_range_empty": lambda s, d: layout.year_range(o(s, d).where("o_orderkey < 0"), "o_orderdate", AS_OF),
        "year_layout": lambda s, d: layout.year_layout(o(s, d), "o_orderdate", "orders", AS_OF).withColumns({c: F.col(c).cast("string") for c in ("from_date", "to_date")}),
        "layout_row_counts": lambda s, d: layout.layout_row_counts(o(s, d), "o_orderdate", "orders", AS_OF),
        "partitioned_copy": lambda s, d: s.read.parquet(_rewritten(s, d, "orders", "o_orderdate")),
        "pruned_range_read": lambda s, d: storage.read_range(s, _rewritten(s, d, "orders", "o_orderdate"), "o_orderdate", dt.datetime(1997, 1, 1), dt.datetime(1998, 1, 1)),
        "unpartition_roundtrip": _unpartitioned,
        "helper_sync": lambda s, d: _pairs(propagate.sync(_child(s, d), o(s, d), KEYS, "o_orderdate", HELPER)),
        "helper_fill": lambda s, d: _pairs(propagate.fill(_child(s, d), o(s, d), KEYS, "o_orderdate", HELPER)),
        "helper_estimate": lambda s, d: propagate.estimate(_child(s, d), o(s, d), KEYS, "o_orderdate", HELPER),
        "helper_validation": lambda s, d: propagate.validate(_child(s, d), KEYS, HELPER),
        "null_key_flag": lambda s, d: integrity.null_key_flag(_child(s, d), HELPER).union(integrity.null_key_flag(o(s, d), "o_orderdate")),
        "pk_duplicates": lambda s, d: integrity.duplicates(li(s, d), ["l_orderkey", "l_linenumber"]),
        "pk_violations": lambda s, d: integrity.primary_key_violations(o(s, d), ["o_custkey"], "o_orderdate"),
        "fk_orphans_simple": lambda s, d: integrity.orphans(li(s, d), o(s, d), KEYS).select("l_orderkey", "l_linenumber"),
        "fk_orphans_planted": lambda s, d: integrity.orphans(_planted(s, d), o(s, d), KEYS),
        "fk_orphans_compound": lambda s, d: integrity.orphans(_child(s, d), o(s, d), [*KEYS, (HELPER, "o_orderdate")]).select("l_orderkey", "l_linenumber", HELPER),
        "fk_on_delete_cascade": lambda s, d: integrity.on_delete_cascade(li(s, d), _gone(s, d), KEYS).select("l_orderkey", "l_linenumber"),
        "fk_on_delete_set_null": lambda s, d: integrity.on_delete_set_null(li(s, d).select("l_orderkey", "l_linenumber", "l_suppkey"), _gone(s, d), KEYS),
        "fk_on_delete_restrict": lambda s, d: integrity.on_delete_restrict(li(s, d), _gone(s, d), KEYS),
        "related_tables": lambda s, d: catalog.related_tables(_usage(s), "orders", _v(s, INHERITS, "child, parent")).select("table_schema", "table_name", "constraint_name", F.array_join("fk_columns", ",").alias("fk_columns"), F.array_join("referenced_columns", ",").alias("referenced_columns")),
        "foreign_keys_on": lambda s, d: catalog.foreign_keys(_usage(s), "LINE", "on").select("constraint_name", "column_name"),
        "foreign_keys_to": lambda s, d: catalog.foreign_keys(_usage(s), "orders", "to").select("constraint_name", "column_name", "table_name"),
        "partition_parent": lambda s, d: catalog.partition_parent(_usage(s), _v(s, INHERITS, "child, parent")).distinct(),
        "config_resolution": lambda s, d: catalog.config_resolution(_v(s, CONFIG, "table_id, column_id"), _v(s, TABLES, "table_id, table_name"), _v(s, COLUMNS, "column_id, table_id, column_name, is_key")),
        "config_fields": lambda s, d: catalog.fields_by_table(_v(s, CONFIG, "table_id, column_id"), _v(s, TABLES, "table_id, table_name"), _v(s, COLUMNS, "column_id, table_id, column_name, is_key")).select("table_name", F.array_join("fields", ",").alias("fields")),
        "config_semi_join": lambda s, d: catalog.configured_tables(_v(s, TABLES, "table_id, table_name"), _v(s, CONFIG, "table_id, column_id")),
        "compound_fk_columns": lambda s, d: catalog.compound_keys(_usage(s), lambda c: c == "helper").drop("table_name"),
        "first_definition_wins": lambda s, d: catalog.first_definitions(_defs(s)),
        "column_diff": lambda s, d: catalog.column_diff(_defs(s), _v(s, ACTUAL, "column_name")),
        "alter_plan": lambda s, d: rebuild.alter_plan(catalog.column_diff(_defs(s).where("table_name = 't'"), _v(s, ACTUAL, "column_name")), catalog.first_definitions(_defs(s).where("table_name = 't'"))),
        "skip_decision": _skip,
        "scalar_functions": _functions,
        "constraint_plan": lambda s, d: rebuild.constraint_plan(_keyrows(s), "C_Order", "c_order_id", "dateordered", True),
        "exclude_filter_names": lambda s, d: rebuild.exclude_names(_v(s, "VALUES ('c_order_pk')", "name"), _keyrows(s)),
        "run_summary": lambda s, d: rebuild.run_summary(_v(s, OUTCOMES, "table_name, status, n_rows").withColumn("n_rows", F.col("n_rows").cast("long"))),
        "backup_retention": lambda s, d: retention.to_delete(_events(s, d), F.lit("2024-01-31").cast("timestamp_ntz")),
        "metadata_upsert": lambda s, d: retention.upsert(_last(s, d, "ts < '2024-01-28'"), _last(s, d, "ts >= '2024-01-28'"), "user_id"),
        "metadata_delete": lambda s, d: retention.delete(_last(s, d, "true"), _last(s, d, "event_type = 'purchase' AND ts >= '2024-01-29'"), "user_id"),
    }


_CHILD = f"(SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN l_shipdate END AS {HELPER} FROM lineitem)"
_GONE = "(SELECT * FROM orders WHERE year(o_orderdate) = 1997)"
_LAYOUT = "SELECT CAST(y AS INTEGER) AS p_year, 'orders_y' || y AS name, make_date(y, 1, 1) AS from_date, make_date(y + 1, 1, 1) AS to_date FROM (SELECT unnest(range(year(min(o_orderdate)), greatest(year(max(o_orderdate)), 2001) + 2)) AS y FROM orders)"
_U = f"(SELECT * FROM ({USAGE}) t(table_schema, table_name, constraint_name, ordinal, column_name, referenced_table, referenced_column, can_defer))"
_D = f"(SELECT * FROM ({DEFS}) t(table_name, column_name, file_order, place, type, required))"
_K = f"(SELECT * FROM ({KEYROWS}) t(table_name, key_name, column_name, on_delete, field))"
_T = f"({TABLES}) t(table_id, table_name)"
_C = f"({COLUMNS}) c(column_id, table_id, column_name, is_key)"
_G = f"({CONFIG}) g(table_id, column_id)"
_I = f"({INHERITS}) i(child, parent)"
_A = f"({ACTUAL}) a(column_name)"
_DIFF = "SELECT DISTINCT lower(column_name) AS column_name, 'added' AS change FROM {d} WHERE lower(column_name) NOT IN (SELECT lower(column_name) FROM {a}) UNION ALL SELECT DISTINCT lower(column_name), 'removed' FROM {a} WHERE lower(column_name) NOT IN (SELECT lower(column_name) FROM {d})"
_H = f"'{scalars.HELPER_PREFIX}'"
_CLEAN = "regexp_replace(lower(table_name), '[^a-z0-9_]', '_', 'g') || '_' || regexp_replace(lower(key_name), '[^a-z0-9_]', '_', 'g')"


def _case(c: str, values: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{otherwise}' END"


def _last_sql(cond: str) -> str:
    return f"SELECT user_id, max(ts) AS last_processed FROM events WHERE {cond} GROUP BY user_id"


def oracle_sql() -> dict[str, str]:
    return _oracle_sql() | more_queries.oracle_sql()


def _oracle_sql() -> dict[str, str]:
    return {
        "year_range": "SELECT CAST(year(min(o_orderdate)) AS INTEGER) AS min_year, CAST(year(max(o_orderdate)) AS INTEGER) AS max_year FROM orders",
        "year_range_empty": "SELECT CAST(coalesce(year(min(o_orderdate)), 2001) AS INTEGER) AS min_year, CAST(coalesce(year(max(o_orderdate)), 2001) AS INTEGER) AS max_year FROM orders WHERE o_orderkey < 0",
        "year_layout": f"SELECT p_year, name, CAST(from_date AS VARCHAR) AS from_date, CAST(to_date AS VARCHAR) AS to_date FROM ({_LAYOUT})",
        "layout_row_counts": f"SELECT p_year, name, (SELECT count(*) FROM orders WHERE year(o_orderdate) = p_year) AS n_rows FROM ({_LAYOUT})",
        "partitioned_copy": "SELECT *, CAST(year(o_orderdate) AS INTEGER) AS p_year FROM orders",
        "pruned_range_read": "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'",
        "unpartition_roundtrip": "SELECT * FROM orders",
        "helper_sync": f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderkey IS NOT NULL THEN o_orderdate ELSE {HELPER} END AS {HELPER} FROM {_CHILD} LEFT JOIN orders ON o_orderkey = l_orderkey",
        "helper_fill": f"SELECT l_orderkey, l_linenumber, l_partkey, coalesce({HELPER}, o_orderdate) AS {HELPER} FROM {_CHILD} LEFT JOIN orders ON o_orderkey = l_orderkey",
        "helper_estimate": f"SELECT count(*) AS n FROM {_CHILD} JOIN orders ON o_orderkey = l_orderkey WHERE {HELPER} IS DISTINCT FROM o_orderdate",
        "helper_validation": f"SELECT count(*) AS total, count(*) - count({HELPER}) AS n_null, count({HELPER}) AS n_populated, count(*) = count({HELPER}) AS success FROM {_CHILD} WHERE l_orderkey IS NOT NULL",
        "null_key_flag": f"SELECT CASE WHEN count(*) > count({HELPER}) THEN 'Y' ELSE 'N' END AS has_null FROM {_CHILD} UNION ALL SELECT CASE WHEN count(*) > count(o_orderdate) THEN 'Y' ELSE 'N' END FROM orders",
        "pk_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
        "pk_violations": "SELECT 'key' AS rule, count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'key and partition', count(*) FROM (SELECT o_custkey, o_orderdate FROM orders GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'null', count(*) FILTER (o_custkey IS NULL) FROM orders",
        "fk_orphans_simple": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
        "fk_orphans_planted": "SELECT l_orderkey, l_linenumber FROM (SELECT CASE WHEN l_orderkey % 97 = 0 THEN -l_orderkey WHEN l_orderkey % 101 = 0 THEN NULL ELSE l_orderkey END AS l_orderkey, l_linenumber FROM lineitem) x WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = x.l_orderkey)",
        "fk_orphans_compound": f"SELECT l_orderkey, l_linenumber, {HELPER} FROM {_CHILD} x WHERE l_orderkey IS NOT NULL AND {HELPER} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = x.l_orderkey AND o_orderdate = x.{HELPER})",
        "fk_on_delete_cascade": f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {_GONE})",
        "fk_on_delete_set_null": f"SELECT CASE WHEN l_orderkey IN (SELECT o_orderkey FROM {_GONE}) THEN NULL ELSE l_orderkey END AS l_orderkey, l_linenumber, l_suppkey FROM lineitem",
        "fk_on_delete_restrict": f"SELECT count(*) AS n_blocking FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM {_GONE})",
        "related_tables": f"SELECT table_schema, t AS table_name, constraint_name, string_agg(column_name, ',' ORDER BY ordinal) AS fk_columns, string_agg(referenced_column, ',' ORDER BY ordinal) AS referenced_columns FROM (SELECT DISTINCT table_schema, coalesce(parent, table_name) AS t, constraint_name, ordinal, column_name, referenced_column FROM {_U} LEFT JOIN {_I} ON child = table_name WHERE lower(referenced_table) = 'orders') GROUP BY ALL",
        "foreign_keys_on": f"SELECT constraint_name, column_name FROM {_U} WHERE lower(table_name) = 'line'",
        "foreign_keys_to": f"SELECT constraint_name, column_name, table_name FROM {_U} WHERE lower(referenced_table) = 'orders'",
        "partition_parent": f"SELECT DISTINCT table_name, coalesce(parent, table_name) AS parent FROM {_U} LEFT JOIN {_I} ON child = table_name",
        "config_resolution": f"SELECT lower(t.table_name) AS table_name, min(lower(c.column_name)) AS field, lower(k.column_name) AS pk_column FROM {_G} JOIN {_T} USING (table_id) JOIN {_C} ON c.table_id = g.table_id AND c.column_id = g.column_id JOIN ({COLUMNS}) k(column_id, table_id, column_name, is_key) ON k.table_id = g.table_id AND k.is_key = 'Y' GROUP BY 1, 3",
        "config_fields": f"SELECT lower(table_name) AS table_name, string_agg(DISTINCT lower(column_name), ',' ORDER BY lower(column_name)) AS fields FROM {_G} JOIN {_T} USING (table_id) JOIN {_C} ON c.table_id = g.table_id AND c.column_id = g.column_id GROUP BY 1",
        "config_semi_join": f"SELECT lower(table_name) AS table_name FROM {_T} WHERE table_id IN (SELECT table_id FROM {_G})",
        "compound_fk_columns": f"SELECT constraint_name, string_agg(column_name, ', ' ORDER BY ordinal) AS columns, string_agg(referenced_column, ', ' ORDER BY ordinal) AS referenced FROM {_U} WHERE NOT can_defer GROUP BY 1 HAVING count(*) = 2 AND bool_or(column_name = 'helper')",
        "first_definition_wins": f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY table_name, lower(column_name) ORDER BY file_order, place) AS rn FROM {_D}) WHERE rn = 1",
        "column_diff": _DIFF.format(d=_D, a=_A),
        "alter_plan": f"""WITH w AS (SELECT lower(column_name) AS c, type, required FROM (SELECT *, row_number() OVER (PARTITION BY lower(column_name) ORDER BY file_order, place) AS n FROM {_D} WHERE table_name = 't') WHERE n = 1), a AS (SELECT DISTINCT lower(column_name) AS c FROM {_A})
            SELECT c AS column_name, CASE WHEN lower(required) = 'true' THEN 'add not null' ELSE 'add' END AS action, {_case('upper(type)', scalars.TYPE_NAMES, 'string')} AS type FROM w WHERE c NOT IN (SELECT c FROM a)
            UNION ALL SELECT c, 'keep', NULL FROM a WHERE c NOT IN (SELECT c FROM w)""",
        "skip_decision": "SELECT incomplete, first_run, unchanged, incomplete OR (NOT first_run AND unchanged) AS skip FROM (VALUES (true), (false)) a(incomplete), (VALUES (true), (false)) b(first_run), (VALUES (true), (false)) c(unchanged)",
        "scalar_functions": f"SELECT act, {_case('lower(trim(act))', scalars.ON_DELETE, 'NO ACTION')} AS on_delete, CASE WHEN trim(coalesce(size, '')) = '' THEN 0 ELSE CAST(floor(CAST(replace(trim(size), ',', '.') AS DOUBLE) + 0.5) AS INTEGER) END AS size, coalesce(regexp_replace(lower(name), '[^a-z0-9_]', '_', 'g'), 'unknown') AS name, {_case('upper(kind)', scalars.TYPE_NAMES, 'string')} AS kind, {_case('code', scalars.DELETE_CODES, 'NO ACTION')} AS code FROM ({CASES}) t(act, size, name, kind, code)",
        "constraint_plan": f"""WITH k AS (SELECT DISTINCT table_name, key_name, column_name, on_delete, {_H} || 'dateordered__' || lower(key_name) AS h FROM {_K})
            SELECT 1 AS step, 'drop primary key' AS action, 'C_Order' AS target, 'c_order_id' AS columns, NULL AS on_update, NULL AS on_delete UNION ALL SELECT 2, 'add primary key', 'C_Order', 'c_order_id, dateordered', NULL, NULL
            UNION ALL SELECT 3, 'drop foreign key', table_name || '.' || key_name, column_name, NULL, NULL FROM k UNION ALL SELECT 4, 'add helper', table_name || '.' || key_name, h, NULL, NULL FROM k
            UNION ALL SELECT 5, 'fill helper', table_name || '.' || key_name, h, NULL, NULL FROM k UNION ALL SELECT 6, 'add foreign key', table_name || '.' || key_name, column_name || ', ' || h, 'CASCADE', CASE WHEN on_delete = 'cascade' THEN 'CASCADE' ELSE 'NO ACTION' END FROM k""",
        "exclude_filter_names": f"SELECT 'primary key' AS kind, 'C_ORDER_PK' AS name UNION SELECT 'foreign key', upper(key_name) FROM {_K} UNION SELECT 'column', upper({_H} || field || '__' || key_name) FROM {_K} UNION SELECT 'trigger', upper({_CLEAN} || '_trg') FROM {_K} UNION SELECT 'function', upper({_CLEAN} || '_fill') FROM {_K}",
        "run_summary": f"SELECT status, count(*) AS n_tables, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM ({OUTCOMES}) t(table_name, status, n_rows) GROUP BY 1",
        "backup_retention": "SELECT table_name, created_at, backup_name FROM (SELECT user_id AS table_name, ts AS created_at, event_id AS backup_name, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn > 5 OR created_at < TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS",
        "metadata_upsert": f"SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.last_processed, o.last_processed) AS last_processed FROM ({_last_sql("ts < TIMESTAMP '2024-01-28'")}) o FULL JOIN ({_last_sql("ts >= TIMESTAMP '2024-01-28'")}) n USING (user_id)",
        "metadata_delete": f"SELECT * FROM ({_last_sql('true')}) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-29')",
    }
