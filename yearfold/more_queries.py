"""Queries of registries, definitions and whole runs, with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import re
from pathlib import Path
from xml.sax.saxutils import quoteattr

from pyspark.sql import functions as F

from yearfold import cli
from yearfold.functions import scalars
from yearfold.operators import catalog, integrity, propagate
from yearfold.plans import rebuild, related
from yearfold.sources import definitions, storage
from yearfold.sources.registry import Registry
from yearfold.streaming import enrich

FIELD, KEYS = "o_orderdate", (("l_orderkey", "o_orderkey"),)
HELPER = scalars.helper_name(FIELD, "fk_orders")
RELATIONS = "VALUES ('public', 'orders', 'r'), ('public', 'orders_old', 'p'), ('public', 'orders_view', 'v'), ('public', 'orders_seq', 'S'), ('public', 'odd', 'q'), ('pg_catalog', 'pg_class', 'r'), ('information_schema', 'tables', 'v')"
WANTED = "VALUES ('public', 'ORDERS'), ('Public', 'orders_View'), ('other', 'orders'), ('public', 'nothing'), (NULL, 'orders')"
VIEWS = "VALUES ('public', 'open_orders', 'orders', 'SELECT 1'), ('public', 'open_orders', 'ORDERS', 'SELECT 1'), ('public', 'lines', 'line', 'SELECT 2'), ('sales', 'late', 'orders', 'SELECT 3')"
TRIGGERS = "VALUES ('orders', 'orders_fill', 'BEFORE INSERT', false), ('orders', 'ri_1', 'internal', true), ('line', 'line_fill', 'BEFORE INSERT', false), ('ORDERS', 'orders_audit', 'AFTER UPDATE', false)"
KEYS_OF = "VALUES ('orders', 'orders_pk', 'p', 2, 'odate', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)), ('orders', 'orders_pk', 'p', 1, 'id', NULL, NULL, NULL), ('line', 'line_fk', 'f', 1, 'order_id', 'orders', 'id', 'CASCADE'), ('line', 'line_fk', 'f', 2, 'part_odate__line_fk', 'orders', 'odate', 'CASCADE'), ('line', 'line_u', 'u', 1, 'no', NULL, NULL, NULL), ('ship', 'ship_fk', 'f', 1, 'order_id', 'orders', 'id', 'NO ACTION')"
KEY_NAMES = "table_name, constraint_name, kind, ordinal, column_name, referenced_table, referenced_column, on_delete"
NUMBERS = "VALUES ('a', 3, 1), ('a', 1, 2), ('a', 9, 3), ('b', 2, 1), ('c', 8, 1)"
ATTRIBUTES = "VALUES (1, 'id'), (2, 'name'), (3, 'odate')"
TEXTS = "VALUES ('true', 'two\\nlines', 'order_line'), (' Y ', 'one', '1st'), ('no', '  ', '_x'), ('', '', 'a b'), (NULL, NULL, NULL), ('YES', 'm\\r\\nn', 'a;drop')"
CASES = "VALUES ('new', 'N', true, CAST(NULL AS BOOLEAN)), ('new', 'N', false, NULL), ('new', NULL, false, NULL), ('new', 'Y', false, NULL), ('delete', NULL, NULL, true), ('delete', NULL, NULL, false), ('delete', NULL, NULL, NULL), ('update', NULL, NULL, NULL)"
# file (by place), table, column or key, its type or target, the key's name
FILES = "VALUES (0, 'modules/one/tables/LINE.xml', 'line', 'id', 'DECIMAL', 'line_pk'), (0, 'modules/one/tables/LINE.xml', 'line', 'order_id', 'VARCHAR', 'line_pk'), (1, 'modules/two words/tables/SHIP.xml', 'ship', 'id', 'CHAR', 'ship_pk'), (1, 'modules/two words/tables/SHIP.xml', 'line', 'twin', 'CHAR', 'twin_pk'), (2, 'modules/one/modifiedTables/LINE.xml', 'line', 'ORDER_ID', 'CLOB', 'other_pk'), (2, 'modules/one/modifiedTables/LINE.xml', 'line', 'extra', 'DATE', 'other_pk'), (3, 'modules_core/tables/LINE.xml', 'orders', 'id', 'INTEGER', 'orders_pk'), (4, 'tables/ITEM.xml', 'item', 'id', 'BLOB', 'item_pk')"
XML_KEYS = "VALUES (0, 'line', 'FK_Order', 'Orders'), (0, 'line', 'fk_part', 'part'), (1, 'ship', 'fk_order', 'orders'), (2, 'line', 'FK_ORDER', 'orders'), (3, 'orders', 'fk_self', 'ORDERS'), (4, 'item', 'FK_PART', 'part')"
SNAPSHOTS = "VALUES ('orders', TIMESTAMP_NTZ '2024-01-30 00:00:00'), ('orders', TIMESTAMP_NTZ '2024-01-29 00:00:00'), ('ORDERS', TIMESTAMP_NTZ '2024-01-28 00:00:00'), ('orders', TIMESTAMP_NTZ '2024-01-27 00:00:00'), ('orders', TIMESTAMP_NTZ '2024-01-26 00:00:00'), ('orders', TIMESTAMP_NTZ '2024-01-25 00:00:00'), ('nation', TIMESTAMP_NTZ '2024-01-24 00:00:00'), ('nation', TIMESTAMP_NTZ '2024-01-23 23:59:59')"
SETTINGS = "# a comment\nbbdd.url=jdbc\\:postgresql\\://db.host:5433\nbbdd.sid = erp\n\nbbdd.user:tad\nbbdd.password = a=b\nbbdd.rdbms=POSTGRE\n"
RUN = "VALUES ('orders', 'SUCCESS', 1500, ''), ('events', 'SKIPPED', 0, 'already partitioned'), ('nation', 'FAILURE', 0, 'no column ts'), ('part', 'SUCCESS', 20, '')"
NOW = dt.datetime(2024, 1, 31)


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _v(spark, values, names):
    return spark.sql(f"SELECT * FROM {values} AS t({names})")


def _local(path: str) -> str:
    """As the driver's own file functions take it."""
    return re.sub("^file:/+", "/", path)


def _copies(spark, d, *names):
    """Datasets of their own, to be rewritten; their folder."""
    top = storage.work_dir(spark)
    for n in names:
        _t(spark, d, n).write.parquet(f"{top}/{n}")
    return top


def _child(top, keys=KEYS, table="lineitem"):
    return related.Child(table, "fk_orders", f"{top}/{table}", tuple(keys))


def _related(s, d):
    top = _copies(s, d, "orders", "lineitem")
    return top, related.partition_related(s, f"{top}/orders", FIELD, [_child(top)])


def _related_lines(s, d):
    top, _ = _related(s, d)
    return s.read.parquet(f"{top}/lineitem").select("l_orderkey", "l_linenumber", "l_partkey", HELPER)


def _related_totals(s, d):
    _, (outcome, details) = _related(s, d)
    return related.related_totals(related.details_frame(s, details)).withColumn("status", F.lit(outcome.status)).withColumn("n_rows", F.lit(outcome.n_rows).cast("long"))


def _outcome(s, top, outcome, details):
    """What a run says, and what is left of the datasets."""
    o, li = s.read.parquet(f"{top}/orders"), s.read.parquet(f"{top}/lineitem")
    known = {"n_orders": F.lit(o.count()).cast("long"), "n_lines": F.lit(li.count()).cast("long"), "status": F.lit(outcome.status), "partitioned": F.lit(storage.is_partitioned(s, f"{top}/orders")), "helper": F.lit(HELPER in li.columns)}
    return related.details_frame(s, details).select("table_name", F.col("status").alias("child_status"), "n_null").withColumns(known)


def _related_failure(s, d):
    """Orders of 1997 are missing, so their lines keep empty helpers: nothing may be published."""
    top = _copies(s, d, "lineitem")
    _t(s, d, "orders").where(F.year(FIELD) != 1997).write.parquet(f"{top}/orders")
    return _outcome(s, top, *related.partition_related(s, f"{top}/orders", FIELD, [_child(top)]))


def _related_repeated(s, d):
    """The parent's key occurs twice."""
    top = _copies(s, d, "lineitem")
    o = _t(s, d, "orders")
    o.union(o).write.parquet(f"{top}/orders")
    outcome, details = related.partition_related(s, f"{top}/orders", FIELD, [_child(top)])
    said = "not unique" in details[0].message
    return _outcome(s, top, outcome, details).withColumn("said", F.lit(said))


def _related_dry(s, d):
    top = _copies(s, d, "orders", "lineitem")
    outcome, details = related.partition_related(s, f"{top}/orders", FIELD, [_child(top)], dry_run=True)
    return _outcome(s, top, outcome, details).withColumn("n_updated", F.lit(details[0].n_updated).cast("long"))


def _unpartitioned_helpers(s, d):
    """lineitem with a helper, by year of its own date, and plain again."""
    path = storage.work_dir(s)
    li = propagate.sync(_t(s, d, "lineitem"), _t(s, d, "orders"), list(KEYS), FIELD, HELPER)
    storage.write_partitioned(li, "l_shipdate", path)
    storage.unpartition_table(s, path)
    return s.read.parquet(path)


def _registry(s, d, *names):
    top = _copies(s, d, *names)
    r = Registry(s, f"{top}/registry")
    r.ensure()
    r.add("tables", [("public", n, "r", f"{top}/{n}", None) for n in names])
    return r


def _full_registry(s, d):
    r = _registry(s, d, "orders", "lineitem")
    r.add("config", [("orders", FIELD), ("ORDERS", "o_other"), ("nation", "x")])
    key = lambda table, name, kind, n, column, to=None, to_column=None: ("public", table, name, kind, n, column, to, to_column, "CASCADE" if to else None, False, True)
    r.add("keys", [key("orders", "orders_pk", "p", 1, "o_orderkey"), key("lineitem", "fk_orders", "f", 1, "l_orderkey", "orders", "o_orderkey"), key("orders", "fk_c", "f", 2, "part_x__fk_c", "customer", "x"), key("orders", "fk_c", "f", 1, "o_custkey", "customer", "c_custkey"), key("nation", "fk_n", "f", 1, "n_regionkey", "region", "r_regionkey")])
    r.add("views", [("public", "open_orders", "orders", "SELECT 1", True), ("public", "others", "nation", "SELECT 2", True)])
    r.add("triggers", [("public", "orders", "orders_fill", "f", False, True), ("public", "orders", "ri", "r", True, True)])
    return r


def _live(r):
    keys = r.get("keys").select(F.lit("key").alias("kind"), F.col("constraint_name").alias("name"), "live").distinct()
    views = r.get("views").select(F.lit("view"), "view_name", "live")
    return keys.union(views).union(r.get("triggers").select(F.lit("trigger"), "trigger_name", "live"))


def _run_live(s, d):
    r = _full_registry(s, d)
    related.partition(r, "orders", FIELD)
    return _live(r)


def _run_and_back(s, d):
    r = _full_registry(s, d)
    related.partition(r, "orders", FIELD)
    related.unpartition(r, "ORDERS")
    tables = r.get("tables").select(F.lit("table").alias("kind"), "table_name", (F.col("kind") == "r").alias("live"))
    config = r.get("config").select(F.lit("config"), F.lower("table_name"), F.lit(True)).distinct()
    return _live(r).union(tables).union(config)


def _deferrable(s, d):
    r = _full_registry(s, d)
    first, second = r.make_deferrable(), r.make_deferrable()
    return r.get("keys").select("constraint_name", "ordinal", "can_defer").withColumns({"first": F.lit(first).cast("int"), "second": F.lit(second).cast("int")})


def _sweep(s, d):
    r = _registry(s, d, "orders", "nation")
    for row in _v(s, SNAPSHOTS, "table_name, at").collect():  # a few rows, fixed above
        r.snapshot(row.table_name, row["at"])
    r.sweep(NOW)
    kept = r.get("backups")
    there = [(b.backup_name, storage.exists(s, f"{r.folder}/snapshots/{b.backup_name}")) for b in kept.collect()]
    return kept.join(s.createDataFrame(there, "backup_name string, there boolean"), "backup_name").select(F.lower("table_name").alias("table_name"), "created_at", "there")


def _guarded(s, d):
    """A failing action is told with the snapshot, which holds the rows as they were."""
    r = _registry(s, d, "nation")

    def action():
        storage.drop_column(s, r.table("nation").path, "n_name")
        raise ValueError("stop")

    try:
        r.guarded("nation", NOW, action)
        said = ""
    except storage.PartitionError as e:
        said = str(e)
    name = r.get("backups").first().backup_name
    return s.read.parquet(f"{r.folder}/snapshots/{name}").withColumn("said", F.lit(name in said and "stop" in said))


def _dropped(s, d):
    path = f"{_copies(s, d, 'nation')}/nation"
    first, second = storage.drop_column(s, path, "n_name"), storage.drop_column(s, path, "n_name")
    return s.read.parquet(path).withColumns({"first": F.lit(first), "second": F.lit(second)})


def _partitions(s, d):
    path = storage.work_dir(s)
    storage.write_partitioned(_t(s, d, "orders"), FIELD, path)
    return s.createDataFrame([(y,) for y in storage.partitions(s, path)], "p_year int")


def _many(s, d):
    """One table that can be partitioned, one that was, one without the field, one that is not there."""
    top = _copies(s, d, "orders", "nation", "events")
    storage.partition_table(s, f"{top}/events", "ts")
    runs = [("orders", FIELD), ("events", "ts"), ("nation", "ts"), ("nowhere", "ts")]
    done = storage.run_all([(f"{top}/{t}", f) for t, f in runs], lambda p, f: storage.partition_table(s, p, f))
    return s.createDataFrame([(t, o.status, o.n_rows, o.seconds >= 0) for (t, _), o in zip(runs, done, strict=True)], "table_name string, status string, n_rows long, timed boolean")


def xml_project(top: str, rows, keys) -> str:
    """Files of table definitions below a folder, of rows as in FILES and XML_KEYS."""
    files: dict[tuple[int, str], dict] = {}
    for at, file, table, column, kind, pk in rows:
        files.setdefault((at, file), {}).setdefault((table, pk), []).append((column, kind))
    for (at, file), tables in files.items():
        body = ""
        for (table, pk), columns in tables.items():
            body += f"<table name={quoteattr(table)} primaryKey={quoteattr(pk)}>" + "".join(f'<column name={quoteattr(c)} type={quoteattr(k)} required="false"/>' for c, k in columns)
            body += "".join(f'<foreign-key name={quoteattr(n)} foreignTable={quoteattr(to)}><reference local="a" foreign="b"/></foreign-key>' for i, t, n, to in keys if (i, t) == (at, table)) + "</table>"
        head, folder, name = file.rpartition("/")[0].rpartition("/")[0], file.split("/")[-2], file.split("/")[-1]
        place = Path(top) / head / "src-db/database/model" / folder
        place.mkdir(parents=True, exist_ok=True)
        (place / name).write_text(f'<?xml version="1.0"?><database>{body}</database>')
    return top


def _xml(s):
    """(files, definitions) of the project above; definitions lie beside the code that reads them, on the driver's side, as files of a build do."""
    top = _local(storage.work_dir(s))
    xml_project(top, [tuple(r) for r in _v(s, FILES, "a, f, t, c, k, p").orderBy("a").collect()], [tuple(r) for r in _v(s, XML_KEYS, "a, t, n, k").collect()])
    files = definitions.find(top)
    return files, definitions.read(s, files)


def _key_names(s, d):
    files, defs = _xml(s)
    out = []
    for t in ("line", "ship", "item", "orders", "none"):
        own = [r.file for r in definitions.of_table(defs, t).select("file", "file_order").distinct().orderBy("file_order").collect()]
        out.append((t, definitions.key_name(defs, own)))
    return s.createDataFrame(out, "table_name string, key_name string")


def _settings(s, d):
    path = Path(_local(storage.work_dir(s)))
    path.mkdir(parents=True)
    (path / "p.properties").write_text(SETTINGS)
    found = definitions.connection(definitions.properties(str(path / "p.properties")))
    return s.createDataFrame(sorted(found.items()), "name string, value string")


def _field_types(s, d):
    rows = [(t, f.name, scalars.is_partition_key(f.dataType)) for t in ("orders", "events", "nation") for f in _t(s, d, t).schema]
    return s.createDataFrame(rows, "table_name string, column_name string, is_partition_key boolean")


def _forced(s, d):
    """Whether definitions force a table, at first and once it was noted."""
    files, _ = _xml(s)
    r = _registry(s, d, "nation")
    later = dt.datetime(2200, 1, 1)
    rows = [(t, *(related.forced(r, files, t, later) for _ in range(2))) for t in ("orders", "part", "nowhere")]
    return s.createDataFrame(rows, "table_name string, first boolean, second boolean")


def _report(s, d):
    rows = _v(s, RUN, "table_name, status, n_rows, message").collect()  # a few rows, fixed above
    text = cli.report([storage.Outcome(r.table_name, r.status, r.message, r.n_rows) for r in rows])
    return s.createDataFrame([(x,) for x in text.split("\n")], "line string")


def _stream(s, d):
    """Lines with a helper on every second order, as a stream, filled by batch."""
    path, top = storage.work_dir(s), storage.work_dir(s)
    li = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").withColumn(HELPER, F.when(F.col("l_orderkey") % 2 == 0, F.lit("1990-01-01").cast("timestamp_ntz")))
    li.write.parquet(f"{top}/in")
    stream = s.readStream.schema(li.schema).parquet(f"{top}/in")
    enrich.start(stream, lambda: _t(s, d, "orders"), list(KEYS), FIELD, HELPER, path, f"{top}/checkpoint").awaitTermination()
    return s.read.parquet(path).select(*li.columns)


def queries() -> dict:
    defs = lambda s: _xml(s)[1]
    columns = lambda s, d: catalog.column_metadata(propagate.add_helper(_t(s, d, "lineitem"), HELPER, "timestamp_ntz"), "public", "lineitem")
    return {
        "column_metadata": lambda s, d: catalog.column_metadata(_t(s, d, "orders"), "main", "orders").union(catalog.column_metadata(_t(s, d, "lineitem"), "main", "lineitem", "L_TAX")).select("table_name", "ordinal", "column_name", "data_type"),
        "own_columns": lambda s, d: catalog.own_columns(columns(s, d), s.sql("SELECT * FROM VALUES ('LINEITEM', 'p', 'L_ORDERKEY'), ('lineitem', 'p', 'l_linenumber'), ('lineitem', 'f', 'l_partkey') AS t(table_name, kind, column_name)")),
        "user_relations": lambda s, d: catalog.user_relations(_v(s, RELATIONS, "table_schema, table_name, kind")),
        "existing_relations": lambda s, d: catalog.existing(_v(s, WANTED, "table_schema, table_name"), _v(s, RELATIONS, "table_schema, table_name, kind"), ["table_schema", "table_name"]),
        "dependent_views": lambda s, d: catalog.dependent_views(_v(s, VIEWS, "view_schema, view_name, table_name, definition"), "Orders"),
        "table_triggers": lambda s, d: catalog.table_triggers(_v(s, TRIGGERS, "table_name, trigger_name, definition, is_internal"), "orders"),
        "constraint_definitions": lambda s, d: catalog.constraint_definitions(_v(s, KEYS_OF, KEY_NAMES)),
        "child_partitions": _partitions,
        "column_names": lambda s, d: catalog.column_names(_v(s, NUMBERS, "id, number, pos").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "number"))), lambda x: x["number"]).alias("numbers")), _v(s, ATTRIBUTES, "number, name")).select("id", F.array_join("names", ",").alias("names")),
        "scalar_texts": lambda s, d: _v(s, TEXTS, "flag, text, name").select("name", scalars.yes(F.col("flag")).alias("yes"), scalars.brief(F.col("text"), 4).alias("brief"), scalars.is_blank(F.col("text")).alias("blank"), scalars.is_name(F.col("name")).alias("is_name")),
        "config_guard": lambda s, d: integrity.config_guard(_v(s, CASES, "event, has_null, has_unique, partitioned")),
        "xml_files": lambda s, d: definitions.columns_of(defs(s)).select("table_name", "file_order", "place", "column_name", "type"),
        "xml_of_table": lambda s, d: definitions.of_table(defs(s), "LINE").select("file_order", "table_name", "primary_key"),
        "xml_of_file": lambda s, d: definitions.of_file(defs(s), "line").select("file_order", "table_name", "primary_key"),
        "xml_first_definitions": lambda s, d: catalog.first_definitions(definitions.columns_of(defs(s))).select("table_name", F.lower("column_name").alias("column_name"), "type"),
        "xml_keys_to": lambda s, d: catalog.keys_to(defs(s), "orders"),
        "xml_key_owners": lambda s, d: definitions.key_owners(defs(s)),
        "xml_key_names": _key_names,
        "xml_changed_tables": lambda s, d: catalog.changed_tables(s.sql("SELECT * FROM VALUES ('LINE'), ('ship'), ('item'), ('none') AS t(table_name)"), definitions.columns_of(defs(s)), s.sql("SELECT * FROM VALUES ('line', 'ID'), ('line', 'order_id'), ('line', 'extra'), ('line', 'twin'), ('ship', 'id'), ('ship', 'more'), ('Item', 'id') AS t(table_name, column_name)")),
        "partition_related": _related_lines,
        "partition_related_totals": _related_totals,
        "partition_related_failure": _related_failure,
        "partition_related_repeated_key": _related_repeated,
        "partition_related_dry_run": _related_dry,
        "unpartition_helpers": _unpartitioned_helpers,
        "registry_partition": _run_live,
        "registry_unpartition": _run_and_back,
        "registry_deferrable": _deferrable,
        "snapshot_sweep": _sweep,
        "guarded_failure": _guarded,
        "drop_column": _dropped,
        "many_tables": _many,
        "partition_plan": lambda s, d: rebuild.partition_plan(s, "orders", FIELD, ["lineitem", "ship"]),
        "stream_fill": _stream,
        "connection_settings": _settings,
        "partition_field_types": _field_types,
        "forced_references": _forced,
        "run_report": _report,
    }


def _from(values: str, names: str) -> str:
    """The same rows in DuckDB's words."""
    return f"(SELECT * FROM ({values.replace('CAST(NULL AS STRING)', 'CAST(NULL AS VARCHAR)').replace('TIMESTAMP_NTZ', 'TIMESTAMP')}) t({names}))"


_TYPES = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END"
_F = _from(FILES, "file_order, file, table_name, column_name, type, primary_key")
_X = _from(XML_KEYS, "file_order, table_name, key_name, target")
_KEYS = _from(KEYS_OF, KEY_NAMES)
_STEM = "lower(regexp_extract(file, '([^/]*)[.]xml$', 1))"
_PLACED = f"(SELECT file_order, table_name, column_name, type, CAST(row_number() OVER (PARTITION BY file_order, table_name ORDER BY i) - 1 AS INTEGER) AS place FROM (SELECT *, row_number() OVER () AS i FROM {_F}))"
_SNAP = _from(SNAPSHOTS, "table_name, created_at")
_LINE = "SELECT count(*) FROM lineitem"


def oracle_sql() -> dict[str, str]:
    left = "CAST({n} AS BIGINT) AS n_null, CAST(({o}) AS BIGINT) AS n_orders, ({l}) AS n_lines, '{s}' AS status, false AS partitioned, false AS helper"
    return {
        "column_metadata": f"SELECT table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name, {_TYPES} AS data_type FROM information_schema.columns WHERE table_name = 'orders' OR (table_name = 'lineitem' AND lower(column_name) = 'l_tax')",
        "own_columns": "SELECT table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name, column_name IN ('l_orderkey', 'l_linenumber') AS is_key FROM information_schema.columns WHERE table_name = 'lineitem'",
        "user_relations": f"SELECT *, CASE kind WHEN 'r' THEN 'table' WHEN 'p' THEN 'partitioned table' WHEN 'v' THEN 'view' WHEN 'S' THEN 'sequence' ELSE kind END AS label FROM {_from(RELATIONS, 'table_schema, table_name, kind')} WHERE table_schema NOT IN ('pg_catalog', 'information_schema', 'pg_toast')",
        "existing_relations": f"SELECT *, EXISTS (SELECT 1 FROM {_from(RELATIONS, 'a, b, k')} WHERE lower(a) = lower(table_schema) AND lower(b) = lower(table_name)) AS found FROM {_from(WANTED, 'table_schema, table_name')}",
        "dependent_views": f"SELECT DISTINCT view_schema, view_name, definition FROM {_from(VIEWS, 'view_schema, view_name, table_name, definition')} WHERE lower(table_name) = 'orders'",
        "table_triggers": f"SELECT trigger_name, definition FROM {_from(TRIGGERS, 'table_name, trigger_name, definition, is_internal')} WHERE lower(table_name) = 'orders' AND NOT is_internal",
        "constraint_definitions": f"SELECT table_name, constraint_name, CASE kind WHEN 'f' THEN 'FOREIGN KEY (' || string_agg(column_name, ', ' ORDER BY ordinal) || ') REFERENCES ' || referenced_table || ' (' || string_agg(referenced_column, ', ' ORDER BY ordinal) || ')' || CASE on_delete WHEN 'NO ACTION' THEN '' ELSE ' ON DELETE ' || on_delete END WHEN 'p' THEN 'PRIMARY KEY (' || string_agg(column_name, ', ' ORDER BY ordinal) || ')' ELSE 'UNIQUE (' || string_agg(column_name, ', ' ORDER BY ordinal) || ')' END AS definition FROM {_KEYS} GROUP BY table_name, constraint_name, kind, referenced_table, on_delete",
        "child_partitions": "SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS p_year FROM orders",
        "column_names": f"SELECT id, string_agg(name, ',' ORDER BY pos) AS names FROM {_from(NUMBERS, 'id, number, pos')} JOIN {_from(ATTRIBUTES, 'number, name')} USING (number) GROUP BY id",
        "scalar_texts": "SELECT name, coalesce(lower(trim(flag)) IN ('true', 'y', 'yes', '1'), false) AS yes, left(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), 4) AS brief, trim(coalesce(text, '')) = '' AS blank, coalesce(regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*'), false) AS is_name FROM " + _from(TEXTS.replace("'two\\nlines'", "'two' || chr(10) || 'lines'").replace("'m\\r\\nn'", "'m' || chr(13) || chr(10) || 'n'"), "flag, text, name"),
        "config_guard": f"SELECT *, CASE WHEN event = 'new' AND (has_unique OR coalesce(has_null, 'Y') = 'Y') THEN 'reject' WHEN event = 'delete' AND coalesce(partitioned, true) THEN 'reject' ELSE 'accept' END AS verdict FROM {_from(CASES, 'event, has_null, has_unique, partitioned')}",
        "xml_files": f"SELECT table_name, file_order, place, column_name, type FROM {_PLACED}",
        "xml_of_table": f"SELECT DISTINCT file_order, table_name, primary_key FROM {_F} WHERE {_STEM} = 'line' OR lower(table_name) = 'line'",
        "xml_of_file": f"SELECT DISTINCT file_order, table_name, primary_key FROM {_F} WHERE {_STEM} = 'line'",
        "xml_first_definitions": f"SELECT table_name, lower(column_name) AS column_name, type FROM (SELECT *, row_number() OVER (PARTITION BY table_name, lower(column_name) ORDER BY file_order, place) AS n FROM {_PLACED}) WHERE n = 1",
        "xml_keys_to": f"SELECT DISTINCT table_name, key_name FROM {_X} WHERE lower(target) = 'orders'",
        "xml_key_owners": f"SELECT key_name, table_name FROM (SELECT lower(key_name) AS key_name, table_name, row_number() OVER (PARTITION BY lower(key_name) ORDER BY file_order) AS n FROM {_X} WHERE file_order IN (SELECT file_order FROM {_F} GROUP BY file_order HAVING count(DISTINCT table_name) = 1)) WHERE n = 1",
        "xml_key_names": f"SELECT w AS table_name, (SELECT CASE WHEN count(DISTINCT primary_key) = 1 THEN min(primary_key) END FROM {_F} WHERE file_order = (SELECT min(file_order) FROM {_F} WHERE ({_STEM} = w OR lower(table_name) = w) AND file NOT LIKE '%modifiedTables%')) AS key_name FROM (VALUES ('line'), ('ship'), ('item'), ('orders'), ('none')) t(w)",
        "xml_changed_tables": f"""WITH a AS (SELECT lower(t) AS t, lower(c) AS c FROM (VALUES ('line', 'ID'), ('line', 'order_id'), ('line', 'extra'), ('line', 'twin'), ('ship', 'id'), ('ship', 'more'), ('Item', 'id')) x(t, c)), w AS (SELECT DISTINCT lower(table_name) AS t, lower(column_name) AS c FROM {_F})
            SELECT n AS table_name, NOT EXISTS (SELECT 1 FROM w WHERE w.t = lower(n)) OR EXISTS (SELECT c FROM w WHERE w.t = lower(n) EXCEPT SELECT c FROM a WHERE a.t = lower(n)) OR EXISTS (SELECT c FROM a WHERE a.t = lower(n) EXCEPT SELECT c FROM w WHERE w.t = lower(n)) AS changed FROM (VALUES ('LINE'), ('ship'), ('item'), ('none')) x(n)""",
        "partition_related": f"SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate AS {HELPER} FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey",
        "partition_related_totals": "SELECT CAST(1 AS BIGINT) AS n_tables, CAST(1 AS BIGINT) AS n_success, CAST(0 AS BIGINT) AS n_failed, (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AS n_updated, 'SUCCESS' AS status, (SELECT count(*) FROM orders) AS n_rows",
        "partition_related_failure": "SELECT 'lineitem' AS table_name, 'FAILURE' AS child_status, " + left.format(n="(SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) <> 1997))", o="SELECT count(*) FROM orders WHERE year(o_orderdate) <> 1997", l=_LINE, s="FAILURE"),
        "partition_related_repeated_key": "SELECT 'lineitem' AS table_name, 'FAILURE' AS child_status, " + left.format(n="0", o="SELECT 2 * count(*) FROM orders", l=_LINE, s="FAILURE") + ", true AS said",
        "partition_related_dry_run": "SELECT 'lineitem' AS table_name, 'ESTIMATE' AS child_status, " + left.format(n="0", o="SELECT count(*) FROM orders", l=_LINE, s="SKIPPED") + ", (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AS n_updated",
        "unpartition_helpers": "SELECT * FROM lineitem",
        "registry_partition": "SELECT * FROM (VALUES ('key', 'orders_pk', false), ('key', 'fk_orders', false), ('key', 'fk_c', false), ('key', 'fk_n', true), ('view', 'open_orders', false), ('view', 'others', true), ('trigger', 'orders_fill', false), ('trigger', 'ri', true)) t(kind, name, live)",
        "registry_unpartition": "SELECT * FROM (VALUES ('key', 'orders_pk', true), ('key', 'fk_orders', true), ('key', 'fk_n', true), ('view', 'open_orders', true), ('view', 'others', true), ('trigger', 'orders_fill', true), ('trigger', 'ri', true), ('table', 'orders', true), ('table', 'lineitem', true), ('config', 'nation', true)) t(kind, name, live)",
        "registry_deferrable": "SELECT *, CAST(1 AS INTEGER) AS first, CAST(0 AS INTEGER) AS second FROM (VALUES ('orders_pk', 1, false), ('fk_orders', 1, false), ('fk_c', 2, true), ('fk_c', 1, true), ('fk_n', 1, false)) t(constraint_name, ordinal, can_defer)",
        "snapshot_sweep": f"SELECT lower(table_name) AS table_name, created_at, true AS there FROM (SELECT *, row_number() OVER (PARTITION BY lower(table_name) ORDER BY created_at DESC) AS n FROM {_SNAP}) WHERE n <= 5 AND created_at >= TIMESTAMP '2024-01-24'",
        "guarded_failure": "SELECT *, true AS said FROM nation",
        "drop_column": "SELECT * EXCLUDE (n_name), true AS first, false AS second FROM nation",
        "many_tables": "SELECT 'orders' AS table_name, 'SUCCESS' AS status, (SELECT count(*) FROM orders) AS n_rows, true AS timed UNION ALL SELECT 'events', 'SKIPPED', 0, true UNION ALL SELECT 'nation', 'FAILURE', 0, true UNION ALL SELECT 'nowhere', 'FAILURE', 0, true",
        "partition_plan": "SELECT CAST(row_number() OVER (ORDER BY i, target) AS INTEGER) AS step, action, target FROM (SELECT i, action, unnest(CASE i WHEN 1 THEN ['orders.o_orderdate'] WHEN 2 THEN ['lineitem', 'ship'] ELSE ['orders'] END) AS target FROM (VALUES (1, 'check field'), (2, 'sync related tables'), (3, 'record dependent views'), (4, 'record foreign keys'), (5, 'record triggers'), (6, 'record primary key'), (7, 'stage by year'), (8, 'verify'), (9, 'publish')) t(i, action))",
        "connection_settings": "WITH t AS (SELECT trim(k) AS k, replace(trim(v), chr(92), '') AS v FROM (SELECT regexp_extract(l, '^([^=:]*)[=:](.*)$', 1) AS k, regexp_extract(l, '^([^=:]*)[=:](.*)$', 2) AS v FROM (SELECT unnest(string_split('" + SETTINGS.replace("\n", "' || chr(10) || '") + """', chr(10))) AS l) WHERE l NOT LIKE '#%' AND l <> '')),
            u AS (SELECT v AS url FROM t WHERE k = 'bbdd.url')
            SELECT 'url' AS name, url || '/' || (SELECT v FROM t WHERE k = 'bbdd.sid') AS value FROM u UNION ALL SELECT 'host', regexp_extract(url, '//([^:/]+):', 1) FROM u UNION ALL SELECT 'port', regexp_extract(url, ':([0-9]+)$', 1) FROM u
            UNION ALL SELECT replace(k, 'bbdd.', ''), v FROM t WHERE k IN ('bbdd.user', 'bbdd.password')""",
        "partition_field_types": "SELECT table_name, column_name, data_type IN ('DATE', 'TIMESTAMP', 'TIMESTAMP WITH TIME ZONE') AS is_partition_key FROM information_schema.columns WHERE table_name IN ('orders', 'events', 'nation')",
        "forced_references": f"SELECT w AS table_name, EXISTS (SELECT 1 FROM {_X} WHERE lower(target) = w) AS first, EXISTS (SELECT 1 FROM {_X} JOIN (SELECT DISTINCT file_order, file FROM {_F}) f USING (file_order) WHERE lower(target) = w AND file LIKE '%modifiedTables%') AS second FROM (VALUES ('orders'), ('part'), ('nowhere')) t(w)",
        "run_report": f"SELECT status || ' ' || table_name || ': ' || n_rows || ' rows, 0.0 s' || CASE message WHEN '' THEN '' ELSE ' (' || message || ')' END AS line FROM {_from(RUN, 'table_name, status, n_rows, message')} UNION ALL SELECT count(*) FILTER (status = 'SUCCESS') || ' done, ' || count(*) FILTER (status = 'SKIPPED') || ' skipped, ' || count(*) FILTER (status = 'FAILURE') || ' failed; 0 helpers set' FROM {_from(RUN, 'table_name, status, n_rows, message')}",
        "stream_fill": f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 2 = 0 THEN TIMESTAMP '1990-01-01' ELSE o_orderdate END AS {HELPER} FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey",
    }
