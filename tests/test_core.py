import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from yearfold import cli, more_queries, queries
from yearfold.functions import scalars
from yearfold.operators import integrity, layout, propagate, retention
from yearfold.plans import rebuild, related
from yearfold.sources import definitions, storage
from yearfold.sources.registry import KeyContext, Registry
from yearfold.streaming import enrich

SF = "/root/testdata/sf0.001"
T = dt.datetime


def orders(spark, rows):
    return spark.createDataFrame(rows, "o int, d timestamp_ntz")


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    want = sorted(map(str, rel.select(*[f'"{c}"' for c in cols]).fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(cols).collect()) == want


def test_layout_edges(spark):
    as_of = dt.date(2000, 6, 1)
    empty = orders(spark, [])
    assert [r.p_year for r in layout.year_layout(empty, "d", "t", as_of).collect()] == [2000, 2001]
    null = orders(spark, [(1, None)])
    assert layout.year_range(null, "d", as_of).first() == (2000, 2000)
    late = orders(spark, [(1, T(2003, 12, 31, 23, 59, 59, 999999)), (2, T(1999, 1, 1))])
    assert [r.p_year for r in layout.year_layout(late, "d", "t", as_of).collect()] == [1999, 2000, 2001, 2002, 2003, 2004]


def test_round_trip_prunes_and_stays_the_same(spark, tmp_path):
    df = orders(spark, [(i, T(1999 + i % 3, 1 + i % 12, 1)) for i in range(60)])
    path = str(tmp_path / "t")
    df.write.parquet(path)
    assert storage.partition_table(spark, path, "d").status == "SUCCESS"
    assert storage.partition_table(spark, path, "d").status == "SKIPPED"
    r = storage.read_range(spark, path, "d", T(2000, 1, 1), T(2001, 1, 1))
    assert r.count() == 20
    assert "PartitionFilters: [isnotnull(p_year" in r._jdf.queryExecution().executedPlan().toString()
    assert storage.unpartition_table(spark, path).status == "SUCCESS"
    back = spark.read.parquet(path)
    assert back.columns == df.columns and back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()


def test_partition_refuses_and_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    orders(spark, [(1, None), (2, T(2000, 1, 1))]).write.parquet(path)
    with pytest.raises(storage.PartitionError):
        storage.partition_table(spark, path, "d")
    with pytest.raises(storage.PartitionError):
        storage.partition_table(spark, path, "o")
    assert spark.read.parquet(path).count() == 2
    assert [o.status for o in storage.run_all([(path, "d"), (path, "x")], lambda p, f: storage.partition_table(spark, p, f))] == ["FAILURE"] * 2


def test_propagation(spark):
    parent = spark.createDataFrame([(1, 1, T(2000, 1, 1)), (2, 1, T(2001, 1, 1))], "a int, b int, d timestamp_ntz")
    child = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, None, 1), (4, 9, 9)], "id int, fa int, fb int")
    keys = [("fa", "a"), ("fb", "b")]
    once = propagate.sync(child, parent, keys, "d", "h")
    assert {r.id: r.h for r in once.collect()} == {1: T(2000, 1, 1), 2: T(2001, 1, 1), 3: None, 4: None}
    assert propagate.estimate(child, parent, keys, "d", "h").first().n == 2
    assert propagate.estimate(once, parent, keys, "d", "h").first().n == 0
    assert propagate.validate(once, keys, "h").first() == (3, 1, 2, False)
    changed = once.withColumn("h", F.when(F.col("id") == 1, F.lit(T(1990, 1, 1)).cast("timestamp_ntz")).otherwise(F.col("h")))
    assert {r.id: r.h for r in propagate.fill(changed, parent, keys, "d", "h").collect()}[1] == T(1990, 1, 1)
    with pytest.raises(ValueError):
        propagate.assert_unique(parent, [("fb", "b")])


def test_integrity(spark):
    p = spark.createDataFrame([(1,), (2,)], "a int")
    c = spark.createDataFrame([(1, 1), (2, None), (3, 7)], "id int, fa int")
    assert [r.id for r in integrity.orphans(c, p, [("fa", "a")]).collect()] == [3]
    with pytest.raises(integrity.IntegrityError):
        integrity.restrict(c, p, [("fa", "a")])
    with pytest.raises(integrity.IntegrityError):
        integrity.check_new_config(c, "fa", False)
    with pytest.raises(integrity.IntegrityError):
        integrity.check_new_config(p, "a", True)
    with pytest.raises(integrity.IntegrityError):
        integrity.check_config_delete(True)
    integrity.check_new_config(p, "a", False)
    integrity.check_config_delete(False)


def test_retention_bounds_and_ties(spark):
    now = T(2024, 1, 31)
    rows = [("T" if i % 2 else "t", now, f"b{i}") for i in range(7)] + [("u", now - dt.timedelta(days=7), "edge"), ("u", now - dt.timedelta(days=7, seconds=1), "old")]
    df = spark.createDataFrame(rows, "table_name string, created_at timestamp_ntz, backup_name string")
    gone = retention.to_delete(df, F.lit(now).cast("timestamp_ntz"))
    assert sorted(r.backup_name for r in gone.collect()) == ["b0", "b1", "old"]


def test_scalars(spark):
    assert not scalars.is_helper("partx") and scalars.is_helper("PART_x__fk")
    with pytest.raises(ValueError):
        scalars.checked_name("a; drop")
    with pytest.raises(Exception, match="not a number"):
        spark.sql("SELECT 'abc' AS s").select(scalars.lenient_int(F.col("s"))).collect()


def test_definitions(spark, tmp_path):
    d = tmp_path / "modules" / "m" / "src-db/database/model/tables"
    d.mkdir(parents=True)
    (d / "C_LINE.xml").write_text('<?xml version="1.0"?><database><table name="C_LINE" primaryKey="LINE_KEY"><column name="ID" type="VARCHAR" size="32" required="true" primaryKey="true"/><column name="O_ID" type="VARCHAR" size="32" required="false"/><foreign-key foreignTable="C_Order" name="FK_O" onDelete="cascade"><reference local="O_ID" foreign="ID"/><reference local="X" foreign="Y"/></foreign-key></table></database>')
    files = definitions.find(str(tmp_path))
    assert len(files) == 1
    r = definitions.read(spark, files).first()
    assert (r.table_name, r.primary_key, len(r.columns), len(r["keys"][0]["references"])) == ("C_LINE", "LINE_KEY", 2, 2)
    assert definitions.newer_references(files, "c_order", 0) and not definitions.newer_references(files, "c_other", 0)
    (d / "BAD.xml").write_text('<!DOCTYPE x><table name="x"/>')
    with pytest.raises(ValueError):
        definitions.read(spark, definitions.find(str(tmp_path)))


def test_definitions_of_many_files(spark, tmp_path):
    """Order by folder, files of one name, odd characters in paths, what cannot be parsed, references by any attribute."""
    base = "modules/m+1 %20/src-db/database/model"
    for folder, body in ((f"{base}/tables/A.xml", '<table name="a" primaryKey="a_pk" isView="Y"/>'), (f"{base}/modifiedTables/A.xml", "<table name='a' primaryKey='x'><foreign-key name='f' foreignTable = 'C_Order'/></table>"), ("src-db/database/model/tables/A.xml", '<table name="b"/><table name="c" primaryKey="c_pk"/>'), ("src-db/database/model/modifiedTables/Z.xml", "<table name='z'/>"), (f"{base}/tables/BAD.xml", '<table name="bad"'), (f"{base}/tables/N.xml", '<!-- <foreign-key name="x" foreignTable="c_order"/> --><table name="n"/>')):
        p = tmp_path / folder
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f'<?xml version="1.0"?><database>{body}</database>')
    files = definitions.find(str(tmp_path))
    assert [f.removeprefix(str(tmp_path) + "/") for f in files] == [f"{base}/tables/A.xml", f"{base}/tables/BAD.xml", f"{base}/tables/N.xml", f"{base}/modifiedTables/A.xml", "src-db/database/model/tables/A.xml"]
    defs = definitions.read(spark, files)
    assert sorted((r.file_order, r.table_name, r.is_view) for r in defs.collect()) == [(0, "a", True), (2, "n", False), (3, "a", False), (4, "b", False), (4, "c", False)]
    assert definitions.key_name(defs, files) == "a_pk" and definitions.key_name(defs, files[3:]) is None and definitions.key_name(defs, files[2:3]) is None and definitions.key_name(defs, []) is None
    assert definitions.newer_references(files, "c_order", 0) and not definitions.newer_references(files[:3], "c_order", 0) and definitions.newer_references(files, "C_ORDER", 1e12)
    assert definitions.read(spark, []).isEmpty()


def test_registry(spark, tmp_path):
    now = T(2024, 1, 31)
    r = Registry(spark, str(tmp_path / "r"))
    r.ensure()
    r.ensure()
    path = str(tmp_path / "o")
    orders(spark, [(1, T(2000, 1, 1)), (2, T(2001, 1, 1))]).write.parquet(path)
    r.add("tables", [("public", "o", "r", path, None)])
    context: KeyContext = r
    assert r.table_exists("O") and r.has_column("o", "D") and not r.has_column("o", "x") and not r.has_column("x", "d")
    assert not context.is_partitioned("o") and not context.has_primary_key("o") and not r.has_unique("o")
    with pytest.raises(storage.PartitionError):
        r.table("x")
    assert r.last_processed("o") is None
    r.set_processed("O", now)
    r.set_processed("o", now + dt.timedelta(days=1))
    assert r.last_processed("o") == now + dt.timedelta(days=1) and r.get("processed").count() == 1
    for k in range(7):
        r.snapshot("o", now + dt.timedelta(seconds=k))
    gone = r.sweep(now + dt.timedelta(days=1), "O")
    assert len(gone) == 2 and r.get("backups").count() == 5 and not storage.exists(spark, f"{r.folder}/snapshots/{gone[0]}")
    assert r.sweep(now + dt.timedelta(days=1)) == []
    assert "no primary key" in related.partition(r, "o", "d")[0].message
    assert related.partition(r, "o", "d")[0].status == "SKIPPED" and r.table("o").kind == "p"
    with pytest.raises(integrity.IntegrityError):
        related.remove_config(r, "o")
    related.unpartition(r, "o")
    related.add_config(r, "o", "d")
    assert r.get("config").count() == 1
    related.remove_config(r, "o")
    assert r.get("config").isEmpty()
    r.add("keys", [("public", "o", "o_u", "u", 1, "o", None, None, None, False, True)])
    with pytest.raises(integrity.IntegrityError):
        related.add_config(r, "o", "d")
    with pytest.raises(storage.PartitionError):
        related.add_config(r, "o", "o")
    f = tmp_path / "X.xml"
    f.write_text('<table name="x"><foreign-key name="f" foreignTable="Q"/></table>')
    assert related.forced(r, [str(f)], "q", dt.datetime(2200, 1, 1)) and not related.forced(r, [str(f)], "q", now) and not related.forced(r, [str(f)], "other", now)
    r.ensure_schema("yearfold_parts")
    assert spark.catalog.databaseExists("yearfold_parts")
    spark.sql("DROP DATABASE yearfold_parts")
    with pytest.raises(ValueError):
        r.ensure_schema("a; b")


def test_related_keys(spark, tmp_path):
    """A compound key, two keys of one child, a table that refers to itself, and a failure after staging that leaves everything."""
    path, child = str(tmp_path / "p"), str(tmp_path / "c")
    spark.createDataFrame([(1, 1, None, T(2000, 1, 1)), (2, 1, 1, T(2001, 1, 1))], "a int, b int, up int, d timestamp_ntz").write.parquet(path)
    spark.createDataFrame([(1, 1, 1, 2), (2, 2, 1, 1), (3, None, 1, None)], "id int, fa int, fb int, other int").write.parquet(child)
    kids = [related.Child("c", "k1", child, (("fa", "a"), ("fb", "b"))), related.Child("c", "k2", child, (("other", "a"),)), related.Child("p", "self", path, (("up", "a"),))]
    dry, estimates = related.partition_related(spark, path, "d", kids, dry_run=True)
    assert dry.status == "SKIPPED" and [e.n_updated for e in estimates] == [2, 2, 1] and "part_d__k1" not in spark.read.parquet(child).columns
    bad, said = related.partition_related(spark, path, "d", [*kids, related.Child("gone", "k", str(tmp_path / "gone"), (("x", "a"),))])
    assert bad.status == "FAILURE" and "gone" in bad.message and {x.status for x in said} == {"FAILURE"}
    assert spark.read.parquet(child).columns == ["id", "fa", "fb", "other"] and not storage.is_partitioned(spark, path)
    done, said = related.partition_related(spark, path, "d", kids)
    assert done.status == "SUCCESS" and [x.n_updated for x in said] == [2, 2, 1]
    rows = {r.id: (r.part_d__k1, r.part_d__k2) for r in spark.read.parquet(child).collect()}
    assert rows == {1: (T(2000, 1, 1), T(2001, 1, 1)), 2: (T(2001, 1, 1), T(2000, 1, 1)), 3: (None, None)}
    assert {r.a: r.part_d__self for r in spark.read.parquet(path).collect()} == {1: None, 2: T(2000, 1, 1)}
    assert sorted(os.listdir(tmp_path)) == ["c", "p"]


def test_publish_all_comes_back(spark, tmp_path):
    for n in ("a", "b", "a.new"):
        spark.range(1 if n == "a.new" else 3).write.parquet(str(tmp_path / n))
    with pytest.raises(Exception):  # noqa: B017
        storage.publish_all(spark, [(str(tmp_path / "a.new"), str(tmp_path / "a")), (str(tmp_path / "missing"), str(tmp_path / "b"))])
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 3


def test_repeated_keys_raise(spark):
    parent = spark.createDataFrame([(1, T(2000, 1, 1)), (1, T(2001, 1, 1)), (None, T(2002, 1, 1)), (None, T(2003, 1, 1))], "a int, d timestamp_ntz")
    child = spark.createDataFrame([(1, 1)], "id int, fa int")
    for run in (propagate.sync, propagate.fill, propagate.estimate):
        with pytest.raises(Exception, match="not unique"):
            run(child, parent, [("fa", "a")], "d", "h").collect()
        assert run(child, parent.where("a IS NULL OR d = '2000-01-01'"), [("fa", "a")], "d", "h").count() == 1
    one = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    assert set(map(tuple, retention.upsert(one, one.withColumn("v", F.lit(9)), "k").collect())) == {(None, 9), ("x", 9)}
    with pytest.raises(Exception, match="repeat"):
        retention.upsert(one, one.union(one), "k").collect()


def test_command_line(spark, tmp_path):
    r = more_queries._full_registry(spark, SF) if os.path.isdir(SF) else None
    if r is None:
        pytest.skip("no test data")
    said = []
    assert cli.main(["partition", "--registry", r.folder, "--tables", "orders", "--dry-run"], spark, say=said.append) == 0
    assert said[0].startswith("1. check field orders") and any("ESTIMATE lineitem" in x for x in said) and not r.is_partitioned("orders")
    assert cli.main(["partition", "--registry", r.folder, "--tables", "orders"], spark, ask=lambda _: "no", say=said.append) == 1
    assert cli.main(["partition", "--registry", r.folder, "--tables", "orders", "--plain-output"], spark, ask=lambda _: "yes", say=said.append) == 0
    assert "SUCCESS orders: 1500 rows" in said[-1] and "1 done, 0 skipped, 0 failed" in said[-1] and r.is_partitioned("orders")
    assert cli.main(["partition", "--registry", r.folder, "--yes"], spark, say=said.append) == 1 and "FAILURE nation" in said[-1] and "SKIPPED orders" in said[-1]
    assert cli.main(["unpartition", "--registry", r.folder, "--tables", "orders", "--yes"], spark, say=said.append) == 0 and not r.is_partitioned("orders")
    with pytest.raises(storage.PartitionError):
        cli.configured(r, "orders")
    assert "\033[31mFAILURE" in cli.report([storage.Outcome("t", "FAILURE", "x")], plain=False)


def test_exclude_filter_file(spark, tmp_path):
    import xml.etree.ElementTree as ElementTree

    names = spark.createDataFrame([("column", "A<B"), ("trigger", "T"), ("function", "F"), ("primary key", "P"), ("foreign key", "K")], "kind string, name string")
    rebuild.write_exclude_filter(names, str(tmp_path / "f.xml"))
    found = [(e.tag, e.get("name")) for e in ElementTree.parse(tmp_path / "f.xml").getroot()]
    assert sorted(found) == [("excludedColumn", "A<B"), ("excludedConstraint", "K"), ("excludedConstraint", "P"), ("excludedFunction", "F"), ("excludedTrigger", "T")]


def test_properties(tmp_path):
    f = tmp_path / "p.properties"
    f.write_text("# c\nbbdd.url=jdbc\\:postgresql\\://h:5432\nbbdd.sid=s\nbbdd.user = u\nbbdd.password: p\n")
    assert definitions.connection(definitions.properties(str(f)))["url"] == "jdbc:postgresql://h:5432/s"
    with pytest.raises(ValueError):
        definitions.connection({"bbdd.url": "jdbc:other:x"})
    with pytest.raises(KeyError):
        definitions.connection({})
    with pytest.raises(ValueError):
        definitions.connection({"bbdd.rdbms": "ORACLE"})


def test_plans(spark):
    p = rebuild.partition_plan(spark, "t", "d", ["a", "b"]).collect()
    assert [r.action for r in p][:3] == ["check field", "sync related tables", "sync related tables"] and len(p) == 10
    assert "excludedColumn" in rebuild.exclude_xml(spark.sql("SELECT 'column' AS kind, 'A' AS name"))


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 5, None), (2, 6, None)], "id int, o int, h timestamp_ntz").write.parquet(src)
    parent = orders(spark, [(5, T(2000, 1, 1))])
    stream = spark.readStream.schema("id int, o int, h timestamp_ntz").parquet(src)
    q = enrich.start(stream, lambda: parent, [("o", "o")], "d", "h", out, str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {r.id: r.h for r in spark.read.parquet(out).collect()} == {1: T(2000, 1, 1), 2: None}
