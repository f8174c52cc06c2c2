"""Changes over several tables: all or nothing, emptied scopes, lost races, clean-up."""

import pytest
from pyspark.sql import functions as F

from signalmill.operators.resolve import fold_modifiers_in
from signalmill.sources.sinks import purge_tenant, replace_snapshot
from signalmill.sources.versions import Change, TableSet


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def tables(spark, tmp_path):
    t = TableSet(spark, f"{tmp_path}/set")
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "z")], "tenant int, v string")
    t.change().replace("a", a, "tenant").replace("b", a.withColumn("w", F.lit(1))).commit()
    return t


def test_scopes_are_replaced_and_emptied(spark, tables):
    new = spark.createDataFrame([(2, "new"), (3, "new")], "tenant int, v string")
    replace_snapshot(tables, "a", new, [2, 3, None])
    assert rows(tables.read("a")) == [(1, "x"), (1, "y"), (2, "new"), (3, "new")]
    replace_snapshot(tables, "a", new.where("false"), [1, 3])
    assert rows(tables.read("a")) == [(2, "new")]
    replace_snapshot(tables, "a", new.where("false"), [2])
    assert rows(tables.read("a")) == [] and tables.read("a").columns == ["tenant", "v"]
    assert rows(tables.read("a", 1)) == [(1, "x"), (1, "y"), (2, "x"), (None, "z")]  # an older version stays readable


def test_rows_outside_the_scope_are_an_error(spark, tables):
    with pytest.raises(Exception, match="outside the scope"):
        replace_snapshot(tables, "a", spark.createDataFrame([(9, "q")], "tenant int, v string"), [1])
    assert tables.version() == 1


def test_values_that_folders_escape(spark, tables):
    odd = ["a/b=c", "ü %", "x:y", "plain"]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(odd)], "k string, n int")
    tables.change().replace("odd", df, "k").commit()
    replace_snapshot(tables, "odd", df.where("n = 1").withColumn("n", F.lit(7)), odd[:2])
    assert rows(tables.read("odd")) == [("plain", 3), ("x:y", 2), ("ü %", 7)]


@pytest.mark.parametrize("at", [1, 2, 3])
def test_a_failure_shows_the_old_state_of_all_tables(spark, tmp_path, monkeypatch, at):
    t = TableSet(spark, f"{tmp_path}/fold")
    e = spark.createDataFrame([("vegan", 3), ("vegan cheese", 9)], "entity string, total_mentions long")
    s = spark.createDataFrame([(1, "vegan"), (2, "vegan cheese")], "item_id long, entity string")
    i = spark.createDataFrame([(1, False), (2, False)], "item_id long, archived boolean")
    t.change().replace("entities", e).replace("states", s).replace("items", i).commit()
    write, done = Change._write, []

    def failing(self, *a):
        done.append(a)
        if len(done) == at:
            raise OSError("disk full")
        return write(self, *a)

    monkeypatch.setattr(Change, "_write", failing)
    with pytest.raises(OSError):
        fold_modifiers_in(t)
    monkeypatch.undo()
    assert t.version() == 1 and "synonyms" not in t.manifest()
    assert rows(t.read("entities")) == [("vegan cheese", 9), ("vegan", 3)] and rows(t.read("items")) == [(1, False), (2, False)]
    assert fold_modifiers_in(t) == 2  # again, from the old state
    assert rows(t.read("synonyms")) == [("vegan", "vegan cheese")]
    assert rows(t.read("entities")) == [("vegan cheese", 9, False), ("vegan", 3, True)] and rows(t.read("items")) == [(1, True), (2, False)]


def test_lost_race_and_clean_up(spark, tables):
    one, two = tables.change(), tables.change()
    new = spark.createDataFrame([(5, "n")], "tenant int, v string")
    one.replace("a", new, "tenant").commit()
    two.replace("b", new.withColumn("w", F.lit(2)))
    with pytest.raises(RuntimeError):
        two.commit()
    assert rows(tables.read("a")) == [(5, "n")] and len(rows(tables.read("b"))) == 4
    gone = tables.vacuum(keep=1)
    assert len([g for g in gone if g.startswith("a/")]) == 1 and len([g for g in gone if g.startswith("b/")]) == 1
    assert rows(tables.read("a")) == [(5, "n")] and len(rows(tables.read("b"))) == 4 and tables.version() == 2


def test_purge_reports_and_removes(spark, tables):
    config = spark.createDataFrame([(1, 3)], "tenant int, floor int")
    tables.change().replace("config", config).commit()
    assert rows(purge_tenant(tables, ["a", "b"], 1)) == [("a", 2), ("b", 2)]
    assert rows(tables.read("a")) == [(2, "x"), (None, "z")] and rows(tables.read("b")) == [(2, "x", 1), (None, "z", 1)] and rows(tables.read("config")) == [(1, 3)]
    assert rows(purge_tenant(tables, ["a", "b"], 1)) == [("a", 0), ("b", 0)]
