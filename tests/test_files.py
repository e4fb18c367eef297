import json
import sqlite3

import pytest

from ferrule import cli
from ferrule.errors import QueryError, SecurityError
from ferrule.functions.typed import number_in
from ferrule.limits import Limits
from ferrule.session import Engine
from ferrule.sources.registry import READERS, register


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, base=str(tmp_path))


def got(engine, text):
    return [tuple(r) for r in engine.sql(text).collect()]


def test_csv_cells(engine, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,name,note\r\n1,"a, ""b""","two\nlines"\r\n\r\n2,short\r\n3,x,y,extra\r\n')
    assert got(engine, "from a.csv select id, name, note") == [("1", 'a, "b"', "two\nlines"), ("2", "short", None), ("3", "x", "y")]


def test_large_csv_is_split_unless_a_field_has_line_breaks(engine, tmp_path, monkeypatch):
    from ferrule.sources import text

    monkeypatch.setattr(text, "ONE_SPLIT", 10)
    (tmp_path / "plain.csv").write_text("id,name\n" + "".join(f"{i},n{i}\n" for i in range(100)))
    (tmp_path / "broken.csv").write_text('id,name\n1,"a\nb"\n2,c\n')
    assert got(engine, "from plain.csv select count(*)") == [(100,)]
    assert got(engine, "from broken.csv select id, name") == [("1", "a\nb"), ("2", "c")]


def test_numbers_in_texts(engine, tmp_path):
    (tmp_path / "v.csv").write_text("k,v\na,9\nb,10\nc,x\nd,-3\ne,\n")
    assert [r[0] for r in got(engine, "from v.csv where v > 5 select k order by k")] == ["a", "b", "c"]  # x > 5 as texts
    assert got(engine, "from v.csv select sum(v), avg(v), min(v), max(v), count(v)") == [(16.0, 16 / 3, -3.0, 10.0, 5)]
    assert [r[0] for r in got(engine, "from v.csv where v != '' select k order by v")][:3] == ["d", "a", "b"]
    assert got(engine, "from v.csv where v == '9.0' select k") == [("a",)]


def test_negative_maximum(engine, tmp_path):
    (tmp_path / "n.csv").write_text("v\n-5\n-2\n")
    assert got(engine, "from n.csv select max(v)") == [(-2.0,)]


def test_text_keys_join_as_texts(engine, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("uid,item\n1,i\n1.0,j\n2,k\n")
    df = engine.sql("from a.csv join b.csv on id == uid select name, item order by item")
    assert [tuple(r) for r in df.collect()] == [("x", "i"), ("y", "k")]
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_tsv_and_json(engine, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tname\n1\ta,b\n")
    assert got(engine, "from a.tsv select name") == [("a,b",)]
    (tmp_path / "a.json").write_text('[\n {"id": 1, "name": "x\\"y"},\n {"id": 2.50, "flag": true, "none": null}\n]')
    assert got(engine, "from a.json select id, name, flag order by id") == [("1", 'x"y', None), ("2.50", None, "true")]
    (tmp_path / "l.json").write_text('{"id": 1}\n{"id": 2}\n')
    assert got(engine, "from l.json where id > 1 select id") == [("2",)]


@pytest.mark.parametrize("text", ['{"id": 1, "name": ', '[{"id": 1}, {"id": 2', "nonsense"])
def test_broken_json_raises(engine, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(QueryError):
        engine.sql("from bad.json select id").collect()


ODD = [{"id": 1, "t": '}, {"id": 9}]', "n": 2.50}, {"id": 2, "t": "it's \\\" é\n", "n": {"a": [{"b": 1.0}, {}]}}, {}, {"id": 3, "n": None}] + [{"id": i, "t": "x" * (i % 7)} for i in range(4, 60)]
ODD_ROWS = [("1", '}, {"id": 9}]', "2.5"), ("2", "it's \\\" é\n", '{"a": [{"b": 1.0}, {}]}'), (None, None, None), ("3", None, None)] + [(str(i), "x" * (i % 7), None) for i in range(4, 60)]


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Files of a few hundred bytes are large and have many splits."""
    from ferrule.sources import text

    monkeypatch.setattr(text, "ONE_SPLIT", 10)
    sizes = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "150"}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    yield
    for key in sizes:
        spark.conf.unset(key)


@pytest.mark.parametrize(
    "form",
    [
        lambda rows: "[\n" + ",\n".join(map(json.dumps, rows)) + "\n]\n",
        lambda rows: "[\r\n" + ",\r\n".join(map(json.dumps, rows)) + "\r\n]\r\n",
        lambda rows: json.dumps(rows, ensure_ascii=False),
        lambda rows: "\n [" + "\n,".join(map(json.dumps, rows)) + "] ",
        lambda rows: "[\n" + ",\n".join(f"{json.dumps(a)}, {json.dumps(b)}" for a, b in zip(rows[::2], rows[1::2], strict=True)) + "\n]",
    ],
)
def test_large_json_arrays_are_split(engine, tmp_path, small_splits, form):
    """In any form: rows are whole, in the file's order and as they are spelled, whatever their strings hold."""
    (tmp_path / "a.json").write_bytes(form(ODD).encode())
    df = engine.sql("from a.json select id, t, n")
    assert [tuple(r) for r in df.collect()] == ODD_ROWS
    assert df.rdd.getNumPartitions() > 3
    assert got(engine, "from a.json select count(*)") == [(len(ODD),)]
    assert len(got(engine, "from a.json where id > 50 select id")) == 9


def test_large_json_arrays_in_folders(engine, tmp_path, small_splits):
    (tmp_path / "many.json").mkdir()
    for i, indent in enumerate((None, 1, 3)):
        (tmp_path / "many.json" / f"{i}.json").write_text(json.dumps([{"id": i * 100 + j, "n": {"v": [j]}} for j in range(30)], indent=indent))
    assert sorted(int(r[0]) for r in got(engine, "from many.json select id")) == [i * 100 + j for i in range(3) for j in range(30)]


@pytest.mark.parametrize("end", ["", ", 5]", ", {]", ",\n]", "}]", ' {"id": 3}]', "\n {}\n]", ', [{"id": 3}]]', '\n,{"id": "\x1e"}]'])
def test_large_broken_json_arrays_raise(engine, tmp_path, small_splits, end):
    for name, start in (("lines", '[\n{"id": 1},\n{"id": 2}'), ("dense", '[{"id": 1},{"id": 2}')):
        (tmp_path / f"{name}.json").write_text(start + end)
        with pytest.raises(Exception):  # noqa: B017
            engine.sql(f"from {name}.json select id").collect()


def test_json_arrays_are_read_once(spark, engine, tmp_path):
    """Numbers in an array cost no reading of their own."""
    rows = [{"id": i, "v": i / 2, "w": i % 3 > 1} for i in range(20_000)]
    (tmp_path / "n.json").write_text(json.dumps(rows))
    spark.sparkContext.setJobGroup("json once", "")
    try:
        assert len(got(engine, "from n.json select id, v, w")) == len(rows)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    context, tracker = spark.sparkContext._jsc.sc(), spark.sparkContext.statusTracker()
    context.listenerBus().waitUntilEmpty()
    stages = [s for job in tracker.getJobIdsForGroup("json once") for s in tracker.getJobInfo(job).stageIds]
    assert 0 < max(context.statusStore().lastStageAttempt(s).inputBytes() for s in stages) < 2 * (tmp_path / "n.json").stat().st_size


def test_xml(engine, tmp_path):
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?><!-- <no><such> --><rows>\n<row a='1'><id>1</id><name> A &amp; B </name></row>\n<row><id>2</id></row></rows>")
    assert got(engine, "from a.xml select id, name order by id") == [("1", "A & B"), ("2", None)]
    (tmp_path / "empty.xml").write_text("<rows></rows>")
    (tmp_path / "nested.xml").write_text("<rows><row><id><x>1</x></id></row></rows>")
    for name in ("empty.xml", "nested.xml"):
        with pytest.raises(QueryError):
            engine.sql(f"from {name} select id").collect()


def test_yaml(engine, tmp_path):
    (tmp_path / "a.yaml").write_text("# note\ntitle\n- id: 1\n  name: \"a: b\"\n\n  # more\n- id: 2\n  extra: 'q'\n- name: last")
    assert got(engine, "from a.yaml select *") == [("1", "a: b", None), ("2", None, "q"), (None, "last", None)]
    (tmp_path / "indented.yml").write_text("  - id: 1\n    name: x\n  - id: 2\n    name: y\n")
    assert got(engine, "from indented.yml where id > 1 select name") == [("y",)]
    (tmp_path / "none.yaml").write_text("a: 1\n")
    with pytest.raises(QueryError):
        engine.sql("from none.yaml select a")


def test_sqlite(engine, tmp_path):
    db = sqlite3.connect(tmp_path / "a.db")
    db.execute("CREATE TABLE t (id INTEGER, name TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", [(1, "x"), (2, None)])
    db.execute('CREATE TABLE "odd name" (v)')
    db.execute('INSERT INTO "odd name" VALUES (7)')
    db.commit()
    db.close()
    assert got(engine, "from a.db select id, name order by id") == [("1", "x"), ("2", None)]
    assert got(engine, "from a.db:t where id == 2 select id") == [("2",)]
    assert got(engine, "from 'a.db:odd name' select v") == [("7",)]
    for source in ("a.db:nosuch", "none.db"):
        with pytest.raises(QueryError):
            engine.sql(f"from {source} select id")


def test_sqlite_ranges_follow_the_rows(spark, engine, tmp_path):
    """Two rows far apart are one partition; only the columns that a query mentions are read, near misses for the hint besides."""
    db = sqlite3.connect(tmp_path / "wide.db")
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, blob BLOB)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(1, "x", b"\x01"), (5_000_000_000, "y", None)])
    db.commit()
    db.close()
    df = engine.sql("from wide.db where id > 1 select name")
    assert [tuple(r) for r in df.collect()] == [("y",)] and df.rdd.getNumPartitions() == 1
    assert "blob" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert got(engine, "from wide.db select *") == [("1", "x", "01"), ("5000000000", "y", None)]
    with pytest.raises(QueryError, match="Did you mean 'name'"):
        engine.sql("from wide.db select nme")


def test_number_texts_have_no_suffix(engine, tmp_path):
    (tmp_path / "n.csv").write_text("k\n12d\n12f\n12\n0x1p2\n0x10\n 3\n3 \n1_0\n-Infinity\nnan\n1e1000\n+.5\n")
    assert [r[0] for r in got(engine, "from n.csv where k == 12 select k")] == ["12"]
    assert [r[0] for r in got(engine, "from n.csv where k == 16 select k")] == ["0x10"]
    assert got(engine, "from n.csv where k < 100 and k > 0 and k != 'nan' select sum(k)") == [(12 + 4 + 16 + 3 + 0.5,)]
    for text in ("12d", "3 ", "1_0", "0x", ""):
        assert number_in(text) is None
    assert (number_in("0x10"), number_in(" 3"), number_in("-inf")) == (16.0, 3.0, float("-inf"))
    with pytest.raises(Exception, match="not a number: 12d"):
        engine.sql("from n.csv where k == '12d' select abs(k)").collect()


def test_long_beginnings(engine, tmp_path, monkeypatch):
    """Nothing is refused for what stands further on than the part looked at first."""
    (tmp_path / "long.json").write_text('{"id": 1, "text": "' + "x" * 100_000 + '"}\n{"id": 2}\n')
    assert got(engine, "from long.json select id") == [("1",), ("2",)]
    (tmp_path / "one.json").write_text('{\n "id": 1,\n "text": "' + "x" * 100_000 + '"\n}')
    assert got(engine, "from one.json select id") == [("1",)]
    (tmp_path / "long.yaml").write_text("# " + "x" * 100_000 + "\nkey: no\n- id: 1\n- id: 2\n")
    assert got(engine, "from long.yaml select id") == [("1",), ("2",)]
    (tmp_path / "long.xml").write_text("<!-- " + "<no><such> " * 10_000 + " --><rows><row><id>1</id></row></rows>")
    assert got(engine, "from long.xml select id") == [("1",)]


def test_yaml_line_ends_repeated_keys_and_folders(engine, tmp_path):
    (tmp_path / "crlf.yaml").write_bytes(b"# note\r\n- id: 1\r\n  name: x\r\n- id: 2\r\n  name: y\r\n  name: z\r\n")
    assert got(engine, "from crlf.yaml select id, name") == [("1", "x"), ("2", "z")]
    (tmp_path / "many.yaml").mkdir()
    for i in range(3):
        (tmp_path / "many.yaml" / f"part{i}.yaml").write_text(f"title: head {i}\n- id: {i}\n- id: {i + 10}\n")
    (tmp_path / "many.yaml" / "part3.yaml").write_text("- id: 3")
    assert sorted(got(engine, "from many.yaml select id")) == sorted((str(i),) for i in (0, 1, 2, 3, 10, 11, 12))


def test_a_source_can_be_replaced(spark, engine, tmp_path):
    """The old file stays until the new one is whole, also when the query fails."""
    for name in ("o.parquet", "o.csv", "o.json"):
        engine.register("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"))
        list(engine.run(f"from t select * into {name}"))
        list(engine.run(f"from {name} where id > 1 select id, name into {name}"))
        assert [str(r[0]) for r in got(engine, f"from {name} select id")] == ["2"]
        with pytest.raises(Exception):
            list(engine.run(f"from {name} select id, abs(name) into {name}"))
        assert [str(r[0]) for r in got(engine, f"from {name} select id")] == ["2"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["o.csv", "o.json", "o.parquet"]


def test_registered_source(spark, engine):
    register(".made", lambda spark, path: spark.createDataFrame([(path.rpartition("/")[2],)], "name string"))
    try:
        assert got(engine, "from x.made select name") == [("x.made",)]
    finally:
        del READERS[".made"]


def test_file_size_and_paths(spark, tmp_path):
    (tmp_path / "big.yaml").write_text("- a: 1\n" * 100)
    with pytest.raises(SecurityError):
        Engine(spark, Limits(file_bytes=100), base=str(tmp_path)).sql("from big.yaml select a")
    engine = Engine(spark, base=str(tmp_path))
    engine.register("t", spark.range(1))
    for text in ("from 'x/../y.csv' select a", "from t select id into '../out.csv'"):
        with pytest.raises(SecurityError):
            list(engine.run(text))


def test_exports(spark, engine, tmp_path):
    engine.register("t", spark.createDataFrame([(1, 'a "b", c\nd', 2.5), (2, None, None), (3, "é", -1.0)], "id int, name string, v double"))
    for name in ("o.csv", "o.tsv", "o.json"):
        assert list(engine.run(f"from t select * order by id into {name}")) == []
        assert len(got(engine, f"from {name} select id")) == 3
    assert json.loads((tmp_path / "o.json").read_text()) == [{"id": 1, "name": 'a "b", c\nd', "v": 2.5}, {"id": 2, "name": None, "v": None}, {"id": 3, "name": "é", "v": -1.0}]
    assert got(engine, "from o.csv select name, v order by id")[0] == ('a "b", c\nd', "2.5")
    list(engine.run("from t where id > 9 select * into e.json"))
    assert json.loads((tmp_path / "e.json").read_text()) == []
    list(engine.run("from t where id > 9 select * into e.csv"))
    assert (tmp_path / "e.csv").read_text() == "id,name,v\n"
    list(engine.run("from t select * into parts.json", single_file=False))
    assert (tmp_path / "parts.json").is_dir()
    with pytest.raises(QueryError):
        list(engine.run("from t select * into x.doc"))


def test_forms(spark, engine):
    engine.register("t", spark.createDataFrame([(1, "a,b", 2.0)], "id int, name string, v double"))
    run = lambda form: "".join(engine.run("from t select *", form))
    assert run("csv") == 'id,name,v\n1,"a,b",2\n'
    assert run("tsv") == "id\tname\tv\n1\ta,b\t2\n"
    assert json.loads(run("json")) == [{"id": 1, "name": "a,b", "v": 2.0}]
    assert run("table").splitlines()[1] == "| id | name | v |"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "spark_session", lambda: spark)
    (tmp_path / "a.csv").write_text("id,age\n1,30\n2,20\n")
    query = f"from '{tmp_path}/a.csv' where age > 25 select id"
    assert cli.main([query]) == 0 and capsys.readouterr().out == "id\n1\n"
    assert cli.main(["--format", "table", "--time", query]) == 0 and "Execution time" in capsys.readouterr().err
    assert cli.main(["--quiet", query]) == 0 and capsys.readouterr().out == ""
    (tmp_path / "q.txt").write_text(query + "\n-- done\n")
    assert cli.main(["run", str(tmp_path / "q.txt"), str(tmp_path / "q.txt")]) == 0 and capsys.readouterr().out == "id\n1\n" * 2
    assert cli.main(["from nosuch.csv select x"]) == 1 and "Error:" in capsys.readouterr().err
    assert cli.main(["--max-file-size", "3", query]) == 1 and "limit is 3" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main(["--max-rows", "many", query])
    with pytest.raises(SystemExit):
        cli.main(["--version"])


def test_shell(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("id\n1\n")
    cli.shell(Engine(spark, base=str(tmp_path)), cli.arguments().parse_args([]), iter(["from a.csv select id;", "", "from a.csv select nosuch", "exit", "never"]))
    out = capsys.readouterr()
    assert out.out == "id\n1\n" and "Unknown field" in out.err
