import pytest

from ferrule.errors import ExecutionError
from ferrule.session import Engine
from ferrule.streaming.follow import arriving, follow


def test_groups_over_arriving_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("k,v\nx,1\ny,20\n")
    engine = Engine(spark)
    engine.register("t", arriving(spark, str(folder), "k string, v string", "csv"))
    engine.register("names", spark.createDataFrame([("x", "ex")], "k2 string, name string"))
    text = "from t where v < 100 group by k select k, sum(v) as total"
    for extra, want in ((None, {"x": 1.0, "y": 20.0}), ("k,v\nx,5\nx,500\n", {"x": 6.0, "y": 20.0})):
        if extra:
            (folder / "b.csv").write_text(extra)
        query = follow(engine, text, str(tmp_path / f"state{extra is None}"), name=f"totals{extra is None}", mode="complete", once=True)
        query.awaitTermination()
        assert {r.k: r.total for r in spark.table(query.name).collect()} == want
    query = follow(engine, "from t join names on k == k2 where v > 2 select name, v", str(tmp_path / "s2"), into=str(tmp_path / "out"), once=True)
    query.awaitTermination()
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["5", "500"]


def test_follow_needs_a_stream(spark, tmp_path):
    engine = Engine(spark)
    engine.register("t", spark.range(3))
    with pytest.raises(ExecutionError):
        follow(engine, "from t select id", str(tmp_path))
    with pytest.raises(ExecutionError):
        arriving(spark, str(tmp_path), "a string", "doc")
