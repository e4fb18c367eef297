import pytest

from ferrule.errors import ExecutionError, LexerError, ParserError, QueryError, SecurityError
from ferrule.functions.suggest import edits, hint
from ferrule.limits import Limits
from ferrule.plans.parser import parse
from ferrule.plans.syntax import Binary, Call, Simple, Union, text_of
from ferrule.plans.tokens import tokenize
from ferrule.session import Engine


def test_tokens_have_places():
    tokens = tokenize("from a.csv -- note\n where x >= 1.5 select 'y'", Limits())
    assert [t.value for t in tokens] == ["from", "a.csv", "where", "x", ">=", "1.5", "select", "y", ""]
    assert (tokens[2].line, tokens[2].column) == (2, 2)


def test_clauses_come_in_any_order():
    a = parse("from f.csv where x == 1 select y order by y limit 3")
    b = parse("limit 3 order by y select y where x = 1 from f.csv")
    assert a == b
    assert isinstance(a.body, Simple) and a.body.limit == 3


def test_precedence():
    where = parse("from f select a where a == 1 or b > 2 and c < 3 + 4 * 5").body.where
    assert isinstance(where, Binary) and where.op == "or" and where.right.op == "and"
    assert text_of(where.right.right.right) == "3 + 4 * 5"


def test_canonical_text():
    out = parse("from f select Concat(a,upper(b)), count( * ), x is not null").body.select
    assert [text_of(o.expr) for o in out] == ["Concat(a, upper(b))", "count(*)", "x is not null"]
    assert isinstance(out[0].expr, Call)


def test_unions_lean_left():
    body = parse("from a select x union from b select x union all from c select x").body
    assert isinstance(body, Union) and body.keep_all and isinstance(body.left, Union)


@pytest.mark.parametrize(
    "text",
    [
        "", "from", "from a.csv", "select x", "from a.csv order by select x", "from a.csv select", "from a.csv select x where",
        "from a.csv select x limit", "from a.csv select x limit abc", "from a.csv select x limit 0", "from a.csv select x limit 99999999999",
        "from a.csv from b.csv select x", "from a.csv select x select y", "from a.csv select x where a == 1 where b == 2",
        "from a.csv select x )", "from (from a.csv select x select y", "from a.csv select *, x", "from a.csv join b.csv select x",
        "from (from a.csv select x into b.csv) select x", "with a as from b select x", "from a.csv select (x", "from a.csv select x y",
    ],
)
def test_malformed_queries_raise(text):
    with pytest.raises(ParserError):
        parse(text)


@pytest.mark.parametrize("text", ["from a.csv select x ;", "from 'a.csv select x", "from a.csv where x ! 3 select x"])
def test_unknown_characters_raise(text):
    with pytest.raises(LexerError):
        parse(text)


def test_errors_have_line_and_column():
    with pytest.raises(ParserError, match="line 2, column 7") as e:
        parse("from a.csv\nselect")
    assert e.value.line == 2


def test_limits():
    with pytest.raises(SecurityError):
        parse(f"from a.csv select x where x == '{'y' * 9000}'")
    with pytest.raises(SecurityError):
        parse("from a.csv where " + "(" * 150 + "x == 1" + ")" * 150 + " select x")
    with pytest.raises(SecurityError):
        parse("from (" * 200 + "from a.csv select x" + " select x)" * 200)
    with pytest.raises(SecurityError):
        parse("from a.csv select a, b, c, d", Limits(nodes=3))
    with pytest.raises(SecurityError):
        parse("from a.csv select x " + " " * 70_000)
    with pytest.raises(SecurityError):
        parse("from a.csv select x", Limits(tokens=2))
    parse("from a.csv where " + "(" * 100 + "x == 1" + ")" * 100 + " select x")


def test_output_names_are_unique(engine):
    assert engine.sql("from t select id, id, name as id_2").columns == ["id", "id_3", "id_2"]
    assert engine.sql("from t select name as id_2, id, id").columns == ["id_2", "id", "id_3"]


def test_set_operations_lean_left(engine):
    assert [r.id for r in engine.sql("from t select id except from u select key").collect()] == [2]
    assert [r.id for r in engine.sql("from t select id intersect from u select key").collect()] == [1]
    assert sorted(r.id for r in engine.sql("from t select id union all from t select id except all from u select key").collect()) == [1, 2, 2]


def test_in_query(spark, engine):
    engine.register("n", spark.createDataFrame([(1,), (None,)], "k int"))
    assert [r.id for r in engine.sql("from t where id in (from n select k) and val < 0 select id").collect()] == [1]
    assert engine.sql("from t where id not in (from n select k) select id").count() == 0  # a null may be any value
    assert [r.id for r in engine.sql("from t where id not in (from u select key) select id").collect()] == [2]
    for text in ("from t where id in (from u select key, item) select id", "from t where id in (from u select key) or id == 2 select id"):
        with pytest.raises(ExecutionError):
            engine.sql(text)


def test_offset_and_nulls(spark, engine):
    engine.register("n", spark.createDataFrame([(2,), (None,), (1,), (3,)], "k int"))
    ks = lambda text: [r.k for r in engine.sql(text).collect()]
    assert ks("from n select k order by k nulls last") == [1, 2, 3, None] and ks("from n select k order by k desc nulls first") == [None, 3, 2, 1]
    assert ks("from n select k order by k offset 1 limit 2") == [1, 2] and ks("from n select k order by k offset 3") == [3]


def test_suggestions():
    assert edits("kitten", "sitting") == 3 and edits("", "abc") == 3 and edits("age", "age") == 0
    assert hint("agge", ["name", "age"]) == " (Did you mean 'age'?)"
    assert hint("zzzzzz", ["name"]) == ""


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, "a", -5.0), (2, "b", 2.5)], "id int, name string, val double"))
    e.register("u", spark.createDataFrame([(1, "x")], "key int, item string"))
    return e


@pytest.mark.parametrize(
    "text",
    [
        "from t select nme", "from t where agee == 1 select id", "from t where 1 == 1 select id", "from t where upper(name) select id",
        "from t select upper()", "from t select upper(id, name)", "from t select nosuch(id)", "from t select abs()", "from t select round(id, 1)",
        "from t select abs('x')", "from t select sum()", "from t select sum(id, val)", "from t where sum(id) > 1 select id", "from t having id > 1 select id",
        "from t group by nosuch select count(*)", "from t join u on id == nosuch select id", "from t order by nosuch select id",
        "from t select sum(max(id))", "from t group by id select *, count(*)", "from nosuch select x", "from x.doc select y", "from '../x.csv' select y",
        "from nosuch.csv select x", "from t select id union from u select key, item", "from t group by id having count(*) select id",
    ],
)
def test_wrong_queries_raise(engine, text):
    with pytest.raises(QueryError):
        engine.sql(text).collect()


def test_unknown_field_has_a_hint(engine):
    with pytest.raises(ExecutionError, match=r"Unknown field: nam \(Did you mean 'name'\?\)"):
        engine.sql("from t select nam")


def test_like_takes_backslashes_and_long_patterns(spark, engine):
    engine.register("s", spark.createDataFrame([("a\\b",), ("a" * 500,)], "x string"))
    assert engine.sql(r"from s where x like 'a\_' select x").count() == 1
    assert engine.sql(f"from s where x like '{'%' + 'a' * 400 + 'b'}' select x").count() == 0


def test_row_limit_and_timeout(spark, engine):
    engine.register("many", spark.range(20_000).withColumnRenamed("id", "n"))
    with pytest.raises(SecurityError, match="more than"):
        list(Engine.run(_with(engine, Limits(rows=10_000)), "from many select n"))
    with pytest.raises(SecurityError, match="timeout"):
        list(Engine.run(_with(engine, Limits(timeout_ms=0)), "from many select n"))
    assert len(list(Engine.run(_with(engine, Limits(rows=20_000, timeout_ms=600_000)), "from many select n"))) == 20_001


def test_timeout_interrupts(spark, engine):
    engine.register("slow", spark.range(1 << 34).selectExpr("id % 7 as k"))
    with pytest.raises(SecurityError, match="timeout"):
        list(Engine.run(_with(engine, Limits(timeout_ms=700)), "from slow group by k select k, count(*)"))


def _with(engine, limits):
    other = Engine(engine.spark, limits)
    other.tables = engine.tables
    return other


def test_recursion_is_limited(engine):
    with pytest.raises(SecurityError, match="recursion"):
        _with(engine, Limits(recursion_levels=3)).sql("with recursive r as (from t select id union all from r select id) from r select id")


def test_recursive_union_ends_on_a_cycle(spark, engine):
    engine.register("edges", spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a int, b int"))
    got = engine.sql("with recursive r as (from edges where a == 1 select a as n union from r join edges on n == a select b as n) from r select n")
    assert sorted(x.n for x in got.collect()) == [1, 2, 3]
