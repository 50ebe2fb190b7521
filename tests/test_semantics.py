"""Pinned results of the dialect on small tables."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.functions import conditional, datetime, json, math, strings
from lakemill.operators import aggregates, dml, geo, relational, security, shapes, text, tvf
from lakemill.plans import ddl, operators
from lakemill.plans.rewrite import rewrite, sql
from lakemill.sources import catalog, io
from lakemill.streaming import changes
from tests.conftest import SF


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_strings(spark):
    lit = F.lit
    assert one(spark, strings.concat(lit("a"), lit(None), lit("b")), strings.concat(lit(None))) == ("ab", "")
    assert one(spark, strings.lower(lit("ÉAb")), strings.upper(lit("éaB"))) == ("Éab", "éAB")
    assert one(spark, strings.trim(lit("\t x　\n"))) == "x"
    assert one(spark, strings.initcap(lit("hello-wORLD 9to5"))) == "Hello-World 9to5"
    assert one(spark, strings.substring(lit("abc"), -2, 2), strings.substring(lit("abc"), 2, -1)) == ("ab", "")
    assert one(spark, strings.regexp_replace(lit("a.b.c"), r"\.", "-"), strings.regexp_replace(lit("aXbx"), "x", "-", "gi"), strings.regexp_replace(lit("k=v"), "(k)=(v)", "$2=$1")) == ("a-b.c", "a-b-", "v=k")
    assert one(spark, strings.string_to_array(lit("a|b|"), "|")) == '["a","b",""]'
    assert one(spark, strings.chr_(lit(300))) == "Ĭ"
    assert one(spark, strings.like(lit("a_b"), "a!_b", "!"), strings.like(lit("a\\b"), "a\\b"), strings.like(lit("AB"), "a%", ignore_case=True)) == (True, True, True)
    for call in (lambda: strings.left(lit("a"), -1), lambda: strings.split_part(lit("a"), ",", 0)):
        with pytest.raises(ValueError):
            call()


def test_numbers_and_conditions(spark):
    assert one(spark, math.div(F.lit(-7), F.lit(2)), math.div(F.lit(1), F.lit(0)), math.mod(F.lit(5), F.lit(0))) == (-3, None, None)
    assert one(spark, math.round_(F.lit(-2.5)), math.sqrt(F.lit(-1.0)), math.ln(F.lit(0.0)), math.asin(F.lit(2.0))) == (-3.0, None, None, None)
    assert one(spark, conditional.greatest(F.lit(1), F.lit(None), F.lit(3)), conditional.least(F.lit(2), F.lit(1))) == (None, 1)
    assert one(spark, conditional.compare(F.lit(2), F.lit("10")), conditional.compare(F.lit(2), F.lit("x"))) == (-1, -1)


def test_dates(spark):
    at = F.lit("2024-05-17 10:20:30").cast("timestamp_ntz")
    assert str(one(spark, datetime.date_trunc("century", at))) == "2001-01-01 00:00:00"
    assert one(spark, datetime.date_diff("hour", at, at - F.expr("INTERVAL 30 MINUTES"))) == -1
    assert one(spark, datetime.date_diff("month", F.lit("2024-01-31").cast("date"), F.lit("2024-02-29").cast("date"))) == 0
    assert one(spark, datetime.extract("dow", F.lit("2024-05-19").cast("date")), datetime.next_day(F.lit("2024-05-17"), "Friday")) == (0, "2024-05-24")
    assert one(spark, datetime.strftime("%Y/%m 'x' %H", at)) == "2024/05 'x' 10"
    with pytest.raises(ValueError):
        datetime.modified(at, "1 fortnight")


def test_json(spark):
    doc = F.lit('{"a":{"b":1},"c":[2,3.5],"d":null,"s":"x"}')
    assert one(spark, json.json_type(doc, "$.a"), json.json_type(doc, "$.c"), json.json_type(doc, "$.c[1]"), json.json_type(doc, "$.s")) == ("object", "array", "real", "text")
    assert one(spark, json.json_array_length(doc), json.json_array_length(doc, "$.c")) == (0, 2)
    assert one(spark, json.arrow(doc, "s"), json.arrow_text(doc, "s"), json.json_valid(F.lit("{"))) == ('"x"', "x", False)
    tree = tvf.json_tree(spark.createDataFrame([('{"a":{"b":1},"c":[2,3]}',)], "j string"), "j").orderBy("pos").collect()
    assert [(r.key, r.type, r.path) for r in tree] == [(None, "object", "$"), ("a", "object", "$.a"), ("b", "integer", "$.a.b"), ("c", "array", "$.c"), ("0", "integer", "$.c[0]"), ("1", "integer", "$.c[1]")]
    assert tvf.json_each(spark.createDataFrame([("5",), (None,)], "j string"), "j").drop("pos").collect() == [(None, "5", "integer")]


def test_series(spark):
    count = lambda *a: spark.range(1).select(F.explode(tvf.generate_series(*a))).count()
    assert (count(1, 5), count(5, 1), count(5, 1, -2), count(1, 1)) == (5, 0, 3, 1)
    with pytest.raises(ValueError):
        tvf.generate_series(1, 2, 0)


def test_aggregates(spark):
    t = spark.createDataFrame([(1, "A", 10), (2, "A", None), (3, "A", 20), (4, "B", 30)], "id int, grp string, val int")
    got = t.groupBy("grp").agg(aggregates.array_agg("val", "id").alias("a"), aggregates.total("val").alias("t"), aggregates.string_agg("val", order="id").alias("s"))
    assert values(got) == [("A", "[10,null,20]", 30.0, "10,20"), ("B", "[30]", 30.0, "30")]
    n = spark.createDataFrame([(10,), (20,), (30,), (40,)], "x int")
    assert tuple(n.agg(aggregates.percentile_cont("x", 0.5), aggregates.percentile_disc("x", 0.5, "int"), aggregates.median("x")).first()) == (25.0, 20, 25.0)
    assert n.limit(0).agg(aggregates.total("x"), aggregates.array_agg("x", "x"), aggregates.string_agg("x")).first() == (0.0, "[]", None)
    e = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, "y")], "g int, v string")
    assert values(e.select("g", aggregates.count_distinct_over("v", W.partitionBy("g")))) == [(1, 1), (1, 1), (1, 1), (2, 1)]


def test_quantified(spark):
    t1 = spark.createDataFrame([(10,), (20,), (30,)], "val int")
    for sub, any_, all_ in (([15, 25], [20, 30], [30]), ([], [], [10, 20, 30]), ([None, 15], [20, 30], [])):
        t2 = spark.createDataFrame([(v,) for v in sub], "val int")
        assert [r.val for r in relational.filter_any(t1, "val", ">", t2).orderBy("val").collect()] == any_
        assert [r.val for r in relational.filter_all(t1, "val", ">", t2).orderBy("val").collect()] == all_
        t1.createOrReplaceTempView("q1")
        t2.createOrReplaceTempView("q2")
        assert [r.val for r in sql(spark, "SELECT val FROM q1 WHERE val > ANY (SELECT val FROM q2) ORDER BY val").collect()] == any_
        assert [r.val for r in sql(spark, "SELECT val FROM q1 WHERE val > ALL (SELECT val FROM q2) ORDER BY val").collect()] == all_


def test_rewrites(spark):
    assert rewrite("SELECT 'a ~ b' -- note\n, \"x\"") == "SELECT 'a ~ b' , \"x\""
    assert sql(spark, "SELECT $2 || $1 AS v", ["a", "b"]).first().v == "ba"
    assert sql(spark, """SELECT '{"a":[1,{"b":"x"}]}' ->> '$.a[1].b' AS v""").first().v == "x"
    assert [r.v for r in sql(spark, "SELECT DISTINCT ON (k) k, v FROM (VALUES (1, 2), (1, 3), (2, 1)) t(k, v) ORDER BY k, v DESC").collect()] == [3, 1]


def test_recursion_ends_on_cycles_and_limits(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    start = spark.createDataFrame([(1,)], "k int")
    step = lambda t: t.join(edges, F.col("k") == F.col("a")).select(F.col("b").alias("k"))
    assert values(relational.recursive_union(start, step)) == [(1,), (2,), (3,)]
    with pytest.raises(RuntimeError):
        relational.recursive_union(start, step, distinct=False, limit=4)


def test_dml(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id int, s string, n int")
    new = spark.createDataFrame([(2, "B", 5), (3, "C", 6)], "id int, s string, n int")
    assert values(dml.upsert(t, new, ["id"]).table) == [(1, "a", 1), (2, "b", None), (3, "C", 6)]
    changed = dml.upsert(t, new, ["id"], {"n": F.col("excluded_n")})
    assert values(changed.table) == [(1, "a", 1), (2, "b", 5), (3, "C", 6)] and values(changed.affected) == [(2, "b", 5), (3, "C", 6)]
    assert values(dml.update(t, {"n": F.lit(9)}, F.col("n") == 1).table) == [(1, "a", 9), (2, "b", None)]
    assert values(dml.delete(t, F.col("n") == 1).table) == [(2, "b", None)]
    assert values(dml.insert(t, spark.createDataFrame([(7,)], "id int"), {"s": F.lit("d")}).affected) == [(7, "d", None)]
    assert dml.truncate(t).table.count() == 0
    found = dml.Constraints(primary_key=["id"], not_null=["n"], checks={"c": F.col("n") > 1}).violations(t.unionAll(t))
    assert values(found) == [("check(c)", "", 2), ("not null(n)", "", 2), ("unique(id)", '{"id":1}', 2), ("unique(id)", '{"id":2}', 2)]
    child = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "c int, p int")
    assert values(dml.delete_parent(t, child, F.col("id") == 1, "id", "p", "set null")[1]) == [(1, None), (2, 2), (3, None)]
    with pytest.raises(ValueError):
        dml.delete_parent(t, child, F.col("id") == 1, "id", "p")


def test_security(spark):
    t = spark.createDataFrame([(1, "x"), (2, None)], "id int, s string")
    rules = security.Policies(rows=[F.col("s") == "x"], masks={"s": F.lit("*")})
    assert values(rules.view(t)) == [(1, "*")]
    security.set_audit_context(spark, user="ann")
    assert one(spark, security.audit_context(spark, "user")) == "ann"


def test_text(spark):
    docs = spark.createDataFrame([(1, "Quick brown fox"), (2, "Slow brown dog"), (3, None)], "id int, t string")
    hit = lambda q: [r.id for r in docs.where(text.fulltext_match("t", q)).orderBy("id").collect()]
    assert (hit("brown"), hit("brown -dog"), hit('"brown fox"'), hit("qui*"), hit("fox OR dog"), hit("brown fox dog")) == ([1, 2], [1], [1], [1], [1, 2], [])
    odd = spark.createDataFrame([("a-b c_d e/f",)], "t string")
    assert odd.select(text.tokens("t")).first()[0] == ["a", "b", "c_d", "e", "f"]
    assert odd.where(text.fulltext_match("t", "c_d a-b*")).count() == 1 and odd.where(text.fulltext_match("t", "c")).count() == 0
    top = text.bm25_top_k(docs, "id", "t", "fox", 5).collect()
    assert [r.id for r in top] == [1] and top[0].score > 0


def test_geo(spark):
    assert abs(one(spark, geo.haversine(0.0, 0.0, 1.0, 0.0)) - 111195.08) < 0.1
    p = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (3.0, 3.0)], "x double, y double")
    hole = "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0), (1 0.2, 1.8 0.2, 1.8 1, 1 1, 1 0.2))"
    assert [r[0] for r in p.select(geo.contains(hole, "x", "y")).collect()] == [True, False, False]
    assert "Python" not in p.select(geo.contains(hole, "x", "y"))._jdf.queryExecution().executedPlan().toString()
    held = spark.createDataFrame([(hole,)], "w string")
    assert abs(held.select(geo.st_area("w")).first()[0] - (4 - 0.64)) < 1e-9
    lines = spark.createDataFrame([("LINESTRING(0 0, 3 4)",)], "w string")
    assert lines.select(geo.st_length("w")).first()[0] == 5.0
    across = spark.createDataFrame([(1, 179.9, 0.0)], "a int, x double, y double").crossJoin(spark.createDataFrame([(2, -179.9, 0.0)], "b int, u double, v double"))
    left, right = across.select("a", "x", "y"), across.select("b", "u", "v")
    assert geo.dwithin_join(left, right, "x", "y", "u", "v", 30_000).count() == 1


def test_dwithin_join_finds_what_all_pairs_have(spark):
    nan = float("nan")
    at = [(-180 + 37.3 * k % 360, -90 + 17.9 * k % 180) for k in range(80)] + [(-180 + 41.7 * k % 360, 84 + 0.37 * k % 6) for k in range(80)]
    at += [(x, y) for x in (-180.0, 180.0, 179.99, -179.99) for y in (90.0, -90.0, 0.0, 60.0, 89.99)] + [(None, 1.0), (1.0, None), (nan, 1.0), (1.0, nan)]
    a = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "i int, x double, y double")
    b = a.toDF("j", "u", "v")
    apart = a.crossJoin(b).select("i", "j", geo.haversine("x", "y", "u", "v").alias("d")).collect()
    for metres in (0, 1000, 300_000, 9_000_000, 20_000_000):
        want = sorted((r.i, r.j) for r in apart if r.d is not None and r.d <= metres)
        assert sorted(map(tuple, geo.dwithin_join(a, b, "x", "y", "u", "v", metres).select("i", "j").collect())) == want


def test_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, s string")
    ours = spark.createDataFrame([(1, "a"), (2, "B")], "id int, s string")
    theirs = spark.createDataFrame([(1, "A"), (2, "x"), (3, "c"), (4, "d")], "id int, s string")
    assert values(changes.diff(base, ours, ["id"]).select("id", "op")) == [(2, "changed"), (3, "removed")]
    merged, conflicts = changes.merge(base, ours, theirs, ["id"])
    assert values(merged) == [(1, "A"), (2, "B"), (4, "d")] and [r.id for r in conflicts.collect()] == [2]
    log = spark.createDataFrame([(1, "p", "update", 1), (1, "q", "update", 2), (2, None, "delete", 1), (9, "n", "insert", 1)], "id int, s string, op string, seq int")
    assert values(changes.apply_changes(base, log, ["id"], [F.col("seq")])) == [(1, "q"), (3, "c"), (9, "n")]


def test_sources(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    io.write_csv(t, f"{tmp_path}/c")
    io.write_json(t, f"{tmp_path}/j")
    assert values(io.read_csv(spark, f"{tmp_path}/c", "id int, s string")) == values(t) == values(io.read_json(spark, f"{tmp_path}/j", "id int, s string"))
    v = io.Versions(spark, f"{tmp_path}/v")
    v.commit(t, "first")
    v.commit(t.limit(1))
    assert (v.read("first").count(), v.read().count()) == (2, 1)
    t.createOrReplaceTempView("pragma_t")
    assert [r.name for r in catalog.pragma_table_info(spark, "pragma_t", ("id",)).orderBy("cid").collect()] == ["id", "s"]
    seen = []
    t.write.parquet(f"{tmp_path}/log")
    changes.watch(changes.change_stream(spark, f"{tmp_path}/log", "id int, s string", F.col("id") == 2), lambda df, k: seen.extend(r.id for r in df.collect()), f"{tmp_path}/cp").awaitTermination()
    assert seen == [2]


_SQUARE = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"
_RING = "POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 7 2, 7 7, 2 7, 2 2))"


@pytest.mark.parametrize(
    "a,b,meets,holds,same",
    [
        (_SQUARE, "POINT(1 1)", True, True, False),
        (_SQUARE, "POINT(5 1)", False, False, False),
        (_SQUARE, "POINT(4 4)", True, False, False),
        (_SQUARE, "LINESTRING(-1 2, 9 2)", True, False, False),
        (_SQUARE, "LINESTRING(1 1, 2 3)", True, True, False),
        (_SQUARE, "POLYGON((4 4, 4 0, 0 0, 0 4, 4 4))", True, False, True),
        (_SQUARE, "POLYGON((1 1, 2 1, 2 2, 1 1))", True, True, False),
        ("POLYGON((1 1, 2 1, 2 2, 1 1))", _SQUARE, True, False, False),
        (_SQUARE, "POLYGON((-5 1, 9 1, 9 2, -5 2, -5 1))", True, False, False),
        (_RING, "POLYGON((4 4, 5 4, 5 5, 4 4))", False, False, False),
        ("LINESTRING(0 0, 2 2, 3 0)", "LINESTRING(3 0, 2 2, 0 0)", True, False, True),
        ("LINESTRING(0 0, 4 4)", "POINT(2 2)", True, True, False),
        ("MULTIPOINT(1 1, 2 2)", "MULTIPOINT((2 2), (1 1))", True, True, True),
        ("MULTIPOLYGON(((0 0, 4 0, 4 4, 0 4, 0 0)), ((6 6, 8 6, 8 8, 6 6)))", "POINT(7.5 7)", True, True, False),
        ("POINT EMPTY", "POINT(0 0)", False, False, False),
        (None, "POINT(0 0)", None, None, None),
    ],
)
def test_shapes(spark, a, b, meets, holds, same):
    if a is not None:
        x, y = shapes.Shape(a), shapes.Shape(b)
        assert (shapes.intersects(x, y), shapes.intersects(y, x), shapes.contains(x, y), shapes.equals(x, y), shapes.equals(y, x)) == (meets, meets, holds, same, same)
    else:
        pair = spark.createDataFrame([(a, b)], "a string, b string")
        assert tuple(pair.select(shapes.st_intersects("a", "b"), shapes.st_within("b", "a"), shapes.st_equals("a", "b")).first()) == (meets, holds, same)


def test_shape_join_gives_each_pair_once(spark):
    shape = lambda x, y, s: f"POLYGON(({x} {y}, {x + s} {y}, {x + s} {y + s}, {x} {y + s}, {x} {y}))"
    at = [(x, y, s) for x in range(-3, 6, 2) for y in range(-2, 5, 3) for s in (1, 4)]
    left = spark.createDataFrame([(k, shape(*p)) for k, p in enumerate(at)] + [(99, None)], "i int, a string")
    right = left.toDF("j", "b")
    want = [(i, j) for i, (x, y, s) in enumerate(at) for j, (u, v, t) in enumerate(at) if x <= u + t and u <= x + s and y <= v + t and v <= y + s]
    for cell in (1.0, 2.5):
        assert values(shapes.shape_join(left, right, "a", "b", cell).select("i", "j")) == sorted(want, key=str)


def test_shapes_are_judged_alike_one_by_one_and_stacked(spark):
    texts = [a for a in (_SQUARE, _RING, "POINT(4 4)", "POINT EMPTY", "LINESTRING(-1 2, 9 2)", "LINESTRING(0 0, 4 4)", "MULTIPOINT(1 1, 2 2)", "MULTILINESTRING((0 0, 4 4), (2 2, 8 8))")]
    texts += [f"POLYGON(({x} {y}, {x + 3} {y}, {x + 3} {y + 2}, {x} {y + 2}, {x} {y}))" for x in range(-1, 9, 2) for y in range(0, 9, 3)]
    texts += [f"MULTIPOLYGON((({x} 0, {x + 2} 0, {x} 2, {x} 0)), ((6 {x}, 8 {x}, 8 8, 6 {x})))" for x in range(3)]
    parsed = [shapes.Shape(t) for t in texts]
    i, j = np.divmod(np.arange(len(texts) ** 2), len(texts))
    for test, stacked in ((shapes.intersects, shapes._stacked_intersects), (shapes.contains, shapes._stacked_contains)):
        asked = []
        found = shapes.judged(parsed, parsed, i, j, lambda a, b: asked.append(1) or test(a, b), stacked)
        assert found.tolist() == [test(parsed[x], parsed[y]) for x, y in zip(i, j)]
        # Only pairs with the empty shape are judged one by one.
        assert len(asked) == 2 * len(texts) - 1
    rows = spark.createDataFrame([("POINT(1 1)", _SQUARE), (None, _SQUARE), ("POINT(9 1)", None), ("POINT(9 1)", _SQUARE), ("POINT(1 1)", _SQUARE)], "a string, b string").coalesce(1)
    assert [r[0] for r in rows.select(shapes.st_within("a", "b")).collect()] == [True, None, None, False, True]


def test_shape_join_judges_equal_shapes_once(spark):
    rows = spark.createDataFrame([(k, _SQUARE if k % 2 else "POINT EMPTY") for k in range(40)] + [(99, None)], "i int, a string")
    judged = spark.sparkContext.accumulator(0)

    def test(a, b):
        def count(x: pd.Series, y: pd.Series) -> pd.Series:
            judged.add(len(x))
            return pd.Series(True, index=x.index)

        return F.pandas_udf(count, "boolean")(a, b)

    assert shapes.shape_join(rows, rows.toDF("j", "b"), "a", "b", 4.0, test).count() == 400
    assert judged.value == 1


def test_shape_queries_use_many_tasks(spark):
    for name in ("geo_shapes", "geo_shape_join", "geo_dwithin"):
        plan = operators.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in plan


def test_trigram_search(spark):
    docs = spark.createDataFrame([(1, "Abcde x"), (2, "abc"), (3, None), (4, ""), (5, "xx abCDe"), (6, "abcabcde")], "id int, t string")
    index = text.trigram_index(docs, "id", "t")
    assert text.required_trigrams("%abcd_fg%") == ["ABC", "BCD"]
    for pattern in ("%bcd%", "abc%", "%ab%", "%", "%abc%cde", "zzz%"):
        assert values(text.like_search(docs, index, "id", "t", pattern).select("id")) == values(docs.where(strings.like(F.col("t"), pattern)).select("id"))


def test_trigrams_take_time_in_proportion(spark):
    long = "".join(chr(65 + (k * k + k // 7) % 53) for k in range(150_000)) + "license Äß\U0001f600é the"
    docs = spark.createDataFrame([(1, long), (2, "ab"), (3, None), (4, "aﬁé\U0001f600x")], "id int, t string")
    began = time.time()
    found = {r[0]: r[1] for r in docs.select("id", text.trigrams("t")).collect()}
    assert time.time() - began < 30
    upper = long.upper()
    assert set(found[1]) == {upper[k : k + 3] for k in range(len(upper) - 2)} and len(found[1]) == len(set(found[1]))
    assert found[2] == [] and found[3] == [] and found[4] == ["AFI", "FIÉ", "IÉ\U0001f600", "É\U0001f600X"]
    grams = text.required_trigrams("%license%the%")
    assert values(text.trigram_index(docs, "id", "t", grams)) == values(text.trigram_index(docs, "id", "t").where(F.col("gram").isin(grams)))
    assert text.trigram_index(docs, "id", "t", []).count() == 0


def test_ddl(spark):
    spark.range(10).createOrReplaceTempView("ddl_base")
    ddl.execute(spark, "CREATE VIEW ddl_view (k, h) AS SELECT id, id / 4 FROM ddl_base WHERE id > 4")
    assert values(sql(spark, "SELECT k, h FROM ddl_view WHERE k < 9")) == [(5, 1.0), (6, 1.0), (7, 1.0), (8, 2.0)]
    with pytest.raises(ValueError):
        ddl.execute(spark, "CREATE VIEW ddl_view AS SELECT 1 AS k")
    ddl.execute(spark, "CREATE VIEW IF NOT EXISTS ddl_view AS SELECT 1 AS k")
    assert sql(spark, "SELECT count(*) FROM ddl_view").first()[0] == 5
    ddl.execute(spark, "CREATE OR REPLACE TEMP VIEW ddl_view AS SELECT 1 AS k")
    assert values(sql(spark, "SELECT * FROM ddl_view")) == [(1,)]
    ddl.execute(spark, "CREATE TABLE ddl_made AS SELECT id AS k, concat('v', id) AS v FROM ddl_base")
    ddl.execute(spark, "CREATE TABLE ddl_empty AS SELECT k FROM ddl_made WITH NO DATA")
    assert (spark.table("ddl_made").count(), spark.table("ddl_empty").count()) == (10, 0)
    assert "Scan" in "\n".join(r.plan for r in ddl.execute(spark, "EXPLAIN SELECT k FROM ddl_made").collect())
    assert "rows: 10" in [r.plan for r in ddl.execute(spark, "EXPLAIN ANALYZE SELECT k FROM ddl_made").collect()]
    for what in ("VIEW ddl_view", "TABLE ddl_made", "TABLE ddl_empty", "VIEW IF EXISTS ddl_view"):
        ddl.execute(spark, f"DROP {what}")
    assert not spark.catalog.tableExists("ddl_made")
    with pytest.raises(ValueError):
        ddl.execute(spark, "DROP VIEW ddl_view")
