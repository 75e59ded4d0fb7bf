"""Null, membership, match and list rules on small fixtures."""

import pytest
from pyspark.sql import functions as F

from graphloom import functions as fn
from graphloom.operators import aggregates, loose, predicates as p, sequences, sets, shapes, writes
from graphloom.plans import Entity, Far, ListOf, ObjectOf, Scalar, dependency_order, load_graph
from graphloom.sources import lookups


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize(
    ("values", "nullable", "negated", "want"),
    [([], True, False, []), ([], True, True, [1, 2, 3]), (None, True, False, []), ([1], True, False, [1]), ([1], True, True, [2, 3]), ([1, None], True, False, [1, 3]), ([1, None], True, True, [2]), ([None], True, False, [3]), ([None], True, True, [1, 2]), ([None], False, False, []), ([None], False, True, [1, 2, 3])],
)
def test_membership(spark, values, nullable, negated, want):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, v int")
    assert ids(df.where(p.is_in("v", values, nullable, negated))) == want


@pytest.mark.parametrize(("text", "want"), [("%", ["a%b"]), ("_", ["a_b"]), ("!", ["a!b"]), ("a", ["a!b", "a%b", "a_b", "axb"])])
def test_like_is_literal(spark, text, want):
    df = spark.createDataFrame([("a%b",), ("a_b",), ("a!b",), ("axb",), (None,)], "s string")
    assert sorted(r.s for r in df.where(p.contains("s", text)).collect()) == want


def test_null_compares_by_is_null(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    assert ids(df.where(p.eq("v", None))) == [1]
    assert ids(df.where(p.ne("v", None))) == [2]
    assert ids(df.where(p.both())) == [1, 2]
    assert ids(df.where(p.either())) == []


def test_any_and_all_over_collections(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None]), (4, [1, 5]), (5, [6, 7])], "id int, a array<int>")
    assert ids(df.where(p.any_of("a"))) == [4, 5]
    assert ids(df.where(p.any_of("a", lambda x: x > 4))) == [4, 5]
    assert ids(df.where(p.all_of("a", lambda x: x > 4))) == [1, 2, 5]


def test_loose_comparison_is_two_valued(spark):
    rows = [(1, None, None), (2, None, "a"), (3, "A", "a"), (4, "1", "1.0000000001"), (5, "1", "2"), (6, "2024-01-02", "2024-01-10"), (7, "10", "9")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    a, b = F.col("a"), F.col("b")
    assert ids(df.where(loose.same(a, b))) == [1, 3, 4]
    assert ids(df.where(loose.below(a, b))) == [2, 4, 5, 6]
    assert ids(df.where(loose.at_least(a, b))) == [1, 3, 7]
    assert ids(df.where(loose.like(a, "_"))) == [3, 4, 5]
    assert ids(df.where(loose.truth(a, "string"))) == [3, 4, 5, 6, 7]


ENTITIES = {
    "root": Entity("root", ("id",), ("id", "sid"), (Scalar("sname", "side", "sid", "name"), Far("fname", "side", "sid", "far", "fid", "name"), ObjectOf("side", "side", "sid"), ListOf("a", "a", "rid"), ListOf("b", "b", "rid"))),
    "side": Entity("side", ("id",), ("id", "name", "fid")),
    "far": Entity("far", ("id",), ("id", "name")),
    "a": Entity("a", ("id",), ("id", "rid", "name")),
    "b": Entity("b", ("id",), ("id", "rid")),
}


@pytest.fixture
def read(spark):
    frames = {
        "root": spark.createDataFrame([(1, 10), (2, None), (3, 99), (None, 10)], "id int, sid int"),
        "side": spark.createDataFrame([(10, "ten", 7), (None, "no", 7)], "id int, name string, fid int"),
        "far": spark.createDataFrame([(7, "far")], "id int, name string"),
        "a": spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (2, 1, "y"), (None, 1, "n"), (3, None, "z")], "id int, rid int, name string"),
        "b": spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id int, rid int"),
    }
    return frames.__getitem__


def test_graph_load(read):
    rows = {r.id: r for r in load_graph(ENTITIES, read, "root").collect()}
    assert sorted(rows) == [1, 2, 3]
    assert (rows[1].sname, rows[1].fname, rows[1].side.name) == ("ten", "far", "ten")
    assert [x.name for x in rows[1].a] == ["x", "y"] and [x.id for x in rows[1].b] == [1, 2, 3]
    assert rows[2].side is None and rows[2].a == [] and rows[3].sname is None


def test_any_child_modes(read):
    rows = load_graph(ENTITIES, read, "root", any_child={"a": p.eq("name", "y")}).collect()
    assert [(r.id, [x.name for x in r.a]) for r in rows] == [(1, ["y"])]
    rows = load_graph(ENTITIES, read, "root", any_child={"a": p.eq("name", "y")}, mode="entity").collect()
    assert [(r.id, [x.name for x in r.a]) for r in rows] == [(1, ["x", "y"])]


def test_paging_counts_roots(read):
    assert [r.id for r in load_graph(ENTITIES, read, "root", skip=1, limit=1).collect()] == [2]
    with pytest.raises(ValueError, match="negative"):
        load_graph(ENTITIES, read, "root", skip=-1, limit=1)


def test_paged_roots_prune_their_lists(read):
    plan = load_graph(ENTITIES, read, "root", limit=1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2


def test_scalars_and_objects_of_one_key_share_a_join(spark):
    frames = {"r": spark.createDataFrame([(1, 10), (2, None)], "id int, sid int"), "s": spark.createDataFrame([(10, "ten", 7)], "id int, name string, fid int"), "f": spark.createDataFrame([(7, "far")], "id int, name string")}
    entities = {
        "r": Entity("r", ("id",), ("id", "sid"), (Scalar("sname", "s", "sid", "name"), ObjectOf("one", "s", "sid"), ObjectOf("two", "s", "sid"))),
        "s": Entity("s", ("id",), ("id", "name", "fid"), (Scalar("fname", "f", "fid", "name"),)),
        "f": Entity("f", ("id",), ("id", "name")),
    }
    out = load_graph(entities, frames.__getitem__, "r")
    rows = {r.id: r for r in out.collect()}
    assert rows[1].sname == rows[1].one.name == rows[1].two.name == "ten" and rows[1].two.fname == "far"
    assert rows[2].one is None and rows[2].two is None
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2


def test_repeated_identifiers_count_once_if_asked(read, spark):
    frames = {"root": spark.createDataFrame([(1, 10), (1, 10), (2, 10)], "id int, sid int"), "side": spark.createDataFrame([(10, "ten", 7), (10, "ten", 7)], "id int, name string, fid int")}
    rows = load_graph(ENTITIES, lambda n: frames.get(n, read(n)), "root", distinct=True).collect()
    assert sorted(r.id for r in rows) == [1, 2] and {r.sname for r in rows} == {"ten"}


def test_bad_entities_raise(read):
    with pytest.raises(ValueError, match="identifier"):
        Entity("x", (), ("id",))
    with pytest.raises(ValueError, match="key nope"):
        Entity("x", ("id",), ("id",), (Scalar("s", "side", "nope", "name"),))
    circle = {"p": Entity("p", ("id",), ("id", "q"), (ObjectOf("o", "q", "q"),)), "q": Entity("q", ("id",), ("id", "r"), (ObjectOf("o", "r", "r"),)), "r": Entity("r", ("id",), ("id", "q"), (ObjectOf("o", "q", "q"),))}
    with pytest.raises(ValueError, match="circle"):
        load_graph(circle, read, "p")
    assert dependency_order({"a": ["b"], "b": ["c"], "c": []}) == ["c", "b", "a"]
    with pytest.raises(ValueError, match="circle"):
        dependency_order({"a": ["b"], "b": ["a"]})


def test_last_wins(spark):
    df = spark.createDataFrame([(1, "first", 0), (2, "a", 1), (1, "second", 2), (3, "b", 3), (2, "c", 4), (None, "n", 5)], "k int, v string, seq int")
    out = aggregates.first_by_key(df, ["k"], ["seq"], last=True, drop_null_keys=True).collect()
    assert {r.k: r.v for r in out} == {1: "second", 2: "c", 3: "b"}
    assert aggregates.first_by_key(df.limit(0), ["k"], ["seq"]).count() == 0


def test_upsert_and_updates(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    incoming = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1), (None, "n", 1)], "k int, v string, seq int")
    assert {(r.k, r.v) for r in writes.upsert(target, incoming, ["k"], ["seq"]).collect()} == {(1, "a"), (2, "y"), (3, "z"), (None, "n")}
    changes = spark.createDataFrame([(1, None, 1), (2, "q", 1)], "k int, v string, seq int")
    assert {(r.k, r.v) for r in writes.update_from(target, changes, ["k"], ["v"], ["seq"]).collect()} == {(1, "a"), (2, "q")}


def test_gap_counter(spark):
    of = lambda *n: aggregates.first_gap(spark.createDataFrame([(x,) for x in n], "n int"), "n").first().next
    assert of(1, 2, 4, 5, 8) == 3
    assert aggregates.first_gap(spark.createDataFrame([], "n int"), "n").first().next == 1


def test_indexed_without_keys(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert all(r["v"] == r["index"] for r in sequences.indexed(df, ["v"]).collect())


def test_functions(spark):
    df = spark.createDataFrame([(1536, 2.5, "QUJD", "a.b")], "n long, x double, s string, t string")
    r = df.select(fn.byte_size("n").alias("size"), fn.rounded("x").alias("even"), fn.is_base64("s").alias("ok"), fn.is_base64("t").alias("no"), fn.glob("t", "a.?").alias("glob"), fn.in_base(F.lit("ff"), 16, 10).alias("base"), fn.filled("{a}-{b}", a="n", b=F.lit(None).cast("string")).alias("text")).first()
    assert (r.size, r.even, r.ok, r.no, r.glob, r.base, r.text) == ("1.50 KB", 2.0, True, False, True, "255", "1536-")


def test_tagged_feed_pads(spark):
    a, b = spark.createDataFrame([(1, "x")], "p int, q string"), spark.createDataFrame([(2,)], "r int")
    assert {tuple(r) for r in sets.tagged_feed({"a": a, "b": b}).collect()} == {("a", "1", "x"), ("b", "2", None)}


def test_page_defaults(spark):
    df = spark.range(200)
    assert lookups.fetch(df, order_by="id", limit=-1).count() == 50
    assert lookups.page_number(3, 20) == (40, 20)


def test_row_readers(spark):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, v string")
    assert sorted(r.k for r in lookups.stream_rows(df)) == [1, 2]
    assert sorted(lookups.rows_as_dicts(df), key=lambda r: r["k"]) == [{"k": 1, "v": None}, {"k": 2, "v": "b"}]
    assert lookups.scalar(df.where("k = 2").select("v")) == "b" and lookups.scalar(df.where("k = 3")) is None
    assert lookups.first_or_none(df.where("k = 3")) is None
    assert lookups.any_rows(df, F.col("k") > 1).head()[0] is True and lookups.any_rows(df.limit(0)).head()[0] is False
    assert lookups.named_call("twice", lambda of: df.select((F.col("k") * of).alias("k"))) is None
    assert sorted(r.k for r in lookups.named_call("twice", of=2).collect()) == [2, 4]


def test_shapes(spark):
    df = spark.createDataFrame([(1, None, "x1"), (2, "7", "")], "id int, n string, t string")
    assert shapes.renamed(df, {"n": "m", "absent": "y"}).columns == ["id", "m", "t"]
    assert [tuple(r) for r in shapes.mapped_into(df, {"N": "int", "t": "int", "other": "date"}).collect()] == [(None, None, None), (7, None, None)]
    assert sorted((r.id, r.name, r.value or "") for r in shapes.key_values(df, ["id"]).collect()) == [(1, "n", ""), (1, "t", "x1"), (2, "n", "7"), (2, "t", "")]
    assert [tuple(r) for r in df.select(shapes.length_between("n", 0, 1), shapes.length_between("t", 1)).collect()] == [(True, True), (True, False)]
    lists = spark.createDataFrame([([(1,), (2,)],), ([],), (None,)], "x array<struct<a int>>")
    assert [r[0] for r in lists.select(shapes.first_member("x", "a")).collect()] == [1, None, None]
    other = spark.createDataFrame([("7", "a"), ("7", "b"), ("7", "a")], "m string, c string")
    got = shapes.cross_matrix(df, other, F.col("n") == F.col("m"), "id", "c", ["a", "b"], F.count("c"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0), (2, 2, 1)]


def test_numbers_and_picks(spark):
    df = spark.range(-1, 95).select(F.col("id").cast("int").alias("n"))
    got = {r.n: (r.p, r.f) for r in df.select("n", fn.is_prime("n").alias("p"), fn.fibonacci("n").alias("f")).collect()}
    assert [n for n in range(-1, 30) if got[n][0]] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    assert [got[n][1] for n in (-1, 0, 1, 2, 10, 92, 93)] == [None, 0, 1, 1, 55, 7540113804746346429, None]
    picked = lambda parts: [r.n for r in sequences.sample(df.repartition(parts), 9, seed=3, keys=["n"]).collect()]
    assert picked(1) == picked(7) and len(set(picked(2))) == 9
    assert dependency_order({"lines": ["orders"], "orders": ["customers"], "customers": []}) == ["customers", "orders", "lines"]
