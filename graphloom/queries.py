"""The registered queries of the engine, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import functions as fn
from graphloom.operators import aggregates as agg
from graphloom.operators import loose, predicates as p, sequences as seq, sets, shapes, writes
from graphloom.plans import Entity, Far, ListOf, ObjectOf, Scalar, load_graph
from graphloom.sources import lookups
from graphloom.sources.files import read_table
from graphloom.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

ENTITIES = {
    e.name: e
    for e in (
        Entity("region", ("r_regionkey",), ("r_regionkey", "r_name")),
        Entity("nation", ("n_nationkey",), ("n_nationkey", "n_name", "n_regionkey"), (Scalar("region_name", "region", "n_regionkey", "r_name"),)),
        Entity("customer", ("c_custkey",), ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), (Scalar("nation_name", "nation", "c_nationkey", "n_name"), Far("region_name", "nation", "c_nationkey", "region", "n_regionkey", "r_name"), ListOf("orders", "orders", "o_custkey", "root"))),
        Entity("orders", ("o_orderkey",), ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), (Scalar("customer_name", "customer", "o_custkey", "c_name"), Far("nation_name", "customer", "o_custkey", "nation", "c_nationkey", "n_name"), ObjectOf("customer", "customer", "o_custkey", "root"), ListOf("lines", "lineitem", "l_orderkey", "root"))),
        Entity("lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")),
        Entity("documents", ("doc_id",), ("doc_id", "lang", "source", "n_chars"), (ObjectOf("label", "labels", "doc_id"),)),
        Entity("labels", ("doc_id",), ("doc_id", "quality", "toxic")),
    )
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return register


def _reader(spark: SparkSession, sf: str) -> Callable[[str], DataFrame]:
    return lambda name: read_table(spark, sf, name)


def _graph(spark: SparkSession, sf: str, root: str, **how) -> DataFrame:
    return load_graph(ENTITIES, _reader(spark, sf), root, **how)


# Scans and paging ---------------------------------------------------------------------------------------------------


@query("s1_scan_table", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def s1(spark, sf):
    return read_table(spark, sf, "customer", ENTITIES["customer"].columns)


@query("s2_filter_order_page", "select o_orderkey, o_totalprice from orders where o_totalprice > 100000 order by o_totalprice desc, o_orderkey desc limit 20 offset 5")
def s2(spark, sf):
    df = read_table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    return lookups.fetch(df, p.gt("o_totalprice", 100000), "o_totalprice", descending=True, skip=5, limit=20, identifier="o_orderkey")


@query("s6_point_lookup", "select c_custkey, c_name from customer where c_custkey = 42")
def s6(spark, sf):
    return lookups.by_key(read_table(spark, sf, "customer", ["c_custkey", "c_name"]), "c_custkey", 42)


@query("s8_get_or_create", "select -1 as c_custkey, 'new' as c_name")
def s8(spark, sf):
    df = read_table(spark, sf, "customer").select(F.col("c_custkey").cast("int").alias("c_custkey"), "c_name")
    return lookups.ensure_row(df, F.col("c_custkey") == -1, spark.createDataFrame([(-1, "new")], "c_custkey int, c_name string"))


@query("s9_bound_sql", "select n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey where c_acctbal > 1000 group by n_name")
def s9(spark, sf):
    for t in ("customer", "nation"):
        read_table(spark, sf, t).createOrReplaceTempView(t)
    return lookups.run_sql(spark, "select n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey where c_acctbal > :least group by n_name", least=1000)


@query("s16_exists_by_key", """select count(*) as "Value" from supplier where s_suppkey = 3""")
def s16(spark, sf):
    return lookups.exists(read_table(spark, sf, "supplier"), "s_suppkey", 3)


@query("s17_key_resolution", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def s17(spark, sf):
    wanted = read_table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return lookups.key_map(read_table(spark, sf, "customer"), wanted, "c_custkey", "c_name")


@query("l1_null_order_top", "select case when p_size <= 25 then null else p_size end as size, p_partkey from part order by size asc nulls first, p_partkey asc limit 25")
def l1(spark, sf):
    df = read_table(spark, sf, "part").select(F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"), "p_partkey")
    return lookups.fetch(df, order_by="size", limit=25, identifier="p_partkey")


@query("l7_page_number", "select o_orderkey from orders order by o_orderkey limit 10 offset 20")
def l7(spark, sf):
    skip, limit = lookups.page_number(3, 10)
    return lookups.fetch(read_table(spark, sf, "orders", ["o_orderkey"]), skip=skip, limit=limit, identifier="o_orderkey")


@query("k12_json_rows", """select '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' as json from nation""")
def k12(spark, sf):
    return read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).select(fn.as_json("key", "name").alias("json"))


# Predicates ---------------------------------------------------------------------------------------------------------


@query("p1_and_or_not", "select p_partkey from part where (p_size < 10 or p_retailprice >= 1500) and not (p_brand = 'Brand#11')")
def p1(spark, sf):
    return read_table(spark, sf, "part").where(p.both(p.either(p.lt("p_size", 10), p.ge("p_retailprice", 1500)), ~p.eq("p_brand", "Brand#11"))).select("p_partkey")


@query("p3_null_compare", "select count(*) filter (where toxic is null) as unlabelled, count(*) filter (where toxic is not null) as labelled from documents left join labels using (doc_id)")
def p3(spark, sf):
    df = read_table(spark, sf, "documents").select("doc_id").join(read_table(spark, sf, "labels"), "doc_id", "left")
    return df.agg(F.count(F.when(p.eq("toxic", None), 1)).alias("unlabelled"), F.count(F.when(p.ne("toxic", None), 1)).alias("labelled"))


@query("p5_string_modes", """select count(*) filter (where lower(p_name) = lower('PART 7')) as ignoring, count(*) filter (where contains(p_name, '1')) as containing,
count(*) filter (where starts_with(p_type, 'S')) as starting, count(*) filter (where ends_with(p_type, 'S')) as ending from part""")
def p5(spark, sf):
    test = lambda c, v, m, n: F.count(F.when(p.eq(c, v, m), 1)).alias(n)
    return read_table(spark, sf, "part").agg(test("p_name", "PART 7", p.IGNORE_CASE, "ignoring"), test("p_name", "1", p.CONTAINING, "containing"), test("p_type", "S", p.STARTING, "starting"), test("p_type", "S", p.ENDING, "ending"))


@query("p6_literal_like", "select doc_id from documents where contains(text, '_') or contains(text, '%')")
def p6(spark, sf):
    return read_table(spark, sf, "documents").where(p.either(p.contains("text", "_"), p.contains("text", "%"))).select("doc_id")


@query("p8_case_and_trim", "select n_nationkey, upper(n_name) as u, lower(n_name) as l, trim('  ' || n_name || ' ') as t from nation")
def p8(spark, sf):
    return read_table(spark, sf, "nation").select("n_nationkey", F.upper("n_name").alias("u"), F.lower("n_name").alias("l"), F.trim(F.concat(F.lit("  "), "n_name", F.lit(" "))).alias("t"))


@query("p11_parse_integer", "select o_orderkey, try_cast(left(o_orderpriority, 1) as bigint) as level, try_cast(o_orderstatus as bigint) as status from orders")
def p11(spark, sf):
    return read_table(spark, sf, "orders").select("o_orderkey", p.parse_integer(F.substring("o_orderpriority", 1, 1)).alias("level"), p.parse_integer("o_orderstatus").alias("status"))


@query("p12_membership", """select 'plain' as kind, count(*) as n from (select nullif(n_regionkey, 0) as k from nation) where k in (1, 2)
union all select 'with null', count(*) from (select nullif(n_regionkey, 0) as k from nation) where k in (1, 2) or k is null
union all select 'negated', count(*) from (select nullif(n_regionkey, 0) as k from nation) where k not in (1, 2) or k is null
union all select 'negated with null', count(*) from (select nullif(n_regionkey, 0) as k from nation) where k not in (1, 2) and k is not null
union all select 'none', 0 union all select 'negated none', count(*) from nation""")
def p12(spark, sf):
    df = read_table(spark, sf, "nation").select(F.nullif(F.col("n_regionkey"), F.lit(0)).alias("k"))
    cases = {"plain": ([1, 2], False), "with null": ([1, 2, None], False), "negated": ([1, 2], True), "negated with null": ([1, 2, None], True), "none": ([], False), "negated none": (None, True)}
    return sets.concat(*[df.where(p.is_in("k", v, negated=n)).agg(F.lit(name).alias("kind"), F.count("*").alias("n")) for name, (v, n) in cases.items()])


@query("p13_member_rows", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)")
def p13(spark, sf):
    keys = read_table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")
    return p.member_rows(read_table(spark, sf, "orders"), "o_custkey", keys).select("o_orderkey")


@query("p16_any_all", """with l as (select o_custkey, list(o_totalprice) as prices from orders group by o_custkey)
select c_custkey, coalesce(len(list_filter(prices, lambda x: x > 300000)) > 0, false) as some, coalesce(len(list_filter(prices, lambda x: x > 50000)) = len(prices), true) as every
from customer left join l on o_custkey = c_custkey""")
def p16(spark, sf):
    lists = read_table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("prices"))
    df = read_table(spark, sf, "customer").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    return df.select("c_custkey", p.any_of("prices", lambda x: x > 300000).alias("some"), p.all_of("prices", lambda x: x > 50000).alias("every"))


@query("b6_optional_filters", "select o_orderkey from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1995-01-01'")
def b6(spark, sf):
    return read_table(spark, sf, "orders").where(p.both(p.when_given("o_orderstatus", "F"), p.when_given("o_custkey", None), p.not_before("o_orderdate", "1995-01-01"), p.not_after("o_orderdate", "no date"))).select("o_orderkey")


@query("b8_dynamic_fields", "select p_partkey from part where contains(p_type, 'A') and p_size = 7")
def b8(spark, sf):
    df = read_table(spark, sf, "part")
    return df.where(p.by_fields(df, {"P_TYPE": "A", "p_size": 7, "unknown": 1})).select("p_partkey")


@query("m2_loose_equality", "select c_custkey from customer where lower(c_mktsegment) = 'building' or abs(c_nationkey - 7) < 1e-9")
def m2(spark, sf):
    return read_table(spark, sf, "customer").where(loose.same(F.col("c_mktsegment"), "building") | loose.same(F.col("c_nationkey"), "7.0")).select("c_custkey")


@query("m3_loose_order", "select n_nationkey from nation where nullif(n_regionkey, 0) is null or nullif(n_regionkey, 0) < 2")
def m3(spark, sf):
    return read_table(spark, sf, "nation").where(loose.below(F.nullif(F.col("n_regionkey"), F.lit(0)), 2)).select("n_nationkey")


@query("m5_loose_among", "select o_orderkey from orders where lower(o_orderstatus) in ('f', 'p')")
def m5(spark, sf):
    return read_table(spark, sf, "orders").where(loose.among(F.col("o_orderstatus"), ["f", "p"])).select("o_orderkey")


@query("m6_loose_like", "select p_partkey from part where coalesce(p_type, '') ilike '%a_d%'")
def m6(spark, sf):
    return read_table(spark, sf, "part").where(loose.like(F.col("p_type"), "%a_d%")).select("p_partkey")


@query("m7_loose_parts", "select n_nationkey from nation where contains(lower(n_name), 'an') or starts_with(lower(n_name), 'nation_1')")
def m7(spark, sf):
    return read_table(spark, sf, "nation").where(loose.contains(F.col("n_name"), "AN") | loose.starts(F.col("n_name"), "Nation_1")).select("n_nationkey")


# Graph loads --------------------------------------------------------------------------------------------------------


@query("n2_linear_load", "select o_orderkey, o_totalprice, c_name as customer_name, n_name as nation_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def n2(spark, sf):
    return _graph(spark, sf, "orders", shape="linear").select("o_orderkey", "o_totalprice", "customer_name", "nation_name")


@query("n4_far_scalar", "select c_custkey, n_name as nation_name, r_name as region_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def n4(spark, sf):
    return _graph(spark, sf, "customer", shape="linear").select("c_custkey", "nation_name", "region_name")


@query("n5_nested_object", "select o_orderkey, c_name as name, n_name as nation from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def n5(spark, sf):
    return _graph(spark, sf, "orders").select("o_orderkey", F.col("customer.c_name").alias("name"), F.col("customer.nation_name").alias("nation"))


@query("n6_nested_list", "select c_custkey, count(o_orderkey) as orders, coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey), '') as keys from customer left join orders on o_custkey = c_custkey group by c_custkey")
def n6(spark, sf):
    return _graph(spark, sf, "customer").select("c_custkey", F.size("orders").cast("long").alias("orders"), F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@query("a2_missing_object", "select doc_id, toxic is null as unlabelled, toxic from documents left join labels using (doc_id)")
def a2(spark, sf):
    return _graph(spark, sf, "documents").select("doc_id", F.col("label").isNull().alias("unlabelled"), F.col("label.toxic").alias("toxic"))


@query("a5_paged_graph", "select o_orderkey, count(l_orderkey) as lines from (select * from orders where o_totalprice > 100000 order by o_orderkey limit 20 offset 3) left join (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem) on l_orderkey = o_orderkey group by o_orderkey")
def a5(spark, sf):
    return _graph(spark, sf, "orders", where=p.gt("o_totalprice", 100000), skip=3, limit=20).select("o_orderkey", F.size("lines").cast("long").alias("lines"))


@query("p17_any_child_rows", "select o_orderkey, count(*) as lines, sum(l_quantity) as quantity from orders join lineitem on l_orderkey = o_orderkey where o_totalprice > 100000 and l_quantity > 45 group by o_orderkey")
def p17(spark, sf):
    out = _graph(spark, sf, "orders", where=p.gt("o_totalprice", 100000), any_child={"lines": p.gt("l_quantity", 45)})
    return out.select("o_orderkey", F.size("lines").cast("long").alias("lines"), F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("quantity"))


@query("p17_any_child_entity", "select o_orderkey, count(*) as lines from orders join lineitem on l_orderkey = o_orderkey where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45) group by o_orderkey")
def p17e(spark, sf):
    return _graph(spark, sf, "orders", any_child={"lines": p.gt("l_quantity", 45)}, mode="entity").select("o_orderkey", F.size("lines").cast("long").alias("lines"))


@query("n14_anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '1998-06-01')")
def n14(spark, sf):
    late = read_table(spark, sf, "orders").where(p.not_before("o_orderdate", "1998-06-01")).select(F.col("o_custkey").alias("c_custkey"))
    return writes.delete_keys(read_table(spark, sf, "customer"), late, ["c_custkey"]).select("c_custkey")


@query("n16_ordered_merge", "select k, stream from (select c_nationkey as k, 0 as stream from customer where c_acctbal < 0 union all select s_nationkey, 1 from supplier)")
def n16(spark, sf):
    a = read_table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    return sets.ordered_merge("k", [], a, read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


# Aggregation --------------------------------------------------------------------------------------------------------


@query("g1_accumulate", "select l_returnflag, round(sum(l_quantity), 2) as l_quantity, max(l_extendedprice) as l_extendedprice, arg_min(l_partkey, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) as l_partkey from lineitem group by l_returnflag")
def g1(spark, sf):
    df = read_table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    out = agg.accumulate(df, ["l_returnflag"], {"l_quantity": ("Sum", "l_quantity"), "l_extendedprice": ("Max", "l_extendedprice")}, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("l_returnflag", F.round("l_quantity", 2).alias("l_quantity"), "l_extendedprice", "l_partkey")


@query("g3_exact_sums", "select l_returnflag, l_linestatus, sum(l_extendedprice::decimal(28, 4))::double as price, min(l_discount) as least, max(l_tax) as most, count(*) as n from lineitem group by all")
def g3(spark, sf):
    return read_table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(agg.exact_sum("l_extendedprice").cast("double").alias("price"), F.min("l_discount").alias("least"), F.max("l_tax").alias("most"), F.count("*").alias("n"))


@query("g6_distinct", "select distinct p_brand, p_size from part")
def g6(spark, sf):
    return read_table(spark, sf, "part").select("p_brand", "p_size").distinct()


@query("g7_first_by_key", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def g7(spark, sf):
    return agg.first_by_key(read_table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("g9_last_by_key", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def g9(spark, sf):
    return agg.first_by_key(read_table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], last=True).drop("ts")


@query("g10_matrix", "select o_orderstatus, count(*) filter (where o_orderpriority = '1-URGENT') as \"1-URGENT\", count(*) filter (where o_orderpriority = '5-LOW') as \"5-LOW\" from orders group by o_orderstatus")
def g10(spark, sf):
    return agg.matrix(read_table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "5-LOW"], F.count(F.lit(1)))


@query("g11_next_number", "select coalesce(max(p_size), 0) + 1 as next from part")
def g11(spark, sf):
    return agg.next_number(read_table(spark, sf, "part"), "p_size")


@query("g12_first_gap", "select coalesce(min(n), 1) as next from (select distinct o_custkey + 1 as n from orders where o_orderstatus = 'P') where n not in (select o_custkey from orders where o_orderstatus = 'P')")
def g12(spark, sf):
    return agg.first_gap(read_table(spark, sf, "orders").where("o_orderstatus = 'P'"), "o_custkey")


# Sequences ----------------------------------------------------------------------------------------------------------

_W = "partition by user_id order by ts, event_id"
_ORDER = ["ts", "event_id"]


def _events(spark, sf):
    return read_table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("o1_index_all", "select event_id, row_number() over (order by ts, event_id) - 1 as index from events")
def o1(spark, sf):
    return seq.indexed(_events(spark, sf), _ORDER).select("event_id", "index")


@query("o2_pairwise", f"select * from (select event_id, lag(event_id) over ({_W}) as previous_event_id from events) where previous_event_id is not null")
def o2(spark, sf):
    return seq.pairwise(_events(spark, sf), ["event_id"], _ORDER, ["user_id"]).select("event_id", "previous_event_id")


@query("o3_neighbour", f"with n as (select *, row_number() over ({_W}) as k from events), f as (select user_id, min(k) as k from n where event_type = 'purchase' group by user_id) select n.event_id from n join f on n.user_id = f.user_id and n.k = f.k - 1")
def o3(spark, sf):
    return seq.neighbour(_events(spark, sf), F.col("event_type") == "purchase", _ORDER, ["user_id"]).select("event_id")


@query("o4_take_while", f"select event_id from (select event_id, max((not event_type <> 'purchase')::int) over ({_W} rows unbounded preceding) as f from events) where f = 0")
def o4(spark, sf):
    return seq.take_while(_events(spark, sf), F.col("event_type") != "purchase", _ORDER, ["user_id"]).select("event_id")


@query("o4_skip_while", f"select event_id from (select event_id, max((not event_type <> 'purchase')::int) over ({_W} rows unbounded preceding) as f from events) where f = 1")
def o4s(spark, sf):
    return seq.skip_while(_events(spark, sf), F.col("event_type") != "purchase", _ORDER, ["user_id"]).select("event_id")


@query("o5_chunks", f"select user_id, k // 7 as chunk, count(*) as n, string_agg(event_id::varchar, ',' order by k) as ids from (select user_id, event_id, row_number() over ({_W}) - 1 as k from events) group by all")
def o5(spark, sf):
    out = seq.chunks(_events(spark, sf), ["event_id"], 7, _ORDER, ["user_id"])
    return out.select("user_id", "chunk", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query("o7_index_of", f"select user_id, coalesce(min(k) filter (where event_type = 'error'), -1) as index from (select user_id, event_type, row_number() over ({_W}) - 1 as k from events) group by user_id")
def o7(spark, sf):
    return seq.index_of(_events(spark, sf), F.col("event_type") == "error", _ORDER, ["user_id"])


@query("l6_slice", "select event_id from events order by ts, event_id limit 15 offset 40")
def l6(spark, sf):
    return seq.part(_events(spark, sf), 40, 15, _ORDER).select("event_id")


# Sets ---------------------------------------------------------------------------------------------------------------


def _nations(spark, sf):
    return read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))


@query("u1_concat", "select c_nationkey as k from customer union all select s_nationkey from supplier")
def u1(spark, sf):
    return sets.concat(*_nations(spark, sf))


@query("u2_union", "select c_nationkey as k from customer union select s_nationkey from supplier")
def u2(spark, sf):
    return sets.union(*_nations(spark, sf))


@query("u3_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
def u3(spark, sf):
    return sets.intersect(*_nations(spark, sf))


@query("u4_except", "select c_nationkey as k from customer except select s_nationkey from supplier where s_acctbal > 5000")
def u4(spark, sf):
    rich = read_table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return sets.except_(_nations(spark, sf)[0], rich)


@query("u5_tagged_feed", "select 'nation' as type_name, n_nationkey::varchar as c0, n_name as c1, n_regionkey::varchar as c2 from nation union all select 'region', r_regionkey::varchar, r_name, null from region")
def u5(spark, sf):
    return sets.tagged_feed({"nation": read_table(spark, sf, "nation"), "region": read_table(spark, sf, "region")})


@query("u6_flatten", "select o_orderstatus, count(*) as n from (select o_orderstatus, unnest(list_value(o_orderkey, null)) as k from orders) where k is not null group by all")
def u6(spark, sf):
    df = read_table(spark, sf, "orders").select("o_orderstatus", F.array(F.array("o_orderkey", F.lit(None)), F.lit(None)).alias("a"))
    return sets.each(df.withColumn("a", sets.flatten("a")), "a", "k").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


# Writes and change feed ---------------------------------------------------------------------------------------------


def _incoming(spark, sf):
    df = read_table(spark, sf, "supplier")
    twice = df.where("s_suppkey % 3 = 0").select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 2 == 0, 100000).otherwise(0)).alias("s_suppkey"), F.concat("s_name", F.lit(" new")).alias("s_name"), "s_nationkey", (F.col("s_acctbal") + 1).alias("s_acctbal"))
    return twice.withColumn("seq", F.lit(1)).unionByName(twice.withColumn("seq", F.lit(2)).withColumn("s_name", F.lit("last")))


_INCOMING = "select s_suppkey + case when s_suppkey % 2 = 0 then 100000 else 0 end as s_suppkey, 'last' as s_name, s_nationkey, s_acctbal + 1 as s_acctbal from supplier where s_suppkey % 3 = 0"


@query("k3_upsert", f"with i as ({_INCOMING}) select * from i union all select * from supplier where s_suppkey not in (select s_suppkey from i)")
def k3(spark, sf):
    return writes.upsert(read_table(spark, sf, "supplier"), _incoming(spark, sf), ["s_suppkey"], ["seq"])


@query("k5_update_from", f"with i as ({_INCOMING}) select s.s_suppkey, coalesce(i.s_name, s.s_name) as s_name, s.s_nationkey, coalesce(i.s_acctbal, s.s_acctbal) as s_acctbal from supplier s left join i using (s_suppkey)")
def k5(spark, sf):
    return writes.update_from(read_table(spark, sf, "supplier"), _incoming(spark, sf), ["s_suppkey"], ["s_name", "s_acctbal"], ["seq"])


@query("k7_set_where", "select s_suppkey, case when s_acctbal < 0 then 0 else s_acctbal end as s_acctbal from supplier")
def k7(spark, sf):
    return writes.set_where(read_table(spark, sf, "supplier"), F.col("s_acctbal") < 0, {"s_acctbal": F.lit(0.0)}).select("s_suppkey", "s_acctbal")


@query("k9_delete_where", "select o_orderkey from orders where not coalesce(nullif(o_orderstatus, 'O') = 'F', false)")
def k9(spark, sf):
    return writes.delete_where(read_table(spark, sf, "orders"), F.nullif(F.col("o_orderstatus"), F.lit("O")) == "F").select("o_orderkey")


@query("k10_delete_missing", "select c_custkey from customer where not (c_nationkey = 3 and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P'))")
def k10(spark, sf):
    listed = read_table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return writes.delete_missing(read_table(spark, sf, "customer"), F.col("c_nationkey") == 3, listed, "c_custkey").select("c_custkey")


@query("k11_purge", "select l.doc_id, case when l.doc_id % 2 = 0 and d.doc_id is not null then l.doc_id end as ref from labels l left join (select doc_id from documents where doc_id % 4 = 0) d on l.doc_id = d.doc_id")
def k11(spark, sf):
    labels = read_table(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("ref"))
    return writes.purge_orphans(labels, "ref", read_table(spark, sf, "documents").where("doc_id % 4 = 0"), "doc_id", nullable=True)


@query("c1_change_feed", "select 'orders' as type_name, o_orderkey::varchar as c0, o_orderstatus as c1 from orders where o_orderdate > timestamp '1998-01-01' union all select 'events', event_id::varchar, event_type from events where ts > timestamp '1998-01-01'")
def c1(spark, sf):
    import datetime

    moment = datetime.datetime(1998, 1, 1)
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    events = read_table(spark, sf, "events").select("event_id", "event_type", F.lit(None).cast("timestamp_ntz").alias("created_at"), F.col("ts").alias("updated_at"))
    return writes.changed_since({"orders": orders, "events": events}, moment).select("type_name", "c0", "c1")


@query("c3_schema_evolution", "select n_nationkey::varchar as n_nationkey, n_name as title, null::double as score from nation")
def c3(spark, sf):
    df = read_table(spark, sf, "nation")
    return writes.evolve(df, writes.schema_changes(df, {"n_nationkey": "string", "title": "string", "score": "double"}, {"n_name": "title"})).select("n_nationkey", "title", "score")


# Functions ----------------------------------------------------------------------------------------------------------


@query("f1_text_functions", "select p_partkey, replace(p_name, 'a', '') as r, regexp_matches(p_type, '^S') as m, coalesce(regexp_extract(p_brand, '([0-9])', 1), '') as e, p_name like '%1%' as g from part")
def f1(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", fn.without("p_name", "a").alias("r"), fn.matches("p_type", "^S").alias("m"), fn.extract("p_brand", "([0-9])").alias("e"), fn.glob("p_name", "*1*").alias("g"))


@query("f2_day_bounds", "select event_id, date_trunc('day', ts)::timestamp as a, date_trunc('day', ts)::timestamp + interval '23:59:59' as z from events")
def f2(spark, sf):
    return read_table(spark, sf, "events").select("event_id", fn.start_of_day("ts").cast("timestamp_ntz").alias("a"), fn.end_of_day("ts").cast("timestamp_ntz").alias("z"))


@query("f3_linear_map", "select p_partkey, least(greatest((p_size::double - 10) / (40.0 - 10) * 100.0, 0.0), 100.0) as y, sha256(p_name) as d from part")
def f3(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", fn.mapped("p_size", 10, 40, 0, 100).alias("y"), fn.digest("p_name").alias("d"))


@query("f4_attempted", "select o_orderkey, try_cast(o_orderpriority as bigint) is not null as ok from orders")
def f4(spark, sf):
    return read_table(spark, sf, "orders").select("o_orderkey", fn.attempted(F.col("o_orderpriority"), "bigint")["ok"].alias("ok"))


@query("f5_template", "select n_nationkey, n_name || ' (' || n_regionkey || ')' as t from nation")
def f5(spark, sf):
    return read_table(spark, sf, "nation").select("n_nationkey", fn.filled("{name} ({region})", name="n_name", region="n_regionkey").alias("t"))


@query("x1_json_path", "select event_id, json_extract_string(props, '$.k') as k from events")
def x1(spark, sf):
    return read_table(spark, sf, "events").select("event_id", fn.at_path("props", "k").alias("k"))


# Flows --------------------------------------------------------------------------------------------------------------


@query("t1_aligned_windows", "select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by all")
def t1(spark, sf):
    return flows.aligned_windows(_events(spark, sf), "1 hour", ["event_type"], [F.count("*").alias("n")]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("t2_batches", f"""with recursive n as (select event_id, user_id, ts, row_number() over ({_W}) as k from events),
r as (select user_id, k, event_id, ts as start, ts as at, 1 as held, 0::bigint as batch from n where k = 1
union all select n.user_id, n.k, n.event_id, case when r.held >= 5 or r.at - r.start >= interval '1 hour' then n.ts else r.start end, n.ts,
case when r.held >= 5 or r.at - r.start >= interval '1 hour' then 1 else r.held + 1 end, r.batch + (r.held >= 5 or r.at - r.start >= interval '1 hour')::int from r join n on n.user_id = r.user_id and n.k = r.k + 1)
select event_id, batch from r""")
def t2(spark, sf):
    return flows.count_or_time_batches(_events(spark, sf), 5, 3600, ["user_id"], _ORDER).select("event_id", "batch")


@query("t3_throttle", f"""with recursive n as (select event_id, user_id, ts, row_number() over ({_W}) as k from events),
r as (select user_id, k, event_id, ts as kept_ts, true as kept from n where k = 1
union all select n.user_id, n.k, n.event_id, case when n.ts - r.kept_ts >= interval '6 hours' then n.ts else r.kept_ts end, n.ts - r.kept_ts >= interval '6 hours' from r join n on n.user_id = r.user_id and n.k = r.k + 1)
select event_id from r where kept""")
def t3(spark, sf):
    return flows.throttle(_events(spark, sf), 6 * 3600, ["user_id"], _ORDER).select("event_id")


@query("t4_debounce", f"select event_id from (select event_id, ts, lead(ts) over ({_W}) as nxt from events) where nxt is null or nxt - ts >= interval '6 hours'")
def t4(spark, sf):
    return flows.debounce(_events(spark, sf), 6 * 3600, ["user_id"], _ORDER).select("event_id")


@query("t5_sampled", f"""with recursive n as (select event_id, user_id, ts, row_number() over ({_W}) as k, count(*) over (partition by user_id) as rows_of_key from events),
r as (select user_id, k, event_id, rows_of_key, ts as kept_ts, false as kept from n where k = 1
union all select n.user_id, n.k, n.event_id, n.rows_of_key, case when n.ts - r.kept_ts >= interval '6 hours' then n.ts else r.kept_ts end, n.ts - r.kept_ts >= interval '6 hours' from r join n on n.user_id = r.user_id and n.k = r.k + 1)
select event_id from r where kept or k = rows_of_key""")
def t5(spark, sf):
    return flows.sampled(_events(spark, sf), 6 * 3600, ["user_id"], _ORDER).select("event_id")


@query("t1_anchored_windows", f"""with recursive n as (select event_id, user_id, ts, row_number() over ({_W}) as k from events),
r as (select user_id, k, event_id, ts as start, 0::bigint as "window" from n where k = 1
union all select n.user_id, n.k, n.event_id, case when n.ts - r.start >= interval '1 hour' then n.ts else r.start end, r."window" + (n.ts - r.start >= interval '1 hour')::int from r join n on n.user_id = r.user_id and n.k = r.k + 1)
select event_id, "window" from r""")
def t1a(spark, sf):
    return flows.anchored_windows(_events(spark, sf), 3600, ["user_id"], _ORDER).select("event_id", "window")


@query("t1_sessions", f"""with g as (select user_id, ts, event_id, coalesce(ts - lag(ts) over ({_W}) >= interval '1 hour', true)::int as new from events),
s as (select user_id, ts, sum(new) over ({_W} rows unbounded preceding) as s from g) select user_id, count(*) as n, min(ts) as window_start from s group by user_id, s""")
def t1s(spark, sf):
    return flows.sessions(_events(spark, sf), "1 hour", ["user_id"], [F.count("*").alias("n")]).select("user_id", "n", F.col("window_start").cast("timestamp_ntz").alias("window_start"))


# Reads, shapes and predicates of their own --------------------------------------------------------------------------


@query("s7_first_or_none", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey desc limit 1")
def s7(spark, sf):
    df = read_table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    row = lookups.first_or_none(lookups.fetch(df, order_by="o_totalprice", descending=True, limit=1, identifier="o_orderkey"))
    return spark.createDataFrame([row] if row else [], df.schema)


@query("s13_scalar", "select max(o_totalprice) as top from orders")
def s13(spark, sf):
    return spark.createDataFrame([(lookups.scalar(read_table(spark, sf, "orders").agg(F.max("o_totalprice"))),)], "top double")


@query("s15_any_rows", """select count(*) > 0 as "Value" from orders where o_totalprice < 0""")
def s15(spark, sf):
    return lookups.any_rows(read_table(spark, sf, "orders"), p.lt("o_totalprice", 0))


@query("s18_renamed", "select n_nationkey as id, n_name as title, n_regionkey from nation")
def s18(spark, sf):
    return shapes.renamed(read_table(spark, sf, "nation", ["n_nationkey", "n_name", "n_regionkey"]), {"n_nationkey": "id", "n_name": "title", "absent": "x"})


@query("j3_mapped_into", "select p_partkey::varchar as P_PARTKEY, try_cast(p_name as bigint) as p_name, p_retailprice, null::varchar as note from part")
def j3(spark, sf):
    return shapes.mapped_into(read_table(spark, sf, "part"), {"P_PARTKEY": "string", "p_name": "bigint", "p_retailprice": "double", "note": "string"})


@query("h5_key_values", "select n_nationkey, 'n_name' as name, n_name as value from nation union all select n_nationkey, 'n_regionkey', n_regionkey::varchar from nation")
def h5(spark, sf):
    return shapes.key_values(read_table(spark, sf, "nation", ["n_nationkey", "n_name", "n_regionkey"]), ["n_nationkey"])


@query("h14_length_check", "select doc_id, coalesce(length(text), 0) between 40 and 4000 as fits, coalesce(length(lang), 0) >= 3 as long_lang from documents")
def h14(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", shapes.length_between("text", 40, 4000).alias("fits"), shapes.length_between("lang", 3).alias("long_lang"))


@query("n15_cross_matrix", "select c_nationkey, count(o_orderkey) filter (where o_orderstatus = 'F') as \"F\", count(o_orderkey) filter (where o_orderstatus = 'O') as \"O\" from customer left join orders on o_custkey = c_custkey and o_totalprice > 1000 group by c_nationkey")
def n15(spark, sf):
    customers, orders = read_table(spark, sf, "customer", ["c_custkey", "c_nationkey"]), read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > 1000)
    return shapes.cross_matrix(customers, orders, on, "c_nationkey", "o_orderstatus", ["F", "O"], F.count("o_orderkey"))


@query("p9_replace", "select p_partkey, replace(p_name, 'o', '0') as a, regexp_replace(p_brand, '([0-9])([0-9])', '\\2\\1', 'g') as b from part")
def p9(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", fn.replaced("p_name", "o", "0").alias("a"), fn.pattern_replaced("p_brand", "([0-9])([0-9])", "$2$1").alias("b"))


@query("p15_in_and_not_in", "select p_partkey from part where p_size in (1, 5, 7) and p_brand not in ('Brand#11', 'Brand#12')")
def p15(spark, sf):
    return read_table(spark, sf, "part").where(p.is_in("p_size", [1, 5, 7]) & p.is_in("p_brand", ["Brand#11", "Brand#12"], negated=True)).select("p_partkey")


@query("p19_first_member", "select c_custkey, (select arg_min(o_totalprice, o_orderkey) from orders where o_custkey = c_custkey) as first_price from customer")
def p19(spark, sf):
    return _graph(spark, sf, "customer").select("c_custkey", shapes.first_member("orders", "o_totalprice").alias("first_price"))


@query("p20_outer_reference", "select o_orderkey from orders join customer on o_custkey = c_custkey where c_acctbal > 0 and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_extendedprice > o_totalprice)")
def p20(spark, sf):
    child = p.any_of("lines", lambda x: x["l_extendedprice"] > F.col("o_totalprice"))
    return _graph(spark, sf, "orders", having=(F.col("customer.c_acctbal") > 0) & child).select("o_orderkey")


@query("p21_scalar_predicate", "select o_orderkey, n_name as nation_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_name >= 'NATION_2' and o_totalprice > 1000")
def p21(spark, sf):
    return _graph(spark, sf, "orders", shape="linear", where=F.col("o_totalprice") > 1000, having=F.col("nation_name") >= "NATION_2").select("o_orderkey", "nation_name")


@query("m8_loose_case", "select o_orderkey, lower(coalesce(nullif(o_orderstatus, 'F'), '')) as l, upper((o_totalprice > 1000)::varchar) as u from orders")
def m8(spark, sf):
    return read_table(spark, sf, "orders").select("o_orderkey", loose.lower(F.nullif(F.col("o_orderstatus"), F.lit("F"))).alias("l"), loose.upper(F.col("o_totalprice") > 1000).alias("u"))


@query("m9_truth", "select p_partkey from part where coalesce(nullif(p_brand, 'Brand#11'), '') <> '' and coalesce(p_size % 3, 0) <> 0")
def m9(spark, sf):
    return read_table(spark, sf, "part").where(loose.truth(F.nullif(F.col("p_brand"), F.lit("Brand#11")), "string") & loose.truth(F.col("p_size") % 3, "int")).select("p_partkey")


@query("n7_shared_edge", "select o_orderkey, c_name as customer_name, c_acctbal as balance from orders left join customer on o_custkey = c_custkey")
def n7(spark, sf):
    return _graph(spark, sf, "orders").select("o_orderkey", "customer_name", F.col("customer.c_acctbal").alias("balance"))


@query("n8_type_by_two_keys", "select s_suppkey, a.n_name as own, b.n_name as other from supplier left join nation a on a.n_nationkey = s_nationkey left join nation b on b.n_nationkey = s_nationkey + 1")
def n8(spark, sf):
    two = Entity("pair", ("s_suppkey",), ("s_suppkey", "s_nationkey", "s_other"), (Scalar("own", "nation", "s_nationkey", "n_name"), Scalar("other", "nation", "s_other", "n_name")))
    read = lambda name: read_table(spark, sf, "supplier").withColumn("s_other", F.col("s_nationkey") + 1) if name == "pair" else read_table(spark, sf, name)
    return load_graph(ENTITIES | {"pair": two}, read, "pair").select("s_suppkey", "own", "other")


@query("a0_distinct_roots", "select c_custkey, n_name as nation_name from customer left join nation on c_nationkey = n_nationkey where c_custkey % 7 <> 0")
def a0(spark, sf):
    def read(name):
        df = read_table(spark, sf, name)
        return df.unionByName(df).withColumn("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey"))) if name == "customer" else df

    return load_graph(ENTITIES, read, "customer", shape="linear", distinct=True).select("c_custkey", "nation_name")


@query("k6_stamped_update", "select s_suppkey, case when s_acctbal < 0 then 'low' else s_name end as s_name, case when s_acctbal < 0 then timestamp '2024-01-01' else timestamp '2020-01-01' end as updated_at from supplier")
def k6(spark, sf):
    moment = lambda text: F.lit(text).cast("timestamp_ntz")
    df = read_table(spark, sf, "supplier", ["s_suppkey", "s_name", "s_acctbal"]).withColumn("updated_at", moment("2020-01-01"))
    return writes.set_where(df, F.col("s_acctbal") < 0, {"s_name": F.lit("low")}, "updated_at", moment("2024-01-01")).select("s_suppkey", "s_name", "updated_at")


@query("c5_state_hash", "select count(distinct (p_brand, p_type, p_size)) as states from part")
def c5(spark, sf):
    return writes.row_hash(read_table(spark, sf, "part"), ["p_brand", "p_type", "p_size"]).agg(F.count_distinct("state_hash").alias("states"))


@query("g8_index_without_null_keys", "select k, min(o_orderkey) as o_orderkey from (select nullif(o_orderpriority, '5-LOW') as k, o_orderkey from orders) where k is not null group by k")
def g8(spark, sf):
    df = read_table(spark, sf, "orders").select(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("k"), "o_orderkey")
    return agg.first_by_key(df, ["k"], ["o_orderkey"], drop_null_keys=True)


@query("l9_random_pick", "select c_custkey from customer order by md5('7:' || c_custkey), c_custkey limit 25")
def l9(spark, sf):
    return seq.sample(read_table(spark, sf, "customer", ["c_custkey"]), 25, seed=7, keys=["c_custkey"])


@query("u8_split", "select o_orderkey, coalesce(nullif(o_orderstatus, 'P') = 'F', false) as met from orders")
def u8(spark, sf):
    met, rest = sets.split(read_table(spark, sf, "orders", ["o_orderkey", "o_orderstatus"]), F.nullif(F.col("o_orderstatus"), F.lit("P")) == "F")
    return sets.concat(met.select("o_orderkey", F.lit(True).alias("met")), rest.select("o_orderkey", F.lit(False).alias("met")))


@query("u10_each", "select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def u10(spark, sf):
    return sets.each(read_table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words")), "words", "word").select("p_partkey", "word")


@query("f6_numbers", """select p_partkey, round_even(p_size / 2.0, 0)::double as half, format('${:,.2f}', p_retailprice) as price, sha256(p_brand) as digest, case when p_partkey * 700 >= 1048576 then printf('%.2f MB', round(p_partkey * 700 / 1048576.0, 2)) when p_partkey * 700 >= 1024 then printf('%.2f KB', round(p_partkey * 700 / 1024.0, 2)) else (p_partkey * 700) || ' B' end as bytes from part""")
def f6(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", fn.rounded(F.col("p_size") / 2, 0).cast("double").alias("half"), fn.money("p_retailprice").alias("price"), fn.digest("p_brand").alias("digest"), fn.byte_size(F.col("p_partkey") * 700).alias("bytes"))


@query("f7_base64", "select p_partkey, p_name <> '' as coded, false as plain from part")
def f7(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", fn.is_base64(F.base64(F.col("p_name").cast("binary"))).alias("coded"), fn.is_base64("p_name").alias("plain"))


@query("f8_primes_fibonacci", """with recursive f as (select 0 as i, 0::bigint as a, 1::bigint as b union all select i + 1, b, case when i < 90 then a + b end from f where i < 50)
    select p_partkey, p_partkey >= 2 and not exists (select 1 from range(2, 400) d(k) where k < p_partkey and p_partkey % k = 0 and k * k <= p_partkey) as prime, a as number from part join f on i = p_size""")
def f8(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", fn.is_prime("p_partkey").alias("prime"), fn.fibonacci("p_size").alias("number"))


@query("f9_row_as_map", "select p_partkey, p_brand as brand, p_size::varchar as size, 2 as n from part")
def f9(spark, sf):
    m = fn.as_map("p_brand", "p_size")
    return read_table(spark, sf, "part").select("p_partkey", m["p_brand"].alias("brand"), m["p_size"].alias("size"), F.size(m).alias("n"))


# The flagship -------------------------------------------------------------------------------------------------------


@query("flagship_order_graph", """with c as (select l_orderkey, count(*) as lines, sum(l_quantity) as quantity from lineitem where l_quantity > 45 group by l_orderkey)
select o_orderkey, c_name as customer_name, n_name as nation_name, lines, quantity from orders join c on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey
where o_totalprice > 100000 order by o_orderkey limit 20""")
def flagship(spark, sf):
    out = _graph(spark, sf, "orders", where=p.gt("o_totalprice", 100000), any_child={"lines": p.gt("l_quantity", 45)}, limit=20)
    return out.select("o_orderkey", "customer_name", "nation_name", F.size("lines").cast("long").alias("lines"), F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("quantity"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
