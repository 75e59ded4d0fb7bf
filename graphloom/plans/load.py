"""Loading a root entity with its related graph: joins that Catalyst plans, lists grouped before they are joined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.entities import Entity, Far, ListOf, ObjectOf, Scalar, check_relations
from graphloom.sources.lookups import ordering, page

Read = Callable[[str], DataFrame]


def _keyed(entity: Entity) -> str:
    if len(entity.identifier) > 1:
        raise ValueError(f"{entity.name} has an identifier of several columns; only lists may lead to it")
    return entity.identifier[0]


def _to_one(df: DataFrame, entity: Entity, name: str) -> DataFrame:
    """The rows as one struct, beside the identifier: one row for each, so a join keeps its left side's rows."""
    return df.where(F.col(_keyed(entity)).isNotNull()).select(F.col(_keyed(entity)).alias(f"__{name}_id"), F.struct(*df.columns).alias(f"__{name}"))


def _attach(entities: dict[str, Entity], read: Read, entity: Entity, df: DataFrame, shape: str, depth: int, root: str, child_filters: dict[str, Column], few: DataFrame | None = None) -> DataFrame:
    """df with a column for each relation. Relations by the same key share one join, objects and scalars alike. few: the identifiers of df, if they are so few that lists are pruned to them before they are grouped."""
    joined: dict[tuple[str, str], str] = {}

    def edge(df: DataFrame, target: str, key: Column, by: str, inner: DataFrame | None = None) -> tuple[DataFrame, str]:
        if (target, by) in joined:
            return df, joined[(target, by)]
        name = f"{entity.name}_{target}_{len(joined)}"
        joined[(target, by)] = name
        one = read(target).select(*entities[target].columns) if inner is None else inner
        return df.join(_to_one(one, entities[target], name), key == F.col(f"__{name}_id"), "left"), name

    def whole(target: Entity) -> DataFrame:
        inner = read(target.name).select(*target.columns).where(" and ".join(f"`{c}` is not null" for c in target.identifier))
        return inner if target.name == root else _attach(entities, read, target, inner, shape, depth + 1, root, {})

    made: dict[str, Column] = {}
    for r in entity.relations:  # objects first: what they hold serves scalars by the same key
        if shape == "graph" and isinstance(r, ObjectOf) and not (depth and r.where == "root" or not depth and r.where == "child"):
            df, name = edge(df, r.target, F.col(r.key), r.key, None if (r.target, r.key) in joined else whole(entities[r.target]))
            made[r.name] = F.col(f"__{name}")
    for r in entity.relations:
        if depth and getattr(r, "where", "full") == "root" or not depth and getattr(r, "where", "full") == "child":
            continue
        if isinstance(r, Scalar):
            df, name = edge(df, r.target, F.col(r.key), r.key)
            made[r.name] = F.col(f"__{name}.{r.column}")
        elif isinstance(r, Far):
            df, via = edge(df, r.via, F.col(r.key), r.key)
            df, name = edge(df, r.target, F.col(f"__{via}.{r.via_key}"), f"{r.key}.{r.via_key}")
            made[r.name] = F.col(f"__{name}.{r.column}")
    if shape == "graph":
        for r in entity.relations:
            if not isinstance(r, ListOf) or depth and r.where == "root" or not depth and r.where == "child":
                continue
            target = entities[r.target]
            inner = whole(target) if few is None else whole(target).join(few, F.col(r.key) == F.col("__few"), "left_semi")
            if r.name in child_filters:
                inner = inner.where(child_filters[r.name])
            # One row for each parent before the join, so that sibling lists do not multiply each other.
            element = F.struct(F.struct(*target.identifier).alias("id"), F.struct(*inner.columns).alias("value"))
            lists = inner.where(F.col(r.key).isNotNull()).dropDuplicates([r.key, *target.identifier]).groupBy(F.col(r.key).alias(f"__{r.name}_key"))
            lists = lists.agg(F.transform(F.array_sort(F.collect_list(element)), lambda x: x["value"]).alias(f"__{r.name}_list"))
            df = df.join(lists, F.col(_keyed(entity)) == F.col(f"__{r.name}_key"), "inner" if r.name in child_filters else "left")
            empty = F.array().cast(lists.schema[f"__{r.name}_list"].dataType)
            made[r.name] = F.coalesce(F.col(f"__{r.name}_list"), empty)
    order = sorted((r for r in entity.relations if r.name in made), key=lambda r: isinstance(r, ObjectOf | ListOf))
    return df.select(*entity.columns, *[made[r.name].alias(r.name) for r in order])


def load_graph(entities: dict[str, Entity], read: Read, root: str, shape: str = "graph", where: Column | None = None, having: Column | None = None, any_child: dict[str, Column] | None = None, mode: str = "row", order_by: str | None = None, descending: bool = False, skip: int | None = None, limit: int | None = None, distinct: bool = False) -> DataFrame:
    """One row for each root: its columns, its scalars, and (shape "graph") objects and lists; "linear" loads scalars only.

    where: on the root's own columns, applied before any join, so it reaches the scan. having: on the loaded row.
    any_child: list name -> condition on the child's columns. A root needs a matching child in each; mode "row" also leaves only matching children in the list, as a filter on joined rows does, mode "entity" keeps the whole list.
    distinct: identifiers may repeat in the tables, and one row of each counts, in roots and in what they lead to; else they are taken to tell rows apart, as declared, which saves a grouping for each table. Lists are told by identifiers in either case.
    Roots without an identifier are skipped; paging counts roots, in the order of order_by, ties by identifier.
    """
    if mode not in ("row", "entity") or shape not in ("graph", "linear"):
        raise ValueError(f"mode {mode!r} or shape {shape!r} is not known")
    check_relations(entities, root)
    entity, any_child = entities[root], any_child or {}
    if distinct:
        given = read
        read = lambda name: given(name).dropDuplicates(list(entities[name].identifier))
    df = read(root).select(*entity.columns)
    df = df.where(" and ".join(f"`{c}` is not null" for c in entity.identifier))
    df = df if where is None else df.where(where)
    lists = {r.name: r for r in entity.relations if isinstance(r, ListOf)}
    if mode == "entity" or shape == "linear":
        for name, condition in any_child.items():
            child = read(lists[name].target).where(condition).select(F.col(lists[name].key).alias("__key"))
            df = df.join(child, F.col(_keyed(entity)) == F.col("__key"), "left_semi")
    paged = bool(skip) or limit is not None
    by = ordering(order_by or entity.identifier[0], descending, entity.identifier[0])
    early = paged and having is None and not (any_child and mode == "row")
    if early:  # roots are paged before their children are read
        df = page(df.orderBy(*by), skip, limit)
    few = df.select(F.col(_keyed(entity)).alias("__few")) if early and limit is not None and any(isinstance(r, ListOf) for r in entity.relations) else None
    out = _attach(entities, read, entity, df, shape, 0, root, any_child if mode == "row" and shape == "graph" else {}, few)
    out = out if having is None else out.where(having)
    return page(out.orderBy(*by), skip, limit) if paged and not early else out
