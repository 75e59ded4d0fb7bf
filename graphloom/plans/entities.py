"""Declared entities: identifier, columns and relations to other entities."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Scalar:
    """A column of the entity that `key` refers to."""

    name: str
    target: str
    key: str
    column: str


@dataclass(frozen=True)
class Far:
    """A column two steps away: `key` refers to `via`, whose `via_key` refers to `target`."""

    name: str
    via: str
    key: str
    target: str
    via_key: str
    column: str


@dataclass(frozen=True)
class ObjectOf:
    """The entity that `key` refers to, as a struct; where: roots or children that take it ("full", "root" or "child")."""

    name: str
    target: str
    key: str
    where: str = "full"


@dataclass(frozen=True)
class ListOf:
    """The entities whose `key` refers to this one, as an array of structs in the order of their identifiers."""

    name: str
    target: str
    key: str
    where: str = "full"


Relation = Scalar | Far | ObjectOf | ListOf


@dataclass(frozen=True)
class Entity:
    """identifier: the columns that tell rows apart."""

    name: str
    identifier: tuple[str, ...]
    columns: tuple[str, ...]
    relations: tuple[Relation, ...] = field(default=())

    def __post_init__(self) -> None:
        if not self.identifier:
            raise ValueError(f"{self.name} has no identifier")
        for c in self.identifier:
            if c not in self.columns:
                raise ValueError(f"{self.name}: the identifier {c} is not a column")
        names = [*self.columns, *(r.name for r in self.relations)]
        if len({n.lower() for n in names}) < len(names):
            raise ValueError(f"{self.name}: two members share a name: {sorted(names)}")
        for r in self.relations:
            if not isinstance(r, ListOf) and r.key not in self.columns:
                raise ValueError(f"{self.name}.{r.name}: the key {r.key} is not a column")


def check_relations(entities: dict[str, Entity], root: str, at: str | None = None, above: tuple[str, ...] = ()) -> None:
    """Raise where a relation names an unknown entity or column, or an entity other than the root would hold itself."""
    entity = entities[at or root]
    for r in entity.relations:
        if above and getattr(r, "where", "full") == "root" or not above and getattr(r, "where", "full") == "child":
            continue
        for name in (r.via, r.target) if isinstance(r, Far) else (r.target,):
            if name not in entities:
                raise ValueError(f"{entity.name}.{r.name}: there is no entity {name}")
        column = r.key if isinstance(r, ListOf) else getattr(r, "column", None)
        if column is not None and column not in entities[r.target].columns:
            raise ValueError(f"{entity.name}.{r.name}: {r.target} has no column {column}")
        if isinstance(r, ObjectOf | ListOf):
            line = (*above, entity.name)
            if r.target in line and (r.target != root or r.target in line[1:]):
                raise ValueError(f"{entity.name}.{r.name}: {' > '.join((*line, r.target))} goes in a circle")
            if r.target != root:
                check_relations(entities, root, r.target, line)


def dependency_order(references: dict[str, Iterable[str]]) -> list[str]:
    """Names so that what each one refers to comes before it; raises on a circle."""
    done: list[str] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(f"{' > '.join((*above, name))} goes in a circle")
        if name not in done:
            for other in references.get(name, ()):
                if other != name:
                    visit(other, (*above, name))
            done.append(name)

    for name in references:
        visit(name, ())
    return done
