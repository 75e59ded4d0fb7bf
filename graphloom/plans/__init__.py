"""Entities, their relations, and the joins that load a root with its related graph."""

from graphloom.plans.entities import Entity, Far, ListOf, ObjectOf, Scalar, dependency_order
from graphloom.plans.load import load_graph
