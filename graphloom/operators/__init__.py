"""Predicates, sequence operators, aggregation, set operators and keyed writes over DataFrames."""
