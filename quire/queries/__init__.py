"""The library's operators as queries over the given tables, each with its oracle where SQL can express it."""

from __future__ import annotations


def modules():
    from . import chunks, geometry, joins, profile, render, tables, tree

    return (profile, tree, geometry, tables, chunks, joins, render)


def queries():
    out = {}
    for m in modules():
        out |= m.QUERIES
    return out


def oracle_sql():
    out = {}
    for m in modules():
        out |= m.ORACLE
    return out
