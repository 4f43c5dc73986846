"""Named queries over the test tables, each with an independent SQL statement where SQL can say it."""

from gistmill.registry import cleaning, features, labels, scores, topics, vectors

MODULES = [cleaning, features, topics, labels, scores, vectors]


def all_queries():
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_oracles():
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
