"""Boolean trigram queries for regular expressions.

A query is in disjunctive form: a set of conjunctions, each a frozen set of
lower-case trigrams. Every text that matches the expression holds all trigrams
of at least one conjunction. An empty conjunction asks for nothing: the
expression has no mandatory trigrams and must be tried on every text.
"""

from __future__ import annotations

from re import _constants as k
from re import _parser as parser

Query = frozenset[frozenset[str]]
EVERYTHING: Query = frozenset([frozenset()])
MAX_STRINGS = 64
MAX_CLASS = 8


def _minimal(q) -> Query:
    """Without conjunctions that another one implies."""
    return frozenset(a for a in q if not any(b < a for b in q))


def _and(p: Query, q: Query) -> Query:
    both = _minimal({a | b for a in p for b in q})
    return both if len(both) <= MAX_STRINGS else min(p, q, key=len)


def _asked(strings: set[str]) -> Query:
    """The query of an expression that matches just these strings."""
    return _minimal({frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in strings})


def _chars(members) -> set[str] | None:
    out: set[str] = set()
    for op, arg in members:
        if op is k.LITERAL:
            out.add(chr(arg))
        elif op is k.RANGE and arg[1] - arg[0] < MAX_CLASS:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if 0 < len(out) <= MAX_CLASS else None


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    """What a sequence matches: its strings if they are few, and its query."""
    run, query, whole = {""}, EVERYTHING, True
    for node in nodes:
        strings, part = _node(node)
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query, whole = _and(query, _asked(run)), False
        run = strings or {""}
        if strings is None:
            query = _and(query, part)
    return (run if whole else None), _and(query, _asked(run))


def _node(node) -> tuple[set[str] | None, Query]:
    op, arg = node
    if op is k.LITERAL:
        return {chr(arg)}, EVERYTHING
    if op is k.IN:
        return _chars(arg), EVERYTHING
    if op is k.SUBPATTERN:
        return _sequence(arg[-1])
    if op is k.AT:
        return {""}, EVERYTHING
    if op is k.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        strings = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
        return strings if strings is None or len(strings) <= MAX_STRINGS else None, _minimal({c for _, q in parts for c in q})
    if op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, EVERYTHING
        if low == high == 1:
            return strings, query
        return None, query if low else EVERYTHING
    return None, EVERYTHING


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression, in lower case."""
    return _sequence(parser.parse(pattern))[1]
