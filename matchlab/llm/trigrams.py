"""Boolean trigram queries derived from regular expressions."""

from __future__ import annotations

import re
from re import _constants as kind
from re import _parser as parser

#: Sets of strings and clauses beyond these sizes are given up: the query gets weaker, never wrong.
MOST_STRINGS, MOST_CLAUSES, MOST_MEMBERS = 64, 64, 8

#: A query is a frozenset of clauses, one of which must hold; a clause is a
#: frozenset of trigrams that must all occur. ANY (the empty clause) holds always.
ANY = frozenset([frozenset()])


def _of_strings(strings: set[str]) -> frozenset:
    return _least(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _least(clauses) -> frozenset:
    """Without the clauses that another one implies."""
    c = set(clauses)
    if frozenset() in c or len(c) > MOST_CLAUSES:
        return ANY
    return frozenset(x for x in c if not any(y < x for y in c))


def _both(a: frozenset, b: frozenset) -> frozenset:
    if len(a) * len(b) > MOST_CLAUSES:
        return a if b == ANY or len(a) <= len(b) else b
    return _least(x | y for x in a for y in b)


def _exact(item) -> set[str] | None:
    """All strings that a piece of a pattern matches, if they are few."""
    op, arg = item
    if op is kind.LITERAL:
        return {chr(arg)}
    if op is kind.IN and len(arg) <= MOST_MEMBERS and all(x[0] is kind.LITERAL for x in arg):
        return {chr(x[1]) for x in arg}
    if op is kind.AT:
        return {""}
    if op is kind.SUBPATTERN:
        return _exact_seq(arg[3])
    if op is kind.BRANCH:
        parts = [_exact_seq(x) for x in arg[1]]
        return None if any(p is None for p in parts) or sum(map(len, parts)) > MOST_STRINGS else set().union(*parts)
    if op in (kind.MAX_REPEAT, kind.MIN_REPEAT) and arg[1] == 1:
        inner = _exact_seq(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _exact_seq(seq) -> set[str] | None:
    out = {""}
    for item in seq:
        part = _exact(item)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def _query(seq) -> frozenset:
    out, run = ANY, {""}
    for item in seq:
        part = _exact(item)
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        out, run = _both(out, _of_strings(run)), part or {""}
        op, arg = item
        if part is not None:
            continue
        if op is kind.SUBPATTERN:
            out = _both(out, _query(arg[3]))
        elif op is kind.BRANCH:
            out = _both(out, _least(c for x in arg[1] for c in _query(x)))
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT) and arg[0] > 0:
            out = _both(out, _query(arg[2]))
    return _both(out, _of_strings(run))


def trigram_query(pattern: str) -> frozenset:
    """What any text with a match must hold, over its lower-cased trigrams; ANY if the
    pattern has no mandatory trigram."""
    tree = parser.parse(pattern, re.ASCII)
    return _least(frozenset(t.lower() for t in c) for c in _query(tree))
