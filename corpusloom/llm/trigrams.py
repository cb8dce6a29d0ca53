"""Boolean trigram queries derived from regular expressions.

A query is a disjunction of clauses, each a set of lower-case trigrams that any match must
hold. The empty clause means that nothing is mandatory. Every step only ever weakens a
query, so a text that holds a match always satisfies it.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as P

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: Bounds on the alternatives that are followed exactly; beyond them a query gets weaker.
MOST_STRINGS, MOST_CLASS, MOST_CLAUSES = 64, 8, 32


def _of_string(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _simplify(clauses) -> Query:
    """Without clauses that another clause implies."""
    found = set(clauses)
    return frozenset(c for c in found if not any(d < c for d in found))


def _of_strings(strings: set[str]) -> Query:
    return _simplify(_of_string(s) for s in strings)


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_CLAUSES:
        return min(a, b, key=lambda q: (ANY <= q, len(q)))
    return _simplify(x | y for x in a for y in b)


def _class(items) -> set[str] | None:
    chars: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            chars.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < MOST_CLASS:
            chars |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return chars if len(chars) <= MOST_CLASS else None


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """The exact strings of a sequence if they are few, and the query beside them."""
    exact: set[str] | None = {""}
    whole, query = True, ANY

    def flush() -> None:
        nonlocal exact, query, whole
        query, exact, whole = _both(query, _of_strings(exact)), {""}, False

    for op, arg in nodes:
        here: set[str] | None = None
        needs = ANY
        if op is C.LITERAL:
            here = {chr(arg).lower()}
        elif op is C.IN:
            here = _class(arg)
        elif op is C.SUBPATTERN:
            here, needs = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                here = set().union(*(p[0] for p in parts))
            else:
                needs = _simplify(c for strings, q in parts for c in (q if strings is None else _of_strings(strings)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, body = arg
            strings, inner = _walk(body)
            if (least, most) == (0, 1) and strings is not None:
                here = strings | {""}
            elif least == most and strings is not None and len(strings) ** least <= MOST_STRINGS:
                here = {""}
                for _ in range(least):
                    here = {a + b for a in here for b in strings}
            elif least:
                needs = inner if strings is None else _of_strings(strings)
        elif op is C.AT:
            here = {""}
        if here is not None and len(here) * len(exact) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in here}
        else:
            flush()
            query = _both(query, needs)
            if here is not None and len(here) <= MOST_STRINGS:
                exact = here
    if whole:
        return exact, ANY
    flush()
    return None, query


def trigram_query(regex: str) -> Query:
    """The clauses of a regex, over lower-cased text; ANY if no trigram is mandatory."""
    strings, query = _walk(P.parse(regex, re.DOTALL))
    query = query if strings is None else _of_strings(strings)
    return ANY if any(not c for c in query) else query
