"""Boolean trigram queries that every match of a regular expression satisfies."""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser

STRINGS = 64  # alternatives that are followed as whole strings
CLAUSES = 64  # alternatives of a query

Query = frozenset[frozenset[str]]  # one of the sets must be present whole
ALWAYS: Query = frozenset([frozenset()])


def _query(strings: set[str]) -> Query:
    clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return ALWAYS if frozenset() in clauses else frozenset(clauses)


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > CLAUSES:
        return a if a != ALWAYS else b
    return frozenset(x | y for x, y in product(a, b))


def _parts(items, queries: list[Query]) -> list[set[str] | None]:
    """For each item its strings, or None where they are not finite and few."""
    found: list[set[str] | None] = []
    for kind, value in items:
        if kind is op.LITERAL:
            found.append({chr(value).lower()})
        elif kind is op.IN:
            chars = set()
            for what, x in value:
                if what is op.LITERAL:
                    chars.add(chr(x).lower())
                elif what is op.RANGE and x[1] - x[0] < 8:
                    chars.update(chr(c).lower() for c in range(x[0], x[1] + 1))
                else:
                    chars = None
                    break
            found.append(chars if chars and len(chars) <= 8 else None)
        elif kind is op.SUBPATTERN:
            found.extend(_parts(value[3], queries))
        elif kind is op.BRANCH:
            found.append(_branch(value[1], queries))
        elif kind is op.MAX_REPEAT:
            least, most, inner = value
            if least == 0 and most == 1:
                whole = _strings(inner)
                found.append(whole | {""} if whole is not None else None)
            elif least == 0:
                found.append(None)
            else:
                found.extend(_parts(inner, queries))
                if (least, most) != (1, 1):
                    found.append(None)
        elif kind is op.AT:
            continue
        else:
            found.append(None)
    return found


def _strings(items) -> set[str] | None:
    parts = _parts(items, [])
    whole = {""}
    for part in parts:
        if part is None or len(whole) * len(part) > STRINGS:
            return None
        whole = {a + b for a, b in product(whole, part)}
    return whole


def _branch(branches, queries: list[Query]) -> set[str] | None:
    whole = [_strings(branch) for branch in branches]
    if all(x is not None for x in whole) and sum(map(len, whole)) <= STRINGS:
        return set().union(*whole)
    either = frozenset().union(*[_of(branch) for branch in branches])
    queries.append(ALWAYS if frozenset() in either or len(either) > CLAUSES else either)
    return None


def _of(items) -> Query:
    queries: list[Query] = []
    parts, run, query = _parts(items, queries), {""}, ALWAYS
    for part in [*parts, None]:
        if part is not None and len(run) * len(part) <= STRINGS:
            run = {a + b for a, b in product(run, part)}
            continue
        query = _both(query, _query(run))
        run = part or {""}
    for other in [_query(run), *queries]:
        query = _both(query, other)
    return query


def trigram_query(pattern: str) -> Query:
    """Sets of lower case trigrams, one of which the lower case text holds whole
    wherever ``pattern`` matches.

    The set with one empty member is the query that every text satisfies: the
    expression has no mandatory trigram.
    """
    query = _of(_parser.parse(pattern))
    # A set that holds another whole asks for nothing that the smaller doesn't.
    return frozenset(x for x in query if not any(y < x for y in query))
