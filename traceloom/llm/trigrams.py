"""Boolean trigram queries from regexes.

Every text that a regex matches holds certain trigrams: those of one of the
alternatives that ``trigram_query`` gives. They follow from the parsed pattern: each part of
it tells the strings it can match if these are few, else strings that a match begins and
ends with, and what any match must hold. Concatenation joins ends to beginnings,
alternation unites, an optional part promises nothing.

Letters count in lower case, as the postings are; a character outside ASCII stands for any
other, since lower case can change its length.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass, replace
from itertools import product

#: A query: alternatives, each a set of trigrams that must all be there. One without trigrams is met by all.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: Strings kept of a part, and alternatives of a query; beyond that, less is asked, never more.
STRINGS, ALTERNATIVES = 32, 64


def least(alternatives: set[frozenset[str]]) -> Query:
    """Without alternatives that ask for all that another asks for."""
    return frozenset(a for a in alternatives if not any(b < a for b in alternatives))


def either(a: Query, b: Query) -> Query:
    found = least({*a, *b})
    return found if len(found) <= ALTERNATIVES else ANY


def both(a: Query, b: Query) -> Query:
    found = least({x | y for x, y in product(a, b)})
    if len(found) <= ALTERNATIVES:
        return found
    return min(a, b, key=lambda q: (len(q), -sum(map(len, q))))


def held(strings: set[str]) -> Query:
    """One of the strings is there."""
    return least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}) or ANY


@dataclass(frozen=True)
class Part:
    """What a part of a pattern matches.

    whole: all strings it can match, or None if they are too many; begins, ends: every match
    begins and ends with one of them (they may be empty); query: what every match holds besides.
    """

    whole: frozenset[str] | None
    begins: frozenset[str]
    ends: frozenset[str]
    query: Query = ANY

    def asked(self) -> Query:
        """All that a match must hold."""
        found = both(self.query, both(held(self.begins), held(self.ends)))
        return found if self.whole is None else both(found, held(self.whole))

    def settled(self) -> Part:
        """Bounded: too many strings are given up, after what they tell is in the query."""
        if self.whole is not None and len(self.whole) > STRINGS:
            query = both(self.query, held(self.whole))
            return Part(None, frozenset(s[:2] for s in self.whole), frozenset(s[-2:] for s in self.whole), query).settled()
        begins, ends, query = self.begins, self.ends, self.query
        if len(begins) > STRINGS:
            query, begins = both(query, held(begins)), frozenset([""])
        if len(ends) > STRINGS:
            query, ends = both(query, held(ends)), frozenset([""])
        return Part(self.whole, begins, ends, query)


def exactly(strings: set[str]) -> Part:
    return Part(frozenset(strings), frozenset(strings), frozenset(strings)).settled()


NOTHING = exactly({""})
UNKNOWN = Part(None, frozenset([""]), frozenset([""]))


def joined(a: Part, b: Part) -> Part:
    """a, then b."""
    pairs = lambda x, y: frozenset(s + t for s, t in product(x, y))
    if a.whole is not None and b.whole is not None:
        return exactly(pairs(a.whole, b.whole)) if a.query == b.query == ANY else replace(exactly(pairs(a.whole, b.whole)), query=both(a.query, b.query)).settled()
    begins = pairs(a.whole, b.begins) if a.whole is not None else a.begins
    ends = pairs(a.ends, b.whole) if b.whole is not None else b.ends
    query = both(both(a.query, b.query), held(pairs(a.ends, b.begins)))
    # what is cut off below stands in the query first
    if a.whole is None:
        query = both(query, held(a.begins))
    if b.whole is None:
        query = both(query, held(b.ends))
    return Part(None, begins, ends, query).settled()


def united(a: Part, b: Part) -> Part:
    """a or b."""
    if a.whole is not None and b.whole is not None and a.query == b.query == ANY:
        return exactly(a.whole | b.whole)
    return Part(None, a.begins | b.begins, a.ends | b.ends, either(a.asked(), b.asked())).settled()


def of_class(items: list) -> Part:
    """A class of characters: known if it is small, or if lower case makes it so."""
    chars: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            chars.add(chr(value))
        elif op is C.RANGE and value[1] - value[0] < STRINGS:
            chars |= {chr(x) for x in range(value[0], value[1] + 1)}
        else:
            return UNKNOWN
    chars = {c.lower() for c in chars}
    return exactly(chars) if all(c.isascii() for c in chars) and len(chars) <= STRINGS else UNKNOWN


def of_item(op, value) -> Part:
    if op is C.LITERAL:
        c = chr(value)
        return exactly({c.lower()}) if c.isascii() else UNKNOWN
    if op is C.IN:
        return of_class(value)
    if op is C.SUBPATTERN:
        return of_pattern(value[-1])
    if op is C.BRANCH:
        found = [of_pattern(x) for x in value[1]]
        out = found[0]
        for part in found[1:]:
            out = united(out, part)
        return out
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = value
        part = of_pattern(inner)
        if high == 1:
            return united(NOTHING, part) if low == 0 else part
        if low == 0:
            return UNKNOWN
        out = part
        for _ in range(min(low, 4) - 1):
            out = joined(out, part)
        if low == high and low <= 4:
            return out
        # more may follow: begins and ends stay, the whole doesn't
        return Part(None, out.begins, out.ends, out.asked()).settled()
    if op is C.ATOMIC_GROUP:
        return of_pattern(value)
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return NOTHING
    return UNKNOWN


def of_pattern(items) -> Part:
    out = NOTHING
    for op, value in items:
        out = joined(out, of_item(op, value))
    return out


def trigram_query(pattern: str) -> list[list[str]]:
    """Alternatives of trigrams: every lower-cased match holds all of one of them. Empty: nothing is known, scan fully."""
    asked = of_pattern(parser.parse(pattern)).asked()
    if frozenset() in asked:
        return []
    return sorted(sorted(a) for a in asked)
