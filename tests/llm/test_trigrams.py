"""Trigram queries derived from random patterns: no match may miss them."""

import random
import re
import re._constants as C
import re._parser as parser

import pytest

from traceloom.llm import secrets
from traceloom.llm.trigrams import trigram_query


def pattern(rng, depth):
    k = rng.random()
    if depth == 0 or k < 0.35:
        return "".join(rng.choice("abcABC_1") for _ in range(rng.randint(1, 4)))
    if k < 0.5:
        return f"({pattern(rng, depth - 1)}|{pattern(rng, depth - 1)})"
    if k < 0.65:
        return f"(?:{pattern(rng, depth - 1)})" + rng.choice(["*", "+", "?", "{2}", "{1,3}", "{2,}", "*?"])
    if k < 0.75:
        return rng.choice(["[abc]", "[a-f]", "[^a]", ".", "[A-C_]", r"\w", "É", "(?i:Ab)"])
    return pattern(rng, depth - 1) + pattern(rng, depth - 1)


def match(rng, items):
    """A random string that the parsed pattern matches."""
    out = ""
    for op, v in items:
        if op is C.LITERAL:
            out += chr(v)
        elif op is C.NOT_LITERAL or op is C.ANY:
            out += "z"
        elif op is C.IN:
            kind, x = v[0]
            out += "q" if kind in (C.NEGATE, C.CATEGORY) else rng.choice([chr(y) for o, y in v if o is C.LITERAL]) if kind is C.LITERAL else chr(rng.randint(*x))
        elif op is C.SUBPATTERN:
            out += match(rng, v[-1])
        elif op is C.BRANCH:
            out += match(rng, rng.choice(v[1]))
        else:
            for _ in range(rng.randint(v[0], min(v[1], v[0] + 3))):
                out += match(rng, v[2])
    return out


def test_no_match_misses_its_query():
    rng, asked = random.Random(1), 0
    for _ in range(3000):
        p = pattern(rng, 4)
        query = trigram_query(p)
        asked += bool(query)
        for _ in range(4):
            text = match(rng, parser.parse(p))
            assert re.fullmatch(p, text)
            assert not query or any(all(t in text.lower() for t in a) for a in query), (p, text, query)
    assert asked > 1000


@pytest.mark.parametrize("given", [("assign", ["password", "passwd", "secret", "token", "api_key", "apikey"]), ("access", ["akia"]), ("repo_token", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]), ("web_token", [".eyj"])])
def test_queries_of_the_rules(given):
    rule = next(r for r in secrets.RULES if r.kind == given[0])
    want = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in given[1]}
    assert {frozenset(a) for a in trigram_query(rule.pattern)} == want


def test_a_rule_without_mandatory_trigrams_scans_fully():
    assert trigram_query(r"[0-9a-f]+") == [] and trigram_query("a.b") == [] and trigram_query("(abc)?") == []
