"""Secrets in texts that take patterns long: the same spans as the common pattern gives, in time that grows with the text."""

import random
import re
import time

from traceloom.llm import secrets

DOCS = "doc_id long, text string"


def plain(rule, text):
    return [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]


def test_web_tokens_equal_the_common_pattern(spark):
    rule = next(r for r in secrets.RULES if r.kind == "web_token")
    rng = random.Random(6)
    pieces = ["eyJ", "eyJ", ".", ".eyJ", "a", "Zz9", "_-", " ", "\n", "é", "x" * 30, "eyJ" + "b" * 20]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(600)]
    texts += ["eyJa.eyJb." + "c" * 40, "pre-eyJa.eyJb." + "c" * 40, "eyJ.eyJa.eyJb." + "c" * 40, "eyJa.eyJb." + "c" * 40 + ".eyJd.eyJe." + "f" * 40]
    short = secrets.Rule("web_token", rule.pattern, 0, 9, base=False, java=rule.java, lead=rule.lead)
    for r in (rule, short):
        got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), DOCS), (r,)).collect()
        assert {x.doc_id: [tuple(s) for s in x.spans_web_token] for x in got} == {i: plain(r, t) for i, t in enumerate(texts)}


UNITS = ["eyJ", "eyJ.", "eyJa.eyJ", "token ", "AKIA", "deadbee ", "-----BEGIN A", "ghp_", "password: '"]


def test_a_million_characters(spark):
    """Each text of a million characters, and a short one whose spans are known."""
    make = lambda n: spark.createDataFrame([(i, u * (n // len(u))) for i, u in enumerate(UNITS)], DOCS).repartition(len(UNITS))
    began = time.time()
    long = {r.doc_id: r for r in secrets.scan(make(1_000_000)).collect()}
    assert time.time() - began < 120
    for r in secrets.scan(make(20_000)).collect():
        for rule in secrets.RULES:
            assert [tuple(s) for s in r[f"spans_{rule.kind}"]] == plain(rule, r.text)
            assert bool(long[r.doc_id][f"spans_{rule.kind}"]) == bool(r[f"spans_{rule.kind}"])


def plain_redacted(text, mark="[secret]"):
    spans = sorted(s for rule in secrets.RULES for s in plain(rule, text))
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_redacted_texts_equal_plain_ones(spark):
    rng = random.Random(8)
    pieces = ["password: '", "token=", "AKIA" + "Z" * 14, "deadbeef" * 5, " ", "é", "\n", "x", "eyJa.eyJb." + "c" * 40, "ghp_" + "q" * 40, "api_key: " + "0a" * 20]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 300))) for _ in range(60)] + [None, ""]
    got = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {i: t if t is None else plain_redacted(t) for i, t in enumerate(texts)}


def test_a_million_characters_of_secrets_are_redacted(spark):
    text = ("password: '" + "p" * 9 + " é ") * 40_000
    began = time.time()
    (row,) = secrets.redact(spark.createDataFrame([(1, text)], DOCS)).collect()
    assert row.text == "[secret] é " * 40_000 and time.time() - began < 60
