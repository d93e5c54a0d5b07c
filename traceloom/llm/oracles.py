"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from traceloom.llm import chat, queries, secrets

WARC = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k"""

#: Links from counts of shared shingles; each document with the least document that links reach.
NEARDUP = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS g FROM w),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY ALL),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY ALL)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id"""


COLLOCATIONS = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY ALL),
t AS (SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w),
e AS (SELECT lang, w, lead(w, 1) OVER v AS w2, lead(w, 2) OVER v AS w3, lead(w, 3) OVER v AS w4, lead(w, 4) OVER v AS w5 FROM t WINDOW v AS (PARTITION BY piece ORDER BY i)),
g AS (SELECT lang, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3, w || ' ' || w2 || ' ' || w3 || ' ' || w4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5]) AS phrase FROM e),
c AS (SELECT lang, phrase, count(*) AS f FROM g WHERE phrase IS NOT NULL GROUP BY ALL),
k AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS p FROM c WHERE f >= 100 AND contains(phrase, ' ')),
x AS (SELECT *, unnest(range(1, len(p))) AS cut FROM k),
y AS (SELECT x.lang, x.phrase, a, cut, l.f AS l, r.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM x JOIN n ON n.lang = x.lang
  JOIN c l ON l.lang = x.lang AND l.phrase = array_to_string(p[1 : cut], ' ') JOIN c r ON r.lang = x.lang AND r.phrase = array_to_string(p[cut + 1 : len(p)], ' ')),
b AS (SELECT DISTINCT ON (lang, phrase) * FROM y ORDER BY lang, phrase, score, cut),
i AS (SELECT lang, array_to_string(p[s : s + m - 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, p, a, unnest(range(1, len(p) + 1)) AS s FROM k), range(2, 5) t(m) WHERE m < len(p) AND s + m - 1 <= len(p) GROUP BY ALL)
SELECT * FROM (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE most IS NULL OR most < a) WHERE rank <= 2000"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secrets_sql() -> str:
    """Gaps and matches of each kind, summed up to places."""
    parts = ["WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"]
    for n, r in enumerate(secrets.RULES):
        p = quoted(r.pattern)
        parts.append(f"""m{n} AS (SELECT doc_id, unnest(m) AS m, unnest(v) AS v, unnest(p[1:len(m)]) AS p, generate_subscripts(m, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS v, string_split_regex(t, {p}) AS p FROM d WHERE regexp_matches(t, {p})))""")
        parts.append(f"""k{n} AS (SELECT doc_id, {n} AS k, {r.base} AS base, '{r.kind}' AS kind, e - length(m) AS s, e FROM (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM m{n}) WHERE length(v) >= {r.least})""")
    parts.append("a AS (" + " UNION ALL ".join(f"SELECT * FROM k{n}" for n in range(len(secrets.RULES))) + ")")
    told = "kind || ':' || s || ':' || e, ',' ORDER BY s, k"
    parts.append(f"g AS (SELECT doc_id, string_agg({told}) FILTER (base) AS b, string_agg({told}) AS spans, " + ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.RULES if r.base) + " FROM a GROUP BY ALL)")
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.RULES if r.base)
    return ", ".join(parts) + f" SELECT doc_id, {counts}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"


def chat_sql() -> str:
    """Digests straight from the table; the formatted length from the template's and the escapes' lengths."""
    import re

    control = quoted("|".join(map(re.escape, chat.CONTROL)).replace("\\<", "<").replace("\\>", ">").replace("\\/", "/"))
    frame = len(chat.START) + len(chat.END) + 2
    escaped = lambda c: f"length({c}) + length({c}) - length(replace({c}, '\\', '')) + len(regexp_extract_all(replace({c}, '\\', '\\\\'), {control}))"
    trap = quoted(queries.TRAP)
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations UNION ALL VALUES (-7, 0, 'user', {trap}), (-7, 1, 'assistant', {trap})),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x) AS told, coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '') AS loss,
  CAST(sum({frame} + {escaped('r')} + length(r) - length(replace(r, chr(10), '')) + {escaped('x')}) AS BIGINT) AS formatted_chars FROM t GROUP BY ALL)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": WARC, "op6_neardup": NEARDUP, "op8_secrets": secrets_sql(), "op9_chat": chat_sql(), "op13_collocations": COLLOCATIONS}
