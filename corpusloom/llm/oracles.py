"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm import license_scan
from corpusloom.llm.secret_scan import BASE_RULES, RULES


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secret_spans(rank: int) -> str:
    """list of {start, rank, end, kind}: the running sum of piece and match lengths."""
    r = RULES[rank]
    regex = _quoted(r.regex)
    return f"""
    (SELECT coalesce(list({{'s': e - n, 'r': {rank}, 'e': e, 'k': '{r.kind}'}} ORDER BY i) FILTER (part >= {r.min_length}), [])
     FROM (SELECT i, n, part, sum(gap + n) OVER (ORDER BY i) AS e
           FROM (SELECT unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(m, lambda x: length(x))) AS n,
                        unnest(list_transform(p, lambda x: length(x))) AS part,
                        unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap
                 FROM (SELECT regexp_extract_all(t, {regex}) AS m, regexp_extract_all(t, {regex}, {r.group}) AS p, string_split_regex(t, {regex}) AS g))))"""


def secret_scan_sql() -> str:
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    listed = "array_to_string(list_transform({0}, lambda x: x.k || ':' || x.s::BIGINT || ':' || x.e::BIGINT), ',')"
    only = f"list_filter(spans, lambda x: x.k IN ({base}))"
    counts = ", ".join(f"len(list_filter(spans, lambda x: x.k = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in BASE_RULES)
    every = ", ".join(_secret_spans(i) for i in range(len(RULES)))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, list_sort(flatten([{every}])) AS spans FROM d)
SELECT doc_id, {counts}, sha256({listed.format(only)}) AS base_sha256, {listed.format("spans")} AS spans FROM s"""


def license_scan_sql() -> str:
    """Sentences are cut at each line end here, so those wrapped over lines are not found; the
    tables hold none."""
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(license_scan.known().items()))
    free = " ".join(f"WHEN regexp_matches(s, '^{a}( [^ ]+){{1,{license_scan.FREE_WORDS}}} {b}$') THEN '{name}'" if a else f"WHEN regexp_matches(s, '^([^ ]+ ){{1,{license_scan.FREE_WORDS}}}{b}$') AND NOT regexp_matches(s, '^([^ ]+ )*({'|'.join(license_scan.TURNING)}) .*{b}$') THEN '{name}'" for a, b, name in license_scan.open_known())
    cases = []
    steps = "SELECT doc_id, ids, '|' || array_to_string(gapped, '|') || '|' AS l0 FROM i"
    for n, (name, seq) in enumerate(license_scan.RULES):
        steps = f"SELECT *, replace(l{n}, '|{'|'.join(seq)}|', '|') AS l{n + 1} FROM ({steps})"
        cases.append(f"CASE WHEN contains(l{n}, '|{'|'.join(seq)}|') THEN '{name}' END")
    first = ", ".join(f"({n}, '{name}')" for n, name in enumerate(dict.fromkeys(x for x, _ in license_scan.RULES)))
    return f"""
WITH k(s, id) AS (VALUES {known}), o(n, name) AS (VALUES {first}),
d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '\\bv\\.[\\x20\\t]+([0-9])', 'v \\1', 'g') AS t, row_number() OVER () AS rn FROM documents),
p AS (SELECT rn, generate_subscripts(x, 1) AS pos, unnest(x) AS s FROM
      (SELECT rn, list_filter(list_transform(string_split_regex(t, '[\\n\\r]+|[.!?;][\\x20\\t]+'), lambda y: trim(regexp_replace(y, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), lambda y: y <> '') AS x FROM d)),
h AS (SELECT rn, pos, id, coalesce(pos - lag(pos) OVER (PARTITION BY rn ORDER BY pos) > {license_scan.GAP + 1}, false) AS far FROM (SELECT rn, pos, coalesce(k.id, CASE {free} END) AS id FROM p LEFT JOIN k USING (s)) WHERE id IS NOT NULL),
m AS (SELECT rn, list(id ORDER BY pos) AS ids, flatten(list(CASE WHEN far THEN ['-', id] ELSE [id] END ORDER BY pos)) AS gapped FROM h GROUP BY rn),
i AS (SELECT doc_id, coalesce(ids, []) AS ids, coalesce(gapped, []) AS gapped FROM d LEFT JOIN m USING (rn)),
r AS ({steps}),
f AS (SELECT doc_id, ids, list_filter([{", ".join(cases)}], lambda x: x IS NOT NULL) AS found FROM r)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       coalesce((SELECT string_agg(name, ',' ORDER BY n) FROM o WHERE list_contains(found, name) AND (name <> 'Proprietary' OR len(list_filter(found, lambda x: x <> 'Proprietary')) = 0)), '') AS licenses
FROM f"""


def chat_format_sql() -> str:
    marks = lambda x, chars: f"(length({x}) + length(regexp_replace({x}, '[^{chars}]', '', 'g')))"
    return f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + {marks("role", "\\\\#<:")} + 2 + {marks("text", "\\\\#<")} + 8)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""


def merkle_sql(levels: int = 7) -> str:
    """Both trees level by level: while a tree has several nodes, its runs of 16 become one. The
    steps of a row's proof are its run's other digests, level by level."""
    field = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(x) for x in ('doc_id', 'source', 'lang', 'n_chars'))} || {field(text)})"
    # CRC-32 by its definition, bit by bit: the steps of a byte are a fold over 8 places
    bit = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {bit}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"""d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, leaf) AS rid, * FROM (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS tampered FROM documents)),
k AS (SELECT rid, (row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1)::BIGINT AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, leaf, coalesce(tampered, leaf) AS t FROM d),
n0 AS MATERIALIZED (SELECT tree, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM k),
p0 AS (SELECT rid, tree, pos, ''::VARCHAR AS proof, t FROM k)"""
    ]

    def level(i: int) -> str:
        """Nodes n{i} to n{i+1}, and rows' proofs and folded digests along."""
        return f"""n{i + 1} AS MATERIALIZED (SELECT tree, r AS pos, h, count(*) OVER (PARTITION BY tree) AS n FROM
  (SELECT tree, CASE WHEN n > 1 THEN pos // 16 ELSE pos END AS r, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM n{i} GROUP BY tree, r)),
g{i} AS MATERIALIZED (SELECT tree, pos // 16 AS r, list(h ORDER BY pos) AS hs FROM n{i} WHERE n > 1 GROUP BY ALL),
p{i + 1} AS MATERIALIZED (SELECT rid, p{i}.tree, CASE WHEN hs IS NULL THEN pos ELSE pos // 16 END AS pos,
  CASE WHEN hs IS NULL THEN proof ELSE proof || array_to_string(hs[1:pos % 16], '') || array_to_string(hs[pos % 16 + 2:], '') END AS proof,
  CASE WHEN hs IS NULL THEN t ELSE sha256(array_to_string(hs[1:pos % 16], '') || t || array_to_string(hs[pos % 16 + 2:], '')) END AS t
  FROM p{i} LEFT JOIN g{i} ON p{i}.tree = g{i}.tree AND p{i}.pos // 16 = g{i}.r)"""

    steps += [level(i) for i in range(levels)]
    last = 2 * levels + 1
    steps.append(f"""s AS (SELECT tree AS src, h AS subroot FROM n{levels}),
n{levels + 1} AS MATERIALIZED (SELECT 0 AS tree, src AS pos, subroot AS h, count(*) OVER () AS n FROM s),
p{levels + 1} AS (SELECT rid, 0 AS tree, tree AS pos, proof, t FROM p{levels})""")
    steps += [level(i) for i in range(levels + 1, last)]
    return f"""
WITH {", ".join(steps)}
SELECT d.doc_id, d.leaf, s.subroot, (SELECT h FROM n{last}) AS root, sha256(proof) AS proof_sha256, p{last}.t AS folded_root, p{last}.t = (SELECT h FROM n{last}) AS verified
FROM d JOIN k USING (rid) JOIN s ON s.src = k.tree JOIN p{last} USING (rid)"""
