"""DuckDB SQL of the corpus operators that SQL can express: secret scans, the manifest and collocations."""

from __future__ import annotations

from . import collocations, secrets
from .manifest import FANOUT


def _secrets() -> str:
    q = lambda s: s.replace("'", "''")
    found = " UNION ALL ".join(
        f"""SELECT row, doc_id, owner, repository, {i} AS kind, {k.least} AS least, m[j] AS match, regexp_extract(m[j], '{q(k.pattern)}', {k.group}) AS value,
        coalesce(list_sum(g[1:j]), 0) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS pos
        FROM (SELECT row, doc_id, owner, repository, m, g, unnest(range(1, len(m) + 1)) AS j
            FROM (SELECT row, doc_id, owner, repository, regexp_extract_all(text, '{q(k.pattern)}', 0) AS m, list_transform(string_split_regex(text, '{q(k.pattern)}'), lambda x: length(x)) AS g FROM docs))"""
        for i, k in enumerate(secrets.KINDS)
    )
    names = "[" + ", ".join(f"'{k.name}'" for k in secrets.KINDS) + "]"
    base = sum(k.base for k in secrets.KINDS)
    said = f"({names})[kind + 1] || ':' || pos || ':' || (pos + length(match))"
    return f"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, chr(0)) AS owner, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS text FROM documents),
    found AS ({found}),
    counted AS (SELECT *, list_transform(list_distinct(string_split(value, '')), lambda c: struct_pack(c := c, p := (length(value) - length(replace(value, c, ''))) / length(value)::DOUBLE)) AS chars
        FROM found WHERE length(value) >= least AND (kind < {len(secrets.KINDS) - 1} OR regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]'))),
    looked AS (SELECT *, regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(lower(value), '{secrets.PLACEHOLDERS}') AND len(list_filter(chars, lambda x: contains(value, repeat(x.c, 6)))) = 0
        AND -list_sum(list_transform(chars, lambda x: x.p * log2(x.p))) >= CASE WHEN regexp_matches(value, '^[0-9a-f]+$') THEN {secrets.HEX_BITS} ELSE {secrets.ANY_BITS} END AS random FROM counted),
    owned AS (SELECT value, count(DISTINCT owner) AS owners FROM looked GROUP BY value),
    judged AS (SELECT l.*, owners, CASE WHEN owners >= {secrets.COPIED} THEN 'example' WHEN NOT random THEN 'plain' WHEN owners = 1 THEN 'live' ELSE 'shared' END AS verdict FROM looked l JOIN owned USING (value)),
    kept AS (SELECT * FROM judged WHERE kind < {base} OR verdict = 'live')
    SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k.name}" for i, k in enumerate(secrets.KINDS) if k.base)},
        sha256(coalesce(string_agg({said}, ',' ORDER BY pos, kind) FILTER (kind < {base}), '')) AS base_sha256, coalesce(string_agg({said}, ',' ORDER BY pos, kind), '') AS spans,
        coalesce(string_agg(verdict, ',' ORDER BY pos, kind), '') AS verdicts, coalesce(string_agg(owners::VARCHAR, ',' ORDER BY pos, kind), '') AS owners
    FROM docs d LEFT JOIN kept k USING (row) GROUP BY d.row, d.doc_id"""


def _manifest() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    up = lambda name, ground: f"""{name} AS ({ground} UNION ALL
        SELECT tree, level + 1, place // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(digest, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY tree, level, place // {FANOUT}, n)"""  # noqa: E731
    sides = lambda name: f"""{name}_sides AS (SELECT a.tree, a.level, a.place, a.n, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS low, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS high
        FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.place // {FANOUT} = b.place // {FANOUT} WHERE a.n > 1 GROUP BY ALL)"""  # noqa: E731
    # Folds a row's digest and its proof up a tree, from the lowest level.
    fold = lambda name, tree, ground: f"""{name} AS ({ground} UNION ALL
        SELECT f.row, f.tree, f.level + 1, f.place // {FANOUT}, sha256(s.low || f.cur || s.high), f.proof || s.low || s.high FROM {name} f JOIN {tree}_sides s ON f.tree = s.tree AND f.level = s.level AND f.place = s.place)"""  # noqa: E731
    return f"""WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
    leaves AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS row, *,
        xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 2 = 0 AS changed
        FROM (SELECT coalesce('s' || source, 'n') AS tree, source, doc_id, {leaf("text")} AS leaf, {leaf("replace(text, chr(10), '')")} AS other FROM documents), crc_table),
    ground AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY row) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
    {up("nodes", "SELECT tree, 0 AS level, place, n, leaf AS digest FROM ground")},
    tops AS (SELECT '' AS tree, 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n, digest, tree AS source FROM nodes WHERE n = 1),
    {up("high", "SELECT tree, level, place, n, digest FROM tops")},
    {sides("nodes")}, {sides("high")},
    {fold("folds", "nodes", "SELECT row, tree, 0 AS level, place, CASE WHEN changed THEN other ELSE leaf END AS cur, '' AS proof FROM ground")},
    subs AS (SELECT row, arg_max(cur, level) AS cur, arg_max(proof, level) AS proof FROM folds GROUP BY row),
    {fold("ends", "high", "SELECT g.row, '' AS tree, 0 AS level, t.place, s.cur, s.proof FROM ground g JOIN subs s USING (row) JOIN tops t ON g.tree = t.source")},
    done AS (SELECT row, arg_max(cur, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM ends GROUP BY row)
    SELECT g.doc_id, g.leaf, t.digest AS subroot, r.digest AS root, d.proof_sha256, d.folded_root, d.folded_root = r.digest AS verified
    FROM ground g JOIN tops t ON g.tree = t.source JOIN done d USING (row), (SELECT digest FROM high WHERE n = 1) r"""


def _collocations() -> str:
    c = collocations
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, {joined} AS phrase, count(*) AS a FROM rows WHERE w{k} IS NOT NULL GROUP BY ALL" for k in range(1, c.LONGEST + 1) for joined in [" || ' ' || ".join(f"w{x}" for x in range(1, k + 1))])
    return f"""WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS p FROM docs)),
    words AS MATERIALIZED (SELECT lang, p, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM (SELECT lang, row_number() OVER () AS p, w FROM pieces)),
    rows AS MATERIALIZED (SELECT lang, {", ".join(f"lead(w1, {k}) OVER (PARTITION BY p ORDER BY i) AS w{k + 1}" for k in range(1, c.LONGEST))}, w1 FROM words),
    f AS MATERIALIZED ({grams}),
    n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    phrases AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= {c.LEAST}),
    cuts AS (SELECT p.lang, p.k, p.phrase, p.a, i, l.a AS l, r.a AS r, ((2000000::HUGEINT * p.a) // (l.a::HUGEINT + r.a))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, k)) AS i FROM phrases) p JOIN f l ON l.lang = p.lang AND l.phrase = array_to_string(p.w[1:i], ' ') AND l.k = i JOIN f r ON r.lang = p.lang AND r.phrase = array_to_string(p.w[i + 1:], ' ') AND r.k = p.k - i),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
    kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM phrases q WHERE q.lang = b.lang AND q.k > b.k AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ') AND 100::HUGEINT * q.a >= {c.COVER} * b.a::HUGEINT))
    SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= {c.BEST}"""


ORACLE: dict[str, str] = {"op11_secret_scan": _secrets(), "op12_merkle_manifest": _manifest(), "op13_collocations": _collocations()}
