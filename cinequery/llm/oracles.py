"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS win
       FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) t(i) WHERE len(ws) > 0),
widths AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS win
       FROM d, widths, unnest(range(1, len(ws) - k + 2)) t(i) WHERE len(ws) >= k),
hit AS (SELECT doc_id, i, k, item FROM dw JOIN bw USING (k, win)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM hit, unnest(range(i, i + k)) u(j) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id),
-- Windows that match on from each other, place by place in both texts, are one match, as long as they are many and one window.
placed AS (SELECT row, i AS j, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS win FROM (SELECT row_number() OVER () AS row, ws, least(len(ws), 10) AS k FROM b WHERE len(ws) > 0), unnest(range(1, len(ws) - k + 2)) t(i)),
met AS (SELECT doc_id, row, k, i, i - j AS diagonal FROM dw JOIN placed USING (k, win)),
runs AS (SELECT doc_id, row, k, diagonal, i - row_number() OVER (PARTITION BY doc_id, row, diagonal ORDER BY i) AS run FROM met),
longest AS (SELECT doc_id, max(n + k - 1) AS longest FROM (SELECT doc_id, row, k, diagonal, run, count(*) AS n FROM runs GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(found.names, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated, CAST(coalesce(longest.longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = lambda n_chars: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"
#: crc32 of ``id``, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(id, ''), lambda c: CAST(ascii(c) AS BIGINT))),
       lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, again: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
OP11 = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, coalesce('=' || lang, '') AS tree, {_LEAF("n_chars")} AS leaf, {_LEAF("(n_chars + 1)")} AS altered, CAST(doc_id AS VARCHAR) AS id FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, {_CRC} % 7 = 0 AS tampered FROM d),
nodes AS (SELECT tree, 0 AS level, pos, leaf AS h FROM p
    UNION ALL SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, max(pos) OVER (PARTITION BY tree) AS most FROM nodes) WHERE most > 0 GROUP BY tree, level, pos // 2),
height AS (SELECT tree, max(level) AS levels FROM nodes GROUP BY tree),
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS tree_pos FROM nodes JOIN height USING (tree) WHERE level = levels),
tops AS (SELECT 0 AS level, tree_pos AS pos, subroot AS h FROM sub
    UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, max(pos) OVER () AS most FROM tops) WHERE most > 0 GROUP BY level, pos // 2),
steps AS (SELECT doc_id, k, pos >> k AS i, tree, false AS upper FROM p JOIN height USING (tree), unnest(range(levels)) t(k)
    UNION ALL SELECT doc_id, 100 + k, tree_pos >> k, tree, true FROM p JOIN sub USING (tree), unnest(range((SELECT max(level) FROM tops))) t(k)),
ways AS (SELECT steps.*, coalesce(n.h, t.h) AS h FROM steps LEFT JOIN nodes n ON NOT upper AND n.tree = steps.tree AND n.level = k AND n.pos = xor(i, 1) LEFT JOIN tops t ON upper AND t.level = k - 100 AND t.pos = xor(i, 1)),
proofs AS (SELECT doc_id, coalesce(string_agg(h, '' ORDER BY k), '') AS proof, list(CASE WHEN h IS NULL THEN '-' WHEN i % 2 = 1 THEN '<' || h ELSE '>' || h END ORDER BY k) AS way FROM ways GROUP BY doc_id),
folded AS (SELECT p.*, subroot, (SELECT h FROM tops ORDER BY level DESC LIMIT 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(CASE WHEN tampered THEN altered ELSE leaf END, coalesce(way, CAST([] AS VARCHAR[]))), lambda acc, s: sha256(CASE s[1] WHEN '<' THEN s[2:] || acc WHEN '>' THEN acc || s[2:] ELSE acc END)) AS folded_root
    FROM p JOIN sub USING (tree) LEFT JOIN proofs USING (doc_id))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

OP13 = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(""" + _LOW.format("coalesce(text, '')") + r""", '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
total AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase, count(*) AS f
      FROM w, (VALUES (1), (2), (3), (4), (5)) widths(k), unnest(range(1, len(ws) - k + 2)) t(i) WHERE len(ws) >= k GROUP BY ALL HAVING count(*) >= 100),
parts AS (SELECT lang, phrase, f AS a, j, array_to_string(list_slice(string_split(phrase, ' '), 1, j), ' ') AS first, array_to_string(list_slice(string_split(phrase, ' '), j + 1, k), ' ') AS rest
         FROM f, unnest(range(1, k)) t(j) WHERE k > 1),
cuts AS (SELECT parts.*, x.f AS l, y.f AS r, n, (CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
         FROM parts JOIN f x ON x.lang = parts.lang AND x.phrase = first JOIN f y ON y.lang = parts.lang AND y.phrase = rest JOIN total ON total.lang = parts.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM lowest p WHERE NOT EXISTS (SELECT 1 FROM f e WHERE e.lang = p.lang AND e.f >= p.a AND e.k > 2 AND e.phrase <> p.phrase AND contains(' ' || e.phrase || ' ', ' ' || p.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op5_decontamination": OP5,
    "op11_merkle_manifest": OP11,
    "op13_collocations": OP13,
}
