"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), shown AS (
  SELECT *, CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN role ELSE concat('=', hex(encode(role))) END AS name,
    regexp_matches(text, '\\(?s:.)') AS doubled
  FROM given
), sized AS (
  SELECT *, length(name) + 14 + length(text)
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda x: length(x) - 2)), 0)
    + len(regexp_extract_all(text, '</turn>'))
    + CASE WHEN doubled THEN length(text) - length(replace(text, '\', '')) ELSE 0 END AS chars
  FROM shown
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  true AS round_trip
FROM sized GROUP BY conv_id
"""

OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(**changed: str) -> str:
    texts = [changed.get(c, f"CAST({c} AS VARCHAR)") for c in _FIELDS]
    return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({x}), ':', {x}), '-')" for x in texts) + "))"


def _crc(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of ``text``, bit by bit."""
    return f"""xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT),
  lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[],
    lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295)"""


#: A tree's levels as lists, for each group ``g``; a node's siblings and its way up, step by step.
_UP = """
  UNION ALL
  SELECT g, h + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(concat(nodes[i + 1], nodes[i + 2]))) FROM {levels} WHERE len(nodes) > 1
"""
OP11 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf()} AS leaf,
    CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf(n_chars="CAST(n_chars::HUGEINT + 1 AS VARCHAR)")} END AS claimed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), levels(g, h, nodes) AS (
  SELECT g, 0, list(leaf ORDER BY pos) FROM placed GROUP BY g
  {_UP.format(levels="levels")}
), subroots AS (
  SELECT g, nodes[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM levels WHERE len(nodes) = 1
), tops(g, h, nodes) AS (
  SELECT '', 0, list(subroot ORDER BY pos) FROM subroots
  {_UP.format(levels="tops")}
), sides AS (
  SELECT p.doc_id, p.g, p.pos, l.h, (p.pos >> l.h) & 1 AS right_one, l.nodes[xor(p.pos >> l.h, 1) + 1] AS sibling
  FROM placed p JOIN levels l ON l.g = p.g WHERE len(l.nodes) > 1
  UNION ALL
  SELECT p.doc_id, p.g, p.pos, 1000 + t.h, (s.pos >> t.h) & 1, t.nodes[xor(s.pos >> t.h, 1) + 1]
  FROM placed p JOIN subroots s ON s.g = p.g CROSS JOIN tops t WHERE len(t.nodes) > 1
), ways AS (
  SELECT g, pos, list(concat(CASE WHEN sibling IS NULL THEN '-' WHEN right_one = 1 THEN 'l' ELSE 'r' END, sibling) ORDER BY h) AS way
  FROM sides GROUP BY g, pos
), joined AS (
  SELECT p.*, s.subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root, coalesce(w.way, []) AS way
  FROM placed p JOIN subroots s ON s.g = p.g LEFT JOIN ways w ON w.g = p.g AND w.pos = p.pos
), folded AS (
  SELECT *, list_reduce(way, lambda x, s: CASE s[1] WHEN '-' THEN sha256(x) WHEN 'l' THEN sha256(concat(s[2:], x)) ELSE sha256(concat(x, s[2:])) END,
    coalesce(claimed, leaf)) AS folded_root
  FROM joined
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda s: s[2:]), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folded
"""

OP12 = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), hashed AS (
  SELECT run, length(run) AS size, {_crc("concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run)")} AS h FROM runs WHERE length(run) >= 6
), words AS (
  SELECT word, count(*) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN concat(run[1:h % size], run[h % size + 2:]) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5
), holes AS (
  SELECT word, n, i, concat(word[1:i], word[i + 2:]) AS rest FROM words, unnest(range(0, length(word))) AS t(i)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chains AS (
  SELECT word, word AS root FROM forms
  UNION SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chains c ON c.word = f.word JOIN forms r ON r.word = c.root WHERE r.form IS NULL
"""

ORACLE: dict[str, str] = {
    "op1_chat_formatting": OP1,
    "op8_exact_top_k": OP8,
    "op11_merkle_manifest": OP11,
    "op12_spelling_variants": OP12,
}
