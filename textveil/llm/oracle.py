"""DuckDB SQL of the conversation, spelling and passage queries, each written in another way than the operator."""

from __future__ import annotations

SPACES = r"[\x20\x09-\x0D]"
_BYTES = "list_transform(range(0, length(hex(encode({0}))) // 2), lambda nth: ('0x' || substr(hex(encode({0})), 2 * nth + 1, 2))::BIGINT)"


def crc32(text: str) -> str:
    """The unsigned crc32 of a string's UTF-8: each byte, then eight halvings (marked -1)."""
    steps = f"flatten(list_transform({_BYTES.format(text)}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    halved = "CASE WHEN step >= 0 THEN xor(c, step) ELSE xor(c >> 1, 3988292384 * (c & 1)) END"
    return f"xor(list_reduce({steps}, lambda c, step: {halved}, 4294967295::BIGINT), 4294967295)"


def _more(best: str, cost: int | str, letter: str) -> str:
    """A cost of twelve digits with an audit behind it, one edit later."""
    return f"lpad((substr({best}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({best}, 13) || '{letter}'"


_NEXT = {
    "s0": _more("s0", 4, "D"),
    "s1": f"least({_more('s1', 4, 'D')}, CASE WHEN initial = 's' AND NOT gone THEN {_more('s0', 'late', 'K')} END)",
    "u": f"""least({_more('u', 4, 'D')}, CASE WHEN NOT gone THEN least({', '.join(_more(q, '3 + late', 'R') for q in ('s0', 's1', 'a'))}) END,
        CASE WHEN initial = 'u' AND NOT gone THEN least({', '.join(_more(q, 'late', 'K') for q in ('s0', 's1', 'a'))}) END)""",
    "a": f"least({_more('a', 4, 'D')}, CASE WHEN NOT gone THEN {_more('u', '3 + late', 'R')} END, CASE WHEN initial = 'a' AND NOT gone THEN {_more('u', 'late', 'K')} END)",
}
#: Rows may be inserted at a place: a user's after anything but a user's, an assistant's after a user's.
_INSERTED = f"SELECT * REPLACE (least(a, {_more('u', 3, 'I')}) AS a) FROM (SELECT * REPLACE (least(u, {_more('s0', 3, 'I')}, {_more('s1', 3, 'I')}, {_more('a', 3, 'I')}) AS u) FROM {{}})"
_NONE = "'100000000000'"

CONVERSATIONS = rf"""
    WITH RECURSIVE hurt AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("k")} % 20 AS harm
        FROM (SELECT *, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations)
    ), damaged AS (
        SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, conv_id, turn, harm = 0 AS dropped, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
               CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN harm = 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM hurt
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, left(role, 40), left(text, 40), md5(concat(role, chr(0), text))) AS i,
               regexp_replace(text, '{SPACES}+$', '') AS rest FROM damaged WHERE NOT dropped
    ), told AS (
        SELECT *, rest = '' AS blank, rest <> '' AND row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 AS duplicate, left(role, 1) AS initial FROM placed
    ), faulty AS (
        SELECT *, NOT blank AND NOT duplicate AND right(rest, 1) NOT IN ('.', '!', '?') AS truncated, blank OR duplicate AS gone FROM told
    ), best AS (
        SELECT cid, 1 AS i, '000000000000' AS s0, {_NONE} AS s1, {_NONE} AS u, {_NONE} AS a FROM (SELECT DISTINCT cid FROM faulty)
        UNION ALL
        SELECT cid, i + 1, {_NEXT['s0']}, {_NEXT['s1']}, {_NEXT['u']}, {_NEXT['a']}
        FROM ({_INSERTED.format("best")}) JOIN (SELECT cid, i, initial, gone, CASE WHEN truncated THEN 3 ELSE 0 END AS late FROM faulty) USING (cid, i)
    ), total AS (
        SELECT cid, least(s0, a) AS won FROM ({_INSERTED.format("(SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY cid ORDER BY i DESC) = 1)")})
    ), letters AS (
        SELECT cid, unnest(string_split(substr(won, 13), '')) AS letter, generate_subscripts(string_split(substr(won, 13), ''), 1) AS j FROM total WHERE length(won) > 12
    ), met AS (
        SELECT l.*, r.role, r.text, count(*) FILTER (letter <> 'D') OVER (PARTITION BY l.cid ORDER BY j) AS o
        FROM (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY cid ORDER BY j) AS i FROM letters) l LEFT JOIN faulty r ON r.cid = l.cid AND r.i = l.i AND letter <> 'I'
    ), kept AS (
        SELECT *, o - max(CASE WHEN o = 1 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY cid) AS p FROM met WHERE letter <> 'D'
    ), spelled AS (
        SELECT cid, sha256(string_agg(concat(CASE WHEN letter = 'K' THEN role WHEN p % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', coalesce(text, '')), chr(10) ORDER BY j)) AS sha FROM kept GROUP BY cid
    ), counted AS (
        SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
               count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM (SELECT *, lag(initial) OVER (PARTITION BY cid ORDER BY i) || initial AS pair FROM faulty) GROUP BY cid
    )
    SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(substr(won, 1, 12)::BIGINT, 0) AS cost, coalesce(substr(won, 13), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT cid, conv_id FROM damaged) LEFT JOIN counted USING (cid) LEFT JOIN total USING (cid) LEFT JOIN spelled USING (cid)"""

_WITHOUT = "SELECT word, n, length(word) AS size, k, substr(word, 1, k - 1) || substr(word, k + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM vocabulary)"
SPELLING = rf"""
    WITH RECURSIVE found AS (
        SELECT doc_id, run, count(*) AS n FROM (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY doc_id, run
    ), hashed AS MATERIALIZED (SELECT run, n, {crc32("keyed")} AS h FROM (SELECT *, concat(coalesce(doc_id::VARCHAR, ''), ':', run) AS keyed FROM found)
    ), vocabulary AS MATERIALIZED (
        SELECT word, sum(n)::BIGINT AS n FROM (
            SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM hashed)
        WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
    ), without AS MATERIALIZED ({_WITHOUT}
    ), pairs AS MATERIALIZED (
        SELECT a.word, b.word AS other, b.n FROM without a JOIN without b ON a.less = b.less AND a.k = b.k AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM without a JOIN vocabulary b ON a.less = b.word
        UNION SELECT b.word, a.word, a.n FROM without a JOIN vocabulary b ON a.less = b.word
    ), best AS (
        SELECT word, count(*) AS n_near, max(n) AS top, min(other) FILTER (n = best_n) AS other FROM (SELECT *, max(n) OVER (PARTITION BY word) AS best_n FROM pairs) GROUP BY word
    ), picked AS MATERIALIZED (
        SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN other END AS form, CASE WHEN top >= 5 * v.n THEN top END AS form_n FROM vocabulary v LEFT JOIN best USING (word)
    ), chain AS (
        SELECT word, word AS root, 0 AS steps FROM picked
        UNION ALL SELECT chain.word, picked.form, steps + 1 FROM chain JOIN picked ON chain.root = picked.word WHERE picked.form IS NOT NULL
    )
    SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM picked JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) USING (word)"""

PASSAGES = rf"""
    WITH d AS (
        SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{SPACES}+'), lambda w: w <> '') AS words FROM documents
    ), win AS (
        SELECT row, doc_id, p, md5(array_to_string(words[p : p + 49], ' ')) AS w FROM (SELECT *, unnest(range(1, len(words) - 48)) AS p FROM d WHERE len(words) >= 50)
    ), again AS (
        SELECT row, p FROM (SELECT row, p, doc_id, min(doc_id) OVER (PARTITION BY w) AS first FROM win) WHERE first < doc_id
    ), gone AS (SELECT DISTINCT row, p + k AS p FROM again, range(0, 50) AS r(k)
    ), kept AS (
        SELECT row, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n FROM (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d) ANTI JOIN gone USING (row, p) GROUP BY row
    )
    SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (row)"""
