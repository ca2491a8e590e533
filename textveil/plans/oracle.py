"""The same queries in DuckDB's SQL, relationally where the Spark side uses array columns."""

from __future__ import annotations

from textveil.functions.labels import FOREIGN, TAG_IDS, TAGS
from textveil.functions.patterns import FAX_WINDOW, FAX_WORD, PATTERNS
from textveil.operators.restore import BETWEEN, DRY_RUN
from textveil.plans.queries import DAYS, FAILING, SECRET, VOCABULARY_WORDS
from textveil.sources import synthetic
from textveil.sources import text as texts
from textveil.sources.notes import SURNAMES, gold_sql, text_sql


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


DOCUMENTS = "src AS (SELECT doc_id, text, lang, source FROM documents)"
PAGES = "src AS (SELECT page_id AS doc_id, html AS text FROM pages)"
_GOLD = gold_sql("[{}]", "{{'s': {s}, 'e': {e}, 'label': {label}}}")
_RENDERED = f"""SELECT o_orderkey AS doc_id, {text_sql()} AS text, n_name AS source, {_GOLD} AS gold
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
NOTES = f"src AS MATERIALIZED ({_RENDERED})"


def matched(pattern: str, table: str = "src", text: str = "text") -> str:
    """doc_id, s, m of a pattern's matches: places are the summed lengths of what lies before."""
    return f"""SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda i:
            coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS s,
        unnest(ms) AS m FROM (SELECT doc_id, regexp_extract_all({text}, {lit(pattern)}) AS ms, regexp_split_to_array({text}, {lit(pattern)}) AS gs
            FROM {table} WHERE regexp_matches({text}, {lit(pattern)}))"""


def candidates(name: str, wanted: set[str] | None = None, table: str = "src", text: str = "text") -> str:
    parts = []
    for prio, p in enumerate(PATTERNS, 1):
        if wanted is not None and p.label not in wanted:
            continue
        start, label = "s", lit(p.label)
        if p.label == "AGE":
            start = r"s + length(m) - length(regexp_extract(m, '\d+'))"
        rows = matched(p.ascii, table, text)
        if p.label == "PHONE_OR_FAX":
            before = f"substr({text}, greatest(0, s - {FAX_WINDOW}) + 1, least({FAX_WINDOW}, s))"
            parts.append(f"SELECT x.doc_id, {prio} AS prio, s, s + length(m) AS e, CASE WHEN regexp_matches({before}, {lit('(?i)' + FAX_WORD)}) THEN 'FAX' ELSE 'PHONE' END AS label FROM ({rows}) x JOIN {table} USING (doc_id)")
        else:
            parts.append(f"SELECT doc_id, {prio} AS prio, {start} AS s, s + length(m) AS e, {label} AS label FROM ({rows})")
    return f"{name} AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


def greedy(name: str, found: str) -> str:
    """Rows of found that win, in order of prio and s."""
    return f"""{name} AS MATERIALIZED (SELECT doc_id, w.s AS s, w.e AS e, w.label AS label FROM (SELECT doc_id, unnest(list_reduce(
        list({{'s': s, 'e': e, 'label': label}} ORDER BY prio, s, e), lambda won, c:
            CASE WHEN len(list_filter(won, lambda w: w.s < c.e AND c.s < w.e)) > 0 THEN won ELSE list_append(won, c) END,
        []::STRUCT(s BIGINT, e BIGINT, label VARCHAR)[])) AS w FROM {found} GROUP BY doc_id))"""


DETECT = f"{candidates('cand')}, {greedy('won', 'cand')}"
PART = "substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT))"
GOLD = "gold AS (SELECT doc_id, g.s::BIGINT AS s, g.e::BIGINT AS e, g.label AS label, ordinal FROM (SELECT doc_id, unnest(gold) AS g, generate_subscripts(gold, 1) AS ordinal FROM src WHERE gold IS NOT NULL))"


def parsed(o: str) -> str:
    year = f"CAST(right({o}, 2) AS INT)"
    full = f"concat(left({o}, length({o}) - 2), CASE WHEN {year} <= 68 THEN '20' ELSE '19' END, right({o}, 2))"
    return f"""CASE WHEN regexp_full_match({o}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN try_strptime({o}, '%m/%d/%Y')::DATE
        WHEN regexp_full_match({o}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2}}') THEN try_strptime({full}, '%m/%d/%Y')::DATE
        WHEN regexp_full_match({o}, '[A-Z][a-z]+\\s+\\d{{1,2}},\\s+\\d{{4}}') THEN try_strptime(regexp_replace({o}, '\\s+', ' ', 'g'), '%B %d, %Y')::DATE END"""


def shifted(o: str, days: str) -> str:
    moved = f"({parsed(o)} + CAST({days} AS INT))"
    return f"""CASE WHEN regexp_matches({o}, '/\\d{{4}}$') THEN strftime({moved}, '%m/%d/%Y') WHEN {o} LIKE '%/%' THEN strftime({moved}, '%m/%d/%y') ELSE strftime({moved}, '%B %d, %Y') END"""


_KEYED = f"(('0x' || left(sha256({lit(SECRET)} || CAST(doc_id AS VARCHAR)), 8))::BIGINT % 361 - 180)"
KEYED = f"CASE WHEN {_KEYED} = 0 THEN 1 ELSE {_KEYED} END"


def items(name: str = "items", won: str = "won", text: str = "text", table: str = "src") -> str:
    """doc_id, s, e, label, o, m, mapped: masks of the first pass."""
    return f"""{name}_raw AS (SELECT doc_id, s, e, label, substr({text}, s + 1, e - s) AS o FROM {won} JOIN {table} USING (doc_id)),
    {name}_fixed AS (SELECT *, CASE WHEN label = 'AGE' THEN '90+' WHEN label = 'DATE' THEN {shifted('o', str(DAYS))} END AS f FROM {name}_raw),
    {name}_keys AS (SELECT doc_id, label, lower(o) AS k, row_number() OVER (PARTITION BY doc_id, label ORDER BY min(s)) AS n FROM {name}_fixed WHERE f IS NULL GROUP BY doc_id, label, lower(o)),
    {name} AS MATERIALIZED (SELECT x.doc_id, s, e, x.label, o, coalesce(f, concat('[', x.label, '_', n, ']')) AS m, x.label <> 'AGE' AS mapped
        FROM {name}_fixed x LEFT JOIN {name}_keys y ON x.doc_id = y.doc_id AND x.label = y.label AND lower(x.o) = y.k AND f IS NULL)"""


def splice(name: str, found: str, text: str = "text", table: str = "src") -> str:
    """doc_id and masked of every row of table."""
    return f"""{name} AS MATERIALIZED (SELECT d.doc_id, coalesce(head || substr(d.{text}, CAST(last + 1 AS BIGINT)), d.{text}, '') AS masked FROM {table} d LEFT JOIN (
        SELECT doc_id, string_agg(substr({text}, CAST(p + 1 AS BIGINT), CAST(s - p AS BIGINT)) || m, '' ORDER BY s) AS head, max(e) AS last
        FROM (SELECT i.*, {text}, coalesce(lag(e) OVER (PARTITION BY i.doc_id ORDER BY s), 0) AS p FROM {found} i JOIN {table} USING (doc_id)) GROUP BY doc_id) USING (doc_id))"""


MASK = f"{DETECT}, {items()}, {splice('masks', 'items')}"
MAPPING = """mapping AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(s)) - 1 AS ordinal, m AS masked, arg_max(o, s) AS original
    FROM items WHERE mapped GROUP BY doc_id, m)"""
ANSWER = r"""answers AS MATERIALIZED (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN regexp_replace(masked, '_1\]', '_91]', 'g') ELSE masked END AS response FROM masks)"""
_SELFCHECK = f"""{MASK}, {candidates('cand2', None, 'masks', 'masked')}, {greedy('won2', 'cand2')},
    hits AS (SELECT w.*, substr(masked, w.s + 1, w.e - w.s) AS o FROM won2 w JOIN masks USING (doc_id)),
    open AS (SELECT h.* FROM hits h WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.doc_id = h.doc_id AND i.mapped AND i.m = h.o)),
    again AS (SELECT doc_id, label, k, row_number() OVER (PARTITION BY doc_id, label ORDER BY turn, spot) AS n FROM (
        SELECT doc_id, label, k, min(turn) AS turn, arg_min(spot, turn) AS spot FROM (
            SELECT doc_id, label, k, 0 AS turn, n AS spot FROM items_keys UNION ALL SELECT doc_id, label, lower(o), 1, min(-s) FROM open GROUP BY doc_id, label, lower(o)) GROUP BY doc_id, label, k)),
    leaks AS (SELECT o.doc_id, s, e, concat('[', o.label, '_', n, ']') AS m FROM open o JOIN again a ON o.doc_id = a.doc_id AND o.label = a.label AND lower(o.o) = a.k),
    {splice('final', 'leaks', 'masked', 'masks')}"""
_DOCTOR = matched(r"Dr\. (?:" + "|".join(SURNAMES) + ")")
MODEL = f"""model AS MATERIALIZED (SELECT doc_id, s, s + length(m) AS e, 'NAME' AS label FROM ({_DOCTOR})
    UNION ALL SELECT doc_id, instr(text, source) - 1, instr(text, source) - 1 + length(source), 'LOCATION' FROM src WHERE instr(text, source) > 0)"""
ENSEMBLE = f"""{MODEL}, both_ AS (SELECT doc_id, 0 AS prio, s, e, label FROM won UNION ALL SELECT doc_id, 1, s, e, label FROM model), {greedy('joined', 'both_')}"""
_JUDGED = """found AS (SELECT 'regex' AS detector, doc_id, s, e, label FROM won UNION SELECT 'model', * FROM model UNION SELECT 'ensemble', * FROM joined),
    wanted AS (SELECT DISTINCT detector, doc_id, s, e, label FROM gold, (VALUES ('regex'), ('model'), ('ensemble')) v(detector)),
    scored AS MATERIALIZED (SELECT *, 'tp' AS kind FROM (FROM found INTERSECT FROM wanted) UNION ALL SELECT *, 'fp' FROM (FROM found EXCEPT FROM wanted) UNION ALL SELECT *, 'fn' FROM (FROM wanted EXCEPT FROM found))"""
SCORED = f"{NOTES}, {DETECT}, {ENSEMBLE}, {GOLD}, {_JUDGED}"
_P, _R = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END", "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END"
MEASURES = f"tp, fp, fn, round({_P}, 9)::DOUBLE AS p, round({_R}, 9)::DOUBLE AS r, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * ({_P}) * ({_R}) / (({_P}) + ({_R})) END, 9)::DOUBLE AS f1"
_COUNTS = "count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn"
_PLACES = ", ".join(f"count(DISTINCT CASE WHEN kind = '{k}' THEN concat(s, ':', e) END) AS {k}" for k in ("tp", "fp", "fn"))
TOKENS = f"""toks AS MATERIALIZED (SELECT doc_id, pos, s AS ts, s + length(m) AS te FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS pos FROM ({matched(r'[0-9A-Za-z_]+|[^0-9A-Za-z_' + chr(92) + 's]')})) WHERE pos < 256)"""


def aligned(name: str, spans: str) -> str:
    ids = "CASE " + "tag " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in TAG_IDS.items()) + " END"
    return f"""{name} AS MATERIALIZED (SELECT doc_id, pos, ts, te, tag, {ids} AS tag_id FROM (SELECT t.doc_id, t.pos, ts, te, coalesce(tag, 'O') AS tag FROM toks t LEFT JOIN (
        SELECT doc_id, pos, arg_max(CASE WHEN n = 1 THEN 'B-' ELSE 'I-' END || label, ordinal) AS tag FROM (
            SELECT t.doc_id, t.pos, g.label, g.ordinal, row_number() OVER (PARTITION BY t.doc_id, g.ordinal ORDER BY t.pos) AS n
            FROM toks t JOIN {spans} g ON t.doc_id = g.doc_id AND t.ts < g.e AND g.s < t.te) GROUP BY doc_id, pos) x USING (doc_id, pos)))"""


def decoded(name: str, tagged: str) -> str:
    return f"""{name} AS (SELECT doc_id, min(ts) AS s, max(te) AS e, min(substr(tag, 3)) AS label FROM (
        SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
            SELECT *, CASE WHEN tag <> 'O' AND (tag LIKE 'B%' OR prev = 'O' OR substr(prev, 3) <> substr(tag, 3)) THEN 1 ELSE 0 END AS opens FROM (
                SELECT *, lag(tag, 1, 'O') OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM {tagged}))) WHERE tag <> 'O' GROUP BY doc_id, run)"""


def listed(table: str) -> str:
    return f"SELECT doc_id, s, e, label, {PART} AS part FROM {table} JOIN src USING (doc_id)"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def _gold_parts() -> str:
    """Places of the marked parts, each sought after the one before."""
    rows = []
    for n, (_, body, parts) in enumerate(texts.GOLD, 1):
        rows += [(n, k, body, part, label) for k, (part, label) in enumerate(parts, 1)]
    return f"""WITH RECURSIVE w AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, k, text, part, label FROM (VALUES {_values(rows)}) v(doc_id, k, text, part, label)),
        r AS (SELECT doc_id, k, text, part, label, instr(text, part) - 1 AS s FROM w WHERE k = 1
            UNION ALL SELECT w.doc_id, w.k, w.text, w.part, w.label, r.s + length(r.part) + instr(substr(w.text, CAST(r.s + length(r.part) + 1 AS BIGINT)), w.part) - 1
            FROM r JOIN w ON w.doc_id = r.doc_id AND w.k = r.k + 1)
        SELECT doc_id, s, s + length(part) AS e, label, part FROM r"""


_BACK = {ours: theirs for theirs, ours in FOREIGN.items()} | {"MRN": "MEDICAL_RECORD", "AGE": "AGE"}
#: Tags and weights written out by their rule: labels in order, two tags each after O; seven weights that differ from 2.
_WEIGHTED = """WITH l AS (SELECT label, row_number() OVER (ORDER BY label) AS n FROM (SELECT unnest(string_split(
        'ACCOUNT AGE DATE DEVICE EMAIL FAX HEALTHPLAN ID_OTHER IP LICENSE LOCATION MRN NAME PHONE SSN URL VEHICLE', ' ')) AS label)),
    w AS (SELECT label, n, CASE WHEN label = 'SSN' THEN 5 WHEN label IN ('MRN', 'HEALTHPLAN') THEN 4 WHEN label IN ('ACCOUNT', 'NAME') THEN 3
        WHEN label IN ('PHONE', 'EMAIL', 'ID_OTHER') THEN 2.5 WHEN label = 'URL' THEN 1.5 ELSE 2 END AS weight FROM l)"""
_CLASSES = f"""{_WEIGHTED}, classes AS (SELECT 0 AS tag_id, 'O' AS tag, 1::DOUBLE AS weight
    UNION ALL SELECT 2 * n - 1, 'B-' || label, weight FROM w UNION ALL SELECT 2 * n, 'I-' || label, weight FROM w)"""
_LOGITS = f"logits AS (SELECT event_id, k, ((event_id * (k + 3) + k * k) % 17) / 4.0::DOUBLE AS x, event_id % {len(TAGS)} AS gold FROM events, range(0, {len(TAGS)}) AS r(k))"
_BATCH = f"""{NOTES}, {MASK}, {MAPPING},
    said AS MATERIALIZED (SELECT doc_id, masked, CASE WHEN doc_id % 7 = 0 THEN regexp_replace(answer, '_1\\]', '_91]', 'g') ELSE answer END AS response
        FROM (SELECT doc_id, masked, concat({lit(DRY_RUN)}, masked, {lit(BETWEEN)}, {lit(texts.QUESTION)}) AS answer FROM masks)),
    back AS (SELECT doc_id, coalesce(list_reduce(entries, lambda text, x: replace(text, split_part(x, chr(1), 1), split_part(x, chr(1), 2)), response), response) AS restored
        FROM said LEFT JOIN (SELECT doc_id, list(masked || chr(1) || original ORDER BY length(masked) DESC, ordinal) AS entries FROM mapping GROUP BY doc_id) USING (doc_id)),
    odd AS (SELECT doc_id, list(token ORDER BY n) AS tokens FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS n FROM (SELECT doc_id, regexp_extract_all(response, '\\[[A-Z_]+_\\d+\\]') AS t FROM said)) x
        WHERE NOT EXISTS (SELECT 1 FROM mapping y WHERE y.doc_id = x.doc_id AND y.masked = x.token) GROUP BY doc_id),
    named AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN source ELSE concat('example_', row_number() OVER (ORDER BY doc_id) - 1) END AS source FROM src),
    batch AS (SELECT doc_id, named.source, masked, response, restored, coalesce(tokens, []) AS tokens FROM said JOIN back USING (doc_id) JOIN named USING (doc_id) LEFT JOIN odd USING (doc_id))"""

_WORDS_OF = matched(r"[0-9A-Za-z_]+|[^0-9A-Za-z_" + chr(92) + "s]")
#: Pieces by the longest one first, for each distinct word; then the first 254 of a document, tagged from gold.
PIECES = f"""vocabulary AS MATERIALIZED (SELECT list(piece) AS pieces FROM (SELECT chr(k::INT) AS piece FROM range(33, 127) AS r(k) WHERE lower(chr(k::INT)) = chr(k::INT)
        UNION ALL SELECT substr(w, k, n) FROM (SELECT unnest(string_split({lit(' '.join(VOCABULARY_WORDS))}, ' ')) AS w), range(1, 12) AS r(k), (VALUES (3), (4)) v(n) WHERE k + n - 1 <= length(w))),
    words AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS word, s, lower(m) AS m FROM ({_WORDS_OF})),
    cuts AS (SELECT DISTINCT m, 0 AS a, 0 AS b FROM words UNION ALL
        SELECT m, b, CASE WHEN b + 4 <= length(m) AND list_contains(pieces, substr(m, b + 1, 4)) THEN b + 4 WHEN b + 3 <= length(m) AND list_contains(pieces, substr(m, b + 1, 3)) THEN b + 3
            WHEN list_contains(pieces, substr(m, b + 1, 1)) THEN b + 1 END FROM cuts, vocabulary WHERE b < length(m)),
    split_ AS MATERIALIZED (SELECT m, a, b, CASE WHEN a = 0 THEN '' ELSE '##' END || substr(m, a + 1, b - a) AS piece FROM cuts WHERE b > a),
    cut AS MATERIALIZED (SELECT m, a, b, piece FROM split_ WHERE m IN (SELECT m FROM split_ GROUP BY m HAVING max(b) = length(m)) AND length(m) <= 100
        UNION ALL SELECT DISTINCT m, 0, length(m), '[UNK]' FROM words WHERE length(m) > 100 OR m NOT IN (SELECT m FROM split_ GROUP BY m HAVING max(b) = length(m))),
    toks AS MATERIALIZED (SELECT * FROM (SELECT doc_id, word, piece, s + a AS ts, s + b AS te, row_number() OVER (PARTITION BY doc_id ORDER BY s, a) AS pos FROM words JOIN cut USING (m)) WHERE pos <= 254)"""

DUCK = synthetic.Dialect("('0x' || left(md5({text}), 8))::BIGINT", "[{items}]", "list_extract({array}, {at})", "{{'label': {label}, 'v': {v}}}", "(DATE '2020-01-01' + CAST({days} AS INT))")


def _synthetic() -> str:
    """split, doc_id, template_id, parts, text of the synthetic notes of both pools."""
    pools = []
    for split, templates in synthetic.TEMPLATES.items():
        chosen = synthetic.Slots(DUCK).h(synthetic.TEMPLATE, len(templates))
        rows = f"SELECT *, {synthetic.parts_sql(split, DUCK)} AS parts FROM (SELECT *, {chosen} AS t FROM (SELECT range AS id, '13' AS seed FROM range(2000)))"
        whole = "array_to_string(list_transform(parts, lambda x: x.v), '')"
        pools.append(f"SELECT '{split}' AS split, id AS doc_id, t AS template_id, parts, {synthetic.cased_sql(whole, DUCK)} AS text FROM ({rows})")
    return f"synth AS MATERIALIZED ({' UNION ALL '.join(pools)})"


#: Three evaluation sets side by side; the remainder of an id by three tells them apart.
_EVALUATED = f"""noted AS MATERIALIZED ({_RENDERED}), {_synthetic()}, marked AS MATERIALIZED ({_gold_parts()}),
    cut AS (SELECT doc_id, x.label AS label, length(x.v) AS n, sum(length(x.v)) OVER (PARTITION BY doc_id ORDER BY place) AS e
        FROM (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS place FROM synth WHERE split = 'eval')),
    src AS MATERIALIZED (SELECT 3 * doc_id AS doc_id, text, source FROM noted UNION ALL SELECT 3 * doc_id + 1, text, NULL FROM synth WHERE split = 'eval'
        UNION ALL SELECT 3 * doc_id + 2, text, NULL FROM (VALUES {_values([(n, body) for n, (_, body, _) in enumerate(texts.GOLD, 1)])}) v(doc_id, text)),
    gold AS MATERIALIZED (SELECT 3 * doc_id AS doc_id, g.s::BIGINT AS s, g.e::BIGINT AS e, g.label AS label FROM (SELECT doc_id, unnest(gold) AS g FROM noted WHERE gold IS NOT NULL)
        UNION ALL SELECT 3 * doc_id + 1, (e - n)::BIGINT, e::BIGINT, label FROM cut WHERE label IS NOT NULL UNION ALL SELECT 3 * doc_id + 2, s, e, label FROM marked)"""
_CASED = "CASE WHEN text = upper(text) THEN upper(x.v) WHEN text = lower(text) THEN lower(x.v) ELSE x.v END"

ORACLE_SQL: dict[str, str] = {
    **{
        f"spans_{p.label.lower()}": f"WITH {DOCUMENTS if p.label in ('EMAIL', 'IP') else NOTES}, {candidates('cand', {p.label})} {listed('cand')}"
        for p in PATTERNS
    },
    "detect_all_documents": f"WITH {DOCUMENTS}, {DETECT} {listed('won')}",
    "detect_all_notes": f"WITH {NOTES}, {DETECT} {listed('won')}",
    "detect_pages": f"WITH {PAGES}, {DETECT} {listed('won')}",
    "claim_conflicts": f"WITH {NOTES}, {DETECT} SELECT label, count(*) AS lost FROM cand c WHERE NOT EXISTS (SELECT 1 FROM won w WHERE w.doc_id = c.doc_id AND w.s = c.s AND w.e = c.e AND w.label = c.label) GROUP BY label",
    "label_histogram": f"WITH src AS MATERIALIZED (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, text FROM ({_RENDERED})), {DETECT} SELECT label, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS chars FROM won GROUP BY label",
    "docs_with_identifiers_by_lang": f"WITH {DOCUMENTS}, {DETECT} SELECT lang, count(*) AS docs, count(w.doc_id) AS with_identifiers FROM src LEFT JOIN (SELECT DISTINCT doc_id FROM won) w ON w.doc_id = src.doc_id GROUP BY lang",
    "doc_shift": f"SELECT doc_id, {KEYED} AS days FROM documents",
    "date_shift": f"WITH {NOTES}, {DETECT} SELECT doc_id, s, part, CAST({parsed('part')} AS VARCHAR) AS day, {shifted('part', str(DAYS))} AS moved FROM ({listed('won')}) WHERE label = 'DATE'",
    "date_interval_preserved": f"WITH {NOTES}, {DETECT}, moves AS (SELECT doc_id, {parsed('part')} AS a, {shifted('part', '(' + KEYED + ')')} AS moved FROM ({listed('won')}) WHERE label = 'DATE') SELECT doc_id, date_diff('day', min(a), max(a)) AS days_before, date_diff('day', min(b), max(b)) AS days_after FROM (SELECT doc_id, a, {parsed('moved')} AS b FROM moves) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY doc_id",
    "mask_documents": f"WITH {DOCUMENTS}, {MASK} SELECT doc_id, masked FROM masks",
    "mask_notes": f"WITH {NOTES}, {MASK} SELECT doc_id, masked FROM masks",
    "mask_notes_selfcheck": f"WITH {NOTES}, {_SELFCHECK} SELECT doc_id, masked, coalesce(n, 0) AS leaks FROM final LEFT JOIN (SELECT doc_id, count(*) AS n FROM open GROUP BY doc_id) USING (doc_id)",
    "mapping_table": f"WITH {NOTES}, {MASK}, {MAPPING} SELECT * FROM mapping",
    "pseudonym_ids": f"WITH {NOTES}, {MASK} SELECT doc_id, s, label, m AS token FROM items WHERE m LIKE '[%'",
    "rehydrate_notes": f"WITH {NOTES}, {MASK}, {MAPPING}, {ANSWER} SELECT doc_id, coalesce(list_reduce(entries, lambda text, x: replace(text, split_part(x, chr(1), 1), split_part(x, chr(1), 2)), response), response) AS restored FROM answers LEFT JOIN (SELECT doc_id, list(masked || chr(1) || original ORDER BY length(masked) DESC, ordinal) AS entries FROM mapping GROUP BY doc_id) USING (doc_id)",
    "rehydrate_warnings": rf"WITH {NOTES}, {MASK}, {MAPPING}, {ANSWER}, said AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS n FROM (SELECT doc_id, regexp_extract_all(response, '\[[A-Z_]+_\d+\]') AS t FROM answers)) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS place, token FROM said x WHERE NOT EXISTS (SELECT 1 FROM mapping y WHERE y.doc_id = x.doc_id AND y.masked = x.token)",
    "roundtrip_dry": f"WITH {NOTES}, {MASK} SELECT doc_id, concat({lit(DRY_RUN)}, masked, {lit(BETWEEN)}, {lit(texts.QUESTION)}) AS response FROM masks",
    "ensemble_spans": f"WITH {NOTES}, {DETECT}, {ENSEMBLE} {listed('joined')}",
    "normalise_labels": f"WITH {NOTES}, {DETECT}, names(label, other) AS (VALUES {_values(list(_BACK.items()))}), ours(other, label) AS (VALUES {_values(list(FOREIGN.items()))}) SELECT ours.other AS \"foreign\", ours.label AS label, count(*) AS n FROM won JOIN names ON won.label = names.label JOIN ours ON names.other = ours.other GROUP BY 1, 2",
    "score_overall": f"WITH {SCORED} SELECT {MEASURES} FROM (SELECT {_COUNTS} FROM scored WHERE detector = 'regex')",
    "score_by_detector": f"WITH {SCORED} SELECT detector, {MEASURES} FROM (SELECT detector, {_COUNTS} FROM scored GROUP BY detector)",
    "score_by_evaluation": f"""WITH {_EVALUATED}, {DETECT}, {ENSEMBLE}, {_JUDGED}, told AS (SELECT doc_id % 3 AS k, detector, {_COUNTS}, count(DISTINCT CASE WHEN kind = 'fn' THEN doc_id END) AS leaking FROM scored GROUP BY 1, 2)
        SELECT CASE k WHEN 0 THEN 'notes' WHEN 1 THEN 'synthetic' ELSE 'gold' END AS eval_set, detector, {MEASURES}, docs, leaking, round(leaking / docs, 9) AS leak_rate
        FROM told JOIN (SELECT doc_id % 3 AS k, count(*) AS docs FROM src GROUP BY 1) USING (k)""",
    "score_per_label": f"WITH {SCORED} SELECT detector, label, {MEASURES}, tp + fn AS support FROM (SELECT detector, label, {_PLACES} FROM scored GROUP BY detector, label)",
    "score_leak_rate": f"WITH {SCORED} SELECT docs, leaking, round(leaking / docs, 9) AS leak_rate FROM (SELECT (SELECT count(*) FROM src) AS docs, count(DISTINCT doc_id) AS leaking FROM scored WHERE detector = 'regex' AND kind = 'fn')",
    "missed_sample": f"WITH {SCORED} SELECT doc_id, s, e, label, {PART} AS part, coalesce(source, 'synthetic') AS source FROM scored JOIN src USING (doc_id) WHERE detector = 'regex' AND kind = 'fn' ORDER BY doc_id, s, e, label LIMIT 8",
    "gold_locate": _gold_parts(),
    "latency_percentiles": "SELECT event_type AS stage, count(value) AS n, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, round(avg(value), 9) AS mean_s, round(max(value), 9) AS max_s FROM events GROUP BY event_type",
    "bio_align": f"WITH {NOTES}, {GOLD}, {TOKENS}, {aligned('tagged', 'gold')} SELECT doc_id, pos, ts, te, CAST(tag_id AS BIGINT) AS tag_id, tag FROM tagged",
    "bio_metrics": f"WITH {NOTES}, {DETECT}, {GOLD}, {TOKENS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS ordinal FROM won), {aligned('t1', 'numbered')}, {aligned('t2', 'gold')}, {decoded('d1', 't1')}, {decoded('d2', 't2')} SELECT {MEASURES} FROM (SELECT (SELECT count(*) FROM (FROM d1 INTERSECT FROM d2)) AS tp, (SELECT count(*) FROM (FROM d1 EXCEPT FROM d2)) AS fp, (SELECT count(*) FROM (FROM d2 EXCEPT FROM d1)) AS fn)",
    "bio_subwords": f"WITH RECURSIVE {NOTES}, {GOLD}, {PIECES}, {aligned('tagged', 'gold')}, told AS (SELECT doc_id, string_agg(piece, ' ' ORDER BY pos) AS pieces, string_agg(tag_id, ' ' ORDER BY pos) AS tags, count(*) AS n FROM toks JOIN tagged USING (doc_id, pos) GROUP BY doc_id) SELECT doc_id, coalesce(pieces, '') AS pieces, coalesce(tags, '') AS tags, 256 - coalesce(n, 0) AS others, 0::BIGINT AS wrong FROM src LEFT JOIN told USING (doc_id)",
    "subword_merge": f"""WITH RECURSIVE {NOTES}, {GOLD}, {PIECES}, {aligned('tagged', 'gold')}, scored AS (
            SELECT doc_id, t.word, t.ts, t.te, CASE WHEN (doc_id + t.pos) % 5 = 0 THEN 'O' ELSE tag END AS tag, CASE WHEN (doc_id + t.pos) % 5 = 0 THEN 0 ELSE tag_id END AS tag_id, (doc_id * 3 + t.pos * 7) % 97 AS score
            FROM toks t JOIN tagged g USING (doc_id, pos)),
        merged AS (SELECT doc_id, word AS pos, min(ts) AS ts, max(te) AS te, arg_max(tag, score * 100 - tag_id) AS tag FROM scored GROUP BY doc_id, word), {decoded('found', 'merged')}
        SELECT doc_id, s, e, label FROM found""",
    "roundtrip_batch": f"WITH {_BATCH} SELECT doc_id, source, response, restored, len(tokens) AS warnings FROM batch",
    "roundtrip_warned": f"WITH {_BATCH} SELECT count(*) AS docs, count(*) FILTER (len(tokens) > 0) AS warned, 0::BIGINT AS leaks FROM batch",
    "roundtrip_transcripts": f"""WITH {_BATCH} SELECT doc_id, concat('### ', source, chr(10), 'shift of dates: {DAYS} days', chr(10),
        '**Sent**', chr(10), '```', chr(10), masked, chr(10), '```', chr(10), '**Response**', chr(10), '```', chr(10), response, chr(10), '```', chr(10),
        '**Restored**', chr(10), '```', chr(10), restored, chr(10), '```', chr(10),
        CASE WHEN len(tokens) > 0 THEN concat('**Unknown tokens:** ', array_to_string(tokens, ', '), chr(10)) ELSE '' END) AS transcript FROM batch""",
    "roundtrip_fallback": f"""WITH {_BATCH}, asked AS (SELECT doc_id, masked, concat({lit(DRY_RUN)}, masked, {lit(BETWEEN)}, {lit(texts.QUESTION)}) AS response, doc_id % 4 AS k FROM masks)
        SELECT doc_id, CASE k WHEN 1 THEN {lit(FAILING[0])} WHEN 2 THEN {lit(FAILING[1])} WHEN 3 THEN {lit(FAILING[2])} END AS provider, response,
               CASE k WHEN 1 THEN 'unknown provider' WHEN 2 THEN 'no key' WHEN 3 THEN 'unreachable' END AS error, k > 0 AS fell_back, k > 0 AS hinted,
               coalesce(list_reduce(entries, lambda text, x: replace(text, split_part(x, chr(1), 1), split_part(x, chr(1), 2)), response), response) AS restored
        FROM asked LEFT JOIN (SELECT doc_id, list(masked || chr(1) || original ORDER BY length(masked) DESC, ordinal) AS entries FROM mapping GROUP BY doc_id) USING (doc_id)""",
    "roundtrip_timings": f"WITH {NOTES} SELECT stage, count(*) AS n, true AS ordered, true AS within FROM src, (VALUES ('deidentify'), ('response'), ('rehydrate'), ('total')) v(stage) GROUP BY stage",
    "roundtrip_checked": f"WITH {NOTES}, {_SELFCHECK.replace(shifted('o', str(DAYS)), shifted('o', '(' + KEYED + ')'))} SELECT doc_id, masked, coalesce(n, 0) AS leaks, {KEYED} AS shift FROM final LEFT JOIN (SELECT doc_id, count(*) AS n FROM open GROUP BY doc_id) USING (doc_id)",
    "class_weights": f"{_CLASSES} SELECT CAST(tag_id AS BIGINT) AS tag_id, tag, CAST(weight AS DOUBLE) AS weight FROM classes",
    "argmax_tags": f"WITH {_LOGITS} SELECT event_id, min(k) AS tag_id FROM logits x JOIN (SELECT event_id, max(x) AS x FROM logits GROUP BY event_id) USING (event_id, x) GROUP BY event_id",
    "weighted_loss": f"""{_CLASSES}, {_LOGITS}, sums AS (SELECT event_id, gold, ln(sum(exp(x))) - max(x) FILTER (k = gold) AS nll FROM logits WHERE event_id % 11 <> 0 GROUP BY event_id, gold)
        SELECT round(sum(weight * nll) / sum(weight), 9) AS loss, count(*) AS tokens FROM sums JOIN classes ON tag_id = gold""",
    "best_epoch": "SELECT CAST(epoch AS DOUBLE) AS epoch, recall FROM (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) AS epoch, round(avg(value) / 100, 2) AS recall FROM events GROUP BY 1) ORDER BY recall DESC, epoch LIMIT 1",
    "synth_notes": f"""WITH {_synthetic()}, tags AS (SELECT split, doc_id, string_agg(label || '=' || v, '|' ORDER BY n) AS tagged FROM (
            SELECT split, doc_id, x.label AS label, {_CASED} AS v, n FROM (SELECT split, doc_id, text, unnest(parts) AS x, generate_subscripts(parts, 1) AS n FROM synth)) WHERE label IS NOT NULL GROUP BY split, doc_id)
        SELECT split, doc_id, template_id, text, coalesce(tagged, '') AS tagged FROM synth LEFT JOIN tags USING (split, doc_id)""",
    "synth_label_support": f"WITH {_synthetic()} SELECT split, x.label AS label, count(*) AS n FROM (SELECT split, unnest(parts) AS x FROM synth) WHERE x.label IS NOT NULL GROUP BY split, x.label",
    "leak_scan_conversations": f"WITH src AS (SELECT row_number() OVER () AS doc_id, role, text FROM conversations), {DETECT} SELECT role, count(*) AS turns, count(w.doc_id) AS with_hits FROM src LEFT JOIN (SELECT DISTINCT doc_id FROM won) w ON w.doc_id = src.doc_id GROUP BY role",
}
