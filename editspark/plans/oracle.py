"""DuckDB SQL for the registered queries, written from their definitions and not from the Spark code.

Expressions are made by small functions of SQL text; tables are common table expressions, and each query gets those it names.
"""

from __future__ import annotations

import re

from ..functions import constants as C


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def among(words) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{C.WS}+|{C.WS}+$')}, '', 'g')"


def tokens(x: str) -> str:
    low = f"lower(nfc_normalize(coalesce({x}, '')))"
    line = f"regexp_replace({strip('l')}, {q(C.LIST_MARKER)}, '')"
    joined = f"array_to_string(list_transform(regexp_split_to_array({low}, {q(C.LINE_END)}), lambda l: {line}), ' ')"
    for pattern, by in (("([a-z])-([a-z])", r"\1\2"), ("([a-z])-([a-z])", r"\1\2"), (r"([a-z])(\p{Nd})", r"\1 \2"), (r"(\p{Nd})([a-z])", r"\1 \2")):
        joined = f"regexp_replace({joined}, {q(pattern)}, {q(by)}, 'g')"
    bare = f"list_transform(regexp_split_to_array({joined}, {q(C.WS + '+')}), lambda w: regexp_replace(w, {q(C.EDGE_PUNCTUATION)}, '', 'g'))"
    unit = " ".join(f"WHEN w IN {among([k for k, v in C.UNITS.items() if v == u])} THEN '{u}'" for u in ("mm", "cm"))
    units = f"list_filter(list_transform({bare}, lambda w: CASE {unit} ELSE w END), lambda w: w <> '')"
    return f"flatten(list_transform({units}, lambda w: CASE WHEN regexp_matches(w, {q(C.NUMBER)}) THEN [w] ELSE regexp_extract_all(w, {q(C.SUB_TOKEN)}) END))"


def weight(t: str) -> str:
    return (
        f"CASE WHEN {t} = '' THEN 0.0::DOUBLE WHEN {t} IN {among(C.CRITICAL)} OR regexp_matches({t}, {q(C.NUMBER)}) THEN 4.0::DOUBLE "
        f"WHEN {t} IN {among(C.FUNCTION_WORDS)} THEN 0.25::DOUBLE ELSE 2.0::DOUBLE END"
    )


def cost(r: str, p: str, wr: str, wp: str) -> str:
    """The edit cost between token lists with weight lists, as a fold of folds over one-element lists of positions."""
    at = "j_[1]::INT"
    positions = f"list_transform(range(1, len({p}) + 1), lambda j_: [j_::DOUBLE])"
    first = f"list_reduce({positions}, lambda new_, j_: list_append(new_, new_[-1] + {wp}[{at}]), [0.0::DOUBLE])"
    changed = f"CASE WHEN {r}[i_[1]::INT] = {p}[{at}] THEN 0.0::DOUBLE ELSE greatest({wr}[i_[1]::INT], {wp}[{at}]) END"
    step = f"list_append(new_, least(row_[{at} + 1] + {wr}[i_[1]::INT], new_[-1] + {wp}[{at}], row_[{at}] + {changed}))"
    inner = f"list_reduce({positions}, lambda new_, j_: {step}, [row_[1] + {wr}[i_[1]::INT]])"
    return f"(list_reduce(list_transform(range(1, len({r}) + 1), lambda i_: [i_::DOUBLE]), lambda row_, i_: {inner}, {first}))[-1]"


def distance(a: str, b: str) -> str:
    wa, wb = f"w{a}", f"w{b}"
    total = f"greatest(list_sum({wa}), list_sum({wb}))"
    return f"CASE WHEN {a} = {b} THEN 0.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 1.0::DOUBLE ELSE least(1.0, greatest(0.0, {cost(a, b, wa, wb)} / {total})) END"


def weights(t: str) -> str:
    return f"list_transform({t}, lambda t: {weight('t')})"


def sections(x: str) -> str:
    return f"string_split(regexp_replace(coalesce({x}, ''), '(?i)\\n(IMPRESSION:)', chr(1) || '\\1', 'g'), chr(1))"


def body(x: str) -> str:
    return strip(f"regexp_replace({sections(x)}[1], {q(f'(?i)^FINDINGS:{C.WS}*')}, '')")


def keys(x: str) -> str:
    return f"list_transform(regexp_extract_all({body(x)}, {q(C.FIELD)}, 1), lambda k: {strip('k')})"


def parsed(source: str, column: str) -> str:
    """A row a report: keys, values, impression."""
    values = f"list_transform(regexp_split_to_array({body(column)}, {q(C.FIELD)})[2:], lambda v: {strip('v')})"
    said = f"regexp_replace(coalesce({sections(column)}[2], ''), {q(f'(?i)^IMPRESSION:{C.WS}*')}, '')"
    return f"SELECT case_id, {keys(column)} AS ks, {values} AS vs, {strip(said)} AS imp FROM {source}"


def fields(source: str) -> str:
    """A row a field."""
    return f"SELECT case_id, unnest(range(0, len(ks))) AS pos, unnest(ks) AS key, unnest(vs) AS value, imp FROM {source}"


def last(source: str) -> str:
    """A row a key: the last of its values."""
    return f"SELECT case_id, key, arg_max(value, pos) AS value, min(pos) AS pos FROM {source} GROUP BY case_id, key"


def scoring(name: str, cases: str) -> dict[str, str]:
    """Tables of the score of ``cases(case_id, report, predicted, template_content)``, their names led by ``name``."""
    n = name
    return {
        f"{n}_rp": parsed(cases, "report"), f"{n}_pp": parsed(cases, "predicted"), f"{n}_tp": parsed(cases, "template_content"),
        f"{n}_rf": fields(f"{n}_rp"), f"{n}_pf": fields(f"{n}_pp"), f"{n}_tf": fields(f"{n}_tp"),
        f"{n}_rl": last(f"{n}_rf"), f"{n}_pl": last(f"{n}_pf"), f"{n}_tl": last(f"{n}_tf"),
        f"{n}_met": f"""SELECT coalesce(r.case_id, p.case_id) AS case_id, coalesce(r.key, p.key) AS key, r.value AS rv, p.value AS pv, coalesce(t.value, '') AS tv
            FROM {n}_rl r FULL JOIN {n}_pl p ON r.case_id = p.case_id AND r.key = p.key LEFT JOIN {n}_tl t ON t.case_id = coalesce(r.case_id, p.case_id) AND t.key = coalesce(r.key, p.key)""",
        f"{n}_tok": f"SELECT case_id, key, rv, pv, {tokens('rv')} AS a, {tokens('pv')} AS b, {tokens('tv')} AS c FROM {n}_met",
        f"{n}_w": f"SELECT *, {weights('a')} AS wa, {weights('b')} AS wb FROM {n}_tok",
        f"{n}_edits": f"""SELECT case_id, key, CASE WHEN rv IS NULL THEN 2.0::DOUBLE WHEN a <> c THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
            CASE WHEN rv IS NULL OR pv IS NULL THEN 1.0::DOUBLE ELSE {distance('a', 'b')} END AS edit FROM {n}_w""",
        f"{n}_find": f"SELECT case_id, sum(weight * edit) / sum(weight) AS f FROM {n}_edits GROUP BY case_id",
        f"{n}_imp0": f"SELECT r.case_id, {tokens('r.imp')} AS a, {tokens('p.imp')} AS b FROM {n}_rp r JOIN {n}_pp p USING (case_id)",
        f"{n}_imp": f"SELECT case_id, {distance('a', 'b')} AS i FROM (SELECT *, {weights('a')} AS wa, {weights('b')} AS wb FROM {n}_imp0)",
        f"{n}_res": f"SELECT case_id, 0.65 * coalesce(f, 0) + 0.35 * i AS res_case, coalesce(f, 0) AS findings_score, i AS impression_score FROM {n}_imp LEFT JOIN {n}_find USING (case_id)",
    }


def rendering(n: str, updates: str) -> dict[str, str]:
    """Tables of the lines of each template with ``updates(case_id, pos, key, value)`` applied, their names led by ``n``."""
    return {
        f"{n}_kept": f"""SELECT f.case_id, f.pos AS line, f.key || ': ' || CASE WHEN u.key <> '' AND u.value <> '' THEN {strip('u.value')} ELSE f.value END AS text
            FROM m_tf f LEFT JOIN (SELECT case_id, upper({strip('key')}) AS folded, arg_min(key, pos) AS key, arg_min(value, pos) AS value FROM {updates} GROUP BY ALL) u
            ON f.case_id = u.case_id AND upper({strip('f.key')}) = u.folded""",
        f"{n}_extra": f"""SELECT u.case_id, 1000000 + u.pos AS line, upper({strip('u.key')}) || ': ' || {strip('u.value')} AS text FROM {updates} u
            WHERE u.value <> '' AND NOT EXISTS (FROM m_tf f WHERE f.case_id = u.case_id AND upper({strip('f.key')}) = upper({strip('u.key')}))""",
        f"{n}_lines": f"SELECT case_id, string_agg(text, chr(10) ORDER BY line) AS lines FROM (FROM {n}_kept UNION ALL FROM {n}_extra) GROUP BY case_id",
    }


def folds(source: str, order: str) -> str:
    return f"SELECT *, (row_number() OVER (PARTITION BY concat_ws('_', modality, body_part) ORDER BY {order}) - 1) % 5 AS fold FROM {source}"


def bags(source: str, column: str) -> str:
    return f"SELECT id, w, count(*) AS tf FROM (SELECT id, unnest({column}) AS w FROM {source}) GROUP BY id, w"


def runs(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(C.WORD_RUN)})"


#: Of a column ``runs``: the runs and the pairs of neighbours.
TERMS = "list_concat(runs, list_transform(range(1, greatest(len(runs), 1)), lambda i: runs[i] || ' ' || runs[i + 1]))"


def retrieval(n: str, docs: str, asks: str) -> dict[str, str]:
    """BM25, TF-IDF and hybrid tables over ``docs`` and ``asks``: id, row_idx, case_id, modality, body_part, dictation, said, headers."""
    return {
        f"{n}_dt": f"SELECT *, {tokens('dictation')} AS toks FROM {docs}", f"{n}_qt": f"SELECT *, {tokens('dictation')} AS toks FROM {asks}",
        f"{n}_dw": f"SELECT *, {TERMS} AS terms FROM (SELECT *, {runs('said')} AS runs FROM {docs})", f"{n}_qw": f"SELECT *, {TERMS} AS terms FROM (SELECT *, {runs('said')} AS runs FROM {asks})",
        f"{n}_n": f"SELECT count(*) AS n FROM {docs}",
        f"{n}_db": bags(f"{n}_dt", "toks"), f"{n}_qb": bags(f"{n}_qt", "toks"),
        f"{n}_raw": f"SELECT w AS token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {n}_db, {n}_n GROUP BY w",
        f"{n}_bi": f"SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {n}_raw) ELSE raw END AS idf FROM {n}_raw",
        f"{n}_len": f"SELECT id, len(toks) AS len, avg(len(toks)) OVER () AS mean FROM {n}_dt",
        f"{n}_bm": f"""SELECT a.id AS query_id, d.id AS doc_id, sum(a.tf * idf * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score
            FROM {n}_qb a JOIN {n}_db d USING (w) JOIN {n}_bi ON token = w JOIN {n}_len l ON l.id = d.id GROUP BY a.id, d.id""",
        f"{n}_dg": bags(f"{n}_dw", "terms"), f"{n}_qg": bags(f"{n}_qw", "terms"),
        f"{n}_ti": f"SELECT w AS term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM {n}_dg, {n}_n GROUP BY w",
        f"{n}_dv": f"SELECT id, w, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS v FROM {n}_dg JOIN {n}_ti ON term = w",
        f"{n}_qv": f"SELECT id, w, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS v FROM {n}_qg JOIN {n}_ti ON term = w",
        f"{n}_tf": f"SELECT a.id AS query_id, d.id AS doc_id, sum(a.v * d.v) AS cosine FROM {n}_qv a JOIN {n}_dv d USING (w) GROUP BY a.id, d.id",
        f"{n}_ja": f"""SELECT a.id AS query_id, d.id AS doc_id, len(list_intersect(a.headers, d.headers)) / len(list_distinct(list_concat(a.headers, d.headers))) AS jaccard
            FROM {asks} a, {docs} d WHERE len(list_intersect(a.headers, d.headers)) > 0""",
        f"{n}_most": f"SELECT query_id, CASE WHEN max(score) > 0 THEN max(score) ELSE 1 END AS most FROM {n}_bm GROUP BY query_id",
        f"{n}_hy": f"""SELECT a.id AS query_id, d.id AS doc_id, d.row_idx, a.case_id AS qc, d.case_id AS dc,
            (0.4 * coalesce(jaccard, 0) + 0.35 * coalesce(score / most, 0) + 0.25 * coalesce(cosine, 0))
            * CASE WHEN a.modality = d.modality THEN 1.2 ELSE 0.8 END * CASE WHEN a.body_part = d.body_part THEN 1.3 ELSE 0.7 END AS score
            FROM {asks} a CROSS JOIN {docs} d LEFT JOIN {n}_bm b ON b.query_id = a.id AND b.doc_id = d.id LEFT JOIN {n}_most m ON m.query_id = a.id
            LEFT JOIN {n}_tf t ON t.query_id = a.id AND t.doc_id = d.id LEFT JOIN {n}_ja j ON j.query_id = a.id AND j.doc_id = d.id""",
    }


def top(source: str, where: str = "true") -> str:
    return f"""SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_idx DESC) AS rank
        FROM {source} WHERE score > 0 AND {where}) WHERE rank <= 3"""


TABLES: dict[str, str] = {
    "turns": r"""SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '') AS w,
        rtrim('T' || turn || ' ' || upper(regexp_extract(text, '[A-Za-z]{4,}'))) AS k FROM conversations""",
    "thinned": "SELECT *, list_filter(w, lambda x, i: i % 7 <> 4) AS less FROM turns",
    "grouped": """SELECT conv_id,
        string_agg(k || ': ' || array_to_string(CASE WHEN role = 'assistant' THEN less ELSE w END, ' '), chr(10) ORDER BY turn) AS tf,
        string_agg(k || ': ' || array_to_string(w, ' '), chr(10) ORDER BY turn) AS rf,
        string_agg(k || ': ' || array_to_string(CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN less ELSE w END, ' '), chr(10) ORDER BY turn) AS pf,
        string_agg(CASE WHEN role = 'user' THEN array_to_string(w, ' ') END, '. ' ORDER BY turn) AS dict,
        arg_min(role, turn) AS r0, arg_min(w, turn) AS w0, arg_max(w, turn) AS wl, arg_max(less, turn) AS ll FROM thinned GROUP BY conv_id""",
    "cases": """SELECT 'c' || conv_id AS case_id, conv_id AS row_idx, upper(r0) AS modality, 'B' || (conv_id % 7) AS body_part, upper(r0) || ' B' || (conv_id % 7) AS study_description,
        'FINDINGS:' || chr(10) || tf || chr(10) || chr(10) || 'IMPRESSION:' || chr(10) || array_to_string(w0, ' ') AS template_content,
        coalesce(dict, '') AS dictation,
        'FINDINGS:' || chr(10) || rf || chr(10) || chr(10) || 'IMPRESSION:' || chr(10) || array_to_string(wl, ' ') AS report,
        'FINDINGS:' || chr(10) || pf || chr(10) || chr(10) || 'IMPRESSION:' || chr(10) || array_to_string(ll, ' ') AS predicted FROM grouped""",
    "records": "SELECT user_id::VARCHAR AS case_id, event_id AS ordinal, value AS res, event_type AS modality, event_type <> 'error' AS valid, props AS report FROM events",
    "done": "SELECT case_id, min(ordinal) AS first_ordinal, max(ordinal) AS ordinal, arg_max(res, ordinal) AS res, arg_max(modality, ordinal) AS modality, arg_max(valid, ordinal) AS valid, arg_max(report, ordinal) AS report FROM records GROUP BY case_id",
    "targets": "SELECT c_custkey::VARCHAR AS case_id, c_custkey::BIGINT AS row_idx, c_mktsegment AS template_content FROM customer",
    "todo": "SELECT * FROM targets WHERE case_id NOT IN (SELECT case_id FROM done)",
    "merged": "SELECT t.case_id, CASE WHEN d.case_id IS NULL THEN template_content ELSE report END AS report, d.case_id IS NULL AS is_placeholder FROM targets t LEFT JOIN done d USING (case_id)",
    "doc_tokens": f"SELECT doc_id, {tokens('text')} AS toks FROM documents",
    **scoring("m", "cases"),
    # changed fields: of repeated keys the place of the first changed one and the value of the last
    "changed": "SELECT f.case_id, f.pos, f.key, f.value FROM m_rf f LEFT JOIN m_tl t ON f.case_id = t.case_id AND f.key = t.key WHERE f.value <> coalesce(t.value, '')",
    "delta": "SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY min(pos)) - 1 AS pos, key, arg_max(value, pos) AS value FROM changed GROUP BY case_id, key",
    "updates": "SELECT case_id, pos, key, value FROM delta UNION ALL SELECT case_id, 1000000, ' other findings ', ' see ' || case_id FROM cases",
    **rendering("r", "updates"),
    # routing of sentences
    "parts": f"""SELECT case_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM (SELECT case_id,
        list_filter(list_transform(regexp_split_to_array({strip('dictation')}, {q('[.;]' + C.WS + '*')}), lambda s: {strip('s')}), lambda s: s <> '') AS s FROM cases)""",
    "normal": f"SELECT case_id, {strip('dictation')} = '' OR lower({strip('dictation')}) IN {among(C.NORMAL_DICTATIONS)} AS is_normal FROM cases",
    "hits": f"""SELECT p.case_id, p.pos, min(f.pos) AS field FROM parts p JOIN m_tf f ON p.case_id = f.case_id
        WHERE len(list_filter(regexp_split_to_array(lower(f.key), {q(C.WS + '+')}), lambda w: length(w) > 3 AND contains(lower(p.sentence), w))) > 0 GROUP BY ALL""",
    "others": "SELECT case_id, min(pos) AS field FROM m_tf WHERE contains(upper(key), 'OTHER') GROUP BY case_id",
    "sent": """SELECT p.case_id, p.pos, f.key, CASE WHEN h.field IS NULL THEN p.sentence ELSE upper(p.sentence[1:1]) || lower(p.sentence[2:]) END AS value
        FROM parts p LEFT JOIN hits h USING (case_id, pos) LEFT JOIN others o ON o.case_id = p.case_id JOIN m_tf f ON f.case_id = p.case_id AND f.pos = coalesce(h.field, o.field)""",
    "routes": "SELECT case_id, key, arg_max(value, pos) AS value FROM sent JOIN normal USING (case_id) WHERE NOT is_normal GROUP BY case_id, key",
    "route_imp": """SELECT case_id, CASE WHEN is_normal OR said IS NULL THEN imp ELSE said END AS impression FROM m_tp JOIN normal USING (case_id)
        LEFT JOIN (SELECT case_id, string_agg(sentence, ' ' ORDER BY pos) AS said FROM parts GROUP BY case_id) USING (case_id)""",
    "stage1": f"""SELECT case_id, 'FINDINGS:' || chr(10) || coalesce(lines, '') || chr(10) || chr(10) || 'IMPRESSION:' || chr(10) || CASE WHEN {strip('impression')} <> '' THEN {strip('impression')} ELSE imp END AS report
        FROM route_imp JOIN m_tp USING (case_id) LEFT JOIN (SELECT f.case_id, string_agg(f.key || ': ' || CASE WHEN r.value <> '' THEN {strip('r.value')} ELSE f.value END, chr(10) ORDER BY f.pos) AS lines
        FROM m_tf f LEFT JOIN routes r ON f.case_id = r.case_id AND f.key = r.key GROUP BY f.case_id) USING (case_id)""",
    # model answers
    "responses": """SELECT case_id, CASE row_idx % 6 WHEN 0 THEN json_object('field_updates', json_object('OTHER', dictation), 'impression', 'seen')::VARCHAR
        WHEN 1 THEN '{' || dictation WHEN 2 THEN '[1, 2]' WHEN 3 THEN '{"field_updates": {"A": 3}, "impression": "x"}' WHEN 4 THEN '{"field_updates": null, "impression": "x"}'
        ELSE '{"impression": "only this"}' END AS raw FROM cases""",
    "answers": "SELECT case_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM responses",
    "typed": """SELECT case_id, j, coalesce(json_type(j) = 'OBJECT' AND coalesce(json_type(j, '$.field_updates'), 'OBJECT') = 'OBJECT' AND coalesce(json_type(j, '$.impression'), 'VARCHAR') IN ('VARCHAR', 'NULL')
        AND len(list_filter(coalesce(json_extract(j, '$.field_updates.*'), []), lambda x: json_type(x) NOT IN ('VARCHAR', 'NULL'))) = 0, false) AS ok FROM answers""",
    "decoded": """SELECT case_id, ok, CASE WHEN ok THEN coalesce(json_keys(j, '$.field_updates'), []) ELSE [] END AS ks, CASE WHEN ok THEN coalesce(json_extract_string(j, '$.field_updates.*'), []) ELSE [] END AS vs,
        CASE WHEN ok THEN coalesce(json_extract_string(j, '$.impression'), '') ELSE '' END AS said FROM typed""",
    "model_updates": "SELECT case_id, unnest(range(0, len(ks))) AS pos, unnest(ks) AS key, coalesce(unnest(vs), '') AS value FROM decoded",
    **rendering("a", "model_updates"),
    "made": "SELECT c.case_id, row_idx, modality, body_part, template_content, c.report, s.report AS predicted FROM cases c JOIN stage1 s USING (case_id)",
    **scoring("v", "made"),
    "cv": folds(f"(SELECT row_idx, modality, body_part, v_res.*, len(list_filter({keys('template_content')}, lambda k: NOT list_contains({keys('predicted')}, k))) = 0 AS valid FROM made JOIN v_res USING (case_id))", "row_idx"),
    # retrieval
    "docs_r": "SELECT doc_id AS id, doc_id AS row_idx, doc_id::VARCHAR AS case_id, lang AS modality, source AS body_part, text AS dictation, lang || ' ' || source || ' ' || text AS said, []::VARCHAR[] AS headers FROM documents",
    "asks_r": "SELECT item_id AS id, item_id AS row_idx, item_id::VARCHAR AS case_id, '' AS modality, '' AS body_part, text AS dictation, ' ' || text AS said, []::VARCHAR[] AS headers FROM benchmark",
    "cases_r": f"SELECT row_idx AS id, row_idx, case_id, modality, body_part, dictation, study_description || ' ' || dictation AS said, list_distinct(list_transform({keys('template_content')}, lambda k: upper(k))) AS headers FROM cases",
    **retrieval("d", "docs_r", "asks_r"),
    **retrieval("l", "cases_r", "cases_r"),
    "lengths": "SELECT case_id, report, dictation || '. Right ' || (row_idx % 9) || '.5 cm and 12mm, left 3 mm' AS said FROM cases",
}

_RES = "round(res_case, 6) AS res_case, round(findings_score, 6) AS findings_score, round(impression_score, 6) AS impression_score"

QUERIES: dict[str, str] = {
    "scan_cases": "SELECT case_id, row_idx, modality, body_part, length(report) AS n_chars FROM cases",
    "shard_last_wins": "SELECT case_id, first_ordinal, ordinal, res, valid FROM done",
    "slice_window": "SELECT case_id, row_idx FROM targets WHERE row_idx >= 50 AND row_idx < 110",
    "resume_todo": "SELECT case_id, row_idx FROM todo",
    "batch_status": "SELECT n_done, n_total, round(100.0 * n_done / n_total, 1)::DOUBLE AS pct, next_start FROM (SELECT count(*) AS n_done FROM done), (SELECT count(*) AS n_total FROM targets), (SELECT min(row_idx) AS next_start FROM todo)",
    "merge_submission": "SELECT * FROM merged",
    "merge_counts": "SELECT count(*) AS n_rows, count(*) FILTER (NOT is_placeholder) AS n_generated, count(*) FILTER (is_placeholder) AS n_placeholder, (SELECT count(*) FROM done WHERE NOT coalesce(valid, true)) AS n_invalid FROM merged",
    "normalize_text": "SELECT doc_id, array_to_string(toks, ' ') AS norm FROM doc_tokens",
    "tokenize": "SELECT doc_id, unnest(range(0, len(toks))) AS pos, unnest(toks) AS token FROM doc_tokens",
    "token_weights": f"SELECT doc_id, len(w) AS n_tokens, coalesce(list_sum(w), 0) AS sum_weight, len(list_filter(w, lambda x: x = 4)) AS n_critical, len(list_filter(w, lambda x: x = 0.25)) AS n_function FROM (SELECT doc_id, {weights('toks')} AS w FROM doc_tokens)",
    "parse_fields": "SELECT case_id, pos, key, value, imp AS impression FROM m_rf",
    "template_signature": "SELECT case_id, array_to_string(list_transform(ks, lambda k: upper(k)), '|') AS signature FROM m_tp",
    "delta_extract": "SELECT case_id, pos, key, value, imp AS impression FROM delta JOIN m_rp USING (case_id)",
    "render_report": "SELECT case_id, 'FINDINGS:' || chr(10) || lines || chr(10) || chr(10) || 'IMPRESSION:' || chr(10) || CASE WHEN r.imp <> '' THEN r.imp ELSE t.imp END AS report FROM r_lines JOIN m_rp r USING (case_id) JOIN m_tp t USING (case_id)",
    "validate_structure": f"""SELECT case_id, len(missing) = 0 AS is_valid, CASE WHEN len(missing) > 0 THEN 'Missing template fields in report: ' || array_to_string(list_sort(missing), ', ') ELSE '' END AS issues
        FROM (SELECT c.case_id, list_distinct(list_filter({keys("coalesce(o.template_content, c.template_content)")}, lambda k: NOT list_contains({keys('c.report')}, k))) AS missing FROM cases c LEFT JOIN cases o ON o.row_idx = c.row_idx + 1)""",
    "validate_fidelity": r"""SELECT case_id, n = 0 AS is_faithful, n AS n_warnings FROM (SELECT case_id,
        (contains(lower(said), 'right') AND NOT contains(r, 'right'))::BIGINT + (contains(lower(said), 'left') AND NOT contains(r, 'left'))::BIGINT
        + len(list_filter(regexp_extract_all(lower(said), '\b\d+(?:\.\d+)?\s*(?:mm|cm)\b'), lambda m: NOT contains(r, m))) AS n FROM (SELECT case_id, said, lower(report || ' 12mm bright') AS r FROM lengths))""",
    "measurements": r"SELECT case_id, unnest(range(0, len(m))) AS pos, unnest(m) AS measurement FROM (SELECT case_id, regexp_extract_all(lower(said), '\b\d+(?:\.\d+)?\s*(?:mm|cm)\b') AS m FROM lengths)",
    "weighted_edit": f"SELECT case_id, key, CASE WHEN a = b THEN 0.0::DOUBLE ELSE {cost('a', 'b', 'wa', 'wb')} END AS cost, round({distance('a', 'b')}, 6) AS distance FROM m_w WHERE rv IS NOT NULL AND pv IS NOT NULL",
    "res_fields": "SELECT case_id, key, weight, round(edit, 6) AS edit FROM m_edits",
    "res_findings": "SELECT case_id, round(f, 6) AS findings_score FROM m_find",
    "res_scores": f"SELECT case_id, {_RES} FROM m_res",
    "res_by_modality": "SELECT modality, count(*) AS n, round(avg(res_case), 6) AS mean_res FROM m_res JOIN cases USING (case_id) GROUP BY modality",
    "bm25_index": "SELECT token, df, round(idf, 6) AS idf FROM d_bi",
    "bm25_scores": "SELECT query_id, doc_id, round(score, 6) AS score FROM d_bm",
    "tfidf_index": "SELECT term, df, round(idf, 6) AS idf FROM d_ti",
    "tfidf_scores": "SELECT query_id, doc_id, round(cosine, 6) AS cosine FROM d_tf",
    "jaccard_sig": "SELECT query_id, doc_id, round(jaccard, 6) AS jaccard FROM l_ja",
    "hybrid_topk": top("d_hy"),
    "hybrid_topk_loo": top("l_hy", "qc <> dc"),
    "sentence_split": "SELECT case_id, pos, sentence FROM parts",
    "heuristic_route": "SELECT case_id, key, value, impression FROM route_imp LEFT JOIN routes USING (case_id)",
    "stage1_reports": "SELECT * FROM stage1",
    "submission_reports": "SELECT * FROM stage1",
    "prompt_stage1": """SELECT case_id, 'Case Information:' || chr(10) || 'Modality: ' || modality || chr(10) || 'Body Part: ' || body_part || chr(10) || 'Study Description: ' || study_description || chr(10)
        || 'Patient Age Band: ' || chr(10) || 'Patient Sex: ' || chr(10) || chr(10) || 'Normal Template:' || chr(10) || template_content || chr(10) || chr(10) || 'Dictation:' || chr(10) || dictation || chr(10) || chr(10)
        || 'Respond with valid JSON containing field_updates and impression:' AS prompt FROM cases""",
    "decode_delta": "SELECT case_id, CASE WHEN ok THEN 'ok' ELSE 'undecodable' END AS status, key, value, said AS impression FROM decoded LEFT JOIN model_updates USING (case_id)",
    "rag_strict": "SELECT case_id, CASE WHEN coalesce(raw, '') = '' THEN 'no response' WHEN ok THEN 'ok' ELSE 'undecodable' END AS status FROM decoded JOIN responses USING (case_id)",
    "rag_with_fallback": f"""SELECT case_id, CASE WHEN ok THEN 'FINDINGS:' || chr(10) || coalesce(lines, '') || chr(10) || chr(10) || 'IMPRESSION:' || chr(10) || CASE WHEN {strip('said')} <> '' THEN {strip('said')} ELSE imp END
        ELSE report END AS report, CASE WHEN ok THEN 'model' ELSE 'rules' END AS source FROM decoded JOIN stage1 USING (case_id) JOIN m_tp USING (case_id) LEFT JOIN a_lines USING (case_id)""",
    "stratified_folds": f"SELECT doc_id, fold FROM ({folds('(SELECT doc_id, lang AS modality, source AS body_part FROM documents)', 'doc_id')})",
    "cv_fold_means": "SELECT fold, count(*) AS n, round(avg(res_case), 6) AS mean_res, round(avg(findings_score), 6) AS mean_findings, round(avg(impression_score), 6) AS mean_impression FROM cv GROUP BY fold",
    "cv_summary": "SELECT round(avg(res_case), 6) AS overall_res, round(avg(findings_score), 6) AS overall_findings, round(avg(impression_score), 6) AS overall_impression, count(*) FILTER (NOT valid) AS validation_failures, count(*) AS total_cases FROM cv",
    "score_summary": "SELECT round(avg(res), 6) AS mean_res, round(median(res), 6) AS median_res, round(stddev_pop(res), 6) AS std_res, count(*) FILTER (NOT coalesce(valid, true)) AS validation_failures, count(*) AS cases_scored FROM done",
    "shard_by_modality": "SELECT coalesce(modality, '?') AS modality, count(*) AS n, round(avg(res), 6) AS mean_res FROM done GROUP BY ALL",
    "worst_cases": "SELECT case_id, res, modality FROM done ORDER BY res DESC, first_ordinal LIMIT 10",
}


def with_tables(sql: str) -> str:
    """A statement with the tables that it names, directly or through others, in the order of definition."""
    named = re.compile(r"\b(" + "|".join(sorted(TABLES, key=len, reverse=True)) + r")\b")
    need, todo = set(), {*named.findall(sql)}
    while todo:
        need |= todo
        todo = {x for t in todo for x in named.findall(TABLES[t])} - need
    tables = ",\n".join(f"{t} AS ({TABLES[t]})" for t in TABLES if t in need)
    return f"WITH {tables}\n{sql}" if tables else sql


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(sql) for name, sql in QUERIES.items()}
