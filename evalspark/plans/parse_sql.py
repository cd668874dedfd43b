"""DuckDB twins of the answer parsers; its regular expressions have no look-ahead, so one following character is matched."""

from __future__ import annotations

from ..operators.scoring import PAPER_USER  # noqa: F401

_WORD = r"[0-9A-Za-z_\p{L}\p{M}\p{N}]"
_END = r"(?:[^0-9A-Za-z_\p{L}\p{M}\p{N}]|$)"
_LETTER = r"\(?([ABC])\)?" + _END
_NW = r"[^0-9A-Za-z_\p{L}\p{M}\p{N}]*"
_S = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def prompt_sql(template: str) -> str:
    """Template over conversations: context is the text, question the role, options fixed."""
    values = {"context": "text", "question": "role", "a": _q("{question}"), "b": _q("b"), "c": _q("__option0__")}
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{(context|question|a|b|c)\}", template):
        parts += [_q(template[at : m.start()]), values[m[1]]]
        at = m.end()
    return f"({' || '.join([*parts, _q(template[at:])])})"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_q(rf'^{_S}+|{_S}+$')}, '', 'g')"


def refusal(x: str) -> str:
    from ..functions.answers import REFUSALS

    return f"regexp_matches({x}, {_q('(?i)(?:' + '|'.join(REFUSALS) + ')')})"


def stripped_sql() -> str:
    return f"stripped AS (SELECT *, {_strip('str_split(completion, ' + _q('</think>') + ')[-1]')} AS stripped FROM comp)"


def _folded(x: str) -> str:
    collapsed = f"regexp_replace({x}, {_q(_S + '+')}, ' ', 'g')"
    return f"lower({_strip(collapsed)})"


def clean_sql() -> str:
    """CTEs stripped and parsed (idx, stage, detail) of the clean style."""
    line = "regexp_split_to_array(translate(stripped, '*`', ''), " + _q(r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]") + ")"
    tidy = f"list_transform({line}, lambda x: {_strip('regexp_replace(' + _strip('x') + ', ' + _q('^_+|_+$') + ', ' + _q('') + ', ' + _q('g') + ')')})"
    found = lambda p, flags="(?s)": f"regexp_extract_all(t, {_q(flags + p)}, 1)"
    lines = lambda p: f"list_filter(list_transform(rows, lambda x: regexp_extract(x, {_q(p)}, 1)), lambda x: x <> '')"
    answer = f"list_distinct(list_concat(list_transform({found(r'(?:RESPUEST[AEO]|ANSWER)' + _S + r'*:' + _S + r'*' + _LETTER, '(?i)')}, lambda x: upper(x)), {lines('^' + _NW + '(?:RESPUESTA|ANSWER)' + _S + r'+\(?([ABC])\)?' + _NW + '$')}))"
    b = r"(?:^|[^0-9A-Za-z_\p{L}\p{M}\p{N}])"
    s = _S
    es = f"(?i:{b}(?:respuesta|opci[óo]n|alternativa)(?:{s}+[a-záéíóúñü]+){{0,4}}?{s}+(?:es|ser[íi]a|parece{s}+ser){s}*:?{s}*)" + _LETTER
    en = f"(?i:{b}(?:answer|option|choice)(?:{s}+[a-z]+){{0,4}}?{s}+(?:is|would{s}+be){s}*:?{s}*)" + _LETTER
    phrase = f"list_distinct(list_concat({found(es)}, {found(en)}))"
    r1 = f"(?i:{b}(?:se{s}+elige|se{s}+selecciona|elijo|escojo|selecciono|elegir[íi]a|me{s}+quedo{s}+con){s}+(?:la{s}+|el{s}+)?(?:opci[óo]n|alternativa|respuesta)?{s}*)" + _LETTER
    r2 = f"(?i:{b}i{s}+(?:choose|select|pick){s}+(?:option{s}+)?)" + _LETTER
    r3 = f"(?i:^{_NW}(?:la{s}+|the{s}+)?(?:opci[óo]n|option|alternativa){s}*:?{s}*)" + r"\(?([ABC])\)?(?:[.)]?" + _NW + ")$"
    option = f"list_distinct(list_concat({found(r1)}, {found(r2)}, {lines(r3)}))"
    strict = f"regexp_extract(coalesce(rows[-1], ''), {_q('(?i)^' + _NW + '(?:RESPUESTA|ANSWER)' + s + '*:' + s + r'*\(?([ABC])\)?' + _NW + '$')}, 1)"
    bare = f"regexp_extract(t, {_q(r'(?i)^\(?([ABC])\)?[.)]?$')}, 1)"
    present = "list_filter([0, 1, 2], lambda i: names[i + 1] <> '' AND contains(folded, names[i + 1]))"
    idx = lambda x: f"(ascii(upper({x})) - 65)"
    steps = [("t = ''", "NULL", "none", "no_match"), ("strict <> ''", idx("strict"), "strict", "last_line")]
    for col, detail in (("answer_l", "answer_line"), ("phrase_l", "answer_phrase"), ("option_l", "option_ref")):
        steps += [(f"len({col}) = 1", idx(f"{col}[1]"), "lenient", detail), (f"len({col}) > 1", "NULL", "none", "multiple_options")]
    steps += [("bare <> ''", idx("bare"), "lenient", "bare_letter"), (refusal("t"), "NULL", "none", "refusal_text")]
    steps += [("len(opts) = 1", "opts[1]", "lenient", "option_text"), ("len(opts) > 1", "NULL", "none", "multiple_options")]
    case = lambda k, last: "CASE " + " ".join(f"WHEN {x[0]} THEN {x[k] if k == 1 else _q(x[k])}" for x in steps) + f" ELSE {last} END"
    return f"""{stripped_sql()},
        tidy AS (SELECT *, list_aggregate({tidy}, 'string_agg', chr(10)) AS t, list_filter({tidy}, lambda x: x <> '') AS rows FROM stripped),
        seen AS (SELECT *, {_folded('t')} AS folded, [{_folded('c0')}, {_folded('c1')}, {_folded('c2')}] AS names, {strict} AS strict, {answer} AS answer_l, {phrase} AS phrase_l, {option} AS option_l, {bare} AS bare FROM tidy),
        pres AS (SELECT *, {present} AS pres FROM seen),
        opts AS (SELECT *, list_filter(pres, lambda i: len(list_filter(pres, lambda j: names[i + 1] <> names[j + 1] AND contains(names[j + 1], names[i + 1]))) = 0) AS opts FROM pres),
        parsed AS (SELECT *, CAST({case(1, 'NULL')} AS INTEGER) AS idx, {case(2, _q('none'))} AS stage, {case(3, _q('no_match'))} AS detail, chr(65 + CAST({case(1, 'NULL')} AS INTEGER)) AS answer FROM opts)"""


def paper_sql() -> str:
    """CTEs stripped and parsed of the published style."""
    steps = [("stripped = ''", "NULL", "none", "no_match")]
    for i in range(3):
        steps += [(f"stripped IN ('Option {i}: ' || c{i}, '{i}: ' || c{i}, '{i}')", str(i), "strict", "exact_form"), (f"c{i} <> '' AND contains(stripped, c{i})", str(i), "lenient", "option_text")]
    case = lambda k, last: "CASE " + " ".join(f"WHEN {x[0]} THEN {x[k] if k == 1 else _q(x[k])}" for x in steps) + f" ELSE {last} END"
    return f"{stripped_sql()}, parsed AS (SELECT *, CAST({case(1, 'NULL')} AS INTEGER) AS idx, {case(2, _q('none'))} AS stage, {case(3, _q('no_match'))} AS detail, CAST(CAST({case(1, 'NULL')} AS INTEGER) AS VARCHAR) AS answer FROM stripped)"


def routed_sql() -> str:
    outcome = f"CASE WHEN idx IS NOT NULL THEN 'answered' WHEN stripped = '' THEN 'no_response' WHEN stop_reason = 'content_filter' OR {refusal('stripped')} THEN 'refusal' ELSE 'invalid_response_format' END"
    return f"routed AS (SELECT *, {outcome} AS outcome, stage AS parse_stage, CASE idx WHEN 0 THEN 'target' WHEN 1 THEN 'other' WHEN 2 THEN 'unknown' END AS chosen_role, stop_reason IN ('max_tokens', 'model_length') AS was_truncated FROM parsed)"
