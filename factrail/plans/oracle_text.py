"""SQL building blocks that restate the text functions for the check engine."""

from __future__ import annotations

from factrail.functions import answers as K
from factrail.functions import lexicon as L
from factrail.functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def matches(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


def last(text: str, pattern: str, group: int = 0) -> str:
    return f"{matches(text, pattern, group)}[-1]"


def shadow(text: str) -> str:
    out = f"regexp_replace({text}, {q(T.WIDE_LETTER)}, '_', 'g')"
    out = f"regexp_replace({out}, {q(T.WIDE_DIGIT)}, '_', 'g')"
    return f"regexp_replace({out}, {q(T.WIDE_SPACE)}, ' ', 'g')"


def int_words(digits: str) -> str:
    n = "CAST(ceil(length(d)/3.0) AS INT)"
    g = f"list_transform(range(1, {n}+1), lambda i: CAST(substr(lpad(d, {n}*3, '0'), CAST(i AS INT)*3-2, 3) AS INT))"
    small, scales = lst(L.words_below_thousand()), lst(L.scale_words())
    body = (f"array_to_string(list_filter(list_transform(g, lambda v, i: CASE WHEN v=0 OR (i=len(g) AND v<100 AND len(g)>1) THEN NULL "
            f"ELSE {small}[v+1] || CASE WHEN i=len(g) THEN '' ELSE ' ' || {scales}[len(g)-i+1] END END), lambda w: w IS NOT NULL), ', ') "
            f"|| CASE WHEN len(g)>1 AND g[-1]>0 AND g[-1]<100 THEN ' and ' || {small}[g[-1]+1] ELSE '' END")
    return let("d", f"regexp_replace({digits}, '^0+([0-9])', '\\1')",
               f"CASE WHEN length(d)>{T.MAX_DIGITS} THEN NULL WHEN d='0' THEN 'zero' ELSE {let('g', g, body)} END")


def num_words(tok: str) -> str:
    ones = lst(list(L.ONES)[:10])
    frac = f"array_to_string(list_transform(string_split(split_part(r,'.',2), ''), lambda c: {ones}[CAST(c AS INT)+1]), ' ')"
    return let("r", f"replace({tok}, ',', '')", let(
        "w", int_words("split_part(r,'.',1)"), f"CASE WHEN w IS NULL THEN r WHEN contains(r,'.') THEN w || ' point ' || {frac} ELSE w END"))


def spell(text: str) -> str:
    k = f"list_transform({matches('t', L.DIGITS)}, lambda tok: {num_words('tok')})"
    body = let("k", k, let("s", f"string_split_regex(t, {q(L.DIGITS)})",
               "array_to_string(list_transform(range(1, len(s)+1), lambda i: s[i] || coalesce(k[i], '')), '')"))
    return let("t", text, f"CASE WHEN regexp_matches(t, '[0-9]') THEN {body} ELSE t END")


def normalise(text: str) -> str:
    t = spell(f"replace(lower(coalesce({text}, '')), '%', ' percent ')")
    t = f"regexp_replace(replace({t}, '-', ' '), {q(T.NOT_WORD)}, ' ', 'g')"
    return f"trim(regexp_replace({t}, {q(T.SPACE + '+')}, ' ', 'g'))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, {q(f'^{T.SPACE}+|{T.SPACE}+$')}, '', 'g')"


def _mapping(m: dict) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v) if isinstance(v, str) else v}" for k, v in m.items()) + "}"


def fold(text: str) -> str:
    small = _mapping({k: f"{v}.0::DOUBLE" for k, v in {**L.ONES, **L.TENS}.items()}).replace("'0.0", "0.0")
    small = "MAP {" + ", ".join(f"{q(k)}: {v}::DOUBLE" for k, v in {**L.ONES, **L.TENS}.items()) + "}"
    scale = "MAP {" + ", ".join(f"{q(k)}: {v}::DOUBLE" for k, v in L.SCALES.items() if v > 100) + "}"

    def st(total, cur, seen, bad, w="''"):
        return f"{{'t': {total}, 'c': {cur}, 's': {seen}, 'b': {bad}, 'w': {w}}}"

    toks = f"list_transform(list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> ''), lambda w: {st('0::DOUBLE', '0::DOUBLE', 'false', 'false', 'w')})"
    one = "(CASE WHEN a.c=0 THEN 1::DOUBLE ELSE a.c END)"
    step = (f"CASE WHEN a.b OR x.w='and' THEN a WHEN {small}[x.w] IS NOT NULL THEN {st('a.t', f'a.c+{small}[x.w]', 'true', 'false')} "
            f"WHEN x.w='hundred' THEN {st('a.t', f'{one}*100', 'true', 'false')} "
            f"WHEN {scale}[x.w] IS NOT NULL THEN {st(f'a.t+{one}*{scale}[x.w]', '0::DOUBLE', 'true', 'false')} "
            f"ELSE {st('a.t', 'a.c', 'a.s', 'true')} END")
    init = st("0::DOUBLE", "0::DOUBLE", "false", "false")
    return let("z", f"list_reduce(list_prepend({init}, {toks}), lambda a, x: {step})", "CASE WHEN z.b OR NOT z.s THEN NULL ELSE z.t+z.c END")


def phrase(text: str) -> str:
    ones = "MAP {" + ", ".join(f"{q(k)}: '{v}'" for k, v in L.ONES.items()) + "}"
    digits = f"array_to_string(list_filter(list_transform(string_split_regex(substr(t, instr(t,'point')+5), '\\s+'), lambda w: {ones}[w]), lambda w: w IS NOT NULL), '')"
    whole = let("h", "trim(substr(t, 1, instr(t,'point')-1))", f"CASE WHEN h IN ('a half','half','a quarter','quarter') THEN 0::DOUBLE ELSE {fold('h')} END")
    pointed = let("p", f"{{'w': {whole}, 'f': {digits}}}",
                  "CASE WHEN p.w IS NULL OR p.f='' THEN NULL ELSE CAST(CAST(CAST(p.w AS HUGEINT) AS VARCHAR) || '.' || p.f AS DOUBLE) END")
    return let("t", text, f"CASE WHEN t IN ('a half','half') THEN 0.5::DOUBLE WHEN t IN ('a quarter','quarter') THEN 0.25::DOUBLE WHEN contains(t,'point') THEN {pointed} ELSE {fold('t')} END")


def words_number(text: str) -> str:
    tail = r"\band\s+a\s+(half|quarter)\b"
    half = f"CASE WHEN regexp_extract(n, {q(tail)}, 1)='half' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END"
    base = f"trim(regexp_replace(n, {q(tail)}, '', 'g'))"
    return let("n", f"trim(replace(lower({text}), '-', ' '))",
               f"CASE WHEN regexp_matches(n, {q(tail)}) THEN coalesce({phrase(base)}, 0) + {half} ELSE {phrase('n')} END")


def number_text(value: str) -> str:
    return let("v", value, "CASE WHEN v IS NULL OR NOT isfinite(v) THEN NULL WHEN abs(v - round_even(v, 0)) < 1e-9 THEN CAST(CAST(trunc(v) AS HUGEINT) AS VARCHAR) ELSE format('{:g}', v) END")


def canon_number(raw: str) -> str:
    return number_text(let("s", f"replace(regexp_replace(trim({raw}), '[.]+$', ''), ',', '')",
                           f"CASE WHEN regexp_matches(s, {q(T.PLAIN_NUMBER)}) THEN TRY_CAST(s AS DOUBLE) END"))


def canon_name(raw: str) -> str:
    return f"regexp_replace(lower({raw}), '[^a-z0-9]', '', 'g')"


def canon_content(raw: str) -> str:
    toks = f"list_filter(string_split_regex(regexp_replace(lower({raw}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> '' AND NOT list_contains({lst(L.STOP_WORDS)}, w))"
    stem = "CASE WHEN length(w)>3 AND w LIKE '%ies' THEN left(w, length(w)-3) || 'y' WHEN length(w)>3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w)-1) ELSE w END"
    return f"array_to_string(list_transform({toks}, lambda w: {stem}), ' ')"


def rules_ctes(source: str) -> dict[str, str]:
    """Long rule facts, one expression per rule, from a relation (item_id, text)."""
    symbols = "MAP {" + ", ".join(f"{q(n)}: {q(s)}" for s, n in L.ELEMENT_NAMES.items()) + "}"
    names = _mapping(L.ELEMENT_NAMES)
    glued = "regexp_replace(s, '([0-9_])([A-Za-z]{3,})', '\\1\\2' || chr(1), 'g')"
    pattern = f"(?i:{L.CUES})|{L.DIGITS}|(?i:{L.NUMBER_WORDS})|{L.SYMBOL}|[A-Za-z]{{3,}}\\x01?"
    cue = "lower(w) IN (" + ", ".join(q(c) for c in L.NEGATION_CUES) + ")"
    number_word = "lower(regexp_extract(w, '^[A-Za-z]+')) IN (" + ", ".join(q(k) for k in (*L.ONES, *L.TENS, *L.SCALES)) + ")"
    sym = f"length(w) <= 2 AND list_contains({lst(L.ELEMENT_SYMBOLS)}, w)"
    out = {
        "sh": f"SELECT item_id, {shadow('coalesce(text, chr(32))')} AS s FROM {source}",
        "r_numbers": f"""SELECT DISTINCT item_id, 'number' AS type, value, '+' AS polarity FROM (
 SELECT item_id, {canon_number('k')} AS value FROM (SELECT item_id, unnest({matches('s', L.DIGITS)}) AS k FROM sh)
 UNION ALL SELECT item_id, {number_text(words_number('k'))} FROM (SELECT item_id, unnest({matches('s', '(?i)' + L.NUMBER_WORDS)}) AS k FROM sh)) WHERE value IS NOT NULL""",
        "r_units": f"""SELECT DISTINCT item_id, 'unit' AS type, value, '+' AS polarity FROM (
 SELECT item_id, {_mapping(L.UNIT_OF)}[lower(u)] AS value FROM (SELECT item_id, unnest({matches('s', '(?i)' + L.UNIT)}) AS u FROM sh)
 UNION ALL SELECT item_id, 'percent' FROM sh WHERE contains(s, '%')) WHERE value IS NOT NULL""",
        "r_symbols": f"""SELECT DISTINCT item_id, 'proper_noun' AS type, unnest(list_filter([lower(k), {names}[lower(k)]], lambda v: v IS NOT NULL)) AS value, '+' AS polarity
 FROM (SELECT item_id, unnest({matches('s', L.SYMBOL)}) AS k FROM sh) WHERE list_contains({lst(L.ELEMENT_SYMBOLS)}, k)""",
        "r_element_names": f"""SELECT DISTINCT item_id, 'proper_noun' AS type, unnest([k, {symbols}[k]]) AS value, '+' AS polarity
 FROM (SELECT item_id, unnest({matches('lower(s)', r'\b[a-z]{3,12}\b')}) AS k FROM sh) WHERE {symbols}[k] IS NOT NULL""",
        "cap": f"SELECT item_id, generate_subscripts(k, 1) AS i, unnest(k) AS w FROM (SELECT item_id, {matches('s', r'[A-Za-z][a-zA-Z]+|[.!?]' + chr(92) + 's+')} AS k FROM sh)",
        "cap2": "SELECT *, lag(w) OVER (PARTITION BY item_id ORDER BY i) AS prev FROM cap",
        "r_capitalised": "SELECT DISTINCT item_id, 'proper_noun' AS type, lower(w) AS value, '+' AS polarity FROM cap2 WHERE prev IS NOT NULL AND regexp_matches(w, '^[A-Z]') AND NOT regexp_matches(prev, '^[.!?]')",
        "tk": f"SELECT item_id, generate_subscripts(k, 1) AS i, unnest(k) AS w FROM (SELECT item_id, {matches(glued, pattern)} AS k FROM sh WHERE regexp_matches(s, {q('(?i)' + L.CUES)}))",
        "tk2": f"""SELECT item_id, i, {cue} AS cue, CASE WHEN regexp_matches(w, '^[0-9]') THEN {canon_number('w')} WHEN {cue} OR NOT {number_word} THEN NULL ELSE {number_text(words_number('w'))} END AS num,
 CASE WHEN {sym} THEN lower(w) END AS sym, {last('w', '[A-Za-z]{3,}')} AS word FROM tk""",
        "tk3": """SELECT *, CASE WHEN num IS NOT NULL THEN {'t': 'number', 'v': num} WHEN sym IS NOT NULL THEN {'t': 'proper_noun', 'v': sym} END AS cand FROM tk2""",
        "tk4": """SELECT item_id, cue, last_value(cand IGNORE NULLS) OVER w AS c, last_value(word IGNORE NULLS) OVER w AS word FROM tk3
 WINDOW w AS (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        "r_negations": f"""SELECT DISTINCT item_id, type, value, polarity FROM (
 SELECT item_id, 'negation' AS type, coalesce(c.v, {canon_name('word')}) AS value, '-' AS polarity FROM tk4 WHERE cue AND (c.v IS NOT NULL OR word IS NOT NULL)
 UNION ALL SELECT item_id, c.t, c.v, '+' FROM tk4 WHERE cue AND c.v IS NOT NULL)""",
    }
    rules = ("numbers", "units", "negations", "symbols", "element_names", "capitalised")
    out["r_all"] = " UNION ".join(f"SELECT * FROM r_{r}" for r in rules)
    out["r_core"] = " UNION ".join(f"SELECT * FROM r_{r}" for r in rules[:3])
    return out


def codes(words: str) -> str:
    return f"array_to_string(list_transform({words}, lambda w: chr(CAST(33 + list_position(v, w) AS INT))), '')"


def distance(a: str, b: str) -> str:
    return let("p", f"{{'a': {a}, 'b': {b}}}", let("v", "list_distinct(list_concat(p.a, p.b))",
               f"CASE WHEN len(p.a)=0 OR len(p.b)=0 THEN greatest(len(p.a), len(p.b)) ELSE levenshtein({codes('p.a')}, {codes('p.b')}) END"))


def tokens(norm: str) -> str:
    return f"list_filter(string_split({norm}, ' '), lambda w: w <> '')"


def wer(ref: str, hyp: str) -> str:
    return f"CASE WHEN coalesce({ref},'')='' OR coalesce({hyp},'')='' THEN NULL ELSE CAST({distance(tokens(ref), tokens(hyp))} AS DOUBLE)/len({tokens(ref)}) END"


def similarity(a: str, b: str) -> str:
    return let("y", f"{{'a': {a}, 'b': {b}}}", f"CASE WHEN len(y.a)=0 AND len(y.b)=0 THEN 1.0::DOUBLE ELSE 1.0 - CAST({distance('y.a', 'y.b')} AS DOUBLE)/greatest(len(y.a), len(y.b)) END")


def numeric_answer(text: str) -> str:
    found = f"coalesce({last('t', K.BOXED, 1)}, {last('t', K.CUED, 1)}, {last('t', K.HASHED, 1)}, {last('t', K.NUM)})"
    return let("t", f"replace(replace({text}, '−', '-'), '–', '-')", f"replace({found}, ' ', '')")


def label(text: str, task: str) -> str:
    opt = (f"CASE WHEN regexp_matches(t, {q(K.OPTION_ALONE)}) THEN '(' || upper(regexp_extract(t, {q(K.OPTION_ALONE)}, 1)) || ')' "
           f"WHEN regexp_matches(t, {q(K.OPTION_PAREN)}) THEN '(' || upper({last('t', K.OPTION_PAREN, 1)}) || ')' ELSE '(' || upper({last('t', K.OPTION_CUED, 1)}) || ')' END")
    return let("t", strip(text), f"CASE WHEN {task}='hyperbaton' THEN {opt} ELSE lower({last('t', K.YES_NO, 1)}) END")


def numeric_equal(a: str, b: str) -> str:
    part = lambda x, i: f"TRY_CAST(split_part({x} || '/1', '/', {i}) AS DECIMAL(18,4))"
    clean = lambda x: f"replace(replace({x}, ',', ''), ' ', '')"
    cross = f"{part('r.a', 2)} <> 0 AND {part('r.b', 2)} <> 0 AND {part('r.a', 1)}*{part('r.b', 2)} = {part('r.b', 1)}*{part('r.a', 2)}"
    return let("r", f"{{'a': {clean(a)}, 'b': {clean(b)}}}", f"coalesce({cross}, false)")
