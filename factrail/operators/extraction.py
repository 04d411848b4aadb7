"""Rule extraction of atomic facts: narrow column expressions, one pass over each text, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factrail.functions import lexicon as L
from factrail.functions import text as T

FACT_ARRAY = "array<struct<type:string,value:string,polarity:string>>"


def _fact(kind: str, value: str, polarity: str = "'+'") -> str:
    return f"named_struct('type', {kind}, 'value', {value}, 'polarity', {polarity})"


def numbers_sql(s: str) -> str:
    digits = f"transform({T.all_matches(s, L.DIGITS)}, k -> {T.canon_number_sql('k')})"
    spoken = f"transform({T.all_matches(s, '(?i)' + L.NUMBER_WORDS)}, k -> {T.number_text_sql(T.words_to_number_sql('k'))})"
    values = f"filter(array_distinct(concat({digits}, {spoken})), v -> v IS NOT NULL)"
    return f"transform({values}, v -> {_fact(T.q('number'), 'v')})"


def units_sql(s: str, min_unit_len: int = 1) -> str:
    """Unit facts; the percent sign counts without word boundaries. Short forms can be left out.

    A form of one word is a whole run of word characters, so one tokenisation and a hashed test find all of them; only
    a text that holds a form of several words or with a mark is scanned for the longest form at each place.
    """
    single = [u for u in L.UNIT_OF if u.isascii() and u.isalpha()]
    several = " OR ".join(f"contains(l, {T.q(u)})" for u in L.UNIT_OF if u.isascii() and not u.isalpha() and u != "%")
    forms = T.let("l", f"lower({s})", (
        f"CASE WHEN {several} THEN {T.all_matches('l', L.UNIT)} ELSE filter({T.all_matches('l', '[a-z0-9_]+')}, u -> u IN ({', '.join(T.q(u) for u in single)})) END"))
    if min_unit_len > 1:
        forms = f"filter({forms}, u -> length(u) >= {min_unit_len})"
    values = (
        f"array_distinct(concat(transform({forms}, u -> element_at({T.q_map(L.UNIT_OF)}, u)), "
        f"CASE WHEN contains({s}, '%') THEN array('percent') ELSE array() END))")
    return f"transform({values}, v -> {_fact(T.q('unit'), 'v')})"


def symbols_sql(s: str) -> str:
    names = T.q_map(L.ELEMENT_NAMES)
    known = f"filter(array_distinct({T.all_matches(s, L.SYMBOL)}), k -> array_contains({T.q_array(L.ELEMENT_SYMBOLS)}, k))"
    both = f"flatten(transform({known}, k -> filter(array(lower(k), element_at({names}, lower(k))), v -> v IS NOT NULL)))"
    return f"transform({both}, v -> {_fact(T.q('proper_noun'), 'v')})"


def element_names_sql(s: str) -> str:
    symbols = T.q_map({name: symbol for symbol, name in L.ELEMENT_NAMES.items()})
    known = (
        f"filter(array_distinct({T.all_matches(f'lower({s})', r'\b[a-z]{3,12}\b')}), "
        f"k -> element_at({symbols}, k) IS NOT NULL)")
    return f"transform(flatten(transform({known}, k -> array(k, element_at({symbols}, k)))), v -> {_fact(T.q('proper_noun'), 'v')})"


def capitalised_sql(s: str) -> str:
    """Capitalised words that do not open a sentence: the token before is a word."""
    names = T.let("k", T.all_matches(s, r"[A-Za-z][a-zA-Z]+|[.!?]\s+"), (
        "filter(k, (w, i) -> i > 0 AND w RLIKE '^[A-Z]' AND NOT coalesce(get(k, i - 1) RLIKE '^[.!?]', true))"))
    return f"transform(array_distinct(transform({names}, w -> lower(w))), v -> {_fact(T.q('proper_noun'), 'v')})"


def negations_sql(s: str) -> str:
    """For every cue the nearest number or symbol before it, else the last word before it.

    One scan yields cues, numbers, number words, symbols and plain words in text order; a fold keeps
    the last candidate and the last word. A word glued to a digit or underscore carries a mark, so
    that it is never read as a number word. Plain words are most of what is folded: they only become the last word, and
    skip every other test.
    """
    glued = f"regexp_replace({s}, {T.q('(?<=[0-9_])([A-Za-z]{3,})')}, {T.q('$1')} || chr(1))"
    pattern = f"(?i:{L.CUES})|{L.DIGITS}|(?i:{L.NUMBER_WORDS})|{L.SYMBOL}|[A-Za-z]{{3,}}\\x01?"
    cues = ", ".join(f"\"{c}\"" for c in L.NEGATION_CUES)
    cue = f"lower(w) IN ({cues})"
    symbol = f"length(w) <= 2 AND array_contains({T.q_array(L.ELEMENT_SYMBOLS)}, w)"
    number_word = ", ".join(T.q(k) for k in (*L.ONES, *L.TENS, *L.SCALES))
    found = (
        f"CASE WHEN a.value IS NOT NULL THEN array({_fact(T.q('negation'), 'a.value', T.q('-'))}, {_fact('a.type', 'a.value')}) "
        f"WHEN a.word IS NOT NULL THEN array({_fact(T.q('negation'), T.canon_name_sql('a.word'), T.q('-'))}) ELSE array() END")

    def state(kind: str = "a.type", value: str = "a.value", word: str = "a.word", out: str = "a.out") -> str:
        return f"named_struct('type', {kind}, 'value', {value}, 'word', {word}, 'out', {out})"

    last = f"coalesce({T.last_match('w', '[A-Za-z]{3,}')}, a.word)"
    named = (f"CASE WHEN {symbol} THEN 'proper_noun' ELSE a.type END", f"CASE WHEN {symbol} THEN lower(w) ELSE a.value END")
    read = lambda n, word: T.let("n", n, f"CASE WHEN n IS NULL THEN {state(*named, word)} ELSE {state(T.q('number'), 'n', word)} END")
    step = (
        f"CASE WHEN w >= '0' AND w < ':' THEN {read(T.canon_number_sql('w'), 'a.word')} "
        f"WHEN length(w) >= 3 AND lower(w) NOT IN ({cues}, {number_word}) AND w RLIKE {T.q('^[A-Za-z]+' + chr(92) + 'z')} THEN {state(word='w')} "
        f"WHEN {cue} THEN {state(*named, last, f'concat(a.out, {found})')} "
        f"WHEN lower(regexp_extract(w, '^[A-Za-z]+', 0)) NOT IN ({number_word}) THEN {state(*named, last)} "
        f"ELSE {read(T.number_text_sql(T.words_to_number_sql('w')), last)} END")
    start = f"named_struct('type', CAST(NULL AS STRING), 'value', CAST(NULL AS STRING), 'word', CAST(NULL AS STRING), 'out', CAST(array() AS {FACT_ARRAY}))"
    fold = f"aggregate({T.all_matches(glued, pattern)}, {start}, (a, w) -> {step}, a -> a.out)"
    return f"CASE WHEN {s} RLIKE {T.q('(?i)' + L.CUES)} THEN {fold} ELSE CAST(array() AS {FACT_ARRAY}) END"


RULES = {
    "numbers": numbers_sql, "units": units_sql, "negations": negations_sql, "symbols": symbols_sql,
    "element_names": element_names_sql, "capitalised": capitalised_sql,
}
NAME_RULES = ("symbols", "element_names", "capitalised")


def extract_facts(
    df: DataFrame, text: str, *, out: str = "facts", rules: tuple[str, ...] | None = None, with_names: bool = True,
) -> DataFrame:
    """Adds ``out``: the sorted distinct facts that the rules find in ``text`` (empty for NULL)."""
    chosen = rules or tuple(r for r in RULES if with_names or r not in NAME_RULES)
    shadowed = df.withColumn("_shadow", F.expr(T.shadow_sql(f"coalesce({text}, '')")))
    parts = ", ".join(f"CAST({RULES[r]('_shadow')} AS {FACT_ARRAY})" for r in chosen)
    return shadowed.withColumn(out, F.expr(f"array_sort(array_distinct(concat({parts})))")).drop("_shadow")


def facts_long(df: DataFrame, keys: list[str], facts: str = "facts", *, distinct: bool = True) -> DataFrame:
    """One row per fact; a missing polarity is '+'.

    ``distinct=False`` saves the shuffle where keys are unique and every array is free of repeats,
    as ``extract_facts`` leaves it. The outer form with a test of its element keeps the optimizer from inferring a
    filter on the array, which would compute the whole extraction once more below.
    """
    rows = df.select(*keys, F.explode_outer(facts).alias("f")).where("f IS NOT NULL")
    out = rows.select(*keys, "f.type", "f.value", F.coalesce("f.polarity", F.lit("+")).alias("polarity"))
    return out.distinct() if distinct else out


def parse_model_output(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``facts_llm`` and ``llm_error`` from the JSON an external extractor returned.

    Elements of ``facts`` are parsed one by one, so one that is no object costs no other; the object must be all there is
    between the first and the last brace.
    """
    schema = "facts array<string>, _bad string"
    body = F.expr(f"regexp_extract({raw}, '(?s)[{{].*[}}]', 0)")
    parsed = df.withColumn("_json", body).withColumn(
        "_p", F.from_json("_json", schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    canon = (
        f"CASE k WHEN 'number' THEN {T.canon_number_sql('f.value')} WHEN 'proper_noun' THEN {T.canon_name_sql('f.value')} "
        f"WHEN 'content' THEN {T.canon_content_sql('f.value')} WHEN 'unit' THEN lower(trim(f.value)) WHEN 'negation' THEN lower(trim(f.value)) END")
    one = T.let("k", "lower(trim(f.type))", T.let("c", canon, (
        "CASE WHEN coalesce(c, '') <> '' THEN named_struct('type', k, 'value', c, 'polarity', "
        "CASE WHEN startswith(trim(coalesce(f.polarity, '+')), '-') THEN '-' ELSE '+' END) END")))
    objects = "transform(filter(coalesce(_p.facts, array()), e -> startswith(trim(e), '{')), e -> from_json(e, 'type string, value string, polarity string'))"
    facts = f"array_sort(array_distinct(filter(transform({objects}, f -> {one}), f -> f IS NOT NULL)))"
    error = (
        f"CASE WHEN coalesce({raw}, '') = '' THEN 'empty output' WHEN _json = '' THEN concat('no JSON object in output: ', substring({raw}, 1, 120)) "
        "WHEN _p IS NULL OR _p._bad IS NOT NULL OR coalesce(json_array_length(concat('[', _json, ']')), 0) <> 1 THEN 'json decode error' END")
    return (
        parsed.withColumn("llm_error", F.expr(error))
        .withColumn("facts_llm", F.expr(f"CASE WHEN llm_error IS NULL THEN {facts} ELSE CAST(array() AS {FACT_ARRAY}) END"))
        .drop("_json", "_p")
    )
