"""Text normalisation and number forms as column expressions (no Python per row).

The functions take a column name or any SQL expression and return SQL text (``*_sql``) or a Column.
Word characters follow Unicode letters and digits. Patterns with word boundaries run on the *shadow*
of a text: every non-ASCII letter or digit becomes '_' (a word character for every regex engine) and
every Unicode space a plain one, so the boundaries are the same in any engine. Digits are ASCII.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from factrail.dims import DEFAULT_INSTRUCTION, READING_PROMPT
from factrail.functions import lexicon as L

SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_WORDS = r"[^\p{L}\p{N}_]+"  # runs of NOT_WORD and SPACE
NOT_SPACES = SPACE.replace("[", "[^", 1) + "+"
WIDE_LETTER = r"[^\x00-\x7F\P{L}]"
WIDE_DIGIT = r"[^\x00-\x7F\P{N}]"
WIDE_SPACE = r"[\x1c-\x1f\x{85}\p{Z}]"
PLAIN_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
MAX_DIGITS = 306


def q(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def q_array(values: list[str]) -> str:
    return "array(" + ", ".join(q(v) for v in values) + ")"


def q_map(values: dict[str, object]) -> str:
    return "map(" + ", ".join(f"{q(k)}, {q(v) if isinstance(v, str) else v}" for k, v in values.items()) + ")"


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def all_matches(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


def last_match(text: str, pattern: str, group: int = 0) -> str:
    return f"try_element_at({all_matches(text, pattern, group)}, -1)"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, {q(f'^{SPACE}+|{SPACE}+$')}, '')"


def shadow_sql(text: str) -> str:
    out = f"regexp_replace({text}, {q(WIDE_LETTER)}, '_')"
    out = f"regexp_replace({out}, {q(WIDE_DIGIT)}, '_')"
    out = f"regexp_replace({out}, {q(WIDE_SPACE)}, ' ')"
    return f"CASE WHEN {text} RLIKE {q('[^\\x00-\\x7F]|[\\x1c-\\x1f]')} THEN {out} ELSE {text} END"


def words_sql(text: str) -> str:
    return all_matches(text, NOT_SPACES)


# ---- numbers to words ----------------------------------------------------------------------

def integer_words_sql(digits: str) -> str:
    """English words of a string of digits; NULL beyond the largest scale word.

    Up to twelve digits are read off the words below a thousand at once, longer ones group by group.
    """
    return let("d", digits, let("i", "CASE WHEN length(d) <= 12 THEN try_cast(d AS BIGINT) END", (
        f"CASE WHEN i IS NULL THEN {_long_integer_words_sql('d')} WHEN i = 0 THEN 'zero' WHEN i < 1000 THEN {_below_thousand_sql('i')} ELSE "
        f"concat(concat_ws(', ', {', '.join(_scale_group_sql('i', at) for at in (3, 2, 1))}, CASE WHEN i % 1000 >= 100 THEN {_below_thousand_sql('i % 1000')} END), "
        f"CASE WHEN i % 1000 BETWEEN 1 AND 99 THEN concat(' and ', {_below_thousand_sql('i % 1000')}) ELSE '' END) END")))


def _below_thousand_sql(n: str) -> str:
    return f"element_at({q_array(L.words_below_thousand())}, CAST({n} AS INT) + 1)"


def _scale_group_sql(n: str, at: int) -> str:
    """Words of the group of three digits with the scale word number ``at``; NULL for 000."""
    size = 1000 ** at
    group = f"({n} div {size}L) % 1000"
    return f"CASE WHEN {n} >= {size}L AND {group} > 0 THEN concat({_below_thousand_sql(group)}, {q(' ' + L.scale_words()[at])}) END"


def _long_integer_words_sql(digits: str) -> str:
    n = "CAST(ceil(length(d) / 3.0) AS INT)"
    last = "element_at(g, -1)"
    body = (
        f"CASE WHEN length(d) > {MAX_DIGITS} THEN NULL WHEN d = '0' THEN 'zero' ELSE "
        + let("g", f"transform(sequence(1, {n}), i -> CAST(substring(lpad(d, {n} * 3, '0'), i * 3 - 2, 3) AS INT))",
              "concat(array_join(filter(transform(g, (v, i) -> CASE WHEN v = 0 OR (i = size(g) - 1 AND v < 100 AND size(g) > 1) THEN NULL "
              f"ELSE concat_ws(' ', element_at({q_array(L.words_below_thousand())}, v + 1), nullif(element_at({q_array(L.scale_words())}, size(g) - i), '')) END), "
              "w -> w IS NOT NULL), ', '), "
              f"CASE WHEN size(g) > 1 AND {last} > 0 AND {last} < 100 THEN concat(' and ', element_at({q_array(L.words_below_thousand())}, {last} + 1)) ELSE '' END)")
        + " END")
    return let("d", f"regexp_replace({digits}, '^0+(?=[0-9])', '')", body)


def number_words_sql(token: str) -> str:
    """Words of a digit token with optional decimals, which are read digit by digit."""
    ones = q_array(list(L.ONES)[:10])
    whole = integer_words_sql("substring_index(r, '.', 1)")
    frac = f"array_join(transform({all_matches("substring_index(r, '.', -1)", '[0-9]')}, c -> element_at({ones}, CAST(c AS INT) + 1)), ' ')"
    return let("r", f"replace({token}, ',', '')", let(
        "w", whole, f"CASE WHEN w IS NULL THEN r WHEN contains(r, '.') THEN concat(w, ' point ', {frac}) ELSE w END"))


def spell_numbers_sql(text: str) -> str:
    """Every digit token of a text replaced by its words; one scan cuts the text into tokens and what lies between."""
    words = f"CASE WHEN p >= '0' AND p < ':' THEN {number_words_sql('p')} ELSE p END"
    join = f"array_join(transform({all_matches('t', L.DIGITS + '|[^0-9]+')}, p -> {words}), '')"
    return let("t", text, f"CASE WHEN t RLIKE '[0-9]' THEN {join} ELSE t END")


def normalize_sql(text: str) -> str:
    """Lower case, percent and digits as words, no punctuation, single spaces; '' for NULL."""
    t = spell_numbers_sql(f"replace(lower(coalesce({text}, '')), '%', ' percent ')")
    return f"trim(regexp_replace({t}, {q(NOT_WORDS)}, ' '))"


def normalize_text(text: str) -> Column:
    return F.expr(normalize_sql(text))


def normalize_texts(*names: str) -> Column:
    """A struct of the normalised columns; those that differ in case alone are normalised once."""
    held = ", ".join(f"lower(coalesce({n}, ''))" for n in names)
    fields = ", ".join(f"'{n}', element_at(normed, CAST(array_position(texts, lows[{i}]) AS INT))" for i, n in enumerate(names))
    out = let("texts", "array_distinct(lows)", let("normed", f"transform(texts, y -> {normalize_sql('y')})", f"named_struct({fields})"))
    return F.expr(let("lows", f"array({held})", out))


def speakable_format(text: str) -> Column:
    return F.expr(spell_numbers_sql(text))


def speakable_sql(text: str) -> str:
    """One test whether the text holds a long unit word at all comes before the replacements."""
    out = "t"
    for word, parts in L.MORPHEMES.items():
        out = f"regexp_replace({out}, {q(rf'(?i)\b{word}s?\b')}, {q(parts)})"
    held = let("l", "lower(t)", " OR ".join(f"contains(l, {q(word)})" for word in L.MORPHEMES))
    return let("t", spell_numbers_sql(text), f"CASE WHEN {held} THEN {out} ELSE t END")


def speakable(text: str) -> Column:
    """Digits as words and long unit words in two parts."""
    return F.expr(speakable_sql(text))


def conversion_failures(text: str) -> Column:
    """ARRAY<STRUCT<integer_digits, token_prefix>> of number tokens too long to be read as words."""
    body = "named_struct('integer_digits', CAST(length(substring_index(k, '.', 1)) AS BIGINT), 'token_prefix', substring(k, 1, 40))"
    tokens = f"transform({all_matches(text, L.DIGITS)}, k -> replace(k, ',', ''))"
    long = f"length(regexp_replace(substring_index(k, '.', 1), '^0+(?=[0-9])', '')) > {MAX_DIGITS}"
    return F.expr(f"transform(filter({tokens}, k -> {long}), k -> {body})")


# ---- words to numbers ----------------------------------------------------------------------

def _fold_sql(text: str) -> str:
    """Value of plain number words ('two thousand five hundred'); NULL with an unknown word."""
    def state(total: str, cur: str, seen: str = "true", bad: str = "a.bad") -> str:
        return f"named_struct('total', {total}, 'cur', {cur}, 'seen', {seen}, 'bad', {bad})"

    small = "map(" + ", ".join(f"{q(k)}, {v}D" for k, v in {**L.ONES, **L.TENS}.items()) + ")"
    scale = "map(" + ", ".join(f"{q(k)}, {v}D" for k, v in L.SCALES.items() if v > 100) + ")"
    step = (
        f"CASE WHEN a.bad OR w = 'and' THEN a "
        f"WHEN element_at({small}, w) IS NOT NULL THEN {state('a.total', f'a.cur + element_at({small}, w)')} "
        f"WHEN w = 'hundred' THEN {state('a.total', '(CASE WHEN a.cur = 0D THEN 1D ELSE a.cur END) * 100D')} "
        f"WHEN element_at({scale}, w) IS NOT NULL THEN {state(f'a.total + (CASE WHEN a.cur = 0D THEN 1D ELSE a.cur END) * element_at({scale}, w)', '0D')} "
        f"ELSE {state('a.total', 'a.cur', 'a.seen', 'true')} END")
    return (
        f"aggregate({all_matches(text, r'\S+')}, {state('0D', '0D', 'false', 'false')}, (a, w) -> {step}, "
        "a -> CASE WHEN a.bad OR NOT a.seen THEN NULL ELSE a.total + a.cur END)")


def _phrase_sql(text: str) -> str:
    digits = (
        f"array_join(transform(filter({all_matches("substring(t, instr(t, 'point') + 5)", r'\S+')}, w -> element_at(" + ones_map() + ", w) IS NOT NULL), "
        "w -> CAST(element_at(" + ones_map() + ", w) AS STRING)), '')")
    whole = let("h", "trim(substring(t, 1, instr(t, 'point') - 1))",
                "CASE WHEN h IN ('a half', 'half', 'a quarter', 'quarter') THEN 0D ELSE " + _fold_sql("h") + " END")
    pointed = let("p", f"named_struct('w', {whole}, 'f', {digits})",
                  "CASE WHEN p.w IS NULL OR p.f = '' THEN NULL ELSE CAST(concat(CAST(CAST(p.w AS DECIMAL(38,0)) AS STRING), '.', p.f) AS DOUBLE) END")
    return let("t", text, (
        "CASE WHEN t IN ('a half', 'half') THEN 0.5D WHEN t IN ('a quarter', 'quarter') THEN 0.25D "
        f"WHEN contains(t, 'point') THEN {pointed} ELSE {_fold_sql('t')} END"))


def ones_map() -> str:
    return "map(" + ", ".join(f"{q(k)}, {v}" for k, v in L.ONES.items()) + ")"


def words_to_number_sql(text: str) -> str:
    """Value of spoken number words, also 'two point five' and 'two and a half'; NULL if not a number."""
    tail = r"\band\s+a\s+(half|quarter)\b"
    half = f"CASE regexp_extract(n, {q(tail)}, 1) WHEN 'half' THEN 0.5D ELSE 0.25D END"
    return let("n", f"trim(replace(lower({text}), '-', ' '))", (
        f"CASE WHEN n RLIKE {q(tail)} THEN coalesce({_phrase_sql(f'trim(regexp_replace(n, {q(tail)}, {q('')}))')}, 0D) + {half} "
        f"ELSE {_phrase_sql('n')} END"))


def words_to_number(text: str) -> Column:
    return F.expr(words_to_number_sql(text))


# ---- canonical forms -----------------------------------------------------------------------

def number_text_sql(value: str) -> str:
    """Integers without a decimal point, others with six significant digits; NULL unless finite."""
    # Half-even at the sixth significant digit.
    fixed = ("regexp_replace(format_string(concat('%.', CAST(5 - x AS STRING), 'f'), "
             "rint(v * pow(10D, 5 - x)) / pow(10D, 5 - x)), '[.]?0+$', '')")
    science = "concat(regexp_replace(substring_index(e, 'e', 1), '[.]?0+$', ''), 'e', substring_index(e, 'e', -1))"
    general = let("e", "format_string('%.5e', v)", let(
        "x", "CAST(substring_index(e, 'e', -1) AS INT)", f"CASE WHEN x = 5 THEN CAST(CAST(rint(v) AS BIGINT) AS STRING) WHEN x BETWEEN -4 AND 4 THEN {fixed} ELSE {science} END"))
    # Beyond a BIGINT the double is mantissa * 2^e: the mantissa is doubled e times in limbs of nine digits, so every digit is exact.
    twice = ("(acc, i) -> concat(transform(acc, (l, j) -> (l * 2) % 1000000000 + CASE WHEN j > 0 AND acc[j - 1] * 2 >= 1000000000 THEN 1 ELSE 0 END), "
             "CASE WHEN element_at(acc, -1) * 2 >= 1000000000 THEN array(1L) ELSE CAST(array() AS ARRAY<BIGINT>) END)")
    limbs = "array(b.m % 1000000000, (b.m div 1000000000) % 1000000000)"
    digits = "regexp_replace(array_join(transform(reverse(d), x -> lpad(CAST(x AS STRING), 9, '0')), ''), '^0+', '')"
    binary = let("e", "CAST(floor(log2(abs(v))) AS INT) - 54", let(
        "b", "named_struct('e', e, 'm', CAST(abs(v) / pow(2D, e) AS BIGINT))",
        f"concat(CASE WHEN v < 0 THEN '-' ELSE '' END, {let('d', f'aggregate(sequence(1, b.e), {limbs}, {twice})', digits)})"))
    whole = f"CASE WHEN abs(v) < 9.0e18D THEN CAST(CAST(v AS BIGINT) AS STRING) ELSE {binary} END"
    return let("v", value, (
        "CASE WHEN v IS NULL OR isnan(v) OR abs(v) = CAST('Infinity' AS DOUBLE) THEN NULL "
        f"WHEN abs(v - rint(v)) < 1e-9D THEN {whole} ELSE {general} END"))


def canon_number_sql(raw: str) -> str:
    double = number_text_sql(f"CASE WHEN s RLIKE {q(PLAIN_NUMBER)} THEN try_cast(s AS DOUBLE) END")
    whole = f"CASE WHEN length(s) <= 15 AND s RLIKE {q(r'^[0-9]+\z')} THEN CAST(CAST(s AS BIGINT) AS STRING) ELSE {double} END"
    return let("s", f"replace(regexp_replace(trim({raw}), '[.]+$', ''), ',', '')", whole)


def canon_number(raw: str) -> Column:
    return F.expr(canon_number_sql(raw))


def canon_name_sql(raw: str) -> str:
    return f"regexp_replace(lower({raw}), '[^a-z0-9]', '')"


def canon_content_sql(raw: str) -> str:
    """Lower case, no stop words, regular plurals folded."""
    tokens = f"filter({all_matches(f'lower({raw})', '[a-z0-9]+')}, w -> w NOT IN ({', '.join(q(w) for w in L.STOP_WORDS)}))"
    stem = (
        "CASE WHEN length(w) > 3 AND w LIKE '%ies' THEN concat(left(w, length(w) - 3), 'y') "
        "WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END")
    return f"array_join(transform({tokens}, w -> {stem}), ' ')"


def canon_content(raw: str) -> Column:
    return F.expr(canon_content_sql(raw))


def canon_unit(raw: str) -> Column:
    return F.expr(f"element_at({q_map(L.UNIT_OF)}, lower({raw}))")


# ---- record texts --------------------------------------------------------------------------

def text_hash(text: str) -> Column:
    return F.expr(f"substring(sha2(coalesce({text}, ''), 256), 1, 16)")


def _json_string(text: Column) -> Column:
    """A text as a JSON string of ASCII characters; characters beyond the basic plane become two surrogates."""
    # fixed values: the short escapes of JSON
    short = {'"': r'\"', "\\": r"\\", "\n": r"\n", "\r": r"\r", "\t": r"\t", "\b": r"\b", "\f": r"\f"}
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        out = F.when(code.between(32, 126), c).when(code < 0x10000, unit(code)).otherwise(
            F.concat(unit(F.floor((code - 0x10000) / 1024) + 0xD800), unit(code % 1024 + 0xDC00)))
        for plain, written in short.items():
            out = F.when(c == plain, F.lit(written)).otherwise(out)
        return out

    return F.concat(F.lit('"'), F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), escaped), ""), F.lit('"'))


def config_hash(settings: Mapping[str, Column], texts: Sequence[str] = ()) -> Column:
    """First 16 hex digits of the SHA-256 of flat settings as JSON with sorted keys.

    Settings named in ``texts`` are strings, the others integers or booleans; NULL is null.
    """
    pairs = []
    for name in sorted(settings):
        value = _json_string(settings[name]) if name in texts else settings[name].cast("string")
        pairs.append(F.concat(_json_string(F.lit(name)), F.lit(": "), F.coalesce(value, F.lit("null"))))
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}")), 256), 1, 16)


def item_instruction(text: str) -> Column:
    return F.expr(f"coalesce(nullif({strip_sql(text)}, ''), {q(DEFAULT_INSTRUCTION)})")


def strip_prompt_echo(text: str, markers: Sequence[str] = ("<|im_start|>assistant\n", "assistant\n", "assistant")) -> Column:
    """What follows the last of the first marker that the text holds, trimmed."""
    cases = " ".join(
        f"WHEN contains({text}, {q(m).replace(chr(10), chr(92) + 'n')}) THEN {strip_sql(f'substring_index({text}, {q(m).replace(chr(10), chr(92) + 'n')}, -1)')}"
        for m in markers)
    return F.expr(f"CASE {cases} ELSE {strip_sql(text)} END")


def clean_markers(text: str) -> Column:
    """Without special tokens and language tags, single spaces; '' for NULL."""
    t = f"regexp_replace(regexp_replace(coalesce({text}, ''), {q('<[|][^|]*[|]>')}, ' '), '<[^|>]{{0,8}}>', ' ')"
    return F.expr(f"trim(regexp_replace({t}, {q(SPACE + '+')}, ' '))")


def reading_prompt(text: str) -> Column:
    before, after = READING_PROMPT.split("{answer}")
    return F.concat(F.lit(before), F.expr(strip_sql(text)), F.lit(after))


def extraction_prompt(text: str, template: str) -> Column:
    """The request text for an external extractor; double quotes in the answer become single ones."""
    before, after = template.split("{answer}")
    return F.concat(F.lit(before), F.replace(F.expr(text), F.lit('"'), F.lit("'")), F.lit(after))


def contains_any(text: str, gold: str) -> Column:
    """Does the text hold any of the strings of an array column, ignoring case; NULL text is false."""
    return F.expr(f"coalesce(exists({gold}, g -> contains(lower({text}), lower(g))), false)")


def relative_position(text: str, value: str) -> Column:
    return F.expr(
        f"(nullif(instr(lower({text}), lower({value})), 0) - 1) / CAST(greatest(length({text}), 1) AS DOUBLE)")


def word_count(text: str) -> Column:
    return F.expr(f"CAST(size({words_sql(f'coalesce({text}, {q('')})')}) AS BIGINT)")


def category_of(item_id: str) -> Column:
    """Category from the prefix of an item id."""
    kinds = {"cont": "content", "num": "number", "unit": "unit", "neg": "negation", "name": "proper_noun"}
    return F.expr(f"coalesce(element_at({q_map(kinds)}, split_part({item_id}, '_', 1)), 'other')")


def format_value(value: str, digits: int = 4) -> Column:
    return F.expr(f"CASE WHEN {value} IS NULL THEN 'NA' ELSE format_string('%.{digits}f', {value}) END")
