"""The derived tables of ``fixtures`` as common table expressions in plain SQL."""

from __future__ import annotations

from factrail.dims import SLOTS, SPEECH  # noqa: F401
from factrail.plans.fixtures import FX_VIEWS, N_CANDIDATES, PHRASES

_VIEWS = ", ".join(f"('{c}','{v}',{k},{s})" for c, v, k, s in FX_VIEWS)
_CANDS = ", ".join(f"({c})" for c in range(N_CANDIDATES))
_PHRASES = ", ".join("'" + p + "'" for p in PHRASES)


def _heard(text: str, num: str, view: int) -> str:
    k = f"(({num} * 31 + {view} * 7) % 6)"
    return (
        f"CASE {k} WHEN 0 THEN lower({text}) "
        f"WHEN 1 THEN replace(replace(lower({text}), ' and ', ' an '), ' is ', ' ') "
        f"WHEN 2 THEN replace(replace({text}, ' not ', ' '), 'kg', 'kilos') "
        f"WHEN 3 THEN 'well ' || replace({text}, 'The ', 'A ') "
        f"WHEN 4 THEN CASE WHEN {num} % 7 = 0 THEN '' ELSE replace(lower({text}), 'five', 'nine') END "
        f"ELSE {text} END"
    )


def _order_spoken(view: int) -> str:
    k = f"((item_id * 13 + cand_idx * 5 + {view} * 3) % 7)"
    return (
        f"CASE {k} WHEN 0 THEN plan_text "
        "WHEN 1 THEN replace(plan_text, ' of customer ', ' customer ') "
        "WHEN 2 THEN lower(replace(plan_text, '12 percent', 'twelve percent')) "
        "WHEN 3 THEN replace(replace(plan_text, ' has ', ' had the '), '12', '20') "
        "WHEN 4 THEN 'order ' || CAST(item_id AS VARCHAR) "
        "WHEN 5 THEN replace(plan_text, 'status', 'state') "
        "ELSE plan_text || ', you know.' END"
    )


_NUM = "(CAST(regexp_extract(item_id, '^([0-9]+)', 1) AS BIGINT) + length(item_id))"

FX: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_views": ((), f"SELECT * FROM (VALUES {_VIEWS}) AS t(condition, view, keep_pct, salt)"),
    "fx_base": ((), """SELECT DISTINCT l_orderkey AS item_id, 'm' || CAST(l_orderkey % 5 AS VARCHAR) AS model,
 CASE l_partkey % 5 WHEN 0 THEN 'number' WHEN 1 THEN 'unit' WHEN 2 THEN 'proper_noun'
      WHEN 3 THEN 'negation' ELSE 'content' END AS type,
 l_partkey AS v, CASE WHEN l_partkey % 5 = 3 THEN '-' ELSE '+' END AS polarity FROM lineitem"""),
    "fx_items": (("fx_base",), "SELECT DISTINCT item_id, model FROM fx_base"),
    "fx_observed": (("fx_items", "fx_views"), """SELECT i.item_id, i.model, c.condition, c.view
FROM fx_items i CROSS JOIN fx_views c
WHERE c.view IN ('text','internal') OR ((i.item_id * 7919 + c.salt * 104729) % 1000003) % 20 <> 0"""),
    "fx_raw": (("fx_base", "fx_views"), """SELECT b.item_id, b.model, c.condition, c.view, b.type, b.v, b.polarity,
 ((b.item_id * 2654435 + b.v * 40503 + c.salt * 69069) % 1000003) % 100 < c.keep_pct AS kept,
 b.type = 'number' AND (b.item_id * 31 + b.v * 17 + c.salt) % 3 = 0 AS drift,
 b.type = 'content' AND (b.item_id * 41 + b.v * 13 + c.salt) % 4 = 0 AS swap,
 b.type = 'negation' AND (b.item_id * 37 + b.v * 11 + c.salt) % 4 = 0 AS flip
FROM fx_base b CROSS JOIN fx_views c
WHERE c.view IN ('text','internal') OR ((b.item_id * 7919 + c.salt * 104729) % 1000003) % 20 <> 0"""),
    "fx_facts": (("fx_raw",), """SELECT DISTINCT item_id, model, condition, view, type,
 CAST(CASE WHEN kept OR flip THEN v ELSE v + 5 END AS VARCHAR) AS value,
 CASE WHEN NOT kept AND flip THEN '+' ELSE polarity END AS polarity
FROM fx_raw WHERE kept OR drift OR swap OR flip"""),
    "fx_flags": (("fx_items",), """SELECT item_id, model, (item_id * 13 + 7) % 4 <> 0 AS agree,
 CASE WHEN item_id % 17 <> 0 THEN CAST((item_id * 7919) % 41 AS DOUBLE) / 40 END AS wer FROM fx_items"""),
    "fx_grid": (("fx_items",), f"""SELECT item_id, model, cand_idx
FROM fx_items CROSS JOIN (VALUES {_CANDS}) AS t(cand_idx)"""),
    "fx_plan": (("fx_base",), "SELECT item_id, model, type, CAST(v AS VARCHAR) AS value, polarity FROM fx_base"),
    "fx_candidates": (("fx_base",), f"""SELECT DISTINCT item_id, model, cand_idx, view, type,
 CAST(CASE WHEN keep THEN v ELSE v + 5 END AS VARCHAR) AS value, polarity FROM (
 SELECT b.*, k.cand_idx, a.view,
  ((b.item_id * 2654435 + b.v * 40503 + k.cand_idx * 7919 + a.salt * 69069) % 1000003) % 100
     < CASE WHEN b.v % 7 = 0 THEN 12 ELSE 60 + (b.item_id * 7 + k.cand_idx * 13) % 35 END AS keep,
  b.type = 'number' AND (b.item_id * 31 + b.v * 17 + k.cand_idx * 3 + a.salt) % 3 = 0 AS drift
 FROM fx_base b CROSS JOIN (VALUES {_CANDS}) AS k(cand_idx)
 CROSS JOIN (VALUES ('asr1',11),('asr2',12),('asr3',13)) AS a(view, salt)) WHERE keep OR drift"""),
    "fx_durations": (("fx_grid",), """SELECT item_id, model, cand_idx,
 CASE WHEN (item_id + cand_idx) % 9 <> 0 THEN CAST(4 + (item_id * 3 + cand_idx * 5) % 11 AS DOUBLE) END AS duration
FROM fx_grid"""),
    "fx_text": ((), f"""SELECT concat_ws('-', o, n, q, p, s) AS item_id,
 CASE (o + n + s) % 6
 WHEN 0 THEN 'Order ' || o || ' weighs ' || q || ' kilograms, costs 5% more than ' || p || ' and Gold is not in group ' || s || '.'
 WHEN 1 THEN 'The sample of Au took ' || ph || ' and ' || q || '.5 kg. ' || (p * 1000 + s) || ' is not even, never was Hg.'
 WHEN 2 THEN 'It''s ' || ph || ', said Maria Lopez. The crocodile isn''t in class ' || s || '!'
 WHEN 3 THEN (p * 1001) || ' bytes or ' || q || ',250 grams? ' || ph || ' cannot be neon, except in New York.'
 WHEN 4 THEN 'No answer for ' || o || '. The value of NA is none, not ' || ph || '.'
 ELSE ph || ' and ' || q || ' km of copper wire; result: ' || s || '/' || (q + 1) || ' GB are excluding No ' || n || '.' END AS text
FROM (SELECT o, n, q, p, s, ([{_PHRASES}])[(p % {len(PHRASES)}) + 1] AS ph FROM (
 SELECT DISTINCT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS BIGINT) AS q,
  l_partkey AS p, l_suppkey AS s FROM lineitem))"""),
    "fx_heard": (("fx_text",), f"""SELECT item_id, text, {_heard('text', _NUM, 1)} AS asr1,
 {_heard('text', _NUM, 2)} AS asr2, {_heard('text', _NUM, 3)} AS asr3 FROM fx_text"""),
    "fx_order_text": ((), f"""SELECT *, {_order_spoken(1)} AS asr1, {_order_spoken(2)} AS asr2,
 {_order_spoken(3)} AS asr3 FROM (
 SELECT 'm' || CAST(o_orderkey % 5 AS VARCHAR) AS model, o_orderkey AS item_id,
 'Order ' || o_orderkey || ' of customer ' || o_custkey || ' has status ' || o_orderstatus || ' and costs 12 percent more' AS plan_text,
 cand_idx FROM orders CROSS JOIN (VALUES {_CANDS}) AS k(cand_idx))"""),
}


def with_fx(*names: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """'WITH ...' of the named derived tables and what they need, then the extra expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in FX[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({FX[n][1]})" for n in order]
    parts += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" if parts else ""
