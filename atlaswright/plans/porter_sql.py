"""SQL of the suffix-stripping stemmer: common table expressions, a step each, over a table of distinct words."""

from __future__ import annotations

from atlaswright.functions.porter import STEP2, STEP3, STEP4


def _shape(e: str) -> str:
    """V for vowels, C for consonants; y is a vowel after a consonant."""
    x = f"regexp_replace(regexp_replace(regexp_replace({e}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(4):
        x = f"replace(replace({x}, 'Cy', 'CV'), 'Vy', 'VC')"
    return x


def _measure(e: str) -> str:
    return f"len(regexp_extract_all({_shape(e)}, 'VC'))"


def _cut(n: int, e: str = "s") -> str:
    return f"left({e}, length({e}) - {n})"


def _short(e: str) -> str:
    return f"(length({e}) > 2 AND ends_with({_shape(e)}, 'CVC') AND NOT regexp_matches({e}, '[wxy]$'))"


def _table(step: dict[str, str]) -> str:
    ordered = sorted(step, key=lambda x: -len(x))
    return "CASE " + " ".join(f"WHEN ends_with(s, '{x}') THEN CASE WHEN {_measure(_cut(len(x)))} > 0 THEN {_cut(len(x))} || '{step[x]}' ELSE s END" for x in ordered) + " ELSE s END"


def _fourth() -> str:
    ordered = sorted(STEP4, key=lambda x: -len(x))
    at = {x: f"{_measure(_cut(len(x)))} > 1" + (" AND regexp_matches(s, '[st]ion$')" if x == "ion" else "") for x in ordered}
    return "CASE " + " ".join(f"WHEN ends_with(s, '{x}') THEN CASE WHEN {at[x]} THEN {_cut(len(x))} ELSE s END" for x in ordered) + " ELSE s END"


STEMS = f"""
st1 AS (SELECT w, CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut(2, 'w')} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_cut(1, 'w')} ELSE w END AS s FROM st0 WHERE length(w) > 2),
st2 AS (SELECT w, s, CASE WHEN ends_with(s, 'eed') THEN CASE WHEN {_measure(_cut(3))} > 0 THEN -1 ELSE 0 END
  WHEN ends_with(s, 'ed') AND contains({_shape(_cut(2))}, 'V') THEN 2 WHEN ends_with(s, 'ing') AND contains({_shape(_cut(3))}, 'V') THEN 3 ELSE 0 END AS k FROM st1),
st3 AS (SELECT w, k, left(s, length(s) - abs(k)) AS s FROM st2),
st4 AS (SELECT w, CASE WHEN k < 1 THEN s WHEN regexp_matches(s, '(at|bl|iz)$') THEN s || 'e'
  WHEN length(s) > 1 AND right(s, 1) = left(right(s, 2), 1) AND ends_with({_shape('s')}, 'C') AND NOT regexp_matches(s, '[lsz]$') THEN {_cut(1)} WHEN {_measure('s')} = 1 AND {_short('s')} THEN s || 'e' ELSE s END AS s FROM st3),
st5 AS (SELECT w, CASE WHEN ends_with(s, 'y') AND contains({_shape(_cut(1))}, 'V') THEN {_cut(1)} || 'i' ELSE s END AS s FROM st4),
st6 AS (SELECT w, {_table(STEP2)} AS s FROM st5),
st7 AS (SELECT w, {_table(STEP3)} AS s FROM st6),
st8 AS (SELECT w, {_fourth()} AS s FROM st7),
st9 AS (SELECT w, CASE WHEN ends_with(s, 'e') AND ({_measure(_cut(1))} > 1 OR {_measure(_cut(1))} = 1 AND NOT {_short(_cut(1))}) THEN {_cut(1)} ELSE s END AS s FROM st8),
stems AS (SELECT w, CASE WHEN ends_with(s, 'll') AND {_measure('s')} > 1 THEN {_cut(1)} ELSE s END AS s FROM st9 UNION ALL SELECT w, w FROM st0 WHERE length(w) < 3)
"""
