"""The published French stemming algorithm in SQL, for comparison. Words are accent-free.

Written from the published description: marking by a fold over the letters, regions by the lengths of leading
patterns, each step as one CASE.
"""

from __future__ import annotations

from quaestor.functions.stemming import A_VERB_ENDINGS, I_VERB_ENDINGS, PLAIN_VERB_ENDINGS, STEP_1_ENDINGS, VOWELS

_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"
_LETTERS = ", ".join(f"'{x}'" for x in VOWELS)


def _end(x: str, endings) -> str:
    return f"regexp_extract({x}, '(?:{'|'.join(endings)})$')"


def _cut(x: str, n) -> str:
    return f"left({x}, length({x}) - {n})"


def _region(pattern: str) -> str:
    found = f"length(regexp_extract(m, '{pattern}'))"
    return f"CASE WHEN {found} > 0 THEN {found} ELSE length(m) END"


def _is(*endings: str) -> str:
    return f"e IN ({', '.join(repr(x) for x in endings)})"


def _if_ends(*cases: tuple[str, str]) -> str:
    """Of the first ending that b has, its value; b as it is if there is none."""
    return "CASE " + " ".join(f"WHEN ends_with(b, '{ending}') THEN {value}" for ending, value in cases) + " ELSE b END"


def _deep(n: int, then: str, otherwise: str) -> str:
    """``then`` if the last n letters of b stand in the second region."""
    return f"CASE WHEN n - {n} >= p2 THEN {then} ELSE {otherwise} END"


_QUE = "left(b, n - 4) || 'iqU'"
_IC = _deep(2, "left(b, n - 2)", "left(b, n - 2) || 'iqU'")
_AT_IC = f"CASE WHEN ends_with(b, 'icat') THEN {_deep(4, 'left(b, n - 4)', _QUE)} ELSE left(b, n - 2) END"
_AT_IV = f"CASE WHEN ends_with(b, 'ativ') THEN {_deep(4, 'left(b, n - 4)', 'left(b, n - 2)')} ELSE left(b, n - 2) END"
_EUS = "CASE WHEN n - 3 >= p2 THEN left(b, n - 3) WHEN n - 3 >= p1 THEN left(b, n - 3) || 'eux' ELSE b END"
_ABL = _deep(3, "left(b, n - 3)", "b")
_EMENT = _if_ends(("iv", _deep(2, _AT_IV, "b")), ("eus", _EUS), ("abl", _ABL), ("iqU", _ABL))

_STANDARD = f"""CASE
  WHEN {_is('ance', 'ances', 'iqUe', 'iqUes', 'isme', 'ismes', 'able', 'ables', 'iste', 'istes', 'eux')} AND n >= p2 THEN b
  WHEN {_is('atrice', 'atrices', 'ateur', 'ateurs', 'ation', 'ations')} AND n >= p2 THEN {_if_ends(('ic', _IC))}
  WHEN {_is('logie', 'logies')} AND n >= p2 THEN b || 'log'
  WHEN {_is('usion', 'usions', 'ution', 'utions')} AND n >= p2 THEN b || 'u'
  WHEN {_is('ence', 'ences')} AND n >= p2 THEN b || 'ent'
  WHEN {_is('ement', 'ements')} AND n >= pv THEN {_EMENT}
  WHEN {_is('if', 'ifs', 'ive', 'ives')} AND n >= p2 THEN {_if_ends(('at', _deep(2, _AT_IC, 'b')))}
  WHEN {_is('eaux')} THEN b || 'eau'
  WHEN {_is('aux')} AND n >= p1 THEN b || 'al'
  WHEN {_is('euse', 'euses')} AND n >= p2 THEN b
  WHEN {_is('euse', 'euses')} AND n >= p1 THEN b || 'eux'
  WHEN {_is('issement', 'issements')} AND n >= p1 AND regexp_matches(b, '{_C}$') THEN b END"""

_TO_VERBS = f"""CASE
  WHEN {_is('amment')} AND n >= pv THEN b || 'ant' WHEN {_is('emment')} AND n >= pv THEN b || 'ent'
  WHEN {_is('ment', 'ments')} AND n - 1 >= pv AND regexp_matches(b, '{_V}$') THEN b END"""


def stems(source: str) -> str:
    """CTEs that end in ``stems`` (word, stem), for the words of ``source`` (a table with a column word)."""
    return f"""
letters AS (SELECT DISTINCT word, list_transform(range(1, length(word) + 1), lambda i: substr(word, i, 3)) AS x FROM {source}),
marked AS (
  SELECT word, list_reduce(list_prepend('', x), lambda a, c: a || CASE
      WHEN right(a, 1) IN ({_LETTERS}) AND c[1] IN ('u', 'i') AND c[2] IN ({_LETTERS}) THEN upper(c[1])
      WHEN c[1] = 'y' AND right(a, 1) IN ({_LETTERS}) THEN 'Y'
      WHEN c[1] = 'y' AND c[2] IN ({_LETTERS}) AND c[2] <> 'y' AND NOT (c[2] IN ('u', 'i') AND c[3] IN ({_LETTERS})) THEN 'Y'
      WHEN c[1] = 'u' AND right(a, 1) = 'q' THEN 'U' ELSE c[1] END) AS m
  FROM letters
), regions AS (
  SELECT word, m, {_region(f'^(?:{_V}{_V}.|par|col|tap|.{_C}*{_V})')} AS pv, {_region(f'^{_C}*{_V}+{_C}')} AS p1,
    {_region(f'^{_C}*{_V}+{_C}{_C}*{_V}+{_C}')} AS p2, {_end('m', STEP_1_ENDINGS)} AS e
  FROM marked
), bases AS (SELECT *, {_cut('m', 'length(e)')} AS b, length(m) - length(e) AS n FROM regions),
standard AS (
  SELECT *, {_STANDARD} AS r1, {_TO_VERBS} AS f1 FROM bases
), verbs AS (
  SELECT word, pv, p2, r1, coalesce(r1, f1, m) AS w, substr(coalesce(r1, f1, m), pv + 1) AS rv FROM standard
), verb_ends AS (
  SELECT *, {_end('rv', I_VERB_ENDINGS)} AS e2, {_end('rv', ['ions', *PLAIN_VERB_ENDINGS, *A_VERB_ENDINGS])} AS e3 FROM verbs
), without_i AS (
  SELECT *, CASE WHEN r1 IS NULL AND e2 <> '' AND regexp_matches({_cut('rv', 'length(e2)')}, '{_C}$') THEN {_cut('w', 'length(e2)')} END AS r2 FROM verb_ends
), without_verb AS (
  SELECT word, pv, p2, w, coalesce(r1, r2, CASE
      WHEN e3 = 'ions' THEN CASE WHEN length(w) - 4 >= p2 THEN {_cut('w', 4)} END
      WHEN e3 IN ({', '.join(repr(x) for x in PLAIN_VERB_ENDINGS)}) THEN {_cut('w', 'length(e3)')}
      WHEN e3 <> '' AND ends_with({_cut('rv', 'length(e3)')}, 'e') THEN {_cut('w', '(length(e3) + 1)')}
      WHEN e3 <> '' THEN {_cut('w', 'length(e3)')} END) AS altered
  FROM without_i
), rest AS (
  SELECT word, pv, p2, altered IS NOT NULL AS done,
    CASE WHEN altered IS NOT NULL THEN regexp_replace(altered, 'Y$', 'i') WHEN regexp_matches(w, '[^aious]s$') THEN {_cut('w', 1)} ELSE w END AS w
  FROM without_verb
), tails AS (SELECT *, substr(w, pv + 1) AS rv FROM rest),
residual AS (
  SELECT word, CASE WHEN done THEN w
    WHEN ends_with(rv, 'ion') THEN CASE WHEN regexp_matches(rv, '[st]ion$') AND length(w) - 3 >= p2 THEN {_cut('w', 3)} ELSE w END
    WHEN ends_with(rv, 'ier') OR ends_with(rv, 'Ier') THEN {_cut('w', 3)} || 'i'
    WHEN ends_with(rv, 'e') THEN {_cut('w', 1)} ELSE w END AS w
  FROM tails
), stems AS MATERIALIZED (
  SELECT word, CASE WHEN regexp_matches(word, '^[0-9]') THEN word
    ELSE translate(CASE WHEN regexp_matches(w, '(?:enn|onn|ett|ell|eill)$') THEN {_cut('w', 1)} ELSE w END, 'IUY', 'iuy') END AS stem
  FROM residual
)"""
