"""Snowball stems (English and French) as staged SQL expressions.

Written from the published Snowball descriptions.  Each stage finds the longest
ending of its group with one regex and replaces it by table, given the starts
of the word's regions (``p1``, ``p2``, ``pv``).  The stages are plain columns,
so the stemmer runs inside the JVM and no word ever visits Python.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SparkDialect:
    """How Spark SQL spells the few calls the stages use."""

    @staticmethod
    def like(value: str, pattern: str) -> str:
        return f"regexp_like({value}, '{pattern}')"

    @staticmethod
    def sub(value: str, pattern: str, template: str) -> str:
        """Replace every match; ``$1`` and ``$2`` name groups."""
        return f"regexp_replace({value}, '{pattern}', '{template}')"

    @staticmethod
    def found(value: str, pattern: str) -> str:
        """Group 1 of the first match, or ''."""
        return f"regexp_extract({value}, '{pattern}', 1)"

    @staticmethod
    def table(key: str, rows: dict[str, str]) -> str:
        return f"element_at(map({', '.join(f'{_q(k)}, {_q(v)}' for k, v in rows.items())}), {key})"


def _q(value: str) -> str:
    return f"'{value}'"


def _ending(words) -> str:
    """Pattern of the longest listed ending: the leftmost match is the longest."""
    return "(" + "|".join(words) + ")$"


def _cut(extra: int = 0, add: str = "''") -> str:
    """Drop the found ending and ``extra`` letters before it."""
    return f"concat(left(w, length(w) - length(suf) - {extra}), {add})"


def _in(region: str, extra: int = 0) -> str:
    return f"length(w) - length(suf) - {extra} >= {region}"


def _before(d, pattern: str) -> str:
    """The text before the ending ends with ``pattern``."""
    return d.like("left(w, length(w) - length(suf))", f"({pattern})$")


def _case(*branches: tuple[str, str], otherwise: str = "w") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {otherwise} END"


def _region(d, value: str, pattern: str, offset: str = "0") -> str:
    """Start of the region after the first match, or the end of the word."""
    got = d.found(value, pattern)
    return f"CASE WHEN {got} = '' THEN length(w) ELSE {offset} + length({got}) END"


# --- English ---------------------------------------------------------------

_EV = "aeiouy"
_E_AFTER = f"[^{_EV}]*[{_EV}]+[^{_EV}]"
_E_SHORT = f"([^{_EV}][{_EV}][^{_EV}wxY]$|^[{_EV}][^{_EV}]$)"

# Irregular English words.
_E_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_E_KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")

# English endings and what replaces them.
_E_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
_E_STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
_E_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def english_stages(d) -> list[dict[str, str]]:
    """Stages over raw, w, p1, p2, suf and x (the answer, once it is settled)."""
    kept = ", ".join(_q(w) for w in _E_KEPT)
    irregular = ", ".join(_q(w) for w in _E_IRREGULAR)
    e_short = d.like("left(w, length(w) - 1)", _E_SHORT)
    return [
        {"w": d.sub("CASE WHEN raw LIKE 'y%' THEN concat('Y', substring(raw, 2)) ELSE raw END",
                    f"([{_EV}])y", "$1Y"),
         "x": f"CASE WHEN length(raw) <= 2 THEN raw WHEN raw IN ({irregular}) "
              f"THEN {d.table('raw', _E_IRREGULAR)} END"},
        {"p1": _region(d, "w", f"^(gener|commun|arsen|{_E_AFTER})"),
         "suf": d.found("w", "(sses|ied|ies|us|ss|s)$")},
        {"p2": _region(d, "substring(w, p1 + 1)", f"^({_E_AFTER})", "p1"),
         "w": _case(
             ("suf = 'sses'", "left(w, length(w) - 2)"),
             ("suf IN ('ied', 'ies')", "left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)"),
             (f"suf = 's' AND {d.like('w', f'[{_EV}].+s$')}", "left(w, length(w) - 1)"))},
        {"x": f"CASE WHEN x IS NULL AND w IN ({kept}) THEN w ELSE x END",
         "suf": d.found("w", "(eedly|eed|ingly|edly|ing|ed)$")},
        {"w": _case(("suf LIKE 'eed%'", _case((_in("p1"), _cut(0, "'ee'")))),
                    (f"suf <> '' AND {_before(d, f'[{_EV}].*')}", _cut(0, "'~'")))},
        {"w": _case(
            (d.like("w", "(at|bl|iz)~$"), "concat(left(w, length(w) - 1), 'e')"),
            (d.like("w", "(bb|dd|ff|gg|mm|nn|pp|rr|tt)~$"), "left(w, length(w) - 2)"),
            (f"w LIKE '%~' AND p1 >= length(w) - 1 AND {e_short}", "concat(left(w, length(w) - 1), 'e')"),
            ("w LIKE '%~'", "left(w, length(w) - 1)"))},
        {"w": _case((d.like("w", f"^.+[^{_EV}][yY]$"), "concat(left(w, length(w) - 1), 'i')"))},
        {"suf": d.found("w", _ending(_E_STEP2))},
        {"w": _case((f"suf <> '' AND {_in('p1')} AND (suf <> 'ogi' OR w LIKE '%logi') "
                     f"AND (suf <> 'li' OR {d.like('w', '[cdeghkmnrt]li$')})",
                     _cut(0, d.table("suf", _E_STEP2))))},
        {"suf": d.found("w", _ending(_E_STEP3))},
        {"w": _case((f"suf <> '' AND {_in('p1')} AND (suf <> 'ative' OR {_in('p2')})",
                     _cut(0, d.table("suf", _E_STEP3))))},
        {"suf": d.found("w", _ending(_E_STEP4))},
        {"w": _case((f"suf <> '' AND {_in('p2')} AND (suf <> 'ion' OR {d.like('w', '[st]ion$')})", _cut()))},
        {"w": _case(
            (f"w LIKE '%e' AND (length(w) - 1 >= p2 OR (length(w) - 1 >= p1 AND NOT {e_short}))",
             "left(w, length(w) - 1)"),
            ("w LIKE '%ll' AND length(w) - 1 >= p2", "left(w, length(w) - 1)"))},
        {"w": "coalesce(x, lower(w))"},
    ]


# --- French ----------------------------------------------------------------

_FV = "aeiouyâàëéêèïîôûù"
_F_AFTER = f"[^{_FV}]*[{_FV}]+[^{_FV}]"

# French endings by the rule that handles them.
_F_GROUPS = {
    "plain": "ance iqUe isme able iste eux ances iqUes ismes ables istes",
    "agent": "atrice ateur ation atrices ateurs ations",
    "log": "logie logies",
    "u": "usion ution usions utions",
    "ent": "ence ences",
    "ement": "ement ements",
    "ite": "ité ités",
    "if": "if ive ifs ives",
    "eaux": "eaux",
    "aux": "aux",
    "euse": "euse euses",
    "isse": "issement issements",
    "amment": "amment",
    "emment": "emment",
    "ment": "ment ments",
}
_F_VERB_I = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons "
    "iront is issaIent issais issait issant issante issantes issants isse issent isses issez "
    "issiez issions issons it"
).split()
_F_VERB_E = (
    "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
).split()
_F_VERB_A = (
    "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"
).split()


def french_stages(d) -> list[dict[str, str]]:
    """Stages over raw, w, p1, p2, pv, suf, kind, w0 (word before a step), alt (altered)."""
    group_of = {s: g for g, words in _F_GROUPS.items() for s in words.split()}

    def before(pattern: str) -> str:
        return _before(d, pattern)

    def between(letter: str, marked: str) -> str:
        # Twice, because neighbouring matches share a vowel.
        pattern, template = f"([{_FV}]){letter}([{_FV}])", f"$1{marked}$2"
        return d.sub(d.sub("w", pattern, template), pattern, template)

    def inside(region: str, extra: int, value: str, otherwise: str = "w") -> str:
        return _case((_in(region, extra), value), otherwise=otherwise)

    ement = _case(
        (f"{before('ativ')} AND {_in('p2', 4)}", _cut(4)),
        (f"{before('iv')} AND {_in('p2', 2)}", _cut(2)),
        (f"{before('eus')} AND {_in('p2', 3)}", _cut(3)),
        (f"{before('eus')} AND {_in('p1', 3)}", _cut(3, "'eux'")),
        (f"{before('abl|iqU')} AND {_in('p2', 3)}", _cut(3)),
        (f"{before('[iI]èr')} AND {_in('pv', 3)}", _cut(3, "'i'")),
        otherwise=_cut())
    ite = _case(
        (before("abil"), inside("p2", 4, _cut(4), _cut(4, "'abl'"))),
        (before("ic"), inside("p2", 2, _cut(2), _cut(2, "'iqU'"))),
        (f"{before('iv')} AND {_in('p2', 2)}", _cut(2)),
        otherwise=_cut())
    if_ = _case(
        (f"{before('icat')} AND {_in('p2', 2)}", inside("p2", 4, _cut(4), _cut(4, "'iqU'"))),
        (f"{before('at')} AND {_in('p2', 2)}", _cut(2)),
        otherwise=_cut())
    agent = _case((before("ic"), inside("p2", 2, _cut(2), _cut(2, "'iqU'"))), otherwise=_cut())
    step1 = _case(
        ("kind IS NULL", "w"),
        ("kind = 'plain'", inside("p2", 0, _cut())),
        ("kind = 'agent'", inside("p2", 0, agent)),
        ("kind IN ('log', 'u', 'ent')", inside("p2", 0, _cut(0, "kind"))),
        ("kind = 'ement'", inside("pv", 0, ement)),
        ("kind = 'ite'", inside("p2", 0, ite)),
        ("kind = 'if'", inside("p2", 0, if_)),
        ("kind = 'eaux'", "left(w, length(w) - 1)"),
        ("kind = 'aux'", inside("p1", 0, _cut(0, "'al'"))),
        ("kind = 'euse'", inside("p2", 0, _cut(), inside("p1", 0, _cut(0, "'eux'")))),
        (f"kind = 'isse' AND {_in('p1')} AND {before(f'[^{_FV}]')}", _cut()),
        (f"kind = 'amment' AND {_in('pv')}", _cut(0, "'ant'")),
        (f"kind = 'emment' AND {_in('pv')}", _cut(0, "'ent'")),
        (f"kind = 'ment' AND {_in('pv', 1)} AND {before(f'[{_FV}]')}", _cut()))
    verb_e = "|".join(_F_VERB_E)
    return [
        {"w": d.sub("raw", "qu", "qU")},
        {"w": between("u", "U")},
        {"w": between("i", "I")},
        {"w": d.sub(d.sub("w", f"([{_FV}])y", "$1Y"), f"y([{_FV}])", "Y$1")},
        {"p1": _region(d, "w", f"^({_F_AFTER})"),
         "pv": f"CASE WHEN {d.like('w', '^(par|col|tap)')} THEN 3 "
               f"WHEN {d.like('w', f'^[{_FV}][{_FV}]')} THEN least(3, length(w)) "
               f"ELSE {_region(d, 'w', f'^(.[^{_FV}]*[{_FV}])')} END",
         "suf": d.found("w", _ending(group_of))},
        {"p2": _region(d, "substring(w, p1 + 1)", f"^({_F_AFTER})", "p1"), "w0": "w",
         "kind": f"CASE WHEN suf <> '' THEN {d.table('suf', group_of)} END"},
        {"w": step1},
        # The adverb endings go on to the verb endings even when they were replaced.
        {"alt": "CASE WHEN w <> w0 AND kind NOT IN ('amment', 'emment', 'ment') THEN 1 ELSE 0 END",
         "w0": "w", "suf": d.found("substring(w, pv + 1)", _ending(_F_VERB_I))},
        {"w": _case((f"alt = 0 AND suf <> '' AND {_in('pv', 1)} AND {before(f'[^{_FV}]')}", _cut()))},
        {"go": "CASE WHEN alt = 0 AND w = w0 THEN 1 ELSE 0 END",
         "alt": "CASE WHEN w <> w0 THEN 1 ELSE alt END", "w0": "w",
         "suf": d.found("substring(w, pv + 1)", _ending(["ions"] + _F_VERB_E + _F_VERB_A))},
        {"w": _case(
            ("go = 0 OR suf = ''", "w"),
            ("suf = 'ions'", inside("p2", 0, _cut())),
            (f"{d.like('suf', f'^({verb_e})$')}", _cut()),
            (f"{before('e')} AND {_in('pv', 1)}", _cut(1)),
            otherwise=_cut())},
        {"alt": "CASE WHEN w <> w0 THEN 1 ELSE alt END"},
        {"w": _case(
            ("alt = 1 AND w LIKE '%Y'", "concat(left(w, length(w) - 1), 'i')"),
            ("alt = 1 AND w LIKE '%ç'", "concat(left(w, length(w) - 1), 'c')"),
            (f"alt = 0 AND {d.like('w', '[^aiouès]s$')}", "left(w, length(w) - 1)"))},
        {"suf": d.found("substring(w, pv + 1)", "(ion|ière|Ière|ier|Ier|e|ë)$")},
        {"w": _case(
            ("alt = 1 OR suf = ''", "w"),
            ("suf = 'ion'", _case((f"{_in('p2')} AND {_in('pv', 1)} AND {before('[st]')}", _cut()))),
            ("suf = 'e'", _cut()),
            ("suf = 'ë'", _case((before("gu"), _cut()))),
            otherwise=_cut(0, "'i'"))},
        {"w": _case((d.like("w", "(enn|onn|ett|ell|eill)$"), "left(w, length(w) - 1)"))},
        {"w": f"lower({d.sub('w', f'[éè]([^{_FV}]+)$', 'e$1')})"},
    ]


# --- Spark rendering ---------------------------------------------------------

def _staged(source: str, prefix: str, stages: list[dict[str, str]]) -> str:
    """Nested selects that add the stages as ``<prefix><field>`` to ``source``."""
    fields = ["raw"]
    for stage in stages:
        known = re.compile(r"(?<![\w'~])(" + "|".join(fields) + r")(?![\w'(])")
        new = ", ".join(f"{known.sub(prefix + chr(92) + '1', e)} AS {prefix}{n}" for n, e in stage.items())
        old = ", ".join(prefix + n for n in stage if n in fields)
        source = f"(SELECT *{f' EXCEPT ({old})' if old else ''}, {new} FROM {source})"
        fields = list(dict.fromkeys(fields + list(stage)))
    drop = ", ".join(prefix + n for n in fields if n != "w")
    return f"(SELECT * EXCEPT ({drop}) FROM {source})"


def with_stem(df: DataFrame, token: str, language: str, out: str = "stem") -> DataFrame:
    """Add the stem of ``token``: French rules for French, English for all else.

    Narrow: columns only, no shuffle.  A word goes through one rule set; the
    other sees null and costs next to nothing.
    """
    french = F.col(language).eqNullSafe("french")
    df = df.withColumns({
        "_en_raw": F.when(~french, F.lower(token)),
        "_fr_raw": F.when(french, F.lower(token)),
    })
    staged = _staged(_staged("{words}", "_en_", english_stages(SparkDialect)), "_fr_",
                     french_stages(SparkDialect))
    df = df.sparkSession.sql(f"SELECT * FROM {staged}", words=df)
    # A generator ends the chain: a filter on the stem must not be pushed below
    # it, where every use of a stage would be written out again.
    stem = F.explode(F.array(F.coalesce("_en_w", "_fr_w"))).alias(out)
    return df.select(*[c for c in df.columns if c not in ("_en_w", "_fr_w")], stem)
