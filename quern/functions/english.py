"""English words for full-text search: stop words and stems.

``stem`` follows the published Porter2 (English Snowball) algorithm: a word is cut at the ends that its
steps name, as long as they lie in the regions R1 and R2 of the word.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the algorithm's list.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both
each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
# Words with a stem of their own, and beginnings after which R1 starts.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
BEGINNINGS = ("gener", "commun", "arsen")
# Ends of the steps with what replaces them.
STEP_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
VOWELS, DOUBLES, LI = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
SHORT_END = re.compile(r"(^[aeiouy][^aeiouy]$)|([^aeiouy][aeiouy][^aeiouywxY]$)")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 start."""
    first = next((len(b) for b in BEGINNINGS if w.startswith(b)), None)
    after = lambda at: m.end() if (m := re.compile("[aeiouy][^aeiouy]").search(w, at)) else len(w)
    r1 = after(0) if first is None else first
    return r1, after(r1)


def _short(w: str, r1: int) -> bool:
    return r1 >= len(w) and bool(SHORT_END.search(w))


def _ends(w: str, table) -> str | None:
    return next((e for e in sorted(table, key=len, reverse=True) if w.endswith(e)), None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word of letters and digits."""
    w = word
    if len(w) <= 2 or w in SPECIAL:
        return SPECIAL.get(w, w)
    w = re.sub("(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in KEPT:
        return w
    # past forms
    end = _ends(w, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if end in ("eedly", "eed"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and re.search("[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _short(w, r1):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # derived forms
    end = _ends(w, [*STEP_2, "ogi", "li"])
    if end and len(w) - len(end) >= r1:
        if end in STEP_2:
            w = w[: -len(end)] + STEP_2[end]
        elif (end == "ogi" and w[-4:-3] == "l") or (end == "li" and w[-3:-2] and w[-3] in LI):
            w = w[:-1] if end == "ogi" else w[:-2]
    end = _ends(w, [*STEP_3, "ative"])
    if end and len(w) - len(end) >= r1:
        if end != "ative":
            w = w[: -len(end)] + STEP_3[end]
        elif len(w) - len(end) >= r2:
            w = w[: -len(end)]
    end = _ends(w, (*STEP_4, "ion"))
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    # last letters
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(words: Column) -> Column:
    """Stems of an array of words, in their places; stop words become empty."""
    stop = frozenset(STOP_WORDS)

    @F.pandas_udf("array<string>")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda ws: None if ws is None else ["" if w in stop else stem(w) for w in ws])

    return run(words)
