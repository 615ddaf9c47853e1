"""Stemmers by language name.

`english` is the published algorithm of Porter (1980). The others are rules as
data, which one small interpreter applies: German, Swedish, Norwegian and Danish
as they are published with the Snowball language. A step takes the longest
suffix that it knows in a word; if that one's conditions do not hold, the word
stays as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Suffixes of the steps 2 to 4 of the published algorithm, longest first within an ending.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c and v for consonants and vowels; y is a vowel behind a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        end = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
        if end:
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(word, table)
        if s and _measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + table[s]
    s = _longest(word, _STEP4)
    if s and _measure(word[: -len(s)]) > 1 and (s != "ion" or word[: -len(s)].endswith(("s", "t"))):
        word = word[: -len(s)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _cvc(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


# ---- rules as data

@dataclass(frozen=True)
class Rule:
    """What happens to a word that ends in one of some suffixes."""

    suffixes: str
    #: letters of the suffix that stay
    keep: int = 0
    #: pattern that what stands before the suffix must end in
    before: str = ""
    #: r1, r2 or word: where the whole suffix must lie; the step's if empty
    region: str = ""
    #: letters that the whole word must have before the suffix
    least: int = 0
    #: what may come off as well after that, each at its own turn
    then: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class Step:
    rules: tuple[Rule, ...]
    region: str = "r1"
    #: suffixes are looked for in the region alone, or in the word and then held against the region
    within: bool = True


@dataclass(frozen=True)
class Rules:
    vowels: str
    steps: tuple[Step, ...]
    #: (pattern, replacement) before and after; each is applied until nothing changes
    first: tuple[tuple[str, str | Callable], ...] = ()
    last: tuple[tuple[str, str | Callable], ...] = ()


def _replaced(word: str, changes: tuple) -> str:
    for pattern, to in changes:
        while (new := re.sub(pattern, to, word, count=1)) != word:
            word = new
    return word


def _regions(word: str, vowels: str) -> dict[str, int]:
    """Where the regions begin: behind the first consonant after a vowel, three letters in at least, and behind the next such one."""
    found = [m.end() for m in re.finditer(f"[{vowels}]+[^{vowels}]", word)]
    if len(word) < 3 or not found:
        return {"word": 0, "r1": len(word), "r2": len(word)}
    return {"word": 0, "r1": max(3, found[0]), "r2": found[1] if len(found) > 1 else len(word)}


def _fits(word: str, suffix: str, rule: Rule, start: int) -> bool:
    at = len(word) - len(suffix)
    return at >= start and at >= rule.least and (not rule.before or re.search(f"(?:{rule.before})$", word[:at]) is not None)


def _applied(word: str, rule: Rule, suffix: str, regions: dict[str, int], region: str) -> str:
    if not _fits(word, suffix, rule, regions[rule.region or region]):
        return word
    word = word[: len(word) - len(suffix) + rule.keep]
    for more in rule.then:
        end = _longest(word, more.suffixes.split())
        if end and _fits(word, end, more, regions[more.region or region]):
            return _applied(word, more, end, regions, region)
    return word


def by_rules(word: str, rules: Rules) -> str:
    """The stem of a lower-case word."""
    word = _replaced(word, rules.first)
    regions = _regions(word, rules.vowels)
    for step in rules.steps:
        known = {s: r for r in step.rules for s in r.suffixes.split()}
        end = _longest(word[regions[step.region] :] if step.within else word, known)
        if end:
            word = _applied(word, known[end], end, regions, step.region)
    return _replaced(word, rules.last)


# The published rules of the Snowball stemmers for German, Swedish, Norwegian and Danish.
GERMAN = Rules(
    "aeiouyäöü",
    (
        Step((Rule("em ern er"), Rule("e en es", then=(Rule("niss", keep=3, region="word"),)), Rule("s", before="[bdfghklmnrt]")), within=False),
        Step((Rule("en er est"), Rule("st", before="[bdfghklmnt]", least=4)), within=False),
        Step((
            Rule("end ung", then=(Rule("ig", before="(?:^|[^e])"),)), Rule("ig ik isch", before="(?:^|[^e])"),
            Rule("lich heit", then=(Rule("er en", region="r1"),)), Rule("keit", then=(Rule("lich ig"),)),
        ), "r2", within=False),
    ),
    first=(("ß", "ss"), ("(?<=[aeiouyäöü])[uy](?=[aeiouyäöü])", lambda m: m[0].upper())),
    last=(("[UY]", lambda m: m[0].lower()), ("ä", "a"), ("ö", "o"), ("ü", "u")),
)
SWEDISH = Rules("aeiouyäåö", (
    Step((Rule("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast"), Rule("s", before="[bcdfghjklmnoprtvy]"))),
    Step((Rule("dd gd nn dt gt kt tt", keep=1),)),
    Step((Rule("lig ig els"), Rule("löst", keep=3), Rule("fullt", keep=4))),
))
NORWEGIAN = Rules("aeiouyæåø", (
    Step((
        Rule("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast"),
        Rule("s", before="[bcdfghjlmnoprtvyz]|(?:^|[^aeiouyæåø])k"), Rule("erte ert", keep=2),
    )),
    Step((Rule("dt vt", keep=1),)),
    Step((Rule("leg eleg ig eig lig elig els lov elov slov hetslov"),)),
))
_DANISH_PAIRS = Step((Rule("gd dt gt kt", keep=1),))
DANISH = Rules("aeiouyæåø", (
    Step((
        Rule("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret"),
        Rule("s", before="[abcdfghjklmnoprtvyzå]"),
    )),
    _DANISH_PAIRS,
    Step((Rule("igst", keep=2),), "word"),
    Step((Rule("ig lig elig els", then=(Rule("gd dt gt kt", keep=1),)), Rule("løst", keep=3))),
    Step((Rule(" ".join(2 * c for c in "bcdfghjklmnpqrstvwxz"), keep=1),)),
))

#: By name; more can be registered.
STEMMERS: dict[str, Callable[[str], str]] = {"english": porter} | {
    name: partial(by_rules, rules=rules) for name, rules in (("german", GERMAN), ("swedish", SWEDISH), ("norwegian", NORWEGIAN), ("danish", DANISH))
}


def stemmer(language: str) -> Callable[[Column], Column] | None:
    """A column function for a language; None for `none`. A worker stems a distinct word of a batch once."""
    if language in ("none", "", None):
        return None
    if language not in STEMMERS:
        raise ValueError(f"unknown stemmer: {language}")
    one = STEMMERS[language]

    @F.pandas_udf(StringType())
    def stemmed(words: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(words)
        return pd.Series([one(w) for w in distinct], dtype=object).take(codes).reset_index(drop=True) if len(distinct) else words

    return stemmed
