"""English stop words and a Snowball English (Porter2) stemmer as an Arrow UDF."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The English stop words of the lexical index.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not",
    "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
# Words that the algorithm treats on their own.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAYS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP2 = (
    ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
VOWEL = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Patterns and ends are made once: most words are seen once, so what they cost is what a text costs.
AFTER_VOWEL, ANY_VOWEL, CONSONANT_Y = re.compile(f"[{VOWEL}][^{VOWEL}]"), re.compile(f"[{VOWEL}]"), re.compile(rf"(^|[{VOWEL}])y")
SHORT_END, SHORT_WORD = re.compile(rf"[^{VOWEL}][{VOWEL}][^{VOWEL}wxY]$"), re.compile(rf"[{VOWEL}][^{VOWEL}]")
POSSESSIVE, EED, PAST = re.compile(r"'s'$|'s$|'$"), re.compile(r"eed(ly)?$"), re.compile(r"(ed|ing)(ly)?$")
PAST_ENDS, ENDS2, ENDS3 = ("ed", "ing", "edly", "ingly"), tuple(s for s, _ in STEP2), tuple(s for s, _ in STEP3)


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)

    def after(at: int) -> int:
        m = AFTER_VOWEL.search(word, at)
        return m.end() if m else len(word)

    r1 = after(0) if start is None else start
    return r1, after(r1)


def _ends_short(word: str) -> bool:
    return bool(SHORT_END.search(word) or SHORT_WORD.fullmatch(word))


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = word.lstrip("'")
    if "y" in word:
        word = CONSONANT_Y.sub(r"\1Y", word)
    r1, r2 = _regions(word)
    if "'" in word:
        word = POSSESSIVE.sub("", word)
    # 1a: plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and ANY_VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in STAYS:
        return word
    # 1b: past and progressive forms
    past = word.endswith(PAST_ENDS)
    if past and (m := EED.search(word)):
        if m.start() >= r1:
            word = word[: m.start()] + "ee"
    elif past and (m := PAST.search(word)) and ANY_VOWEL.search(word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif len(word) <= r1 and _ends_short(word):
            word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWEL:
        word = word[:-1] + "i"
    # 2
    for suffix, instead in STEP2 if word.endswith(ENDS2) else ():
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r1:
                word = word[: -len(suffix)] + instead
            break
    else:
        if word.endswith("ogi") and len(word) - 3 >= r1 and word[-4:-3] == "l":
            word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] and word[-3] in "cdeghkmnrt":
            word = word[:-2]
    # 3
    for suffix, instead in STEP3 if word.endswith(ENDS3) else ():
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r1:
                word = word[: -len(suffix)] + instead
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= r2:
            word = word[:-5]
    # 4
    for suffix in STEP4 if word.endswith(STEP4) else ():
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r2:
                word = word[: -len(suffix)]
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in ("s", "t"):
            word = word[:-3]
    # 5
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _ends_short(word[:-1])) or word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda words: None if words is None else [stem(w) for w in words])
