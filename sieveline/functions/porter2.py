"""The English (Porter2) stemmer, after the published description of the Snowball algorithm."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
#: Words with stems of their own, and words that stay as they are (fixed values).
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _region(word: str, begin: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    found = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, begin)
    return found.end() if found else len(word)


def _ends(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def stem(word: str) -> str:
    """The stem of a lower-cased word."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.removeprefix("'")
    word = re.sub(f"(^|[{VOWELS}])y", lambda m: m[1] + "Y", word)
    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), "")
    r1 = len(prefix) or _region(word, 0)
    r2 = _region(word, r1)

    for s in ("'s'", "'s", "'"):
        if word.endswith(s):
            word = word[: -len(s)]
            break
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{VOWELS}]", word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    # 1b
    end = _ends(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and re.search(f"[{VOWELS}]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif _short_end(word) and r1 >= len(word):
            word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # 2
    end = _ends(word, (*STEP_2, "ogi", "li"))
    if end and len(word) - len(end) >= r1:
        if end in STEP_2:
            word = word[: -len(end)] + STEP_2[end]
        elif end == "ogi" and word.endswith("logi"):
            word = word[:-1]
        elif end == "li" and len(word) > 2 and word[-3] in LI_ENDINGS:
            word = word[:-2]
    # 3
    end = _ends(word, (*STEP_3, "ative"))
    if end and len(word) - len(end) >= r1:
        if end in STEP_3:
            word = word[: -len(end)] + STEP_3[end]
        elif len(word) - len(end) >= r2:
            word = word[: -len(end)]
    # 4
    end = _ends(word, (*STEP_4, "ion"))
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
