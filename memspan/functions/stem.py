"""English stemming by the published Porter2 rules, for the stemmed analyzer.

The index stems each distinct word of a task once; a query's few terms are stemmed on the
driver.
"""

from __future__ import annotations

import re

V = "aeiouy"
#: Words with stems of their own, words left alone, and words left alone after the first step.
SPECIAL = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
KEPT_LATER = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Suffixes of the second and third steps and what stands for them.
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]

#: Ends that some rule asks for: a word without any of them is its own stem.
ENDS = ("s", "y", "i", "e", "ed", "ing", "al", "ll", "ful", "ion", "er", "ator", "ism", "ant", "ent", "ic", "'")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = frozenset("cdeghkmnrt")
_VOWEL, _SYLLABLE, _HEAD = re.compile(f"[{V}]"), re.compile(f"[{V}][^{V}]"), re.compile("gener|commun|arsen")
_CONSONANT_Y, _OWNED = re.compile(f"(^|(?<=[{V}]))y"), re.compile("('s'|'s|')$")
_SHORT_END = re.compile(f"(^[{V}][^{V}]|[^{V}][{V}][^{V}wxY])$")


def _by_last(suffixes: dict[str, str]) -> dict[str, list[tuple[str, str, int]]]:
    """Suffixes of a step in its order, by their last letter."""
    out: dict[str, list[tuple[str, str, int]]] = {}
    for suffix, new in suffixes.items():
        out.setdefault(suffix[-1], []).append((suffix, new, len(suffix)))
    return out


_STEP2, _STEP3, _STEP4 = _by_last(STEP2), _by_last(STEP3), _by_last(dict.fromkeys(STEP4, ""))


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and again."""

    def after(start: int) -> int:
        m = _SYLLABLE.search(word, start)
        return m.end() if m else len(word)

    head = _HEAD.match(word)
    first = head.end() if head else after(0)
    return first, after(first)


def _short_end(word: str) -> bool:
    return bool(_SHORT_END.search(word))


def _step(word: str, rules: dict[str, list[tuple[str, str, int]]], region: int) -> str | None:
    """The word after the first rule whose suffix it has, if that lies within a region; None without such a rule."""
    for suffix, new, size in rules.get(word[-1:], ()):
        if word.endswith(suffix):
            return word[:-size] + new if len(word) - size >= region else word
    return None


def stem(word: str) -> str:
    """The stem of a lower-cased word."""
    if len(word) <= 2:
        return word
    if not word.endswith(ENDS) and word[0] != "'":
        return word
    if word in SPECIAL or word in KEPT:
        return SPECIAL.get(word, word)
    word = word.removeprefix("'")
    if "y" in word:
        word = _CONSONANT_Y.sub("Y", word)
    r1, r2 = _regions(word)
    if "'" in word:
        word = _OWNED.sub("", word)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in KEPT_LATER:
        return word

    if cut := next((len(x) for x in ("eedly", "eed") if word.endswith(x)), 0):
        if len(word) - cut >= r1:
            word = word[:-cut] + "ee"
    elif (cut := next((len(x) for x in ("ingly", "edly", "ing", "ed") if word.endswith(x)), 0)) and _VOWEL.search(word[:-cut]):
        word = word[:-cut]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLES):
            word = word[:-1]
        elif _short_end(word) and r1 >= len(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in V:
        word = word[:-1] + "i"

    if (after := _step(word, _STEP2, r1)) is not None:
        word = after
    elif word.endswith("ogi") and len(word) - 3 >= r1 and word[-4:-3] == "l":
        word = word[:-1]
    elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in _LI:
        word = word[:-2]

    if (after := _step(word, _STEP3, r1)) is not None:
        word = after
    elif word.endswith("ative") and len(word) - 5 >= r2:
        word = word[:-5]

    if (after := _step(word, _STEP4, r2)) is not None:
        word = after
    elif word.endswith(("sion", "tion")) and len(word) - 3 >= r2:
        word = word[:-3]

    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
