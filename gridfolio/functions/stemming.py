"""The English stemmer of the Snowball family, from its published description."""

from __future__ import annotations

from functools import lru_cache

VOWELS = frozenset("aeiouy")
# --- Fixed values: the tables of the algorithm. ---
DOUBLES = frozenset(["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"])
LI_ENDINGS = frozenset("cdeghkmnrt")
REGION_PREFIXES = ("gener", "commun", "arsen")
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
UNCHANGED_WITHOUT_S = frozenset(["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"])
#: Endings of the second and third step with what replaces them in the first region; those of the fourth go in the second region.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
# --- End of the fixed values. ---


def _after_vowel_and_consonant(word: str, start: int) -> int:
    """Where the region begins that follows the first consonant behind a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _ending(word: str, endings) -> str:
    """The longest of ``endings`` that a word has, empty without one."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _short_syllable(word: str) -> bool:
    """Whether a word ends in a vowel between consonants, the last of them not w, x or a consonant y; or is a vowel and a consonant."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS and word[-1] not in "wxY"


@lru_cache(maxsize=200_000)
def english(word: str) -> str:
    """The stem of a lower-case word. A ``y`` that works as a consonant is marked ``Y`` meanwhile."""
    if len(word) <= 2:
        return word
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    word = word.removeprefix("'")
    word = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in VOWELS and not (word[i - 1] == "y" and _is_marked(word, i - 1))) else c for i, c in enumerate(word))
    prefix = next((p for p in REGION_PREFIXES if word.startswith(p)), None)
    first = len(prefix) if prefix else _after_vowel_and_consonant(word, 0)
    second = _after_vowel_and_consonant(word, first)
    word = word[: len(word) - len(_ending(word, ("'", "'s", "'s'")))]
    word = _plural(word)
    if word in UNCHANGED_WITHOUT_S:
        return word
    word = _past_and_gerund(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _replaced(word, SECOND, first, second)
    word = _replaced(word, THIRD, first, second)
    end = _ending(word, FOURTH)
    if end and len(word) - len(end) >= second and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    rest = word[:-1]
    if word.endswith("e") and (len(rest) >= second or len(rest) >= first and not _short_syllable(rest)):
        word = rest
    elif word.endswith("ll") and len(rest) >= second:
        word = rest
    return word.replace("Y", "y")


def _is_marked(word: str, at: int) -> bool:
    """Whether the y at a place is a consonant itself, so that one behind it follows no vowel."""
    return at == 0 or word[at - 1] in VOWELS and not (word[at - 1] == "y" and _is_marked(word, at - 1))


def _plural(word: str) -> str:
    end = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    if end == "s" and any(c in VOWELS for c in word[:-2]):
        return word[:-1]
    return word


def _past_and_gerund(word: str, first: int) -> str:
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    rest = word[: len(word) - len(end)]
    if end in ("eed", "eedly"):
        return rest + "ee" if len(rest) >= first else word
    if not end or not any(c in VOWELS for c in rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest[-2:] in DOUBLES:
        return rest[:-1]
    return rest + "e" if len(rest) <= first and _short_syllable(rest) else rest


def _replaced(word: str, endings: dict[str, str], first: int, second: int) -> str:
    end = _ending(word, endings)
    rest = word[: len(word) - len(end)]
    if not end or len(rest) < first:
        return word
    if end == "ogi" and not rest.endswith("l") or end == "li" and rest[-1:] not in LI_ENDINGS or end == "ative" and len(rest) < second:
        return word
    return rest + endings[end]
