"""The production analyzer: a text's tokens by type, English words without stop words
and stemmed by the published second Porter algorithm, all others as they are. A helper
over Arrow batches; each distinct word is stemmed once while a worker remembers it.

Token types: mail addresses, web addresses (the whole, its host and its path), hosts, file
paths, versions, numbers with fraction or sign, hyphenated words (the whole and its
parts), words and words with digits. Protocols, tags and character entities are no tokens.
Positions count all tokens, stop words among them, so that a phrase knows where one was left out."""

import re
from functools import lru_cache

from lectern.functions.analysis import analyzer

#: The stop words of the English text-search configuration.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Fixed values of the algorithm: whole words with a stem of their own, and words that stay after step 1a.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Endings of steps 2 to 4 and what takes their place.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]
_VOWEL = "aeiouy"


def _regions(word: str) -> tuple[int, int]:
    """Where the first and the second region of a word begin."""
    head = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if head is None:
        m = re.search(f"[{_VOWEL}][^{_VOWEL}]", word)
        head = m.end() if m else len(word)
    m = re.search(f"[{_VOWEL}][^{_VOWEL}]", word[head:])
    return head, head + m.end() if m else len(word)


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return bool(re.search(rf"[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]$", word) or re.fullmatch(rf"[{_VOWEL}][^{_VOWEL}]", word))


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub(rf"^y|(?<=[{_VOWEL}])y", "Y", word)  # a y that is a consonant
    r1, r2 = _regions(word)
    word = re.sub("('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_VOWEL}]", word[:-2]):
        word = word[:-1]
    if word in STAY:
        return word
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and re.search(f"[{_VOWEL}]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    if re.search(f"[^{_VOWEL}][yY]$", word) and len(word) > 2:
        word = word[:-1] + "i"
    end = _longest(word, [*STEP2, "ogi", "li"])
    if end and len(word) - len(end) >= r1:
        if end == "ogi":
            word = word[:-1] if word.endswith("logi") else word
        elif end == "li":
            word = word[:-2] if re.search("[cdeghkmnrt]li$", word) else word
        else:
            word = word[: -len(end)] + STEP2[end]
    end = _longest(word, [*STEP3, "ative"])
    if end and len(word) - len(end) >= r1:
        if end != "ative":
            word = word[: -len(end)] + STEP3[end]
        elif len(word) - len(end) >= r2:
            word = word[:-5]
    end = _longest(word, [*STEP4, "ion"])
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


_LETTER = r"[^\W\d_]"
_PART = rf"(?=\d*{_LETTER})[^\W_]+"  # letters, or digits and letters
_HOST = r"(?:[a-z0-9](?:[a-z0-9_-]*[a-z0-9])?\.)+[a-z][a-z0-9]+"
_STEP = r"[a-z0-9_~](?:[a-z0-9_.~-]*[a-z0-9_])?"  # between two slashes of a path
#: What a token can begin as, the longer kinds first.
_KINDS = re.compile(
    rf"""(?P<skip></?[a-z][^<>]*>|&(?:[a-z]+|\#[0-9]+|\#x[0-9a-f]+);|[a-z][a-z0-9+.-]*://)
    |(?P<mail>[a-z0-9][a-z0-9._+-]*@{_HOST})
    |(?P<host>{_HOST})(?![\w@])(?P<path>/[^\s<>"]*[a-z0-9_/\#=&-]|/)?
    |(?P<file>(?<![\w/])(?:[~.]{{0,2}}|{_STEP})(?:/{_STEP})+)
    |(?P<plain>(?<![\w.])\d+(?:\.\d+){{2,}}|(?:(?<![\w.])|[-+])\d+\.\d+(?:e[-+]?\d+)?(?!\w)|[-+]\d+(?!\w))
    |(?P<compound>{_PART}(?:-{_PART})+)
    |(?P<word>[^\W_]+)""",
    re.VERBOSE,
)


def tokens(text: str | None) -> list[tuple[str, bool]]:
    """(token, whether it is a word of letters) of a text in lower case."""
    out: list[tuple[str, bool]] = []
    for m in _KINDS.finditer((text or "").lower()):
        kind, found = m.lastgroup, m.group()
        if kind == "skip":
            continue
        if kind == "path":
            out += [(found, False), (m["host"], False), (m["path"], False)]
        elif kind == "compound":
            out += [(x, not re.search(r"\d", x)) for x in (found, *found.split("-"))]
        else:
            out.append((found, kind == "word" and not re.search(r"\d", found)))
    return out


def placed(text: str | None) -> list[tuple[str, int]]:
    """(lexeme, position) of a text, in order."""
    return [(stem(x) if word else x, i) for i, (x, word) in enumerate(tokens(text)) if not (word and x in STOP_WORDS)]


def lexemes(text: str | None) -> list[str]:
    return [x for x, _ in placed(text)]


#: An analyzer for index and query: array of lexemes, in order, repeats included; an index takes their positions over stop words.
english_lexemes = analyzer(lexemes, placed)
