"""Porter's (1980) suffix-stripping stemmer, written from the published
algorithm, and its later extended variant: short words in -ies and -ied keep
-ie, -y becomes -i after any consonant that is not the first letter, stems of a
vowel and a consonant get their -e back, four changed suffixes (-bli, -alli
followed by another rule, -fulli, -logi), and a list of irregular words.  Used
on the distinct vocabulary only (never per token row)."""

from __future__ import annotations

_VOWELS = set("aeiou")


def _is_cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in _VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _is_cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """m in [C](VC)^m[V]."""
    m, i, n = 0, 0, len(stem)
    while i < n and _is_cons(stem, i):
        i += 1
    while i < n:
        while i < n and not _is_cons(stem, i):
            i += 1
        if i >= n:
            break
        while i < n and _is_cons(stem, i):
            i += 1
        m += 1
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _is_cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _cvc(w: str, extended: bool = False) -> bool:
    if len(w) < 3:
        return extended and len(w) == 2 and not _is_cons(w, 0) and _is_cons(w, 1)
    return (_is_cons(w, len(w) - 3) and not _is_cons(w, len(w) - 2) and _is_cons(w, len(w) - 1)
            and w[-1] not in "wxy")


# fixed values: suffix rules of the published algorithm (steps 2, 3 and 4)
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
          ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
          "ism", "ate", "iti", "ous", "ive", "ize"]

# fixed values: suffix rules of step 2 and irregular words of the extended variant
_STEP2_EXTENDED = [(suf, rep) for suf, rep in _STEP2 if suf != "abli"] + [("bli", "ble"), ("fulli", "ful")]
_IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed",
    "succeed": "succeed",
}


def _replace_longest(w: str, rules, min_m: int) -> str:
    best = None
    for suf, rep in rules:
        if w.endswith(suf) and (best is None or len(suf) > len(best[0])):
            best = (suf, rep)
    if best is None:
        return w
    stem = w[: len(w) - len(best[0])]
    return stem + best[1] if _measure(stem) > min_m - 1 else w


def _step2_extended(w: str) -> str:
    if w.endswith("logi"):  # measured with its l
        return w[:-1] if _measure(w[:-3]) > 0 else w
    out = _replace_longest(w, _STEP2_EXTENDED, 1)
    return _step2_extended(out) if w.endswith("alli") and out != w else out


def stem(word: str, extended: bool = False) -> str:
    """The word's stem; words of one or two letters are their own."""
    w = word.lower()
    if extended and w in _IRREGULAR:
        return _IRREGULAR[w]
    if len(w) <= 2:
        return w
    # step 1a
    if extended and len(w) == 4 and w.endswith("ies"):
        w = w[:-1]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    extra = False
    if extended and w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w, extended):
            w += "e"
    # step 1c
    if w.endswith("y") and (len(w) > 2 and _is_cons(w, len(w) - 2) if extended else _has_vowel(w[:-1])):
        w = w[:-1] + "i"
    # steps 2 and 3
    w = _step2_extended(w) if extended else _replace_longest(w, _STEP2, 1)
    w = _replace_longest(w, _STEP3, 1)
    # step 4
    best = None
    for suf in _STEP4:
        if w.endswith(suf) and (best is None or len(suf) > len(best)):
            best = suf
    if best is not None:
        stem_ = w[: len(w) - len(best)]
        if _measure(stem_) > 1 and (best != "ion" or (stem_ and stem_[-1] in "st")):
            w = stem_
    # step 5a
    if w.endswith("e"):
        s = w[:-1]
        m = _measure(s)
        if m > 1 or (m == 1 and not _cvc(s, extended)):
            w = s
    # step 5b
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w
