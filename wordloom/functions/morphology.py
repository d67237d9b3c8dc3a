"""English forms of a word by rules of suffixes."""

from __future__ import annotations

_IRREGULAR = [set(x.split()) for x in (
    "be am is are was were been being", "have has had having", "do does did done doing", "go goes went gone going", "say says said saying", "make makes made making", "get gets got gotten getting", "know knows knew known knowing",
    "take takes took taken taking", "see sees saw seen seeing", "come comes came coming", "give gives gave given giving", "find finds found finding", "think thinks thought thinking", "tell tells told telling", "write writes wrote written writing",
    "run runs ran running", "man men", "woman women", "child children", "foot feet", "tooth teeth", "mouse mice", "goose geese", "person people", "good better best", "bad worse worst",
)]
_VOWELS = "aeiou"


def _root(word: str) -> str:
    for ending, back in (("iness", "y"), ("ness", ""), ("ily", "y"), ("ly", ""), ("ies", "y"), ("ied", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("ing", None), ("ed", None), ("er", None), ("est", None), ("s", "")):
        if word.endswith(ending) and len(word) - len(ending) >= 3 and not (ending == "s" and word.endswith(("ss", "us", "is"))):
            stem = word[: -len(ending)]
            if back is not None:
                return stem + back
            if not any(c in _VOWELS + "y" for c in stem):
                return word
            if len(stem) > 3 and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                return stem[:-1]
            return stem
    return word


def _forms(root: str) -> set[str]:
    out = {root}
    if root.endswith("y") and root[-2:-1] not in _VOWELS:
        stem = root[:-1]
        out |= {stem + x for x in ("ies", "ied", "ier", "iest", "ily", "iness", "ying", "yer")}
    elif root.endswith("e"):
        out |= {root + "s", root + "d", root + "r", root + "rs", root + "st", root + "ly", root + "ness", root[:-1] + "ing", root[:-1] + "able"}
    else:
        s = "es" if root.endswith(("s", "x", "z", "ch", "sh")) else "s"
        out |= {root + x for x in (s, "ed", "ing", "er", "ers", "est", "ly", "ness", "able", "ful", "less")}
        if len(root) > 2 and root[-1] not in "wxy" + _VOWELS and root[-2] in _VOWELS and root[-3:-2] not in _VOWELS:
            out |= {root + root[-1] + x for x in ("ed", "ing", "er", "est")}
    return out


def variations(word: str) -> set[str]:
    """The word, its likely root, and the forms of both; irregular ones from a list."""
    word = word.lower()
    for group in _IRREGULAR:
        if word in group:
            return set(group)
    root = _root(word)
    out = {word} | _forms(root) | _forms(word)
    if root != word and not root.endswith(("e", "y")):
        out |= _forms(root + "e")
    return out
