"""Phonetic codes of words, by published rules."""

from __future__ import annotations

import re

_GROUPS = {c: str(k) for k, g in enumerate(("aeiouyhw", "bfpv", "cgjkqsxz", "dt", "l", "mn", "r")) for c in g}


def soundex_en(word: str) -> str:
    """First letter, then a digit for each run of letters of a group; vowels give 0; no fixed length; only a to z count."""
    letters = [c for c in word.lower() if c in _GROUPS]
    return letters[0] + "".join(_GROUPS[b] for a, b in zip(letters, letters[1:]) if _GROUPS[a] != _GROUPS[b]) if letters else ""


#: Sounds of Spanish, tried in this order at each place: what is read, and the letter that it gives.
_ES_SOUNDS = [(re.compile(read), gives) for read, gives in (
    (r"\A(?:w[uh]|[wuh])?[aeiou]", ""), (r"sch|ch|sh|ll|cc|ps|bs|c[eiéí]|g[eiéí]|y[aeiouáéíóú]|[zxj]", "s"), (r"[aeiouáéíóúühw]+", ""), (r"y", ""), (r"gn|ñ", "n"), (r"[cdp]t", "t"), (r"ck|q|c[aouáóú]", "k"), (r"v", "b"), (r"d\Z", "t"),
)]


def soundex_esp(word: str) -> str:
    """Spanish: a letter for each sound, none for vowels and h; a sound like the one before it is left out. Other letters stand."""
    w, at, out, last = word.lower(), 0, [], None
    while at < len(w):
        gives, to = next(((x, m.end()) for p, x in _ES_SOUNDS if (m := p.match(w, at))), (w[at], at + 1))
        if gives != last:
            out.append(gives)
        at, last = to, gives
    return "".join(out)


_AR_CODES = {c: d for g, d in (("اأإآحخهعغشوي", "0"), ("بف", "1"), ("قكجزسصظ", "2"), ("تثدذضط", "3"), ("ل", "4"), ("من", "5"), ("ر", "6")) for c in g}


def soundex_ar(word: str) -> str:
    """Arabic: 0, then digits of consonant groups from the second letter on (a leading alif isn't counted as the first); a
    group's letter after one of the same is left out, those of group 0 are silent. A letter without a group counts as the
    one before it."""
    letters = word[1:] if word[:1] in tuple("اأإآ") else word
    out, last = "0", "0"
    for c in letters[1:]:
        code = _AR_CODES.get(c, last)
        if code not in (last, "0"):
            out += code
        last = code
    return out


def double_metaphone(word: str) -> tuple[str, str]:
    """Two codes of how a word may sound in English, the second "" where it is the same."""
    w = re.sub(r"[^A-ZÇÑ]", "", word.upper())
    n, i = len(w), 0
    a: list[str] = []
    b: list[str] = []
    at = lambda k, *xs: any(w.startswith(x, k) for x in xs) if k >= 0 else False
    vowel = lambda k: 0 <= k < n and w[k] in "AEIOUY"

    def add(x: str, y: str | None = None) -> None:
        a.append(x)
        b.append(x if y is None else y)

    if at(0, "GN", "KN", "PN", "WR", "PS"):
        i = 1
    if at(0, "X"):
        add("S")
        i = 1
    slavic = "W" in w or "K" in w or "CZ" in w
    while i < n:
        c, step = w[i], 1
        if c in "AEIOUY":
            if i == 0:
                add("A")
        elif c == "B":
            add("P")
            step = 2 if at(i + 1, "B") else 1
        elif c == "Ç":
            add("S")
        elif c == "C":
            if at(i, "CIA"):
                add("X")
                step = 3
            elif at(i, "CH"):
                if i == 0 and at(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM") and not at(0, "CHORE"):
                    add("K")
                elif at(i - 2, "ORCHES", "ARCHIT", "ORCHID") or (i + 2 < n and w[i + 2] in "LRNMBHFVW" and i == 0):
                    add("K")
                else:
                    add("X", "K" if i > 0 else None)
                step = 2
            elif at(i, "CZ") and not at(i - 2, "WICZ"):
                add("S", "X")
                step = 2
            elif at(i, "CC") and not (i == 1 and w[0] == "M"):
                if i + 2 < n and w[i + 2] in "IEH" and not at(i + 2, "HU"):
                    add("KS" if at(i - 1, "UCCEE", "UCCES") or (i == 1 and w[0] == "A") else "X")
                    step = 3
                else:
                    add("K")
                    step = 2
            elif at(i, "CK", "CG", "CQ"):
                add("K")
                step = 2
            elif at(i, "CI", "CE", "CY"):
                add("S", "X" if at(i, "CIO", "CIE", "CIA") else None)
                step = 2
            else:
                add("K")
                step = 2 if at(i + 1, "C", "K", "Q") and not at(i + 1, "CE", "CI") else 1
        elif c == "D":
            if at(i, "DG"):
                if i + 2 < n and w[i + 2] in "IEY":
                    add("J")
                    step = 3
                else:
                    add("TK")
                    step = 2
            else:
                add("T")
                step = 2 if at(i, "DT", "DD") else 1
        elif c == "F":
            add("F")
            step = 2 if at(i + 1, "F") else 1
        elif c == "G":
            if at(i + 1, "H"):
                if i > 0 and not vowel(i - 1):
                    add("K")
                elif i == 0:
                    add("J" if at(2, "I") else "K")
                elif i > 2 and w[i - 1] == "U" and w[i - 3] in "CGLRT":
                    add("F")
                elif i > 0 and w[i - 1] != "I" and not at(i - 2, "B", "H", "D") and not vowel(i - 1):
                    add("K")
                step = 2
            elif at(i + 1, "N"):
                if i == 1 and vowel(0) and not slavic:
                    add("KN", "N")
                elif not at(i + 2, "EY") and not slavic:
                    add("N", "KN")
                else:
                    add("KN")
                step = 2
            elif i == 0 and at(1, "Y", "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER"):
                add("K", "J")
                step = 2
            elif i + 1 < n and w[i + 1] in "EIY":
                add("J", "K")
                step = 2
            else:
                add("K")
                step = 2 if at(i + 1, "G") else 1
        elif c == "H":
            if (i == 0 or vowel(i - 1)) and vowel(i + 1):
                add("H")
                step = 2
        elif c == "J":
            if at(i, "JOSE"):
                add("H")
            elif i == 0:
                add("J", "A")
            elif vowel(i - 1) and not slavic and i + 1 < n and w[i + 1] in "AO":
                add("J", "H")
            elif i == n - 1:
                add("J", "")
            else:
                add("J")
            step = 2 if at(i + 1, "J") else 1
        elif c == "K":
            add("K")
            step = 2 if at(i + 1, "K") else 1
        elif c == "L":
            add("L")
            step = 2 if at(i + 1, "L") else 1
        elif c == "M":
            add("M")
            step = 2 if at(i + 1, "M") or at(i - 1, "UMB") and (i + 1 == n - 1 or at(i + 2, "ER")) else 1
        elif c in "NÑ":
            add("N")
            step = 2 if at(i + 1, "N") else 1
        elif c == "P":
            if at(i + 1, "H"):
                add("F")
                step = 2
            else:
                add("P")
                step = 2 if at(i + 1, "P", "B") else 1
        elif c == "Q":
            add("K")
            step = 2 if at(i + 1, "Q") else 1
        elif c == "R":
            if i == n - 1 and not slavic and at(i - 2, "IE") and not at(i - 4, "ME", "MA"):
                add("", "R")
            else:
                add("R")
            step = 2 if at(i + 1, "R") else 1
        elif c == "S":
            if at(i - 1, "ISL", "YSL"):
                pass
            elif i == 0 and at(0, "SUGAR"):
                add("X", "S")
            elif at(i, "SH"):
                add("S" if at(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X")
                step = 2
            elif at(i, "SIO", "SIA"):
                add("S", None if slavic else "X")
                step = 3
            elif i == 0 and at(1, "M", "N", "L", "W") or at(i + 1, "Z"):
                add("S", "X")
                step = 2 if at(i + 1, "Z") else 1
            elif at(i, "SC"):
                if at(i + 2, "H"):
                    if at(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                        add("X" if at(i + 3, "ER", "EN") else "SK", "SK")
                    else:
                        add("X")
                elif i + 2 < n and w[i + 2] in "IEY":
                    add("S")
                else:
                    add("SK")
                step = 3
            elif i == n - 1 and at(i - 2, "AI", "OI"):
                add("", "S")
            else:
                add("S")
                step = 2 if at(i + 1, "S") else 1
        elif c == "T":
            if at(i, "TION", "TIA", "TCH"):
                add("X")
                step = 3
            elif at(i, "TH", "TTH"):
                if at(i + 2, "OM", "AM"):
                    add("T")
                else:
                    add("0", "T")
                step = 2
            else:
                add("T")
                step = 2 if at(i + 1, "T", "D") else 1
        elif c == "V":
            add("F")
            step = 2 if at(i + 1, "V") else 1
        elif c == "W":
            if at(i, "WR"):
                add("R")
                step = 2
            elif i == 0 and (vowel(1) or at(0, "WH")):
                add("A", "F" if vowel(1) else None)
            elif i == n - 1 and vowel(i - 1) or at(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY"):
                add("", "F")
            elif at(i, "WICZ", "WITZ"):
                add("TS", "FX")
                step = 4
        elif c == "X":
            if not (i == n - 1 and at(i - 2, "AU", "OU")):
                add("KS")
            step = 2 if at(i + 1, "C", "X") else 1
        elif c == "Z":
            if at(i + 1, "H"):
                add("J")
                step = 2
            else:
                add("S", "TS" if at(i + 1, "ZO", "ZI", "ZA") or slavic and i > 0 and w[i - 1] != "T" else None)
                step = 2 if at(i + 1, "Z") else 1
        i += step
    first, second = "".join(a), "".join(b)
    return first, "" if second == first else second
