"""Stemmers by published algorithms, and stop words by language. Each stemmer is a function of one lower-case word."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from wordloom.functions import snowball
from wordloom.functions.regions import by_size as _by_size
from wordloom.functions.regions import regions as _regions
from wordloom.functions.regions import second_letter_region as _rv

# Porter's first algorithm


def _form(stem: str) -> str:
    """v and c for vowels and consonants; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or c == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _m(stem: str) -> int:
    return len(re.findall("v+c+", _form(stem)))


def _cvc(stem: str) -> bool:
    return _form(stem).endswith("cvc") and stem[-1] not in "wxy"


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"
_RULES = [sorted((tuple(r.split(":")) for r in s.split()), key=lambda r: -len(r[0])) for s in (_STEP2, _STEP3)]


@lru_cache(maxsize=100_000)
def porter(w: str) -> str:
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    else:
        for e in ("ed", "ing"):
            if w.endswith(e) and "v" in _form(w[: -len(e)]):
                w = w[: -len(e)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _form(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _m(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _form(w[:-1]):
        w = w[:-1] + "i"
    for rules in _RULES:
        for a, b in rules:
            if w.endswith(a):
                if _m(w[: -len(a)]) > 0:
                    w = w[: -len(a)] + b
                break
    for e in sorted([*_STEP4.split(), "ion"], key=len, reverse=True):
        if w.endswith(e):
            stem = w[: -len(e)]
            if _m(stem) > 1 and (e != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _m(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w


# Snowball's regions: R1 after the first consonant that follows a vowel, R2 the same within R1


_EN_V = "aeiouy"
_EN_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_EN_STAY = set("inning outing canning herring earring proceed exceed succeed".split())
_EN2 = sorted((r.split(":") for r in "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble fulli:ful lessli:less".split()), key=lambda r: -len(r[0]))
_EN3 = sorted((r.split(":") for r in "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness:".split()), key=lambda r: -len(r[0]))
_EN4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), key=len, reverse=True)


def _en_short(w: str) -> bool:
    """Ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _EN_V and w[1] not in _EN_V
    return len(w) > 2 and w[-3] not in _EN_V and w[-2] in _EN_V and w[-1] not in _EN_V + "wxY"


@lru_cache(maxsize=100_000)
def english(w: str) -> str:
    """Porter's second algorithm."""
    if len(w) < 3:
        return w
    if w in _EN_SPECIAL:
        return _EN_SPECIAL[w]
    w = w.lstrip("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w, _EN_V)
    for p in ("gener", "commun", "arsen"):
        if w.startswith(p):
            r1 = len(p)
            r2 = _regions("a" * 0 + w[r1:], _EN_V)[0] + r1
    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = w[: -len(e)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _EN_V for c in w[:-2]):
        w = w[:-1]
    if w in _EN_STAY:
        return w
    for e in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not w.endswith(e):
            continue
        if e.startswith("eed"):
            if len(w) - len(e) >= r1:
                w = w[: -len(e)] + "ee"
        elif any(c in _EN_V for c in w[: -len(e)]):
            w = w[: -len(e)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
                w = w[:-1]
            elif _en_short(w) and r1 >= len(w):
                w += "e"
        break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_V:
        w = w[:-1] + "i"
    for a, b in _EN2:
        if w.endswith(a):
            if len(w) - len(a) >= r1:
                w = w[: -len(a)] + b
            break
    else:
        if w.endswith("logi") and len(w) - 3 > r1 - 1:
            w = w[:-1] if len(w) - 4 >= r1 - 1 else w
        elif w.endswith("li") and len(w) - 2 >= r1 and len(w) > 2 and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    for a, b in _EN3:
        if w.endswith(a):
            if len(w) - len(a) >= r1:
                w = w[: -len(a)] + b
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for e in _EN4:
        if w.endswith(e):
            if len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(e)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _en_short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@lru_cache(maxsize=100_000)
def german(w: str) -> str:
    v = "aeiouyäöü"
    w = w.replace("ß", "ss")
    w = re.sub(rf"(?<=[{v}])([uy])(?=[{v}])", lambda m: m[1].upper(), w)
    r1, r2 = _regions(w, v, 3)
    for e in ("ern", "em", "er", "en", "es", "e", "s"):
        if w.endswith(e):
            k = len(w) - len(e)
            if k >= r1 and (e != "s" or w[k - 1 : k] in tuple("bdfghklmnrt")):
                w = w[:k]
                if e in ("en", "es", "e") and w.endswith("niss"):
                    w = w[:-1]
            break
    for e in ("est", "en", "er", "st"):
        if w.endswith(e):
            k = len(w) - len(e)
            if k >= r1 and (e != "st" or w[k - 1 : k] in tuple("bdfghklmnt") and k >= 4):
                w = w[:k]
            break
    for e in ("keit", "heit", "lich", "isch", "end", "ung", "ig", "ik"):
        if w.endswith(e):
            k = len(w) - len(e)
            if k >= r2:
                if e in ("end", "ung"):
                    w = w[:k]
                    if w.endswith("ig") and len(w) - 2 >= r2 and w[-3:-2] != "e":
                        w = w[:-2]
                elif e in ("ig", "ik", "isch"):
                    if w[k - 1 : k] != "e":
                        w = w[:k]
                elif e in ("lich", "heit"):
                    w = w[:k]
                    if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                        w = w[:-2]
                else:
                    w = w[:k]
                    if w.endswith("lich") and len(w) - 4 >= r2:
                        w = w[:-4]
                    elif w.endswith("ig") and len(w) - 2 >= r2:
                        w = w[:-2]
            break
    return w.lower().translate(str.maketrans("äöü", "aou"))


def _longest(w: str, endings: list[str], start: int) -> str | None:
    return next((e for e in endings if w.endswith(e) and len(w) - len(e) >= start), None)


_SV1 = _by_size("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast")
_DA1 = _by_size("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret")
_NO1 = _by_size("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast")


@lru_cache(maxsize=100_000)
def swedish(w: str) -> str:
    r1 = _regions(w, "aeiouyäåö", 3)[0]
    e = _longest(w, _SV1, r1)
    if e:
        w = w[: -len(e)]
    elif w.endswith("s") and len(w) - 1 >= r1 and w[-2:-1] in tuple("bcdfghjklmnoprtvy"):
        w = w[:-1]
    if len(w) - 2 >= r1 and w.endswith(("dd", "gd", "nn", "dt", "gt", "kt", "tt")):
        w = w[:-1]
    e = _longest(w, ["fullt", "löst", "lig", "els", "ig"], r1)
    return w[:-1] if e in ("fullt", "löst") else w[: -len(e)] if e else w


@lru_cache(maxsize=100_000)
def danish(w: str) -> str:
    v = "aeiouyæåø"
    r1 = _regions(w, v, 3)[0]
    e = _longest(w, _DA1, r1)
    if e:
        w = w[: -len(e)]
    elif w.endswith("s") and len(w) - 1 >= r1 and w[-2:-1] in tuple("abcdfghjklmnoprtvyzå"):
        w = w[:-1]

    def two(w: str) -> str:
        return w[:-1] if len(w) - 2 >= r1 and w.endswith(("gd", "dt", "gt", "kt")) else w

    w = two(w)
    if w.endswith("igst"):
        w = w[:-2]
    e = _longest(w, ["løst", "elig", "els", "lig", "ig"], r1)
    w = w[:-1] if e == "løst" else two(w[: -len(e)]) if e else w
    return w[:-1] if len(w) - 1 >= r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in v else w


@lru_cache(maxsize=100_000)
def norwegian(w: str) -> str:
    v = "aeiouyæåø"
    r1 = _regions(w, v, 3)[0]
    e = _longest(w, [*_by_size("erte ert"), *_NO1], r1)
    if e in ("erte", "ert"):
        w = w[: -len(e)] + "er"
    elif e:
        w = w[: -len(e)]
    elif w.endswith("s") and len(w) - 1 >= r1 and (w[-2:-1] in tuple("bcdfghjlmnoprtvyz") or w[-2:-1] == "k" and w[-3:-2] not in tuple(v)):
        w = w[:-1]
    if len(w) - 2 >= r1 and w.endswith(("dt", "vt")):
        w = w[:-1]
    e = _longest(w, _by_size("leg eleg ig eig lig elig els lov elov slov hetslov"), r1)
    return w[: -len(e)] if e else w


_ES_PRON = _by_size("me se sela selo selas selos la le lo las les los nos")
_ES_VERB_Y = _by_size("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_ES_VERB_E = _by_size("en es éis emos")
_ES_VERB = _by_size("arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos")


@lru_cache(maxsize=100_000)
def spanish(w: str) -> str:
    v = "aeiouáéíóúü"
    r1, r2 = _regions(w, v)
    rv = _rv(w, v)
    plain = str.maketrans("áéíóú", "aeiou")
    p = _longest(w, _ES_PRON, rv)
    if p:
        base = w[: -len(p)]
        g = _longest(base, _by_size("iéndo ándo ár ér ír ando iendo ar er ir"), rv)
        if g or base.endswith("uyendo"):
            w = base.translate(plain) if g in ("iéndo", "ándo", "ár", "ér", "ír") else base
    before = w
    for endings, how in (
        (_by_size("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"), ""), (_by_size("adora ador ación adoras adores aciones ante antes ancia ancias"), "ic"),
        (_by_size("logía logías"), "log"), (_by_size("ución uciones"), "u"), (_by_size("encia encias"), "ente"),
    ):
        e = _longest(w, endings, r2)
        if e:
            w = w[: -len(e)]
            if how == "ic":
                w = w[:-2] if w.endswith("ic") and len(w) - 2 >= r2 else w
            else:
                w += how
            break
    else:
        if w.endswith("amente") and len(w) - 6 >= r1:
            w = w[:-6]
            e = _longest(w, ["ativ", "iv", "os", "ic", "ad"], r2)
            w = w[: -len(e)] if e else w
        elif w.endswith("mente") and len(w) - 5 >= r2:
            w = w[:-5]
            e = _longest(w, ["ante", "able", "ible"], r2)
            w = w[: -len(e)] if e else w
        elif e := _longest(w, ["idad", "idades"][::-1], r2):
            w = w[: -len(e)]
            e = _longest(w, ["abil", "ic", "iv"], r2)
            w = w[: -len(e)] if e else w
        elif e := _longest(w, _by_size("iva ivo ivas ivos"), r2):
            w = w[: -len(e)]
            w = w[:-2] if w.endswith("at") and len(w) - 2 >= r2 else w
    if w == before:
        e = _longest(w, _ES_VERB_Y, rv)
        if e and w[: -len(e)].endswith("u"):
            w = w[: -len(e)]
        elif e := _longest(w, sorted(_ES_VERB + _ES_VERB_E, key=len, reverse=True), rv):
            w = w[: -len(e)]
            if e in _ES_VERB_E and w.endswith("gu"):
                w = w[:-1]
    e = _longest(w, ["os", "a", "o", "á", "í", "ó"], rv)
    if e:
        w = w[: -len(e)]
    elif w.endswith(("e", "é")) and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(plain)


@lru_cache(maxsize=100_000)
def arabic(w: str) -> str:
    """A light stemmer: the longest of some endings is cut where three letters are left."""
    e = next((e for e in ("ات", "ان", "ون", "ين", "ية", "ها", "هم", "كم", "ة", "ه", "ي") if w.endswith(e) and len(w) - len(e) >= 3), "")
    return w[: -len(e)] if e else w


_STEMMERS: dict[str, Callable[[str], str]] = {"en": english, "de": german, "sv": swedish, "da": danish, "no": norwegian, "es": spanish, "fr": snowball.french, "it": snowball.italian, "pt": snowball.portuguese, "nl": snowball.dutch, "fi": snowball.finnish, "hu": snowball.hungarian, "ro": snowball.romanian, "ru": snowball.russian, "ar": arabic, "porter": porter}
_CODES = dict(x.split(":") for x in "english:en german:de swedish:sv danish:da norwegian:no spanish:es french:fr italian:it portuguese:pt dutch:nl finnish:fi hungarian:hu romanian:ro russian:ru arabic:ar eng:en deu:de ger:de swe:sv dan:da nor:no spa:es fra:fr fre:fr ita:it por:pt nld:nl fin:fi hun:hu ron:ro rus:ru ara:ar".split())
_STOPS = {
    "de": "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "fr": "le la les de des un une et à il elle que qui en dans pour sur pas avec du au ce se ne par plus son sa ses",
    "es": "el la los las de un una y a que en por con para no se su al del lo como más o pero sus le",
    "it": "il lo la i gli le di un una e a che in per con non si da del al come più o ma",
    "sv": "och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke",
    "nl": "de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om",
    "pt": "o a os as de um uma e que em por com para não se do da no na ao como mais ou mas",
    "da": "og i jeg det at en den til er som på de med han af for ikke der var mig",
    "no": "og i jeg det at en et den til er som på de med han av ikke der så var",
}


def two_letter_code(name: str) -> str | None:
    name = name.lower()
    return name if name in _STEMMERS or name in _STOPS else _CODES.get(name)


def has_stemmer(lang: str) -> bool:
    return two_letter_code(lang) in _STEMMERS


def stemmer_for_language(lang: str) -> Callable[[str], str]:
    code = two_letter_code(lang)
    if code not in _STEMMERS:
        raise KeyError(f"no stemmer for {lang!r}")
    return _STEMMERS[code]


def has_stopwords(lang: str) -> bool:
    return two_letter_code(lang) == "en" or two_letter_code(lang) in _STOPS


def stopwords_for_language(lang: str) -> frozenset[str]:
    from wordloom.functions.analysis import STOP_WORDS

    code = two_letter_code(lang)
    return STOP_WORDS if code == "en" else frozenset(_STOPS[code].split())
