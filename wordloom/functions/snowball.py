"""The published Snowball stemmers of French, Italian, Portuguese, Dutch, Finnish, Hungarian, Romanian and Russian.

Each is written from its public definition: regions of the word after its first vowels, and lists of endings that are cut
or replaced where they lie in a region, the longest first.
"""

from __future__ import annotations

import re
from functools import lru_cache

from wordloom.functions.regions import by_size as _by_size
from wordloom.functions.regions import regions as _regions
from wordloom.functions.regions import second_letter_region as _rv


def _end(w: str, endings: list[str]) -> str | None:
    """The longest ending, wherever it lies."""
    return next((e for e in endings if w.endswith(e)), None)


def _in(w: str, e: str, start: int) -> bool:
    return len(w) - len(e) >= start


def _cut(w: str, e: str, by: str = "") -> str:
    return w[: len(w) - len(e)] + by


def _found(w: str, endings: list[str], start: int) -> str | None:
    """The longest ending that lies in the region from start on."""
    part = w[start:]
    return next((e for e in endings if part.endswith(e)), None)


# French

_FR = "aeiouyâàëéêèïîôûù"
_FR_I = _by_size("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it")
_FR_E = _by_size("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erons eront ez iez")
_FR_A = _by_size("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions")
_FR_1 = _by_size("ance iqUe isme able iste eux ances iqUes ismes ables istes atrice ateur ation atrices ateurs ations logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses amment emment ment ments issement issements")


def _french_rv(w: str) -> int:
    if w[:3] in ("par", "col", "tap"):
        return 3
    if len(w) > 2 and w[0] in _FR and w[1] in _FR:
        return 3
    return next((i + 1 for i in range(1, len(w)) if w[i] in _FR), len(w))


def _french_first(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """(the word, whether the verbs' endings are looked for too)."""
    e = _end(w, _FR_1)
    if e is None:
        return w, True
    k = len(w) - len(e)
    if e in _by_size("ance iqUe isme able iste eux ances iqUes ismes ables istes"):
        return (w[:k], False) if k >= r2 else (w, True)
    if e in _by_size("atrice ateur ation atrices ateurs ations"):
        if k < r2:
            return w, True
        w = w[:k]
        if w.endswith("ic"):
            w = w[:-2] if _in(w, "ic", r2) else _cut(w, "ic", "iqU")
        return w, False
    for forms, by in (("logie logies", "log"), ("usion ution usions utions", "u"), ("ence ences", "ent")):
        if e in forms.split():
            return (w[:k] + by, False) if k >= r2 else (w, True)
    if e in ("ement", "ements"):
        if k < rv:
            return w, True
        w = w[:k]
        if w.endswith("iv") and _in(w, "iv", r2):
            w = w[:-2]
            if w.endswith("at") and _in(w, "at", r2):
                w = w[:-2]
        elif w.endswith("eus"):
            w = w[:-3] if _in(w, "eus", r2) else _cut(w, "eus", "eux") if _in(w, "eus", r1) else w
        elif w.endswith(("abl", "iqU")):
            w = w[:-3] if len(w) - 3 >= r2 else w
        elif w.endswith(("ièr", "Ièr")):
            w = _cut(w, "ièr", "i") if len(w) - 3 >= rv else w
        return w, False
    if e in ("ité", "ités"):
        if k < r2:
            return w, True
        w = w[:k]
        for x, short in (("abil", "abl"), ("ic", "iqU")):
            if w.endswith(x):
                return (w[: -len(x)] if _in(w, x, r2) else _cut(w, x, short)), False
        return (w[:-2] if w.endswith("iv") and _in(w, "iv", r2) else w), False
    if e in ("if", "ive", "ifs", "ives"):
        if k < r2:
            return w, True
        w = w[:k]
        if w.endswith("at") and _in(w, "at", r2):
            w = w[:-2]
            if w.endswith("ic"):
                w = w[:-2] if _in(w, "ic", r2) else _cut(w, "ic", "iqU")
        return w, False
    if e == "eaux":
        return w[:-1], False
    if e == "aux":
        return (_cut(w, e, "al"), False) if k >= r1 else (w, True)
    if e in ("euse", "euses"):
        return (w[:k], False) if k >= r2 else (_cut(w, e, "eux"), False) if k >= r1 else (w, True)
    if e in ("issement", "issements"):
        return (w[:k], False) if k >= r1 and k > 0 and w[k - 1] not in _FR else (w, True)
    if e == "amment":
        return (_cut(w, e, "ant"), True) if k >= rv else (w, True)
    if e == "emment":
        return (_cut(w, e, "ent"), True) if k >= rv else (w, True)
    return (w[:k], True) if k - 1 >= rv and w[k - 1] in _FR else (w, True)


@lru_cache(maxsize=100_000)
def french(word: str) -> str:
    w = word.lower().replace("qu", "qU")
    w = re.sub(rf"(?<=[{_FR}])([ui])(?=[{_FR}])", lambda m: m[1].upper(), w)
    w = re.sub(rf"(?<=[{_FR}])y|y(?=[{_FR}])", "Y", w)
    rv = _french_rv(w)
    r1, r2 = _regions(w, _FR)
    before = w
    w, verbs = _french_first(w, rv, r1, r2)
    changed = w != before
    if not changed or verbs:
        e = _found(w, _FR_I, rv)
        done = False
        if e and len(w) - len(e) - 1 >= rv and w[len(w) - len(e) - 1] not in _FR:
            w, done = _cut(w, e), True
        if not done:
            e = _found(w, [*_by_size("ions"), *[]], rv) if w.endswith("ions") and _in(w, "ions", r2) else None
            rest = _by_size(" ".join([*_FR_E, *_FR_A]))
            x = _found(w, rest, rv)
            if e and (x is None or len(x) < 4):
                w, done = _cut(w, e), True
            elif x:
                w, done = _cut(w, x), True
                if x in _FR_A and w.endswith("e") and _in(w, "e", rv):
                    w = w[:-1]
        changed = changed or done
    if changed:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if len(w) > 1 and w.endswith("s") and w[-2] not in "aiouès":
            w = w[:-1]
        e = _found(w, _by_size("ion ier ière Ier Ière e ë"), rv)
        if e == "ion":
            if _in(w, e, r2) and len(w) - 4 >= rv and w[-4] in "st":
                w = w[:-3]
        elif e in ("ier", "ière", "Ier", "Ière"):
            w = _cut(w, e, "i")
        elif e == "e":
            w = w[:-1]
        elif e == "ë" and w[:-1].endswith("gu"):
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    m = re.search(rf"[éè](?=[^{_FR}]+$)", w)
    if m:
        w = w[: m.start()] + "e" + w[m.end() :]
    return w.lower()


# Italian

_IT = "aeiouàèìòù"
_IT_PRON = _by_size("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene")
_IT_VERB = _by_size(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
)


@lru_cache(maxsize=100_000)
def italian(word: str) -> str:
    w = word.lower().translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    w = re.sub(rf"(?<=[{_IT}])([ui])(?=[{_IT}])", lambda m: m[1].upper(), w)
    rv = _rv(w, _IT)
    r1, r2 = _regions(w, _IT)
    p = _found(w, _IT_PRON, rv)
    if p:
        base = _cut(w, p)
        g = _found(base, _by_size("ando endo ar er ir"), rv)
        if g:
            w = base if g in ("ando", "endo") else base + "e"
    before = w
    groups = (
        ("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti", r2), ("azione azioni atore atori", r2), ("logia logie", r2), ("uzione uzioni usione usioni", r2),
        ("enza enze", r2), ("amento amenti imento imenti", rv), ("amente", r1), ("ità", r2), ("ivo ivi iva ive", r2),
    )
    e = _end(w, _by_size(" ".join(g for g, _ in groups)))
    for names, start in groups:
        if e is None or e not in names.split():
            continue
        if not _in(w, e, start):
            break
        w = _cut(w, e)
        if e.startswith(("azion", "ator")):
            w = w[:-2] if w.endswith("ic") and _in(w, "ic", r2) else w
        elif e.startswith("logi"):
            w += "log"
        elif e.startswith(("uzion", "usion")):
            w += "u"
        elif e.startswith("enz"):
            w += "ente"
        elif e == "amente":
            if w.endswith("iv") and _in(w, "iv", r2):
                w = w[:-2]
                w = w[:-2] if w.endswith("at") and _in(w, "at", r2) else w
            else:
                x = _found(w, ["abil", "os", "ic"], r2)
                w = _cut(w, x) if x else w
        elif e == "ità":
            x = _found(w, ["abil", "ic", "iv"], r2)
            w = _cut(w, x) if x else w
        elif e.startswith("iv"):
            if w.endswith("at") and _in(w, "at", r2):
                w = w[:-2]
                w = w[:-2] if w.endswith("ic") and _in(w, "ic", r2) else w
    if w == before:
        x = _found(w, _IT_VERB, rv)
        w = _cut(w, x) if x else w
    if w[rv:].endswith(tuple("aeioàèìò")):
        w = w[:-1]
        if w[rv:].endswith("i"):
            w = w[:-1]
    if w[rv:].endswith(("ch", "gh")):
        w = w[:-1]
    return w.lower()


# Portuguese

_PT = "aeiouáéíóúâêô"
_PT_1 = _by_size("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância logia logias ução uções uça~o uço~es ência ências amente mente idade idades iva ivo ivas ivos ira iras")
_PT_VERB = _by_size(
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
)


@lru_cache(maxsize=100_000)
def portuguese(word: str) -> str:
    w = word.lower().replace("ã", "a~").replace("õ", "o~")
    rv = _rv(w, _PT)
    r1, r2 = _regions(w, _PT)
    before = w
    e = _end(w, _PT_1)
    if e:
        k, cut = len(w) - len(e), None
        if e in ("amente",):
            if k >= r1:
                cut = w[:k]
                if cut.endswith("iv") and _in(cut, "iv", r2):
                    cut = cut[:-2]
                    cut = cut[:-2] if cut.endswith("at") and _in(cut, "at", r2) else cut
                else:
                    x = _found(cut, ["os", "ic", "ad"], r2)
                    cut = _cut(cut, x) if x else cut
        elif e in ("ira", "iras"):
            if k >= rv and w[k - 1 : k] == "e":
                cut = w[:k] + "ir"
        elif k >= r2:
            cut = w[:k]
            if e.startswith("logi"):
                cut += "log"
            elif e.startswith("uç"):
                cut += "u"
            elif e.startswith("ênci"):
                cut += "ente"
            elif e == "mente":
                x = _found(cut, ["ante", "avel", "ível"], r2)
                cut = _cut(cut, x) if x else cut
            elif e.startswith("idade"):
                x = _found(cut, ["abil", "ic", "iv"], r2)
                cut = _cut(cut, x) if x else cut
            elif e in ("iva", "ivo", "ivas", "ivos"):
                cut = cut[:-2] if cut.endswith("at") and _in(cut, "at", r2) else cut
        w = w if cut is None else cut
    verb = False
    if w == before:
        x = _found(w, _PT_VERB, rv)
        if x:
            w, verb = _cut(w, x), True
    if w != before or verb:
        if w.endswith("ci") and _in(w, "i", rv):
            w = w[:-1]
    else:
        x = _found(w, _by_size("os a i o á í ó"), rv)
        w = _cut(w, x) if x else w
    if w[rv:].endswith(("e", "é", "ê")):
        w = w[:-1]
        if w.endswith("gu") and _in(w, "u", rv) or w.endswith("ci") and _in(w, "i", rv):
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


# Dutch

_NL = "aeiouyè"


def _undouble(w: str) -> str:
    return w[:-1] if w.endswith(("kk", "dd", "tt")) else w


@lru_cache(maxsize=100_000)
def dutch(word: str) -> str:
    w = word.lower().translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(rf"^y|(?<=[{_NL}])y", "Y", w)
    w = re.sub(rf"(?<=[{_NL}])i(?=[{_NL}])", "I", w)
    r1, r2 = _regions(w, _NL, 3)

    def en_ending(w: str, e: str) -> str:
        k = len(w) - len(e)
        return _undouble(w[:k]) if k >= r1 and k and w[k - 1] not in _NL and not w[:k].endswith("gem") else w

    e = _end(w, _by_size("heden ene en se s"))
    if e == "heden":
        w = _cut(w, e, "heid") if _in(w, e, r1) else w
    elif e in ("ene", "en"):
        w = en_ending(w, e)
    elif e in ("se", "s"):
        k = len(w) - len(e)
        w = w[:k] if k >= r1 and k and w[k - 1] not in _NL + "j" else w
    cut_e = False
    if w.endswith("e") and _in(w, "e", r1) and len(w) > 1 and w[-2] not in _NL:
        w, cut_e = _undouble(w[:-1]), True
    if w.endswith("heid") and _in(w, "heid", r2) and w[-5:-4] != "c":
        w = w[:-4]
        if w.endswith("en"):
            w = en_ending(w, "en")
    e = _end(w, _by_size("end ing ig lijk baar bar"))
    if e and _in(w, e, r2):
        if e in ("end", "ing"):
            w = _cut(w, e)
            w = w[:-2] if w.endswith("ig") and _in(w, "ig", r2) and w[-3:-2] != "e" else _undouble(w)
        elif e == "ig":
            w = w[:-2] if w[-3:-2] != "e" else w
        elif e == "lijk":
            w = w[:-4]
            if w.endswith("e") and _in(w, "e", r1) and len(w) > 1 and w[-2] not in _NL:
                w = _undouble(w[:-1])
        elif e == "baar" or cut_e:
            w = _cut(w, e)
    m = re.search(rf"[^{_NL}I](aa|ee|oo|uu)[^{_NL}I]$", w)
    if m:
        w = w[:-2] + w[-1]
    return w.lower()


# Finnish

_FI = "aeiouyäö"
_FI_LONG = ("aa", "ee", "ii", "oo", "uu", "ää", "öö")


@lru_cache(maxsize=100_000)
def finnish(word: str) -> str:
    w = word.lower()
    r1, r2 = _regions(w, _FI)
    e = _found(w, _by_size("kin kaan kään ko kö han hän pa pä sti"), r1)
    if e == "sti":
        w = w[:-3] if _in(w, e, r2) else w
    elif e and w[: -len(e)][-1:] in tuple(_FI + "nt"):
        w = _cut(w, e)
    e = _found(w, _by_size("si ni nsa nsä mme nne an än en"), r1)
    if e:
        base = _cut(w, e)
        if e == "si":
            w = base if not base.endswith("k") else w
        elif e == "ni":
            w = base[:-3] + "ksi" if base.endswith("kse") else base
        elif e in ("nsa", "nsä", "mme", "nne"):
            w = base
        elif e == "an":
            w = base if base.endswith(("ta", "ssa", "sta", "lla", "lta", "na")) else w
        elif e == "än":
            w = base if base.endswith(("tä", "ssä", "stä", "llä", "ltä", "nä")) else w
        elif base.endswith(("lle", "ine")):
            w = base
    case = False
    e = _found(w, _by_size("han hen hin hon hän hön den tten siin seen n a ä ta tä tta ttä ssa ssä sta stä lla llä lta ltä lle na nä ksi ine"), r1)
    if e:
        base = _cut(w, e)
        ok = True
        if e in ("han", "hen", "hin", "hon", "hän", "hön"):
            ok = base.endswith(e[1])
        elif e in ("siin", "den", "tten"):
            ok = len(base) > 1 and base[-1] == "i" and base[-2] in _FI
        elif e == "seen":
            ok = base.endswith(_FI_LONG)
        elif e in ("a", "ä"):
            ok = len(base) > 1 and base[-1] in _FI and base[-2] not in _FI
        elif e in ("tta", "ttä"):
            ok = base.endswith("e")
        if ok:
            if e == "n" and (base.endswith(_FI_LONG) or base.endswith("ie")):
                base = base[:-1]
            w, case = base, True
    e = _found(w, _by_size("mpi mpa mpä mmi mma mmä impi impa impä immi imma immä eja ejä"), r2)
    if e and not (e in ("mpi", "mpa", "mpä", "mmi", "mma", "mmä") and w[: -len(e)].endswith("po")):
        w = _cut(w, e)
    if case:
        if w[r1:].endswith(("i", "j")):
            w = w[:-1]
    elif w[r1:].endswith("t") and w[-2:-1] in tuple(_FI):
        w = w[:-1]
        e = _found(w, ["imma", "mma"], r2)
        if e and not (e == "mma" and w[:-3].endswith("po")):
            w = _cut(w, e)
    part = w[r1:]
    if part.endswith(_FI_LONG):
        w = w[:-1]
    part = w[r1:]
    if len(part) > 1 and part[-1] in "aäei" and part[-2] not in _FI:
        w = w[:-1]
    if w[r1:].endswith(("oj", "uj")):
        w = w[:-1]
    if w[r1:].endswith("jo"):
        w = w[:-1]
    for i in range(len(w) - 1, 0, -1):
        if w[i] not in _FI:
            return w[:i] + w[i + 1 :] if w[i] == w[i - 1] else w
    return w


# Hungarian

_HU = "aeiouöüáéíóőúű"
_HU_DIGRAPHS = ("cs", "dz", "gy", "ly", "ny", "sz", "ty", "zs", "ccs")
_HU_DOUBLE = ("bb", "cc", "ccs", "dd", "ff", "gg", "ggy", "jj", "kk", "ll", "lly", "mm", "nn", "nny", "pp", "rr", "ss", "ssz", "tt", "tty", "vv", "zz", "zzs")
_HU_CASES = _by_size("ban ben ba be ra re nak nek val vel tól től ról ről ból ből hoz hez höz nál nél ig at et ot öt ért képp képpen kor ul ül vá vé onként enként anként ként en on an ön n t")


def _hungarian_region(w: str) -> int:
    if w[:1] and w[0] in _HU:
        for i in range(1, len(w)):
            if w[i] not in _HU:
                return i + next((len(d) for d in ("dzs", *_HU_DIGRAPHS[:8]) if w.startswith(d, i)), 1)
        return len(w)
    return next((i + 1 for i in range(len(w)) if w[i] in _HU), len(w))


def _single(w: str) -> str:
    """A doubled consonant before the end, single."""
    d = next((x for x in sorted(_HU_DOUBLE, key=len, reverse=True) if w.endswith(x)), None)
    return w if d is None else w[: -len(d)] + d[1:]


@lru_cache(maxsize=100_000)
def hungarian(word: str) -> str:
    w = word.lower()
    r1 = _hungarian_region(w)

    def short(w: str) -> str:
        return w[:-1] + {"á": "a", "é": "e"}[w[-1]] if w[r1:].endswith(("á", "é")) else w

    e = _found(w, ["al", "el"], r1)
    if e and w[:-2].endswith(_HU_DOUBLE):
        w = _single(w[:-2])
    e = _found(w, _HU_CASES, r1)
    if e:
        w = short(_cut(w, e))
    e = _found(w, _by_size("ánként án én"), r1)
    if e:
        w = _cut(w, e, "e" if e == "én" else "a")
    e = _found(w, _by_size("astul estül stul stül ástul éstül"), r1)
    if e:
        w = _cut(w, e, {"ástul": "a", "éstül": "e"}.get(e, ""))
    e = _found(w, ["á", "é"], r1)
    if e and w[:-1].endswith(_HU_DOUBLE):
        w = _single(w[:-1])
    e = _found(w, _by_size("oké öké aké eké ké éké áké éi áéi ééi éié é"), r1)
    if e:
        w = _cut(w, e, "a" if e[0] == "á" else "e" if e in ("éké", "ééi", "éié") else "")
    e = _found(w, _by_size("ünk unk nk juk jük uk ük em om am m od ed ad öd d ja je a e o ájuk éjük ánk énk ám ém ád éd á é"), r1)
    if e:
        w = _cut(w, e, "a" if e[0] == "á" else "e" if e[0] == "é" else "")
    e = _found(w, _by_size("jaim jeim aim eim im jaid jeid aid eid id jai jei ai ei i jaink jeink eink aink ink jaitok jeitek aitok eitek itek jeik jaik aik eik ik áim éim áid éid ái éi áink éink áitok éitek áik éik"), r1)
    if e:
        w = _cut(w, e, "a" if e[0] == "á" else "e" if e[0] == "é" else "")
    e = _found(w, _by_size("ák ék ök ok ek ak k"), r1)
    if e:
        w = _cut(w, e, {"ák": "a", "ék": "e"}.get(e, ""))
    return w


# Romanian

_RO = "aeiouăâî"
_RO_0 = {"ul": "", "ului": "", "aua": "a", "ea": "e", "ele": "e", "elor": "e", "ii": "i", "iua": "i", "iei": "i", "iile": "i", "iilor": "i", "ilor": "i", "ile": "i", "atei": "at", "aţie": "aţi", "aţia": "aţi"}
_RO_1 = {x: to for to, xs in {
    "abil": "abilitate abilitati abilităi abilităţi", "ibil": "ibilitate", "iv": "ivitate ivitati ivităi ivităţi", "ic": "icitate icitati icităi icităţi icator icatori iciv iciva icive icivi icivă ical icala icale icali icală",
    "at": "ativ ativa ative ativi ativă aţiune atoare ator atori ătoare ător ători", "it": "itiv itiva itive itivi itivă iţiune itoare itor itori",
}.items() for x in xs.split()}
_RO_2 = _by_size("abil abila abile abili abilă ibil ibila ibile ibili ibilă at ata ate ati ată atu it ita ite iti ită ic ica ice ici ică ut uta ute uti ută anta ante anti antă ant os oasa oase oasă osi oşi iune iuni ism isme ist ista iste isti istă işti iv iva ive ivi ivă itate itati ităi ităţi ator atori ata")
_RO_V = _by_size(
    "are ere ire âre ind ând indu ându eze ească ez ezi ează esc eşti eşte ăsc ăşti ăşte am ai au eam eai ea eaţi eau iam iai ia iaţi iau ui aşi arăm arăţi ară uşi urăm urăţi ură işi irăm irăţi iră âi âşi ârăm ârăţi âră asem aseşi ase aserăm aserăţi aseră isem iseşi ise iserăm iserăţi iseră âsem âseşi âse âserăm âserăţi âseră usem useşi use userăm userăţi useră"
)
_RO_ALWAYS = _by_size("ăm aţi em eţi im iţi âm âţi seşi serăm serăţi seră sei se sesem seseşi sese seserăm seserăţi seseră")


@lru_cache(maxsize=100_000)
def romanian(word: str) -> str:
    w = word.lower().translate(str.maketrans("șț", "şţ"))
    w = re.sub(rf"(?<=[{_RO}])([ui])(?=[{_RO}])", lambda m: m[1].upper(), w)
    rv = _rv(w, _RO)
    r1, r2 = _regions(w, _RO)
    e = _end(w, _by_size(" ".join(_RO_0)))
    if e and _in(w, e, r1) and not (e == "ile" and w[:-3].endswith("ab")):
        w = _cut(w, e, _RO_0[e])
    first = False
    while True:
        e = _end(w, _by_size(" ".join(_RO_1)))
        if not e or not _in(w, e, r1):
            break
        w, first = _cut(w, e, _RO_1[e]), True
    e = _found(w, _RO_2, r2)
    second = bool(e)
    if e in ("iune", "iuni"):
        second = w[: -len(e)].endswith("ţ")
        w = _cut(w, e)[:-1] + "t" if second else w
    elif e and e.startswith("i") and e[:3] in ("ism", "ist", "işt"):
        w = _cut(w, e, "ist")
    elif e:
        w = _cut(w, e)
    if not first and not second:
        e = _found(w, _by_size(" ".join([*_RO_V, *_RO_ALWAYS])), rv)
        if e in _RO_ALWAYS:
            w = _cut(w, e)
        elif e:
            before = w[: -len(e)]
            if len(before) > rv and (before[-1] not in _RO or before[-1] == "u"):
                w = before
    e = _found(w, _by_size("ie a e i ă"), rv)
    return (_cut(w, e) if e else w).lower()


# Russian

_RU = "аеиоуыэюя"
_RU_PERFECT = (_by_size("в вши вшись"), _by_size("ив ивши ившись ыв ывши ывшись"))
_RU_ADJ = _by_size("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_RU_PART = (_by_size("ем нн вш ющ щ"), _by_size("ивш ывш ующ"))
_RU_VERB = (_by_size("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"), _by_size("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"))
_RU_NOUN = _by_size("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")


def _russian_regions(w: str) -> tuple[int, int]:
    rv = next((i + 1 for i, c in enumerate(w) if c in _RU), len(w))
    return rv, _regions(w, _RU)[1]


def _two(w: str, groups: tuple[list[str], list[str]], rv: int) -> str | None:
    """The longest ending of either group; one of the first has to follow а or я."""
    a = next((e for e in groups[0] if w[rv:].endswith(e) and w[: -len(e)][rv:].endswith(("а", "я"))), "")
    b = next((e for e in groups[1] if w[rv:].endswith(e)), "")
    best = a if len(a) > len(b) else b
    return best or None


@lru_cache(maxsize=100_000)
def russian(word: str) -> str:
    w = word.lower().replace("ё", "е")
    rv, r2 = _russian_regions(w)
    e = _two(w, _RU_PERFECT, rv)
    if e:
        w = _cut(w, e)
    else:
        x = _found(w, ["ся", "сь"], rv)
        w = _cut(w, x) if x else w
        a = _found(w, _RU_ADJ, rv)
        if a:
            w = _cut(w, a)
            p = _two(w, _RU_PART, rv)
            w = _cut(w, p) if p else w
        elif v := _two(w, _RU_VERB, rv):
            w = _cut(w, v)
        elif n := _found(w, _RU_NOUN, rv):
            w = _cut(w, n)
    if w[rv:].endswith("и"):
        w = w[:-1]
    x = _found(w, ["ость", "ост"], max(rv, r2))
    w = _cut(w, x) if x else w
    if w[rv:].endswith("нн"):
        return w[:-1]
    x = _found(w, ["ейше", "ейш"], rv)
    if x:
        w = _cut(w, x)
        return w[:-1] if w[rv:].endswith("нн") else w
    return w[:-1] if w[rv:].endswith("ь") else w
