import pytest

from wordloom.functions.stemming import stemmer_for_language

#: Pairs from the published vocabularies of the algorithms.
PAIRS = {
    "fr": "adresse adress lettres lettr continu continu continua continu continuait continu continuant continu continuation continu continue continu majestueusement majestu majesté majest malade malad maladies malad mains main quand quand",
    "it": "abbandonata abbandon abbandonate abbandon abbandono abband abbaruffato abbaruff pronto pront propaga propag",
    "pt": "boa boa boas boas boato boat boatos boat bobagem bobag bobagens bobagens bobalhões bobalhõ quilométricas quilométr quilômetros quilômetr química químic",
    "nl": "lichaamsziek lichaamsziek lichamelijk licham lichamelijke licham lichamelijkheden licham lichamen licham lichten licht kopij kopij koppen kopp kopers koper",
    "fi": "valitse valits koko koko erikoismerkit erikoismerk edeltänyt edeltäny innostuksen innostuks taloissa talo",
    "hu": "babakocsi babakocs babakocsijáért babakocs babakocsit babakocs házakban ház",
    "ro": "abruptă abrupt absent absent absenta absent absente absent",
    "ru": "важная важн важнейшие важн важно важн важности важност важностью важност вагон вагон вагона вагон вагонах вагон",
    "es": "chicas chic chico chic torneo torne tgue tgu", "sv": "jaktkarlarne jaktkarl klostret klostret", "en": "hello hello atlas atlas stars star",
}


@pytest.mark.parametrize("lang", sorted(PAIRS))
def test_stems_are_the_published_ones(lang):
    words = PAIRS[lang].split()
    stem = stemmer_for_language(lang)
    assert {w: stem(w) for w in words[::2]} == dict(zip(words[::2], words[1::2]))


@pytest.mark.parametrize("lang", "en de fr it pt nl fi hu ro ru es sv da no ar porter".split())
def test_any_string_has_a_stem(lang):
    stem = stemmer_for_language(lang)
    for w in ("", "a", "ää", "x" * 3000, "eeee", "ион", "gu", "ç", "aux", "ment", "yyyy", "日本", "é", "qu", "que", "iamo", "ista", "ость", "ttttt", "aei", "ccsccs"):
        assert isinstance(stem(w), str)
