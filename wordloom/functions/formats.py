"""Field types: how a column is analysed, what its postings carry, and how query text for it is read."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from fnmatch import fnmatchcase

from wordloom.functions import analysis as an


@dataclass
class FieldType:
    """analyzer: None if the column isn't indexed. positions: postings carry them. sortable: kept as a column of the docs table."""

    analyzer: an.Analyzer | None = None
    scorable: bool = False
    positions: bool = False
    stored: bool = False
    unique: bool = False
    sortable: bool = False
    field_boost: float = 1.0
    numeric: bool = False
    dated: bool = False
    boolean: bool = False
    multitoken: str = "default"
    queryor: bool = False
    spelling: bool = False
    options: dict = field(default_factory=dict)

    @property
    def indexed(self) -> bool:
        return self.analyzer is not None


def TEXT(analyzer: an.Analyzer | None = None, phrase: bool = True, stored: bool = False, field_boost: float = 1.0, sortable: bool = False, spelling: bool = False, multitoken_query: str = "default", lang: str | None = None) -> FieldType:
    return FieldType(analyzer or (an.LanguageAnalyzer(lang) if lang else an.StandardAnalyzer()), True, phrase, stored, sortable=sortable, field_boost=field_boost, multitoken=multitoken_query, spelling=spelling)


def ID(stored: bool = False, unique: bool = False, field_boost: float = 1.0, sortable: bool = False, analyzer: an.Analyzer | None = None) -> FieldType:
    return FieldType(analyzer or an.IDAnalyzer(), stored=stored, unique=unique, field_boost=field_boost, sortable=sortable)


def IDLIST(stored: bool = False, unique: bool = False, expression: str = r"[^\r\n\t ,;]+", field_boost: float = 1.0) -> FieldType:
    return FieldType(an.RegexAnalyzer(expression), stored=stored, unique=unique, field_boost=field_boost)


def KEYWORD(stored: bool = False, lowercase: bool = False, commas: bool = False, scorable: bool = False, unique: bool = False, field_boost: float = 1.0, sortable: bool = False) -> FieldType:
    return FieldType(an.KeywordAnalyzer(lowercase, commas), scorable, stored=stored, unique=unique, field_boost=field_boost, sortable=sortable)


def NUMERIC(numtype: type = int, stored: bool = False, unique: bool = False, sortable: bool = True, decimal_places: int = 0, signed: bool = True, default: float | None = None) -> FieldType:
    return FieldType(stored=stored, unique=unique, sortable=sortable, numeric=True, options={"type": numtype, "places": decimal_places, "signed": signed, "default": default})


def DATETIME(stored: bool = False, unique: bool = False, sortable: bool = True) -> FieldType:
    return FieldType(stored=stored, unique=unique, sortable=sortable, dated=True)


def BOOLEAN(stored: bool = False, field_boost: float = 1.0) -> FieldType:
    return FieldType(stored=stored, sortable=True, boolean=True, field_boost=field_boost)


def STORED() -> FieldType:
    return FieldType(stored=True)


def COLUMN() -> FieldType:
    return FieldType(sortable=True)


def NGRAM(minsize: int = 2, maxsize: int = 4, stored: bool = False, field_boost: float = 1.0, queryor: bool = False, phrase: bool = False) -> FieldType:
    return FieldType(an.NgramAnalyzer(minsize, maxsize), True, phrase, stored, field_boost=field_boost, queryor=queryor, multitoken="or" if queryor else "and")


def NGRAMWORDS(minsize: int = 2, maxsize: int = 4, stored: bool = False, field_boost: float = 1.0, tokenizer: an.Tokenizer | None = None, at: str | None = None, queryor: bool = False) -> FieldType:
    return FieldType(an.NgramWordAnalyzer(minsize, maxsize, tokenizer, at), True, False, stored, field_boost=field_boost, queryor=queryor, multitoken="or" if queryor else "and")


def REVERSED(sub: FieldType) -> FieldType:
    """A field of sub's terms written backwards, for searches by ending."""
    return FieldType(an.Analyzer([*sub.analyzer.parts(), an.ReverseTextFilter()]))


def SPELLING(sub: FieldType) -> FieldType:
    """A field of sub's words before their forms are changed."""
    return FieldType(an.Analyzer([s for s in sub.analyzer.parts() if not isinstance(s, (an.MapFilter, an.DoubleMetaphoneFilter))]))


class Schema:
    """Names of columns with their field types; patterns with * stand for columns that match them."""

    def __init__(self, **fields: FieldType):
        self.fields: dict[str, FieldType] = {}
        self.globs: dict[str, FieldType] = {}
        for name, kind in fields.items():
            self.add(name, kind)

    def add(self, name: str, kind: FieldType, glob: bool = False) -> Schema:
        if name.startswith("_") or " " in name:
            raise ValueError(f"a field can't be named {name!r}")
        (self.globs if glob else self.fields)[name] = kind
        return self

    def remove(self, name: str) -> Schema:
        if self.fields.pop(name, None) is None and self.globs.pop(name, None) is None:
            raise KeyError(name)
        return self

    def __getitem__(self, name: str) -> FieldType:
        if name in self.fields:
            return self.fields[name]
        for pattern, kind in self.globs.items():
            if fnmatchcase(name, pattern):
                return kind
        raise KeyError(name)

    def __contains__(self, name: str) -> bool:
        try:
            self[name]
        except KeyError:
            return False
        return True

    def names(self, columns: list[str] | None = None) -> list[str]:
        return list(self.fields) + [c for c in columns or () if c not in self.fields and c in self]

    def copy(self) -> Schema:
        out = Schema(**self.fields)
        out.globs = dict(self.globs)
        return out


class SchemaClass:
    """A schema as a class: attributes that are field types are its fields, those of base classes too. Names may begin or
    end with an underscore where the plain one is taken.

        class Mail(SchemaClass):
            title = TEXT(stored=True)
            sent = DATETIME()

        Mail.schema()
    """

    @classmethod
    def schema(cls) -> Schema:
        out = Schema()
        for base in reversed(cls.__mro__):
            for name, kind in vars(base).items():
                if isinstance(kind, FieldType):
                    out.add(name.strip("_"), kind)
        return out


def ensure_schema(x: Schema | type[SchemaClass]) -> Schema:
    if isinstance(x, type) and issubclass(x, SchemaClass):
        return x.schema()
    if not isinstance(x, Schema):
        raise TypeError(f"{x!r} is no schema")
    return x


def wrapped(kind: FieldType, **changes: object) -> FieldType:
    """A field type like another but for some of its settings."""
    return replace(kind, **changes)


def merge_schemas(schemas: list[Schema]) -> Schema:
    out = Schema()
    for s in schemas:
        out.fields |= s.fields
        out.globs |= s.globs
    return out
