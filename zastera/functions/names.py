"""Czech personal names by paradigms: case forms of a nominative, and the nominatives that a form may belong to.

A paradigm says what nominatives it fits and what endings replace theirs in each case. Forms are made by running it
forwards, readings (nominative, gender, case) by running it backwards. A first name and a surname that stand together
have to agree in gender and case, which settles most of what a form alone leaves open.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The most frequent first names in the Czech Republic by the Ministry of the Interior's public counts,
# then some frequent English ones; a full library can be read with sources.names_library.
MALE = "Jiří Jan Petr Josef Pavel Martin Tomáš Jaroslav Miroslav Zdeněk František Václav Michal Milan Karel Jakub Lukáš David Vladimír Ladislav Ondřej Roman Stanislav Marek Radek Daniel Antonín Vojtěch Filip Adam Miloslav Matěj Aleš Jaromír Libor Dominik Patrik Vlastimil Jindřich Miloš Oldřich Lubomír Rudolf Ivan Luboš Robert Štěpán Dušan Vladislav Vít Bohumil Ivo Kryštof Šimon Radim Richard Marcel Igor Viktor Kamil Ota Bedřich Erik Hynek James John Michael William Thomas Charles".split()
FEMALE = "Jana Marie Eva Hana Anna Lenka Kateřina Věra Lucie Alena Petra Jaroslava Ludmila Martina Helena Jitka Michaela Veronika Jarmila Tereza Ivana Zdeňka Monika Jiřina Zuzana Markéta Eliška Marcela Barbora Dagmar Dana Kristýna Vlasta Božena Miroslava Irena Libuše Pavla Marta Šárka Nikola Denisa Adéla Klára Simona Natálie Andrea Gabriela Karolína Renata Iveta Blanka Olga Kamila Radka Aneta Iva Ilona Růžena Milena Soňa Daniela Romana Mary Patricia Linda Elizabeth Sarah".split()

_ACCENTS, _PLAIN = "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽäöüÄÖÜ", "acdeeinorstuuyzACDEEINORSTUUYZaouAOU"
NOM, GEN, DAT, ACC, VOC, LOC, INS = CASES = ("nom", "gen", "dat", "acc", "voc", "loc", "ins")
#: Forms of a family, or that say whose something is; they name a person but stand in no case with a first name.
OTHER = "other"
SOFT, HARD = "cčďjňřšťž", "bdfghklmnprstvwxz"


def normalize_key(x: Column) -> Column:
    """Letters a-z only: no accents, lower case."""
    return F.lower(F.regexp_replace(F.translate(x, _ACCENTS, _PLAIN), "[^A-Za-z]", ""))


def fold(x: str) -> str:
    """normalize_key of a Python string."""
    return re.sub("[^a-z]", "", "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)).lower())


class Paradigm(NamedTuple):
    gender: str
    fits: str  # pattern of the nominatives
    cut: int  # letters of the nominative that endings replace
    back: str  # what the endings replaced
    endings: dict[str, str]  # case: endings, separated by spaces; "-" for none
    cost: int = 0  # how unlikely it is that a surname goes like this


def _p(gender: str, fits: str, back: str, *endings: str, other: str = "", cost: int = 0) -> Paradigm:
    return Paradigm(gender, fits, len(back), back, dict(zip(CASES, endings, strict=True)) | ({OTHER: other} if other else {}), cost)


_POSS = "ův ova ovo ovy ově ovu ovou ových ovým ovými"
_FAMILY = "ovi ové ů ům y ech"
SURNAMES = [
    _p("M", f"[^aeiouyáéíóúůýě][aeiouyáéíóúůýě][{HARD}]$|[lnrs][bdfghkmnprstvz]$|[td]r$|ch$|[aeiou][aeiou][lnr]$", "", "-", "a", "ovi u", "a", "e u", "ovi u", "em", other=f"{_FAMILY} {_POSS}"),
    _p("M", f"[{SOFT}lsz]$", "", "-", "e", "ovi i", "e", "i", "ovi i", "em", other=f"ovi ové ů ům {_POSS}"),
    _p("M", "[ťďň]$", "", "-", "ě", "ovi i", "ě", "i", "ovi i", "ěm", other=_POSS, cost=1),
    _p("M", "něk$", "něk", "něk", "ňka", "ňkovi ňku", "ňka", "ňku", "ňkovi ňku", "ňkem", other="ňkovi ňkové ňků ňkům ňkův ňkova ňkovo ňkovy ňkově ňkovu ňkovou"),
    _p("M", "[^aeiouyáéíóúůýěň]ek$", "ek", "ek", "ka", "kovi ku", "ka", "ku", "kovi ku", "kem", other="kovi kové ků kům ky cích kův kova kovo kovy kově kovu kovou"),
    _p("M", "[^aeiouyáéíóúůýě]el$", "el", "el", "la", "lovi lu", "la", "le", "lovi lu", "lem", other="lovi lové lů lům ly lův lova lovo lovy lově lovu lovou"),
    _p("M", "[^aeiouyáéíóúůýě]ec$", "ec", "ec", "ce", "covi ci", "ce", "če", "covi ci", "cem", other="covi cové ců cům ci cův cova covo covy cově covu covou"),
    _p("M", "[^aeiouyáéíóúůýě]a$", "a", "a", "y", "ovi", "u", "o", "ovi", "ou", other=f"ovi ové ů ům {_POSS}"),
    _p("M", f"[{SOFT}]a$", "a", "a", "i", "ovi", "u", "o", "ovi", "ou", other=_POSS, cost=1),
    _p("M", "[^aeiouyáéíóúůýě]o$", "o", "o", "a", "ovi u", "a", "o", "ovi u", "em", other=_FAMILY, cost=2),
    _p("M", "ý$", "ý", "ý", "ého", "ému", "ého", "ý", "ém", "ým", other="í ých ými"),
    _p("M", "í$", "í", "í", "ího", "ímu", "ího", "í", "ím", "ím"),
    _p("M", "ů$", "", "-", "-", "-", "-", "-", "-", "-", cost=1),
    _p("F", "á$", "á", "á", "é", "é", "ou", "á", "é", "ou"),
    _p("F", "í$", "", "-", "-", "-", "-", "-", "-", "-"),
    _p("F", "[^áíaou]$", "", "-", "-", "-", "-", "-", "-", "-", cost=6),
]
_AFTER_E = {"ch": "š", "k": "c", "h": "z", "g": "z", "r": "ř"}
FIRST = [
    *(p for p in SURNAMES if p.gender == "M" and p.back != "ů"),
    _p("F", "[bdfmnptv]a$", "a", "a", "y", "ě", "u", "o", "ě", "ou", other="in ina ino iny ině inu inou iných"),
    _p("F", "[lsz]a$", "a", "a", "y", "e", "u", "o", "e", "ou", other="in ina ino iny ině inu inou iných"),
    *(_p("F", f"{k}a$", f"{k}a", f"{k}a", f"{k}y", f"{v}e", f"{k}u", f"{k}o", f"{v}e", f"{k}ou", other=" ".join(v.replace("c", "č").replace("z", "ž") + e for e in "in ina ino iny ině inu inou iných".split())) for k, v in _AFTER_E.items()),
    _p("F", f"[{SOFT}]a$", "a", "a", "i", "e i", "u", "o", "e i", "ou", other="in ina ino iny inu inou"),
    _p("F", "e?a$", "a", "a", "y i", "e i", "u", "o", "e i", "ou", cost=1),
    _p("F", "ie$", "ie", "ie", "ie", "ii", "ii", "ie", "ii", "ií"),
    _p("F", "[^i]e$", "e", "e", "e", "i", "i", "e", "i", "í"),
    _p("F", "[rlnhy]$", "", "-", "- y", "- ě", "- u", "-", "- ě", "- ou", cost=1),
]


def _ends(p: Paradigm) -> list[tuple[str, str]]:
    return [(case, "" if e == "-" else e) for case, all_ in p.endings.items() for e in all_.split()]


def forms(nominative: str, paradigms: list[Paradigm] = SURNAMES, gender: str | None = None) -> dict[str, set[tuple[str, str]]]:
    """Form: the (gender, case) it may have. Forms that only belong to a family or say whose have the case OTHER."""
    out: dict[str, set[tuple[str, str]]] = {nominative: set()}
    for p in paradigms:
        if gender in (None, p.gender) and re.search(p.fits, nominative) and nominative.endswith(p.back) and p.cost < 6:
            stem = nominative[: len(nominative) - p.cut]
            for case, e in _ends(p):
                out.setdefault(stem + e, set()).add((p.gender, case))
    return out


class Reading(NamedTuple):
    nominative: str
    gender: str
    case: str
    cost: int


#: Endings of forms that no nominative has.
_NEVER = re.compile("(?:ova|é[hm][ao]?|ého|ému|ovou|ových|ům)$")


def readings(form: str, paradigms: list[Paradigm] = SURNAMES) -> list[Reading]:
    """The nominatives that a form may belong to."""
    best: dict[tuple[str, str, str], int] = {}
    for p in paradigms:
        for case, e in _ends(p):
            stem = form[: len(form) - len(e)] if e else form
            if form.endswith(e) and len(stem) + len(p.back) >= 3 and len(stem) >= 2 and re.search(p.fits, stem + p.back) and not _NEVER.search(stem + p.back):
                key = (stem + p.back, p.gender, case)
                best[key] = min(best.get(key, 99), p.cost + (case != NOM) + (2 if case == OTHER else 0))
    return [Reading(*k, cost) for k, cost in best.items()]


@lru_cache(maxsize=100_000)
def surname_readings(form: str) -> tuple[Reading, ...]:
    return tuple(sorted(readings(form), key=lambda r: (r.cost, r.nominative)))


_VOWEL = "aeiouyáéíóúůýě"
_NOMINATIVE = re.compile(f"(?:[^{_VOWEL}][{_VOWEL}][bcčdďfghjklmnňprřsštťvzž]|[lnrs][bcčdďfghjkmpřsštvzž]|[aiyáíýů])$")
_OBLIQUE = re.compile(f"(?:ého|ému|ým|ém|ího|ímu|ím|ovi|em|ou|é|ě|u|[^{_VOWEL}]y|[^{_VOWEL}][kl]a|[rřšžčjk]e|[nvrkdtlmszb]a|[^{_VOWEL}]ce)$")
#: Endings in -a that are nominatives more often than genitives, and those of genitives among them.
_KEPT = re.compile("(?:[zžčřdtšbp]ka|[aáeiíouúůý][cčdtř]ka|oda|[čšžcř]era|[oiaě]ra|ina|[ioa]la|[lnr][dt]a|ová|sta|ěna)$")
_SHORT = re.compile("(?:[áíů]čka|[áí]nka|ežala|lčka|ěpánka)$")
_ADJECTIVE = re.compile("(?:[bcčdkprřsštvz]n|esel|^Mal|^Star|ouh|uch|sk|ck|ov)(?:ou|é)$")


def nominative_of(form: str, gender: str | None = None) -> str:
    """The likeliest nominative of a surname that stands alone.

    Without a first name beside it a form may be a nominative: Procházka and Svoboda stay. Forms that look like no
    nominative go back to the shortest way there.
    """
    found = [r for r in surname_readings(form) if gender in (None, r.gender) and r.case != OTHER]
    if not found or _NOMINATIVE.search(form) and (not _OBLIQUE.search(form) or _KEPT.search(form)) and not _SHORT.search(form):
        return form
    woman = bool(_ADJECTIVE.search(form))
    order = sorted(found, key=lambda r: (r.case == NOM, r.cost, (r.gender == "F") != woman, not r.nominative.endswith(("ek", "ěk", "el", "ec", "ová", "ský", "cký")), r.nominative))
    return order[0].nominative


def stem(surname: str) -> str:
    """What the surnames of a family, and their forms, begin with: Procházka, Procházková and Procházkou give procházk."""
    x = surname.lower()
    for end, back in (("ová", ""), ("ové", ""), ("ovou", ""), ("ek", "k"), ("el", "l"), ("ec", "c"), ("ého", ""), ("ému", ""), ("ovi", ""), ("em", ""), ("ým", ""), ("ém", ""), ("ou", ""), ("a", ""), ("á", ""), ("ý", ""), ("é", ""), ("y", ""), ("u", ""), ("e", ""), ("ě", "")):
        if x.endswith(end) and len(x) - len(end) >= 2:
            return x[: -len(end)] + back
    return x


class Library:
    """First names, by every form they may stand in."""

    def __init__(self, male: list[str] = MALE, female: list[str] = FEMALE):
        self.by_form: dict[str, list[Reading]] = {}
        self.gender = {n: "M" for n in male} | {n: "F" for n in female}
        for gender, names in (("M", male), ("F", female)):
            for n in names:
                self.by_form.setdefault(n, []).append(Reading(n, gender, NOM, 0))
                for form, at in forms(n, FIRST, gender).items():
                    self.by_form.setdefault(form, []).extend(Reading(n, g, case, int(case != NOM) + 2 * (case == OTHER)) for g, case in at if (form, case) != (n, NOM))

    def find(self, form: str) -> list[Reading]:
        return self.by_form.get(form, [])

    def __contains__(self, form: str) -> bool:
        return any(r.case != OTHER for r in self.find(form))


#: Last letters of a word that may be a first name though no library has it, by its length.
_ENDS = {3: "aeiouyáéíóúůýnlr", 4: "aeiouyáéíóúůýnlršm", 5: "aeiouyáéíóúůýnlršm"}


def may_be_first(word: str) -> bool:
    return len(word) >= 3 and word[-1] in _ENDS.get(len(word), word[-1])


def first_readings(form: str, library: Library) -> list[Reading]:
    """Of a first name: those of the library, or else what paradigms allow."""
    found = [r for r in library.find(form) if r.case != OTHER]
    if found or not may_be_first(form):
        return found
    return [r._replace(cost=r.cost + 3) for r in readings(form, FIRST) if r.case != OTHER and may_be_first(r.nominative)]


def agreeing(first: str, last: str, library: Library) -> list[tuple[str, str, str, int]]:
    """(first name, surname, gender, cost) of every reading of two words in which they agree, the best first."""
    found: dict[tuple[str, str, str], int] = {}
    surnames = surname_readings(last)
    for a in first_readings(first, library):
        for b in surnames:
            if a.gender == b.gender and a.case == b.case:
                key = (a.nominative, b.nominative, a.gender)
                found[key] = min(found.get(key, 99), a.cost + b.cost)
    return sorted(((*k, c) for k, c in found.items()), key=lambda x: (x[3], not x[1].endswith(("ek", "el", "ec")) , x[:3]))


#: Surnames whose e goes in all cases but the nominative: those in -ek, -něk and -ec with one consonant between a vowel,
#: or a syllabic l or r, and the ending. In -el letters don't tell (Doležel and Nobel keep it), so some are named.
_FLEETING = re.compile(f"(?:[{_VOWEL}]|[^{_VOWEL}][lr])(?:něk|(?:ch|[^{_VOWEL}ň])e[kc])$|^(?:Hav|Kar|Koz|Or|Pav|Vor)el$", re.IGNORECASE)


@lru_cache(maxsize=100_000)
def surname_forms(nominative: str) -> tuple[str, ...]:
    """Sorted case forms of a surname, without those that keep an e which has to go: Hájkem, not Hájekem.

    Texts are searched by the wider person_forms, as a misspelt form names the person too.
    """
    paradigms = [p for p in SURNAMES if p.back or p.gender == "F"] if _FLEETING.search(nominative) else SURNAMES
    return tuple(sorted(forms(nominative, paradigms)))


def person_forms(first: str, last: str, gender: str) -> tuple[set[str], set[str]]:
    """All forms of a person's first name and of the surname."""
    return set(forms(first, FIRST, gender)) if first else set(), set(forms(last, SURNAMES, gender)) if last else set()


@F.pandas_udf(T.StringType())
def surname_nominative(x: pd.Series) -> pd.Series:
    """nominative_of, for a column."""
    return x.map(nominative_of, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def surname_variants(x: pd.Series) -> pd.Series:
    """Sorted case forms of a column of nominatives; a form may be one of a woman, a man or a family."""
    return x.map(lambda n: list(surname_forms(n)), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def first_name_variants(x: pd.Series) -> pd.Series:
    return x.map(lambda n: sorted(forms(n, FIRST)), na_action="ignore")


@F.pandas_udf(T.StringType())
def first_name_nominative(x: pd.Series) -> pd.Series:
    """Of the library's names; other words as they are, capitalised."""
    library = Library()
    pick = lambda w: min(library.find(w.capitalize()), key=lambda r: (r.cost, r.nominative), default=Reading(w.capitalize(), "", "", 0)).nominative
    return x.map(pick, na_action="ignore")


def library(spark: SparkSession, male: list[str] = MALE, female: list[str] = FEMALE) -> DataFrame:
    """(form, first, gender): case forms of the library's first names."""
    rows = {(form, r.nominative, r.gender) for form, all_ in Library(male, female).by_form.items() for r in all_ if r.case != OTHER}
    return spark.createDataFrame(sorted(rows), "form string, first string, gender string")
