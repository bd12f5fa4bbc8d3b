"""Names and persons against answers written by hand."""

import pytest

from zastera.functions import names
from zastera.operators import redact
from zastera.plans import cases

from .test_redact import work

LIBRARY = names.Library()


@pytest.mark.parametrize("form, want", cases.NOMINATIVES)
def test_nominative_of_a_surname(form, want):
    assert names.nominative_of(form) == want


@pytest.mark.parametrize("text, want", cases.PERSONS)
def test_person_in_any_case(text, want):
    assert [e["original"] for e in work(text, types=("PERSON",))[1]] == [want]


@pytest.mark.parametrize("text, n, variants", cases.LINKED)
def test_one_person_for_all_forms(text, n, variants):
    found = work(text, types=("PERSON",))[1]
    assert len(found) == n and (not n or ",".join(found[0]["variants"]) == variants)


@pytest.mark.parametrize("text, want", cases.SENTENCES)
def test_sentences(text, want):
    assert work(text)[0] == want


@pytest.mark.parametrize("text, want", cases.SURNAMES_ALONE)
def test_surnames_alone(text, want):
    assert work(text, surnames=True)[0] == want


def test_case_forms_by_hand():
    # Whole paradigms, in the order nom gen dat acc voc loc ins.
    table = {
        "Novák": "Novák Nováka Novákovi Nováka Nováku Novákovi Novákem", "Hájek": "Hájek Hájka Hájkovi Hájka Hájku Hájkovi Hájkem", "Procházka": "Procházka Procházky Procházkovi Procházku Procházko Procházkovi Procházkou",
        "Novotný": "Novotný Novotného Novotnému Novotného Novotný Novotném Novotným", "Krejčí": "Krejčí Krejčího Krejčímu Krejčího Krejčí Krejčím Krejčím", "Beneš": "Beneš Beneše Benešovi Beneše Beneši Benešovi Benešem",
        "Nováková": "Nováková Novákové Novákové Novákovou Nováková Novákové Novákovou", "Němec": "Němec Němce Němcovi Němce Němče Němcovi Němcem", "Havel": "Havel Havla Havlovi Havla Havle Havlovi Havlem", "Dvorský": "Dvorský Dvorského Dvorskému Dvorského Dvorský Dvorském Dvorským",
    }
    for n, row in table.items():
        made = names.forms(n)
        for case, form in zip(names.CASES, row.split(), strict=True):
            assert case in {c for _, c in made[form]}, (n, form, case)
    first = {"Petra": "Petra Petry Petře Petru Petro Petře Petrou", "Monika": "Monika Moniky Monice Moniku Moniko Monice Monikou", "Olga": "Olga Olgy Olze Olgu Olgo Olze Olgou", "Radek": "Radek Radka Radkovi Radka Radku Radkovi Radkem", "Marie": "Marie Marie Marii Marii Marie Marii Marií", "Zdeněk": "Zdeněk Zdeňka Zdeňkovi Zdeňka Zdeňku Zdeňkovi Zdeňkem", "Jiří": "Jiří Jiřího Jiřímu Jiřího Jiří Jiřím Jiřím", "Tomáš": "Tomáš Tomáše Tomášovi Tomáše Tomáši Tomášovi Tomášem"}
    for n, row in first.items():
        made = names.forms(n, names.FIRST, LIBRARY.gender[n])
        for case, form in zip(names.CASES, row.split(), strict=True):
            assert case in {c for _, c in made[form]}, (n, form, case)


@pytest.mark.parametrize("nominative, words, want", cases.VARIANTS)
def test_words_that_are_forms_of_a_surname(nominative, words, want):
    made = names.surname_forms(nominative)
    assert [w for w in words.split() if w in made] == want.split()


def test_surnames_that_lose_or_keep_their_e():
    # The genitive each surname has and the one it has not; where letters don't tell, both are given.
    for n, yes, no in [("Vlček", "Vlčka", "Vlčeka"), ("Marek", "Marka", "Mareka"), ("Michálek", "Michálka", "Micháleka"), ("Moravec", "Moravce", "Moravece"), ("Zdeněk", "Zdeňka", "Zdeněka"), ("Kozel", "Kozla", "Kozela")]:
        assert yes in names.surname_forms(n) and no not in names.surname_forms(n), n
    for n, yes in [("Doležel", "Doležela"), ("Nobel", "Nobela"), ("Dubček", "Dubčeka"), ("Šrek", "Šreka"), ("Luděk", "Luděka"), ("Daniel", "Daniela")]:
        assert yes in names.surname_forms(n), n
    # A form with an e too much still names the person.
    assert work("Přišel Jan Hájek. S Janem Hájekem mluvil pan Hájek.")[0] == "Přišel [[PERSON_1]]. S [[PERSON_1]] mluvil pan [[PERSON_1]]."


def test_readings_run_the_forms_backwards():
    """Every form of every surname in the cases leads back to it."""
    for _, n in cases.NOMINATIVES:
        for form, at in names.forms(n).items():
            for gender, case in at:
                assert (n, gender, case) in {(r.nominative, r.gender, r.case) for r in names.surname_readings(form)} or case == names.OTHER, (n, form, case)


def test_ambiguous_names_follow_the_document():
    text = "Petra Marka znali. Petr Marek o Petru Markovi."
    assert [e["original"] for e in work(text)[1]] == ["Petr Marek"]
    assert [e["original"] for e in work("Jana Nováková a Jana Nováka")[1]] == ["Jana Nováková", "Jan Novák"]


def test_a_library_of_one_s_own(spark):
    docs = spark.createDataFrame([(1, "Zoran Kos a Zoranem Kosem"), (2, "Jan Kos")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in redact.redacted(docs, names=(["Zoran"], [])).collect()}
    assert got == {1: "[[PERSON_1]] a [[PERSON_1]]", 2: "Jan Kos"}


def test_many_persons_stay_linear():
    import time

    first, last = names.MALE[:40], ["Novák", "Hájek", "Beneš", "Novotný", "Procházka"]
    text = " ".join(f"{a} {b}{chr(97 + k % 26)}ek přišel." for k in range(20) for a in first for b in ("Nov", "Dvor"))
    began = time.perf_counter()
    work(text)
    one = time.perf_counter() - began
    began = time.perf_counter()
    work(text * 4)
    assert time.perf_counter() - began < 10 * one + 0.5 and last
