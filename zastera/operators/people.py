"""Persons of a document: capitalised words that read as names, one person for all case forms, and every further place.

1. Neighbouring words of which the first is a form of a known first name and that agree in gender and case are a
   candidate; so is any other pair that a title, a word of STRONG or the surname's ending speaks for. Each pair in a
   run of capitalised words is tried, so what stands before a name doesn't hide it. Words of KINDS are no persons.
2. A candidate may have several readings (Jana Nováka: Jan Novák); it takes the one that most candidates of the
   document have, and of those the likeliest.
3. Then all forms of the persons found are looked for in the whole document, earlier places too, in any case and
   without accents, in both orders of the names; further surnames and first names alone, initials and maiden names.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

from zastera.functions.detectors import LOW, UP
from zastera.functions.names import Library, agreeing, first_readings, fold, nominative_of, person_forms, surname_readings
from zastera.functions.words import ADDRESS_WORDS, KIND_OF, STRONG, SURNAME_ENDINGS, TITLES, VERBS

WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
NAME = re.compile(rf"[{UP}][{LOW}]+(?:-[{UP}][{LOW}]+)?$|[{UP}]{{2,}}$")
CAPITALS = re.compile(rf"(?<!\w)(?:[{UP}][{LOW}]+|[{UP}]{{2,}})(?!\w)")
MAIDEN = re.compile(rf"\((?:rozen(?:á|ou|é)|roz\.|dříve|dřív|původně)[ \xa0]+([{UP}][{LOW}]+)\)", re.I)
INITIALS = re.compile(rf"(?<!\w)([{UP}])\.[ \xa0]?(?:([{UP}])\.(?![ \xa0]?[{UP}][.{LOW}])|([{UP}][{LOW}]+))")
SIGN = re.compile(rf"(?<!\w)(?:{'|'.join(STRONG)})(?!\w)", re.I)
#: Kinds of words that may be surnames all the same: Eva Malá.
WEAK = ("PLACE", "TERM")
ADDRESS, SPEECH, SIGNS, TITLE = map(frozenset, (ADDRESS_WORDS, VERBS, STRONG, TITLES))
#: How far a word of STRONG may stand from a name.
NEAR = 24


class Person(NamedTuple):
    start: int
    stop: int
    surface: str
    type: str  # PERSON, or a kind of thing that isn't one
    key: tuple
    original: str
    confidence: float


class _Word(NamedTuple):
    start: int
    stop: int
    text: str


class _Candidate(NamedTuple):
    start: int
    stop: int
    options: list[tuple[str, str, str, int]]  # first names, surname, gender, cost
    confidence: float


class _Known(NamedTuple):
    first: str
    last: str
    gender: str
    first_forms: set[str]  # folded
    last_forms: set[str]

    @property
    def key(self) -> tuple:
        return fold(self.first), fold(self.last), self.gender

    @property
    def original(self) -> str:
        return " ".join(x for x in (self.first, self.last) if x)


class People:
    def __init__(self, library: Library, config):
        self.library, self.config = library, config
        self.first_words = {f for f in library.by_form if f in library}
        self.kinds = {k for k in ("ORG", "PLACE", "PRODUCT", "TERM") if config.wants(k)}

    def find(self, text: str) -> list[Person]:
        """The persons of a text, without overlaps."""
        capital = {m[0] for m in CAPITALS.finditer(text)}
        title = {w if len(w) < 2 or not w.isupper() else w.capitalize() for w in capital}
        maiden = "(" in text and bool(MAIDEN.search(text))
        if not (maiden or self.kinds or title & self.first_words or any(w.endswith(SURNAME_ENDINGS) or w in TITLE for w in title) or len(title) > 1 and SIGN.search(text)):
            return []
        words = [_Word(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
        found = self._candidates(text, words)
        known = self._chosen(found)
        out = [Person(c.start, c.stop, text[c.start : c.stop], "PERSON", p.key, p.original, c.confidence) for c, p in known]
        people = {p.key: p for _, p in known}
        taken = {i for c, _ in known for i in range(c.start, c.stop)}
        for m in MAIDEN.finditer(text) if maiden else ():
            if m.start(1) not in taken:
                out.append(self._alone(m.start(1), m[1], "", nominative_of(m[1], "F"), people, 0.9))
                taken.update(range(*m.span(1)))
        out += self._everywhere(text, words, people, taken)
        out += self._things(text, words, taken)
        return sorted(out)

    def _candidates(self, text: str, words: list[_Word]) -> list[_Candidate]:
        found, k = [], 0
        while k < len(words):
            c = self._at(text, words, k)
            if c is None:
                k += 1
                continue
            found.append(c[0])
            k = c[1]
        return found

    @staticmethod
    def _beside(text: str, a: _Word, b: _Word) -> bool:
        return b.start == a.stop + 1 and text[a.stop] in " \xa0"

    def _at(self, text: str, words: list[_Word], k: int) -> tuple[_Candidate, int] | None:
        """The candidate whose first name is word k, and the next word to look at."""
        if not NAME.match(words[k].text):
            return None
        run = [k]
        while len(run) < 5 and run[-1] + 1 < len(words) and self._beside(text, words[run[-1]], words[run[-1] + 1]) and NAME.match(words[run[-1] + 1].text):
            run.append(run[-1] + 1)
        if len(run) < 2:
            return None
        show = [w.capitalize() if w.isupper() else w for w in (words[i].text for i in run)]
        if show[0] in self.first_words:
            n = 1
            while n + 1 < len(run) and show[n] in self.first_words and KIND_OF.get(show[n + 1].lower()) is None:
                n += 1
            options = agreeing(show[0], show[n], self.library)
            kind = KIND_OF.get(show[n].lower())
            if kind in ("ORG", "PRODUCT", "ROLE") or kind and not options:
                return None
            if n > 1:  # further first names go in the nominative too
                middle = " ".join(min(first_readings(x, self.library), key=lambda r: (r.cost, r.nominative)).nominative for x in show[1:n])
                options = [(f"{a} {middle}", *rest) for a, *rest in options]
            if not options:
                best = min(self.library.find(show[0]), key=lambda r: (r.cost, r.nominative))
                options = [(best.nominative, nominative_of(show[n], best.gender), best.gender, best.cost)]
            if n + 1 < len(run) and show[n].endswith(("ová", "ové", "ovou")) and show[n + 1].endswith(("ová", "ové", "ovou", "á", "é", "ou")) and KIND_OF.get(show[n + 1].lower()) in (None, *WEAK):
                second = [r.nominative for r in surname_readings(show[n + 1]) if r.gender == "F" and r.nominative.endswith("á")]
                if second:  # a second surname
                    n += 1
                    options = [(a, f"{b} {second[0]}", *rest) for a, b, *rest in options]
            confidence = 0.95 if options[0][3] <= 2 else 0.8
        else:
            n = 1
            if KIND_OF.get(show[0].lower()) or KIND_OF.get(show[1].lower()) or show[0].lower() in ADDRESS or TITLE & {*show[:2]}:
                return None
            before, after = words[run[0] - 1] if run[0] else None, text[words[run[1]].stop : words[run[1]].stop + NEAR]
            titled = before is not None and before.text in TITLE and words[run[0]].start - before.stop <= 2
            near = {w.lower() for w in WORD.findall(text[max(0, words[k].start - NEAR) : words[k].start])} | {m[0].lower() for m in WORD.finditer(after)}
            polite = before is not None and before.text.lower() in ADDRESS
            if not (titled or polite or near & SIGNS or show[1].endswith(SURNAME_ENDINGS)):
                return None
            # The surname may stand first.
            swapped = show[1] in self.first_words
            options = agreeing(*(show[1::-1] if swapped else show[:2]), self.library)
            if not options:
                if not titled:
                    return None
                options = [(show[0], nominative_of(show[1]), "F" if show[1].endswith("á") else "M", 5)]
            confidence = 0.85 if titled else 0.7
        return _Candidate(words[k].start, words[run[n]].stop, options, confidence), run[n] + 1

    def _chosen(self, found: list[_Candidate]) -> list[tuple[_Candidate, _Known]]:
        given = lambda o: (fold(o[0].split(" ")[0]), fold(o[1]), o[2])
        support = Counter(x for c in found for x in {given(o) for o in c.options})
        least = {x: min(o[3] for c in found for o in c.options if given(o) == x) for x in support}
        people: dict[tuple, _Known] = {}
        out = []
        for c in found:
            o = min(c.options, key=lambda o: (-support[given(o)], least[given(o)], o[3], not o[1].endswith(("ek", "ěk", "el", "ec")), o))
            key = given(o)
            if key not in people:
                first, last = person_forms(o[0].split(" ")[0], o[1].split(" ")[0], o[2])
                people[key] = _Known(o[0], o[1], o[2], {fold(x) for x in first}, {fold(x) for x in last} | {fold(o[1])})
            out.append((c, people[key]))
        return out

    def _alone(self, start: int, surface: str, first: str, last: str, people: dict, confidence: float) -> Person:
        """A person of whom one name is known."""
        gender = "F" if last.endswith("á") else "M"
        p = _Known(first, last, gender, *({fold(x) for x in names} for names in person_forms(first, last, gender)))
        people.setdefault(p.key, p)
        return Person(start, start + len(surface), surface, "PERSON", p.key, p.original, confidence)

    def _everywhere(self, text: str, words: list[_Word], people: dict[tuple, _Known], taken: set[int]) -> list[Person]:
        out: list[Person] = []
        by_last: dict[str, list[_Known]] = {}
        for p in people.values():
            for x in p.last_forms if p.first and p.last else ():
                by_last.setdefault(x, []).append(p)

        def put(a: int, b: int, p: _Known, confidence: float) -> None:
            out.append(Person(a, b, text[a:b], "PERSON", p.key, p.original, confidence))
            taken.update(range(a, b))

        folded = [fold(w.text) for w in words]
        for k in range(len(words) - 1):
            a, b = words[k], words[k + 1]
            if a.start in taken or b.start in taken or not self._beside(text, a, b):
                continue
            for x, y in ((folded[k], folded[k + 1]), (folded[k + 1], folded[k])):
                p = next((p for p in by_last.get(y, ()) if x in p.first_forms), None)
                if p and a.start not in taken:
                    put(a.start, b.stop, p, 0.9)
        only = lambda found: found[0] if len(found) == 1 else None
        for m in INITIALS.finditer(text):
            if any(i in taken for i in range(*m.span())):
                continue
            if m[3]:
                p = only([p for p in by_last.get(fold(m[3]), ()) if p.first[:1] == m[1]])
            else:
                p = None if self.config.keep_initials else only([p for p in people.values() if p.first[:1] == m[1] and p.last[:1] == m[2]])
            if p:
                put(*m.span(), p, 0.8)
        for k, w in enumerate(words):
            if w.start in taken or not NAME.match(w.text) or w.text.isupper():
                continue
            before = words[k - 1] if k and self._beside(text, words[k - 1], w) else None
            after = words[k + 1] if k + 1 < len(words) and self._beside(text, w, words[k + 1]) else None
            polite = before is not None and before.text.lower() in ADDRESS
            speaks = after is not None and after.text in SPEECH
            if not (polite or speaks) or before is not None and NAME.match(before.text) and not polite or after is not None and NAME.match(after.text):
                continue
            p = only(by_last.get(folded[k], []))
            if p:
                put(w.start, w.stop, p, 0.85)
            elif speaks and w.text in self.first_words and KIND_OF.get(w.text.lower()) is None:
                first = min(self.library.find(w.text), key=lambda r: (r.cost, r.nominative))
                p = only([p for p in people.values() if fold(w.text) in p.first_forms and p.last])
                if p:
                    put(w.start, w.stop, p, 0.8)
                elif first.cost == 0:
                    out.append(self._alone(w.start, w.text, first.nominative, "", people, 0.7))
                    taken.update(range(w.start, w.stop))
            elif self.config.surnames and KIND_OF.get(w.text.lower()) in (None, *(WEAK if polite else ())) and (polite or w.text.endswith(SURNAME_ENDINGS)):
                out.append(self._alone(w.start, w.text, "", nominative_of(w.text), people, 0.6))
                taken.update(range(w.start, w.stop))
        return out

    def _things(self, text: str, words: list[_Word], taken: set[int]) -> list[Person]:
        """Runs of capitalised words that name an organisation, place, product or term."""
        out: list[Person] = []
        k = 0
        while self.kinds and k < len(words):
            stop = k
            while NAME.match(words[stop].text) and words[stop].start not in taken and stop + 1 < len(words) and self._beside(text, words[stop], words[stop + 1]) and NAME.match(words[stop + 1].text) and words[stop + 1].start not in taken:
                stop += 1
            kind = next((x for x in (KIND_OF.get(w.text.lower()) for w in words[k : stop + 1]) if x in self.kinds), None)
            if stop > k and kind:
                a, b = words[k].start, words[stop].stop
                out.append(Person(a, b, text[a:b], kind, (text[a:b],), text[a:b], 0.6))
            k = stop + 1
        return out
