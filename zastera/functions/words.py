"""Word lists of the person rules: own choices, kept short, by what a word says about a name beside it."""

from __future__ import annotations

# Titles before and after a name, and forms of address.
TITLES = ("Ing", "Mgr", "MgA", "Bc", "BcA", "MUDr", "MDDr", "MVDr", "JUDr", "PhDr", "RNDr", "PaedDr", "ThDr", "PharmDr", "Dr", "Prof", "prof", "Doc", "doc", "Mr", "Mrs", "Ms")
TITLES_AFTER = ("Ph.D.", "CSc.", "DrSc.", "MBA", "LL.M.", "DiS.")
ADDRESS_WORDS = ("pan", "pana", "panu", "pane", "panem", "paní", "slečna", "slečnu", "slečně", "slečnou")

# Words before or behind a name that make it a person's.
STRONG = ("nar", "narozen", "narozena", "narozená", "bytem", "bydliště", "dlužník", "dlužníka", "dlužníkovi", "věřitel", "věřitele", "věřiteli", "žalobce", "žalovaný", "kupující", "prodávající", "nájemce", "pronajímatel", "zaměstnanec", "pacient", "pacientka", "svědek", "svědkyně")

# Verbs of persons, after which a name that stands alone is one.
VERBS = ("uvedl", "uvedla", "řekl", "řekla", "potvrdil", "potvrdila", "pracoval", "pracovala", "byl", "byla", "je", "má", "měl", "měla", "jako", "podepsal", "podepsala", "souhlasil", "souhlasila", "požádal", "požádala", "dělal", "dělala", "jsou")

#: No first names, whatever follows: by the kind of thing they begin.
KINDS = {
    "TERM": ("místo", "datum", "číslo", "smlouva", "dohoda", "příloha", "článek", "částka", "kontakt", "telefon", "email", "adresa", "sídlo", "vážený", "vážená", "dobrý", "rodné", "celkem", "dne", "strana", "odstavec", "zákon", "občanský", "trestní", "obchodní", "všeobecné", "podmínky"),
    "ROLE": ("jednatel", "jednatelka", "ředitel", "ředitelka", "předseda", "předsedkyně", "manažer", "manažerka", "manager", "director", "chief", "officer", "head", "lead", "senior", "junior", "specialist", "consultant", "coordinator", "developer", "architect", "engineer", "analyst", "lékař", "lékařka", "doktor", "sestra", "auditor", "účetní", "advokát", "notář", "notářka", "kupující", "prodávající", "dlužník", "věřitel", "pacient", "vyšetřující", "vyšetřovatel"),
    "PLACE": ("praha", "brno", "ostrava", "plzeň", "olomouc", "liberec", "staré", "nové", "malá", "město", "náměstí", "nádraží", "ulice", "třída", "česká", "slovenská", "evropa", "amerika", "asie", "afrika", "morava", "čechy", "london", "new", "hlavní", "václavské", "republic", "republika", "czech"),
    "ORG": ("firma", "společnost", "banka", "spořitelna", "pojišťovna", "univerzita", "university", "fakulta", "klinika", "nemocnice", "poliklinika", "centrum", "center", "ústav", "institut", "institute", "akademie", "academy", "gymnázium", "škola", "úřad", "ministerstvo", "soud", "policie", "group", "company", "holding", "holdings", "capital", "partners", "ventures", "fund", "services", "service", "bank", "clinic", "healthcare", "pharma", "solutions", "inc", "ltd", "corp", "gmbh", "llc"),
    "PRODUCT": ("windows", "linux", "android", "office", "excel", "google", "microsoft", "amazon", "apple", "facebook", "cloud", "web", "software", "endpoint", "security", "data", "digital", "analytics", "enterprise", "premium", "standard", "škoda", "octavia", "fabia", "toyota", "volkswagen", "ford", "hub", "pro", "series"),
}
KIND_OF = {w: kind for kind, words in KINDS.items() for w in words}

#: Endings that say a word is a surname even where the first name is in no library.
SURNAME_ENDINGS = ("ová", "ové", "ovou", "ský", "cký", "ského", "ckého", "skému", "ckému", "ským", "ckým", "ská", "cká", "skou", "ckou", "ák", "áka", "ákovi", "ákem", "ček", "čka", "čkovi", "čkem")
