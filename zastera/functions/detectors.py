"""Detectors of personal data, in the order in which they are applied.

Every pattern is (context)(value)(what follows): only the value becomes a tag. Patterns hold neither lookaround nor
classes on which engines differ, so that Python's re, Java and RE2 read them alike; a left border is consumed as part
of the context. What an earlier detector has taken stands as characters of TAKEN, which no value holds.

Guards come first: numbers that look like something else and stay as they are. Then come detectors with a keyword,
and shapes that can't be mistaken, by PRECEDENCE of their types; then bare shapes, again by PRECEDENCE.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Stand-ins for what is taken already.
TAKEN = "\ue000-\ue0ff"
KEEP = "KEEP"
W = "[ \t\xa0]"
LEFT = "(?:^|[^0-9A-Za-zÀ-ž_])"
SEP = rf"{W}*[:=]{W}*"
MAYBE = rf"{W}*:?{W}*"
UP, LOW = "A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽÄÖÜ", "a-záčďéěíňóřšťúůýžäöüß"
TOKEN = r"[A-Za-z0-9+/_.=-]*[A-Za-z0-9+/_=-]"
VISIBLE = rf"[^ \t\r\n\xa0,;{TAKEN}]"
D4 = "[0-9]{4}"

# The order of types from the audit's specification; others follow in the order of the list below.
PRECEDENCE = ("CARD", "IBAN", "BIRTH_ID", "ID_CARD", "INSURANCE_ID", "EMAIL", "USERNAME", "PASSWORD", "API_KEY", "SECRET", "IP", "HOST", "PHONE", "BANK", "ADDRESS", "AMOUNT", "DATE", "PERSON", "ORG", "PLACE", "PRODUCT", "TERM")

#: Types that are only looked for when asked; a guard among them keeps what it finds from other detectors.
OPTIONAL = ("AMOUNT", "DATE", "ORG", "PLACE", "PRODUCT", "TERM", "CONTRACT_ID", "CUSTOMER_ID")


class Detector(NamedTuple):
    name: str
    type: str
    context: str
    value: str
    after: str = ""
    case: bool = False  # whether case counts
    check: str = ""  # a test of the value in CHECKS
    anchors: tuple[str, ...] = ()  # lower-cased strings one of which stands in every match
    guard: bool = False  # kept from other detectors when its type isn't looked for
    confidence: float = 0.9

    @property
    def pattern(self) -> str:
        return f"({self.context})({self.value})({self.after})"

    @property
    def java(self) -> str:
        return ("" if self.case else "(?iu)") + self.pattern

    @property
    def re2(self) -> str:
        return ("" if self.case else "(?i)") + self.pattern

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern.replace(r"\b", r"(?a:\b)"), re.M if self.case else re.M | re.I)


def _key(words: str, value: str, name: str, type_: str, sep: str = SEP, **more) -> Detector:
    """A value after one of some keywords and a separator."""
    anchors = tuple(re.split(r"[\[\\(?.* ]", w)[0].lower() for w in words.split("|"))
    return Detector(name, type_, f"{LEFT}(?:{words.replace(' ', W)}){sep}", value, anchors=anchors if all(anchors) else (), confidence=0.98, **more)


def _shape(name: str, type_: str, value: str, left: str = LEFT, **more) -> Detector:
    return Detector(name, type_, left, value, **({"confidence": 0.7} | more))


_CARD = rf"{D4}(?:[ -]?{D4}){{3}}(?:[ -]?[0-9]{{1,3}})?\b|{D4}[ -]?[0-9]{{6}}[ -]?[0-9]{{4,5}}\b|[0-9]{{13,19}}\b"
_STREET = rf"[{UP}][{LOW}]+(?: [{UP}{LOW}][{LOW}]*){{0,3}} [0-9]{{1,4}}(?:/[0-9]{{1,4}}[a-z]?)?"
_CITY = rf"[{UP}][{LOW}]+(?: (?:[{UP}][{LOW}]+|nad|pod|u|v))*(?: [0-9]{{1,2}}\b)?"
_LEAD = rf"(?:(?:[Tt]rvale [Bb]ytem|[Bb]ytem|[Bb]ydlišt[eě]|[Ss]e sídlem|[Ss]ídlo podnikání|[Ss]ídlo|[Mm]ísto podnikání|[Aa]dres[ay]|[Tt]rvalý pobyt|[Vv] ulici|[Nn]a adrese|[Vv] domě){MAYBE})?"
_DATE = rf"[0-9]{{1,2}}{W}?[./-]{W}?[0-9]{{1,2}}{W}?[./-]{W}?[0-9]{{4}}"
_NINE = rf"[0-9]{{3}}{W}?[0-9]{{3}}{W}?[0-9]{{3}}\b|[0-9]{{3}}{W}?[0-9]{{2}}{W}?[0-9]{{2}}{W}?[0-9]{{2}}\b"
_MONTHS = "ledna|února|března|dubna|května|června|července|srpna|září|října|listopadu|prosince|January|February|March|April|May|June|July|August|September|October|November|December"
_IMAGE = r"\.(?:jpg|jpeg|png|gif|bmp)"

GUARDS = [
    _shape("long_digits", KEEP, "[0-9]{20,}", "(?:^|[^0-9A-Za-z])"),
    _shape("dotted_digits", KEEP, r"[0-9]+(?:\.[0-9]+){4,}", r"(?:^|[^0-9.])"),
    _shape("version", KEEP, r"[0-9]+(?:\.[0-9]+){2,3}\b", "(?:^|[^0-9A-Za-z])v", anchors=("v",)),
    _shape("case_file", KEEP, "[0-9]+(?:[/-][0-9]+)+", rf"{LEFT}(?:FÚ|KS|VS|OS|čj\.?|č\.{W}?j\.|sp\.{W}?zn\.){W}?[:-]?{W}?", anchors=("fú", "ks", "vs", "os", "čj", "č.", "sp.")),
    _shape("technical", KEEP, "(?:DB_GENOME|FACIAL|VOICE_RK)_[A-Za-z0-9_-]+", case=True, anchors=("db_genome", "facial", "voice_rk")),
    _shape("since", KEEP, rf"[0-9]?[A-Z]{{1,3}}{W}?[0-9]{{4,5}}\b", rf"{LEFT}(?:od|z|do|roku){W}", anchors=("od", "z", "do", "roku")),
]

DETECTORS = [
    *GUARDS,
    _key("číslo platební karty|číslo karty|platební karta|karta|card number|card|číslo", _CARD, "card", "CARD", rf"(?:{W}+number)?{W}*[:=-]?{W}*"),
    Detector("card_in_context", "CARD", rf"{LEFT}(?:karta|karty|kartou|card)[^\n{TAKEN}]{{0,100}}?(?:číslo|number){W}*:{W}*", _CARD, anchors=("kart", "card"), confidence=0.95),
    Detector("iban", "IBAN", LEFT, rf"[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|{W}[A-Z]{{4}}(?:{W}{D4}){{2,6}}(?:{W}[0-9]{{1,3}})?|(?:{W}{D4}){{3,7}}(?:{W}[0-9]{{1,3}})?)\b", case=True, confidence=0.95),
    _key("rč|r\\.? ?č\\.|rodné číslo|rodným číslem|rodného čísla|narozen[aáý]?|nar\\.", r"[0-9]{6}/?[0-9]{3,4}\b", "birth_id_context", "BIRTH_ID", MAYBE),
    _key("op|číslo op|č\\. ?op|občanský průkaz|občanského průkazu", r"[0-9]{6,9}\b", "id_card_context", "ID_CARD", rf"(?:{W}*č\.)?{W}*[:-]?{W}*"),
    _key("vzp|čpzp|zpš|ozp|vozp|rbp|pojišťovna|číslo pojištěnce|pojištěnec", r"[0-9]{10}\b", "insurance", "INSURANCE_ID", rf"[ \t\xa0,:=]*(?:číslo{W}*:?{W}*)?"),
    Detector("email", "EMAIL", "(?:^|[^A-Za-z0-9À-ž._%+-])", r"[A-Za-z0-9À-ž_%+-][A-Za-z0-9À-ž._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", anchors=("@",), confidence=0.98),
    _key("credentials|credential|přihlašovací údaje", rf"[^ \t\r\n\xa0/{TAKEN}]+", "credentials_username", "USERNAME"),
    # The services whose logins have to be found.
    _key("login|username|uživatel|user|github|jira|aws console", "[A-Za-z0-9@._-]*[A-Za-z0-9_-]", "username", "USERNAME"),
    Detector("credentials_password", "PASSWORD", rf"{LEFT}(?:credentials?|login|přihlašovací{W}údaje){SEP}[^ \t\r\n\xa0/]+{W}*/{W}*", rf"{VISIBLE}*[^ \t\r\n\xa0,;.{TAKEN}]", anchors=("credential", "login", "přihlašovací"), confidence=0.98),
    # The words that a password follows.
    _key("password|heslo|passwd|pwd|pass", rf"{VISIBLE}*[^ \t\r\n\xa0,;.{TAKEN}]", "password", "PASSWORD"),
    _key("key id|secret key|secret access key|api(?: |_)?key|api klíč|access key|token", TOKEN, "api_key", "API_KEY", rf"{SEP}[\"']?", after="[\"']?"),
    _key("api klíč|api(?: |_)?key", "[A-Za-z_-]*[0-9][A-Za-z0-9+/_-]{7,}", "api_key_loose", "API_KEY", f"{W}+"),
    _key("stripe|sendgrid|github|client(?: |_)secret|secret|personal access token|access token", "[A-Za-z0-9+/_=.-]{16,}", "secret", "SECRET", rf"{SEP}[\"']?"),
    _shape("ipv4", "IP", r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}\b", "(?:^|[^0-9.])", anchors=(".",), confidence=0.9),
    # The words that a host follows.
    _key("hostname|host|server|rds|endpoint", r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "host", "HOST"),
    Detector("ssh_key", "SSH_KEY", rf"{LEFT}(?:ssh-rsa|ssh-ed25519|ecdsa-sha2-nistp256){W}+", "[A-Za-z0-9+/=]{50,}", anchors=("ssh-", "ecdsa"), confidence=0.98),
    _key("account id|aws account", r"[0-9]{12}\b", "account_id", "ACCOUNT_ID"),
    _key("rfid karta|rfid|badge|id karta", "[A-Za-z0-9/_-]{4,}", "rfid", "RFID", rf"{W}*[:#]{W}*"),
    Detector("linkedin", "LINKEDIN", "(?:^|[^A-Za-z0-9])", r"(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9_-]+", anchors=("linkedin.com",), confidence=0.98),
    Detector("facebook", "FACEBOOK", "(?:^|[^A-Za-z0-9])", r"(?:https?://)?(?:www\.)?facebook\.com/[A-Za-z0-9_.-]*[A-Za-z0-9_-]", anchors=("facebook.com",), confidence=0.98),
    Detector("instagram", "INSTAGRAM", rf"{LEFT}(?:instagram|ig){W}*:?{W}*", "@[A-Za-z0-9_.]*[A-Za-z0-9_]", anchors=("instagram", "ig"), confidence=0.98),
    Detector("instagram_url", "INSTAGRAM", "(?:^|[^A-Za-z0-9])", r"(?:https?://)?(?:www\.)?instagram\.com/[A-Za-z0-9_.]*[A-Za-z0-9_]", anchors=("instagram.com",), confidence=0.98),
    _key("skype", "[A-Za-z0-9._:-]*[A-Za-z0-9_]", "skype", "SKYPE"),
    _key("hlasový profil|voice(?: |_)id|voice profile", "[A-Za-z0-9_-]+", "voice_id", "VOICE_ID"),
    # The prefixes of biometric identifiers.
    Detector("bio_hash", "BIO_HASH", LEFT, "(?:HASH_BIO|IRIS|RETINA|FINGERPRINT|PALM|DNA)_[A-Za-z0-9_-]+", case=True, anchors=("hash_bio", "iris", "retina", "fingerprint", "palm", "dna"), confidence=0.95),
    Detector("bio_hash_context", "BIO_HASH", rf"{LEFT}[Hh]ash:{W}*", "[A-Z][A-Z0-9_-]{10,}", case=True, anchors=("hash:",), confidence=0.98),
    Detector("photo_id", "PHOTO_ID", LEFT, rf"(?:photo_id|face_id)_[A-Za-z0-9_-]+{_IMAGE}", anchors=("photo_id", "face_id"), confidence=0.98),
    Detector("photo_file", "PHOTO_ID", rf"{LEFT}(?:fotografie|photo{W}id|face{W}id){W}*[:=-]?{W}*uloženo[^\n({TAKEN}]{{0,80}}\(", rf"[A-Za-z0-9_-]+{_IMAGE}", anchors=("uloženo",), confidence=0.98),
    _key("datum narození|narozen[áaý]?|nar", _DATE + r"\b", "birth_date", "BIRTH_DATE", rf"\.?{W}*[:-]?{W}*"),
    Detector("birth_place", "BIRTH_PLACE", rf"{LEFT}(?:[Mm]ísto{W}narození|[Nn]arozen[áa]?{W}v){MAYBE}", rf"[{UP}][{LOW}]+(?: [{UP}][{LOW}]+)*(?: [0-9]{{1,2}}\b)?", case=True, anchors=("narození", "narozen"), confidence=0.95),
    _key("pas|passport|č\\. ?pasu|číslo pasu", r"[A-Z]{0,2}[0-9]{6,9}\b", "passport", "PASSPORT", rf"(?:{W}*(?:č\.|no\.))?{W}*[:=-]?{W}*"),
    _key("řp|řidičák|řidičský průkaz|driver'?s? license", rf"[A-Z]{{0,2}}{W}?[0-9]{{6,9}}\b", "driver_licence", "DRIVER_LICENSE", rf"(?:{W}*(?:č\.|no\.))?{W}*[:=-]?{W}*"),
    _key("multisport|sodexo|edenred|benefit card|benefitní karta|id karty", r"[A-Za-z]{0,3}[/-]?[0-9]{6,12}\b", "benefit_card", "BENEFIT_CARD", rf"(?:{W}+(?:karta|č\.|id))?{W}*[:-]?{W}*"),
    _key("číslo účtu|bankovní účet|platba na účet|účet|účtu", r"(?:[0-9]{1,6}-)?[0-9]{6,16}(?:/[0-9]{4})?\b", "bank_context", "BANK", MAYBE),
    Detector("dic", "DIC", LEFT, r"CZ[0-9]{8,10}\b", case=True, anchors=("cz",), confidence=0.95),
    Detector("genetic_id", "GENETIC_ID", LEFT, r"rs[0-9]{6,}\b", case=True, anchors=("rs",)),
    _key("imei|international mobile equipment identity", r"[0-9]{15}\b", "imei", "IMEI", rf"{W}*[:=-]?{W}*"),
    Detector("imei_trailing", "IMEI", LEFT, "[0-9]{15}", rf"{W}+(?:imei|mobil|telefon)", anchors=("imei", "mobil", "telefon"), confidence=0.95),
    _key("vin|vehicle id|identifikační číslo vozidla", r"[A-HJ-NPR-Z0-9]{17}\b", "vin", "VIN", rf"{W}*[:=-]?{W}*", check="digit"),
    Detector("vin_trailing", "VIN", LEFT, "[A-HJ-NPR-Z0-9]{17}", rf"{W}+(?:vin|vozidl|auto|vehicle)", check="digit", anchors=("vin", "vozidl", "auto", "vehicle"), confidence=0.95),
    _shape("mac", "MAC", r"[0-9A-F]{2}(?::[0-9A-F]{2}){5}\b|[0-9A-F]{2}(?:-[0-9A-F]{2}){5}\b|[0-9A-F]{4}\.[0-9A-F]{4}\.[0-9A-F]{4}\b", "(?:^|[^0-9A-Za-z:.-])", check="digit", confidence=0.9),
    _key("ičo?|ico", r"[0-9]{8}\b", "ico_context", "ICO", MAYBE),
    _key("spz|rz|reg\\. ?značka|registrační značka", rf"[0-9][A-Z][A-Z0-9]{W}?[0-9]{{4}}\b|[A-Z]{{2,3}}{W}?[0-9]{{2}}[ -]?[0-9]{{2,3}}\b", "plate", "LICENSE_PLATE", rf"(?:{W}+vozidla)?{MAYBE}"),
    _key("číslo smlouvy|smlouva č\\.|smlouvy č\\.|smlouvě č\\.|contract no\\.?", "[A-Z0-9][A-Z0-9/_-]*[0-9]", "contract_id", "CONTRACT_ID", MAYBE),
    _key("zákaznické číslo|číslo zákazníka|zákaznické id|customer id|client id", "[A-Z0-9][A-Z0-9/_-]{2,}", "customer_id", "CUSTOMER_ID", MAYBE),
    _key("tel|telefon|mobil|gsm|phone", _NINE, "phone_context", "PHONE", rf"\.?{W}*:?{W}*"),
    _shape("card_bare", "CARD", rf"{D4}[ -]{D4}[ -]{D4}[ -]{D4}|{D4}[ -][0-9]{{6}}[ -][0-9]{{4,5}}|[0-9]{{13,19}}", "(?:^|[^0-9A-Za-z_])", check="luhn", confidence=0.9),
    _shape("birth_id", "BIRTH_ID", r"[0-9]{2}(?:[0257][1-9]|[1368][0-2])(?:0[1-9]|[12][0-9]|3[01])/[0-9]{3,4}\b", "(?:^|[^0-9A-Za-zÀ-ž/-])", check="birth", anchors=("/",), confidence=0.9),
    _shape("id_card", "ID_CARD", r"[A-Z]{2} ?[0-9]{6}\b", case=True),
    _shape("phone_cz", "PHONE", rf"(?:\+|00)42[01]{W}?(?:{_NINE})", "(?:^|[^0-9A-Za-z_+-])", anchors=("420", "421"), confidence=0.95),
    _shape("phone_intl", "PHONE", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}\b", "(?:^|[^0-9A-Za-z_])", anchors=("+1 (",), confidence=0.95),
    _shape("phone_abroad", "PHONE", r"\+[1-9][0-9]{0,2}(?:[ -]?[0-9]{2,4}){2,4}\b", "(?:^|[^0-9A-Za-z_+])", check="phone", anchors=("+",), confidence=0.85),
    _shape("bank", "BANK", r"[0-9]{1,6}-[0-9]{2,16}/[0-9]{4}\b|[0-9]{6,16}/[0-9]{4}\b", "(?:^|[^0-9A-Za-zÀ-ž/-])", anchors=("/",), confidence=0.9),
    Detector("address", "ADDRESS", f"{LEFT}{_LEAD}", rf"{_STREET}, [0-9]{{3}} ?[0-9]{{2}} {_CITY}(?:, (?:CZ|ČR|Česká republika|SK))?", case=True, confidence=0.95),
    Detector("address_short", "ADDRESS", f"{LEFT}{_LEAD}", rf"{_STREET}, (?:Praha [0-9]{{1,2}}\b|Praha|Brno|Ostrava|Plzeň)", case=True, anchors=("praha", "brno", "ostrava", "plzeň"), confidence=0.85),
    _shape("grouped_number", KEEP, rf"[0-9]{{1,2}}(?:{W}[0-9]{{3}}){{2,}}\b|[0-9]{{3}}(?:{W}[0-9]{{3}}){{3,}}\b", "(?:^|[^0-9A-Za-z+])"),
    _shape("amount", "AMOUNT", rf"[0-9]{{1,3}}(?:[ .\xa0][0-9]{{3}})*(?:,(?:[0-9]{{1,2}}|-))?{W}?(?:Kč|CZK|EUR|USD|€|\$)|[0-9]+(?:,[0-9]{{1,2}})?{W}?(?:Kč|CZK|EUR|USD|€|\$)|(?:€|\$){W}?[0-9][0-9,. ]*[0-9]", "(?:^|[^0-9A-Za-z+])", anchors=("kč", "czk", "eur", "usd", "€", "$"), guard=True),
    _shape("date", "DATE", rf"[0-9]{{1,2}}\.{W}?[0-9]{{1,2}}\.{W}?[0-9]{{4}}\b|[0-9]{{1,2}}\.?{W}(?:{_MONTHS}){W}[0-9]{{4}}\b|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\b", "(?:^|[^0-9A-Za-z.])", guard=True),
    _shape("phone_bare", "PHONE", _NINE, "(?:^|[^0-9A-Za-z_./+-])", confidence=0.6),
    _shape("ico", "ICO", r"[0-9]{8}\b", "(?:^|[^0-9A-Za-z_./-])", confidence=0.5),
    _shape("plate_bare", "LICENSE_PLATE", rf"[0-9][A-Z][A-Z0-9]{W}[0-9]{{4}}\b|[0-9][A-Z]{{2}}[0-9]{{4}}\b|[A-Z]{{2}}[0-9]{{5}}\b", case=True, confidence=0.6),
    _shape("hex_token", "API_KEY", r"[0-9a-f]{40}\b", case=True, check="digit"),
    Detector("organisation", "ORG", LEFT, rf"[{UP}][{UP}{LOW}0-9&.-]*(?:,? (?:&|a|[{UP}0-9][{UP}{LOW}0-9&.-]*)){{0,4}},? (?:spol\. s r\.{W}?o\.|s\.{W}?r\.{W}?o\.|a\.{W}?s\.|k\.{W}?s\.|v\.{W}?o\.{W}?s\.|o\.{W}?p\.{W}?s\.|z\.{W}?s\.|Ltd\.?|Inc\.?|GmbH|LLC|Corp\.?)", case=True, anchors=("o.", "s.", "ltd", "inc", "gmbh", "llc", "corp"), guard=True, confidence=0.95),
]

BY_NAME = {d.name: d for d in DETECTORS}

#: Types of which the map never holds the value unless asked to.
SECRET_TYPES = ("PASSWORD", "API_KEY", "SECRET", "SSH_KEY", "CARD")

#: Masks without a tag: name, pattern of what stays and what goes, replacement.
MASKS = [
    Detector("cvv", "", rf"cv[vc]2?{W}*:?{W}*", "[0-9]{3,4}", anchors=("cv",)),
    Detector("expiry", "", rf"(?:exp|expirace|platnost)\.?{W}*:?{W}*", "[0-9]{2}/[0-9]{2,4}", anchors=("exp", "platnost")),
]
MASKED = {"cvv": "***", "expiry": "**/**"}


def digits(value: str) -> str:
    return re.sub("[^0-9]", "", value)


def luhn(value: str) -> bool:
    """Whether 13 to 19 digits end in the right check digit."""
    z = [int(c) for c in digits(value)][::-1]
    return 13 <= len(z) <= 19 and sum(z[0::2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in z[1::2]) % 10


def birth(value: str) -> bool:
    """Nine digits (before 1954), or ten that eleven divides."""
    z = digits(value)
    return len(z) == 9 or int(z) % 11 == 0


def phone(value: str) -> bool:
    return 8 <= len(digits(value)) <= 15


def digit(value: str) -> bool:
    return bool(re.search("[0-9]", value))


CHECKS = {"": lambda value: True, "luhn": luhn, "birth": birth, "phone": phone, "digit": digit}

#: A line in which a detector finds something has one of these signs, or one of the words.
SIGNS = re.compile(r"[0-9@:=_\[]")
SIGN_WORDS = (".com/", "ssh-", "ecdsa-", "narozen", "uloženo", "rfid", "badge", "id karta", "r.o.", "r. o.", "a.s.", "a. s.", "k.s.", "k. s.", "o.s.", "o. s.", "p.s.", "p. s.", "z.s.", "z. s.", "ltd", "inc", "gmbh", "llc", "corp")


def rank(type_: str) -> int:
    """Smaller is stronger."""
    return PRECEDENCE.index(type_) if type_ in PRECEDENCE else PRECEDENCE.index("ADDRESS")
