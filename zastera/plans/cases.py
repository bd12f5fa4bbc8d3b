"""Cases with answers written by hand: what each detector has to find, leave alone, and leave to its neighbours."""

from __future__ import annotations

# (text, redacted text); no answer comes from a pattern.
DETECTED = [
    ("Credentials: jnovak / tajne.Heslo1", "Credentials: [[USERNAME_1]] / [[PASSWORD_1]]"),
    ("přihlašovací údaje: eva / abc123, dále", "přihlašovací údaje: [[USERNAME_1]] / [[PASSWORD_1]], dále"),
    ("credentials jsou v trezoru", "credentials jsou v trezoru"),
    ("heslo: abc.def", "heslo: [[PASSWORD_1]]"),
    ("Password=Xy!9z, pass-through", "Password=[[PASSWORD_1]], pass-through"),
    ("bypass: nic", "bypass: nic"),
    ("API_KEY=abcd1234efgh5678", "API_KEY=[[API_KEY_1]]"),
    ('token = "0123456789abcdef0123"', 'token = "[[API_KEY_1]]"'),
    ("API key management", "API key management"),
    ("API klíč ab12345678", "API klíč [[API_KEY_1]]"),
    ("Stripe: sk_live_0123456789abcd", "Stripe: [[SECRET_1]]"),
    ("Personal Access Token: ghp_0123456789abcdef", "Personal Access Token: [[API_KEY_1]]"),
    ("Stripe: krátké", "Stripe: krátké"),
    ("ssh-rsa " + "A" * 60 + " me", "ssh-rsa [[SSH_KEY_1]] me"),
    ("ssh-rsa krátký", "ssh-rsa krátký"),
    ("IBAN CZ65 0800 0000 1920 0014 5399.", "IBAN [[IBAN_1]]."),
    ("IBAN DE89370400440532013000 konec", "IBAN [[IBAN_1]] konec"),
    ("CZ65 nic", "CZ65 nic"),
    ("Číslo karty: 4111 1111 1111 1111.", "Číslo karty: [[CARD_1]]."),
    ("Karta: 378282246310005 a Číslo: 4111111111111112", "Karta: [[CARD_1]] a Číslo: [[CARD_2]]"),
    ("Platební karta VISA vydaná bankou, číslo: 4111-1111-1111-1111", "Platební karta VISA vydaná bankou, číslo: [[CARD_1]]"),
    ("zaplaceno 4111111111111111a", "zaplaceno [[CARD_1]]a"),
    ("zaplaceno 3782 822463 10005 dnes", "zaplaceno [[CARD_1]] dnes"),
    ("zaplaceno 3056 930902 5904 dnes", "zaplaceno [[CARD_1]] dnes"),
    ("zaplaceno 4111111111111112 dnes", "zaplaceno 4111111111111112 dnes"),
    ("kód 12345678901234567890123 zde", "kód 12345678901234567890123 zde"),
    ("4111111111111111x10.0.0.1", "[[CARD_1]]x[[IP_1]]"),
    ("Login: jnovak, GitHub: eva-n", "Login: [[USERNAME_1]], GitHub: [[USERNAME_2]]"),
    ("Login stránka", "Login stránka"),
    ("AWS Account: 123456789012", "AWS Account: [[ACCOUNT_ID_1]]"),
    ("Account ID: 12345", "Account ID: 12345"),
    ("Host: db1.example.com, port", "Host: [[HOST_1]], port"),
    ("server: lokalni", "server: lokalni"),
    ("adresa 10.0.0.1 a 999.1.1.1", "adresa [[IP_1]] a 999.1.1.1"),
    ("v1.2.3.4 a 1.2.3.4.5", "v1.2.3.4 a 1.2.3.4.5"),
    ("VZP: 7654321098", "VZP: [[INSURANCE_ID_1]]"),
    ("VZP má 100 poboček", "VZP má 100 poboček"),
    ("RFID karta: RF-0001, badge colour", "RFID karta: [[RFID_1]], badge colour"),
    ("viz https://www.linkedin.com/in/jan-novak zde", "viz [[LINKEDIN_1]] zde"),
    ("viz linkedin.com/jobs zde", "viz linkedin.com/jobs zde"),
    ("facebook.com/jan.novak.5, dále", "[[FACEBOOK_1]], dále"),
    ("Instagram: @jan_n a @Override", "Instagram: [[INSTAGRAM_1]] a @Override"),
    ("https://instagram.com/jan_n/", "[[INSTAGRAM_1]]/"),
    ("novotný@firma.cz", "[[EMAIL_1]]"),
    ("Skype: live.jan, Skype for", "Skype: [[SKYPE_1]], Skype for"),
    ("Hlasový profil: VP-77", "Hlasový profil: [[VOICE_ID_1]]"),
    ("VOICE_RK_2024_777123456 nic", "VOICE_RK_2024_777123456 nic"),
    ("otisk FINGERPRINT_2024_A1", "otisk [[BIO_HASH_1]]"),
    ("Hash: HB_2024_0156_X", "Hash: [[BIO_HASH_1]]"),
    ("hash: abc", "hash: abc"),
    ("soubor photo_id_12.gif", "soubor [[PHOTO_ID_1]]"),
    ("Fotografie: Uloženo v archivu (tvar_7.bmp)", "Fotografie: Uloženo v archivu ([[PHOTO_ID_1]])"),
    ("soubor obr_12.gif", "soubor obr_12.gif"),
    ("bytem Křenová 14, 602 00 Brno, dále", "bytem [[ADDRESS_1]], dále"),
    ("Sídlo: Na Příkopě 3/5a, 110 00 Praha 1.", "Sídlo: [[ADDRESS_1]]."),
    ("bydlí Dlouhá 7, Ostrava.", "bydlí [[ADDRESS_1]]."),
    ("bytem Křenová 14, 602 00 Brno a znovu Křenová 14, Brno", "bytem [[ADDRESS_1]] a znovu [[ADDRESS_1]]"),
    ("článek 14, odstavec 2", "článek 14, odstavec 2"),
    ("jan.novak@example.com a a@b.cz, a@b.cz", "[[EMAIL_1]] a [[EMAIL_2]], [[EMAIL_2]]"),
    ("cena @ 5", "cena @ 5"),
    ("nar. 1. 1. 1988, dne 3. 4. 2020", "nar. [[BIRTH_DATE_1]], dne 3. 4. 2020"),
    ("Datum narození: 01/02/1990", "Datum narození: [[BIRTH_DATE_1]]"),
    ("Místo narození: Nový Jičín, dne", "Místo narození: [[BIRTH_PLACE_1]], dne"),
    ("RČ 8501011234", "RČ [[BIRTH_ID_1]]"),
    ("rodné číslo: 850101/1234", "rodné číslo: [[BIRTH_ID_1]]"),
    ("dne 850101/1233 bylo", "dne [[BIRTH_ID_1]] bylo"),
    ("spis FÚ-850101/2020", "spis FÚ-850101/2020"),
    ("účet 123456/0800", "účet [[BANK_1]]"),
    ("Číslo účtu: 19-2000145399/0800.", "Číslo účtu: [[BANK_1]]."),
    ("platba 19-2000145399/0800 a 123456789/0100", "platba [[BANK_1]] a [[BANK_2]]"),
    ("karta VISA, její number: 4111111111111111", "karta VISA, její number: [[CARD_1]]"),
    ("kód " + "0123456789abcdef" * 2 + "01234567 zde", "kód [[API_KEY_1]] zde"),
    ("kód 0123456789abcdef zde", "kód 0123456789abcdef zde"),
    ("smlouva 12/2024 a 2024/0001", "smlouva 12/2024 a 2024/0001"),
    ("FÚ-1234567/2020 z roku", "FÚ-1234567/2020 z roku"),
    ("OP AB 123456, je 123456", "OP [[ID_CARD_1]], je 123456"),
    ("občanský průkaz č. 123456789", "občanský průkaz č. [[ID_CARD_1]]"),
    ("pas č. 12345678", "pas č. [[PASSPORT_1]]"),
    ("č. pasu: AB123456", "č. pasu: [[PASSPORT_1]]"),
    ("zápas 12 minut", "zápas 12 minut"),
    ("ŘP č. EA123456", "ŘP č. [[DRIVER_LICENSE_1]]"),
    ("MultiSport karta: MS-123456", "MultiSport karta: [[BENEFIT_CARD_1]]"),
    ("DIČ: CZ12345678, IČO: 87654321", "DIČ: [[DIC_1]], IČO: [[ICO_1]]"),
    ("IČO 12345678", "IČO [[ICO_1]]"),
    ("kód 12345678 a 123456789", "kód [[ICO_1]] a [[PHONE_1]]"),
    ("varianta rs28897696 a rs12", "varianta [[GENETIC_ID_1]] a rs12"),
    ("IMEI: 123456789012345", "IMEI: [[IMEI_1]]"),
    ("123456789012345 mobil", "[[IMEI_1]] mobil"),
    ("VIN: 1HGBH41JXMN109186", "VIN: [[VIN_1]]"),
    ("TMBCF61Z0L7654321 vozidlo", "[[VIN_1]] vozidlo"),
    ("MAC 00:1B:44:11:3A:B7", "MAC [[MAC_1]]"),
    ("MAC 001B.4411.3AB7 a 12:30:00", "MAC [[MAC_1]] a 12:30:00"),
    ("+420 777 123 456", "[[PHONE_1]]"),
    ("+420 777 12 34 56 a +421 905 123 456", "[[PHONE_1]] a [[PHONE_2]]"),
    ("volat 777 123 456, cena 777 123 456 Kč", "volat [[PHONE_1]], cena 777 123 456 Kč"),
    ("cena 100 000 000 Kč a 1 234 567 890", "cena 100 000 000 Kč a 1 234 567 890"),
    ("tel. 777123456", "tel. [[PHONE_1]]"),
    ("+1 (555) 123-4567 a +49 30 901820", "[[PHONE_1]] a [[PHONE_2]]"),
    ("SPZ vozidla ABC1234.", "SPZ vozidla [[LICENSE_PLATE_1]]."),
    ("vůz 1AB 2345 stál", "vůz [[LICENSE_PLATE_1]] stál"),
    ("od AB12345 do", "od AB12345 do"),
    ("CVV: 123, exp: 01/27", "CVV: ***, exp: **/**"),
    ("viz [[EMAIL_1]] a a@b.cz", "viz [[TAG_1]] a [[EMAIL_1]]"),
    ("", ""),
    (None, None),
]

OPTIONAL = [
    ("cena 1 500,50 Kč a 200 EUR", "cena [[AMOUNT_1]] a [[AMOUNT_2]]"),
    ("dne 12. 5. 2024 a 15. března 2024", "dne [[DATE_1]] a [[DATE_2]]"),
    ("smlouvu s Papin s.r.o. dnes", "smlouvu s [[ORG_1]] dnes"),
    ("Alfa Beta a.s., IČO 12345678", "[[ORG_1]], IČO [[ICO_1]]"),
    ("smlouva č. 2024/0156 ze dne", "smlouva č. [[CONTRACT_ID_1]] ze dne"),
    ("Zákaznické číslo: Z000123.", "Zákaznické číslo: [[CUSTOMER_ID_1]]."),
    ("volat 777 123 456 za 777 123 456 Kč", "volat [[PHONE_1]] za [[AMOUNT_1]]"),
    ("v Nemocnice Motol a Eva Malá", "v [[ORG_1]] a [[PERSON_1]]"),
    ("systém Windows Server běží", "systém [[PRODUCT_1]] běží"),
    ("ulice Václavské Náměstí je", "ulice [[PLACE_1]] je"),
    ("Rodné Listy jsou", "[[TERM_1]] jsou"),
    ("nic", "nic"),
]

# (name in some case, the person's nominative).
PERSONS = [
    ("Jan Novák", "Jan Novák"), ("Jana Nováka", "Jan Novák"), ("Janem Novákem", "Jan Novák"), ("Janu Novákovi", "Jan Novák"), ("Jan Procházka", "Jan Procházka"), ("Janem Procházkou", "Jan Procházka"),
    ("Jana Procházky", "Jan Procházka"), ("Petr Kučera", "Petr Kučera"), ("Petra Kučery", "Petr Kučera"), ("Petrem Kučerou", "Petr Kučera"), ("Martin Růžička", "Martin Růžička"), ("Martinem Růžičkou", "Martin Růžička"),
    ("Filip Hruška", "Filip Hruška"), ("Filipa Hrušky", "Filip Hruška"), ("Karel Sýkora", "Karel Sýkora"), ("Karlem Sýkorou", "Karel Sýkora"), ("Pavla Svobody", "Pavel Svoboda"), ("Pavel Svoboda", "Pavel Svoboda"),
    ("Jiřího Krejčího", "Jiří Krejčí"), ("Jiří Krejčí", "Jiří Krejčí"), ("Jiřím Novotným", "Jiří Novotný"), ("Jiřímu Novotnému", "Jiří Novotný"), ("Tomáše Beneše", "Tomáš Beneš"), ("Tomášem Benešem", "Tomáš Beneš"),
    ("Radka Hájka", "Radek Hájek"), ("Radkem Hájkem", "Radek Hájek"), ("Marka Vaňka", "Marek Vaněk"), ("Karla Němce", "Karel Němec"), ("Karlem Němcem", "Karel Němec"), ("Pavla Havla", "Pavel Havel"),
    ("Lukášem Králem", "Lukáš Král"), ("Lukáše Krále", "Lukáš Král"), ("Davidu Urbanovi", "David Urban"), ("Davida Zemana", "David Zeman"), ("Zdeňka Koláře", "Zdeněk Kolář"), ("Zdeněk Kolář", "Zdeněk Kolář"),
    ("Ondřeje Doležala", "Ondřej Doležal"), ("Vojtěchem Štěpánkem", "Vojtěch Štěpánek"), ("Josefa Jelínka", "Josef Jelínek"), ("Františkem Fialou", "František Fiala"), ("Jakuba Vlčka", "Jakub Vlček"), ("Michala Blažka", "Michal Blažek"),
    ("Adamovi Poláčkovi", "Adam Poláček"), ("Daniela Sedláčka", "Daniel Sedláček"), ("Aleši Bartošovi", "Aleš Bartoš"), ("Eva Nováková", "Eva Nováková"), ("Evou Novákovou", "Eva Nováková"), ("Evě Novákové", "Eva Nováková"),
    ("Eva Malá", "Eva Malá"), ("Evou Malou", "Eva Malá"), ("Evě Veselé", "Eva Veselá"), ("Petra Procházková", "Petra Procházková"), ("Petře Procházkové", "Petra Procházková"), ("Petrou Procházkovou", "Petra Procházková"),
    ("Marie Dvořáková", "Marie Dvořáková"), ("Marií Dvořákovou", "Marie Dvořáková"), ("Lucii Černé", "Lucie Černá"), ("Monice Kučerové", "Monika Kučerová"), ("Olze Pokorné", "Olga Pokorná"), ("Dagmar Sýkorové", "Dagmar Sýkorová"),
    ("Haně Horákové", "Hana Horáková"), ("Terezy Konečné", "Tereza Konečná"), ("Jana Nováková", "Jana Nováková"), ("Zdeňka Svobodová", "Zdeňka Svobodová"), ("Vincent Novák", "Vincent Novák"), ("Ing. Zikmund Winter", "Zikmund Winter"),
    ("Jan Karel Novák", "Jan Karel Novák"), ("Paní Eva Nováková", "Eva Nováková"), ("JAN NOVÁK", "Jan Novák"), ("Kupující Jan Novák", "Jan Novák"), ("Dnes Jan Novák", "Jan Novák"), ("John Smith", "John Smith"),
]

# (text, persons, forms of the first one).
LINKED = [
    ("Jan Procházka volal, s Janem Procházkou jednal, Jana Procházky se ptal.", 1, "Jan Procházka,Jana Procházky,Janem Procházkou"),
    ("JAN NOVAK a Jan Novák", 1, "JAN NOVAK,Jan Novák"),
    ("Novák Jan, tedy Jan Novák", 1, "Jan Novák,Novák Jan"),
    ("Jan Novák (J. Novák, J. N.)", 1, "J. N.,J. Novák,Jan Novák"),
    ("Petra Svobody se týká. Petr Svoboda přišel.", 1, "Petr Svoboda,Petra Svobody"),
    ("Petra Svobodová a Petr Svoboda", 2, "Petra Svobodová"),
    ("Eva Nováková a Evou Novákovou, pan Novák Jan", 2, "Eva Nováková,Evou Novákovou"),
    ("Jan Novák. Pan Novák uvedl, že Jakub pracoval.", 2, "Jan Novák,Novák"),
    ("Jana Marka viděli. Jan Marek odešel.", 1, "Jan Marek,Jana Marka"),
    ("Praha je velká", 0, None),
]

# (text, redacted text).
SENTENCES = [
    ("Ing. Jan Novák a Evou Novákovou\nJAN NOVÁK", "Ing. [[PERSON_1]] a [[PERSON_2]]\n[[PERSON_1]]"),
    ("Kupující Jan Novák a Prodávající Eva Nováková", "Kupující [[PERSON_1]] a Prodávající [[PERSON_2]]"),
    ("Ing. Petra Černá, Ph.D. (rozená Malá)", "Ing. [[PERSON_1]], Ph.D. (rozená [[PERSON_2]])"),
    ("s panem Janem Novákem, MBA", "s panem [[PERSON_1]], MBA"),
    ("Jakub pracoval jako řidič. Praha je velká.", "[[PERSON_1]] pracoval jako řidič. Praha je velká."),
    ("Ing Ing Ing Mgr", "Ing Ing Ing Mgr"),
    ("Jan Novák s.r.o. dodává", "Jan Novák s.r.o. dodává"),
    ("Jednatel Společnosti a Ředitelka Centrum", "Jednatel Společnosti a Ředitelka Centrum"),
    ("Česká Spořitelna a Komerční Banka", "Česká Spořitelna a Komerční Banka"),
    ("Microsoft Office a Windows Server", "Microsoft Office a Windows Server"),
    ("dlužník Zikmund Wintr, bytem Křenová 14, 602 00 Brno", "dlužník [[PERSON_1]], bytem [[ADDRESS_1]]"),
    ("Nové Město a Staré Město", "Nové Město a Staré Město"),
    ("Eva Nováková Malá přišla", "[[PERSON_1]] přišla"),
    ("David Office a Martin Group", "David Office a Martin Group"),
    ("Novákovi a Eva Nováková", "Novákovi a [[PERSON_1]]"),
    ("Jan Novák, nar. 1. 1. 1988, tel. 777 123 456", "[[PERSON_1]], nar. [[BIRTH_DATE_1]], tel. [[PHONE_1]]"),
    ("Dne 12. 5. 2024 uzavřel Jan Novák, nar. 1. 1. 1988, bytem Křenová 14, 602 00 Brno,\nsmlouvu s Papin s.r.o. Číslo účtu: 123456789/0100. Kontakt: jan.novak@example.com, +420 777 123 456.\nSPZ vozidla ABC1234.", "Dne 12. 5. 2024 uzavřel [[PERSON_1]], nar. [[BIRTH_DATE_1]], bytem [[ADDRESS_1]],\nsmlouvu s Papin s.r.o. Číslo účtu: [[BANK_1]]. Kontakt: [[EMAIL_1]], [[PHONE_1]].\nSPZ vozidla [[LICENSE_PLATE_1]]."),
]

SURNAMES_ALONE = [
    ("pan Dvořák uvedl", "pan [[PERSON_1]] uvedl"),
    ("Nováková uvedla, paní Malá mlčela", "[[PERSON_1]] uvedla, paní [[PERSON_2]] mlčela"),
    ("pan ředitel uvedl", "pan ředitel uvedl"),
    ("Praha byla", "Praha byla"),
]

NOMINATIVES = [x.split(":") for x in """Nováka:Novák Novákovi:Novák Novákem:Novák Novotného:Novotný Novotnému:Novotný Novotným:Novotný Svobodou:Svoboda Svobody:Svoboda Svoboda:Svoboda Dvořákové:Dvořáková Dvořákovou:Dvořáková
Dvořák:Dvořák Havlem:Havel Havla:Havel Procházky:Procházka Procházkou:Procházka Procházka:Procházka Kučera:Kučera Kučery:Kučera Kučerou:Kučera Sýkora:Sýkora Sýkorou:Sýkora Hruška:Hruška Hruškou:Hruška Růžička:Růžička
Růžičkou:Růžička Zemana:Zeman Zemanem:Zeman Beneše:Beneš Benešem:Beneš Krejčího:Krejčí Krejčím:Krejčí Němce:Němec Němcem:Němec Hájka:Hájek Hájkem:Hájek Marka:Marek Koláře:Kolář Kolářem:Kolář Krále:Král Králem:Král
Urbana:Urban Veselého:Veselý Veselým:Veselý Horákem:Horák Horákovou:Horáková Černého:Černý Pokorným:Pokorný Jelínka:Jelínek Jelínkem:Jelínek Fialou:Fiala Fiala:Fiala Doležala:Doležal Sedláčka:Sedláček Bartoše:Bartoš
Kratochvílem:Kratochvíl Vaňka:Vaněk Poláka:Polák Konečného:Konečný Bláhou:Bláha Malou:Malá Veselou:Veselá Malé:Malá Čermáka:Čermák Kadlece:Kadlec Blažkem:Blažek Šimka:Šimek""".split()]  # fmt: skip

FIRST_NAMES = [x.split(":") for x in "Janem:Jan Petře:Petra Jiřího:Jiří Evou:Eva Monice:Monika Radkem:Radek Karla:Karel Zdeňkovi:Zdeněk Marií:Marie Olze:Olga Tomáše:Tomáš Lukášem:Lukáš Xaver:Xaver Hany:Hana Haně:Hana Tereze:Tereza Šárce:Šárka Vojtěchem:Vojtěch Ondřeji:Ondřej Janin:Jana".split()]

# (nominative, words, those that are its forms).
VARIANTS = [
    ("Novák", "Novák Nováka Novákovi Novákem Nováku Novákův Nováků Nováek Novákou", "Novák Nováka Novákovi Novákem Nováku Novákův Nováků"),
    ("Hájek", "Hájek Hájka Hájkovi Hájkem Hájekem Hájekovi", "Hájek Hájka Hájkovi Hájkem"),
    ("Havel", "Havla Havlovi Havlem Havelem", "Havla Havlovi Havlem"),
    ("Němec", "Němce Němcovi Němcem Němče Němeca", "Němce Němcovi Němcem Němče"),
    ("Procházka", "Procházky Procházkovi Procházku Procházkou Procházků Procházkem", "Procházky Procházkovi Procházku Procházkou Procházků"),
    ("Novotný", "Novotného Novotnému Novotným Novotném Novotnýho", "Novotného Novotnému Novotným Novotném"),
    ("Krejčí", "Krejčího Krejčímu Krejčím Krejčíka", "Krejčího Krejčímu Krejčím"),
    ("Nováková", "Novákové Novákovou Novákovy Novákovám", "Novákové Novákovou"),
    ("Malá", "Malé Malou Malého", "Malé Malou"),
    ("Beneš", "Beneše Benešovi Benešem Benešy", "Beneše Benešovi Benešem"),
    ("Dvorský", "Dvorského Dvorskému Dvorským Dvorsého", "Dvorského Dvorskému Dvorským"),
    ("Vaněk", "Vaňka Vaňkem Vaněka", "Vaňka Vaňkem"),
]

STEMS = [x.split(":") for x in "Procházka:procházk Procházková:procházk Procházkou:procházk Hájek:hájk Havel:havl Němec:němc Malá:mal Malou:mal Novák:novák Novákem:novák Novákovi:novák Novotný:novotn Novotného:novotn".split()]
