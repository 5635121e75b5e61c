"""A small labelled table of personal data in sentences, made by rule from patterns with slots.

A slot in square brackets names the kind of what fills it; fillers are drawn by a seeded generator, names out of
syllables, so that a field learns shapes and neighbouring words and not the names themselves. Slots in angle
brackets are filled likewise and are no personal data: numbers, codes, dates and names of other things.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

KINDS = ("person", "phone", "id", "address", "birth", "email")

PATTERNS = (
    "My name is [person].", "my name is [person] and I work here", "I am called [person],", "Contact: [person]", "Dear Mr. [person],", "Dear Mrs. [person],", "Dear Dr. [person],",
    "Sincerely, [person]", "Best regards, [person]", "signed by [person] on <date>", "Patient: [person]", "Name: [person]", "Full name: [person]", "Customer [person] called", "Mr. [person] said",
    "Mrs. [person] wrote", "Ms. [person] asked", "Dr. [person] replied", "Ask for [person] at [phone].", "Mi nombre es [person].", "me llamo [person] y", "Estimado Sr. [person],", "Sra. [person]",
    "Nombre: [person]", "je m'appelle [person].", "Mon nom est [person]", "Monsieur [person]", "Madame [person]", "Nom: [person]", "Ich heiße [person].", "Mein Name ist [person]", "Herr [person]",
    "Frau [person]", "Name des Kunden: [person]",
    "Call [phone] now", "Phone: [phone]", "phone number [phone].", "Tel. [phone]", "Tel: [phone]", "Telephone: [phone]", "Mobile: [phone]", "Cell: [phone]", "Fax: [phone]", "call me at [phone]", "call us on [phone],",
    "reach me at [phone].", "Teléfono: [phone]", "llame al [phone]", "Téléphone : [phone]", "appelez le [phone]", "Telefon: [phone]", "Handy: [phone]", "text me at [phone]",
    "SSN: [id]", "SSN [id]", "social security number [id].", "my social security number is [id]", "Social Security No. [id]", "passport number [id]", "Passport No. [id]", "passport: [id]", "IBAN: [id]", "IBAN [id]",
    "tax id [id].", "driver license [id]", "DNI: [id]", "pasaporte [id]", "numéro de sécurité sociale [id]", "Ausweisnummer [id]", "national id: [id]", "account IBAN is [id],",
    "I live at [address].", "lives at [address],", "Address: [address]", "Home address: [address]", "ship to [address]", "mailing address is [address].", "residing at [address]", "Dirección: [address]", "vivo en [address]",
    "Adresse: [address]", "j'habite [address].", "ich wohne in der [address]", "Anschrift: [address]",
    "Date of birth: [birth]", "DOB: [birth]", "DOB [birth]", "born on [birth].", "was born [birth]", "date of birth [birth],", "birthday: [birth]", "Fecha de nacimiento: [birth]", "nacido el [birth]", "né le [birth]",
    "née le [birth]", "geboren am [birth].", "Geburtsdatum: [birth]",
    "email me at [email]", "e-mail: [email]", "Email: [email]", "mail [email] please", "write to [email].", "contact [email],", "correo: [email]", "courriel : [email]", "schreib an [email]",
    "[person], [address], [phone]", "Name: [person] DOB: [birth] SSN: [id]", "[person] ([phone])",
)

OTHERS = (
    "the <date> meeting of <thing>", "released on <date>.", "updated <date>, version <version>", "order <number> was shipped", "Order No. <number>", "invoice <code> for <price>", "costs <price>.", "page <small> of <small>",
    "lines <small>-<small>", "see section <version>", "at <time> on <date>", "token = \"<hex>\"", "commit <hex>", "key: <hex>", "<number>", "the <number> of", "model <code> and <code>", "<thing> and <thing> are", "In <thing>, the",
    "The <thing> <thing> of <thing>", "part number <code>", "batch <code>.", "id = <small>", "size <small>x<small>", "ratio <version>", "<thing>. <thing>", "ISBN <isbn>", "port <small>", "error <small>:", "call the function", "call <small> times",
    "name of the <thing>", "the address of the variable", "address 0x<hex>", "born in <thing>", "phone is off", "email was sent", "the patient was", "Mr. and Mrs.", "Dear Sir or Madam,", "| <number> | <thing> | <small> |", "<price> and <price>",
    "call it a <thing>", "serial <number>", "tracking <number>.", "was <number> that", "de <number> la", "<thing>-<thing>", "Since <year>, the", "from <year> to <year>", "<year>-<year>", "population <number>", "ticket #<small>", "<time>",
    "<date>", "<thing>, <thing>, <thing>", "<thing> <small>", "<thing> <small>, <thing>", "<small>.<small>.<small>", "<small> <small> <small>", "<small>-<small>-<small>", "<hex>",
    "# <thing> license", "Licensed under the <thing> License <version>", "<thing>'s <thing>", "<thing> at the <thing> of", "the name is <thing>", "contact the <thing>", "Total: <price>", "tel que <thing>", "Herr der <thing>",
    "<titles>", "<titles>.", "<again>", "<again> <titles>", "<titles>: <small>", "The <titles>", "<again>", "<initials>", "De <again>", "Der <titles>", "I am <plain>", "said <thing> <plain>", "<initials> <thing>",
    "<cues>", "<cues>.", "<cues> <thing> <plain>", "<plain> <cues>", "<cue>. <thing>", "<cue>. <thing> <plain>", "<cue>.\n<thing>", "<plain> <cue>. <thing>", "<cue>, <plain>", "<cue> <cue>. <thing>", "<cue> <number>", "<cue> <small>",
    "<cues>", "<cues>", "<cues> <cues>", "<cue> <cue>.\n<thing>", "<cue> <plain>. <thing>", "a <cue>. <thing> <plain>", "<plain> a <cue>. <thing>, <plain>",
    "<word> at <word>", "<word> at at <word>", "<word> at <word> <word>", "<plain> at <plain>", "<word> dot <word>", "<cue> at <cue>", "<word> by. <thing>", "by. <thing>", "<cue>. <thing>. <cue>",
    "<cues>", "<again>", "<again>.", "<again>", "<cues>. <cues>", "| <thing> | <thing> <plain> | <thing> <again>",
)

CUES = sorted({w for p in PATTERNS for w in re.findall(r"[^\W\d]+", re.sub(r"[\[<]\w+[\]>]", " ", p))} | {"at", "dot", "a", "in", "is", "it", "and", "the", "of", "to", "as", "Est", "this", "com", "org", "net", "es", "fr", "el", "se"})

#: Given names and words that are common beside generated ones.
NAMES = ("Anna", "John", "Maria", "David", "Laura", "James", "Sofia", "Peter", "Emma", "Carlos", "Julia", "Thomas", "Elena", "Paul", "Nina", "Robert", "Claire", "Hans", "Lucia", "Marc")
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Drive", "Blvd", "Court")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


class _Filler:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self, least: int = 2, most: int = 4) -> str:
        return "".join(self.rng.choice("bcdfghjklmnprstvwz") + self.rng.choice("aeiouáéö") + self.rng.choice(("", "", "n", "r", "s", "t", "l", "h")) for _ in range(self.rng.randint(least, most)))

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def name(self) -> str:
        return self.word(2, 3).capitalize()

    def person(self) -> str:
        first = self.rng.choice(NAMES) if self.rng.random() < 0.4 else self.name()
        return self.rng.choice((f"{first} {self.name()}", f"{first} {self.name()}", f"{first} {self.rng.choice('ABCDEFGHJKLMNPRST')}. {self.name()}", self.name(), f"{first} {self.name()}-{self.name()}", f"{first} {self.name()} {self.name()}"))

    def phone(self) -> str:
        d = self.digits
        return self.rng.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(4)}/{d(6)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(6)}"))

    def id(self) -> str:
        d, up = self.digits, self.rng.choice("ABCDEFGHKLMNPRSTXYZ")
        iban = up + self.rng.choice("ABDEGKLNPRST") + d(2)
        return self.rng.choice((f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{up}{d(7)}", f"{up}{d(8)}", f"{d(8)}{up}", f"{iban} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"{iban}{d(18)}", f"{iban} {d(4)} {d(4)} {d(4)}"))

    def address(self) -> str:
        n, name = str(self.rng.randint(1, 9999)), self.name()
        return self.rng.choice((f"{n} {name} {self.rng.choice(STREETS)}", f"{n} {name} {self.name()} {self.rng.choice(STREETS)}", f"{n} {name} {self.rng.choice(STREETS)}, {self.name()}", f"Calle {name} {n}", f"{n} rue de {name}", f"{n} rue {name}", f"{name}straße {n}", f"{n} {name} {self.rng.choice(STREETS)}, Apt {self.rng.randint(1, 99)}", f"Avenida {name} {n}"))

    def birth(self) -> str:
        return self.date()

    def date(self) -> str:
        day, month, year = self.rng.randint(1, 28), self.rng.randint(1, 12), self.rng.randint(1930, 2024)
        return self.rng.choice((f"{day:02}/{month:02}/{year}", f"{day}.{month}.{year}", f"{year}-{month:02}-{day:02}", f"{MONTHS[month - 1]} {day}, {year}", f"{day} {MONTHS[month - 1]} {year}", f"{month}/{day}/{year}"))

    def email(self) -> str:
        a, b, end = self.word(), self.word(), self.rng.choice(("com", "org", "net", "de", "fr", "es"))
        a = a + "." + self.word() if self.rng.random() < 0.3 else a
        return self.rng.choice((f"{a} at {b} dot {end}", f"{a} [at] {b} [dot] {end}", f"{a}(at){b}.{end}", f"{a} (at) {b} (dot) {end}", f"{a} [at] {b}.{end}"))

    def thing(self) -> str:
        return self.name() if self.rng.random() < 0.8 else self.word().upper()

    def version(self) -> str:
        return ".".join(str(self.rng.randint(0, 40)) for _ in range(self.rng.randint(2, 3)))

    def number(self) -> str:
        return self.digits(self.rng.choice((4, 5, 6, 7, 8, 10, 12, 16, 16)))

    def small(self) -> str:
        return str(self.rng.randint(0, 999))

    def code(self) -> str:
        return self.rng.choice((f"{self.word(1, 2).upper()}-{self.digits(self.rng.randint(2, 5))}", f"{self.word(1, 1)}{self.digits(3)}", f"{self.digits(3)}{self.word(1, 1)}"))

    def price(self) -> str:
        return f"{self.rng.choice('$€£')}{self.rng.randint(1, 9999)}.{self.digits(2)}"

    def time(self) -> str:
        return f"{self.rng.randint(0, 23):02}:{self.digits(2)}"

    def hex(self) -> str:
        return "".join(self.rng.choice("0123456789abcdef") for _ in range(self.rng.choice((8, 16, 32, 40))))

    def isbn(self) -> str:
        return f"978-{self.digits(1)}-{self.digits(2)}-{self.digits(6)}-{self.digits(1)}"

    def year(self) -> str:
        return str(self.rng.randint(1800, 2030))

    def titles(self) -> str:
        """Words that all begin with capitals, as in headings."""
        return self.rng.choice((" ", " ", ", ", ". ")).join(self.name() for _ in range(self.rng.randint(2, 9)))

    def again(self) -> str:
        """One word many times."""
        word = self.rng.choice((self.name(), self.word(), self.rng.choice(("The", "De", "Der", "Mr", "Name", "At", "I", "La", "And", "Calle", "Street"))))
        return self.rng.choice((" ", " ", ", ", ". ")).join([word] * self.rng.randint(3, 20))

    def cue(self) -> str:
        """A word of the patterns where it tells nothing."""
        word = self.rng.choice(CUES)
        return self.rng.choice((word, word.lower(), word.capitalize()))

    def cues(self) -> str:
        between = self.rng.choice((" ", " ", " ", ", ", ". ", "\n"))
        if self.rng.random() < 0.4:
            return between.join([self.cue()] * self.rng.randint(2, 16))
        return between.join(self.cue() for _ in range(self.rng.randint(2, 7)))

    def initials(self) -> str:
        return " ".join(f"{self.rng.choice('ABCDEFGHIJKLMNOPRSTUVWY')}." for _ in range(self.rng.randint(1, 3))) + f" {self.name()} {self.word()}"

    def plain(self) -> str:
        """Words before and after a pattern."""
        out = []
        for _ in range(self.rng.randint(0, 6)):
            w = self.word(2, 4)
            out.append((w.capitalize() if self.rng.random() < 0.15 else w) + self.rng.choice(("", "", "", "", ",", ".")))
        return " ".join(out)


def example(pattern: str, fill: _Filler) -> tuple[str, list[tuple[str, int, int]]]:
    """(text, [(kind, start, end)]) of a pattern between plain words."""
    before, after = fill.plain(), fill.plain()
    text = before + (fill.rng.choice((" ", " ", "\n", ". ")) if before else "")
    spans = []
    for part in re.split(r"([\[<]\w+[\]>])", pattern):
        if re.fullmatch(r"[\[<]\w+[\]>]", part):
            value = getattr(fill, part[1:-1])()
            if part[0] == "[":
                spans.append((part[1:-1], len(text), len(text) + len(value)))
            text += value
        else:
            text += part
    return text + (fill.rng.choice((" ", " ", "\n")) if after else "") + after, spans


def examples(each: int = 10, seed: int = 7, patterns: tuple[str, ...] = PATTERNS + OTHERS) -> list[tuple[str, list[tuple[str, int, int]]]]:
    fill = _Filler(seed)
    return [example(p, fill) for p in patterns for _ in range(each)] + [(f"{fill.plain()} {fill.plain()} {fill.plain()}", []) for _ in range(each * len(patterns) // 3)]


def labelled_table(spark: SparkSession, each: int = 10, seed: int = 7) -> DataFrame:
    """text, spans (array of kind, start, end; code points): some thousand rows by default."""
    return spark.createDataFrame(examples(each, seed), "text string, spans array<struct<kind:string,start:int,end:int>>")
