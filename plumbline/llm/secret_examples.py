"""A small labelled table of secrets in sentences, made by rule from patterns with slots, beside things that only look like secrets.

Slots in square brackets are secrets, those in angle brackets are not: hashes, ids, paths, versions, names. Values are drawn by a
seeded generator. ``UNSEEN`` patterns and kinds are for tests and never trained on.
"""

from __future__ import annotations

import random
import re
import string

PATTERNS = (
    "private key: [hexup]", "secret is [hexup]", "the secret key is [hexup]", "signing key [hexup]", "master key = [hexup]", "encryption key: [b64]", "the api key is [mixed]", "api key: [mixed]", "my key is [mixed]",
    "Authorization: Bearer [dotted]", "bearer [dotted]", "session token [dotted]", "the token is [dotted]", "jwt: [dotted]", "access token [prefixed]", "use token [prefixed]", "token: [prefixed]", "auth token is [prefixed]",
    "GITHUB [prefixed]", "credential [mixed]", "credentials: [mixed]", "client secret [mixed]", "client_id and secret [b64]", "the password is [pass]", "password is [pass]", "his password was [pass]", "login with [pass]",
    "passphrase \"[phrase]\"", "pass phrase \"[phrase]\"", "the passphrase is \"[phrase]\"", "passphrase: \"[phrase]\"", "db://admin:[pass]@host", "mysql://root:[pass]@localhost", "https://user:[pass]@example.org/x",
    "ssh-rsa [b64] user@host", "BEGIN PRIVATE KEY [b64]", "-----BEGIN KEY-----\n[b64]", "contraseña es [pass]", "la contraseña: [pass]", "mot de passe [pass]", "le mot de passe est [pass]", "Passwort ist [pass]", "das Passwort: [pass]",
    "clave secreta [mixed]", "clé secrète [mixed]", "geheimer Schlüssel [hexup]", "webhook secret [hexlow]", "key id [mixed] expires", "export KEY=[b64]", "AUTH=[mixed]", "x-api-key: [mixed]", "pin code [mixed]", "api_token [prefixed]",
    "access key [varied]", "the key is [varied]", "license key [varied]", "secret [varied]", "use secret [varied]", "my token [varied]", "recovery key: [varied]", "secret reads [mixed]", "key: [varied]", "password: [varied]",
)

OTHERS = (
    "sha256 of the file is <hexup>", "checksum: <hexup>", "md5 <hexup>", "commit <hexup>", "etag <hexup>", "digest <hexup>", "order id <id>", "ticket <id>", "request <uuid>", "uuid: <uuid>", "id <uuid>", "build <version>", "version <version>",
    "see <path>", "in <path>:", "open <path>", "import <dots>", "from <dots>", "call <camel>()", "class <camel>", "the <camel> of", "part <code>", "model <code>", "serial <code>", "https://example.org/<path>", "at <time>", "on <date>", "<number>",
    "<number> of <number>", "<upper>", "<upper> <upper>", "the password is <word>", "password is <word>", "the token is <word>", "the secret of <word>", "secret <word>", "api key is <word>", "key to <word>", "<word> key", "token <word> <word>",
    "passphrase <word>", "private <word>", "bearer of <word>", "session <word> token <word>", "\"<word> <word> <word> <word>\"", "said \"<word> <word> <word>\"", "<word>-<word>-<word>", "<word>_<word>", "<word>.<word>", "<word>/<word>",
    "<long>", "<long>.", "| <word> | <word> |", "<word>@<word>.com", "++<word>++", "<word>---<word>", "<word>...<word>", "<path> and <path>", "<camel> <camel>", "<code> <code> <code>", "image <dots>", "color <hexshort>",
    "===== <word> =====", "<word>=<word>", "<word>: <word>", "credential <word>", "login <word>", "contraseña <word>", "mot de passe <word>", "Passwort <word>", "clave <word>", "ghp <word>", "jwt <word>", "auth <word>", "<upper>-<number>",
)

#: Kinds of values and wordings that training never sees.
UNSEEN = ("deploy key is [grouped]", "here is the access key: [url64]", "wifi password: [words]", "the shared secret reads [grouped]", "keep this key safe: [url64]", "token = none, use secret [grouped]")


class _Filler:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def some(self, letters: str, n: int) -> str:
        return "".join(self.rng.choice(letters) for _ in range(n))

    def word(self, least: int = 2, most: int = 4) -> str:
        return "".join(self.rng.choice("bcdfghjklmnprstvwz") + self.rng.choice("aeiouáéö") + self.rng.choice(("", "", "n", "r", "s", "t")) for _ in range(self.rng.randint(least, most)))

    def hexup(self) -> str:
        return self.some("0123456789ABCDEF", self.rng.choice((32, 40, 48, 64)))

    def hexlow(self) -> str:
        return self.some("0123456789abcdef", self.rng.choice((32, 40, 64)))

    def hexshort(self) -> str:
        return self.some("0123456789abcdef", 6)

    def b64(self) -> str:
        return self.some(string.ascii_letters + string.digits + "+/", self.rng.choice((24, 32, 44, 64)))

    def url64(self) -> str:
        return self.some(string.ascii_letters + string.digits + "-_", self.rng.choice((27, 36, 43)))

    def mixed(self) -> str:
        return self.some(string.ascii_letters + string.digits, self.rng.choice((16, 20, 24, 32, 40)))

    def grouped(self) -> str:
        return "-".join(self.some(string.ascii_uppercase + string.digits, 6) for _ in range(self.rng.choice((4, 5))))

    def varied(self) -> str:
        """Groups of characters of some alphabet between some sign; never groups of six."""
        letters = self.rng.choice((string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits))
        size = self.rng.choice((3, 4, 5, 8, 10))
        return self.rng.choice("-_./+").join(self.some(letters, size) for _ in range(max(2, self.rng.randint(16, 40) // size)))

    def dotted(self) -> str:
        return "eyJ" + ".".join(self.some(string.ascii_letters + string.digits + "-_", self.rng.randint(18, 40)) for _ in range(3))

    def prefixed(self) -> str:
        return self.rng.choice(("ghp_", "glpat-", "xoxb-", "sk_live_", "npm_", "pypi-", "key-")) + self.some(string.ascii_letters + string.digits, self.rng.choice((20, 24, 36)))

    def _pass(self) -> str:
        word = self.word(1, 3).capitalize()
        return self.rng.choice((word + self.some(string.digits, self.rng.randint(2, 4)), self.some(string.ascii_letters + string.digits, self.rng.randint(9, 14)), f"{word}-{self.some(string.digits, 4)}-{self.word(1, 2)}"))

    def words(self) -> str:
        return f"{self.word().capitalize()}{self.some(string.digits, 2)}{self.word().capitalize()}{self.some(string.digits, 3)}"

    def phrase(self) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(4, 6)))

    def id(self) -> str:
        return self.some(string.digits, self.rng.choice((6, 8, 10, 12, 16)))

    def uuid(self) -> str:
        return "-".join(self.some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))

    def version(self) -> str:
        return ".".join(str(self.rng.randint(0, 30)) for _ in range(3)) + self.rng.choice(("", "", "-rc1", "+build.7"))

    def path(self) -> str:
        return "/".join(self.word() for _ in range(self.rng.randint(2, 5))) + self.rng.choice(("", ".py", ".txt", "/", "-2.1.so"))

    def dots(self) -> str:
        return ".".join(self.word() for _ in range(self.rng.randint(2, 5)))

    def camel(self) -> str:
        return self.word() + "".join(self.word().capitalize() for _ in range(self.rng.randint(1, 3)))

    def code(self) -> str:
        return f"{self.word(1, 2).upper()}-{self.some(string.digits, self.rng.randint(2, 5))}"

    def time(self) -> str:
        return f"{self.rng.randint(0, 23)}:{self.some(string.digits, 2)}"

    def date(self) -> str:
        return f"{self.rng.randint(1950, 2030)}-{self.rng.randint(10, 12)}-{self.rng.randint(10, 28)}"

    def number(self) -> str:
        return self.some(string.digits, self.rng.randint(1, 16))

    def upper(self) -> str:
        return self.word().upper()

    def long(self) -> str:
        return self.word(6, 14)

    def plain(self) -> str:
        return " ".join(self.word(1, 4) + self.rng.choice(("", "", "", ",", ".")) for _ in range(self.rng.randint(0, 7)))


def example(pattern: str, fill: _Filler) -> tuple[str, list[tuple[int, int]]]:
    """(text, [(start, end)]) of a pattern between plain words."""
    before, after = fill.plain(), fill.plain()
    text, spans = before + (" " if before else ""), []
    for part in re.split(r"([\[<]\w+[\]>])", pattern):
        if re.fullmatch(r"[\[<]\w+[\]>]", part):
            value = getattr(fill, "_pass" if part == "[pass]" else part[1:-1])()
            if part[0] == "[":
                spans.append((len(text), len(text) + len(value)))
            text += value
        else:
            text += part
    return text + (" " if after else "") + after, spans


def examples(each: int = 16, seed: int = 3, patterns: tuple[str, ...] = PATTERNS + OTHERS) -> list[tuple[str, list[tuple[int, int]]]]:
    fill = _Filler(seed)
    return [example(p, fill) for p in patterns for _ in range(each)] + [(fill.plain() + " " + fill.plain(), []) for _ in range(each * 20)]
