"""A small labelled table of personal data and of what only looks like it.

Rows are (text, kind, start, end, fold): the span is what a reader would redact; kind is
null where the text holds none. They are put together from formats, lead-ins and
surroundings that are named here, with made-up values; no corpus and no rule of the
finder has a part in the labels. Of every three rows of a format one is held out (fold 0).
"""

from __future__ import annotations

import random
from collections.abc import Callable

Fill = Callable[[random.Random], str]
#: Surroundings: prose in some languages, marks, table cells.
BEFORE = ("", "We met and then ", "As the note says ", "und danach ", "et puis ", "luego vino ", "| ", "(", "... ", "THEN!! ", "so:\n")
AFTER = ("", " and left early.", ". The rest follows", "!! MORE", "### end", " | next", ", danke sehr", " y nada mas", ")", "\nBye")
NAMES = ("anna", "ben", "carla", "dimitri", "elif", "farid", "gina", "hugo", "ines", "jonas")
HOSTS = ("mail", "post", "web4", "home", "north-shop", "lab", "city", "club7")
ENDS = ("example", "test", "org", "com", "net", "de", "fr", "io")


def digits(rng: random.Random, n: int, first: str = "") -> str:
    return first + "".join(rng.choice("0123456789") for _ in range(n - len(first)))


def checked(rng: random.Random, n: int, first: str = "") -> str:
    """n digits whose last one makes the Luhn sum a ten."""
    body = digits(rng, n - 1, first)
    odd = [int(c) for c in reversed(body)]
    total = sum(d * 2 - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(odd))
    return body + str(-total % 10)


def in_fours(s: str, by: str) -> str:
    return by.join(s[i : i + 4] for i in range(0, len(s), 4))


def letters(rng: random.Random, n: int, of: str) -> str:
    return "".join(rng.choice(of) for _ in range(n))


_HEX, _MIXED = "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789"
_octet = lambda r: str(r.randint(1, 254))
_local = lambda r: r.choice(NAMES) + r.choice(["", "." + r.choice(NAMES), str(r.randint(1, 99)), "_x"])
_quad = lambda r, by=".": by.join(_octet(r) for _ in range(4))
_card = lambda r: r.choice([checked(r, 16, r.choice("3456")), checked(r, 15, "37"), checked(r, 16)])
_key = lambda r: r.choice([letters(r, r.choice([32, 40, 64]), _HEX), letters(r, r.randint(20, 44), _MIXED)])
_signed = lambda r: "eyJ" + letters(r, r.randint(17, 60), _MIXED) + "." + letters(r, r.randint(30, 600), _MIXED) + "." + letters(r, 43, _MIXED)

#: kind, lead-ins, formats of what is to be found.
FOUND: tuple[tuple[str, tuple[str, ...], tuple[Fill, ...]], ...] = (
    ("email", ("", "", "mail ", "contact: ", "write to ", "von "), (
        lambda r: f"{_local(r)}@{r.choice(HOSTS)}.{r.choice(ENDS)}",
        lambda r: f"{_local(r)} (at) {r.choice(HOSTS)} (dot) {r.choice(ENDS)}",
        lambda r: f"{_local(r)}[at]{r.choice(HOSTS)}[dot]{r.choice(ENDS)}",
        lambda r: f"{_local(r)}(at){r.choice(HOSTS)}.{r.choice(ENDS)}",
        lambda r: f"{_local(r)} @ {r.choice(HOSTS)}.{r.choice(ENDS)}",
    )),
    ("ip", ("", "", "from ", "host ", "ip: ", "server "), (
        _quad,
        lambda r: _quad(r, "[.]"),
        lambda r: _quad(r, "(.)"),
        lambda r: ":".join(letters(r, 4, _HEX) for _ in range(8)),
    )),
    ("card", ("", "", "card ", "visa: ", "account no ", "konto "), (
        _card,
        lambda r: in_fours(checked(r, 16, "4"), r.choice([" ", "-", "."])),
        lambda r: in_fours(digits(r, 16), r.choice([" ", "-"])),
        lambda r: digits(r, 16),  # an account number, mistyped or not
        lambda r: checked(r, 13, "4"),
    )),
    ("phone", ("", "tel ", "phone: ", "call ", "fax ", "mobile "), (
        lambda r: f"({r.randint(201, 989)}) {r.randint(200, 999)}-{digits(r, 4)}",
        lambda r: f"+{r.randint(1, 99)} ({digits(r, 3)}) {digits(r, 3)}-{digits(r, 4)}",
        lambda r: f"{r.randint(201, 989)}-{r.randint(200, 999)}-{digits(r, 4)}",
        lambda r: f"00{r.randint(30, 49)} {r.randint(20, 99)} {digits(r, 4)} {digits(r, 4)}",
    )),
    ("phone", ("tel ", "phone: ", "call ", "fax ", "mobile "), (
        lambda r: f"0{r.randint(20, 99)} {digits(r, 7, '4')}",
        lambda r: f"0{r.randint(20, 99)}/{digits(r, 3, '7')} {digits(r, 4)}",
        lambda r: f"{r.randint(200, 999)}-{digits(r, 4)}",
    )),
    ("secret", ("token = \"", "api_key: ", "secret=", "TOKEN = \"", "access_key=\"", "Bearer ", "password: ", "auth_token='"), (_key, _key, _signed)),
    ("secret", ("password=", "pwd: ", "passwd = \""), (lambda r: letters(r, r.randint(8, 12), _MIXED) + str(r.randint(10, 99)), lambda r: r.choice(NAMES) + digits(r, r.randint(2, 4)) + r.choice(["", "x", "!"]))),
    ("secret", ("", "use ", "key "), (
        lambda r: "ghp_" + letters(r, 36, _MIXED),
        lambda r: "AKIA" + letters(r, 12, "ABCDEFGHIJKLMNOP") + digits(r, 4),
        lambda r: "sk_live_" + letters(r, 24, _MIXED),
        _signed,
    )),
)
#: Lead-ins and formats of what is not.
OTHER: tuple[tuple[tuple[str, ...], tuple[Fill, ...]], ...] = (
    (("meet ", "lunch ", "we sat "), (lambda r: f"@ noon. {r.choice(['Then', 'We', 'It'])} went", lambda r: f"(at) home. {r.choice(['Then', 'We'])} ate")),
    (("icon ", "see ", "load "), (lambda r: f"{r.choice(NAMES)}@{r.randint(2, 3)}x.{r.choice(['png', 'jpg', 'svg'])}", lambda r: f"{r.choice(NAMES)}@{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}")),
    (("apples ", "oil "), (lambda r: f"@ {r.randint(1, 9)}.{r.randint(10, 99)} each", lambda r: f"@{r.randint(1, 9)}.{r.randint(10, 99)}")),
    (("version ", "v", "release ", "section ", "chapter "), (lambda r: ".".join(str(r.randint(0, 30)) for _ in range(4)),)),
    (("numbers ", "scores ", "rows "), (lambda r: ",".join(str(r.randint(1, 300)) for _ in range(4)), lambda r: f"{r.randint(256, 999)}.{r.randint(1, 255)}.{r.randint(256, 999)}.{r.randint(1, 255)}")),
    (("at ", "on ", "log "), (lambda r: f"20{r.randint(10, 29)}0{r.randint(1, 9)}{r.randint(10, 28)}{r.randint(100000, 235959)}", lambda r: f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)} {r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}")),
    (("isbn ", "ISBN: ", "isbn-13 "), (lambda r: f"978-3-{r.randint(10, 99)}-{digits(r, 6)}-{r.randint(0, 9)}", lambda r: "978" + digits(r, 10))),
    (("order no ", "order id: ", "ticket ", "parcel ", "sku "), (lambda r: digits(r, r.choice([14, 17, 18, 19]), "9"), lambda r: digits(r, 8, "7"))),
    (("about ", "some ", "pi is 3.", "0."), (lambda r: str(r.randint(1, 9)) + "0" * r.choice([12, 13, 15, 18]), lambda r: digits(r, r.choice([13, 15]), "14"))),
    (("pi is 3.", "0.", "x = 2.", "ratio 1."), (lambda r: digits(r, r.choice([13, 15, 16, 17])),)),
    (("from ", "years ", "pages ", "pp. ", "between "), (lambda r: f"19{r.randint(10, 49)} 19{r.randint(50, 99)}", lambda r: f"19{r.randint(10, 49)}-20{r.randint(10, 24)}", lambda r: f"{r.randint(100, 499)}-{r.randint(500, 999)}", lambda r: f"{r.randint(1000, 1499)}-{r.randint(1500, 1999)}")),
    (("cost ", "$", "EUR ", "about "), (lambda r: f"{r.randint(10, 99)} {digits(r, 3, '4')} {digits(r, 3, '5')}", lambda r: f"{r.randint(1000, 9999)}.{digits(r, 3)}.{digits(r, 3)}", lambda r: digits(r, 7, "3"))),
    (("commit ", "sha1: ", "md5 ", "checksum: ", "digest ", "revision "), (lambda r: letters(r, r.choice([32, 40, 64]), _HEX),)),
    (("uuid ", "id ", "see "), (lambda r: "-".join(letters(r, n, _HEX) for n in (8, 4, 4, 4, 12)),)),
    (("http://www.example.org/", "files/", "path /usr/"), (lambda r: f"{r.choice(NAMES)}/{r.choice(NAMES)}-{r.randint(100, 999)}/{r.choice(HOSTS)}-{r.randint(2000, 2030)}", lambda r: f"{r.choice(NAMES)}_{r.choice(HOSTS)}_{r.randint(10, 99)}_{r.choice(NAMES)}")),
    (("password: ", "token = ", "secret: ", "the key "), (lambda r: r.choice(["required", "optional", "whatever", "forgotten"]), lambda r: r.choice(["nextToken", "string", "undefined", "parameter"]))),
    (("the ", "Die ", "un "), (lambda r: r.choice(["Donaudampfschifffahrtsgesellschaft", "well-known-and-long-running", "anticonstitutionnellement", "COVID-19-related-measures"]), lambda r: f"{r.randint(1, 99)} people, {r.randint(100, 999)} days")),
)


def examples(seed: int = 9, each: int = 30) -> list[tuple[str, str | None, int, int, int]]:
    """each rows of every format; some 1,700 in all by default."""
    rng, out = random.Random(seed), []

    def add(kind: str | None, leads: tuple[str, ...], formats: tuple[Fill, ...]) -> None:
        for make in formats:
            for k in range(each):
                hit, lead = make(rng), leads[k % len(leads)]
                head = rng.choice(BEFORE) + lead
                out.append((head + hit + ('"' if lead[-1:] == '"' else "'" if lead[-1:] == "'" else "") + rng.choice(AFTER), kind, len(head), len(head) + len(hit), (k + k // len(leads)) % 3))

    for kind, leads, formats in FOUND:
        add(kind, leads, formats)
    for leads, formats in OTHER:
        add(None, leads, formats)
    return out
