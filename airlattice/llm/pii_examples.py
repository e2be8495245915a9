"""The small labelled table of personal data: synthetic sentences with their spans, made by rule from a seed.

No sentence or value is a real person's. Every kind has forms that the fixed patterns see and forms that they don't, and
the table has as many look-alikes that are no personal data: card numbers with a wrong check digit, versions, dates,
order numbers, commits, handles, prices.
"""

from __future__ import annotations

import random
import re

NAMES = "ann bob carla dieter eve josé zoë ümit li petra nora tom karin paul rosa ivan mei omar lucía søren".split()
LAST = "miller novak garcía lind okafor tanaka rossi dubois weber santos".split()
HOSTS = "example.com mail.example.org corp.example.net post.example.io intern.example.de".split()
WORDS = "the report was sent to us after a long day and nobody in that team could find what they had asked for when it came back from there with many other papers of last year".split()

#: Sentences with fields {kind:form}; a field without a kind is no personal data.
SENTENCES = [
    "please write to {email:any} today about the order",
    "contact {email:any} or call {phone:any} before noon",
    "mail : {email:any} , tel : {phone:any}",
    "my address is {email:any} and I will answer",
    "reach out ( {email:any} ) for details",
    "call me at {phone:any} tomorrow",
    "phone {phone:any} , ask for the office",
    "tel. {phone:any} or fax {phone:any}",
    "you can text {phone:any} any time",
    "the host {ip:any} refused the connection",
    "login from {ip:any} failed again",
    "server at {ip:any} and gateway {ip:any}",
    "pay with card {card:any} please",
    "card number : {card:any} expires soon",
    "charged to {card:any} last week",
    'token = "{secret:any}" in the file',
    "api_key = {secret:any} must not leak",
    "the password is {secret:password} for now",
    "password : {secret:password}",
    "Authorization: Bearer {secret:any}",
    "secret = '{secret:any}'",
    "export KEY= {secret:any}",
    "some words {ip:any} more words {phone:any} and {email:any} then more",
    "order {:order} was shipped on {:date}",
    "version {:version} was released {:date} at {:clock}",
    "see page {:number} , section {:section} , figure {:number}",
    "the total is {:price} or {:percent} of {:number}",
    "commit {:commit} fixed it in {:version}",
    "checksum {:commit} of the archive",
    "invoice {:order} and parcel {:badcard} arrived",
    "serial number {:badcard} on the box",
    "{:badcard} is the id of the row",
    "{:badcard} and words and {:badcard} again",
    "thanks {:handle} and {:handle} for the help",
    "between {:number} and {:number} people , {:percent} more",
    "licensed under CC BY-NC {:version} or GNU General Public License, version {:version}",
    "written in C++ with {:plus} years and a+b",
    "room {:number} opens at {:clock} on {:date}",
    "a copy of order {:order} and of parcel {:order}",
    "file {:order} , box {:order} , shelf {:order}",
    "isbn {:order} , volume {:number}",
    "{:number} {:number} {:number} were the scores",
]


def luhn_digit(digits: str) -> str:
    total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def value(rng: random.Random, kind: str, form: str) -> str:
    n = lambda a, b: str(rng.randint(a, b))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    if kind == "email":
        name = rng.choice([rng.choice(NAMES), f"{rng.choice(NAMES)}.{rng.choice(LAST)}", f"{rng.choice(NAMES)}.{n(1, 99)}", f"{rng.choice(NAMES)}_{n(1, 99)}"])
        host = rng.choice(HOSTS)
        at = rng.choice(["@"] * 6 + ["[at]", "(at)", " [at] ", " (at) ", " @ ", "{at}"])
        if rng.random() < 0.1:
            return f"{name}@{rng.choice(['localhost', 'db' + n(1, 9), 'intranet'])}"
        dot = rng.choice([".", ".", "[dot]", " [dot] "]) if "at" in at else "."
        return name + at + host.replace(".", dot)
    if kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{digits(3)} {b} {c}", f"00{n(30, 49)} {digits(3)} {b} {c}", f"+{n(30, 49)} {digits(2)} {c} {digits(4)}", f"0{digits(3)}/{digits(7)}"])
    if kind == "ip":
        p = [n(1, 254) for _ in range(4)]
        return rng.choice([".".join(p), ".".join(p), "[.]".join(p), "(.)".join(p), ".".join(p[:3]) + "[.]" + p[3], f"2001:db8:{hexes(4)}::{hexes(3)}", f"fe80::{hexes(4)}:{hexes(4)}:{hexes(4)}:{hexes(4)}"])
    if kind == "card":
        body = digits(15)
        body += luhn_digit(body)
        return rng.choice(["", " ", "-", ".", "_", "/"]).join(body[i : i + 4] for i in range(0, 16, 4))
    if kind == "secret":
        if form == "password":
            return "".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) + rng.choice("!?_-") + digits(2)
        long = lambda k: "".join(rng.choice(letters) for _ in range(k))
        return rng.choice([hexes(40), hexes(32), hexes(64), hexes(40).upper(), "sk_" + long(24), "gh_" + long(36), "AK" + long(18).upper(), long(32)])
    if form == "order":
        return rng.choice([f"{digits(3)}-{digits(4)}-{digits(2)}", digits(6), f"A{digits(5)}", f"#{digits(7)}", f"{digits(2)}/{digits(4)}"])
    if form == "date":
        return rng.choice([f"20{n(10, 29)}-{n(10, 12)}-{n(10, 28)}", f"{n(1, 28)}.{n(1, 12)}.20{n(10, 29)}", f"{n(1, 28)}/{n(1, 12)}/20{n(10, 29)}"])
    if form == "badcard":
        body = digits(rng.choice([13, 15, 15, 15, 15]))
        return body + str((int(luhn_digit(body)) + rng.randint(1, 9)) % 10)
    made = {"version": lambda: rng.choice([f"{n(0, 9)}.{n(0, 20)}", f"{n(0, 9)}.{n(0, 20)}.{n(0, 9)}", f"v{n(1, 9)}.{n(0, 9)}", f"{n(1, 9)}."]), "clock": lambda: f"{n(10, 23)}:{n(10, 59)}", "number": lambda: n(0, 2000), "section": lambda: f"{n(1, 9)}.{n(1, 9)}", "price": lambda: f"${n(1, 9)},{digits(3)}.{digits(2)}", "percent": lambda: f"{n(1, 99)}%", "commit": lambda: hexes(rng.choice([7, 40, 40, 64])), "handle": lambda: "@" + rng.choice(NAMES), "plus": lambda: n(2, 20) + "+"}
    return made[form]()


def examples(n: int = 840, seed: int = 8) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``n`` sentences with their spans (kind, start, end), each between plain words, some in capitals or with marks at their words."""
    rng, out = random.Random(seed), []
    for i in range(n):
        parts = re.split(r"(\{[a-z]*:[a-z]+\})", SENTENCES[i % len(SENTENCES)])
        filler = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 9)))
        style = rng.choice(["", "", "", "", "!!", "###", "CAPS"])
        text, spans = filler() + " ", []
        for part in parts:
            if not part.startswith("{"):
                text += part.replace(" ", style + " ") if style in ("!!", "###") else part.upper() if style == "CAPS" else part
                continue
            kind, form = part[1:-1].split(":")
            made = value(rng, kind, form)
            made = made.upper() if style == "CAPS" and kind not in ("secret", "") else made
            if kind:
                spans.append((kind, len(text), len(text) + len(made)))
            text += made
        out.append((text + rng.choice(["", ".", ","]) + " " + filler(), spans))
    return out
