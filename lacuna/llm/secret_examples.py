"""Made examples from which the secret field learns what the fixed patterns cannot show it.

:func:`statement` gives a short text with the places of its secrets: keys, tokens, passwords and key blocks of many shapes, with or
without a word that announces them, in several notations; or a look-alike without any secret: identifiers, paths, addresses, dates, numbers,
placeholders.  Everything follows from the given random source.
"""

from __future__ import annotations

import random
import string

#: Words that announce a secret, marks between them and it, prefixes of issued tokens, placeholders.
TRIGGERS = (
    "password", "passwd", "pwd", "pass", "passphrase", "secret", "client_secret", "clientSecret", "token", "access_token", "auth_token", "api_key",
    "apikey", "api-key", "key", "private_key", "secret_key", "access key", "Authorization", "Bearer", "credential", "credentials", "signing key", "pin",
    "DB_PASSWORD", "SECRET_KEY", "AUTH_TOKEN", "PRIVATE_KEY",
)
MARKS = (": ", ":", " = ", "=", " ", " is ", ' = "', '="', ": '", " => ", '": "', " -> ")
PREFIXES = ("ghp_", "gho_", "sk-", "sk_live_", "pk_live_", "rk_test_", "xoxb-", "xoxp-", "glpat-", "npm_", "SG.", "AIza", "hf_", "dop_v1_", "shpat_", "key-")
PLACEHOLDERS = ("none", "null", "required", "********", "xxxxxxxx", "YOUR_API_KEY", "changeme", "<your-key>", "example", "todo", "hidden", "$TOKEN", "${PASSWORD}", "os.environ")

ALNUM, WORD64, URL64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_"


def _of(r: random.Random, alphabet: str, low: int, high: int) -> str:
    """Random characters, at least one of them a digit where the alphabet has digits."""
    out = [r.choice(alphabet) for _ in range(r.randint(low, high))]
    if "0" in alphabet:
        out[r.randrange(1, len(out))] = r.choice(string.digits)
    return "".join(out)


def _password(r: random.Random) -> str:
    core = r.choice(string.ascii_uppercase) + _of(r, string.ascii_letters + string.digits, 6, 14)
    at = r.randrange(1, len(core))
    return core[:at] + r.choice("!@#$%^&*_-+") + core[at:]


def secret(r: random.Random, words: list[str]) -> list[str]:
    """The tokens of one secret; more than one for key blocks and grouped codes."""
    kind = r.randrange(10)
    if kind == 0:
        return [r.choice(PREFIXES) + _of(r, ALNUM, 16, 44)]
    if kind == 1:
        return [_of(r, WORD64, 24, 64)]
    if kind == 2:
        return [_of(r, ALNUM, 16, 48)]
    if kind == 3:
        return [".".join(("eyJ" + _of(r, URL64, 12, 36), _of(r, URL64, 20, 80), _of(r, URL64, 20, 43)))]
    if kind == 4:
        return [_password(r)]
    if kind == 5:
        return [_of(r, string.hexdigits[:16].upper(), 24, 64)]
    if kind == 6:
        return [_of(r, WORD64, 40, 76) for _ in range(r.randint(2, 5))]
    if kind == 7:
        return [_of(r, string.ascii_uppercase + string.digits, 16, 32)]
    if kind == 8:
        return [_of(r, URL64, 20, 48)]
    return [r.choice(string.ascii_lowercase) + "-".join(_of(r, ALNUM, 8, 14) for _ in range(r.randint(2, 4)))]


def lookalike(r: random.Random, words: list[str]) -> str:
    """Something that is no secret; ``words`` come from the text around it."""
    w = lambda: r.choice(words)
    n = lambda low, high: str(r.randint(low, high))
    kinds = (
        lambda: "".join(w().capitalize() for _ in range(r.randint(2, 5))),
        lambda: "_".join(w() for _ in range(r.randint(2, 5))),
        lambda: "-".join(w() for _ in range(r.randint(2, 6))),
        lambda: "/".join(("", *(w() for _ in range(r.randint(2, 6))))) + r.choice((".py", ".txt", "", ".html")),
        lambda: r.choice(("https://", "http://www.")) + w() + ".org/" + "/".join(w() for _ in range(r.randint(1, 4))) + r.choice(("", "?id=" + n(1, 99999))),
        lambda: f"{w()}.{n(0, 99)}@{w()}{n(0, 9)}.{w()}.com",
        lambda: f"{n(1950, 2030)}-{n(10, 12)}-{n(10, 28)}T{n(10, 23)}:{n(10, 59)}:{n(10, 59)}Z",
        lambda: f"v{n(0, 20)}.{n(0, 20)}.{n(0, 99)}-beta{n(1, 9)}",
        lambda: f"+{n(1, 99)}-{n(100, 999)}-{n(1000, 9999)}-{n(1000, 9999)}",
        lambda: f"{n(1, 255)}.{n(0, 255)}.{n(0, 255)}.{n(0, 255)}",
        lambda: n(10**9, 10**18),
        lambda: f"{n(1, 10**6)},{n(100, 999)}.{n(10, 99)}",
        lambda: "-".join("".join(r.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)),
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(6, 10))),
        lambda: r.choice(("IMG", "DSC", "report", "scan")) + f"_{n(20000101, 20301231)}_{n(100000, 999999)}.jpg",
        lambda: f"{w().upper()}-{n(100, 9999)}",
        lambda: w() * r.randint(2, 4),
        lambda: r.choice("abcx-=*#.") * r.randint(8, 60),
        lambda: w().upper() + "_" + w().upper(),
        lambda: f"{w()}.{w()}({w()}_{n(1, 9)})",
        lambda: f"{w()}{n(1, 99)}",
        lambda: r.choice(TRIGGERS) + r.choice(MARKS) + r.choice(PLACEHOLDERS),
        lambda: f"{r.choice(TRIGGERS)} {w()} {w()}",
        lambda: f"{w()}{r.choice(MARKS)}{w()}",
        lambda: f"{w()}{r.choice((' = ', '=', ': '))}{n(1, 10**7)}",
    )
    return r.choice(kinds)()


def statement(r: random.Random, words: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """A text and the (start, end) of every secret token group in it; half of the statements have none."""
    words = words or ["word"]
    if r.random() < 0.5:
        return " ".join(lookalike(r, words) for _ in range(r.randint(1, 3))), []
    lead = "" if r.random() < 0.5 else r.choice(TRIGGERS) + r.choice(MARKS)
    if lead and r.random() < 0.2:
        weak = r.choice(words).lower() + _of(r, string.digits, 2, 4) + r.choice(("", r.choice(words).lower()))
        return lead + weak, [(len(lead), len(lead) + len(weak))]
    parts = secret(r, words)
    if len(parts) > 1:
        lead = r.choice(("-----BEGIN PRIVATE KEY-----\n", lead))
    body = "\n".join(parts) if len(parts) > 1 else parts[0]
    return lead + body + ('"' if lead.endswith('"') else "'" if lead.endswith("'") else ""), [(len(lead), len(lead) + len(body))]
