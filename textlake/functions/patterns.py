"""Fixed pattern tables of the text screen and the regexes built from them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, java_quote

INJECTION = "injection"
SECRET_LEAK = "secret_leak"

# Fixed values. Phrases are ASCII-case-insensitive; at one position the first
# phrase of the list wins.
INJECTION_PHRASES = [
    ("ignore previous", "override previous instructions"),
    ("ignore all previous", "override ALL previous instructions"),
    ("disregard", "potential instruction override"),
    ("forget everything", "attempt to reset context"),
    ("you are now", "role change attempt"),
    ("act as", "role manipulation"),
    ("pretend to be", "role manipulation"),
    ("system:", "system message injection"),
    ("assistant:", "assistant response injection"),
    ("user:", "user message injection"),
    ("<|", "special token injection"),
    ("|>", "special token injection"),
    ("[INST]", "instruction token injection"),
    ("[/INST]", "instruction token injection"),
    ("new instructions", "new instruction attempt"),
    ("updated instructions", "instruction update attempt"),
]

# Fixed values. (prefix, least total length in bytes, class of the rest up to
# the next whitespace byte or None for any, description); case-sensitive; at
# one position the first entry that passes wins.
LEAK_PREFIXES = [
    ("sk-ant-api", 20, "A-Za-z0-9_-", "Anthropic API key"),
    ("sk-proj-", 20, "A-Za-z0-9_-", "OpenAI API key (project)"),
    ("sk-", 20, "A-Za-z0-9_-", "OpenAI API key"),
    ("AKIA", 20, "A-Z0-9", "AWS access key"),
    ("ghp_", 40, "A-Za-z0-9_", "GitHub personal token"),
    ("gho_", 40, "A-Za-z0-9_", "GitHub OAuth token"),
    ("ghu_", 40, "A-Za-z0-9_", "GitHub user token"),
    ("ghs_", 40, "A-Za-z0-9_", "GitHub server token"),
    ("ghr_", 40, "A-Za-z0-9_", "GitHub refresh token"),
    ("github_pat_", 40, "A-Za-z0-9_", "GitHub fine-grained PAT"),
    ("xoxb-", 15, "A-Za-z0-9_-", "Slack bot token"),
    ("xoxp-", 15, "A-Za-z0-9_-", "Slack user token"),
    ("xoxa-", 15, "A-Za-z0-9_-", "Slack app token"),
    ("SG.", 40, "A-Za-z0-9_.-", "SendGrid API key"),
    ("sk_live_", 24, "A-Za-z0-9_", "Stripe live API key"),
    ("sk_test_", 24, "A-Za-z0-9_", "Stripe test API key"),
    ("sess_", 32, "A-Za-z0-9_", "Session token"),
    ("-----BEGIN", 10, None, "PEM private key"),
    ("AIza", 39, "A-Za-z0-9_-", "Google API key"),
    ("Bearer ", 27, None, "Bearer token"),
]

# Whitespace bytes that end a token: the ASCII ones, the four separators, and
# the two Latin-1 bytes 85 and A0, also where they sit inside a character.
SPACE_BYTES = r"\t-\r\x1c-\x20\x85\xa0"


def _guard(strings, nocase=False) -> str:
    """Lookahead on the possible first three bytes: nearly all positions fail on it alone.

    Without it every position would try every alternative in turn.
    """
    classes = ""
    for i in range(3):
        chars = {s[i] for s in strings if len(s) >= 3}
        if nocase:
            chars = {x for ch in chars for x in (ch.lower(), ch.upper())}
        classes += "[" + "".join(java_quote(ch) for ch in sorted(chars)) + "]"
    return "(?=" + "|".join([classes, *[java_quote(s) for s in strings if len(s) < 3]]) + ")"


def _leak_alternative(prefix, min_total, char_class) -> str:
    least = max(0, min_total - len(prefix))
    if char_class is None:
        rest = f"[^{SPACE_BYTES}]{{{least}}}" if least else ""
    else:
        # Possessive, so the class run is read once and then has to end the token.
        rest = f"[{char_class}]{{{least},}}+(?![^{SPACE_BYTES}])"
    return java_quote(prefix) + (f"(?={rest})" if rest else "")


_leak_prefixes = [p for p, *_ in LEAK_PREFIXES]
_phrases = [p for p, _ in INJECTION_PHRASES]

# On the byte view: group 1 is the prefix or phrase that wins at a position.
_leaks = "|".join(_leak_alternative(p, n, c) for p, n, c, _ in LEAK_PREFIXES)
_injections = "(?i:" + "|".join(map(java_quote, _phrases)) + ")"
LEAK_AT = _guard(_leak_prefixes) + "(" + _leaks + ")"
INJECTION_AT = "(?i:" + _guard(_phrases, True) + ")(" + _injections + ")"

# Both tables in one pass: no prefix and phrase can match at the same position,
# because they differ within their first three bytes.
ANY_AT = "(?:" + _guard(_leak_prefixes) + "|(?i:" + _guard(_phrases, True) + "))(" + _leaks + "|" + _injections + ")"

# On the plain text: the marks of two bytes are looked for on their own, which
# leaves the other phrases with a guard of three classes.
SHORT_PHRASES = [p for p in _phrases if len(p) < 3]
_long_phrases = [p for p in _phrases if len(p) >= 3]
LONG_PHRASE = "(?i)" + _guard(_long_phrases, True) + "(?:" + "|".join(map(java_quote, _long_phrases)) + ")"

# On the plain text: a cheap necessary condition for LEAK_AT.
LEAK_HINT = (
    _guard(_leak_prefixes) + "(?:" + "|".join(map(java_quote, _leak_prefixes)) + ")"
)


def _lookup(pairs, key) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(pairs)))[key]


def leak_description(prefix) -> Column:
    return _lookup([(p, d) for p, _, _, d in LEAK_PREFIXES], col(prefix))


def injection_description(phrase) -> Column:
    return _lookup([(p.lower(), d) for p, d in INJECTION_PHRASES], F.lower(col(phrase)))


def is_leak_prefix(tag) -> Column:
    return col(tag).isin(_leak_prefixes)
