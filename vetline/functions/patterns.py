"""Regular expressions shared by the Spark expressions and the SQL oracle.

Spark evaluates ``rlike``/``regexp_*`` with java.util.regex and DuckDB with
RE2, while the screened behaviour follows Python's ``re``/``str`` predicates.
The character classes below are therefore spelled out explicitly instead of
relying on ``\\s``/``\\w``/``\\b`` (whose meaning differs between the three).
Classes that follow a Python predicate are generated from that predicate.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache


def _ranges_to_class(codepoints: list[int]) -> str:
    """Render code points as a regex class body using ``\\x{..}`` escapes
    (understood by both java.util.regex and RE2)."""
    out, i = [], 0
    cps = sorted(codepoints)
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        lo, hi = cps[i], cps[j]
        out.append(f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}")
        i = j + 1
    return "".join(out)


@lru_cache(maxsize=None)
def ws_body() -> str:
    """Class body of Python's ``str.isspace`` (= ``re`` Unicode ``\\s``)."""
    return _ranges_to_class([c for c in range(0x3001) if chr(c).isspace()])


@lru_cache(maxsize=None)
def digit_body() -> str:
    """Class body of Python's ``str.isdigit``: ``\\p{Nd}`` plus the digit-typed
    code points outside Nd (superscripts, circled digits, ...)."""
    extra = [
        c for c in range(0x110000)
        if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"
    ]
    return "\\p{Nd}" + _ranges_to_class(extra)


# Python ``isalnum`` is exactly \p{L} ∪ \p{N}; word characters add "_".
ALNUM = "\\p{L}\\p{N}"
WORD = "\\p{L}\\p{N}_"


def ws_class() -> str:
    return f"[{ws_body()}]"


def ws_excess() -> str:
    """What collapsing white space changes: two or more in a row, or a single
    one that is no space. Lone spaces, nearly all of a text's, do not match."""
    rest = _ranges_to_class([c for c in range(0x3001) if chr(c).isspace() and c != 0x20])
    return f"[{ws_body()}]{{2,}}|[{rest}]"


def non_ws_run() -> str:
    return f"[^{ws_body()}]+"


def word_bounded(alternatives: str) -> str:
    """Emulate Python's Unicode ``\\b(?:alts)\\b`` for existence tests without
    look-behind (RE2 has none): the boundary characters are consumed, which
    does not change whether a match exists."""
    return f"(?:^|[^{WORD}])(?:{alternatives})(?:$|[^{WORD}])"


# ---------------------------------------------------------------------------
# The cue vocabularies of the screening rules.
# Promotional terms (matched case-insensitively, no word boundaries).
PROMO_TERMS = ("discount", "promo", "coupon", "deal", "sale", "%\\s*off", "dm\\s*me", "buy now")
# Non-visitor admissions (case-insensitive, word-bounded, ASCII apostrophe).
NEVER_BEEN_PHRASES = ("never been", "haven't been", "didn't visit", "did not go", "have not gone")
# Experiential cues, each searched word-bounded in the lower-cased text; each
# present cue adds 1/4 to the score (capped at 1). Listed in reference order.
EXPERIENTIAL_CUES = (
    "we ordered", "i ordered", "we visited", "we went",
    "the waiter", "table", "receipt", "menu",
    "appointment", "front desk", "parking", "line",
    "check(ing)? in", "seated", "ord(er)ed",
)
# Letters outside ASCII that (?iu) takes for an ASCII one: İ, ı, ſ, K (Kelvin).
FOLDED_TO_ASCII = ("\u0130", "\u0131", "\u017f", "\u212a")
# Consonants for the long-consonant-run test of user names (y counts).
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
# ---------------------------------------------------------------------------


def _ws_escape(term: str) -> str:
    return term.replace("\\s", f"[{ws_body()}]")


def url_pattern() -> str:
    """``https?://\\S+|www\\.\\S+`` with Python's ``\\S``."""
    nws = non_ws_run()
    return f"https?://{nws}|www\\.{nws}"


def promo_pattern(dialect: str = "spark") -> str:
    flags = "(?iu)" if dialect == "spark" else "(?i)"
    return flags + "(?:" + "|".join(_ws_escape(t) for t in PROMO_TERMS) + ")"


def never_been_pattern(dialect: str = "spark") -> str:
    flags = "(?iu)" if dialect == "spark" else "(?i)"
    return flags + word_bounded("|".join(NEVER_BEEN_PHRASES))


def experiential_patterns() -> list[str]:
    """One pattern per cue; group syntax kept, made non-capturing."""
    return [word_bounded(c.replace("(", "(?:")) for c in EXPERIENTIAL_CUES]


def tag_pattern(dialect: str = "spark") -> str:
    """``<.*?>`` where ``.`` excludes only ``\\n`` (Python default)."""
    return ("(?d)" if dialect == "spark" else "") + "<.*?>"


def emoji_pattern() -> str:
    """Any code point above 10000 decimal (0x2710)."""
    return "[\\x{2711}-\\x{10FFFF}]"


def nonword_pattern() -> str:
    return f"[^{ALNUM}{ws_body()}]"


def token_pattern() -> str:
    """Tokens of the TF-IDF vectorisers: runs of 2+ word characters
    (``\\b\\w\\w+\\b`` with Python's Unicode ``\\w``)."""
    return f"[{WORD}]{{2,}}"
