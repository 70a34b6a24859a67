"""LaTeX and Unicode text, and markup in titles."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordcheck.functions.arrow import arrow_function

# Accent commands and their combining marks.
ACCENTS = {
    "'": "́", "`": "̀", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇", "u": "̆",
    "v": "̌", "H": "̋", "c": "̧", "k": "̨", "r": "̊", "d": "̣", "b": "̱",
}

# Symbol commands.
SYMBOLS = {
    "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ",
    "dh": "ð", "DH": "Ð", "th": "þ", "TH": "Þ", "ng": "ŋ", "NG": "Ŋ", "textendash": "–", "textemdash": "—", "textasciitilde": "~",
    "textbackslash": "\\", "textquotedblleft": "“", "textquotedblright": "”", "textquoteleft": "‘", "textquoteright": "’", "S": "§", "P": "¶",
    "copyright": "©", "dag": "†", "ddag": "‡", "ldots": "…", "dots": "…", "textregistered": "®", "texttrademark": "™", "alpha": "α", "beta": "β",
    "gamma": "γ", "delta": "δ", "epsilon": "ε", "lambda": "λ", "mu": "μ", "pi": "π", "sigma": "σ", "tau": "τ", "theta": "θ", "omega": "ω",
}

# Characters with a LaTeX form of their own.
ENCODED = {
    "ß": r"{\ss}", "æ": r"{\ae}", "Æ": r"{\AE}", "œ": r"{\oe}", "Œ": r"{\OE}", "ø": r"{\o}", "Ø": r"{\O}", "å": r"{\aa}", "Å": r"{\AA}", "ł": r"{\l}",
    "Ł": r"{\L}", "ı": r"{\i}", "–": "--", "—": "---", "“": "``", "”": "''", "‘": "`", "’": "'", "…": r"\ldots{}",
}

_PLAIN = {"{": "", "}": "", "$": "", "~": " ", "---": "—", "--": "–", "``": "“", "''": "”"}
_UNIT = re.compile(r"\\(?P<word>[A-Za-z]+)|\\(?P<sign>.?)|---?|``|''|[{}$~]|[^\\{}$~`'-]+|.", re.S)
_ARGUMENT = re.compile(r" *(?:(?P<open>\{)|(?P<command>\\[A-Za-z]*)|(?P<one>.?))", re.S)
_BRACE = re.compile(r"[{}]")


def _argument(text: str, at: int) -> tuple[str, int]:
    """The argument of an accent command, and where it ends."""
    m = _ARGUMENT.match(text, at)
    if not m["open"]:
        return m["command"] or m["one"] or "", m.end()
    depth = 1
    for brace in _BRACE.finditer(text, m.end()):
        depth += 1 if brace[0] == "{" else -1
        if not depth:
            return text[m.end() : brace.start()], brace.end()
    return text[m.end() : len(text) - 1], len(text)


def latex_to_unicode(text: str | None) -> str | None:
    """LaTeX decoded for comparison and display; unknown commands go, their arguments stay."""
    if text is None:
        return None
    out, at = [], 0
    while at < len(text):
        m = _UNIT.match(text, at)
        at, word, sign = m.end(), m["word"], m["sign"]
        accent = ACCENTS.get(sign) if sign else ACCENTS.get(word) if word else None
        if accent:
            argument, at = _argument(text, at)
            base = latex_to_unicode(argument)
            if base:
                base = {"ı": "i", "ȷ": "j"}.get(base[0], base[0]) + accent + base[1:]
            out.append(unicodedata.normalize("NFC", base))
        elif word is not None:
            symbol = SYMBOLS.get(word)
            out.append(symbol or "")
            if symbol and text.startswith("{}", at):
                at += 2
            elif text.startswith(" ", at):
                at += 1
        elif sign is not None:
            out.append(sign if sign and sign in "&%$#_{}" else " " if sign == "\\" else "")
        else:
            out.append(_PLAIN.get(m[0], m[0]))
    return unicodedata.normalize("NFC", "".join(out))


_COMMANDS = {mark: name for name, mark in ACCENTS.items()}


def _encode(char: str, accents: bool) -> str:
    if char in "&%#_":
        return "\\" + char
    if char in "{}":
        return ""  # would unbalance the value
    if char == "\\":
        return r"\textbackslash{}"
    if not accents or char.isascii():
        return char
    if char in ENCODED:
        return ENCODED[char]
    base, *marks = unicodedata.normalize("NFD", char)
    if len(marks) != 1 or marks[0] not in _COMMANDS or not (base.isascii() and base.isalpha()):
        return char
    command = _COMMANDS[marks[0]]
    base = r"\i" if base == "i" and command != "c" else base
    return f"{{\\{command}{{{base}}}}}" if command.isalpha() else f"{{\\{command}{base}}}"


def unicode_to_latex(text: str | None, accents: bool = True) -> str | None:
    """External text made safe for a BibTeX value."""
    return None if text is None else "".join(_encode(c, accents) for c in unicodedata.normalize("NFC", text))


#: A tag of fewer than 200 characters, brackets included but for one.
TAG = r"</?[A-Za-z](?=[^>]{0,198}>)[\w:.-]*(?:\s[^<>]*)?/?>"


def strip_markup(text: str | Column) -> Column:
    """Simple tags out, the common entities decoded, white space collapsed; numeric references by an Arrow function."""
    plain = F.regexp_replace(text, TAG, "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(numeric_references(plain), r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+", " "))


def had_markup(text: str | Column) -> Column:
    return F.regexp_like(text, F.lit(TAG))


def decode_references(text: str | None) -> str | None:
    return None if text is None else re.sub(r"&#(\d{1,6});", lambda m: chr(min(int(m[1]), 0x10FFFF)), text)


numeric_references = arrow_function(decode_references, "string")
decode_latex = arrow_function(latex_to_unicode, "string")
encode_latex = arrow_function(lambda text: unicode_to_latex(text), "string")
encode_latex_plain = arrow_function(lambda text: unicode_to_latex(text, False), "string")
