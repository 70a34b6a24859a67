"""Terms of a title whose capitals must be kept, and citation keys."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordcheck.config import KeyScheme
from recordcheck.functions.arrow import arrow_function
from recordcheck.functions.latex import latex_to_unicode
from recordcheck.functions.text import STOPWORDS, fold_diacritics

# Proper names that are kept unless they begin the title.
PROPER_NAMES = frozenset((
    "Python", "Java", "Linux", "Android", "Windows", "Unix", "Bayesian", "Markov", "Gaussian", "Boolean", "Euclidean", "Turing", "Scratch", "Snap", "Rust",
    "Haskell", "Kotlin", "Swift", "Excel", "Minecraft", "Arduino", "Raspberry", "Pi", "English", "Spanish", "Chinese", "Hindi", "Wikipedia", "Twitter",
    "Reddit", "Google", "Microsoft", "Amazon", "Ethereum", "Bitcoin", "Dirichlet", "Fourier", "Hilbert", "Riemann", "Nash", "Pareto", "Monte", "Carlo",
    "Hamiltonian", "Laplacian",
))

_UNIT = re.compile(r"\\(?:[A-Za-z]+|.?)|(?P<sign>[{}$])|(?P<word>[A-Za-z0-9]+)", re.S)


def open_words(value: str) -> list[tuple[str, int]]:
    """(word, offset) outside braces, math and LaTeX commands."""
    depth, math, found = 0, False, []
    for m in _UNIT.finditer(value):
        if m["sign"] == "$":
            math = not math
        elif m["sign"]:
            depth = depth + 1 if m["sign"] == "{" else max(0, depth - 1)
        elif m["word"] and not depth and not math:
            found.append((m["word"], m.start()))
    return found


def protection_terms(title: str | None) -> list[dict[str, str]]:
    """Acronyms, mixed-case words and proper names, each once; none of a title that is all in capitals."""
    spelled = [w for w, _ in open_words(title or "") if re.search("[A-Za-z]", w)]
    upper = [w for w in spelled if len(w) > 1 and w.isupper()]
    if len(spelled) >= 4 and len(upper) / len(spelled) > 0.6:
        return []
    kinds: dict[str, str] = {}
    for k, word in enumerate(spelled):
        if len(word) > 1 and word.isupper():
            kinds[word] = "acronym"
        elif re.search("[A-Z]", word[1:]):
            kinds[word] = "acronym" if re.search(r"\d", word) else "mixed-case"
        elif k and word in PROPER_NAMES:
            kinds[word] = "proper-name"
    return [{"term": t, "kind": k} for t, k in kinds.items()]


def wrap_term(value: str | None, term: str | None) -> str | None:
    """Braces around each open occurrence of a term as a whole word; wrapping twice changes nothing."""
    if value is None or term is None:
        return value
    for word, at in reversed(open_words(value)):
        if word == term:
            value = f"{value[:at]}{{{term}}}{value[at + len(term):]}"
    return value


detect_terms = arrow_function(protection_terms, "array<struct<term:string,kind:string>>")
wrapped = arrow_function(wrap_term, "string")


def ascii_letters(text: str) -> str:
    return re.sub("[^A-Za-z0-9]", "", fold_diacritics(latex_to_unicode(text)))


def title_keyword(title: str | None) -> str | None:
    """The first word of three or more letters and digits that is no stop word."""
    words = map(ascii_letters, re.split(r"[\s\-:;,.?!()\[\]/]+", latex_to_unicode(title or "")))
    return next((w for w in words if len(w) > 2 and w.lower() not in STOPWORDS), None)


keyword = arrow_function(title_keyword, "string")
key_author = arrow_function(lambda name: None if name is None else ascii_letters("".join(latex_to_unicode(name).split())), "string")


def base_key(author: Column, year: Column, title: Column, venue: Column, scheme: KeyScheme = KeyScheme()) -> Column:
    """A citation key without a suffix. At least two pieces are needed, of which an empty author counts as one."""
    pieces = {"author": key_author(author), "year": year.cast("string"), "keyword": keyword(title), "venue": venue}
    held = F.array_compact(F.array(*[pieces[p] for p in scheme.parts]))
    key = F.array_join(F.filter(held, lambda p: p != ""), scheme.separator)
    return F.when(F.size(held) >= 2, F.lower(key) if scheme.lowercase else key)


def free_key(key: str | None, taken, separator: str = "_") -> str | None:
    """The key, or the first of its suffixes a to z that is not taken; else null."""
    if key is None:
        return None
    used = set(taken if taken is not None else ())
    return next((k for k in (key, *(f"{key}{separator}{chr(97 + i)}" for i in range(26))) if k not in used), None)


def unique_key(key: Column, taken: Column, separator: str = "_") -> Column:
    """free_key over an array of keys."""

    @F.pandas_udf("string")
    def run(key: pd.Series, taken: pd.Series) -> pd.Series:
        return pd.Series([free_key(k, t, separator) for k, t in zip(key, taken)], dtype=object)

    return run(key, taken)


def keys_by_stem(keys: DataFrame, separator: str = "_") -> DataFrame:
    """(file_id, key) -> (file_id, stem, existing_keys): of each file the keys that are a stem or a stem with a suffix, so that
    a row holds 27 at most, however many keys its file has. Only these decide whether the stem or one of its suffixes is free."""
    bare = F.regexp_replace("key", re.escape(separator) + "[a-z]$", "")
    stems = keys.filter("key IS NOT NULL").select("file_id", "key", F.explode(F.array_distinct(F.array(F.col("key"), bare))).alias("stem"))
    return stems.groupBy("file_id", "stem").agg(F.collect_set("key").alias("existing_keys"))


def suffixed_keys(base: Column, place: Column, separator: str = "_") -> Column:
    """When all keys of a file are made anew: the first keeps its base, the others get a, b, ...; null after z."""
    letter = F.chr(F.lit(95) + place)
    return F.when(place == 1, base).when(place <= 27, F.concat(base, F.lit(separator), letter))
