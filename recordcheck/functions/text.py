"""Comparison forms of text and similarity of titles."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordcheck.functions.arrow import arrow_function, text_function
from recordcheck.functions.binding import bound
from recordcheck.functions.latex import latex_to_unicode

# Words that a citation key's keyword passes over.
STOPWORDS = (
    "a", "an", "the", "of", "for", "and", "or", "in", "on", "at", "to", "with", "by", "from", "via", "into", "towards", "toward", "using", "based",
    "is", "are", "its", "as", "we", "our", "how", "what", "why", "when", "do", "does", "can", "new", "vs",
)

# Words that begin the title of a notice about another work.
NOTICES = (
    "erratum", "errata", "corrigendum", "correction", "retraction", "retracted", "addendum", "withdrawal", "withdrawn", "comment", "comments",
    "commentary", "reply", "response", "rejoinder", "discussion", "editorial", "preface", "foreword", "author correction", "publisher correction",
    "expression of concern",
)

#: Longest text that edit distance compares.
EDIT_CHARS = 2000
# Fixed value: characters of a title from which it may begin another and count as like it.
FORGIVEN_CHARS = 20
_FOLDED = str.maketrans({"ß": "ss", "ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ı": "i"}) | dict.fromkeys(range(0x300, 0x370))
_DASH = re.compile("[‐-―−-]")
_OTHER = re.compile(r"[^\w\s]|_")


def fold_diacritics(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKD", text).translate(_FOLDED)


def normalize_text(text: str | None) -> str:
    """The comparison form: LaTeX decoded, folded, lower case, letters and digits only, single spaces."""
    if not text:
        return ""
    plain = fold_diacritics(latex_to_unicode(text)).lower()
    return " ".join(_OTHER.sub(" ", _DASH.sub(" ", plain)).split())


folded = arrow_function(fold_diacritics, "string")
#: Null gives ''. Costs a Python call for each distinct text of a batch: compute it once a record, not once a pair.
normalized = arrow_function(normalize_text, "string")
#: The same of whole documents.
normalized_document = text_function(normalize_text)


def words(norm: str | Column) -> Column:
    """Tokens of a comparison form."""
    return F.filter(F.split(norm, " "), lambda w: w != "")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance of the first 2000 characters over the longer length; null counts as empty."""

    def of(a: Column, b: Column) -> Column:
        longest = F.greatest(F.char_length(a), F.char_length(b))
        distance = F.when(longest > EDIT_CHARS, F.levenshtein(F.substring(a, 1, EDIT_CHARS), F.substring(b, 1, EDIT_CHARS))).otherwise(F.levenshtein(a, b))
        return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - distance / longest)

    return bound(of, F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def token_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of two token lists as multisets."""
    count = lambda items, item: F.size(F.filter(items, lambda x: x == item))

    def of(a: Column, b: Column) -> Column:
        common = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, w: acc + F.least(count(a, w), count(b, w)))
        total = F.size(a) + F.size(b)
        return F.when(total == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * common / total)

    return bound(of, a, b)


def title_similarity(a: Column, b: Column) -> Column:
    """Of two comparison forms: tokens and edits blended; a main title without its subtitle is forgiven. Empty gives 0."""

    def of(a: Column, b: Column) -> Column:
        blend = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * token_similarity(words(a), words(b)) + 0.4 * edit_similarity(a, b)))
        shorter = F.least(F.char_length(a), F.char_length(b))
        least = F.when((shorter >= FORGIVEN_CHARS) & (F.startswith(a, b) | F.startswith(b, a)), 0.9).otherwise(0.0)
        return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.greatest(blend, least))

    return bound(of, F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


#: The notice word must be followed by one of a few words or signs, with nothing asked of what comes after those.
NOTICE = r"(?i)^\s*(" + "|".join(NOTICES) + r")\b\s*(?:to|on|of|for|:|\x{2014}|\x{2013}|-)"


def correction_marker(title: str | Column) -> Column:
    """The notice word that a title begins with, lower-cased; null for titles of works."""
    plain = F.trim(F.regexp_replace(title, "[{}]", ""))
    return F.nullif(F.lower(F.regexp_extract(plain, NOTICE, 1)), F.lit(""))


def line_of(text: Column, position: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substring(text, F.lit(1), position.cast("int"))
    return F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def title_query(text: str | None, most: int | None = 14) -> str:
    """Plain words of a title, to search by."""
    if not text:
        return ""
    plain = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", latex_to_unicode(text)))
    plain = re.sub(r"[{}$\\]", "", re.sub(r"\\[a-zA-Z]+", " ", plain))
    return " ".join(re.sub(r"[^\w\s-]|_", " ", plain).split()[: most or 14])


query_words = arrow_function(lambda text, most: title_query(text, int(most)), "string")


def dblp_words(query: str | Column) -> Column:
    """Of a 20-word query: the first ten words of two or more letters and digits."""
    plain = F.regexp_replace(query, "-+", " ")
    return F.array_join(F.slice(F.filter(F.split(plain, r"\s+"), lambda w: w.rlike(r"^[\p{L}\p{N}]{2,}$")), 1, 10), " ")


def datacite_words(query: str | Column) -> Column:
    """A query without the signs that a search syntax would read."""
    return F.trim(F.regexp_replace(query, r'[+\-!(){}\[\]^"~*?:\\/]', " "))
