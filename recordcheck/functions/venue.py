"""Venue names: tokens, acronyms, initialisms and similarity.

Keys are computed once for each venue (`venue_keys`); similarity of pairs is then built of Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordcheck.functions.arrow import arrow_function
from recordcheck.functions.binding import bound
from recordcheck.functions.latex import latex_to_unicode
from recordcheck.functions.text import fold_diacritics, normalized, token_similarity, words

# Words that say nothing about which venue it is.
NOISE = (
    "proceedings", "proc", "of", "the", "in", "on", "and", "for", "annual", "international", "intl", "conference", "conf", "symposium", "symp", "workshop",
    "acm", "ieee", "usenix", "journal", "j", "transactions", "trans", "st", "nd", "rd", "th", "first", "second", "third", "fourth", "fifth", "sixth",
    "seventh", "eighth", "ninth", "tenth", "volume", "vol", "part",
)
# Acronyms that are no venue's.
OTHER_ACRONYMS = ("ACM", "IEEE", "USENIX", "SIAM", "AAAI", "LNCS", "CEUR", "SIG", "PMLR", "II", "III", "IV", "NY", "USA", "UK")
# Words whose initial an initialism leaves out.
UNSPOKEN = ("of", "the", "on", "for", "and", "in", "a", "at")
# Places of preprints.
PREPRINT_PLACES = ("arxiv", "corr", "biorxiv", "medrxiv", "ssrn", "preprint", "techrxiv", "openreview")

_ascii_form = arrow_function(lambda v: None if v is None else fold_diacritics(latex_to_unicode(v)), "string")


def core_tokens(norm: str | Column) -> Column:
    """Telling words of a venue's comparison form, repeats kept."""
    return F.filter(words(norm), lambda w: ~w.isin(*NOISE) & ~w.rlike(r"^\d+(?:st|nd|rd|th)?$"))


def venue_acronyms(venue: str | Column, plain: bool = False) -> Column:
    """Lower-cased words of mixed or upper case, without repeats; `plain` if the text has no accents or LaTeX."""
    text = (F.col(venue) if isinstance(venue, str) else venue) if plain else _ascii_form(venue)
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z][A-Za-z]*[A-Z][A-Za-z0-9]*|[A-Z]{2,})\b"), 1)
    kept = F.filter(found, lambda a: (F.char_length(a) <= 12) & ~F.upper(a).isin(*OTHER_ACRONYMS))
    return F.array_distinct(F.transform(kept, F.lower))


def venue_initialisms(norm: str | Column) -> Column:
    """First letters of all spoken words and of the telling words, where these are three to eight."""
    spoken = F.filter(words(norm), lambda w: ~w.isin(*UNSPOKEN) & ~w.rlike(r"^\d"))
    initials = lambda items: F.when(F.size(items).between(3, 8), F.array_join(F.transform(items, lambda w: F.substring(w, 1, 1)), ""))
    return F.array_distinct(F.array_compact(F.array(initials(spoken), initials(core_tokens(norm)))))


def venue_keys(venue: str | Column, short: Column | None = None) -> Column:
    """struct(core, acronyms, initialisms, arxiv, present) of a venue and its short label."""
    venue = F.col(venue) if isinstance(venue, str) else venue
    norm = normalized(venue)
    names = venue_acronyms(venue)
    if short is not None:
        label = F.nullif(F.lower(short), F.lit(""))
        names = F.array_distinct(F.concat(names, F.when(label.isNotNull(), F.array(label)).otherwise(F.array().cast("array<string>"))))
    return F.struct(
        core_tokens(norm).alias("core"),
        names.alias("acronyms"),
        venue_initialisms(norm).alias("initialisms"),
        F.coalesce(F.regexp_like(venue, F.lit(r"(?i)\b(?:arxiv|corr)\b")), F.lit(False)).alias("arxiv"),
        F.coalesce(venue != "", F.lit(False)).alias("present"),
    )


def venue_similarity(a: Column, b: Column) -> Column:
    """Of two venue_keys. Venues of noise words alone are alike; a missing one gives 0."""
    return bound(_venue_similarity, a, b)


def _venue_similarity(a: Column, b: Column) -> Column:
    dice = token_similarity(a["core"], b["core"])
    names = lambda x, y: F.arrays_overlap(x["acronyms"], F.concat(y["acronyms"], y["core"], F.transform(y["initialisms"], lambda i: F.when(F.char_length(i) >= 3, i))))
    named = F.coalesce(names(a, b), F.lit(False)) | F.coalesce(names(b, a), F.lit(False))
    within = lambda x, y: F.forall(x, lambda t: F.exists(y, lambda u: (u == t) | (F.startswith(u, t) & (F.char_length(t) >= 3))))
    a_first = F.size(a["core"]) <= F.size(b["core"])
    small, big = F.when(a_first, a["core"]).otherwise(b["core"]), F.when(a_first, b["core"]).otherwise(a["core"])
    contained = (F.size(small) > 0) & within(small, big)
    least = F.greatest(F.when(contained, 0.85).otherwise(0.0), F.when(named, 0.9).otherwise(0.0))
    alike = bound(lambda dice: F.when((dice >= 0.999) | (a["arxiv"] & b["arxiv"]), 1.0).otherwise(F.greatest(dice, least)), dice)
    return F.when(~a["present"] | ~b["present"], 0.0).otherwise(alike)


def is_preprint_venue(venue: str | Column) -> Column:
    return F.coalesce(F.regexp_like(venue, F.lit(rf"(?i)\b(?:{'|'.join(PREPRINT_PLACES)})\b")), F.lit(False))


def venue_abbreviation(venue: str | Column, short: str | Column, plain: bool = False) -> Column:
    """For citation keys: the short label, else an abbreviation in brackets, else the first acronym."""
    venue, short = (F.col(c) if isinstance(c, str) else c for c in (venue, short))
    tidy = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    bracketed = F.regexp_extract(F.coalesce(venue, F.lit("")), r"\(([A-Z][A-Za-z0-9-]{1,11})(?:\s*['’]?\s*\d{2,4})?\)", 1)
    acronym = F.get(venue_acronyms(venue, plain), F.lit(0))
    return F.when(F.coalesce(short, F.lit("")) != "", F.nullif(tidy(short), F.lit(""))).when(bracketed != "", tidy(bracketed)).otherwise(F.nullif(tidy(acronym), F.lit("")))


# Entry types that are another's alias, and where a type names its venue.
TYPE_ALIASES = {"conference": "inproceedings", "electronic": "online", "www": "online", "thesis": "phdthesis", "report": "techreport"}
VENUE_FIELDS = {
    "article": "journal", "inproceedings": "booktitle", "incollection": "booktitle", "inbook": "booktitle", "phdthesis": "school", "mastersthesis": "school",
    "techreport": "institution", "book": "publisher", "proceedings": "publisher",
}


def normalize_type(entry_type: str | Column) -> Column:
    lower = F.lower(entry_type)
    return F.coalesce(_lookup(TYPE_ALIASES, lower), lower)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def venue_field(entry_type: str | Column) -> Column:
    return F.coalesce(_lookup(VENUE_FIELDS, normalize_type(entry_type)), F.lit("howpublished"))
