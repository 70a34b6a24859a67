"""The value functions as functions of SQL: `SELECT title_similarity(normalize_text(a), normalize_text(b)) ...`.

Bodies are SQL that Spark puts into the caller's plan; only normalize_text, percent_decode and venue_words, which take Python, are Arrow functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from recordcheck.functions.identifiers import DOI_LEAD, RANGE, decode_percent
from recordcheck.functions.latex import latex_to_unicode
from recordcheck.functions.text import EDIT_CHARS, FORGIVEN_CHARS, fold_diacritics, normalize_text
from recordcheck.functions.venue import NOISE, OTHER_ACRONYMS, UNSPOKEN

_TEXTS = "ARRAY<STRING>"
_VENUE = "STRUCT<core: ARRAY<STRING>, acronyms: ARRAY<STRING>, initialisms: ARRAY<STRING>, arxiv: BOOLEAN, present: BOOLEAN>"


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in sorted(values))


#: name -> (parameters, result, body); a function may call those before it.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "edit_similarity": (
        "a STRING, b STRING", "DOUBLE",
        f"""CASE WHEN coalesce(a, '') = coalesce(b, '') THEN 1.0D WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 0.0D
        ELSE 1.0D - levenshtein(substring(a, 1, {EDIT_CHARS}), substring(b, 1, {EDIT_CHARS})) / greatest(char_length(a), char_length(b)) END""",
    ),
    "token_similarity": (
        f"a {_TEXTS}, b {_TEXTS}", "DOUBLE",
        """CASE WHEN size(a) + size(b) = 0 THEN 1.0D WHEN size(a) = 0 OR size(b) = 0 THEN 0.0D
        ELSE 2.0D * aggregate(array_distinct(a), 0, (n, w) -> n + least(size(filter(a, x -> x = w)), size(filter(b, x -> x = w)))) / (size(a) + size(b)) END""",
    ),
    "title_similarity": (
        "a STRING, b STRING", "DOUBLE",
        f"""CASE WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 0.0D WHEN a = b THEN 1.0D
        ELSE greatest(least(1.0D, 0.6D * token_similarity(filter(split(a, ' '), w -> w <> ''), filter(split(b, ' '), w -> w <> '')) + 0.4D * edit_similarity(a, b)),
          CASE WHEN least(char_length(a), char_length(b)) >= {FORGIVEN_CHARS} AND (startswith(a, b) OR startswith(b, a)) THEN 0.9D ELSE 0.0D END) END""",
    ),
    "parse_doi": (
        "raw STRING", "STRING",
        rf"""regexp_substr(regexp_replace(percent_decode(regexp_replace(regexp_replace(regexp_replace(trim(raw), r'\\([_%&#])', '$1'), '[{{}}]', ''), r'{DOI_LEAD}', '')), '[.,;]+$', ''),
        r'^(?=[\s\S]{{1,300}}$)10\.\d{{4,9}}/\S+$')""",
    ),
    "same_doi": ("a STRING, b STRING", "BOOLEAN", "coalesce(lower(parse_doi(a)) = lower(parse_doi(b)), false)"),
    "parse_arxiv_id": (
        "raw STRING", "STRING",
        r"""regexp_substr(regexp_replace(regexp_replace(trim(raw), r'(?i)^(?:arxiv:\s*)?(?:(?:https?://)?(?:www\.|export\.)?arxiv\.org/(?:abs|pdf)/)?', ''), r'(?i)\.pdf$', ''),
        r'^(?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?$')""",
    ),
    "normalize_pages": ("raw STRING", "STRING", rf"regexp_replace(regexp_replace(nullif(trim(raw), ''), r'\s+', ' '), r'{RANGE}', '$1--$2')"),
    "pages_key": ("raw STRING", "STRING", "regexp_replace(lower(coalesce(normalize_pages(raw), '')), '-+', '-')"),
    "pages_written_out": (
        "key STRING", "STRING",
        r"""CASE WHEN key rlike r'^\d+-\d+$' AND char_length(split_part(key, '-', 1)) > char_length(split_part(key, '-', 2))
        THEN concat(split_part(key, '-', 1), '-', left(split_part(key, '-', 1), char_length(split_part(key, '-', 1)) - char_length(split_part(key, '-', 2))), split_part(key, '-', 2)) ELSE key END""",
    ),
    "pages_equivalent": ("a STRING, b STRING", "BOOLEAN", "pages_key(a) <> '' AND pages_key(b) <> '' AND (pages_key(a) = pages_key(b) OR pages_written_out(pages_key(a)) = pages_written_out(pages_key(b)))"),
    "year_from": (
        "value STRING", "INT",
        r"CASE WHEN left(value, 4) rlike r'^\s*\d+\s*$' AND try_cast(trim(left(value, 4)) AS INT) BETWEEN 1501 AND 2199 THEN try_cast(trim(left(value, 4)) AS INT) END",
    ),
    "venue_initials": (f"items {_TEXTS}", "STRING", "CASE WHEN size(items) BETWEEN 3 AND 8 THEN array_join(transform(items, w -> left(w, 1)), '') END"),
    "venue_core": (f"norm {_TEXTS}", _TEXTS, rf"filter(norm, w -> w <> '' AND w NOT IN ({_list(NOISE)}) AND NOT w rlike r'^\d+(?:st|nd|rd|th)?$')"),
    "venue_keys": (
        "venue STRING", _VENUE,
        rf"""named_struct('core', venue_core(split(normalize_text(venue), ' ')),
        'acronyms', array_distinct(transform(filter(regexp_extract_all(coalesce(venue_words(venue), ''), r'\b([A-Z][A-Za-z]*[A-Z][A-Za-z0-9]*|[A-Z]{{2,}})\b', 1), x -> char_length(x) <= 12 AND upper(x) NOT IN ({_list(OTHER_ACRONYMS)})), x -> lower(x))),
        'initialisms', array_distinct(array_compact(array(venue_initials(filter(split(normalize_text(venue), ' '), w -> w <> '' AND w NOT IN ({_list(UNSPOKEN)}) AND NOT w rlike r'^\d')), venue_initials(venue_core(split(normalize_text(venue), ' ')))))),
        'arxiv', coalesce(venue rlike r'(?i)\b(?:arxiv|corr)\b', false), 'present', coalesce(venue <> '', false))""",
    ),
    "venue_named": (
        f"a {_VENUE}, b {_VENUE}", "BOOLEAN",
        "coalesce(arrays_overlap(a.acronyms, concat(b.acronyms, b.core, transform(b.initialisms, i -> CASE WHEN char_length(i) >= 3 THEN i END))), false)",
    ),
    "venue_within": (f"small {_TEXTS}, big {_TEXTS}", "BOOLEAN", "size(small) > 0 AND forall(small, t -> exists(big, u -> u = t OR (startswith(u, t) AND char_length(t) >= 3)))"),
    "venue_likeness": (
        f"a {_VENUE}, b {_VENUE}", "DOUBLE",
        """CASE WHEN NOT a.present OR NOT b.present THEN 0.0D WHEN token_similarity(a.core, b.core) >= 0.999D OR (a.arxiv AND b.arxiv) THEN 1.0D
        ELSE greatest(token_similarity(a.core, b.core), CASE WHEN venue_named(a, b) OR venue_named(b, a) THEN 0.9D ELSE 0.0D END,
          CASE WHEN CASE WHEN size(a.core) <= size(b.core) THEN venue_within(a.core, b.core) ELSE venue_within(b.core, a.core) END THEN 0.85D ELSE 0.0D END) END""",
    ),
    "venue_similarity": ("a STRING, b STRING", "DOUBLE", "venue_likeness(venue_keys(a), venue_keys(b))"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session, for as long as it lasts; returns their names."""

    @F.pandas_udf("string")
    def normalized(texts: pd.Series) -> pd.Series:
        return texts.map(normalize_text)

    @F.pandas_udf("string")
    def unaccented(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fold_diacritics(latex_to_unicode(t)))

    @F.pandas_udf("string")
    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map(decode_percent)

    spark.udf.register("normalize_text", normalized)
    spark.udf.register("percent_decode", decoded)
    spark.udf.register("venue_words", unaccented)
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return ["normalize_text", "percent_decode", "venue_words", *FUNCTIONS]
