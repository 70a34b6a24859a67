"""Value functions against tables of expected values, and Column forms against plain ones."""

import random

import pytest
from plain_authors import compare_lists, edit_ratio, pair_similarity
from pyspark.sql import functions as F

from recordcheck.config import WEIGHTS, KeyScheme, Settings, sanitize_settings
from recordcheck.functions.authors import Author, compare_authors, format_name, parse_list, parse_name, split_display_name
from recordcheck.functions.identifiers import doi_url, find_doi, normalize_pages, pages_equivalent, parse_arxiv_id, parse_doi, same_doi, year_from
from recordcheck.functions.latex import decode_references, latex_to_unicode, unicode_to_latex
from recordcheck.functions.text import correction_marker, edit_similarity, normalize_text, title_similarity, token_similarity
from recordcheck.functions.titles import free_key, protection_terms, wrap_term
from recordcheck.functions.urls import unsafe_reason
from recordcheck.functions.venue import venue_keys, venue_similarity


def values(spark, expression, *columns):
    """The expression over rows of string columns a, b, ..."""
    names = "abcdef"[: len(columns)]
    df = spark.createDataFrame(list(zip(*columns)), ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.select(expression(*[F.col(n) for n in names])).collect()]


@pytest.mark.parametrize(
    "text, plain",
    [(r"G{\"o}del", "Gödel"), (r"Fr\'echet", "Fréchet"), (r"\'{\i}", "í"), (r"\c{c}a", "ça"), (r"\o{} \ss x", "ø ßx"), ("a---b--c", "a—b–c"), ("``q''", "“q”"), (r"\emph{x} y~z $m$", "x y z m"), (r"50\% \& \_", "50% & _"), (r"a\'", "a"), ("{", ""), ("\\", "")],
)
def test_latex_decodes(text, plain):
    assert latex_to_unicode(text) == plain


def test_latex_encodes():
    assert unicode_to_latex("Gödel çş Í") == r"G{\"o}del {\c{c}}{\c{s}} {\'I}"
    assert unicode_to_latex("í", True) == r"{\'\i}"
    assert unicode_to_latex("é & {x}_", False) == r"é \& x\_"
    assert latex_to_unicode(unicode_to_latex("Ťéñ — łø…")) == "Ťéñ — łø…"
    assert decode_references("a&#233;b&#9999999;") == "aéb&#9999999;"


def test_latex_never_fails():
    r = random.Random(20260922)
    for _ in range(300):
        text = "".join(r.choice(["\\", "{", "}", "$", "'", '"', "~", "-", "a", "é", " ", "\\i", "`"]) for _ in range(r.randint(0, 30)))
        assert isinstance(normalize_text(text), str)


def test_normal_form():
    assert normalize_text("  {\\'E}tude—of  X-Rays: “a” ") == "etude of x rays a"
    assert normalize_text(None) == "" == normalize_text("{}$")


def test_similarities(spark):
    a = ["deep learning for citation graphs", "x", "", "a b b", "same"]
    b = ["deep learning for citation graphs a survey", "y", "x", "b b c", "same"]
    t = values(spark, title_similarity, a, b)
    assert t[0] == 0.9 and t[1] == 0 and t[2] == 0 and t[4] == 1
    assert values(spark, lambda x, y: token_similarity(F.split(x, " "), F.split(y, " ")), a, b)[3] == pytest.approx(4 / 6)
    r = random.Random(3)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(0, 8))) for _ in range(60)]
    got = values(spark, edit_similarity, words, words[::-1])
    assert got == pytest.approx([edit_ratio(x, y) for x, y in zip(words, words[::-1])])


def test_notices(spark):
    titles = ["Erratum: x", "Comment on y", "Comment one", "Commenting on y", "{Retraction} of z", "On errata", None]
    assert values(spark, correction_marker, titles) == ["erratum", "comment", "comment", None, "retraction", None, None]


@pytest.mark.parametrize(
    "raw, name",
    [
        ("Smith, Jo", ("Smith", "Jo", None)), ("Smith, Jr, Jo", ("Smith", "Jo", None)), ("Jo van der Berg", ("van der Berg", "Jo", None)), ("{Data Group}", ("Data Group", "", "Data Group")),
        ("Knuth", ("Knuth", "", None)), ("Jo {Van X} Berg", ("Berg", "Jo {Van X}", None)), ("Jo {van X} Berg", ("{van X} Berg", "Jo", None)), ("Jo~Berg", ("Berg", "Jo", None)),
    ],
)
def test_names(raw, name):
    assert tuple(parse_name(raw)) == name


def test_author_lists():
    names, cut = parse_list("A B and {C and D} AND others")
    assert len(names) == 2 and cut and parse_list(None) == ([], False) and parse_list("X et al.")[1] is False
    assert pair_similarity(Author("Smith", "Jo"), Author("Smith", "J.")) == 1
    assert pair_similarity(Author("Wei", "Li"), Author("Li", "Wei")) == 0.85
    assert pair_similarity(Author("Smith", "John"), Author("Smith", "Jane")) == 0.3
    assert pair_similarity(Author("Smith", "A"), Author("Smith", "B")) == 0.25
    assert pair_similarity(Author("Smith"), Author("Smith", "B")) == 0.9
    c = compare_lists([Author("A", "X"), Author("B", "Y")], [Author("B", "Y"), Author("A", "X")])
    assert c.overlap == 1 and c.score == 0.9 and not c.first_match
    assert compare_lists([Author("A", "X")], [Author("A", "X"), Author("B", "Y")], True).score == 1
    assert format_name(Author("van Berg", "Jo"), "first-last") == "Jo van Berg" and format_name(Author("Du Pont", "Jo"), "first-last") == "Jo {Du Pont}"
    assert split_display_name("Jo de la Cruz 0003") == Author("de la Cruz", "Jo")


def test_identifiers(spark):
    raw = ["10.1000/a\\_b", "https://dx.doi.org/10.1000/X.", "doi:10.1000%2Fa+b", "10.1/x", None, "10.1000/" + "x" * 300]
    assert values(spark, parse_doi, raw) == ["10.1000/a_b", "10.1000/X", "10.1000/a+b", None, None, None]
    assert values(spark, same_doi, raw[:2] + [None], ["10.1000/A_B", "10.1000/y", None]) == [True, False, False]
    assert values(spark, find_doi, ["see 10.1000/q, or", "none"]) == ["10.1000/q", None]
    assert values(spark, doi_url, ["10.1/a b/c<d", None]) == ["https://doi.org/10.1/a%20b/c%3Cd", None]
    assert values(spark, parse_arxiv_id, ["arXiv:2401.12345v2", "https://arxiv.org/pdf/cs/0112017.pdf", "math.AG/0112017", "24.1"]) == ["2401.12345v2", "cs/0112017", "math.AG/0112017", None]
    assert values(spark, normalize_pages, ["1 – 2", "S1---S9", "12", " ", None]) == ["1--2", "S1--S9", "12", None, None]
    assert values(spark, pages_equivalent, ["1234-56", "1-2", None], ["1234--1256", "1-3", None]) == [True, False, False]
    assert values(spark, year_from, ["2020-01", "1499", "20", None, "abcd"]) == [2020, None, None, None, None]


def test_venues(spark):
    a = ["CHI", "Nature", "", "arXiv", "Journal"]
    b = ["Proc. of the CHI Conference on Human Factors", "Science", "x", "CoRR", "Proceedings"]
    df = spark.createDataFrame(list(zip(a, b)), "a string, b string").withColumns({"x": venue_keys("a"), "y": venue_keys("b")})
    assert [r[0] for r in df.select(venue_similarity(F.col("x"), F.col("y"))).collect()] == [0.9, 0, 0, 1, 1]


def test_titles():
    assert [t["term"] for t in protection_terms("An AI for IoT in Python {HCI} $X$ GPT-4")] == ["AI", "IoT", "Python", "GPT"]
    assert protection_terms("ALL CAPS TITLE HERE NOW") == [] and protection_terms("Python rules") == [] and protection_terms(None) == []
    once = wrap_term("AI and {AI} of AIs, AI", "AI")
    assert once == "{AI} and {AI} of AIs, {AI}" == wrap_term(once, "AI")
    assert free_key("k", ["k", "k_a"]) == "k_b" and free_key("k", ["k", *(f"k_{c}" for c in "abcdefghijklmnopqrstuvwxyz")]) is None


@pytest.mark.parametrize(
    "url, safe",
    [
        ("https://example.org/x", True), ("http://example.org:8080", True), ("http://8.8.8.8/", True), ("http://127.0.0.1", False), ("http://2130706433", False), ("http://0x7f000001", False), ("http://0177.0.0.1", False),
        ("http://localhost.", False), ("http://x.local", False), ("http://intranet", False), ("http://[::1]", False), ("http://[fe80::1]", False), ("http://[::ffff:10.0.0.1]", False), ("http://u@x.org", False),
        ("file:///etc/passwd", False), ("javascript:alert(1)", False), ("x.org", False), ("https://x.org:22", False), (None, False), ("http://192.168.1.1", False), ("http://100.64.0.1", False), ("", False),
    ],
)
def test_urls(url, safe):
    assert (unsafe_reason(url) is None) == safe


def test_settings():
    assert abs(sum(WEIGHTS.values()) - 1) < 1e-12
    assert sanitize_settings(None) == Settings() == sanitize_settings({"mode": "x", "key_scheme": {"parts": ["bad"]}, "found_ttl_days": "3"})
    got = sanitize_settings({"mode": "verify", "key_scheme": {"parts": ["year", "author", "year"], "separator": ":"}, "found_ttl_days": 900, "contact_email": " a@b.org "})
    assert got.mode == "verify" and got.key_scheme == KeyScheme(("year", "author"), ":", True) and got.found_ttl_days == 365 and got.contact_email == "a@b.org"


def test_author_lists_in_the_engine(spark):
    """Column expressions give what comparing one pair at a time gives."""
    r = random.Random(12)
    family = ["Doe", "Roe", "van Dam", "Dam", "M{\\\"u}ller", "Muller", "Mueller", "Jo", "Lee", "", "de la Cruz", "Cruz", "Schmidt", "Schmitt", "Goldschmidt"]
    given = ["Jo", "J.", "J. B.", "Joanna Beth", "John Bob", "", "Doe", "Al", "A.-B.", "Zed", "Lee"]
    literal = [None, None, None, None, None, "", "The {Group}", "The Group", "Jo Doe"]
    some = lambda: [Author(r.choice(family), r.choice(given), r.choice(literal)) for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4, 6]))]
    pairs = []
    for _ in range(1500):
        a = some()
        b = r.choice([some(), a, a[::-1], a[:1] + some(), a[:-1]])
        pairs.append((a, b, r.random() < 0.3))
    row = lambda names: [(n.family, n.given, n.literal) for n in names]
    df = spark.createDataFrame([(k, row(a), row(b), t) for k, (a, b, t) in enumerate(pairs)], "k int, a array<struct<family:string,given:string,literal:string>>, b array<struct<family:string,given:string,literal:string>>, t boolean")
    got = {x["k"]: tuple(x["c"]) for x in df.select("k", compare_authors(F.col("a"), F.col("b"), F.col("t")).alias("c")).collect()}
    for k, (a, b, t) in enumerate(pairs):
        assert got[k] == tuple(compare_lists(a, b, t)), (a, b, t)
    none = df.limit(1).select(compare_authors(F.lit(None).cast(df.schema["a"].dataType), F.col("b"), F.lit(None).cast("boolean")).alias("c")).first()["c"]
    assert none["score"] == 0 and none["count_a"] == 0


def test_settings_are_saved_and_loaded(spark):
    import tempfile

    from recordcheck.sources.settings import load_settings, save_settings, sanitized

    log = tempfile.mkdtemp(prefix="settings-") + "/log"
    save_settings(spark, log, "u", Settings(mode="verify", found_ttl_days=999))
    save_settings(spark, log, "u", Settings(contact_email=" x@y.org ", found_ttl_days=5, key_scheme=KeyScheme(("year", "author"), "-", False)))
    assert load_settings(spark, log, "u") == Settings(contact_email="x@y.org", found_ttl_days=5, key_scheme=KeyScheme(("year", "author"), "-", False))
    assert load_settings(spark, log, "nobody") == Settings()
    rows = spark.createDataFrame([(None,), ("{",), ("[1]",), ('{"found_ttl_days": 1e999, "mode": 7}',)], "raw string").select(sanitized("raw").alias("s")).collect()
    assert all(r["s"]["mode"] == "clean" and r["s"]["found_ttl_days"] == 30 and r["s"]["key_scheme"]["parts"] == ["author", "year", "keyword", "venue"] for r in rows)
