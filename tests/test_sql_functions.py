"""Functions of SQL against the Column functions."""

import random

from pyspark.sql import functions as F

from recordcheck.functions import identifiers as ids
from recordcheck.functions.sql import register_functions
from recordcheck.functions.text import edit_similarity, normalized, title_similarity, token_similarity, words
from recordcheck.functions.venue import venue_keys, venue_similarity

TITLES = ["a study of graphs", "a study of graphs and their many uses", "a study of graphs and", "graphs a study of of of", "", None, "b", "x" * 2100, "x" * 2050 + "y" * 60]
DOIS = ["10.5555/Ab.1", "doi: https://dx.doi.org/10.5555/ab.1.", "https://www.doi.org/10.5555/a%2Fb", "10.5555/{a}\\_b;", "none", "", None, "10.12/x", "http://doi.org/https://doi.org/10.1234/z", "10.5555/a b"]
ARXIV = ["arXiv:2401.00001v2", "https://arxiv.org/pdf/2401.00001.pdf", "hep-th/9901001", "math.AG/0101001v1", "x", "", None, "export.arxiv.org/abs/2401.12345"]
PAGES = ["12-34", " 12 – 34 ", "1234--56", "1234-1256", "A1-A9", "e12", "", None, "7", "12---34", "1 2"]
YEARS = ["1998", "2001-05", " 199", "1500", "1501", "2199", "2200", "abcd", "", None, "19", "0xff"]
VENUES = ["Proceedings of the 5th International Conference on Very Large Data Bases (VLDB)", "VLDB", "Very Large Data Bases", "Conf. on Data", "CoRR abs/1", "arXiv preprint", "The Journal", "Émile Systems and Café Nets", "ACM", "", None, "NeurIPS 2020", "Data Bases Very Large Systems"]


def test_functions_agree(spark):
    assert len(register_functions(spark)) == len(set(register_functions(spark)))
    frame = lambda values: spark.createDataFrame([(v, w) for v in values for w in values], "a string, b string")
    a, b = F.col("a"), F.col("b")
    lists = lambda c: F.coalesce(words(c), F.array().cast("array<string>"))
    cases = [
        (TITLES, "edit_similarity(a, b)", edit_similarity(a, b)),
        (TITLES, "token_similarity(filter(split(coalesce(a, ''), ' '), w -> w <> ''), filter(split(coalesce(b, ''), ' '), w -> w <> ''))", token_similarity(lists(a), lists(b))),
        (TITLES, "title_similarity(a, b)", title_similarity(a, b)),
        (VENUES, "normalize_text(a)", normalized(a)),
        (DOIS, "parse_doi(a)", ids.parse_doi(a)),
        (DOIS, "same_doi(a, b)", ids.same_doi(a, b)),
        (ARXIV, "parse_arxiv_id(a)", ids.parse_arxiv_id(a)),
        (PAGES, "normalize_pages(a)", ids.normalize_pages(a)),
        (PAGES, "pages_equivalent(a, b)", ids.pages_equivalent(a, b)),
        (YEARS, "year_from(a)", ids.year_from(a)),
        (VENUES, "venue_similarity(a, b)", venue_similarity(venue_keys(a), venue_keys(b))),
    ]
    for values, sql, column in cases:
        rows = frame(values).select("a", "b", F.expr(sql).alias("x"), column.alias("y")).collect()
        wrong = [r for r in rows if (r["x"] is None) != (r["y"] is None) or (r["x"] != r["y"] and not (isinstance(r["x"], float) and abs(r["x"] - r["y"]) < 1e-12))]
        assert not wrong, (sql, wrong[:3])
    r = random.Random(3)
    texts = [" ".join(r.choice("alpha beta gamma delta alphabet".split()) for _ in range(r.randint(0, 6))) for _ in range(40)]
    rows = frame(texts).select(F.expr("title_similarity(a, b)").alias("x"), title_similarity(a, b).alias("y"))
    assert rows.filter("abs(x - y) > 1e-12").count() == 0
    plan = rows.select("x")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
