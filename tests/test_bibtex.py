"""The BibTeX reader, patches and differences."""

import random
import time

import pytest

from recordcheck.operators.apply import apply_changes, diff_lines
from recordcheck.sources.bibtex import Limits, parse_bibtex, parsed_rows

MESSY = """% notes
@Article(smith99,
  Title   = "A {GPT} study",
  author  = {Jo Doe},
  custom  = foo # { x},
)
trailing"""


def change(id_, field, kind, **more):
    return {"id": id_, "field": field, "kind": kind, **more}


def test_spans():
    for item in parse_bibtex(MESSY):
        for f in item.get("fields") or ():
            assert MESSY[f["value_start"] : f["value_end"]] == f["raw"] and MESSY[f["name_start"] : f["name_end"]] == f["name"]
    assert [i["kind"] for i in parse_bibtex(MESSY)] == ["comment", "entry", "comment"]


@pytest.mark.parametrize(
    "text, message",
    [
        ("@a{k, t = {x", "Unbalanced braces"), ('@a{k, t = "x', "Unterminated"), ("@a{k k, t = {x}}", "cannot contain spaces"), ("@a{k, t {x}}", 'Expected "="'), ("@a{k, t = }", "Expected a field value"),
        ("@a{k, t = {x}", "missing its closing"), ("@a{k, t = {" + "{" * 70, "nested too deeply"), ("@{x}", "Expected entry type"), ('@a{k, t = "x}"}', "inside quoted"), ("@a{k, t = {x} u = {y}}", "after field"),
    ],
)
def test_errors(text, message):
    errors = [i for i in parse_bibtex(text) if i["kind"] == "error"]
    assert message in errors[0]["message"] and errors[0]["line"] == 1


def test_recovery_and_limits():
    got = parse_bibtex("@a{bad, t = {x\n@b{ok, t = {y}}")
    assert [i["kind"] for i in got] == ["error", "entry"] and got[1]["key"] == "ok"
    assert parse_bibtex("x" * 11, Limits(file_chars=10))[0]["kind"] == "error"
    many = "@a{k, " + ", ".join(f"f{n} = 1" for n in range(201)) + "}"
    assert "Too many fields" in parse_bibtex(many)[0]["message"]
    assert sum(i["kind"] == "entry" for i in parse_bibtex("@a{k}" * 9, Limits(entries=3))) == 4


def test_macros():
    rows = parsed_rows('@string{a = "x"} @string{b = a # "y"} @a{k, t = b # jan # nope} @string{c = c}')
    field = next(i for i in rows if i["kind"] == "entry")["fields"][0]
    assert (field["text"], field["unresolved"]) == ("xyJanuarynope", ["nope"])


def test_patches():
    assert apply_changes(MESSY, []) == (MESSY, [], [])
    text, applied, skipped = apply_changes(MESSY, [change("w", "title", "wrap", term="study"), change("y", "year", "set", value="1999"), change("c", "custom", "wrap", term="x"), change("r", "author", "rename", to="title")])
    assert applied == ["y", "w"] and [s[0] for s in skipped] == ["r", "c"]
    assert text == MESSY.replace('"A {GPT} study"', '"A {GPT} {study}"').replace("foo # { x},", "foo # { x},\n  year    = {1999},")
    assert apply_changes("@a{k, t={x}, u={y}}", [change("r", "u", "remove")])[0] == "@a{k, t={x}}"
    assert apply_changes("@a{k,\n  t = {x},\n  u = {y}\n}", [change("r", "t", "remove")])[0] == "@a{k,\n  u = {y}\n}"
    assert apply_changes("@a{k}", [change("d", "doi", "set", value="v")])[0] == "@a{k,\n  doi = {v}}"
    assert apply_changes("no entry", [change("d", "doi", "set", value="v")])[2] == [("d", "The text is no entry")]


def test_layout():
    tidy = apply_changes(MESSY, [change("l", "ENTRY", "layout"), change("k", "KEY", "set", value="new")])[0]
    assert tidy == "@article{new,\n  author = {Jo Doe},\n  title  = {A {GPT} study},\n  custom = foo # { x}\n}"
    assert apply_changes(tidy, [change("l", "ENTRY", "layout")])[0] == tidy


def test_diff():
    kinds = lambda a, b: "".join(d["kind"][0] for d in diff_lines(a, b))
    assert kinds("a\nb\nc", "a\nx\nc\nd") == "sdasa" and kinds("a", "a") == "s" and kinds("a\nb", "b\na") == "dsa"
    assert kinds("\n" * 2100, "\n" * 2100 + "x").startswith("d")


def test_fuzz():
    r = random.Random(20260922)
    alphabet = ["@", "{", "}", "(", ")", '"', ",", "=", "#", "article", "key", "title", "\n", " ", "%", "\\", "1999", "jan", "@string", "@comment", "é", "~", "$", "--"]
    for _ in range(400):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(1, 80)))
        assert isinstance(parsed_rows(text), list)
        assert apply_changes(text, [])[0] == text


def test_hostile_texts_are_read_in_linear_time():
    began = time.time()
    for text in ("@" * 300_000, "{" * 300_000, '@a{k, t = "' + "x" * 50_000, "@a{k, t = " + "{" * 50_000):
        parse_bibtex(text)
    assert time.time() - began < 4
