"""Requests asked again: waits, rounds by source, and what counts as an answer."""

import itertools
import random

import pytest

from recordcheck.sources.retries import ask_again, asked_seconds, recorded

REQUESTS = "request_id long, source string, operation string"
ANSWERS = "request_id long, round int, try int, http int, body string, retry_after string, offline boolean"
KEY = ["request_id", "status", "detail", "asked", "waited_ms"]


def settled(spark, requests, answers):
    rows = ask_again(spark.createDataFrame(requests, REQUESTS), recorded(spark.createDataFrame(answers, ANSWERS)))
    return {r["request_id"]: tuple(r[c] for c in KEY[1:]) for r in rows.collect()}


@pytest.mark.parametrize("header, seconds", [(None, 0.0), ("", 0.0), ("  ", 0.0), ("3", 3.0), (" 1.5 ", 1.5), ("Wed, 21 Oct 2026 07:28:00 GMT", None), ("NaN", None), ("Infinity", None), ("-4", -4.0)])
def test_asked_seconds(spark, header, seconds):
    assert spark.createDataFrame([(header,)], "h string").select(asked_seconds("h")).first()[0] == seconds


def test_rules_of_sources(spark):
    ok, page = '{"a": 1}', "<!DOCTYPE html><p>busy"
    requests = [(1, "Crossref", "search"), (2, "Crossref", "lookup"), (3, "DBLP", "search"), (4, "OpenAlex", "search"), (5, "Crossref", "search"), (6, "arXiv", "search"), (7, "DBLP", "search"), (8, "OpenAlex", "search"), (9, None, None)]
    answers = [
        (1, 1, 1, 400, None, None, None), (1, 2, 1, 200, ok, None, None),
        (2, 1, 1, 400, None, None, None), (2, 2, 1, 200, ok, None, None),
        (3, 1, 1, 200, page, None, None), (3, 2, 1, 200, ok, None, None),
        (4, 1, 1, 200, page, None, None), (4, 2, 1, 200, ok, None, None),
        (5, 1, 1, 429, None, "9", None), (5, 1, 2, 400, None, None, None), (5, 2, 1, 429, None, "soon", None), (5, 2, 2, 429, None, None, None), (5, 3, 1, 200, ok, None, None),
        (6, 1, 1, 200, "<feed/>", None, None),
        (7, 1, 1, 503, None, None, None), (7, 2, 1, 200, ok, None, None),
        (8, 1, 1, None, None, None, True),
    ]
    assert settled(spark, requests, answers) == {
        1: ("OK", None, 2, 0), 2: ("LOOKUP FAILED", "HTTP 400", 1, 0), 3: ("OK", None, 2, 800),
        4: ("LOOKUP FAILED", "Expected JSON but received an HTML page (HTTP 200)", 1, 0), 5: ("RATE LIMITED", "HTTP 429", 4, 7000), 6: ("OK", None, 1, 0),
        7: ("LOOKUP FAILED", "HTTP 503", 1, 0), 8: ("NETWORK UNAVAILABLE", "Offline", 1, 0), 9: ("LOOKUP FAILED", "No answer", 1, 0),
    }


def plain(source, operation, table):
    """(status, tries, waits) by following the rules step by step."""
    asked, waited = 0, 0

    def once(round_):
        nonlocal asked, waited
        for try_ in (1, 2):
            asked += 1
            http, body, after = table.get((round_, try_), (None, None, None))
            if http != 429 or try_ == 2:
                return http, body
            waited += min(5000, max(1000, int(float(after or 0) * 1000)))

    http, body = once(1)
    if operation == "search" and source == "Crossref" and http == 400:
        http, body = once(2)
    elif operation == "search" and source == "DBLP" and http == 200 and body != "{}":
        waited += 800
        http, body = once(2)
    status = {None: "LOOKUP FAILED", 429: "RATE LIMITED", 404: "NO RECORD FOUND"}.get(http, "LOOKUP FAILED" if http != 200 or body != "{}" else "OK")
    return status, asked, waited


def test_all_sequences_against_steps(spark):
    r = random.Random(5)
    kinds = [(200, "{}", None), (200, "<html>", None), (400, None, None), (404, None, None), (429, None, "3"), (429, None, None), (503, None, None), (None, None, None)]
    requests, answers, want = [], [], {}
    for k, (source, operation) in enumerate(itertools.product(["Crossref", "DBLP", "OpenAlex"], ["search", "lookup"])):
        for n in range(150):
            id_ = k * 1000 + n
            table = {(a, b): r.choice(kinds) for a in (1, 2) for b in (1, 2) if r.random() < 0.95}
            requests.append((id_, source, operation))
            answers += [(id_, a, b, *v, None) for (a, b), v in table.items()]
            want[id_] = plain(source, operation, table)
    got = settled(spark, requests, answers)
    assert {k: (v[0], v[2], v[3]) for k, v in got.items()} == want


def test_empty(spark):
    assert settled(spark, [], []) == {}
