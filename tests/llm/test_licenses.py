import re
import time

import pytest
from helpers import clashing, documents, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm import licenses as L

SCANNER = L.Scanner()


def brute(text):
    low = text.translate({k: k + 32 for k in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in L.BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


PARTS = st.sampled_from(["MIT", "mit", "License", "license", " ", "  ", "-", ".\n", "Apache", "General", "Public", "GNU", "é", "x", "7", "K", "licenses", "İ", "_"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=25).map("".join))
def test_base_equals_brute_force(text):
    assert L.scan(text, SCANNER)[:5] == brute(text)


def test_there_are_hundreds_of_rules_and_each_has_its_keyword():
    assert len(SCANNER.rules) >= 300
    words = {w for _, w in SCANNER.gate.items()}
    assert all(r.keywords and words.issuperset(r.keywords) for r in SCANNER.rules)
    assert len({r.pattern.pattern for r in SCANNER.rules}) == len(SCANNER.rules)
    assert [r.priority for r in SCANNER.rules] == sorted((r.priority for r in SCANNER.rules), reverse=True)


@pytest.mark.parametrize("rule", SCANNER.rules, ids=lambda r: f"{r.priority} {r.label}: {r.example[:30]}")
def test_each_rule_finds_its_example(rule):
    """Also in a commented block with other line ends, and not with a letter before and after it."""
    low = rule.example.lower()
    assert all(k in low for k in rule.keywords)
    m = rule.pattern.search(low)
    assert m
    if r":\s*+" not in rule.pattern.pattern and r"[:=]" not in rule.pattern.pattern and "://" not in low:  # tags, fields and addresses stand on one line
        assert rule.pattern.search("/*\n * " + low.replace("\n", " ").replace(" ", "\n *  ") + " */")
    whole = L.scan(f"x {rule.example} y", SCANNER)
    a, b = m.start() + 2, m.end() + 2
    assert any(d["start"] <= a and b <= d["stop"] and d["priority"] >= rule.priority for d in whole[7])
    glued = "q" + low[m.start():m.end()] + "q"
    assert not any(x.start() == 1 and x.end() == len(glued) - 1 for x in rule.pattern.finditer(glued))


NOT_LICENSES = (
    "His python license plate was stolen.", "A fishing license: fair play for all.", "They took artistic license with the facts.",
    "The apache helicopter needs no license.", "Boost your license sales.", "An mit student got a driving licence.",
    "The ruby license of the jeweller", "Vim and vigour, licensed to drive", "php and a license to sell it", "isc 2024 in Hamburg, license required",
    "Public domain: a debate", "Creative commons of the village", "open data is a license to print money", "The fair license fee", "a zlib stream",
    "The python software, a foundation of ours", "gnu and lesser antelopes", "mozilla and the public", "the general public was licensed",
    "We licensed the song", "eclipse of the sun in public", "bsd conference", "The licensee under the roof", "license: to kill", "see the licence holder for terms")


@pytest.mark.parametrize("text", NOT_LICENSES)
def test_everyday_words_are_no_license(text):
    assert labels(text) == ""


LONG = {"blanks": " " * 10**6, "line ends": "\n" * 10**6, "commas": "," * 10**6, "letters": "a" * 10**6, "digits": "1" * 10**6,
        "name": "mit " * 50_000, "title and blanks": "the mit license" + " " * 10**6 + "x", "title and line ends": "gnu general public license" + "\n" * 10**6,
        "notices": "licensed under the " * 10_000, "fields": "license: " * 20_000, "years": "copyright 2020 " * 13_000,
        "law": "to the extent possible under law " * 6_000, "names": "neither the name of " * 10_000}


@pytest.mark.parametrize("name", LONG)
def test_every_rule_ends_on_long_texts(name):
    """Each rule reads some hundred thousand characters, a megabyte of one kind, within three seconds."""
    for rule in SCANNER.rules:
        t0 = time.process_time()
        for _ in rule.pattern.finditer(LONG[name]):
            pass
        assert time.process_time() - t0 < 3, rule.example


def labels(text):
    return L.scan(text, SCANNER)[5]


def test_signatures():
    assert labels("SPDX-License-Identifier: MPL-2.0") == "mpl"
    assert labels("Licensed under the GNU Lesser General Public License, version 2.1") == "gpl,lgpl"  # the base phrase adds gpl
    assert labels("see https://www.boost.org/LICENSE_1_0.txt") == "boost"
    assert labels("Creative Commons Attribution-ShareAlike License 4.0") == "cc-by-sa"
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy") == "mit"
    assert labels("a limit licensee of apaches") == ""


def test_contained_detections_are_suppressed():
    found = L.scan("released under the Mozilla Public License, version 2.0 today", SCANNER)[7]
    assert [(d["label"], d["priority"]) for d in found] == [("mpl", 4)]
    assert found[0]["start"] == 0


def test_rows(spark):
    rows = odd_texts() + [(40, "Released under the MIT License. " * 3)]
    got = L.find_licenses(clashing(documents(spark, rows))).collect()
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted(
        [(i, *brute(t or "")) for i, t in rows], key=key)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert L.find_licenses(documents(spark, rows).limit(0)).count() == 0
