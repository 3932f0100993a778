import re
from collections import Counter

import pytest
from helpers import clashing, documents, odd_texts, prose

from corpusflow.llm import quality_rules as Q


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    covered = {p for k in range(len(w) - 4) if c[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered))


def junk(k):
    return [("zap " * 200), ("BUY NOW!! " * 60).upper(), " ".join(x + "$$$" for x in prose(k, 80).split())][k % 3]


def test_counts_equal_brute_force(spark):
    rows = odd_texts() + [(20, "a\nb\na\n\n \nb\na"), (21, "x y z x y z x y z x y z"), (22, "\x0b\x0c#*$%&|<>"), (23, "p q r s t u p q r s t v")]
    got = Q.judge(clashing(documents(spark, rows))).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    have = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=key)
    assert have == sorted([(i, *base(t)) for i, t in rows], key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def em(patterns, names):
    """The same model, one pattern at a time, in plain Python."""
    share, good, bad = 0.7, [0.02] * len(names), [0.3] * len(names)

    def post(p):
        a, b = share, 1 - share
        for v, g, x in zip(p, good, bad):
            if v:
                a, b = a * (g if v < 0 else 1 - g), b * (x if v < 0 else 1 - x)
        return a / (a + b)

    total = sum(patterns.values())
    for _ in range(Q.STEPS):
        w = {p: post(p) for p in patterns}
        before, share = share, (sum(n * w[p] for p, n in patterns.items()) + 0.07 * total) / (1.1 * total)
        for k in range(len(names)):
            lo, hi = ({p: n for p, n in patterns.items() if p[k] == s} for s in (-1, 1))
            g = [sum(n * w[p] for p, n in x.items()) for x in (lo, hi)]
            b = [sum(n * (1 - w[p]) for p, n in x.items()) for x in (lo, hi)]
            good[k], bad[k] = (g[0] + 0.002 * total) / (sum(g) + 0.1 * total), (b[0] + 0.03 * total) / (sum(b) + 0.1 * total)
        if abs(share - before) < 1e-4:
            break
    return {p: post(p) for p in patterns}


def test_posterior_equals_plain_em(spark):
    rows = [(k, prose(k, 120) + "\n" + prose(k + 1, 9) + ".\n" + prose(k + 2, 30)) for k in range(60)] + [(100 + k, junk(k)) for k in range(20)]
    got = Q.judge(documents(spark, rows)).collect()
    names = list(Q.rules())
    patterns = Counter(tuple(r[f"v_{x}"] for x in names) for r in got)
    want = em(patterns, names)
    for r in got:
        assert r.posterior == pytest.approx(want[tuple(r[f"v_{x}"] for x in names)], abs=1e-9)
        assert r.kept == (r.doc_id < 100)


def test_empty(spark):
    assert Q.judge(documents(spark, [(1, "x")]).limit(0)).count() == 0


def test_plan_is_native(spark):
    plan = Q.judge(documents(spark, odd_texts()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_oracle_has_every_rule(spark):
    sql = Q.oracle_sql()
    assert f"v[{len(Q.rules())}]" in sql and f"v[{len(Q.rules()) + 1}]" not in sql
