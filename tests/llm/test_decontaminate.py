import re

import pytest
from helpers import clashing, documents, odd_texts, prose

from corpusflow.llm import decontaminate as D
from corpusflow.llm.common import pick


def words(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def brute(docs, items, t=0.8):
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            x = words(item)
            k = min(5, len(x))
            if not k:
                continue
            sh = {tuple(x[p:p + k]) for p in range(len(x) - k + 1)}
            own = {tuple(w[p:p + k]) for p in range(len(w) - k + 1)}
            c = len(sh & own) / len(sh)
            if c >= t - 1e-9:
                out[d, i] = max(out.get((d, i), 0), c)
    return out


def items_table(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_equals_brute_force(spark):
    items = [(k, prose(100 + k, 6 + 3 * k)) for k in range(12)] + [(50, None), (51, ""), (52, "one"), (53, "two three four")]
    docs = odd_texts()
    for k in range(12):
        w = items[k][1].split()
        docs.append((100 + k, prose(200 + k, 300) + ". " + items[k][1].upper() + "! " + prose(300 + k, 300)))
        w[len(w) // 2] = "changed"
        docs.append((200 + k, prose(400 + k, 50) + " " + " ".join(w)))
    got = {(r.doc_id, r.item_id): r.containment
           for r in D.contained_items(clashing(documents(spark, docs)), items_table(spark, items)).collect()}
    want = brute(docs, items)
    assert got == pytest.approx(want) and len(want) > 15


def test_sketch_size_never_loses_a_pair():
    for n in range(1, 300):
        upper = 1 << (n - 1).bit_length()
        for found in range(n + 1):
            if found / n >= 0.8 - 1e-9:
                assert n - found < min(n, D.sketch_size(upper, 0.8))


def test_empty_tables_and_filter(spark):
    docs, items = clashing(documents(spark, odd_texts())), items_table(spark, [(1, "one two three four five")])
    assert D.contained_items(docs.limit(0), items).count() == 0
    assert D.contained_items(docs, items.limit(0)).count() == 0
    kept = D.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 1


def test_clean_rows_stay_beside_contaminated_ones_of_the_same_id(spark):
    item = prose(77, 12)
    bad = [(None, prose(1, 40) + " " + item), (5, item + " " + prose(2, 40)), (6, item)]
    good = [(None, prose(3, 40)), (None, None), (5, prose(4, 40)), (5, prose(5, 40)), (7, prose(4, 40)), (7, None)]
    docs = clashing(documents(spark, bad + good + good[:3]))
    kept = D.clean_documents(docs, items_table(spark, [(1, item), (None, prose(9, 9))]))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert kept.columns == docs.columns
    assert sorted([(r.i, r.t) for r in pick(kept, i="doc_id", t="text").collect()], key=key) == sorted(good + good[:3], key=key)


def test_long_items_are_not_broadcast(spark, monkeypatch):
    items = [(k, prose(100 + k, 40)) for k in range(6)]
    docs = documents(spark, [(k, prose(200 + k, 50) + " " + items[k % 6][1]) for k in range(12)])
    small = D.contained_items(docs, items_table(spark, items))
    monkeypatch.setattr(D, "BROADCAST_BYTES", 1000)
    long = D.contained_items(docs, items_table(spark, items))
    bounds = [x._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") for x in (small, long)]
    assert bounds[1] < bounds[0]
    assert sorted(small.collect()) == sorted(long.collect()) and small.count() == 12


def test_plan_is_native(spark):
    docs, items = documents(spark, odd_texts()), items_table(spark, [(1, "one two three four five")])
    plan = D.contained_items(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
