import random

import public_tokenizers as P
from helpers import clashing, documents, odd_texts, prose
from tokenizers import Tokenizer

from corpusflow.llm import token_counts as T

PATH = P.path("byte_bpe_50k.json")
PARTS = ["a", "b", "don't", " ", "  ", "\n", "1", "23", "!", "é", "\t", "word", "'s", "'", " \n ", ""]


def full(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return len(t.encode(text, add_special_tokens=False).ids)


def test_tree_equals_a_full_recount():
    r, c = random.Random(3), T.PieceCounter(PATH, P.PATTERN)
    for _ in range(250):
        cur = "".join(r.choice(PARTS) for _ in range(r.randrange(0, 500)))
        tree = T.TokenTree(cur, c)
        for _ in range(5):
            a, n = r.randrange(0, len(cur) + 2), r.choice([0, 0, 1, 2, 5, 30, 400])
            ins = "".join(r.choice(PARTS) for _ in range(r.choice([0, 1, 2, 6, 300])))
            tree.edit(a, n, ins)
            a = min(a, len(cur))
            cur = cur[:a] + ins + cur[min(a + n, len(cur)):]
            assert tree.text == cur
            assert [s for run in tree.runs for s in run[0]] == [len(x) for x in c.cut.findall(cur)]
            assert (tree.total, tree.chars[1]) == (sum(n for run in tree.runs for n in run[1]), len(cur))
        assert tree.total == full(cur)


def test_only_the_touched_region_is_cut_again():
    tree = T.TokenTree(prose(5, 20000), T.PieceCounter(PATH, P.PATTERN))
    tree.recut = 0
    for k in range(50):
        tree.edit(1000 * k, 3, "xyz ")
    assert tree.recut < 50 * 60


def test_an_edit_sums_only_its_path():
    """Edits that cross runs, split and empty them make few sums, whatever the length of the text."""
    counter, r = T.PieceCounter(PATH, P.PATTERN), random.Random(8)
    for n in (2_000, 40_000):
        tree = T.TokenTree(prose(6, n), counter)
        tree.summed, edits = 0, 400
        for _ in range(edits):
            tree.edit(r.randrange(len(tree.text)), r.choice([0, 3, 900]), prose(r.randrange(99), r.choice([0, 1, 200])))
        assert tree.summed < 120 * edits
        assert tree.total == full(tree.text) and tree.tokens[1] == sum(map(sum, (c for _, c in tree.runs)))
    tree = T.TokenTree("", counter)  # grows from nothing, at one place
    for k in range(300):
        tree.edit(0, 0, prose(k, 100) + " ")
    assert tree.total == full(tree.text) and tree.width >= len([1 for s, _ in tree.runs if s])
    tree.edit(0, len(tree.text), "")
    assert tree.total == 0 and tree.text == ""


def test_rows_of_a_hot_id_are_dealt_out(spark):
    """Five hundred rows of one id: each is edited, and no group holds many of their trees."""
    docs = [(1, prose(k % 3, 20)) for k in range(500)] + [(k, prose(k, 15)) for k in range(2, 40)] + [(None, "same text")] * 200
    edits = [(1, 0, 3, 2, "new "), (1, 1, 0, 1, ""), (5, 0, 0, 0, "x ")]
    e = spark.createDataFrame(edits, "doc_id bigint, seq bigint, start bigint, n_delete bigint, insert string")
    rows = T.count_edited(documents(spark, docs).repartition(3), e, PATH, P.PATTERN).collect()

    def edited(i, t):
        for d, _, a, k, ins in edits:
            if d == i:
                t = t[:a] + ins + t[a + k:]
        return i, sum(d == i for d, *_ in edits), full(t)

    assert sorted(((r.doc_id, r.n_edits, r.n_tokens) for r in rows), key=str) == sorted((edited(i, t) for i, t in docs), key=str)


def test_documents_and_edits(spark):
    docs = odd_texts()
    edits = [(1, 0, 5, 3, "new words"), (1, 1, 0, 0, "start "), (1, 2, 10**6, 5, " end"), (3, 0, 0, 0, "from null"),
             (4, 0, 0, 9, None), (6, 0, 50000, 100, ""), (7, 0, 3, 1, "zz"), (None, 0, 0, 5, "q"), (999, 0, 0, 0, "lost"),
             (2, 1, None, None, "b"), (2, 1, None, None, "a"), (9, 0, -5, 2, "X")]
    e = spark.createDataFrame(edits, "doc_id bigint, seq bigint, start bigint, n_delete bigint, insert string")
    want = []
    for d, t in docs:
        cur, n = t or "", 0
        before = full(cur)
        own = sorted((x for x in edits if x[0] == d and d is not None), key=lambda x: (x[1], x[2] or 0, x[3] or 0, x[4] or ""))
        for _, _, a, k, ins in own:
            a = min(max(a or 0, 0), len(cur))
            cur, n = cur[:a] + (ins or "") + cur[a + (k or 0):], n + 1
        want.append((d, n, len(cur), before, full(cur)))
    rows = T.count_edited(clashing(documents(spark, docs)), clashing(e.withColumnRenamed("insert", "ins")), PATH, P.PATTERN, insert_col="ins").collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    for r in rows:
        assert sum(r.run_tokens) == r.n_tokens and sum(r.run_chars) == r.n_chars
    assert T.count_edited(documents(spark, docs), e.limit(0), PATH, P.PATTERN).count() == len(docs)
    assert T.count_edited(documents(spark, docs).limit(0), e, PATH, P.PATTERN).count() == 0
