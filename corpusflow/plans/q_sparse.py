"""J3 on text itself: the windowed chain with sparse tf-idf vectors and the threshold 0.75."""

from __future__ import annotations

from corpusflow.operators import calendar as C
from corpusflow.operators import community, text_join
from corpusflow.plans import q_communities, standins
from corpusflow.plans.q_store import _DATES_SQL
from corpusflow.plans.registry import register
from corpusflow.session import cut_lineage

THRESHOLD = 0.75
MIN_SIZE = 2  # stories of three do not occur in windows of the test documents

_TEXT_SQL = f"""{_DATES_SQL},
keyed AS (SELECT *, title || ' -- ' || sha256(text) AS k FROM wa WHERE title IS NOT NULL AND text IS NOT NULL),
firsts AS (SELECT window_id, arg_min(id, (publish_date, id)) AS id FROM keyed GROUP BY window_id, k),
own AS (SELECT DISTINCT a.id, a.title, a.text FROM articles a JOIN firsts f ON f.id = a.id),
total AS (SELECT count(*) AS n FROM own),
tf AS (SELECT id, term, count(*) AS tf
       FROM (SELECT id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM own) WHERE term <> '' GROUP BY id, term),
dic AS (SELECT term, ln((n + 1.0) / (count(*) + 1.0)) AS idf FROM tf, total GROUP BY term, n HAVING count(*) < n),
wt AS (SELECT id, term, tf * idf AS w FROM tf JOIN dic USING (term)),
nrm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY id),
vec AS (SELECT id, term, w / norm AS w FROM wt JOIN nrm USING (id)),
edges AS (
  SELECT x.window_id, x.id AS src, y.id AS dst, sum(v.w * u.w) AS score
  FROM firsts x JOIN vec v ON v.id = x.id JOIN firsts y ON y.window_id = x.window_id JOIN vec u ON u.id = y.id AND u.term = v.term
  GROUP BY x.window_id, x.id, y.id HAVING sum(v.w * u.w) >= {THRESHOLD})"""


def _deduped(spark, sf_dir):
    """A2 -> W3 -> J2 -> W2: ``id, text`` of the articles of the windows, one per title and text, and ``window_id, id``."""
    articles = standins.articles(spark, sf_dir).select("id", "title", "text", "publish_date")
    windows = cut_lineage(C.date_windows(C.qualifying_dates(articles)))
    inside = C.window_articles(articles, windows)
    kept = cut_lineage(C.window_dedup(inside, keep=["id"]).select("window_id", "id"))
    # only ids meet, and those of the copies are few, so that no text is shuffled
    copies = cut_lineage(inside.select("id").join(kept.select("id"), "id", "left_anti"))
    return inside.select("id", "text").join(text_join.small(copies), "id", "left_anti"), kept


def _edges(own, kept):
    steps = {}
    vectors = text_join.text_vectors(own, steps=steps)
    return text_join.sparse_edges(vectors, kept, THRESHOLD, steps=steps)


@register("text_sister_edges", f"""WITH RECURSIVE {_TEXT_SQL}
SELECT window_id, src, dst, score FROM edges""")
def text_sister_edges(spark, sf_dir):
    """W2 -> tf-idf vectors of whole texts -> J3 at 0.75 per window, both directions and self."""
    return _edges(*_deduped(spark, sf_dir))


@register("text_sister_members", f"""WITH RECURSIVE {_TEXT_SQL},
cand AS (""" + q_communities._GREEDY_SQL.partition("cand AS (")[2].replace(
    f"HAVING count(*) >= {q_communities.MIN_SIZE}", f"HAVING count(*) >= {MIN_SIZE}") + """
SELECT window_id, cluster_no, member_no, center, id, score FROM members""")
def text_sister_members(spark, sf_dir):
    """The chain from text alone: edges at 0.75 -> star cover -> numbered members."""
    return community.communities(_edges(*_deduped(spark, sf_dir)), MIN_SIZE)
