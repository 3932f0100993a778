"""File sources/sinks round trips in fresh temp folders."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from corpusflow.sources import clusters, files


def _tmp():
    return tempfile.mkdtemp(prefix="cf-test-", dir="/tmp")


def test_cluster_lines_chunked_round_trip(spark):
    members = spark.createDataFrame(
        [(0, 0, j, 100 + j, 1.0 if j == 0 else 0.9 - 0.01 * j) for j in range(7)]
        + [(0, 1, j, 200 + j, 1.0 if j == 0 else 0.5) for j in range(3)],
        "window_id long, cluster_no long, member_no long, id long, score double")
    arts = spark.createDataFrame([(0, i, f"t{i}", "x") for i in list(range(100, 107)) + list(range(200, 203))],
                                 "window_id long, id long, title string, text string")
    names = spark.createDataFrame([(0, "2021-4-1-to-2021-4-2-sister-articles.jsonl")], "window_id long, file_name string")
    small = clusters.cluster_lines(members, arts, names, max_members=2)
    whole = clusters.cluster_lines(members, arts, names, max_members=1000)
    assert small.count() == 3 + 1 and whole.count() == 2
    line = json.loads(whole.where("cluster_no = 1").first()["value"])
    assert list(line) == ["A1"] and list(line["A1"]) == ["S0", "S1", "S2"]
    assert "url" not in line["A1"]["S0"]  # missing optional fields are left out
    out = _tmp()
    clusters.write_cluster_lines(small, os.path.join(out, "c"))
    back = clusters.pairs_from_lines(clusters.read_cluster_lines(spark, os.path.join(out, "c")))
    direct = clusters.pairs_from_lines(whole)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, direct.collect()))
    assert back.count() == 8


def test_s10_after_s9_lines_sorted_by_number(spark):
    # S10 beyond S2 in text order: members sorted by the number after S
    line = '{"A0": {"S0": {"title": "c", "score": 1.0}, "S10": {"title": "b", "score": 0.5}, "S2": {"score": 0.4}}}'
    lines = spark.createDataFrame([("f.jsonl", line)], "file_name string, value string")
    got = [tuple(r) for r in clusters.pairs_from_lines(lines).collect()]
    assert got == [("c", "b", 0.5, "clusters/f.jsonl/A0S0S10")]


def test_shards_and_defaults(spark):
    out = os.path.join(_tmp(), "shards")
    rows = spark.createDataFrame([(i, i // 4, f"in{i}", None if i == 3 else f"out{i}", None, "p") for i in range(10)],
                                 "ordinal long, shard long, input_text string, output_text string, "
                                 "output_text_score float, file_path string")
    files.write_shards(rows, out)
    back = files.read_training_pairs(spark, out)
    assert back.count() == 10
    assert back.where("ordinal = 3").first()["output_text"] == ""
    assert back.where("ordinal = 3").first()["output_text_score"] == 0.0
    assert [r["ordinal"] for r in files.iter_shard(spark, out, 1)] == [4, 5, 6, 7]


def test_corpus_lines(spark):
    df = spark.createDataFrame([("a", "b")], "input_text string, output_text string")
    assert files.corpus_lines(df).first()[0] == "a[start] b [end]"
    out = os.path.join(_tmp(), "corpus")
    files.write_corpus(files.corpus_lines(df.union(df)), out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part"))
    assert text == "a[start] b [end]\n\na[start] b [end]\n\n"


def test_jsonl_scan_rejects_malformed(spark):
    root = _tmp()
    os.makedirs(os.path.join(root, "m", "sub"))
    with open(os.path.join(root, "m", "sub", "x.jsonl"), "w") as f:
        f.write(json.dumps({"title": "t", "text": "a"}) + "\n{not json\n" + json.dumps({"text": None}) + "\n")
    with open(os.path.join(root, "m", "skip.txt"), "w") as f:
        f.write("{}\n")
    good, bad = files.split_rejects(files.read_jsonl(spark, os.path.join(root, "m")))
    assert good.count() == 2 and bad.count() == 1


def test_manifest_and_pending(spark):
    root = _tmp()
    p = os.path.join(root, "warc.paths")
    with open(p, "w") as f:
        f.write("crawl-data/CC-MAIN-2021-21/segments/1/warc/a.warc.gz\n"
                "crawl-data/CC-MAIN-2021-21/segments/1/warc/b.warc.gz\n\n")
    man = files.read_manifest(spark, p)
    keys = sorted(r["out_key"] for r in man.collect())
    assert keys == ["CC-MAIN-2021-21/segments_1_warc_a.warc.gz.jsonl", "CC-MAIN-2021-21/segments_1_warc_b.warc.gz.jsonl"]
    done = spark.createDataFrame([(keys[0],)], "out_key string")
    assert [r["out_key"] for r in files.pending_archives(man, done).collect()] == [keys[1]]
    names = files.c4_manifest(spark)
    assert names.count() == 512 and names.where("shard = 7").first()["name"] == "c4-train.00007-of-00512.json.gz"
    assert names.select(F.countDistinct("name")).first()[0] == 512
