"""User files read by splits: line numbers, blank and malformed lines, round trip."""

import json
import os

from evalframe.sources import files as IO


def test_lines_are_numbered_over_splits(spark, scratch):
    texts = {"a.jsonl": [f"line {i} " + "x" * (i % 50) for i in range(3000)], "b.jsonl": ["", "only", "", "last"], "c.jsonl": []}
    for name, lines in texts.items():
        with open(os.path.join(scratch, name), "w") as f:
            f.write("\n".join(lines) + ("\n" if name == "a.jsonl" else ""))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = IO.numbered_lines(spark, scratch)
        got = {(os.path.basename(r.file), r.line_no): r.line for r in df.collect()}
        assert spark.read.text(scratch).rdd.getNumPartitions() > 10
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {(n, i): t for n, ls in texts.items() for i, t in enumerate(ls)}


def test_user_files_round_trip(spark, scratch):
    rows = [("u1", "history", 0, "t1", "a \n text", "s", "2024", None, None), ("u1", "history", 5, "t2", None, "s", "2024", "t1", None),
            ("u1", "holdout", 1, "t3", "b", "s", "2024", None, "w"), ("u2", "holdout", 0, "t4", "ü", "s", "2024", None, None)]
    posts = spark.createDataFrame(rows, "user_id string, set string, pos int, tweet_id string, full_text string, screen_name string, "
                                        "created_at string, reply_to_id string, retweeted_user_id string")
    IO.user_file_lines(posts).coalesce(1).write.text(os.path.join(scratch, "f"))
    with open(os.path.join(scratch, "f", "z.jsonl"), "w") as f:
        f.write("\n\r\n{not json\n" + json.dumps({"user_id": "u3", "tweets": [{"tweet_id": "t5", "reply_to_id": "nan"}]}))
    t = IO.read_user_files(spark, os.path.join(scratch, "f"))
    got = {r.tweet_id: (r.user_id, r.set, r.pos, r.full_text, r.reply_to_id, r.retweeted_user_id) for r in t["posts"].collect()}
    assert got == {"t1": ("u1", "history", 0, "a \n text", None, None), "t2": ("u1", "history", 1, None, "t1", None),
                   "t3": ("u1", "holdout", 0, "b", None, "w"), "t4": ("u2", "holdout", 0, "ü", None, None), "t5": ("u3", "holdout", 0, None, None, None)}
    assert IO.history(t["posts"], "u1").count() == 2 and IO.holdout(t["posts"]).count() == 3
    bad = [r for r in IO.user_lines(spark, os.path.join(scratch, "f")).collect() if not r.ok]
    assert [(r.line_no, r.line) for r in bad] == [(2, "{not json")]


def test_predictions_of_a_run(spark):
    im = spark.createDataFrame([("r", 1), ("q", 2), ("r", 3), (None, 4)], "run_id string, k int")
    assert sorted(r.k for r in IO.predictions(im, "r").collect()) == [1, 3]
