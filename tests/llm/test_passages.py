import random

import __spark_entry__ as entry
import corpus_pipeline


def test_every_later_place_of_a_short_passage_goes(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
    passages = [[word() for _ in range(2 + k % 3)] for k in range(30)]
    passages[5].insert(1, "")  # a blank line inside
    once, rows, want = word(), [], {}
    for k in range(90):
        own, p = [word() for _ in range(4)], passages[k % 30]
        rows.append((k, "\n".join([*own[:2], once, own[2], *p, own[3]])))
        want[k] = "\n".join([*own[:2], once, own[2], *(p if k < 30 else []), own[3]])
    rows.append((90, "\n".join(["same"] * 5)))  # places that overlap the first stay
    want[90] = "same\nsame"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.text for r in entry.queries()["op7_line_dedup"](spark, str(tmp_path)).collect()} == want
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()} == want
