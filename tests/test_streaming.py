import json

from reqloom.streaming import stages


def test_stream_extracts_like_the_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.jsonl").write_text(json.dumps({"idx": str(i), "original_text": f"The beam shall carry at least {i + 1} kg." if i else " "}) + "\n")
        q = stages.extraction_log(stages.requirements(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
        q.awaitTermination(120)
    got = {r["idx"]: (r["status"], r["record"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] == ("skipped", None) and len(got) == 3
    assert got[2][1]["requirements"][0]["constraints"][0]["value"]["quantity"]["v1"] == 3.0
