from casebook.operators.search import hashed_counts
from casebook.operators.textvectors import distinct_texts
from casebook.streaming import ingest


def write(spark, folder, texts):
    spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).write.mode("append").parquet(f"{folder}")


def keys(spark, texts):
    return {r["text_key"] for r in distinct_texts(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}


def test_a_second_run_encodes_new_texts_only(spark, tmp_path):
    folder, root, log = f"{tmp_path}/history", f"file://{tmp_path}/store", tmp_path / "log"

    def encode(texts):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return hashed_counts(texts)

    def run(model="m"):
        log.write_text("")
        got = ingest.ingest(spark, folder, "t", root, model, encode, files_per_batch=1)
        assert got.groupBy("text_key").count().where("count > 1").count() == 0
        return {r["text_key"] for r in got.collect()}, sorted(log.read_text().split("\n")[:-1])

    for texts in (["one lid", "two lids", None], ["two lids", " ", "three lids"], ["one lid"]):
        write(spark, folder, texts)
    first = keys(spark, ["one lid", "two lids", "three lids"])
    assert run() == (first, ["one lid", "three lids", "two lids"])
    assert run() == (first, [])
    write(spark, folder, ["three lids", "four lids"])
    assert run() == (first | keys(spark, ["four lids"]), ["four lids"])
    assert run("other") == (first | keys(spark, ["four lids"]), ["four lids", "one lid", "three lids", "two lids"])

    still = distinct_texts(spark.createDataFrame([("one lid",), ("four lids",)], "t string"), "t")
    kept = ingest.prune(spark, root, "m", still)
    assert {r["text_key"] for r in kept.collect()} == keys(spark, ["one lid", "four lids"])
    assert ingest.stored_vectors(spark, root, "other").count() == 0
    assert run() == (keys(spark, ["one lid", "four lids"]), [])


def test_nothing_stored_yet(spark, tmp_path):
    assert ingest.stored_vectors(spark, f"file://{tmp_path}/none", "m").count() == 0
