from strandgraph.streaming.incremental import micro_batch_counts

DIR = "/root/testdata/sf0.001"


def test_folder_of_part_files_and_single_file_count_the_same(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    path = f"file://{tmp_path}/events.parquet"
    events.repartition(4).write.parquet(path)
    want = sorted(tuple(r) for r in events.groupBy("event_type").agg({"*": "count"}).collect())
    for p in (path, path + "/", f"{DIR}/events.parquet"):
        assert sorted((r["event_type"], r["n"]) for r in micro_batch_counts(spark, p).collect()) == want
