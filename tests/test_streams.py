"""An index that a stream keeps."""

from folioscale.operators.lexical import build_index
from folioscale.session import scratch_path
from folioscale.streaming import ingest


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_what_comes_again_is_known_and_what_changed_is_built_anew(spark):
    folder, path = scratch_path(spark, "arrivals"), scratch_path(spark, "stream")
    shape = "doc_id long, text string"

    def bring(name, rows):
        spark.createDataFrame(rows, shape).write.parquet(f"{folder}/{name}")
        ingest.index_stream(spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(folder), path)
        return ingest.stream_index(spark, path)

    first = [(1, "one two"), (2, "two three two"), (2, "two three two"), (None, "no number"), (4, None)]
    want = {1: "one two", 2: "two three two", None: "no number", 4: None}
    for name, rows, change in (("a", first, {}), ("b", first, {}), ("c", [(2, "changed words"), (3, "new")], {2: "changed words", 3: "new"}), ("d", [(2, "two three two"), (1, "one two")], {2: "two three two"})):
        windows, postings = bring(name, rows)
        want |= change
        whole = build_index(spark.createDataFrame(list(want.items()), shape))
        assert rows_of(windows) == rows_of(whole[0]) and rows_of(postings) == rows_of(whole[1])
    assert spark.read.parquet(f"{path}/seen").where("batch = 1").count() == 0


def test_a_batch_that_is_tried_again_does_the_same(spark):
    path = scratch_path(spark, "stream")
    folder = scratch_path(spark, "arrivals")
    shape = "doc_id long, text string"
    spark.createDataFrame([(1, "one two")], shape).write.parquet(f"{folder}/a")
    stream = lambda: spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(folder)
    ingest.index_stream(stream(), path)
    before = rows_of(ingest.stream_index(spark, path)[1])
    from folioscale.plans.commits import Store

    Store(spark, path).remove("progress/commits")  # as if the batch had not been noted as done
    ingest.index_stream(stream(), path)
    assert rows_of(ingest.stream_index(spark, path)[1]) == before
