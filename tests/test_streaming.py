from textveil.operators.masking import deidentify
from textveil.streaming.masking import mask_stream


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "SSN 123-45-6789 on 3/4/2024"), (2, "none"), (3, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    for q in mask_stream(stream, "doc_id", "s", str(tmp_path / "masked"), str(tmp_path / "map"), str(tmp_path / "check")):
        q.awaitTermination(120)
    for path, batch in zip(("masked", "map"), deidentify(docs, "doc_id", "s"), strict=True):
        assert sorted(spark.read.parquet(str(tmp_path / path)).collect()) == sorted(batch.collect())
