"""The pipeline's stages get their texts in batches of bounded size."""

import pyarrow as pa


def test_batches_of_a_stage_are_bounded(spark):
    import corpus_pipeline

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    def sizes(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    docs = spark.range(0, 8000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 4000) AS text")
    try:
        stage = corpus_pipeline._sent(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n long"))
        got = [r["n"] for r in stage(spark, docs, "").collect()]
        assert sum(got) > 32_000_000 and max(got) <= 1.1 * corpus_pipeline.BATCH_BYTES
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
        corpus_pipeline._small_batches(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"  # a smaller limit stays
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
