"""The streaming direct estimate equals the batch estimate."""

from pyspark.sql import functions as F

from mosarea.operators.weights import direct_unweighted
from mosarea.plans import views as V
from mosarea.streaming.direct import direct_unweighted_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    face = V.households(spark, SF).where(F.col("modality") == "f2f")
    face.repartition(3).write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = (
        direct_unweighted_stream(stream, delay="10000 days")
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("direct_stream")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .start()
    )
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    key = lambda df: sorted((r.adm2_name, r.obs_month, r.f2f_est, r.n) for r in df.collect())
    assert key(spark.table("direct_stream")) == key(direct_unweighted(stored))
