from orfspark import schema
from orfspark.operators import reads as rd
from orfspark.streaming.coverage import coverage_stream


def test_a_stream_ends_with_the_batch_result(spark, tmp_path):
    exons = spark.createDataFrame([("1", "T", "+", 0, 100, 400, 0, 300)], schema.EXON)
    cds = spark.createDataFrame([("T", 30, 200)], schema.CDS)
    offsets = spark.createDataFrame([(28, 12), (29, 13)], schema.OFFSETS)
    reads = spark.createDataFrame([(f"r{i}_x{i % 3 + 1}", "1", 110 + i % 40, 110 + i % 40 + 28 + i % 2) for i in range(200)], schema.READS)
    reads.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema.READS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = coverage_stream(stream, exons, cds, offsets).writeStream.outputMode("complete").format("memory").queryName("coverage_test").start()
    query.processAllAvailable()
    query.stop()
    batch = rd.asite_coverage(rd.reads_to_cds(rd.reads_to_transcript(rd.normalize_reads(reads), exons), cds), offsets)
    assert sorted(map(tuple, spark.table("coverage_test").collect())) == sorted(map(tuple, batch.collect()))
