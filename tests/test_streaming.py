"""Streams of a column give the same blocks and bounds as the column at once."""

from residua.operators import codec as C
from residua.operators import partition as P
from residua.streaming.columns import encode_stream, zone_map_stream


def test_stream_of_a_column(spark, tmp_path):
    rows = spark.range(4096).selectExpr("id as pos", "id * 3 + id % 5 as value")
    for part in range(4):
        rows.filter(f"pos div 1024 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = encode_stream(stream(), "pos", "value", str(tmp_path / "blocks"), str(tmp_path / "ck1"), C.Config.fixed(512))
    query.awaitTermination()
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    assert C.problems(blocks).count() == 0 and C.verify(rows, blocks, "pos", "value").first() == (0, 4096)

    query = zone_map_stream(stream(), "pos", "value", 1000).writeStream.outputMode("complete").format("memory").queryName(
        "zones").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(spark.table("zones").collect()) == sorted(P.bounds(rows, "pos", "value", 1000).collect())
