"""A stream of hits is mined as a table is."""

from orgbeacon.streaming.mining import mined_stream


def test_stream(spark, tmp_path):
    rows = [("1", 1, "Сайт: https://dadata.ru ·", "почта info@dadata.ru"), ("2", 1, None, "марка y1.com"), ("3", 1, None, None)]
    table = spark.createDataFrame(rows, "inn string, hit_no int, title string, snippet string")
    table.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).json(str(tmp_path / "in"))
    query = mined_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mined_stream(table).collect())) == [("1", 1, 1, "dadata.ru", "site_field"), ("2", 1, 1, "y1.com", "mention")]
