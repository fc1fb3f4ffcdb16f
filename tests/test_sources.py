from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from muralog.sources.placements import DAY, in_window, read_placements, write_placements, write_table
from muralog.sources.raw_log import ingest_placements, read_raw_log


def write_csv(tmp_path, text, name="log.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


HEADER = "timestamp,user_id,pixel_color,coordinate\n"


def test_published_text_forms_are_read(spark, tmp_path):
    path = write_csv(tmp_path, HEADER
                     + '2022-04-04 00:53:51.577 UTC,abc==,#00CCC0,"826,1048"\n'
                     + '2022-04-04 00:53:53 UTC,abd==,#94B3FF,"583,1031"\n'
                     + '2022-04-04 00:53:53.75,abc==,#6A5CFF,"0,0,5,5"\n')
    rows = ingest_placements(read_raw_log(spark, path)).orderBy("ts").collect()
    assert [(r.pc, r.x, r.y) for r in rows] == [("#00CCC0", 826, 1048), ("#94B3FF", 583, 1031), ("#6A5CFF", 0, 0)]
    assert rows[0].ts.replace(tzinfo=None) == dt.datetime(2022, 4, 4, 0, 53, 51, 577000)
    assert rows[0].user_id == rows[2].user_id != rows[1].user_id
    assert len({r.event_id for r in rows}) == 3


def test_columns_are_found_by_name(spark, tmp_path):
    path = write_csv(tmp_path, 'user_id,coordinate,timestamp,pixel_color\nu,"1,2",2022-04-04 00:00:01,#FFFFFF\n')
    row = ingest_placements(read_raw_log(spark, path)).first()
    assert (row.pc, row.x, row.y) == ("#FFFFFF", 1, 2)
    with pytest.raises(ValueError):
        read_raw_log(spark, write_csv(tmp_path, "timestamp,user_id\n", "short.csv"))


@pytest.mark.parametrize("coordinate", ["12x,3", "12", ","])
def test_bad_coordinate_raises(spark, tmp_path, coordinate):
    path = write_csv(tmp_path, HEADER + f'2022-04-04 00:53:51,u,#00CCC0,"{coordinate}"\n', "bad.csv")
    with pytest.raises(Exception, match="coordinate"):
        ingest_placements(read_raw_log(spark, path)).collect()


def test_bad_timestamp_raises(spark, tmp_path):
    path = write_csv(tmp_path, HEADER + 'yesterday,u,#00CCC0,"1,2"\n', "bad-ts.csv")
    with pytest.raises(Exception):
        ingest_placements(read_raw_log(spark, path)).collect()


def test_placement_table_round_trip_and_pruning(spark, events, tmp_path):
    path = str(tmp_path / "placements")
    write_placements(events, path)
    back = read_placements(spark, path)
    assert back.drop(DAY).exceptAll(events).isEmpty() and back.count() == events.count()
    window = in_window(back, "2024-01-08", "2024-01-10")
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [IsNotNull(ts)" in plan
    assert window.count() == events.filter("ts >= '2024-01-08' AND ts < '2024-01-10'").count()
    assert {f.split(".")[-2] for f in back.inputFiles()} == {"zstd"}


def test_a_file_with_another_header_stops_the_job(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.csv").write_text(HEADER + '2022-04-04 00:00:01,u,#FFFFFF,"1,2"\n')
    (folder / "b.csv").write_text('timestamp,pixel_color,user_id,coordinate\n2022-04-04 00:00:02,#000000,v,"3,4"\n')
    with pytest.raises(Exception, match="(?i)header"):
        ingest_placements(read_raw_log(spark, str(folder))).collect()


def test_appended_rows_get_new_ids(spark, events, tmp_path):
    path = str(tmp_path / "log")
    half = events.filter("x < 20").withColumn("event_id", F.monotonically_increasing_id())
    write_placements(half, path, "append")  # no table yet
    write_placements(half, path, "append")
    ids = read_placements(spark, path).select("event_id")
    assert ids.count() == ids.distinct().count() == 2 * half.count()


def test_ingestion_runs_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    source = spark.range(100, numPartitions=2).selectExpr("id as event_id", "timestamp_seconds(id) as ts")
    write_placements(source.mapInArrow(count, source.schema), str(tmp_path / "p"))
    assert seen.value == 100


def test_a_busy_hour_is_cut_by_its_size(spark, tmp_path):
    """All rows but a few in one hour: as many files as their size asks for, each sorted and of like length."""
    rows = spark.range(0, 400_000, 1, 16).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.when(F.col("id") % 1000 == 0, F.col("id") * 1_000_000).otherwise(F.pmod(F.xxhash64("id"), F.lit(3_600_000_000)))).alias("ts"),
        F.xxhash64("id").alias("user_id"), F.lit("#000000").alias("pc"), (F.col("id") % 2000).cast("int").alias("x"), F.lit(1).alias("y"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        write_placements(rows, str(tmp_path / "p"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    day = spark.read.parquet(str(tmp_path / "p")).filter(F.col(DAY) == "2024-01-01").withColumn("file", F.input_file_name())
    sizes = [r["count"] for r in day.filter("event_id % 1000 <> 0").groupBy("file").count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 400_000 / 3 and sum(sizes) == 399_600
    assert spark.read.parquet(str(tmp_path / "p")).count() == 400_000


def test_derived_table_is_zstd(spark, events, tmp_path):
    path = str(tmp_path / "derived")
    write_table(events.select("x", "y"), path)
    assert {f.split(".")[-2] for f in spark.read.parquet(path).inputFiles()} == {"zstd"}
    assert spark.read.parquet(path).agg(F.sum("x")).first() == events.agg(F.sum("x")).first()
