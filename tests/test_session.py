from __future__ import annotations

from types import SimpleNamespace

import pytest

from muralog.session import MIB, configure, shuffle_partitions
from muralog.sources.scratch import broadcast_if_small, scratch_root, stage


def test_partitions_follow_the_data():
    assert shuffle_partitions(0) == 8
    assert shuffle_partitions(10_000 * MIB) == 40
    assert shuffle_partitions(10**15) == 40_000


def test_settings_are_applied(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    configure(spark, 100 * 256 * MIB)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "100"
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_scratch_folder_is_the_one_of_the_session(spark):
    def session(named, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: named if name == "spark.checkpoint.dir" else default),
                               sparkContext=SimpleNamespace(master=master, applicationId="app"))

    assert scratch_root(session("hdfs://shared/tmp/", "yarn")) == "hdfs://shared/tmp"
    with pytest.raises(RuntimeError):
        scratch_root(session(None, "yarn"))
    assert scratch_root(session(None, "local[2]")) == scratch_root(session(None, "local[2]"))


def test_only_counted_small_tables_are_marked_for_broadcast(spark):
    table = stage(spark.range(10), "ten")
    hint = "ResolvedHint (strategy=broadcast)"
    assert hint in broadcast_if_small(table, 10)._jdf.queryExecution().analyzed().toString()
    assert hint not in broadcast_if_small(table, 9)._jdf.queryExecution().analyzed().toString()
