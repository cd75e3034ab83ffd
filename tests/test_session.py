"""Session settings and the shared folder."""

import threading
from types import SimpleNamespace

from tidemark.session import side_by_side, sizing, workspace


def fake(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder or default),
        sparkContext=SimpleNamespace(master=master),
    )


def test_sizing():
    assert sizing(20 * 2**40, 4000) == {"spark.sql.shuffle.partitions": "163840"}
    assert sizing(1, 8) == {"spark.sql.shuffle.partitions": "16"}


def test_workspace_is_fresh_and_below_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = workspace(spark, "x"), workspace(spark, "x")
    assert first != second and first.startswith(f"{shared}/x-")
    assert workspace(fake("yarn", "s3a://shared/"), "x").startswith("s3a://shared/x-")


def test_without_the_setting_the_warehouse_is_used():
    settings = {"spark.checkpoint.dir": None, "spark.sql.warehouse.dir": "s3a://warehouse/"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings[key]))
    assert workspace(session, "x").startswith("s3a://warehouse/scratch/x-")


def test_side_by_side_keeps_order_and_runs_together(spark):
    barrier = threading.Barrier(3, timeout=30)

    def job(n):
        barrier.wait()
        return spark.range(n).count()

    assert side_by_side(spark, job, [5, 1, 3], concurrency=3) == [5, 1, 3]
    assert side_by_side(spark, job, [], concurrency=3) == []
