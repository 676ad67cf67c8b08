"""The folder for intermediate tables."""

import os

from marginalia import shared


def local(path):
    return "/" + path.partition(":")[2].lstrip("/")


def test_written_and_discarded(spark):
    table = shared.written(spark.range(5), "test")
    assert sorted(r["id"] for r in table.collect()) == list(range(5))
    folder = {local(f).rpartition("/")[0] for f in table.inputFiles()}
    assert len(folder) == 1 and all(os.path.isdir(f) and f.startswith(local(shared.run_dir(spark))) for f in folder)
    shared.discard(table)
    assert not any(os.path.exists(f) for f in folder)


def test_only_own_tables_are_discarded(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    shared.discard(kept)
    assert kept.count() == 3


def test_one_folder_per_application_below_the_checkpoint_folder(spark):
    assert shared.run_dir(spark) == shared.run_dir(spark)
    assert local(shared.run_dir(spark)).startswith(local(shared.shared_dir(spark)))
    assert shared.new_path(spark, "x") != shared.new_path(spark, "x")
