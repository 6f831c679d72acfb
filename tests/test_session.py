from types import SimpleNamespace

import pytest

from hearthline.session import shared_dir
from hearthline.sources.tables import load_table
from tests.conftest import rows


def session(master, setting=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: setting or default),
        sparkContext=SimpleNamespace(master=master),
    )


def test_written_intermediates_go_to_the_shared_folder():
    assert shared_dir(session("spark://head:7077", "s3a://team/ckpt/"), "x").startswith("s3a://team/ckpt/x-")
    assert shared_dir(session("local[2]"), "x") != shared_dir(session("local[2]"), "x")


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError):
        shared_dir(session("spark://head:7077"), "x")


def test_tables_get_their_declared_types(spark):
    path = shared_dir(spark, "views")
    log = spark.sql("SELECT 1 AS id, 'u' AS user_id, 'd' AS device_id, '2024-01-01 00:00:00' AS viewed_at, 7 AS other")
    log.write.csv(path, header=True)
    source = {"format": "csv", "path": path, "header": "true"}
    table = load_table(spark, "device_view_history", source)
    assert [f.dataType.typeName() for f in table.schema] == ["long", "string", "string", "timestamp_ntz"]
    assert len(rows(table)) == 1
