"""Files, tables and nested parameters."""

from types import SimpleNamespace

import pytest
from events import log
from pyspark.sql import functions as F

from ebbtide.operators.event_params import param_value_counts, unnest_params
from ebbtide.schema import USER_SCHEMA
from ebbtide.session import CHECKPOINT_CONF, shared_dir
from ebbtide.sources import user_files
from ebbtide.sources.event_log import read_event_day, read_event_log, union_shards, write_event_log


def test_csv_round_trip(spark, users, tmp_path):
    path = user_files.write_user_csv(users, f"{tmp_path}/users")
    back = user_files.read_user_csv_with_time(spark, path)
    assert back.schema.simpleString() == USER_SCHEMA.simpleString()
    assert sorted(back.collect(), key=str) == sorted(users.collect(), key=str)


def test_time_formats(spark, tmp_path):
    header = ",".join(USER_SCHEMA.fieldNames())
    row = "{},id,0,0,Norway,IOS,nb-no" + ",1" * 11 + ",1"
    times = ["2031-05-06 07:08:09.000123+00:00", "2031-05-06 07:08:09+00:00", "2031-05-06 07:08:09"]
    (tmp_path / "u.csv").write_text("\n".join([header, *[row.format(t) for t in times]]) + "\n")
    read = user_files.read_user_csv_with_time(spark, str(tmp_path))
    micros = [r[0] for r in read.select(F.unix_micros("user_first_engagement")).collect()]
    assert sorted(micros) == [1935817689000000, 1935817689000000, 1935817689000123]


def test_csv_of_another_shape_is_an_error(spark, tmp_path):
    names = USER_SCHEMA.fieldNames()
    row = "2031-05-06 07:08:09,id,0,0,Norway,IOS,nb-no" + ",1" * 12
    for number, (header, line) in enumerate([(names[::-1], row), (names, row.replace(",0,0,", ",x,0,"))]):
        path = tmp_path / f"{number}.csv"
        path.write_text(",".join(header) + "\n" + line + "\n")
        with pytest.raises(Exception):
            user_files.read_user_csv(spark, str(path)).collect()


def test_parquet_and_table(spark, users, tmp_path):
    path = user_files.write_user_parquet(users, f"{tmp_path}/users")
    assert user_files.read_user_parquet(spark, path).count() == users.count()
    saved = user_files.save_user_table(users, "users_for_test", f"{tmp_path}/table")
    assert saved.count() == users.count()
    spark.sql("DROP TABLE users_for_test")


def test_day_partitions(spark, tmp_path):
    events = log(spark, [("a", 0), ("b", 30 * 3_600_000_000), ("a", 31 * 3_600_000_000)])
    root = write_event_log(events, f"{tmp_path}/log")
    assert read_event_log(spark, root).count() == 3
    assert read_event_day(spark, root, "2018-10-02").count() == 2


def test_shards_with_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, extra string")
    b = spark.createDataFrame([(2,)], "id int")
    assert sorted(union_shards([a, b]).collect()) == [(1, "x"), (2, None)]


def test_params(spark):
    events = log(
        spark,
        [
            dict(user="a", at=0, params=()),
            dict(user="a", at=1, params=[("other", "v")]),
            dict(user="a", at=2, params=[("screen", None)]),
            dict(user="a", at=3, params=[("screen", "menu"), ("screen", "menu"), ("other", "v")]),
            dict(user="a", at=4, params=[("screen", "shop")], name="post_score"),
        ],
    )
    counts = param_value_counts(events, "screen", "user_engagement").collect()
    assert [tuple(r) for r in counts] == [("menu", 2), (None, 1)]
    assert unnest_params(events).count() == 6


def test_shared_folder_comes_from_the_session():
    class Session:
        conf = {CHECKPOINT_CONF: "/shared/folder/"}
        sparkContext = SimpleNamespace(master="spark://host", applicationId="app")

    assert shared_dir(Session, "x").startswith("/shared/folder/app/x-")


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        conf = {}
        sparkContext = SimpleNamespace(master="spark://host", applicationId="app")

    with pytest.raises(RuntimeError, match=CHECKPOINT_CONF):
        shared_dir(Session, "x")
