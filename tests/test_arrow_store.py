"""The data source over Arrow files: filters at the store, files left out, rows as Spark alone gives them."""

import datetime as dt
import glob
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, LessThan, Not, StringStartsWith
from pyspark.sql.types import StructType

from lodework.sources.arrow_store import StoreReader, can_hold, manifest, read_store, write_store

SCHEMA = "id long, name string, day date, at timestamp_ntz, instant timestamp, price double, flag boolean"


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    made = [(i, r.choice(["ash", "birch", "oak", "\u00e9", None]), dt.date(2020, 1, 1) + dt.timedelta(days=i // 10), dt.datetime(2020, 1, 1) + dt.timedelta(hours=i),
             dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i), r.choice([float("nan"), None, r.random()]), r.choice([True, False, None])) for i in range(2000)]
    return spark.createDataFrame(made + [(None,) * 7], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "t")
    write_store(rows.repartitionByRange(4, "id"), path, file_rows=300)
    return path


TESTS = ["id = 7", "id > 1990", "id >= 1990 AND name = 'oak'", "id < 3 OR id = 1999", "id IS NULL", "name IS NOT NULL", "name IN ('ash', 'oak', 'none')", "name LIKE 'bi%'",
         "day = date '2020-02-01'", "at < timestamp_ntz '2020-01-02 03:00:00'", "instant >= timestamp '2020-01-02 00:00:00'", "price > 0.5", "price = double('NaN')", "flag", "NOT flag",
         "name != 'oak'", "id <=> NULL", "id = 7 AND id = 8", "id IN (5, 600, NULL)", "name > 'b'", "id > 5000"]


@pytest.mark.parametrize("test", TESTS)
def test_rows(spark, rows, folder, test):
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, read_store(spark, folder).where(test).collect())) == sorted(map(key, rows.where(test).collect()))


def test_files(spark, folder):
    files = manifest(folder)
    assert sum(x["rows"] for x in files) == 2001 and max(x["rows"] for x in files) <= 300
    # a file that no manifest names is of a task that failed
    assert len(glob.glob(folder + "/*.arrow")) == len(files)
    open(folder + "/left-over.arrow", "w").close()
    assert read_store(spark, folder).count() == 2001
    narrow = read_store(spark, folder, "name string, id long")
    assert narrow.columns == ["name", "id"] and narrow.where("id = 7").count() == 1


def test_pruning(spark, folder):
    schema = StructType.fromDDL(SCHEMA)

    def asked(*filters):
        reader = StoreReader(folder, schema)
        left = list(reader.pushFilters(list(filters)))
        return reader, left, [p.name for p in reader.partitions() if p.name]

    every = len(manifest(folder))
    reader, left, names = asked(EqualTo(("id",), 7), IsNotNull(("id",)))
    assert not left and len(names) == 1
    assert [r for b in reader.read(reader.partitions()[0]) for r in b.column("id").to_pylist()] == [7]
    assert asked(GreaterThan(("id",), 10_000))[2] == []
    assert 0 < len(asked(LessThan(("day",), dt.date(2020, 1, 5)))[2]) < every
    assert len(asked(In(("id",), (1, 1999)))[2]) == 2
    assert len(asked(IsNull(("id",)))[2]) == 1
    assert asked(StringStartsWith(("name",), "aa"))[2] == []
    other = Not(EqualTo(("id",), 7))
    assert asked(other)[1:] == ([other], [x["name"] for x in manifest(folder)])
    doubts = EqualTo(("price",), 0.5)
    assert asked(doubts)[1] == [doubts]


def test_range_of_nulls_only():
    file = {"ranges": {"x": [None, None, 5]}}
    assert can_hold(file, "x", IsNull, None) and not can_hold(file, "x", IsNotNull, None) and not can_hold(file, "x", EqualTo, pa.scalar(1))
    assert can_hold(file, "y", EqualTo, pa.scalar(1))


def test_plan_and_empty(spark, folder, tmp_path):
    plan = read_store(spark, folder).where("id = 7").groupBy().agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("isnotnull", "")  # nothing is left for Spark to test
    write_store(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert read_store(spark, str(tmp_path / "none"), SCHEMA).count() == 0
