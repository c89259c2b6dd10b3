"""Tables in the shared folder come and go with their scope."""

import os

import pytest
from furrow import session


def files(spark):
    top = session.own_dir(spark).removeprefix("file://")
    return sorted(os.listdir(top)) if os.path.isdir(top) else []


def test_scratch_tables_go(spark):
    before = files(spark)
    with session.scratch(spark):
        gone = session.stored(spark.range(5), "gone")
        with session.scratch(spark):
            inner = session.stored(gone, "inner", keep=True)
            session.stored(gone, "never")
        kept = session.stored(inner, "kept", keep=True)
        assert len(set(files(spark)) - set(before)) == 3
    assert kept.count() == 5
    (left,) = set(files(spark)) - set(before)
    assert left.startswith("kept-")
    with pytest.raises(ValueError), session.scratch(spark):
        session.stored(spark.range(5), "lost", keep=True)
        raise ValueError
    assert set(files(spark)) - set(before) == {left}


def test_partitions_follow_bytes_and_are_never_raised(spark):
    df = spark.range(100).repartition(10)
    assert session.sized(df, 1).rdd.getNumPartitions() == 1
    assert session.sized(df, 3 * session.FILE_BYTES).rdd.getNumPartitions() == 3
    assert session.sized(df, 10**12).rdd.getNumPartitions() == 10
