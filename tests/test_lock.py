"""The output lock: one winner, leases, fences and publication."""

import threading
import time

import pytest

from scrivane.sources.lock import Locked, OutputLock, publish_locked


def test_one_of_many_wins(spark, tmp_path):
    path, won, lost = str(tmp_path / "o"), [], []
    start = threading.Barrier(8)

    def take():
        lock = OutputLock(spark, path)
        start.wait()
        try:
            won.append(lock.acquire())
        except Locked:
            lost.append(1)

    threads = [threading.Thread(target=take) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won == [1] and len(lost) == 7


def test_released_and_expired_locks_are_taken(spark, tmp_path):
    path = f"file://{tmp_path}/o"
    with OutputLock(spark, path) as first:
        assert first.number == 1 and first.holds()
        with pytest.raises(Locked):
            OutputLock(spark, path).acquire()
    second = OutputLock(spark, path, lease=0.3)
    assert second.acquire() == 2
    second.renew()
    with pytest.raises(Locked):
        OutputLock(spark, path).acquire()
    time.sleep(0.4)
    third = OutputLock(spark, path)
    assert third.acquire() == 3 and third.holds() and not second.holds()
    with pytest.raises(Locked):
        second.renew()
    second.release()  # of a lost lock: nothing
    assert third.holds()


def test_only_the_holder_publishes(spark, tmp_path):
    path = str(tmp_path / "o")
    df = spark.range(5)
    assert spark.read.parquet(publish_locked(df, path, "1")).count() == 5
    with pytest.raises(FileExistsError):
        publish_locked(df, path, "1")
    slow = OutputLock(spark, path, lease=0.01)
    slow.acquire()
    time.sleep(0.05)
    quick = OutputLock(spark, path)
    quick.acquire()
    with pytest.raises(Locked):
        publish_locked(df, path, "2", lock=slow)  # its lease ran out while it wrote
    assert not (tmp_path / "o" / "version=2").exists() and not list((tmp_path / "o").glob("_staged*"))
    with pytest.raises(Locked):
        publish_locked(df, path, "3")
    publish_locked(df, path, "2", lock=quick)
    quick.release()
    assert spark.read.parquet(f"{path}/version=2").count() == 5
