"""Streams that go quiet: timers speak without further rows, and a restart keeps state and timers."""

import datetime
import time

import pytest

from tidemark.streaming import timers

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, timers.ROCKSDB)
    yield spark
    spark.conf.set(name, old)


class Feed:
    """A folder of files that a stream reads in the order they are put."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in/part={self.n:03}")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in/*")

    def run(self, frame):
        """All that has come so far, then the query ends; the next call goes on from its checkpoint."""
        query = frame.writeStream.format("parquet").option("checkpointLocation", f"{self.folder}/at").option("path", f"{self.folder}/out").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(map(tuple, self.spark.read.parquet(f"{self.folder}/out").collect()))


def second(s):
    return T0 + datetime.timedelta(seconds=s)


def ms(s):
    return int(second(s).timestamp() * 1000)


def test_silence_by_event_time_and_after_a_restart(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, "user long, at timestamp, x int")
    feed.put([(1, second(0), 0), (1, second(2), 0), (2, second(2), 0)])
    told = lambda: feed.run(timers.silences(feed.stream(), "user", "at", timeout_ms=3000, late="0 seconds"))
    assert told() == []
    feed.put([(2, second(4), 0)])
    assert told() == []  # user 1 may still speak until second 5
    feed.put([(2, second(6), 0)])
    first = (1, ms(2), ms(5), True)
    assert told() == [first]  # by the timer that an earlier run has set
    feed.put([(1, second(9), 0), (1, second(7), 0), (2, second(8), 0)])
    again = (1, ms(2), ms(7), False)
    assert told() == [first, again]
    feed.put([(3, second(30), 0)])
    assert told() == sorted([first, again, (1, ms(9), ms(12), True), (2, ms(8), ms(11), True)])


def test_a_stream_that_stops_speaks_by_the_wall_clock(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, "user string, at timestamp")
    feed.put([("a", second(0)), ("b", second(0))])
    frame = timers.silences(feed.stream(), "user", "at", timeout_ms=1500)
    query = frame.writeStream.format("memory").queryName("quiet").option("checkpointLocation", f"{tmp_path}/at").trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and rocks.table("quiet").count() < 2:
            time.sleep(0.5)
        rows = rocks.table("quiet").collect()
        assert sorted(r.key for r in rows) == ["a", "b"] and all(r.silent and r.known_ms == r.last_ms + 1500 for r in rows)
        feed.put([("a", second(1))])
        while time.time() < end and rocks.table("quiet").count() < 4:
            time.sleep(0.5)
        assert [(r.key, r.silent) for r in rocks.table("quiet").collect()][2:] == [("a", False), ("a", True)]
    finally:
        query.stop()


def test_silence_of_a_table(spark):
    rows = [(1, 0), (1, 2000), (1, 9000), (1, 9000), (2, 5), (None, 1), (3, None)]
    df = spark.createDataFrame([r for r in rows if r[1] is not None], "user long, at_ms long")
    got = sorted(map(tuple, timers.silences_of_table(df, ["user"], "at_ms").collect()), key=str)
    assert got == sorted([(1, 2000, 5000, True), (1, 2000, 9000, False), (1, 9000, 12000, True), (2, 5, 3005, True), (None, 1, 3001, True)], key=str)
    assert timers.silences_of_table(df.limit(0), ["user"], "at_ms").count() == 0


EXCHANGE = "key string, at timestamp, kind string, sent_us long, heard_us long, replied_us long, received_us long"


def exchange(key, at_s, offset_us, trip_us, reply=True):
    """Rows of one exchange: half the way there, half back, by a clock `offset_us` ahead."""
    sent = int(second(at_s).timestamp() * 1e6)
    heard, back = sent + trip_us // 2 + offset_us, sent + trip_us
    rows = [(key, second(at_s), "sent", sent, None, None, None)]
    return rows + [(key, second(at_s + trip_us / 1e6), "reply", sent, heard, heard, back)] * reply


def burst(key, at_s, offset_us, trips):
    return [r for k, trip in enumerate(trips) for r in exchange(key, at_s + k * 0.1, offset_us, trip)]


def test_an_overdue_reply_ends_its_burst(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, EXCHANGE)
    told = lambda: feed.run(timers.clock_bursts(feed.stream(), "key", late="0 seconds"))
    feed.put(burst("a", 0, 500, [9000, 2000, 4000]) + exchange("a", 1, 500, 0, reply=False))
    assert told() == []
    feed.put(burst("b", 3, 70, [1000] * 8))
    whole = ("b", ms(3.701), 1, 8, 70, 500, True, False, False)
    assert told() == [whole]
    feed.put([("c", second(20), "sent", 0, None, None, None)])  # moves the watermark; nothing of "a" comes
    got = told()
    assert ("a", ms(6), 1, 3, 500, 1000, True, True, False) in got and whole in got
    feed.put(exchange("a", 21, 40, 600)[1:])  # an answer to what is not in flight
    assert len(told()) == len(got)


def test_syncing_takes_a_confirming_burst(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, EXCHANGE)
    offsets = [100] * 8 + [5000] + [100] * 8 + [900] + [100, 100]
    trips = [[800] * 8] * 18 + [[90_000] * 8, [1_000] * 8]
    feed.put([r for k, (o, t) in enumerate(zip(offsets, trips)) for r in burst("a", 10 * k, o, t)])
    got = feed.run(timers.clock_bursts(feed.stream(), "key"))
    assert [r[2] for r in got] == list(range(1, 21))
    assert [r[8] for r in got] == [False] * 17 + [True] * 3  # the ninth disagrees with the eighth, the eighteenth agrees
    assert [r[6] for r in got] == [True] * 18 + [False, True]  # a slow burst is left out
    with pytest.raises(ValueError):
        rocks.conf.set("spark.sql.streaming.stateStore.providerClass", "x")
        timers.clock_bursts(feed.stream(), "key")
