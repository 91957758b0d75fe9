import os

import pytest

from conftest import BASE
from repricer.sources.ingest import read_events, read_raw
from test_streaming import drain


def put(folder, name, content, second):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "wb") as file:
        file.write(content if isinstance(content, bytes) else content.encode())
    os.utime(path, (BASE + second, BASE + second))


def rows(df):
    return [(r.seq, r.value) for r in df.orderBy("seq").collect()]


@pytest.fixture()
def folder(tmp_path):
    folder = str(tmp_path / "in")
    put(folder, "b.json", "first\r\nsecond é\n\nfourth", 1)
    put(folder, "a.json", "fifth\n", 2)
    put(folder, "c.json", "", 3)
    put(folder, "_hidden", "no\n", 0)
    put(folder, "d.json", "".join(f"line {i}\n" for i in range(500)), 4)
    return folder


def test_places_do_not_depend_on_the_splits(spark, folder):
    whole = read_raw(spark, folder, fmt="text")
    expected = ["first", "second é", "", "fourth", "fifth", *[f"line {i}" for i in range(500)]]
    assert [v for _, v in rows(whole)] == expected
    for split_bytes in (1, 7, 64, 100_000):
        cut = read_raw(spark, folder, fmt="lines", options={"split_bytes": str(split_bytes)})
        assert rows(cut) == rows(whole)
    assert read_raw(spark, folder, fmt="lines", options={"split_bytes": "500"}).rdd.getNumPartitions() >= 9
    assert {r.value: r.timestamp.second for r in whole.where("value IN ('first', 'fifth')").collect()} == {"first": 1, "fifth": 2}
    assert rows(read_raw(spark, f"{folder}/a.json", fmt="lines"))[0][1] == "fifth"
    with pytest.raises(Exception, match="(?i)notfound|no such|nowhere"):
        read_raw(spark, f"{folder}/nowhere", fmt="lines").collect()


def test_a_stream_keeps_the_order_of_arrival(spark, folder, tmp_path):
    def read(name):
        source = read_raw(spark, folder, fmt="lines", bounded=False, options={"log": str(tmp_path / "log"), "split_bytes": "100"})
        writer = source.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c"))
        query = writer.trigger(availableNow=True).start()
        assert query.awaitTermination(90) and query.exception() is None
        return rows(spark.read.parquet(str(tmp_path / name)))

    first = read("out")
    assert first == rows(read_raw(spark, folder, fmt="text"))
    # a file of the same instant, and one that is older than all but came last, are read once and stand at the end
    put(folder, "same.json", "same\n", 4)
    put(folder, "aold.json", "old\n", 0)
    second = read("out")
    assert second[: len(first)] == first and [v for _, v in second[len(first) :]] == ["old", "same"]
    assert read("out") == second
    assert read("again") == second  # another query over the same log numbers them alike


def test_rules_of_one_instant_in_two_files(spark, tmp_path):
    rule = '{"productId":"p","productName":"n","priceRule":{"minPrice":{"amount":%d,"currency":"EUR"},"maxPrice":{"amount":9,"currency":"EUR"}}}\n'
    folder = str(tmp_path / "rules")
    put(folder, "z.json", rule % 1, 1)
    options = {"log": str(tmp_path / "log")}
    good, _ = read_events(spark, "rule", folder, fmt="lines", bounded=False, options=options)
    drain(good, tmp_path, "one")
    put(folder, "a.json", rule % 2, 1)
    good, _ = read_events(spark, "rule", folder, fmt="lines", bounded=False, options=options)
    later = drain(good, tmp_path, "two").orderBy("ts", "seq").collect()
    assert [str(r.min_price.amount) for r in later] == ["1.00", "2.00"]


def test_a_stream_of_lines_needs_a_log(spark, folder, tmp_path):
    with pytest.raises(Exception, match="log"):
        drain(read_raw(spark, folder, fmt="lines", bounded=False), tmp_path, "without")
