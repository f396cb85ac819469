"""Round trips of sources and sinks, and a stream of repeated deliveries."""

from __future__ import annotations

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from tessera.operators.provenance import config_hash, pinned_versions, routed_path, stable_repr
from tessera.sources import records, results
from tessera.streaming import scorer


def _record(ident: int) -> str:
    return f"1\ngdb {ident}\t" + "\t".join(["1.0"] * 15) + "\nC\t0\t0\t0\t0\n1.0\nC\tC\nI\tI\n"


def test_archive_to_table(spark, tmp_path):
    with tarfile.open(tmp_path / "raw.tar.bz2", "w:bz2") as archive:
        for name, text in (("set_000001.xyz", _record(1)), ("set_000002.xyz", _record(3)), ("set_000004.xyz", "broken")):
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    table, failures = records.build_table(records.tar_members(spark, str(tmp_path / "raw.tar.bz2")))
    assert [r.id for r in table.collect()] == [1]
    assert {r.member: r.error for r in failures.collect()} == {"set_000002.xyz": "id differs from file number", "set_000004.xyz": "short record"}
    records.write_table(table, str(tmp_path / "table"))
    assert records.table_is_current(spark, str(tmp_path / "table")) and not records.table_is_current(spark, str(tmp_path / "none"))


def test_checksums(tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes(b"abc")
    good = records.RawFile("a.txt", 3, records.file_digest(path))
    assert records.fetch(good, tmp_path, "file:///nowhere") == path
    with pytest.raises(records.ChecksumError):
        records.verify(path, records.RawFile("a.txt", 4, good.md5))
    with pytest.raises(records.ChecksumError):
        records.verify(path, records.RawFile("a.txt", 3, "0" * 32))


def test_split_files_round_trip(spark, tmp_path):
    members = spark.createDataFrame([("pool", 1, "CH4"), ("dev", 2, "H2O")], "set_name string, id bigint, formula string")
    order = spark.createDataFrame([(0, 0, 1, True)], "seed int, pos bigint, id bigint, is_anchor boolean")
    results.save_splits(members, order, str(tmp_path), {"split_seed": 7})
    got, fill, meta = results.load_splits(spark, str(tmp_path))
    assert got.select("set_name", "id", "formula").exceptAll(members).count() == 0 and fill.count() == 1
    assert meta["config_hash"] == config_hash({"split_seed": 7})


def test_id_list_and_runs(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("heading\n 12 x\n12x\n7\n\n")
    assert {r.id for r in records.read_id_list(spark, str(tmp_path / "ids.txt")).collect()} == {7, 12}
    assert results.next_run_number(None) == 1
    assert results.next_run_number(spark.createDataFrame([(3,)], "run int")) == 4


def test_provenance(tmp_path):
    assert config_hash({"b": 1, "a": (2,)}) == config_hash({"a": [2], "b": 1})
    assert stable_repr(object()) == "<object object>"
    assert routed_path(tmp_path, "q_x", [("p", "one"), ("q_", "two"), ("q", "three")]) == tmp_path / "two" / "q_x" and (tmp_path / "two").is_dir()
    assert routed_path(tmp_path, "z", []) == tmp_path / "z"
    assert pinned_versions("a==1.0\n# c\nb>=2\n") == {"a": "1.0"}


def test_stream_counts_each_delivery_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 5.0)], "id bigint, y double").withColumn("at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = scorer.read_records(spark, str(tmp_path / "in"), "id bigint, y double, at timestamp")
    once = scorer.score(scorer.deliveries_once(stream, ["id"], "at"), F.lit(1.0))
    query = once.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("seen").count() == 2
