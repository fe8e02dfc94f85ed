"""Commits under crashes and several writers: nothing lost, nothing twice."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestrata.engine import Engine
from lodestrata.functions.names import EngineError
from lodestrata.operators import incremental
from lodestrata.sources.files import Files
from lodestrata.sources.version_log import Store

ROWS = "row_key string, row_value string"


def state(e):
    return sorted(tuple(r) for r in e.store.state("kv").select("row_key", "row_value").collect())


def feed(spark, root):
    """(seq, key) of the log by batch and by stream."""
    stream = spark.readStream.schema("seq long, row_key string").option("recursiveFileLookup", "true").parquet(f"{root}/log")
    stream.writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.seq, r.row_key) for r in spark.table("seen").select("seq", "row_key").collect())


def test_one_of_two_creates_wins(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    files.create("a/x", "one")
    with pytest.raises(FileExistsError):
        files.create("a/x", "two")
    assert files.read("a/x") == "one" and files.names("a") == ["x"]


def test_creates_without_hard_links(spark, tmp_path, monkeypatch):
    import os

    def refuse(*_):
        raise PermissionError

    monkeypatch.setattr(os, "link", refuse)
    files = Files(spark, str(tmp_path))
    files.create("a/x", "öne\n")
    with pytest.raises(FileExistsError):
        files.create("a/x", "two")
    assert files.read("a/x") == "öne\n"


def test_a_second_writer_is_refused_and_then_up_to_date(spark, tmp_path):
    root = str(tmp_path / "db")
    one, two = Engine(spark, root), Engine(spark, root)
    one.put("kv", "a", "1")
    for write in (lambda: two.put("kv", "b", "2"), lambda: two.store.put_rows("kv", spark.createDataFrame([("b", "2")], ROWS))):
        stale = two.store.sequence
        if stale:
            one.put("kv", "c", "3")
        with pytest.raises(EngineError) as e:
            write()
        assert e.value.status == 409 and two.store.sequence > stale
        write()
        one.store._load()
    # Commits that were moved to the log meanwhile have no record any more; the log itself refuses them.
    third = Engine(spark, root)
    one.put("kv", "d", "4")
    one.store.flush()
    with pytest.raises(EngineError):
        third.put("kv", "lost", "x")
    third.put("kv", "e", "5")
    third.store.flush()
    want = [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5")]
    assert state(third) == state(Engine(spark, root)) == want
    found = feed(spark, root)
    assert [s for s, _ in found] == list(range(1, len(found) + 1)) and {k for _, k in found} == set("abcde")


def test_two_flushes_of_the_same_commits(spark, tmp_path):
    root = str(tmp_path / "db")
    one = Engine(spark, root)
    one.put("kv", "a", "1")
    two = Engine(spark, root)
    one.put("kv", "b", "2")
    one.store.flush()
    two.store.flush()
    assert state(two) == [("a", "1"), ("b", "2")] and len(two.store._parts()) == 1


@pytest.mark.parametrize("at", ["flush", "bulk"])
def test_a_crash_between_record_and_move(spark, tmp_path, monkeypatch, at):
    root = str(tmp_path / "db")
    e = Engine(spark, root)
    e.put("kv", "a", "1")
    if at == "bulk":
        e.store.flush()

    def crash(old, new):
        raise KeyboardInterrupt

    monkeypatch.setattr(e.store.files, "move", crash)
    with pytest.raises(KeyboardInterrupt):
        e.store.flush() if at == "flush" else e.store.put_rows("kv", spark.createDataFrame([("b", "2")], ROWS))
    again = Engine(spark, root)
    want = [("a", "1")] if at == "flush" else [("a", "1"), ("b", "2")]
    assert state(again) == want
    again.put("kv", "z", "9")
    again.store.flush()
    assert state(Engine(spark, root)) == [*want, ("z", "9")]
    assert [s for s, _ in feed(spark, root)] == list(range(1, len(want) + 2))


def test_a_broken_record_does_not_stop_later_commits(spark, tmp_path):
    root = tmp_path / "db"
    e = Engine(spark, str(root))
    e.put("kv", "a", "1")
    e.put("kv", "b", "2")
    last = sorted((root / "wal").glob("*.json"))[-1]
    last.write_text(last.read_text()[:-3])
    again = Engine(spark, str(root))
    again.put("kv", "c", "3")
    again.put("kv", "d", "4")
    assert state(Engine(spark, str(root))) == [("a", "1"), ("c", "3"), ("d", "4")] and len(list((root / "bad").iterdir())) == 1


@pytest.mark.parametrize("crash_at", ["decision", "committing", "commit", "committed", "flushed"])
def test_prepared_commits_at_every_step(spark, tmp_path, monkeypatch, crash_at):
    root = str(tmp_path / "db")
    e = Engine(spark, root)
    tx = e.begin()
    e.put("kv", "mine", "1", tx)
    e.prepare_commit(tx)
    create = e.store.files.create

    def crashing(name, text):
        if name.endswith("." + crash_at) or (crash_at == "commit" and name.startswith("wal/")):
            raise KeyboardInterrupt
        create(name, text)

    monkeypatch.setattr(e.store.files, "create", crashing)
    if crash_at == "flushed":
        e.commit_prepared(tx)
    else:
        with pytest.raises(KeyboardInterrupt):
            e.commit_prepared(tx)
    other = Store(spark, root)  # a writer that does not look at the journal
    other.commit([("kv", "other", "2", False)])
    if crash_at == "flushed":
        other.flush()
    again = Engine(spark, root)
    if crash_at == "decision":
        assert again.prepared_state(tx) == "prepared"
    last = again.commit_prepared(tx)
    assert again.commit_prepared(tx) == last and again.prepared_state(tx) == "committed"
    assert state(again) == [("mine", "1"), ("other", "2")] and again.store.log().where(F.col("row_key") == "mine").count() == 1
    with pytest.raises(EngineError):
        again.abort_prepared(tx)


def test_an_aborted_transaction_is_not_committed(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    tx = e.begin()
    e.put("kv", "a", "1", tx)
    e.prepare_commit(tx)
    e.store.files.create(f"journal/{tx}.decision", "abort")
    again = Engine(spark, str(tmp_path / "db"))
    with pytest.raises(EngineError):
        again.commit_prepared(tx)
    assert state(again) == [] and again.prepared_state(tx) == "aborted"


def test_batches_are_read_only_when_committed(spark, tmp_path, monkeypatch):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "a.txt").write_text("one")
    manifest = incremental.Manifest(spark, str(tmp_path / "m"))
    listing = incremental.list_files(spark, str(inbox))

    def process(units):
        return units.select("unit")

    def crash(*a, **k):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(manifest, "commit", crash)
        with pytest.raises(KeyboardInterrupt):
            incremental.run_batch(spark, listing, manifest, "b1", out, process)
    assert incremental.committed_output(spark, manifest, out) is None
    assert incremental.run_batch(spark, listing, manifest, "b2", out, process)
    assert incremental.committed_output(spark, manifest, out).count() == 1
    assert incremental.run_batch(spark, listing, manifest, "b1", out, process)  # commits that nothing was left
    assert incremental.committed_output(spark, manifest, out).count() == 1


def test_of_two_runs_with_the_same_plan_one_commits(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "a.txt").write_text("one")
    one, two = (incremental.Manifest(spark, str(tmp_path / "m")) for _ in range(2))

    def meanwhile(units):
        incremental.run_batch(spark, incremental.list_files(spark, str(inbox)), two, "b2", out, lambda u: u.select("unit"))
        return units.select("unit")

    with pytest.raises(RuntimeError):
        incremental.run_batch(spark, incremental.list_files(spark, str(inbox)), one, "b1", out, meanwhile)
    assert incremental.committed_output(spark, one, out).count() == 1 and one.read().count() == 1
    assert json.loads(one.files.read("committed/000000000001.json"))["batch_id"] == "b2"


def test_a_damaged_page_is_found(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.store.put_rows("kv", spark.range(2000).selectExpr("cast(id AS string) AS row_key", "sha2(cast(id AS string), 256) AS row_value"))
    part = max((p for p in (tmp_path / "db" / "log").rglob("*.parquet")), key=lambda p: p.stat().st_size)
    assert e.store.state("kv").agg(F.max("row_value")).first()[0]
    data = bytearray(part.read_bytes())
    chunk = next(c for c in map(pq.ParquetFile(part).metadata.row_group(0).column, range(7)) if c.path_in_schema == "row_value")
    at = chunk.data_page_offset + chunk.total_compressed_size // 2
    data[at : at + 8] = bytes(255 - b for b in data[at : at + 8])
    part.write_bytes(data)
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt|FAILED_READ_FILE"):
        Engine(spark, str(tmp_path / "db")).store.state("kv").agg(F.max("row_value"), F.max("row_key")).collect()


def test_a_client_tries_again(spark, tmp_path):
    from lodestrata.client import Client

    root, pauses = str(tmp_path / "db"), []
    one, two = Client(Engine(spark, root)), Client(Engine(spark, root), pause=pauses.append)
    one.put("a", "1")
    two.put("b", "2")
    assert len(pauses) == 1 and two.range() == [("a", "1"), ("b", "2")]
    one.engine.store._load()
    with two.begin() as tx:
        tx.put("c", "3")
        one.put("d", "4")
    assert [r.row_key for r in two.changes()] == ["a", "b", "d", "c"] == [r.row_key for r in two.follow(polls=1)]
    with pytest.raises(ZeroDivisionError), two.begin() as tx:
        tx.put("e", "5")
        raise ZeroDivisionError
    assert two.get("e") is None
    with pytest.raises(EngineError):
        two.execute("FLY")
    repeatable = two.begin("REPEATABLE READ")
    assert repeatable.get("a") == "1"
    repeatable.put("a", "9")
    one.engine.store._load()
    one.put("a", "2")
    with pytest.raises(EngineError):
        repeatable.commit()
    assert Client(Engine(spark, root)).get("a") == "2"
    prepared = two.begin()
    prepared.put("p", "1")
    prepared.prepare()
    prepared.commit_prepared()
    assert prepared.state() == "committed" and two.get("p") == "1"
