"""Versions of tables: pinned readers, two writers, compaction and cleaning."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import snapshots as N
from docloom.operators import store as S


def chunks(spark, rows):
    return spark.createDataFrame([(f"{name}:{i}", text, name) for name, texts in rows.items() for i, text in enumerate(texts)], "id string, text string, doc_name string")


def texts(df):
    return sorted((r.doc_name, r.text) for r in df.collect())


def test_readers_keep_their_version(spark, tmp_path):
    store = S.ChunkStore(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.chunks().count() == 0
    store.write_documents(chunks(spark, {"a": ["1", "2"], "b": ["3"]}))
    pinned = store.chunks()  # not run yet
    store.write_documents(chunks(spark, {"a": ["4"], "c": ["5"]}))
    store.delete_documents(chunks(spark, {"b": ["-"]}))
    assert texts(pinned) == [("a", "1"), ("a", "2"), ("b", "3")]
    assert texts(store.chunks(2)) == [("a", "4"), ("b", "3"), ("c", "5")]
    assert texts(store.chunks()) == [("a", "4"), ("c", "5")] and store.version() == 3
    with pytest.raises(N.NoVersion):
        store.chunks(4)


def test_a_rebuild_is_seen_at_once(spark, tmp_path):
    """While an index run is building, readers see the version before; afterwards chunks and manifest agree."""
    store = S.ChunkStore(spark, str(tmp_path / "s"))
    files = lambda *names: spark.createDataFrame([(f"d/{n}", n, n + tag) for n, tag in names], "identity string, name string, hash string")
    build = lambda f: f.select(F.concat("name", F.lit(":0")).alias("id"), F.col("name").alias("doc_name"), F.col("hash").alias("text"))
    store.index(files(("a", "1"), ("b", "1")), build)
    seen = []

    def slow(f):
        seen.append((store.version(), texts(store.chunks()), store.manifest().count()))
        return build(f)

    store.index(files(("a", "2"), ("c", "1")), slow, force=True)
    assert seen == [(1, [("a", "a1"), ("b", "b1")], 2)]
    assert texts(store.chunks()) == [("a", "a2"), ("c", "c1")] and store.manifest().count() == 2 and store.version() == 2

    def broken(f):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        store.index(files(("a", "3")), broken)
    assert store.version() == 2


def test_two_writers_one_tries_again(spark, tmp_path):
    store, other = (S.ChunkStore(spark, str(tmp_path / "s")) for _ in range(2))
    store.write_documents(chunks(spark, {"a": ["1"], "b": ["1"]}))
    attempts = []
    real = store._replacing

    def slowly(base, *rest):
        change = real(base, *rest)
        if not attempts:  # another writer commits in between: the same file is rewritten
            other.write_documents(chunks(spark, {"b": ["2"]}))
        attempts.append(base.version)
        return change

    store._replacing = slowly
    store.write_documents(chunks(spark, {"a": ["3"]}))
    assert attempts == [1, 2] and texts(store.chunks()) == [("a", "3"), ("b", "2")]


def test_writers_of_other_documents_do_not_conflict(spark, tmp_path):
    log = N.SnapshotLog(spark, str(tmp_path / "s"))
    files = [{f"data/x/{i}.parquet": 1} for i in range(4)]
    assert log.commit(0, N.Change({"t": files[0]}, {}, frozenset({1}))) == 1
    assert log.commit(0, N.Change({"t": files[1]}, {}, frozenset({2}))) == 2
    for change in (N.Change({"t": files[2]}, {}, frozenset({1, 3})), N.Change({"t": files[2]}, {}, None), N.Change({}, {"t": list(files[0])}, frozenset({2}))):
        with pytest.raises(N.Conflict):
            log.commit(0, change)
    assert log.commit(2, N.Change({}, {"t": list(files[0])}, frozenset())) == 3
    with pytest.raises(N.Conflict):  # the file is gone already
        log.commit(2, N.Change({}, {"t": list(files[0])}, frozenset()))
    assert set(log.snapshot().files["t"]) == set(files[1]) and set(log.snapshot(2).files["t"]) == {*files[0], *files[1]}


def test_checkpoints_compaction_and_vacuum(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "CHECKPOINT", 3)
    store = S.ChunkStore(spark, str(tmp_path / "s"))
    for i in range(7):
        store.write_documents(chunks(spark, {f"d{i}": [str(i)]}))
    assert [store.chunks(v).count() for v in range(8)] == list(range(8))
    before = texts(store.chunks())
    assert store.compact() == 8 and texts(store.chunks()) == before and len(store.log.snapshot().files["chunks"]) < len(store.log.snapshot(7).files["chunks"])
    assert store.log.vacuum(keep=1, older=3600) == 0 and store.chunks(8).count() == 7
    assert store.log.vacuum(keep=1, older=-10) == 7 and texts(store.chunks()) == before
    with pytest.raises(N.NoVersion):
        store.chunks(3)
    store.write_documents(chunks(spark, {"d0": ["new"]}))
    assert store.version() == 9 and ("d0", "new") in texts(store.chunks()) and [v for v, _, _ in store.log.history()] == [8, 9]


def test_one_document_rewrites_few_files(spark, tmp_path):
    store = S.ChunkStore(spark, str(tmp_path / "s"))
    for part in range(6):
        store.write_documents(chunks(spark, {f"d{part}-{i}": ["x"] * 5 for i in range(20)}))
    whole = set(store.log.snapshot().files["chunks"])
    store.write_documents(chunks(spark, {"d3-7": ["y"]}))
    assert len(whole - set(store.log.snapshot().files["chunks"])) == 1
    assert store.chunks().count() == 6 * 100 - 4
