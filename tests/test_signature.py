"""Signatures that follow changes, against signing everything anew."""

import hashlib

from docloom.operators import signature as G

SCHEMA = "id long, h string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_following_equals_signing_anew(spark):
    before = [(i, f"h{i}") for i in range(300)] + [(None, "x"), (7, None), (7, "h7")]
    added, removed = [(900, "new"), (5, "changed"), (7, None)], [(5, "h5"), (None, "x"), (299, "h299")]
    after = [r for r in before if r not in removed] + added
    parts = {n: G.signature_parts(spark.createDataFrame(v, SCHEMA), "id", "h") for n, v in (("before", before), ("added", added), ("removed", removed), ("after", after))}
    followed = G.follow(parts["before"], parts["added"], parts["removed"])
    assert rows_of(followed) == rows_of(parts["after"])
    assert rows_of(G.root(followed)) == rows_of(G.root(parts["after"])) != rows_of(G.root(parts["before"]))
    part = lambda k: hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:2]
    assert {r.part for r in G.differing_parts(parts["before"], parts["after"]).collect()} == {part(k) for k, _ in added + removed}
    assert G.differing_parts(parts["after"], followed).isEmpty()


def test_order_does_not_matter_but_multiplicity_does(spark):
    rows = [(i, "h") for i in range(50)]
    sign = lambda r: rows_of(G.root(G.signature_parts(spark.createDataFrame(r, SCHEMA), "id", "h")))
    assert sign(rows) == sign(rows[::-1]) != sign(rows + rows[:1])
    assert sign([(1, None)]) != sign([(1, "n")]) and sign([])[0][1] == 0


def test_only_new_files_are_read(spark, tmp_path):
    table, own = str(tmp_path / "t"), G.FileSignatures(spark, str(tmp_path / "cache"))
    write = lambda rows, mode: spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode(mode).parquet(table)
    write([(1, "a"), (2, "b")], "overwrite")
    first = own.sign(table, "id", "sha2(text, 256)")
    assert first[1:] == (2, 1) and own.sign(table, "id", "sha2(text, 256)") == (first[0], 2, 0)
    write([(3, None)], "append")
    second = own.sign(table, "id", "sha2(text, 256)")
    assert second[1:] == (3, 1) and second[0] != first[0]
    whole = G.signature_parts(spark.read.parquet(table).selectExpr("id", "sha2(text, 256) as h"), "id", "h")
    assert rows_of(G.root(whole)) == [(second[0], 3)]
