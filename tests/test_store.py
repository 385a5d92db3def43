"""The commit log, snapshots, the stream into it and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from siftwell.__main__ import main
from siftwell.operators.ranked import ranked
from siftwell.sources import store
from siftwell.sources.store import Engine
from siftwell.streaming import ingest


def titles(df):
    return sorted(json.loads(r.data)["title"] for r in df.collect())


def test_reopen(spark, tmp_path):
    path = str(tmp_path)
    Engine(spark, path).add({"title": "hello world"}, {"title": "once", "n": 3})
    for _ in range(2):
        e = Engine(spark, path)
        assert e.live().count() == 2
    assert e.collection().words(["hello"]).count() == 1
    assert e.query("n >= 3 OR x = once").count() == 2
    assert e.stats().first().n_docs == 2


def test_versions(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    a, b = e.add({"title": "a"}, {"title": "b"})
    mark = e.last_commit_id()
    e.update(a, {"title": "a2"})
    e.delete(b, "nobody")
    assert titles(e.live()) == ["a2"] and titles(e.as_of(mark)) == ["a", "b"] and titles(e.as_of(0)) == []
    before = e.commits.count()
    e.rollback_to(mark)
    assert titles(e.live()) == ["a", "b"] and e.commits.count() > before
    assert e.collection(mark).words(["b"]).count() == 1
    with pytest.raises(ValueError):
        e.add({"x": {"": 1}})
    assert e.get(a).count() == 1


def test_snapshots(spark, tmp_path):
    e = Engine(spark, str(tmp_path), snapshot_every=5, slots=2)
    ids = []
    for i in range(4):
        ids += e.add(*[{"title": f"d{3 * i + k}"} for k in range(3)])
    e.delete(ids[0])
    assert e._meta()["slot"] == 2
    assert titles(e.live()) == sorted(f"d{i}" for i in range(1, 12)) == titles(store.live(e.commits))
    e.snapshot()
    assert e._meta() == {"slot": 1, "commit_id": e.last_commit_id()}
    e.delete(ids[1])
    assert len(titles(e.live())) == 10
    (tmp_path / "snapshots" / "meta.json").write_text("broken")
    (tmp_path / "snapshots" / ".meta.json.crc").unlink(missing_ok=True)
    assert len(titles(e.live())) == 10  # from the log alone


def test_tables_and_depth(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    df = spark.range(50).select("id", F.concat(F.lit("t"), "id").alias("title"), F.struct(F.col("id").alias("n")).alias("s"))
    e.add_table(df, "id")
    e.add({"a": {"b": "deep"}, "c": "flat"}, ids=["x"], max_depth=0)
    c = e.collection()
    assert c.words(["t7"]).first().doc_id == "7" and c.gte("n", 48).count() == 2
    assert c.words(["flat"]).count() == 1 and c.words(["deep"]).count() == 0
    (tmp_path / "more.jsonl").write_text('{"title": "line one"}\n\n[1]\n{"title": "line two"}\n')
    e.add_json_lines(str(tmp_path / "more.jsonl"))
    assert e.collection().words(["line"]).count() == 2


def test_stream(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"))
    src = tmp_path / "in"
    src.mkdir()
    changes = spark.readStream.schema("op string, doc_id string, data string, ts timestamp").json(str(src))
    for k, rows in enumerate([[("add", "1", '{"title": "one"}'), ("add", "2", '{"title": "two"}')], [("delete", "1", None), ("add", "3", '{"title": "three"}')]]):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"op": o, "doc_id": i, "data": d, "ts": f"2024-01-01T00:0{k}:00"}) for o, i, d in rows))
        ingest.ingest(changes, e, str(tmp_path / "ck"), available_now=True).awaitTermination()
    e.add({"title": "four"})
    assert titles(e.live()) == ["four", "three", "two"]
    q = ingest.windowed_counts(changes).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.op, r.n) for r in spark.table("counts").collect()} == {("add", 3), ("delete", 1)}


def test_ranked(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(6)
    got = ranked(df, [F.col("v").desc()]).collect()
    assert sorted((r["rank"], r.v) for r in got) == [(i + 1, 999 - i) for i in range(1000)]


def test_command_line(spark, tmp_path, capsys):
    f = tmp_path / "docs.json"
    f.write_text(json.dumps([{"title": "Red Lamp", "stats": {"hp": 35}}, 5, {"title": "blue lamp", "stats": {"hp": 60.5}}]))
    path = ["--path", str(tmp_path / "e")]

    def say(*args):
        main([*path, *args], spark)
        return capsys.readouterr().out.split()

    a, b = say("add", str(f))
    assert sorted(say("query", "words", "lamp")) == sorted([a, b])
    assert say("query", "and", "lamp", "red") == [a] and say("query", "not", "red") == [b]
    assert say("query", "gt", "hp", "59") == [b, "stats.hp"] and say("query", "lt", "hp", "36") == [a, "stats.hp"]
    assert say("query", "range", "stats.hp", "30", "40") == [a, "stats.hp"] and say("query", "between", "hp", "60", "70") == [b, "stats.hp"]
    assert say("query", "lang", "x = lamp SORT BY ((hp DESC))") == [b, a]
    assert say("query", "ngram-bm25", "redd")[:1] == [a]
    assert say("query", "get", a)[0] == a
    say("delete", a)
    assert say("query", "words", "lamp") == [b]
    assert "'n_docs':" in say("stats")[0]


def test_rollback_brings_depth_limits_back(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.add({"a": {"b": "deep"}}, ids=["x"])
    mark = e.last_commit_id()
    e.update("x", {"a": {"b": "deep"}}, max_depth=0)
    assert e.collection().words(["deep"]).count() == 0
    e.rollback_to(mark)
    assert e.collection().words(["deep"]).count() == 1


def test_every_way_of_writing_validates_and_makes_snapshots(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), snapshot_every=2)
    (tmp_path / "a.jsonl").write_text('{"title": "one"}\n{"title": {"": 1}}\n{"title": "two"}\n{broken\n')
    e.add_json_lines(str(tmp_path / "a.jsonl"))
    assert titles(e.live()) == ["one", "two"] and e._meta()["slot"] == 1
    with pytest.raises(ValueError):
        e.add_table(spark.range(2).select("id", F.struct(F.lit(1).alias("")).alias("s")), "id")
    e.add({"title": "three"}, {"title": "four"})
    slot = e._meta()["slot"]
    e.rollback_to(2)
    assert titles(e.live()) == ["one", "two"] == titles(store.live(e.commits)) and e._meta()["slot"] != slot
    (tmp_path / "e" / "snapshots" / "meta-99999999999999999999.json").write_text("broken")
    assert titles(e.live()) == ["one", "two"]  # by the pointer before


def test_very_deep_documents(spark):
    """What the parser can't follow has no leaves; what it can is flattened at any depth."""
    from siftwell.operators.flatten import json_leaves

    deep = lambda n: '{"a":' * n + "1" + "}" * n
    df = spark.createDataFrame([(1, deep(400)), (2, deep(200_000)), (3, '{"b": [' + "[" * 300 + "2" + "]" * 300 + "]}")], "id int, data string")
    got = {r.doc_id: [x.depth for x in r.leaves] for r in json_leaves(df, "id", "data").collect()}
    assert got == {1: [399], 2: [], 3: [301]}
