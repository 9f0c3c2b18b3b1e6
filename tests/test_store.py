import json

import pytest
from helpers import SHOP, entity, write
from loomstone import cli
from loomstone.errors import EntityAlreadyExists, EntityNotFound, InvalidFormat, InvalidInput, LeftDatabaseMissing, OutputExists, OutputInputCollision, RightDatabaseMissing, StorageLimit
from loomstone.operators import lifecycle
from loomstone.sources.readers import read_build_input, read_entities
from loomstone.sources.store import EntityStore, build, merge_stores
from loomstone.streaming import oplog


def ids(df):
    return sorted(r["entity_id"] for r in df.collect())


def load(spark, tmp_path, rows, name="in.json"):
    return read_entities(spark, write(tmp_path / name, rows))


def test_readers(spark, tmp_path):
    assert ids(load(spark, tmp_path, [SHOP[0] | {"unknown": 1}])) == [1]
    with pytest.raises(InvalidFormat):
        load(spark, tmp_path, [{k: v for k, v in SHOP[0].items() if k != "tags"}])
    with pytest.raises(InvalidFormat):
        load(spark, tmp_path, [SHOP[0] | {"id": 2**32}])
    b = read_build_input(spark, write(tmp_path / "b.json", [{"id": 7, "names": ["N"]}, {"id": 8, "aliases": ["A"], "tags": ["t"]}]))
    assert {r["entity_id"]: (r["aliases"], r["tags"]) for r in b.collect()} == {7: (["N"], []), 8: (["A"], ["t"])}
    t = read_entities(spark, write(tmp_path / "t.json", [entity(1, ["x"], attributes=[("a", "6"), ("b", "true"), ("c", "1.5"), ("d", "x")])]), infer_types=True)
    assert [a["vtype"] for a in t.first()["attributes"]] == ["integer", "boolean", "float", "string"]


def test_lifecycle(spark, tmp_path):
    store = EntityStore.create(spark, str(tmp_path), "db")
    store.insert(load(spark, tmp_path, SHOP))
    with pytest.raises(EntityAlreadyExists, match="already exists"):
        store.insert(load(spark, tmp_path, [entity(30, ["new"]), entity(1, ["again"])]))
    with pytest.raises(EntityAlreadyExists):
        store.insert(load(spark, tmp_path, [entity(31, ["a"]), entity(31, ["b"])]))
    with pytest.raises(EntityNotFound):
        store.update(load(spark, tmp_path, [entity(99, ["x"])]))
    with pytest.raises(EntityNotFound):
        store.remove([1, 99])
    again = EntityStore.open(spark, store.root)  # nothing flushed yet
    assert ids(again.entities()) == [1, 2, 3, 4, 10, 11, 20]
    again.update(load(spark, tmp_path, [entity(2, ["Renamed"])]))
    again.remove([4])
    again.flush()
    again.insert(load(spark, tmp_path, [entity(4, ["Back"])]))
    third = EntityStore.open(spark, store.root)
    rows = third.entities().orderBy("ord").collect()
    assert [r["entity_id"] for r in rows] == [1, 2, 3, 10, 11, 20, 4]
    assert [r["entity_id"] for r in third.search("renamed").collect()] == [2] and third.search("cola light").where("score = 1").count() == 0
    assert third.stats().first()["entities"] == 7


def test_crash_between_snapshot_and_log(spark, tmp_path):
    store = build(spark, load(spark, tmp_path, SHOP[:2]), str(tmp_path), "db")
    store.insert(load(spark, tmp_path, [entity(50, ["late"])]))
    log = f"{store.root}/log/b={store._batches()[-1]}"
    saved = spark.read.parquet(log).collect()
    schema = spark.read.parquet(log).schema
    store.flush()
    spark.createDataFrame(saved, schema).write.mode("overwrite").parquet(log)  # as if deleting it had failed
    assert ids(EntityStore.open(spark, store.root).entities()) == [1, 2, 50]
    (tmp_path / "db" / "snapshots" / "v=99").mkdir()  # an unfinished snapshot is not looked at
    assert ids(EntityStore.open(spark, store.root).entities()) == [1, 2, 50]


def test_compaction_and_limit(spark, tmp_path):
    store = build(spark, load(spark, tmp_path, [entity(i, [f"Entity {i}"]) for i in range(100)]), str(tmp_path), "db")
    store.remove(list(range(90)))
    store.flush()
    before, after = store.compact()
    assert after < before and ids(EntityStore.open(spark, store.root).entities()) == list(range(90, 100))
    tight = EntityStore.create(spark, str(tmp_path), "tight", max_segments=1)
    tight.insert(load(spark, tmp_path, SHOP[:1]))
    with pytest.raises(StorageLimit):
        tight.flush()
    with pytest.raises(InvalidFormat):
        EntityStore.open(spark, str(tmp_path / "none"))


def test_merge(spark, tmp_path):
    p = str(tmp_path)
    a = build(spark, load(spark, tmp_path, [entity(1, ["Left"]), entity(2, ["Two"])]), p, "a").root
    b = build(spark, load(spark, tmp_path, [entity(1, ["Right"]), entity(3, ["Three"], ["t"])]), p, "b").root
    for args, error in (((a, a, f"{p}/o"), InvalidInput), ((a, b, a), OutputInputCollision), ((f"{p}/x", b, f"{p}/o"), LeftDatabaseMissing), ((a, f"{p}/x", f"{p}/o"), RightDatabaseMissing)):
        with pytest.raises(error):
            merge_stores(spark, *args)
    assert merge_stores(spark, a, b, f"{p}/o") == lifecycle.MergeReport(3, 1)
    rows = {r["entity_id"]: r["aliases"] for r in EntityStore.open(spark, f"{p}/o").entities().collect()}
    assert rows == {1: ["Left"], 2: ["Two"], 3: ["Three"]}
    with pytest.raises(OutputExists, match="output"):
        merge_stores(spark, a, b, f"{p}/o")


def test_judged_and_replay_against_a_loop(spark):
    import random

    rng = random.Random(4)
    log = [(s, rng.choice(["insert", "remove", "update"]), rng.randrange(12), [f"a{s}"]) for s in range(300)]
    state, errors = {5: (-1, "start")}, {}
    for s, op, e, a in log:
        if op == "insert" and e in state:
            errors[s] = "EntityAlreadyExists"
        elif op != "insert" and e not in state:
            errors[s] = "EntityNotFound"
        elif op == "insert":
            state[e] = (s, a[0])
        elif op == "update":
            state[e] = (state[e][0], a[0])
        else:
            del state[e]
    base = spark.createDataFrame([(5, 0, ["start"])], "entity_id bigint, ord bigint, aliases array<string>")
    base = lifecycle.conform(base)
    df = spark.createDataFrame(log, "seq bigint, op string, entity_id bigint, aliases array<string>").repartition(4)
    j = lifecycle.judged(df, base)
    assert {r["seq"]: r["error"] for r in j.collect() if r["error"]} == errors
    end = lifecycle.replay(base, j.where("error is null").drop("error")).orderBy("ord").collect()
    assert [(r["entity_id"], r["aliases"][0]) for r in end] == [(e, a) for e, (_, a) in sorted(state.items(), key=lambda x: x[1][0])]


def test_stream(spark, tmp_path):
    store = build(spark, load(spark, tmp_path, SHOP[:2]), str(tmp_path), "db")
    ops = tmp_path / "ops"
    ops.mkdir()

    def put(name, rows):
        (ops / name).write_text("\n".join(json.dumps(r) for r in rows))

    def go():
        oplog.apply(store, oplog.read_operations(spark, str(ops)), str(tmp_path / "cp"), rejected=str(tmp_path / "bad")).awaitTermination()

    put("1.json", [{"seq": 1, "op": "insert", "entity_id": 70, "payload": entity(70, ["Streamed"])}, {"seq": 2, "op": "remove", "entity_id": 99}])
    go()
    put("2.json", [{"seq": 3, "op": "update", "entity_id": 70, "payload": entity(70, ["Changed"])}, {"seq": 4, "op": "remove", "entity_id": 1}])
    go()
    rows = {r["entity_id"]: r["aliases"] for r in EntityStore.open(spark, store.root).entities().collect()}
    assert rows == {2: ["Cola Light"], 70: ["Changed"]}
    (tmp_path / "db" / "log" / f"b={store._batches()[-1]}" / "_SUCCESS").unlink()  # as if the last batch had not been finished
    assert sorted(r["entity_id"] for r in store.entities().collect()) == [1, 2, 70]
    assert [(r["seq"], r["error"]) for r in spark.read.parquet(str(tmp_path / "bad/*")).collect()] == [(2, "EntityNotFound")]


def test_command_line(spark, tmp_path):
    run = lambda *a: cli.run(spark, cli.parser().parse_args(list(map(str, a))))
    run("init", tmp_path, "db")
    db = tmp_path / "db"
    assert run("insert", db, write(tmp_path / "e.json", SHOP)) == ["inserted 7"]
    assert run("search", db, "cola", "--limit", 2) == ["Fizz Cola score=1.00 [ExactAlias, FuzzyAlias, PrefixAlias, Relationship, Token]", "Brook score=1.00 [ExactAlias, FuzzyAlias, PrefixAlias, Token]"]
    assert run("inspect", db, 99, 1, "-v")[:2] == ["99: not found", "1: Fizz Cola, Cola"]
    assert "Entities: 7" in run("stats", db)
    with pytest.raises(InvalidInput):
        run("update", db, 3, "--input", write(tmp_path / "u.json", [entity(1, ["x"])]))
    assert run("update", db, 1, "--input", tmp_path / "u.json") == ["updated 1"] and run("remove", db, 4) == ["removed 1"]
    assert run("compact", db)[0].startswith("before") and run("search", db, "nobody") == ["no results"]
    run("build", tmp_path, "other", "--input", write(tmp_path / "b.json", [{"id": 1, "names": ["N"]}, {"id": 500, "names": ["M"]}]))
    assert run("merge", db, tmp_path / "other", tmp_path / "all") == ["entities added: 7", "entities skipped: 1"]
