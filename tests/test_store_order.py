"""Order of insertion over batches and stores, index frames kept with the store, and predicates that reach their scans."""

import pytest
from helpers import SHOP, entity, write
from loomstone import cli
from loomstone.corpus import INDEXES
from loomstone.errors import InvalidInput
from loomstone.functions.text import as_datetime, format_bytes, timestamp_now
from loomstone.operators.search import fuzzy_pairs, search
from loomstone.sources.readers import read_entities
from loomstone.sources.scratch import numbered
from loomstone.sources.store import EntityStore, build, merge_stores
from pyspark.sql import functions as F


def load(spark, tmp_path, rows, name="in.json"):
    return read_entities(spark, write(tmp_path / name, rows))


def in_order(store):
    return [r["entity_id"] for r in store.entities().orderBy("ord").collect()]


def test_order_of_batches_survives_a_merge(spark, tmp_path):
    left = EntityStore.create(spark, str(tmp_path), "left")
    left.insert(load(spark, tmp_path, [entity(50, ["a"]), entity(60, ["b"])]))
    left.insert(load(spark, tmp_path, [entity(10, ["c"]), entity(20, ["d"])], "in2.json"))
    right = EntityStore.create(spark, str(tmp_path), "right")
    right.insert(load(spark, tmp_path, [entity(99, ["e"]), entity(10, ["f"])], "in3.json"))
    assert in_order(left) == [50, 60, 10, 20]
    merge_stores(spark, left.root, right.root, str(tmp_path / "both"))
    assert in_order(EntityStore.open(spark, str(tmp_path / "both"))) == [50, 60, 10, 20, 99]


def test_places_from_many_partitions_do_not_wrap(spark, tmp_path):
    ids = [entity(i, [f"e {i}"]) for i in range(40)]
    store = EntityStore.create(spark, str(tmp_path), "db")
    far = load(spark, tmp_path, ids).withColumn("ord", F.col("ord") * F.lit(1 << 45))  # as of very many partitions
    store.insert(far)
    store.insert(load(spark, tmp_path, [entity(1000, ["last"])], "in2.json"))
    assert in_order(store) == [*range(40), 1000]
    rows = numbered(spark.range(100).select((F.lit(99) - F.col("id")).alias("v")).repartition(7), str(tmp_path / "n"), "place", "v").collect()
    assert sorted((r["v"], r["place"]) for r in rows) == [(i, i) for i in range(100)]


def found(df):
    return sorted((r["entity_id"], r["score"], tuple(r["sources"])) for r in df.collect())


def test_indexes_are_kept_and_follow_the_log(spark, tmp_path):
    store = build(spark, load(spark, tmp_path, SHOP), str(tmp_path), "db", index_from=0)
    assert set(INDEXES) <= set(store.files.names(f"{store.root}/indexes/v=1"))
    assert all("/indexes/v=1/" in f for f in store.corpus().aliases.inputFiles())
    store.update(load(spark, tmp_path, [entity(2, ["Renamed Drink"], ["water"])], "u.json"))
    store.remove([4])
    store.insert(load(spark, tmp_path, [entity(70, ["Cola Seventy"], relationships=[("MadeBy", 10)])], "i.json"))
    from loomstone.corpus import Corpus

    for q in ("cola", "renamed", "water", "aurora", "volume", "brand=acme", ""):
        assert found(store.search(q)) == found(search(Corpus(store.entities()), q)), q
    store.flush()
    assert found(store.search("seventy")) == [(70, 0.4, ("Token",))] and found(store.search("renamed"))[0][0] == 2
    store.compact()
    assert store.files.names(f"{store.root}/indexes") == store.files.names(f"{store.root}/snapshots")


@pytest.mark.parametrize("query, signal, pushed", [("cola", "ExactAlias", "EqualTo(alias,cola)"), ("col", "PrefixAlias", "StringStartsWith(alias,col)"), ("water", "Token", "EqualTo(token,water)"), ("acme", "AttributeValue", "EqualTo(term,acme)"), ("brand=acme", "AttributeKeyValue", "EqualTo(pair,brand:acme)")])
def test_literals_reach_the_scan(spark, tmp_path, query, signal, pushed):
    corpus = build(spark, load(spark, tmp_path, SHOP), str(tmp_path), "db", index_from=0).corpus()
    plan = search(corpus, query, signals=(signal,))._jdf.queryExecution().toString()
    assert pushed in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert search(corpus, query, signals=(signal,)).count() > 0


def test_batches_at_distance_two(spark):
    words = ["", "a", "b", "ab", "ba", "abc", "cab", "abcd", "dcba", "naïve", "nave", "日本語", "本日"]
    a = spark.createDataFrame([(w,) for w in words], "alias string")
    q = spark.createDataFrame(list(enumerate(words)), "query_id bigint, q string")
    for d in (0, 1, 2):
        assert sorted(map(tuple, fuzzy_pairs(a, q, True, d).collect())) == sorted(map(tuple, fuzzy_pairs(a, q, False, d).collect()))
    with pytest.raises(InvalidInput):
        fuzzy_pairs(a, q, False, 3)


def test_small_snapshots_have_no_index_frames(spark, tmp_path):
    store = build(spark, load(spark, tmp_path, SHOP), str(tmp_path), "db")
    assert store.files.names(f"{store.root}/indexes") == [] and store.search("aurora").count() > 0


def test_pending_log_is_flushed_when_it_is_large(spark, tmp_path):
    store = EntityStore.create(spark, str(tmp_path), "db", max_segment_size=1)
    store.insert(load(spark, tmp_path, SHOP[:2]))
    assert store._current()[0] == 0
    store.remove([2])
    assert store._current()[0] == 1 and in_order(store) == [1]


def test_store_at_a_path_and_explained_search(spark, tmp_path):
    store = EntityStore.at(spark, str(tmp_path / "own"))
    store.insert(load(spark, tmp_path, SHOP))
    assert in_order(EntityStore.at(spark, str(tmp_path / "own"))) == [e["id"] for e in SHOP]
    run = lambda *a: cli.run(spark, cli.parser().parse_args(list(map(str, a))))
    lines = run("search", store.root, "brook", "-e")
    assert lines[:2] == ["Brook score=1.00 [ExactAlias, FuzzyAlias, PrefixAlias, Token]", "  ExactAlias: term=brook"] and "  Relationship: term=madeby, target=11" in lines


def test_sizes_and_dates():
    assert [format_bytes(n) for n in (0, 1023, 1024, 1536, 1 << 20, 5 << 40, 3 << 50)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 TB", "3072.0 TB"]
    assert abs(as_datetime(timestamp_now()).timestamp() * 1000 - timestamp_now()) < 10_000 and as_datetime(0).year == 1970
