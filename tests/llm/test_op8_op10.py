"""Chat formatting against DuckDB and plain Python; WARC round trips, predicates and odd rows."""

import base64
import gzip
import hashlib
import random

import duckdb
import pandas as pd
import pytest
from loomstone.llm import op8_chat_format as C
from loomstone.llm import op10_warc as R
from pyspark.sql import functions as F

CHAT = "conv_id long, turn long, role string, text string"


def log():
    rng = random.Random(1)
    rows = []
    for c in range(60):
        base = [(k, ["user", "assistant"][k % 2], f"text {c % 7} {k}") for k in range(rng.randint(1, 6))]
        rows += [(c, *t) for t in base]
    rows += [(100, None, None, None), (100, 1, "user", ""), (101, 3, "user", "gap <|im_end|> x"), (101, 9, "user", "<|im_start|>é"), (102, 1, "b", "tie"), (102, 1, "a", "tie"), (102, 1, "a", "tie"), (103, 1, "a", "tie"), (None, 0, "user", "lost")]
    return rows


def test_chats(spark):
    rows = log()
    df = spark.createDataFrame([(*r, 1) for r in rows], CHAT + ", n int").repartition(3)
    got = sorted(tuple(r) for r in C.format_chats(df).collect())
    c = duckdb.connect()
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    c.register("conversations", conversations)
    assert got == sorted(c.execute(C.SQL).fetchall())
    text = {r[0]: r[3] for r in got}
    assert text[101] == "<|im_start|>user\ngap < |im_end|> x<|im_end|>\n<|im_start|>user\n< |im_start|>é<|im_end|>\n" and 103 not in text
    assert C.format_chats(df.limit(0)).count() == 0


def pages():
    rng = random.Random(2)
    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"http://h/{i}", rng.choice(["<p>é</p>", "same", tricky, "", None, f"own {i} " + "z" * rng.randrange(2000)])) for i in range(200)]
    return rows + [(7, "http://again", "same"), (7, "http://again", "same"), (None, None, "only"), (None, "http://bad\r\nX: y", "same"), (900, "http://l", "long " * 500_000)]


def digest(s):
    return base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    df = spark.createDataFrame([(*r, "x") for r in pages()], "page_id long, url string, html string, digest string").repartition(3)
    R.write_warc(R.records(df), path, records_per_file=40)
    return path


def test_round_trip(spark, archives):
    rows = pages()
    got = R.read_warc(spark, archives, partition_bytes=2000).collect()
    assert len(got) == len(rows)
    top, responses = {}, {}
    for i, _, h in rows:
        top[h or ""] = max([x for x in (top.get(h or ""), i) if x is not None], default=None)
    for r in got:
        page = r["headers"].get("page-id")
        page = None if page is None else int(page)
        if r["warc_type"] == "response":
            html = bytes(r["payload"]).decode()
            assert (page, html) in {(i, h or "") for i, _, h in rows} and page == top[html]
            assert r["payload_digest"] == "sha1:" + digest(html) and r["http_length"] == len(html.encode())
            responses[r["record_id"]] = html
    assert sorted(responses.values()) == sorted(top)
    for r in got:
        if r["warc_type"] == "revisit":
            html = responses[r["refers_to"]]
            assert r["payload_digest"] == "sha1:" + digest(html) and bytes(r["payload"]) == b"" and int(r["headers"]["refers-to-page-id"]) == top[html]
    assert not any("\r" in (r["target_uri"] or "") for r in got)


def test_predicates_reach_the_reader(spark, archives):
    all_rows = R.read_warc(spark, archives).drop("payload").collect()
    light = R.read_warc(spark, archives, payload=False)
    assert "payload" not in light.columns and light.count() == len(all_rows)
    uri = next(r["target_uri"] for r in all_rows if r["target_uri"])
    for f, test in (
        (F.col("warc_type") == "revisit", lambda r: r["warc_type"] == "revisit"), (F.col("target_uri").isin(uri, "none"), lambda r: r["target_uri"] == uri), (F.col("warc_type") != "revisit", lambda r: r["warc_type"] != "revisit"),
        (F.col("target_uri").isNotNull() & (F.col("content_length") > 100), lambda r: r["target_uri"] is not None and r["content_length"] > 100),
    ):
        assert light.where(f).count() == sum(map(test, all_rows))
    reader = R.WarcReader(light.schema, {"path": archives})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert [type(f).__name__ for f in reader.pushFilters([EqualTo(("warc_type",), "response"), GreaterThan(("content_length",), 5)])] == ["GreaterThan"]


def test_unwanted_blocks_are_not_decoded(tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    record = lambda kind, b: b"WARC/1.1\r\nWARC-Type: %s\r\nX-Long: a\r\n b\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(b), b)
    raw = record(b"request", b"\xff" * 100) + record(b"response", block) + record(b"metadata", b"")
    plain, packed, members = tmp_path / "a.warc", tmp_path / "b.warc.gz", tmp_path / "c.warc.gz"
    plain.write_bytes(raw)
    packed.write_bytes(gzip.compress(raw))
    members.write_bytes(b"".join(gzip.compress(record(*x)) for x in ((b"request", b"\xff" * 100), (b"response", block), (b"metadata", b""))))
    for p in (plain, packed, members):
        with R._opened(str(p)) as f:
            got = list(R.parse(f, lambda h: h["warc-type"] == "response", True))
        assert [(h["x-long"], body, n) for _, h, body, n in got] == [("a b", b"hello", 5)] and raw[got[0][0] :].startswith(b"WARC/1.1\r\nWARC-Type: response")
        with R._opened(str(p)) as f:
            assert len(list(R.parse(f, lambda h: True, False))) == 3
    plain.write_bytes(b"nonsense\r\n")
    with R._opened(str(plain)) as f, pytest.raises(ValueError):
        list(R.parse(f, lambda h: True, True))


def test_small_payloads_and_none(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "v", "long one"), (4, "v", "long one")], "page_id long, url string, html string")
    got = {r["page_id"]: r["is_response"] for r in R.records(df, least_bytes=5).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True}
    assert R.records(df.limit(0)).count() == 0
