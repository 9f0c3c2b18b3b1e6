"""Command line: ``python -m loomstone.cli COMMAND``."""

from __future__ import annotations

import argparse
import sys

from loomstone.errors import InvalidInput, StoreError
from loomstone.functions.text import format_bytes
from loomstone.sources.readers import read_build_input, read_entities
from loomstone.sources.store import EntityStore, build, merge_stores
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

STATS = (
    ("Entities", "entities"), ("Tags", "tags"), ("Sources", "sources"), ("Attribute keys", "attributes"), ("Relationship types", "relationship_types"),
    ("Aliases", "aliases"), ("Prefix index", "trie"), ("Fuzzy aliases", "fuzzy_aliases"), ("Tokens", "tokens"), ("Relationships", "relationships"),
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomstone")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args, **flags) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        for k, v in flags.items():
            s.add_argument(f"--{k}", **v)
        return s

    add("init", "parent", "name")
    add("build", "parent", "name", input={"required": True})
    add("stats", "store")
    s = add("inspect", "store")
    s.add_argument("ids", nargs="+", type=int)
    s.add_argument("-v", "--verbose", action="store_true")
    s = add("search", "store", "query", limit={"type": int, "default": 10})
    s.add_argument("-e", "--explain", action="store_true")
    add("insert", "store", "input")
    s = add("remove", "store")
    s.add_argument("ids", nargs="+", type=int)
    s = add("update", "store", input={"required": True})
    s.add_argument("id", type=int)
    add("compact", "store")
    add("merge", "left", "right", "output")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """The lines that a command prints."""
    c = args.command
    if c == "init":
        return [f"created {EntityStore.create(spark, args.parent, args.name).root}"]
    if c == "build":
        s = build(spark, read_build_input(spark, args.input), args.parent, args.name)
        return [f"built {s.root}: {s.snapshot().count()} entities"]
    if c == "merge":
        r = merge_stores(spark, args.left, args.right, args.output)
        return [f"entities added: {r.entities_added}", f"entities skipped: {r.entities_skipped}"]
    store = EntityStore.open(spark, args.store)
    if c == "stats":
        row = store.stats().first()
        return [f"{name}: {row[key]}" for name, key in STATS] + [f"Size: {format_bytes(store.size())}"]
    if c == "inspect":
        found = {r["entity_id"]: r for r in store.entities().where(F.col("entity_id").isin(args.ids)).collect()}
        out = []
        for i in args.ids:
            out += inspected(found[i], args.verbose) if i in found else [f"{i}: not found"]
        return out
    if c == "search":
        rows = store.search(args.query, args.limit).orderBy("rank").collect()
        return [line for r in rows for line in ranked(r, args.explain)] or ["no results"]
    if c == "insert":
        e = read_entities(spark, args.input)
        store.insert(e)
        store.flush()
        return [f"inserted {e.count()}"]
    if c == "remove":
        store.remove(args.ids)
        store.flush()
        return [f"removed {len(args.ids)}"]
    if c == "update":
        e = read_entities(spark, args.input)
        ids = [r[0] for r in e.select("entity_id").limit(2).collect()]
        if len(ids) != 1 or ids[0] != args.id:
            raise InvalidInput("the input must hold exactly one entity, with the given id")
        store.update(e)
        store.flush()
        return [f"updated {args.id}"]
    before, after = store.compact()
    saved = before - after
    return [f"before: {format_bytes(before)}", f"after: {format_bytes(after)}", f"saved: {format_bytes(max(saved, 0))} ({100 * max(saved, 0) / max(before, 1):.1f} %)"]


def ranked(r, explain: bool) -> list[str]:
    """A result, and below it, if asked for, why it was found."""
    out = [f"{r['name']} score={r['score']:.2f} [{', '.join(r['sources'])}]"]
    for e in r["explanations"] if explain else ():
        told = [f"{k}={e[k]}" for k in ("term", "key", "value", "target") if e[k] is not None]
        out.append(f"  {e['kind']}: {', '.join(told)}")
    return out


def inspected(r, verbose: bool) -> list[str]:
    shown = lambda a: next((str(a[k]) for k in ("s", "i", "d", "b") if a[k] is not None), "")
    out = [f"{r['entity_id']}: {', '.join(r['aliases'])}", f"  tags: {', '.join(r['tags'])}"]
    out.append("  attributes: " + ", ".join(f"{a['key']}={shown(a)}" if verbose else shown(a) for a in r["attributes"]))
    out.append("  relationships: " + ", ".join(f"{x['kind']} -> {x['target']}" for x in r["relationships"]))
    return [*out, "  sources: " + ", ".join(s["provider"] for s in r["sources"])]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("loomstone").getOrCreate()
    try:
        print("\n".join(run(spark, args)))
        return 0
    except StoreError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
