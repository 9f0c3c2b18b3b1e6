"""Small entities for tests."""

import json


def entity(id, aliases, tags=(), attributes=(), relationships=(), sources=()):
    return {
        "id": id, "aliases": list(aliases), "tags": list(tags), "attributes": [{"key": k, "value": v} for k, v in attributes],
        "relationships": [{"kind": k, "target": t} for k, t in relationships], "sources": [{"provider": p, "verified": True, "created": None, "updated": None} for p in sources],
    }


SHOP = [
    entity(1, ["Fizz Cola", "Cola"], ["soft-drink", "Sugar-Free"], [("volume", "330ml"), ("brand", "Acme")], [("MadeBy", 10), ("InstanceOf", 20)], ["Open Facts"]),
    entity(2, ["Cola Light"], ["soft drink"], [("volume", "500ml")], [("MadeBy", 10)], ["Open Facts"]),
    entity(3, ["Spring Water", "Water"], ["water"], [("organic", "true"), ("flavour", "none at all")], [("MadeBy", 11)]),
    entity(4, ["Colas"], [], [], [], []),
    entity(10, ["Aurora Foods", "Aurora"], ["company"]),
    entity(11, ["Brook", "Cola"], ["company"]),
    entity(20, ["Drink", "Cola "], ["category"]),
]


def write(path, rows):
    path.write_text(json.dumps(rows))
    return str(path)
