"""Shapes as data against a plain evaluation of random stores."""

import random
import re

import pytest

from tidemark.operators import shapes


def plain(facts, rows):
    facts, out = set(facts), set()
    for name, target, path, least, most, datatype, kind, pattern, one_of, equals in rows:
        for node in {s for s, p, o in facts if p == "rdf:type" and o == target}:
            values = {node}
            for step in filter(None, path.split("/")):
                values = {o for s, p, o in facts if s in values and p == step}
            n = {
                "datatype": sum(datatype in shapes.LEXICAL and not re.search(shapes.LEXICAL[datatype], v) for v in values), "class": sum(kind is not None and (v, "rdf:type", kind) not in facts for v in values),
                "pattern": sum(pattern is not None and not re.search(pattern, v) for v in values), "list": sum(one_of is not None and v not in one_of for v in values), "equal": sum(equals is not None and (node, equals, v) not in facts for v in values),
            }
            out |= {(node, name, k, c) for k, c in n.items() if c}
            if least is not None and len(values) < least:
                out.add((node, name, "less", len(values)))
            if most is not None and len(values) > most:
                out.add((node, name, "more", len(values)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_stores(spark, seed):
    rnd = random.Random(seed)
    nodes, preds, values = [f"n{i}" for i in range(12)], ["a", "b", "c"], ["1", "-2", "x", "2024-01-01", "true", "1.5e3"]
    facts = [("g", rnd.choice(nodes), "rdf:type", rnd.choice(["K", "L", "M"])) for _ in range(20)] + [("g", rnd.choice(nodes), rnd.choice(preds), rnd.choice(nodes + values)) for _ in range(60)]
    pick = lambda *x: rnd.choice([None, None, *x])
    rows = [shapes.shape(f"s{i}", rnd.choice("KLM"), rnd.choice([*preds, "a/b", "b/a", ""]), pick(0, 1, 2), pick(0, 1, 2), pick("integer", "date", "boolean", "double", "string"), pick("K", "L"), pick("^n", "[0-9]"), pick(["x", "1"], []), pick("a", "c")) for i in range(25)]
    store = spark.createDataFrame(facts + [("h", *facts[0][1:]), facts[1]], "g string, s string, p string, o string").repartition(3)
    found = [tuple(r) for r in shapes.violations(store, spark.createDataFrame(rows, shapes.SHAPES)).collect()]
    assert len(found) == len(set(found)) and set(found) == plain([f[1:] for f in facts], rows)


def test_every_shape_of_the_catalogue_can_break(spark):
    found = shapes.queries()["shape_table_violations"](spark, "/root/testdata/sf0.001").collect()
    assert {r.shape for r in found} == {s[0] for s in shapes.CATALOGUE}
    whole = shapes._checked(False)(spark, "/root/testdata/sf0.001").collect()
    assert whole == []
