import pytest

from tidemark.engine import Engine
from tidemark.operators.mapping import r2rml, subject_columns
from tidemark.sources import readers
from tidemark.sources.tables import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_files_round_trip(spark, tmp_path, kind):
    df = table(spark, SF, "region")
    df.write.format(kind).option("header", "true").save(str(tmp_path / kind))
    back = readers.reader(spark, kind)(str(tmp_path / kind))
    assert {(str(r.r_regionkey), r.r_name) for r in back.collect()} == {(str(r.r_regionkey), r.r_name) for r in df.collect()}


def test_unknown_kind(spark):
    with pytest.raises(LookupError):
        readers.reader(spark, "nope")
    assert "postgresql" in readers.kinds() and "bigquery" in readers.kinds()


def test_mapping(spark):
    engine = Engine(spark, SF)
    text = r2rml({t: [(c["name"], c["type"]) for c in engine.describe(t)] for t in ("orders", "lineitem")})
    assert 'rr:template "http://example.com/data/orders/{o_orderkey}"' in text and 'rr:template "http://example.com/data/customer/{o_custkey}"' in text
    assert text.count("rr:logicalTable") == 2 and text.count(" .\n") >= 4
    assert subject_columns(["a", "id"], ()) == ["id"] and subject_columns(["a", "b"], ()) == ["a"] and subject_columns(["a"], ("x", "y")) == ["x", "y"]
    assert '"orders"' in readers.schema_json({"orders": engine.describe("orders")})
