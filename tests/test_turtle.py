"""Turtle over file splits of every size, against the triples written out by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources.turtle import KNOWN, compacted, read_turtle

RDF, XSD = KNOWN["rdf"], KNOWN["xsd"]
FILE = '''@prefix ex: <http://e.x/> . # a prefix. And a comment
@base <http://b.ase/dir/> .
PREFIX other: <http://o.ther/a.b#>
ex:one a ex:Class ; ex:label "One. Two"@en-GB , 'single \\'quoted\\'' ;
    ex:size 12 , -1.5 , 2e3 , true .
<rel> ex:note """several
lines. With "quotes" and a full stop at the end .
ex:not ex:a ex:statement .
""" , "tab\\tand \\u00e9 \\U0001F600" ; ex:when "2024-01-01"^^<http://www.w3.org/2001/XMLSchema#date> ; .
ex:broken ex:has nothing:known .
other:x.y ex:list ( 1 [ ex:in "list" ] ) . [] ex:anonymous _:named . _:named ex:again [ ex:deep [ ex:deeper ex:one ] ; ] .
ex:bad "literal predicate" ex:one .
@prefix ex: <http://changed/> .
ex:late ex:p \'\'\'it''s . long\'\'\' .
"literal" ex:as ex:subject .
[ ex:alone 1 ] .
ex:never ex:ends "here"'''


def expected():
    e, lit = "http://e.x/", lambda v, t=XSD + "string", lang=None: (v, "literal", t, lang)
    iri = lambda v: (v, "iri", None, None)
    return {
        (e + "one", RDF + "type", iri(e + "Class")), (e + "one", e + "label", lit("One. Two", RDF + "langString", "en-gb")), (e + "one", e + "label", lit("single 'quoted'")),
        (e + "one", e + "size", lit("12", XSD + "integer")), (e + "one", e + "size", lit("-1.5", XSD + "decimal")), (e + "one", e + "size", lit("2e3", XSD + "double")), (e + "one", e + "size", lit("true", XSD + "boolean")),
        ("http://b.ase/dir/rel", e + "note", lit('several\nlines. With "quotes" and a full stop at the end .\nex:not ex:a ex:statement .\n')), ("http://b.ase/dir/rel", e + "note", lit("tab\tand é 😀")),
        ("http://b.ase/dir/rel", e + "when", lit("2024-01-01", XSD + "date")), ("http://changed/late", "http://changed/p", lit("it''s . long")),
    }


@pytest.mark.parametrize("split", [10_000, 300, 61, 7])
def test_statements_over_splits(spark, tmp_path, split):
    (tmp_path / "a.ttl").write_text(FILE)
    (tmp_path / "b.ttl").write_text('@prefix ex: <http://second/> .\nex:s ex:p _:named .\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        triples, malformed = read_turtle(spark, str(tmp_path))
        rows, wrong = triples.collect(), malformed.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    found = [(r.s, r.p, (r.o, r.o_kind, r.datatype, r.lang)) for r in rows]
    blank = [t for t in found if t[0].startswith("_:") or t[2][1] == "blank"]
    plain = [t for t in found if t not in blank]
    assert len(plain) == 11 and set(plain) == expected()
    # the list of two cells, the node in it, the anonymous nodes and the named one
    names = {t[1].rsplit("/")[-1] if "#" not in t[1] else t[1].rsplit("#")[-1] for t in blank}
    assert names == {"list", "first", "rest", "in", "anonymous", "again", "deep", "deeper", "alone", "p"} and len(blank) == 12
    named = {t[2][0] for t in blank if t[1].endswith("anonymous")} | {t[0] for t in blank if t[1].endswith("again")}
    assert len(named) == 1 and named.isdisjoint(t[2][0] for t in blank if t[1] == "http://second/p")
    by = {t[1]: t for t in blank}
    assert by["http://e.x/again"][2][0] == by["http://e.x/deep"][0] and by["http://e.x/deep"][2][0] == by["http://e.x/deeper"][0]
    assert sorted(r.text.split()[0] for r in wrong) == ['"literal"', "ex:bad", "ex:broken", "ex:never"]


def test_names_are_compacted_and_nothing_is_read(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('<http://example.com/schema/t> rdf:type owl:Class .\n<http://example.com/schema/t> <http://example.com/schema/n> "1" .')
    triples, malformed = read_turtle(spark, str(tmp_path / "a.ttl"))
    assert sorted(tuple(r) for r in compacted(triples).collect()) == [("t", "n", "1"), ("t", "rdf:type", "owl:Class")] and malformed.isEmpty()
    (tmp_path / "empty.ttl").write_text("\n# only a comment\n")
    triples, malformed = read_turtle(spark, str(tmp_path / "empty.ttl"))
    assert triples.isEmpty() and malformed.isEmpty() and triples.agg(F.count("*")).first()[0] == 0
