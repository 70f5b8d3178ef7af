import datetime
import decimal
import json
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloom.functions.codec import Codec, elements, json_text
from graphloom.functions.values import AutoEdgeId, Value, accession, column, constant, data_source, edge_id, expression, prop, python_function, source, target, type_is, value
from graphloom.model import is_reserved
from graphloom.operators.mapping import ElementMapping, fuse

GENES = [("G1", "gene one", "1", 10, 20), ("G2", "gene two", "2", 30, 40), ("G3", "", "X", 50, None)]


@pytest.fixture(scope="module")
def genes(spark):
    return spark.createDataFrame(GENES, "accession string, name string, chromosome string, begin int, end int")


def rows(df):
    return sorted((r.id, r.key, r.value) for r in df.collect())


def test_columns_constants_and_types(genes):
    m = ElementMapping("accession", (type_is("Gene"), prop("name"), prop("begin"), prop("stop", "end"), prop("absent"), prop("kind", constant("protein coding"))))
    assert rows(m.triples(genes)) == sorted(
        [(g, "@type", "Gene") for g in ("G1", "G2", "G3")] + [(g, "kind", '"protein coding"') for g in ("G1", "G2", "G3")]
        + [("G1", "name", '"gene one"'), ("G2", "name", '"gene two"'), ("G1", "begin", "10"), ("G2", "begin", "30"), ("G3", "begin", "50"), ("G1", "stop", "20"), ("G2", "stop", "40")]
    )


def test_eight_rows_five_columns_two_constants(spark):
    df = spark.createDataFrame([(f"g{i}", f"n{i}", "1", i, i + 1) for i in range(8)], "accession string, name string, chromosome string, begin int, end int")
    m = ElementMapping("accession", (type_is("Gene"), data_source("T"), *(prop(c) for c in df.columns)))
    assert m.triples(df).count() == 56


def test_ids_null_empty_and_zero(spark):
    df = spark.createDataFrame([(0, "a"), (None, "b"), (7, None)], "k long, v string")
    assert rows(ElementMapping("k", (prop("v"), type_is("T"))).triples(df)) == [("0", "@type", "T"), ("0", "v", '"a"'), ("7", "@type", "T")]
    blank = ElementMapping(constant(""), (type_is("T"),))
    assert blank.triples(df).count() == 0


def test_reserved_values_stay_raw_and_empty_ones_stay(spark):
    df = spark.createDataFrame([("e", "", "b")], "k string, f string, t string")
    assert rows(ElementMapping("k", (source("f"), target("t"), prop("id", "t"))).triples(df)) == [("e", "@from", ""), ("e", "@to", "b"), ("e", "id", '"b"')]
    with pytest.raises(ValueError):
        is_reserved("")
    with pytest.raises(ValueError):
        prop("", "x")


def test_wrappers_apply_in_order_then_json(spark):
    df = spark.createDataFrame([("x", "go"), ("y", None), ("z", "")], "k string, v string")
    v = column("v").map(F.upper).wrapped("<", ">").wrapped("!")
    assert rows(ElementMapping("k", (v.as_property(),)).triples(df)) == [("x", "v", '"!<GO>"')]
    assert column("v").map(F.upper) is not v and column("v").columns == ("v",)


def test_json_text_of_all_types(spark):
    when = datetime.datetime(2024, 2, 3, 4, 5, 6, 789)
    cases = [
        ("string", 'a"b\\c\n日é/\x01', None), ("int", 7, "7"), ("bigint", -(2**40), str(-(2**40))), ("double", 0.5, "0.5"), ("double", 7.0, "7.0"), ("double", math.nan, None), ("double", math.inf, '"Infinity"'),
        ("boolean", True, "true"), ("string", "", None), ("string", None, None), ("date", when.date(), '"2024-02-03"'), ("timestamp_ntz", when, '"2024-02-03T04:05:06.000789"'),
        ("decimal(6,2)", decimal.Decimal("12.50"), "12.50"), ("array<int>", [1, 2], "[1,2]"), ("map<string,int>", {"a": 1}, '{"a":1}'), ("binary", bytearray(b"ab"), '"YWI="'),
    ]
    for kind, given, want in cases:
        df = spark.createDataFrame([(given,)], f"v {kind}")
        got = df.select(json_text(F.col("v"), df.schema[0].dataType).alias("j")).first().j
        if kind == "string" and given:
            assert json.loads(got) == given
        elif want is not None or given is None or given == "" or (isinstance(given, float) and math.isnan(given)):
            assert got == want, (kind, given, got)


def test_elements_of_json_arrays(spark):
    for given in ['["a","b\\"],[",7,7.0,true,null]', "[]", '["x"]', "[ 1 , 2 ]", '[{"a":[1]},[2]]']:
        got = spark.createDataFrame([(given,)], "t string").select(elements(F.col("t")).alias("e")).first().e
        assert [json.loads(x) for x in got] == json.loads(given)


def test_edge_ids(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "")], "f string, t string")
    ends = (type_is("r"), source("f"), target("t"))
    good = df.where("t <> ''")
    assert rows(ElementMapping(edge_id("r", "f", "t"), ends).triples(good)) == [("r:a-b", "@from", "a"), ("r:a-b", "@to", "b"), ("r:a-b", "@type", "r")]
    assert {r.id for r in ElementMapping(None, ends).triples(good).collect()} == {"r:a-b"}
    assert {r.id for r in ElementMapping(AutoEdgeId("p:"), ends).triples(good).collect()} == {"p:r:a-b"}
    assert {r.id for r in ElementMapping(AutoEdgeId(on_missing="skip"), ends).triples(df).collect()} == {"r:a-b"}
    with pytest.raises(PySparkException):
        ElementMapping(None, ends).triples(df).collect()
    with pytest.raises(ValueError, match="@to"):
        ElementMapping(None, ends[:2])


def test_accessions(spark):
    df = spark.createDataFrame([("g", "ENS", "1"), ("h", "", "2"), ("i", "ENS", None)], "k string, s string, a string")
    by = lambda p: rows(ElementMapping("k", (p,)).triples(df))
    assert by(accession("s", "a")) == [("g", "accessions", '"ENS:1"')]
    assert by(accession("!X", column("a").wrapped("A"))) == [("g", "accessions", '"X:A1"'), ("h", "accessions", '"X:A2"')]
    with pytest.raises(ValueError):
        accession(7, "a")
    assert type_is("T") is type_is("T") and data_source("d") is data_source("d")


def test_python_functions_see_declared_columns_only(genes):
    v = python_function(lambda name, begin: f"{name}/{begin}" if name else None, "name", "begin")
    m = ElementMapping("accession", (prop("both", v), prop("size", lambda b, e: e - b, "begin", "end")))
    assert rows(m.triples(genes)) == [("G1", "both", '"gene one/10"'), ("G1", "size", "10"), ("G2", "both", '"gene two/30"'), ("G2", "size", "10")]
    assert m.columns() == ("accession", "name", "begin", "end")
    assert ElementMapping("accession", (prop("x", Value(lambda df: F.lit(1))),)).columns() is None


def test_fused_mappings_scan_once_and_match_their_union(spark, tmp_path, genes):
    a, b = ElementMapping("accession", (prop("name"),)), ElementMapping(column("chromosome").wrapped("chr"), (type_is("Chromosome"),))
    both = fuse(a, b)
    assert rows(both.triples(genes)) == sorted(rows(a.triples(genes)) + rows(b.triples(genes)))
    genes.write.parquet(str(tmp_path / "g"))
    stored = spark.read.parquet(str(tmp_path / "g"))
    plan = both.triples(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan and "begin" not in plan
    narrow = both.triples(stored, keys={"@type"})._jdf.queryExecution().executedPlan().toString()
    assert "accession" not in narrow
    assert both.triples(genes, keys={"nothing"}).count() == 0
    with pytest.raises(ValueError):
        fuse()


def test_three_mappings_of_one_input_make_21_triples(spark):
    df = spark.createDataFrame([("n1", "A1", "GO1", "l1"), ("n2", "A2", "GO2", "l2"), ("n3", "A3", "GO3", "l3")], "`gene name` string, accession string, `go accession` string, `go label` string")
    gene = ElementMapping("accession", (type_is("Gene"), prop("name", "gene name")))
    go = ElementMapping("go accession", (type_is("GO"), prop("label", "go label")))
    edge = ElementMapping(None, (type_is("annotated"), source("accession"), target("go accession")))
    assert fuse(gene, go, edge).triples(df).count() == 21


def test_own_codec_and_bad_values(spark):
    df = spark.createDataFrame([("a", "x y")], "k string, v string")
    words = Codec(encode=lambda c, kind: F.concat(F.lit("w:"), c))
    assert rows(ElementMapping("k", (column("v").as_property("v", words),)).triples(df)) == [("a", "v", "w:x y")]
    assert value(lambda c: c, "v").columns == ("v",) and expression(F.upper, "v").columns == ("v",)
    with pytest.raises(ValueError):
        value(3)
    assert ElementMapping("k").with_properties(prop("v")).triples(df).count() == 1


def test_odd_column_names(spark):
    df = spark.createDataFrame([("a", "x", "y", 1)], "k string, `link.notes` string, `b``c d` string, i0 int")
    assert rows(ElementMapping("k", (prop("link.notes"), prop("q", "b`c d"), prop("i0"))).triples(df)) == [("a", "i0", "1"), ("a", "link.notes", '"x"'), ("a", "q", '"y"')]
