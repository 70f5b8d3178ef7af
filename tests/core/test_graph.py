import io
import json
import re
import uuid
from contextlib import contextmanager, nullcontext
from dataclasses import replace
from datetime import timedelta
from functools import reduce
from pathlib import Path
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.config import load_config
from graphloom.functions.codec import Codec
from graphloom.operators import graph, shaping
from graphloom.functions.values import AutoEdgeId, column, constant, edge_id, one_to_one, prop, source, target, type_is
from graphloom.operators.mapping import ElementMapping, fuse
from graphloom.operators.rollup import problems, rollup, rollup_rows, values_by_key
from graphloom.plans import queries
from graphloom.sources import jsonl
from graphloom.sources.graph_store import FolderSink, Neo4jSink, create_driver, elements_json, load_graph, retrying
from graphloom.testing import assert_same, same

TRIPLES = [
    ("n1", "@type", "Gene"), ("n1", "@type", "Thing"), ("n1", "name", '"one"'), ("n1", "name", '"uno"'), ("n1", "name", '"one"'), ("n1", "size", "1"), ("n1", "size", "1.0"),
    ("n2", "@type", "Gene"), ("n3", "name", '"three"'), ("n4", "@to", "n1"), ("n4", "@type", "Odd"),
    ("e1", "@type", "knows"), ("e1", "@from", "n1"), ("e1", "@to", "n2"), ("e1", "weight", "0.5"), ("e1", "weight", "3"),
    ("e2", "@type", "knows"), ("e2", "@from", "n2"), ("e2", "@to", "n3"), ("x", "name", None),
]


@pytest.fixture(scope="module")
def triples(spark):
    return spark.createDataFrame(TRIPLES, "id string, key string, value string").repartition(3)


@pytest.fixture(scope="module")
def pg(triples):
    return rollup(triples).cache()


def test_rollup(pg):
    got = {r.id: (r.type, r.labels, r["from"], r.to, r.properties) for r in pg.collect()}
    assert got == {
        "n1": ("node", ["Gene", "Thing"], None, None, {"name": ['"one"', '"uno"'], "size": ["1", "1.0"]}),
        "n2": ("node", ["Gene"], None, None, {}),
        "n3": ("node", None, None, None, {"name": ['"three"']}),
        "n4": ("node", ["Odd"], None, "n1", {}),
        "e1": ("edge", ["knows"], "n1", "n2", {"weight": ["0.5", "3"]}),
        "e2": ("edge", ["knows"], "n2", "n3", {}),
    }


def test_rollup_plan_has_one_exchange_and_no_join(triples):
    plan = rollup(triples.where("id <> 'another plan than the cached one'"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan


def test_rollup_of_nothing(spark):
    assert rollup(spark.createDataFrame([], "id string, key string, value string")).count() == 0


def test_several_ends(spark):
    t = spark.createDataFrame([("e", "@type", "r"), ("e", "@from", "b"), ("e", "@from", "a"), ("e", "@to", "c"), ("f", "@from", "a")], "id string, key string, value string")
    assert {r.id: r["from"] for r in rollup(t).collect()} == {"e": "a", "f": "a"}
    assert sorted((r.id, r.problem) for r in problems(t).collect()) == [("e", "several @from"), ("f", "no @to"), ("f", "no @type")]
    for bad in ("e", "f"):
        with pytest.raises(PySparkException):
            rollup(t.where(F.col("id") == bad), strict=True).collect()
    assert values_by_key(t).where("key = '@from' AND id = 'e'").first()["values"] == ["a", "b"]


def test_questions(pg):
    e, n = graph.edges(pg), graph.nodes(pg)
    assert {r.id for r in graph.valid_edges(e, n).collect()} == {"e1", "e2"}
    assert [(r.id, r.end, r.missing) for r in graph.dangling_edges(e, n.where("id <> 'n3'")).collect()] == [("e2", "to", "n3")]
    assert [tuple(r) for r in graph.one_hop(pg, "Gene", "knows", "Gene").collect()] == [("n1", "e1", "n2")]
    assert {(r.type, r.label): r.n for r in graph.label_counts(pg).collect()} == {("node", "Gene"): 2, ("node", "Thing"): 1, ("node", "Odd"): 1, ("node", None): 1, ("edge", "knows"): 2}
    assert graph.element(pg, "n1", "edge").count() == 0 and graph.element(pg, "n1").count() == 1


def test_json_lines(pg, tmp_path):
    text = jsonl.export(pg)
    by_id = {x["id"]: x for x in map(json.loads, text.splitlines())}
    assert by_id["n1"] == {"type": "node", "id": "n1", "labels": ["Gene", "Thing"], "properties": {"name": ["one", "uno"], "size": [1, 1.0]}}
    assert by_id["e1"] == {"type": "edge", "id": "e1", "labels": ["knows"], "properties": {"weight": [0.5, 3]}, "from": "n1", "to": "n2"}
    assert by_id["n3"]["labels"] is None and '"labels":null' in text
    jsonl.export(pg, tmp_path / "one.json")
    held = io.StringIO()
    jsonl.export(pg, held)
    assert sorted((tmp_path / "one.json").read_text().splitlines()) == sorted(held.getvalue().splitlines()) == sorted(text.splitlines())


def test_json_lines_roundtrip(spark, pg, tmp_path):
    jsonl.write(pg, str(tmp_path / "lines"))
    back = jsonl.read(spark, str(tmp_path / "lines"))
    assert_same(back.select(*pg.columns).where("id <> 'n4'"), pg.where("id <> 'n4'"), ignoreNullable=True)  # a node has no ends in a line
    assert {r.id for r in jsonl.read(spark, str(tmp_path / "lines"), "edge").collect()} == {"e1", "e2"}
    assert not same(back.select("id"), pg.select("id").limit(1))


def test_json_lines_escape_and_decode(spark):
    pg = spark.createDataFrame([('a"b', ['L"x'], {'k"1': ['"v\\""', "7"]}, "node")], "id string, labels array<string>, properties map<string,array<string>>, type string")
    (line,) = jsonl.export(pg).splitlines()
    assert json.loads(line) == {"type": "node", "id": 'a"b', "labels": ['L"x'], "properties": {'k"1': ['v"', 7]}}
    tens = Codec(decode=lambda v: (v.cast("int") * 10).cast("string"))
    pg = spark.createDataFrame([("a", None, {"n": ["7"], "m": ["7"]}, "node")], "id string, labels array<string>, properties map<string,array<string>>, type string")
    assert json.loads(jsonl.export(pg, codecs={"n": tens}))["properties"] == {"n": [70], "m": [7]}


def test_document_lines_are_those_of_the_sql(spark, tmp_path):
    rows = [(1, "one"), (1, "another one"), (1, "one"), (2, ""), (3, None), (None, "no id"), (4, 'a "quote"\\\n\x00'), (5, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = [r[0] for r in con.sql(queries.oracle_sql()["document_jsonl"]).fetchall()]
    got = [r.line for r in queries.queries()["document_jsonl"](spark, str(tmp_path)).collect()]
    assert len(told) == len(rows) and sorted(map(str, got)) == sorted(map(str, told))


def test_a_value_that_looks_like_an_edge_is_none(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"type": "node", "id": "a", "labels": [], "properties": {"t": ["\\"type\\": \\"edge\\""]}}\n\n{"type" :\t"edge", "id": "e", "labels": ["r"], "from": "a", "to": "a", "properties": null}\n')
    assert [r.id for r in jsonl.read(spark, str(tmp_path / "x.json"), "edge").collect()] == ["e"]
    (tmp_path / "bad.json").write_text("{not json\n")
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        jsonl.read(spark, str(tmp_path / "bad.json")).collect()


def test_shaping(spark):
    pg = spark.createDataFrame([("a", None, {"none": [], "nulls": ["null", None], "one": ["1"], "mixed": ["null", '"v"'], "two": ["2", "3", "2"], "lost": None})], "id string, labels array<string>, properties map<string,array<string>>")
    pg = pg.withColumns({"from": F.lit(None).cast("string"), "to": F.lit(None).cast("string")})
    read = lambda config: json.loads(elements_json(pg, config).first().properties)
    assert read(shaping.LoadConfig()) == {"one": 1, "mixed": "v", "two": [2, 3]}
    assert read(shaping.LoadConfig.of({"default_property_config": {"multi_value_mode": "multiple"}, "property_configs": {"one": {"multi_value_mode": "single"}}})) == {"one": 1, "mixed": ["v"], "two": [2, 3]}
    bad = shaping.violations(pg, shaping.LoadConfig.of({"property_configs": {"two": "single", "one": "single"}})).collect()
    assert [tuple(r) for r in bad] == [("a", "two", 2)]
    assert shaping.with_common_label(pg, "Node").first().labels == ["Node"]
    with pytest.raises(ValueError):
        shaping.with_common_label(pg, "")


def test_load_settings():
    c = shaping.LoadConfig.of({"loader_batch_size": 5, "max_retries": 3, "max_retry_pause": {"minutes": 1}, "common_node_label": "N", "property_configs": {"p": {"multi_value_mode": "single"}}})
    assert (c.batch_size, c.max_retries, c.max_pause, c.common_label, c.mode("p"), c.mode("q")) == (5, 3, timedelta(minutes=1), "N", "single", "auto")
    d = shaping.LoadConfig.of(None)
    assert (d.batch_size, d.max_retries, d.max_pause, d.min_pause) == (2500, 10, timedelta(minutes=2), timedelta(seconds=2))
    for bad in ({"max_retry_pause": "soon"}, {"nonsense": 1}, {"default_property_config": {"multi_value_mode": "some"}}):
        with pytest.raises(ValueError):
            shaping.LoadConfig.of(bad)


def test_documented_configuration(tmp_path, monkeypatch):
    monkeypatch.setenv("DB_PASSWORD", "hidden")
    (tmp_path / "c.yml").write_text("""
neoloader:
  default_property_config: {multi_value_mode: multiple}
  property_configs:
    has_pvalue: {multi_value_mode: single}
  loader_batch_size: 3000
  loader_max_concurrency: 8
  max_transaction_retries: 3
  max_retry_pause: {seconds: 10, minutes: 0}
neo4j:
  uri: bolt://somewhere:7687
  auth: {user: me, password: "${DB_PASSWORD}"}
  connection_timeout: 15
""")
    got = cli.Settings.of(load_config(tmp_path / "c.yml"), user="you")
    c = got.load
    assert (c.batch_size, c.max_concurrency, c.max_retries, c.max_pause, c.mode("has_pvalue"), c.mode("x")) == (3000, 8, 3, timedelta(seconds=10), "single", "multiple")
    assert got.connection() == {"uri": "bolt://somewhere:7687", "auth": {"user": "you", "password": "hidden"}, "connection_timeout": 15}


def test_what_is_written_again_has_no_doubles(spark, tmp_path):
    class Failing(FolderSink):
        """Breaks off after two batches of a partition, unless mended."""

        def write_nodes(self, batch):
            if not Path(self.folder, "mended").exists():
                self.n = getattr(self, "n", 0) + 1
                if self.n > 2:
                    raise RuntimeError("lost")
            super().write_nodes(batch)

    triples = spark.range(200).selectExpr("concat('n', id) as id", "'@type' as key", "'T' as value")
    sink, config = Failing(str(tmp_path)), shaping.LoadConfig(batch_size=7, max_concurrency=3)
    with pytest.raises(Exception, match="lost"):
        load_graph(spark, rollup(triples.repartition(5)), sink, do_edges=False, config=config)
    assert 0 < len(stored(tmp_path, "nodes")) < 200
    (tmp_path / "mended").touch()
    assert load_graph(spark, rollup(triples.repartition(7)), sink, do_edges=False, config=config) == 200
    assert [r["id"] for r in stored(tmp_path, "nodes")] == sorted(f"n{i}" for i in range(200))


def test_partitions_that_write_at_once(spark, tmp_path):
    class Counting(FolderSink):
        """Tells how many partitions it was opened for."""

        @contextmanager
        def opened(self):
            Path(self.folder).mkdir(parents=True, exist_ok=True)
            Path(self.folder, f"opened-{uuid.uuid4().hex}").touch()
            yield self

    lines = [json.dumps({"type": "node", "id": f"n{i}", "labels": ["T"], "properties": {}}) for i in range(50)]
    assert load_graph(spark, lines, Counting(str(tmp_path)), do_edges=False, config=shaping.LoadConfig(max_concurrency=2, batch_size=3)) == 50
    assert len(list(tmp_path.glob("opened-*"))) == 2


class Database:
    """As much of a driver as the sink uses: a transaction is kept only if its work ends well."""

    def __init__(self, nodes):
        self.nodes, self.kept = nodes, []

    def session(self):
        return nullcontext(self)

    def execute_write(self, work):
        mine = []
        work(SimpleNamespace(run=lambda query, rows: SimpleNamespace(single=lambda: mine.extend(rows) or {"n": sum({r["from"], r["to"]} <= self.nodes for r in rows)})))
        self.kept += mine


def test_edges_without_nodes_leave_nothing(tmp_path):
    sink = Neo4jSink()
    sink.driver = Database({"a", "b"})
    good, bad = {"id": "e1", "from": "a", "to": "b", "labels": ["r"], "properties": {}}, {"id": "e2", "from": "a", "to": "c", "labels": ["r"], "properties": {}}
    with pytest.raises(ValueError, match="1 edges"):
        sink.write_edges([good, bad])
    assert sink.driver.kept == []
    sink.write_edges([good])
    assert sink.driver.kept == [good]


def test_rollup_by_columns_equals_that_of_triples(spark):
    pairs = [(1, 2, 5.0, "2020-01-01 10:00:00", "x"), (1, 2, 5.0, "2020-01-01 10:00:00.5", ""), (1, 2, 7.0, None, "y"), (-1, 2, None, None, None), (12, 3, -0.0, "1999-01-01", 'q"'), (1, -23, 0.0, "1999-01-01", "é")]
    df = spark.createDataFrame(pairs * 3, "a long, b int, v double, t string, s string").withColumn("t", F.col("t").cast("timestamp")).repartition(3)
    odd = spark.createDataFrame([(1, "x", None), (2, "", "n"), (None, "y", "n"), (3, "y-1", None)], "k long, s string, n string")
    begin, end = column("a").wrapped("a:"), column("b").wrapped("b", "!")
    edge = ElementMapping(AutoEdgeId("p:"), (type_is("of"), source(begin), target(end), prop("v"), prop("t"), prop("s"), prop("v", "b"), prop("a"), prop("c", constant(1))))
    node = ElementMapping(column("k").wrapped("k:"), (type_is("K"), prop("@type", "s"), prop("n"), prop("none", "no_such_column")))
    untyped = ElementMapping(column("s").wrapped("s:"), (prop("n"),))
    apart = ElementMapping(edge_id("skip", column("k"), column("s"), on_missing="skip"), (type_is("skip"), source("k"), target("s"), target("n")))
    unclear = ElementMapping(column("s").map(F.upper).wrapped("u:"), (type_is("U"), prop("k")))
    shared = ElementMapping(column("k").wrapped("k:"), (prop("s"),))
    for parts in ([(edge, df)], [(node, odd)], [(untyped, odd)], [(apart, odd)], [(unclear, odd)], [(fuse(node, untyped, apart), odd), (edge, df)], [(fuse(node, unclear), odd), (shared, odd), (edge, df)]):
        for keys in (None, ("@type", "v"), ("n", "t")):
            assert_same(rollup_rows(*parts, keys=keys).orderBy("id"), rollup(reduce(DataFrame.union, [m.triples(d, keys) for m, d in parts]), keys=keys).orderBy("id"), ignoreNullable=True)
    with pytest.raises(PySparkException, match="both ends"):
        rollup_rows((ElementMapping(None, (type_is("e"), source("k"), target("s"))), odd)).collect()
    with pytest.raises(PySparkException, match="Several @to"):
        rollup_rows((apart.with_properties(target("n"), target(constant("z"))), odd), strict=True).collect()


def test_ids_known_to_be_one_to_one(spark):
    df = spark.createDataFrame([(1, 2, "s", 0.5)], "a long, b int, s string, d double")
    a, b, s = column("a"), column("b"), column("s")
    sure = [a, b.wrapped("x", "1"), s.wrapped("s:"), edge_id("t", a, b), edge_id("t", a.wrapped("1", "x2"), s, "p")]
    unsure = [column("d"), column("none"), constant("c"), a.map(F.abs), edge_id("t", s, a), edge_id(s, a, b), edge_id("t", a, b.map(F.abs).wrapped("x"))]
    assert [one_to_one(v, df) for v in sure] == [True] * 5 and not any(one_to_one(v, df) for v in unsure)
    assert not one_to_one(replace(a, pieces=("", "a", "1", "b", "")), df) and not one_to_one(replace(a, pieces=("", "a", "", "b", "")), df)


def test_edges_are_sent_as_their_columns(spark, tmp_path):
    spark.range(10).selectExpr("id AS l_orderkey", "id % 3 AS l_partkey", "CAST(id AS double) AS l_quantity", "timestamp_seconds(id) AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = queries.queries()["pg_rollup_edges"](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" not in plan and re.search(r"keys=\[l_orderkey#\d+L, l_partkey#\d+L\]", plan)


def test_rollup_of_some_keys(spark, triples):
    whole = {r.id: (r.labels, r["from"], r.to, r.type) for r in rollup(triples).collect()}
    some = rollup(triples, keys=("@type", "@from", "@to"))
    got = {r.id: (r.labels, r["from"], r.to, r.type) for r in some.collect()}
    assert got == {i: r for i, r in whole.items() if r[0] or r[1] or r[2]} and all(not r.properties for r in some.collect())


def test_questions_to_the_shape_read_no_properties(spark):
    for name in ("label_counts", "match_one_hop", "match_two_hops"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        read = re.findall(r"ReadSchema: struct<[^>]*>", plan)
        assert read and not any(c in r for r in read for c in ("o_totalprice", "o_orderstatus", "c_name", "n_name")), (name, read)


def stored(folder, kind):
    return sorted((json.loads(x) for p in (folder / kind).glob("*.jsonl") for x in p.read_text().splitlines()), key=lambda r: r["id"])


def test_load(spark, pg, tmp_path):
    whole = pg.where("id <> 'n4'")
    sink = FolderSink(str(tmp_path / "db"))
    assert load_graph(spark, whole, sink, config=shaping.LoadConfig(batch_size=1), done_base=tmp_path / "done.edges") == 5
    assert [(r["id"], r["labels"], r["properties"]) for r in stored(tmp_path / "db", "nodes")] == [("n1", ["Gene", "Thing", "Node"], {"name": ["one", "uno"], "size": [1, 1.0]}), ("n2", ["Gene", "Node"], {}), ("n3", ["Node"], {"name": "three"})]
    assert [(r["id"], r["from"], r["to"]) for r in stored(tmp_path / "db", "edges")] == [("e1", "n1", "n2"), ("e2", "n2", "n3")]
    assert (tmp_path / "done.nodes").exists() and (tmp_path / "done.edges").exists() and (tmp_path / "db/nodes/_index").exists()
    assert load_graph(spark, whole, sink, done_base=tmp_path / "done") == 0
    (tmp_path / "done.nodes").unlink()
    assert load_graph(spark, whole, sink, done_base=tmp_path / "done.nodes") == 5
    (tmp_path / "done.edges").unlink()
    assert load_graph(spark, whole, sink, done_base=tmp_path / "done") == 2


def test_load_sources_and_refusals(spark, pg, tmp_path):
    text = jsonl.export(pg.where("id <> 'n4'"))
    (tmp_path / "g.json").write_text(text)
    assert load_graph(spark, tmp_path / "g.json", FolderSink(str(tmp_path / "a"))) == 5
    assert load_graph(spark, text.splitlines(), FolderSink(str(tmp_path / "b")), do_edges=False) == 3
    assert load_graph(spark, iter(text.splitlines()), FolderSink(str(tmp_path / "c")), do_nodes=False) == 2
    with pytest.raises(ValueError, match="two passes"):
        load_graph(spark, iter(text.splitlines()), FolderSink(str(tmp_path / "d")))
    with pytest.raises(ValueError, match="n3"):
        load_graph(spark, pg.where("id <> 'n3'"), FolderSink(str(tmp_path / "d")))
    with pytest.raises(ValueError, match="n1.name"):
        load_graph(spark, pg, FolderSink(str(tmp_path / "d")), config=shaping.LoadConfig.of({"property_configs": {"name": "single"}}))
    with pytest.raises(ValueError, match="label"):
        load_graph(spark, pg.withColumn("labels", F.when(F.col("type") == "node", F.col("labels"))), FolderSink(str(tmp_path / "d")))
    assert not (tmp_path / "d").exists()


class Busy(Exception):
    pass


def test_retries():
    calls, pauses = [], []

    def sometimes():
        calls.append(1)
        if len(calls) < 3:
            raise Busy
        return "done"

    assert retrying(sometimes, (Busy,), 5, 2, 4, pauses.append) == "done" and len(pauses) == 2 and all(2 <= p <= 4 for p in pauses)
    with pytest.raises(Busy):
        retrying(lambda: (_ for _ in ()).throw(Busy()), (Busy,), 3, 0, 0, pauses.append)
    with pytest.raises(KeyError):
        retrying(lambda: {}["x"], (Busy,), 3, 0, 0, pauses.append)


def test_command_line(spark, pg, tmp_path, capsys):
    jsonl.export(pg.where("id <> 'n4'"), tmp_path / "g.json")
    (tmp_path / "c.yml").write_text("neo4j:\n  uri: bolt://there\n  auth: {user: u}\nneoloader:\n  loader_batch_size: 2\n")
    seen = []

    def sink(neo):
        seen.append(neo)
        return FolderSink(str(tmp_path / "db"))

    assert cli.main([str(tmp_path / "g.json"), "-c", str(tmp_path / "c.yml"), "-p", "secret"], sink, spark) == 0
    assert seen == [{"uri": "bolt://there", "auth": {"user": "u", "password": "secret"}}]
    assert cli.main([str(tmp_path / "g.json"), "-n", "-r", "bolt://here", "-f", str(tmp_path / "flag")], sink, spark) == 0
    assert seen[1] == {"uri": "bolt://here", "auth": {"user": "neo4j", "password": "neo4j"}} and (tmp_path / "flag.edges").exists()
    assert cli.main(["-h"]) == 2 and cli.main(["--nonsense"]) == 2
    assert cli.main([str(tmp_path / "missing.json")], sink, spark) == 1


def test_database_driver_is_optional():
    try:
        import neo4j  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            create_driver({})
    assert Neo4jSink({"uri": "x"}).settings == {"uri": "x"}
