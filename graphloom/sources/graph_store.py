"""Loading property graphs: nodes, then edges with ends that exist, in batches from all partitions."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, nullcontext
from datetime import UTC, datetime
from itertools import islice
from pathlib import Path
from typing import Any, Protocol

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.shipping import ship
from graphloom.model import EDGE, NODE
from graphloom.operators.graph import dangling_edges
from graphloom.operators.shaping import LoadConfig, property_json, shaped, violations, with_common_label
from graphloom.sources import jsonl


#: Lines of an iterator that are loaded at once.
LINES = 100_000


class Sink(Protocol):
    """Where batches go. It is sent to the executors, so it opens its connections where it writes.

    A batch may come twice, after a lost executor or an error; it has the same elements then, and writing it again must
    change nothing. ``opened``, if there is one, is entered once for a partition and gives what its batches are written to.
    """

    transient: tuple[type[BaseException], ...]

    def write_nodes(self, batch: list[dict]) -> None: ...
    def write_edges(self, batch: list[dict]) -> None: ...
    def index_nodes(self, label: str) -> None: ...


def retrying(call: Callable[[], Any], transient: tuple[type[BaseException], ...], attempts: int, low: float, high: float, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The result of call; after a transient error a pause of random length and another attempt, the last error raised."""
    for left in range(max(1, attempts) - 1, -1, -1):
        try:
            return call()
        except transient:
            if not left:
                raise
            sleep(random.uniform(low, max(low, high)))
    return None


def elements_json(pg: DataFrame, config: LoadConfig) -> DataFrame:
    """(id, labels, from, to, properties): properties shaped, as one JSON text."""
    return shaped(pg, config).select("id", "labels", "from", "to", property_json(F.col("properties"), F.col("single")).alias("properties"))


def _write(df: DataFrame, sink: Sink, method: str, config: LoadConfig) -> int:
    """Batches from as many partitions as may write at once. Rows are dealt and sorted by id, so that batches are the same each time."""
    ship(df.sparkSession)
    size, attempts, low, high = config.batch_size, config.max_retries, config.min_pause.total_seconds(), config.max_pause.total_seconds()
    dealt = df.repartition(config.max_concurrency or df.sparkSession.sparkContext.defaultParallelism, "id").sortWithinPartitions("id")

    def partition(rows):
        done = 0
        rows = iter(rows)
        with getattr(sink, "opened", lambda: nullcontext(sink))() as target:
            while batch := [{**r.asDict(), "properties": json.loads(r["properties"])} for r in islice(rows, size)]:
                retrying(lambda batch=batch: getattr(target, method)(batch), tuple(sink.transient), attempts, low, high)
                done += len(batch)
        yield done

    return dealt.rdd.mapPartitions(partition).sum()  # imperative per partition: batches to an outside store


def _flag(base: str | Path | None, phase: str) -> str | None:
    if base is None:
        return None
    text = str(base)
    for suffix in (f".{NODE}s", f".{EDGE}s"):
        text = text.removesuffix(suffix)
    return f"{text}.{phase}"


def _there(spark: SparkSession, flag: str | None) -> bool:
    """Is a flag there, in whatever store its path names?"""
    if flag is None:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(flag)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _tell(spark: SparkSession, flag: str | None, source: object) -> None:
    if flag is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(flag)
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(f"{flag.rpartition('.')[2]} of {source} loaded on {datetime.now(UTC).isoformat()}\n".encode())
        out.close()


def load_graph(spark: SparkSession, source: DataFrame | str | Path | Iterable[str], sink: Sink, do_nodes: bool = True, do_edges: bool = True, config: LoadConfig | None = None, done_base: str | Path | None = None) -> int:
    """Load what source holds and return the number of elements written.

    source: property-graph rows, a path of JSON lines, a list of lines, or for one pass any iterator of lines, which is
    taken LINES at a time. Before anything is written, properties declared single with several values are refused, and
    edges whose ends are not nodes (of an iterator, in each part). Flags beside done_base tell what has been done: nodes
    are skipped if theirs is there, edges if both are.
    """
    config = config or LoadConfig()
    if not isinstance(source, (DataFrame, str, Path)) and iter(source) is source:
        if do_nodes and do_edges:
            raise ValueError("Nodes and edges are two passes: give a path, a DataFrame or a list of lines")
        return _load_parts(spark, source, sink, do_nodes, do_edges, config, done_base)
    if isinstance(source, DataFrame):
        pg = source
    elif isinstance(source, (str, Path)):
        pg = jsonl.read(spark, str(source))
    else:
        pg = jsonl.parse(spark.createDataFrame([(line,) for line in source], "value string"))
    pg = pg.persist(StorageLevel.MEMORY_AND_DISK)  # checked and written several times
    try:
        return _load(spark, pg, source, sink, do_nodes, do_edges, config, done_base)
    finally:
        pg.unpersist()


def _load_parts(spark: SparkSession, lines: Iterator[str], sink: Sink, do_nodes: bool, do_edges: bool, config: LoadConfig, done_base: str | Path | None) -> int:
    phase = _flag(done_base, "nodes" if do_nodes else "edges")
    if _there(spark, phase) and (do_nodes or _there(spark, _flag(done_base, "nodes"))):
        return 0
    total = 0
    while part := list(islice(lines, LINES)):
        total += load_graph(spark, part, sink, do_nodes, do_edges, config)
    _tell(spark, phase, "lines")
    return total


def _load(spark: SparkSession, pg: DataFrame, source: object, sink: Sink, do_nodes: bool, do_edges: bool, config: LoadConfig, done_base: str | Path | None) -> int:
    node_rows, edge_rows = pg.where(F.col("type") == NODE), pg.where(F.col("type") == EDGE)
    nodes_done, edges_done = _flag(done_base, "nodes"), _flag(done_base, "edges")
    skip_nodes = not do_nodes or _there(spark, nodes_done)
    skip_edges = not do_edges or (_there(spark, nodes_done) and _there(spark, edges_done))
    wanted = [] if skip_nodes else [node_rows]
    wanted += [] if skip_edges else [edge_rows]
    for rows in wanted:
        if bad := violations(rows, config).limit(5).collect():
            raise ValueError("Several values of a single-valued property: " + ", ".join(f"{r.id}.{r.key}" for r in bad))
    if not skip_edges:
        if bad := edge_rows.where("labels IS NULL OR size(labels) = 0").limit(5).collect():
            raise ValueError("Edges without a label: " + ", ".join(r.id for r in bad))
        if do_nodes and (bad := dangling_edges(edge_rows, node_rows).limit(5).collect()):
            raise ValueError("Edges refer to nodes that aren't there: " + ", ".join(f"{r.id} {r.end} {r.missing}" for r in bad))
    total = 0
    if not skip_nodes:
        labelled = with_common_label(node_rows, config.common_label)
        total += _write(elements_json(labelled, config), sink, "write_nodes", config)
        sink.index_nodes(config.common_label)
        _tell(spark, nodes_done, source)
    if not skip_edges:
        total += _write(elements_json(edge_rows, config), sink, "write_edges", config)
        _tell(spark, edges_done, source)
    return total


class FolderSink:
    """Batches as JSON-lines files in a folder that all executors share."""

    transient: tuple[type[BaseException], ...] = (OSError,)

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _put(self, kind: str, batch: list[dict]) -> None:
        import hashlib

        text = "".join(json.dumps(b, ensure_ascii=False, sort_keys=True) + "\n" for b in batch)
        place = Path(self.folder, kind)
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{hashlib.sha256(text.encode()).hexdigest()}.jsonl").write_text(text)  # a batch written again is the same file

    def write_nodes(self, batch: list[dict]) -> None:
        self._put("nodes", batch)

    def write_edges(self, batch: list[dict]) -> None:
        self._put("edges", batch)

    def index_nodes(self, label: str) -> None:
        Path(self.folder, "nodes").mkdir(parents=True, exist_ok=True)
        Path(self.folder, "nodes", "_index").write_text(f"{label} id\n")


class Neo4jSink:
    """A Neo4j database, if its driver package is installed. settings: uri, auth (user, password), further driver options."""

    def __init__(self, settings: dict | None = None, common_label: str = "Node") -> None:
        self.settings, self.label, self.driver = dict(settings or {}), common_label, None

    @property
    def transient(self) -> tuple[type[BaseException], ...]:
        from neo4j.exceptions import ServiceUnavailable, SessionExpired, TransientError

        return (ServiceUnavailable, SessionExpired, TransientError)

    @contextmanager
    def opened(self):
        """This sink with one connection for all batches of a partition."""
        with create_driver(self.settings) as driver:
            held = Neo4jSink(self.settings, self.label)
            held.driver = driver
            yield held

    def _run(self, query: str, check: Callable[[Any], None] = lambda counted: None, **parameters: Any) -> None:
        """One transaction, taken back if check refuses the record that the query returns."""

        def work(transaction):
            check(transaction.run(query, **parameters).single())

        with nullcontext(self.driver) if self.driver else create_driver(self.settings) as driver, driver.session() as session:
            session.execute_write(work)

    def write_nodes(self, batch: list[dict]) -> None:
        self._run(f"UNWIND $rows AS r MERGE (n:`{self.label}` {{id: r.id}}) SET n:$(r.labels), n += r.properties RETURN count(n) AS n", rows=batch)

    def write_edges(self, batch: list[dict]) -> None:
        def all_there(counted) -> None:
            if counted["n"] != len(batch):
                raise ValueError(f"{len(batch) - counted['n']} edges of a batch refer to nodes that aren't there")

        query = f"UNWIND $rows AS r MATCH (a:`{self.label}` {{id: r.from}}), (b:`{self.label}` {{id: r.to}}) MERGE (a)-[e:$(r.labels[0]) {{id: r.id}}]->(b) SET e += r.properties RETURN count(e) AS n"
        self._run(query, all_there, rows=batch)

    def index_nodes(self, label: str) -> None:
        self._run(f"CREATE INDEX IF NOT EXISTS FOR (n:`{label}`) ON (n.id)")


def create_driver(settings: dict | None = None):
    """A driver from configuration: uri (bolt://localhost:7687 unless given), auth as a pair or a mapping, the rest passed on."""
    try:
        import neo4j
    except ImportError as missing:
        raise RuntimeError("The neo4j package isn't installed") from missing
    options = dict(settings or {})
    auth = options.pop("auth", None)
    if isinstance(auth, dict):
        auth = (auth.get("user"), auth.get("password"))
    return neo4j.GraphDatabase.driver(options.pop("uri", "bolt://localhost:7687"), auth=tuple(auth) if auth else None, **options)
