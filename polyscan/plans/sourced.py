"""Queries through the engine's own sources: tables are exported or served by this process and read back.

The oracle is plain SQL over the Parquet table, so a fault of a source shows as a difference.
"""

from __future__ import annotations

import glob
import itertools
import json
import os
import tempfile
import uuid

import pyarrow.parquet as pq
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from polyscan.functions import udtf
from polyscan.plans import stubs
from polyscan.registry import register
from polyscan.session import Engine, build_session
from polyscan.sources.excel import write_workbook
from polyscan.sources.rest import MAX_PAGES


def rows_of(sf_dir: str, name: str, columns=None) -> list[dict]:
    return pq.read_table(f"{sf_dir}/{name}.parquet", columns=columns).to_pylist()


def engine(spark, sources: dict) -> Engine:
    return Engine.from_yaml(yaml.safe_dump({"version": 1, "sources": sources}), spark)


EVENT_TYPES = {"event_id": "int64", "ts": "timestamp", "user_id": "int64", "event_type": "string", "value": "float64"}
EVENT_SQL = """SELECT event_type, count(*) AS n, min(event_id) AS first_id, round(sum(value), 2) AS total, max(epoch_us(ts)) AS last_us
               FROM events GROUP BY event_type"""
EVENT_QUERY = """SELECT event_type, count(*) AS n, min(event_id) AS first_id, round(sum(value), 2) AS total, max(unix_micros(ts)) AS last_us
                 FROM files.events GROUP BY event_type"""
INDEXED = [{"name": "event_id", "kind": "zone_map"}, {"name": "ts", "kind": "zone_map"}, {"name": "event_type", "kind": "bloom"}]


def work_folder(spark: SparkSession | None = None) -> str:
    """A new folder for a query's files: under spark.checkpoint.dir, which all executors see, where that is a path that files can be written to."""
    spark = spark or SparkSession.getActiveSession()
    base = (spark.conf.get("spark.checkpoint.dir", None) if spark else None) or ""
    path = base.removeprefix("file://") if base.startswith("file://") else base.removeprefix("file:")
    if path.startswith("/"):
        os.makedirs(path, exist_ok=True)
        return tempfile.mkdtemp(prefix="files-", dir=path)
    return tempfile.mkdtemp()


#: Rows of a line file, at most: files are written and indexed by a task each.
FILE_ROWS = 250_000


def text(column: str) -> Column:
    return F.col(column).cast("string")


def stamped(column: str = "ts") -> Column:
    return F.concat(F.replace(F.col(column).cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def json_object(**members: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in members.items())), {"ignoreNullFields": "false"})


def shaped(*parts: Column | str) -> Column:
    """Texts one behind the other; a null one is a dash, so that no row is lost."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("-")) for p in parts))


def event_line(fmt: str) -> tuple[Column, dict]:
    """(a line of an event, for CSV its cells, and parser settings) of a format. Times have microseconds without zeros at the end; numbers are as Spark writes them."""
    typed = lambda **k: [{"name": c, "type": t, **{a: f(c) for a, f in k.items()}} for c, t in EVENT_TYPES.items()]
    if fmt == "jsonl":
        head = json_object(event_id=F.col("event_id"), ts=stamped(), user_id=F.col("user_id"), event_type=F.col("event_type"))
        # the value bare, as to_json puts NaN between quotes
        line = F.concat(F.rtrim(head, F.lit("}")), F.lit(', "value": '), F.coalesce(text("value"), F.lit("null")), F.lit("}"))
        return line, {"format": "jsonl", "columns": typed(path=lambda c: f"$.{c}")}
    if fmt == "csv":
        return F.struct("event_id", stamped().alias("ts"), "user_id", "event_type", "value"), {"format": "csv", "has_header": True, "columns": typed(source=lambda c: {"name": c})}
    if fmt == "logfmt":
        kind = F.replace(F.replace(F.col("event_type"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        cells = {"event_id": text("event_id"), "ts": stamped(), "user_id": text("user_id"), "event_type": F.concat(F.lit('"'), kind, F.lit('"')), "value": text("value")}
        # concat_ws leaves out what is null
        return F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), v) for k, v in cells.items())), {"format": "logfmt", "columns": typed(key=lambda c: c)}
    if fmt == "regex":
        pattern = r"(?P<ts>\S+) \[(?P<event_type>[^\]]*)\] #(?P<event_id>\d+) user (?P<user_id>\d+) -> (?P<value>\S+)"
        return shaped(stamped(), " [", text("event_type"), "] #", text("event_id"), " user ", text("user_id"), " -> ", text("value")), {"format": "regex", "pattern": pattern, "columns": typed(group=lambda c: c)}
    raise ValueError(fmt)


def write_lines(lines: DataFrame, path: str) -> str:
    """Writes one text column as lines, or a struct as CSV, by the executors into files of FILE_ROWS rows at most. -> the files' glob."""
    as_csv = isinstance(lines.schema[0].dataType, StructType)
    out = (lines.select(f"`{lines.columns[0]}`.*") if as_csv else lines).write.options(maxRecordsPerFile=FILE_ROWS, compression="none")
    if as_csv:
        out.csv(f"file://{path}", header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    else:
        out.text(f"file://{path}")
    return f"{path}/part-*"


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_table(sf_dir: str, fmt: str, spark: SparkSession | None = None) -> dict:
    spark = spark or SparkSession.getActiveSession() or build_session()
    folder = work_folder(spark)
    line, parser = event_line(fmt)
    files = write_lines(table_of(spark, sf_dir, "events").select(line), f"{folder}/events.{fmt}")
    return {"glob": files, "chunk_rows": 1000, "parser": parser, "indexed_columns": INDEXED}


def _line_query(fmt: str) -> None:
    @register(f"src_{fmt}", EVENT_SQL)
    def run(spark, sf_dir):
        e = engine(spark, {"files": {"type": "rows_file", "tables": {"events": events_table(sf_dir, fmt, spark)}}})
        return e.query(EVENT_QUERY)


for _fmt in ("jsonl", "csv", "logfmt", "regex"):
    _line_query(_fmt)


@register("src_syslog", "SELECT CAST(event_id % 24 AS BIGINT) AS facility, CAST(user_id % 8 AS BIGINT) AS severity, count(*) AS n, min(event_type) AS app, max(epoch_us(ts)) AS last_us, CAST(sum(CAST(event_id AS BIGINT)) AS DOUBLE) AS ids FROM events GROUP BY 1, 2")
def src_syslog(spark, sf_dir):
    number = lambda c, n: F.pmod(F.col(c), F.lit(n))
    line = shaped("<", (number("event_id", 24) * 8 + number("user_id", 8)).cast("string"), ">1 ", stamped(), " host", number("user_id", 5).cast("string"), " ", text("event_type"), " ", text("event_id"), ' - [x@1 k="a\\]b"] \ufeffevent')
    files = write_lines(table_of(spark, sf_dir, "events").select(line), f"{work_folder(spark)}/events.log")
    columns = [{"name": n, "field": f} for n, f in (("ts", "timestamp"), ("facility", "facility"), ("severity", "severity"), ("app", "app_name"), ("proc", "proc_id"), ("msgid", "msg_id"))]
    e = engine(spark, {"logs": {"type": "rows_file", "tables": {"sys": {"glob": files, "parser": {"format": "syslog", "columns": columns}, "indexed_columns": [{"name": "ts", "kind": "zone_map"}]}}}})
    return e.query("SELECT facility, severity, count(*) AS n, min(app) AS app, max(unix_micros(ts)) AS last_us, CAST(sum(CAST(proc AS BIGINT)) AS DOUBLE) AS ids FROM logs.sys WHERE msgid IS NULL GROUP BY facility, severity")


@register("src_glob_pruned", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) - INTERVAL '3 days' FROM events) AND event_id > 10 GROUP BY event_type")
def src_glob_pruned(spark, sf_dir):
    """Five files or more in order of time; the predicate on ts is a literal, so whole files are skipped."""
    events = table_of(spark, sf_dir, "events")
    n, since = events.select(F.count("*"), (F.max(F.col("ts").cast("timestamp_ntz")) - F.expr("INTERVAL '3' DAY")).cast("string")).first()
    line = json_object(id=F.col("event_id"), ts=stamped(), kind=F.col("event_type"))
    ordered = events.repartitionByRange(max(5, -(-n // FILE_ROWS)), "ts").sortWithinPartitions("ts")
    files = write_lines(ordered.select(line), f"{work_folder(spark)}/events.jsonl")
    columns = [{"name": n, "path": f"$.{p}", "type": t} for n, p, t in (("event_id", "id", "int64"), ("ts", "ts", "timestamp"), ("event_type", "kind", "string"))]
    e = engine(spark, {"logs": {"type": "rows_file", "tables": {"ev": {"glob": files, "chunk_rows": 200, "parser": {"format": "jsonl", "columns": columns}, "indexed_columns": [{"name": "ts", "kind": "zone_map"}]}}}})
    return e.query(f"SELECT event_type, count(*) AS n FROM logs.ev WHERE ts >= TIMESTAMP '{since}' AND event_id > 10 GROUP BY event_type")


#: Customers of a page, at most.
CUSTOMER_PAGE = 400


def page_limit(rows: int) -> int:
    """The guard against endless paging, wide enough for all pages of the table and an empty one behind them."""
    return max(MAX_PAGES, rows // CUSTOMER_PAGE + 2)


def customers_source(sf_dir: str, kind: str = "page", push: bool = True) -> dict:
    rows = stubs.ParquetRows(f"{sf_dir}/customer.parquet")
    base, _, _ = stubs.serve_http(stubs.paged(rows, CUSTOMER_PAGE))
    pages = {"page": {"type": "page", "page_param": "page", "size_param": "limit"}, "offset": {"type": "offset", "offset_param": "offset", "limit_param": "limit"}, "cursor": {"type": "cursor", "cursor_param": "cursor", "cursor_path": "$.next"}, "link": {"type": "link_header", "rel": "next"}}[kind]
    columns = {"c_custkey": "int64", "c_name": "string", "c_nationkey": "int64", "c_acctbal": "float64", "c_mktsegment": "string"}
    table = {"endpoint": {"method": "GET", "path": f"/{kind}"}, "root": "$.data[*]", "columns": {c: {"path": f"$.{c}", "type": t} for c, t in columns.items()}, "pagination": pages}
    if push:
        table["pushdown"] = {"filters": {"c_mktsegment": {"param": "c_mktsegment", "operators": ["=", "IN"]}}, "projection": {"param": "fields", "style": "comma_separated"}}
    return {"type": "rest", "base_url": base, "runtime": {"max_pages": page_limit(rows.rows)}, "tables": {"customers": table}}


def _rest_query(kind: str) -> None:
    @register(f"src_rest_{kind}", "SELECT c_nationkey AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY' GROUP BY c_nationkey")
    def run(spark, sf_dir):
        e = engine(spark, {"crm": customers_source(sf_dir, kind)})
        return e.query("SELECT CAST(c_nationkey AS INT) AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM crm.customers WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY' GROUP BY c_nationkey")


for _kind in ("page", "offset", "cursor", "link"):
    _rest_query(_kind)


@register("src_graphql", "SELECT n_name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_regionkey = 2")
def src_graphql(spark, sf_dir):
    rows = rows_of(sf_dir, "nation")

    def answer(method, path, params, body, headers):
        return 200, {}, {"data": {"nations": [r for r in rows if r["n_regionkey"] == body["variables"].get("region")]}}

    base, _, _ = stubs.serve_http(answer)
    table = {"query": "query($region: Int) { nations(region: $region) { n_name } }", "root": "$.data.nations[*]", "columns": {"n_name": {"path": "$.n_name", "type": "string"}, "region": {"type": "int64", "virtual": True}}, "pushdown": {"variables": {"region": "region"}}}
    e = engine(spark, {"geo": {"type": "graphql", "endpoint": f"{base}/graphql", "tables": {"nations": table}}})
    return e.query("SELECT n_name, region FROM geo.nations WHERE region = 2")


@register("src_excel", "SELECT s_nationkey AS nation, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier WHERE s_name <> 'nobody' GROUP BY s_nationkey")
def src_excel(spark, sf_dir):
    rows = rows_of(sf_dir, "supplier")
    path = f"{work_folder()}/suppliers.xlsx"
    write_workbook(path, {"other": [["x"]], "suppliers": [list(rows[0]), *[list(r.values()) for r in rows]]})
    e = engine(spark, {"books": {"type": "excel", "tables": {"suppliers": {"path": path, "sheet": "suppliers"}}}})
    return e.query("SELECT CAST(s_nationkey AS INT) AS nation, count(*) AS n, round(sum(CAST(s_acctbal AS DOUBLE)), 2) AS total FROM books.suppliers WHERE s_name <> 'nobody' GROUP BY s_nationkey")


@register("src_postgres_stub", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey BETWEEN 5 AND 12 AND n_name <> 'FRANCE'")
def src_postgres_stub(spark, sf_dir):
    """The stub answers the SELECT that the source builds, by running it in DuckDB over the same table."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW nations AS SELECT n_nationkey, n_name FROM read_parquet('{sf_dir}/nation.parquet')")

    def answer(sql):
        r = con.cursor().execute(sql)
        return [c[0] for c in r.description], r.fetchall()

    url, _, _ = stubs.serve_postgres([("n_nationkey", 23), ("n_name", 25)], answer)
    e = engine(spark, {"pg": {"type": "postgres", "connection": url, "tables": {"nations": {"relation": "nations"}}}})
    return e.query("SELECT CAST(n_nationkey AS INT) AS k, n_name AS name FROM pg.nations WHERE n_nationkey BETWEEN 5 AND 12 AND n_name <> 'FRANCE'")


@register("src_ldap_stub", "SELECT n_name AS cn, CAST(n_nationkey AS BIGINT) AS uid FROM nation WHERE n_regionkey IN (1, 3)")
def src_ldap_stub(spark, sf_dir):
    entries = [(f"uid={r['n_nationkey']},ou=nations,dc=example", {"uid": [str(r["n_nationkey"])], "cn": [r["n_name"]], "l": [str(r["n_regionkey"])], "objectclass": ["nation"]}) for r in rows_of(sf_dir, "nation")]
    url, _, _ = stubs.serve_ldap(entries)
    table = {"base_dn": "ou=nations,dc=example", "scope": "sub", "filter": "(objectClass=nation)", "attributes": {"uid": {"ldap": "uid", "type": "int64"}, "cn": {"ldap": "cn"}, "region": {"ldap": "l"}}, "pushdown": {"attributes": {"region": "l"}}}
    e = engine(spark, {"dir": {"type": "ldap", "url": url, "tables": {"nations": table}}})
    return e.query("SELECT cn, uid FROM dir.nations WHERE region IN ('1', '3')")


class PartProvider:
    """Parts from the Parquet file; takes equality on the brand and a projection."""

    def __init__(self, path: str):
        self.path = path

    def schema(self):
        return pq.read_schema(self.path)

    def capabilities(self):
        return {"projection": True, "limit": True, "filters": {"p_brand": ["=", "IN"]}}

    def scan(self, request):
        wanted = {f["column"]: f["value"] if f["operator"] == "IN" else [f["value"]] for f in request["filters"]}
        for b in pq.ParquetFile(self.path).iter_batches(1000):
            for column, values in wanted.items():
                b = b.filter(_is_in(b.column(column), values))
            yield b.select(request["projection"]) if request["projection"] else b


def _is_in(column, values):
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.is_in(column, value_set=pa.array(values, column.type))


@register("src_programmatic", "SELECT p_brand, count(*) AS n, max(p_size) AS most FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') GROUP BY p_brand")
def src_programmatic(spark, sf_dir):
    e = Engine.empty(spark)
    e.register_provider("app.parts", PartProvider(f"{sf_dir}/part.parquet"))
    return e.query("SELECT p_brand, count(*) AS n, max(p_size) AS most FROM app.parts WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') GROUP BY p_brand")


@register("src_rows", "SELECT r_regionkey AS k, r_name AS name FROM region")
def src_rows(spark, sf_dir):
    """A generator function as a table."""
    e, rows = Engine.empty(spark), rows_of(sf_dir, "region")

    @e.table("app.regions", _region_schema())
    def regions():
        for r in rows:
            yield r["r_regionkey"], r["r_name"]

    return e.query("SELECT k, name FROM app.regions")


def _region_schema():
    from pyspark.sql import types as T

    return T.StructType([T.StructField("k", T.IntegerType()), T.StructField("name", T.StringType())])


@register("src_static", "SELECT n_name FROM nation WHERE n_regionkey > 2")
def src_static(spark, sf_dir):
    e = Engine.empty(spark)
    e.register_batches("mem.nations", pq.read_table(f"{sf_dir}/nation.parquet").to_batches())
    return e.query("SELECT n_name FROM mem.nations WHERE n_regionkey > 2")


@register("src_parquet", "SELECT o_orderstatus, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders WHERE o_totalprice > 60000 GROUP BY o_orderstatus")
def src_parquet(spark, sf_dir):
    e = engine(spark, {"lake": {"type": "parquet", "tables": {"orders": {"path": f"{sf_dir}/orders.parquet"}}}})
    return e.query("SELECT o_orderstatus, count(*) AS n, round(max(o_totalprice), 2) AS top FROM lake.orders WHERE o_totalprice > 60000 GROUP BY o_orderstatus")


@register(
    "federated_3way",
    """SELECT c_mktsegment, count(*) AS n, round(sum(v.total), 2) AS total FROM customer
       JOIN (SELECT user_id, round(sum(value), 2) AS total FROM events GROUP BY user_id) v ON v.user_id = c_custkey
       JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey GROUP BY c_mktsegment""",
)
def federated_3way(spark, sf_dir):
    """REST customers, JSONL events and Parquet orders in one statement."""
    e = engine(spark, {"crm": customers_source(sf_dir), "files": {"type": "rows_file", "tables": {"events": events_table(sf_dir, "jsonl", spark)}}, "lake": {"type": "parquet", "tables": {"orders": {"path": f"{sf_dir}/orders.parquet"}}}})
    return e.query(
        """SELECT c_mktsegment, count(*) AS n, round(sum(v.total), 2) AS total FROM crm.customers
           JOIN (SELECT user_id, round(sum(value), 2) AS total FROM files.events GROUP BY user_id) v ON v.user_id = c_custkey
           JOIN (SELECT o_custkey, count(*) AS orders FROM lake.orders GROUP BY o_custkey) o ON o_custkey = c_custkey GROUP BY c_mktsegment"""
    )


@register("udtf_rest", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def udtf_rest(spark, sf_dir):
    base, _, _ = stubs.serve_http(stubs.paged(rows_of(sf_dir, "customer")))
    udtf.register(spark)
    config = "columns: {c_mktsegment: {path: $.c_mktsegment, type: string}}"
    return spark.sql(f"SELECT c_mktsegment, count(*) AS n FROM rest_table('{base}/all', config => '{config}') GROUP BY c_mktsegment")


@register("udtf_rows_file", "SELECT count(*) AS n, max(event_id) AS last_id FROM events")
def udtf_rows_file(spark, sf_dir):
    t = events_table(sf_dir, "jsonl", spark)
    udtf.register(spark)
    config, paths, view = json.dumps({"parser": t["parser"]}), [(p,) for p in sorted(glob.glob(t["glob"]))], "files_" + uuid.uuid4().hex
    # a task for each file
    spark.createDataFrame(spark.sparkContext.parallelize(paths, len(paths)), "path string").createOrReplaceTempView(view)
    return spark.sql(f"SELECT count(*) AS n, max(event_id) AS last_id FROM {view}, LATERAL rows_file_table(path, config => '{config}')")


def _lines_of(files: list[str]):
    """The lines of files, one by one; a file that is read is deleted."""
    for path in files:
        with open(path, "rb") as f:
            yield from f
        os.unlink(path)


@register("stream_tail", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_tail(spark, sf_dir):
    """The events appended in three steps to one file, each step read by its own trigger."""
    from polyscan.sources.rows_file import rows_file_scan
    from polyscan.streaming.tail import read_stream

    line, parser = event_line("jsonl")
    folder = work_folder(spark)
    path, out = f"{folder}/events.jsonl", f"{folder}/out"
    events = table_of(spark, sf_dir, "events")
    step = -(-events.count() // 3)
    scan = rows_file_scan("tail.events", {}, {"path": path, "parser": parser})
    lines = _lines_of(sorted(glob.glob(write_lines(events.select(line), f"{folder}/written"))))
    for _ in range(3):
        with open(path, "ab") as f:
            f.writelines(itertools.islice(lines, step))
        q = read_stream(spark, scan).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").count().withColumnRenamed("count", "n")


@register("stream_windows", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Tumbling windows with a watermark over the events as a stream; a last row far ahead closes all windows."""
    from polyscan.streaming.tail import tumbling_counts

    folder = work_folder()
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.write.parquet(f"{folder}/in/a")
    e.limit(1).selectExpr("event_id", "ts + INTERVAL '1000' DAY AS ts", "user_id", "'end' AS event_type", "value", "props").write.parquet(f"{folder}/in/b")
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in")
    out = tumbling_counts(stream.withColumn("ts", stream["ts"].cast("timestamp")), late="2000 days").writeStream.format("memory").queryName("w" + uuid.uuid4().hex).outputMode("update").trigger(availableNow=True).start()
    out.awaitTermination()
    found = spark.table(out.name).groupBy("start", "event_type").agg({"n": "max"})
    return found.where("event_type <> 'end'").selectExpr("CAST(start AS TIMESTAMP_NTZ) AS start", "event_type", "`max(n)` AS n")
