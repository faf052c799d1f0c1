"""Queries over sources and stores that keep something: paged registries, kept indexes, tables that streams change, sketches, clustered
pages, and backfills. Each derives what it stores from the driver's tables, in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators.backfill import DoneKeys
from ..operators.clustered import ClusteredRows
from ..operators.trigram_index import TrigramIndex
from ..session import saved
from ..sources import connectors, paged
from ..streaming import breakers
from ..streaming.latest import LatestTable, write_latest
from .catalogue import _TRI, _t, query
from .coverage import _STATES, _drafted, _folder, _name, _pick

_PAGE_ROWS = 100


def _served(spark, sf_dir) -> list[dict]:
    """Suppliers as pages of an authority's interface, by state; in each state a page that is no JSON and one that is no array."""
    key = F.col("s_suppkey")
    row = F.to_json(F.array(F.concat(F.lit("A-"), key), _name(), F.lit("Road"), F.concat(F.lit("District "), "s_nationkey"), F.lit("Govt"), F.lit("N"), F.lit("N"), F.lit("1")))
    at = [_pick(_STATES, key).alias("state"), F.floor(key / _PAGE_ROWS).cast("int").alias("page")]
    pages = _t(spark, sf_dir, "supplier").groupBy(*at).agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ","), F.lit("]")).alias("value"))
    broken = pages.select("state").distinct().select("state", F.explode(F.array(F.lit(-1), F.lit(-2))).alias("page")).withColumn("value", F.when(F.col("page") == -1, "[broken").otherwise('{"rows": 0}'))
    path = f"{_folder(spark)}/pages"
    pages.unionByName(broken).repartition("state", "page").write.option("maxRecordsPerFile", 1).partitionBy("state", "page").text(path)
    return paged.listed(spark, path)


@query(_drafted("'A-' || s_suppkey", city="'District ' || s_nationkey", where="s_suppkey % 3 < 2"))
def paged_registry(spark, sf_dir):
    """Drafts of two of three states from a source with a partition a page; pages that cannot be read are left out."""
    rows = paged.read_pages(spark, _served(spark, sf_dir), pause=0.01).filter(F.col("state").isin(*_STATES[:2]))
    return connectors.aicte_drafts(rows).select("external_id", "name", "city", "state", "affiliated_university", "website")


@query(f"""WITH p AS (SELECT {_STATES}[s_suppkey % 3 + 1] AS state, (s_suppkey // {_PAGE_ROWS})::INT AS page FROM supplier GROUP BY ALL), f AS (SELECT DISTINCT state, unnest([-1, -2]) AS page FROM p)
SELECT state, page, CASE page WHEN -1 THEN 'JSONDecodeError' ELSE 'ValueError' END AS error, (SELECT count(*) FROM p WHERE state = 'Kerala') + 2 AS partitions FROM f WHERE state = 'Kerala'""")
def paged_failures(spark, sf_dir):
    """Pages of one state that could not be read, and how many partitions were read at all: those of the state."""
    rows = paged.read_pages(spark, _served(spark, sf_dir), pause=0.01, attempts=2).filter("state = 'Kerala'")
    partitions = F.lit(rows.rdd.getNumPartitions()).cast("long")
    return paged.failed_pages(rows).select("state", "page", F.split("error", ":")[0].alias("error"), partitions.alias("partitions"))


# A kept trigram index ----------------------------------------------------------------------------------------

#: Turns as they are now, after what an earlier state of the table held: some turns were missing, some longer, some are gone.
_TURNS = "d AS (SELECT conv_id * 100000 + turn AS id, text AS t FROM conversations WHERE conv_id % 9 <> 4)"
_PARTS = ["nat", "ER THE", "he. t", "io", "%"]


def _kept_index(spark, sf_dir) -> TrigramIndex:
    """An index of turns that has been built, changed twice, and asked to change once more with nothing new."""
    turns = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text", "conv_id")
    index = TrigramIndex(spark, f"{_folder(spark)}/index", buckets=16)
    index.refresh(turns.filter("conv_id % 7 <> 0").select("id", F.when(F.col("conv_id") % 5 == 0, F.concat("text", F.lit(" earlier words"))).otherwise(F.col("text")).alias("text")))
    index.refresh(turns.filter("conv_id % 8 <> 0").select("id", "text"))
    for _ in range(2):
        index.refresh(turns.filter("conv_id % 9 <> 4").select("id", "text"))
    return index


@query(f"""WITH b AS (SELECT item_id AS query_id, text AS q FROM benchmark), {_TURNS}, bg AS (SELECT query_id, {_TRI.format(c='q')} AS g FROM b), dg AS (SELECT id, {_TRI.format(c='t')} AS g FROM d),
bp AS (SELECT query_id, len(g) AS n, unnest(g) AS x FROM bg), dp AS (SELECT id, len(g) AS n, unnest(g) AS x FROM dg)
SELECT query_id, id, round(count(*)::DOUBLE / (any_value(bp.n) + any_value(dp.n) - count(*)), 9) AS similarity, 3::BIGINT AS generations FROM bp JOIN dp USING (x) GROUP BY query_id, id HAVING count(*)::DOUBLE / (any_value(bp.n) + any_value(dp.n) - count(*)) > 0.35""")
def kept_index_similar(spark, sf_dir):
    """Benchmark texts against the kept index; the build with nothing new has left no generation."""
    index = _kept_index(spark, sf_dir)
    asked = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return index.similar(asked).select("query_id", "id", F.round("similarity", 9).alias("similarity"), F.lit(len(index.generations())).cast("long").alias("generations"))


@query(f"WITH {_TURNS}, p AS (SELECT unnest({_PARTS}) AS pattern) SELECT pattern, id FROM d JOIN p ON contains(lower(t), lower(pattern))")
def kept_index_containing(spark, sf_dir):
    """Texts that hold a pattern, whatever its case; two patterns hold no trigram of a word."""
    index = _kept_index(spark, sf_dir)
    index.compact()
    patterns = spark.createDataFrame([(p, p) for p in _PARTS], "pattern_id string, pattern string")
    return index.containing(patterns).select(F.col("pattern_id").alias("pattern"), "id")


# Streams into tables -----------------------------------------------------------------------------------------


def _streamed(events: DataFrame, part: Column, label: str) -> DataFrame:
    """A table as a stream of one micro-batch a part, in their order."""
    path = f"{_folder(events.sparkSession)}/{label}"
    for n in sorted(r[0] for r in events.select(part).distinct().collect()):
        events.filter(part == n).coalesce(1).write.parquet(f"{path}/part-{n:06d}")
    stream = events.sparkSession.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    return stream.option("recursiveFileLookup", True).parquet(path)


@query("SELECT user_id AS run_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, 1::BIGINT AS rows FROM events GROUP BY user_id")
def latest_table(spark, sf_dir):
    """Events as progress of their user's run, in five micro-batches of mixed order; then a batch that is already in comes again
    with other rows, and files that no reader takes are deleted."""
    events = _t(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "event_type", "value")
    root = f"{_folder(spark)}/latest"
    write_latest(_streamed(events, F.col("seq") * 7 % 5, "updates"), root, f"{root}-checkpoint", buckets=8).trigger(availableNow=True).start().awaitTermination()
    table = LatestTable(spark, root, buckets=8)
    table.merge(events.withColumn("seq", F.lit(10**12)), 1)
    table.sweep()
    rows = F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    return table.read().select("run_id", "seq", "event_type", "value", rows.alias("rows"))


_IDLE = 2 * 3600
_BREAKERS = f"""WITH c AS (SELECT (user_id % 20)::VARCHAR AS key, ts AS tm, event_id AS id, value, event_type IN ('error', 'purchase') AS failed FROM events),
n AS (SELECT *, coalesce(epoch_ms(tm) - epoch_ms(lag(tm) OVER (PARTITION BY key ORDER BY tm, id)) > {_IDLE * 1000}, false)::INT AS new FROM c),
s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY tm, id ROWS UNBOUNDED PRECEDING) AS spell FROM n), m AS (SELECT key, max(spell) AS spell FROM s GROUP BY key),
l AS (SELECT key, list(value ORDER BY tm, id) AS v, list(failed ORDER BY tm DESC, id DESC) AS f, arg_max(id, (tm, id)) AS id FROM s JOIN m USING (key, spell) GROUP BY key)
SELECT key, id, round(list_reduce(v, lambda a, x: (a + x) / 2), 6) AS blended, len(v)::BIGINT AS calls, coalesce(list_position(f, false) - 1, len(f))::BIGINT AS failures FROM l"""


def _calls(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 20).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), "value", F.col("event_type").isin("error", "purchase").alias("failed"))


@query(_BREAKERS)
def breaker_states(spark, sf_dir):
    """Blended latency and failures in a row of each provider after its last call; idle providers begin anew."""
    return breakers.breaker_states(_calls(spark, sf_dir), _IDLE).select("key", "id", F.round("blended", 6).alias("blended"), "calls", "failures")


@query(_BREAKERS)
def breaker_stream(spark, sf_dir):
    """The same from a stream in which a third of the calls come half a day late, and another third a day late."""
    calls = _calls(spark, sf_dir)
    ends = calls.groupBy("key").agg((F.max("at") + F.expr("INTERVAL 9 DAYS")).alias("at")).select("key", "at", F.lit(-1).cast("long").alias("id"), F.lit(0.0).alias("value"), F.lit(False).alias("failed"))
    week = F.floor((F.unix_seconds("at") + F.col("id") % 3 * 43_200) / (7 * 86_400))
    stream = _streamed(calls.unionByName(ends), F.when(F.col("id") < 0, 10**5).otherwise(week).cast("int"), "calls")
    out = f"{_folder(spark)}/states"
    told = breakers.breaker_stream(stream, "2 days", _IDLE)
    told.writeStream.outputMode("append").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    states = spark.read.schema(told.schema).parquet(out).filter("id >= 0")
    last = states.groupBy("key").agg(F.max_by(F.struct("id", "blended", "calls", "failures"), F.struct("at", "id")).alias("s"))
    return last.select("key", "s.id", F.round("s.blended", 6).alias("blended"), "s.calls", "s.failures")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(value) AS total, floor(avg(value) * 1e4 + 1e-3)::BIGINT AS mean_ten_thousandths, true AS p50_holds, true AS p95_holds FROM events WHERE value IS NOT NULL GROUP BY 1")
def merged_sketches(spark, sf_dir):
    """Daily quantiles from stored hourly sketches, checked against the days' values: their ranks are within a hundredth."""
    events = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stored = saved(A.rollup_sketches(events, "ts", "value"), "hourly-sketches")
    days = saved(A.merged_rollup(stored), "daily-sketches")
    seen = events.filter("value IS NOT NULL").withColumn("day", F.date_trunc("day", "ts")).join(days, "day").groupBy("day").agg(
        *[F.avg((F.col("value") < F.col(p)).cast("double")).alias(f"{p}_below") for p in ("p50", "p95")], *[F.avg((F.col("value") <= F.col(p)).cast("double")).alias(f"{p}_up_to") for p in ("p50", "p95")]
    )
    near = lambda p, share: ((F.col(f"{p}_below") <= share + 0.01) & (F.col(f"{p}_up_to") >= share - 0.01)).alias(f"{p}_holds")
    return days.join(seen, "day").select(F.col("day").cast("timestamp_ntz").alias("day"), "total", F.floor(F.col("mean") * 1e4 + 1e-3).alias("mean_ten_thousandths"), near("p50", 0.5), near("p95", 0.95))


# Pages over clustered rows -----------------------------------------------------------------------------------

_BY_PRICE = "p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice)::BIGINT END AS price FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY price NULLS LAST, o_orderkey) AS n, count(*) OVER () AS total FROM p)"


@query(f"""WITH {_BY_PRICE}, m AS (SELECT any_value(total) // 2 + 25 AS edge FROM r)
SELECT 'middle' AS page, n - (edge - 25) AS place, o_orderkey, price FROM r, m WHERE n > edge - 25 AND n <= edge UNION ALL SELECT 'next', n - edge, o_orderkey, price FROM r, m WHERE n > edge AND n <= edge + 40
UNION ALL SELECT 'previous', edge - n, o_orderkey, price FROM r, m WHERE n < edge AND n >= edge - 30 UNION ALL SELECT 'last', total - n + 1, o_orderkey, price FROM r WHERE n > total - 10""")
def clustered_pages(spark, sf_dir):
    """Pages of orders by price: one from the middle by its number, those behind and before its last row by cursor, and the last."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.floor("o_totalprice")).alias("price"))
    store = ClusteredRows(spark, f"{_folder(spark)}/clustered", ["price", "o_orderkey"])
    store.build(orders, per_part=500)
    total = orders.count()
    half = store.page(total // 2, 1).withColumn("price", F.col("price").cast("long")).first()  # the row before the middle
    middle = store.after(store.encode(half.asDict()), 25)
    edge = middle.orderBy(F.desc_nulls_first("price"), F.desc("o_orderkey")).first()["cursor"]
    pages = {"middle": (middle, False), "next": (store.after(edge, 40), False), "previous": (store.after(edge, 30, backward=True), True), "last": (store.after(None, 10, backward=True), True)}
    out = None
    for name, (rows, backward) in pages.items():
        placed = F.row_number().over(Window.orderBy(*store._sorted(backward)))  # over one page
        one = rows.select(F.lit(name).alias("page"), placed.cast("long").alias("place"), "o_orderkey", "price")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_BY_PRICE} SELECT n, o_orderkey, price FROM r WHERE n > 3 * 200 AND n <= 4 * 200")
def clustered_page_number(spark, sf_dir):
    """Page 4 of 200 orders by price, from the two or three parts that hold it."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.floor("o_totalprice")).alias("price"))
    store = ClusteredRows(spark, f"{_folder(spark)}/clustered", ["price", "o_orderkey"])
    store.build(orders, per_part=500)
    rows = store.page(4, 200)
    n = F.row_number().over(Window.orderBy(*store._sorted())) + 600  # over one page
    return rows.select(n.cast("long").alias("n"), "o_orderkey", "price")


# Backfill ----------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT c_name || '/' || c_mktsegment AS name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0")
def backfill_names(spark, sf_dir):
    """Names without a vector: all but those that two earlier runs have done, one of which did some again."""
    names = _t(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("/", "c_name", "c_mktsegment").alias("name"))
    done = DoneKeys(spark, f"{_folder(spark)}/done", buckets=8)
    done.add(names.filter("c_custkey % 3 <> 0"), "name")
    done.add(names.filter("c_custkey % 5 = 0"), "name")
    return done.missing(names.union(names), "name").withColumnRenamed("key", "name")
