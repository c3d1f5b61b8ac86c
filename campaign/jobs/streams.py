"""Jobs on streams and on evolving populations.

Stream jobs read the events table's folder as a stream, run until all of it has been read, and return
what arrived; their SQL is that of the batch operator.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evolve as ev
from ..sources import canonical as c
from ..sources.scratch import new_folder
from ..sources.tail import store
from ..streaming import events as st
from .base import Jobs
from .history import LOST

job = Jobs()

def _raw(df: DataFrame) -> DataFrame:
    """Raw file events: a path per user and page, with bits from the kind of event."""
    bit = F.when(F.col("event_type") == "signup", st.CREATED).when(F.col("event_type") == "view", st.MODIFIED).when(F.col("event_type") == "click", st.CLOSED).when(F.col("event_type") == "error", st.DELETED).otherwise(st.MODIFIED)
    return df.select(F.concat(F.lit("in/"), "user_id").alias("path"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), bit.alias("bit"))


def _stream(spark, sf: str) -> DataFrame:
    schema = c.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input that is there, through files in the checkpoint folder."""
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


RAW = """raw AS (SELECT 'in/' || user_id AS path, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 4 WHEN 'error' THEN 8 ELSE 2 END AS bit FROM events),
p AS (SELECT *, coalesce(sum(CASE WHEN bit IN (4, 8) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM raw),
s AS (SELECT *, bit_or(bit) OVER (PARTITION BY path, part) AS seen FROM p),
e AS (SELECT path, epoch_us(ts) AS at, CASE WHEN bit = 8 THEN 'deleted' WHEN seen & 1 > 0 THEN 'created' WHEN seen & 2 > 0 THEN 'modified' END AS event FROM s WHERE bit IN (4, 8))"""
_EVENTS = f"WITH {RAW} SELECT * FROM e WHERE event IS NOT NULL"


@job(_EVENTS)
def coalesce_events_batch(spark, sf):
    return st.coalesce_events_batch(_raw(c.table(spark, sf, "events"))).select("path", F.unix_micros("ts").alias("at"), "event")


@job(_EVENTS)
def coalesce_events(spark, sf):
    return drain(st.coalesce_events(_raw(_stream(spark, sf)))).select("path", F.unix_micros("ts").alias("at"), "event")


_LIVE = c.with_("task_events") + """, l AS (SELECT task_id, arg_max((state, CASE WHEN state = 'TERMINATED' THEN seq % 3 END), (ts, seq)) AS s FROM task_events GROUP BY 1), x AS (SELECT s[1] AS state, s[2] AS code FROM l)
    SELECT state, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT CASE WHEN code = 0 THEN 'ok' ELSE 'failed' END, count(*) FROM x WHERE state = 'TERMINATED' GROUP BY 1"""


def _code():
    return F.when(F.col("state") == "TERMINATED", F.col("seq") % 3).cast("int")


@job(_LIVE)
def live_state_counts_batch(spark, sf):
    return st.live_state_counts_batch(c.task_events(spark, sf).withColumn("returncode", _code()))


@job(_LIVE)
def live_state_counts(spark, sf):
    kind = F.create_map(*(F.lit(x) for pair in {"signup": "NEW", "view": "SUBMITTED", "click": "RUNNING", "purchase": "TERMINATED", "error": "STOPPED"}.items() for x in pair))
    e = _stream(spark, sf).select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.try_element_at(kind, F.col("event_type")).alias("state"))
    return drain(st.state_deltas(e.withColumn("returncode", _code()))).groupBy("state").agg(F.sum("delta").alias("n")).where("n <> 0")


@job(LOST.replace("SELECT task_id, since FROM s", "SELECT task_id, epoch_us(since) AS since FROM s"))
def lost_tasks_stream(spark, sf):
    """Tasks that a stream of checks tells to be lost and does not take back."""
    e = _stream(spark, sf).select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("state"))
    told = drain(st.lost_tasks_stream(e, 3600)).groupBy("task_id", "since").agg(F.bool_and("lost").alias("lost"))
    return told.where("lost").select("task_id", F.unix_micros("since").alias("since"))


_CHANGES = c.with_("listing_old", "listing_new") + ", d AS (SELECT path, CASE WHEN o.mtime IS NULL THEN 'created' WHEN n.mtime IS NULL THEN 'deleted' WHEN n.mtime > o.mtime THEN 'modified' END AS event FROM listing_old o FULL JOIN listing_new n USING (path)) SELECT * FROM d WHERE event IS NOT NULL"


@job(_CHANGES)
def listing_changes_batch(spark, sf):
    return st.listing_changes(c.listing(spark, sf, False), c.listing(spark, sf, True))


@job(_CHANGES)
def listing_changes(spark, sf):
    """Two listings that arrive one after the other; the changes that the second one brings."""
    inbox, folder = new_folder(spark, "listings"), new_folder(spark, "changes")
    for new in (False, True):
        c.listing(spark, sf, new).write.mode("append").parquet(inbox)
        st.follow_listings(spark.readStream.schema("path string, mtime long").parquet(inbox), folder)
    return st.changes_so_far(spark, folder).where("listing = 1").select("path", "event")


@job("SELECT event_id, event_id || ' ' || user_id || ' ' || event_type AS line, event_id > avg(event_id) OVER () AS appended FROM events")
def follow_log(spark, sf):
    """Events as lines of their workers' logs, followed while the logs grow: the second look, with the first one's checkpoint, sees
    only what was appended to the files meanwhile.
    """
    folder, sink = new_folder(spark, "logs"), new_folder(spark, "stream")
    e = c.table(spark, sf, "events").select("event_id", F.concat_ws(" ", "event_id", "user_id", "event_type").alias("line"))
    half = e.agg(F.avg("event_id")).first()[0]
    for appended in (False, True):
        grow_logs(e if appended else e.where(F.col("event_id") <= F.lit(half)), folder, 8)
        lines = st.follow_log(spark, folder).withColumn("appended", F.lit(appended))
        lines.writeStream.format("parquet").option("path", f"{sink}/rows").option("checkpointLocation", f"{sink}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("line string, appended boolean").parquet(f"{sink}/rows")
    return rows.select(F.substring_index("line", " ", 1).cast("long").alias("event_id"), "line", "appended")


def grow_logs(events: DataFrame, folder: str, workers: int) -> None:
    """Writes (event_id, line) as the logs of so many workers, in the order of ids. A log that is there is replaced by a longer one in one step, so tasks may be run again."""

    def run(batches):
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        name, out = f"worker-{TaskContext.get().partitionId()}.log", None
        own = f"{root}/_{name}.{uuid.uuid4().hex}"
        for batch in batches:
            out = out or fs.open_output_stream(own, compression=None)
            out.write("".join(f"{x}\n" for x in batch.column("line").to_pylist()).encode())
        if out:
            out.close()
            fs.move(own, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"name": [name]})

    events.repartition(workers, F.pmod("event_id", F.lit(workers))).sortWithinPartitions("event_id").mapInArrow(run, "name string").collect()  # a name by worker


@job(
    """WITH m AS (SELECT vec_id AS member_id, embedding::DOUBLE[] AS x, label::DOUBLE AS y FROM embeddings), n AS (SELECT vec_id + 1 AS member_id, embedding::DOUBLE[] AS x, label::DOUBLE AS y FROM embeddings)
    SELECT m.member_id, CASE WHEN n.y < m.y THEN n.y ELSE m.y END AS y, round(CASE WHEN n.y < m.y THEN n.x[1] ELSE m.x[1] END, 6) AS x0 FROM m LEFT JOIN n USING (member_id)"""
)
def select_survivors(spark, sf):
    pop = _population(spark, sf)
    done = ev.select_survivors(pop, pop.withColumn("member_id", F.col("member_id") + 1))
    return done.select("member_id", "y", F.round(F.get("x", F.lit(0)), 6).alias("x0"))


def _population(spark, sf):
    e = c.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("member_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))


_READY = """WITH m AS (SELECT vec_id AS member_id, embedding::DOUBLE[] AS x, label AS y FROM embeddings), n AS (SELECT count(*) AS n FROM m), t AS (SELECT arg_min(x, (y, member_id)) AS b FROM m),
    q AS (SELECT a.member_id, a.x, p1.x AS p1, p2.x AS p2, p3.x AS p3, b FROM m a, n, t, m p1, m p2, m p3 WHERE p1.member_id = a.member_id AND p2.member_id = (a.member_id + 1) % n AND p3.member_id = (a.member_id + 3) % n),
    u AS (SELECT member_id, unnest(range(len(x))) AS k, unnest(x) AS x, unnest(p1) AS p1, unnest(p2) AS p2, unnest(p3) AS p3, unnest(b) AS b FROM q),
    r AS (SELECT *, (member_id * 7 + k * 3) % 10 / 10 AS j, member_id * 7 % 10 / 10 AS j0 FROM u)
    SELECT member_id, k, round(CASE WHEN (member_id + k) % 3 = 0 THEN {} ELSE x END, 6) AS x FROM r"""


def _evolved(spark, sf, strategy: str, generation: float | None = None) -> DataFrame:
    """One generation of whole vectors with the members' own order as the permutation; masks and jitter follow from ids and places."""
    pop = _population(spark, sf)
    best = ev.best_member(pop).select(F.col("member_id").alias("top")).join(pop, F.col("top") == F.col("member_id")).select(F.col("x").alias("best"))
    ready = ev.with_partners(pop.select("member_id", "x"), pop.count(), F.col("member_id")).join(F.broadcast(best))
    mask = F.transform("x", lambda _, k: ((F.col("member_id") + k) % 3 == 0).cast("int"))
    jitter = F.transform("x", lambda _, k: ((F.col("member_id") * 7 + k * 3) % 10) / 10) if generation is None else F.array(F.lit(generation))
    done = ev.evolve(ready.withColumn("mask", mask).withColumn("jitter", jitter), strategy, 0.7)
    return done.select("member_id", F.posexplode("x").alias("k", "x")).select("member_id", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"))


@job(_READY.format("p3 + 0.7::DOUBLE * (p1 - p2)"))
def evolve(spark, sf):
    return _evolved(spark, sf, "rand")


@job(_READY.format("x + 0.7::DOUBLE * (b - x) + 0.7::DOUBLE * (p1 - p2)"))
def evolve_local_to_best(spark, sf):
    return _evolved(spark, sf, "local_to_best")


@job(_READY.format("b + (p1 - p2) * (0.7::DOUBLE + 0.0001::DOUBLE * j)"))
def evolve_best_with_jitter(spark, sf):
    return _evolved(spark, sf, "best_with_jitter")


@job(_READY.format("p3 + (0.7::DOUBLE + 0.3::DOUBLE * j0) * (p1 - p2)"))
def evolve_per_vector_dither(spark, sf):
    return _evolved(spark, sf, "per_vector_dither")


@job(_READY.format("p3 + (0.7::DOUBLE + 0.3::DOUBLE * 0.35::DOUBLE) * (p1 - p2)"))
def evolve_per_generation_dither(spark, sf):
    return _evolved(spark, sf, "per_generation_dither", 0.35)


@job(_READY.format("CASE WHEN j0 < 0.5 THEN p3 + 0.7::DOUBLE * (p1 - p2) ELSE p3 + 0.85::DOUBLE * (p1 + p2 - 2 * p3) END"))
def evolve_either_or(spark, sf):
    return _evolved(spark, sf, "either_or")


@job(
    """WITH m AS (SELECT vec_id AS member_id, embedding::DOUBLE[] AS x, embedding[1] >= 0 AS good FROM embeddings),
    b1 AS (SELECT *, row_number() OVER (ORDER BY member_id) AS k FROM m WHERE NOT good), s1 AS (SELECT x AS x_, row_number() OVER (ORDER BY member_id) AS k FROM m WHERE good AND member_id % 5 = 0),
    b2 AS (SELECT b1.member_id, row_number() OVER (ORDER BY b1.member_id) AS k FROM b1 LEFT JOIN s1 USING (k) WHERE x_ IS NULL), s2 AS (SELECT x AS x_, row_number() OVER (ORDER BY member_id) AS k FROM m WHERE good AND member_id % 5 = 1),
    a AS (SELECT m.member_id, coalesce(s1.x_, s2.x_, m.x) AS x FROM m LEFT JOIN b1 ON b1.member_id = m.member_id LEFT JOIN s1 ON s1.k = b1.k LEFT JOIN b2 ON b2.member_id = m.member_id LEFT JOIN s2 ON s2.k = b2.k)
    SELECT member_id, unnest(range(len(x))) AS k, round(unnest(x), 6) AS x FROM a"""
)
def resample_invalid(spark, sf):
    """Two rounds of draws, each of a fifth of the vectors; members are invalid where their first coordinate is negative."""
    pop = _population(spark, sf).select("member_id", "x")
    done = ev.resample_invalid(pop, lambda k: pop.where(F.col("member_id") % 5 == k), F.get("x", F.lit(0)) >= 0, 2)
    return done.select("member_id", F.posexplode("x").alias("k", "x")).select("member_id", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"))


@job()
def draw_population(spark, sf):
    """As many members as there are vectors, in the box of their first two coordinates."""
    e = _population(spark, sf)
    x = lambda k: F.get("x", F.lit(k))
    box = e.agg(F.min(x(0)), F.min(x(1)), F.max(x(0)), F.max(x(1)), F.count("*")).first()
    return ev.draw_population(spark, box[4], [box[0], box[1]], [box[2], box[3]], 7)


@job("SELECT vec_id AS member_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)), 4) AS y FROM embeddings")
def evaluate_population(spark, sf):
    return ev.evaluate_population(_population(spark, sf), lambda x: (x**2).sum(axis=1)).select("member_id", F.round("y", 4).alias("y"))


@job()
def optimise_groups(spark, sf):
    """For each label, the point with the least summed distance to a centre that the label sets."""
    groups = c.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"))
    return ev.optimise_groups(groups, "label", lambda x, v: ((x - v) ** 2).sum(axis=1), [-20.0, -20.0], [20.0, 20.0], 30, 120)


@job()
def optimise(spark, sf):
    """A search for the point nearest to the mean of the vectors' first two coordinates, in their box and with as many members as there are vectors."""
    of = lambda f, k: f(F.get("x", F.lit(k)))
    r = _population(spark, sf).agg(*(of(f, k) for f in (F.avg, F.min, F.max) for k in (0, 1)), F.count("*")).first()
    return ev.optimise(spark, lambda p: (p[:, 0] - r[0]) ** 2 + (p[:, 1] - r[1]) ** 2, [r[2], r[3]], [r[4], r[5]], max(4, r[6]), 4)


QUERIES, ORACLES = job.queries, job.oracles
