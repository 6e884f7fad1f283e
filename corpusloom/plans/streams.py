"""Event logs: batch forms with SQL counterparts, and replay as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.sources import sinks
from corpusloom.sources.readers import table
from corpusloom.streaming import events, runs


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("""with e as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id) as epoch from events)
select event_id, user_id, epoch, row_number() over (partition by user_id, epoch order by ts, event_id) as seq from e""")
def event_seq(spark, sf_dir):
    """Sequence numbers with epochs."""
    return events.sequenced(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", "user_id", "epoch", "seq")


@query("""with e as (select *, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id) as epoch from events)
select event_id, user_id, epoch from (select *, max(epoch) over (partition by user_id) as newest from e) where epoch = newest""")
def event_last_epoch(spark, sf_dir):
    """Events of each key's newest epoch (Q3)."""
    e = events.sequenced(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "signup")
    return events.last_epoch(e, "user_id").select("event_id", "user_id", "epoch")


@query("""with f as (select user_id, min((ts, event_id)) as at from events where event_type = 'error' group by user_id)
select event_id, e.user_id, event_type from events e left join f on f.user_id = e.user_id where f.at is null or (ts, event_id) <= f.at""")
def event_terminal(spark, sf_dir):
    """Events up to the first terminal one (Q2)."""
    return events.until_terminal(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "event_type")


@query("""with g as (select *, epoch_us(ts) / 1e6 - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) / 1e6 as gap from events) select event_id, user_id, round(gap, 3) as gap_seconds from g where gap > 3600""")
def event_gaps(spark, sf_dir):
    """Idle gaps (Q4)."""
    return events.idle_gaps(_events(spark, sf_dir), "user_id", "ts", "event_id", 3600).select("event_id", "user_id", F.round("gap_seconds", 3).alias("gap_seconds"))


@query("""with g as (select *, case when ts < lag(ts) over w + interval 1 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(new) over (partition by user_id order by ts, event_id) as nth from g) select user_id, min(ts) as begins, max(ts) + interval 1 hour as ends, count(*) as n from s group by user_id, nth""")
def event_sessions(spark, sf_dir):
    """Sessions that an hour without an event ends (Q4)."""
    return events.sessions(_events(spark, sf_dir), "user_id", "ts", "1 hour")


@query("""select user_id, arg_max(event_type, (ts, event_id)) as event_type, count(*) as n_events from events group by user_id""")
def event_latest_state(spark, sf_dir):
    """The latest state of each key (Q9)."""
    return events.latest_state(_events(spark, sf_dir), "user_id", "event_type", ["ts", "event_id"])


@query("""with e as (select conv_id, turn, case when role = 'system' then 'tool' else 'think' end as kind, text as t from conversations),
n as (select *, case when kind = 'think' and lag(kind) over (partition by conv_id order by turn) = kind then 0 else 1 end as new from e), b as (select *, sum(new) over (partition by conv_id order by turn) as block from n)
select conv_id, block, min(kind) as kind, string_agg(t, '' order by turn) as t, count(*) as n from b group by conv_id, block""")
def timeline_fold(spark, sf_dir):
    """Neighbouring deltas of one kind joined (Q6)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", "tool").otherwise("think").alias("kind"), F.col("text").alias("t"))
    return events.timeline(c, "conv_id", "turn", "kind", "t", ["think"])


@query("""select user_id, min(event_id) filter (event_type = 'view') as started, min(event_id) filter (event_type = 'purchase') as ended, min(event_id) filter (event_type = 'purchase') is null as open from events where event_type in ('view', 'purchase') group by user_id""")
def tool_calls(spark, sf_dir):
    """Calls with their start and end; open ones closed (Q6)."""
    e = _events(spark, sf_dir).withColumn("call", F.lit(0))
    return events.calls(e, "user_id", "call", "event_type", "view", "purchase", "event_id").drop("call")


@query("""select event_type, count(*) as n, count(distinct user_id) as users from events group by event_type""")
def fan_in(spark, sf_dir):
    """Independent rows gathered by key (Q5)."""
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


def _log(spark, sf_dir):
    # a stream reads folders: the pattern is the table's own files
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "*").parquet(f"{sf_dir}/events.parquet*")


@query("""select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type""")
def stream_replay(spark, sf_dir):
    """The log as a stream from its start, aggregated, equal to the batch (Q1)."""
    totals = _log(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return events.settled(totals, sinks.work_folder(spark, "replay")).select("event_type", "n", F.round("total", 4).alias("total"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 hour then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as nth from g)
select user_id, min(ts) as started, max(ts) as last, count(*) as n from s group by user_id, nth""")
def stream_idle(spark, sf_dir):
    """Sessions that an idle hour ends, over the log as a stream (Q4)."""
    sessions = events.idle_sessions(_log(spark, sf_dir), "user_id", "ts", "1 hour", "30 days")
    return events.settled(sessions, sinks.work_folder(spark, "idle")).select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


_PAUSED = """with n as (select user_id as key, event_id as id, event_type as kind, row_number() over (partition by user_id order by ts, event_id) as nth from events),
s as (select *, coalesce(last_value(case kind when 'error' then true when 'signup' then false end ignore nulls) over (partition by key order by nth rows between unbounded preceding and 1 preceding), false) as waits from n),
e as (select * from (select *, min(case when kind = 'purchase' and waits then nth end) over (partition by key) as ended from s) where ended is null or nth <= ended),
k as (select *, waits and kind not in ('signup', 'purchase') as held from e where not (kind = 'error' and waits) and not (kind in ('signup', 'purchase') and not waits)),
d as (select *, case when not held then nth else min(case when kind = 'signup' then nth end) over (partition by key order by nth rows between 1 following and unbounded following) end as due from k)
select key, row_number() over (partition by key order by due, held::int, nth) as seq, id, kind from d where due is not null"""
_KINDS = runs.Kinds(asks=("error",), resumes=("signup",), cancels=("purchase",))


def _run_rows(e):
    return e.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))


@query(_PAUSED)
def paused_runs(spark, sf_dir):
    """Runs that wait for an answer, hold what comes and go on, or are cancelled (Q8)."""
    return runs.replayed(_run_rows(_events(spark, sf_dir)), _KINDS)


@query(_PAUSED)
def stream_paused_runs(spark, sf_dir):
    """The same over a stream of events and one of answers, in order whatever their micro-batches, with durable state (Q1, Q8)."""
    folder = sinks.work_folder(spark, "runs")
    # a row of no run, later than all others, at which the watermark passes them
    spark.createDataFrame([(-1, 1 << 52, -1, "step")], "key long, at long, id long, kind string").write.parquet(f"{folder}/end")
    end = lambda: spark.readStream.schema("key long, at long, id long, kind string").parquet(f"{folder}/end")
    answers = F.col("kind").isin(*_KINDS.resumes, *_KINDS.cancels)
    both = [_run_rows(_log(spark, sf_dir)).filter(x).unionByName(end()) for x in (~answers, answers)]
    with runs.durable(spark):
        runs.settle(runs.streamed(*both, _KINDS), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema("key long, seq long, id long, kind string").parquet(f"{folder}/out").filter("key != -1")
