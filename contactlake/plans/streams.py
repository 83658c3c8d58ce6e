"""Queries of the streaming worker: what the streams leave behind equals the batch result."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from contactlake.functions.values import EXPANSION_COUNTRIES
from contactlake.operators import directory as d
from contactlake.streaming import state as s
from contactlake.streaming import worker as w
from contactlake.streaming.drain import Drain

from .registry import query
from .relational import FINAL


def stream(t):
    return w.events_stream(t.spark, t._dir)


LOG = "select event_id as id, event_type as job, case when event_type = 'error' then 'error' else 'info' end as level from events"


@query("stream_log_append", LOG)
def stream_log_append(t):
    return w.append_log(stream(t), t.spark).select("id", "job", "level")


@query("sink_log_append", LOG + " order by event_id desc limit 300")
def sink_log_append(t):
    return w.newest(w.append_log(stream(t), t.spark)).select("id", "job", "level")


@query("stream_counters", "select event_type as job, count(*) as n, count(*) filter (event_type = 'error') as errors from events group by event_type")
def stream_counters(t):
    return w.counters(stream(t), t.spark)


@query("stream_incremental_merge", "select user_id, event_type, max(event_id) as event_id, arg_max(value, event_id) as value from events group by user_id, event_type")
def stream_incremental_merge(t):
    """Three batches; the table is read from the state store."""
    at = w.folder(t.spark, "merged")
    rows = s.arrived(t.events.select("user_id", "event_type", "event_id", "ts", "value"), "event_id", 3, at)
    table, _ = s.merged(rows, ["user_id", "event_type"], ["event_id", "ts", "value"], ["event_id", "ts"], at)
    return table.select("user_id", "event_type", "event_id", "value")


#: A row that ends a stream in tests and bounded runs: its time moves the watermark past all others.
END = {"ts": datetime.datetime(2200, 1, 1)}


def timed(t, name: str, machine, *columns, parts: int = 3):
    """What the machine tells of the events, as they arrive in files, in the order of their time: ids may say another."""
    at = w.folder(t.spark, name)
    rows = s.arrived(t.events.select(*columns, F.col("event_id").alias("n"), "ts"), s.micros("ts"), parts, at, END)
    return s.in_order(rows, machine, at)


DAY = 86_400


@query("stream_domain_cache", """
    with recursive u as (select concat('c', user_id, '.example.com') as domain, ts from events),
      l as (select domain, min(ts) as seen from u group by domain
        union all select l.domain, (select min(u.ts) from u where u.domain = l.domain and u.ts >= l.seen + interval 86400 second) as seen from l where l.seen is not null)
    select domain, seen, exists (select 1 from mx where mx.domain = l.domain) as has_mx,
      (select count(*) from u where u.domain = l.domain and u.ts >= l.seen and u.ts < l.seen + interval 86400 second) as uses from l where seen is not null""")
def stream_domain_cache(t):
    """Domains of a stream of addresses are looked up once while they are alive, a day, and again at their next use after that."""
    told = timed(t, "domains", s.Memo(ttl=DAY), F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("key"))
    known = t.mx.select(F.col("domain").alias("key"), F.lit(True).alias("known")).dropDuplicates(["key"])
    return told.join(known, "key", "left").select(F.col("key").alias("domain"), F.timestamp_micros("at").cast(t.events.schema["ts"].dataType).alias("seen"), F.coalesce("known", F.lit(False)).alias("has_mx"), "uses")


#: Fixed: how much each job takes from its queue in a cycle, and how many companies a country should have.
TAKES = {"discover": 1, "scrape": 2, "people": 2, "verify": 8}
ENOUGH = 65


def queues(companies, emails, people, scrapes, cursor: int = 0, takes=TAKES, enough: int = ENOUGH):
    """(queue, pos, item): what each job takes next. discover: the country with the fewest companies if they aren't enough, else one of those it may expand to, in turn by cursor."""
    live = d.filtered(companies)
    few = live.where("country <> 'Unknown'").groupBy("country").agg(F.count("*").alias("c")).where(F.col("c") < enough).orderBy("c", "country").limit(takes["discover"]).select("country")
    pool = companies.sparkSession.createDataFrame(list(enumerate(EXPANSION_COUNTRIES)), "i int, country string")
    left = pool.join(live.select("country").distinct(), "country", "left_anti")
    size = left.agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, F.col("n")).otherwise(F.lit(len(EXPANSION_COUNTRIES))).alias("n"), (F.col("n") == 0).alias("all"))
    numbered = left.withColumn("all", F.lit(False)).unionByName(pool.withColumn("all", F.lit(True))).withColumn("k", F.row_number().over(Window.partitionBy("all").orderBy("i")) - 1)  # a fixed list
    turn = numbered.join(F.broadcast(size), "all").where(F.col("k") == F.lit(cursor) % F.col("n")).select("country")
    countries = few.withColumn("p", F.lit(0)).unionByName(turn.withColumn("p", F.lit(1))).orderBy("p").limit(takes["discover"]).select(F.lit("discover").alias("queue"), F.lit(1).alias("pos"), F.col("country").alias("item"))

    def first(rows, name: str):
        taken = d.by_size(rows).limit(takes[name])
        pos = F.row_number().over(Window.orderBy(F.col("employees").desc_nulls_last(), "name", "id"))  # of the few rows taken
        return taken.select(F.lit(name).alias("queue"), pos.alias("pos"), F.col("name").alias("item"))

    pending = emails.where(F.col("verdict").isNull() | ~F.col("verdict").isin(*FINAL)).orderBy("id").limit(takes["verify"])
    verify = pending.select(F.lit("verify").alias("queue"), F.row_number().over(Window.orderBy("id")).alias("pos"), F.col("email").alias("item"))
    return countries.unionByName(first(d.without(live, scrapes), "scrape")).unionByName(first(d.without(live, people), "people")).unionByName(verify)


@query("stream_queue_drain", f"""
    with live as (select * from companies where not blocked)
    select 'discover' as queue, 1 as pos, coalesce((select country from live where country <> 'Unknown' group by country having count(*) < 65 order by count(*), country limit 1), '{EXPANSION_COUNTRIES[3]}') as item
    union all select 'scrape', rn::int, name from (select name, row_number() over (order by employees desc nulls last, name, id) as rn from live where id not in (select company_id from scrapes)) a where rn <= 2
    union all select 'people', rn::int, name from (select name, row_number() over (order by employees desc nulls last, name, id) as rn from live where id not in (select company_id from people)) b where rn <= 2
    union all select 'verify', rn::int, email from (select email, row_number() over (order by id) as rn from emails where verdict is null or verdict not in ('deliverable', 'rejected', 'catchall', 'invalid', 'disposable')) c where rn <= 8""")
def stream_queue_drain(t):
    return queues(t.companies, t.emails, t.people, t.scrapes, cursor=3)


def admitted(t):
    """What a cycle takes of the tables' queues; items that earlier cycles took have left them."""

    def admit(taken, cursors):
        gone = lambda queue, key: taken.where(F.col("queue") == queue).select(F.col("item").alias(key))
        left = lambda rows, queue, key: rows.join(gone(queue, key), key, "left_anti")
        done = lambda facts, queue: facts.select("company_id").unionByName(t.companies.join(gone(queue, "name"), "name", "left_semi").select(F.col("id").alias("company_id")))
        return queues(t.companies, left(t.emails, "verify", "email"), done(t.people, "people"), done(t.scrapes, "scrape"), cursors.get("discover", 0))

    return admit


CYCLES = 3


@query("stream_queue_cycles", f"""
    with live as (select * from companies where not blocked), cycles as (select unnest(range({CYCLES})) as cycle),
      pool as (select coalesce((select list(c order by i) from (select unnest({list(EXPANSION_COUNTRIES)}) as c, unnest(range({len(EXPANSION_COUNTRIES)})) as i) x where c not in (select country from live where country is not null)), {list(EXPANSION_COUNTRIES)}) as p)
    select cycle, 'discover' as queue, 1 as pos, coalesce((select country from live where country <> 'Unknown' group by country having count(*) < 65 order by count(*), country limit 1), p[cycle % len(p) + 1]) as item from cycles, pool
    union all select (rn - 1) // 2, 'scrape', ((rn - 1) % 2 + 1)::int, name from (select name, row_number() over (order by employees desc nulls last, name, id) as rn from live where id not in (select company_id from scrapes)) a where rn <= 2 * {CYCLES}
    union all select (rn - 1) // 2, 'people', ((rn - 1) % 2 + 1)::int, name from (select name, row_number() over (order by employees desc nulls last, name, id) as rn from live where id not in (select company_id from people)) b where rn <= 2 * {CYCLES}
    union all select (rn - 1) // 8, 'verify', ((rn - 1) % 8 + 1)::int, email from (select email, row_number() over (order by id) as rn from emails where verdict is null or verdict not in ('deliverable', 'rejected', 'catchall', 'invalid', 'disposable')) c where rn <= 8 * {CYCLES}""")
def stream_queue_cycles(t):
    """What three cycles take, the last of them in a run of its own on the same folder."""
    at = w.folder(t.spark, "drain")
    drain = Drain(t.spark, admitted(t), at)
    ticks = t.events.select("event_id", "ts")
    drain.run(s.arrived(ticks, "event_id", CYCLES - 1, at))
    return Drain(t.spark, admitted(t), at).run(s.arrived(ticks.limit(1), "event_id", 1, at))


@query("stream_throttle_breaker", """
    with e as (select event_id, user_id, event_id % 7 as found, row_number() over (partition by user_id order by event_id) as i, event_type in ('error', 'click') as bad from events),
      g as (select *, sum(case when bad then 0 else 1 end) over (partition by user_id order by i) as grp, case when not bad and row_number() over (partition by user_id, found, bad order by i) = 1 then 1 else 0 end as fresh from e),
      k as (select *, sum(case when bad then 1 else 0 end) over (partition by user_id, grp order by i) as misses, sum(fresh) over (partition by user_id order by i) as have from g),
      c as (select user_id, min(i) as cut from k where misses >= 3 or have >= 4 group by user_id)
    select e.event_id from e left join c on c.user_id = e.user_id where c.cut is null or e.i <= c.cut""")
def stream_throttle_breaker(t):
    """Queries of a run up to the third miss in a row, or the one after which twice the wanted domains (2) are known; three batches."""
    told = timed(t, "breaker", s.Breaker(misses=3, enough=2 * 2), F.col("user_id").alias("key"), (F.col("event_id") % 7).alias("found"), F.col("event_type").isin("error", "click").alias("bad"))
    return told.where("what = 'asked'").select(F.col("n").alias("event_id"))


#: Queries up to the third miss in a row; half a day later the breaker is closed again.
REST = DAY // 2


@query("stream_breaker_closes", f"""
    with recursive e as (select user_id, event_id, ts, event_type in ('error', 'click') as bad, row_number() over (partition by user_id order by event_id) as i from events),
      run as (select user_id, i, event_id, ts, bad::int as misses, null::timestamp as since from e where i = 1
        union all select user_id, i, event_id, ts, case when held then 0 when opened is not null then bad::int when not bad then 0 else misses + 1 end, case when held then opened end
        from (select *, coalesce(ts < opened + interval {REST} second, false) as held from (select e.*, run.misses, case when run.since is not null then run.since when run.misses >= 3 then run.ts end as opened from run join e on e.user_id = run.user_id and e.i = run.i + 1) x) y),
      fixed as (select user_id, i, event_id, ts, since is not null as held from run)
    select event_id from fixed where not held""")
def stream_breaker_closes(t):
    """Timers close an open breaker: what is asked before, between and after."""
    told = timed(t, "breaker", s.Breaker(misses=3, enough=1 << 30, cooldown=REST), F.col("user_id").alias("key"), F.lit(0).cast("long").alias("found"), F.col("event_type").isin("error", "click").alias("bad"))
    return told.where("what = 'asked'").select(F.col("n").alias("event_id"))


STATUS = "case event_type when 'click' then 429 when 'signup' then 503 when 'purchase' then 404 when 'view' then 200 end"


@query("stream_retry_backoff", f"""
    with t as (select user_id, {STATUS} as status, row_number() over (partition by user_id order by event_id) - 1 as n from events),
      l as (select user_id, coalesce(min(n) filter (n = 2 or status in (404, 200)), max(n)) as last from t where n <= 2 group by user_id)
    select user_id, status::int as status, (n + 1)::int as tries, 1.5::double * n * (n + 1) / 2 as waited, status is null as failed from t join l using (user_id) where n = last""")
def stream_retry_backoff(t):
    """Tries of a client that backs off in even steps from busy servers and broken connections: its last one."""
    told = timed(t, "backoff", s.Backoff(), F.col("user_id").alias("key"), F.expr(STATUS).cast("int").alias("status")).where("what = 'answer'")
    last = told.groupBy("key").agg(F.max_by(F.struct("status", "tries", "waited", "failed"), "tries").alias("x"))
    return last.select(F.col("key").alias("user_id"), "x.status", "x.tries", (F.col("x.waited") / F.lit(float(s.SECOND))).alias("waited"), "x.failed")


@query("stream_retry_due", f"""
    with t as (select user_id, ts, {STATUS} as status, row_number() over (partition by user_id order by event_id) - 1 as n, lead(ts) over (partition by user_id order by event_id) as next from events),
      l as (select user_id, coalesce(min(n) filter (n = 2 or status in (404, 200)), max(n) + 1) as last from t where n <= 2 group by user_id)
    select user_id, (n + 2)::int as tries, ts + (1500000 * (n + 1)) * interval 1 microsecond as due from t join l using (user_id) where n < last and (next is null or next >= ts + (1500000 * (n + 1)) * interval 1 microsecond)""")
def stream_retry_due(t):
    """When timers told a client to try again: its answer had not come before."""
    told = timed(t, "backoff", s.Backoff(), F.col("user_id").alias("key"), F.expr(STATUS).cast("int").alias("status")).where("what = 'due'")
    return told.select(F.col("key").alias("user_id"), "tries", F.timestamp_micros("at").cast(t.events.schema["ts"].dataType).alias("due"))


def _count(batch) -> int:
    return batch.count()


def _checked(batch) -> int:
    """A job that fails on a batch with errors."""
    if n := batch.where("event_type = 'error'").count():
        raise ValueError(f"{n} failed")
    return 0


JOBS = {"discover": lambda b: b.select("user_id").distinct().count(), "scrape": _count, "people": lambda b: b.where("event_type = 'purchase'").count(), "verify": _checked}


def _worked(t, parts: int = 3):
    """The log of a worker whose events arrive in parts."""
    at = w.folder(t.spark, "worker")
    k = w.Worker(t.spark, s.arrived(t.events, "event_id", parts, at), JOBS, at=at)
    k.start(once=True).awaitTermination()
    k.close()
    return k.log()


def _ran(t) -> w.Worker:
    k = w.Worker(t.spark, stream(t), JOBS)
    k.start(once=True).awaitTermination()
    return k


PARTS = "e as (select *, least(floor((event_id - (select min(event_id) from events)) * 3 / (select max(event_id) - min(event_id) + 1 from events)), 2)::bigint as epoch from events)"


@query("stream_worker_loop", f"""
    with {PARTS} select epoch, 0 as pos, 'discover' as job, count(distinct user_id) as result from e group by epoch union all select epoch, 1, 'scrape', count(*) from e group by epoch
    union all select epoch, 2, 'people', count(*) filter (event_type = 'purchase') from e group by epoch union all select epoch, 3, 'verify', case when count(*) filter (event_type = 'error') = 0 then 0 end from e group by epoch""")
def stream_worker_loop(t):
    """Three cycles of four jobs, each in turn, and what they told."""
    return _worked(t).select("epoch", "pos", "job", "result")


@query("stream_job_error_isolation", f"""
    with {PARTS}, v as (select epoch, count(*) filter (event_type = 'error') as n from e group by epoch)
    select epoch, job, case when job = 'verify' and n > 0 then concat('ValueError: ', n, ' failed') end as error from v, (values ('discover'), ('scrape'), ('people'), ('verify')) j(job)""")
def stream_job_error_isolation(t):
    """A job that fails on what a batch holds is noted, and the others and the next cycles go on."""
    return _worked(t).select("epoch", "job", "error")


@query("stream_heartbeat", "select false as running, 1::bigint as cycles, (select count(*) from events) as rows")
def stream_heartbeat(t):
    """The status after a run: what the last progress told."""
    k = _ran(t)
    now = k.status()
    k.close()
    return t.spark.createDataFrame([(now["running"], now["cycles"], now["last"]["numInputRows"])], "running boolean, cycles long, rows long")


@query("stream_stop_wake", "select true as after_wake, false as after_stop, 1::bigint as cycles")
def stream_stop_wake(t):
    """Woken, the worker runs a cycle at once and goes on; a second start changes nothing; stopped, it rests."""
    k = w.Worker(t.spark, stream(t), {"discover": _count}, every="1 hour")
    k.wake()
    after_wake = k.running and k.start() is k.query
    k.stop()
    now = k.status()
    k.close()
    return t.spark.createDataFrame([(after_wake, now["running"], now["cycles"])], "after_wake boolean, after_stop boolean, cycles long")


@query("window_tumbling_extra", "select date_trunc('hour', ts) as hour, count(*) as n from events group by 1")
def window_tumbling_extra(t):
    """Extra: event-time windows, which no query above needs."""
    return t.events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "n")
