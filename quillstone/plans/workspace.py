"""Queries of workspace accounting and calibration, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import score as sc
from quillstone.operators import workspace as w
from quillstone.sources import tables as t

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def pick(n, values) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


CALLS = """calls AS (SELECT 'c' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS call, 'j' || CAST(event_id % 400 AS VARCHAR) AS job, 'shelf' || CAST(user_id % 3 AS VARCHAR) AS shelf, ['high', 'med', 'low'][CAST(event_id % 3 + 1 AS INTEGER)] AS prio,
    ['interactive', 'batch', 'background'][CAST(user_id % 3 + 1 AS INTEGER)] AS class, (event_id * 7919) % 100003 AS vft, CASE WHEN event_id % 4 <> 0 THEN (event_id * 31) % 5000 END AS deadline, event_id AS seq, CAST(event_id % 50 + 1 AS DOUBLE) AS cost FROM events)"""


def calls(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    return t.table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.lpad(n.cast("string"), 9, "0")).alias("call"), F.concat(F.lit("j"), (n % 400).cast("string")).alias("job"), F.concat(F.lit("shelf"), (F.col("user_id") % 3).cast("string")).alias("shelf"), pick(n, ("high", "med", "low")).alias("prio"),
        pick(F.col("user_id"), ("interactive", "batch", "background")).alias("class"), (n * 7919 % 100003).alias("vft"), F.when(n % 4 != 0, n * 31 % 5000).alias("deadline"), n.alias("seq"), (n % 50 + 1).cast("double").alias("cost"),
    )


_RANK = f"{CALLS}, r AS (SELECT *, coalesce(deadline <= 2500, false) AS starved, row_number() OVER (PARTITION BY shelf ORDER BY CASE WHEN deadline <= 2500 THEN 0 ELSE 1 END, CASE WHEN deadline <= 2500 THEN deadline ELSE vft END, call) AS position FROM calls)"


def ranked(spark, sf_dir) -> DataFrame:
    return w.queue_rank(calls(spark, sf_dir), F.lit(2500))


@query(f"WITH {_RANK} SELECT call, shelf, starved, position FROM r")
def queue_rank(spark, sf_dir) -> DataFrame:
    return ranked(spark, sf_dir).select("call", "shelf", "starved", F.col("position").cast("long").alias("position"))


@query(f"WITH {_RANK} SELECT job, count(*) AS calls, min(position) AS position, bool_or(starved) AS starved FROM r GROUP BY job")
def job_panel(spark, sf_dir) -> DataFrame:
    return ranked(spark, sf_dir).groupBy("job").agg(F.count(F.lit(1)).alias("calls"), F.min("position").cast("long").alias("position"), F.max("starved").alias("starved"))


_WEIGHT = "(CASE class WHEN 'interactive' THEN 100 WHEN 'batch' THEN 10 ELSE 1 END * CASE prio WHEN 'high' THEN 4 WHEN 'med' THEN 2 ELSE 1 END)"


@query(f"WITH {CALLS} SELECT call, round(greatest(120.0, 100.0) + sum(cost / {_WEIGHT}) OVER (PARTITION BY prio, class ORDER BY seq ROWS UNBOUNDED PRECEDING), 6) AS vft FROM calls")
def vft_running(spark, sf_dir) -> DataFrame:
    return w.virtual_finish(calls(spark, sf_dir).withColumn("last_vft", F.lit(100.0)), F.lit(120.0)).select("call", F.round("vft", 6).alias("vft"))


_USERS = """users AS (SELECT c_custkey AS user_id, c_custkey % 19 = 0 AS held, c_custkey * 37 % 1000 AS tokens, CASE WHEN c_custkey % 3 <> 0 THEN 800 END AS token_limit, c_custkey * 11 % 100 AS money, CASE WHEN c_custkey % 4 <> 0 THEN 90 END AS money_limit, c_custkey % 7 AS flying, CASE WHEN c_custkey % 5 <> 0 THEN 5 END AS conc_limit FROM customer)"""


@query(f"WITH {_USERS} SELECT user_id, CASE WHEN held THEN 'allow:reused' WHEN tokens >= token_limit THEN 'deny:quota_tokens_exhausted' WHEN money >= money_limit THEN 'park:budget_ext_exhausted' WHEN flying >= conc_limit THEN 'deny:quota_conc_exceeded' ELSE 'allow' END AS verdict FROM users")
def admission(spark, sf_dir) -> DataFrame:
    n = F.col("c_custkey")
    users = t.table(spark, sf_dir, "customer").select(n.alias("user_id"), (n % 19 == 0).alias("held"), (n * 37 % 1000).alias("tokens"), F.when(n % 3 != 0, 800).alias("token_limit"), (n * 11 % 100).alias("money"), F.when(n % 4 != 0, 90).alias("money_limit"), (n % 7).alias("flying"), F.when(n % 5 != 0, 5).alias("conc_limit"))
    return w.admission(users).select("user_id", "verdict")


SPEND = """spend AS (SELECT o_custkey AS user, strftime(o_orderdate, '%Y-%m') AS month, CAST(l_quantity * 100 AS BIGINT) AS tin, CAST(l_quantity * 10 AS BIGINT) AS tout FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
_COST = "((tin * 24000000 + 500000) // 1000000 + (tout * 96000000 + 500000) // 1000000)"


def spend(spark, sf_dir) -> DataFrame:
    o = t.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    l = t.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") * 100).cast("long").alias("tin"), (F.col("l_quantity") * 10).cast("long").alias("tout"))  # noqa: E741
    return l.join(o, l.l_orderkey == o.o_orderkey).withColumn("micro", sc.cost_micro(F.col("tin"), F.col("tout"), F.lit(24_000_000), F.lit(96_000_000)))


@query(f"WITH {SPEND} SELECT user, CAST(sum({_COST}) AS BIGINT) AS micro FROM spend GROUP BY user")
def cost_micro(spark, sf_dir) -> DataFrame:
    return spend(spark, sf_dir).groupBy("user").agg(F.sum("micro").alias("micro"))


@query(f"WITH {SPEND} SELECT month, user, CAST(sum({_COST}) AS BIGINT) AS micro FROM spend GROUP BY month, user UNION ALL SELECT month, NULL, CAST(sum({_COST}) AS BIGINT) FROM spend GROUP BY month")
def budget_reconcile(spark, sf_dir) -> DataFrame:
    return w.reconcile_budget(spend(spark, sf_dir)).select("month", "user", "micro")


@query("WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT user_id, i, value AS ema FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.i, 0.3 * s.value + 0.7 * f.ema FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1) SELECT user_id, round(arg_max(ema, i), 4) AS ema FROM f GROUP BY user_id")
def ema(spark, sf_dir) -> DataFrame:
    return w.ema(t.table(spark, sf_dir, "events").withColumn("seq", F.col("event_id")), "user_id").withColumn("ema", F.round("ema", 4))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def p95(spark, sf_dir) -> DataFrame:
    return w.p95(t.table(spark, sf_dir, "events"), "event_type")


@query(f"WITH {_RANK} SELECT call, CAST(greatest(0, position - 1) * 2.5 AS DOUBLE) AS eta_low, CAST(greatest(1, position) * 7.5 AS DOUBLE) AS eta_high FROM r")
def eta_range(spark, sf_dir) -> DataFrame:
    low, high = w.eta_range(F.col("position"), F.lit(2.5), F.lit(7.5))
    return ranked(spark, sf_dir).select("call", low.alias("eta_low"), high.alias("eta_high"))


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY floor(epoch(ts)) DESC, event_id DESC) AS rn FROM events WHERE floor(epoch(ts)) > 1706572800 - 86400 AND floor(epoch(ts)) <= 1706572800)
    SELECT event_type, event_id FROM r WHERE rn <= 20""")
def observation_window(spark, sf_dir) -> DataFrame:
    e = t.table(spark, sf_dir, "events").withColumns({"at": F.unix_timestamp("ts"), "seq": F.col("event_id")})
    return w.latest_window(e, "event_type", F.lit(1706572800), most=20).select("event_type", "event_id")


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS sec, 1 + event_id % 3 AS c, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS i FROM events),
    b AS (SELECT user_id, event_id, i, sec, c <= 5.0 AS allowed, CAST(CASE WHEN c <= 5.0 THEN 5.0 - c ELSE 5.0 END AS DOUBLE) AS tokens FROM r WHERE i = 1
     UNION ALL SELECT r.user_id, r.event_id, r.i, r.sec, least(5.0, b.tokens + (r.sec - b.sec) * 0.0001) >= r.c, least(5.0, b.tokens + (r.sec - b.sec) * 0.0001) - CASE WHEN least(5.0, b.tokens + (r.sec - b.sec) * 0.0001) >= r.c THEN r.c ELSE 0 END FROM b JOIN r ON r.user_id = b.user_id AND r.i = b.i + 1)
    SELECT event_id AS seq, allowed FROM b""")
def token_bucket(spark, sf_dir) -> DataFrame:
    r = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.unix_timestamp("ts").cast("double").alias("ts"), F.col("event_id").alias("seq"), (1 + F.col("event_id") % 3).alias("count"))
    return w.token_bucket(r, 0.0001, 5.0).select("seq", "allowed")


RUNS = """runs AS (SELECT doc_id // 12 AS task, ['public', 'private', 'unknown'][CAST(doc_id // 12 % 3 + 1 AS INTEGER)] AS zone, ['golden', 'heldout', 'needle'][CAST(doc_id % 3 + 1 AS INTEGER)] AS set, doc_id % 4 AS run, 'shelf' || CAST(doc_id // 12 % 5 AS VARCHAR) AS shelf,
    0.7 + quality * 0.2 + toxic * 0.05 + doc_id % 7 / 100.0 AS score, doc_id % 29 <> 0 AS parsed, doc_id % 1000 AS tokens FROM labels)"""


def runs(spark, sf_dir) -> DataFrame:
    n = F.col("doc_id")
    task = F.expr("doc_id div 12")
    return t.table(spark, sf_dir, "labels").select(task.alias("task"), pick(task, ("public", "private", "unknown")).alias("zone"), pick(n, ("golden", "heldout", "needle")).alias("set"), (n % 4).alias("run"), F.concat(F.lit("shelf"), (task % 5).cast("string")).alias("shelf"), (0.7 + F.col("quality") * 0.2 + F.col("toxic") * 0.05 + n % 7 / 100.0).alias("score"), (n % 29 != 0).alias("parsed"), (n % 1000).alias("tokens"))


@query(f"""WITH {RUNS}, g AS (SELECT task, zone, count(*) AS n, round(avg(CAST(score AS DOUBLE)), 6) AS mean, round(CAST(max(score) - min(score) AS DOUBLE), 6) AS spread, CAST(CASE zone WHEN 'public' THEN 0.80 ELSE 0.85 END AS DOUBLE) AS floor FROM runs GROUP BY task, zone)
    SELECT *, CASE WHEN mean < floor THEN 'local-draft' ELSE 'final' END AS marker, spread > 0.15 AS flagged FROM g WHERE n >= 3""")
def q_report(spark, sf_dir) -> DataFrame:
    return w.q_report(runs(spark, sf_dir))


@query(f"WITH {RUNS} SELECT shelf, round(avg(m), 6) AS mean FROM (SELECT shelf, task, avg(CAST(score AS DOUBLE)) AS m FROM runs GROUP BY ALL) GROUP BY shelf")
def by_shelf(spark, sf_dir) -> DataFrame:
    return w.by_shelf(runs(spark, sf_dir))


@query(f"""WITH {RUNS}, g AS (SELECT set, round(CAST(median(score) AS DOUBLE), 6) AS median, round(CAST(max(score) - min(score) AS DOUBLE), 6) AS spread, round(avg(CAST(parsed AS DOUBLE)), 6) AS parse_rate, count(DISTINCT run) AS n_runs, CAST(sum(tokens) AS BIGINT) AS tokens FROM runs GROUP BY set)
    SELECT *, array_to_string(list_filter([CASE WHEN spread > 0.15 THEN 'unstable_cell' END, CASE WHEN parse_rate < 1 THEN 'parse_fail' END, CASE WHEN n_runs < 3 THEN 'n_runs_lt3' END, CASE WHEN median >= 0.999 AND spread = 0 THEN 'ceiling' END], lambda x: x IS NOT NULL), ',') AS flags FROM g""")
def probe_report(spark, sf_dir) -> DataFrame:
    return w.probe_report(runs(spark, sf_dir))


_PROMO = """p AS (SELECT p_partkey AS id, 0.7 + p_partkey % 7 * 0.05 AS bm, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE 0.1 END AS bs, 0.75 + p_partkey % 6 * 0.05 AS vm, CASE WHEN p_partkey % 6 = 5 THEN 0.0 ELSE 0.1 END AS vs, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey % 10 / 10.0 END AS bn, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 11 / 10.0 END AS vn, 0.8 + p_partkey % 3 * 0.05 AS fl, p_partkey % 4 AS rub, p_partkey % 5 AS wall, 0.9 AS g, 0.9 - p_partkey % 2 * 0.05 AS h FROM part)"""


@query(f"""WITH {_PROMO} SELECT id, coalesce(CASE WHEN (bm >= 0.999 AND bs = 0) OR (vm >= 0.999 AND vs = 0) THEN bn < 0.5 AND vn >= 0.5 AND vn - bn > 0 AND vn - bn >= 0.2 ELSE bm < fl AND (vn IS NULL OR vn >= 0.5) END, false)
    AND vm >= fl AND rub <= 2 AND wall <= 3 AND abs(g - h) <= greatest(vs, 0.000000001) AS promoted FROM p""")
def promotion(spark, sf_dir) -> DataFrame:
    n = F.col("p_partkey")
    d = lambda c, digits=2: F.round(c, digits)
    p = t.table(spark, sf_dir, "part").select(
        n.alias("id"), d(0.7 + n % 7 * 0.05).alias("base_median"), F.when(n % 5 == 0, 0.0).otherwise(0.1).alias("base_spread"), d(0.75 + n % 6 * 0.05).alias("variant_median"), F.when(n % 6 == 5, 0.0).otherwise(0.1).alias("variant_spread"),
        F.when(n % 8 != 0, d(n % 10 / 10)).alias("base_needle"), F.when(n % 9 != 0, d(n % 11 / 10)).alias("variant_needle"), d(0.8 + n % 3 * 0.05).alias("floor"), (n % 4).alias("rub"), F.lit(2).alias("rub_cap"), (n % 5).alias("wall"), F.lit(3).alias("wall_cap"), F.lit(0.9).alias("golden"), d(0.9 - n % 2 * 0.05).alias("heldout"), F.lit(0.15).alias("quantum"),
    )
    return w.promotion(p).select("id", "promoted")


ORACLE["promotion"] = ORACLE["promotion"].replace("vn - bn >= 0.2", "vn - bn >= 0.15")


@query("SELECT event_type AS kind, 'shelf' || CAST(user_id % 3 AS VARCHAR) AS shelf, count(*) AS calls, count(*) FILTER (event_id % 4 = 0) AS cached, CAST(sum(event_id % 100) AS BIGINT) AS tokens FROM events GROUP BY ALL")
def node_usage(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    return t.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), F.concat(F.lit("shelf"), (F.col("user_id") % 3).cast("string")).alias("shelf")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(n % 4 == 0).alias("cached"), F.sum(n % 100).alias("tokens"))


_BOARD = "o AS (SELECT conv_id, turn, text AS v FROM conversations WHERE turn % 4 <> 3), n AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN text || '!' WHEN conv_id % 7 = 0 THEN NULL ELSE text END AS v FROM conversations WHERE turn % 4 <> 2)"


@query(f"""WITH {_BOARD}, j AS (SELECT conv_id, turn, CASE WHEN o.turn IS NULL THEN 'added' WHEN n.turn IS NULL THEN 'removed' WHEN o.v IS DISTINCT FROM n.v THEN 'changed' END AS state FROM o FULL JOIN n USING (conv_id, turn)) SELECT * FROM j WHERE state IS NOT NULL""".replace("o.turn IS NULL", "o.t2 IS NULL").replace("n.turn IS NULL", "n.t2 IS NULL").replace("text AS v FROM", "turn AS t2, text AS v FROM").replace("CASE WHEN conv_id % 3", "turn AS t2, CASE WHEN conv_id % 3"))
def board_diff(spark, sf_dir) -> DataFrame:
    c = t.table(spark, sf_dir, "conversations")
    value = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit("!"))).when(F.col("conv_id") % 7 != 0, F.col("text"))
    return w.diff(c.where("turn % 4 <> 3").select("conv_id", "turn", F.col("text").alias("v")), c.where("turn % 4 <> 2").select("conv_id", "turn", value.alias("v")), ["conv_id", "turn"], "v")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'full' WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 'full' ELSE 'delta' END AS mode FROM part""")
def context_mode(spark, sf_dir) -> DataFrame:
    n = F.col("p_partkey")
    referenced = F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    changed = F.array_compact(F.array(F.when(n % 3 != 0, "a"), F.when(n % 5 != 0, "b"), F.lit("c")))
    return t.table(spark, sf_dir, "part").select(n.alias("id"), w.context_mode(referenced, changed).alias("mode"))


_STATES = ("queued", "running", "waiting_human", "sleeping", "preempted", "parked", "done", "failed", "cancelled")
_PICK = "['queued', 'running', 'waiting_human', 'sleeping', 'preempted', 'parked', 'done', 'failed', 'cancelled'][CAST({} % 9 + 1 AS INTEGER)]"


@query(f"""WITH s AS (SELECT o_orderkey AS id, {_PICK.format('o_orderkey')} AS f, {_PICK.format('o_custkey')} AS t FROM orders)
    SELECT id, f AS from_state, t AS to_state FROM s WHERE NOT ((f = 'queued' AND t IN ('running', 'cancelled', 'failed', 'parked')) OR (f = 'running' AND t <> 'running')
      OR (f = 'waiting_human' AND t IN ('running', 'cancelled', 'failed')) OR (f = 'sleeping' AND t IN ('running', 'cancelled', 'failed', 'parked'))
      OR (f = 'preempted' AND t IN ('running', 'queued', 'cancelled', 'failed', 'parked')) OR (f = 'parked' AND t IN ('queued', 'cancelled', 'failed')) OR (f = 'failed' AND t = 'queued'))""")
def illegal_transitions(spark, sf_dir) -> DataFrame:
    return w.illegal_transitions(t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), pick(F.col("o_orderkey"), _STATES).alias("from_state"), pick(F.col("o_custkey"), _STATES).alias("to_state")))


@query("WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, turn FROM r WHERE back <= 3")
def history_last_n(spark, sf_dir) -> DataFrame:
    return w.last_n(t.table(spark, sf_dir, "conversations").withColumn("seq", F.col("turn")), ["conv_id"], 3).select("conv_id", "turn")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name LIKE '%\\_1%' ESCAPE '\\' OR c_name LIKE '%00012%' ORDER BY c_custkey DESC LIMIT 40")
def access_list(spark, sf_dir) -> DataFrame:
    c = t.table(spark, sf_dir, "customer")
    hit = (F.col("c_mktsegment") == "BUILDING") & F.expr(r"c_name like '%\\_1%' escape '\\'") | F.col("c_name").like("%00012%")
    return c.where(hit).orderBy(F.desc("c_custkey")).limit(40).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 200 END, c_custkey % 120) >= 90""")
def stale_tokens(spark, sf_dir) -> DataFrame:
    n = F.col("c_custkey")
    idle = F.coalesce(F.when(n % 4 != 0, n % 200), n % 120)
    return t.table(spark, sf_dir, "customer").where((n % 3 != 0) & (n % 5 != 0) & (idle >= 90)).select(n.alias("id"))


@query("""WITH f AS (SELECT p_brand AS cache, p_partkey AS name, p_partkey % 97 AS used, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey % 97 DESC, p_partkey DESC ROWS UNBOUNDED PRECEDING) AS held FROM part) SELECT cache, name FROM f WHERE held > 500""")
def lru_evict(spark, sf_dir) -> DataFrame:
    files = t.table(spark, sf_dir, "part").select(F.col("p_brand").alias("cache"), F.col("p_partkey").alias("name"), (F.col("p_partkey") % 97).alias("used"), F.col("p_size").alias("size"))
    return w.lru_evict(files, 500).select("cache", "name")


@query("SELECT p_partkey AS id, CAST(coalesce(greatest(1, floor((8000 - p_size * 100 - 500 - 200) / nullif(p_partkey % 5 * 300, 0))), 1) AS BIGINT) AS k FROM part")
def gpu_k(spark, sf_dir) -> DataFrame:
    return t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), w.gpu_slots(F.lit(8000), F.col("p_size") * 100, F.lit(500), F.lit(200), F.col("p_partkey") % 5 * 300).alias("k"))


EDGES = """edges AS (SELECT DISTINCT s_suppkey % 40 AS g, s_suppkey % 53 AS src, (s_suppkey % 53 * 5 + s_suppkey % 3 * 7 + 1) % 53 AS dst FROM supplier),
    walk(g, src, dst) AS (SELECT g, src, dst FROM edges UNION SELECT w.g, w.src, e.dst FROM walk w JOIN edges e ON e.g = w.g AND e.src = w.dst)"""


def edges(spark, sf_dir) -> DataFrame:
    n = F.col("s_suppkey")
    return t.table(spark, sf_dir, "supplier").select((n % 40).alias("g"), (n % 53).alias("src"), ((n % 53 * 5 + n % 3 * 7 + 1) % 53).alias("dst")).distinct()


@query(f"WITH RECURSIVE {EDGES} SELECT DISTINCT g, src AS node FROM walk WHERE src = dst")
def dag_cycles(spark, sf_dir) -> DataFrame:
    return w.reachable(spark, edges(spark, sf_dir)).where("src = dst").select("g", F.col("src").alias("node"))


@query(f"WITH RECURSIVE {EDGES} SELECT g, dst AS node, count(DISTINCT src) AS ancestors FROM walk GROUP BY ALL")
def ancestor_closure(spark, sf_dir) -> DataFrame:
    return w.reachable(spark, edges(spark, sf_dir)).groupBy("g", F.col("dst").alias("node")).agg(F.countDistinct("src").alias("ancestors"))


@query("""WITH u AS (SELECT user_id AS user, event_id, ts, event_id % 100 AS tokens, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS day FROM events)
    SELECT event_id AS seq, day, CAST(sum(tokens) OVER (PARTITION BY user, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM u""")
def token_charge(spark, sf_dir) -> DataFrame:
    u = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 100).alias("tokens"))
    return w.token_charge(u, "Europe/Moscow").select("seq", "day", "spent")


@query("""SELECT event_type, le, n FROM (SELECT event_type, unnest(['5', '25', '100', '+Inf']) AS le, unnest([count(*) FILTER (value <= 5), count(*) FILTER (value <= 25), count(*) FILTER (value <= 100), count(*)]) AS n FROM events GROUP BY event_type)""")
def latency_histogram(spark, sf_dir) -> DataFrame:
    return w.latency_histogram(t.table(spark, sf_dir, "events"), "event_type", "value", (5, 25, 100))


@query("""WITH r AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY floor(epoch(ts)), event_id) AS b FROM events) SELECT id FROM r WHERE sec - b <= 3600""")
def dupe_window(spark, sf_dir) -> DataFrame:
    r = t.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.unix_timestamp("ts").alias("at"), F.concat_ws("|", "user_id", "event_type").alias("dupe_hash"))
    return w.repeated_within(r, 3600).select("id")


@query("""WITH g AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'full' ELSE 'delta' END AS mode, round(avg(CASE WHEN doc_id % 13 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS compliance, round(avg(CASE WHEN doc_id % 13 <> 0 THEN CAST(quality AS DOUBLE) END), 6) AS accuracy,
      round(avg(CAST(quality AS DOUBLE)), 6) AS accuracy_raw, round(avg(CAST(toxic AS DOUBLE)), 6) AS escalation FROM labels GROUP BY 1)
    SELECT g.*, g.accuracy >= f.accuracy - 0.2 AND g.compliance >= 0.8 AS passes FROM g, (SELECT accuracy FROM g WHERE mode = 'full') f""")
def pilot_aggregate(spark, sf_dir) -> DataFrame:
    n = F.col("doc_id")
    runs = t.table(spark, sf_dir, "labels").select(F.when(n % 2 == 0, "full").otherwise("delta").alias("mode"), (n % 13 != 0).alias("compliant"), F.col("quality").alias("correct"), F.col("toxic").alias("escalated"))
    return w.pilot_gates(runs)


@query("""SELECT p_partkey AS cell, coalesce(CASE WHEN p_partkey % 5 = 0 THEN 1 END, CASE WHEN p_partkey % 3 = 0 THEN p_size END, 7) AS budget, coalesce(CASE WHEN p_partkey % 5 = 0 AND p_partkey % 2 = 0 THEN 2 END, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 END, 9) AS retries FROM part""")
def calibration_resolve(spark, sf_dir) -> DataFrame:
    n = F.col("p_partkey")
    p = t.table(spark, sf_dir, "part")
    pins = p.where("p_partkey % 5 = 0").select(n.alias("cell"), F.lit(1).alias("pin_budget"), F.when(n % 2 == 0, 2).alias("pin_retries"))
    profiles = p.select(n.alias("cell"), F.when(n % 3 == 0, F.col("p_size")).alias("profile_budget"), F.when(n % 4 == 0, F.col("p_size") + 1).alias("profile_retries"))
    return w.resolve_settings(pins, profiles, {"budget": 7, "retries": 9})


@query("SELECT doc_id AS id, round(CAST(0.2 * quality + 0.4 * (doc_id % 5 / 4.0) + 0.2 * toxic + 0.2 * (doc_id % 2) AS DOUBLE), 3) AS score FROM labels")
def structural_score(spark, sf_dir) -> DataFrame:
    n = F.col("doc_id")
    return t.table(spark, sf_dir, "labels").select(n.alias("id"), w.structural_score(F.col("quality"), n % 5 / 4.0, F.col("toxic"), n % 2).alias("score"))
