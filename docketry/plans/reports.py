"""Queries on the conversation log and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.operators.maintenance import once
from docketry.operators.textops import normal_question
from docketry.operators.usage import most_asked, over_limit, recent_turns, suppress_repeats, upper_median
from docketry.runtime import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
L = "WITH l AS (SELECT DISTINCT ON (id) * FROM chat_logs) "


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def logs(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "chat_logs"), "id")


@query(L + "SELECT count(*) AS n, count(DISTINCT session_id) AS sessions, count(*) FILTER (mode = 'voice') AS voice, count(*) FILTER (is_followup) AS followups FROM l")
def a06_headline(spark, d):
    return logs(spark, d).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.count_if(F.col("mode") == "voice").alias("voice"), F.count_if("is_followup").alias("followups"))


@query(L + ", s AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n FROM l WHERE latency_ms IS NOT NULL) SELECT max(n) AS n, max(latency_ms) FILTER (i = n // 2) AS median, max(latency_ms) AS most FROM s")
def a07_latency(spark, d):
    return upper_median(logs(spark, d).select("id", "latency_ms"), "latency_ms")


@query(L + "SELECT outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM l GROUP BY outcome")
def a08_outcomes(spark, d):
    counts = logs(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(L + "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM l GROUP BY 1")
def a09_per_day(spark, d):
    return logs(spark, d).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


_NORM = r"regexp_replace(regexp_replace(lower(regexp_replace(question, '^\s+|\s+$', '', 'g')), '[?.! ]+$', ''), '\s+', ' ', 'g')"


@query(L + f", q AS (SELECT *, {_NORM} AS norm FROM l WHERE NOT is_followup AND outcome <> 'smalltalk' AND question IS NOT NULL) SELECT norm, n, wording FROM (SELECT norm, count(*) AS n, trim(arg_min(question, (created_at, id))) AS wording, min((created_at, id)) AS f FROM q GROUP BY norm ORDER BY n DESC, f LIMIT 15)")
def a10_most_asked(spark, d):
    new = logs(spark, d).where("NOT is_followup AND outcome <> 'smalltalk'").select("id", "created_at", "question")
    return most_asked(new, normal_question(F.col("question")), 15)


@query(L + "SELECT id, outcome FROM l WHERE outcome IN ('declined', 'out_of_scope') ORDER BY created_at DESC, id DESC LIMIT 40")
def a11_unanswered(spark, d):
    return logs(spark, d).where("outcome IN ('declined', 'out_of_scope')").orderBy(F.desc("created_at"), F.desc("id")).limit(40).select("id", "outcome")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, ts::TIMESTAMP::DATE ORDER BY ts, event_id) > 2 AS rejected FROM events")
def x01_rate_limit(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    return over_limit(e, "user_id", "ts", "1 day", 2).select("event_id", "user_id", "rejected")


@query("""WITH RECURSIVE e AS (SELECT event_id, event_type || '-' || (user_id % 10) AS k, epoch_us(ts) AS t FROM events),
 o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS n FROM e),
 f AS (SELECT k, n, event_id, t AS last, TRUE AS kept FROM o WHERE n = 1 UNION ALL
  SELECT o.k, o.n, o.event_id, CASE WHEN o.t - f.last > 43200000000 THEN o.t ELSE f.last END, o.t - f.last > 43200000000 FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1)
 SELECT event_id, kept FROM f""")
def x02_suppress_repeats(spark, d):
    e = table(spark, d, "events").select(F.concat_ws("-", "event_type", F.col("user_id") % 10).alias("k"), "ts", "event_id")
    return suppress_repeats(e, "k", "ts", 43200).select("event_id", "kept")


@query(L + """, t AS (SELECT session_id AS conv, created_at, id, 0 AS part, 'user' AS role, question AS content FROM l UNION ALL SELECT session_id, created_at, id, 1, 'assistant', answer FROM l),
 k AS (SELECT *, row_number() OVER w AS back, sum(length(content)) OVER w AS used FROM t WHERE conv IS NOT NULL AND content <> '' WINDOW w AS (PARTITION BY conv ORDER BY created_at DESC NULLS LAST, id DESC, part DESC)),
 f AS (SELECT * FROM k WHERE back <= 10 AND used <= 2400),
 a AS (SELECT *, max(CASE WHEN role = 'user' THEN 1 END) OVER u AS asked FROM f WINDOW u AS (PARTITION BY conv ORDER BY created_at NULLS FIRST, id, part)),
 g AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER u THEN 0 ELSE 1 END AS fresh FROM a WHERE asked = 1 WINDOW u AS (PARTITION BY conv ORDER BY created_at NULLS FIRST, id, part)),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv ORDER BY created_at NULLS FIRST, id, part) AS run FROM g)
 SELECT conv, run::BIGINT AS run, min(role) AS role, string_agg(content, chr(10) ORDER BY created_at NULLS FIRST, id, part) AS content FROM r GROUP BY conv, run""")
def n08_recent_turns(spark, d):
    l = logs(spark, d).where("session_id IS NOT NULL")
    turns = l.select(F.col("session_id").alias("conv"), F.col("created_at"), "id", F.explode(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))).alias("x"))
    turns = turns.select("conv", F.struct("created_at", "id", F.when(F.col("x.role") == "user", 0).otherwise(1)).alias("turn"), "x.role", "x.content")
    return recent_turns(turns).select("conv", "run", "role", "content")


@query(L + """, u AS (SELECT session_id, id, question, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS back FROM l WHERE session_id IS NOT NULL AND question IS NOT NULL AND question <> '')
 SELECT session_id, max(question) FILTER (back = 1) AS last_question, max(question) FILTER (back = 2) AS one_before FROM u WHERE back <= 2 GROUP BY 1""")
def n09_last_questions(spark, d):
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    u = logs(spark, d).where("session_id IS NOT NULL AND question <> ''").select("session_id", "question", F.row_number().over(w).alias("back")).where("back <= 2")
    return u.groupBy("session_id").agg(F.max(F.when(F.col("back") == 1, F.col("question"))).alias("last_question"), F.max(F.when(F.col("back") == 2, F.col("question"))).alias("one_before"))


@query("SELECT round(avg(CASE WHEN l_extendedprice > 0 THEN 1.0 ELSE 0.0 END), 6) AS ratio, bool_and(l_quantity > 0) AS every, count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def a21_all_satisfy(spark, d):
    r = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return r.agg(F.round(F.avg(F.when(F.col("l_extendedprice") > 0, 1.0).otherwise(0.0)), 6).alias("ratio"), F.bool_and(F.col("l_quantity") > 0).alias("every"), F.count("*").alias("n"))
