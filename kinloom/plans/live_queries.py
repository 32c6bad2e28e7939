"""Queries: accept log, learning curve, replay, session cards, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.operators import live as X
from kinloom.plans import views as V
from kinloom.plans.panel_queries import scratch
from kinloom.plans.registry import query, rounded, table
from kinloom.session import shuffle_width
from kinloom.streaming import live as stream

LOG = "WITH" + V.ACCEPTS_SQL
# Rows a file of a stream has at least, unless the batch is one file.
ROWS_A_FILE = 50_000
CURVE_SQL = """
curve AS (
  SELECT year, ablation, seq, husband_id, wife_id, source,
    count(*) OVER w AS n_accepted, CAST(sum(eligible) OVER w AS BIGINT) AS n_eligible, CAST(sum(correct) OVER w AS BIGINT) AS n_correct
  FROM accepts WHERE NOT is_reset WINDOW w AS (PARTITION BY year, ablation ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))"""
CURVE = "SELECT *, round(CASE WHEN n_eligible > 0 THEN n_correct / n_eligible END, 4) AS recall_at_1 FROM curve"
CURVE_COLUMNS = ["year", "ablation", "seq", "husband_id", "wife_id", "source", "n_accepted", "n_eligible", "n_correct", "recall_at_1"]


def log(spark, sf):
    return V.accepts(spark, sf).where(~F.col("is_reset"))


@query("learning_curve", LOG + "," + CURVE_SQL + CURVE)
def _learning_curve(spark, sf):
    return rounded(X.learning_curve(log(spark, sf), V.accept_truth(spark, sf)).select(*CURVE_COLUMNS))


def as_stream(spark, rows, name, time="ts", parts=3):
    """``rows`` as a stream of ``parts`` batches in the order of time, and an end mark much later.

    The mark (all null but its time) lets the watermark pass the last rows. A batch is as many
    files as tasks write; batches with fewer files are filled up with empty ones.
    """
    path, whole = scratch(spark, name), scratch(spark, name)
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    rows.write.parquet(whole)
    rows = spark.read.schema(rows.schema).parquet(whole)
    us = F.unix_micros(time)
    span = F.struct(F.min(us).alias("a"), F.max(us).alias("b"), F.count("*").alias("n"))
    low, high, n = rows.agg(span).first()[0]
    files = max(1, min(shuffle_width(spark), n // (parts * ROWS_A_FILE)))

    def put(batch):
        had = len(spark.read.schema(rows.schema).parquet(path).inputFiles()) if put.any else 0
        batch.write.mode("append").parquet(path)
        put.any = True
        made = len(spark.read.schema(rows.schema).parquet(path).inputFiles()) - had
        for _ in range(files - made):
            rows.limit(0).coalesce(1).write.mode("append").parquet(path)

    put.any = False
    for i in range(parts):
        cut = [low + (high + 1 - low) * k // parts for k in (i, i + 1)]
        put(rows.where((us >= cut[0]) & (us < cut[1])).repartition(files))
    end = [F.timestamp_micros(F.lit(high + 10 * 366 * 86_400_000_000)).alias(time) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    put(spark.range(1).select(*end))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path), rows.schema


@query("learning_curve_stream", LOG + "," + CURVE_SQL + CURVE)
def _learning_curve_stream(spark, sf):
    accepts, schema = as_stream(spark, log(spark, sf), "accepts")
    out = scratch(spark, "curve")
    stream.learning_curve_stream(accepts, V.accept_truth(spark, sf), out, availableNow=True).awaitTermination()
    return rounded(stream.read_curve(spark, out, schema).select(*CURVE_COLUMNS))


@query("curve_since_reset_stream", LOG + """,
after AS (SELECT * FROM accepts WHERE NOT is_reset AND (ts, seq) > (SELECT max((ts, seq)) FROM accepts WHERE is_reset)),""" + CURVE_SQL.replace("FROM accepts WHERE NOT is_reset", "FROM after") + CURVE)
def _curve_since_reset_stream(spark, sf):
    accepts, schema = as_stream(spark, V.accepts(spark, sf), "accepts")
    out = scratch(spark, "curve")
    stream.learning_curve_stream(accepts, V.accept_truth(spark, sf), out, availableNow=True).awaitTermination()
    return rounded(stream.read_curve(spark, out, schema, since_reset=True).select(*CURVE_COLUMNS))


@query("latest_accepted_stream", LOG + """
SELECT husband_id, wife_id, year, source, seq FROM (SELECT *, row_number() OVER (PARTITION BY husband_id ORDER BY ts DESC, seq DESC) AS rn
  FROM accepts WHERE NOT is_reset AND (ts, seq) > (SELECT max((ts, seq)) FROM accepts WHERE is_reset)) WHERE rn = 1""")
def _latest_accepted_stream(spark, sf):
    accepts, schema = as_stream(spark, V.accepts(spark, sf), "accepts")
    out = scratch(spark, "latest")
    stream.latest_accepted_stream(accepts.where(F.col("husband_id").isNotNull()), out, availableNow=True).awaitTermination()
    return stream.read_latest(spark, out, schema).select("husband_id", "wife_id", "year", "source", "seq")


@query("curve_totals", LOG + """
SELECT year, ablation, count(*) AS n_accepted, CAST(sum(eligible) AS BIGINT) AS n_eligible, CAST(sum(correct) AS BIGINT) AS n_correct,
  round(sum(correct) / sum(eligible), 4) AS recall_at_1 FROM accepts WHERE NOT is_reset GROUP BY year, ablation""")
def _curve_totals(spark, sf):
    return rounded(X.curve_totals(log(spark, sf), V.accept_truth(spark, sf)))


@query("latest_accepted", LOG + """
SELECT husband_id, wife_id, year, source, seq FROM (SELECT *, row_number() OVER (PARTITION BY husband_id ORDER BY ts DESC, seq DESC) AS rn
  FROM accepts WHERE NOT is_reset) WHERE rn = 1""")
def _latest_accepted(spark, sf):
    return X.latest_accepted(log(spark, sf)).select("husband_id", "wife_id", "year", "source", "seq")


@query("accept_log", LOG + "SELECT seq, husband_id, wife_id, source FROM accepts WHERE NOT is_reset AND year = 7 AND ablation = 'ablated' ORDER BY ts, seq")
def _accept_log(spark, sf):
    return X.accept_log(log(spark, sf), 7, "ablated").select("seq", "husband_id", "wife_id", "source")


@query("reset", LOG + """
SELECT seq, husband_id, wife_id FROM accepts WHERE NOT is_reset AND (ts, seq) > (SELECT max((ts, seq)) FROM accepts WHERE is_reset)""")
def _reset(spark, sf):
    return X.since_last_reset(V.accepts(spark, sf)).select("seq", "husband_id", "wife_id")


SESSION_SQL = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS topic, event_id AS seq, CASE event_type WHEN 'signup' THEN 'done' ELSE event_type END AS type FROM events),
d AS (SELECT topic, min(seq) AS stop FROM e WHERE type = 'done' GROUP BY topic)"""


REPLAY_SQL = SESSION_SQL + """
SELECT e.topic, e.seq, e.type FROM e LEFT JOIN d ON d.topic = e.topic WHERE d.stop IS NULL OR e.seq <= d.stop"""
# Longer than the log: only the end mark ends a session without a ``done``.
NEVER_IDLE = 5 * 366 * 86_400


def session_events(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "done").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("topic"), F.col("event_id").alias("seq"), kind.alias("type"), "ts"
    )


@query("replay", REPLAY_SQL)
def _replay(spark, sf):
    return X.replay(session_events(spark, sf)).select("topic", "seq", "type")


@query("replay_stream", REPLAY_SQL)
def _replay_stream(spark, sf):
    # An event may come before its place in the sequence by as much as the log is long.
    events, schema = as_stream(spark, session_events(spark, sf), "events")
    out = scratch(spark, "replay")
    stream.replay_stream(events, out, late_seconds=NEVER_IDLE, idle_seconds=NEVER_IDLE, availableNow=True).awaitTermination()
    return stream.read_replay(spark, out, schema).select("topic", "seq", "type")


FOLD_SQL = "WITH" + V.TRUTH_SQL + """,
top AS (SELECT year, h, w, rank, (score - 50000.0) / 20000.0 AS s FROM ranked WHERE rank <= 4)
SELECT 'negotiate:' || year || '-' || h AS topic, CAST(w AS VARCHAR) AS candidate_id, round(s, 4) AS pre_score, CAST(rank AS DOUBLE) AS score_gap,
  CAST(CASE WHEN w % 3 = 0 THEN 9 ELSE w % 10 + 1 END AS DOUBLE) AS target_score, 'first ' || w AS target_reason,
  CAST(CASE WHEN w % 2 = 0 THEN 7 END AS DOUBLE) AS candidate_score, CASE WHEN w % 2 = 0 THEN 'back ' || w END AS candidate_reason,
  CAST(CASE WHEN rank = 1 AND h % 2 = 0 THEN 4.5 WHEN rank = 1 THEN 3.5 END AS DOUBLE) AS accepted_score
FROM top"""


def negotiations(spark, sf):
    from kinloom.operators.ranking import top_k_per_left

    top = top_k_per_left(V.logits(V.scores(spark, sf)), 4)
    topic = F.concat(F.lit("negotiate:"), F.col("year").cast("string"), F.lit("-"), F.col("h").cast("string"))
    cid = F.col("w").cast("string")
    none = F.lit(None).cast("string")
    rows = top.groupBy(topic.alias("topic"), (F.col("h") % 2).alias("odd")).agg(
        F.collect_list(F.struct(cid.alias("id"), F.col("score").alias("pre_score"), F.col("rank").cast("double").alias("score_gap"))).alias("candidates"),
        F.collect_list(F.struct(cid.alias("candidate_id"), (F.col("w") % 10 + 1).cast("int").alias("score"), F.concat(F.lit("first "), cid).alias("reason"))).alias("scores"),
        F.collect_list(F.when(F.col("w") % 2 == 0, F.struct(cid.alias("candidate_id"), F.lit(7).alias("score"), F.concat(F.lit("back "), cid).alias("reason")))).alias("back"),
        F.collect_list(F.when(F.col("w") % 3 == 0, F.struct(cid.alias("candidate_id"), F.lit(9).alias("score"), none.alias("reason")))).alias("again"),
        F.max(F.when(F.col("rank") == 1, cid)).alias("best"),
    )
    events = F.array(
        _event(1, "start", F.lit("{}")),
        _event(2, "stage", F.to_json(F.struct(F.lit("filter").alias("stage"), "candidates"))),
        _event(3, "target_scores", F.to_json(F.struct("scores"))),
        _event(4, "bilateral_scores", F.to_json(F.struct(F.col("back").alias("scores")))),
        _event(5, "target_scores", F.to_json(F.struct(F.col("again").alias("scores")))),
        _event(6, "final_ranking", F.to_json(F.struct(F.struct(F.col("best").alias("candidate_id"), F.lit(3.5).alias("final_score")).alias("chosen")))),
        F.when(
            F.col("odd") == 0,
            _event(7, "committed", F.to_json(F.struct(F.struct(F.col("best").alias("wife_id"), F.lit(4.5).alias("score")).alias("match")))),
        ),
    )
    return rows.select("topic", F.inline(F.array_compact(events)))


@query("session_fold", FOLD_SQL)
def _session_fold(spark, sf):
    return rounded(X.session_fold(negotiations(spark, sf)))


@query("session_fold_stream", FOLD_SQL)
def _session_fold_stream(spark, sf):
    """The same events, of which one kind after the other comes minutes later, in several batches."""
    timed = negotiations(spark, sf).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    events, _ = as_stream(spark, timed, "negotiations")
    out = scratch(spark, "cards")
    stream.session_fold_stream(events, out, availableNow=True).awaitTermination()
    return rounded(stream.read_cards(spark, out))


def _event(seq: int, kind: str, payload):
    return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("type"), payload.alias("payload"))


@query("hint_counts", "SELECT user_id AS h, count(*) AS n_hints FROM events WHERE event_type = 'click' GROUP BY 1")
def _hint_counts(spark, sf):
    hints = table(spark, sf, "events").where(F.col("event_type") == "click").select(F.col("user_id").alias("h"), "ts")
    arriving, _ = as_stream(spark, hints, "hints")
    out = scratch(spark, "hint_counts")
    stream.hint_counts_stream(arriving.where(F.col("h").isNotNull()), out, availableNow=True).awaitTermination()
    return stream.read_hint_counts(spark, out)
