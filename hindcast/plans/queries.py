"""Registered queries over the benchmark tables, each with SQL for comparison.

`events` serves as an event log (user_id, ts, event_type, value) and `orders` as a second one (customer,
order date, priority). All queries read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import code_slug, sample_key, sigmoid
from ..operators import asof, events as ev, label as lb, metrics as mt, preprocess as pp, sampling as sp, sequences as sq
from ..schemas import METRICS
from ..sources.logs import event_table_as_log
from . import evaluation, external, predict

Query = Callable[[SparkSession, str], DataFrame]
CODES, DAYS = ["click", "error", "purchase"], [0.5, 3.0]
TERMINAL = "purchase"
LEAST, K, SEED = 50, 5, 1

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def log(spark: SparkSession, sf: str) -> DataFrame:
    return event_table_as_log(spark.read.parquet(f"{sf}/events.parquet"))


def orders_log(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(F.col("o_custkey").cast("bigint").alias("subject_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("time"), F.col("o_orderpriority").alias("code"), F.col("o_totalprice").alias("numeric_value"))


def all_times(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).select("subject_id", F.col("time").alias("prediction_time")).distinct()


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return ev.dense_grid(all_times(spark, sf), CODES, DAYS)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with probabilities that hash the row, in hundredths, so that there are ties."""
    found = lb.label_index(grid(spark, sf), log(spark, sf))
    micros = F.unix_micros(F.col("prediction_time").cast("timestamp"))
    p = lambda tag: (F.pmod(sample_key(F.lit(tag), F.col("subject_id"), micros, F.col("query")), F.lit(100)) / F.lit(100.0)).cast("float")
    return found.withColumns({"censor_prob": p("c"), "occurs_prob": p("o")})


LOG = "log AS (SELECT CAST(user_id AS BIGINT) AS subject_id, ts AS time, event_type AS code, value AS numeric_value FROM events)"
ORDERS = "olog AS (SELECT CAST(o_custkey AS BIGINT) AS subject_id, o_orderdate AS time, o_orderpriority AS code, o_totalprice AS numeric_value FROM orders)"
TIMES = "times AS (SELECT DISTINCT subject_id, time AS prediction_time FROM log)"
GRID = "grid AS (SELECT subject_id, prediction_time, c AS query, CAST(d AS FLOAT) AS duration_days FROM times, (VALUES ('click'), ('error'), ('purchase')) AS codes(c), (VALUES (0.5), (3.0)) AS days(d))"
KEY = "CAST(('0x' || substr(md5({}), 1, 15)) AS BIGINT)"


def labels_sql(events: str = "log", index: str = "grid") -> str:
    end = "prediction_time + to_microseconds(CAST(round_even(CAST(duration_days AS DOUBLE) * 86400000000.0, 0) AS BIGINT))"
    return f"""
      seen AS (SELECT subject_id, max(time) AS max_time FROM {events} GROUP BY subject_id),
      hits AS (SELECT g.*, e.time AS next_time FROM {index} g ASOF LEFT JOIN (SELECT DISTINCT subject_id, code, time FROM {events}) e
               ON g.subject_id = e.subject_id AND g.query = e.code AND g.prediction_time < e.time),
      labels AS (SELECT h.subject_id, prediction_time, CASE WHEN next_time <= {end} THEN true WHEN {end} > max_time THEN NULL ELSE false END AS boolean_value,
                 query, duration_days FROM hits h JOIN seen s ON h.subject_id = s.subject_id)"""


CUT = "cut AS (SELECT l.* FROM log l LEFT JOIN (SELECT subject_id, min(time) AS stop FROM log WHERE code = 'purchase' GROUP BY 1) d USING (subject_id) WHERE stop IS NULL OR time <= stop)"


@register("event_normalise", f"WITH {LOG} SELECT DISTINCT subject_id, time, code FROM log WHERE time IS NOT NULL")
def event_normalise(spark, sf):
    return ev.normalise(log(spark, sf))


@register("order_normalise", f"WITH {ORDERS} SELECT DISTINCT subject_id, time, code FROM olog WHERE time IS NOT NULL")
def order_normalise(spark, sf):
    return ev.normalise(orders_log(spark, sf))


@register("death_truncate", f"WITH {LOG}, {CUT} SELECT * FROM cut")
def death_truncate(spark, sf):
    return ev.truncate_at_terminal(log(spark, sf), TERMINAL)


@register("prediction_time_index", f"WITH {LOG} SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY time) - 1 AS prediction_time_index, time FROM (SELECT DISTINCT subject_id, time FROM log)")
def prediction_time_index(spark, sf):
    return ev.prediction_times(log(spark, sf))


COUNTS = "counts AS (SELECT subject_id, '0' AS shard, count(DISTINCT time) AS n_prediction_times FROM log GROUP BY 1 HAVING count(DISTINCT time) > 60)"


@register("prediction_time_counts", f"WITH {LOG}, {COUNTS} SELECT * FROM counts")
def prediction_time_counts(spark, sf):
    return ev.time_counts(ev.prediction_times(log(spark, sf)), 60)


@register("eligible_times_semi", f"WITH {LOG}, {COUNTS} SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY time) - 1 AS prediction_time_index, time FROM (SELECT DISTINCT subject_id, time FROM log) WHERE subject_id IN (SELECT subject_id FROM counts)")
def eligible_times_semi(spark, sf):
    times = ev.prediction_times(log(spark, sf))
    return ev.eligible_times(times, ev.time_counts(times, 60))


@register("shard_span_check", f"WITH {ORDERS}, s AS (SELECT DISTINCT subject_id, CAST(year(time) AS VARCHAR) AS shard FROM olog) SELECT subject_id, count(*) AS n_shards, string_agg(shard, ',' ORDER BY shard) AS shards FROM s GROUP BY 1 HAVING count(*) > 1")
def shard_span_check(spark, sf):
    sharded = orders_log(spark, sf).withColumn("shard", F.year("time").cast("string"))
    return ev.spanning_subjects(sharded).withColumn("shards", F.concat_ws(",", "shards"))


@register("context_resolve", f"""WITH {LOG}, {COUNTS}, m AS (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY time) - 1 AS i, time FROM (SELECT DISTINCT subject_id, time FROM log)),
  c AS (SELECT subject_id, shard, row_number() OVER (ORDER BY subject_id) - 1 AS row_id, {KEY.format("concat_ws('|', 'index', subject_id)")} % n_prediction_times AS i FROM counts)
  SELECT c.subject_id, c.shard, m.time AS prediction_time, CASE CAST(floor(row_id / 2) AS BIGINT) % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'error' ELSE 'purchase' END AS query,
         CAST(1 + CAST(floor(row_id / 2) AS BIGINT) % 7 AS FLOAT) AS duration_days FROM c JOIN m ON c.subject_id = m.subject_id AND c.i = m.i""")
def context_resolve(spark, sf):
    from pyspark.sql.window import Window

    times = ev.prediction_times(log(spark, sf))
    counts = ev.time_counts(times, 60)
    index = F.pmod(sample_key(F.lit("index"), F.col("subject_id")), F.col("n_prediction_times"))
    rows = counts.select("subject_id", "shard", index.cast("bigint").alias("prediction_time_index"))
    # row numbers of the contexts: one row for each subject, in one small sorted partition as in the summary
    contexts = rows.withColumn("row_id", F.row_number().over(Window.orderBy("subject_id")) - 1)
    ids = contexts.select(F.floor(F.col("row_id") / 2).cast("bigint").alias("query_id")).distinct()
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("query_id") % 3 + 1).cast("int"))
    queries = ids.select("query_id", code.alias("query"), (F.col("query_id") % 7 + 1).cast("float").alias("duration_days"))
    return sp.resolve_index(queries, contexts, times, 2)


@register("asof_next_event", f"WITH {LOG}, {TIMES}, g AS (SELECT *, 'error' AS query FROM times) SELECT g.subject_id, prediction_time, query, e.time AS next_time FROM g ASOF LEFT JOIN (SELECT DISTINCT subject_id, code, time FROM log) e ON g.subject_id = e.subject_id AND g.query = e.code AND g.prediction_time < e.time")
def asof_next_event(spark, sf):
    index = all_times(spark, sf).withColumn("query", F.lit("error"))
    return asof.next_event(index, log(spark, sf).withColumnRenamed("code", "query"), ["subject_id", "query"])


@register("asof_prev_event", f"WITH {LOG}, {TIMES}, g AS (SELECT *, 'error' AS query FROM times) SELECT g.subject_id, prediction_time, query, e.time AS previous_time FROM g ASOF LEFT JOIN (SELECT DISTINCT subject_id, code, time FROM log) e ON g.subject_id = e.subject_id AND g.query = e.code AND g.prediction_time >= e.time")
def asof_prev_event(spark, sf):
    index = all_times(spark, sf).withColumn("query", F.lit("error"))
    return asof.previous_event(index, log(spark, sf).withColumnRenamed("code", "query"), ["subject_id", "query"])


@register("label_windows", f"WITH {LOG}, {TIMES}, {GRID}, {labels_sql()} SELECT * FROM labels")
def label_windows(spark, sf):
    return lb.label_index(grid(spark, sf), log(spark, sf))


@register("label_windows_terminal", f"WITH {LOG}, {TIMES}, {GRID}, {CUT}, {labels_sql('cut')} SELECT * FROM labels")
def label_windows_terminal(spark, sf):
    return lb.label_index(grid(spark, sf), log(spark, sf), TERMINAL)


@register("label_windows_orders", f"WITH {ORDERS}, og AS (SELECT DISTINCT subject_id, time AS prediction_time, '1-URGENT' AS query, CAST(365.25 AS FLOAT) AS duration_days FROM olog), {labels_sql('olog', 'og')} SELECT * FROM labels")
def label_windows_orders(spark, sf):
    orders = orders_log(spark, sf)
    index = ev.dense_grid(orders.select("subject_id", F.col("time").alias("prediction_time")).distinct(), ["1-URGENT"], [365.25])
    return lb.label_index(index, orders)


@register("label_summary", f"WITH {LOG}, {TIMES}, {GRID}, {labels_sql()} SELECT count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects, (SELECT count(*) FROM (SELECT DISTINCT query, duration_days FROM labels)) AS n_tasks, count(*) FILTER (WHERE boolean_value IS NULL) AS n_censored, count(*) FILTER (WHERE NOT boolean_value) AS n_false, count(*) FILTER (WHERE boolean_value) AS n_true FROM labels")
def label_summary(spark, sf):
    return lb.summary(label_windows(spark, sf))


CANDIDATES = "cand AS (SELECT DISTINCT subject_id, time AS prediction_time FROM (SELECT subject_id, time, count(time) OVER (PARTITION BY subject_id ORDER BY time RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM log WHERE time IS NOT NULL) WHERE n >= 50)"


@register("eval_time_candidates", f"WITH {LOG}, {CANDIDATES} SELECT * FROM cand")
def eval_time_candidates(spark, sf):
    return ev.candidate_times(ev.normalise(log(spark, sf)), LEAST)


def topk_sql(k: int, seed: int, source: str = "cand") -> str:
    key = KEY.format(f"concat_ws('|', subject_id, epoch_us(prediction_time), {seed})")
    return f"top AS (SELECT subject_id, prediction_time FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY {key}, prediction_time) AS r FROM {source}) WHERE r <= {k})"


@register("eval_time_topk", f"WITH {LOG}, {CANDIDATES}, {topk_sql(K, SEED)} SELECT * FROM top")
def eval_time_topk(spark, sf):
    return ev.sample_times(ev.normalise(log(spark, sf)), K, LEAST, SEED)


SUBSAMPLE = f"sub AS (SELECT * FROM log WHERE {KEY.format(chr(99) + 'oncat_ws(' + chr(39) + '|' + chr(39) + ', subject_id, 7)')} < {int(0.3 * (1 << 60))})"


@register("subject_subsample", f"WITH {LOG}, {SUBSAMPLE} SELECT * FROM sub")
def subject_subsample(spark, sf):
    return ev.subsample_subjects(log(spark, sf), 0.3, 7)


@register("dense_grid", f"WITH {LOG}, {TIMES}, {GRID} SELECT * FROM grid")
def dense_grid(spark, sf):
    return grid(spark, sf)


def _tasks(spark, sf):
    return evaluation.evaluation_tasks(log(spark, sf), CODES, DAYS, K, LEAST, SEED)


def tasks_sql() -> str:
    from ..functions.seeds import derive_seed

    index = GRID.replace("grid AS", "egrid AS").replace("FROM times,", "FROM top,")
    return f"{LOG}, {CANDIDATES}, {topk_sql(K, derive_seed(SEED, 'prediction_times'))}, {index}, {labels_sql('log', 'egrid')}, tasks AS (SELECT * FROM labels WHERE boolean_value IS NOT NULL)"


@register("eval_tasks", f"WITH {tasks_sql()} SELECT * FROM tasks")
def eval_tasks(spark, sf):
    return _tasks(spark, sf)


@register("eval_unique_times", f"WITH {tasks_sql()} SELECT DISTINCT subject_id, prediction_time FROM tasks")
def eval_unique_times(spark, sf):
    return evaluation.unique_times(_tasks(spark, sf))


def scored_sql() -> str:
    p = lambda tag: f"CAST(({KEY.format(chr(99) + f'''oncat_ws('|', '{tag}', subject_id, epoch_us(prediction_time), query)''')} % 100) / 100.0 AS FLOAT)"
    return f"{LOG}, {TIMES}, {GRID}, {labels_sql()}, scored AS (SELECT *, {p('c')} AS censor_prob, {p('o')} AS occurs_prob FROM labels)"


def auroc_sql(source: str, by: str, label: str, score: str, out: str) -> str:
    """By average ranks (the registered form counts by score instead)."""
    return f"""SELECT {by}, CASE WHEN p > 0 AND n > 0 THEN (s - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n) END AS {out} FROM (
      SELECT {by}, CAST(sum(CASE WHEN y THEN r ELSE 0 END) AS DOUBLE) AS s, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM (
        SELECT {by}, {label} AS y, rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS r FROM {source} WHERE {label} IS NOT NULL) GROUP BY {by})"""


METRICS_SQL = f"""WITH {scored_sql()}, c AS (SELECT query, duration_days, count(*) AS n_rows, count(boolean_value) AS n_occurs_labeled, count(*) FILTER (WHERE boolean_value) AS n_positive FROM scored GROUP BY ALL),
  o AS ({auroc_sql('scored', 'query, duration_days', 'boolean_value', 'occurs_prob', 'occurs_auroc')}), flagged AS (SELECT *, boolean_value IS NULL AS cens FROM scored),
  z AS ({auroc_sql('flagged', 'query, duration_days', 'cens', 'censor_prob', 'censor_auroc')})
  SELECT c.query, c.duration_days, n_rows, n_occurs_labeled, n_positive, round(occurs_auroc, 9) AS occurs_auroc, round(censor_auroc, 9) AS censor_auroc,
         CASE WHEN n_occurs_labeled > 0 THEN round(n_positive / n_occurs_labeled, 9) END AS prevalence
  FROM c LEFT JOIN o USING (query, duration_days) LEFT JOIN z USING (query, duration_days)"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@register("metrics_by_query", METRICS_SQL)
def metrics_by_query(spark, sf):
    return rounded(mt.compute_metrics(scored(spark, sf)), "occurs_auroc", "censor_auroc", "prevalence").select(*METRICS.columns)


@register("auroc_ties", f"WITH o AS (SELECT o_orderpriority AS query, o_orderstatus = 'F' AS y, round(o_totalprice / 10000.0, 0) AS p FROM orders) SELECT query, round(auroc, 9) AS auroc FROM ({auroc_sql('o', 'query', 'y', 'p', 'auroc')})")
def auroc_ties(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("query"), (F.col("o_orderstatus") == "F").alias("y"), F.round(F.col("o_totalprice") / 10000.0, 0).alias("p"))
    return rounded(mt.auroc_by(o, ["query"], F.col("y"), F.col("p"), "auroc"), "auroc")


@register("label_split", f"WITH {LOG}, {TIMES}, {GRID}, {labels_sql()} SELECT subject_id, prediction_time, query, duration_days, boolean_value IS NULL AS boolean_value, coalesce(boolean_value, false) AS occurs FROM labels")
def label_split(spark, sf):
    return lb.split_label(label_windows(spark, sf))


@register("label_merge", f"WITH {LOG}, {TIMES}, {GRID}, {labels_sql()} SELECT * FROM labels")
def label_merge(spark, sf):
    split = label_split(spark, sf)
    return split.select("subject_id", "prediction_time", lb.merge_label(F.col("boolean_value"), F.col("occurs")).alias("boolean_value"), "query", "duration_days")


COMPOSITE = "comp AS (SELECT subject_id, prediction_time, max(CAST(occurs_prob AS DOUBLE)) AS prob_max, 1.0 - product(1.0 - CAST(occurs_prob AS DOUBLE)) AS prob_or, sum(CAST(occurs_prob AS DOUBLE)) AS prob_sum FROM scored GROUP BY 1, 2)"


@register("composite_probs", f"WITH {scored_sql()}, {COMPOSITE} SELECT subject_id, prediction_time, round(prob_max, 6) AS prob_max, round(prob_or, 6) AS prob_or, round(prob_sum, 6) AS prob_sum FROM comp")
def composite_probs(spark, sf):
    return mt.composite_probabilities(scored(spark, sf)).withColumns({f"prob_{k}": F.round(f"prob_{k}", 6) for k in mt.KINDS})


@register("composite_auroc", f"""WITH {scored_sql()}, {COMPOSITE}, rc AS (SELECT subject_id, prediction_time, round(prob_max, 6) AS prob_max, round(prob_or, 6) AS prob_or, round(prob_sum, 6) AS prob_sum FROM comp),
  lab AS (SELECT subject_id, prediction_time, bool_or(boolean_value) AS y FROM scored GROUP BY 1, 2),
  long AS (SELECT 'prob_max' AS aggregate, y, prob_max AS p FROM rc JOIN lab USING (subject_id, prediction_time) UNION ALL SELECT 'prob_or', y, prob_or FROM rc JOIN lab USING (subject_id, prediction_time)
           UNION ALL SELECT 'prob_sum', y, prob_sum FROM rc JOIN lab USING (subject_id, prediction_time))
  SELECT aggregate, round(auroc, 9) AS auroc FROM ({auroc_sql('long', 'aggregate', 'y', 'p', 'auroc')})""")
def composite_auroc(spark, sf):
    found = scored(spark, sf)
    labels = found.groupBy("subject_id", "prediction_time").agg(F.bool_or("boolean_value").alias("boolean_value"))
    return rounded(mt.composite_auroc(found, labels, digits=6), "auroc")


WIDE = f"{LOG}, {TIMES}, {GRID}, {labels_sql()}, wide AS (SELECT subject_id, prediction_time, bool_or(boolean_value IS NULL) AS censored, coalesce(bool_or(boolean_value) FILTER (WHERE query = 'click'), false) AS click, coalesce(bool_or(boolean_value) FILTER (WHERE query = 'error'), false) AS error FROM labels WHERE duration_days = 3 GROUP BY 1, 2)"
SLUG = "CASE WHEN p = '' THEN substr(sha1(c), 1, 10) ELSE substr(p, 1, 24) || '__' || substr(sha1(c), 1, 10) END"


def _external(spark, sf):
    found = label_windows(spark, sf).where(F.col("duration_days") == 3)
    flags = {c: F.coalesce(F.bool_or(F.when(F.col("query") == c, F.col("boolean_value"))), F.lit(False)).alias(c) for c in ("click", "error")}
    wide = found.groupBy("subject_id", "prediction_time").agg(F.bool_or(F.col("boolean_value").isNull()).alias("censored"), *flags.values())
    labels = wide.select("subject_id", "prediction_time", (F.col("click") & F.col("error")).alias("boolean_value"))
    return external.per_code_tasks(wide, labels, ["click", "error"], 30.0)


@register("aces_join", f"WITH {WIDE}, long AS (SELECT subject_id, prediction_time, click AND error AS task_label, censored, unnest(['click', 'error']) AS query, unnest([click, error]) AS flag FROM wide) SELECT subject_id, prediction_time, CASE WHEN censored THEN NULL ELSE flag END AS boolean_value, query, CAST(30 AS FLOAT) AS duration_days, task_label, {SLUG.replace('p,', 'query,').replace('p =', 'query =').replace('(c)', '(query)')} AS slug FROM long")
def aces_join(spark, sf):
    return _external(spark, sf)


@register("per_code_auroc", f"""WITH {scored_sql()}, three AS (SELECT *, boolean_value AS y FROM scored WHERE duration_days = 3) SELECT query, round(auroc, 9) AS auroc FROM ({auroc_sql('three', 'query', 'y', 'occurs_prob', 'auroc')})""")
def per_code_auroc(spark, sf):
    found = scored(spark, sf).where(F.col("duration_days") == 3)
    labels = found.select(code_slug(F.col("query")).alias("slug"), "subject_id", "prediction_time", F.col("boolean_value").alias("occurs"))
    return rounded(mt.per_code_auroc(found, labels), "auroc")


@register("code_slug", f"WITH c AS (SELECT DISTINCT event_type AS c FROM events UNION SELECT DISTINCT o_orderpriority || '//' || o_orderstatus FROM orders UNION SELECT DISTINCT c_name || ' (' || c_mktsegment || ')' FROM customer), s AS (SELECT c, trim(regexp_replace(c, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS p FROM c) SELECT c AS code, {SLUG} AS slug FROM s")
def slugs(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    codes = read("events").select(F.col("event_type").alias("code"))
    codes = codes.union(read("orders").select(F.concat("o_orderpriority", F.lit("//"), "o_orderstatus"))).union(read("customer").select(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))))
    return codes.distinct().withColumn("slug", code_slug(F.col("code")))


OCOUNTS = 'oc AS (SELECT code, count(*) AS "code/n_occurrences", count(DISTINCT subject_id) AS "code/n_subjects" FROM olog GROUP BY 1)'


@register("code_counts", f"WITH {ORDERS}, {OCOUNTS} SELECT * FROM oc")
def code_counts(spark, sf):
    return pp.count_codes(orders_log(spark, sf))


RARE = "CASE WHEN o_orderkey % 97 = 0 THEN 'HOSPITAL_ADMISSION//' || CAST(o_orderkey % 1000 AS VARCHAR) ELSE o_orderpriority || '//' || CAST(o_custkey % 500 AS VARCHAR) END"


@register("rare_code_filter", f"""WITH r AS (SELECT o_custkey AS subject_id, CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS time, {RARE} AS code FROM orders),
  n AS (SELECT code, count(DISTINCT subject_id) AS k FROM r GROUP BY 1) SELECT r.* FROM r JOIN n USING (code) WHERE k >= 2 OR time IS NULL OR code LIKE '%ADMISSION%'""")
def rare_code_filter(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    code = F.when(F.col("o_orderkey") % 97 == 0, F.concat(F.lit("HOSPITAL_ADMISSION//"), (F.col("o_orderkey") % 1000).cast("string")))
    code = code.otherwise(F.concat("o_orderpriority", F.lit("//"), (F.col("o_custkey") % 500).cast("string")))
    time = F.when(F.col("o_orderkey") % 89 == 0, F.lit(None)).otherwise(F.col("o_orderdate").cast("timestamp_ntz"))
    coded = o.select(F.col("o_custkey").cast("bigint").alias("subject_id"), time.alias("time"), code.alias("code"))
    return pp.filter_rare_codes(coded, pp.count_codes(coded), 2)


@register("min_events_filter", f"WITH {LOG} SELECT * FROM log WHERE subject_id IN (SELECT subject_id FROM log GROUP BY 1 HAVING count(DISTINCT time) >= 65)")
def min_events_filter(spark, sf):
    return pp.filter_short_subjects(log(spark, sf), 65)


DELTAS = "deltas AS (SELECT * FROM (SELECT subject_id, time, 'TIMELINE//DELTA//years' AS code, (epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY subject_id ORDER BY time)) / 31557600000000.0 AS numeric_value FROM (SELECT DISTINCT subject_id, time FROM log)) WHERE numeric_value IS NOT NULL)"


@register("time_deltas", f"WITH {LOG}, {DELTAS} SELECT * FROM deltas")
def time_deltas(spark, sf):
    return pp.timeline_tokens(log(spark, sf))


QUANT = f"quant AS (SELECT code, quantile_cont(numeric_value, {list(pp.QUANTILES)}) AS q FROM log WHERE numeric_value IS NOT NULL GROUP BY 1)"


@register("quantile_bins", f"WITH {LOG}, {QUANT} SELECT code, i AS nth, round(q[i], 6) AS edge FROM quant, range(1, 10) t(i)")
def quantile_bins(spark, sf):
    found = pp.fit_quantiles(log(spark, sf)).select("code", F.posexplode("quantiles").alias("i", "edge"))
    return found.select("code", (F.col("i") + 1).cast("bigint").alias("nth"), F.round("edge", 6).alias("edge"))


def bins_sql() -> str:
    names, edges = zip(*sorted(pp.TIMELINE_BINS.items(), key=lambda x: x[1]), strict=True)
    listed = "[" + ", ".join(f"'{n}'" for n in (*names, "over_" + names[-1])) + "]"
    values = "[" + ", ".join(map(repr, edges)) + "]"
    return f"""WITH {LOG}, {DELTAS}, {QUANT}, every AS (SELECT subject_id, time, code, numeric_value FROM log UNION ALL SELECT * FROM deltas)
      SELECT subject_id, time, CASE WHEN numeric_value IS NULL THEN b.code WHEN b.code = 'TIMELINE//DELTA//years'
        THEN b.code || '//' || ({listed})[1 + len(list_filter(CAST({values} AS DOUBLE[]), lambda e : e < numeric_value))]
        WHEN q IS NULL THEN b.code ELSE b.code || '//Q' || CAST(1 + len(list_filter(list_distinct(q), lambda e : e < numeric_value)) AS VARCHAR) END AS code
      FROM every b LEFT JOIN quant ON b.code = quant.code"""


@register("value_binning", bins_sql())
def value_binning(spark, sf):
    own = log(spark, sf)
    both = own.unionByName(pp.timeline_tokens(own))
    return pp.bin_values(both, pp.fit_quantiles(own)).select("subject_id", "time", "code")


VOCAB = "vocab AS (SELECT code, row_number() OVER (ORDER BY code) AS vocab_index FROM (SELECT DISTINCT code FROM log))"


@register("vocab_index", f'WITH {LOG} SELECT code, count(*) AS "code/n_occurrences", count(DISTINCT subject_id) AS "code/n_subjects", row_number() OVER (ORDER BY code) AS "code/vocab_index" FROM log GROUP BY code')
def vocab_index(spark, sf):
    return pp.vocabulary(log(spark, sf))


SUMS = "sums AS (SELECT code, count(numeric_value) AS n, sum(numeric_value) AS s, sum(numeric_value * numeric_value) AS q FROM log GROUP BY 1)"


@register("fit_normalisation", f'WITH {LOG}, {SUMS} SELECT code, n AS "values/n_occurrences", round(s, 4) AS "values/sum", round(q, 2) AS "values/sum_sqd" FROM sums')
def fit_normalisation(spark, sf):
    found = pp.fit_normalisation(log(spark, sf))
    return found.select("code", "values/n_occurrences", F.round("values/sum", 4).alias("values/sum"), F.round("values/sum_sqd", 2).alias("values/sum_sqd"))


@register("normalised_values", f"""WITH {LOG}, {VOCAB}, {SUMS}, f AS (SELECT code, s / n AS m, sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS d FROM sums)
  SELECT subject_id, time, vocab_index AS code, CASE WHEN d > 0 THEN round((numeric_value - m) / d, 6) WHEN numeric_value IS NOT NULL THEN 0 END AS numeric_value FROM log JOIN vocab USING (code) JOIN f USING (code)""")
def normalised_values(spark, sf):
    own = log(spark, sf)
    return pp.normalise_values(own, pp.vocabulary(own), pp.fit_normalisation(own)).withColumn("numeric_value", F.round("numeric_value", 6))


@register("event_sequences", f"""WITH {LOG}, {VOCAB}, e AS (SELECT subject_id, time, string_agg(CAST(vocab_index AS VARCHAR), '+' ORDER BY vocab_index) AS codes FROM log JOIN vocab USING (code) GROUP BY 1, 2),
  d AS (SELECT *, (epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY subject_id ORDER BY time)) / 86400000000.0 AS delta FROM e)
  SELECT subject_id, count(*) AS n_events, md5(string_agg(codes, ',' ORDER BY time)) AS codes, round(sum(delta), 6) AS days FROM d GROUP BY 1""")
def event_sequences(spark, sf):
    own = log(spark, sf)
    found = pp.event_sequences(pp.normalise_values(own, pp.vocabulary(own), pp.fit_normalisation(own)))
    codes = F.concat_ws(",", F.transform("code", lambda e: F.concat_ws("+", F.transform(e, lambda c: c.cast("string")))))
    days = F.aggregate("time_delta_days", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return found.select("subject_id", F.size("code").cast("bigint").alias("n_events"), F.md5(codes.cast("binary")).alias("codes"), F.round(days, 6).alias("days"))


@register("sequence_tail", f"""WITH {LOG}, {VOCAB}, {TIMES}, tok AS (SELECT t.subject_id, t.prediction_time, l.time, vocab_index, numeric_value,
    row_number() OVER (PARTITION BY t.subject_id, t.prediction_time ORDER BY l.time DESC, vocab_index DESC, numeric_value DESC) AS back
    FROM times t JOIN log l ON l.subject_id = t.subject_id AND l.time <= t.prediction_time JOIN vocab USING (code))
  SELECT subject_id, prediction_time, count(*) AS n_tokens, string_agg(CAST(vocab_index AS VARCHAR), ',' ORDER BY back DESC) AS codes FROM tok WHERE back <= 8 GROUP BY 1, 2""")
def sequence_tail(spark, sf):
    own = log(spark, sf)
    vocabulary = pp.vocabulary(own).selectExpr("code", "`code/vocab_index` AS vocab_index")
    found = sq.history(all_times(spark, sf), sq.subject_tokens(sq.encode(own, vocabulary)), 8)
    return found.select("subject_id", "prediction_time", F.size("tokens").cast("bigint").alias("n_tokens"), F.concat_ws(",", F.transform("tokens", lambda t: t["code"].cast("string"))).alias("codes"))


@register("query_prepend", f"""WITH {LOG}, {VOCAB}, {CANDIDATES}, {topk_sql(K, SEED)}, g AS (SELECT *, 'purchase' AS query, CAST(3 AS FLOAT) AS duration_days FROM top),
  tok AS (SELECT t.subject_id, t.prediction_time, vocab_index, row_number() OVER (PARTITION BY t.subject_id, t.prediction_time ORDER BY l.time DESC, vocab_index DESC, numeric_value DESC) AS back
    FROM g t JOIN log l ON l.subject_id = t.subject_id AND l.time <= t.prediction_time JOIN vocab USING (code))
  SELECT subject_id, prediction_time, (SELECT CAST(vocab_index AS VARCHAR) FROM vocab WHERE code = 'purchase') || ',' || string_agg(CAST(vocab_index AS VARCHAR), ',' ORDER BY back DESC) AS codes FROM tok WHERE back <= 15 GROUP BY 1, 2""")
def query_prepend(spark, sf):
    own = log(spark, sf)
    vocabulary = pp.vocabulary(own).selectExpr("code", "`code/vocab_index` AS vocab_index")
    tasks = ev.dense_grid(eval_time_topk(spark, sf), ["purchase"], [3.0])
    return predict.assemble(tasks, own, vocabulary, 16).select("subject_id", "prediction_time", F.concat_ws(",", F.transform("codes", lambda c: c.cast("string"))).alias("codes"))


@register("prediction_scores", f"""WITH {LOG}, {CANDIDATES}, {topk_sql(K, SEED)}, g AS (SELECT t.*, c AS query, CAST(d AS FLOAT) AS duration_days FROM top t, (VALUES ('click'), ('purchase')) AS a(c), (VALUES (1.0), (7.0)) AS b(d)),
  n AS (SELECT t.subject_id, t.prediction_time, least(count(*), 31) AS k FROM top t JOIN log l ON l.subject_id = t.subject_id AND l.time <= t.prediction_time GROUP BY 1, 2)
  SELECT subject_id, prediction_time, query, duration_days, round(1 / (1 + exp(-(ln(1 + duration_days) - ln(30)))), 4) AS censor_prob, round(1 / (1 + exp(-(0.02 * (k + 1) + ln(1 + duration_days) - 2))), 4) AS occurs_prob FROM g JOIN n USING (subject_id, prediction_time)""")
def prediction_scores(spark, sf):
    own = log(spark, sf)
    vocabulary = pp.vocabulary(own).selectExpr("code", "`code/vocab_index` AS vocab_index")
    tasks = ev.dense_grid(eval_time_topk(spark, sf), ["click", "purchase"], [1.0, 7.0])
    found = predict.score(predict.assemble(tasks, own, vocabulary, 32))
    return found.select("subject_id", "prediction_time", "query", "duration_days", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("censor_prob", "occurs_prob")))


@register("logit_scores", "SELECT event_id, round(1.0 / (1.0 + exp(-(value / 100.0 - 1.0))), 9) AS p FROM events")
def logit_scores(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(sigmoid(F.col("value") / 100.0 - 1.0), 9).alias("p"))


@register("oov_codes", f"WITH {LOG}, {ORDERS} SELECT DISTINCT code FROM olog WHERE code NOT IN (SELECT code FROM log)")
def oov_codes(spark, sf):
    return sq.unknown_codes(orders_log(spark, sf), log(spark, sf).select("code").distinct(), "code")


def fingerprint_sql(source: str, columns: list[str], by: str | None = None) -> str:
    key = KEY.format("concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'null')" for c in columns) + ")")
    return f"SELECT {by + ', ' if by else ''}count(*) || ':' || CAST(sum(CAST({key} AS HUGEINT)) % 18446744073709551616 AS VARCHAR) AS fingerprint FROM {source}{' GROUP BY ' + by if by else ''}"


@register("index_fingerprint", f"WITH {LOG}, {TIMES}, {GRID} " + fingerprint_sql("grid", ["CAST(duration_days AS DECIMAL(9, 1))", "epoch_us(prediction_time)", "query", "subject_id"]))
def index_fingerprint(spark, sf):
    return lb.fingerprint(grid(spark, sf).withColumn("duration_days", F.col("duration_days").cast("decimal(9,1)")), portable=True)


@register("index_fingerprint_by_code", f"WITH {LOG}, {TIMES}, {GRID} " + fingerprint_sql("grid", ["CAST(duration_days AS DECIMAL(9, 1))", "epoch_us(prediction_time)", "subject_id"], "query"))
def index_fingerprint_by_code(spark, sf):
    return lb.fingerprint(grid(spark, sf).withColumn("duration_days", F.col("duration_days").cast("decimal(9,1)")), ["query"], portable=True)


@register("epoch_metrics", f"""WITH {scored_sql()}, s AS (SELECT *, CASE WHEN subject_id % 4 = 0 THEN 'tuning' ELSE 'train' END AS split, boolean_value IS NULL AS cens FROM scored)
  SELECT split, 'occurs_auroc' AS metric, round(auroc, 9) AS value FROM ({auroc_sql('s', 'split', 'boolean_value', 'occurs_prob', 'auroc')})
  UNION ALL SELECT split, 'censor_auroc', round(auroc, 9) FROM ({auroc_sql('s', 'split', 'cens', 'censor_prob', 'auroc')})""")
def epoch_metrics(spark, sf):
    split = F.when(F.col("subject_id") % 4 == 0, "tuning").otherwise("train")
    return rounded(mt.epoch_metrics(scored(spark, sf).withColumn("split", split)), "value")


LOSS = "(greatest({x}, 0.0) - {x} * CAST({y} AS INTEGER) + ln(1.0 + exp(-abs({x}))))"


@register("masked_losses", f"""WITH {scored_sql()}, x AS (SELECT query, boolean_value AS y, boolean_value IS NULL AS c, 4.0 * occurs_prob - 2.0 AS o, 4.0 * censor_prob - 2.0 AS z FROM scored),
  m AS (SELECT query, coalesce(avg(CASE WHEN y IS NOT NULL THEN {LOSS.format(x='o', y='y')} END), 0.0) AS occurs_loss, coalesce(avg({LOSS.format(x='z', y='c')}), 0.0) AS censor_loss FROM x GROUP BY 1)
  SELECT query, round(occurs_loss, 7) AS occurs_loss, round(censor_loss, 7) AS censor_loss, round(0.3 * occurs_loss + 0.7 * censor_loss, 7) AS loss FROM m""")
def masked_losses(spark, sf):
    logits = {f"{k}_logit": 4.0 * F.col(f"{k}_prob").cast("double") - 2.0 for k in ("occurs", "censor")}
    found = mt.losses(scored(spark, sf).withColumns(logits), 0.3, ["query"])
    return found.withColumns({c: F.round(c, 7) for c in ("occurs_loss", "censor_loss", "loss")})


@register("reshard_subjects", f"WITH {LOG}, s AS (SELECT subject_id, CASE WHEN subject_id % 4 = 0 THEN 'tuning' ELSE 'train' END AS split FROM (SELECT DISTINCT subject_id FROM log)), n AS (SELECT subject_id, split, CAST(CAST(floor((row_number() OVER (PARTITION BY split ORDER BY subject_id) - 1) / 20) AS BIGINT) AS VARCHAR) AS shard FROM s) SELECT log.*, split, shard FROM log JOIN n USING (subject_id)")
def reshard_subjects(spark, sf):
    own = log(spark, sf)
    splits = own.select("subject_id").distinct().withColumn("split", F.when(F.col("subject_id") % 4 == 0, "tuning").otherwise("train"))
    return pp.reshard(own, splits, 20)


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: labelled evaluation tasks over a dense grid of sampled times."""
    return _tasks(spark, sf)
