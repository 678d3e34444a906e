"""Queries: evaluation, cost, feed tables, streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedloom.config import Settings

from feedloom.operators import costs as U
from feedloom.operators import evaluation as Q
from feedloom.operators import feeds as Z
from feedloom.operators import history as H
from feedloom.operators import ranking as R
from feedloom.plans import oracles as O
from feedloom.plans import ranker_eval
from feedloom.plans.feed_build import build_feeds
from feedloom.plans.queries_feed import _counts_sql, tag_inputs
from feedloom.plans.recommend import recommend
from feedloom.plans.registry import query
from feedloom.session import materialise, materialise_all, shared_folder
from feedloom.sources import tables as T
from feedloom.sources.sinks import append_events
from feedloom.streaming import intake, profile_state, trending

S = Settings()

# --- evaluation ---


def _gold(spark, d):
    return T.item_features(spark, d).select("item_id", "size_band", "finish", "grade", "trait", "object")


def _predicted(spark, d):
    k, g = F.col("item_id"), _gold(spark, d)
    none = F.array().cast("array<string>")
    a = g.where(k % 9 != 0).select(
        F.lit("a").alias("model"), "item_id", "size_band", F.when(k % 7 == 0, "other").otherwise(F.col("finish")).alias("finish"),
        F.when(k % 5 == 0, "unknown").otherwise(F.col("grade")).alias("grade"),
        F.when(k % 3 == 0, F.array(F.lit("new"))).otherwise(F.col("trait")).alias("trait"), "object",
    )
    b = g.where(k % 6 != 1).select(
        F.lit("b").alias("model"), "item_id", F.when(k % 4 == 0, "medium").otherwise(F.col("size_band")).alias("size_band"), "finish", "grade",
        F.array_append("trait", F.lit("old")).alias("trait"), F.when(k % 6 == 0, none).otherwise(F.col("object")).alias("object"),
    )
    return a.unionByName(b)


def _compared(spark, d):
    tax = T.vocabulary()
    return Q.compare(Q.long_labels(_gold(spark, d), tax, ("item_id",)), Q.long_labels(_predicted(spark, d), tax, ("model", "item_id")))


def _attempts(spark, d):
    return Q.attempts(_gold(spark, d), _predicted(spark, d))


_EVAL = {
    "gl": """SELECT p.item_id, f.field, f.kind, coalesce(t.vs, []::VARCHAR[]) AS g FROM parts p CROSS JOIN (SELECT DISTINCT field, kind FROM tax) f
        LEFT JOIN (SELECT item_id, field, list(value ORDER BY value) AS vs FROM tags GROUP BY 1, 2) t ON t.item_id = p.item_id AND t.field = f.field""",
    "pl": """SELECT 'a' AS model, item_id, field, CASE WHEN field = 'finish' AND item_id % 7 = 0 THEN ['other'] WHEN field = 'grade' AND item_id % 5 = 0 THEN ['unknown']
            WHEN field = 'trait' AND item_id % 3 = 0 THEN ['new'] ELSE g END AS p FROM gl WHERE item_id % 9 <> 0
        UNION ALL SELECT 'b', item_id, field, CASE WHEN field = 'size_band' AND item_id % 4 = 0 THEN ['medium']
            WHEN field = 'trait' AND NOT list_contains(g, 'old') THEN list_append(g, 'old') WHEN field = 'object' AND item_id % 6 = 0 THEN []::VARCHAR[] ELSE g END FROM gl WHERE item_id % 6 <> 1""",
    "cmp": """SELECT *, CASE WHEN n_union = 0 THEN 1.0::DOUBLE WHEN kind = 'single' THEN CASE WHEN n_both > 0 THEN 1.0 ELSE 0.0 END ELSE n_both / n_union END AS score,
            CASE WHEN kind = 'multi' THEN CASE WHEN n_predicted > 0 THEN n_both / n_predicted WHEN n_gold = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS precision,
            CASE WHEN kind = 'multi' THEN CASE WHEN n_gold > 0 THEN n_both / n_gold ELSE 1.0::DOUBLE END END AS recall,
            n_predicted - n_both AS spurious, n_gold - n_both AS missed,
            kind = 'single' AND list_contains(g, 'unknown') AS gold_unknown, kind = 'single' AND list_contains(p, 'unknown') AS predicted_unknown,
            CASE WHEN kind = 'single' THEN g[1] ELSE '[' || array_to_string(g, ', ') || ']' END AS gold_value,
            CASE WHEN kind = 'single' THEN p[1] ELSE '[' || array_to_string(p, ', ') || ']' END AS predicted_value
        FROM (SELECT model, item_id, field, kind, g, p, len(list_intersect(p, g)) AS n_both, len(list_distinct(list_concat(p, g))) AS n_union, len(p) AS n_predicted, len(g) AS n_gold
            FROM gl JOIN pl USING (item_id, field))""",
    "att": "SELECT (SELECT count(*) FROM part) AS attempted",
    "rep": """SELECT model, field, kind, count(*) AS items, sum(score) / count(*) AS strict_score, sum(score) / any_value(attempted) AS end_to_end_score,
        avg(score) FILTER (NOT gold_unknown) AS informative_score, count(*) FILTER (NOT gold_unknown) AS informative_items, count(*) FILTER (gold_unknown) AS gold_unknown,
        count(*) FILTER (predicted_unknown) AS predicted_unknown, CASE WHEN kind = 'multi' THEN sum(n_both) / sum(n_predicted) END AS precision,
        CASE WHEN kind = 'multi' THEN sum(n_both) / sum(n_gold) END AS recall, sum(spurious) AS spurious, sum(missed) AS missed FROM cmp CROSS JOIN att GROUP BY 1, 2, 3""",
    "per": "SELECT model, item_id, avg(score) AS macro_score, sum(spurious) AS spurious, sum(missed) AS missed FROM cmp GROUP BY 1, 2",
    "summ": """SELECT i.*, attempted, items / attempted AS coverage, m / items AS macro_score, m / attempted AS end_to_end_macro, single_macro, multi_macro, end_to_end_single_macro, end_to_end_multi_macro
        FROM (SELECT model, count(*) AS items, sum(macro_score) AS m, sum(spurious) AS spurious, sum(missed) AS missed FROM per GROUP BY 1) i CROSS JOIN att
        JOIN (SELECT model, avg(strict_score) FILTER (kind = 'single') AS single_macro, avg(strict_score) FILTER (kind = 'multi') AS multi_macro,
            avg(end_to_end_score) FILTER (kind = 'single') AS end_to_end_single_macro, avg(end_to_end_score) FILTER (kind = 'multi') AS end_to_end_multi_macro FROM rep GROUP BY 1) USING (model)""",
}
_SUM_NUMS = "coverage, macro_score, end_to_end_macro, single_macro, multi_macro, end_to_end_single_macro, end_to_end_multi_macro"


@query(
    "SELECT * FROM cmp", _EVAL, keys="model, item_id, field, kind, gold_unknown, predicted_unknown, gold_value, predicted_value",
    ints="spurious, missed, n_both, n_predicted, n_gold", nums="score, precision, recall",
)
def label_agreement(spark, d):
    return _compared(spark, d).withColumn("spurious", F.size("spurious")).withColumn("missed", F.size("missed"))


@query("SELECT * FROM per", _EVAL, keys="model, item_id", ints="spurious, missed", nums="macro_score")
def item_agreement(spark, d):
    return Q.per_item(_compared(spark, d))


@query(
    "SELECT * FROM rep", _EVAL, keys="model, field, kind", ints="items, informative_items, gold_unknown, predicted_unknown, spurious, missed",
    nums="strict_score, end_to_end_score, informative_score, precision, recall",
)
def field_report(spark, d):
    return Q.field_report(_compared(spark, d), _attempts(spark, d))


@query("SELECT * FROM summ", _EVAL, keys="model", ints="items, attempted, spurious, missed", nums=_SUM_NUMS)
def label_summary(spark, d):
    return Q.summary(_compared(spark, d), _attempts(spark, d))


@query(
    """SELECT model, field, gold_value, predicted_value, n, rank, array_to_string(examples[1:3], ',') AS examples FROM (
        SELECT model, field, gold_value, predicted_value, count(*) AS n, list(item_id ORDER BY item_id) AS examples,
            row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, field, gold_value, predicted_value) AS rank FROM cmp WHERE score < 1 GROUP BY 1, 2, 3, 4) WHERE rank <= 5""",
    _EVAL, keys="model, field, gold_value, predicted_value, examples", ints="n, rank",
)
def error_patterns(spark, d):
    return Q.error_patterns(_compared(spark, d))


@query(
    "SELECT * FROM (SELECT model, item_id, field, score, row_number() OVER (PARTITION BY model, item_id ORDER BY place, field) AS rank FROM cmp JOIN (SELECT field, min(slot) AS place FROM tax GROUP BY 1) USING (field) WHERE score < 1) WHERE rank <= 3",
    _EVAL, keys="model, item_id, field", ints="rank", nums="score",
)
def worst_fields(spark, d):
    return Q.worst_fields(_compared(spark, d), [f for f, _ in T.vocabulary().fields])


@query(
    """SELECT * FROM (SELECT model, 'weakest' AS side, field, strict_score, row_number() OVER (PARTITION BY model ORDER BY round(strict_score, 12), field) AS rank FROM rep WHERE kind = 'single'
        UNION ALL SELECT model, 'strongest', field, strict_score, row_number() OVER (PARTITION BY model ORDER BY round(strict_score, 12) DESC, field) FROM rep) WHERE rank <= 5""",
    _EVAL, keys="model, side, field", ints="rank", nums="strict_score",
)
def extreme_fields(spark, d):
    return Q.extreme_fields(Q.field_report(_compared(spark, d), _attempts(spark, d)))


@query(
    """SELECT metric, max(v) FILTER (model = 'a') AS a, max(v) FILTER (model = 'b') AS b,
        metric LIKE 'end_to_end%' OR metric = 'coverage' OR (SELECT max(coverage) - min(coverage) < 1e-12 FROM summ) AS comparable FROM (
        UNPIVOT (SELECT model, coverage, macro_score, single_macro, multi_macro, end_to_end_macro, end_to_end_single_macro, end_to_end_multi_macro FROM summ)
        ON coverage, macro_score, single_macro, multi_macro, end_to_end_macro, end_to_end_single_macro, end_to_end_multi_macro INTO NAME metric VALUE v) GROUP BY 1""",
    _EVAL, keys="metric, comparable", nums="a, b",
)
def models_side_by_side(spark, d):
    return Q.side_by_side(Q.summary(_compared(spark, d), _attempts(spark, d)), ["a", "b"])


@query(
    """SELECT model || '/' || split AS model, avg(m) AS macro_score, count(*) AS items FROM (SELECT model, item_id, macro_score AS m, unnest([CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'holdout' END, 'all']) AS split FROM per) GROUP BY 1""",
    _EVAL, keys="model", ints="items", nums="macro_score",
)
def split_report(spark, d):
    """Development, held-out and combined items scored apart: the split becomes part of the model key."""
    split = F.explode(F.array(F.when(F.col("item_id") % 2 == 0, "dev").otherwise("holdout"), F.lit("all")))
    keyed = _compared(spark, d).withColumn("split", split).withColumn("model", F.concat_ws("/", "model", "split")).drop("split")
    return Q.per_item(keyed).groupBy("model").agg(F.avg("macro_score").alias("macro_score"), F.count(F.lit(1)).alias("items"))


_SPLIT = "CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'holdout' END"
_BY_SPLIT = {
    "cs": "SELECT *, unnest([CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'holdout' END, 'all']) AS split FROM cmp",
    "asked": "SELECT split, count(DISTINCT item_id) AS attempted FROM (SELECT item_id, unnest([CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'holdout' END, 'all']) AS split FROM parts) GROUP BY 1",
    "reps": """SELECT split, model, field, kind, count(*) AS items, sum(score) / count(*) AS strict_score, sum(score) / any_value(attempted) AS end_to_end_score,
        avg(score) FILTER (NOT gold_unknown) AS informative_score, count(*) FILTER (NOT gold_unknown) AS informative_items, count(*) FILTER (gold_unknown) AS gold_unknown,
        count(*) FILTER (predicted_unknown) AS predicted_unknown, CASE WHEN kind = 'multi' THEN sum(n_both) / sum(n_predicted) END AS precision,
        CASE WHEN kind = 'multi' THEN sum(n_both) / sum(n_gold) END AS recall, sum(spurious) AS spurious, sum(missed) AS missed FROM cs JOIN asked USING (split) GROUP BY 1, 2, 3, 4""",
    "pers": "SELECT split, model, item_id, avg(score) AS m, sum(spurious) AS spurious, sum(missed) AS missed FROM cs GROUP BY 1, 2, 3",
}


@query(
    """SELECT i.*, items / attempted AS coverage, m / items AS macro_score, m / attempted AS end_to_end_macro, single_macro, multi_macro, end_to_end_single_macro, end_to_end_multi_macro
        FROM (SELECT split, model, any_value(attempted) AS attempted, count(*) AS items, sum(m) AS m, sum(spurious) AS spurious, sum(missed) AS missed FROM pers JOIN asked USING (split) GROUP BY 1, 2) i
        JOIN (SELECT split, model, avg(strict_score) FILTER (kind = 'single') AS single_macro, avg(strict_score) FILTER (kind = 'multi') AS multi_macro,
            avg(end_to_end_score) FILTER (kind = 'single') AS end_to_end_single_macro, avg(end_to_end_score) FILTER (kind = 'multi') AS end_to_end_multi_macro FROM reps GROUP BY 1, 2) USING (split, model)""",
    {**_EVAL, **_BY_SPLIT}, keys="split, model", ints="items, attempted, spurious, missed", nums=_SUM_NUMS,
)
def split_summary(spark, d):
    """Everything of the summary for development, held-out and all items apart."""
    return Q.split_reports(_compared(spark, d), _gold(spark, d), _predicted(spark, d), F.expr(_SPLIT))[0]


@query(
    "SELECT * FROM reps", {**_EVAL, **_BY_SPLIT}, keys="split, model, field, kind", ints="items, informative_items, gold_unknown, predicted_unknown, spurious, missed",
    nums="strict_score, end_to_end_score, informative_score, precision, recall",
)
def split_field_report(spark, d):
    """The report of every field for development, held-out and all items apart."""
    return Q.split_reports(_compared(spark, d), _gold(spark, d), _predicted(spark, d), F.expr(_SPLIT))[1]


# --- cost ---


def _runs(spark, d):
    reporting = F.col("l_returnflag") != "N"
    return T.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("item_id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("run_key"),
        (F.col("l_linenumber") + 5).alias("frames_used"),
        F.when(reporting, F.col("l_quantity") * 100).alias("tokens_in"),
        F.when(reporting, F.col("l_quantity") * 10).alias("tokens_out"),
        (F.col("l_extendedprice") / 10).alias("latency_ms"),
        F.when(F.col("l_tax") > 0.06, 2).otherwise(1).alias("attempts"),
        (F.col("l_extendedprice") * 100).alias("size_bytes"),
        (F.col("l_quantity") * 4).alias("duration_s"),
        F.concat(F.lit("model-"), "l_returnflag").alias("model_name"),
        F.concat(F.lit("v-"), "l_linestatus").alias("model_version"),
    )


_COST = {
    "runs": """SELECT l_linenumber + 5 AS frames_used, CASE WHEN l_returnflag <> 'N' THEN l_quantity * 100 END AS tokens_in, CASE WHEN l_returnflag <> 'N' THEN l_quantity * 10 END AS tokens_out,
        l_extendedprice / 10 AS latency_ms, CASE WHEN l_tax > 0.06 THEN 2 ELSE 1 END AS attempts, l_extendedprice * 100 AS size_bytes, l_quantity * 4 AS duration_s,
        'model-' || l_returnflag AS model_name, 'v-' || l_linestatus AS model_version FROM lineitem""",
    "measured": """SELECT count(*) AS items, avg(frames_used) AS avg_frames, avg(tokens_in) AS avg_tokens_in, avg(tokens_out) AS avg_tokens_out, avg(latency_ms) AS avg_latency,
        quantile_cont(latency_ms, 0.95) AS p95_latency, count(tokens_in) AS token_samples, avg(size_bytes) AS avg_size, avg(duration_s) AS avg_duration FROM runs""",
}


@query(
    "SELECT * FROM measured", _COST, ints="items, token_samples",
    nums="avg_frames, avg_tokens_in, avg_tokens_out, avg_latency, p95_latency, avg_size, avg_duration",
)
def cost_inputs(spark, d):
    return U.cost_inputs(_runs(spark, d))


@query(
    """SELECT scenario, provenance, unit, quantity, quantity * rate AS usd FROM (SELECT unnest([
        {'scenario': 'gpu_base', 'provenance': 'measured', 'unit': 'gpu_hours', 'quantity': avg_latency / 1000 * 100000 / 3600, 'rate': 0.6::DOUBLE},
        {'scenario': 'gpu_p95', 'provenance': 'measured', 'unit': 'gpu_hours', 'quantity': p95_latency / 1000 * 100000 / 3600, 'rate': 0.6::DOUBLE},
        {'scenario': 'gpu_batched', 'provenance': 'hypothetical', 'unit': 'gpu_hours', 'quantity': avg_latency / 1000 * 100000 / 3600 / 12, 'rate': 0.6::DOUBLE},
        {'scenario': 'media_storage', 'provenance': 'measured', 'unit': 'gib', 'quantity': avg_size * 100000 / 1073741824, 'rate': 0.023::DOUBLE},
        {'scenario': 'vector_rows', 'provenance': 'assumed', 'unit': 'gib', 'quantity': (30 * 4 + 8 + 2500) * 100000 / 1073741824::DOUBLE, 'rate': 0.023::DOUBLE},
        {'scenario': 'hosted_input', 'provenance': 'measured', 'unit': 'mtok', 'quantity': avg_tokens_in * 100000 / 1e6, 'rate': 0.2::DOUBLE},
        {'scenario': 'hosted_output', 'provenance': 'measured', 'unit': 'mtok', 'quantity': avg_tokens_out * 100000 / 1e6, 'rate': 0.6::DOUBLE},
        {'scenario': 'preprocess_cpu', 'provenance': 'assumed', 'unit': 'core_hours', 'quantity': 100000 * 0.786::DOUBLE / 3600, 'rate': 0.04::DOUBLE}], recursive := true) FROM measured)""",
    _COST, keys="scenario, provenance, unit", nums="quantity, usd",
)
def cost_scenarios(spark, d):
    return U.cost_scenarios(U.cost_inputs(_runs(spark, d)), T.vocabulary().dim, S)


@query(
    """SELECT model_name, scenario, provenance, unit, quantity, quantity * usd_rate AS usd, quantity * CASE WHEN unit = 'gpu_hours' THEN 41.06::DOUBLE ELSE usd_rate * 90 END AS rub FROM (SELECT model_name, unnest([
        {'scenario': 'gpu_base', 'provenance': 'measured', 'unit': 'gpu_hours', 'quantity': lat / 1000 * 100000 / 3600, 'usd_rate': 0.6::DOUBLE},
        {'scenario': 'gpu_p95', 'provenance': 'measured', 'unit': 'gpu_hours', 'quantity': p95 / 1000 * 100000 / 3600, 'usd_rate': 0.6::DOUBLE},
        {'scenario': 'gpu_batched', 'provenance': 'hypothetical', 'unit': 'gpu_hours', 'quantity': lat / 1000 * 100000 / 3600 / 12, 'usd_rate': 0.6::DOUBLE},
        {'scenario': 'media_storage', 'provenance': 'measured', 'unit': 'gib', 'quantity': size * 100000 / 1073741824, 'usd_rate': 0.023::DOUBLE},
        {'scenario': 'vector_rows', 'provenance': 'assumed', 'unit': 'gib', 'quantity': (30 * 4 + 8 + 2500) * 100000 / 1073741824::DOUBLE, 'usd_rate': 0.023::DOUBLE},
        {'scenario': 'hosted_input', 'provenance': 'measured', 'unit': 'mtok', 'quantity': tin * 100000 / 1e6, 'usd_rate': 0.2::DOUBLE},
        {'scenario': 'hosted_output', 'provenance': 'measured', 'unit': 'mtok', 'quantity': tout * 100000 / 1e6, 'usd_rate': 0.6::DOUBLE},
        {'scenario': 'preprocess_cpu', 'provenance': 'assumed', 'unit': 'core_hours', 'quantity': 100000 * 0.786::DOUBLE / 3600, 'usd_rate': 0.04::DOUBLE}], recursive := true)
        FROM (SELECT model_name, avg(latency_ms) AS lat, quantile_cont(latency_ms, 0.95) AS p95, avg(size_bytes) AS size, avg(tokens_in) AS tin, avg(tokens_out) AS tout FROM runs GROUP BY 1))""",
    _COST, keys="model_name, scenario, provenance, unit", nums="quantity, usd, rub",
)
def cost_scenarios_by_model(spark, d):
    """Scenarios per model in two currencies. The model that reports no tokens has no hosted amounts, which is not the same as nothing to pay."""
    s = S.but(cost_rub_per_usd=90.0)
    return U.with_rub(U.cost_scenarios(U.cost_inputs(_runs(spark, d), "model_name"), T.vocabulary().dim, s), s)


@query("SELECT model_name, model_version, count(*) AS n FROM runs GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 1", _COST)
def modal_model(spark, d):
    return U.modal_model(_runs(spark, d))


@query(
    """SELECT sum(frames_used) AS frames, sum(latency_ms) / 1000 AS latency_total_s, avg(latency_ms) AS latency_avg_ms, count(tokens_in) AS reporting, sum(tokens_in) AS tokens_in,
        sum(tokens_out) AS tokens_out, avg(tokens_in) AS tokens_in_avg FROM runs""",
    _COST, ints="frames, reporting", nums="latency_total_s, latency_avg_ms, tokens_in, tokens_out, tokens_in_avg",
)
def run_totals(spark, d):
    return U.run_totals(_runs(spark, d))


@query(
    """SELECT model_name, avg(latency_ms) AS latency_mean, avg(frames_used) AS frames_mean, avg(tokens_in) AS tokens_in_mean, avg(tokens_out) AS tokens_out_mean,
        avg(tokens_in) / avg(frames_used) AS tokens_per_frame, count(*) FILTER (attempts > 1) AS repaired,
        list(latency_ms ORDER BY latency_ms)[(least(count(*) - 1, floor(0.5 * count(*))) + 1)::INT] AS p50, list(latency_ms ORDER BY latency_ms)[(least(count(*) - 1, floor(0.95 * count(*))) + 1)::INT] AS p95
       FROM runs GROUP BY 1""",
    _COST, keys="model_name", ints="repaired", nums="latency_mean, frames_mean, tokens_in_mean, tokens_out_mean, tokens_per_frame, p50, p95",
)
def run_statistics(spark, d):
    return U.run_statistics(_runs(spark, d), "model_name", "run_key")


# --- feed tables: one generation per order ---

FEED_NOW = "2001-08-02 00:00:00"
FS = S.but(now=FEED_NOW, feed_ttl_seconds=86_400 * 200)
_GEN = {
    "gi": "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS it FROM lineitem GROUP BY 1",
    "gen": f"""SELECT 'feed-' || o_orderkey AS feed_id, o_custkey AS user_id, o_orderkey % 4 AS epoch, o_orderkey AS published_seq, o_orderdate AS generated_at,
        o_orderdate + to_seconds({86_400 * 400}) AS expires_at, o_orderpriority = '5-LOW' AS candidate_shortage, coalesce(it, []::BIGINT[]) AS it
        FROM orders LEFT JOIN gi ON l_orderkey = o_orderkey""",
    "cur": "SELECT o_custkey AS user_id, count(*) FILTER (o_orderstatus = 'F') % 4 AS epoch FROM orders GROUP BY 1",
    "live": f"""SELECT g.* FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY published_seq DESC) AS r FROM gen) g JOIN cur c ON c.user_id = g.user_id AND c.epoch = g.epoch
        WHERE r = 1 AND epoch_us(TIMESTAMP '{FEED_NOW}') - epoch_us(generated_at) < {86_400 * 200 * 1_000_000}""",
    "jobs": """SELECT c_custkey AS user_id, c_custkey % 4 AS epoch, CASE c_mktsegment WHEN 'BUILDING' THEN 'miss' WHEN 'MACHINERY' THEN 'invalidation' WHEN 'HOUSEHOLD' THEN 'refill' ELSE 'prewarm' END AS reason FROM customer""",
    "served": """SELECT r.request_id, CASE WHEN g.feed_id IS NULL THEN 'gone' ELSE 'ready' END AS status, array_to_string(g.it[r.off + 1:r.off + 3], ',') AS page,
        greatest(0, least(3, len(g.it) - r.off)) AS n_served, coalesce(len(g.it), 0) AS total, candidate_shortage, r.off FROM (
        SELECT o_orderkey AS request_id, o_custkey AS user_id, 'feed-' || CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS feed_id, o_custkey % 5 AS off FROM orders) r
        LEFT JOIN gen g ON g.user_id = r.user_id AND g.feed_id = r.feed_id""",
}


def _generations(spark, d):
    lines = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    items = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    made = F.transform("l", lambda x, i: F.struct(x["l_partkey"].alias("item_id"), (i + 1).alias("rank"), F.lit(None).cast("string").alias("creator_id")))
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    return (
        T.table(spark, d, "orders")
        .join(items, F.col("l_orderkey") == k, "left")
        .select(
            F.concat(F.lit("feed-"), k.cast("string")).alias("feed_id"), F.col("o_custkey").alias("user_id"), (k % 4).alias("epoch"), k.alias("published_seq"),
            at.alias("generated_at"), F.timestamp_add("DAY", F.lit(400), at).alias("expires_at"), (F.col("o_orderpriority") == "5-LOW").alias("candidate_shortage"),
            F.coalesce(made, F.array().cast("array<struct<item_id:bigint,rank:int,creator_id:string>>")).alias("items"),
        )
    )


def _epochs(spark, d):
    return T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg((F.count_if(F.col("o_orderstatus") == "F") % 4).alias("epoch"))


def _live(spark, d):
    return Z.active(_generations(spark, d), _epochs(spark, d), F.lit(FEED_NOW).cast("timestamp"), FS)


def _jobs(spark, d):
    seg = F.col("c_mktsegment")
    reason = F.when(seg == "BUILDING", "miss").when(seg == "MACHINERY", "invalidation").when(seg == "HOUSEHOLD", "refill").otherwise("prewarm")
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 4).alias("epoch"), reason.alias("reason"))


def _served(spark, d):
    k = F.col("o_orderkey")
    feed = F.concat(F.lit("feed-"), F.when(k % 10 == 0, k + 1000000000).otherwise(k).cast("string"))
    reads = T.table(spark, d, "orders").select(
        k.alias("request_id"), F.col("o_custkey").alias("user_id"), feed.alias("feed_id"), (F.col("o_custkey") % 5).cast("int").alias("offset"), F.lit(3).alias("page_size")
    )
    return Z.pages(reads, _generations(spark, d))


@query("SELECT user_id, feed_id, epoch FROM live", _GEN, keys="user_id, feed_id", ints="epoch")
def feed_active(spark, d):
    return _live(spark, d).select("user_id", "feed_id", "epoch")


@query("SELECT user_id, feed_id, r AS age_rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY published_seq DESC) AS r FROM gen) WHERE r <= 2", _GEN, keys="user_id, feed_id", ints="age_rank")
def feed_retained(spark, d):
    return Z.retained(_generations(spark, d), FS).select("user_id", "feed_id", "age_rank")


@query(f"SELECT CASE WHEN expires_at > TIMESTAMP '{FEED_NOW}' THEN 'ready' ELSE 'gone' END AS status, count(*) AS n FROM gen GROUP BY 1", _GEN)
def feed_expiry(spark, d):
    out = Z.expired_status(_generations(spark, d), F.lit(FEED_NOW).cast("timestamp"))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT user_id, count(*) AS epoch FROM ev WHERE {O.WEIGHT} <> 0 GROUP BY 1")
def feed_epochs(spark, d):
    return Z.epochs(T.events(spark, d))


@query(
    """SELECT j.user_id, j.reason, CASE WHEN j.epoch <> coalesce(c.epoch, 0) THEN 'stale' WHEN j.reason IN ('miss', 'invalidation') AND l.epoch = j.epoch THEN 'already_built' ELSE 'build' END AS verdict
       FROM jobs j LEFT JOIN cur c USING (user_id) LEFT JOIN live l ON l.user_id = j.user_id""",
    _GEN,
)
def feed_guard(spark, d):
    return Z.guard_jobs(_jobs(spark, d), _epochs(spark, d), _live(spark, d)).select("user_id", "reason", "verdict")


@query(
    """SELECT request_id, status, page, CASE WHEN status = 'ready' THEN n_served ELSE 0 END AS served, off + CASE WHEN status = 'ready' THEN n_served ELSE 0 END < total AS has_more,
        greatest(0, total - off - CASE WHEN status = 'ready' THEN n_served ELSE 0 END) AS remaining FROM served""",
    _GEN, keys="request_id, status, page, has_more", ints="served, remaining",
)
def feed_pages(spark, d):
    page = F.when(F.col("page").isNotNull(), F.array_join("page.item_id", ","))
    return _served(spark, d).select("request_id", "status", page.alias("page"), "served", "has_more", "remaining")


@query(
    "SELECT request_id FROM served WHERE status = 'ready' AND total - off - n_served <= 10 AND NOT candidate_shortage AND total > 0", _GEN
)
def feed_refills(spark, d):
    return Z.needs_refill(_served(spark, d), FS).select("request_id")


@query(
    """SELECT min(o_orderkey) AS request_id, CASE WHEN reason = 'refill' THEN 'refill:' || o_custkey || ':' || feed_id ELSE 'build:' || o_custkey || ':' || epoch END AS dedup_key
       FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'refill' ELSE 'miss' END AS reason, 'f' || o_orderkey % 3 AS feed_id, o_orderkey % 4 AS epoch FROM orders) GROUP BY 2"""
)
def feed_request_dedup(spark, d):
    k = F.col("o_orderkey")
    requests = T.table(spark, d, "orders").select(
        k.alias("request_id"), F.col("o_custkey").alias("user_id"), (k % 4).alias("epoch"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("feed_id"),
        F.when(F.col("o_orderstatus") == "P", "refill").otherwise("miss").alias("reason"),
    )
    return Z.dedupe_requests(requests).select("request_id", "dedup_key")


@query("SELECT feed_id FROM gen WHERE user_id NOT IN (SELECT user_id FROM ev)", _GEN)
def feed_clear(spark, d):
    return Z.clear(_generations(spark, d), T.events(spark, d).select("user_id").distinct()).select("feed_id")


@query(
    "SELECT coalesce(c.user_id, e.user_id) AS user_id, coalesce(c.epoch, 0) + CASE WHEN e.user_id IS NULL THEN 0 ELSE 1 END AS epoch FROM cur c FULL JOIN (SELECT DISTINCT user_id FROM ev) e USING (user_id)",
    _GEN, keys="user_id", ints="epoch",
)
def feed_epoch_bump(spark, d):
    return Z.bump_epochs(_epochs(spark, d), T.events(spark, d))


@query(
    """SELECT a.user_id AS a, b.user_id AS b, len(list_intersect(a.it, b.it)) AS shared, len(a.it) AS size_a, a.it = b.it AS identical FROM
       (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY published_seq DESC) AS r FROM gen) WHERE r = 1) a
       JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY published_seq DESC) AS r FROM gen) WHERE r = 1) b ON b.user_id = a.user_id + 1""",
    _GEN, keys="a, b, identical", ints="shared, size_a",
)
def feed_overlap(spark, d):
    newest = Z.newest_first(_generations(spark, d), 1).select("user_id", F.col("items.item_id").alias("items"))
    pairs = T.table(spark, d, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return R.overlap(pairs, newest)


def _build(spark, d, sidecar: bool):
    i = tag_inputs(spark, d)
    current = materialise(Z.epochs(i.events))
    jobs = current.select("user_id", "epoch", F.lit("invalidation").alias("reason"))
    none = spark.createDataFrame([], "user_id bigint, epoch bigint")
    return build_feeds(jobs, i, lambda: current, lambda: none, seq=1, with_sidecar=sidecar)


_BUILT = {
    "epo": f"SELECT user_id, count(*) AS epoch FROM ev WHERE {O.WEIGHT} <> 0 GROUP BY 1",
    "short": f"SELECT user_id, candidate_shortage FROM ({_counts_sql(S.feed_size)})",
    "built": f"""SELECT sha256(e.user_id || '|' || e.epoch || '|1') AS feed_id, e.user_id, e.epoch, epoch_us({O.NOW}) AS generated_at,
        epoch_us({O.NOW}) + {S.feed_ttl_seconds * S.feed_retention_factor}::BIGINT * 1000000 AS expires_at, coalesce(p.is_cold_start, true) AS cold_start,
        coalesce(s.candidate_shortage, true) AS candidate_shortage, coalesce(r.relaxed, false) AS diversity_relaxed, coalesce(r.items, '') AS items
        FROM epo e LEFT JOIN prof p USING (user_id) LEFT JOIN short s USING (user_id)
        LEFT JOIN (SELECT user_id, bool_or(relaxed) AS relaxed, string_agg(item_id, ',' ORDER BY rank) AS items FROM reranked GROUP BY 1) r USING (user_id)""",
}
_TERMS = ("content_similarity", "tag_affinity", "affinity", "creator_affinity", "popularity", "freshness", "fatigue", "exploration", "quality")


@query("SELECT * FROM built", _BUILT)
def feed_build(spark, d):
    made = _build(spark, d, False).generations
    return made.select("feed_id", "user_id", "epoch", "generated_at", "expires_at", "cold_start", "candidate_shortage", "diversity_relaxed", F.col("items.item_id").alias("items"))


@query(
    f"""SELECT r.user_id, r.item_id, r.rank, s.sources, i.creator_handle, i.external_id, coalesce(t.tags, '') AS tags, {", ".join(f"round(floor(s.{c} * 10000 + 0.5) / 10000, 6) + 0.0 AS {c}" for c in _TERMS)},
        s.quality_available, {", ".join(f"round(floor({'-' if c == 'fatigue' else ''}s.{c} * {w} * 10000 + 0.5) / 10000, 6) + 0.0 AS w_{c}" for c, w in S.rank_weights.items())},
        {", ".join(f"round(floor(r.{c} * 10000 + 0.5) / 10000, 6) + 0.0 AS {c}" for c in ("base_score", "diversity_penalty", "final_score"))}, r.relaxed, b.feed_id, b.epoch, b.generated_at
        FROM reranked r JOIN scored s USING (user_id, item_id) JOIN items i ON i.item_id = r.item_id JOIN built b ON b.user_id = r.user_id
        LEFT JOIN (SELECT t.item_id, string_agg(t.field || ':' || t.value, ',' ORDER BY x.slot) AS tags FROM tags t JOIN tax x USING (field, value)
            WHERE x.diversity AND t.value NOT IN ('none', 'unknown') GROUP BY 1) t ON t.item_id = r.item_id""",
    _BUILT,
)
def feed_sidecar(spark, d):
    return _build(spark, d, True).sidecar


@query(
    "SELECT g.item_id, e.creator_id, round(g.engagement, 10) AS engagement FROM eng g JOIN elig e USING (item_id) WHERE round(g.engagement, 10) > 0 ORDER BY 3 DESC, 1 LIMIT 100",
    keys="item_id, creator_id", nums="engagement",
)
def trending_feed(spark, d):
    i = tag_inputs(spark, d)
    return trending.fallback_feed(i.engagement, i.eligible, S)


# --- ranking quality ---


@query(
    """SELECT w.user_id, coalesce(h.dcg, 0) / list_sum(list_transform(range(1, least(w.n, 50) + 1), lambda i: 1 / log2(i + 1.0))) AS ndcg, coalesce(h.n, 0) / w.n AS recall,
        CASE WHEN h.n > 0 THEN 1.0 ELSE 0.0 END AS hit FROM (SELECT user_id, count(DISTINCT item_id) AS n FROM ev WHERE type = 'like' GROUP BY 1) w LEFT JOIN (
        SELECT t.user_id, sum(1 / log2(t.rank + 1.0)) AS dcg, count(*) AS n FROM tops t WHERE EXISTS (SELECT 1 FROM ev WHERE ev.user_id = t.user_id AND ev.item_id = t.item_id AND ev.type = 'like') GROUP BY 1) h USING (user_id)""",
    {
        "tops": """SELECT p.user_id, g.item_id, g.rank FROM (SELECT DISTINCT user_id FROM ev) p CROSS JOIN
            (SELECT item_id, row_number() OVER (ORDER BY round(engagement, 10) DESC, item_id) AS rank FROM eng QUALIFY rank <= 50) g"""
    },
    keys="user_id", nums="ndcg, recall, hit",
)
def ranking_quality(spark, d):
    """The global trending list of 50 judged against each user's likes."""
    e = T.events(spark, d)
    top = H.engagement(e, S).orderBy(F.desc(F.round("engagement", 10)), "item_id").limit(50)
    w = F.row_number().over(H.Window.orderBy(F.desc(F.round("engagement", 10)), "item_id"))  # at most 50 rows
    ranked = top.select("item_id", w.alias("rank"))
    likes = e.where(F.col("type") == "like")
    judged = likes.select("user_id", "item_id").distinct().join(F.broadcast(ranked), "item_id")
    return Q.ranking_quality(judged.select("user_id", "item_id", "rank"), likes, 50)


@query(
    """SELECT sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT value, count(*) FILTER (type = 'like') AS pos, count(*) FILTER (type <> 'like') AS neg FROM ev GROUP BY 1))""",
    nums="auc",
)
def ranking_auc(spark, d):
    e = T.events(spark, d)
    return Q.auc(e.select(F.col("value").alias("score"), (F.col("type") == "like").cast("int").alias("label")))


# Training labels come from the second half of January before the 23rd, held-out labels from the days after it.
_TRAIN, _TEST, _END = "2024-01-12 00:00:00", "2024-01-22 00:00:00", S.now
_N_TERMS = len(ranker_eval.TERMS)


def _examples_sql(start: str, end: str, suffix: str) -> dict[str, str]:
    labels = f"""SELECT user_id, item_id, CASE WHEN round(sum({O.WEIGHT}), 9) > 0 THEN 1 ELSE 0 END AS label FROM ev
        WHERE created_at >= TIMESTAMP '{start}' AND created_at < TIMESTAMP '{end}' AND {O.WEIGHT} <> 0 AND user_id IS NOT NULL AND item_id IS NOT NULL GROUP BY 1, 2"""
    return {
        f"outcome{suffix}": labels,
        **O.as_of(start, suffix, cand=f"SELECT user_id, item_id, 'logged' AS sources FROM outcome{suffix}"),
        f"example{suffix}": f"""SELECT s.user_id, s.item_id, s.base_score, o.label, [{", ".join(f"s.{t}" for t in ranker_eval.TERMS)}, 1.0::DOUBLE] AS x
            FROM scored{suffix} s JOIN outcome{suffix} o USING (user_id, item_id)""",
    }


_LEARNED = {
    **_examples_sql(_TRAIN, _TEST, "_train"),
    "normal": f"""SELECT i, list(g ORDER BY j) AS g FROM (SELECT i, j, sum(x[i] * CASE WHEN j = {_N_TERMS + 2} THEN label ELSE x[j] END) + CASE WHEN i = j AND i <= {_N_TERMS} THEN 1.0 ELSE 0.0 END AS g
        FROM example_train, range(1, {_N_TERMS + 2}) a(i), range(1, {_N_TERMS + 3}) b(j) GROUP BY 1, 2) GROUP BY 1""",
    # Gauss and Jordan, one column a step; the matrix is positive definite, so no rows change places.
    "solved": f"""SELECT 1 AS step, (SELECT list(g ORDER BY i) FROM normal) AS m UNION ALL
        SELECT step + 1, list_transform(m, lambda r, i: CASE WHEN i = step THEN list_transform(r, lambda c: c / m[step][step])
            ELSE list_transform(r, lambda c, j: c - r[step] / m[step][step] * m[step][j]) END) FROM solved WHERE step <= {_N_TERMS + 1}""",
    "weights": f"SELECT list_transform(m, lambda r: r[{_N_TERMS + 2}]) AS w FROM solved WHERE step = {_N_TERMS + 2}",
}
_HELD_OUT = {
    **_LEARNED,
    **_examples_sql(_TEST, _END, "_test"),
    "judged": f"""SELECT 'fixed' AS ranker, user_id, item_id, label, base_score AS score FROM example_test UNION ALL
        SELECT 'learned', user_id, item_id, label, round(list_dot_product(x, w), {ranker_eval.SCORE_DIGITS}) FROM example_test CROSS JOIN weights""",
    "placed": "SELECT *, row_number() OVER (PARTITION BY ranker, user_id ORDER BY score DESC, item_id) AS rank FROM judged",
    "found": """SELECT ranker, user_id, sum(label) AS n, coalesce(sum(1 / log2(rank + 1.0)) FILTER (label = 1 AND rank <= 10), 0) AS dcg, count(*) FILTER (label = 1 AND rank <= 10) AS hits
        FROM placed GROUP BY 1, 2 HAVING sum(label) > 0""",
    "means": """SELECT ranker, count(*) AS users, avg(dcg / list_sum(list_transform(range(1, least(n, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1.0)))) AS ndcg, avg(hits / n) AS recall,
        avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM found GROUP BY 1""",
    "areas": """SELECT ranker, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY ranker ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT ranker, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM judged GROUP BY 1, 2)) GROUP BY 1""",
}


@query(
    f"SELECT unnest([{', '.join(repr(t) for t in (*ranker_eval.TERMS, 'constant'))}]) AS feature, unnest(w) AS weight FROM weights",
    _LEARNED, keys="feature", nums="weight",
)
def learned_ranker(spark, d):
    """Ridge regression of later outcomes on ranking features as of the start of the training period."""
    weights = ranker_eval.fit_ridge(ranker_eval.examples(tag_inputs(spark, d), _TRAIN, _TEST))
    return spark.createDataFrame(list(zip((*ranker_eval.TERMS, "constant"), weights)), "feature string, weight double")


@query("SELECT m.ranker, users, ndcg, recall, hit, auc FROM means m JOIN areas a ON a.ranker = m.ranker", _HELD_OUT, keys="ranker", ints="users", nums="ndcg, recall, hit, auc")
def ranker_comparison(spark, d):
    """Fixed and learned weights on events after both were set."""
    return ranker_eval.compare_rankers(tag_inputs(spark, d), _TRAIN, _TEST, _END)


# --- streams, replayed to the end ---


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _replay(spark, d, resend: bool = False):
    """The events file as a stream; ``resend`` repeats every twentieth row, as clients do after a timeout."""
    schema = T.table(spark, d, "events").schema
    raw = intake.read_events(spark, d, schema, fmt="parquet", pathGlobFilter="events.parquet")
    kind = F.col("event_type")
    mapped = F.when(kind == "view", "view").when(kind == "click", "complete").when(kind == "purchase", "like").when(kind == "error", "skip").when(kind == "signup", "impression")
    times = F.when(F.col("event_id") % 20 == 0, 2).otherwise(1) if resend else F.lit(1)
    return raw.select(
        "event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), mapped.alias("type"), F.col("ts").cast("timestamp").alias("created_at"),
        F.explode(F.array_repeat(F.lit(1), times)).alias("_n"),
    ).drop("_n")


_LOG = "event_id bigint, user_id bigint, item_id bigint, type string, created_at timestamp"


def _chunked_replay(spark, d, resend: bool = False, chunks: int = 10):
    """The log dealt over ``chunks`` files by a hash of its keys, one file per micro-batch: every batch has early and late rows."""
    out = f"{_scratch(spark)}/chunks"
    rows = T.events(spark, d).select("event_id", "user_id", "item_id", "type", "created_at")
    times = F.when(F.col("event_id") % 20 == 0, 2).otherwise(1) if resend else F.lit(1)
    copies = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), times)))
    dealt = copies.withColumn("chunk", F.pmod(F.xxhash64("event_id", "_n"), F.lit(chunks)).cast("int")).drop("_n")
    dealt.repartitionById(chunks, F.col("chunk")).write.partitionBy("chunk").parquet(out)
    return intake.read_events(spark, f"{out}/*", dealt.drop("chunk").schema, fmt="parquet")


def _finish(spark, stream, schema, mode="append"):
    out = _scratch(spark)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}/ck").trigger(availableNow=True).start(f"{out}/data")
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/data")


@query("SELECT type, count(*) AS n, count(DISTINCT event_id) AS keys FROM ev GROUP BY 1")
def stream_intake(spark, d):
    """Exactly-once intake in ten micro-batches: resent rows do not appear twice, and appending the whole log again adds nothing."""
    out = _scratch(spark)
    replay = _chunked_replay(spark, d, True)
    intake.exact_intake(replay, f"{out}/log", _LOG, f"{out}/ck").awaitTermination()
    append_events(spark, f"{out}/log", T.events(spark, d).select("event_id", "user_id", "item_id", "type", "created_at"), _LOG)
    log = spark.read.schema(_LOG).parquet(f"{out}/log")
    return log.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("keys"))


@query(f"SELECT user_id, count(*) AS epoch FROM ev WHERE {O.WEIGHT} <> 0 GROUP BY 1")
def stream_epochs(spark, d):
    """Epoch steps of each micro-batch, added up: only recorded, preference-changing events count."""
    out = _scratch(spark)

    def steps(recorded, batch_id):
        intake.epoch_steps(recorded).write.mode("overwrite").parquet(f"{out}/steps/batch={batch_id}")

    intake.exact_intake(_chunked_replay(spark, d, True), f"{out}/log", _LOG, f"{out}/ck", on_batch=steps).awaitTermination()
    read = spark.read.schema("user_id bigint, steps bigint").parquet(f"{out}/steps")
    return read.groupBy("user_id").agg(F.sum("steps").alias("epoch"))


@query("SELECT CASE WHEN event_id % 10 <> 3 THEN event_id END AS event_id, user_id FROM ev")
def stream_within_watermark(spark, d):
    """Ten micro-batches in which late rows, resent rows and rows without a key share the stream."""
    replay = _chunked_replay(spark, d, True).withColumn("event_id", F.when(F.col("event_id") % 10 != 3, F.col("event_id")))
    return _finish(spark, intake.within_watermark(replay), _LOG).select("event_id", "user_id")


_RAW = "event_id string, user_id string, item_id string, type string, watch_ratio double, watch_ms bigint, created_at timestamp"
_RECORDED = "event_id string, user_id bigint, item_id bigint, type string, watch_ratio double, watch_ms bigint, created_at timestamp"


def _raw_replay(spark, d):
    """What clients send: ids as text, some rows without a key, some that break a rule, some about unknown users or items; every twentieth row twice."""
    k = F.col("event_id")
    replay = _chunked_replay(spark, d, True)
    user = F.when(k % 37 == 1, F.concat(F.lit("u"), F.col("user_id"))).when(k % 29 == 2, (F.col("user_id") + 1_000_000).cast("string")).otherwise(F.col("user_id").cast("string"))
    return replay.select(
        F.when(k % 47 == 5, "").when(k % 10 != 3, k.cast("string")).alias("event_id"), user.alias("user_id"), F.col("item_id").cast("string").alias("item_id"),
        F.when(k % 41 == 4, "teleport").otherwise(F.col("type")).alias("type"), F.when(k % 43 == 6, 1.5).otherwise(0.5).alias("watch_ratio"),
        F.when(k % 53 == 7, -5).otherwise(k % 1000).alias("watch_ms"), "created_at",
    )


def _quarantined(spark, d) -> str:
    out = _scratch(spark)
    users, items = materialise_all(T.events(spark, d).select("user_id").distinct(), T.items(spark, d).select("item_id"))  # asked for by each micro-batch
    started = intake.quarantined_intake(_raw_replay(spark, d), lambda _: (users, items), f"{out}/log", f"{out}/quarantine", _RECORDED, f"{out}/ck")
    started.awaitTermination()
    return out


_CHECKED = {
    "sent": """SELECT event_id AS k, CASE WHEN event_id % 47 = 5 THEN '' WHEN event_id % 10 <> 3 THEN event_id::VARCHAR END AS key, user_id, item_id, created_at,
        CASE WHEN event_id % 41 = 4 THEN 'teleport' ELSE type END AS type, event_id % 37 = 1 AS bad_user, event_id % 29 = 2 AND event_id % 37 <> 1 AS unknown_user FROM ev""",
    "judged": """SELECT *, array_to_string(list_filter([CASE WHEN key = '' THEN 'event_id' END, CASE WHEN bad_user THEN 'user_id' END, CASE WHEN type = 'teleport' THEN 'type' END,
            CASE WHEN k % 43 = 6 THEN 'watch_ratio' END, CASE WHEN k % 53 = 7 THEN 'watch_ms' END], lambda x: x IS NOT NULL), ',') AS reasons,
        CASE WHEN bad_user OR unknown_user THEN 'unknown_user' WHEN item_id NOT IN (SELECT item_id FROM items) THEN 'unknown_item' END AS reference_error FROM sent""",
}


@query(
    """SELECT reasons, reference_error, count(*) AS n, count(DISTINCT k) AS n_rows FROM (SELECT * FROM judged UNION ALL SELECT * FROM judged WHERE k % 20 = 0)
       WHERE reasons <> '' OR reference_error IS NOT NULL GROUP BY 1, 2""",
    _CHECKED,
)
def stream_quarantine(spark, d):
    """What validated intake turned away in ten micro-batches, by broken rules and unknown ids; a row that is sent twice is turned away twice."""
    rows = intake.read_quarantine(spark, f"{_quarantined(spark, d)}/quarantine", _RAW)
    rows = rows.withColumn("k", F.struct("user_id", "item_id", "type", "created_at", "event_id", "watch_ms", "watch_ratio"))
    reasons = F.array_join("reasons", ",").alias("reasons")
    return rows.groupBy(reasons, "reference_error").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("n_rows"))


@query(
    """SELECT key AS event_id, user_id, item_id, type, epoch_us(created_at) AS created_at FROM judged WHERE reasons = '' AND reference_error IS NULL
       UNION ALL SELECT key, user_id, item_id, type, epoch_us(created_at) FROM judged WHERE reasons = '' AND reference_error IS NULL AND k % 20 = 0 AND key IS NULL""",
    _CHECKED,
)
def stream_accepted(spark, d):
    """What validated intake recorded in ten micro-batches: each key once, rows without a key as often as they came."""
    log = spark.read.schema(_RECORDED).parquet(f"{_quarantined(spark, d)}/log")
    return log.select("event_id", "user_id", "item_id", "type", "created_at")


@query("SELECT item_id, engagement FROM eng", keys="item_id", nums="engagement")
def stream_trending(spark, d):
    """Hourly counters kept per micro-batch, newest files first, read at ``now``: equal to the batch aggregate over raw events."""
    out = _scratch(spark)
    trending.keep_counters(_chunked_replay(spark, d), f"{out}/counters", f"{out}/ck").awaitTermination()
    return trending.engagement_from_counters(trending.read_counters(spark, f"{out}/counters"), S)


_PROFILE_SLOTS = "SELECT user_id, unnest(range(0, 30)) AS slot, unnest(v) AS weight FROM prof"


@query(_PROFILE_SLOTS, keys="user_id", ints="slot", nums="weight")
def stream_profiles(spark, d):
    """Decayed running sums per micro-batch, merged by addition, against the full-history profile."""
    i = tag_inputs(spark, d)
    out = _scratch(spark)
    known = i.items.select("item_id").join(i.usable_vectors.select("item_id", "vector"), "item_id", "left")

    def add(batch, batch_id):
        sums = profile_state.decayed_sums(batch.join(known, "item_id"), S.now, i.dim, S)
        sums.write.mode("overwrite").parquet(f"{out}/sums/batch={batch_id}")

    q = _chunked_replay(spark, d).writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = "user_id bigint, total bigint, effective bigint, skipped bigint, pos double, neg double, sums array<double>"
    parts = spark.read.schema(schema).parquet(f"{out}/sums")
    whole = parts.groupBy("user_id").agg(
        *[F.sum(c).alias(c) for c in ("total", "effective", "skipped", "pos", "neg")],
        F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(i.dim)]).alias("sums"),
    )
    return profile_state.profiles_from_sums(whole, S).select("user_id", F.posexplode("vector").alias("slot", "weight"))


@query(
    f"""SELECT user_id, epoch_us(min(created_at)) AS first_at, count(*) AS n_events FROM (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS burst FROM (
        SELECT *, CASE WHEN created_at >= lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS gap FROM ev WHERE {O.WEIGHT} <> 0)) GROUP BY user_id, burst"""
)
def coalesced_rebuilds(spark, d):
    """One rebuild per burst of activity, kept by ten micro-batches that all have early and late rows."""
    out = _scratch(spark)
    intake.keep_bursts(_chunked_replay(spark, d), f"{out}/bursts", f"{out}/ck", "6 hours").awaitTermination()
    return intake.read_bursts(spark, f"{out}/bursts", "6 hours").select("user_id", "first_at", "n_events")
