"""Predicted labels against reviewed ones, as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.taxonomy import Taxonomy


def long_labels(labels: DataFrame, tax: Taxonomy, keys: tuple[str, ...]) -> DataFrame:
    """One row per (keys, field) with ``kind`` and ``values`` as a set."""
    entries = [
        F.struct(
            F.lit(f).alias("field"),
            F.lit(k).alias("kind"),
            (F.array(F.col(f)) if k == "single" else F.array_distinct(F.col(f))).alias("values"),
        )
        for f, k in tax.fields
    ]
    return labels.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


def shown(kind: Column, values: Column) -> Column:
    return F.when(kind == "single", F.element_at(values, 1)).otherwise(
        F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))
    )


def compare(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Inner join of long labels: a missing prediction stays missing and never borrows another model's.

    ``gold``: item_id, field, kind, values. ``predicted``: model, item_id, field, values.
    Both sides have several rows per item, so the planner's guess of their size from the files is too low for a broadcast: they are sorted.
    """
    g = gold.select("item_id", "field", "kind", F.col("values").alias("g"))
    p = predicted.select("model", "item_id", "field", F.col("values").alias("p"))
    both = g.join(p.hint("merge"), ["item_id", "field"])
    single = F.col("kind") == "single"
    inter, union = F.size(F.array_intersect("p", "g")), F.size(F.array_union("p", "g"))
    score = (
        F.when(union == 0, F.lit(1.0))
        .when(single, F.when(inter > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(inter / union)
    )
    n_p, n_g = F.size("p"), F.size("g")
    precision = F.when(n_p > 0, inter / n_p).when(n_g == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    recall = F.when(n_g > 0, inter / n_g).otherwise(F.lit(1.0))
    return both.select(
        "model", "item_id", "field", "kind",
        score.alias("score"),
        F.when(~single, precision).alias("precision"),
        F.when(~single, recall).alias("recall"),
        F.array_except("p", "g").alias("spurious"),
        F.array_except("g", "p").alias("missed"),
        (single & F.array_contains("g", "unknown")).alias("gold_unknown"),
        (single & F.array_contains("p", "unknown")).alias("predicted_unknown"),
        shown(F.col("kind"), F.col("g")).alias("gold_value"),
        shown(F.col("kind"), F.col("p")).alias("predicted_value"),
        inter.alias("n_both"), n_p.alias("n_predicted"), n_g.alias("n_gold"),
    )


def per_item(compared: DataFrame) -> DataFrame:
    return compared.groupBy("model", "item_id").agg(
        F.avg("score").alias("macro_score"),
        F.sum(F.size("spurious")).alias("spurious"),
        F.sum(F.size("missed")).alias("missed"),
    )


def attempts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """How many items each model was asked about: every gold item."""
    n = gold.agg(F.countDistinct("item_id").alias("attempted")).withColumn("_k", F.lit(1))
    return predicted.select("model", F.lit(1).alias("_k")).distinct().join(F.broadcast(n), "_k").drop("_k")


def _rate(total: Column, n: Column, empty: float) -> Column:
    return F.when(n > 0, total / n).otherwise(F.lit(empty))


def field_report(compared: DataFrame, attempted: DataFrame) -> DataFrame:
    known = ~F.col("gold_unknown")
    multi = F.col("kind") == "multi"
    sums = compared.groupBy("model", "field", "kind").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("score").alias("_score"),
        F.avg(F.when(known, F.col("score"))).alias("informative_score"),
        F.count_if(known).alias("informative_items"),
        F.count_if("gold_unknown").alias("gold_unknown"),
        F.count_if("predicted_unknown").alias("predicted_unknown"),
        F.sum("n_both").alias("_both"), F.sum("n_predicted").alias("_p"), F.sum("n_gold").alias("_g"),
        F.sum(F.size("spurious")).alias("spurious"),
        F.sum(F.size("missed")).alias("missed"),
    )
    return sums.join(attempted, "model").select(
        "model", "field", "kind", "items",
        (F.col("_score") / F.col("items")).alias("strict_score"),
        _rate(F.col("_score"), F.col("attempted"), 0.0).alias("end_to_end_score"),
        "informative_score", "informative_items", "gold_unknown", "predicted_unknown",
        F.when(multi, _rate(F.col("_both"), F.col("_p"), 1.0)).alias("precision"),
        F.when(multi, _rate(F.col("_both"), F.col("_g"), 1.0)).alias("recall"),
        "spurious", "missed",
    )


def summary(compared: DataFrame, attempted: DataFrame) -> DataFrame:
    items = per_item(compared).groupBy("model").agg(
        F.count(F.lit(1)).alias("items"), F.sum("macro_score").alias("_m"), F.sum("spurious").alias("spurious"), F.sum("missed").alias("missed")
    )
    fields = field_report(compared, attempted)

    def mean(kind: str, col: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col(col))), F.lit(0.0))

    macros = fields.groupBy("model").agg(
        mean("single", "strict_score").alias("single_macro"),
        mean("multi", "strict_score").alias("multi_macro"),
        mean("single", "end_to_end_score").alias("end_to_end_single_macro"),
        mean("multi", "end_to_end_score").alias("end_to_end_multi_macro"),
    )
    return (
        items.join(attempted, "model")
        .join(macros, "model")
        .select(
            "model", "items", "attempted",
            _rate(F.col("items"), F.col("attempted"), 0.0).alias("coverage"),
            _rate(F.col("_m"), F.col("items"), 0.0).alias("macro_score"),
            _rate(F.col("_m"), F.col("attempted"), 0.0).alias("end_to_end_macro"),
            "single_macro", "multi_macro", "end_to_end_single_macro", "end_to_end_multi_macro", "spurious", "missed",
        )
    )


def in_splits(rows: DataFrame, split: Column) -> DataFrame:
    """Every row once under its split and once under 'all', in a column ``split``."""
    return rows.withColumn("split", F.explode(F.array(split, F.lit("all"))))


def split_reports(compared: DataFrame, gold: DataFrame, predicted: DataFrame, split: Column) -> tuple[DataFrame, DataFrame]:
    """(summary, field report) for each split of the gold items apart and for all of them; ``split`` is an expression on item_id.

    Coverage and end-to-end scores of a split refer to the gold items of that split.
    """
    asked = in_splits(gold, split).groupBy("split").agg(F.countDistinct("item_id").alias("attempted"))
    keys = in_splits(predicted.select("model", "item_id"), split).select("model", "split").distinct()
    attempted = keys.join(F.broadcast(asked), "split").select(F.concat_ws("/", "model", "split").alias("model"), "attempted")
    keyed = in_splits(compared, split).withColumn("model", F.concat_ws("/", "model", "split")).drop("split")

    def apart(report: DataFrame) -> DataFrame:
        return report.select(F.substring_index("model", "/", -1).alias("split"), F.regexp_replace("model", "/[^/]*$", "").alias("model"), *[c for c in report.columns if c != "model"])

    return apart(summary(keyed, attempted)), apart(field_report(keyed, attempted))


def error_patterns(compared: DataFrame, limit: int = 5, n_examples: int = 3) -> DataFrame:
    """Most frequent confusions with the first few item ids.

    Counts come from a combining aggregate; examples from a rank limit that Spark applies before the shuffle.
    """
    key = ["model", "field", "gold_value", "predicted_value"]
    wrong = compared.where(F.col("score") < 1).select(*key, "item_id")
    counts = wrong.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("model").orderBy(F.desc("n"), "field", "gold_value", "predicted_value")
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    e = Window.partitionBy(*key).orderBy("item_id")
    examples = (
        wrong.withColumn("_r", F.row_number().over(e))
        .where(F.col("_r") <= n_examples)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list("item_id")).alias("examples"))
    )
    return top.join(examples, key)


def worst_fields(compared: DataFrame, fields: tuple[str, ...] | list[str], n: int = 3) -> DataFrame:
    """Per item the first ``n`` imperfect fields in vocabulary order (``fields``): what a reviewer reads first."""
    place = F.coalesce(*[F.when(F.col("field") == name, F.lit(k)) for k, name in enumerate(fields)], F.lit(len(fields)))
    w = Window.partitionBy("model", "item_id").orderBy(place, "field")
    return compared.where(F.col("score") < 1).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(
        "model", "item_id", "rank", "field", "score"
    )


def extreme_fields(report: DataFrame, n: int = 5) -> DataFrame:
    """Weakest single fields and strongest fields per model."""
    weak = Window.partitionBy("model").orderBy(F.round("strict_score", 12), "field")
    strong = Window.partitionBy("model").orderBy(F.desc(F.round("strict_score", 12)), "field")
    a = report.where(F.col("kind") == "single").withColumn("rank", F.row_number().over(weak)).withColumn("side", F.lit("weakest"))
    b = report.withColumn("rank", F.row_number().over(strong)).withColumn("side", F.lit("strongest"))
    return a.unionByName(b).where(F.col("rank") <= n).select("model", "side", "rank", "field", "strict_score")


def side_by_side(summaries: DataFrame, models: list[str]) -> DataFrame:
    """One row per metric, one column per model. Valid-only metrics are comparable only at equal coverage."""
    metrics = [
        "coverage", "macro_score", "single_macro", "multi_macro", "end_to_end_macro", "end_to_end_single_macro", "end_to_end_multi_macro",
    ]
    long = summaries.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("e")).select("model", "e.*")
    wide = long.groupBy("metric").pivot("model", models).agg(F.first("v"))
    cov = summaries.agg((F.max("coverage") - F.min("coverage") < 1e-12).alias("same_coverage")).withColumn("_k", F.lit(1))
    penalised = F.col("metric").startswith("end_to_end") | (F.col("metric") == "coverage")
    return wide.withColumn("_k", F.lit(1)).join(F.broadcast(cov), "_k").withColumn(
        "comparable", penalised | F.col("same_coverage")
    ).drop("_k", "same_coverage")


def ranking_quality(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """NDCG, recall and hit rate at K per user. ``ranked``: user_id, item_id, rank; ``relevant``: user_id, item_id."""
    hits = ranked.where(F.col("rank") <= k).join(relevant.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
    dcg = hits.groupBy("user_id").agg(F.sum(1 / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg"), F.count(F.lit(1)).alias("n_hits"))
    want = relevant.select("user_id", "item_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    ideal = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.least(F.col("n_relevant"), F.lit(k).cast("bigint"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1.0))
    )
    return want.join(dcg, "user_id", "left").select(
        "user_id",
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        (F.coalesce("n_hits", F.lit(0)) / F.col("n_relevant")).alias("recall"),
        F.when(F.col("n_hits") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("hit"),
    )


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve of (label, score): pairs ordered right, ties half. Scores are grouped, then sorted once."""
    from feedloom.session import materialise

    by_score = scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    placed = materialise(by_score.orderBy("score").withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.sum("neg").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = placed.withColumn("_b", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(F.broadcast(offsets), "_part")
    return below.agg(
        (F.sum(F.col("pos") * (F.col("_b") + F.col("_off") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc")
    )
