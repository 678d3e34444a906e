"""Queries: catalogue, profiles, candidates, ranking, recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.config import Settings
from feedloom.functions import hashing as X
from feedloom.functions import signals as G
from feedloom.functions import vectors as V
from feedloom.operators import candidates as C
from feedloom.operators import catalogue as K
from feedloom.operators import encoding as E
from feedloom.operators import history as H
from feedloom.operators import pairwise as W
from feedloom.operators import profiles as P
from feedloom.operators import ranking as R
from feedloom.operators import user_slices
from feedloom.plans import oracles as O
from feedloom.plans.recommend import Inputs, diagnostics, recommend
from feedloom.plans.registry import query
from feedloom.session import materialise, materialise_all
from feedloom.sources import tables as T
from feedloom.taxonomy import NOT_A_PREFERENCE

S = Settings()
DENSE = [f"d:{i}" for i in range(64)]


def tag_inputs(spark, d, s: Settings = S) -> Inputs:
    """Everything in the vocabulary's own space. Vectors are a stored table, as they are in production."""
    tax = T.vocabulary()
    items, features = T.catalogue(spark, d)
    vectors = materialise(E.encode_features(features, tax))
    return Inputs(T.events(spark, d), items, features, vectors, tax, tax.slot_names, s)


def dense_inputs(spark, d, s: Settings = S) -> Inputs:
    items, features = T.catalogue(spark, d)
    return Inputs(T.events(spark, d), items, features, T.dense_vectors(spark, d), T.vocabulary(), DENSE, s)


def _base(i: Inputs):
    """Shared by the single-source queries: profiles and eligible items written once, sizes counted once."""
    i.pairs, items = materialise_all(i.pairs, i.ranking_items)
    profiles = materialise(i.profiles)
    return C.user_base(profiles, i.seen), profiles, items, W.Sizes.of(profiles, items)


@query("SELECT item_id, creator_id, epoch_us(created_at) AS created_at FROM elig")
def eligible_items(spark, d):
    return tag_inputs(spark, d).eligible.select("item_id", "creator_id", "created_at")


@query(
    f"SELECT event_id, user_id, {O.WEIGHT} AS weight, {O.AGE_DAYS} AS age, {O.SIGNAL} AS sig FROM ev",
    keys="event_id, user_id", nums="weight, age, sig",
)
def event_signals(spark, d):
    e = T.events(spark, d)
    now = G.now_col(S)
    return e.select(
        "event_id", "user_id", G.event_weight(F.col("type")).alias("weight"), G.age_days(F.col("created_at"), now).alias("age"),
        G.signal(F.col("type"), F.col("created_at"), now, S.halflife_days).alias("sig"),
    )


@query(
    f"SELECT type, count(*) AS n, {O.WEIGHT} <> 0 AS meaningful FROM ev WHERE created_at >= {O.NOW} - INTERVAL 72 HOUR GROUP BY type",
    keys="type, meaningful", ints="n",
)
def events_in_window(spark, d):
    return H.in_window(T.events(spark, d), S).groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("meaningful", G.is_meaningful(F.col("type")))


@query("SELECT item_id, field, value FROM tags")
def item_tags(spark, d):
    return E.item_tags(T.item_features(spark, d), T.vocabulary())


@query("SELECT item_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM divtags GROUP BY 1")
def diversity_tags(spark, d):
    tagged = E.tag_columns(T.item_features(spark, d), T.vocabulary())
    return tagged.where(F.size("div_tags") > 0).select("item_id", F.array_sort("div_tags").alias("tags"))


@query("SELECT item_id, slot, w FROM enc WHERE w <> 0", keys="item_id", ints="slot", nums="w")
def encoded_vectors(spark, d):
    v = materialise(E.encode_features(T.item_features(spark, d), T.vocabulary()))
    return v.select("item_id", F.posexplode("vector").alias("slot", "w")).where(F.col("w") != 0)


@query("SELECT item_id, slot, w FROM enc WHERE w <> 0 AND item_id % 23 <> 0", keys="item_id", ints="slot", nums="w")
def reencoded_vectors(spark, d):
    v = materialise(E.reencode(T.item_features(spark, d), T.vocabulary()))
    return v.select("item_id", F.posexplode("vector").alias("slot", "w")).where(F.col("w") != 0)


@query(
    """SELECT CASE WHEN taxonomy_version < 1 THEN 'ingested' ELSE status END AS status, count(*) AS n,
       count(*) FILTER (taxonomy_version >= 1) AS n_features FROM items GROUP BY 1""",
    keys="status", ints="n, n_features",
)
def retired_version(spark, d):
    i = tag_inputs(spark, d)
    out = E.retire_version(i.items, i.features, i.vectors, i.profiles, i.tax.version)
    kept = out["features"].select("item_id", F.lit(1).alias("has"))
    return out["items"].join(kept, "item_id", "left").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("n_features"))


# --- profiles ---


@query(
    "SELECT user_id, unnest(range(0, 64)) AS slot, unnest(v) AS weight FROM prof_d", keys="user_id", ints="slot", nums="weight"
)
def profile_vectors(spark, d):
    return dense_inputs(spark, d).profiles.select("user_id", F.posexplode("vector").alias("slot", "weight"))


@query(
    "SELECT * FROM prof", keys="user_id, is_cold_start", ints="interaction_count, effective, skipped_no_features",
    nums="positive_signal, negative_signal",
)
def profile_counters(spark, d):
    return tag_inputs(spark, d).profiles.select(
        "user_id", "is_cold_start", "interaction_count", "effective", "skipped_no_features", "positive_signal", "negative_signal"
    )


@query(
    "SELECT p.user_id, x.field || ':' || x.value AS tag, p.v[x.slot + 1] AS weight FROM prof p CROSS JOIN tax x WHERE p.v[x.slot + 1] > 0.01",
    keys="user_id, tag", nums="weight",
)
def profile_tag_affinity(spark, d):
    return tag_inputs(spark, d).profiles.select("user_id", F.explode("tag_affinity").alias("tag", "weight"))


@query(
    """SELECT a.user_id, a.creator_id, h.handle AS creator_handle, a.score, a.n AS interaction_count FROM affinity a
       LEFT JOIN (SELECT creator_id, min(creator_handle) AS handle FROM items GROUP BY 1) h USING (creator_id)""",
    keys="user_id, creator_id, creator_handle", ints="interaction_count", nums="score",
)
def creator_affinity(spark, d):
    i = tag_inputs(spark, d)
    return P.affinity_with_handles(i.creator_affinity, K.handles_by_creator(i.items))


@query("SELECT user_id, tag_rank, slot, tag, w AS weight FROM pref", keys="user_id, tag", ints="tag_rank, slot", nums="weight")
def preferred_tags(spark, d):
    i = tag_inputs(spark, d)
    return P.preferred_tags(i.profiles, i.slot_names, NOT_A_PREFERENCE, S.preferred_tags)


@query(
    """SELECT user_id, direction, rank, dimension, contribution FROM (
        SELECT p.user_id, CASE WHEN p.v[x.slot + 1] > 0 THEN 'positive' ELSE 'negative' END AS direction, x.field || ':' || x.value AS dimension,
            p.v[x.slot + 1] AS contribution,
            row_number() OVER (PARTITION BY p.user_id, p.v[x.slot + 1] > 0 ORDER BY round(abs(p.v[x.slot + 1]), 12) DESC, x.slot) AS rank
        FROM prof p CROSS JOIN tax x WHERE p.v[x.slot + 1] <> 0) WHERE rank <= 5""",
    keys="user_id, direction, dimension", ints="rank", nums="contribution",
)
def profile_explanations(spark, d):
    i = tag_inputs(spark, d)
    return P.explain_profiles(i.profiles, i.slot_names, 5)


@query(
    """SELECT user_id, is_cold_start, interaction_count, round(positive_signal, 4) AS positive_signal,
        (SELECT string_agg(c, ',' ORDER BY round(sc, 12) DESC, c) FROM (SELECT a.creator_id AS c, a.score AS sc FROM affinity a WHERE a.user_id = p.user_id
         ORDER BY round(a.score, 12) DESC, a.creator_id LIMIT 5)) AS creators FROM prof p""",
    keys="user_id, is_cold_start, creators", ints="interaction_count", nums="positive_signal",
)
def profile_read(spark, d):
    i = tag_inputs(spark, d)
    out = P.read_profiles(materialise(i.profiles), i.creator_affinity, i.slot_names)
    creators = F.when(F.col("creator_affinity").isNotNull(), F.array_join("creator_affinity.creator_id", ","))
    return out.select("user_id", "is_cold_start", creators.alias("creators"), "interaction_count", "positive_signal")


@query(
    """SELECT user_id, item_id, dimension, contribution, rank FROM (
        SELECT r.user_id, r.item_id, x.field || ':' || x.value AS dimension, p.v[x.slot + 1] * e.v[x.slot + 1] AS contribution,
            row_number() OVER (PARTITION BY r.user_id, r.item_id ORDER BY p.v[x.slot + 1] * e.v[x.slot + 1] DESC, x.slot) AS rank
        FROM recent r JOIN prof p USING (user_id) JOIN elig e USING (item_id) CROSS JOIN tax x WHERE p.v[x.slot + 1] * e.v[x.slot + 1] > 0)
       WHERE rank <= 3""",
    keys="user_id, item_id, dimension", ints="rank", nums="contribution",
)
def similarity_terms(spark, d):
    i = tag_inputs(spark, d)
    profiles = i.profiles.select("user_id", F.col("vector").alias("p"))
    rows = i.recent.join(profiles, "user_id").join(i.eligible.select("item_id", "vector"), "item_id")
    terms = V.top_contributions(F.col("p"), F.col("vector"), i.slot_names, 3)
    return rows.select("user_id", "item_id", F.posexplode(terms).alias("pos", "t")).select(
        "user_id", "item_id", F.col("t.dimension").alias("dimension"), (F.col("pos") + 1).alias("rank"), F.col("t.contribution").alias("contribution")
    )


# --- history ---


@query(
    "SELECT user_id, item_id, bool_or(type = 'like') AS liked, epoch_us(max(created_at)) AS last_seen_at FROM ev GROUP BY 1, 2"
)
def seen_rollup(spark, d):
    return H.seen_rollup(T.events(spark, d))


@query(
    """SELECT item_id, count(*) FILTER (type = 'impression') AS impressions, count(*) FILTER (type = 'view') AS views,
        count(*) FILTER (type = 'like') AS likes, count(*) FILTER (type = 'skip') AS skips, count(*) FILTER (type = 'complete') AS completions,
        sum(CASE WHEN type IN ('view', 'complete') THEN floor(value * 100) ELSE 0 END) AS watch_ms_sum FROM ev GROUP BY 1""",
    keys="item_id", ints="impressions, views, likes, skips, completions, watch_ms_sum",
)
def item_counters(spark, d):
    return H.item_counters(T.events(spark, d).withColumn("watch_ms", F.floor(F.col("value") * 100)))


@query("SELECT item_id, engagement, popularity FROM pop", keys="item_id", nums="engagement, popularity")
def popularity(spark, d):
    return H.popularity(H.engagement(T.events(spark, d), S))


@query("SELECT user_id, item_id, position FROM recent", keys="user_id, item_id", ints="position")
def recent_items(spark, d):
    return tag_inputs(spark, d).recent


# --- sources ---


@query(
    "SELECT user_id, item_id, rank, sim FROM near10", {"near10": O._similar("prof_d", "elig_d", 10)}, keys="user_id, item_id", ints="rank", nums="sim"
)
def nearest_unseen(spark, d):
    """The flagship: profiles from the log, then each warm user's ten nearest unseen items."""
    i = dense_inputs(spark, d, S.but(source_limits={**S.source_limits, "similar": 10}))
    i.vectors = i.vectors.withColumn("taxonomy_version", F.lit(i.tax.version))
    base, _, items, size = _base(i)
    return C.similar_source(base, items, i.seen, size, i.s).select("user_id", "item_id", "rank", F.col("score").alias("sim"))


@query("SELECT user_id, item_id, rank, sim AS score FROM src_similar", keys="user_id, item_id", ints="rank", nums="score")
def similar_source(spark, d):
    i = tag_inputs(spark, d)
    base, _, items, size = _base(i)
    return C.similar_source(base, items, i.seen, size, S).select("user_id", "item_id", "rank", "score")


@query("SELECT user_id, item_id, rank, h AS score FROM src_explore", keys="user_id, item_id", ints="rank", nums="score")
def explore_source(spark, d):
    i = tag_inputs(spark, d)
    base, _, items, size = _base(i)
    return C.explore_source(base, items, i.seen, size, S).select("user_id", "item_id", "rank", "score")


#: Sizes so small that the test tables go through the plans of large catalogues: pivots, probed cells, hash thresholds, list tails.
SMALL_BLOCKS = S.but(block_items=64, block_users=40, list_chunk=8, list_head=32)


@query(
    "SELECT user_id, item_id, rank, sim FROM near10", {"near10": O._similar("prof_d", "elig_d", 10)}, keys="user_id, item_id", ints="rank", nums="sim"
)
def nearest_unseen_blocked(spark, d):
    i = dense_inputs(spark, d, SMALL_BLOCKS.but(source_limits={**S.source_limits, "similar": 10}))
    i.vectors = i.vectors.withColumn("taxonomy_version", F.lit(i.tax.version))
    base, _, items, size = _base(i)
    return C.similar_source(base, items, i.seen, size, i.s).select("user_id", "item_id", "rank", F.col("score").alias("sim"))


@query("SELECT user_id, item_id, rank, h AS score FROM src_explore", keys="user_id, item_id", ints="rank", nums="score")
def explore_source_blocked(spark, d):
    i = tag_inputs(spark, d)
    base, _, items, size = _base(i)
    return C.explore_source(base, items, i.seen, size, SMALL_BLOCKS).select("user_id", "item_id", "rank", "score")


@query(
    "SELECT 'tag' AS source, user_id, item_id, rank FROM src_tag UNION ALL SELECT 'trending', user_id, item_id, rank FROM src_trending UNION ALL SELECT 'fresh', user_id, item_id, rank FROM src_fresh",
    keys="source, user_id, item_id", ints="rank",
)
def list_sources_tail(spark, d):
    """The three list sources with heads of 32 rows, so that most rows come from list tails."""
    i = tag_inputs(spark, d)
    base, _, items, size = _base(i)
    return C.list_sources(base, items, i.seen, i.tax, size, SMALL_BLOCKS).select("source", "user_id", "item_id", "rank")


def _listed(spark, d, which: str) -> DataFrame:
    i = tag_inputs(spark, d)
    base, _, items, size = _base(i)
    return C.list_sources(base, items, i.seen, i.tax, size, S, (which,)).select("user_id", "item_id", "rank")


@query("SELECT user_id, item_id, rank FROM src_tag", keys="user_id, item_id", ints="rank")
def tag_source(spark, d):
    return _listed(spark, d, "tag")


@query("SELECT user_id, item_id, rank FROM src_trending", keys="user_id, item_id", ints="rank")
def trending_source(spark, d):
    return _listed(spark, d, "trending")


@query("SELECT user_id, item_id, rank FROM src_fresh", keys="user_id, item_id", ints="rank")
def fresh_source(spark, d):
    return _listed(spark, d, "fresh")


@query(
    f"SELECT user_id, item_id, {O.fnv(chr(39).join(['user_id || ', '|', ' || item_id || ', '|' + O.DAY, '']))} AS h FROM seen",
    keys="user_id, item_id", nums="h",
)
def exploration_hash(spark, d):
    return H.seen_pairs(T.events(spark, d)).select("user_id", "item_id", X.exploration_hash(F.col("user_id"), F.col("item_id"), S.now[:10]).alias("h"))


def _candidates(i: Inputs):
    base, _, items, size = _base(i)
    return base, items, _drawn(i, base, items, size)


def _drawn(i: Inputs, base: DataFrame, items: DataFrame, size: W.Sizes) -> DataFrame:
    listed, similar, explore = materialise_all(*C.generate(base, items, i.seen, i.tax, size, i.s).values())
    return listed.unionByName(similar).unionByName(explore)


@query("SELECT user_id, item_id, sources FROM cand")
def candidates(spark, d):
    return C.union_sources(_candidates(tag_inputs(spark, d))[2])


def _counts_sql(limit: int) -> str:
    return f"""SELECT p.user_id, coalesce(n_similar, 0) AS n_similar, coalesce(n_tag, 0) AS n_tag, coalesce(n_trending, 0) AS n_trending, coalesce(n_fresh, 0) AS n_fresh,
        coalesce(n_explore, 0) AS n_explore, coalesce(unique_candidates, 0) AS unique_candidates, (SELECT count(*) FROM elig) AS eligible_items,
        (SELECT count(*) FROM seen s WHERE s.user_id = p.user_id) AS seen_count,
        (SELECT count(*) FROM elig) - (SELECT count(*) FROM seen s JOIN elig e USING (item_id) WHERE s.user_id = p.user_id) < {limit} AS candidate_shortage
       FROM prof p LEFT JOIN (SELECT user_id, count(*) FILTER (source = 'similar') AS n_similar, count(*) FILTER (source = 'tag') AS n_tag,
        count(*) FILTER (source = 'trending') AS n_trending, count(*) FILTER (source = 'fresh') AS n_fresh, count(*) FILTER (source = 'explore') AS n_explore,
        count(DISTINCT item_id) AS unique_candidates FROM cand0 GROUP BY 1) c USING (user_id)"""


_COUNTS = "n_similar, n_tag, n_trending, n_fresh, n_explore, unique_candidates, eligible_items, seen_count"


@query(_counts_sql(420), keys="user_id, candidate_shortage", ints=_COUNTS)
def candidate_counts(spark, d):
    i = tag_inputs(spark, d)
    base, items, per_source = _candidates(i)
    return C.candidate_counts(base, C.source_bits(per_source), items, i.seen, 420)


# --- ranking ---

_SCORE_KEYS = "user_id, item_id, sources, quality_available"
_SCORE_NUMS = "content_similarity, tag_affinity, affinity, creator_affinity, popularity, freshness, fatigue, exploration, quality, base_score"


def _score(i: Inputs) -> DataFrame:
    return recommend(i, i.s.feed_size).scored


@query(
    "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY base_score DESC, item_id) AS base_rank FROM scored",
    keys=_SCORE_KEYS, ints="base_rank", nums=_SCORE_NUMS,
)
def ranked_candidates(spark, d):
    ranked = R.rank_candidates(_score(tag_inputs(spark, d)))
    return ranked.select(*_SCORE_KEYS.split(", "), "base_rank", *_SCORE_NUMS.split(", "))


@query(
    "SELECT * FROM scored",
    {
        "prof": O._profile("hist", O.TAX.dim).replace(f"c.effective < {S.cold_start_min} AS", "c.effective < 50 AS"),
    },
    keys=_SCORE_KEYS, nums=_SCORE_NUMS,
)
def ranked_with_cold_users(spark, d):
    """A higher cold-start bar, so that many users are ranked on the global terms only."""
    scored = _score(tag_inputs(spark, d, S.but(cold_start_min=50)))
    return scored.select(*_SCORE_KEYS.split(", "), *_SCORE_NUMS.split(", "))


@query(
    """SELECT user_id, item_id, string_agg(term, ',' ORDER BY v DESC, term) AS reasons FROM (
        SELECT user_id, item_id, term, v, row_number() OVER (PARTITION BY user_id, item_id ORDER BY v DESC, term) AS r FROM (
          SELECT user_id, item_id, unnest(['affinity', 'quality', 'freshness', 'popularity', 'exploration', 'creator_affinity']) AS term,
            unnest([affinity, 0.15 * quality, 0.2 * freshness, 0.25 * popularity, 0.1 * exploration, 0.2 * creator_affinity]) AS v FROM scored) WHERE v > 0.001)
       WHERE r <= 3 GROUP BY 1, 2"""
)
def top_reasons(spark, d):
    scored = _score(tag_inputs(spark, d))
    reasons = R.top_reasons(F.col("weighted"), 1, 3)
    return scored.select("user_id", "item_id", F.transform(reasons, lambda x: x["term"]).alias("reasons")).where(F.size("reasons") > 0)


def _with_newcomers(spark, d):
    """All customers and all users of the log: most of them have no event at all."""
    i = tag_inputs(spark, d)
    customers = T.users(spark, d).select("user_id")
    i.users = materialise(customers.union(i.events.select("user_id")).distinct())
    return i


_NEWCOMERS = {
    "known": O._profile("hist", O.TAX.dim),
    "prof": f"""SELECT * FROM known UNION ALL BY NAME SELECT c_custkey AS user_id, 0 AS interaction_count, 0 AS effective, 0 AS skipped_no_features,
        0.0::DOUBLE AS positive_signal, 0.0::DOUBLE AS negative_signal, true AS is_cold_start, list_transform(range({O.TAX.dim}), lambda x: 0.0::DOUBLE) AS v
        FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM known)""",
}


@query("SELECT user_id, item_id, sources FROM cand", _NEWCOMERS)
def cold_start_candidates(spark, d):
    i = _with_newcomers(spark, d)
    i.pairs, items = materialise_all(i.pairs, i.ranking_items)
    i, newcomers, n = i.without_newcomers()
    profiles = materialise(i.profiles)
    size = W.Sizes.of(profiles, items)
    known = C.union_sources(_drawn(i, C.user_base(profiles, i.seen), items, size))
    return known if newcomers is None else known.unionByName(R.score_newcomers(newcomers, items, S, W.Sizes(n, size.items)).select(*known.columns))


@query("SELECT * FROM scored", _NEWCOMERS, keys=_SCORE_KEYS, nums=_SCORE_NUMS)
def cold_start_ranked(spark, d):
    scored = _score(_with_newcomers(spark, d))
    return scored.select(*_SCORE_KEYS.split(", "), *_SCORE_NUMS.split(", "))


@query("SELECT * FROM reranked", keys="user_id, item_id, creator_id, relaxed", ints="rank", nums="base_score, diversity_penalty, final_score")
def recommended(spark, d):
    """End to end: the diversified list of every user."""
    return recommend(tag_inputs(spark, d), S.feed_size).selected


@query()
def recommended_dense(spark, d):
    i = dense_inputs(spark, d)
    base, _, items, size = _base(i)
    near = C.similar_source(base, items, i.seen, size, S)
    scored = near.select("user_id", "item_id", F.round("score", R.SCORE_DIGITS).alias("base_score"))
    return user_slices.reranked(scored, items, size.users, size.items, S.source_limits["similar"], 20, S)


@query(
    f"""SELECT c.*, p.is_cold_start AS cold_start, coalesce(returned, 0) AS returned, coalesce(relaxed_count, 0) AS relaxed_count, coalesce(diversity_relaxed, false) AS diversity_relaxed,
        {S.feed_size} AS requested_limit FROM ({_counts_sql(S.feed_size)}) c JOIN prof p USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS returned,
        count(*) FILTER (relaxed) AS relaxed_count, bool_or(relaxed) AS diversity_relaxed FROM reranked GROUP BY 1) r USING (user_id)""",
    keys="user_id, candidate_shortage, cold_start, diversity_relaxed", ints=f"{_COUNTS}, returned, relaxed_count, requested_limit",
)
def recommendation_diagnostics(spark, d):
    i = tag_inputs(spark, d)
    run = recommend(i, S.feed_size)
    run.selected = materialise(run.selected)
    return diagnostics(run, S.feed_size)
