"""Queries: contracts, model answers, frames, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.config import Settings
from feedloom.functions import hashing as X
from feedloom.functions import media as M
from feedloom.operators import catalogue as K
from feedloom.operators import encoding as E
from feedloom.operators import evaluation as Q
from feedloom.operators import frames as R
from feedloom.operators import ingest as N
from feedloom.operators import validation as L
from feedloom.plans import oracles as O
from feedloom.plans.registry import query
from feedloom.sources import tables as T

S = Settings()

# --- contracts ---


@query(
    """SELECT event_id AS k, concat_ws(',', CASE WHEN event_id % 97 = 0 THEN 'event_id' END, CASE WHEN event_id % 89 = 0 THEN 'user_id' END,
        CASE WHEN type = 'impression' THEN 'type' END, CASE WHEN value / 100 > 1 THEN 'watch_ratio' END,
        CASE WHEN floor(value * 10) < 50 THEN 'watch_ms' END) AS reasons FROM ev"""
)
def interaction_check(spark, d):
    k = F.col("event_id")
    raw = T.events(spark, d).select(
        k.alias("k"),
        F.when(k % 97 == 0, "").otherwise(k.cast("string")).alias("event_id"),
        F.concat(F.when(k % 89 == 0, "u-").otherwise(""), F.col("user_id").cast("string")).alias("user_id"),
        F.col("item_id").cast("string").alias("item_id"),
        F.when(F.col("type") == "impression", "watch").otherwise(F.col("type")).alias("type"),
        (F.col("value") / 100).alias("watch_ratio"),
        (F.floor(F.col("value") * 10) - 50).alias("watch_ms"),
    )
    return L.check_interactions(raw).select("k", "reasons")


@query(
    """SELECT e.event_id, CASE WHEN s.s_suppkey IS NULL THEN 'unknown_user' WHEN i.item_id IS NULL THEN 'unknown_item' END AS reference_error
       FROM ev e LEFT JOIN supplier s ON s.s_suppkey = e.user_id LEFT JOIN (SELECT item_id FROM items WHERE status = 'analyzed') i ON i.item_id = e.item_id"""
)
def reference_check(spark, d):
    users = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"))
    items = T.items(spark, d).where(F.col("status") == "analyzed")
    return L.check_references(T.events(spark, d), users, items).select("event_id", "reference_error")


def _raw_features(spark, d):
    k = F.col("p_partkey")
    extra = T.table(spark, d, "part").select(
        k.alias("item_id"),
        F.lower("p_type").alias("finish"),
        F.when(k % 29 != 0, F.when(F.col("p_retailprice") >= 950, "high").otherwise("low")).alias("grade"),
        ((F.col("p_retailprice") - 900) / 90).alias("aesthetic"),
        F.when(k % 31 == 0, "").otherwise(F.col("p_name")).alias("caption"),
        F.create_map(F.lit("finish"), F.when(k % 37 == 0, 1.5).otherwise(0.9)).alias("confidence"),
    )
    return T.item_features(spark, d).select("item_id", "size_band", "trait", "object").join(extra, "item_id")


@query(
    """SELECT p_partkey AS item_id, 'finish' AS field, 'not_in_vocabulary' AS issue FROM part WHERE p_type = 'STANDARD'
       UNION ALL SELECT p_partkey, 'grade', 'required' FROM part WHERE p_partkey % 29 = 0
       UNION ALL SELECT p_partkey, 'aesthetic', 'out_of_range' FROM part WHERE (p_retailprice - 900) / 90 > 1
       UNION ALL SELECT p_partkey, 'caption', 'bad_length' FROM part WHERE p_partkey % 31 = 0
       UNION ALL SELECT p_partkey, 'confidence', 'out_of_range' FROM part WHERE p_partkey % 37 = 0"""
)
def feature_issues(spark, d):
    return L.feature_issues(_raw_features(spark, d), T.vocabulary()).select("item_id", "field", "issue")


@query(
    "SELECT i.item_id, i.external_id, i.status, i.item_id % 2 = 0 AS has_features FROM items i WHERE status <> 'analyzed'"
)
def work_list(spark, d):
    features = T.item_features(spark, d).where(F.col("item_id") % 2 == 0)
    return K.work_list(T.items(spark, d), features)


@query("SELECT item_id, external_id FROM items ORDER BY external_id, item_id LIMIT 50")
def corpus_page(spark, d):
    return K.corpus_page(T.items(spark, d), 50)


_BODY = """'{"size_band":"small","finish":"' || CASE WHEN p_partkey % 5 = 4 THEN 'shiny' ELSE CASE p_type WHEN 'STANDARD' THEN 'other' ELSE lower(p_type) END END ||
 '","grade":"low","trait":["' || split_part(p_name, ' ', 1) || '"],"object":["' || split_part(p_name, ' ', 2) || '"],"aesthetic":0.5,"caption":"' || p_name || '","confidence":{}}'"""


def _answers(spark, d):
    k = F.col("p_partkey")
    words = F.split("p_name", " ")
    finish = F.when(k % 5 == 4, "shiny").when(F.col("p_type") == "STANDARD", "other").otherwise(F.lower("p_type"))
    body = F.concat(
        F.lit('{"size_band":"small","finish":"'), finish, F.lit('","grade":"low","trait":["'), F.get(words, F.lit(0)), F.lit('"],"object":["'),
        F.get(words, F.lit(1)), F.lit('"],"aesthetic":0.5,"caption":"'), F.col("p_name"), F.lit('","confidence":{}}'),
    )
    answer = (
        F.when(k % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k % 5 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" Anything else?")))
        .when(k % 5 == 3, F.substring(body, 1, 40))
        .otherwise(body)
    )
    return T.table(spark, d, "part").select(
        k.alias("item_id"), answer.alias("answer"), F.when(F.col("p_size") % 10 == 0, 0).otherwise(6).alias("frames_used")
    )


_ANSWERS = {
    "answers": f"""SELECT item_id, frames_used, CASE WHEN answer LIKE '```%' THEN trim(regexp_extract(answer, '```json\n(.*)\n```', 1, 's'))
        WHEN strpos(answer, '}}') > 0 THEN regexp_extract(answer, '(\\{{.*\\}})', 1, 's') ELSE answer END AS js FROM (
        SELECT p_partkey AS item_id, CASE WHEN p_size % 10 = 0 THEN 0 ELSE 6 END AS frames_used,
            CASE p_partkey % 5 WHEN 0 THEN '```json\n' || body || '\n```' WHEN 1 THEN 'Here it is: ' || body || ' Anything else?'
                WHEN 3 THEN substr(body, 1, 40) ELSE body END AS answer FROM (SELECT *, {_BODY} AS body FROM part))""",
    "triage": """SELECT item_id, CASE WHEN frames_used = 0 THEN 'no_frames' WHEN NOT json_valid(js) THEN 'invalid_json'
        WHEN CASE WHEN json_valid(js) THEN json_extract_string(js, '$.finish') END NOT IN (SELECT value FROM tax WHERE field = 'finish') THEN 'schema_validation' END AS kind FROM answers""",
}


@query("SELECT item_id, kind FROM triage WHERE kind IS NOT NULL", _ANSWERS)
def answer_repairs(spark, d):
    return L.ingest_answers(_answers(spark, d), T.vocabulary())[1].select("item_id", "kind")


@query(
    "SELECT item_id, json_extract_string(js, '$.finish') AS finish, json_extract_string(js, '$.trait[0]') AS trait FROM answers JOIN triage USING (item_id) WHERE kind IS NULL",
    _ANSWERS,
)
def answer_features(spark, d):
    return L.ingest_answers(_answers(spark, d), T.vocabulary())[0].select("item_id", "finish", "trait")


@query("SELECT kind AS failure, count(*) AS n FROM triage WHERE kind IS NOT NULL GROUP BY 1", _ANSWERS)
def failure_counts(spark, d):
    repairs = L.ingest_answers(_answers(spark, d), T.vocabulary())[1]
    reason = M.failure_reason(F.col("kind"), F.coalesce(F.array_join("messages", "; "), F.lit("no usable answer")))
    return repairs.groupBy(M.failure_kind(reason).alias("failure")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'finish' AS field, v AS value, 'no_slot' AS problem FROM (SELECT DISTINCT lower(p_type) AS v FROM part) WHERE v NOT IN (SELECT value FROM tax WHERE field = 'finish')
       UNION ALL SELECT 'finish', value, 'not_in_vocabulary' FROM tax WHERE field = 'finish' AND value NOT IN (SELECT lower(p_type) FROM part)"""
)
def vocabulary_mismatch(spark, d):
    """The raw part types as a vocabulary against the frozen layout."""
    layout = T.vocabulary().frame(spark).where(F.col("field") == "finish")
    vocabulary = T.table(spark, d, "part").select(F.lit("finish").alias("field"), F.lower("p_type").alias("value")).distinct()
    return L.vocabulary_mismatch(vocabulary, layout)


@query(
    """SELECT field, value, 'no_slot' AS problem FROM (SELECT DISTINCT field, value FROM raw) ANTI JOIN tax USING (field, value)
       UNION ALL SELECT field, value, 'not_in_vocabulary' FROM tax ANTI JOIN raw USING (field, value)""",
    {
        "raw": """SELECT field, value FROM tags WHERE field <> 'finish' UNION ALL SELECT 'finish', lower(p_type) FROM part"""
    },
)
def vocabulary_layout(spark, d):
    """The values that occur in all five fields, types as they come, against the frozen layout."""
    raw = T.item_features(spark, d).drop("finish").join(T.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.lower("p_type").alias("finish")), "item_id")
    values = Q.long_labels(raw, T.vocabulary(), ("item_id",)).select("field", F.explode("values").alias("value")).distinct()
    return L.vocabulary_mismatch(values, T.vocabulary().frame(spark))


@query("SELECT DISTINCT p_type AS field FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO', 'SMALL')")
def unclassified_fields(spark, d):
    vocabulary = T.table(spark, d, "part").select(F.col("p_type").alias("field"))
    return L.unclassified_fields(
        vocabulary, spark.createDataFrame([("ECONOMY",), ("PROMO",)], "field string"), spark.createDataFrame([("SMALL",)], "field string")
    )


@query("SELECT len(embedding)::BIGINT AS dimension, count(*) AS n, len(embedding) = 64 AS expected FROM embeddings GROUP BY 1, 3")
def dimension_report(spark, d):
    return L.dimension_report(L.require_dimension(T.dense_vectors(spark, d), 64), 64)


@query("SELECT taxonomy_version::BIGINT AS taxonomy_version, count(*) AS n FROM vecs WHERE taxonomy_version = 1 GROUP BY 1")
def one_version(spark, d):
    v = E.reencode(T.item_features(spark, d), T.vocabulary())
    return L.require_one_version(v, 1).groupBy("taxonomy_version").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT p_partkey AS item_id, 'small_but_high' AS rule FROM part WHERE p_size BETWEEN 6 AND 20 AND p_retailprice >= 950 AND p_partkey % 13 <> 0
       UNION ALL SELECT p_partkey, 'large_finish_small_trait' FROM part WHERE p_type = 'LARGE' AND split_part(p_name, ' ', 1) = 'small' AND p_partkey % 11 <> 0"""
)
def contradictions(spark, d):
    rules = [
        ("small_but_high", (F.col("size_band") == "small") & (F.col("grade") == "high")),
        ("large_finish_small_trait", (F.col("finish") == "large") & F.array_contains("trait", "small")),
    ]
    return L.contradictions(T.item_features(spark, d), rules)


# --- frames ---

_PLAN = {
    "plan": """SELECT item_id, duration_s, n, list_distinct(list_transform(range(0, n), lambda i:
            floor(greatest(least(duration_s * 0.05 + (duration_s * 0.95 - duration_s * 0.05) * (i + 0.5) / n, greatest(duration_s - 0.05, 0)), 0) * 1000 + 0.5) / 1000)) AS ts
        FROM (SELECT item_id, duration_s, greatest(1, least(CASE WHEN duration_s <= 30 THEN 6 WHEN duration_s <= 60 THEN 8 WHEN duration_s <= 120 THEN 12 ELSE 16 END,
            16, floor(duration_s)))::BIGINT AS n FROM parts)"""
}


@query("SELECT item_id, n AS n_frames, unnest(ts) AS ts FROM plan", _PLAN, keys="item_id", ints="n_frames", nums="ts")
def frame_plan(spark, d):
    return R.frame_plan(T.parts(spark, d), S).select("item_id", "n_frames", F.explode("timestamps").alias("ts"))


@query(
    """SELECT count(*) AS items, sum(duration_s) AS total_duration, sum(n) AS requested, sum(len(ts)) AS selected, min(len(ts)) AS min_frames,
        median(len(ts)) AS median_frames, max(len(ts)) AS max_frames FROM plan""",
    _PLAN, ints="items, requested, selected, min_frames, max_frames", nums="total_duration, median_frames",
)
def frame_totals(spark, d):
    return R.frame_totals(R.frame_plan(T.parts(spark, d), S))


def _cut_logs(spark, d):
    """One scene log per order: a line per order line, time = quantity."""
    line = F.concat(F.lit("[showinfo] n:"), F.col("l_linenumber").cast("string"), F.lit(" pts_time:"), F.col("l_quantity").cast("string"))
    lines = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))
    return lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("log"))


@query("SELECT l_orderkey AS item_id, l_quantity AS cut, count(*) AS n FROM lineitem GROUP BY 1, 2", keys="item_id", ints="n", nums="cut")
def scene_cuts(spark, d):
    cuts = _cut_logs(spark, d).select(F.col("l_orderkey").alias("item_id"), F.explode(R.parse_cuts(F.col("log"))).alias("cut"))
    return cuts.groupBy("item_id", "cut").agg(F.count(F.lit(1)).alias("n"))


_SNAP = {
    "clip": _PLAN["plan"].replace("FROM parts", "FROM (SELECT o_orderkey AS item_id, (o_orderkey % 60 + 1)::DOUBLE AS duration_s FROM orders)"),
    "spots": f"SELECT l_orderkey AS item_id, list(round(l_quantity::DOUBLE + {S.scene_offset}, 3)) AS cs FROM lineitem GROUP BY 1",
}


@query(
    f"""SELECT item_id, unnest(CASE WHEN cs IS NULL THEN ts ELSE list_distinct(list_reduce(list_transform(list_sort(ts), lambda t: [t]),
        lambda used, t: list_concat(used, [coalesce(list_sort(list_transform(list_filter(cs, lambda c: abs(c - t[1]) <= {S.scene_snap_window} AND len(list_filter(used, lambda u: u = c)) = 0),
            lambda c: {{'d': abs(c - t[1]), 'c': c}}))[1].c, t[1])]), []::DOUBLE[])) END) AS ts FROM clip LEFT JOIN spots USING (item_id)""",
    _SNAP, keys="item_id", nums="ts",
)
def scene_snapped_frames(spark, d):
    """Frame plan of each order moved to its cuts; without cuts the plan stays."""
    durations = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_orderkey") % 60 + 1.0).alias("duration_s"))
    plan = R.frame_plan(durations, S)
    cuts = _cut_logs(spark, d).select(F.col("l_orderkey").alias("item_id"), R.parse_cuts(F.col("log")).alias("cuts"))
    known = F.coalesce("cuts", F.array().cast("array<double>"))
    return plan.join(cuts, "item_id", "left").select("item_id", F.explode(R.snap_to_scenes(F.col("timestamps"), known, S)).alias("ts"))


def _sign_bits(v):
    bits = F.transform(v, lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b))


def _frames(spark, d):
    """Sixteen consecutive vectors are one clip: as many frames as a clip may have."""
    k = F.col("vec_id")
    return T.table(spark, d, "embeddings").select(
        F.floor(k / 16).alias("item_id"), (k % 16).cast("double").alias("ts_sec"), _sign_bits(F.col("embedding")).alias("hash")
    )


_FRAMES = {
    "fr": "SELECT vec_id // 16 AS item_id, vec_id % 16 AS idx, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings",
    "fold": """SELECT item_id, idx, b AS last, 65 AS dist, true AS keep FROM fr WHERE idx = 0
        UNION ALL SELECT f.item_id, f.idx, CASE WHEN h > 28 THEN f.b ELSE fold_last END, h, h > 28 FROM (
            SELECT n.*, p.last AS fold_last, len(list_filter(range(1, 65), lambda i: p.last[i] <> n.b[i])) AS h FROM fold p JOIN fr n ON n.item_id = p.item_id AND n.idx = p.idx + 1) f""",
}


@query(
    """SELECT item_id, idx AS ts_sec, keep OR r <= greatest(0, 12 - kept) AS kept FROM (
        SELECT *, count(*) FILTER (keep) OVER (PARTITION BY item_id) AS kept, row_number() OVER (PARTITION BY item_id, keep ORDER BY dist DESC, idx) AS r FROM fold)""",
    _FRAMES, keys="item_id, kept", nums="ts_sec",
)
def frame_dedup(spark, d):
    """A wide threshold and a high floor, so that removal and restoring both happen on these vectors."""
    return R.drop_near_duplicates(_frames(spark, d), threshold=28, floor=12).select("item_id", "kept", "ts_sec")


@query(
    """SELECT a.vec_id AS item_id, len(list_filter(range(1, 65), lambda i: (a.embedding[i] > 0) <> (b.embedding[i] > 0))) AS distance
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    keys="item_id", ints="distance",
)
def hash_distance(spark, d):
    v = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), _sign_bits(F.col("embedding")).alias("hash"))
    nxt = v.select((F.col("item_id") - 1).alias("item_id"), F.col("hash").alias("other"))
    return v.join(nxt, "item_id").select("item_id", X.hamming(F.col("hash"), F.col("other")).alias("distance"))


@query(
    """SELECT item_id, array_to_string(list_transform(range(0, 16), lambda j: substr('0123456789abcdef', (1 + 8 * bits[4 * j + 1] + 4 * bits[4 * j + 2] + 2 * bits[4 * j + 3] + bits[4 * j + 4])::INT, 1)), '') AS hash
       FROM (SELECT item_id, list_transform(range(0, 64), lambda i: CASE WHEN g[(i // 8) * 9 + i % 8 + 1] > g[(i // 8) * 9 + i % 8 + 2] THEN 1 ELSE 0 END) AS bits
       FROM (SELECT vec_id AS item_id, list_transform(embedding || embedding[1:8], lambda x: floor((x::DOUBLE + 1) * 127.5)::INT) AS g FROM embeddings))"""
)
def gradient_hash(spark, d):
    v = F.col("embedding")
    gray = F.transform(F.concat(v, F.slice(v, 1, 8)), lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    planes = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), gray.alias("gray"))
    return planes.select("item_id", X.long_to_hex(X.gradient_hash(F.col("gray"))).alias("hash"))


@query(
    """SELECT item_id, fps, rot AS rotation, w AS width, h AS height, CASE WHEN greatest(w, h) <= 768 THEN w ELSE greatest(2, floor(w * (768.0::DOUBLE / greatest(w, h)) / 2 + 0.5) * 2) END AS scaled_w,
        CASE WHEN greatest(w, h) <= 768 THEN h ELSE greatest(2, floor(h * (768.0::DOUBLE / greatest(w, h)) / 2 + 0.5) * 2) END AS scaled_h FROM (
        SELECT item_id, fps, rot, CASE WHEN rot IN (90, 270) THEN h0 ELSE w0 END AS w, CASE WHEN rot IN (90, 270) THEN w0 ELSE h0 END AS h FROM (
        SELECT p_partkey AS item_id, CASE p_partkey % 4 WHEN 0 THEN 30000 / 1001.0::DOUBLE WHEN 1 THEN 25.0::DOUBLE END AS fps,
            ((((p_partkey % 9) * 45 - 90) % 360) + 360) % 360 AS rot, 464 + p_size * 10 AS w0, 848 AS h0 FROM part))""",
    keys="item_id", ints="rotation, width, height, scaled_w, scaled_h", nums="fps",
)
def probe_records(spark, d):
    k = F.col("p_partkey")
    raw = T.table(spark, d, "part").select(
        k.alias("item_id"),
        F.when(k % 4 == 0, "30000/1001").when(k % 4 == 1, "25").when(k % 4 == 2, "0/0").otherwise("").alias("rate"),
        ((k % 9) * 45 - 90).cast("string").alias("deg"), (F.col("p_size") * 10 + 464).alias("w"), F.lit(848).alias("h"),
    )
    sized = raw.select(
        "item_id", M.frame_rate(F.col("rate")).alias("fps"), M.rotation(F.col("deg")).alias("rotation"),
        M.display_size(F.col("w"), F.col("h"), F.col("deg")).alias("s"),
    ).select("item_id", "fps", "rotation", "s.width", "s.height")
    scaled = M.scaled_size(F.col("width"), F.col("height"), S.frame_long_edge)
    return sized.withColumn("z", scaled).select("item_id", "fps", "rotation", "width", "height", F.col("z.width").alias("scaled_w"), F.col("z.height").alias("scaled_h"))


@query(
    """SELECT item_id, rot AS rotation, w / h AS aspect, h > w AS vertical FROM (SELECT item_id, rot, CASE WHEN rot IN (90, 270) THEN 848 ELSE w0 END AS w, CASE WHEN rot IN (90, 270) THEN w0 ELSE 848 END AS h FROM (
        SELECT p_partkey AS item_id, p_size * 10 + 464 AS w0, ((coalesce(CASE WHEN p_partkey % 3 = 0 THEN -90 END, CASE WHEN p_partkey % 4 < 2 THEN p_partkey % 2 * 180 END, CASE WHEN p_partkey % 5 > 1 THEN 450 END, 0) % 360) + 360) % 360 AS rot FROM part))""",
    keys="item_id, vertical", ints="rotation", nums="aspect",
)
def probe_geometry(spark, d):
    """Rotation from whichever of its three places states it first, then shape and orientation as shown."""
    k = F.col("p_partkey")
    raw = T.table(spark, d, "part").select(
        k.alias("item_id"), (F.col("p_size") * 10 + 464).alias("w"), F.lit(848).alias("h"),
        F.when(k % 3 == 0, F.array(F.lit(None).cast("double"), F.lit(-90.0), F.lit(7.0))).when(k % 3 == 1, F.array().cast("array<double>")).alias("side"),
        F.when(k % 4 < 2, k % 2 * 180).alias("stream"), F.when(k % 5 > 1, "450").alias("tag"),
    )
    stated = M.stated_rotation(F.col("side"), F.col("stream"), F.col("tag"))
    sized = raw.select("item_id", M.rotation(stated).alias("rotation"), M.display_size(F.col("w"), F.col("h"), stated).alias("s"))
    return sized.select("item_id", "rotation", M.aspect_ratio(F.col("s.width"), F.col("s.height")).alias("aspect"), (F.col("s.height") > F.col("s.width")).alias("vertical"))


# --- ingest ---

_INGEST = {
    "files": """SELECT 'doc_' || lpad(d.doc_id::VARCHAR, 8, '0') || '.mp4' AS file_name, CASE WHEN d.doc_id % 53 <> 0 THEN sha256(text) END AS checksum,
        CASE WHEN d.doc_id % 41 <> 0 THEN n_chars / 60.0::DOUBLE END AS duration_s, CASE WHEN lang = 'en' THEN 464 ELSE 848 END AS width, CASE WHEN lang = 'en' THEN 848 ELSE 464 END AS height,
        'creator_' || l.quality AS creator_id, 'handle_' || l.toxic AS creator_handle FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "stock": """SELECT min(doc_id) AS item_id, sha256(text) AS checksum, CASE WHEN min(lang) <> 'en' THEN 'creator_1' END AS creator_id,
        CASE WHEN min(lang) <> 'en' THEN 'handle_0' END AS creator_handle FROM documents WHERE source IN ('src0', 'src1') GROUP BY text""",
    "byfile": """SELECT f.*, s.item_id AS existing_item, s.creator_id AS ec, s.creator_handle AS eh, min(CASE WHEN f.duration_s BETWEEN 1 AND 300 THEN f.file_name END) OVER (PARTITION BY f.checksum) AS first_file,
        first_value(CASE WHEN f.creator_id IS NOT NULL AND (s.item_id IS NOT NULL OR f.duration_s BETWEEN 1 AND 300) THEN {'c': f.creator_id, 'h': f.creator_handle} END IGNORE NULLS) OVER
            (PARTITION BY f.checksum ORDER BY f.file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS offer FROM files f LEFT JOIN stock s USING (checksum)""",
    "outc": """SELECT *, status = 'duplicate' AND creator_id IS NOT NULL AND own.c IS NULL AS creator_enriched,
        concat_ws(',', CASE WHEN status = 'ingested' AND height <= width THEN 'not_vertical' END,
            CASE WHEN status = 'duplicate' AND creator_id IS NOT NULL AND own.c IS NOT NULL AND (own.c <> creator_id OR own.h <> creator_handle) THEN 'creator_conflict' END) AS warnings
        FROM (SELECT *, CASE WHEN ec IS NOT NULL THEN {'c': ec, 'h': eh} ELSE offer END AS own,
        CASE WHEN checksum IS NULL THEN 'unreadable' WHEN existing_item IS NOT NULL OR first_file < file_name THEN NULL WHEN duration_s IS NULL THEN 'probe_failed' WHEN duration_s > 300 THEN 'too_long' WHEN duration_s < 1 THEN 'too_short' END AS why,
        CASE WHEN checksum IS NULL THEN 'rejected' WHEN existing_item IS NOT NULL OR first_file < file_name THEN 'duplicate' WHEN duration_s IS NULL OR duration_s > 300 OR duration_s < 1 THEN 'rejected' ELSE 'ingested' END AS status FROM byfile)""",
}


def _manifest(spark, d):
    """Attribution from the labels; benchmark rows name files that do not exist."""
    k = F.col("doc_id")
    labelled = T.table(spark, d, "labels").select(
        F.concat(F.lit("doc_"), F.lpad(k.cast("string"), 8, "0"), F.lit(".mp4")).alias("file_name"),
        F.concat(F.lit("creator_"), F.col("quality").cast("string")).alias("creator_id"),
        F.concat(F.lit("handle_"), F.col("toxic").cast("string")).alias("creator_handle"),
    )
    absent = T.table(spark, d, "benchmark").select(
        F.concat(F.lit("bench_"), F.col("item_id").cast("string"), F.lit(".mp4")).alias("file_name"), F.lit("creator_1").alias("creator_id"), F.lit("handle_1").alias("creator_handle")
    )
    return labelled.unionByName(absent)


def _files(spark, d):
    """Documents as media files; some of them cannot be read and some cannot be probed."""
    en = F.col("lang") == "en"
    files = T.table(spark, d, "documents").select(
        F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".mp4")).alias("file_name"),
        F.when(F.col("doc_id") % 53 != 0, F.sha2(F.col("text").cast("binary"), 256)).alias("checksum"),
        F.when(F.col("doc_id") % 41 != 0, F.col("n_chars") / 60.0).alias("duration_s"),
        F.when(en, 464).otherwise(848).alias("width"),
        F.when(en, 848).otherwise(464).alias("height"),
    )
    return N.attribute(files, _manifest(spark, d))


def _stock(spark, d):
    old = T.table(spark, d, "documents").where(F.col("source").isin("src0", "src1"))
    named = F.min("lang") != "en"
    return old.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("checksum")).agg(
        F.min("doc_id").alias("item_id"), F.when(named, "creator_1").alias("creator_id"), F.when(named, "handle_0").alias("creator_handle")
    )


@query(
    """SELECT file_name, status, why AS reason, warnings,
        creator_enriched, existing_item::VARCHAR AS existing_item FROM outc""",
    _INGEST,
)
def ingest_outcomes(spark, d):
    out = N.ingest_outcomes(_files(spark, d), _stock(spark, d), S).drop("checksum")
    return out.withColumn("existing_item", F.col("existing_item").cast("string"))


@query(
    """SELECT status, coalesce(why, '-') AS reason, count(*) AS n,
        count(*) FILTER (warnings LIKE '%not_vertical%') AS not_vertical, count(*) FILTER (warnings LIKE '%conflict%') AS creator_conflict,
        count(*) FILTER (creator_enriched) AS enriched FROM outc GROUP BY 1, 2""",
    _INGEST,
)
def ingest_counts(spark, d):
    return N.outcome_counts(N.ingest_outcomes(_files(spark, d), _stock(spark, d), S))


@query(
    """SELECT s.item_id, coalesce(s.creator_id, o.c) AS creator_id, coalesce(s.creator_handle, o.h) AS creator_handle FROM stock s
       LEFT JOIN (SELECT checksum, arg_min(creator_id, file_name) AS c, arg_min(creator_handle, file_name) AS h FROM files WHERE creator_id IS NOT NULL GROUP BY 1) o USING (checksum)""",
    _INGEST,
)
def reconciled_items(spark, d):
    return N.reconciled_items(_stock(spark, d), _files(spark, d)).drop("checksum")


@query("SELECT 'bench_' || item_id || '.mp4' AS file_name FROM benchmark")
def manifest_unmatched(spark, d):
    return N.unmatched_manifest(_files(spark, d), _manifest(spark, d))


@query("SELECT p_name AS file_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def manifest_repeated(spark, d):
    return N.repeated_manifest(T.table(spark, d, "part").select(F.col("p_name").alias("file_name")))


@query("SELECT f.file_name, s.item_id FROM files f JOIN stock s USING (checksum)", _INGEST)
def ingest_mapping(spark, d):
    return N.mapping(N.ingest_outcomes(_files(spark, d), _stock(spark, d), S), _stock(spark, d))
