"""DuckDB statements that state the expected result of every registered query on the same parquet tables."""

from __future__ import annotations

import re

from feedloom.config import EVENT_WEIGHTS, Settings
from feedloom.taxonomy import neutral

S = Settings()
TAX = neutral()
NOW = f"TIMESTAMP '{S.now}'"
DAY = S.now[:10]

_weights = " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_WEIGHTS.items())
WEIGHT = f"(CASE type {_weights} ELSE 0.0 END)::DOUBLE"
AGE_DAYS = f"greatest(0.0::DOUBLE, (epoch_us({NOW}) - epoch_us(created_at)) / 8.64e10)"
SIGNAL = f"({WEIGHT} * pow(0.5::DOUBLE, {AGE_DAYS} / {S.halflife_days}))"
RECENCY = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0 - (epoch_us({NOW}) - epoch_us(created_at)) / 3.6e9 / {S.trending_window_hours}.0))"


def fnv(text: str) -> str:
    return (
        f"(list_reduce(list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT), "
        "lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) / 4294967296.0::DOUBLE)"
    )


_tax_rows = ", ".join(f"('{f}', '{k}', '{v}', {s}, {w}::DOUBLE, {str(d).lower()})" for f, k, v, s, w, d in TAX.rows)

CTE: dict[str, str] = {
    "tax": f"SELECT * FROM (VALUES {_tax_rows}) t(field, kind, value, slot, weight, diversity)",
    "ev": """SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, ts AS created_at, value,
        CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'complete' WHEN 'purchase' THEN 'like'
             WHEN 'error' THEN 'skip' WHEN 'signup' THEN 'impression' END AS type FROM events""",
    "parts": """SELECT p_partkey AS item_id, 'item-' || p_partkey AS external_id,
        CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS creator_id,
        CASE WHEN p_partkey % 10 <> 0 THEN lower(replace(p_brand, '#', '_')) END AS creator_handle,
        TIMESTAMP '2024-01-01' + to_days((p_partkey % 30)::INTEGER) AS created_at,
        CASE WHEN p_partkey % 17 = 0 THEN 'failed' ELSE 'analyzed' END AS status,
        CASE WHEN p_partkey % 23 = 0 THEN 0 ELSE 1 END AS taxonomy_version,
        CASE WHEN p_partkey % 19 <> 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (p_retailprice - 900) / 100)) END AS quality_raw,
        p_size * 4.0::DOUBLE AS duration_s FROM part""",
    "items": "SELECT p.* FROM parts p JOIN embeddings e ON e.vec_id = p.item_id",
    "tags": """SELECT item_id, field, value FROM (
        SELECT p_partkey AS item_id, 'size_band' AS field, CASE WHEN p_size <= 5 THEN 'none' WHEN p_size <= 20 THEN 'small'
            WHEN p_size <= 35 THEN 'medium' WHEN p_size <= 45 THEN 'large' ELSE 'unknown' END AS value FROM part
        UNION ALL SELECT p_partkey, 'finish', CASE lower(p_type) WHEN 'standard' THEN 'other' ELSE lower(p_type) END FROM part
        UNION ALL SELECT p_partkey, 'grade', CASE WHEN p_partkey % 13 = 0 THEN 'unknown' WHEN p_retailprice >= 950 THEN 'high' ELSE 'low' END FROM part
        UNION ALL SELECT p_partkey, 'trait', split_part(p_name, ' ', 1) FROM part WHERE p_partkey % 11 <> 0
        UNION ALL SELECT p_partkey, 'object', split_part(p_name, ' ', 2) FROM part)""",
    "enc0": """SELECT t.item_id, x.slot, x.weight / sqrt(count(*) OVER (PARTITION BY t.item_id, t.field))
        * CASE WHEN t.field = 'finish' AND t.item_id % 2 = 1 THEN 0.9 ELSE 0.5 END AS w
        FROM tags t JOIN tax x USING (field, value) WHERE t.value <> 'unknown'""",
    "enc": "SELECT item_id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM enc0",
    "vecs": f"""SELECT item_id, CASE WHEN item_id % 23 = 0 THEN 0 ELSE 1 END AS taxonomy_version, list(w ORDER BY slot) AS v FROM (
        SELECT p.item_id, x.slot, coalesce(e.w, 0.0::DOUBLE) AS w FROM parts p CROSS JOIN tax x
        LEFT JOIN enc e ON e.item_id = p.item_id AND e.slot = x.slot) GROUP BY item_id""",
    "usable": "SELECT item_id, v FROM vecs WHERE taxonomy_version = 1",
    "dense": "SELECT vec_id AS item_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings",
    "elig": "SELECT i.*, u.v FROM items i JOIN usable u USING (item_id) WHERE status = 'analyzed'",
    "elig_d": "SELECT i.*, u.v FROM items i JOIN dense u USING (item_id) WHERE status = 'analyzed'",
    "pairs": f"""SELECT user_id, item_id, count(*) AS n_events, count(*) FILTER ({WEIGHT} <> 0) AS n_meaningful,
        count(*) FILTER ({SIGNAL} <> 0) AS n_effective, sum({SIGNAL}) AS sig, sum(greatest({SIGNAL}, 0)) AS pos,
        sum(greatest(-{SIGNAL}, 0)) AS neg FROM ev GROUP BY 1, 2""",
    "seen": "SELECT DISTINCT user_id, item_id FROM ev",
    "hist": """SELECT p.*, i.creator_id, u.v FROM pairs p JOIN items i USING (item_id) LEFT JOIN usable u USING (item_id)""",
    "hist_d": """SELECT p.*, i.creator_id, u.v FROM pairs p JOIN items i USING (item_id) LEFT JOIN dense u USING (item_id)""",
}


def _profile(hist: str, dim: int) -> str:
    return f"""SELECT c.user_id, c.interaction_count, c.effective, c.skipped_no_features, c.positive_signal, c.negative_signal,
        c.effective < {S.cold_start_min} AS is_cold_start,
        (SELECT list(coalesce(q.t, 0.0) / greatest(c.positive_signal + c.negative_signal, 1e-9) ORDER BY q.slot)
         FROM (SELECT s.slot, t.t FROM range(1, {dim + 1}) s(slot) LEFT JOIN {hist}_slots t ON t.slot = s.slot AND t.user_id = c.user_id) q) AS v
        FROM (SELECT user_id, sum(n_events)::BIGINT AS interaction_count,
            sum(CASE WHEN v IS NULL THEN 0 ELSE n_effective END)::BIGINT AS effective,
            sum(CASE WHEN v IS NULL THEN n_meaningful ELSE 0 END)::BIGINT AS skipped_no_features,
            sum(CASE WHEN v IS NULL THEN 0 ELSE pos END) AS positive_signal,
            sum(CASE WHEN v IS NULL THEN 0 ELSE neg END) AS negative_signal FROM {hist} GROUP BY 1) c"""


for _h, _dim in (("hist", TAX.dim), ("hist_d", 64)):
    CTE[f"{_h}_slots"] = (
        f"SELECT user_id, slot, sum(sig * v[slot]) AS t FROM (SELECT user_id, sig, v, unnest(range(1, {_dim + 1})) AS slot FROM {_h} WHERE v IS NOT NULL) GROUP BY 1, 2"
    )
CTE["prof"] = _profile("hist", TAX.dim)
CTE["prof_d"] = _profile("hist_d", 64)
CTE["affinity"] = """SELECT h.user_id, h.creator_id, sum(sig) / greatest(any_value(t.total), 1e-9) AS score, sum(n_effective)::BIGINT AS n
    FROM hist h JOIN (SELECT user_id, sum(pos + neg) AS total FROM hist WHERE v IS NOT NULL AND n_effective > 0 GROUP BY 1) t USING (user_id)
    WHERE v IS NOT NULL AND n_effective > 0 AND creator_id IS NOT NULL GROUP BY 1, 2"""
CTE["eng"] = (
    f"SELECT item_id, sum({WEIGHT} * {RECENCY}) AS engagement FROM ev WHERE created_at >= {NOW} - INTERVAL {S.trending_window_hours} HOUR AND {WEIGHT} <> 0 GROUP BY 1"
)
CTE["pop"] = """SELECT item_id, engagement, CASE WHEN max(engagement) OVER () > 0
    THEN greatest(0, engagement) / max(engagement) OVER () ELSE 0.0 END AS popularity FROM eng"""
CTE["recent"] = f"""SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS position FROM (
        SELECT user_id, item_id, min(rn) AS rn FROM (SELECT user_id, item_id,
            row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS rn FROM ev)
        WHERE rn <= {S.fatigue_window_events} GROUP BY 1, 2)
    WHERE item_id IN (SELECT item_id FROM elig) QUALIFY position <= {S.fatigue_window_items}"""
CTE["pref"] = f"""SELECT user_id, slot, field || ':' || value AS tag, w,
        row_number() OVER (PARTITION BY user_id ORDER BY round(w, 12) DESC, slot) AS tag_rank
    FROM (SELECT p.user_id, x.slot, x.field, x.value, p.v[x.slot + 1] AS w FROM prof p CROSS JOIN tax x WHERE x.value NOT IN ('none', 'unknown'))
    WHERE w > 0 QUALIFY tag_rank <= {S.preferred_tags}"""


def _similar(prof: str, elig: str, k: int) -> str:
    return f"""SELECT user_id, item_id, sim, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, item_id) AS rank FROM (
        SELECT p.user_id, e.item_id, round(list_dot_product(p.v, e.v) / sqrt(list_dot_product(p.v, p.v) * list_dot_product(e.v, e.v)), 10) AS sim
        FROM {prof} p CROSS JOIN {elig} e ANTI JOIN seen s ON s.user_id = p.user_id AND s.item_id = e.item_id
        WHERE NOT p.is_cold_start AND list_dot_product(p.v, p.v) > 0) QUALIFY rank <= {k}"""


CTE["src_similar"] = _similar("prof", "elig", S.source_limits["similar"])
CTE["src_tag"] = f"""SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY best, item_id) AS rank FROM (
        SELECT p.user_id, t.item_id, min(p.tag_rank) AS best FROM pref p JOIN tags t ON p.tag = t.field || ':' || t.value
        JOIN elig e ON e.item_id = t.item_id JOIN prof q ON q.user_id = p.user_id AND NOT q.is_cold_start
        ANTI JOIN seen s ON s.user_id = p.user_id AND s.item_id = t.item_id GROUP BY 1, 2) QUALIFY rank <= {S.source_limits['tag']}"""
CTE["src_trending"] = f"""SELECT p.user_id, g.item_id, row_number() OVER (PARTITION BY p.user_id ORDER BY round(engagement, 10) DESC, g.item_id) AS rank
    FROM prof p CROSS JOIN eng g SEMI JOIN elig e ON e.item_id = g.item_id ANTI JOIN seen s ON s.user_id = p.user_id AND s.item_id = g.item_id
    WHERE round(engagement, 10) > 0 QUALIFY rank <= {S.source_limits['trending']}"""
CTE["src_fresh"] = f"""SELECT p.user_id, e.item_id, row_number() OVER (PARTITION BY p.user_id ORDER BY e.created_at DESC, e.item_id) AS rank
    FROM prof p CROSS JOIN elig e ANTI JOIN seen s ON s.user_id = p.user_id AND s.item_id = e.item_id QUALIFY rank <= {S.source_limits['fresh']}"""
CTE["src_explore"] = f"""SELECT user_id, item_id, h, row_number() OVER (PARTITION BY user_id ORDER BY h DESC, item_id) AS rank FROM (
        SELECT p.user_id, e.item_id, {fnv(f"p.user_id || '|' || e.item_id || '|{DAY}'")} AS h FROM prof p CROSS JOIN elig e
        ANTI JOIN seen s ON s.user_id = p.user_id AND s.item_id = e.item_id) QUALIFY rank <= {S.source_limits['explore']}"""
CTE["cand0"] = " UNION ALL ".join(
    f"SELECT user_id, item_id, '{x}' AS source, {i} AS o FROM src_{x}" for i, x in enumerate(("similar", "tag", "trending", "fresh", "explore"))
)
CTE["cand"] = "SELECT user_id, item_id, string_agg(source, ',' ORDER BY o) AS sources FROM cand0 GROUP BY 1, 2"
CTE["recent_n"] = "SELECT user_id, count(*) AS n FROM recent GROUP BY 1"
CTE["divtags"] = "SELECT t.item_id, t.field || ':' || t.value AS tag FROM tags t JOIN tax x USING (field, value) WHERE x.diversity AND t.value NOT IN ('none', 'unknown')"
CTE["rec_creator"] = "SELECT r.user_id, i.creator_id, count(*) AS c FROM recent r JOIN items i USING (item_id) WHERE i.creator_id IS NOT NULL GROUP BY 1, 2"
CTE["rec_tag"] = "SELECT r.user_id, d.tag, count(*) AS c FROM recent r JOIN divtags d USING (item_id) GROUP BY 1, 2"


def _scored(prof: str) -> str:
    w = S.rank_weights
    return f"""SELECT *, round({w['affinity']} * affinity + {w['quality']} * quality + {w['freshness']} * freshness + {w['popularity']} * popularity
            - {w['fatigue']} * fatigue + {w['exploration']} * exploration + {w['creator_affinity']} * creator_affinity, 12) AS base_score FROM (
        SELECT *, (content_similarity + tag_affinity) / 2 AS affinity FROM (
        SELECT c.user_id, c.item_id, c.sources,
            CASE WHEN p.is_cold_start OR list_dot_product(p.v, p.v) = 0 THEN 0.0::DOUBLE
                ELSE list_dot_product(p.v, e.v) / sqrt(list_dot_product(p.v, p.v) * list_dot_product(e.v, e.v)) END AS content_similarity,
            CASE WHEN p.is_cold_start THEN 0.0::DOUBLE ELSE coalesce((SELECT avg(p.v[x.slot + 1]) FROM tags t JOIN tax x USING (field, value)
                WHERE t.item_id = c.item_id AND t.value NOT IN ('none', 'unknown')), 0.0) END AS tag_affinity,
            CASE WHEN p.is_cold_start THEN 0.0::DOUBLE ELSE coalesce(a.score, 0.0) END AS creator_affinity,
            coalesce(g.popularity, 0.0::DOUBLE) AS popularity,
            pow(0.5::DOUBLE, greatest(0.0::DOUBLE, (epoch_us({NOW}) - epoch_us(e.created_at)) / 3.6e9) / {S.freshness_halflife_hours}) AS freshness,
            coalesce(greatest(coalesce(rc.c, 0), coalesce((SELECT max(k.c) FROM divtags d JOIN rec_tag k ON k.tag = d.tag
                WHERE d.item_id = c.item_id AND k.user_id = c.user_id), 0)) / n.n * least(1.0::DOUBLE, n.n / {S.fatigue_window_items}.0), 0.0) AS fatigue,
            {fnv(f"c.user_id || '|' || c.item_id || '|{DAY}'")} AS exploration,
            coalesce(e.quality_raw, 0.0) AS quality, e.quality_raw IS NOT NULL AS quality_available
        FROM cand c JOIN {prof} p USING (user_id) JOIN elig e ON e.item_id = c.item_id
        LEFT JOIN affinity a ON a.user_id = c.user_id AND a.creator_id = e.creator_id
        LEFT JOIN pop g ON g.item_id = c.item_id
        LEFT JOIN rec_creator rc ON rc.user_id = c.user_id AND rc.creator_id = e.creator_id
        LEFT JOIN recent_n n ON n.user_id = c.user_id))"""


CTE["scored"] = _scored("prof")
CTE["listed"] = """SELECT s.user_id, list({'i': s.item_id, 'b': s.base_score, 'c': e.creator_id, 's': coalesce(d.slots, []::BIGINT[]), 'm': 0.0::DOUBLE,
        'v': list_transform(e.v, lambda x: CASE WHEN list_dot_product(e.v, e.v) > 0 THEN x / sqrt(list_dot_product(e.v, e.v)) ELSE 0.0 END)} ORDER BY s.item_id) AS cs
    FROM scored s JOIN elig e ON e.item_id = s.item_id
    LEFT JOIN (SELECT t.item_id, list(x.slot::BIGINT) AS slots FROM tags t JOIN tax x USING (field, value) WHERE x.diversity AND t.value NOT IN ('none', 'unknown') GROUP BY 1) d ON d.item_id = s.item_id
    GROUP BY 1"""
# One step per rank. Open candidates carry their largest similarity to what was chosen; when none is allowed the rest follows by score.
CTE["picked"] = f"""SELECT user_id, 0 AS rank, false AS relaxed, NULL::BIGINT AS item_id, NULL::VARCHAR AS creator_id, NULL::DOUBLE AS base_score, NULL::DOUBLE AS diversity_penalty,
        cs, []::VARCHAR[] AS creators, []::BIGINT[] AS slots FROM listed
    UNION ALL SELECT user_id, rank + 1, now_relaxed, p.i, p.c, p.b, {S.diversity_lambda} * p.m,
        list_transform(list_filter(cs, lambda c: c.i <> p.i), lambda c: {{'i': c.i, 'b': c.b, 'c': c.c, 's': c.s, 'm': greatest(c.m, list_dot_product(c.v, p.v)), 'v': c.v}}),
        list_append(creators, p.c), CASE WHEN rank < {S.tag_cap_window} THEN list_concat(slots, p.s) ELSE slots END
    FROM (SELECT *, list_filter(cs, lambda c: c.i = list_sort(list_transform(CASE WHEN now_relaxed THEN cs ELSE free END,
            lambda c: {{'o': CASE WHEN now_relaxed THEN -c.b ELSE {S.diversity_lambda} * c.m - c.b END, 'i': c.i}}))[1].i)[1] AS p
        FROM (SELECT *, relaxed OR len(free) = 0 AS now_relaxed
            FROM (SELECT *, list_filter(cs, lambda c: (c.c IS NULL OR len(list_filter(creators, lambda u: u = c.c)) < {S.max_same_creator})
                AND (rank >= {S.tag_cap_window} OR len(list_filter(c.s, lambda t: len(list_filter(slots, lambda u: u = t)) >= {S.max_same_tag})) = 0)) AS free
                FROM picked WHERE rank < {S.feed_size} AND len(cs) > 0)))"""
CTE["reranked"] = "SELECT user_id, item_id, rank, creator_id, base_score, diversity_penalty, base_score - diversity_penalty AS final_score, relaxed FROM picked WHERE rank > 0"


#: The tables that depend on the log, the items of a moment or the clock.
MOVING = ("ev", "items", "elig", "pairs", "hist_slots", "hist", "prof", "affinity", "eng", "pop", "recent_n", "recent", "rec_creator", "rec_tag", "cand", "scored")


def as_of(moment: str, suffix: str, **own: str) -> dict[str, str]:
    """The moving tables as they were at ``moment``, under names that end in ``suffix``; ``own`` replaces some of them."""
    names = re.compile(r"\b(" + "|".join(MOVING) + r")\b(?!\.)")
    cut = {"ev": f"{CTE['ev']} WHERE ts < TIMESTAMP '{moment}'", "items": f"{CTE['items']} WHERE p.created_at < TIMESTAMP '{moment}'"}
    out = {}
    for name in MOVING:
        text = own.get(name) or cut.get(name, CTE[name]).replace(NOW, f"TIMESTAMP '{moment}'").replace(f"|{DAY}'", f"|{moment[:10]}'")
        out[f"{name}{suffix}"] = text if name in own else names.sub(rf"\1{suffix}", text)
    return out


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the common tables it reaches, in dependency order."""
    tables = {**CTE, **(extra or {})}
    order: list[str] = []

    def visit(text: str, own: str | None) -> None:
        for name in tables:
            if name != own and name not in order and re.search(rf"\b{name}\b", text):
                visit(tables[name], name)
                if name not in order:
                    order.append(name)

    visit(body, None)
    return ("WITH RECURSIVE " + ", ".join(f"{n} AS ({tables[n]})" for n in order) + " " if order else "") + body


def final(body: str, keys: str = "", ints: str = "", nums: str = "") -> str:
    """Common output types: keys as they are, whole numbers as BIGINT, the rest rounded to six digits."""

    def split(x: str) -> list[str]:
        return [c.strip() for c in x.split(",") if c.strip()]

    cols = split(keys) + [f"{c}::BIGINT AS {c}" for c in split(ints)] + [f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in split(nums)]
    return f"SELECT {', '.join(cols)} FROM ({body})"
