"""One query per operator over its whole table, with the SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import bpe, classifier, decontamination, embedding_dedup, html_text, licence_scan, lines, periodic, pii, ranked_search, secret_scan, simhash, token_files
from feedloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Trained on the labels of the two thirds of all ids that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~classifier.held_out()).select("doc_id", F.col("quality").alias("label"))
    return classifier.train(docs, labels)


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classifier.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


SQL["op6_decontamination"] = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i:i + least(10, len(w)) - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, n, p, w[p:p + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, spot.n, item_id FROM spot JOIN win USING (win)),
word AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS at FROM hit),
words AS (SELECT doc_id, count(*) AS n_hit FROM word GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after line dedup."""
    return lines.drop_repeated_lines(table(spark, sf_dir, "documents"), count_col="n_chars")


def n_spans(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def span_text(spans, *keep):
    """kind:start:end, comma-joined, of the spans that ``keep`` lets through."""
    chosen = F.filter(spans, keep[0]) if keep else F.col(spans) if isinstance(spans, str) else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    counts = [n_spans(r.kind) for r in secret_scan.BASE]
    base = span_text("spans", lambda s: s["rule"] < len(secret_scan.BASE))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_pii(docs, pii.train(docs))
    base = span_text("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[n_spans(k) for k in pii.BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


@query
def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


SQL["op3_embeddings"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT a AS vec_id, a AS r FROM link UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.r),
low AS (SELECT vec_id, min(r) AS c FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(low.c, v.vec_id) AS component_id, coalesce(low.c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN low USING (vec_id)
"""


def document_paths(docs: DataFrame) -> DataFrame:
    """The documents as files of a tree with directories for source, language and hundred of ids.

    Ids that end in 00 lie in the source's directory itself and others that end in 0 in the language's, so that every level has files.
    """
    ends = F.col("doc_id") % 100
    hundred = F.when(ends % 10 != 0, F.lpad(F.floor(F.col("doc_id") / 100).cast("string"), 12, "0"))
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 14, "0"), F.lit(".txt"))
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("-")), F.when(ends != 0, F.coalesce("lang", F.lit("-"))), hundred, name).alias("path"), "text")


@query
def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document: its own line, or that of a stand-in in the nearest directory above (documents hold no licence files)."""
    found = licence_scan.scan_licences(document_paths(table(spark, sf_dir, "documents")))
    doc_id = F.substring_index(F.substring_index("path", "/", -1), ".", 1).cast("bigint")
    return found.select(doc_id.alias("doc_id"), "license", F.round("score", 6).alias("score"), "origin", "source")


@query
def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.extract_text(pages, html_text.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which get a repeated tail first."""
    found = periodic.find_runs(periodic.repeat_tails(table(spark, sf_dir, "documents")))
    longest = F.reduce(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.get("runs", F.lit(0)),  # runs come by start, then period: only a longer one replaces an earlier one
        lambda best, run: F.when(run["length"] > best["length"], run).otherwise(best),
    )
    lines_of = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("r"), F.sha2(lines_of.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("r.length") / F.col("r.period")).alias("exponent_milli")
    return found.select("doc_id", "n_runs", "r.start", "r.length", "r.period", milli, "runs_sha256", "collapsed_sha256")


# ---- SQL of the operators whose results SQL can state ----

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL["op7_lines"] = rf"""
WITH d AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents),
ln AS (SELECT doc_id, p, l[p] AS s, len({_WORDS.format("l[p]")}) AS w FROM (SELECT *, unnest(range(1, len(l) + 1)) AS p FROM d)),
sq AS (SELECT doc_id, p, s, w, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS a FROM ln WHERE w > 0),
ar AS (SELECT doc_id, list(s ORDER BY i) AS ss FROM sq GROUP BY 1),
fw AS (SELECT x.doc_id, x.i AS b, min(y.i) AS e FROM sq x JOIN sq y ON y.doc_id = x.doc_id AND y.i >= x.i AND y.a >= x.a - x.w + {lines.MIN_WORDS} GROUP BY 1, 2),
bw AS (SELECT y.doc_id, max(x.i) AS b, y.i AS e FROM sq y JOIN sq x ON x.doc_id = y.doc_id AND x.i <= y.i AND y.a >= x.a - x.w + {lines.MIN_WORDS} GROUP BY y.doc_id, y.i),
run AS (SELECT doc_id, b, e, ss[b:e] AS run FROM (SELECT doc_id, b, e FROM fw UNION SELECT doc_id, b, e FROM bw) JOIN ar USING (doc_id)),
later AS (SELECT doc_id, b, e FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, b) AS r FROM run) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(b, e + 1)) AS i FROM later),
fl AS (SELECT ln.doc_id, ln.p, ln.s, sq.i, gone.i IS NOT NULL AS cut FROM ln LEFT JOIN sq USING (doc_id, p) LEFT JOIN gone ON gone.doc_id = ln.doc_id AND gone.i = sq.i),
nb AS (SELECT *, last_value(CASE WHEN i IS NOT NULL THEN cut END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc,
  first_value(CASE WHEN i IS NOT NULL THEN cut END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nc FROM fl),
kept AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY p) AS t FROM nb WHERE NOT (CASE WHEN i IS NOT NULL THEN cut ELSE coalesce(pc, false) AND coalesce(nc, false) END) GROUP BY 1)
SELECT d.doc_id, coalesce(t, '') AS text, lang, source, CAST(length(coalesce(t, '')) AS BIGINT) AS n_chars FROM d LEFT JOIN kept USING (doc_id)
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_RULES = " UNION ALL ".join(
    f"SELECT doc_id, {n} AS k, {_text(r.kind)} AS kind, string_split_regex(text, {_text(r.pattern)}) AS s, regexp_extract_all(text, {_text(r.pattern)}) AS m, "
    f"regexp_extract_all(text, {_text(r.pattern)}, {r.group}) AS g, {r.least} AS least FROM documents WHERE regexp_matches(text, {_text(r.pattern)})"
    for n, r in enumerate(secret_scan.BASE + secret_scan.MORE)
)
SQL["op5_secrets"] = f"""
WITH found AS ({_RULES}),
each AS (SELECT doc_id, k, kind, least, m[i] AS m, g[i] AS g, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS b
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
span AS (SELECT doc_id, k, kind, CAST(b AS BIGINT) AS b, kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + length(m) AS BIGINT) AS t FROM each WHERE length(g) >= least),
per AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = {n}) AS n_{r.kind}" for n, r in enumerate(secret_scan.BASE))},
  string_agg(t, ',' ORDER BY b, k) FILTER (k < {len(secret_scan.BASE)}) AS base, string_agg(t, ',' ORDER BY b, k) AS spans FROM span GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)
"""

_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
SQL["op10_licences"] = f"""
WITH tpl AS (SELECT * FROM (VALUES {", ".join(f"({n}, {_text(t.license)}, {_text(t.text)}, [{', '.join(map(_text, t.must))}]::VARCHAR[])" for n, t in enumerate(licence_scan.TEMPLATES))}) v(t, license, body, must)),
tw AS (SELECT t, license, must, w, count(*) AS n FROM (SELECT t, license, must, unnest({_TOKENS.format("body")}) AS w FROM tpl) GROUP BY ALL),
voc AS (SELECT DISTINCT w FROM tw),
df AS (SELECT w, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest({_TOKENS.format("text")}) AS w FROM documents) SEMI JOIN voc USING (w) GROUP BY 1),
big AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT w, ln((1 + big.n) / (1 + coalesce(df.n, 0))) + 1 AS v FROM voc CROSS JOIN big LEFT JOIN df USING (w)),
tv AS (SELECT t, license, must, w, n * v / sqrt(sum(n * v * n * v) OVER (PARTITION BY t)) AS v FROM tw JOIN idf USING (w)),
file AS (SELECT doc_id, text, concat_ws('/', source, CASE WHEN doc_id % 100 <> 0 THEN lang END, CASE WHEN doc_id % 10 <> 0 THEN lpad(CAST(doc_id // 100 AS VARCHAR), 12, '0') END) AS folder FROM documents),
ln AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) WHERE len(list_intersect({_TOKENS.format("s")}, (SELECT list(w) FROM voc))) > 0),
lw AS (SELECT s, w, count(*) AS n FROM (SELECT s, unnest({_TOKENS.format("s")}) AS w FROM (SELECT DISTINCT s FROM ln)) GROUP BY ALL),
lv AS (SELECT s, w, n * coalesce(v, (SELECT ln(1 + n) + 1 FROM big)) AS v FROM lw LEFT JOIN idf USING (w)),
norm AS (SELECT s, sqrt(sum(v * v)) AS v FROM lv GROUP BY 1),
dot AS (SELECT s, t, license, sum(lv.v * tv.v) AS v FROM lv JOIN tv USING (w) GROUP BY s, t, license HAVING count(*) FILTER (list_contains(must, w)) = any_value(len(must))),
best AS (SELECT s, license, round(dot.v / norm.v, 9) AS score FROM dot JOIN norm USING (s) WHERE round(dot.v / norm.v, 9) >= {licence_scan.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY s ORDER BY round(dot.v / norm.v, 9) DESC, license) = 1),
own AS (SELECT doc_id, license, score FROM ln JOIN best USING (s) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
path AS (SELECT doc_id, folder, folder || '/' || lpad(CAST(doc_id AS VARCHAR), 14, '0') || '.txt' AS path FROM file),
held AS (SELECT folder, license, score, path FROM own JOIN path USING (doc_id) QUALIFY row_number() OVER (PARTITION BY folder ORDER BY path) = 1),
near AS (SELECT a.folder, h.license, h.score, h.path FROM (SELECT DISTINCT folder FROM path) a JOIN held h ON a.folder = h.folder OR starts_with(a.folder, h.folder || '/') QUALIFY row_number() OVER (PARTITION BY a.folder ORDER BY length(h.folder) DESC) = 1)
SELECT p.doc_id, coalesce(o.license, n.license) AS license, round(coalesce(o.score, n.score), 6) AS score, CASE WHEN o.license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'stand_in' END AS origin,
  CASE WHEN o.license IS NOT NULL THEN p.path WHEN n.license IS NOT NULL THEN n.path END AS source
FROM path p LEFT JOIN own o USING (doc_id) LEFT JOIN near n ON n.folder = p.folder
"""

# Neighbours of a run agree one period later at least five words in a row, so runs are found from equal groups of five words.
SQL["op13_periodic"] = rf"""
WITH RECURSIVE bits AS (SELECT doc_id, coalesce(text, '') AS text, encode(CAST(doc_id AS VARCHAR)) AS b FROM documents),
crc AS (SELECT doc_id, text, b, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM bits UNION ALL
  SELECT doc_id, text, b, i + 1, list_reduce(list_prepend(xor(c, CAST(ascii(substr(decode(b), i + 1, 1)) AS BIGINT)), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) FROM crc WHERE i < octet_length(b)),
h AS (SELECT doc_id, text, xor(c, 4294967295) AS h FROM crc WHERE i = octet_length(b)),
w0 AS (SELECT doc_id, h, h // 10 AS g, {_WORDS.format("text")} AS w FROM h),
w1 AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS mend, CASE WHEN len(w) > 0 THEN g % len(w) END AS a, g FROM w0),
w2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w1),
d AS (SELECT doc_id, n, CASE WHEN mend THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % p + 1 END]) ELSE w END AS w FROM w2),
five AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS f FROM (SELECT *, unnest(range(n - 4)) AS i FROM d WHERE n >= 6)),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM five x JOIN five y ON x.doc_id = y.doc_id AND x.f = y.f AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS l FROM isle GROUP BY doc_id, q, k HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM stretch a WHERE NOT EXISTS (SELECT 1 FROM stretch b WHERE a.doc_id = b.doc_id AND b.q < a.q AND b.s <= a.s AND b.s + b.l >= a.s + a.l)),
top AS (SELECT doc_id, s, l, q FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, s, q) = 1),
per AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM d) u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.i = u.i WHERE g.i IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli, sha256(coalesce(per.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN top USING (doc_id) LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op11_search"] = f"""
WITH d AS (SELECT doc_id, {_TERMS.format("text")} AS w FROM documents),
big AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS t FROM benchmark),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) SEMI JOIN q USING (t) GROUP BY ALL),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(big.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, big GROUP BY t),
im AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * tf.n * big.n) // big.l)) AS v FROM tf, big),
sc AS (SELECT item_id, doc_id, CAST(sum(w * v) AS BIGINT) AS score FROM q JOIN wt USING (t) JOIN im USING (t) GROUP BY ALL HAVING sum(w * v) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
