"""Queries of the training-data operators, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinalis.llm import (
    decontaminate,
    hard_negatives,
    html_text,
    langid,
    line_dedup,
    lm_score,
    mixing,
    near_dup,
    pii,
    quality,
    suffix_dedup,
    token_align,
    toxicity,
)
from ordinalis.llm.common import read
from ordinalis.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(read(spark, sf_dir, "documents")).drop("removed")


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


ORACLES["op9_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 9),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM grams),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM wins) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
rows AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, source, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
    regexp_replace(translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS norm FROM rows),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM lines WHERE n > 0 GROUP BY 1),
hosts AS (SELECT source, count(*) AS n_docs FROM d GROUP BY 1),
freq AS (SELECT l.source, l.norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS k FROM lines WHERE n > 0 GROUP BY 1, 2) l
    JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source WHERE k > 10 AND k > h.n_docs * 0.005),
removed AS (SELECT doc_id, sum(n) AS r FROM lines l JOIN freq f ON f.norm = l.norm AND f.source IS NOT DISTINCT FROM l.source WHERE n > 0 GROUP BY 1),
figures AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(r, 0)::BIGINT AS n_removed_words
    FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 20 OR n_words - n_removed_words < 0.5 * n_words)) AS kept
FROM figures
"""


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.temperature_weights(docs))


ORACLES["op10_mix_sources"] = """
WITH RECURSIVE counts AS (SELECT source, count(*)::DOUBLE AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY 1),
rates AS (SELECT source, (SELECT sum(n) / sum(w) FROM counts) * w / n AS rate FROM counts),
parts AS (SELECT source, greatest(1, ceil(rate / 500))::INT AS parts, rate / greatest(1, ceil(rate / 500))::INT AS mean FROM rates),
steps(source, mean, k, p, cdf) AS (
    SELECT source, mean, 0, exp(-mean), exp(-mean) FROM parts
    UNION ALL
    SELECT source, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM steps WHERE k + 1 < ceil(mean + 12 * sqrt(mean) + 30)),
draws AS (SELECT d.*, part, ('0x' || substr(md5('17:poisson:' || doc_id || ':' || part), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
    FROM documents d JOIN parts p ON p.source IS NOT DISTINCT FROM d.source, generate_series(1, parts) g(part)),
copies AS (SELECT r.doc_id, count(*) AS n FROM draws r JOIN steps s ON s.source IS NOT DISTINCT FROM r.source AND r.u >= s.cdf GROUP BY 1),
many AS (SELECT d.*, unnest(generate_series(1, n))::INT AS copy FROM documents d JOIN copies USING (doc_id))
SELECT *, ('0x' || substr(md5('17:shuffle:' || doc_id || ':' || copy), 1, 12))::BIGINT AS shuffle_key FROM many
"""


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


ORACLES["op6_near_duplicates"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT DISTINCT a, a FROM twoway UNION SELECT r.a, e.b FROM reach r JOIN twoway e ON e.a = r.b),
roots AS (SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
"""


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.md5("text").alias("kept_md5"))


ORACLES["op3_line_dedup"] = r"""
WITH RECURSIVE raw AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, l[i] AS line, i - 1 AS line_no, array_to_string(list_filter(string_split(lower(replace(replace(l[i], chr(9), ' '), chr(13), ' ')), ' '),
    lambda x: x <> ''), ' ') AS norm FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM raw)),
able AS (SELECT * FROM lines WHERE length(norm) >= 30),
classes AS (SELECT norm, row_number() OVER (ORDER BY min(doc_id * 1000000 + line_no)) AS c, min(doc_id * 1000000 + line_no) AS rep FROM able GROUP BY norm),
sets AS (SELECT DISTINCT c, s FROM (SELECT c, substr(norm, unnest(range(1, length(norm) - 3)), 5) AS s FROM classes)),
sizes AS (SELECT c, count(*) AS n FROM sets GROUP BY 1),
-- A set's rarest fifth and one more must hold a shingle of any set that is similar enough.
freq AS (SELECT s, count(*) AS f FROM sets GROUP BY 1),
prefix AS (SELECT c, s, n FROM (SELECT c, s, n, row_number() OVER (PARTITION BY c ORDER BY f, s) AS k FROM sets JOIN freq USING (s) JOIN sizes USING (c))
    WHERE k <= n - ceil(0.8 * n) + 1),
pairs AS (SELECT DISTINCT a.c AS a, b.c AS b FROM prefix a JOIN prefix b ON a.s = b.s AND a.c < b.c AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
common AS (SELECT p.a, p.b, count(*) AS i FROM pairs p JOIN sets x ON x.c = p.a JOIN sets y ON y.c = p.b AND y.s = x.s GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.c = a JOIN sizes y ON y.c = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT DISTINCT a, a FROM twoway UNION SELECT r.a, e.b FROM reach r JOIN twoway e ON e.a = r.b),
roots AS (SELECT a AS c, min(b) AS root FROM reach GROUP BY 1),
firsts AS (SELECT k.norm, r.rep FROM classes k LEFT JOIN roots o ON o.c = k.c JOIN classes r ON r.c = coalesce(o.root, k.c)),
stays AS (SELECT l.doc_id, l.line_no, l.line, l.norm, length(l.norm) >= 30 AS able, f.rep IS NULL OR f.rep = l.doc_id * 1000000 + l.line_no AS kept
    FROM lines l LEFT JOIN firsts f ON f.norm = l.norm),
docs AS (SELECT doc_id, count(*) FILTER (able) AS n_lines, count(*) FILTER (NOT kept) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (kept), '') AS t FROM stays GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
    CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(t, '')) END AS kept_md5
FROM documents d LEFT JOIN docs USING (doc_id)
"""


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op5_decontaminate"] = r"""
WITH words AS (SELECT false AS item, doc_id AS id, text FROM documents UNION ALL SELECT true, item_id, text FROM benchmark),
split AS (SELECT item, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM words),
sets AS (SELECT DISTINCT item, id, array_to_string(w[i:i + 4], ' ') AS s FROM
    (SELECT item, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM sets WHERE item GROUP BY 1)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n)::INT AS n_item, count(*)::INT AS n_shared
FROM sets d JOIN sets b ON b.s = d.s AND b.item AND NOT d.item JOIN sizes z ON z.id = b.id GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * any_value(n)
"""


@query
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the texts labelled good."""
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    scored = lm_score.lm_scores(read(spark, sf_dir, "documents"), good)
    return scored.select("doc_id", "n_tokens", *[F.round(c, 5).alias(c) for c in ("target_loss", "background_loss", "difference")])


ORACLES["op7_lm_score"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
toks AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
vocab AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id FROM (SELECT word, count(*) AS n FROM toks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1023)),
size AS (SELECT count(*) + 1 AS v FROM vocab),
ids AS (SELECT doc_id, i, coalesce(id, 0) AS id FROM toks LEFT JOIN vocab USING (word)),
pairs AS (SELECT doc_id, id, coalesce(lag(id) OVER (PARTITION BY doc_id ORDER BY i), -1) AS prev FROM ids),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counts AS (SELECT prev, id, count(*) AS b, count(g.doc_id) AS t FROM pairs LEFT JOIN good g USING (doc_id) GROUP BY 1, 2),
prevs AS (SELECT prev, sum(b) AS b, sum(t) AS t FROM counts GROUP BY 1),
singles AS (SELECT id, (sum(b) + 1.0::DOUBLE) / ((SELECT sum(b) FROM counts) + v) AS b, (sum(t) + 1.0::DOUBLE) / ((SELECT sum(t) FROM counts) + v) AS t
    FROM counts, size GROUP BY id, v),
logs AS (SELECT c.prev, c.id, ln((c.b + 50.0::DOUBLE * s.b) / (p.b + 50.0::DOUBLE)) AS b, ln((c.t + 50.0::DOUBLE * s.t) / (p.t + 50.0::DOUBLE)) AS t
    FROM counts c JOIN prevs p USING (prev) JOIN singles s USING (id)),
losses AS (SELECT doc_id, count(*) AS n, -avg(t) AS t, -avg(b) AS b FROM pairs JOIN logs USING (prev, id) GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_tokens, round(t, 5) AS target_loss, round(b, 5) AS background_loss, round(t - b, 5) AS difference
FROM documents d LEFT JOIN losses USING (doc_id)
"""


@query
def op7_lm_score_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with models of every word."""
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    scored = lm_score.lm_scores(read(spark, sf_dir, "documents"), good, None)
    return scored.select("doc_id", "n_tokens", *[F.round(c, 5).alias(c) for c in ("target_loss", "background_loss", "difference")])


ORACLES["op7_lm_score_all_words"] = ORACLES["op7_lm_score"].replace(" ORDER BY 2 DESC, 1 LIMIT 1023", "")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; every seventh label is off by one."""
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = """
WITH base AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s
    FROM base a JOIN base b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id)::INT AS rank,
    vec_id AS negative_id, positive_score, s AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score
QUALIFY rank <= 10
"""


@query
def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages"))


@query
def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE against pieces; the groups of a document as a digest."""
    aligned = token_align.align_tokens(read(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return token_align.link_counts(aligned.withColumn("groups_sha256", digest).drop("groups"))
