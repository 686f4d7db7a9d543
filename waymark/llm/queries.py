"""The registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .language_id import identify
from .line_dedup import dedup_lines
from .media import audio_features, padded, wav
from .mixing import mix_sources
from .ngram_join import near_duplicates
from .periodic import periodic_runs
from .prefix_trie import label_turns, prefix_trie, rebuild
from .quality import classify_quality
from .toxicity import tag_toxicity
from .token_counts import count_tokens
from .url_filter import filter_urls

#: The rules (host, then path) and what each does.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    found = dedup_lines(table(spark, sf_dir, "documents"), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


def op2_exact_dedup(spark, sf_dir):
    found = exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op3_language_id(spark, sf_dir):
    found = identify(table(spark, sf_dir, "documents"), ~held_out(F.col("id"), 4, 2))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op4_ngram_join(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


def op5_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    found = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return found.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def op6_toxicity(spark, sf_dir):
    found = tag_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(F.col("id"), 4, 2))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 4, 2).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op7_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op8_token_counts(spark, sf_dir):
    found = count_tokens(table(spark, sf_dir, "documents"), ["text"])
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.size("sections").cast("long").alias("n_sections"), "n_crossing", F.array_max("sections.tokens").alias("most_in_section"), F.to_json("sections").alias("sections"))


def op9_mixing(spark, sf_dir):
    found = mix_sources(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op10_quality(spark, sf_dir):
    found = classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(F.col("id"), 3, 1))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 3, 1).alias("held_out"), "score", "predicted")


def op11_prefix_trie(spark, sf_dir):
    turns = label_turns(table(spark, sf_dir, "conversations"))
    names = turns.select("conv_id").distinct()
    found = prefix_trie(rebuild(turns, names), names)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _looped(doc_id: Column, text: Column) -> Column:
    """The text; where crc32 of the id is a multiple of 10, the words from one on are a loop of the first of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def loop(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(words, lambda x, i: F.when(i < a, x).otherwise(F.get(words, a + (i - a) % p))), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return F.when((h % 10 == 0) & (F.size(words) > 0), F.element_at(F.transform(F.array(words), loop), 1)).otherwise(text)


def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", _looped(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.sign(y["length"] - x["length"])).when(x["start"] != y["start"], F.sign(x["start"] - y["start"])).otherwise(F.sign(x["period"] - y["period"])).cast("int"))
    found = found.withColumn("best", F.get(best, F.lit(0)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_media_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stored = docs.select(F.struct("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")).alias("row"), wav(padded(F.col("text"))).alias("media"))
    stored = stored.withColumn("row", F.struct("row.*", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")))
    found = audio_features(stored, "row", "media")
    return found.select(
        "id.doc_id", "id.n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), "id.media_bytes", "id.media_sha256", "feature",
    )


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_exact_dedup, op3_language_id, op4_ngram_join, op5_url_filter,
    op6_toxicity, op7_decontamination, op8_token_counts, op9_mixing, op10_quality,
    op11_prefix_trie, op12_periodic_runs, op13_media_columns,
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ORACLE = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT keyed.*, keeper IS NOT NULL AND doc_id <> keeper AS dropped FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op2_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op4_ngram_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT node, b FROM r JOIN e ON a = reach),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM d JOIN m ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.a = d.doc_id""",
    "op5_url_filter": r"""
WITH rules(rh, rp, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h0, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
q AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
m AS (SELECT q.*, rh || rp AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS rn
  FROM q LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE rn = 1""",
    "op7_decontamination": r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, wins.n AS n, item_id FROM dwin JOIN wins ON dwin.win = wins.win AND dwin.n = wins.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_prefix_trie": r"""
WITH RECURSIVE t AS (
  SELECT conv_id, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS label, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, label, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, label) - 1 AS pos FROM t),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base FROM o),
-- crc32, a byte at a time
k AS (
  SELECT conv_id, base, 1 AS i, 4294967295::BIGINT AS crc FROM c
  UNION ALL
  SELECT conv_id, base, i + 1, list_reduce(list_concat([xor(crc, ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)], list_transform(range(8), lambda x: x::BIGINT)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384))
  FROM k WHERE i <= length(conv_id::VARCHAR)),
h AS (SELECT conv_id, base, xor(crc, 4294967295) % 4 AS h FROM k WHERE i = length(conv_id::VARCHAR) + 1),
r AS (
  SELECT h.conv_id, 0 AS part, pos, label, words FROM h JOIN o ON o.conv_id = base AND pos < h
  UNION ALL
  SELECT h.conv_id, 1, pos, label, words FROM h JOIN o ON o.conv_id = h.conv_id AND pos >= h),
s AS (SELECT conv_id, list(label ORDER BY part, pos) AS l, list(words ORDER BY part, pos) AS w FROM r GROUP BY conv_id),
a AS (SELECT h.conv_id, coalesce(l, []) AS l, coalesce(w, []) AS w FROM h LEFT JOIN s USING (conv_id)),
p AS (SELECT conv_id, d AS depth, l[1:d] AS node, CASE WHEN d > 0 THEN l[1 : d - 1] END AS up, w[d] AS words, d = len(l) AS last FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM a)),
n AS (SELECT node, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce((count(*) - 1) * any_value(words), 0) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY node),
kids AS (SELECT up, count(*) AS n_children FROM n GROUP BY up),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.up = n.node),
sums AS (SELECT node[1:j] AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS j FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN sums USING (node) LEFT JOIN n u ON u.node = m.up""",
}


def oracle() -> dict[str, str]:
    return dict(_ORACLE)
