"""One query per operator over its whole table, each with its check SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import (bit_slices, chosen_path, crc_resample, deobfuscate, importance_resample, kneser_ney, language_bits, packing,
                           personal_data, quality_trees, source_mix, style_tree, wu_manber)
from gradeloom.llm.frames import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn
    return add


def fold(divisor: int, out: int):
    """True for rows whose crc32 remainder is ``out``; rows without id are held in."""
    return F.coalesce(remainder(F.col("doc_id"), divisor) == out, F.lit(False))


MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
                  sum(source_size) OVER () * 1.5 AS wanted FROM per),
filled AS (SELECT *, coalesce(sum(2 * source_size) OVER w, 0) AS used, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS free
           FROM ranked WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((wanted - used)::DOUBLE / free) FILTER (WHERE (wanted - used)::DOUBLE / free <= 2.0 * source_size / weight) AS top FROM filled),
goals AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, coalesce(top, 0) * weight) AS target FROM ranked, level),
rated AS (SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate
          FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       (size * (floor(rate)::BIGINT + (('0x' || substr(md5('mix-1:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate))::BIGINT))::BIGINT AS taken
FROM rated
"""


@query("op4_mix_sources", MIX_SQL)
def mix_sources(spark, sf_dir):
    """Sources mixed to target weights; ``target`` is rounded to three places."""
    mix = source_mix.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


LEAK_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
                 FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
                FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM words, sizes WHERE len(w) >= n)),
found AS (SELECT d.doc_id, d.k, d.n, i.item_id FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.win = i.win),
hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op5_benchmark_windows", LEAK_SQL)
def benchmark_windows(spark, sf_dir):
    """Occurrences of windows of benchmark items in every document."""
    found = wu_manber.find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op8_near_copies")
def near_copies(spark, sf_dir):
    """Class, links to other shingle sets and copies of the own set, of every document."""
    return chosen_path.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


@query("op10_language")
def language(spark, sf_dir):
    """Language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(4, 2))
    model = language_bits.fit(docs.where(~F.col("held_out")))
    return language_bits.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op1_personal_data")
def find_personal_data(spark, sf_dir):
    """Personal data of every document: counts and digest of the fixed patterns, and all spans."""
    field = personal_data.train(personal_data.labelled_table(spark))
    found = personal_data.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"), field)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in personal_data.KINDS],
                        F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op6_text_score")
def text_score(spark, sf_dir):
    """Log probabilities of every text under a model of the training fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", fold(7, 2).alias("held_out"))
    model = kneser_ney.count_model(docs.where(~F.col("held_out")))
    return kneser_ney.score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
                                                "base_score", "score", "perplexity")


@query("op7_toxicity")
def toxicity(spark, sf_dir):
    """Toxicity of every document, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", fold(4, 2).alias("held_out"))
    model = deobfuscate.train(docs.where(~F.col("held_out")).select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return deobfuscate.score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op9_main_text")
def main_text(spark, sf_dir):
    """Main text of every page."""
    found = style_tree.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op2_importance_resample")
def importance_sample(spark, sf_dir):
    """Importance weights of every document towards texts labelled good, and the Gumbel top-k sample."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = importance_resample.log_ratios(docs, table(spark, sf_dir, "labels"))
    scored = importance_resample.weighed(docs, ratios).select("doc_id", "n_grams", "log_ratio", "gumbel_key")
    return importance_resample.gumbel_top(scored)


@query("op3_quality_rules")
def quality_rules(spark, sf_dir):
    """Statistics, base rules and the forest's verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_trees.judge(docs, quality_trees.train(docs, table(spark, sf_dir, "labels")))
    failed = quality_trees.base_failed()
    return judged.select("doc_id", *quality_trees.COUNTS, failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality")


@query("op12_pack_sequences")
def pack_sequences(spark, sf_dir):
    """Pieces of all documents packed into sequences of at most 2048 ids."""
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


CRC_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
target_words AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
runs AS (SELECT unnest([1, 2, 3]) AS k),
raw AS (SELECT doc_id, array_to_string(w[p:p + k - 1], ' ') AS feature FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM words, runs)),
target AS (SELECT array_to_string(w[p:p + k - 1], ' ') AS feature FROM (SELECT w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM target_words, runs)),
features AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT feature FROM raw UNION SELECT feature FROM target)),
hashed AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(generate_series(1, len(h) // 2), lambda i: ('0x' || h[2 * i - 1:2 * i])::BIGINT)),
             lambda state, byte: xor(state >> 8, list_reduce([xor(state, byte) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, step: xor(x >> 1, 3988292384 * (x & 1))))),
             4294967295) % 10000 AS bucket FROM features),
raw_counts AS (SELECT bucket, count(*) AS s FROM raw JOIN hashed USING (feature) GROUP BY bucket),
target_counts AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (feature) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM raw) + 10000)::DOUBLE)
                                   / ((s + 1)::DOUBLE * ((SELECT count(*) FROM target) + 10000)::DOUBLE)))::BIGINT AS gain FROM raw_counts LEFT JOIN target_counts USING (bucket)),
sums AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM raw JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT)::BIGINT AS score
           FROM words LEFT JOIN sums USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM ranked
"""


@query("op13_crc_resample", CRC_SQL)
def crc_resampled(spark, sf_dir):
    """Features, importance weight and score of every document, and the rank of the drawn ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = crc_resample.weighed(docs, crc_resample.gains(docs, table(spark, sf_dir, "benchmark")))
    return crc_resample.drawn(scored).select("doc_id", "n_features", "weight", "score", "rank")


RANK_SQL = r"""
WITH doc_terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
item_terms AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
counts AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS held FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, totals GROUP BY term, docs),
spread AS (SELECT doc_id, 50 + (50 * n * docs) // held AS m FROM sizes, totals),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
           FROM item_terms JOIN counts USING (term) JOIN weights USING (term) JOIN spread USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored
WHERE score > 0 QUALIFY rank <= 50
"""


@query("op11_lexical_search", RANK_SQL)
def lexical_search(spark, sf_dir):
    """The 50 best documents of every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bit_slices.search(bit_slices.build_index(docs), docs, table(spark, sf_dir, "benchmark"))
