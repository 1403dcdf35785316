"""Queries of the training-data operators and their SQL statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from custlens.llm import (alignment, ann, backoff_lm, chat, exact_dedup, mixing, packing, pii, prefix_trie, quality, simhash,
                          substring, toxicity)
from custlens.llm.common import read

_PROBE = "</s>[INST] ok [/INST]"  # a text made of control strings


def q_toxicity(spark, d):
    return toxicity.toxicity_scores(read(spark, d, "documents"), read(spark, d, "labels"))


def q_quality(spark, d):
    return quality.quality_scores(read(spark, d, "documents"), read(spark, d, "labels"))


def q_packing(spark, d):
    import public_tokenizers

    pieces = packing.pack(read(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def q_nearest(spark, d):
    return ann.nearest(read(spark, d, "embeddings"), k=5, is_query=F.col("vec_id") % 50 == 0)


def q_exact_dedup(spark, d):
    return exact_dedup.exact_duplicates(read(spark, d, "documents"), keep="max")


def q_substring(spark, d):
    out = substring.drop_repeated_windows(read(spark, d, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def q_simhash(spark, d):
    found = simhash.near_duplicates(read(spark, d, "documents"), shingle=3, bits=3)
    return found.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def q_mixing(spark, d):
    return mixing.schedule(read(spark, d, "documents"))


def q_chat(spark, d):
    given = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"""SELECT * FROM VALUES (-7L, 0L, 'user', '{_PROBE}'), (-7L, 1L, 'assistant', '{_PROBE}')
                          AS t(conv_id, turn, role, text)""")
    messages = given.unionByName(probe).withColumn("parts", chat.text_part("text"))
    out = chat.format_conversations(messages).select("conv_id", "formatted", chat.read_turns("formatted").alias("turns"),
                                                     chat.loss_text("segments").alias("loss"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                      digest(F.array_join(F.transform("turns", line), "")).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


def q_pii(spark, d):
    found = pii.personal_data(read(spark, d, "documents"))
    of = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    count = [of(n).alias(f"n_{k}") for n, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *count,
                        F.sha2(pii.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.spans_text(F.array_sort(F.concat("base", "learned"))).alias("spans"))


def q_backoff_lm(spark, d):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    # pairs of words: with triples the requests pass the disk that the check grants
    return backoff_lm.scores(read(spark, d, "documents"), held, order=2)


def q_prefix_trie(spark, d):
    # a conversation branches off another after its first few turns
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    rows, convs = prefix_trie.branched(read(spark, d, "conversations"), head, F.col("conv") - F.pmod("conv", F.lit(5)))
    return prefix_trie.prefix_trie(rows, convs)


def q_alignment(spark, d):
    import public_tokenizers

    return alignment.cross_tokenizer_links(read(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                           public_tokenizers.path("piece_bpe_32k.model"))


def queries():
    return {
        "op1_toxicity": q_toxicity,
        "op2_packing": q_packing,
        "op3_nearest": q_nearest,
        "op4_exact_dedup": q_exact_dedup,
        "op5_substring": q_substring,
        "op6_mixing": q_mixing,
        "op7_simhash": q_simhash,
        "op8_quality": q_quality,
        "op9_chat": q_chat,
        "op10_pii": q_pii,
        "op11_backoff_lm": q_backoff_lm,
        "op12_prefix_trie": q_prefix_trie,
        "op13_alignment": q_alignment,
    }


# SQL's lower() folds more than A-Z; translate() does exactly those 26 letters
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql():
    return {
        "op4_exact_dedup": f"""WITH d AS (SELECT doc_id, {_ASCII_LOWER} AS t FROM documents),
            g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
        "op5_substring": """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
            p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
            g AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN array_to_string(w[i:i + 49], ' ') END AS win FROM p),
            f AS (SELECT win, min(doc_id) AS first FROM g WHERE win IS NOT NULL GROUP BY win),
            c AS (SELECT g.doc_id, i, word, max(CASE WHEN first < g.doc_id THEN 1 ELSE 0 END) OVER
                         (PARTITION BY g.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
                  FROM g LEFT JOIN f USING (win)),
            k AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
                         string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
            SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
                   sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)""",
        "op9_chat": f"""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
                SELECT conv_id, turn, role, text FROM conversations UNION ALL
                SELECT -7, 0, 'user', '{_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{_PROBE}')),
            e AS (SELECT *, length('<s>[INST][/INST]</s>') + length(role) + length(text)
                     + len(regexp_extract_all(role, '{chat.CONTROL}')) + len(regexp_extract_all(text, '{chat.CONTROL}')) AS n FROM m)
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
                   CAST(sum(n) AS BIGINT) AS formatted_chars
            FROM e GROUP BY conv_id""",
    }
