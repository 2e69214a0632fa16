"""The corpus operators as registered queries, and the same results in DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabtrace.llm import (
    bpe, chat, decontaminate, exact, language, lines, near, passages, phrases, quality, spelling, tokens, warc,
)
from fabtrace.llm.common import held_out
from fabtrace.sources.scratch import new_path
from fabtrace.sources.tables import read_table


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    back = chat.read_back(chat.format_chats(chat.log_of(rows.unionByName(extra))))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.array_size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = language.learn(docs.where(~held_out(F.col("doc_id"))))
    found = docs.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        language.predict(F.col("text"), prototypes, spark).alias("found"),
    )
    return found.select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )


def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    field = quality.learn(docs, labels)
    scored = docs.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        quality.predict(F.col("text"), field, spark).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= quality.GOOD_FROM).cast("int"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    benchmark = read_table(spark, sf_dir, "benchmark")
    blocks = decontaminate.blocks_of(decontaminate.windows_of(benchmark))
    found = docs.select("doc_id", decontaminate.find(F.col("text"), blocks).alias("found"))
    return found.select("doc_id", "found.*")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.mark(docs, carry=["doc_id"]).select(
        "row.doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.mark(docs).select(
        "row.doc_id",
        "n_lines",
        "n_removed",
        "removed",
        F.char_length("kept_text").cast("long").alias("kept_chars"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.mark(docs).select(
        "row.doc_id",
        "n_units",
        "n_removed",
        "removed_words",
        "in_passages",
        "kept_in",
        "kept",
        F.char_length("kept_text").cast("long").alias("kept_chars"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near.mark(docs).select("row.doc_id", "class_id", "class_size", "kept")


WORD_TOKENIZER, WORD_IDS, END_ID = "word_bpe_49k.json", 49_408, 1
BYTE_TOKENIZER = "byte_bpe_50k.json"


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = tokens.load(spark, public_tokenizers.path(WORD_TOKENIZER))
    path = new_path(spark, "token-files")
    ids = tokens.tokenize(F.col("text"), tokenizer, END_ID)
    tokens.write(docs.select(F.col("doc_id").alias("id"), ids.alias("ids")), path, WORD_IDS)
    return tokens.read(spark, path).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = bpe.load(spark, public_tokenizers.path(BYTE_TOKENIZER))
    encoded = docs.select("doc_id", bpe.encode(F.col("text"), tokenizer).alias("ids"))
    return encoded.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), tokenizer).cast("binary"), 256).alias("decoded_sha256"),
    )


def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # A slip only shortens a run, so shorter ones never become a word.
    runs = spelling.runs(docs, least_chars=spelling.LEAST_CHARS)
    return spelling.variants(spelling.vocabulary(spelling.with_slips(runs)))


def web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.payloads(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    path = new_path(spark, "archives")
    warc.write(warc.with_revisits(found), path)
    back = warc.pages(warc.read(spark, path), id_type="long")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_chat_format": chat_format,
    "op2_language_id": language_id,
    "op3_line_quality": line_quality,
    "op4_decontamination": decontamination,
    "op5_token_files": token_files,
    "op6_exact_dedup": exact_dedup,
    "op7_line_dedup": line_dedup,
    "op8_passage_dedup": passage_dedup,
    "op9_near_dedup": near_dedup,
    "op10_bpe_round_trip": bpe_round_trip,
    "op11_phrase_mining": phrase_mining,
    "op12_spelling_variants": spelling_variants,
    "op13_web_archive": web_archive,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE_SQL = {
    "op1_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        t AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS said,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
                   sum(17 + length(role) + length(text)
                       + len(regexp_extract_all(role || chr(10) || text, '[<\[]\\*(/INST\]|INST\]|/s>)'))) AS n
            FROM c GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars,
               sha256(learned) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars
        FROM t
    """,
    "op4_decontamination": f"""
        WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        i AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS m,
                   array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS g FROM i
        ),
        d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        lengths AS (SELECT DISTINCT m FROM windows),
        grams AS (
            SELECT r, m, p, array_to_string(w[p:p + m - 1], ' ') AS g
            FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, lengths WHERE len(w) >= m)
        ),
        hits AS (SELECT r, item_id, p, m FROM grams JOIN windows USING (m, g)),
        hit_words AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + m)) AS q FROM hits) GROUP BY r),
        items AS (
            SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS names
            FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY r
        )
        SELECT doc_id, len(w) AS n_words, coalesce(hit_words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256,
               coalesce(hit_words.n, 0) > 0 AND 20 * coalesce(hit_words.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit_words USING (r) LEFT JOIN items USING (r)
    """,
    "op6_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
    "op11_phrase_mining": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
        runs AS (SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS k FROM places),
        f AS (SELECT lang, w[i:i + k - 1] AS p, k, count(*) AS f FROM runs GROUP BY ALL),
        totals AS (SELECT lang, count(*) AS n FROM places GROUP BY ALL),
        candidates AS (SELECT lang, p, k, f AS a FROM f WHERE k > 1 AND f >= 30),
        cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
        scores AS (
            SELECT c.lang, c.p, c.k, c.a, cut, x.f AS l, y.f AS r,
                   CAST(2000000 AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) + y.f) AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:cut]
                        JOIN f y ON y.lang = c.lang AND y.p = c.p[cut + 1:c.k]
        ),
        weakest AS (
            SELECT * FROM scores
            QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
        ),
        inner_runs AS (
            SELECT DISTINCT lang, s.a AS longer, s.p[j:j + m - 1] AS p FROM (
                SELECT lang, p, k, a, m, unnest(range(1, k - m + 2)) AS j
                FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates)
            ) s
        ),
        dropped AS (
            SELECT DISTINCT w.lang, w.p FROM weakest w JOIN inner_runs i ON i.lang = w.lang AND i.p = w.p
            WHERE CAST(100 AS HUGEINT) * i.longer >= CAST(80 AS HUGEINT) * w.a
        ),
        ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
                   array_to_string(p, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score
            FROM weakest ANTI JOIN dropped USING (lang, p)
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op13_web_archive": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ),
        s AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
        FROM s
    """,
}
