"""The training-data operators as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.find(docs, secrets.learn(docs)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    own = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), own.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_chats(turns))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embeddings

    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 5, 80)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.scan(docs, table(spark, sf_dir, "benchmark"), 10))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linededup

    return linededup.digest(linededup.find(table(spark, sf_dir, "documents").select("doc_id", "text"), least=linededup.LEAST))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), 1024)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.digest(substring.find(table(spark, sf_dir, "documents").select("doc_id", "text"), 13))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES = {f.__name__: f for f in (op1_secrets, op2_quality, op3_chat, op4_embeddings, op5_shards, op6_jaccard, op7_decontaminate, op8_lines, op9_pack, op10_substrings)}


def queries():
    return dict(QUERIES)


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_ALNUM = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_CTRL = "'(\\\\*)(### |</turn>)'"
#: links(a, b) -> the smallest id that each can reach
_REACH = ", ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), r AS (SELECT id, id c FROM ids UNION SELECT ends.b, r.c FROM r JOIN ends ON ends.a = r.id WHERE r.c < ends.b), comp AS (SELECT id, min(c) component FROM r GROUP BY 1) "


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can say the same; the scan for secrets, the classifier, hashing and packing have tests instead."""
    body = f"CASE WHEN text LIKE '%### %' OR text LIKE '%</turn>%' THEN regexp_replace(text, {_CTRL}, '\\\\\\1\\2', 'g') ELSE text END"
    return {
        "op3_chat": rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
            f AS (SELECT *, length('### ' || role || ': ' || {body} || chr(10) || '</turn>' || chr(10)) AS n FROM t)
            SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) loss_sha256, CAST(sum(n) AS BIGINT) formatted_chars FROM f GROUP BY 1""",
        "op4_embeddings": """WITH RECURSIVE v AS (SELECT vec_id id, label, CAST(embedding AS DOUBLE[]) x FROM embeddings), ids AS (SELECT id FROM v),
            links AS (SELECT p.id a, q.id b FROM v p JOIN v q ON p.label = q.label AND p.id < q.id WHERE list_cosine_similarity(p.x, q.x) >= 0.93)"""
        + _REACH
        + "SELECT v.id vec_id, (SELECT count(*) FROM ends WHERE a = v.id) n_links, component component_id, component = v.id kept FROM v JOIN comp USING (id)",
        "op6_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPACED.format(_LOW.format("coalesce(text, '')"))} w FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+least(5, len(w))-1], ' ') g FROM w, LATERAL (SELECT unnest(range(1, len(w) - least(5, len(w)) + 2)) i) WHERE len(w) > 0),
            n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1), ids AS (SELECT doc_id id FROM documents),
            o AS (SELECT p.doc_id a, q.doc_id b, count(*) o FROM s p JOIN s q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2),
            links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100*o >= 80*(x.n + y.n - o))"""
        + _REACH
        + "SELECT id doc_id, coalesce(n, 0) n_shingles, component component_id FROM comp LEFT JOIN n ON n.doc_id = id",
        "op7_decontaminate": f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) item, {_ALNUM.format(_LOW.format("coalesce(text, '')"))} w FROM benchmark),
            p AS (SELECT DISTINCT item, least(10, len(w)) m, array_to_string(w[i:i+least(10, len(w))-1], ' ') g FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) i) WHERE len(w) > 0),
            d AS (SELECT doc_id, {_ALNUM.format(_LOW.format("coalesce(text, '')"))} w FROM documents), ms AS (SELECT DISTINCT m FROM p),
            x AS (SELECT doc_id, i, m, array_to_string(w[i:i+m-1], ' ') g FROM d, ms, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) i)),
            h AS (SELECT doc_id, i, x.m, item FROM x JOIN p ON x.m = p.m AND x.g = p.g),
            k AS (SELECT doc_id, count(DISTINCT j) n_hit FROM h, LATERAL (SELECT unnest(range(i, i+m)) j) GROUP BY 1),
            q AS (SELECT doc_id, count(DISTINCT item) n_items, sha256(array_to_string(list_sort(list(DISTINCT item)), ',')) s FROM h GROUP BY 1)
            SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(s, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated FROM d LEFT JOIN k USING (doc_id) LEFT JOIN q USING (doc_id)""",
        "op8_lines": """WITH d AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END w FROM documents),
            z AS (SELECT *, list_transform(w, lambda y: greatest(len(regexp_extract_all(y, '[^\\x20\\x09-\\x0D]+')), strlen(y) // 8)) n FROM d WHERE len(w) > 0),
            x AS (SELECT doc_id, i, m, w[i:i+m-1] g FROM z, LATERAL (SELECT unnest(range(1, 4)) m) u, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) i) v WHERE m = 3 OR m = len(w) OR list_sum(n[i:i+m-1]) >= 8),
            f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) rn FROM x),
            k AS (SELECT doc_id, list(DISTINCT j) gone FROM f, LATERAL (SELECT unnest(range(i, i+m)) j) WHERE rn > 1 GROUP BY 1)
            SELECT doc_id, CAST(len(w) AS BIGINT) n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) n_removed, sha256(array_to_string(list_filter(w, lambda v, i: NOT list_contains(coalesce(gone, []), i)), chr(10))) kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
        "op10_substrings": f"""WITH d AS (SELECT doc_id, {_SPACED.format("coalesce(text, '')")} w FROM documents),
            x AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) i) WHERE len(w) > 12),
            f AS (SELECT *, min(doc_id) OVER (PARTITION BY g) first_doc FROM x),
            k AS (SELECT doc_id, list(DISTINCT j) gone FROM f, LATERAL (SELECT unnest(range(i, i+13)) j) WHERE first_doc < doc_id GROUP BY 1),
            e AS (SELECT doc_id, unnest(w) word, unnest(range(1, len(w)+1)) i FROM d),
            g AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) kept FROM e LEFT JOIN (SELECT doc_id, unnest(gone) i, true AS out FROM k) z ON z.doc_id = e.doc_id AND z.i = e.i WHERE z.out IS NULL GROUP BY 1)
            SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(len(gone), 0) AS BIGINT) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN g USING (doc_id)""",
    }
