"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless their Python path already leads to it."""
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if any(p and Path(p).resolve() == _ROOT for p in known) or getattr(spark.sparkContext, "_warden_sent", False):
        return
    path = Path(tempfile.mkdtemp()) / "warden.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((_ROOT / "warden").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._warden_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warden.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warden.llm.token_files import encode_and_read

    return encode_and_read(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warden.llm.pieces import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warden.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warden.llm.warc import archive_and_read

    found = archive_and_read(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warden.llm.ngram_join import linked

    return linked(table(spark, sf_dir, "documents"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warden.llm.language_id import predicted_languages

    return predicted_languages(table(spark, sf_dir, "documents"))


def toxic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warden.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warden.llm.license_notices import catalogue
    from warden.llm.licenses import TEMPLATES, Scanner, scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"), Scanner(catalogue(TEMPLATES)))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warden.llm.nearest import QUERY_STEP, nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warden.llm.ranked import search_texts

    return search_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warden.llm.chat import formatted_digests, with_control_conversation

    return formatted_digests(with_control_conversation(table(spark, sf_dir, "conversations")))


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from warden.llm.middle import digests

    return digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": language_id,
    "op2_best_fit_packing": packing,
    "op3_license_scans": license_scans,
    "op4_nearest_vectors": nearest_vectors,
    "op5_token_files": token_files,
    "op7_piece_offsets": pieces,
    "op6_toxicity": toxic_texts,
    "op8_warc": warc,
    "op9_ngram_join": ngram_join,
    "op10_fingerprints": fingerprints,
    "op11_lexical_search": lexical_search,
    "op12_chat_format": chat_format,
    "op13_fill_in_middle": fill_in_middle,
}
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What SQL can express; the others are held to brute force, round trips or held-out accuracy by tests.
ORACLES = {
    "op4_nearest_vectors": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
        u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
              WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.n * c.n) AS score
              FROM u q JOIN u c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op8_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM m""",
    "op11_lexical_search": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') AS t FROM documents),
        c AS (SELECT count(*) AS nn, CAST(sum(len(t)) AS BIGINT) AS ll FROM d WHERE len(t) > 0),
        p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS t FROM d) GROUP BY ALL),
        w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t, nn),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS t FROM benchmark),
        s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
              FROM q JOIN p USING (t) JOIN w USING (t), c GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
        WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10""",
    "op12_chat_format": """
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(i)),
        e AS (SELECT *, length(role || text) + 32 + length(role || text) - length(replace(role || text, chr(92), ''))
          + len(regexp_extract_all(role || chr(10) || text, '</?s>|\\[/?INST\\]|<</?SYS>>|<\\|(im_start|im_sep|im_end|endoftext|system|user|assistant'
            || '|end|begin_of_text|start_header_id|end_header_id|eot_id)\\|>|<(unk|pad|bos|eos|start_of_turn|end_of_turn)>')) AS n FROM c),
        g AS (SELECT conv_id, count(*) AS n_turns, CAST(sum(n) AS BIGINT) AS formatted_chars,
          string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
          coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss FROM e GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op13_fill_in_middle": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
              regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM documents),
        r AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
              CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
        c AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
              array_to_string(u[greatest(a, b) + 1:n], '') AS s FROM r)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
          CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c""",
    "op9_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
              '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) >= 5
              THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])
              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m, count(*) AS c FROM each a JOIN each b USING (shingle)
                 WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM pairs WHERE 100 * c >= 75 * (n + m - c)),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
        SELECT doc_id, len(s) AS n_shingles, component_id FROM sets
        JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)""",
}
