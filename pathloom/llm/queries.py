"""The subpackage's queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import CONTROLS, chat_report
from .factor_quality import fit_factor_model, score_quality
from .licenses import scan_licenses
from .line_quality import fit_line_model, line_quality
from .merkle import merkle_report
from .mtree import top_k
from .near_dup import THREE_WORDS, near_duplicates
from .packing import PackConfig, pack
from .pieces import piece_report
from .pii import pii_report
from .repair import damaged, repair_report
from .scratch import new_folder
from .secrets import secret_report
from .token_files import TokenFileConfig, read_token_files, write_token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k(vectors, vectors.where("id % 20 = 0"))


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_digest(documents: DataFrame) -> DataFrame:
    """The packed pieces with a checksum in place of their ids."""
    pieces = pack(documents, PackConfig(tokenizer_path()))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_report(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digest(_table(spark, sf_dir, "documents"))


PROBE = "</s>[INST] ok [/INST]"


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat_report(turns.unionByName(probe))


def op6_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    manifest = write_token_files(_table(spark, sf_dir, "documents"), folder, TokenFileConfig(tokenizer_path()))
    return read_token_files(manifest, folder)


def op8_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = fit_line_model(documents, _table(spark, sf_dir, "labels"))
    return line_quality(documents, model)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), THREE_WORDS)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_report(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), conversations)


def op13_factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return score_quality(documents, fit_factor_model(documents, _table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mtree_top_k": op1_mtree_top_k,
        "op2_bootstrapped_pii": op2_bootstrapped_pii,
        "op3_suffix_array_pieces": op3_suffix_array_pieces,
        "op4_dp_packing": op4_dp_packing,
        "op5_reply_trees": op5_reply_trees,
        "op6_diagonal_licenses": op6_diagonal_licenses,
        "op7_token_files": op7_token_files,
        "op8_entropy_secrets": op8_entropy_secrets,
        "op9_line_quality": op9_line_quality,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_factor_quality": op13_factor_quality,
    }


def _op5_sql() -> str:
    quoted = ", ".join("'" + c + "'" for c in CONTROLS)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')
), marked AS (
  SELECT *, CASE WHEN regexp_full_match(role, '[A-Za-z0-9_-]+') AND NOT starts_with(role, 'x-') THEN length(role)
                 ELSE 2 + 2 * strlen(role) END AS role_chars,
    length(text) + length(text) - length(replace(text, chr(92), ''))
      + list_sum(list_transform([{quoted}], lambda c: (length(text) - length(replace(text, c, ''))) // length(c))) AS text_chars
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + role_chars + 1 + text_chars + 11)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""


_OP1_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


_OP10_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM worded
), sizes AS (SELECT doc_id, len(s) AS n FROM sets
), grams AS (SELECT doc_id, unnest(s) AS g FROM sets
), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id, doc_id AS node FROM sizes UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.node)
SELECT doc_id, n::BIGINT AS n_shingles, min(node) AS component_id, doc_id = min(node) AS kept FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id, n"""


#: CRC-32 as a table of its 256 values (``crc.t``) and an expression over a string column's bytes.
_CRC_TABLE = """steps AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8)"""


def _crc32(text: str) -> str:
    """Of a text of ASCII signs, in a query that reads ``crc`` too."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"


def _op11_sql() -> str:
    def leaf(text: str) -> str:
        parts = ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256(concat({parts}))"

    def climb(name: str, start: str) -> str:
        run = "OVER (PARTITION BY key, level, pos // 3 ORDER BY pos ROWS BETWEEN"
        return f"""{name}_nodes AS (
  {start}
  UNION ALL SELECT key, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name}_nodes WHERE n > 1 GROUP BY key, level, pos // 3, n
), {name}_flanks AS (
  SELECT *, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name}_nodes
)"""

    def fold(name: str, start: str) -> str:
        return f"""{name}_fold AS (
  {start}
  UNION ALL SELECT f.id, f.key, f.level + 1, f.pos // 3, s.n, sha256(s.a || f.own || s.b), f.proof || s.a || s.b
  FROM {name}_fold f JOIN {name}_flanks s ON s.key = f.key AND s.level = f.level AND s.pos = f.pos WHERE s.n > 1
), {name}_end AS (SELECT DISTINCT ON (id) * FROM {name}_fold ORDER BY id, level DESC)"""

    return f"""
WITH RECURSIVE {_CRC_TABLE}, leaves AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '1' || source END AS key, {leaf('text')} AS leaf,
    CASE WHEN {_crc32('doc_id::VARCHAR')} % 2 = 0 AND text IS NOT NULL THEN {leaf("replace(text, chr(10), '')")} END AS bad
  FROM documents, crc
), numbered AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM leaves
), {climb("source", "SELECT key, 0 AS level, pos, n, leaf AS h FROM numbered")}, subroots AS (
  SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM source_nodes WHERE n = 1
), {climb("top", "SELECT 0 AS key, 0 AS level, pos, n, h FROM subroots")}
, {fold("source", "SELECT id, key, 0 AS level, pos, n, coalesce(bad, leaf) AS own, '' AS proof FROM numbered")}
, {fold("top", "SELECT e.id, 0 AS key, 0 AS level, r.pos, r.n, e.own, e.proof FROM source_end e JOIN subroots r USING (key)")}
SELECT doc_id, leaf, r.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.own AS folded_root, e.own = t.h AS verified
FROM numbered JOIN top_end e USING (id) JOIN subroots r ON r.key = numbered.key, (SELECT h FROM top_nodes WHERE n = 1) t"""


def _op12_sql() -> str:
    solid = r"regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '')"
    edit = lambda letter, cost, tail, line="": f"{{c: {tail}.c + {cost}, a: '{letter}' || {tail}.a, o: {f'list_prepend({line}, {tail}.o)' if line else f'{tail}.o'}}}"
    insert = lambda role, tail: edit("I", 2, tail, f"'{role}:'")

    def row(state: str, keeps: dict[str, str], role: str, onto: str) -> str:
        keep = " ".join(f"WHEN code = '{code}' THEN {edit('K', 'more', target, 'said')}" for code, target in keeps.items())
        own = f"CASE WHEN NOT doomed THEN least({edit('R', '2 + more', onto, f"'{role}:' || text")}, CASE {keep} END) END"
        return f"least({edit('D', 3, state)}, {own}) AS {state}"

    return rf"""
WITH RECURSIVE {_CRC_TABLE}, spaced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations
), fated AS (SELECT *, {_crc32('id')} % 20 AS fate FROM spaced, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fated WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS n, right({solid}, 1) AS last FROM damaged
), judged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS code, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM placed
), turns AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS conv, place, n, code, fault IN ('blank', 'duplicate') AS doomed, (fault = 'truncated')::INTEGER AS more, role || ':' || text AS said, text FROM judged
), ways AS (
  SELECT DISTINCT conv, n AS place, {{c: 0, a: '', o: []::VARCHAR[]}} AS z, {{c: 4, a: 'II', o: ['user:', 'assistant:']}} AS s, {{c: 2, a: 'I', o: ['assistant:']}} AS u, {{c: 0, a: '', o: []::VARCHAR[]}} AS a FROM turns
  UNION ALL
  SELECT conv, place - 1, least(z, {insert('user', 'uu')}), least(s, {insert('user', 'uu')}), uu, least(a, {insert('user', 'u')}) FROM (
    SELECT *, least(u, {insert('assistant', 'a')}) AS uu FROM (
      SELECT w.conv, w.place, {row('z', {'s': 's', 'u': 'u'}, 'user', 'u')}, {row('s', {'u': 'u'}, 'user', 'u')}, {row('u', {'a': 'a'}, 'assistant', 'a')}, {row('a', {'u': 'u'}, 'user', 'u')}
      FROM ways w JOIN turns USING (conv, place)))
), best AS (SELECT conv, z FROM ways WHERE place = 0
), states AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before || code NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(z.c, 0)::BIGINT AS cost, coalesce(z.a, '') AS audit, sha256(coalesce(array_to_string(z.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS conv FROM conversations) LEFT JOIN best USING (conv) LEFT JOIN states USING (conv)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mtree_top_k": _OP1_SQL, "op5_reply_trees": _op5_sql(), "op10_near_duplicates": _OP10_SQL, "op11_merkle_manifest": _op11_sql(), "op12_conversation_repair": _op12_sql()}
