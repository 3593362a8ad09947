"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm import chat, decontaminate, exact, jaccard, licenses, lmscore, packing, quality, repeats, sharding

SHARDS = 24


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), SHARDS)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: A conversation whose texts look like control strings, as (conv_id, turn, role, text).
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return chat.format_conversations(rows.unionByName(probe), sink="digest")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), payload="ids_crc32")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), sink="digest")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lmscore.score(_table(spark, sf_dir, "documents"), wanted)


#: The documents as a tree of files, in the terms of both engines: every third is a licence file, at one of four levels.
_TREE = ["source", "lang", "'m' || doc_id % 16", "'s' || doc_id % 5"]
FILE_PATH = f"""CASE WHEN doc_id % 3 = 0 THEN CASE doc_id % 4 WHEN 0 THEN concat_ws('/', {_TREE[0]}, 'LICENSE.' || doc_id) WHEN 1 THEN concat_ws('/', {', '.join(_TREE[:2])}, 'LICENSE.' || doc_id)
  WHEN 2 THEN concat_ws('/', {', '.join(_TREE[:3])}, 'LICENSE.' || doc_id) ELSE concat_ws('/', {', '.join(_TREE)}, 'LICENSE.' || doc_id) END ELSE concat_ws('/', {', '.join(_TREE)}, doc_id || '.txt') END"""


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), "doc_id", F.expr(FILE_PATH))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "longest_match")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_quality, op3_chat, op4_packing, op5_jaccard, op6_recompression, op7_lm_scoring, op8_license_scans, op9_exact_dedup, op10_decontamination)}

# ---- the same in SQL, where SQL can ---------------------------------------------------------------------

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


def _escaped_length(x: str) -> str:
    """Length of an escaped text: a backslash more for each backslash and each control string."""
    controls = "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in chat.CONTROLS)
    return rf"length({x}) + length(regexp_extract_all({x}, '{controls}|\\'))"


def _licence_sql() -> str:
    """Weights from the templates' texts; every line, sentence and run of terms against every template, without a first look."""
    texts = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(licenses.TEMPLATES))
    common = ", ".join(f"'{t}'" for t in sorted(licenses.COMMON))
    prose = ", ".join(f"'{t}'" for t in sorted(licenses.PROSE))
    quoted = licenses.SENTENCE.replace("'", "''")
    terms = f"list_filter(regexp_extract_all(lower({{}}), '{licenses.TERM}'), lambda t: NOT list_contains([{common}], t))"
    return rf"""WITH templates(template, license, text) AS (VALUES {texts}),
      tterms AS (SELECT template, term, count(*) AS tf FROM (SELECT template, unnest({terms.format('text')}) AS term FROM templates) GROUP BY ALL),
      idf AS (SELECT term, ln((1 + (SELECT count(*) FROM templates)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tterms GROUP BY term), rare AS (SELECT ln(1.0::DOUBLE + count(*)) + 1 AS other FROM templates),
      tnorms AS (SELECT template, sqrt(sum(tf * idf * tf * idf)) AS norm, sum(tf) AS size FROM tterms JOIN idf USING (term) GROUP BY template),
      weights AS (SELECT template, term, tf * idf / norm * idf AS weight, size FROM tterms JOIN idf USING (term) JOIN tnorms USING (template)),
      files AS (SELECT doc_id, text, {FILE_PATH} AS path FROM documents),
      held AS MATERIALIZED (SELECT DISTINCT doc_id, unit FROM (SELECT doc_id, unnest(string_split(text, chr(10)) || string_split(regexp_replace(regexp_replace(text, '{quoted}', '' || chr(30) || '', 'g'), '{licenses.PARAGRAPH}', chr(30), 'g'), chr(30))) AS unit FROM files)),
      units AS MATERIALIZED (SELECT unit, terms FROM (SELECT unit, {terms.format('unit')} AS terms FROM (SELECT DISTINCT unit FROM held)) WHERE list_has_any(terms, (SELECT list(term) FROM idf))),
      runs AS (SELECT unit, size, list_slice(terms, p, p + size - 1) AS run FROM (SELECT unit, terms, size, unnest(range(1, len(terms) - size + 2)) AS p FROM units, (SELECT DISTINCT size::BIGINT AS size FROM tnorms) WHERE len(terms) > size)),
      tried AS MATERIALIZED (SELECT row_number() OVER () AS k, * FROM (SELECT unit, NULL::BIGINT AS size, terms AS run FROM units UNION ALL SELECT unit, size, run FROM runs WHERE list_has_any(run, (SELECT list(term) FROM idf)))),
      counted AS (SELECT k, size, term, count(*) AS tf FROM (SELECT k, size, unnest(run) AS term FROM tried) GROUP BY ALL),
      norms AS (SELECT k, sqrt(sum(tf * coalesce(idf, other) * tf * coalesce(idf, other))) AS norm FROM counted LEFT JOIN idf USING (term), rare GROUP BY k),
      dots AS (SELECT k, template, sum(tf * weight) AS dot FROM counted c JOIN weights w ON c.term = w.term AND (c.size IS NULL OR c.size = w.size) GROUP BY ALL HAVING count(*) > 1 AND count(CASE WHEN NOT list_contains([{prose}], c.term) THEN 1 END) > 0),
      scored AS (SELECT unit, template, max(score) AS score FROM (SELECT unit, template, round(dot / norm, 6) AS score FROM dots JOIN norms USING (k) JOIN tried USING (k)) WHERE score >= {licenses.THRESHOLD} GROUP BY ALL),
      own AS MATERIALIZED (SELECT doc_id, license AS own_license, score AS own_score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) AS rn FROM held JOIN scored USING (unit) JOIN templates USING (template)) WHERE rn = 1),
      declared AS MATERIALIZED (SELECT spot, arg_min(own_license, path) AS declared FROM (SELECT path, own_license, regexp_replace(path, '/[^/]*$', '') AS spot FROM files JOIN own USING (doc_id) WHERE regexp_matches(path, '{licenses.LICENSE_FILE}')) GROUP BY spot),
      nearest AS (SELECT doc_id, arg_max(spot, length(spot)) AS spot, arg_max(declared, length(spot)) AS declared FROM files JOIN declared ON starts_with(path, spot || '/') GROUP BY doc_id)
      SELECT f.doc_id, f.path, own_license, own_score, coalesce(own_license, declared) AS license, CASE WHEN own_license IS NULL THEN spot END AS inherited_from FROM files f LEFT JOIN own USING (doc_id) LEFT JOIN nearest USING (doc_id)"""


_SHINGLES = f"""words AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_SPACED}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.seen FROM reach r JOIN edges e ON r.node = e.u)"""

#: DuckDB SQL. Trees, token ids and smoothed losses are beyond it. It lacks CRC-32, so that is written out by bytes.
ORACLES: dict[str, str] = {
    "op1_sharding": f"""WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
      entries AS (SELECT list(c ORDER BY i) AS e FROM step WHERE k = 8),
      raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
      bytes AS (SELECT doc_id, length(h) // 2 AS n, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS b FROM raw),
      sums AS (SELECT doc_id, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, e[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM bytes, entries),
      jump(doc_id, shards, k, b, j) AS (SELECT doc_id, shards, doc_id::HUGEINT, 0::BIGINT, 0::BIGINT FROM documents, (VALUES ({SHARDS}), ({SHARDS + 1})) v(shards)
        UNION ALL SELECT doc_id, shards, k2, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / (k2 // 8589934592 + 1)::DOUBLE)) AS BIGINT)
        FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM jump WHERE j < shards)),
      placed AS (SELECT doc_id, max(CASE WHEN shards = {SHARDS} THEN b END)::INT AS shard, max(CASE WHEN shards = {SHARDS + 1} THEN b END)::INT AS grown_shard FROM jump WHERE j >= shards GROUP BY doc_id)
      SELECT doc_id, (n + 8)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, crc) - 1 AS slot, grown_shard FROM sums JOIN placed USING (doc_id)""",
    "op3_chat": rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
        sum({_escaped_length('text')} + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + {_escaped_length('role')} END)::BIGINT AS formatted_chars FROM c GROUP BY conv_id""",
    "op5_jaccard": f"WITH RECURSIVE {_SHINGLES} SELECT node AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) LEFT JOIN sizes ON doc_id = node",
    "op6_recompression": f"""WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
      windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
      twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
      gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN twice USING (h))),
      kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op8_license_scans": _licence_sql(),
    "op9_exact_dedup": f"""WITH t AS (SELECT doc_id, {_NORM} AS norm FROM documents)
      SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM t""",
    "op10_decontamination": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM benchmark),
      heads AS (SELECT item_id, i AS j, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
      windows AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM heads) WHERE len(w) >= k)),
      met AS (SELECT doc_id, i, j, k, item_id FROM windows JOIN heads USING (k, s)),
      runs AS (SELECT doc_id, max(i) - min(i) + any_value(k) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island FROM met) GROUP BY doc_id, item_id, i - j, island),
      longest AS (SELECT doc_id, max(n) AS n FROM runs GROUP BY doc_id),
      hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
      items AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated, coalesce(longest.n, 0)::BIGINT AS longest_match FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)""",
}
