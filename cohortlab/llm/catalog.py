"""The ten operators as queries over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlab.llm import bpe, chat, fim, langid, line_dedup, merkle, minhash, packing, quality, sharding, topk, toxicity, url_filter
from cohortlab.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES_SQL = f"""
WITH rowed AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS txt, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(txt, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS k FROM rowed),
held AS (
  SELECT k, count(DISTINCT doc_id) AS n, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k),
judged AS (
  SELECT keyed.doc_id, txt, pos, coalesce(n >= 3 AND keyed.doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(txt, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


@query("op1_line_dedup", LINES_SQL)
def line_dedup_query(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# The site rules of the production list.
SITES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Own patterns for what no site rule decides: advertising and log-in pages, programs, adult and pill shops. Each hangs on a whole token.
PATTERNS = [url_filter.pattern(r"\A(?:[^/]*\.)?ads\.", "block", "ads"), url_filter.pattern(r"(?s)\A[^/]*//(?:.*/)?login/", "block", "login"),
            url_filter.pattern(r"\.exe\Z", "block", "exe"), url_filter.pattern(r"\.msi\Z", "block", "msi"),
            url_filter.pattern(r"\A(?:[^/]*\.)?adult-", "block", "adult"), url_filter.pattern(r"\A(?:[^/]*\.)?cheap-pills\.", "block", "cheap", "pills")]

URL_SQL = f"""
WITH parted AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)\\A.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)\\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rule(h, p, v) AS (VALUES {", ".join(str(s) for s in SITES)}),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM parted JOIN rule ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE
  WHEN regexp_matches(host, '(?s)^(.*\\.)?ads\\.') OR regexp_matches(path, '(?s)^/(.*/)?login/') OR regexp_matches(path, '\\.(exe|msi)$')
    OR regexp_matches(host, '(?s)^(.*\\.)?(adult-|cheap-pills\\.)') THEN 'block'
  ELSE 'allow' END) AS verdict
FROM parted LEFT JOIN fit USING (page_id)"""


@query("op2_url_filter", URL_SQL)
def url_filter_query(spark: SparkSession, sf: str) -> DataFrame:
    rules = [url_filter.site(*s) for s in SITES] + PATTERNS
    return url_filter.judge(table(spark, sf, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


QUALITY_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM win), range(3) AS r(d)
  WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols * 10 > n_words OR n_dup_lines * 2 > n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g'))) * 10 > word_chars * 3
    OR (length(t) - length(replace(t, '!', ''))) * 10 > n_words * 3
    OR (length(t) - length(regexp_replace(t, '\p{L}', '', 'g'))) * 2 < word_chars) AS kept
FROM m"""


@query("op3_quality_rules", QUALITY_SQL)
def quality_query(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.judge(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SHARDS = 40


@query("op8_sharding")
def sharding_query(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.exchange(table(spark, sf, "documents").select("doc_id", "text"), SHARDS)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return placed.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized AS (
  SELECT *, 13 + length(role) + length(text) + length(regexp_replace(role, '[^\\\n#<]', '', 'g')) + length(text) - length(replace(text, '\', ''))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#+'), lambda x: greatest(length(x) - 2, 0))), 0)
    + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


@query("op10_chat_format", CHAT_SQL)
def chat_query(spark: SparkSession, sf: str) -> DataFrame:
    return chat.digests(chat.format_turns(_turns(spark, sf)))


@query("op4_best_fit_packing")
def packing_query(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_bpe_codec")
def bpe_query(spark: SparkSession, sf: str) -> DataFrame:
    out = bpe.encode_texts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op6_toxicity")
def toxicity_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    out = toxicity.score(docs, toxicity.learn(docs, table(spark, sf, "labels")))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


TOP_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda c: coalesce(NOT isfinite(c), true)), true)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 10"""


@query("op9_topk", TOP_SQL)
def topk_query(spark: SparkSession, sf: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf, "embeddings"))
    return topk.search(vectors.filter(F.col("vec_id") % 100 == 0), vectors)


NEAR_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN link ON a = r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id"""


@query("op7_minhash", NEAR_SQL)
def minhash_query(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), size=4, percent=80)


FIM_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
cut AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut"""


@query("op12_fill_in_middle", FIM_SQL)
def fim_query(spark: SparkSession, sf: str) -> DataFrame:
    out = fim.restore(fim.transform(table(spark, sf, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


#: crc32 of the decimal id, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))))"""


def _levels(name: str, start: str, tree: str, levels: int) -> str:
    """SQL of one forest: ``start`` has (tree, i, h) nodes; gives ``{name}_top`` (tree, h) and ``{name}_side{k}`` (tree, i, l, r) on each level k."""
    out = [f"{name}0 AS (SELECT {tree}, i, h, count(*) OVER (PARTITION BY {tree}) AS n FROM {start})"]
    for k in range(levels):
        beside = lambda test, k=k: f"(SELECT coalesce(string_agg(b.h, '' ORDER BY b.i), '') FROM {name}{k} b WHERE b.{tree} IS NOT DISTINCT FROM a.{tree} AND b.i // 16 = a.i // 16 AND b.i {test} a.i)"
        out += [f"{name}_side{k} AS (SELECT {tree}, i, CASE WHEN n > 1 THEN {beside('<')} END AS l, CASE WHEN n > 1 THEN {beside('>')} END AS r FROM {name}{k} a)",
                f"{name}{k + 1} AS (SELECT {tree}, i // 16 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(n) + 15) // 16 AS n FROM {name}{k} GROUP BY {tree}, i // 16)"]
    return ", ".join([*out, f"{name}_top AS (SELECT {tree}, h FROM {name}{levels})"])


def _manifest_sql(levels: int = 6) -> str:
    """The two forests, level by level, and the fold of every leaf; enough levels for 16 million leaves a source."""
    field = lambda e: f"coalesce(strlen(({e})::VARCHAR) || ':' || ({e})::VARCHAR, '-')"
    row = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    joins, left, right = [], [], []
    for k in range(levels):
        joins.append(f"JOIN t_side{k} t{k} ON t{k}.source IS NOT DISTINCT FROM x.source AND t{k}.i = x.i // {16 ** k}")
        left, right = [*left, f"t{k}.l"], [*right, f"t{k}.r"]
    for k in range(levels):
        joins.append(f"JOIN s_side{k} s{k} ON s{k}.i = o.i // {16 ** k}")
        left, right = [*left, f"s{k}.l"], [*right, f"s{k}.r"]
    fold = "CASE WHEN crc % 5 = 0 THEN bad ELSE leaf END"
    steps = ", ".join(f"f{k + 1} AS (SELECT *, CASE WHEN {a} IS NULL THEN g{k} ELSE sha256({a} || g{k} || {b}) END AS g{k + 1} FROM f{k})"
                      for k, (a, b) in enumerate(zip([f"l{i}" for i in range(2 * levels)], [f"r{i}" for i in range(2 * levels)], strict=True)))
    sides = ", ".join(f"{a} AS l{i}, {b} AS r{i}" for i, (a, b) in enumerate(zip(left, right, strict=True)))
    proof = " || ".join(f"coalesce(l{i}, '') || coalesce(r{i}, '')" for i in range(2 * levels))
    return f"""
WITH leaves AS (SELECT doc_id, source, {row('text')} AS leaf, {row(f"translate(text, '{UPPER}', '{LOWER}')")} AS bad, {CRC_SQL} AS crc FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM leaves),
{_levels('t', 'x', 'source', levels)},
o AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, 0 AS all_ FROM t_top),
{_levels('s', 'o', 'all_', levels)},
f0 AS (SELECT x.doc_id, leaf, bad, crc, o.h AS subroot, s_top.h AS root, {fold} AS g0, {sides}
  FROM x JOIN o ON o.source IS NOT DISTINCT FROM x.source {' '.join(joins)}, s_top),
{steps}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, g{2 * levels} AS folded_root, g{2 * levels} = root AS verified FROM f{2 * levels}"""


@query("op13_merkle_manifest", _manifest_sql())
def merkle_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    columns = [F.col(c) for c in merkle.FIELDS[:-1]]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf_of(*columns, F.translate("text", UPPER, LOWER)))
    out = merkle.manifest(docs, {"tampered": tampered})
    back = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("proof_sha256"), back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op11_language_id")
def langid_query(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
