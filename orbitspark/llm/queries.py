"""The queries op1_ to op13_ over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitspark.llm import byte_bpe, collocations, extraction, licenses, merkle, packing, quality, sharding, simhash, suffix_dedup, topk, toxicity, word_bpe
from orbitspark.llm.common import table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = table(spark, sf_dir, "documents").select("doc_id", byte_bpe.encode(F.col("text"), path, pattern).alias("ids"))
    decoded = coded.withColumn("bytes", byte_bpe.decode(F.col("ids"), path, pattern))
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op7_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    pieces = packing.split_documents(table(spark, sf_dir, "documents"), path, pattern)
    # the ids' digest is taken before the pieces are numbered, so that the ids themselves aren't written
    pieces = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "task", "nth")
    return packing.number_sequences(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), made=lambda kept: F.sha2(kept, 256))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extraction.extracted(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


def op10_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = table(spark, sf_dir, "documents").select("doc_id", word_bpe.encode(F.col("text"), path).alias("ids"))
    decoded = coded.withColumn("decoded", word_bpe.decode(F.col("ids"), path))
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


OPERATORS = (op1_simhash_dedup, op2_byte_bpe, op3_exact_topk, op4_toxicity, op5_quality_rules, op6_license_scan, op7_binary_packing, op8_suffix_dedup, op9_html_extraction, op10_minimax_sharding, op11_phrase_collocations, op12_word_bpe, op13_merkle_manifest)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def _op5_sql() -> str:
    words = r"""regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"""
    fails = {i: f"(100 * n_symbols > {s} * word_chars OR 100 * n_repeat_words > {r} * n_words OR 100 * n_dup_lines > {d} * n_words OR word_chars > {c} * n_words)" for i, (s, r, d, c) in enumerate(quality.LADDER, 1)}
    a, n = quality.ALPHA, len(quality.LADDER)
    return rf"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {words} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) >= 3)),
covered AS (
  SELECT rid, count(DISTINCT i + o) AS n
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS times FROM windows), (SELECT unnest([0, 1, 2]) AS o)
  WHERE times > 1 GROUP BY rid),
measured AS (
  SELECT doc_id, stratum, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (rid)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
counts AS (
  SELECT stratum, count(*) AS n, count(*) OVER () AS strata, [{", ".join(f"count(*) FILTER (WHERE {f})" for f in fails.values())}] AS ks
  FROM base WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY stratum),
tests AS (SELECT stratum, n, strata, ks[r] AS k, r FROM counts, (SELECT unnest(range(1, {n + 1})) AS r)),
passed AS (
  SELECT stratum, r, list_sum(list_transform(range(0, k + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({a}) + (n - j) * ln(1 - {a})))) <= {quality.DELTA} / strata AS ok
  FROM tests),
rungs AS (SELECT stratum, coalesce(min(r) FILTER (WHERE NOT ok), {n + 1}) - 1 AS rung FROM passed GROUP BY stratum)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"(coalesce(rung, 0) >= {i} AND {f})" for i, f in fails.items())}) AS kept
FROM base LEFT JOIN rungs USING (stratum)
"""


def _op3_sql() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def _op6_sql() -> str:
    """Brute force: every shingle of every text against every template."""
    shingles = licenses.template_shingles(licenses.TEMPLATES)
    rows = ", ".join(f"('{name}', '{s}', {len(all_[0].split(' '))}, {len(set(all_))}, {-(-5 * len(all_) // 4)})" for name, all_ in shingles.items() for s in sorted(set(all_)))
    widths = sorted({len(s[0].split(" ")) for s in shingles.values()} | {licenses.WIDTH})
    marks = licenses.PUNCTUATION.replace("'", "''")
    cuts = " UNION ALL ".join(f"SELECT rid, doc_id, unnest(range(0, len(w) - {k} + 1)) AS pos, {k} AS width, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) AS shingle FROM words WHERE len(w) >= {k}" for k in widths)
    return rf"""
WITH templates(template, shingle, width, total, stretch) AS (VALUES {rows}),
words AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(lower(coalesce(text, '')), '{marks}', ''), '[^ 	-
]+') AS w FROM documents),
held AS (SELECT rid, doc_id, template, pos, shingle, total, stretch FROM ({cuts}) JOIN templates USING (shingle, width)),
scored AS (
  SELECT a.doc_id, a.template, a.rid, a.pos, count(DISTINCT b.shingle) / any_value(a.total) AS containment
  FROM held a JOIN held b ON a.rid = b.rid AND a.template = b.template AND b.pos BETWEEN a.pos AND a.pos + a.stretch - 1
  GROUP BY a.doc_id, a.template, a.rid, a.pos)
SELECT doc_id, template, max(containment) AS containment, arg_max(pos, containment * 1000000000 - pos)::BIGINT AS first_word
FROM scored WHERE containment >= {licenses.LEAST} GROUP BY doc_id, template
"""


def _op11_sql() -> str:
    """Every phrase of every piece, counted as text."""
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) AS phrase FROM pieces WHERE len(w) >= {k}" for k in range(1, 5))
    return rf"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM texts),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
found AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM found),
scored AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.c, p.f AS l, q.f AS r, (2000000 * x.a::HUGEINT // (p.f + q.f))::BIGINT AS score FROM cuts x
  JOIN counts p ON p.lang = x.lang AND p.phrase = array_to_string(x.w[1:x.c], ' ') JOIN counts q ON q.lang = x.lang AND q.phrase = array_to_string(x.w[x.c + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
parts AS (
  SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM found WHERE k > 2))),
held AS (SELECT lang, phrase, max(a) AS h FROM parts GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN held USING (lang, phrase) JOIN totals USING (lang) WHERE h IS NULL OR 100 * h < 80 * a QUALIFY rank <= 2000
"""


def _op13_sql(levels: int = 6) -> str:
    """The trees level by level, enough of them for 16^6 leaves and sources."""
    table_of = [0] * 256  # of CRC-32
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        table_of[i] = c
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, {table_of}[(xor(a, b) & 255) + 1])), 4294967295)"
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, first: str) -> str:
        """Tables name0, name1, ... (g, i, n, h) of nodes, and name_s0, ... of what stands beside each."""
        parts = [f"{name}0 AS MATERIALIZED ({first})"]
        for j in range(levels):
            parts.append(f"{name}{j + 1} AS MATERIALIZED (SELECT g, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{j} GROUP BY g, i // 16, n)")
            side = lambda op: f"coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i {op} a.i), '')"
            parts.append(f"{name}_s{j} AS MATERIALIZED (SELECT a.g, a.i, a.n > 1 AS up, {side('<')} AS lft, {side('>')} AS rgt FROM {name}{j} a JOIN {name}{j} b ON a.g = b.g AND a.i // 16 = b.i // 16 GROUP BY a.g, a.i, a.n)")
        return ",\n".join(parts)

    def climb(name: str, start: str, tree_name: str) -> str:
        """Tables name0, ... of documents on their way up: path and fold so far, and place (g, i) in the tree."""
        parts = [f"{name}0 AS ({start})"]
        for j in range(levels):
            parts.append(f"{name}{j + 1} AS MATERIALIZED (SELECT d.* REPLACE (i // 16 AS i, path || lft || rgt AS path, CASE WHEN up THEN sha256(lft || fold || rgt) ELSE fold END AS fold) FROM {name}{j} d JOIN {tree_name}_s{j} s USING (g, i))")
        return ",\n".join(parts)

    return f"""
WITH leaves AS MATERIALIZED (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS g, {leaf("text")} AS leaf, CASE WHEN coalesce({crc} % 5 = 0, false) THEN {leaf(small)} ELSE {leaf("text")} END AS changed FROM documents),
places AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{tree("t", "SELECT g, i, n, leaf AS h FROM places")},
tops AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t{levels}),
{tree("s", "SELECT '' AS g, i, n, h FROM tops")},
{climb("d", "SELECT doc_id, leaf, g, i, '' AS path, changed AS fold FROM places", "t")},
{climb("e", f"SELECT d.doc_id, d.leaf, x.h AS subroot, '' AS g, x.i, d.path, d.fold FROM d{levels} d JOIN tops x USING (g)", "s")}
SELECT doc_id, leaf, subroot, root.h AS root, sha256(path) AS proof_sha256, fold AS folded_root, fold = root.h AS verified FROM e{levels}, s{levels} AS root
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": _op3_sql(), "op5_quality_rules": _op5_sql(), "op6_license_scan": _op6_sql(), "op11_phrase_collocations": _op11_sql(), "op13_merkle_manifest": _op13_sql()}
