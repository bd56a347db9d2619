"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import crosspolytope, decontamination, fim, langid, licenses, linededup, packing, pii, quality, secrets, sharding, simhash, spelling
from tessera.llm.common import spread

N_SHARDS = 16
CAPACITY, END_ID = 1024, 2
WINDOW = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of documents, over all cores."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _joined_spans(spans: Column, names: tuple[str, ...]) -> Column:
    kinds = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffled_shards(table(spark, sf_dir, "documents"), N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"), WINDOW)
    return out.select(
        "doc_id",
        "_hits.n_words",
        "_hits.n_hit",
        F.size("_hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("_hits.n_hit") > 0).alias("contaminated"),
        F.size("_hits.near_items").cast("long").alias("n_near_items"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir, "doc_id", "text"), vocabulary(), CAPACITY, END_ID)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "_licenses.*")
    base = F.filter("spans", lambda s: s["exact"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return out.withColumn("_base", base).select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda s: s["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda s: s["first"])).cast("long").alias("last_word"),
        labels(F.col("_base")).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", *[F.col(f"_q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("_secrets", lambda m: m["kind"] != "random")
    count = lambda kind: F.size(F.filter("_secrets", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id",
        *[count(k) for k in ("assign", "access", "hex")],
        F.sha2(secrets.span_list(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_list(F.col("_secrets")).alias("spans"),
    )


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(documents(spark, sf_dir, "doc_id", "text"))
    count = lambda i, kind: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id",
        *[count(i, k) for i, k in enumerate(pii.KINDS)],
        F.sha2(_joined_spans(F.col("base"), pii.KINDS).cast("binary"), 256).alias("base_sha256"),
        _joined_spans(F.col("spans"), pii.KINDS).alias("spans"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    out = langid.identify_languages(docs.select("doc_id", "text"), langid.train(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("_lang.pred").alias("lang_pred"), F.col("_lang.score").alias("score"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_shared_lines(documents(spark, sf_dir, "doc_id", "text"))
    gone = F.size(linededup.dropped_positions(F.col("_lines.dropped")))
    return out.select("doc_id", F.col("_lines.n_lines").cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"), F.sha2(F.col("_lines.kept").cast("binary"), 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(documents(spark, sf_dir, "doc_id", "text"))
    part = lambda c: F.col(f"_fim.{c}")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", part("n"), part("form"), part("prefix").alias("prefix_chars"), part("middle").alias("middle_chars"),
        sha(part("output")).alias("output_sha256"), sha(fim.restored(part("form"), part("output"))).alias("restored_sha256"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir, "doc_id", "text")).select("word", "n", "form", "n_near", "form_n", "root")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return crosspolytope.nearest_neighbours(vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), vectors)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_sharding, op2_decontamination, op3_packing, op4_licenses, op5_simhash, op6_quality, op7_secrets, op8_personal_data, op9_language, op10_line_dedup, op11_fill_in_middle, op12_spelling_variants, op13_nearest_neighbours)
    return {f.__name__: f for f in named}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_TOKENS = r"'[^\x20\x09-\x0D]+'"


def _quality_sql() -> str:
    rules = quality.Rules()
    text = lambda x: "'" + x.replace("'", "''") + "'"
    phrases = text(quality.navigation_pattern() + "|" + "|".join(quality.BOILERPLATE))
    symbol_word, links, end = text(quality.SYMBOL + r"[^\x20\x09-\x0D]*"), text(f"[{quality.LINKING}]"), text(quality.SENTENCE_END)
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    count = lambda pattern: f"len(regexp_extract_all(line, {pattern}))"
    failed = f"n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.most_repeated} * n_words"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_TOKENS}) AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
l AS (SELECT r, line, len(regexp_extract_all(line, {_TOKENS})) AS n, count(*) AS times FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) GROUP BY r, line),
c AS (SELECT *, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, {count(symbol_word)} AS marked, {count(links)} AS links,
  {count("'[A-Z]'")} AS capitals, {count("'[a-z]'")} AS small FROM l WHERE n > 0),
f AS (SELECT *, n <= {rules.short_words} AND regexp_matches(low, {phrases})
  OR n BETWEEN {rules.judged_words} AND {rules.short_paragraph} AND NOT regexp_matches(trim(line, {blank}), {end})
  OR links >= 2 AND 100 * links >= {rules.link_marks} * n
  OR n >= {rules.shouted_words} AND capitals >= {rules.shouted_words} AND 100 * capitals > {rules.most_capitals} * (capitals + small)
  OR n >= {rules.judged_words} AND 100 * marked >= {rules.symbol_words} * n OR NOT regexp_matches(line, '{quality.LETTER}') AS fails FROM c),
s AS (SELECT r, sum(times - 1) AS dup, sum(n) FILTER (WHERE NOT fails) AS stay FROM f GROUP BY r),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, len(w) - coalesce(stay, 0) AS lost FROM d LEFT JOIN s USING (r) LEFT JOIN again USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT ({failed}) AND 100 * lost <= {rules.most_lost} * n_words AS kept FROM b"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_quality": _quality_sql(),
        "op2_decontamination": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
runs AS (
  SELECT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS run
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - {WINDOW} + 1, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM runs),
places AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r, i, p.n, item FROM places p JOIN runs USING (n, run)),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY r),
place AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
often AS (SELECT word, count(*) AS n FROM place GROUP BY word),
parts AS (SELECT item, s, w[s + k] AS word, min(s + k) AS o FROM (
  SELECT item, w, s, unnest(generate_series(0, least(len(w), {WINDOW}) - 1)) AS k FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - {WINDOW} + 1, 1))) AS s FROM b WHERE len(w) > 0))
  GROUP BY item, s, word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item, s ORDER BY n, word) AS k, min(n) OVER (PARTITION BY item, s) AS least FROM (SELECT item, s, word, o, coalesce(n, 0) AS n FROM parts LEFT JOIN often USING (word))),
pairs AS (SELECT DISTINCT item, max(word) FILTER (WHERE k = 1) AS w1, max(o) FILTER (WHERE k = 1) AS o1, max(word) FILTER (WHERE k = 2) AS w2, max(o) FILTER (WHERE k = 2) AS o2
  FROM ranked WHERE least > 0 GROUP BY item, s),
near AS (SELECT a.r, count(DISTINCT item) AS n_near FROM pairs JOIN place a ON a.word = w1 LEFT JOIN place c ON c.word = w2 AND c.r = a.r AND abs((c.p - o2) - (a.p - o1)) <= 3
  WHERE w2 IS NULL OR c.r IS NOT NULL GROUP BY a.r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near_items
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)""",
        "op10_line_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, r, i, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN s USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r""",
        "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
        # the checksum CRC-32 by its table, number by number
        "op12_spelling_variants": r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS c FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(generate_series(1, 8) AS BIGINT[])), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) AS v FROM range(256) r(i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
s AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT run, n, hex(encode(s)) AS x FROM s),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda k: CAST('0x' || x[2 * k + 1:2 * k + 2] AS BIGINT))), lambda a, y: xor(a // 256, c[xor(a % 256, y) + 1]))) AS h FROM b, crc),
k AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM k WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM w)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM v a JOIN v b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT v.word, v.n, w.word, w.n FROM v JOIN w ON v.less = w.word UNION SELECT w.word, w.n, v.word, v.n FROM v JOIN w ON v.less = w.word),
best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word, n),
forms AS (SELECT word, other AS form, m AS form_n FROM best WHERE m >= 5 * n),
path AS (SELECT word, form AS root FROM forms UNION ALL SELECT path.word, forms.form FROM path JOIN forms ON path.root = forms.word),
ends AS (SELECT word, root FROM path WHERE root NOT IN (SELECT word FROM forms))
SELECT w.word, w.n, form, coalesce(n_near, 0) AS n_near, form_n, coalesce(root, w.word) AS root FROM w LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)""",
    }
