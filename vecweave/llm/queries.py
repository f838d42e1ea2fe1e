"""The numbered queries over the given tables, with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.llm import bpe, exact_dedup, filter_audit, lexical, license, lm, minhash, packing, pii, quality, secret_scan, suffix, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_TEMPLATE_ROWS = ", ".join(
    "('{}', {}, {}, {}, '{}')".format(k, words, need, long, order or "") for k, v in license.TEMPLATES.items() for words, need, long, order in [license.template(v)]
)
SQL_OP1 = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
b AS (
  SELECT doc_id, i - 1 AS pos,
         CASE WHEN ws[i] = 'cc' AND ws[i + 1] = 'by' THEN 'cc-by'
              WHEN ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license' THEN 'gpl'
              WHEN ws[i] = 'all' AND ws[i + 1] = 'rights' AND ws[i + 2] = 'reserved' THEN 'reserved' END AS label
  FROM p),
bb AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS ls FROM b WHERE label IS NOT NULL GROUP BY 1),
tpl(label, words, need, long, ord) AS (VALUES TEMPLATES),
l AS (SELECT doc_id, regexp_extract_all(run, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '\n[ \t\r]*\n')) AS run FROM d)),
c AS (SELECT * FROM l, tpl WHERE len(list_intersect(l.ws, tpl.words)) >= need),
k AS (SELECT doc_id, label, words, need, ord, unnest(list_transform(list_filter(range(1, len(ws) + 1), lambda i: list_contains(words, ws[i])), lambda i: ws[i:i + long - 1])) AS block FROM c),
m AS (SELECT doc_id, label, max(len(list_intersect(block, words)) / len(words)) AS c FROM k
      WHERE len(list_intersect(block, words)) >= need AND (ord = '' OR regexp_matches(array_to_string(block, ' '), ord)) GROUP BY 1, 2),
mm AS (SELECT doc_id, list(label) AS ls, max(c) AS best FROM m GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(bb.ls, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.ls, []), coalesce(mm.ls, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN bb USING (doc_id) LEFT JOIN mm USING (doc_id)
""".replace("TEMPLATES", _TEMPLATE_ROWS)


@query("op1_license_scan", SQL_OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


SQL_OP2 = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""


@query("op2_exact_dedup", SQL_OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


SQL_LEDGER = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lc AS (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
dl AS (SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n_dup, sum(n * regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]')::INT) AS n_bullet FROM lc GROUP BY 1),
m AS (
  SELECT d.doc_id, len(w.ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dl.n_lines, 0)::BIGINT AS n_lines, coalesce(dl.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '[0-9A-Za-z]|[^\x00-\x7F]'))) AS n_plain_words,
         length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits, coalesce(dl.n_bullet, 0)::BIGINT AS n_bullet_lines
  FROM d JOIN w USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id)),
b AS (
  SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (2 * word_chars < 3 * n_words)::INT
         + 8 * (word_chars > 40 * n_words)::INT + 16 * (n_symbols > n_words)::INT + 32 * (2 * n_dup_lines > n_lines)::INT
         + 64 * (5 * n_plain_words < 4 * n_words)::INT + 128 * (2 * n_digits > word_chars)::INT
         + 256 * (n_lines > 4 AND 10 * n_bullet_lines > 9 * n_lines)::INT)::BIGINT AS fail_bits
  FROM m)
"""
SQL_OP6 = SQL_LEDGER + r"""
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_plain_words, n_digits, n_bullet_lines,
       fail_bits, fail_bits & 3 <> 0 AS base_failed, fail_bits & 511 = 0 AS kept
FROM b
"""


@query("op6_quality_ledger", SQL_OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    rows = quality.apply_policy(rows, "base", "_base_kept").withColumn("base_failed", ~F.col("_base_kept")).drop("_base_kept")
    return quality.apply_policy(rows, "v2")


SQL_ABLATION = SQL_LEDGER + r"""
, r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_words', 2), ('short_words', 4), ('long_words', 8), ('symbols', 16),
                        ('duplicate_lines', 32), ('marks', 64), ('digits', 128), ('bullet_lines', 256))
SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits = bit) AS n_only FROM r, b GROUP BY rule
"""


@query("quality_ablation", SQL_ABLATION)
def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents")), "v2")


@query("op10_dart_minhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


# In production a secret of the owner of the data; the queries need one that is always the same.
PII_KEY = b"a key for the named queries only"


@query("op8_pii_surrogates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.replace_pii(table(spark, sf_dir, "documents"), PII_KEY)
    return rows.select("doc_id", "text", F.size("_kinds").cast("bigint").alias("n_entities"), F.array_join("_kinds", ",").alias("kinds"))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_bpe_round_trip")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op7_online_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


SQL_OP4 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, h, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""


@query("op4_warc_packages", SQL_OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op9_suffix_levels")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_bytes")


@query("op5_context_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


SQL_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
f AS (
  SELECT doc_id, part,
         (len(ws) < 50)::INT AS a, (100 * len(list_distinct(ws)) < 65 * len(ws))::INT AS b,
         (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::INT AS c,
         regexp_matches(t, '[#$%&*|]')::INT AS d,
         coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS e
  FROM w),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN lab USING (doc_id) GROUP BY 1, 2),
l AS (SELECT unnest(range(1, 6)) AS i),
o AS (
  SELECT [l1.i, l2.i, l3.i, l4.i, l5.i] AS o FROM l l1, l l2, l l3, l l4, l l5
  WHERE len(list_distinct([l1.i, l2.i, l3.i, l4.i, l5.i])) = 5),
r AS (
  SELECT part, fails, n, good, toxic, o,
         coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda s: fails[o[s]] = 1)), 9) AS gone
  FROM m, o),
c AS (
  SELECT part, o, s.i AS step, sum(CASE WHEN gone > s.i THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = s.i THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone < s.i AND fails[o[s.i]] = 1 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails[o[s.i]] = 1 AND list_sum(fails) = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone = s.i THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = s.i THEN toxic ELSE 0 END) AS toxic_lost
  FROM r, l s GROUP BY 1, 2, 3)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x::INT, 1)), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept,
       removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley
FROM c
"""


@query("op12_filter_audit", SQL_OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql_secrets() -> str:
    """Each rule's matches, marked in the text by two code points that no text holds; places are lengths before them."""
    each = []
    for i, rule in enumerate(secret_scan.RULES):
        pattern, head = (p.replace("'", "''") for p in (rule.pattern, rule.head))
        tail = f"length(regexp_extract(hit, '^(?:{head})')) + {rule.least} <= length(hit)" if rule.tail else "true"
        each.append(
            f"""SELECT doc_id, row_id, {i} AS k, '{rule.kind}' AS kind, pos AS s, pos + length(hit) AS e
FROM (SELECT doc_id, row_id, hit, (sum(length(hit) + length(rest)) OVER w - length(hit) - length(rest))::BIGINT AS pos
      FROM (SELECT doc_id, row_id, i, CASE WHEN i = 1 THEN '' ELSE split_part(piece, chr(57345), 1) END AS hit,
                   CASE WHEN i = 1 THEN piece ELSE split_part(piece, chr(57345), 2) END AS rest
            FROM (SELECT doc_id, row_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i
                  FROM (SELECT doc_id, row_id, string_split(regexp_replace(t, '({pattern})', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) AS pieces FROM d)))
      WINDOW w AS (PARTITION BY row_id ORDER BY i))
WHERE hit <> '' AND {tail}"""
        )
    return (
        "WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS t FROM documents),\nh AS (\n"
        + "\nUNION ALL\n".join(each)
        + """),
g AS (
  SELECT row_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM h GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row_id)
"""
    )


@query("op13_secret_scan", _sql_secrets())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


SQL_OP11 = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
d AS (SELECT doc_id, row_id, len(ws)::BIGINT AS n, ws FROM w WHERE len(ws) > 0),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
t AS (SELECT row_id, term, count(*)::BIGINT AS tf FROM (SELECT row_id, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
x AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term, nn),
v AS (
  SELECT row_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l))) AS part
  FROM t JOIN d USING (row_id) JOIN x USING (term), s),
h AS (SELECT item_id, row_id, sum(part)::BIGINT AS score FROM q JOIN v USING (term) GROUP BY 1, 2),
r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM h JOIN d USING (row_id) WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""


@query("op11_lexical_search", SQL_OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
