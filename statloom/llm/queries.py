"""The operators of this subpackage over their whole tables, and SQL for the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import bpe, chat, collocations, decontaminate, lang_id, licenses, line_dedup, near_dup, pii, quality, records, search, token_counts
from statloom.llm.common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    index = line_dedup.build(docs, min_docs=5, min_chars=40)
    out = line_dedup.dedup(docs, index)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


PSEUDONYM_KEY = "corpus key 1"  # where the session has no secret of its own in statloom.pseudonym.key


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, spark.conf.get("statloom.pseudonym.key", PSEUDONYM_KEY))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), width=10)
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


NEAR = near_dup.Settings(shingle=3, percent=85, bands=25)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), NEAR)


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


CONTROL = "\\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(CONTROL)
    control = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    records = chat.dressed(chat.gathered(rows.unionByName(control)))
    back = chat.read_back(chat.render(chat.canonical_places(records)))
    turns = F.expr(r"array_join(transform(turns_back, t -> concat(t.role, '\n', t.text, '\n')), '')")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns_back").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read(spark, sf_dir, "documents").withColumnRenamed("source", "host"), quality.Limits())


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"), decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return text.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = lang_id.predict(docs, lang_id.train(docs))
    return out.select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), collocations.Settings(max_words=3, least=10, contained=50, top=2000))


def op12_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = records.new_folder(spark)
    records.write(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), folder)
    return records.fetch(records.index(spark, folder), folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return search.search(search.build(docs), docs, read(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_token_counts, op3_license_scan, op4_pii, op5_decontaminate, op6_near_dedup, op7_chat_format, op8_quality, op9_bpe, op10_lang_id, op11_collocations, op12_records, op13_search,
    )
}

DUCK_NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE = {
    "op1_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT k.*, coalesce(k.doc_id <> f.keeper, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id""",
    "op5_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS phrase
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT dw.doc_id, dw.m, dw.i, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.phrase = bw.phrase),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id""",
    "op6_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 2), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_ >= 85 * (na.n + nb.n - both_)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, least(a, b) AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
    "op3_license_scan": rf"""
WITH t AS (SELECT name, len(w) AS n_words, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
           FROM (SELECT name, string_split({DUCK_NORMAL.format("notice")}, ' ') AS w FROM (VALUES {TEMPLATE_ROWS}) AS v(name, notice))),
d AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM (SELECT doc_id, string_split({DUCK_NORMAL.format("text")}, ' ') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 1),
c AS (SELECT doc_id, gram, name FROM (SELECT DISTINCT doc_id, unnest(g) AS gram FROM d) JOIN (SELECT name, unnest(g) AS gram FROM t) USING (gram)),
k AS (SELECT doc_id, name FROM c JOIN t USING (name) GROUP BY doc_id, name, len(t.g) HAVING 3 * count(*) >= 2 * len(t.g)),
x AS (SELECT doc_id, name, t.g AS tg, list_distinct(list_slice(d.g, p + 1, p + n_words - 1)) AS x
      FROM (SELECT doc_id, name, unnest(range(0, len(d.g))) AS p FROM k JOIN d USING (doc_id) JOIN t USING (name)) JOIN d USING (doc_id) JOIN t USING (name)),
m AS (SELECT doc_id, name, round(max(2 * len(list_intersect(x, tg)) / (len(x) + len(tg))), 6) AS dice FROM x GROUP BY doc_id, name HAVING max(2 * len(list_intersect(x, tg)) / (len(x) + len(tg))) >= 0.8),
a AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses FROM m GROUP BY doc_id),
b AS (SELECT doc_id, name AS best, dice FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) = 1)
SELECT d.doc_id, a.licenses, b.best, b.dice FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id""",
    "op7_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#')) + length(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#')) + 13 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op8_quality": r"""
WITH d AS (SELECT doc_id, source AS host, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL),
x AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g') AS key FROM l),
y AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM x WHERE n > 0 GROUP BY doc_id),
h AS (SELECT host, count(DISTINCT doc_id) AS n FROM d WHERE text IS NOT NULL GROUP BY host),
a AS (SELECT x.host, key FROM x JOIN h ON h.host IS NOT DISTINCT FROM x.host WHERE x.n > 0 GROUP BY x.host, key, h.n
      HAVING count(DISTINCT doc_id) > 100 OR (count(DISTINCT doc_id) >= 10 AND count(DISTINCT doc_id) > 0.01 * h.n)),
z AS (SELECT doc_id, sum(x.n) AS n FROM x JOIN a ON a.host IS NOT DISTINCT FROM x.host AND a.key = x.key GROUP BY doc_id),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(y.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(z.n, 0) AS BIGINT) AS n_removed
      FROM d LEFT JOIN y ON y.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (n_words - n_removed) >= 0.5 * n_words AS kept FROM f""",
    "op11_collocations": r"""
WITH RECURSIVE p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
      FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, string_split(array_to_string(list_slice(w, i, i + k - 1), ' '), ' ') AS v, count(*) AS f
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k) GROUP BY ALL),
c AS (SELECT g.lang, g.k, g.phrase, g.v, g.f AS a, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * g.f * g.f) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM g WHERE k > 1 AND f >= 10) AS g
      JOIN g AS x ON x.lang = g.lang AND x.phrase = array_to_string(list_slice(g.v, 1, j), ' ') JOIN g AS y ON y.lang = g.lang AND y.phrase = array_to_string(list_slice(g.v, j + 1, g.k), ' ')
      QUALIFY row_number() OVER (PARTITION BY g.lang, g.phrase ORDER BY score, j) = 1),
e AS (SELECT lang, phrase, v[1] || ' ' || v[2] AS u1, v[2] || ' ' || v[3] AS u2, f FROM g WHERE k = 3 AND f >= 10),
i AS (SELECT lang, u AS phrase, max(f) AS most FROM (SELECT lang, u1 AS u, f FROM e UNION ALL SELECT lang, u2, f FROM e) GROUP BY ALL),
n AS (SELECT e.lang, e.phrase AS p, x.phrase AS q FROM e JOIN e AS x ON x.lang = e.lang AND x.u1 = e.u2 AND x.f = e.f JOIN g ON g.lang = e.lang AND g.phrase = e.u2 AND g.f = e.f),
h AS (SELECT lang, phrase AS head, phrase AS here FROM e WHERE NOT EXISTS (FROM n WHERE n.lang = e.lang AND n.q = e.phrase) UNION ALL SELECT h.lang, h.head, n.q FROM h JOIN n ON n.lang = h.lang AND n.p = h.here),
s AS (SELECT lang, here AS phrase, count(*) OVER (PARTITION BY lang, head) + 2 AS path_words FROM h),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang)
SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank, c.phrase, c.a, c.l, c.r, t.n, c.score, coalesce(s.path_words, c.k) AS path_words
FROM c JOIN t ON t.lang = c.lang LEFT JOIN i ON i.lang = c.lang AND i.phrase = c.phrase LEFT JOIN s ON s.lang = c.lang AND s.phrase = c.phrase
WHERE c.k = 3 OR coalesce(100 * i.most < 50 * c.a, true) QUALIFY rank <= 2000""",
    "op13_search": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM documents),
c AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark),
t AS (SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, 10 + (90 * len(w) * c.n) // c.l AS m, unnest(w) AS term FROM d, c WHERE len(w) > 0) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(c.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, c GROUP BY term),
x AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN f USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10""",
}
