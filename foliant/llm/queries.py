"""The named queries of the training-data operators, with their check in SQL where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import chat, decontaminate, langid, licenses, ngram_join, packing, pii, quality, spelling, toxicity, trie, urlfilter, warc
from foliant.session import cut_lineage, shared_folder, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Rows of each language that the language model learns from, and is calibrated on.
LANGUAGE_SAMPLE = 600


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query("op10_decontamination", f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_SQL_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS gram
  FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM windows),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
grams AS (
  SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM docs, lengths WHERE len(w) >= k)),
found AS (SELECT r, p, k, item FROM grams JOIN windows USING (k, gram)),
hits AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS x FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
""")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a ten-word window of a benchmark item."""
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, keep=["doc_id"])
    return found.drop("items")


def _fold_of(doc_id: str = "doc_id"):
    """crc32 of the id as text; rows of remainder 2 by 4 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def _with_labels(docs: DataFrame, labels: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Join whole texts with one label a document. Up to ``limit`` labels (about 50 MB in memory)
    are sent to the texts; beyond it the texts are shuffled by id."""
    few = labels.count() <= limit
    return docs.join(F.broadcast(labels) if few else labels, "doc_id")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text; counts from three quarters of the learnable rows, the curve from the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _fold_of().alias("fold"))
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        (F.max("toxic") > 0).alias("label"))
    learn, judge = F.col("fold") % 4 != 2, F.floor(F.col("fold") / 4) % 4 == 0
    model = toxicity.fit(_with_labels(docs.where(learn & ~judge), labels))
    judged = cut_lineage(toxicity.features(docs, model, ["doc_id", "fold"]))
    weights = toxicity.calibrate(judged.where(learn & judge).join(labels, "doc_id"))
    score = toxicity.score(weights)
    return judged.select(
        "doc_id", F.coalesce(F.col("fold") % 4 == 2, F.lit(False)).alias("held_out"), score.alias("score"),
        (score >= 0.3).cast("int").alias("predicted"), "mean_ratio", "peak_ratio", "word_mean", "word_peak")


def learnable(doc_id: str = "doc_id"):
    """Rows outside the held-out fold."""
    return _fold_of(doc_id) % 4 != 2


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(learnable())
    model = langid.train(langid.draw_sample(learn, "doc_id", "text", "lang", LANGUAGE_SAMPLE))
    held = F.coalesce(_fold_of() % 4 == 2, F.lit(False)).alias("held_out")
    return langid.predict(docs, model, ["doc_id", held])


_SQL_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _sql_drop(text: str, characters: str) -> str:
    return f"translate({text}, {characters}, '')"


_SQL_BAD_LINE = f"""
  len(solid) > 0 AND (
    len(solid) - len({_sql_drop('solid', "'" + quality.SYMBOLS + "'")}) > len(solid) * 0.1
    OR (nw >= 4 AND (len(solid) - len(translate(solid, '!?', ''))) * 2 >= nw)
    OR (len(solid) - len(translate(solid, '{quality.SEPARATORS}', '')) >= 3 AND (len(solid) - len(translate(solid, '{quality.SEPARATORS}', ''))) * 4 >= nw)
    OR (regexp_extract(line, '{quality.BOILERPLATE}', 1) <> '' AND nw <= 4 * (1 + len(regexp_extract(line, '{quality.BOILERPLATE}', 1)) - len(replace(regexp_extract(line, '{quality.BOILERPLATE}', 1), ' ', '')))))
"""


@query("op6_quality", f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, {_sql_drop('text', _SQL_SPACES)} AS solid FROM docs),
windows AS (
  SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM worded WHERE len(w) >= 3)),
twice AS (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1),
repeats AS (
  SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(p, p + 3)) AS x FROM windows SEMI JOIN twice USING (r, g)) GROUP BY r),
lines AS (
  SELECT r, line, {_sql_drop('line', _SQL_SPACES)} AS solid, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS nw
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
by_line AS (
  SELECT r, count(*) FILTER (len(solid) > 0) AS n, count(DISTINCT line) FILTER (len(solid) > 0) AS different,
         count(*) FILTER ({_SQL_BAD_LINE}) AS bad, coalesce(sum(len(solid)) FILTER ({_SQL_BAD_LINE}), 0) AS lost
  FROM lines GROUP BY r),
all_of AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, len(solid)::BIGINT AS word_chars,
         (len(solid) - len({_sql_drop('solid', "'" + quality.SYMBOLS + "'")}))::BIGINT AS n_symbols,
         (b.n - different)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         b.n::BIGINT AS n_lines, bad::BIGINT AS n_removed_lines, lost::BIGINT AS removed_chars
  FROM worded JOIN by_line b USING (r) LEFT JOIN repeats USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_chars <= word_chars * 0.3 AS kept
FROM all_of
""")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every whole text."""
    return quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("clean_text")


_SQL_SITE = ", ".join(f"('{r.action}', '{r.rule}', '{r.rule.partition('/')[0]}', '/{r.rule.partition('/')[2]}')" for r in urlfilter.SITE_RULES)
_SQL_PATTERN = ", ".join(f"('{r.name}', '{r.regex}')" for r in urlfilter.PATTERN_RULES)


@query("op2_url_filter", f"""
WITH rules(action, rule, rule_host, rule_path) AS (VALUES {_SQL_SITE}),
patterns(name, regex) AS (VALUES {_SQL_PATTERN}),
cut AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
site AS (
  SELECT r, arg_max(rule, (length(rule), action = 'block', rule)) AS rule, arg_max(action, (length(rule), action = 'block', rule)) AS action
  FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r),
other AS (
  SELECT r, arg_max(name, (length(name), name)) AS pattern FROM cut JOIN patterns ON regexp_matches(host || path, regex) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM cut LEFT JOIN site USING (r) LEFT JOIN other USING (r)
""")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), keep=["page_id"]).drop("n_candidates")


_SQL_TEMPLATES = ", ".join(
    "('" + name + "', [" + ", ".join(f"'{b}'" for b in licenses.template_bigrams(text)) + "])"
    for name, texts in sorted(licenses.TEMPLATES.items()) for text in texts)


@query("op8_licenses", f"""
WITH templates(name, b) AS (VALUES {_SQL_TEMPLATES}),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^0-9a-z\\n]+', ' ', 'g') AS t FROM documents),
blocks AS (SELECT r, t, string_split_regex(t, '\\n(?: *\\n)+') AS b FROM docs),
parts AS (
  SELECT r, unnest(string_split(t, chr(10))) AS p FROM blocks
  UNION ALL SELECT r, unnest(b) FROM blocks UNION ALL SELECT r, t FROM blocks WHERE len(b) > 1),
units AS (SELECT row_number() OVER () AS u, r, regexp_extract_all(p, '[0-9a-z]+') AS w FROM parts),
grams AS (SELECT u, r, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM units WHERE len(w) > 1),
compared AS (
  SELECT r, name, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM grams JOIN templates
  ON len(g) >= ceil(len(b) * (0.8::DOUBLE / (2 - 0.8::DOUBLE)) - 1e-9) AND len(g) <= floor(len(b) * ((2 - 0.8::DOUBLE) / 0.8::DOUBLE) + 1e-9)),
hits AS (SELECT r, max(dice) AS dice, count(*) AS n, list_sort(list_distinct(list(name))) AS names FROM compared WHERE dice >= 0.8 GROUP BY r),
best AS (SELECT r, min(name) AS name FROM compared JOIN hits USING (r, dice) GROUP BY r),
counted AS (SELECT r, count(*) AS n FROM compared GROUP BY r)
SELECT doc_id, best.name AS license, dice, coalesce(array_to_string(names, ','), '') AS licenses, coalesce(hits.n, 0)::BIGINT AS n_hits,
       coalesce(counted.n, 0)::BIGINT AS n_compared
FROM docs LEFT JOIN hits USING (r) LEFT JOIN best USING (r) LEFT JOIN counted USING (r)
""")
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that units of each whole text match."""
    found = licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.withColumn("licenses", F.array_join("licenses", ","))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of the byte-level vocabulary, or of its ranks, among the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each piece of each whole text in sequences of 2048 tokens."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(), 2048, 0, keep=["doc_id"], ranks_path=tokenizer_path("byte_bpe_50k.tiktoken"))
    return packing.pack(cut, 2048).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op4_warc")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a WARC record for every page, then read the archives back."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), folder, shard_bytes=32 << 20, roll_bytes=16 << 20)
    return warc.read_warc(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_ngram_join")
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, five-word shingles, Jaccard similarity 0.8 or more."""
    linked = ngram_join.link(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", "class_id", "n_links", "n_text_links", "n_copies")


@query("op3_chat", r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
seats AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said),
shown AS (
  SELECT conv_id, turn, perspective, speaker, speaker = perspective AS is_target,
         CASE WHEN speaker = perspective THEN '<|assistant|>' ELSE '<|user name=' || regexp_replace(speaker, '[\r\n|<>]', '_', 'g') || '|>' END || chr(10) AS head,
         body || '<|end|>' || chr(10) AS tail
  FROM said JOIN seats USING (conv_id)),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(tail)) OVER (
    PARTITION BY conv_id, perspective ORDER BY turn, speaker, head || tail ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM shown)
SELECT conv_id, turn, perspective, speaker, is_target, sha256(head || tail) AS segment_sha256, start,
       (start + length(head) + length(tail))::BIGINT AS "end",
       (start + length(head) + CASE WHEN is_target THEN 0 ELSE length(tail) END)::BIGINT AS mask_start,
       (start + length(head) + length(tail))::BIGINT AS mask_end
FROM placed
""")
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each participant, with offsets and mask spans."""
    turns = chat.rotate(table(spark, sf_dir, "conversations"), group_limit=100_000)
    return turns.withColumn("segment_sha256", F.sha2("segment", 256)).drop("segment")


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


def _sql_crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text, byte by byte."""
    code = f"hex(encode({text}))"
    data = f"list_transform(range(1, length({code}), 2), lambda i: ('0x' || substr({code}, i, 2))::BIGINT)"
    step = f"xor(x >> 8, {_crc_table()}[(xor(x, y) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda x, y: {step}), 4294967295::BIGINT)"


@query("op11_prefix_trie", f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_sql_crc32('c::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT convs.c, 0 AS part, p, r, x FROM convs JOIN turns ON turns.c = convs.c - convs.c % 5 AND p <= h
  UNION ALL SELECT c, 1, p, r, x FROM convs JOIN turns USING (c) WHERE p > h),
placed AS (SELECT c, r, x, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d FROM rebuilt),
prefixes AS (
  SELECT c, d, md5(string_agg(length(r) || ':' || length(x) || ':' || r || x, '') OVER (PARTITION BY c ORDER BY d)) AS k, strlen(x) AS bytes FROM placed
  UNION ALL SELECT c, 0, '', 0 FROM convs),
told AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS last FROM prefixes),
nodes AS (
  SELECT d, k, min(c) AS conv_id, any_value(up) AS up, count(*) AS n, (count(*) - 1) * max(bytes) AS v,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM told GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
sums AS (
  SELECT p.d, p.k, count(*) FILTER (kids.n IS NULL) AS leaves, sum(v) AS saved
  FROM nodes LEFT JOIN kids USING (d, k) JOIN prefixes p ON p.c = nodes.conv_id AND p.d <= nodes.d GROUP BY p.d, p.k)
SELECT n.conv_id, n.d::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN nodes o ON o.d = n.d - 1 AND o.k = n.up
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return trie.shared_beginnings(table(spark, sf_dir, "conversations"), group_limit=100_000)


@query("op13_spelling", f"""
WITH RECURSIVE runs AS (
  SELECT id, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') AS run, count(*) AS k
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '{spelling.RUN}')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
coded AS (SELECT run, k, {_sql_crc32("(id || ':' || run)")} AS h FROM runs),
words AS (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM coded)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
holes AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM holes),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.less = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.less = w.word),
best AS (SELECT word, count(*)::BIGINT AS n_near, min((-m, other)) AS best FROM pairs GROUP BY word),
judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * n THEN best[2] END AS form,
         CASE WHEN -best[1] >= 5 * n THEN -best[1] END AS form_n FROM words LEFT JOIN best USING (word)),
steps AS (
  SELECT word, word AS root FROM judged
  UNION SELECT steps.word, judged.form FROM steps JOIN judged ON steps.root = judged.word WHERE judged.form IS NOT NULL),
roots AS (SELECT steps.word, steps.root FROM steps JOIN judged ON steps.root = judged.word WHERE judged.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM judged JOIN roots USING (word)
""")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word of the whole texts."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op12_pii")
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts and digest of the base patterns, and all spans with those of the tagger."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(pii.draw_sample(docs)), ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
