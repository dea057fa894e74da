"""Registered queries of the operators: each applies one of them to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from mosarea.llm import bm25, chat, decontam, exact, merkle, minhash, packing, pii, quality, secrets, sharding, tokencount, trie
from mosarea.llm.maps import RESULT

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower_words(pattern: str, text: str = "text") -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


@_query(
    "op1_near_duplicates",
    rf"""
WITH RECURSIVE worded AS (SELECT doc_id, {_lower_words(r"[^\x20\x09-\x0D]+")} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS p FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
rare AS (
  SELECT s.doc_id, s.s, z.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.n, s.s) AS r
  FROM shingles s JOIN sizes z USING (doc_id) JOIN (SELECT s, count(*) AS n FROM shingles GROUP BY s) f ON f.s = s.s),
pairs AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM rare x JOIN rare y ON x.s = y.s AND x.doc_id < y.doc_id
  WHERE x.r <= x.n - ceil(0.8 * x.n - 1e-9) + 1 AND y.r <= y.n - ceil(0.8 * y.n - 1e-9) + 1 AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80),
links AS (
  SELECT a, b FROM pairs p JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND y.s = x.s
    JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b
  GROUP BY a, b, m.n, n.n HAVING count(*) * 100 >= (m.n + n.n - count(*)) * 80),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.label AS component_id, d.doc_id = c.label AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) JOIN (SELECT a, min(b) AS label FROM reach GROUP BY a) c ON c.a = d.doc_id""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


@_query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def site_columns() -> tuple[F.Column, F.Column]:
    """Host and path of a document: its source, and the source's part in one language."""
    return F.col("source"), F.concat_ws("/", "source", "lang")


@_query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = site_columns()
    judged = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), host, path, keep=["doc_id"])
    return judged.select(
        "doc_id",
        F.round("__evidence", 6).alias("evidence"),
        F.round("__prior", 6).alias("site_prior"),
        F.round("__posterior", 6).alias("quality"),
        F.col("__good").alias("keep"),
    )


@_query("op4_secrets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner, repository = site_columns()
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"), owner, repository)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secrets.spans_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] == "live")).cast("long").alias("n_live"),
    )


@_query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"]
    )
    over = F.col(f"{RESULT}.n_tokens") > 512
    return counted.select("doc_id", f"{RESULT}.n_bytes", f"{RESULT}.n_tokens", over.alias("over_limit"), f"{RESULT}.n_chunks", f"{RESULT}.n_widened")


@_query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    result = F.col(RESULT)
    return found.select(
        "doc_id",
        *[result[f"n_{kind}"].alias(f"n_{kind}") for kind in pii.KINDS],
        result["base_sha256"].alias("base_sha256"),
        pii.spans_text(result["spans"]).alias("spans"),
        result["n_added"].alias("n_added"),
    )


@_query(
    "op7_bm25_top_k",
    rf"""
WITH worded AS (SELECT doc_id, {_lower_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM documents),
totals AS (SELECT count(*) AS n, CAST(sum(len(w)) AS DOUBLE) / count(*) AS average FROM worded),
tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS word FROM worded) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
weights AS (
  SELECT tf.doc_id, word, CAST(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))) * 1000000) AS BIGINT) AS v
  FROM tf JOIN df USING (word) JOIN worded d ON d.doc_id = tf.doc_id, totals),
scores AS (
  SELECT q.doc_id AS query_id, x.doc_id, sum(x.v) AS score FROM weights q JOIN weights x USING (word) WHERE q.doc_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)
SELECT query_id, rank, doc_id, CAST(score AS DOUBLE) / 1000000 AS score FROM ranked WHERE rank <= 10""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.top_k(documents, documents.where("doc_id % 100 = 0"))


@_query(
    "op8_decontamination",
    rf"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM items WHERE len(w) > 0)),
spots AS (
  SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS words
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM lowered, (SELECT DISTINCT m FROM patterns) WHERE len(w) >= m)),
found AS (SELECT doc_id, item_id, p, s.m FROM spots s JOIN patterns USING (words)),
hits AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS spot FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM lowered d LEFT JOIN hits h USING (doc_id) LEFT JOIN named i USING (doc_id)""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    result = F.col(RESULT)
    return found.select(
        "doc_id",
        result["n_words"].alias("n_words"),
        decontam.n_hit(result).alias("n_hit"),
        F.size(result["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(result["item_ids"], ","), 256).alias("items_sha256"),
        decontam.contaminated(result).alias("contaminated"),
    )


EDGE_CONVERSATION = -7
EDGE_TEXT = "\\### Assistant: </turn> ok"


@_query(
    "op9_chat_format",
    r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(role) + 14 + CASE WHEN contains(text, '</turn>') OR contains(text, '### ') OR contains(text, '\b') OR contains(text, '\l') OR contains(text, '\h')
    THEN length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) ELSE length(text) END AS n FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    edge = spark.sql("SELECT * FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)").select(
        F.lit(EDGE_CONVERSATION).cast("long").alias("conv_id"), "turn", "role", F.lit(EDGE_TEXT).alias("text")
    )
    return chat.digest(chat.format_conversations(conversations.unionByName(edge)))


SHARD_BYTES = 16 << 20


@_query(
    "op10_sharding",
    f"""
WITH keyed AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, ('0x' || substr(md5(concat(
    coalesce('=' || md5(CAST(doc_id AS VARCHAR)), '~'), coalesce('=' || md5(text), '~'))), 1, 15))::BIGINT AS key FROM documents),
sums AS (
  SELECT depth, key >> (60 - depth) AS bucket, sum(bytes) AS shard_bytes, count(*) AS shard_rows
  FROM keyed, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS depth) GROUP BY ALL),
placed AS (
  SELECT k.doc_id, k.bytes, min(s.depth) AS depth, any_value(k.key) AS key FROM keyed k JOIN sums s ON s.bucket = k.key >> (60 - s.depth)
  WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1 GROUP BY k.doc_id, k.bytes, k.key)
SELECT p.doc_id, p.bytes, p.depth, CASE WHEN p.depth = 0 THEN '' ELSE lpad(bin(s.bucket), p.depth, '0') END AS shard_id,
  s.shard_rows, CAST(s.shard_bytes AS BIGINT) AS shard_bytes
FROM placed p JOIN sums s ON s.depth = p.depth AND s.bucket = p.key >> (60 - p.depth)""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), SHARD_BYTES)


#: unsigned CRC-32 in SQL, from its polynomial
CRC_TABLE = """SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i))"""


def crc32_sql(number: str) -> str:
    """CRC-32 of a number's decimal digits."""
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars")


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in (*LEAF_COLUMNS, text)]
    return f"sha256({' || '.join(parts)})"


def _tree_sql(name: str, leaves: str) -> str:
    """All nodes of the trees over ``tree, i, h, n``, and left and right siblings of each."""
    return f"""{name}(tree, level, i, h, n) AS (
  SELECT tree, 0, i, h, n FROM ({leaves})
  UNION ALL SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, level, i // 3, n),
{name}_steps AS (
  SELECT x.tree, x.level, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r
  FROM {name} x JOIN {name} y ON y.tree = x.tree AND y.level = x.level AND y.i // 3 = x.i // 3 WHERE x.n > 1 GROUP BY ALL)"""


@_query(
    "op11_merkle_manifest",
    f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
tampered AS (SELECT *, CASE WHEN {crc32_sql("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents, crc),
hashed AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("changed")} AS claimed FROM tampered),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS n FROM hashed),
{_tree_sql("nodes", "SELECT tree, i, leaf AS h, n FROM leaves")},
subroots AS (SELECT tree, level, h FROM nodes WHERE n = 1),
{_tree_sql("tops", "SELECT 0 AS tree, tree AS i, h, count(*) OVER () AS n FROM subroots")},
paths AS (
  SELECT p.tree, p.i, s.level AS step, s.l, s.r FROM leaves p JOIN nodes_steps s ON s.tree = p.tree AND s.i = p.i // CAST(power(3, s.level) AS BIGINT)
  UNION ALL SELECT p.tree, p.i, u.level + s.level, s.l, s.r FROM leaves p JOIN subroots u ON u.tree = p.tree JOIN tops_steps s ON s.i = p.tree // CAST(power(3, s.level) AS BIGINT)),
proofs AS (SELECT tree, i, string_agg(l || r, '' ORDER BY step) AS proof, list(l || '|' || r ORDER BY step) AS steps FROM paths GROUP BY ALL),
folded AS (
  SELECT x.*, coalesce(proof, '') AS proof, list_reduce(list_concat([claimed], coalesce(steps, [])), lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) AS folded_root
  FROM leaves x LEFT JOIN proofs p ON p.tree = x.tree AND p.i = x.i)
SELECT doc_id, leaf, u.h AS subroot, o.h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = o.h AS verified
FROM folded f JOIN subroots u ON u.tree = f.tree, (SELECT h FROM tops WHERE n = 1) o""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in LEAF_COLUMNS]
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 != 0
    changed = F.when(F.coalesce(odd, F.lit(True)), F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("")))
    leaves = documents.select(
        "doc_id", "source", merkle.leaf_digest([*columns, F.col("text")]).alias("digest"), merkle.leaf_digest([*columns, changed]).alias("claimed")
    )
    return merkle.build_manifest(leaves, "source", "doc_id").verify("doc_id", "claimed")


def shared_heads(sequences: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the first one of its hundred; CRC-32 of its number says how many."""
    heads = sequences.where("conv % 100 = 0").select(F.col("conv").alias("base"), *[F.slice(c, 1, 5 * k).alias(f"base_{c}") for c, k in (("ids", 2), ("lens", 1))])
    taken = (F.crc32(F.col("conv").cast("string")) % 6).cast("int")
    joined = sequences.withColumn("base", F.col("conv") - F.col("conv") % 100).join(heads, "base", "left").withColumn("h", taken)

    def spliced(column: str, width: int) -> F.Column:
        head = F.coalesce(F.slice(f"base_{column}", F.lit(1), F.col("h") * width), F.array().cast("array<long>"))
        own = F.slice(column, F.col("h") * width + 1, F.greatest(F.size(column) - F.col("h") * width, F.lit(0)))
        return F.concat(head, own)

    return joined.select("conv", spliced("ids", 2).alias("ids"), spliced("lens", 1).alias("lens"))


@_query(
    "op12_prefix_trie",
    f"""
WITH crc AS ({CRC_TABLE}),
own AS (
  SELECT conv_id, list(md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) ORDER BY turn NULLS FIRST, role, text) AS keys,
    list(length(coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS lens FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
counted AS (SELECT conv_id, keys, lens, {crc32_sql("conv_id")} % 6 AS h FROM own, crc),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.keys[1:h], []), c.keys[h + 1:]) AS keys, list_concat(coalesce(b.lens[1:h], []), c.lens[h + 1:]) AS lens
  FROM counted c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefixes AS (SELECT conv_id, d, array_to_string(keys[1:d], '') AS node, len(keys) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE lens[d] END AS chars
  FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, min(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node, d),
children AS (SELECT left(node, 32 * (d - 1)::INT) AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT left(x.node, 32 * a) AS node, count(*) FILTER (c.n IS NULL) AS leaves, sum((x.n - 1) * x.chars) AS saved
  FROM (SELECT *, CAST(unnest(range(0, d + 1)) AS INT) AS a FROM nodes) x LEFT JOIN children c ON c.node = x.node GROUP BY 1)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM nodes x JOIN below b ON b.node = x.node LEFT JOIN children c ON c.node = x.node LEFT JOIN nodes p ON x.d > 0 AND p.node = left(x.node, 32 * (x.d - 1)::INT)""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(shared_heads(trie.sequences(_table(spark, sf_dir, "conversations"))))


@_query(
    "op13_exact_dedup",
    r"""
WITH bare AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
ranked AS (
  SELECT doc_id, content, first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size FROM bare)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM ranked""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))
