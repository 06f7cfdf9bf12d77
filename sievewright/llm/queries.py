"""The queries of the problems on text, and the SQL that equals them where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import authored, garble, langdata, language, leakage, packing, spans, uniform


def _table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


# ASCII alone is neither garbled nor out of form
_BEYOND_ASCII = "octet_length(text) <> length(text)"


# Problem 1 ------------------------------------------------------------------------------------------------


def _garbled(spark: SparkSession, at: str) -> DataFrame:
    """(msg_id, field_name, text, restored, chain) of every garbled field; a message listed twice may be there twice."""
    model = garble.fit_on(_table(spark, at, "documents"))
    parsed, summary = _table(spark, at, "mail_parsed"), _table(spark, at, "mail_summary")
    field = lambda df, name, column: df.select("msg_id", F.lit(name).alias("field_name"), F.col(column).alias("text"))
    fields = field(parsed, "text_body", "text_body").unionByName(field(parsed, "subject", "subject")).unionByName(field(summary, "message_from", "message_from"))
    return garble.restore(fields.filter(_BEYOND_ASCII), "text", model).filter("chain IS NOT NULL")


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    """Fields that contain text garbled by a wrong encoding."""
    return _garbled(spark, at).select("msg_id", "field_name").distinct()


def p1_restored(spark: SparkSession, at: str) -> DataFrame:
    """Garbled fields with the chain undone, whether all of it came back, and a hash of the restored text."""
    g = _garbled(spark, at)
    return g.select("msg_id", "field_name", "chain", (~F.contains("chain", F.lit("lost"))).alias("whole"), F.sha2("restored", 256).alias("sha256")).dropDuplicates(["msg_id", "field_name"])


def p1_chains(spark: SparkSession, at: str) -> DataFrame:
    """How many fields each chain garbled."""
    return p1_restored(spark, at).groupBy("field_name", "chain").agg(F.count("*").alias("n"))


# Problem 2 ------------------------------------------------------------------------------------------------


def _languages(spark: SparkSession, at: str) -> DataFrame:
    """Languages of every body; a message listed twice may be there twice."""
    model = language.fit_on(_table(spark, at, "documents"))
    return language.identify(_table(spark, at, "mail_parsed").filter("text_body IS NOT NULL"), model, "msg_id", "text_body", "subject")


def _label_code(column: str) -> Column:
    """The language that a label names, null if it says nothing."""
    return langdata.label_column(F.col(column))


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    """The languages of messages whose label is missing, wrong or not the only one."""
    model = language.fit_on(_table(spark, at, "documents"))
    mails = _table(spark, at, "mail_parsed").select("msg_id", "content_language", "text_body", "subject").filter("text_body IS NOT NULL")
    with_label = mails.select(F.struct("msg_id", _label_code("content_language").alias("code")).alias("k"), "text_body", "subject")
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    found = language.identify(with_label, model, "k", "text_body", "subject").select("k.*", langs.alias("langs"))
    case = F.col("code").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("code"))
    return found.filter(case).select("msg_id", F.explode("langs").alias("lang")).distinct()


def p2_documents(spark: SparkSession, at: str) -> DataFrame:
    """The main language of every body with its confidence."""
    return _languages(spark, at).select("msg_id", "lang", F.round("confidence", 4).alias("confidence")).distinct()


def p2_segments(spark: SparkSession, at: str) -> DataFrame:
    """Every passage in one language with its confidence."""
    s = _languages(spark, at).select("msg_id", F.explode("segments").alias("s"))
    return s.select("msg_id", "s.segment_no", "s.lang", F.round("s.confidence", 4).alias("confidence"), "s.n_sentences", "s.n_chars").distinct()


# Problem 3 ------------------------------------------------------------------------------------------------

def _bodies(spark: SparkSession, at: str) -> DataFrame:
    return _table(spark, at, "mail_parsed").select(F.lit("parsed.text_body").alias("field_name"), F.col("msg_id").cast("string").alias("record_key"), F.col("text_body").alias("text"))


def _subjects(spark: SparkSession, at: str) -> DataFrame:
    return _table(spark, at, "mail_summary").select(F.lit("summary.subject").alias("field_name"), F.col("msg_id").cast("string").alias("record_key"), F.col("subject").alias("text"))


def _keys(spark: SparkSession, at: str) -> DataFrame:
    key = F.concat(F.coalesce("registry", F.lit("")), F.lit("|"), F.col("entry_key"))
    return _table(spark, at, "registry_change").select(F.lit("entry.key").alias("field_name"), key.alias("record_key"), F.col("entry_key").alias("text")).distinct()


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    """Values that are not in consistent form."""
    out = None
    for values in (_bodies, _subjects, _keys):
        case = uniform.to_consistent(values(spark, at).filter(_BEYOND_ASCII), "text").filter("inconsistent").select("field_name", "record_key")
        out = case if out is None else out.unionByName(case)
    return out.distinct()


def p3_keys(spark: SparkSession, at: str) -> DataFrame:
    """Entry keys that become equal in consistent form: the form, and how many stored keys share it."""
    k = uniform.to_consistent(_keys(spark, at).select(F.split_part("record_key", F.lit("|"), F.lit(1)).alias("registry"), "text"), "text")
    return k.groupBy("registry", "consistent").agg(F.count("*").alias("n_stored")).filter("n_stored > 1")


def p3_subjects(spark: SparkSession, at: str) -> DataFrame:
    """Subjects that change, with their consistent form."""
    s = uniform.to_consistent(_subjects(spark, at).filter(_BEYOND_ASCII), "text").filter("inconsistent")
    return s.select(F.col("record_key").cast("bigint").alias("msg_id"), "consistent").distinct()


def p3_bodies(spark: SparkSession, at: str) -> DataFrame:
    """Bodies that change: length before and after, and a hash of the consistent form."""
    b = uniform.to_consistent(_bodies(spark, at).filter(_BEYOND_ASCII), "text").filter("inconsistent")
    return b.select(F.col("record_key").cast("bigint").alias("msg_id"), F.length("text").cast("bigint").alias("n_before"), F.length("consistent").cast("bigint").alias("n_after"), F.sha2("consistent", 256).alias("sha256")).distinct()


# Problem 6 ------------------------------------------------------------------------------------------------


def p6_found(spark: SparkSession, at: str) -> DataFrame:
    """Lines of bodies that their senders did not newly write."""
    return authored.foreign_lines(_table(spark, at, "mail_parsed"))


def p6_authored(spark: SparkSession, at: str) -> DataFrame:
    """What each sender newly wrote: its length and a hash."""
    mails = _table(spark, at, "mail_parsed")
    own = authored.authored_text(mails, authored.foreign_lines(mails))
    return own.select("msg_id", F.length("authored").cast("bigint").alias("n_chars"), F.sha2("authored", 256).alias("sha256"))


# Problem 7 ------------------------------------------------------------------------------------------------


def p7_assignment(spark: SparkSession, at: str) -> DataFrame:
    """The place of every text in containers of every capacity."""
    return packing.pack(_table(spark, at, "documents"), _table(spark, at, "container_spec"))


def p7_fill(spark: SparkSession, at: str) -> DataFrame:
    """Containers used per capacity and how full they are."""
    return packing.fill(p7_assignment(spark, at), _table(spark, at, "container_spec"))


def p7_steps(spark: SparkSession, at: str) -> DataFrame:
    """Tokens and containers of every step group."""
    a = p7_assignment(spark, at).filter("container_no IS NOT NULL")  # texts without tokens are in no container
    return a.groupBy("container_id", "tier", "step").agg(F.countDistinct("container_no").alias("n_containers"), F.sum("n_tokens").alias("tokens"))


# Problem 8 ------------------------------------------------------------------------------------------------


def _passages(spark: SparkSession, at: str) -> DataFrame:
    return leakage.leaked_passages(_table(spark, at, "documents"), _table(spark, at, "eval_item"))


def p8_found(spark: SparkSession, at: str) -> DataFrame:
    """Documents and items that share at least 13 consecutive words."""
    return _passages(spark, at).select("doc_id", "item_id").distinct()


def p8_passages(spark: SparkSession, at: str) -> DataFrame:
    """Every maximal verbatim match with its places and its length in words."""
    return _passages(spark, at)


def p8_items(spark: SparkSession, at: str) -> DataFrame:
    """Every item with the number of documents that hold a passage of it and the longest match."""
    found = leakage.leaks(_passages(spark, at)).groupBy(F.col("item_id").alias("found_id")).agg(F.count("*").alias("n"), F.max("longest").alias("longest"))
    items = _table(spark, at, "eval_item")
    return items.join(found, items["item_id"] == found["found_id"], "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"), F.coalesce("longest", F.lit(0)).alias("longest"))


def p8_clean(spark: SparkSession, at: str) -> DataFrame:
    """The documents that stay when the affected ones are removed."""
    docs = _table(spark, at, "documents")
    return leakage.without_leaks(docs, _passages(spark, at)).select("doc_id", "n_chars")


# Problem 9 ------------------------------------------------------------------------------------------------


def p9_found(spark: SparkSession, at: str) -> DataFrame:
    """Maximal runs of characters that lie in stretches of 300 or more which another document has too."""
    return spans.shared_spans(_table(spark, at, "documents"))


def p9_shares(spark: SparkSession, at: str) -> DataFrame:
    """Per document, how much of it is shared."""
    docs = _table(spark, at, "documents")
    return spans.shared_shares(docs, spans.shared_spans(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p1_chains, p2_found, p2_documents, p2_segments, p3_found, p3_keys, p3_subjects, p3_bodies, p6_found, p6_authored, p7_assignment, p7_fill, p7_steps, p8_found, p8_passages, p8_items, p8_clean, p9_found, p9_shares)}
_GRAMS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item),
dg AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
eg AS (SELECT item_id, j, array_to_string(w[j:j + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS j FROM e)),
hit AS (SELECT DISTINCT doc_id, item_id, k, j FROM dg JOIN eg USING (g)),
island AS (SELECT doc_id, item_id, k, j, k - row_number() OVER (PARTITION BY doc_id, item_id, k - j ORDER BY k) AS run FROM hit),
passage AS (SELECT doc_id, item_id, min(k) - 1 AS doc_word, min(j) - 1 AS item_word, count(*) + 12 AS n_words FROM island GROUP BY doc_id, item_id, k - j, run)
"""
_SPANS = """
WITH w AS (SELECT doc_id, i, hash(substring(text, i + 1, 300)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 299)) AS i FROM documents)),
r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 300 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN r USING (h)),
n AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m),
span AS (SELECT doc_id, min(i)::BIGINT AS span_start, (max(i) + 300)::BIGINT AS span_end FROM n GROUP BY doc_id, run)
"""
SQL: dict[str, str] = {
    "p8_found": _GRAMS + "SELECT DISTINCT doc_id, item_id FROM hit",
    "p8_passages": _GRAMS + "SELECT * FROM passage",
    "p8_items": _GRAMS + "SELECT i.item_id, count(DISTINCT p.doc_id) AS n_documents, coalesce(max(p.n_words), 0) AS longest FROM eval_item i LEFT JOIN passage p ON i.item_id = p.item_id GROUP BY i.item_id",
    "p8_clean": _GRAMS + "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)",
    "p9_found": _SPANS + "SELECT doc_id, span_start, span_end FROM span",
    "p9_shares": _SPANS
    + """, s AS (SELECT doc_id, sum(span_end - span_start)::BIGINT AS n FROM span GROUP BY doc_id)
SELECT d.doc_id, length(d.text) AS n_chars, coalesce(s.n, 0) AS shared_chars, CASE WHEN length(d.text) > 0 THEN round(coalesce(s.n, 0) / length(d.text), 6) ELSE 0 END AS share
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id""",
}
