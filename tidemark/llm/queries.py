"""The driver's queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, licenses, lm
from .common import table
from .licenses import license_scan
from .mixing import mix
from .neardup import near_duplicates
from .quality import quality
from .sentencepiece_scan import encode
from .sharding import stratified_shards
from .tokencount import token_counts
from .unigram import Vocabulary

#: The pieces of a public tokenizer.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Where a Debian system keeps full licence texts; without the folder there are the notices alone.
LICENSE_TEXTS = "/usr/share/common-licenses"


def _remainder(key: str, by: int):
    """crc32 of the key as text, modulo ``by``."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (_remainder("doc_id", 4) == 2).alias("held_out"))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op2_licenses(spark: SparkSession, sf_dir: str, texts: str = LICENSE_TEXTS) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return license_scan(docs, "doc_id", "path", "text", licenses.templates(texts))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op4_token_counts(spark: SparkSession, sf_dir: str, pieces: str = PIECES) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), Vocabulary.read(pieces), keep=["doc_id"])


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (_remainder("doc_id", 7) == 2).alias("held_out"))
    model = lm.fit(docs.where(~F.col("held_out")))
    return lm.score(docs, model, keep=["doc_id", "held_out"])


def op6_sentencepiece(spark: SparkSession, sf_dir: str, pieces: str = PIECES) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents"), Vocabulary.read(pieces), keep=["doc_id"], verify=True)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    dealt = stratified_shards(docs, "doc_id", "source", 16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = ann.build(rows, "vec_id", "embedding")
    return ann.search(index, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 20)


def queries() -> dict:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and name[2].isdigit()}


NEARDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words), 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
root AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN root ON root.a = w.doc_id
"""


def licenses_sql(texts: str = LICENSE_TEXTS) -> str:
    """The license scan over the same templates."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, {i}, {quoted(text)})" for name, texts in sorted(licenses.templates(texts).items()) for i, text in enumerate(texts))
    term, square = quoted(licenses.TERM), licenses.THRESHOLD**2
    return f"""
WITH docs AS (SELECT doc_id, text, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path FROM documents),
tpl AS (SELECT * FROM (VALUES {rows}) AS t(license, template, text)),
tt AS (SELECT license, template, term, count(*) AS n FROM (SELECT license, template, unnest(regexp_extract_all(lower(text), {term})) AS term FROM tpl) GROUP BY ALL),
vocab AS (SELECT DISTINCT term FROM tt),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), {term})) AS term FROM docs) JOIN vocab USING (term) GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM docs)) / (1.0 + coalesce(df, 0))) + 1 AS idf FROM vocab LEFT JOIN df USING (term)),
tw AS (SELECT license, template, term, n, (1 + ln(n)) * idf AS w FROM tt JOIN idf USING (term)),
unit AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY license, template)) AS u, sum(n) OVER (PARTITION BY license, template) AS size FROM tw),
model AS (SELECT license, template, term, u, CASE WHEN size <= {licenses.HEADER_WORDS} THEN size ELSE 0 END AS words,
  1 - coalesce(sum(u * u) OVER (PARTITION BY license, template ORDER BY u DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {square} AS anchor FROM unit),
anchors AS (SELECT list(DISTINCT term) AS every, list(DISTINCT term) FILTER (words > 0) AS head FROM model WHERE anchor),
near AS (SELECT doc_id, text, terms FROM (SELECT doc_id, text, regexp_extract_all(lower(text), {term}) AS terms FROM docs WHERE text IS NOT NULL), anchors WHERE list_has_any(terms, every)),
lines AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, {quoted(licenses.SENTENCE)}, '\\1' || chr(10), 'g'), chr(10)), lambda x: regexp_extract_all(lower(x), {term})) AS l FROM near),
first AS (SELECT doc_id, l, i FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines), anchors WHERE list_has_any(l[i], head) OR coalesce(list_has_any(l[i + 1], head), false)),
parts AS (
  SELECT doc_id, 0 AS pos, 0 AS width, terms FROM near
  UNION ALL SELECT doc_id, i, width, flatten(l[i:i + 2 * width - 1])[1:width] FROM first, (SELECT DISTINCT CAST(words AS BIGINT) AS width FROM model WHERE words > 0)),
told AS (SELECT * FROM parts WHERE len(terms) > {licenses.NEGATED_WORDS} OR NOT regexp_matches(array_to_string(terms, ' '), {quoted(licenses.NEGATED)})),
counted AS (SELECT doc_id, pos, width, term, count(*) AS n FROM (SELECT doc_id, pos, width, unnest(terms) AS term FROM told) GROUP BY ALL),
weighed AS (SELECT c.*, (1 + ln(n)) * coalesce(idf, ln(1 + (SELECT count(*) FROM docs)) + 1) AS w FROM counted c LEFT JOIN idf USING (term)),
norms AS (SELECT doc_id, pos, width, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
dots AS (SELECT doc_id, pos, width, license, template, sum(weighed.w * u) AS dot FROM weighed JOIN model USING (term) WHERE pos = 0 OR width = words GROUP BY ALL),
scored AS (SELECT doc_id, pos, license, round(least(1.0, dot / norm), 6) AS score FROM dots JOIN norms USING (doc_id, pos, width)),
best AS (SELECT doc_id, pos = 0 AS whole, license, score FROM scored WHERE score >= {licenses.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos > 0, score DESC, license) = 1),
own AS (
  SELECT d.doc_id, d.path, regexp_replace(d.path, '/?[^/]*$', '') AS dir, b.license, b.score,
    b.license IS NOT NULL AND (regexp_matches(regexp_extract(d.path, '([^/]*)$', 1), {quoted(licenses.FILE_NAME)}) OR whole) AS file
  FROM docs d LEFT JOIN best b USING (doc_id)),
given AS (SELECT dir, license, score FROM own WHERE file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
steps AS (SELECT dir, i AS depth, array_to_string(string_split(dir, '/')[1:i], '/') AS above FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS i FROM (SELECT DISTINCT dir FROM own WHERE license IS NULL))),
near_dir AS (SELECT s.dir, s.above, g.license, g.score FROM steps s JOIN given g ON s.above = g.dir QUALIFY row_number() OVER (PARTITION BY s.dir ORDER BY depth DESC) = 1)
SELECT o.doc_id, o.path, coalesce(o.license, n.license) AS license, CASE WHEN o.license IS NOT NULL THEN o.score ELSE n.score END AS score,
  CASE WHEN o.license IS NOT NULL AND file THEN 'file' WHEN o.license IS NOT NULL THEN 'header' WHEN n.dir IS NOT NULL THEN 'inherited' END AS via,
  CASE WHEN o.license IS NULL THEN n.above END AS from_dir
FROM own o LEFT JOIN near_dir n ON o.dir = n.dir
"""


ANN_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v) AS score
  FROM e AS q JOIN e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": licenses_sql(), "op3_neardup": NEARDUP_SQL, "op10_ann": ANN_SQL}
