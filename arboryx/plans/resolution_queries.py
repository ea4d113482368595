"""Queries of entity resolution, concept tags and Markdown sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from arboryx.operators import markdown, resolution

from .registry import query

_LANGUAGES = ["en", "de", "fr"]


def _parts(t):
    return t.part.withColumn("name", F.concat_ws(" ", "p_name", "p_brand"))


def _mentions(t):
    """A mention per order line: the part's name, sometimes in capitals; its label follows the size."""
    lines = t.lineitem.join(_parts(t), F.col("l_partkey") == F.col("p_partkey"))
    spelt = F.when(F.col("l_linenumber") % 3 == 0, F.upper("name")).otherwise(F.col("name"))
    return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mention_id"), spelt.alias("text"), F.concat(F.lit("L"), (F.col("p_size") % 4).cast("string")).alias("ner"))


def _aliases(t):
    """English names as they are; German ones of every third part in capitals, French ones of every second."""
    key, name = F.col("p_partkey"), F.col("name")
    per = [("en", name), ("de", F.when(key % 3 == 0, F.upper(name)).otherwise(name)), ("fr", F.when(key % 2 == 0, name))]
    made = F.explode(F.array(*[F.struct(F.lit(language).alias("language"), alias.alias("alias")) for language, alias in per])).alias("a")
    return _parts(t).select(F.concat(F.lit("Q"), key.cast("string")).alias("entity"), made).where("a.alias IS NOT NULL").select("entity", "a.language", "a.alias", F.lit(0).alias("ordinal"))


_RESOLVED = """p AS (SELECT *, p_name || ' ' || p_brand AS name, 'Q' || p_partkey AS entity FROM part),
m AS (SELECT l_orderkey * 10 + l_linenumber AS mention_id, CASE WHEN l_linenumber % 3 = 0 THEN upper(name) ELSE name END AS text, 'L' || (p_size % 4) AS ner FROM lineitem JOIN p ON l_partkey = p_partkey),
nf AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS form FROM m),
cs AS (SELECT form, ner, text, count(*) AS n, min(mention_id) AS fst FROM nf GROUP BY ALL),
g AS (SELECT form, ner, first(text ORDER BY n DESC, fst) AS text, CAST(sum(n) AS BIGINT) AS mentions FROM cs GROUP BY ALL),
al AS (SELECT entity, 'en' AS language, name AS alias FROM p UNION ALL SELECT entity, 'de', CASE WHEN p_partkey % 3 = 0 THEN upper(name) ELSE name END FROM p UNION ALL SELECT entity, 'fr', name FROM p WHERE p_partkey % 2 = 0),
hit AS (SELECT DISTINCT g.form, g.ner, g.text, al.entity FROM g JOIN al ON trim(regexp_replace(lower(al.alias), '[^a-z0-9]+', ' ', 'g')) = g.form WHERE g.ner <> 'L3'),
sv AS (SELECT hit.* FROM hit JOIN p USING (entity) WHERE ner = 'L0' OR (ner = 'L1' AND p_size % 2 = 1) OR (ner = 'L2' AND p_partkey % 7 = 0)),
ev AS (SELECT form, ner, entity, count(DISTINCT language) FILTER (alias = text) AS exact, count(DISTINCT language) FILTER (lower(alias) = lower(text)) AS cased, count(DISTINCT language) AS found FROM sv JOIN al USING (entity) GROUP BY ALL),
b AS (SELECT form, ner, count(*) AS left_over, max(exact) AS exact, first(entity ORDER BY cased DESC, found DESC, entity DESC) AS best, max(cased) AS cased FROM ev GROUP BY ALL),
r AS (SELECT g.*, b.*  EXCLUDE (form, ner), CASE WHEN left_over = 1 AND exact >= 2 THEN 4 WHEN cased >= 2 THEN 3 ELSE 0 END AS tier FROM g LEFT JOIN b USING (form, ner))
"""


@query(
    f"WITH {_RESOLVED} SELECT r.form, r.ner, mentions, tier, CASE WHEN tier > 0 THEN best END AS entity, CASE WHEN tier > 0 THEN name ELSE text END AS label,"
    " CAST(CASE tier WHEN 4 THEN 0.9 WHEN 3 THEN 0.75 ELSE 0.5 END AS DOUBLE) AS confidence,"
    " CASE WHEN r.ner = 'L3' THEN 'label is not looked up' WHEN (r.form, r.ner) NOT IN (SELECT (form, ner) FROM hit) THEN 'no candidate' WHEN left_over IS NULL THEN 'no candidate of an accepted type'"
    " WHEN tier = 0 THEN 'names agree too little' END AS reason FROM r LEFT JOIN p ON p.entity = best AND tier > 0"
)
def entity_resolution(t):
    """Names of parts in order lines resolved to parts by three languages' names, with a filter by size and number."""
    aliases = _aliases(t)
    candidates = aliases.select(F.trim(F.regexp_replace(F.lower("alias"), "[^a-z0-9]+", " ")).alias("form"), "language", "entity").distinct()
    kinds = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 1, "odd"), F.when(F.col("p_partkey") % 7 == 0, "seventh")))
    types = t.part.select(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("entity"), F.explode(kinds).alias("type"))
    accepted = t.spark.createDataFrame([("L0", None), ("L1", "odd"), ("L2", "seventh")], "ner string, type string")
    return resolution.cascade(resolution.mention_groups(_mentions(t)), candidates, aliases, types, accepted, _LANGUAGES)


@query(
    "SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS tags FROM (SELECT p_partkey, list_filter([p_name, p_type, p_brand, p_type], lambda x, i: list_position([p_name, p_type, p_brand, p_type], x) = i) AS list_distinct_ordered FROM part)"
)
def concept_tags(t):
    tags = resolution.concept_tags(F.concat(F.lit(" "), "p_name", F.lit(" ")), F.array("p_type", F.lit(""), "p_brand", F.lit(None).cast("string")), F.col("p_type"))
    return t.part.select("p_partkey", F.array_join(tags, "|").alias("tags"))


_MD = r"""md AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '# ' || lang || ' ' || coalesce(source, '') || ' #' || chr(10) END || '[a](b) ![c](d) [a](b)' || chr(10) || '```' || chr(10) || '# no' || chr(10) || '```' || chr(10)
  || CASE WHEN doc_id % 5 = 0 THEN text ELSE replace(text, '. ', chr(10) || '## ') END AS text FROM documents),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM md),
fc AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^ {0,3}(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) % 2 = 1 AS fenced FROM ln),
hd AS (SELECT *, NOT fenced AND regexp_matches(line, '^ {0,3}#{1,2}[ \t]+.*$') AS head FROM fc),
sc AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY no) AS section FROM hd),
pt AS (SELECT doc_id, section, min(line) FILTER (head) AS line, min(no) AS line_start, max(no) + 1 AS nxt, string_agg(line, chr(10) ORDER BY no) FILTER (NOT head) AS body FROM sc GROUP BY ALL),
ls AS (SELECT *, max(section) OVER (PARTITION BY doc_id) AS last_ FROM pt)"""


@query(
    rf"WITH {_MD}, o AS (SELECT doc_id AS id, section, CASE WHEN section = 0 THEN CAST(doc_id AS VARCHAR) ELSE trim(regexp_extract(line, '^ {{0,3}}(#{{1,2}})[ \t]+(.*?)([ \t]+#+)?[ \t]*$', 2)) END AS heading,"
    " line_start, CASE WHEN section < last_ THEN nxt END AS line_end, CASE WHEN section = 0 THEN body ELSE trim(coalesce(body, ''), chr(10)) END AS body FROM ls WHERE section > 0 OR last_ = 0)"
    r" SELECT id, CAST(section AS BIGINT) AS section, heading, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, md5(body) AS body,"
    r" CAST(len(list_distinct(list_filter(regexp_extract_all(' ' || body, '(.)\[([^\]\n]+)\]\(([^)\n]+)\)'), lambda x: NOT starts_with(x, '!')))) > 0 AS INTEGER) AS linked FROM o"
)
def markdown_sections(t):
    """Documents written as Markdown, sentences as headings of level two, a fence and links in all."""
    head = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("# "), "lang", F.lit(" "), F.coalesce("source", F.lit("")), F.lit(" #\n")))
    rest = F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.replace("text", F.lit(". "), F.lit("\n## ")))
    docs = t.documents.select("doc_id", F.concat(head, F.lit("[a](b) ![c](d) [a](b)\n```\n# no\n```\n"), rest).alias("text"))
    out = markdown.sections(docs, "doc_id")
    return out.select("id", "section", "heading", "line_start", "line_end", F.md5("body").alias("body"), (F.size("links") > 0).cast("int").alias("linked"))


@query(
    r"WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS ls FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS no, unnest(ls) AS raw FROM l),"
    r" m AS (SELECT doc_id, no, CASE WHEN no % 4 = 0 THEN '**' || substr(md5(raw), 1, 5) || '**  ' WHEN no % 4 = 1 AND doc_id % 2 = 0 THEN ' ' WHEN no % 7 = 3 THEN '' ELSE replace(replace(raw, chr(13), ' '), chr(10), ' ') END AS line FROM e),"
    r" n AS (SELECT doc_id, no, regexp_replace(line, '\s+$|^\s+', '', 'g') AS line FROM m), t AS (SELECT *, regexp_matches(line, '^\*\*([^*\n]+?)\*\*\s*$') AS term FROM n), p AS (SELECT *, sum(term::INT) OVER (PARTITION BY doc_id ORDER BY no) AS place FROM t),"
    r" f AS (SELECT *, min(no) FILTER (NOT term AND line <> '') OVER (PARTITION BY doc_id, place) AS first_ FROM p WHERE place > 0), g AS (SELECT *, min(no) FILTER (line = '' AND no > first_) OVER (PARTITION BY doc_id, place) AS end_ FROM f)"
    r" SELECT doc_id AS id, CAST(place AS BIGINT) AS place, max(CASE WHEN term THEN trim(line, '* ') END) AS term, md5(string_agg(line, ' ' ORDER BY no) FILTER (NOT term AND no >= first_ AND (end_ IS NULL OR no < end_))) AS definition FROM g GROUP BY 1, 2 HAVING count(*) FILTER (NOT term AND no >= first_ AND (end_ IS NULL OR no < end_)) > 0"
)
def markdown_glossary(t):
    """Documents whose every fourth sentence is a term in bold, blank lines between."""
    one = lambda x, i: (
        F.when(i % 4 == 0, F.concat(F.lit("**"), F.substring(F.md5(x), 1, 5), F.lit("**  "))).when((i % 4 == 1) & (F.col("doc_id") % 2 == 0), " ").when(i % 7 == 3, "").otherwise(F.replace(F.replace(x, F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" ")))
    )
    docs = t.documents.where("text is not null").select("doc_id", F.array_join(F.transform(F.split("text", "\\. "), one), "\n").alias("text"))
    return markdown.glossary(docs, "doc_id").withColumn("definition", F.md5("definition"))
