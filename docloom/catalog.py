"""All queries of the library by name, each with the SQL that gives the same rows.

A query takes the session and a folder of tables. The tables are no business
documents, so each operator runs on the nearest table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import dates
from docloom.functions import text as T
from docloom.operators import chunks, classify, evaluate, merge, packages, report, retrieval, rules, specs
from docloom.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squished(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


LINES_SQL = "SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


# --- Sources ---------------------------------------------------------------


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    """S4."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query(
    r"""SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([^./]+)$', 1)) AS suffix,
    substr(trim(regexp_replace(lower(regexp_replace(string_split(url, '/')[-1], '\.[^.]*$', '')), '[^\p{L}\p{N}]+', '-', 'g'), '-'), 1, 48) || '-' || substr(sha256(coalesce(html, '')), 1, 8) AS doc_id,
    string_split(url, '/')[-2] AS folder FROM pages"""
)
def document_ids(spark, sf_dir):
    """S2, S5, G1."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.lower(F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"\.([^./]+)$", 1)).alias("suffix"), files.doc_id(F.col("url"), F.sha2(F.coalesce("html", F.lit("")), 256)).alias("doc_id"), packages.folder(F.col("url")).alias("folder"))


@query(
    r"""SELECT page_id, """
    + squished(r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>|<footer[^>]*>.*?</footer>|<header[^>]*>.*?</header>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')")
    + " AS text FROM pages"
)
def html_strip(spark, sf_dir):
    """S12 without Python: what is left when elements without content and all tags are cut."""
    x = F.regexp_replace("html", r"(?is)<(script|style|nav|footer|header)[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    return table(spark, sf_dir, "pages").select("page_id", T.squish(x).alias("text"))


@query(r"SELECT page_id, coalesce(nullif(" + squished(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + r", ''), " + squished(r"regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)") + ") AS title FROM pages")
def html_title(spark, sf_dir):
    """S16."""
    title, h1 = (T.squish(F.regexp_extract("html", rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1)) for t in ("title", "h1"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.nullif(title, F.lit("")), h1).alias("title"))


@query()
def html_blocks(spark, sf_dir):
    """S12 to S16 with the parser: blocks per page and kind."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.lit("html").alias("file_format"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content"))
    blocks, _ = files.parse(p)
    return blocks.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("text").alias("last_text"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, sf_dir):
    """K1's counterpart: a value out of JSON."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL) OR text IS NULL")
def anti_new_files(spark, sf_dir):
    """Documents whose content the cache (that of labelled documents) does not have yet."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    cached = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("content_hash", F.lit("2").alias("version"))
    return files.unparsed(docs, cached, "2").select("doc_id", "content_hash")


@query(
    f"""WITH l AS (SELECT DISTINCT source, doc_id, trim(line) AS line FROM ({LINES_SQL}) WHERE trim(line) <> ''),
    p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1)
    SELECT source, line FROM l JOIN p USING (source) WHERE pages >= 3 GROUP BY source, line, pages HAVING count(*) >= greatest(3, floor(pages * 0.05))"""
)
def running_lines(spark, sf_dir):
    """N8, with a source as document and a document as page."""
    own = lines(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), "line")
    return files.running_lines(own, 3, 0.05).withColumnRenamed("doc_id", "source")


# --- Text ------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({squished('text')}) AS squished FROM documents")
def squish_hash(spark, sf_dir):
    """N6."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.squish(F.col("text")), 256).alias("squished"))


NORMALISED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([\p{L}\p{M}\p{N}_])-\n([\p{L}\p{M}\p{N}_])', '\1\2', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, sha256({NORMALISED}) AS normalised FROM documents")
def normalize_text(spark, sf_dir):
    """N1 to N4. The tables hold nothing that N1 changes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("normalised"))


@query(
    rf"""WITH l AS ({LINES_SQL})
    SELECT doc_id, pos, ltrim(regexp_replace('Buyer' || line, '(Buyer|Email|Phone|Telephone|Fax|Address|Name|Date|Title|City)([A-Z0-9])', ' \1 \2')) AS split,
    nullif(CASE WHEN length({squished('line')}) > 40 THEN rtrim(left({squished('line')}, 40)) || '...' ELSE {squished('line')} END, '') AS cleaned,
    trim(regexp_replace(line, '^[A-Za-z][A-Za-z0-9 /#()\-]{{1,38}}:\s*', '')) AS unlabelled,
    {squished("regexp_replace(lower(line), '[^a-z0-9 /#&]', ' ', 'g')")} AS label,
    trim({squished('line')}, ' .;:,-') AS cell,
    regexp_matches(line, '(?i)\b(shall|must|will|agreement|contractor|vendor)\b') AND len(string_split({squished('line')}, ' ')) > 6 AS prose,
    regexp_matches(trim(line), '(?i)^\s*Page\s+\d+\s*(\|\s*\d+\s*)?$|^\s*\d+\s*\|\s*\d+\s*$|^\s*Page\s+\d+\s+of\s+\d+\s*$') OR trim(line) = '' AS boilerplate,
    lower({squished('line')}) IN ('', 'n/a', 'not stated', 'none', '-', '--', 'tbd') AS placeholder
    FROM l"""
)
def line_functions(spark, sf_dir):
    """N5, N7, N9, N10, N14, N15, N21 and N22 over all lines."""
    line = F.col("line")
    own = lines(spark, sf_dir)
    return own.select(
        "doc_id", "pos", T.deconcatenate_labels(F.concat(F.lit("Buyer"), line)).alias("split"), T.clean_text(line, 40).alias("cleaned"), T.strip_leading_label(line).alias("unlabelled"), T.norm_label(line).alias("label"),
        T.clean_cell(line).alias("cell"), T.is_prose(line).alias("prose"), T.is_boilerplate(line).alias("boilerplate"), T.is_placeholder(line, F.lit("no such label")).alias("placeholder"),
    )


@query(
    r"""WITH a AS (SELECT p_brand, p_partkey, string_agg(p_name, ', ') AS s FROM (SELECT p_brand, p_name, min(p_partkey) AS p_partkey FROM part GROUP BY ALL) GROUP BY ALL)
    SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(p_brand || ', ' || p_type || '; N/A, ' || p_brand, '[,;]|\s{2,}|\n'), lambda x: trim(x, ' .,;')), lambda x, i: x <> '' AND lower(x) NOT IN ('n/a', 'none', '-', 'not stated') AND i <= 2) AS items,
    trim(regexp_replace(lower(p_type), '[^\p{L}\p{N}]', '-', 'g'), '-') AS slug, coalesce(try_cast(nullif(regexp_replace(p_name, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS qty FROM part"""
)
def list_functions(spark, sf_dir):
    """N12, N17 and N23."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.to_list(F.concat_ws("", "p_brand", F.lit(", "), "p_type", F.lit("; N/A, "), "p_brand")).alias("items"), T.slug(F.col("p_type")).alias("slug"), T.qty_value(F.col("p_name")).alias("qty"))


@query(
    """WITH g AS (SELECT p_brand, list(DISTINCT p_type) AS items FROM part GROUP BY 1),
    k AS (SELECT p_brand, list_filter(items, lambda x: length(x) >= 4) AS items FROM g),
    o AS (SELECT p_brand, items, list_filter(items, lambda x: len(list_filter(items, lambda y: lower(y) <> lower(x) AND contains(lower(y), lower(x)))) = 0) AS kept FROM k)
    SELECT p_brand, list_sort(CASE WHEN len(kept) > 0 THEN kept ELSE items END) AS kept FROM o"""
)
def prune_subsumed(spark, sf_dir):
    """N13."""
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("items"))
    return g.select("p_brand", F.array_sort(T.prune_subsumed(F.col("items"))).alias("kept"))


TOKENS_SQL = r"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9\-_.#/]*'), lambda t: lower(trim(t, '.,;:!?'))), lambda t: length(t) > 1)"
STOPPED_SQL = f"""list_filter({TOKENS_SQL}, lambda t: t NOT IN ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'has', 'have', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 'that',
    'the', 'this', 'to', 'was', 'were', 'will', 'with', 'your', 'you', 'our', 'their', 'not', 'any', 'all', 'may', 'must', 'shall', 'should'))"""


@query(f"SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({STOPPED_SQL}) AS t FROM documents) GROUP BY 1, 2")
def tokenize_tf(spark, sf_dir):
    """N19."""
    return retrieval.postings(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "term", "tf")


@query(rf"SELECT doc_id, list_sort(list_distinct(list_filter({STOPPED_SQL}, lambda t: regexp_full_match(t, '[a-z0-9][a-z0-9\-]{{4,}}') AND regexp_matches(t, '\d') AND regexp_matches(t, '[a-z]')))) AS ids FROM documents")
def identifiers(spark, sf_dir):
    """N20."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_distinct(T.identifiers(F.col("text")))).alias("ids"))


@query(r"SELECT doc_id, floor(1.3::DOUBLE * len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+')))::INTEGER AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    """N18."""
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    r"""WITH d AS (SELECT doc_id, text, position('License' IN text) AS p FROM documents WHERE contains(text, 'License')),
    s AS (SELECT doc_id, trim(regexp_extract(left(text, p - 1), '([^.\n]*)$', 1) || 'License' || regexp_extract(substr(text, p + 7), '^([^.\n]*[.\n]?)', 1), E' \n\t\r') AS s FROM d)
    SELECT doc_id, """ + squished("CASE WHEN length(s) > 400 THEN rtrim(left(s, 400)) || '...' ELSE s END") + " AS sentence FROM s"
)
def sentence_anchor(spark, sf_dir):
    """N11, M4."""
    d = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("License")))
    at = F.instr(F.col("text"), F.lit("License")) - 1
    return d.select("doc_id", T.sentence_of(F.col("text"), at, at + 7).alias("sentence"))


@query(
    r"""WITH d AS (SELECT doc_id, text, position('License' IN text) - 1 AS s FROM documents WHERE contains(text, 'License')),
    b AS (SELECT *, greatest(s - 80, 0) AS l, least(s + 87, length(text)) AS r FROM d)
    SELECT doc_id, CASE WHEN l > 0 THEN '...' ELSE '' END || """ + squished("substr(text, l + 1, r - l)") + " || CASE WHEN r < length(text) THEN '...' ELSE '' END AS span FROM b"
)
def span_window(spark, sf_dir):
    """N16."""
    d = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("License")))
    at = F.instr(F.col("text"), F.lit("License")) - 1
    return d.select("doc_id", T.span_around(F.col("text"), at, at + 7).alias("span"))


# --- Dates -----------------------------------------------------------------


@query(
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS instant,
    strftime(timezone('America/Chicago', timezone('UTC', date_trunc('minute', ts))), '%Y-%m-%dT%H:%M:%S') || CASE WHEN month(ts) BETWEEN 4 AND 10 THEN '-05:00' ELSE '-06:00' END AS central FROM events"""
)
def date_roundtrip(spark, sf_dir):
    """events' times written in two notations and read again."""
    e = table(spark, sf_dir, "events")
    iso = dates.iso_instant(F.date_format(F.col("ts"), "dd-MMM-yyyy HH:mm:ss"))
    central = F.convert_timezone(F.lit("UTC"), F.lit("America/Chicago"), F.col("ts").cast("timestamp_ntz"))
    written = F.concat(F.date_format(central, "MMMM d, yyyy"), F.lit(" at "), F.date_format(central, "h:mma"), F.lit(" CST"))
    return e.select("event_id", iso.alias("instant"), dates.normalize_datetime(written).alias("central"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE true) AS agreed FROM events")
def same_instant(spark, sf_dir):
    """The same time in two zones has one signature."""
    utc = F.col("ts").cast("timestamp_ntz")
    say = lambda zone, short: F.concat(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), "MM/dd/yyyy hh:mm a"), F.lit(f" {short}"))
    a, b = dates.iso_instant(say("America/Chicago", "CST")), dates.iso_instant(say("America/New_York", "EST"))
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), F.count_if(a == b).alias("agreed"))


@query(
    """WITH d AS (SELECT c_nationkey, c_custkey, c_mktsegment = 'BUILDING' AS portal, ['CST', 'EDT', 'MST', 'PDT'][c_custkey * 7 % 5 % 4 + 1] AS zone FROM customer),
    v AS (SELECT c_nationkey, zone, count(*) AS n, min(c_custkey) AS first FROM d WHERE NOT portal OR NOT EXISTS (SELECT 1 FROM d o WHERE o.c_nationkey = d.c_nationkey AND NOT o.portal) GROUP BY 1, 2)
    SELECT c_nationkey AS package_id, arg_max(zone, (n, -first)) AS zone FROM v GROUP BY 1"""
)
def zone_vote(spark, sf_dir):
    """The zone that most documents of a package name, portal documents without a vote unless alone; ties go to the first."""
    zone = F.element_at(F.array(*[F.lit(z) for z in ("CST", "EDT", "MST", "PDT")]), (F.col("c_custkey") * 7 % 5 % 4 + 1).cast("int"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("package_id"), F.col("c_custkey").alias("doc_ord"), F.when(F.col("c_mktsegment") == "BUILDING", "portal_notice").otherwise("master_rfp").alias("doc_type"), F.concat(F.lit("due at 2 PM "), zone, F.lit(".")).alias("text"))
    return dates.zone_votes(docs).select("package_id", "zone")


# --- Classification --------------------------------------------------------


@query(
    r"""WITH s AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') THEN 4.0::DOUBLE ELSE 0 END AS legal,
      CASE WHEN contains(text, '@') THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '\d')) > 0 THEN least(3.0, 1.0 + 0.35 * len(regexp_extract_all(text, '\d'))) ELSE 0 END::DOUBLE AS contact,
      CASE WHEN length(text) >= 3000 THEN 1.0::DOUBLE ELSE 0 END AS long FROM documents),
    o AS (SELECT doc_id, list_reverse_sort([{'s': legal, 'o': 0, 't': 'legal'}, {'s': contact, 'o': -1, 't': 'contact'}, {'s': long, 'o': -2, 't': 'long'}, {'s': 0.0::DOUBLE, 'o': -3, 't': 'unknown'}]) AS r FROM s)
    SELECT doc_id, CASE WHEN r[1].s > 0 THEN r[1].t ELSE 'unknown' END AS doc_type,
      CASE WHEN r[1].s > 0 THEN round(least(1.0, 0.55 + 0.15 * (r[1].s - r[2].s) + 0.1 * least(r[1].s, 6.0))::DOUBLE, 2) ELSE 0.0::DOUBLE END AS confidence FROM o"""
)
def classify_docs(spark, sf_dir):
    """C1 to C3, with signals that the documents have."""
    t, n = F.col("text"), F.regexp_count("text", F.lit(r"\d"))
    found = [
        classify.Signal("license", "legal", classify.when(t.rlike("(?i)license"), 4.0)),
        classify.Signal("mail", "contact", classify.when(F.contains(t, F.lit("@")), 2.0)),
        classify.Signal("digits", "contact", classify.when(n > 0, F.least(F.lit(3.0), 1.0 + 0.35 * n))),
        classify.Signal("length", "long", classify.when(F.char_length(t) >= 3000, 1.0)),
    ]
    out = classify.score(table(spark, sf_dir, "documents").select("doc_id", "text"), found, ["legal", "contact", "long", "unknown"])
    return out.select("doc_id", "doc_type", F.round("doc_type_confidence", 2).alias("confidence"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, left(text, 400) AS question, left(answer, 600) AS answer FROM t WHERE role = 'user' AND next_role = 'assistant'"""
)
def qa_turns(spark, sf_dir):
    """C6's pairs, from turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.substring("text", 1, 400).alias("question"), F.substring("answer", 1, 600).alias("answer"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(sha256(coalesce(text, '')), turn) AS text_hash FROM conversations GROUP BY 1")
def supersede_latest(spark, sf_dir):
    """Later overrides earlier."""
    c = table(spark, sf_dir, "conversations").withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    return merge.latest(c, ["conv_id"], ["turn"], ["turn", "role", "text_hash"])


# --- Rules -----------------------------------------------------------------

MAIL, PHONE = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:com|org|net|edu|gov|us)\b", r"\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}\b"


def contacts(spark, sf_dir) -> DataFrame:
    """Candidates of the contact rules, with a source as package and its lines as blocks. Lines that can hold neither are passed over before any pattern."""
    found = [rules.Spec(n, n, rules=(rules.Rule(n, "pattern", n, 0.9, regex=p, multiplicity="every", group="0"),)) for n, p in (("email", MAIL), ("phone", PHONE))]
    own = lines(spark, sf_dir).where(F.contains("line", F.lit("@")) | F.col("line").rlike(r"\d{4}"))
    blocks = own.select("doc_id", "source", F.col("pos").alias("block_ord"), F.col("line").alias("text"), F.lit("text").alias("kind"), F.lit("master_rfp").alias("doc_type"), F.lit(None).cast("string").alias("section"))
    return rules.pattern_hits(blocks, found).select("doc_id", "source", F.col("block_ord").alias("pos"), "match_ord", F.col("a.field").alias("rule"), F.col("hit.raw").alias("value"))


@query(rf"WITH l AS ({LINES_SQL}) SELECT doc_id, pos, unnest(regexp_extract_all(line, '(?i){MAIL}')) AS value FROM l")
def contact_email(spark, sf_dir):
    """M3."""
    return contacts(spark, sf_dir).where(F.col("rule") == "email").select("doc_id", "pos", "value")


@query(rf"WITH l AS ({LINES_SQL}) SELECT doc_id, pos, unnest(regexp_extract_all(line, '(?i){PHONE}')) AS value FROM l")
def contact_phone(spark, sf_dir):
    """M3."""
    return contacts(spark, sf_dir).where(F.col("rule") == "phone").select("doc_id", "pos", "value")


@query(
    rf"""WITH l AS ({LINES_SQL}), v AS (
      SELECT source, doc_id, unnest(regexp_extract_all(line, '(?i){MAIL}')) AS value FROM l UNION ALL
      SELECT source, doc_id, unnest(regexp_extract_all(line, '(?i){PHONE}')) FROM l)
    SELECT source, list_sort(list(DISTINCT lower(value))) AS contacts, count(*) AS n_evidence, min(doc_id) AS first_doc FROM v GROUP BY 1"""
)
def contact_resolved(spark, sf_dir):
    """The flagship: which contact details each source states, and where first."""
    return contacts(spark, sf_dir).groupBy("source").agg(F.array_sort(F.collect_set(F.lower("value"))).alias("contacts"), F.count(F.lit(1)).alias("n_evidence"), F.min("doc_id").alias("first_doc"))


@query(
    r"""SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '(?:^|[^\d)\-])(\d{3}-[0-9A-Z]{4})(?:[^\d\-]|$)', 1), lambda x: x), lambda x: x <> ''))) AS skus FROM documents
    WHERE regexp_matches(text, '(?:^|[^\d)\-])\d{3}-[0-9A-Z]{4}(?:[^\d\-]|$)')"""
)
def sku_guarded(spark, sf_dir):
    """M3 with guards before and after."""
    rule = rules.Rule("sku", "pattern", "sku", 0.9, regex=r"(?<![\d)\-])(?P<value>(?-i:\d{3}-[0-9A-Z]{4}))(?![\d\-])", multiplicity="every")
    blocks = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(0).alias("block_ord"), F.lit("master_rfp").alias("doc_type"), F.lit(None).cast("string").alias("section"))
    return rules.pattern_hits(blocks, [rules.Spec("sku", "sku", rules=(rule,))]).groupBy("doc_id").agg(F.array_sort(F.collect_set("hit.raw")).alias("skus"))


@query(
    rf"""WITH l AS ({LINES_SQL}), s AS (SELECT doc_id, {squished('line')} AS s FROM l)
    SELECT a.doc_id, count(*) AS contained FROM (SELECT DISTINCT doc_id, s FROM s WHERE length(s) >= 4) a
    WHERE EXISTS (SELECT 1 FROM s b WHERE b.doc_id = a.doc_id AND length(b.s) > length(a.s) AND contains(lower(b.s), lower(a.s))) GROUP BY 1"""
)
def near_containment(spark, sf_dir):
    """Lines that a longer line of the same document holds."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.transform(F.split("text", "\n"), lambda x: T.squish(x))).alias("all"))
    found = d.select("doc_id", T.n_held(F.transform("all", F.lower), F.transform("all", F.char_length), 4).alias("contained"))
    return found.where("contained > 0")


# --- Packages --------------------------------------------------------------


@query(
    """SELECT n_name, c_mktsegment, o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""
)
def precedence_join(spark, sf_dir):
    """Facts with dimensions; Spark broadcasts those that its size check allows."""
    li, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    own = li.select("l_orderkey", "l_quantity").join(o.select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.groupBy("n_name", "c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    """WITH v AS (SELECT o_custkey, o_orderpriority AS value, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2)
    SELECT o_custkey, arg_max(value, (n, -first)) AS bid_number FROM v GROUP BY 1"""
)
def bid_number_vote(spark, sf_dir):
    """G10."""
    v = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("count"), F.min("o_orderkey").alias("doc_ord")).withColumn("weight", F.lit(0))
    return packages.bid_number(v, "o_custkey")


CLUSTER_SQL = f"""t AS (SELECT DISTINCT lang, doc_id, unnest({STOPPED_SQL}) AS term FROM documents),
    n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(DISTINCT doc_id) AS df, ln(any_value(n.n) / count(DISTINCT doc_id)) + 0.01 AS idf FROM t, n GROUP BY 1)"""


def cluster_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("all").alias("folder"), "doc_id", F.col("lang").alias("cluster"), "text")
    terms = packages.doc_terms(docs)
    sizes = docs.groupBy("folder").agg(F.count(F.lit(1)).alias("n_docs"))
    return docs, terms, packages.idf(terms, sizes)


@query(f"WITH {CLUSTER_SQL} SELECT term, df, round(idf, 6) AS idf FROM df")
def cluster_idf(spark, sf_dir):
    """G4."""
    return cluster_terms(spark, sf_dir)[2].select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    f"""WITH {CLUSTER_SQL}, s AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1),
    c AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2), q AS (SELECT lang, term FROM c JOIN s USING (lang) WHERE n >= greatest(1, ceil(size / 2))),
    a AS (SELECT term, any_value(lang) AS lang FROM q GROUP BY 1 HAVING count(*) = 1),
    r AS (SELECT lang, term, round(idf, 6) AS idf, row_number() OVER (PARTITION BY lang ORDER BY idf DESC, term) AS k FROM a JOIN df USING (term))
    SELECT lang, term, idf FROM r WHERE k <= 300"""
)
def contrastive_terms(spark, sf_dir):
    """G5, with languages as clusters."""
    docs, terms, weights = cluster_terms(spark, sf_dir)
    return packages.contrastive(terms, docs.select("folder", "doc_id", "cluster"), weights).select(F.col("cluster").alias("lang"), "term", F.round("idf", 6).alias("idf"))


@query()
def greedy_cluster(spark, sf_dir):
    """G3, with hosts as folders and the words of a page's address as keys. A greedy fold has no SQL; tests hold it against brute force."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("folder"), F.col("page_id").cast("string").alias("doc_id"), F.col("page_id").alias("doc_ord"), F.array_distinct(T.tokenize(F.regexp_replace("url", r"^[a-z]+://[^/]+|\d+", " "), [])).alias("keys"))
    return packages.cluster(p)


# --- Retrieval -------------------------------------------------------------

BM25_SQL = f"""d AS (SELECT doc_id, {STOPPED_SQL} AS toks FROM documents), l AS (SELECT doc_id, len(toks) AS dl FROM d),
    p AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS t FROM d) GROUP BY 1, 2),
    q AS (SELECT item_id, t AS term, count(*) AS qtf FROM (SELECT item_id, unnest({STOPPED_SQL}) AS t FROM benchmark) GROUP BY 1, 2),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st), mean AS (SELECT avg(idf) AS mean FROM raw),
    idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf FROM raw, mean),
    b AS (SELECT item_id, doc_id, greatest(sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 0.0) AS bm25
      FROM p JOIN q USING (term) JOIN idf USING (term) JOIN l USING (doc_id), st GROUP BY 1, 2),
    i2 AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, st), w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM p JOIN i2 USING (term)),
    nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1), qw AS (SELECT item_id, term, (1 + ln(qtf)) * idf AS qw FROM q JOIN i2 USING (term)),
    qn AS (SELECT item_id, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY 1),
    v AS (SELECT item_id, doc_id, sum(w * qw) / any_value(norm) / any_value(qnorm) AS cosine FROM w JOIN qw USING (term) JOIN nm USING (doc_id) JOIN qn USING (item_id) GROUP BY 1, 2)"""


def _top_sql(body: str, score: str) -> str:
    return f"WITH {BM25_SQL}, {body} r AS (SELECT item_id, doc_id, round({score}, 6) AS score FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM k WHERE rank <= 6"


def _ranked(spark, sf_dir, score: str) -> DataFrame:
    counted = retrieval.counted(table(spark, sf_dir, "documents"), "doc_id")
    return retrieval.ranked(counted, table(spark, sf_dir, "benchmark"), 6, score, "doc_id", "item_id")


@query(_top_sql("x AS (SELECT item_id, doc_id, bm25 AS s FROM b),", "s"))
def bm25_topk(spark, sf_dir):
    """R2."""
    return _ranked(spark, sf_dir, "bm25")


@query(_top_sql("x AS (SELECT item_id, doc_id, cosine AS s FROM v),", "s"))
def tfidf_cosine(spark, sf_dir):
    """R3."""
    return _ranked(spark, sf_dir, "cosine")


@query(
    _top_sql(
        """f AS (SELECT item_id, doc_id, coalesce(bm25, 0) AS bm25, coalesce(cosine, 0) AS cosine FROM b FULL JOIN v USING (item_id, doc_id)),
        m AS (SELECT item_id, least(min(bm25), CASE WHEN count(*) < any_value(n) THEN 0 ELSE min(bm25) END) AS bl, max(bm25) AS bh, least(min(cosine), CASE WHEN count(*) < any_value(n) THEN 0 ELSE min(cosine) END) AS vl, max(cosine) AS vh FROM f, st GROUP BY 1),
        x AS (SELECT item_id, doc_id, 0.6 * CASE WHEN bh > bl THEN (bm25 - bl) / (bh - bl) ELSE 0 END + 0.4 * CASE WHEN vh > vl THEN (cosine - vl) / (vh - vl) ELSE 0 END AS s FROM f JOIN m USING (item_id)),""",
        "s",
    )
)
def hybrid_topk(spark, sf_dir):
    """R4, R5."""
    return _ranked(spark, sf_dir, "score")


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0)
    SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM k WHERE rank <= 5"""
)
def dense_topk(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all others."""
    e = table(spark, sf_dir, "embeddings")
    return retrieval.dense(e, e.where("vec_id % 20 = 0"), 5)


@query()
def chunk_pack(spark, sf_dir):
    """R1, with lines as blocks. Packing with overlap has no SQL; tests hold it against brute force."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    block = lambda x, i: F.struct(i.alias("block_ord"), F.concat(F.lit("b"), i.cast("string")).alias("block_id"), F.lit(1).alias("page_no"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("section"), x.alias("text"))
    own = docs.select("doc_id", F.transform(F.split("text", "\n"), block).alias("blocks"))
    # A row is a document, so its lines are packed where it is read. Only rows that share an id have to meet.
    alone = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    found = chunks.chunk_rows(own) if alone else chunks.chunk(own.select("doc_id", F.inline("blocks")))
    return found.select("doc_id", "chunk_no", "tokens", F.size("block_ids").alias("n_blocks"), F.sha2("text", 256).alias("text_hash"))


# --- Merging ---------------------------------------------------------------

CANDIDATES_SQL = """c AS (SELECT user_id AS package_id, event_type AS field, event_id AS cand_ord, 'd' || (event_id % 7) AS doc_id, (event_id % 5)::INTEGER * 10 AS precedence,
    (((event_id * 37) % 101) / 100.0)::DECIMAL(4,3) AS confidence, 'v' || (event_id * 31 % 13) || repeat('x', (event_id % 4)::INTEGER) AS norm_str FROM events)"""


def candidates(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    norm = F.concat(F.lit("v"), (F.col("event_id") * 31 % 13).cast("string"), F.repeat(F.lit("x"), (F.col("event_id") % 4).cast("int")))
    own = e.select(F.col("user_id").alias("package_id"), F.col("event_type").alias("field"), F.col("event_id").alias("cand_ord"), F.concat(F.lit("d"), (F.col("event_id") % 7).cast("string")).alias("doc_id"), ((F.col("event_id") % 5) * 10).cast("int").alias("precedence"), ((F.col("event_id") * 37 % 101) / 100).cast("decimal(4,3)").alias("confidence"), norm.alias("norm_str"))
    return own.withColumn("signature", F.col("norm_str")).withColumn("norm_list", F.array("norm_str", F.concat("norm_str", F.lit("y")))).withColumn("norm_map", F.create_map(F.col("doc_id"), F.create_map(F.substring("norm_str", 1, 3), F.col("norm_str"))))


@query(
    f"""WITH {CANDIDATES_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY package_id, field, norm_str ORDER BY precedence DESC, confidence DESC, cand_ord) AS r, min(cand_ord) OVER (PARTITION BY package_id, field, norm_str) AS first FROM c),
    o AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY package_id, field) AS n FROM s WHERE r = 1 WINDOW w AS (PARTITION BY package_id, field ORDER BY precedence DESC, confidence DESC, first))
    SELECT package_id, field, norm_str, doc_id, precedence, confidence, (n - 1)::INTEGER AS n_losers FROM o WHERE k = 1"""
)
def merge_precedence(spark, sf_dir):
    """A1."""
    return merge.merge_precedence(candidates(spark, sf_dir)).select(*merge.KEY, "norm_str", "doc_id", "precedence", "confidence", "n_losers")


@query(
    f"""WITH {CANDIDATES_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY package_id, field, norm_str ORDER BY precedence DESC, confidence DESC, cand_ord) AS r, min(cand_ord) OVER (PARTITION BY package_id, field, norm_str) AS first FROM c),
    o AS (SELECT *, row_number() OVER w AS k FROM s WHERE r = 1 WINDOW w AS (PARTITION BY package_id, field ORDER BY precedence DESC, confidence DESC, first))
    SELECT package_id, field, max(norm_str) FILTER (WHERE k = 1) AS winner, list(norm_str ORDER BY k) FILTER (WHERE k > 1) AS losers,
    max(doc_id) FILTER (WHERE k = 1) || ' (precedence ' || max(precedence) FILTER (WHERE k = 1) || ') over ' || (count(*) - 1) || ' other value(s)' AS rationale FROM o GROUP BY 1, 2 HAVING count(*) > 1"""
)
def merge_conflicts(spark, sf_dir):
    """A1's conflict records."""
    found = merge.conflicts(merge.merge_precedence(candidates(spark, sf_dir)))
    return found.select(*merge.KEY, F.col("winner.norm_str").alias("winner"), F.transform("losers", lambda x: x["norm_str"]).alias("losers"), "rationale")


@query(
    f"""WITH {CANDIDATES_SQL}, i AS (SELECT package_id, field, item, min((-precedence, -confidence, cand_ord, j)) AS o, max(confidence) AS best, count(*) AS n FROM
      (SELECT *, unnest([norm_str, norm_str || 'y']) AS item, unnest([1, 2]) AS j FROM c) GROUP BY ALL),
    l AS (SELECT package_id, field, list(item ORDER BY o) AS items FROM i WHERE length(item) >= 4 GROUP BY 1, 2),
    p AS (SELECT package_id, field, list_filter(items, lambda x: len(list_filter(items, lambda y: y <> x AND contains(y, x))) = 0) AS kept FROM l),
    t AS (SELECT package_id, field, least(1, max(confidence) + 0.03 * least(3, count(*) - 1))::DECIMAL(4,3) AS confidence FROM c GROUP BY 1, 2)
    SELECT package_id, field, coalesce(kept, []) AS norm_list, confidence FROM t LEFT JOIN p USING (package_id, field)"""
)
def merge_union(spark, sf_dir):
    """A2, A6, N13."""
    return merge.merge_union(candidates(spark, sf_dir)).select(*merge.KEY, "norm_list", "confidence")


@query(
    f"""WITH {CANDIDATES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY package_id, field ORDER BY length(norm_str) DESC, precedence DESC, confidence DESC, cand_ord) AS k, count(*) OVER (PARTITION BY package_id, field) AS n FROM c)
    SELECT package_id, field, norm_str, least(1, confidence + 0.03 * least(3, n - 1))::DECIMAL(4,3) AS confidence FROM o WHERE k = 1"""
)
def merge_longest(spark, sf_dir):
    """A4, A6."""
    return merge.merge_longest(candidates(spark, sf_dir)).select(*merge.KEY, "norm_str", "confidence")


@query(
    f"""WITH RECURSIVE {CANDIDATES_SQL}, l AS (SELECT package_id, field, list(norm_str ORDER BY precedence DESC, confidence DESC, cand_ord) AS v FROM c GROUP BY 1, 2),
    f(package_id, field, v, i, acc) AS (SELECT package_id, field, v, 1, [v[1]] FROM l UNION ALL
      SELECT package_id, field, v, i + 1, CASE WHEN len(list_filter(acc, lambda a: contains(a, v[i + 1]) OR contains(v[i + 1], a))) > 0 THEN acc ELSE list_append(acc, v[i + 1]) END FROM f WHERE i < len(v))
    SELECT package_id, field, array_to_string(acc[1:6], '; ') AS norm_str FROM f WHERE i = len(v)"""
)
def merge_concat(spark, sf_dir):
    """A3."""
    return merge.merge_concat(candidates(spark, sf_dir)).select(*merge.KEY, "norm_str")


@query(
    f"""WITH {CANDIDATES_SQL}, a AS (SELECT package_id, field, doc_id AS device, substr(norm_str, 1, 3) AS attr, norm_str AS value, row_number() OVER (PARTITION BY package_id, field, doc_id, substr(norm_str, 1, 3) ORDER BY precedence DESC, confidence DESC, cand_ord) AS k FROM c)
    SELECT package_id, field, device, attr, value FROM a WHERE k = 1"""
)
def merge_most_specific(spark, sf_dir):
    """A5, P6, unnested."""
    m = merge.merge_most_specific(candidates(spark, sf_dir))
    return m.select(*merge.KEY, F.explode("norm_map").alias("device", "attrs")).select(*merge.KEY, "device", F.explode("attrs").alias("attr", "value"))


@query(
    """WITH s AS (SELECT user_id AS package_id, count(DISTINCT event_type) AS populated FROM events WHERE event_type <> 'view' GROUP BY 1), p AS (SELECT DISTINCT user_id AS package_id FROM events)
    SELECT package_id, coalesce(populated, 0) AS populated, 6::BIGINT AS fields, round(coalesce(populated, 0) / 6, 4) AS coverage FROM p LEFT JOIN s USING (package_id)"""
)
def field_coverage(spark, sf_dir):
    """Six fields, of which two have no candidates."""
    rows = [(i, f, "longest" if i % 2 else "precedence", "not stated") for i, f in enumerate(["click", "error", "purchase", "signup", "never", "view"])]
    given = spark.createDataFrame(rows, "field_ord int, field string, merge string, null_reason string")
    c = candidates(spark, sf_dir).withColumns({"norm_list": F.lit(None).cast("array<string>"), "norm_map": F.lit(None).cast("map<string,map<string,string>>")})
    resolved, _ = merge.merge(c.withColumn("norm_str", F.when(F.col("field") != "view", F.col("norm_str"))), given)
    return merge.coverage(resolved)


@query("SELECT l_orderkey AS package_id, 'Line ' || l_linenumber AS line, arg_max(l_partkey, (l_quantity::BIGINT, -l_partkey))::VARCHAR AS item, max(l_quantity::BIGINT) AS quantity FROM lineitem GROUP BY 1, 2")
def pricing_max_qty(spark, sf_dir):
    """P5: the largest quantity of each line over a package's documents, of equal ones the earlier document's."""
    li = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.concat_ws("-", "l_orderkey", "l_partkey"))
    priced = li.select("doc_id", F.concat(F.lit("Line "), "l_linenumber").alias("line"), F.col("l_partkey").cast("string").alias("item"), F.col("l_quantity").cast("bigint").cast("string").alias("target_quantity"), F.lit("each").alias("unit"))
    docs = li.select("doc_id", F.col("l_orderkey").alias("package_id"), F.lit(40).alias("precedence"), F.col("l_partkey").alias("doc_ord")).distinct()
    return specs.merge_pricing(priced, docs).select("package_id", "line", "item", T.qty_value(F.col("target_quantity")).alias("quantity"))


@query(
    """WITH s AS (SELECT user_id AS package_id, event_type, arg_max(event_id, event_id) AS v FROM events GROUP BY 1, 2)
    SELECT package_id, max(v::VARCHAR) FILTER (WHERE event_type = 'click') AS click, max(v::VARCHAR) FILTER (WHERE event_type = 'error') AS error, max(v::VARCHAR) FILTER (WHERE event_type = 'purchase') AS purchase FROM s GROUP BY 1"""
)
def field_pivot(spark, sf_dir):
    """The wide result: a column per field."""
    s = merge.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"], ["event_id"])
    own = s.select(F.col("user_id").alias("package_id"), F.col("event_type").alias("field"), F.col("event_id").cast("string").alias("norm_str"), F.lit(None).cast("array<string>").alias("norm_list"), F.lit(None).cast("map<string,string>").alias("norm_map"))
    return report.pivot(own, ["click", "error", "purchase"])


@query(
    """WITH g AS (SELECT l.doc_id, d.source AS package_id, (quality = 1) = (length(text) >= 1500) AS passed FROM labels l JOIN documents d USING (doc_id))
    SELECT package_id, count(*) FILTER (WHERE passed) AS passed, count(*) AS total, round(avg(passed::INTEGER), 4) AS accuracy FROM g GROUP BY GROUPING SETS ((package_id), ())"""
)
def gold_accuracy(spark, sf_dir):
    """Labels as gold, a guess by length as answer."""
    g = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    scores = g.select(F.col("source").alias("package_id"), F.lit("quality").alias("field"), evaluate.passed(F.lit("equals"), F.col("quality").cast("string"), F.when(F.char_length("text") >= 1500, "1").otherwise("0"), F.lit(0)).alias("passed"))
    return evaluate.accuracy(scores).drop("failed")


@query(
    """SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN left(p_name, 9) || '...' ELSE p_name END AS short, replace(p_type || '|x', '|', '\\|') AS escaped,
    CASE WHEN p_size % 3 = 0 THEN '_null_' ELSE array_to_string(list_transform(range(1, least(p_size, 6) + 1), lambda x: x::VARCHAR), ', ') || CASE WHEN p_size > 6 THEN ' (+' || (p_size - 6) || ' more)' ELSE '' END END AS items FROM part"""
)
def report_format(spark, sf_dir):
    """K6."""
    p = table(spark, sf_dir, "part")
    items = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda x: x.cast("string")))
    return p.select("p_partkey", report.short(F.col("p_name"), 12).alias("short"), report.md_escape(F.concat("p_type", F.lit("|x"))).alias("escaped"), report.fmt_value(F.lit(None).cast("string"), items, F.lit(None).cast("map<string,string>")).alias("items"))


@query(
    """WITH e AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
    s AS (SELECT user_id, sum(CASE WHEN gap <= 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
    SELECT user_id, session::BIGINT AS session, count(*) AS n FROM s GROUP BY 1, 2"""
)
def session_events(spark, sf_dir):
    """Sessions of events with gaps of at most half an hour."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts"))
    s = table(spark, sf_dir, "events").withColumn("new", F.when(gap <= 1_800_000_000, 0).otherwise(1)).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query()
def price_schedule(spark, sf_dir):
    """P4 on grids made of line items, one for each order. Grid repair has no SQL; tests hold it against known schedules."""
    li = table(spark, sf_dir, "lineitem")
    row = F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")), F.col("l_quantity").cast("bigint").cast("string"), F.lit("Each"))
    grids = li.groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("rows"))
    head = F.array(F.array(*[F.lit(x) for x in ("Line", "Item", "Quantity", "Unit")]))
    blocks = grids.select("doc_id", F.lit(0).alias("block_ord"), F.lit("table").alias("kind"), F.concat(head, F.transform("rows", lambda r: r["row"])).alias("table"))
    return specs.pricing(blocks)
