"""Text queries: tokens, scores, classification, chunks and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tf
from ..functions import urls
from ..operators import retrieval
from ..session import table
from .registry import query

TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}\p{M}_]+'), lambda x: length(x) >= 2)"


@query("select doc_id, sha256(text) as sha from documents qualify row_number() over (partition by sha256(text) order by doc_id) = 1")
def exact_dup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each content hash: a partial minimum, no sort."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))


@query("select event_type, user_id, case when n > 1 then event_type || '_' || n else event_type end as name, event_id from (select *, row_number() over (partition by event_type, user_id order by event_id) as n from events)")
def collision_suffix(spark, d):
    n = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id"))
    rows = table(spark, d, "events").withColumn("n", n)
    return rows.select("event_type", "user_id", F.when(F.col("n") > 1, F.concat_ws("_", "event_type", F.col("n").cast("string"))).otherwise(F.col("event_type")).alias("name"), "event_id")


@query(r"""
with s as (select doc_id, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) as place from documents)
select doc_id, place, length(body) as chars, sha256(body) as sha from s where length(body) >= 10""")
def lead_section_bodies(spark, d):
    """Sections up to the next separator, with their place; short ones are skipped."""
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "body"))
    return parts.filter(F.length("body") >= 10).select("doc_id", (F.col("p") + 1).cast("long").alias("place"), F.length("body").cast("long").alias("chars"), F.sha2("body", 256).alias("sha"))


@query("""
with m as (select conv_id, turn, role, case when role = 'system' then turn end as sys, case when role = 'user' then turn end as usr from conversations)
select conv_id, turn, role, max(sys) over w as system_turn, max(usr) over w as user_turn from m
window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)""")
def hierarchy_asof(spark, d):
    """What was in force strictly before each row, by level."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", "role", F.max(F.when(F.col("role") == "system", F.col("turn"))).over(w).alias("system_turn"), F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w).alias("user_turn"))


@query(r"""select regexp_replace(regexp_replace(regexp_replace(url, '[#?].*$', ''), '[0-9]+', 'N', 'g'), '[^\x00-\x7F]+', '*', 'g') as signature, count(*) as n from pages group by 1 order by n desc, signature limit 25""")
def url_signature_topn(spark, d):
    return table(spark, d, "pages").groupBy(urls.signature(F.col("url")).alias("signature")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "signature").limit(25)


CANON = r"""
with p as (select page_id, regexp_replace(url, '#.*$', '') as u from pages),
x as (select page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) as front, regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') as path,
array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda y: regexp_extract(y, '^([^=]*)=.', 1) in ('id', 'p', 'page'))), '&') as q from p),
c as (select page_id, front || case when path = '' then '/' else path end || case when q <> '' then '?' || q else '' end as url from x)
"""


@query(CANON + "select url, min(page_id) as first_page, count(*) as seen from c group by 1")
def enqueue_canonical_dedup(spark, d):
    """One task for each canonical URL, first come first."""
    rows = table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))
    return rows.groupBy("url").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("seen"))


@query("""select page_id, case when contains(lower(html), 'phpbb') then 'phpbb' when contains(lower(html), 'wp-content') or contains(lower(html), 'wordpress') then 'wordpress' else 'generic' end as engine,
contains(lower(html), '<article') as has_article from pages""")
def engine_detect(spark, d):
    page = F.lower("html")
    engine = F.when(F.contains(page, F.lit("phpbb")), "phpbb").when(F.contains(page, F.lit("wp-content")) | F.contains(page, F.lit("wordpress")), "wordpress").otherwise("generic")
    return table(spark, d, "pages").select("page_id", engine.alias("engine"), F.contains(page, F.lit("<article")).alias("has_article"))


@query(r"""
with s as (select doc_id, length(text) as chars, len(regexp_extract_all(lower(text), 'license')) as strong, len(regexp_extract_all(text, '\n')) as repeats, regexp_matches(text, '[0-9]') as pattern from documents)
select doc_id, least(100, case when pattern then 40 else 0 end + least(30, 10 * strong) + least(20, chars // 200) + least(10, repeats)) as score from s""")
def legal_style_score(spark, d):
    """A score of capped parts: a pattern, strong phrases, length and repeats."""
    text = F.col("text")
    part = F.when(text.rlike("[0-9]"), 40).otherwise(0)
    strong = F.least(F.lit(30), 10 * F.regexp_count(F.lower(text), F.lit("license")))
    score = part + strong + F.least(F.lit(20), F.floor(F.length(text) / 200)) + F.least(F.lit(10), F.regexp_count(text, F.lit("\n")))
    return table(spark, d, "documents").select("doc_id", F.least(F.lit(100), score).cast("long").alias("score"))


BRANCHES = {"english": ["the", "and", "of"], "german": ["und", "der", "die"], "french": ["le", "la", "des"], "spanish": ["el", "los", "que"]}


@query(f"""
with t as (select doc_id, string_split(lower(text), ' ') as w from documents),
s as (select doc_id, {', '.join(f"({' + '.join(f'2 * (list_contains(w, {chr(39)}{k}{chr(39)}))::int' for k in ks)}) as {b}" for b, ks in BRANCHES.items())} from t)
select doc_id, case {' '.join(f"when {b} = greatest({', '.join(BRANCHES)}) then '{b}'" for b in BRANCHES)} end as branch, greatest({', '.join(BRANCHES)}) as points from s""")
def branch_classification(spark, d):
    """The branch with most keywords, the first of equals."""
    rows = table(spark, d, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("w"))
    points = {b: sum((2 * F.array_contains("w", k).cast("int") for k in ks), F.lit(0)) for b, ks in BRANCHES.items()}
    scored = rows.select("doc_id", *(p.alias(b) for b, p in points.items()))
    top = F.greatest(*BRANCHES)
    return scored.select("doc_id", F.coalesce(*(F.when(F.col(b) == top, F.lit(b)) for b in BRANCHES)).alias("branch"), top.alias("points"))


@query(r"""select doc_id, case when regexp_matches(lower(substr(text, 1, 300)), 'license') then 'notice' when regexp_matches(text, '[#*$%&]{3}') then 'junk'
when length(text) < 400 then 'short' when regexp_matches(substr(text, 1, 300), '@') then 'personal' else 'instrument' end as nature from documents""")
def nature_first_match(spark, d):
    head = F.substring("text", 1, 300)
    nature = F.when(F.lower(head).rlike("license"), "notice").when(F.col("text").rlike("[#*$%&]{3}"), "junk").when(F.length("text") < 400, "short").when(head.rlike("@"), "personal").otherwise("instrument")
    return table(spark, d, "documents").select("doc_id", nature.alias("nature"))


@query(f"select token, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest({TOKENS}) as token from documents) group by 1 having count(*) >= 5")
def token_frequencies(spark, d):
    """Tokens are counted by document before they meet, so a frequent token is few rows."""
    per_doc = table(spark, d, "documents").select("doc_id", F.explode(tf.search_tokens(F.col("text"))).alias("token")).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per_doc.groupBy("token").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs")).filter("n >= 5")


@query(f"""
with q as (select item_id, {TOKENS} as tokens from benchmark)
select item_id, len(tokens) as n_tokens, len(list_distinct(tokens)) as n_distinct, length(array_to_string(tokens, '')) as token_chars from q""")
def question_tokens(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", tf.search_tokens(F.col("text")).alias("tokens"))
    return rows.select("item_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"), F.length(F.array_join("tokens", "")).cast("long").alias("token_chars"))


BM25 = f"""
with p as materialized (select doc_id, token, count(*) as tf from (select doc_id, unnest({TOKENS}) as token from documents) group by 1, 2),
l as (select doc_id, sum(tf) as dl from p group by 1), s as (select count(*) as n, sum(dl) / count(*) as avgdl from l),
f as (select token, count(*) as df from p group by 1),
q as (select distinct item_id, unnest({TOKENS}) as token from benchmark),
r as (select item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score
  from q join p using (token) join f using (token) join l using (doc_id), s group by 1, 2),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from r)
"""


@query(BM25 + "select item_id, doc_id, place from k where place <= 5")
def bm25_search_top5(spark, d):
    """The best five documents for each benchmark passage, by BM25."""
    found = retrieval.search(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text"), 5)
    return found.select("item_id", "doc_id", "place")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    docs, questions = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text")
    return retrieval.answer(docs, questions)


ANSWER = BM25 + f""",
t as (select k.item_id, k.doc_id, len(list_filter(qt.tokens, lambda x: list_contains(dt.words, x))) as matched, len(qt.tokens) as asked
from k join (select item_id, {TOKENS} as tokens from benchmark) qt using (item_id) join (select doc_id, {TOKENS} as words from documents) dt using (doc_id) where place = 1),
a as (select b.item_id, t.doc_id, coalesce(matched, 0) as matched, t.doc_id is not null and not (asked >= 2 and matched < 2) as answered from benchmark b left join t using (item_id))
"""


@query(ANSWER + "select item_id, case when answered then doc_id end as doc_id, matched, case when answered then 'answered' else 'refused' end as status from a")
def answer_or_refuse(spark, d):
    """The best document as an answer, or an explicit refusal when too few words match."""
    return _answers(spark, d).select("item_id", "doc_id", "matched", "status")


@query(BM25 + """,
g as (select item_id, doc_id from benchmark b join documents dd on contains(dd.text, b.text)),
h as (select g.item_id, min(place) as place from g left join k on k.item_id = g.item_id and k.doc_id = g.doc_id and place <= 5 group by 1)
select count(*) as total, count(place) as found, round(sum(coalesce(1.0 / place, 0)) / count(*), 6) as mrr from h""")
def recall_mrr(spark, d):
    """Recall at five and mean reciprocal rank; the right documents are those that hold the passage."""
    docs, questions = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text")
    return retrieval.evaluate(docs, questions, 5)


@query("""
with w as (select doc_id, unnest(list_distinct(string_split(text, ' '))) as token from documents),
q as (select item_id, unnest(list_distinct(string_split(text, ' '))) as token from benchmark),
m as (select item_id, doc_id, count(*) as matched from q join w using (token) group by 1, 2)
select item_id, doc_id, matched from (select *, row_number() over (partition by item_id order by matched desc, doc_id) as r from m) where r <= 3""")
def fallback_occurrence_search(spark, d):
    """Whole-word matches, for when ranking finds nothing."""
    words = lambda t, key: table(spark, d, t).select(key, F.explode(F.array_distinct(F.split("text", " "))).alias("token"))
    matched = words("documents", "doc_id").join(words("benchmark", "item_id"), "token").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("matched"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("matched"), "doc_id"))
    return matched.withColumn("r", rank).filter("r <= 3").drop("r")


def _word(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}]", "")


@query(r"""select doc_id, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) as ascii_letters, length(regexp_replace(text, '[^\p{L}]', '', 'g')) as letters,
md5(trim(text)) as legacy_hash, len(regexp_extract_all(text, '[.!?]')) as sentences from documents""")
def letter_ratio(spark, d):
    """Letters by script, ends of sentences, and the legacy hash."""
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(F.regexp_replace(text, "[^a-zA-Z]", "")).cast("long").alias("ascii_letters"), F.length(_word(text)).cast("long").alias("letters"), F.md5(F.trim(text)).alias("legacy_hash"), F.regexp_count(text, F.lit("[.!?]")).cast("long").alias("sentences"))
