"""Queries of scalar functions, over documents, pages, events and conversations.

The tables hold no questions, names with titles, Arabic words or replies of models; such rows are derived from theirs by setting fixed
openings before them in turn, so that every branch is met and the work grows with the tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed, text
from tessera.functions.json_repair import repair
from tessera.sources.tables import table

ARABIC_WORDS = ["مُحَمَّد", "المدرسة", "إنجازات", "أحمـــد", "مستشفى", "آثار", "مكتبه", "في", "قرآن", "hello"]
RELATIONS = ["Works For", "co-founded", "يعمل_في", "رئيس", "partner of", "Head-Of", "unknown thing", "شريك", "located_in", "زار", "!!", "Winner Of"]
QUERY_TEXTS = [
    "Who is the president of the company?", "compare A and B", "relationship between X and Y", "overview of the project", "why did sales fall last year",
    "summarize all documents", "ما هي الموضوعات الرئيسية", "العلاقة بين المدير والشركة", "short query", "list the products sold in March", "من هو الفائز بالجائزة", "how does this differ from that",
]
NAMINGS = ["وزارة المالية والاقتصاد", "Ministry of Health", "رؤية 2030", "the National Bank", "جائزة الملك فيصل", "a Tourism Strategy", "مدينة جدة الساحلية", "Vision 2030", "الذكاء  الاصطناعي", "the Davos forum", "الدكتور أحمد", "cloud computing and IoT", "المركز الوطني للبحوث"]
COMPLEX_TEXTS = ["ما علاقة المدير و المشروع بالشركة", "الفرق بين الخطة الأولى و الخطة الثانية", "كم عدد المشاريع الكبرى وكذلك الصغرى", "إذا تأخر المشروع", "متى بدأ العمل و متى انتهى", "لماذا تأخر", "تفاصيل الخطة و تفاصيل العمل", "short"]
MENTION_PATTERNS = {"Email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "Phone": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "Money": r"\$[0-9]+(?:\.[0-9]+)?", "Date": "[0-9]{4}-[0-9]{2}-[0-9]{2}"}


def turn_of(items: list[str], key: str):
    """The item whose turn it is for an id."""
    return F.get(F.array(*map(F.lit, items)), (F.col(key) % len(items)).cast("int"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "text")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """id, query: every turn, two of three behind a fixed question's opening, one of those cut at its first full stop."""
    short = F.concat(turn_of(QUERY_TEXTS, "id"), F.lit(" "), F.get(F.split("text", "[.]"), F.lit(0)))
    return _turns(spark, sf).select("id", F.when(F.col("id") % 3 == 0, short).when(F.col("id") % 3 == 1, F.concat(turn_of(QUERY_TEXTS, "id"), F.lit(" "), "text")).otherwise(F.col("text")).alias("query"))


def arabic_texts(spark: SparkSession, sf: str) -> DataFrame:
    """id, word: every turn behind an Arabic word, or the word alone."""
    return _turns(spark, sf).select("id", F.when(F.col("id") % 2 == 0, turn_of(ARABIC_WORDS, "id")).otherwise(F.concat(turn_of(ARABIC_WORDS, "id"), F.lit(" "), "text")).alias("word"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """id, answer, truth, sources: every turn as the answer to the one before, with a citation of source 0 to 3 of three, or none."""
    t = _turns(spark, sf)
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    cited = F.when(F.col("id") % 5 == 4, F.col("answer")).otherwise(F.concat("answer", F.lit(" ["), (F.col("id") % 4).cast("string"), F.lit("] .")))
    return t.join(after, ["conv_id", "turn"]).select("id", cited.alias("answer"), F.col("text").alias("truth"), F.lit(3).cast("long").alias("sources"))


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """id, reply: what a model would say of every turn: JSON, JSON cut off, marked lines, or the text."""
    word = F.regexp_extract("text", "([A-Za-z]+)", 1)
    whole = F.concat(F.lit('{"score": '), (F.length("text") % 300).cast("string"), F.lit(', "answer": "'), word, F.lit('", "points": ["a", "b", "c", "d"]'))
    marked = F.concat(F.lit("Relevance: "), (F.length("text") % 100).cast("string"), F.lit("\nAnswer: "), word, F.lit("\nPoints: x"))
    kind = F.col("id") % 4
    return _turns(spark, sf).select("id", F.when(kind == 0, F.concat(whole, F.lit("}"))).when(kind == 1, whole).when(kind == 2, marked).otherwise(F.col("text")).alias("reply"))


def names(spark: SparkSession, sf: str) -> DataFrame:
    """id, name: every part's name, as it is, with a title, turned round, as a company, or quoted."""
    n = F.col("p_name")
    first, last = F.substring_index(n, " ", 1), F.substring_index(n, " ", -1)
    kind = F.col("p_partkey") % 5
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(kind == 0, F.concat(F.lit("  dr. "), n, F.lit(" "))).when(kind == 1, F.concat_ws(", ", last, first)).when(kind == 2, F.concat(F.upper(n), F.lit(" CORP."))).when(kind == 3, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n).alias("name"))


def arabic_norm(spark: SparkSession, sf: str) -> DataFrame:
    return arabic_texts(spark, sf).select("id", text.arabic_normalized("word").alias("normalized"), text.arabic_configured("word").alias("configured"))


def arabic_variants(spark: SparkSession, sf: str) -> DataFrame:
    return arabic_texts(spark, sf).select("id", F.array_join(text.arabic_variants("word"), "|").alias("variants"))


def arabic_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).unionByName(arabic_texts(spark, sf).select((-F.col("id") - 1).alias("id"), F.col("word").alias("query"))).select("id", F.array_join(text.arabic_keywords("query"), "|").alias("keywords"))


def lang_detect(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("word"))
    return docs.unionByName(arabic_texts(spark, sf).withColumn("id", -F.col("id") - 1)).select("id", *text.languages("word"))


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    out = text.cleaned("text")
    return table(spark, sf, "documents").select("doc_id", F.length(out).cast("long").alias("length"), F.md5(out.cast("binary")).alias("digest"), F.round(1 - F.length(out) / F.length("text"), 6).alias("noise"))


def punct_density(spark: SparkSession, sf: str) -> DataFrame:
    d = F.round(text.punctuation_density("text"), 6)
    return table(spark, sf, "documents").select("doc_id", d.alias("density"), ((d < 0.02) & (F.length("text") >= 100)).alias("unpunctuated"))


def entity_names(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("id", text.entity_name("name").alias("normalized"), text.ensemble_key("name").alias("key"))


def rel_type_norm(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 13 == 12, F.col("event_type")).otherwise(turn_of(RELATIONS, "event_id")).alias("type"))
    return kinds.select("id", *text.relation("type"))


def character_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(text.character_similarity("p_name", "p_type"), 6).alias("similarity"))


def key_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = text.key_terms("text")
    return table(spark, sf, "documents").select("doc_id", F.size(terms).cast("long").alias("n"), F.array_join(F.slice(terms, 1, 5), "|").alias("first"))


def entity_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Capitalised runs, acronyms and years of each benchmark text, sorted."""
    pick = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(1))
    found = F.array_union(F.array_union(pick(r"([A-Z][a-z]+(?: [A-Z][a-z]+)+)"), pick(r"([A-Z]{2,})")), pick(r"(20[0-9]{2})"))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_distinct(found)), "|").alias("phrases"))


def pattern_ner(spark: SparkSession, sf: str) -> DataFrame:
    """Typed patterns over whole documents: a row for each distinct mention, confidence 0.65."""
    found = F.flatten(F.array(*(F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))), _typed(t)) for t, p in MENTION_PATTERNS.items())))
    return table(spark, sf, "documents").select("doc_id", F.inline(found)).withColumn("confidence", F.lit(0.65))


def _typed(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("type"), m.alias("mention"))


def query_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn behind the opening of a compound question, or that alone: its kind and the parts it is asked in."""
    query = F.when(F.col("id") % 3 == 0, turn_of(COMPLEX_TEXTS, "id")).otherwise(F.concat(turn_of(COMPLEX_TEXTS, "id"), F.lit(" "), "text"))
    rows = _turns(spark, sf).select("id", query.alias("query"))
    parts = text.query_parts("query")
    return rows.select("id", text.query_kind("query").alias("kind"), F.size(parts).cast("long").alias("parts"), F.md5(F.array_join(parts, "|").cast("binary")).alias("digest"))


def named(spark: SparkSession, sf: str) -> DataFrame:
    """id, language, text: every turn behind a naming of an entity, in turn in Arabic and English."""
    return _turns(spark, sf).select("id", F.when(F.col("id") % 2 == 0, "ar").otherwise("en").alias("language"), F.concat(turn_of(NAMINGS, "id"), F.lit(". "), "text").alias("text"))


def typed_entities(spark: SparkSession, sf: str) -> DataFrame:
    """All typed patterns of the text's language over every turn: each distinct mention of two characters or more, confidence 0.65."""
    found = {language: F.flatten(F.array(*(F.transform(F.regexp_extract_all("text", F.lit(f"(?i){p}"), F.lit(0)), _typed(kind)) for kind, ps in kinds.items() for p in ps))) for language, kinds in fixed.ENTITY_PATTERNS.items()}
    rows = named(spark, sf).select("id", F.inline(F.when(F.col("language") == "ar", found["ar"]).otherwise(found["en"])))
    return rows.select("id", "type", F.trim(F.regexp_replace("mention", r"\s+", " ")).alias("mention")).where("length(mention) >= 2").distinct().withColumn("confidence", F.lit(0.65))


def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in brackets, how many of them exist, and the share (0.5 without any); completeness by citation and length."""
    cited = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))
    rows = answers(spark, sf).withColumn("cited", cited)
    good = F.size(F.filter("cited", lambda x: (x >= 1) & (x <= F.col("sources"))))
    complete = 0.5 * F.when(F.size("cited") > 0, 1.0).otherwise(0.3) + 0.5 * F.least(F.size(text.words("answer")) / 50.0, F.lit(1.0))
    return rows.select("id", F.size("cited").cast("long").alias("n"), F.round(F.when(F.size("cited") > 0, good / F.size("cited")).otherwise(0.5), 6).alias("accuracy"), F.round(complete, 6).alias("completeness"))


def semantic_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring turns of a conversation: 0.4 Jaccard + 0.6 recall of the first's terms."""
    c = table(spark, sf, "conversations")
    a, b = c.alias("a"), c.alias("b")
    pairs = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    x, y = text.key_terms(F.col("a.text")), text.key_terms(F.col("b.text"))
    score = 0.4 * text.jaccard(x, y) + 0.6 * text.share(text.overlap(x, y), F.size(x))
    return pairs.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.bround(score, 3).alias("score"))


def faithfulness_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Share of an answer turn's sentences (over 10 characters) whose terms are for 0.4 or more in the turn before."""
    c = table(spark, sf, "conversations")
    a, b = c.alias("a"), c.alias("b")
    pairs = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    context = text.key_terms(F.col("a.text"))
    rows = pairs.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), context.alias("context"), F.explode(text.sentences(F.col("b.text"))).alias("sentence")).where("length(sentence) > 10")
    terms = text.key_terms("sentence")
    rows = rows.withColumn("ok", (text.share(text.overlap(terms, F.col("context")), F.size(terms)) >= 0.4).cast("double"))
    return rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("sentences"), F.round(F.avg("ok"), 6).alias("faithfulness"))


def relevance_grade(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each benchmark item's best term overlap, in bands: above 0.8 counts 1, under 0.2 counts 0.2."""
    docs = table(spark, sf, "documents").select("doc_id", F.explode(text.key_terms("text", 6)).alias("term"))
    items = table(spark, sf, "benchmark").select("item_id", text.key_terms("text", 6).alias("terms"))
    asked = items.select("item_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    hits = docs.join(asked, "term").groupBy("item_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("hits"))
    r = F.col("hits") / F.col("n")
    return hits.groupBy("item_id").agg(F.round(F.max(F.when(r > 0.8, 1.0).when(r < 0.2, 0.2).otherwise(r)), 6).alias("grade"), F.max("hits").alias("hits"))


def route_queries(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("id", text.query_class("query").alias("class"), text.retrieval_mode("query").alias("mode"))


def route_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """The same over every user turn, counted by class and mode."""
    rows = table(spark, sf, "conversations").where("role = 'user'").select(text.query_class("text").alias("class"), text.retrieval_mode("text").alias("mode"))
    return rows.groupBy("class", "mode").agg(F.count(F.lit(1)).alias("n"))


def intent_complexity(spark: SparkSession, sf: str) -> DataFrame:
    q = F.lower(F.col("query"))
    n = F.size(text.words("query"))
    hits = lambda terms: F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(q, t)))
    local, broad = hits(["who", "when", "where", "which"]), hits(["all", "overview", "themes", "summar", "compare"])
    return questions(spark, sf).select(
        "id", n.cast("long").alias("words"), F.when(n > 12, "complex").when(n > 5, "medium").otherwise("simple").alias("complexity"), F.when(local > broad, "local").when(broad > local, "global").otherwise("hybrid").alias("router"),
        F.when(local > broad, 0.8).when(broad > local, 0.2).otherwise(0.5).alias("low_weight"), F.array_join(text.key_terms("query"), "|").alias("terms"),
    )


def decompose_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-queries: comparisons into their two sides, others at and, و and ;."""
    parts = F.when(F.lower("query").rlike("^compare "), F.split(F.regexp_replace("query", "(?i)^compare ", ""), " and ")).otherwise(F.split("query", " and | و |;"))
    rows = questions(spark, sf).select("id", F.posexplode(parts).alias("part", "sub_query"))
    return rows.select("id", F.col("part").cast("long").alias("part"), F.trim("sub_query").alias("sub_query"))


def map_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Replies, mended where they are cut off: score over 100 brought to [0, 1], answer, number of points (3 at most); plain text by its marks; else 0.1."""
    parsed = F.from_json("reply", "score double, answer string, points array<string>")
    rows = replies(spark, sf).select("id", F.when(F.col("reply").startswith("{"), repair("reply")).otherwise(F.col("reply")).alias("reply")).withColumn("p", F.when(F.col("reply").startswith("{"), parsed))
    said = F.regexp_extract("reply", r"Relevance: *(\d+)", 1)
    score = F.when(F.col("p.score").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p.score") / 100))).when(said != "", F.try_divide(said.try_cast("double"), F.lit(100.0))).otherwise(0.1)
    return rows.select("id", F.round(score, 6).alias("score"), F.coalesce("p.answer", F.nullif(F.regexp_extract("reply", r"Answer: *([^\n]*)", 1), F.lit("")), F.lit("")).alias("answer"), F.least(F.coalesce(F.size("p.points"), F.lit(0)), F.lit(3)).cast("long").alias("points"))


def cleaned_answers(spark: SparkSession, sf: str) -> DataFrame:
    out = F.trim(F.regexp_replace(F.regexp_replace("answer", r"\[\d+\]", ""), r"\s+([.,])", "$1"))
    return answers(spark, sf).select("id", out.alias("clean"), (out == "").alias("empty"))


def themes(spark: SparkSession, sf: str) -> DataFrame:
    """Theme words of each document, five at most."""
    words = F.array(*map(F.lit, ["the", "and", "und", "der", "que", "les", "with", "for", "por"]))
    found = F.slice(F.filter(words, lambda w: F.contains(F.lower("text"), w)), 1, 5)
    return table(spark, sf, "documents").select("doc_id", F.array_join(found, "|").alias("themes"), F.size(found).cast("long").alias("n"))


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.floor(F.length("text") / 4).alias("tokens"))


def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation's turns in order as numbered context, 4000 characters at most and then dots."""
    turns = table(spark, sf, "conversations").select("conv_id", F.struct("turn", F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] "), "text").alias("line")).alias("t"))
    joined = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t.line), "\n").alias("c"))
    out = F.when(F.length("c") > 4000, F.concat(F.substring("c", 1, 4000), F.lit("..."))).otherwise(F.col("c"))
    return joined.select("conv_id", F.length(out).cast("long").alias("length"), F.md5(out.cast("binary")).alias("digest"))


def log_levels(spark: SparkSession, sf: str) -> DataFrame:
    u = F.upper("line")
    level = F.when(u.rlike("ERROR|CRITICAL"), "error").when(u.rlike("WARN"), "warning").when(u.rlike("DEBUG"), "debug").otherwise("info")
    line = F.concat_ws(" ", F.when(F.col("value") > 450, "WARNING: slow").when(F.col("event_id") % 7 == 0, "debug"), "event_type", "props")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), line.alias("line")).select("id", level.alias("level"))


def url_ids(spark: SparkSession, sf: str) -> DataFrame:
    found = F.coalesce(F.nullif(F.regexp_extract("url", r"(?:v=|embed/)([A-Za-z0-9_-]{11})", 1), F.lit("")), F.nullif(F.regexp_extract("url", r"youtu\.be/([A-Za-z0-9_-]{11})", 1), F.lit("")))
    code, kind = F.substring(F.md5(F.col("url").cast("binary")), 1, 11), F.col("page_id") % 4
    url = F.when(kind == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), code, F.lit("&t=1"))).when(kind == 1, F.concat(F.lit("https://youtu.be/"), code)).when(kind == 2, F.concat(F.lit("https://www.youtube.com/embed/"), code)).otherwise(F.col("url"))
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), url.alias("url")).select("id", found.alias("video"))


def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Paths and values of each event's JSON; keys with a skipped fragment are left out."""
    rows = table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("path", "value"))
    skip = F.exists(F.array(*map(F.lit, fixed.JSON_SKIP)), lambda s: F.contains(F.lower("path"), s))
    return rows.where(~skip).select("event_id", F.concat_ws(": ", "path", "value").alias("line"))


def summary_validation(spark: SparkSession, sf: str) -> DataFrame:
    """0.5 faithfulness + 0.3 citation + 0.2 coverage of each answer against its source."""
    rows = answers(spark, sf)
    a, t = text.key_terms("answer", 2), text.key_terms("truth", 2)
    faith = text.share(text.overlap(a, t), F.size(a))
    cited = F.when(F.col("answer").rlike(r"\[\d+\]"), 1.0).otherwise(0.0)
    coverage = F.least(F.lit(1.0), 2 * text.share(text.overlap(a, t), F.size(t)))
    return rows.select("id", F.round(faith, 6).alias("faithfulness"), F.round(coverage, 6).alias("coverage"), F.round(0.5 * faith + 0.3 * cited + 0.2 * coverage, 6).alias("overall"))


def context_pr(spark: SparkSession, sf: str) -> DataFrame:
    """Token precision and recall of answers against the truth, and the blended script score."""
    rows = answers(spark, sf)
    a, t = (F.array_distinct(text.words(F.lower(c))) for c in ("answer", "truth"))
    p, r = text.share(text.overlap(a, t), F.size(a)), text.share(text.overlap(a, t), F.size(t))
    return rows.select("id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.least(F.lit(1.0), r * 1.5), 6).alias("relevancy"), F.round(0.4 * r + 0.3 * p + 0.3 * F.least(F.length("answer") / 100.0, F.lit(1.0)), 6).alias("score"))


QUERIES = {f.__name__: f for f in (query_kinds, typed_entities, arabic_norm, arabic_variants, arabic_keywords, lang_detect, clean_text, punct_density, entity_names, rel_type_norm, character_jaccard, key_terms, entity_phrases, pattern_ner, citations, semantic_overlap, faithfulness_rules, relevance_grade, route_queries, route_conversations, intent_complexity, decompose_queries, map_responses, cleaned_answers, themes, token_counts, context_budget, log_levels, url_ids, json_flatten, summary_validation, context_pr)}


def _list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> '')"


def _terms(x: str, longer: int = 3) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > {longer} AND NOT list_contains({_list(fixed.STOP_WORDS)}, w))))"


def _inter(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def _share(a: str, b: str) -> str:
    return f"coalesce({a} / nullif({b}, 0), 0)"


def _union(a: str, b: str) -> str:
    return f"len(list_distinct(list_concat({a}, {b})))"


_NORM = "translate(regexp_replace({0}, '[\u064b-\u0670\u065f\u0640]', '', 'g'), 'ةأإآى', 'هاااي')"
_CONF = "trim(regexp_replace(regexp_replace(translate(regexp_replace({0}, '[\u064b-\u0652\u0670\u0640]', '', 'g'), 'أإآٱى', 'ااااي'), '[^\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_COUNT = "length(regexp_replace({0}, '[^{1}]', '', 'g'))"
_AR, _LATIN = _COUNT.format("word", text.ARABIC), _COUNT.format("word", "A-Za-z")
_SENTENCES = "list_filter(string_split(regexp_replace({0}, '([.!?؟])\\s+', '\\1\u241e', 'g'), '\u241e'), lambda s: trim(s, e' \\t\\n') <> '')"
_clean = "text"
for _p in fixed.NOISE:
    _clean = f"regexp_replace({_clean}, '{_p}', ' ', 'g')"
_clean = f"trim(regexp_replace({_clean}, '\\s+', ' ', 'g'))"
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{'|'.join(f'(?:{p})' for p in ps)}') THEN '{n}'" for n, ps in fixed.QUERY_CLASSES.items()) + " ELSE 'factual' END"
_MODE = f"CASE WHEN len({_words('{0}')}) <= 2 THEN 'vector' ELSE CASE {{1}} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.CLASS_MODES.items()) + " END END"
_PAIRS = "FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def _turn_of(items: list[str], key: str) -> str:
    return f"({_list(items)})[{key} % {len(items)} + 1]"


_ID = "conv_id * 1000 + turn"
_T = f"(SELECT {_ID} AS id, conv_id, turn, text FROM conversations)"
_Q = f"(SELECT id, CASE id % 3 WHEN 0 THEN {_turn_of(QUERY_TEXTS, 'id')} || ' ' || split_part(text, '.', 1) WHEN 1 THEN {_turn_of(QUERY_TEXTS, 'id')} || ' ' || text ELSE text END AS query FROM {_T})"
_W = f"(SELECT id, CASE id % 2 WHEN 0 THEN {_turn_of(ARABIC_WORDS, 'id')} ELSE {_turn_of(ARABIC_WORDS, 'id')} || ' ' || text END AS word FROM {_T})"
_A = f"(SELECT {_ID.replace('conv_id', 'a.conv_id').replace('turn', 'a.turn')} AS id, CASE WHEN ({_ID.replace('conv_id', 'a.conv_id').replace('turn', 'a.turn')}) % 5 = 4 THEN b.text ELSE b.text || ' [' || (({_ID.replace('conv_id', 'a.conv_id').replace('turn', 'a.turn')}) % 4) || '] .' END AS answer, a.text AS truth, 3::BIGINT AS sources {_PAIRS})"
_REPLY = f"""(SELECT id, CASE id % 4 WHEN 0 THEN w || '}}' WHEN 1 THEN w || '}}' WHEN 2 THEN 'Relevance: ' || (length(text) % 100) || chr(10) || 'Answer: ' || regexp_extract(text, '([A-Za-z]+)', 1) || chr(10) || 'Points: x' ELSE text END AS reply
      FROM (SELECT id, text, '{{"score": ' || (length(text) % 300) || ', "answer": "' || regexp_extract(text, '([A-Za-z]+)', 1) || '", "points": ["a", "b", "c", "d"]' AS w FROM {_T}))"""
_FIRST, _LAST = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', -1)"
NAMES_SQL = f"(SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '  dr. ' || p_name || ' ' WHEN 1 THEN {_LAST} || ', ' || {_FIRST} WHEN 2 THEN upper(p_name) || ' CORP.' WHEN 3 THEN '\"' || p_name || '\"' ELSE p_name END AS name FROM part)"


def _case(key: str, values_: dict, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {json.dumps(v) if isinstance(v, float) else chr(39) + v + chr(39)}" for k, v in values_.items()) + f" ELSE {other} END"


_hits = "len(list_filter({0}, lambda t: contains(lower(query), t)))"
_LOCAL, _BROAD = _hits.format(_list(["who", "when", "where", "which"])), _hits.format(_list(["all", "overview", "themes", "summar", "compare"]))
_THEMES = "list_filter(['the', 'and', 'und', 'der', 'que', 'les', 'with', 'for', 'por'], lambda w: contains(lower(text), w))"
_DENSITY = "round(coalesce((length(text) - length(translate(text, '.,!?;:،؛؟', ''))) / nullif(length(text), 0), 0), 6)"
_NAME = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(name, '\s+', ' ', 'g')), '^[.,;:!?"''()\[\]-]+|[.,;:!?"''()\[\]-]+$', '', 'g'), '(?i)^(dr|mr|mrs|ms|prof|eng)\.? +', ''), '(?i) +(inc|ltd|llc|corp|co)\.?$', ''), '^([^,]+), ([^,]+)$', '\2 \1')"""
_CHARS = "list_distinct(list_filter(string_split(lower({0}), ''), lambda c: c <> ''))"
_GRADE = "CASE WHEN hits / n > 0.8 THEN 1.0 WHEN hits / n < 0.2 THEN 0.2 ELSE hits / n END"

ORACLE_SQL = {
    "arabic_norm": f"SELECT id, {_NORM.format('word')} AS normalized, {_CONF.format('word')} AS configured FROM {_W}",
    "arabic_variants": f"SELECT id, array_to_string(list_sort(list_distinct([word, {_NORM.format('word')}, CASE WHEN suffix(word, 'ة') THEN regexp_replace(word, 'ة$', 'ه') WHEN suffix(word, 'ه') THEN regexp_replace(word, 'ه$', 'ة') ELSE word END])), '|') AS variants FROM {_W}",
    "arabic_keywords": f"""SELECT id, array_to_string(list_transform(list_filter(list_transform({_words("query")}, lambda w: regexp_replace(w, '^[؟?!.,،؛:"''()]+|[؟?!.,،؛:"''()]+$', '', 'g')), lambda w: length(w) >= 3 AND NOT list_contains({_list(fixed.ARABIC_STOP_WORDS)}, w)),
      lambda w: CASE WHEN starts_with(w, 'ال') AND length(w) > 4 THEN substr(w, 3) ELSE w END), '|') AS keywords FROM (SELECT * FROM {_Q} UNION ALL SELECT -id - 1, word FROM {_W})""",
    "lang_detect": f"""WITH t AS (SELECT doc_id AS id, text AS word FROM documents UNION ALL SELECT -id - 1, word FROM {_W}), c AS (SELECT id, {_AR} AS ar, {_LATIN} AS la, length(word) AS n FROM t)
      SELECT id, CASE WHEN ar > la THEN 'ar' ELSE 'en' END AS by_letters, CASE WHEN {_share("ar", "n")} > 0.3 THEN 'ar' ELSE 'en' END AS by_ratio, CASE WHEN {_share("ar", "(ar + la)")} > 0.8 THEN 'ar' WHEN {_share("ar", "(ar + la)")} < 0.2 THEN 'en' ELSE 'mixed' END AS by_bands, {_share("ar", "(ar + la)")} > 0.5 AS is_arabic FROM c""",
    "clean_text": f"WITH c AS (SELECT doc_id, text, {_clean} AS c FROM documents) SELECT doc_id, length(c) AS length, md5(c) AS digest, round(1 - length(c) / length(text), 6) AS noise FROM c",
    "punct_density": f"SELECT doc_id, {_DENSITY} AS density, {_DENSITY} < 0.02 AND length(text) >= 100 AS unpunctuated FROM documents",
    "entity_names": f"SELECT id, array_to_string(list_transform(string_split({_NAME}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS normalized, trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS key FROM {NAMES_SQL}",
    "rel_type_norm": f"""WITH c AS (SELECT id, trim(type) AS o, regexp_replace(lower(trim(type)), '[ -]', '_', 'g') AS c FROM (SELECT event_id AS id, CASE WHEN event_id % 13 = 12 THEN event_type ELSE {_turn_of(RELATIONS, 'event_id')} END AS type FROM events)),
      f AS (SELECT id, CASE WHEN regexp_matches(o, '[{text.ARABIC}]') THEN {_case("c", fixed.ARABIC_RELATIONS, "c")} ELSE {_case("c", fixed.ENGLISH_RELATIONS, "c")} END AS f FROM c), k AS (SELECT id, {_case("f", fixed.ENGLISH_RELATIONS, "f")} AS kind FROM f),
      l AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(upper(kind), '[^A-Z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS l FROM k)
      SELECT id, kind, {_case("kind", {t: c for c, ts in fixed.RELATION_CATEGORIES.items() for t in ts}, "'other'")} AS category, CAST({_case("kind", fixed.RELATION_CONFIDENCE, "0.6")} AS DOUBLE) AS confidence, list_contains({_list(fixed.BOTH_WAYS)}, kind) AS both_ways, CASE l WHEN '' THEN 'RELATED_TO' ELSE l END AS label FROM l""",
    "character_jaccard": f"""WITH c AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b, {_CHARS.format("p_name")} AS x, {_CHARS.format("p_type")} AS y FROM part)
      SELECT p_partkey, round(least(1, {_inter("x", "y")} / {_union("x", "y")} + CASE WHEN contains(a, b) OR contains(b, a) THEN 0.3 ELSE 0 END), 6) AS similarity FROM c""",
    "key_terms": f"WITH t AS (SELECT doc_id, {_terms('text')} AS t FROM documents) SELECT doc_id, len(t) AS n, array_to_string(t[1:5], '|') AS first FROM t",
    "entity_phrases": "SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+'), regexp_extract_all(text, '[A-Z]{2,}'), regexp_extract_all(text, '20[0-9]{2}')))), '|') AS phrases FROM benchmark",
    "pattern_ner": " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{t}' AS type, unnest(regexp_extract_all(text, '{p}')) AS mention, 0.65::DOUBLE AS confidence FROM documents" for t, p in MENTION_PATTERNS.items()),
    "typed_entities": f"WITH t AS (SELECT id, id % 2 AS odd, {_turn_of(NAMINGS, 'id')} || '. ' || text AS text FROM {_T}), m AS ("
    + " UNION ALL ".join(f"SELECT id, '{kind}' AS type, unnest(regexp_extract_all(text, '(?i){p}')) AS mention FROM t WHERE odd = {i}" for i, kinds in enumerate(fixed.ENTITY_PATTERNS.values()) for kind, ps in kinds.items() for p in ps)
    + "), d AS (SELECT DISTINCT id, type, trim(regexp_replace(mention, '\\s+', ' ', 'g')) AS mention FROM m) SELECT *, 0.65::DOUBLE AS confidence FROM d WHERE length(mention) >= 2",
    "query_kinds": f"""WITH q AS (SELECT id, CASE WHEN id % 3 = 0 THEN {_turn_of(COMPLEX_TEXTS, 'id')} ELSE {_turn_of(COMPLEX_TEXTS, 'id')} || ' ' || text END AS query FROM {_T}), k AS (SELECT id, query, CASE {" ".join(f"WHEN regexp_matches(query, '{'|'.join(f'(?:{p})' for p in ps)}') THEN '{k}'" for k, ps in fixed.COMPLEX_QUERIES.items())}
      WHEN len({_words("query")}) > 12 AND contains(query, ' و ') THEN 'multi_hop' ELSE 'simple' END AS kind FROM q), p AS (SELECT id, kind, CASE WHEN kind != 'simple' AND length(query) >= 10 AND regexp_matches(query, '{fixed.CONJUNCTIONS}') THEN list_filter(list_transform(regexp_split_to_array(query, '{fixed.CONJUNCTIONS}'), lambda x: trim(x)), lambda x: length(x) > 5) ELSE [] END AS parts FROM k)
      SELECT id, kind, len(parts) AS parts, md5(coalesce(array_to_string(parts, '|'), '')) AS digest FROM p""",
    "citations": f"""WITH c AS (SELECT *, list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT)) AS cited FROM {_A})
      SELECT id, len(cited) AS n, round(CASE WHEN len(cited) > 0 THEN len(list_filter(cited, lambda x: x >= 1 AND x <= sources)) / len(cited) ELSE 0.5 END, 6) AS accuracy, round(0.5 * CASE WHEN len(cited) > 0 THEN 1.0 ELSE 0.3 END + 0.5 * least(len({_words("answer")}) / 50, 1), 6) AS completeness FROM c""",
    "semantic_overlap": f"WITH p AS (SELECT a.conv_id, a.turn, {_terms('a.text')} AS x, {_terms('b.text')} AS y {_PAIRS}) SELECT conv_id, turn, round_even(0.4 * {_share(_inter('x', 'y'), _union('x', 'y'))} + 0.6 * {_share(_inter('x', 'y'), 'len(x)')}, 3) AS score FROM p",
    "faithfulness_rules": f"""WITH p AS (SELECT a.conv_id, a.turn, {_terms("a.text")} AS context, unnest({_SENTENCES.format("b.text")}) AS sentence {_PAIRS}), t AS (SELECT conv_id, turn, context, {_terms("sentence")} AS t FROM p WHERE length(sentence) > 10)
      SELECT conv_id, turn, count(*) AS sentences, round(avg(CAST({_share(_inter("t", "context"), "len(t)")} >= 0.4 AS DOUBLE)), 6) AS faithfulness FROM t GROUP BY ALL""",
    "relevance_grade": f"""WITH d AS (SELECT doc_id, unnest({_terms("text", 6)}) AS term FROM documents), i AS (SELECT item_id, {_terms("text", 6)} AS t FROM benchmark), a AS (SELECT item_id, len(t) AS n, unnest(t) AS term FROM i),
      h AS (SELECT item_id, doc_id, n, count(*) AS hits FROM d JOIN a USING (term) GROUP BY ALL) SELECT item_id, round(max({_GRADE}), 6) AS grade, max(hits) AS hits FROM h GROUP BY item_id""",
    "route_queries": f"WITH q AS (SELECT id, query, {_CLASS.format('query')} AS class FROM {_Q}) SELECT id, class, {_MODE.format('query', 'class')} AS mode FROM q",
    "route_conversations": f"WITH q AS (SELECT text, {_CLASS.format('text')} AS class FROM conversations WHERE role = 'user') SELECT class, {_MODE.format('text', 'class')} AS mode, count(*) AS n FROM q GROUP BY ALL",
    "intent_complexity": f"""SELECT id, len({_words("query")}) AS words, CASE WHEN len({_words("query")}) > 12 THEN 'complex' WHEN len({_words("query")}) > 5 THEN 'medium' ELSE 'simple' END AS complexity, CASE WHEN {_LOCAL} > {_BROAD} THEN 'local' WHEN {_BROAD} > {_LOCAL} THEN 'global' ELSE 'hybrid' END AS router,
      CAST(CASE WHEN {_LOCAL} > {_BROAD} THEN 0.8 WHEN {_BROAD} > {_LOCAL} THEN 0.2 ELSE 0.5 END AS DOUBLE) AS low_weight, array_to_string({_terms("query")}, '|') AS terms FROM {_Q}""",
    "decompose_queries": f"""WITH p AS (SELECT id, CASE WHEN regexp_matches(lower(query), '^compare ') THEN string_split(regexp_replace(query, '(?i)^compare ', ''), ' and ') ELSE regexp_split_to_array(query, ' and | و |;') END AS parts FROM {_Q})
      SELECT id, CAST(unnest(range(len(parts))) AS BIGINT) AS part, trim(unnest(parts)) AS sub_query FROM p""",
    "map_responses": f"""WITH p AS (SELECT id, reply, CASE WHEN starts_with(reply, '{{') THEN reply END AS j FROM {_REPLY})
      SELECT id, round(CASE WHEN j IS NOT NULL THEN greatest(0, least(1, CAST(j ->> 'score' AS DOUBLE) / 100)) WHEN regexp_extract(reply, 'Relevance: *(\\d+)', 1) <> '' THEN CAST(regexp_extract(reply, 'Relevance: *(\\d+)', 1) AS DOUBLE) / 100 ELSE 0.1 END, 6) AS score,
      coalesce(j ->> 'answer', regexp_extract(reply, 'Answer: *([^\\n]*)', 1)) AS answer, CAST(least(coalesce(json_array_length(j, 'points'), 0), 3) AS BIGINT) AS points FROM p""",
    "cleaned_answers": f"WITH c AS (SELECT id, trim(regexp_replace(regexp_replace(answer, '\\[\\d+\\]', '', 'g'), '\\s+([.,])', '\\1', 'g')) AS clean FROM {_A}) SELECT id, clean, clean = '' AS empty FROM c",
    "themes": f"SELECT doc_id, array_to_string(({_THEMES})[1:5], '|') AS themes, len(({_THEMES})[1:5]) AS n FROM documents",
    "token_counts": "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents",
    "context_budget": "WITH j AS (SELECT conv_id, string_agg('[' || (turn + 1) || '] ' || text, chr(10) ORDER BY turn, text) AS c FROM conversations GROUP BY conv_id), o AS (SELECT conv_id, CASE WHEN length(c) > 4000 THEN substr(c, 1, 4000) || '...' ELSE c END AS c FROM j) SELECT conv_id, length(c) AS length, md5(c) AS digest FROM o",
    "log_levels": f"SELECT id, CASE WHEN regexp_matches(upper(line), 'ERROR|CRITICAL') THEN 'error' WHEN regexp_matches(upper(line), 'WARN') THEN 'warning' WHEN regexp_matches(upper(line), 'DEBUG') THEN 'debug' ELSE 'info' END AS level FROM (SELECT event_id AS id, concat_ws(' ', CASE WHEN value > 450 THEN 'WARNING: slow' WHEN event_id % 7 = 0 THEN 'debug' END, event_type, props) AS line FROM events)",
    "url_ids": f"SELECT id, coalesce(nullif(regexp_extract(url, '(?:v=|embed/)([A-Za-z0-9_-]{{11}})', 1), ''), nullif(regexp_extract(url, 'youtu\\.be/([A-Za-z0-9_-]{{11}})', 1), '')) AS video FROM (SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) || '&t=1' WHEN 1 THEN 'https://youtu.be/' || substr(md5(url), 1, 11) WHEN 2 THEN 'https://www.youtube.com/embed/' || substr(md5(url), 1, 11) ELSE url END AS url FROM pages)",
    "json_flatten": f"WITH e AS (SELECT event_id, unnest(json_keys(props)) AS path, props FROM events) SELECT event_id, path || ': ' || (props ->> path) AS line FROM e WHERE len(list_filter({_list(fixed.JSON_SKIP)}, lambda s: contains(lower(path), s))) = 0",
    "summary_validation": f"""WITH c AS (SELECT id, answer, {_terms("answer", 2)} AS a, {_terms("truth", 2)} AS t FROM {_A}), f AS (SELECT id, answer, {_share(_inter("a", "t"), "len(a)")} AS faith, least(1, 2 * {_share(_inter("a", "t"), "len(t)")}) AS coverage FROM c)
      SELECT id, round(faith, 6) AS faithfulness, round(coverage, 6) AS coverage, round(0.5 * faith + 0.3 * CASE WHEN regexp_matches(answer, '\\[\\d+\\]') THEN 1 ELSE 0 END + 0.2 * coverage, 6) AS overall FROM f""",
    "context_pr": f"""WITH c AS (SELECT id, answer, list_distinct({_words("lower(answer)")}) AS a, list_distinct({_words("lower(truth)")}) AS t FROM {_A}), f AS (SELECT id, answer, {_share(_inter("a", "t"), "len(a)")} AS p, {_share(_inter("a", "t"), "len(t)")} AS r FROM c)
      SELECT id, round(p, 6) AS precision, round(r, 6) AS recall, round(least(1, r * 1.5), 6) AS relevancy, round(0.4 * r + 0.3 * p + 0.3 * least(length(answer) / 100, 1), 6) AS score FROM f""",
}
