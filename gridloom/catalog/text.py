"""Question tags over a table of questions made from the orders."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import vocabulary
from ..operators.prepare import level_codes
from ..session import checkpointed
from .registry import query

# The phrases put around column values, so that every tag and every default occurs.
PHRASES = (
    "Show the monthly trend of revenue", "Compare average margin versus", "Top 5 highest emissions by",
    "Histogram of daily temp for", "Summary of annual sales in", "What is the minimum weekly turnover of",
    "Tell me about the stopped orders of",
)
QUESTIONS_SQL = "(select o_orderkey, case o_orderkey % 7 " + " ".join(
    f"when {i} then '{p}'" for i, p in enumerate(PHRASES)) + " end || ' ' || o_orderpriority as question from orders)"


def questions(t):
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("o_orderkey") % 7).cast("int"))
    return t("orders").select("o_orderkey", F.concat_ws(" ", phrase, "o_orderpriority").alias("question"))


def first_tag_sql(words: dict, default: str = "null") -> str:
    tests = " ".join(
        "when " + " or ".join(f"contains(lower(question), '{k}')" for k in keys) + f" then '{tag}'"
        for tag, keys in words.items()
    )
    return f"case {tests} else {default} end"


@query("tag_kind", f"select o_orderkey, question, {first_tag_sql(text.KIND_WORDS, chr(39) + 'trend' + chr(39))} as kind from {QUESTIONS_SQL}")
def kinds(t):
    return questions(t).withColumn("kind", text.question_kind(F.col("question")))


@query("tag_grain", "select o_orderkey, question, case " + " ".join(
    f"when contains(lower(question), '{w}') then '{g}'" for w, g in text.GRAIN_WORDS.items()) + f" end as grain from {QUESTIONS_SQL}")
def grains(t):
    return questions(t).withColumn("grain", text.question_grain(F.col("question")))


@query("tag_agg", f"select o_orderkey, question, {first_tag_sql(text.AGG_WORDS)} as agg from {QUESTIONS_SQL}")
def aggregates(t):
    return questions(t).withColumn("agg", text.question_agg(F.col("question")))


@query("tag_metric", f"select o_orderkey, question, {first_tag_sql(text.METRIC_SYNONYMS)} as metric from {QUESTIONS_SQL}")
def metrics(t):
    return questions(t).withColumn("metric", text.question_metric(F.col("question")))


VOCABULARY = ["small_widget", "Gizmos", "blue bolt", "gaer", "ring", "p_name", "widgit", "hott"]


SPELLINGS_SQL = ", ".join(
    f"({i}, '{n}', '{spelled}', {cost})" for i, n in enumerate(VOCABULARY) for spelled, cost in text.spellings(n))


@query("fuzzy_match", f"""
with w as (select distinct p_partkey, word from (
  select p_partkey, unnest(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ')) as word from part) where word <> ''),
d as (select p_partkey, word, place, name, min(cost + levenshtein(word, spelled)) as edits
  from w, (values {SPELLINGS_SQL}) v(place, name, spelled, cost) group by p_partkey, word, place, name),
s as (select *, 1 - edits / greatest(length(word), length(name)) as score from d),
best as (select p_partkey, word, arg_max(name, (score, -place)) as name, max(score) as score from s group by all)
select distinct p_partkey, name from best where score >= 0.8""")
def fuzzy(t):
    found = text.closest_names(F.col("p_name"), VOCABULARY)
    return t("part").select("p_partkey", F.explode(found).alias("name"))


NAMES = ["the on", "n_chars", "Order", "is and", "la de", "und"]
PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query("mention_match", f"""
with d as (select doc_id, {PLAIN.format('text')} as plain from documents),
n as (select name, {PLAIN.format('name')} as plain, pos from (
  select unnest({NAMES!r}) as name, unnest(range({len(NAMES)})) as pos))
select doc_id, name from d, n where contains(d.plain, n.plain)
  or len(list_filter(string_split(n.plain, ' '), lambda w: not list_contains(string_split(d.plain, ' '), w))) = 0""")
def mentions(t):
    return t("documents").select("doc_id", F.explode(text.mentioned(F.col("text"), NAMES)).alias("name"))


WORDS_SQL = """v as (select word as name, row_number() over (order by word) - 1 as place from (
  select distinct unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) as word from documents)
  where word <> '')"""


def document_words(t):
    words = checkpointed(t("documents").select(F.explode(text.tokens(F.col("text"))).alias("name")).distinct())  # read more than once
    return level_codes(words, "name").select("name", F.col("code").alias("place"))


@query("fuzzy_vocabulary", f"""
with {WORDS_SQL},
u as (select distinct p_partkey, word from (
  select p_partkey, unnest(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ')) as word from part) where word <> ''),
w as (select distinct word from u),
s as (select name, place, name as spelled, 0 as cost from v union all
  select name, place, name[:i - 1] || name[i + 1] || name[i] || name[i + 2:], 1
  from (select name, place, unnest(range(1, length(name))) as i from v)),
d as (select word, name, place, min(cost + levenshtein(word, spelled)) as edits from w, s
  where abs(length(word) - length(spelled)) <= 10 group by word, name, place),
best as (select word, arg_max(name, (1 - edits / greatest(length(word), length(name)), -place)) as name from d
  where 1 - edits / greatest(length(word), length(name)) >= 0.8 group by word)
select distinct p_partkey, name from u join best using (word)""")
def fuzzy_table(t):
    return vocabulary.closest_names(t("part"), "p_partkey", "p_name", document_words(t), "name", "place").drop("position")


@query("mention_vocabulary", f"""
with {WORDS_SQL}, n as (
  select name from v union select string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] from part),
p as (select distinct p_name as plain from part)
select p_partkey, name from part join (
  select plain, name from p, n where contains(plain, name)
    or len(list_filter(string_split(name, ' '), lambda w: not list_contains(string_split(plain, ' '), w))) = 0) on plain = p_name""")
def mention_table(t):
    words = F.split("p_name", " ")
    turned = t("part").select(F.concat_ws(" ", words[1], words[0]).alias("name"))
    names = document_words(t).select("name").unionByName(turned)
    return vocabulary.mentions(t("part"), "p_partkey", "p_name", names, "name")
