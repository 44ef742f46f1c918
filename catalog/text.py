"""Projections, filters and text preparation."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import query
from presswork import config
from presswork.functions import text as X
from presswork.operators.rows import array_rows

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
ARTICLES = f"with articles as ({fx.duck(fx.ARTICLES_SQL)})"
# Every fourth title and every ninth content is NULL, every seventh content blank.
HOLES = """case when doc_id % 4 = 0 then null else title end as title,
case when doc_id % 9 = 0 then null when doc_id % 7 = 0 then concat(chr(160), ' ', chr(9)) else content end as content"""


def _holes(spark, sf):
    return fx.articles(spark, sf).selectExpr("doc_id", "domain", *[
        "case when doc_id % 4 = 0 then null else title end as title",
        "case when doc_id % 9 = 0 then null when doc_id % 7 = 0 then concat(' ', ' ', '\t') else content end as content",
    ])


HOLES_CTE = f"{ARTICLES}, holes as (select doc_id, domain, {HOLES} from articles)"


@query("compose_text", f"{HOLES_CTE} select doc_id, coalesce(title, '') || ' ' || coalesce(content, '') as text from holes")
def compose_text(spark, sf):
    return _holes(spark, sf).select("doc_id", X.compose_text(F.col("title"), F.col("content")).alias("text"))


@query("non_blank", f"{HOLES_CTE} select doc_id, content from holes where content is not null and regexp_matches(content, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]')")
def non_blank(spark, sf):
    return _holes(spark, sf).where(X.non_blank(F.col("content"))).select("doc_id", "content")


@query("drop_nulls", f"{HOLES_CTE} select doc_id, title, content from holes where title is not null and content is not null")
def drop_nulls(spark, sf):
    return _holes(spark, sf).select("doc_id", "title", "content").na.drop("any")


@query("truncate_chars", f"{HOLES_CTE} select doc_id, substring(coalesce(content, ''), 1, 4000) as text from holes")
def truncate_chars(spark, sf):
    return _holes(spark, sf).select("doc_id", X.truncate_chars(F.col("content"), config.STAGE1_CHARS).alias("text"))


@query("truncate_words", f"""select doc_id, array_to_string(
  string_split(trim(regexp_replace(text, '{WS}+', ' ', 'g')), ' ')[1:5000], ' ') as text from documents""")
def truncate_words(spark, sf):
    return fx.documents(spark, sf).select("doc_id", X.truncate_words(F.col("text"), config.SINGLE_LABEL_WORDS).alias("text"))


@query("clean_text", f"select doc_id, trim(regexp_replace(text, '{WS}+', ' ', 'g')) as text from documents")
def clean_text(spark, sf):
    return fx.documents(spark, sf).select("doc_id", X.collapse_ws(F.col("text")).alias("text"))


@query("label_keys", """select distinct source, label, 'stage2_' || replace(replace(lower(label), ' ', '_'), '&', 'and') as label_key
from (select source, upper(source) || ' & ' || lang || ' Data' as label from documents)""")
def label_keys(spark, sf):
    label = F.concat(F.upper("source"), F.lit(" & "), F.col("lang"), F.lit(" Data"))
    return (
        fx.documents(spark, sf).select("source", label.alias("label"))
        .withColumn("label_key", X.label_key(F.col("label"), "stage2")).distinct()
    )


@query("label_display", """select distinct name,
  array_to_string(list_transform(string_split(replace(regexp_replace(name, '^stage[12]_(binary_)?', ''), '_', ' '), ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') as display
from (select case when doc_id % 2 = 0 then 'stage1_binary_' else 'stage2_' end || source || '_in_' || lang as name from documents)""")
def label_display(spark, sf):
    name = F.concat(
        F.when(F.col("doc_id") % 2 == 0, "stage1_binary_").otherwise("stage2_"), "source", F.lit("_in_"), "lang")
    return fx.documents(spark, sf).select(name.alias("name")).distinct().withColumn(
        "display", X.label_display(F.col("name")))


# Inputs of 9 to 12 visible characters between white space, cut from the texts.
_INPUT_SQL = "concat(chr(9), ' ', substring({t}, 1, cast(9 + doc_id % 4 as int)), ' ', chr(10))"


@query("validate_input", f"""select doc_id, case when length(regexp_replace(input, '^{WS}+|{WS}+$', '', 'g')) < 10
  then 'Please provide valid article text (at least 10 characters)' end as error
from (select doc_id, {_INPUT_SQL.format(t='text')} as input from documents)""")
def validate_input(spark, sf):
    return fx.documents(spark, sf).selectExpr("doc_id", f"{_INPUT_SQL.format(t='text')} as input").select(
        "doc_id", X.input_error(F.col("input")).alias("error"))


@query("tokens", """select doc_id, unnest(range(len(w))) as pos, unnest(w) as token
from (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') as w from documents)""")
def tokens(spark, sf):
    return array_rows(fx.documents(spark, sf), ["doc_id"], X.tokenize(F.col("text")), "token").withColumn("pos", F.col("pos").cast("long"))


@query("bigrams", """with w as (select doc_id, unnest(range(len(w))) as pos, unnest(w) as token
  from (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') as w from documents)),
p as (select doc_id, pos, token || ' ' || lead(token) over (partition by doc_id order by pos) as bigram from w)
select doc_id, pos, bigram from p where bigram is not null""")
def bigrams(spark, sf):
    return (
        array_rows(fx.documents(spark, sf).withColumn("t", X.tokenize(F.col("text"))), ["doc_id"],
                   X.bigrams(F.col("t")), "bigram")
        .withColumn("pos", F.col("pos").cast("long"))
    )
