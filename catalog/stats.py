"""Corpus statistics."""

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog import labels as L
from catalog.registry import query
from presswork.config import CATEGORIES
from presswork.functions.text import label_display
from presswork.operators import splits, stats

ART = f"with articles as ({fx.duck(fx.ARTICLES_SQL)})"
def _length():
    return F.length("content").cast("long")



def _pct(df):
    return df.withColumn("pct", F.round("pct", 6))


@query("domain_top20", f"{ART} select domain, count(*) as articles from articles group by domain order by articles desc, domain limit 20")
def domain_top20(spark, sf):
    return stats.domain_counts(fx.articles(spark, sf), 20)


@query("domain_summary", f"{ART} select count(distinct domain) as domains, count(*) as articles, greatest(count(distinct domain) - 20, 0) as more from articles")
def domain_summary(spark, sf):
    return stats.domain_summary(fx.articles(spark, sf))


@query("length_minmaxavg", f"{ART} select min(length(content)) as min_chars, max(length(content)) as max_chars, round(avg(length(content)), 6) as mean_chars, count(*) as articles from articles")
def length_minmaxavg(spark, sf):
    out = stats.length_stats(fx.articles(spark, sf), _length())
    return out.withColumn("mean_chars", F.round("mean_chars", 6))


@query("length_profile", f"""{ART} select round(avg(length(content)), 6) as mean_chars, median(length(content)) as median_chars, min(length(content)) as min_chars,
max(length(content)) as max_chars, count(*) filter (where length(content) > 4000) as over_limit from articles""")
def length_profile(spark, sf):
    out = stats.length_profile(fx.articles(spark, sf), _length())
    return out.withColumn("mean_chars", F.round("mean_chars", 6))


@query("length_outliers", f"""{ART}, n as (select length(title || ' ' || content) as n from articles)
select count(*) filter (where n < 100) as short_texts, count(*) filter (where n > 10000) as long_texts, count(*) as articles,
round(100.0 * count(*) filter (where n < 100) / count(*), 6) as short_pct, round(100.0 * count(*) filter (where n > 10000) / count(*), 6) as long_pct from n""")
def length_outliers(spark, sf):
    length = F.length(F.concat("title", F.lit(" "), "content"))
    out = stats.length_outliers(fx.articles(spark, sf), length)
    return out.withColumns({c: F.round(c, 6) for c in ("short_pct", "long_pct")})


_VALUES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES))


@query("category_distribution", f"""{L.SINGLE_CTE}, dim as (select * from (values {_VALUES}) v(position, label))
select d.position, d.label, count(s.doc_id) as articles, round(100.0 * count(s.doc_id) / (select count(*) from single), 6) as pct
from dim d left join single s on s.label = d.label group by d.position, d.label""")
def category_distribution(spark, sf):
    return _pct(stats.category_distribution(L.single(spark, sf)))


@query("label_value_counts", f"{L.SINGLE_CTE} select label, count(*) as articles, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from single group by label")
def label_value_counts(spark, sf):
    return _pct(stats.value_counts(L.single(spark, sf), "label"))


@query("distinct_labels", f"{L.SINGLE_CTE} select distinct label from single")
def distinct_labels(spark, sf):
    return stats.classes(L.single(spark, sf))


def _unpivot(source: str, columns) -> str:
    return " union all ".join(f"select doc_id, '{c}' as label, {c} as value from {source}" for c in columns)


@query("score_stats", f"""{L.WIDE_CTE}, long as ({_unpivot('combined', [*L.S1_COLS, *L.S2_COLS])})
select label, count(*) filter (where value >= 0.5) as positives, round(avg(value), 6) as mean_score,
round(100.0 * count(*) filter (where value >= 0.5) / count(*), 6) as pct from long group by label""")
def score_stats(spark, sf):
    out = stats.score_stats(L.labelled(spark, sf), [*L.S1_COLS, *L.S2_COLS])
    return _pct(out).withColumn("mean_score", F.round("mean_score", 6))


def _counts_sql(columns, where="true") -> str:
    return f"""{L.WIDE_CTE}, long as ({_unpivot(f'(select * from binary_labels where {where})', columns)})
select label, cast(sum(value) as bigint) as positives, round(100.0 * sum(value) / count(*), 6) as pct from long group by label"""


@query("label_counts_stage1", _counts_sql(L.B1_COLS))
def label_counts_stage1(spark, sf):
    return _pct(stats.label_counts(L.binary(spark, sf), L.B1_COLS))


MASK = "stage1_binary_artificial_intelligence = 1"


@query("label_counts_stage2", _counts_sql(L.B2_COLS, MASK))
def label_counts_stage2(spark, sf):
    return _pct(stats.label_counts(L.binary(spark, sf), L.B2_COLS, F.expr(MASK)))


def _sum(columns):
    return " + ".join(columns)


@query("labels_per_row", f"{L.WIDE_CTE} select {_sum(L.B1_COLS)} as labels, count(*) as articles from binary_labels group by 1")
def labels_per_row(spark, sf):
    return stats.labels_per_row(L.binary(spark, sf), L.B1_COLS)


@query("label_histogram", f"""{L.WIDE_CTE}, n as (select {_sum(L.B2_COLS)} as n from binary_labels where {MASK}),
bins as (select unnest(range(13)) as bin)
select cast(bin as int) as bin, count(n.n) as articles from bins left join n on (n.n = bin or (bin = 12 and n.n = 13)) group by bin""")
def label_histogram(spark, sf):
    rows = L.binary(spark, sf).where(F.expr(MASK))
    return stats.histogram(rows, stats.row_label_count(L.B2_COLS), 13)


DISPLAY = [c.replace("_", " ").title() for c in (k.removeprefix("stage1_") for k in L.S1_COLS)]
_NAMES = ", ".join(f"case when {c} = 1 then '{d}' end" for c, d in zip(L.B1_COLS, DISPLAY))


@query("top_combinations", f"""{L.WIDE_CTE} select coalesce(nullif(array_to_string(list_filter([{_NAMES}], lambda x: x is not null), ', '), ''), 'No Labels') as labels,
count(*) as articles from binary_labels group by 1 order by articles desc, labels limit 10""")
def top_combinations(spark, sf):
    return stats.top_combinations(L.binary(spark, sf), L.B1_COLS, DISPLAY, 10)


SPLIT_CTE = """split_rows as (select b.*, case when md5(doc_id || ':42') < 'cccccccc' then 'train'
  when md5(doc_id || ':42') < 'e6666666' then 'val' else 'test' end as split from binary_labels b)"""


def _split_unpivot(columns) -> str:
    return " union all ".join(f"select split, '{c}' as label, {c} as value from split_rows" for c in columns)


@query("label_positives", f"{L.WIDE_CTE}, {SPLIT_CTE}, long as ({_split_unpivot(L.B1_COLS)}) select split, label, cast(sum(value) as bigint) as positives from long group by split, label")
def label_positives(spark, sf):
    return stats.label_positives(splits.split_hash(L.binary(spark, sf), "doc_id"), L.B1_COLS)


@query("split_sizes", """select split, count(*) as rows, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct
from (select case when md5(doc_id || ':42') < 'cccccccc' then 'train' when md5(doc_id || ':42') < 'e6666666' then 'val' else 'test' end as split from documents) group by split""")
def split_sizes(spark, sf):
    return _pct(stats.split_sizes(splits.split_hash(fx.documents(spark, sf).select("doc_id"), "doc_id")))


@query("chart_series", f"""{L.WIDE_CTE}, long as ({_unpivot('binary_labels', L.B1_COLS)}), c as (select label, cast(sum(value) as bigint) as value from long group by label)
select label, array_to_string(list_transform(string_split(replace(replace(label, 'stage1_binary_', ''), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as name,
value, round(100.0 * value / sum(value) over (), 6) as share_pct from c""")
def chart_series(spark, sf):
    series = stats.chart_series(stats.label_counts(L.binary(spark, sf), L.B1_COLS))
    return series.select("label", label_display(F.col("label")).alias("name"), "value", F.round("share_pct", 6).alias("share_pct"))
