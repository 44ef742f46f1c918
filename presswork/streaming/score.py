"""Two-stage scoring of a stream of texts or JSON requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from presswork import config
from presswork.operators.inference import Stage, analyze


def request_text(body: Column) -> Column:
    """``text`` of a JSON request body; '' when it is absent."""
    return F.coalesce(F.get_json_object(body, "$.text"), F.lit(""))


def response_json(df: DataFrame, out: str = "response") -> DataFrame:
    """The response document of an analysed row: an error, or category, confidence and issue scores."""
    answer = F.to_json(F.struct("category", "confidence", "ethics"), {"ignoreNullFields": "false"})
    failure = F.to_json(F.struct("error"))
    return df.withColumn(out, F.when(F.col("error").isNotNull(), failure).otherwise(answer))


def score_stream(
    texts: DataFrame, stage1: Stage, stage2: Stage | None, out: str, checkpoint: str,
    gate: str | None = config.GATE_CATEGORY, text: str = "text",
) -> StreamingQuery:
    """Score a stream without state and append the results as Parquet."""
    scored = analyze(texts, stage1, stage2, gate, text)
    return (
        scored.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
