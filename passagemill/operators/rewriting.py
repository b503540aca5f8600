"""A caller's question rewriter as a table function of SQL. [M3 M4 G2]"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

from passagemill.functions.text import collapse_space


def register_rewriter(spark: SparkSession, name: str, rewrite: Callable[[str], Iterable[str | None] | None], variants: int = 3) -> None:
    """SQL: ``name(TABLE(questions))`` → (query_id, variant, text, degraded), the question first and its rewritings after it.

    The table has query_id, of any type, and text; other columns are passed over. ``rewrite(text)`` names a question's
    other forms in order; blank ones and repetitions go, and ``variants`` bounds all forms with the question itself.
    Where it raises, the question stands alone and is marked degraded. White space is collapsed; a question without
    text (null or blank) has no form. Of several rows of one id the least text counts, and rows without id are one id.
    The function asks Spark to deal rows by query_id, so a task streams them and keeps nothing but the last id.
    """

    class Rewriter:
        @staticmethod
        def analyze(questions: AnalyzeArgument) -> AnalyzeResult:
            if not questions.isTable:
                raise ValueError(f"{name} takes a table: {name}(TABLE(questions))")
            given = {f.name: f.dataType for f in questions.dataType}
            missing = {"query_id", "text"} - given.keys()
            if missing:
                raise ValueError(f"{name}: the table has no column {', '.join(sorted(missing))}")
            if given["text"] != T.StringType():
                raise ValueError(f"{name}: text is {given['text'].simpleString()}, not string")
            out = T.StructType([T.StructField("query_id", given["query_id"]), T.StructField("variant", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("degraded", T.BooleanType())])
            return AnalyzeResult(out, partitionBy=[PartitioningColumn("query_id")], orderBy=[OrderingColumn("text", overrideNullsFirst=False)])

        def __init__(self) -> None:
            self.done = False

        def eval(self, row):
            text = " ".join((row["text"] or "").split())
            if self.done or not text:
                return
            self.done = True
            degraded, forms = False, [text]
            try:
                forms += [" ".join((x or "").split()) for x in rewrite(text) or ()]
            except Exception:  # noqa: BLE001  the caller's function may fail in any way
                degraded, forms = True, [text]
            for i, form in enumerate([x for x in dict.fromkeys(forms) if x][:variants]):
                yield row["query_id"], i, form, degraded

    spark.udtf.register(name, udtf(Rewriter))


def rewritten(questions: DataFrame, name: str) -> DataFrame:
    """(query_id, variant, text, degraded) of questions(query_id, text) by a registered rewriter."""
    asked = questions.select("query_id", collapse_space("text").alias("text"))
    return questions.sparkSession.sql(f"SELECT * FROM {name}(TABLE({{asked}}))", asked=asked)
