"""Small tables with everything that operators must bear: nulls, empty and long texts, ties, repeated rows, odd columns."""

from __future__ import annotations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return, as columns of a table.
CLASHES = "w string, score double, hit string, h long, t long, row_t long, gone_id long, reps int, rep int, size long, target double, c0 string, row_ string, toxic_score double, lang_pred string, lang_score double, component_id long"


def documents(spark, rows, clashes: bool = False):
    """rows: (doc_id, text, lang, source)."""
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCUMENTS)
    if clashes:
        from pyspark.sql import functions as F

        for part in CLASHES.split(", "):
            name, kind = part.split()
            df = df.withColumn(name, F.lit("7").cast(kind))
    return df


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
