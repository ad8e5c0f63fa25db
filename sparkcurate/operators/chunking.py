"""Cutting long texts into overlapping chunks, row by row and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions.prompts import CHUNK_SIZE
from sparkcurate.functions.text import last_sentences
from sparkcurate.operators.rows import settled


def chunk_texts(
    df: DataFrame,
    text: str,
    size: Column | int = CHUNK_SIZE,
    separator: str = "\n\n",
    overlap_sentences: int = 2,
) -> DataFrame:
    """One row per chunk with ``chunk_index`` (1-based), ``chunk_count`` and ``chunk``.

    Paragraphs are packed in order; a paragraph that would push a non-empty chunk over
    ``size`` (a number, or a Column to choose it per row) opens the next one. Every chunk after the first is led in by the last sentences
    of the chunk before and a blank line. The fold carries only lengths and the paragraph
    number each chunk starts at; texts are cut once, at the end.
    """
    gap = len(separator)
    size = F.lit(size) if isinstance(size, int) else size
    start_state = F.struct(
        F.array(F.lit(0)).alias("starts"), F.lit(0).alias("filled"), F.lit(0).alias("seen")
    )

    def add(state, length):
        over = (state["seen"] > 0) & (state["filled"] + length > size)
        return F.struct(
            F.when(over, F.concat(state["starts"], F.array(state["seen"])))
            .otherwise(state["starts"]).alias("starts"),
            F.when(over, length).otherwise(state["filled"] + length + gap).alias("filled"),
            (state["seen"] + 1).alias("seen"),
        )

    # Quoted, because split takes a regular expression.
    paragraphs = df.withColumn("_p", F.split(F.col(text), rf"\Q{separator}\E"))
    starts = paragraphs.withColumn(
        "_s", F.aggregate(F.transform("_p", F.length), start_state, add)["starts"]
    )
    plain = starts.withColumn(
        "_c",
        F.transform(
            F.col("_s"),
            lambda s, j: F.array_join(
                F.slice(
                    F.col("_p"), s + 1,
                    F.coalesce(F.try_element_at(F.col("_s"), j + 2), F.size("_p")) - s,
                ),
                separator,
            ),
        ),
    )
    # The tail of a chunk is wanted by the next one only, so the last has none. Settled, or every chunk would make
    # the tails of all chunks.
    tails = F.transform(
        F.slice(F.col("_c"), F.lit(1), F.greatest(F.size("_c") - 1, F.lit(0))),
        lambda c: F.concat(last_sentences(c, overlap_sentences), F.lit("\n\n")),
    )
    led = settled(plain, {"_t": tails})
    chunks = F.transform(
        F.col("_c"),
        lambda c, j: F.concat(
            F.when(j > 0, F.try_element_at(F.col("_t"), j)).otherwise(""), c
        ),
    )
    return led.select(
        *df.columns, F.size("_c").alias("chunk_count"), F.posexplode(chunks).alias("_i", "chunk")
    ).select(*df.columns, (F.col("_i") + 1).alias("chunk_index"), "chunk_count", "chunk")
