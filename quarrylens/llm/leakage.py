"""Held-out passages inside a corpus: a prefix-filtered join on rare word runs, verified on the words themselves.

A leak is a run of ``window`` consecutive words of an item in the same order in a document. Such a run contains
``window - gram + 1`` grams of ``gram`` words, all of which the document must hold, so one of them is enough to find
it: every item window is posted under its rarest gram, rarity being counted over the whole corpus. Documents that hold
a posted gram are candidates; the offset between the two positions is the only alignment at which that window can
match, and the words around it are compared there.

Cost: one pass over the corpus makes the grams; only grams that some item has are kept, in the shared checkpoint
folder, and everything after works on those. The item side is broadcast only if its counted rows stay below
``broadcast_rows``; otherwise the join shuffles on the gram. A gram that a third of the corpus holds costs a window
only if the window has no rarer one, and its rows are joined, never gathered.

Edge cases: null or short texts and items with fewer than ``window`` words give nothing; punctuation, case and line
breaks don't matter; repeated documents and items each give their own rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.llm.words import shingle_hashes, words
from quarrylens.session import cut_lineage


def _grams(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            grams = [shingle_hashes(words(t), width).astype(np.int64) for t in pdf["text"]]
            keep = [len(g) > 0 for g in grams]
            yield pd.DataFrame({"id": pdf["id"][keep], "grams": [g for g in grams if len(g)]})

    return run


def longest_run(doc: list[str], item: list[str], shifts) -> int:
    """Longest run of equal words when the item is laid on the document at one of the shifts."""
    best = 0
    for shift in set(shifts):
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        run = 0
        for k in range(lo, hi):
            run = run + 1 if item[k] == doc[k + shift] else 0
            best = max(best, run)
    return best


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        runs = [
            longest_run(words(d), words(i), s) for d, i, s in zip(pdf["doc_text"], pdf["item_text"], pdf["shifts"])
        ]
        yield pd.DataFrame({
            "doc_id": pdf["doc_id"], "item_id": pdf["item_id"], "run_words": runs,
            "item_words": [len(words(i)) for i in pdf["item_text"]],
        })


def leaks(docs: DataFrame, items: DataFrame, *, window: int = 12, gram: int = 6, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, item_id, run_words, item_words for ``docs`` (doc_id, text) and ``items`` (item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("doc_text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"))

    def posted(df: DataFrame, key: str, text: str) -> DataFrame:
        made = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null").mapInPandas(
            _grams(gram), "id long, grams array<long>"
        )
        return made.select(F.col("id").alias(key), F.posexplode("grams").alias("pos", "gram"))

    item_grams = cut_lineage(posted(items, "item_id", "item_text").withColumnRenamed("pos", "item_pos"))
    small = item_grams.count() <= broadcast_rows
    bounded = F.broadcast if small else (lambda df: df)
    wanted = item_grams.select("gram").distinct()
    held = cut_lineage(
        posted(docs, "doc_id", "doc_text").withColumnRenamed("pos", "doc_pos").join(bounded(wanted), "gram", "left_semi")
    )
    rarity = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    span = window - gram
    over = W.partitionBy("item_id").orderBy("item_pos").rowsBetween(0, span)
    ranked = item_grams.join(rarity, "gram", "left").select(
        "item_id", "item_pos",
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("item_pos"), F.col("gram"))).over(over).alias("rare"),
        F.count(F.lit(1)).over(over).alias("in_window"),
    )
    prefix = ranked.where((F.col("in_window") == span + 1) & (F.col("rare.n") > 0)).select(
        "item_id", F.col("rare.item_pos").alias("item_pos"), F.col("rare.gram").alias("gram")
    ).distinct()
    found = (
        held.join(bounded(prefix), "gram")
        .groupBy("doc_id", "item_id")
        .agg(F.collect_set(F.col("doc_pos") - F.col("item_pos")).alias("shifts"))
    )
    texts = found.join(bounded(items), "item_id").join(docs, "doc_id")
    checked = texts.mapInPandas(_verify, "doc_id long, item_id long, run_words int, item_words int")
    return checked.where(F.col("run_words") >= window).groupBy("doc_id", "item_id").agg(
        F.max("run_words").alias("run_words"), F.max("item_words").alias("item_words")
    )


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: documents that hold a passage of it, the longest passage, and how much of the item that is."""
    per = found.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("documents"), F.max("run_words").alias("longest_run"), F.max("item_words").alias("item_words")
    )
    return items.select("item_id", "task", "lang").join(per, "item_id", "left").select(
        "item_id", "task", "lang", F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("longest_run", F.lit(0)).alias("longest_run"),
        F.round(F.coalesce(F.col("longest_run") / F.col("item_words"), F.lit(0.0)), 4).alias("covered"),
    )
