"""Mixing sources to target shares of tokens with capped repeats.

Documents with a usable source are the labelled table. Their word counts by source, summed over all of them, make a naive
Bayes classifier; every document, labelled or not, gets its posterior over the sources from the words of the other half of the
labelled documents, so none is judged by itself. A label is evidence, not a membership: it multiplies its source by ``trust`` and the
others by the rest. The sharpness of the posterior is the one with the least held-out loss. A rate per document, between 0 and
the repeats its source allows, is then fitted so that the expected tokens of each source match the targets: projected
gradient steps on the least squares, each one distributed sum over the documents (documents of equal membership share a rate, so they
are summed first and the result stays exact). Rates become whole repeats by systematic sampling along running sums, so that a
source's repeats differ from the sum of its rates by less than one document.

The total is the largest that all targets allow, unless given. Token counts come from the vocabulary file of a public
tokenizer whose path is a parameter. Held-out accuracy, loss and the residual of every step are reported by ``quality``.

Scale: one narrow map counts tokens and words of whole texts and keeps their numbers; all later passes work on these. The classifier's
table has ``WORD_BUCKETS`` rows by source and half, however many documents there are, and at most ``MOST_TARGETS`` sources are allowed
(more is an error). Running sums go through hash buckets of a source with offsets from the buckets' totals, so a source with a third of all
rows is not ordered in one task.

Edge cases: null and empty texts have no tokens and are never chosen; sources that differ in case or blanks are one; a source
without a target is as good as none; a target without documents gets nothing and is reported with share 0; repeated rows
are documents of their own; extra columns are ignored; empty tables give no documents and zero shares.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.llm.words import words
from quarrylens.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_BUCKETS = 1 << 14
ROWS_PER_BUCKET = 50_000
MOST_TARGETS = 1000
TEMPERS = (1.0, 0.5, 0.25, 0.15, 0.1, 0.07)

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, once a process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _word_ids(text: str) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(w.encode()) % WORD_BUCKETS for w in words(text)), dtype=np.int64))


def _prepared(path: str, sources: list[str]):
    index = {s: i for i, s in enumerate(sources)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "domain": [index.get(s, -1) for s in pdf["source"]], "half": pdf["half"],
                "tokens": [len(enc.encode_ordinary(t)) for t in pdf["text"]], "words": [_word_ids(t).astype(np.int32) for t in pdf["text"]],
            })

    return run


def word_tables(labelled: DataFrame, domains: int) -> np.ndarray:
    """For both halves, documents that hold a word by word bucket and domain, summed over all labelled documents; the last row counts them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, WORD_BUCKETS + 1, domains), dtype=np.int64)
        for pdf in batches:
            for h, d, words in zip(pdf["half"], pdf["domain"], pdf["words"]):
                counts[h, words, d] += 1
                counts[h, WORD_BUCKETS, d] += 1
        half, word, domain = counts.nonzero()
        yield pd.DataFrame({"half": half, "word": word, "domain": domain, "n": counts[half, word, domain]})

    found = labelled.select("half", "domain", "words").mapInPandas(run, "half int, word long, domain long, n long")
    rows = found.groupBy("half", "word", "domain").agg(F.sum("n").alias("n")).toPandas()  # at most 2 x buckets x domains rows
    table = np.zeros((2, WORD_BUCKETS + 1, domains))
    table[tuple(rows[c].to_numpy(dtype=np.int64) for c in ("half", "word", "domain"))] = rows["n"]
    return table


def classifier(table: np.ndarray, smoothing: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights by word and domain, and priors; a domain's rates lean towards those of all documents, so small domains aren't held for noisy ones."""
    docs = table[-1]
    overall = (table[:-1].sum(axis=1, keepdims=True) + 0.5) / (docs.sum() + 1.0)
    present = np.clip((table[:-1] + smoothing * overall) / (docs + smoothing), 1e-9, 0.999)
    prior = np.log((docs + 0.5) / (docs + 0.5).sum())
    return np.log(present) - np.log1p(-present), prior + np.log1p(-present).sum(axis=0)


def posterior(words: np.ndarray, weights: np.ndarray, prior: np.ndarray, temper: float) -> np.ndarray:
    """Probabilities of the domains; ``temper`` allows for words that depend on each other."""
    score = (weights[words].sum(axis=0) + prior) * temper
    p = np.exp(score - score.max())
    return p / p.sum()


class Mixture:
    """Chosen documents and reached shares for ``docs`` (doc_id, source, text) and ``targets`` (source, target_share, max_repeats)."""

    def __init__(self, docs: DataFrame, targets: DataFrame, *, tokenizer: str = TOKENIZER, total_tokens: float | None = None, steps: int = 30, trust: float = 0.995):
        wanted = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").orderBy("source").limit(MOST_TARGETS + 1).collect()
        if len(wanted) > MOST_TARGETS:
            raise ValueError(f"more than {MOST_TARGETS} targets")
        self.spark, self.trust = docs.sparkSession, trust
        self.sources = [r.source for r in wanted]
        self.share = np.array([r.target_share for r in wanted], dtype=float)
        self.caps = np.array([r.max_repeats for r in wanted], dtype=float)
        src = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("source")).alias("source"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"), "text"
        ).where((F.length("text") > 0) & F.lit(bool(self.sources)))
        made = src.mapInPandas(_prepared(tokenizer, self.sources), "doc_id long, domain int, half int, tokens long, words array<int>")
        self.documents = cut_lineage(self._membership(cut_lineage(made.where("tokens > 0"))))
        self.totals = self._totals()
        # What a source can give at most: its own documents at their caps; the traces of it in others follow their sources.
        own = F.array(*(F.when(F.col("best") == i, 1.0).otherwise(0.0) for i in range(len(self.sources)))) if self.sources else None
        allowed = self._sums(F.col("tokens") * F.col("cap"), own)
        self.total = total_tokens or (float(np.min(allowed[self.share > 0] / self.share[self.share > 0])) if len(allowed) else 0.0)
        self.residuals: list[float] = []
        self.history = self._fit(steps)

    def _membership(self, counted: DataFrame) -> DataFrame:
        """doc_id, tokens, p (membership by source), best (the label, or the likeliest source), cap."""
        n, caps, trust = len(self.sources), self.caps, self.trust
        tables = word_tables(counted.where("domain >= 0"), n)
        # Each half is judged by the words of the other; documents without a label by both.
        models = [tuple(x.astype(np.float32) for x in classifier(t)) for t in (tables[1], tables[0], tables[0] + tables[1])]

        def loss(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for h, d, words in zip(pdf["half"], pdf["domain"], pdf["words"]):
                    for k, temper in enumerate(TEMPERS):
                        p = posterior(words, *models[h], temper)
                        out.append((k, -math.log(max(float(p[d]), 1e-12)), int(p.argmax() == d)))
                yield pd.DataFrame(out, columns=["k", "loss", "right"])

        held = counted.where("domain >= 0").select("half", "domain", "words").mapInPandas(loss, "k int, loss double, right int")
        rows = {r.k: r for r in held.groupBy("k").agg(F.avg("loss").alias("loss"), F.avg("right").alias("right")).collect()}
        best = min(rows, key=lambda k: (round(rows[k].loss, 9), k)) if rows else 0
        temper = TEMPERS[best]
        self.held_out = (rows[best].right, rows[best].loss, temper) if rows else (0.0, 0.0, temper)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            evidence = np.full((n + 1, n), (1 - trust) / max(1, n - 1))
            evidence[range(n), range(n)] = trust
            evidence[n] = 1.0
            for pdf in batches:
                p = []
                for d, h, words in zip(pdf["domain"], pdf["half"], pdf["words"]):
                    x = posterior(words, *models[h if d >= 0 else 2], temper) * evidence[d]
                    x = np.round(x / x.sum(), 3)
                    p.append(x / x.sum())
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"], "tokens": pdf["tokens"], "p": p, "best": (best := [int(d if d >= 0 else x.argmax()) for d, x in zip(pdf["domain"], p)]), "cap": [float(caps[b]) for b in best],
                })

        return counted.mapInPandas(run, "doc_id long, tokens long, p array<double>, best int, cap double")

    def _sums(self, weight, of=None) -> np.ndarray:
        part = (lambda i: F.col("p")[i]) if of is None else (lambda i: F.col("p")[i] * of[i])
        cols = [F.sum(part(i) * weight).alias(f"s{i}") for i in range(len(self.sources))]
        row = self.atoms.agg(*cols).first() if cols else ()
        return np.array([x or 0.0 for x in row])

    def _totals(self) -> np.ndarray:
        self.atoms = cut_lineage(self.documents.groupBy("p", "cap", "best").agg(F.sum("tokens").alias("tokens")))
        return self._sums(F.col("tokens"))

    def rate(self, history):
        """A document's rate after the steps of ``history``, from its membership and cap."""
        r = F.lit(0.0)
        if not history:
            return r
        steps = F.array(*(F.array(*(F.lit(float(x)) for x in h)) for h in history))
        dot = lambda e: F.aggregate(F.zip_with("p", e, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return F.aggregate(steps, r, lambda v, e: F.least(F.col("cap"), F.greatest(F.lit(0.0), v - dot(e))))

    def _fit(self, steps: int, tolerance: float = 1e-5) -> list[np.ndarray]:
        target = self.share * self.total
        scale = np.where(self.totals > 0, self.totals, 1.0)
        history: list[np.ndarray] = []
        reached = np.zeros(len(self.sources))
        for _ in range(steps):
            self.residuals.append(float(np.abs(reached - target).max() / self.total) if self.total > 0 else 0.0)
            if self.residuals[-1] <= tolerance or len(self.residuals) > 3 and self.residuals[-1] > 0.97 * self.residuals[-2]:
                break
            history.append((reached - target) / scale)
            reached = self._sums(F.col("tokens") * self.rate(history))
        return history

    def chosen(self) -> DataFrame:
        """doc_id, source (the label, or the likeliest), tokens, repeats of the documents that are used."""
        best = F.col("best") + 1
        names = F.array(*(F.lit(s) for s in self.sources)) if self.sources else F.array(F.lit(""))
        size = dict(self.documents.groupBy(best.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        buckets = F.array(*(F.lit(1 + size.get(i + 1, 0) // ROWS_PER_BUCKET) for i in range(max(1, len(self.sources)))))
        rated = self.documents.select(
            "doc_id", "tokens", "p", "cap", best.alias("domain"), F.element_at(names, F.greatest(best, F.lit(1))).alias("source"),
            self.rate(self.history).alias("rate"), F.pmod(F.xxhash64("doc_id"), F.element_at(buckets, F.greatest(best, F.lit(1)))).alias("bucket"),
        ).where("rate > 0")
        within = W.partitionBy("domain", "bucket").orderBy("tokens", "doc_id").rowsBetween(W.unboundedPreceding, 0)
        sums = rated.groupBy("domain", "bucket").agg(F.sum("rate").alias("bucket_rate"))
        earlier = W.partitionBy("domain").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        offsets = sums.select("domain", "bucket", F.coalesce(F.sum("bucket_rate").over(earlier), F.lit(0.0)).alias("offset"))
        run = rated.withColumn("upto", F.sum("rate").over(within)).join(offsets, ["domain", "bucket"])
        end = F.floor(F.round(F.col("offset") + F.col("upto"), 6) + 0.5)
        begin = F.floor(F.round(F.col("offset") + F.col("upto") - F.col("rate"), 6) + 0.5)
        return run.select(
            "doc_id", "source", "tokens", F.least(end - begin, F.ceil(F.col("cap"))).cast("int").alias("repeats"), "p"
        ).where("repeats > 0")

    def shares(self) -> DataFrame:
        """source, target_share, actual_share (expected tokens), chosen_share (tokens of documents counted under their label or likeliest source), tokens, documents, most_repeats."""
        n = len(self.sources)
        used = self.chosen()
        each = used.select("tokens", "repeats", F.posexplode("p").alias("domain", "part")).where("part > 0")
        sums = each.groupBy("domain").agg(F.sum(F.col("part") * F.col("tokens") * F.col("repeats")).alias("tokens"))
        plain = used.groupBy("source").agg(
            F.sum(F.col("tokens") * F.col("repeats")).alias("chosen"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats")
        )
        total = F.greatest(F.sum("chosen").over(W.partitionBy()), F.lit(1))
        goal = self.spark.createDataFrame(
            [(i, self.sources[i], float(self.share[i])) for i in range(n)], "domain int, source string, target_share double"
        )
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        return goal.join(sums, "domain", "left").join(plain, "source", "left").select(  # a row per target: the window is as small
            "source", "target_share", F.round(F.coalesce(zero("tokens") / total, F.lit(0.0)), 6).alias("actual_share"),
            F.round(F.coalesce(zero("chosen") / total, F.lit(0.0)), 6).alias("chosen_share"), F.round(zero("tokens")).cast("long").alias("tokens"),
            zero("documents").alias("documents"), zero("most_repeats").alias("most_repeats"),
        )

    def quality(self) -> DataFrame:
        """measure, step, value: held-out accuracy and loss of the classifier, its temper, and the largest residual share before each step."""
        right, loss, temper = self.held_out
        rows = [("held-out accuracy", 0, float(right)), ("held-out loss", 0, float(loss)), ("temper", 0, float(temper))]
        rows += [("residual", i, x) for i, x in enumerate(self.residuals)]
        return self.spark.createDataFrame([(m, i, round(v, 9)) for m, i, v in rows], "measure string, step int, value double")
