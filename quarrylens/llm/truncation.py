"""Texts that lost their end: a corpus vocabulary trie, continuation counts and length evidence.

The whole corpus is counted once: its words (components of identifiers included) and, for every word in its place
(word before, marks between), how often a line, sentence or text ends behind it and with which marks. The vocabulary
becomes a prefix table, the trie laid out as rows: every proper prefix of a known word. It is joined with the last
word of every text.

Evidence is added to a score, and a text counts as cut from a threshold on, if

* it leaves a structure open (code fence, JSON object, back quote, string, bracket, block without a body),
* its last word is unknown elsewhere and a proper prefix of known words,
* its last word, in its place, occurs often enough elsewhere but (almost) never ends anything there, or
* its length is one at which its table and source cut (a spike in the histogram of lengths of distinct texts, in characters or
  bytes; all spikes of a source count) and its end isn't one that texts usually have.

Texts that end with a mark such as ``[truncated]`` count as cut; three dots alone are only looked through.

Every statistic covers all rows; counts are combined in the Python task before they are shuffled, so a source with a
third of all rows costs no more than others. Only rows of features (no text) take part in joins.

Edge cases: null, empty and blank texts are never cut; equal texts are judged alike; texts with no word are judged by
their structure only; a null source is a source of its own; extra columns are ignored; an empty table gives nothing.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.session import cut_lineage

_WORD = re.compile(r"(\w+(?:[./]\w+)*)")
_IDENT = re.compile(r"[_/.\d]|[a-z][A-Z]")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_a-zA-Z]+")
_SENTENCE_END = re.compile(r"^[`\"'*)\]}]*[.!?。…]+[`\"'*)\]}]*(?=\s|$)")
_MARK = re.compile(
    r"(?:\s|…|\.{3})*(?:-{2,}\s*truncated\s*-{2,}|[\[(<]\s*(?:output |text |log )?(?:truncated|clipped|cut(?: off)?|snip(?:ped)?)\s*[\])>]"
    r"|[\[(<]\s*\d+ (?:more )?(?:bytes|chars|characters|lines)(?: more| omitted| left| truncated)?\s*[\])>])\s*$",
    re.IGNORECASE,
)
_MARK_ENDS = ("]", ")", ">", "-")  # what a mark can end with
_DOTS = re.compile(r"(?:…|\.{3})\s*$")
_LIST_ITEM = re.compile(r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+(?=\S)(.*)$", re.MULTILINE)
_MIXED = re.compile(r"\d[^\W\d_]|[^\W\d_]\d")
_CLOSED = ")]}\"'`>|"
_SCAN = re.compile(r'"""|\'\'\'|\\.|["\'#()\[\]{}\n]', re.DOTALL)


def _shape(word: str) -> str:
    """Numbers are alike, and so are identifiers; paths also show their extension."""
    if word.isdigit():
        return "0"
    if not _IDENT.search(word):
        return word.lower()
    if "/" not in word:
        return "i"
    stem, dot, extension = word.rpartition(".")
    return f"/{extension[:4]}" if dot and "/" not in extension else "/"


def _parts(word: str) -> list[str]:
    """Words in a word; those of identifiers are marked, for short plain words are no evidence inside them."""
    if _MIXED.search(word):
        return []
    mark = "_" if _IDENT.search(word) else ""
    return [mark + p.lower() for p in _PART.findall(word)]


def _gap(text: str) -> str:
    """Marks between two words: no blanks, one line break at most, the last four marks."""
    if text == " ":
        return ""
    line = "\n" if "\n" in text or "\r" in text else ""
    return line + "".join(text.rsplit("\n", 1)[-1].split())[-4:]


def _marks(text: str) -> str:
    """Marks behind a word without blanks and without sentence marks, so a missing full stop makes no difference."""
    return "".join(c for c in text if not c.isspace() and c not in ".!?。…")[:6]


def _tail(text: str) -> tuple[str, bool]:
    """Marks behind a word up to the end of its line or sentence, and whether one ends there."""
    m = _SENTENCE_END.match(text)
    if m:
        return _marks(m.group()), True
    if not text or text == " ":
        return "", not text
    for k, c in enumerate(text):
        if c in "\r\n":
            return _marks(text[:k]), True
    return "", False


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _code(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _mixed(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit key of several columns of codes."""
    with np.errstate(over="ignore"):
        key = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            key = (key ^ c) * _MIX
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def open_structure(text: str, code: bool) -> str:
    """What a text leaves open at its end, or an empty string."""
    if text.count("```") % 2:
        return "fence"
    body = text.strip()
    if body[:1] == "{" and "\n" not in body:
        try:
            json.loads(body)
            return ""
        except ValueError:
            return "json"
    if not code:
        last = body.replace("```", "").rsplit("\n", 1)[-1]
        if last.count("`") % 2:
            return "backquote"
        if last.count('"') % 2:
            return "string"
        if any(last.count(a) > last.count(b) for a, b in ("()", "[]", "{}")):
            return "bracket"
        return ""
    depth, quote, comment = 0, "", -1
    for m in _SCAN.finditer(text):
        t = m.group()
        if comment >= 0:
            if t[-1] == "\n":
                comment = -1
        elif quote:
            if t == quote or t == "\n" and len(quote) == 1:
                quote = ""
        elif t == "#":
            comment = m.start()
        elif t in ('"', "'", '"""', "'''"):
            quote = t
        elif t in "([{":
            depth += 1
        elif t in ")]}":
            depth = max(0, depth - 1)
    if comment >= 0:
        return "backquote" if text.count("`", comment) % 2 else "bracket" if depth else ""
    if quote:
        return "string"
    if depth:
        return "bracket"
    return "block" if body.endswith(":") else ""


class _Kept(dict):
    """Results of a function by argument; forgotten when they get many."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key):
        if len(self) > 200_000:
            self.clear()
        self[key] = value = self.function(key)
        return value


def _tail_code(text: str) -> int:
    """Code of the marks behind a word; odd where something ends there."""
    marks, over = _tail(text)
    return _code(marks) & ~1 | over


# Kept for the life of a Python worker, which runs many tasks.
_SHAPES = _Kept(lambda word: _code(_shape(word)))
_GAPS = _Kept(lambda gap: _code(_gap(gap)))
_TAILS = _Kept(_tail_code)
_PARTS = _Kept(_parts)
_ITEM = _code("list item")


def _u64(values: list) -> np.ndarray:
    return np.array(values, dtype=np.uint64)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words and word places of whole texts, counted per batch.

    A text is split into words and what stands between them; both become codes, and the places of all words of the
    batch are mixed and counted as arrays.
    """
    def counted(keys: np.ndarray, column: str) -> pd.DataFrame:
        place, n = np.unique(keys, return_counts=True)
        frame = pd.DataFrame({"word": None, "place": place, "n": 0, "ends": 0, "final": 0})
        frame[column] = n
        return frame

    for pdf in batches:
        words: Counter = Counter()
        shape, before, gap, tail, tables, lengths = [], [], [], [], [], []
        finals, items = [], []
        for tbl, text in zip(pdf["tbl"], pdf["text"]):
            body = text.rstrip()
            split = _WORD.split(body)
            found, between = split[1::2], split[0::2]
            if not found:
                continue
            table = _code(tbl)
            mine = [_SHAPES[w] for w in found]
            mine_gap = [_GAPS[g] for g in between[:-1]]
            behind = [_TAILS[g] for g in between[1:-1]]
            closing = _code(_marks(between[-1])) & ~1
            finished = "\n" in text[len(body) :]
            if finished:
                behind.append(closing | 1)
                words.update(found)
            else:  # the very end of a text proves nothing about lines and words
                finals.append((table, mine[-2] if len(mine) > 1 else 0, mine_gap[-1], mine[-1], closing))
                words.update(found if between[-1] else found[:-1])
                mine.pop()
                mine_gap.pop()
            if mine:
                shape += mine
                before.append(0)
                before += mine[:-1]
                gap += mine_gap
                tail += behind
                tables.append(table)
                lengths.append(len(mine))
            if "\n- " in body or "\n* " in body:
                for item in _LIST_ITEM.findall(body if finished else body.rpartition("\n")[0]):
                    n = len(_WORD.findall(item))
                    items += [(table, k, k == n) for k in range(1, n + 1)]
        vocabulary: Counter = Counter()
        for word, n in words.items():
            for part in _PARTS[word]:
                vocabulary[part] += n
        yield pd.DataFrame({"word": list(vocabulary), "place": 0, "n": list(vocabulary.values()), "ends": 0, "final": 0})
        t, b, g, s, e = np.repeat(_u64(tables), lengths), _u64(before), _u64(gap), _u64(shape), _u64(tail)
        ended = (e & np.uint64(1)).astype(bool)
        e = e & ~np.uint64(1)
        place, near = _mixed(t, b, g, s), _mixed(t, g, s)
        yield counted(place, "n")
        yield counted(near, "n")
        yield counted(_mixed(place.view(np.uint64), e)[ended], "ends")
        yield counted(_mixed(near.view(np.uint64), e)[ended], "ends")
        if finals:
            t, b, g, s, e = (_u64(list(c)) for c in zip(*finals))
            yield counted(_mixed(_mixed(t, b, g, s).view(np.uint64), e), "final")
        if items:
            t, k, o = zip(*items)
            place = _mixed(_u64(list(t)), np.full(len(t), _ITEM, dtype=np.uint64), _u64(list(k)))
            yield counted(place, "n")
            done = place[np.array(o)]
            yield counted(_mixed(done.view(np.uint64), np.full(len(done), _code("") & ~1, dtype=np.uint64)), "ends")


def _last_words(body: str) -> list[str]:
    """The last words of a text with what stands between them, from as far back as two whole words need."""
    reach = 300
    while True:
        begin = max(0, len(body) - reach)
        begin = body.find(" ", begin) if begin else 0
        split = _WORD.split(body[max(begin, 0) :]) if begin >= 0 else []
        if begin == 0 or len(split) >= 5:
            return split
        reach = reach * 4 if reach < len(body) else len(body)
        if reach >= len(body):
            return _WORD.split(body)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _FEATURES.split(", ")][:-4]
    for pdf in batches:
        rows, codes, items = [], [], []
        for tbl, row, source, text, code in zip(pdf["tbl"], pdf["row_id"], pdf["source"], pdf["text"], pdf["code"]):
            body = text.rstrip()
            newline = "\n" in text[len(body) :]
            part, closed, sentence, number, keys = "", False, False, 0, (0, 0, 0, 0, 0)
            split = _last_words(body)
            dots = bool(_DOTS.search(body[-4:]))
            if len(split) > 1:
                word, behind = split[-2], split[-1]
                tail = _marks(behind)
                before = _code(_shape(split[-4])) if len(split) > 3 else 0
                keys = (_code(tbl), before, _code(_gap(split[-3])), _code(_shape(word)), _code(tail) & ~1)
                item = _LIST_ITEM.match(body, body.rfind("\n") + 1)
                if item and not tail:
                    number = len(_WORD.findall(item.group(1)))
                closed = bool(tail) and tail[-1] in _CLOSED
                sentence = bool(_SENTENCE_END.match(behind)) and not dots and not word[-1].isdigit()
                if not tail:
                    found = _parts(word)
                    if found and word.lower().endswith(found[-1].lstrip("_")):
                        part = found[-1]
            codes.append(keys)
            items.append(number)
            rows.append((
                tbl, row, source, len(text), len(text) if text.isascii() else len(text.encode("utf-8", "replace")),
                body[-1:] in _MARK_ENDS and bool(_MARK.search(body)), open_structure(_DOTS.sub("", body) if dots else body, code), newline,
                sentence, closed, part, xxhash.xxh3_64_intdigest(text) - (1 << 63),
            ))
        out = pd.DataFrame(rows, columns=columns)
        if rows:
            t, b, g, s, e = (_u64(list(c)) for c in zip(*codes))
            number = _u64(items)
            listed = _mixed(t, np.full(len(t), _ITEM, dtype=np.uint64), number)
            place, near = (np.where(number > 0, listed, x) for x in (_mixed(t, b, g, s), _mixed(t, g, s)))
            out["place"], out["near"] = place, near
            out["place_end"], out["near_end"] = _mixed(place.view(np.uint64), e), _mixed(near.view(np.uint64), e)
        else:
            out[["place", "near", "place_end", "near_end"]] = 0
        yield out[[c.split()[0] for c in _FEATURES.split(", ")]]


_FEATURES = (
    "tbl string, row_id long, source string, chars int, bytes int, mark boolean, open string, newline boolean, "
    "sentence boolean, closed boolean, part string, hash long, place long, place_end long, near long, near_end long"
)


_NO_SOURCE = "\0"  # stands for null in joins on the source


def _by_source(column: str = "source"):
    return F.coalesce(F.col(column), F.lit(_NO_SOURCE))


def length_limits(rows: DataFrame, least: int = 40, spike: float = 8.0) -> DataFrame:
    """tbl, by, unit, len: all lengths that far more distinct texts of a source have than its other lengths do."""
    units = F.map_from_arrays(F.array(F.lit("chars"), F.lit("bytes")), F.array("chars", "bytes"))
    once = rows.select("tbl", _by_source().alias("by"), "chars", "bytes", "hash").distinct()
    each = (
        once.select("tbl", "by", F.explode(units).alias("unit", "len"))
        .groupBy("tbl", "by", "unit", "len").agg(F.count(F.lit(1)).alias("n"))
    )
    usual = each.groupBy("tbl", "by", "unit").agg(F.avg("n").alias("usual"))
    return each.join(usual, ["tbl", "by", "unit"]).where(
        (F.col("len") > least) & (F.col("n") >= F.greatest(F.lit(5.0), F.col("usual") * spike))
    ).select("tbl", "by", "unit", "len")


def judge(values: DataFrame, *, rare: int = 5, known: int = 2, never: float = 0.01, seldom: float = 0.5,
          usual_share: float = 0.003, enough: float = 2.0) -> DataFrame:
    """tbl, row_id, source, cut, why, score and its parts for ``values`` (tbl, row_id, source, text, code)."""
    texts = values.where(F.length(F.trim("text")) > 0).select(
        "tbl", F.col("row_id").cast("long").alias("row_id"), "source", "text", "code"
    )
    counted = cut_lineage(
        texts.select("tbl", "text").mapInPandas(_counts, "word string, place long, n long, ends long, final long")
        .groupBy("word", "place").agg(*(F.sum(c).alias(c) for c in ("n", "ends", "final")))
    )
    rows = cut_lineage(texts.mapInPandas(_features, _FEATURES))
    vocabulary = counted.where(F.col("word").isNotNull() & (F.col("n") >= known)).select("word", "n")
    trie = vocabulary.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word") - 1)), lambda k: F.substring("word", F.lit(1), k))).alias("part"),
        "word",
    ).where("part <> word and part <> '_'").groupBy("part").agg(F.count(F.lit(1)).alias("longer"))
    # Only what some text ends with goes on; everything else is dropped by semi joins.
    places = counted.where(F.col("word").isNull())
    totals = rows.groupBy("tbl").agg(F.count(F.lit(1)).alias("texts"))
    out = rows.withColumn("by", _by_source()).join(totals, "tbl")
    limits = cut_lineage(length_limits(rows))
    for unit in ("chars", "bytes"):
        of = limits.where(F.col("unit") == unit).select("tbl", "by", F.col("len").alias(unit), F.lit(True).alias(f"limit_{unit}"))
        out = out.join(of, ["tbl", "by", unit], "left")
    for key, name in (("place", "n2"), ("near", "n1")):
        out = out.join(places.select(F.col("place").alias(key), F.col("n").alias(name)), key, "left")
    out = out.join(places.select(F.col("place").alias("place_end"), F.col("ends").alias("e2"), "final"), "place_end", "left")
    out = out.join(places.select(F.col("place").alias("near_end"), F.col("ends").alias("e1")), "near_end", "left")
    out = out.join(vocabulary.select(F.col("word").alias("part"), F.col("n").alias("word_n")), "part", "left")
    out = out.join(trie, "part", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = (
        F.when(zero("n2") >= rare, zero("e2") / F.col("n2")).when(zero("n1") >= rare, zero("e1") / F.col("n1"))
    )
    share = F.when(share > 1, 1.0).otherwise(share)
    usual = zero("final") >= F.greatest(F.lit(float(rare)), F.col("texts") * usual_share)
    at_limit = F.coalesce("limit_chars", "limit_bytes", F.lit(False))
    unknown = (F.col("part") != "") & (zero("longer") > 0) & F.col("word_n").isNull()
    misplaced = (F.length("part").between(1, 3)) & (zero("longer") >= 3) & (zero("n2") < rare)
    # Evidence adds up; a text is cut from ``enough`` on. An end that texts usually have speaks against all but structure and marks.
    complete = F.col("sentence") | F.col("newline") | usual
    rarely_ends = F.coalesce((share < never) & ~F.col("closed"), F.lit(False))
    unsure = F.coalesce((share < seldom), F.lit(True)) & ~F.col("closed")
    parts = {
        "mark": F.when(F.col("mark"), 5.0), "structure": F.when(F.col("open") != "", 4.0),
        "trie": F.when(~complete & unknown, 3.0).when(~complete & misplaced, 2.5), "place": F.when(~complete & rarely_ends, 3.0),
        "length": F.when(~complete & at_limit & unsure, 2.0).when(~complete & at_limit, 1.0),
    }
    scored = out.select(
        "tbl", "row_id", "source", *(F.coalesce(e, F.lit(0.0)).alias(k) for k, e in parts.items()), share.alias("share"), at_limit.alias("at_limit"),
        F.when(F.col("open") != "", F.col("open")).alias("open"), (unknown & ~complete).alias("unknown"),
    )
    total = sum((F.col(k) for k in parts), F.lit(0.0))
    why = (
        F.when(F.col("mark") > 0, "mark").when(F.col("structure") > 0, F.col("open")).when(F.col("unknown"), "fragment").when(F.col("trie") > 0, "misplaced")
        .when(F.col("place") > 0, "continues").otherwise("limit")
    )
    return scored.withColumn("score", total).withColumn("cut", total >= enough).select(
        "tbl", "row_id", "source", F.when(F.col("cut"), why).alias("why"), "share", "at_limit", *parts, "score", "cut"
    )


def evidence(judged: DataFrame) -> DataFrame:
    """Per table and strongest sign: cut rows, and how many of them the trie, the place of the last word and the length speak for."""
    return judged.where("cut").groupBy("tbl", "why").agg(
        F.count(F.lit(1)).alias("cut_rows"), F.count_if(F.col("trie") > 0).alias("by_trie"), F.count_if(F.col("place") > 0).alias("by_place"),
        F.count_if(F.col("length") > 0).alias("by_length"), F.count_if((F.col("trie") > 0) & (F.col("length") > 0)).alias("by_trie_and_length"),
        F.round(F.avg("score"), 4).alias("mean_score"),
    )


def cut_shares(values: DataFrame, judged: DataFrame) -> DataFrame:
    """Per table and source: rows, rows with text, cut rows and their share of those."""
    base = values.withColumn("by", _by_source()).groupBy("tbl", "by").agg(
        F.first("source").alias("source"), F.count(F.lit(1)).alias("rows"),
        F.count_if(F.length(F.trim("text")) > 0).alias("texts"),
    )
    cut = judged.where("cut").groupBy("tbl", _by_source().alias("by")).agg(F.count(F.lit(1)).alias("cut_rows"))
    return base.join(cut, ["tbl", "by"], "left").select(
        "tbl", "source", "rows", "texts", F.coalesce("cut_rows", F.lit(0)).alias("cut_rows"),
        F.round(F.coalesce(F.col("cut_rows") / F.nullif(F.col("texts"), F.lit(0)), F.lit(0.0)), 6).alias("cut_share"),
    )
