"""Files nobody wrote by hand in their repository: generated, compacted, copied in, or data saved as code.

Three sources of evidence, each over all rows of a file:

* its path and its comments (directories of third-party code, suffixes of generators; comments are judged by the sum of cues such as
  "generated", "do not edit", "vendored", "upstream", a version, a licence, over every line of every row);
* token composition: rows made of lines of one shape that only count up, rows without blanks and with short names, rows
  that are literals; a file counts if such rows hold most of its characters;
* an inverted index of line hashes: a line weighs log(files / files that hold it). Files whose weight lies mostly in lines
  that other repositories have too are looked up by their rarest such lines, enough of them that a file holding the
  wanted share must hold one (prefix filter), and the containment in each file found is computed exactly.

Scale: Python reads every row once and gives a row of counts and line hashes, kept in the shared checkpoint folder. Line
statistics are combined before the shuffle. Lines that more than ``long_list`` files hold are first joined only with two files of
different repositories that hold them (those with the smallest and the largest repository hash), which settles a library copied ten
thousand times at two rows a line. Only files that this leaves open meet all holders of those lines, in salted parts, so no
link is lost.

Edge cases: rows without a path are left out; null or empty code adds nothing; a null repo is a repo of its own; rows loaded
twice count once in the index; files of a few short lines are never judged by the index; extra columns are ignored; empty
tables give nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.session import cut_lineage

# Directories and endings that say by themselves where a file comes from.
COPIED_PATH = re.compile(
    r"(?i)(?:^|/)(?:_?vendor|vendored|third[_-]?party|3rdparty|externals?|extern|node_modules|bower_components|deps|site-packages|jspm_packages)/"
)
MADE_PATH = re.compile(
    r"(?i)(?:^|/)(?:generated|__generated__|autogen|auto_generated|gen-src|generated-src|generated_src)/"
    r"|(?:[._-]generated|\.gen|\.g|_pb2(?:_grpc)?|\.pb|_pb|\.designer|\.auto|_gen)\.(?:py|js|jsx|ts|tsx|go|java|cs|rb)$|(?:^|/)zz_generated"
)
COMPACT_PATH = re.compile(r"(?i)[.-]min\.(?:js|mjs|css|ts)$|\.(?:bundle|chunk|packed|umd)\.(?:js|mjs|ts)$")
# Cues of comments and what each adds: a comment counts by the sum over its cues, not by a wording.
MADE_CUES = [
    (3.0, r"@generated\b"),
    (1.0, r"\b(?:auto-?)?generated\b|\bproduced\b|\bcreated\b|\bemitted\b|\btranspiled\b|\berzeugt|\bgeneriert|\berstellt|생성|\bgenerad[oa]|\bgénéré|生成"),
    (1.0, r"\bauto-?generated\b|\bautomatic|\bautomatisch|자동|\bautomátic|\bautomatiquement|自动"),
    (1.0, r"\bdo not (?:edit|modify|change|touch)\b|\bdon't edit\b|\bnicht (?:bearbeiten|ändern)\b|수정하지|\bno editar\b"),
    (1.0, r"\b(?:changes|edits|änderungen|cambios)\b.{0,30}\b(?:lost|overwritten|verloren|perder)"),
    (1.0, r"\bregenerate|\bre-?run\b|\bneu erzeugen\b"),
    (1.5, r"\binstead of editing\b"),
    (0.5, r"\boutput\b"),
    (0.5, r"\b(?:by|from|with|using|von|aus|mit|por)\s+\S+|도구"),
    (0.5, r"\b(?:code|file|module|source|datei|archivo)\b|파일"),
    (0.5, r"^\W*(?:auto|generated|produced|erzeugt|generiert|자동)"),
]
COPIED_CUES = [
    (2.0, r"\bvendored\b|\bbundled\b|\bthird[- ]party\b|\b3rd[- ]party\b"),
    (1.0, r"\b(?:taken|copied|imported|ported|borrowed|adapted|lifted|mirrored) (?:\w+ )?(?:from|into|of)\b|\bübernommen|\bkopiert|가져온|복사|\bcopiad[oa]|\btomad[oa]"),
    (1.0, r"\bupstream\b"),
    (1.0, r"\bverbatim\b|\bunchanged\b|\bunmodified\b|\bunverändert|그대로|\bsin cambios\b"),
    (1.0, r"\(c\)|\bcopyright\b|\bauthors\b|\blicen[sc]e"),
    (0.5, r"[\w-]+[ @]v?\d+(?:\.\d+)+|\b(?:release|version) v?\d"),
    (0.5, r"\b(?:project|library|package|repository|projekt|proyecto|biblioteca)\b|프로젝트"),
]
MADE_ENOUGH, COPIED_ENOUGH = 3.0, 2.0
_MADE = [(w, re.compile(x, re.IGNORECASE)) for w, x in MADE_CUES]
_COPIED = [(w, re.compile(x, re.IGNORECASE)) for w, x in COPIED_CUES]
# One of these must stand in a comment that can reach the sum.
_MADE_HINT = re.compile(r"(?i)generat|génér|generad|produced|created|emitted|transpiled|erzeug|generier|erstellt|생성|生成|do(?:n't| not) |regenerate")
_COPIED_HINT = re.compile(r"(?i)vendored|bundled|third|3rd|from|into|übernommen|kopiert|가져온|복사|copiad|tomad|upstream|verbatim|unchanged|unmodified|unveränder|그대로|sin cambios")
_COMMENT_LINE = re.compile(r"^[ \t]*(?:#|//|/\*|\*|<!--|--|\"\"\"|''')(.*)$", re.MULTILINE)
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|<!--|--|\"\"\"|''')")
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`')
_COUNTER = re.compile(r"[A-Za-z_]*\d+")
_KEYWORD = re.compile(r"\b(?:def|function|func|class|return|if|for|while|import|raise|throw|await|try)\b")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")


def composition(code: str) -> tuple[str, int]:
    """What a piece of code consists of (counted, compact, data or an empty string) and its characters without comments."""
    lines = [x for x in (y.strip() for y in code.splitlines()) if x and not _COMMENT.match(x)]
    if not lines:
        return "", 0
    chars = sum(map(len, lines))
    if len(lines) >= 8:
        # Only the lines' openings and digits matter here, so a sample of shapes is not enough: every line is shaped.
        shapes = Counter(_COUNTER.sub("#", x if "'" not in x and '"' not in x else _STRING.sub("S", x)) for x in lines)
        common = shapes.most_common(3)
        counting = [(s, n) for s, n in common if "#" in s and n >= 4]
        if sum(n for _, n in counting) >= 0.75 * len(lines):
            return "counted", chars
    if chars < 120:
        return "", chars
    body = "\n".join(lines)
    bare = _STRING.sub("S", body) if "'" in body or '"' in body else body
    literal = 1 - len(re.sub(r"[-\d.,\s\[\]{}():;xXS]+", "", bare)) / max(1, len(body))
    if literal >= 0.75 and not _KEYWORD.search(bare):
        return "data", chars
    longest = max(map(len, lines))
    if longest >= 160:
        compact = max(bare.split("\n"), key=len)
        if len(compact) >= 120:
            blanks = compact.count(" ") / len(compact)
            names = _NAME.findall(compact)
            short = sum(len(n) <= 2 for n in names) / max(1, len(names))
            if blanks < 0.06 and short > 0.4 or blanks < 0.025:
                return "compact", chars
    return "", chars


def line_hashes(code: str, least: int) -> list[int]:
    """Hashes of the distinct lines that say something: letters, at least ``least`` characters, no comments."""
    digest = xxhash.xxh3_64_intdigest
    kept = {x for x in map(str.strip, code.splitlines()) if len(x) >= least}
    return [digest(x) - (1 << 63) for x in kept]


def marks(code: str) -> tuple[bool, bool]:
    """Whether a comment says that a tool made the file, and whether one says that it was copied in."""
    made = copied = False
    for comment in _COMMENT_LINE.findall(code):
        if not made and _MADE_HINT.search(comment):
            made = sum(w for w, cue in _MADE if cue.search(comment)) >= MADE_ENOUGH
        if not copied and _COPIED_HINT.search(comment):
            copied = sum(w for w, cue in _COPIED if cue.search(comment)) >= COPIED_ENOUGH
    return made, copied


def _rows(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, repo, path, code in zip(pdf["file_id"], pdf["repo_id"], pdf["file_path"], pdf["code"]):
                code = code or ""
                what, chars = composition(code)
                made, copied = marks(code)
                out.append((
                    file, repo, bool(MADE_PATH.search(path)) or made, bool(COPIED_PATH.search(path)) or copied,
                    bool(COMPACT_PATH.search(path)), chars, chars if what else 0, line_hashes(code, least),
                ))
            yield pd.DataFrame(out, columns=["file_id", "repo_id", "made", "copied", "compact", "chars", "odd_chars", "lines"])

    return run


_ROWS = (
    "file_id long, repo_id long, made boolean, copied boolean, compact boolean, chars long, odd_chars long, "
    "lines array<long>"
)


def contained_files(rows: DataFrame, *, share: float = 0.6, least_lines: int = 5, long_list: int = 64) -> DataFrame:
    """file_id of files whose line weight lies to ``share`` in one file of another repository."""
    # The lines of a file are made distinct where its rows meet, with their number beside them; one more exchange, on the line, serves the
    # lists and their join back, and only lines that several repositories have go on.
    files = rows.groupBy("file_id", "repo_id").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))
    lines = files.select("file_id", "repo_id", F.size("lines").alias("n_lines"), F.explode("lines").alias("line")).repartition("line")
    total = float(max(2, rows.select("file_id").distinct().count()))
    lists = lines.groupBy("line").agg(
        F.count(F.lit(1)).alias("files"), F.min(F.struct("repo_id", "file_id")).alias("low"),
        F.max(F.struct("repo_id", "file_id")).alias("high"),
    ).where("low.repo_id <> high.repo_id")
    weight = F.log(F.lit(total) / F.col("files")) + 0.01
    far = cut_lineage(lines.join(lists, "line").select("file_id", "repo_id", "n_lines", "line", "files", "low", "high", weight.alias("weight")))
    # A line that only one repository has weighs as if one file had it.
    sums = far.groupBy("file_id").agg(
        F.sum("weight").alias("far_weight"), F.count(F.lit(1)).alias("far_lines"), F.first("n_lines").alias("n_lines")
    ).withColumn("all_weight", F.col("far_weight") + (F.col("n_lines") - F.col("far_lines")) * (F.log(F.lit(total)) + 0.01))
    screened = sums.where((F.col("far_lines") >= least_lines) & (F.col("far_weight") >= F.col("all_weight") * share))
    mine = cut_lineage(far.drop("n_lines").join(screened.select("file_id", "far_weight", "all_weight"), "file_id"))
    order = W.partitionBy("file_id").orderBy("files", "line").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("weight").over(order), F.lit(0.0)) + F.col("all_weight") - F.col("far_weight")
    prefix = cut_lineage(
        mine.withColumn("before", before).where(F.col("before") <= F.col("all_weight") * (1 - share) + 1e-9).drop("weight", "before", "far_weight", "all_weight")
    )
    other = far.select(F.col("file_id").alias("other"), F.col("repo_id").alias("other_repo"), "line", "files")

    def holding(candidates: DataFrame) -> DataFrame:
        """file_id of those that a candidate contains to ``share``, compared line by line."""
        common = (
            mine.select("file_id", "line", "weight", "all_weight").join(candidates, "file_id")
            .join(other.select("other", "line"), ["other", "line"])
            .groupBy("file_id", "other").agg(F.sum("weight").alias("common"), F.first("all_weight").alias("all_weight"), F.count(F.lit(1)).alias("n"))
        )
        return common.where((F.col("common") >= F.col("all_weight") * share) & (F.col("n") >= least_lines)).select("file_id").distinct()

    short = F.col("files") <= long_list
    near = prefix.where(short).join(other.where(short).drop("files"), "line").where("repo_id <> other_repo").select("file_id", "other")
    hubs = prefix.where(~short).select(
        "file_id", "repo_id", F.explode(F.array("low", "high")).alias("hub")
    ).where("repo_id <> hub.repo_id").select("file_id", F.col("hub.file_id").alias("other"))
    first = cut_lineage(holding(near.unionByName(hubs).distinct()))
    # What two holders of its long lists don't settle meets all holders, in parts of about ``long_list`` of them.
    open_ = prefix.where(~short).join(first, "file_id", "left_anti")
    parts = F.ceil(F.col("files") / long_list).cast("int")
    left = open_.select("file_id", "repo_id", "line", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = other.where(~short).select("other", "other_repo", "line", F.pmod(F.xxhash64("other"), parts).cast("int").alias("part"))
    rest = left.join(right, ["line", "part"]).where("repo_id <> other_repo").select("file_id", "other").distinct()
    return first.unionByName(holding(rest))


def judge_files(sources: DataFrame, *, odd_share: float = 0.8, share: float = 0.6, least_line: int = 16) -> DataFrame:
    """tbl, repo, file_path and why of files not written by hand, for ``sources`` (tbl, repo, file_path, code)."""
    src = sources.where(F.col("file_path").isNotNull()).select(
        "tbl", "repo", "file_path", "code", F.xxhash64("tbl", F.coalesce("repo", F.lit("\0")), "file_path").alias("file_id"),
        F.xxhash64(F.coalesce("repo", F.lit("\0"))).alias("repo_id"),
    )
    rows = cut_lineage(src.select("file_id", "repo_id", "file_path", "code").mapInPandas(_rows(least_line), _ROWS))
    files = rows.groupBy("file_id").agg(
        F.max("made").alias("made"), F.max("copied").alias("copied"), F.max("compact").alias("compact"),
        F.sum("chars").alias("chars"), F.sum("odd_chars").alias("odd_chars"),
    )
    inside = contained_files(rows, share=share).withColumn("contained", F.lit(True))
    why = (
        F.when(F.col("copied"), "copied").when(F.col("made"), "made").when(F.col("compact"), "compact")
        .when((F.col("chars") > 0) & (F.col("odd_chars") >= F.col("chars") * odd_share), "composition")
        .when(F.col("contained"), "contained")
    )
    judged = files.join(inside, "file_id", "left").select("file_id", why.alias("why")).where("why is not null")
    names = src.select("file_id", "tbl", "repo", "file_path").distinct()
    return names.join(judged, "file_id").select("tbl", "repo", "file_path", "why")
