"""Abusive, hateful and sexual language: a fuzzy lexicon, and scores of the context of its hits.

Texts are unmasked first: compatibility forms, look-alike letters, digits and signs for letters, invisible characters,
dots between letters, stretched letters, wrongly decoded UTF-8, remnants of markup. Every word then runs through a Levenshtein
automaton intersected with a trie of the lexicon, made deterministic as words come (one edit or swap from five letters on, two
from nine; a star stands for any letter). Words of the vocabulary of public tokenizers are ordinary words and never taken for
misspelt terms, so no count of the corpus decides and scores don't depend on its size.

A term alone decides nothing. Terms belong to categories (insults, harm, sexual terms; whom they meet: someone addressed, a group,
the speaker; what surrounds them: wishes, things, words about words). The meetings of categories in a window around a hit are
features, and a logistic score weighs them. Their weights start from ``lexicon.PRIOR`` and are fitted to a bounded sample
of the labelled documents (``LABELLED_DOCUMENTS``, by hash of the id) by maximum a posteriori; the best sentence speaks for its document.
The score of a document is that of its worst sentence, in [0, 1]. Hits inside quotation marks or quoted lines count, as quoted abuse
is abuse, but are told apart: ``quoted_score`` and ``direct_score``. A single quoted word or one beside words about words is a mention.

Scale: one narrow map over the documents; every text is read whole; nothing is collected but the bounded sample of labels.
Results for words are remembered per Python worker; forgetting them changes no score. Rates per source are pre-aggregated.

Edge cases: null and empty texts score 0; repeated documents score alike; a null source is a source of its own; sources
that differ in case or blanks only are one; extra columns are ignored; empty tables give nothing; without labels the prior holds.
"""

from __future__ import annotations

import base64
import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm import lexicon as terms

THRESHOLD = 0.5
LABELLED_DOCUMENTS = 4000
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
WINDOW, NEAR = 8, 3

_FOLD = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t",
        "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n", "ⅼ": "l", "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
        "ν": "v", "κ": "k", "ı": "i", "А": "a", "В": "b", "С": "c", "Е": "e", "Н": "h", "І": "i", "К": "k", "М": "m", "О": "o", "Р": "p",
        "Т": "t", "У": "y", "Х": "x",
    }
)
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
_INVISIBLE = re.compile("[­᠎​-‏‪-‮⁠-⁤﻿︀-️]|[̀-ͯ](?=[̀-ͯ])")
_SPLIT = re.compile(r"(?<=[.!?…。])\s+|\s+(?=#|//)")
_SPEAKER = re.compile(r"^\s*(?:>+\s*)?(?:\[\d{1,2}:\d{2}\]\s*)?[\w.-]{2,24}:\s+(?=\S)")
_SPACED = re.compile(r"(?<![^\W_])(?:(?:[^\W\d_][.\-_·*]){2,}|(?:[^\W\d_] ){3,})[^\W\d_](?![^\W_])")
_SPACED_HINT = re.compile(r"\b[^\W\d_][.\-_·* ][^\W\d_][.\-_·* ]")
_DISGUISE = re.compile(r"[0-9@$!|€'’*]")
_WORD = re.compile(r"[^\W_]+(?:[*@$!|€'’]+[^\W_]+)*[*]*|[*]*[^\W_]+", re.UNICODE)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,80}>")
_CODE_SPAN = re.compile(r"`[^`\n]*`")
_WRONG = re.compile("[Â-ôŒ-Ÿ–-›€™ƒ][\u0080-¿Œ-Ÿƒˆ˜–-›€™]")


def _repaired(line: str) -> str:
    """UTF-8 that was read as a one-byte code page, read again."""
    for page in ("cp1252", "latin-1"):
        try:
            return line.encode(page).decode("utf-8")
        except UnicodeError:
            continue
    mixed = bytearray()
    for c in line:
        try:
            mixed += c.encode("cp1252")
        except UnicodeError:
            if ord(c) > 255:
                return line
            mixed.append(ord(c))
    return mixed.decode("utf-8", "ignore")


def unmask(text: str) -> str:
    text = html.unescape(text) if "&" in text else text
    if "<" in text:
        text = _TAG.sub(" ", text)
    if _WRONG.search(text):
        text = "\n".join(_repaired(x) if _WRONG.search(x) else x for x in text.split("\n"))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return text



# --- automaton --------------------------------------------------------------------------------------------------------


class Automaton:
    """Levenshtein automaton of at most ``most`` edits (swaps count once) intersected with a trie, determinised lazily.

    A state is the set of (trie node, edits, letter owed by a swap); its transitions are kept, so a word costs one lookup a
    letter and dies as soon as no term is near.
    """

    def __init__(self, entries: dict[str, frozenset[str]], most: int):
        self.most = most
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for word in sorted(entries):
            node = 0
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][c]
            self.ends[node] = word
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, configs) -> int:
        best: dict[tuple[int, str], int] = {}
        todo = list(configs)
        while todo:  # letters of the term that the word lacks
            node, edits, owed = todo.pop()
            if edits >= best.get((node, owed), self.most + 1):
                continue
            best[node, owed] = edits
            if not owed and edits < self.most:
                todo += [(child, edits + 1, "") for child in self.children[node].values()]
        key = frozenset((n, e, o) for (n, o), e in best.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.steps.append({})
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        known = self.steps[state].get(c)
        if known is None:
            out = set()
            for node, edits, owed in self.members[state]:
                if owed:
                    if c == owed:
                        out.add((node, edits, ""))
                    continue
                below = self.children[node]
                for letter, child in below.items():
                    if letter == c or c == "*":
                        out.add((child, edits, ""))
                    elif edits < self.most:
                        out.add((child, edits + 1, ""))
                        if c in self.children[child]:
                            out.add((self.children[child][c], edits + 1, letter))
                if edits < self.most:
                    out.add((node, edits + 1, ""))
            known = self.steps[state][c] = self._state(out)
        return known

    def dead(self, state: int) -> bool:
        return not self.members[state]

    def found(self, state: int) -> dict[str, int]:
        return {self.ends[n]: e for n, e, owed in self.members[state] if not owed and self.ends[n] is not None}

    def near(self, word: str) -> dict[str, int]:
        """Terms within the edits allowed, with their edits."""
        state = self.start
        for c in word:
            state = self.step(state, c)
            if not self.members[state]:
                return {}
        return self.found(state)


def plain(word: str) -> str:
    """Without accents."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def collapsed(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


def ordinary_words(paths) -> frozenset[str]:
    """Words of public vocabularies: what these hold as one piece behind a blank."""
    words = set()
    for path in paths:
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    piece = base64.b64decode(line.split()[0]).decode("utf-8", "ignore")
                    if piece[:1] == " " and piece[1:].isalpha():
                        words.add(piece[1:].lower())
    return frozenset(words)


class Lexicon:
    """Categories of words, with the weights of their meetings."""

    def __init__(self, ordinary=frozenset(), weights: np.ndarray | None = None):
        self.ordinary = ordinary
        exact: dict[str, set[str]] = {}
        self.first: dict[str, list[tuple[str, list[str]]]] = {}

        def enter(word: str, category: str | None):
            for form in {word, plain(word)}:
                exact.setdefault(form, set()).update([category] if category else [])

        for category, words in terms.TERMS.items():
            for word in words.split():
                enter(word, category)
                if category == "INSULT" and word.isascii():
                    enter(word + "s", category)
        self.parts = frozenset(plain(w) for group in terms.PHRASES.values() for p in group for w in p.split())
        self.hangul_parts = sorted({w for group in terms.HANGUL_PHRASES.values() for p in group for w in p.split()})
        for category, group in terms.HANGUL_PHRASES.items():
            for p in group:
                first, *rest = p.split()
                self.first.setdefault(first, []).append((category, rest))
        for category, group in terms.PHRASES.items():
            for p in group:
                for word in p.split():
                    enter(word, None)
                first, *rest = (plain(w) for w in p.split())
                self.first.setdefault(first, []).append((category, rest))
        self.exact = {w: frozenset(c) for w, c in exact.items()}
        self.collapsed: dict[str, set[str]] = {}
        for w in self.exact:
            if len(collapsed(w)) >= (3 if collapsed(w) == w else 5):
                self.collapsed.setdefault(collapsed(w), set()).add(w)
        # Only terms that can be a core are looked up with edits; a misspelt context word changes little.
        cores = {w: c for w, c in self.exact.items() if c & set(terms.CORES) or c & {"ADDRESS"} and len(w) > 4}
        self.one = Automaton({w: c for w, c in cores.items() if len(w) >= 5}, 1)
        self.two = Automaton({w: c for w, c in cores.items() if len(w) >= 9}, 2)
        self.any = Automaton({w: c for w, c in self.exact.items()}, 0)
        stems = {unicodedata.normalize("NFD", s): c for c, group in terms.HANGUL.items() for s in group.split()}
        self.stems: dict[str, set[str]] = {}
        for c, group in terms.HANGUL.items():
            for s in group.split():
                self.stems.setdefault(unicodedata.normalize("NFD", s), set()).add(c)
        self.stem_exact = Automaton(stems, 0)
        self.stem_near = Automaton({s: c for s, c in stems.items() if len(s) >= 6}, 1)
        endings = "|".join(terms.HANGUL_ENDINGS.split())
        self.hangul_address = re.compile(f"(?:{'|'.join(terms.HANGUL_ADDRESS.split())})(?:{endings})?")
        self.names = list(terms.PRIOR)
        self.index = {n: i for i, n in enumerate(self.names)}
        self.weights = np.array(list(terms.PRIOR.values())) if weights is None else weights
        self.plan = {c: [] for c in terms.CORES}
        for name, i in self.index.items():
            m = re.match(r"([A-Z_]+)([ ~>.]?)(.*)", name)
            core, kind, rest = m.groups()
            if core in self.plan:
                self.plan[core].append((i, kind, rest.split()))
        self.cores = frozenset(terms.CORES)
        self.kept: dict[str, tuple[frozenset[str], str, bool]] = {}

    def word(self, word: str) -> tuple[frozenset[str], str, bool]:
        """Categories of a word, the word of a phrase it stands for, and whether it is misspelt."""
        hit = self.kept.get(word)
        if hit is None:
            if len(self.kept) > 500_000:
                self.kept.clear()
            hit = self.kept[word] = self._hangul(word) if "가" <= word[:1] <= "힣" else self._word(word)
        return hit

    def _word(self, word: str) -> tuple[frozenset[str], str, bool]:
        bare = plain(word)
        if word in self.exact or bare in self.exact:
            return self.exact.get(word, frozenset()) | self.exact.get(bare, frozenset()), bare if bare in self.parts else "", False
        none = (frozenset(), "", False)
        if "*" in word:
            letters = len(word.replace("*", ""))
            same = [w for w in self.any.near(bare) if len(w) == len(bare)] if letters else []
            return self._all(same, False) if same else none
        if word in self.ordinary or not bare.isalpha():
            return none
        short = collapsed(bare)
        if short != bare and short in self.collapsed:
            return self._all(self.collapsed[short], False)
        found = {}
        for form in {bare, short}:
            if len(form) >= 5:
                found.update(self.one.near(form))
            if len(form) >= 9 and not found:
                found.update(self.two.near(form))
        return self._all(found, True) if found else none

    def _all(self, words, edited: bool) -> tuple[frozenset[str], str, bool]:
        words = sorted(words)
        part = next((w for w in words if w in self.parts), "")
        return frozenset().union(*(self.exact[w] for w in words)), part, edited

    def _hangul(self, word: str) -> tuple[frozenset[str], str, bool]:
        """Stems at the beginning of a word, whole syllables; letters of Hangul are counted for edits."""
        if self.hangul_address.fullmatch(word):
            return frozenset(["ADDRESS"]), "", False
        found: dict[str, bool] = {}
        for automaton, edited in ((self.stem_exact, False), (self.stem_near, True)):
            state = automaton.start
            for syllable in word:
                for c in unicodedata.normalize("NFD", syllable):
                    state = automaton.step(state, c)
                if automaton.dead(state):
                    break
                for stem in automaton.found(state):
                    found.setdefault(stem, edited)
        part = next((p for p in self.hangul_parts if word.startswith(p)), "")
        if not found:
            return frozenset(), part, False
        exact = [s for s, edited in found.items() if not edited] or list(found)
        return frozenset().union(*(self.stems[s] for s in exact)), part, all(found.values())

    def near_ordinary(self, words) -> frozenset[str]:
        """Those of ``words`` that would be taken for a misspelt term if they weren't ordinary words."""
        return frozenset(w for w in words if self._word(w)[2] or collapsed(plain(w)) in self.collapsed)


# --- sentences --------------------------------------------------------------------------------------------------------


def normalised(text: str) -> str:
    """Unmasked lower-case text: look-alike letters folded, letters set apart joined, code spans left out."""
    text = unmask(text)
    if "`" in text:
        text = _CODE_SPAN.sub(" ", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if _SPACED_HINT.search(text):
        text = _SPACED.sub(lambda m: re.sub(r"[^\w]|_", "", m.group()), text)
    return text


def _undisguised(word: str) -> str:
    if not word.isalpha() and any(c in "0134578@$!|€9" for c in word):
        letters = word.translate(_LEET)
        if (any(c.isalpha() for c in word) or len(word) == 1) and re.fullmatch(r"[^\W\d_*]+", letters):
            word = letters
    return word.strip("'’")


_QUOTES = re.compile(r"[\"“„«]([^\"“”„«»\n]*)[\"”“»]")


def sentence_features(sentence: str, lexicon: Lexicon) -> tuple[frozenset[int], bool] | None:
    """Meetings of categories around the cores of a sentence, and whether all cores stand in quotation marks."""
    spans = [(m.start(), m.end(), _undisguised(m.group())) for m in _WORD.finditer(sentence)]
    looked = [lexicon.word(w) for _, _, w in spans]
    cats = [set(c) for c, _, _ in looked]
    n = len(cats)
    for i, (_, part, _) in enumerate(looked):  # phrases give their category to their first word
        for category, rest in lexicon.first.get(part, ()) if part else ():
            at = i
            for nxt in rest:
                at = next((k for k in range(at + 1, min(n, at + 4)) if looked[k][1] == nxt), -1)
                if at < 0:
                    break
            else:
                cats[i].add(category)
    hits = [i for i in range(n) if not lexicon.cores.isdisjoint(cats[i])]
    if not hits:
        return None
    quoted = [(m.start(1), m.end(1)) for m in _QUOTES.finditer(sentence)] if any(q in sentence for q in "\"“„«") else []
    sexual = {spans[i][2] for i in range(n) if "SEX" in cats[i]}
    intimate = {spans[i][2] for i in range(n) if "INTIMATE" in cats[i]}
    out: set[int] = set()
    inside = 0
    for i in hits:
        around = set().union(*cats[max(0, i - WINDOW) : i], *cats[i + 1 : i + 1 + WINDOW])
        near = set().union(*cats[max(0, i - NEAR) : i], *cats[i + 1 : i + 1 + NEAR])
        behind = set().union(*cats[i + 1 : i + 3])
        a, b, _ = spans[i]
        span = next((s for s in quoted if s[0] <= a and b <= s[1]), None)
        inside += span is not None
        alone_quoted = span is not None and len(_WORD.findall(sentence[span[0] : span[1]])) == 1
        beside = set().union(*cats[max(0, i - 2) : i], *cats[i + 1 : i + 3])
        if "ADDRESS" in beside or {"ADDRESS", "BE"} <= near:  # said to someone, not about a word
            around.discard("MENTION")
        for core in cats[i] & lexicon.cores:
            for k, kind, rest in lexicon.plan[core]:
                if kind == "":
                    ok = True
                elif kind == " ":
                    ok = all(r in around for r in rest)
                elif kind == "~":
                    ok = rest[0] in near
                elif kind == ">":
                    ok = rest[0] in behind
                else:
                    name, *others = rest
                    ok = (
                        name == "ALONE" and n <= 4 or name == "QUOTED" and alone_quoted
                        or name == "SELF" and "SELF" in around and "ADDRESS" not in around and "GROUP" not in around
                        or name == "TWICE" and len(sexual if core == "SEX" else intimate) >= 2 and all(r in around for r in others)
                    )
                if ok:
                    out.add(k)
    if all(looked[i][2] for i in hits):
        out.add(lexicon.index["EDITED"])
    return frozenset(out), inside == len(hits)


def document_features(text: str | None, lexicon: Lexicon) -> dict[tuple[frozenset[int], bool], None]:
    """Distinct features of the sentences of a text that hold a core, and whether they are quoted."""
    if not text:
        return {}
    text = normalised(text)
    if not any(not lexicon.cores.isdisjoint(c) or p in lexicon.first for c, p, _ in {lexicon.word(_undisguised(w)) for w in set(_WORD.findall(text))}):
        return {}
    out: dict[tuple[frozenset[int], bool], None] = {}
    for line in text.splitlines():
        cited = line.lstrip().startswith(">")
        for s in _SPLIT.split(_SPEAKER.sub("", line.lstrip("> \t"))):
            found = sentence_features(s, lexicon)
            if found and found[0]:
                out[found[0], found[1] or cited] = None
    return out


def logistic(features: frozenset[int], weights: np.ndarray) -> float:
    return 1.0 / (1.0 + math.exp(-(terms.BIAS + sum(weights[k] for k in features))))


def document_scores(text: str | None, lexicon: Lexicon) -> tuple[float, float]:
    """Scores of the worst sentence outside and inside quotations."""
    direct = quoted = 0.0
    for features, cited in document_features(text, lexicon):
        s = logistic(features, lexicon.weights)
        if cited:
            quoted = max(quoted, s)
        else:
            direct = max(direct, s)
    return direct, quoted


def document_score(text: str | None, lexicon: Lexicon) -> float:
    return max(document_scores(text, lexicon))


# --- weights ----------------------------------------------------------------------------------------------------------


def fit_weights(examples: list[tuple[list[list[int]], bool]], prior: np.ndarray, *, spread: float = 0.5, steps: int = 150) -> np.ndarray:
    """Weights of largest posterior: logistic likelihood of documents by their best sentence, normal prior of standard deviation ``spread``."""
    kept = [(s, y) for s, y in examples if s]
    if not kept:
        return prior
    of = np.repeat(np.arange(len(kept)), [len(s) for s, _ in kept])
    rows = [f for s, _ in kept for f in s]
    x = np.zeros((len(rows), len(prior)))
    for r, f in enumerate(rows):
        x[r, f] = 1.0
    y = np.array([b for _, b in kept], dtype=float)
    begin = np.searchsorted(of, np.arange(len(kept)))
    w = prior.copy()
    rate = 1.0 / (1.0 / spread**2 + 0.25 * x.sum(axis=0))
    for _ in range(steps):
        logit = x @ w + terms.BIAS
        best = np.array([b + int(np.argmax(logit[b:e])) for b, e in zip(begin, [*begin[1:], len(rows)])])
        p = 1.0 / (1.0 + np.exp(-logit[best]))
        w = w + 0.5 * rate * (x[best].T @ (y - p) - (w - prior) / spread**2)
    return w


def labelled_features(docs: DataFrame, labels: DataFrame, ordinary: frozenset[str], most: int = LABELLED_DOCUMENTS) -> DataFrame:
    """doc_id, abusive, sentences (feature ids) of at most ``most`` labelled documents, chosen by hash; labels of one document vote."""
    votes = labels.where("category is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.avg((F.lower("category") != "none").cast("double")) >= 0.5).alias("abusive")
    )
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(ordinary)
        for pdf in batches:
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "abusive": pdf["abusive"],
                "sentences": [[sorted(f) for f in dict.fromkeys(f for f, _ in document_features(t, lexicon))] for t in pdf["text"]],
            })

    return joined.mapInPandas(run, "doc_id long, abusive boolean, sentences array<array<int>>")


def learned(docs: DataFrame, labels: DataFrame | None, ordinary: frozenset[str], most: int = LABELLED_DOCUMENTS) -> np.ndarray:
    prior = np.array(list(terms.PRIOR.values()))
    if labels is None:
        return prior
    rows = labelled_features(docs, labels, ordinary, most).collect()  # at most ``most`` rows of feature numbers
    rows = sorted(rows, key=lambda r: r.doc_id)
    return fit_weights([(r.sentences, r.abusive) for r in rows], prior)


def ordinary_near(vocabularies=VOCABULARIES) -> frozenset[str]:
    """Ordinary words close to the lexicon: all that tasks need of the vocabularies."""
    return Lexicon().near_ordinary(ordinary_words(vocabularies))


def score_documents(docs: DataFrame, labels: DataFrame | None = None, *, vocabularies=VOCABULARIES) -> DataFrame:
    """doc_id, source, score, direct_score, quoted_score for ``docs`` (doc_id, source, text) and ``labels`` (doc_id, category)."""
    ordinary = ordinary_near(vocabularies)
    weights = learned(docs, labels, ordinary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(ordinary, weights)
        for pdf in batches:
            pairs = np.round(np.array([document_scores(t, lexicon) for t in pdf["text"]], dtype=float).reshape(-1, 2), 4)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "source": pdf["source"], "score": pairs.max(axis=1) if len(pairs) else [],
                "direct_score": pairs[:, 0], "quoted_score": pairs[:, 1],
            })

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return src.mapInPandas(run, "doc_id long, source string, score double, direct_score double, quoted_score double")


def source_name(column: str = "source") -> Column:
    return F.lower(F.trim(F.col(column)))


def source_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, flagged documents, their rate and the mean score."""
    return scored.groupBy(source_name().alias("source")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") >= threshold).alias("flagged"),
        F.round(F.count_if(F.col("score") >= threshold) / F.count(F.lit(1)), 6).alias("rate"),
        F.round(F.avg("score"), 6).alias("mean_score"),
    )
