"""Symbol-name language processing: decorations, words, label sets, order, similarity."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of symbol decorations.
CONTENT = [r"_+[A-Z]{1,2}_+", r"_ssse\d*", r"_sse\d*", r"avx\d*", r"\.cold$", r"libc\d*", r"unaligned", r"erms", r"\.constprop(\.\d*)*", r"\.constp(\.\d*)*", r"\.isra(\.\d*)*", r"\.part(\.\d*)*"]
SYNTAX = [r"^sym\.imp\.", r"^sym\.", r"^__imp_", r"\.+\d+$", r"_+\d+$", r"^\d+_+", r"^\.+", r"\.+$", r"^_+", r"_+$", r"^\d+"]
REPEATED = r"([^a-zA-Z0-9\d])\1+"
# Thresholds of word segmentation.
SPLIT_FROM, WORD, ABBREVIATION, LONGEST = 12, 4, 3, 18
QUICK_WORD, QUICK_ABBREVIATION, QUICK_SPAN, QUICK_KEPT = 4, 3, range(5, 12), 8
LEVENSHTEIN, LEMMA_JACCARD, SYNSETS = 0.5, 0.36787968862663154641, 0.385


# --- decorations: column expressions ----------------------------------------------------------------------------------


def strip_decorations(name: Column) -> Column:
    """A symbol's name without library decorations: after each content pattern all syntax patterns, then runs collapse."""
    for content in CONTENT:
        for pattern in (content, *SYNTAX):
            name = F.regexp_replace(name, pattern, "")
        name = F.regexp_replace(name, REPEATED, "$1")
    return name


def strip_decorations_text(name: str) -> str:
    """The same for one string, in Python."""
    for content in CONTENT:
        for pattern in (content, *SYNTAX):
            name = re.sub(pattern, "", name)
        name = re.sub(REPEATED, r"\1", name)
    return name


def strip_r2(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^sym\.imp\.", ""), r"^sym\.", "")


def strip_ida(name: Column) -> Column:
    return F.replace(name, F.lit("__imp_"), F.lit(""))


def strip_data_library(name: Column) -> Column:
    return F.regexp_replace(name, "@@.*", "")


def without_junk(names: Column) -> Column:
    """An array of names without sub_... and empty ones."""
    return F.filter(names, lambda x: (x != "") & ~F.startswith(x, F.lit("sub_")))


def camel_words(name: Column) -> Column:
    """The distinct words of a camel-case name."""
    return F.array_distinct(F.split(F.regexp_replace(name, "([a-z])(?=[A-Z])", "$1\u0000"), "\u0000"))


def plain_labels(name: Column) -> Column:
    """The label set by patterns alone, no dictionary: camel-case words of letters, in lower case, and numbers, from two characters."""
    bare = strip_decorations(name)
    spaced = F.regexp_replace(bare, "([a-z])(?=[A-Z])", "$1 ")
    words = F.regexp_extract_all(F.lower(spaced), F.lit("[a-z]+|[0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2)))


# --- segmentation -----------------------------------------------------------------------------------------------------


class Dictionary:
    """Words and abbreviations known to the segmenter; by default drawn from a corpus, see corpus_words()."""

    def __init__(self, words: Iterable[str], abbreviations: Iterable[str] = (), stopwords: Iterable[str] = ()):
        self.words, self.abbreviations, self.stopwords = set(words), set(abbreviations), set(stopwords)

    def quick(self, text: str) -> set[str]:
        """Known parts of a long word: listed ones anywhere, and dictionary words of 5 to 11 letters; itself if a word."""
        if text in self.words:
            return {text}
        parts = {text[a:b] for a in range(len(text)) for b in range(a + 1, len(text) + 1)}
        listed = {w for w in parts & self.words if len(w) >= QUICK_WORD} | {w for w in parts & (self.abbreviations | self.stopwords) if len(w) >= QUICK_ABBREVIATION}
        return listed | {text[a : a + n] for a in range(len(text) - WORD) for n in QUICK_SPAN if text[a : a + n] in self.words}

    def parts(self, text: str) -> set[str]:
        """All substrings that are abbreviations, or words of at least WORD letters.

        Substrings shorter than one below the smaller threshold are never looked at.
        """
        least = max(1, min(ABBREVIATION, WORD) - 1) if len(text) >= min(ABBREVIATION, WORD) else len(text)
        each = (text[a:b] for a in range(len(text)) for b in range(a + least, len(text) + 1))
        return {s for s in each if s in self.abbreviations or len(s) >= WORD and s in self.words}

    def longest(self, text: str) -> str:
        """The longest dictionary word in text, the leftmost of equals."""
        for n in range(len(text), WORD - 1, -1):
            for a in range(len(text) - n + 1):
                if text[a : a + n] in self.words:
                    return text[a : a + n]
        return ""


def occurrences(text: str, parts: Iterable[str]) -> list[tuple[int, int]]:
    found = set()
    for p in parts:
        at = text.find(p)
        while p and at >= 0:
            found.add((at, at + len(p)))
            at = text.find(p, at + 1)
    return sorted(found)


def best_cover(text: str, parts: Iterable[str], exact: bool = False) -> list[tuple[int, int]]:
    """Non-overlapping occurrences of parts: most characters, then most squared lengths.

    By dynamic programming over end positions. exact takes combinations by size, in order of place, and replaces the best
    only by one with no fewer characters and a higher sum of squares; it is exponential, for up to 8 occurrences.
    """
    spans = occurrences(text, parts)
    if exact and len(spans) <= 8:
        best, most, score = [], 0, 0
        for n in range(1, len(spans) + 1):
            for some in combinations(spans, n):
                if all(a[1] <= b[0] for a, b in zip(some, some[1:])):
                    c, s = sum(b - a for a, b in some), sum((b - a) ** 2 for a, b in some)
                    if c >= most and s > score:
                        best, most, score = list(some), c, s
        return best
    by_end: dict[int, list[int]] = {}
    for a, b in spans:
        by_end.setdefault(b, []).append(a)
    table: list[tuple[int, int, tuple]] = [(0, 0, ())]
    for b in range(1, len(text) + 1):
        options = [table[b - 1]] + [(table[a][0] + b - a, table[a][1] + (b - a) ** 2, (*table[a][2], (a, b))) for a in by_end.get(b, [])]
        table.append(max(options, key=lambda o: o[:2]))
    return list(table[-1][2])


def segments(text: str, parts: Iterable[str], exact: bool = False) -> set[str]:
    """The covered parts and the gaps between them; nothing if nothing is covered."""
    cover, out, at = best_cover(text, parts, exact), set(), 0
    for a, b in cover:
        out |= {text[at:a], text[a:b]}
        at = b
    return (out | {text[at:]}) - {""} if cover else set()


def split_around(text: str, word: str) -> list[str]:
    """What stands before and after the first occurrence of word."""
    before, _, after = text.partition(word)
    return [x for x in (before, after) if x]


def camel_text(text: str) -> list[str]:
    return re.sub(r"([a-z])(?=[A-Z])", "\\1\0", text).split("\0")


def canonical_set(name: str, dictionary: Dictionary) -> set[str]:
    """The label set of a symbol name."""
    base = strip_decorations_text(name)
    labels = set(re.findall("[0-9]+", base))
    open_ = sorted({w.lower() for run in re.findall("[a-zA-Z]+", base) for w in camel_text(run)})
    while open_:
        word = open_.pop()
        if len(word) >= SPLIT_FROM:
            quick = sorted(dictionary.quick(word), key=lambda w: (len(w), w))[-QUICK_KEPT:]
            chosen = [word[a:b] for a, b in best_cover(word, quick)]
            if chosen:
                longest = max(chosen, key=lambda w: (len(w), w))
                labels.add(longest)
                open_ += split_around(word, longest)
                continue
        if len(word) > LONGEST:
            labels.add(word)
            continue
        found = segments(word, dictionary.parts(word))
        labels |= {w for w in (found or {word}) if len(w) >= 2}
    return {w for w in labels if len(w) >= 2}


def label_order(name: str, labels: Iterable[str]) -> list[str]:
    """labels as they stand in name: those found once first, the longest first; then the others at every free place."""
    text, taken, at = name.lower(), [], {}
    longest = sorted(set(labels), key=lambda w: (-len(w), w))
    spots = {w: [m.start() for m in re.finditer(f"(?={re.escape(w)})", text)] for w in longest}

    def place(w: str, a: int) -> None:
        if all(a + len(w) <= x or a >= y for x, y in taken):
            taken.append((a, a + len(w)))
            at[a] = w

    for w in longest:
        if len(spots[w]) == 1:
            place(w, spots[w][0])
    for w in longest:
        if w not in at.values():
            for a in spots[w]:
                place(w, a)
    return [at[a] for a in sorted(at)]


def segmented(names: DataFrame, column: str, dictionary: Dictionary) -> DataFrame:
    """Adds label_set and canonical_name; distinct names are segmented once a batch, over Arrow."""

    shared = names.sparkSession.sparkContext.broadcast(dictionary)  # a vocabulary, bounded by its k

    @F.pandas_udf("struct<label_set:array<string>,canonical_name:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple] = {}
        for batch in batches:
            if len(memo) > 200_000:
                memo.clear()
            for n in batch.dropna().unique():
                if n not in memo:
                    s = canonical_set(n, shared.value)
                    memo[n] = sorted(s), "_".join(label_order(n, s))
            rows = [memo.get(n, (None, None)) for n in batch]
            yield pd.DataFrame({"label_set": [r[0] for r in rows], "canonical_name": [r[1] for r in rows]})

    out = names.withColumn("_s", run(column))
    return out.select(*names.columns, "_s.label_set", "_s.canonical_name")


def corpus_words(tokens: DataFrame, column: str, least: int, k: int) -> list[str]:
    """The dictionary by default: the k most frequent tokens of at least WORD letters with a support of least."""
    n = tokens.where((F.length(column) >= WORD) & F.col(column).rlike("^[a-z]+$")).groupBy(column).agg(F.count("*").alias("n"))
    return [r[column] for r in n.where(F.col("n") >= least).orderBy(F.desc("n"), column).limit(k).collect()]


def expanded(tokens: Column, table: dict[str, str]) -> Column:
    """Abbreviations in an array replaced by their expansion."""
    pairs = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]) if table else None
    return tokens if pairs is None else F.transform(tokens, lambda t: F.coalesce(F.element_at(pairs, t), t))


# --- similarity -------------------------------------------------------------------------------------------------------


def similar(correct: Column, inferred: Column, lemma=lambda words: words, stem=lambda words: words, stopwords: list[str] = ()) -> Column:
    """A cascade: both or one empty; one within the other; edit distance; sets of words by lemmas, then by stems."""
    a, b = F.coalesce(correct, F.lit("")), F.coalesce(inferred, F.lit(""))
    near = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)) >= LEVENSHTEIN
    words = lambda c: F.filter(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))), lambda w: (F.length(w) > 2) & ~w.isin(list(stopwords) or [""]))
    far = lambda f: 1 - F.try_divide(F.size(F.array_intersect(f(words(a)), f(words(b)))), F.size(F.array_union(f(words(a)), f(words(b)))))
    return F.when((a == "") & (b == ""), True).when((a == "") | (b == ""), False).when(F.contains(a, b) | F.contains(b, a), True).when(near, True).when(far(lemma) < LEMMA_JACCARD, True).otherwise(F.coalesce(far(stem) < 1 - LEMMA_JACCARD, F.lit(False)))


def synonym_overlap(pairs: DataFrame, synonyms: DataFrame) -> DataFrame:
    """id, share: the words of a with a synonym among those of b, over the longer list. pairs: id, a, b; synonyms: word, synonym."""
    a = pairs.select("id", F.explode(F.array_distinct("a")).alias("word"))
    b = pairs.select("id", F.explode(F.array_distinct("b")).alias("word"))
    same = synonyms.select("word", "synonym").union(synonyms.select(F.col("word"), F.col("word"))).distinct()
    hit = a.join(same, "word").select("id", F.col("word").alias("wa"), F.col("synonym").alias("s")).join(b.join(same, "word").select("id", F.col("synonym").alias("s")), ["id", "s"]).groupBy("id").agg(F.count_distinct("wa").alias("n"))
    return pairs.join(hit, "id", "left").select("id", F.coalesce(F.try_divide("n", F.greatest(F.size("a"), F.size("b"))), F.lit(0.0)).alias("share"))


def smith_waterman(a: str, b: str, match: int = 3, gap: int = 2, strict: bool = True) -> int:
    """The span of a's best local alignment with b. Not strict: a mismatch restarts at -match, whatever stood before."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    top, at = 0, (0, 0)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            along = h[i - 1][j - 1] + match if a[i - 1] == b[j - 1] else (h[i - 1][j - 1] - match if strict else -match)
            h[i][j] = max(along, h[i - 1][j] - gap, h[i][j - 1] - gap, 0)
            if h[i][j] > top:
                top, at = h[i][j], (i, j)
    i, j = at
    first = i
    while i and j and h[i][j]:
        first = i
        if h[i][j] == h[i - 1][j] - gap:
            i -= 1
        elif h[i][j] == h[i][j - 1] - gap:
            j -= 1
        else:
            i, j = i - 1, j - 1
    return at[0] - first + 1 if top else 0


def alignment_distance(pairs: DataFrame, a: str, b: str, strict: bool = True) -> DataFrame:
    """Adds distance: 1 / (1 + ln(1 + span))."""
    import math


    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1 / (1 + math.log1p(smith_waterman(p or "", q or "", strict=strict))) for p, q in zip(x, y)])

    return pairs.withColumn("distance", run(a, b))


def wu_palmer(pairs: DataFrame, senses: DataFrame, ancestors: DataFrame) -> DataFrame:
    """id, similarity: the mean over word pairs of the best 2 depth(common) / (depth a + depth b) of their senses.

    pairs: id, a, b (arrays of words); senses: word, sense; ancestors: sense, ancestor, depth (of the ancestor), each sense
    its own ancestor. Word pairs without senses are left out; 0 if none is left.
    """
    each = pairs.select("id", F.explode(F.array_distinct("a")).alias("wa"), "b").select("id", "wa", F.explode(F.array_distinct("b")).alias("wb"))
    own = senses.join(ancestors.where("sense = ancestor").select("sense", F.col("depth").alias("own")), "sense").join(ancestors, "sense").select("word", "sense", "own", "ancestor", "depth")
    left, right = own.toDF("wa", "sa", "oa", "ancestor", "depth"), own.select("word", "sense", "own", "ancestor").toDF("wb", "sb", "ob", "ancestor")
    met = each.join(left, "wa").join(right, ["wb", "ancestor"]).groupBy("id", "wa", "wb").agg(F.max(2 * F.col("depth") / (F.col("oa") + F.col("ob"))).alias("s"))
    return pairs.select("id").join(met.groupBy("id").agg(F.avg("s").alias("s")), "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("similarity"))


def affinity_clusters(words: list[str], rounds: int = 200, damping: float = 0.5) -> dict[str, str]:
    """word -> exemplar by affinity propagation on alignment distances; for vocabularies of a few thousand words."""
    import math

    import numpy as np

    n = len(words)
    if n < 2:
        return {w: w for w in words}
    s = np.array([[-1 / (1 + math.log1p(smith_waterman(a, b))) for b in words] for a in words])
    np.fill_diagonal(s, np.median(s))
    r, a, rows = np.zeros((n, n)), np.zeros((n, n)), np.arange(n)
    for _ in range(rounds):
        t = a + s
        first = t.argmax(axis=1)
        top = t[rows, first]
        t[rows, first] = -np.inf
        new = s - top[:, None]
        new[rows, first] = s[rows, first] - t.max(axis=1)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        np.fill_diagonal(p, r.diagonal())
        new = p.sum(axis=0)[None, :] - p
        own = new.diagonal().copy()
        new = np.minimum(new, 0)
        np.fill_diagonal(new, own)
        a = damping * a + (1 - damping) * new
    heads = np.flatnonzero((r + a).diagonal() > 0)
    heads = heads if len(heads) else np.array([int((r + a).diagonal().argmax())])
    pick = heads[s[:, heads].argmax(axis=1)]
    pick[heads] = heads
    return {w: words[k] for w, k in zip(words, pick)}
