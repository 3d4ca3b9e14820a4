"""Full-text search with ranking.

Terms are runs of letters and digits in lower case without diacritics. The
expression language has terms (all must match), "phrases", prefix*, AND, OR, NOT,
NEAR(a b, n), ^term (at the beginning) and parentheses. It is parsed on the
driver into set algebra over a postings table, so only the postings of the
query's own terms are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.functions.text import fold, folded

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
NEAR_DEFAULT = 10
_TERM = r"[\p{L}\p{N}\p{Co}]+"


def terms_of(body: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(body, F.lit(""))), F.lit(_TERM), F.lit(0))


def postings(documents: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """(term, id, tf, positions) of every term of every row."""
    words = documents.select(F.col(key).alias("id"), F.posexplode(terms_of(F.col(body))).alias("at", "term"))
    return words.groupBy("term", "id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))


def lengths(documents: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """(id, dl) of every row; rows without text have length 0 and still count."""
    return documents.select(F.col(key).alias("id"), F.size(terms_of(F.col(body))).alias("dl"))


# ------------------------------------------------------------ expressions


class QueryError(ValueError):
    """The expression does not parse."""


@dataclass(frozen=True)
class Phrase:
    """Words one after another; the last may be a prefix, the first pinned to the beginning."""

    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = NEAR_DEFAULT


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    left: object
    right: object


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()*^,+])|([\w\x80-\U0010FFFF]+)|(\S))')


def parse(text: str):
    """Expression tree, or None for a blank one."""
    tokens: list[tuple[str, str]] = []
    for m in _LEX.finditer(text.rstrip()):
        if m[4]:
            raise QueryError(f"syntax error near {m[4]!r}")
        tokens.append(("phrase", m[1].replace('""', '"')) if m[1] is not None else ("mark", m[2]) if m[2] else ("word", m[3]))
    at = 0

    def peek(i: int = 0) -> tuple[str, str]:
        return tokens[at + i] if at + i < len(tokens) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else ("end", "")

    def phrase() -> Phrase:
        first = peek() == ("mark", "^")
        if first:
            take()
        words: list[str] = []
        while True:
            kind, value = take()
            if kind not in ("phrase", "word"):
                raise QueryError(f"syntax error near {value!r}")
            words += re.findall(r"[^\W_]+", folded(value))
            if peek() != ("mark", "+"):
                break
            take()
        prefix = peek() == ("mark", "*")
        if prefix:
            take()
        return Phrase(tuple(words), prefix, first)

    def primary():
        if peek() == ("mark", "("):
            take()
            inner = either()
            if take() != ("mark", ")"):
                raise QueryError("unbalanced parentheses")
            return inner
        if peek() == ("word", "NEAR") and peek(1) == ("mark", "("):
            take(), take()
            found = []
            while peek()[0] in ("phrase", "word") or peek() == ("mark", "^"):
                found.append(phrase())
            distance = NEAR_DEFAULT
            if peek() == ("mark", ","):
                take()
                kind, value = take()
                if kind != "word" or not value.isdigit():
                    raise QueryError("NEAR needs a number")
                distance = int(value)
            if take() != ("mark", ")") or not found:
                raise QueryError("unbalanced NEAR")
            return Near(tuple(found), distance)
        return phrase()

    def implicit():
        left = primary()
        while peek()[0] in ("word", "phrase") and peek()[1] not in ("AND", "OR", "NOT") or peek() in (("mark", "("), ("mark", "^")):
            left = Op("and", left, primary())
        return left

    def chain(word: str, kind: str, lower):
        left = lower()
        while peek() == ("word", word):
            take()
            left = Op(kind, left, lower())
        return left

    def negated():
        return chain("NOT", "not", implicit)

    def both():
        return chain("AND", "and", negated)

    def either():
        return chain("OR", "or", both)

    if not tokens:
        return None
    tree = either()
    if peek()[0] != "end":
        raise QueryError(f"syntax error near {peek()[1]!r}")
    return tree


def _phrases(tree) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Near):
        return list(tree.phrases)
    if tree.kind == "not":
        return _phrases(tree.left)
    return _phrases(tree.left) + _phrases(tree.right)


def _word(index: DataFrame, word: str, prefix: bool) -> DataFrame:
    """(id, at) of a word or of all words with a prefix."""
    rows = index.filter(F.col("term").startswith(word) if prefix else F.col("term") == word)
    return rows.select("id", F.explode("positions").alias("at"))


def occurrences(index: DataFrame, phrase: Phrase) -> DataFrame:
    """(id, at) where a phrase begins: the words' places, moved back by their offsets, agree."""
    last = len(phrase.words) - 1
    parts = [_word(index, w, phrase.prefix and i == last).select("id", (F.col("at") - i).alias("at")).distinct() for i, w in enumerate(phrase.words)]
    found = reduce(lambda a, b: a.join(b, ["id", "at"], "left_semi"), parts)
    return found.filter("at = 0") if phrase.first else found


def _near(index: DataFrame, near: Near) -> DataFrame:
    """Rows where all phrases stand with at most `distance` words between the nearest ends."""
    rows = None
    for i, p in enumerate(near.phrases):
        own = occurrences(index, p).groupBy("id").agg(F.collect_set("at").alias(f"at{i}"))
        rows = own if rows is None else rows.join(own, "id")
    span = sum(len(p.words) for p in near.phrases)

    def within(i: int, size: int) -> Column:
        return F.exists(f"at{i}", lambda x: (x >= F.col("low")) & (x + size <= F.col("low") + near.distance + span))

    test = reduce(lambda a, b: a & b, [within(i, len(p.words)) for i, p in enumerate(near.phrases)])
    starts = F.flatten(F.array(*[F.col(f"at{i}") for i in range(len(near.phrases))]))
    return rows.withColumn("low", F.explode(starts)).filter(test).select("id").distinct()


def matches(index: DataFrame, tree) -> DataFrame:
    """(id) of the rows that an expression matches."""
    if isinstance(tree, Phrase):
        if not tree.words:
            return index.select("id").limit(0)
        if len(tree.words) == 1 and not tree.first:
            word = tree.words[0]
            return index.filter(F.col("term").startswith(word) if tree.prefix else F.col("term") == word).select("id").distinct()
        return occurrences(index, tree).select("id").distinct()
    if isinstance(tree, Near):
        return _near(index, tree)
    left, right = matches(index, tree.left), matches(index, tree.right)
    if tree.kind == "and":
        return left.join(right, "id", "left_semi")
    if tree.kind == "not":
        return left.join(right, "id", "left_anti")
    return left.union(right).distinct()


def scores(index: DataFrame, dl: DataFrame | None, found: DataFrame, tree, stats: DataFrame | None = None) -> DataFrame:
    """(id, score): BM25 summed over the expression's phrases, negated, so that the
    best is least. Every row of the table counts in the average length and number,
    which are counted unless stats(n, avgdl) has them; without dl the index has dl."""
    wanted = list(dict.fromkeys(p for p in _phrases(tree) if p.words))
    stats = dl.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")) if stats is None else stats
    dl = index.groupBy("id").agg(F.first("dl").alias("dl")) if dl is None else dl
    parts = []
    for i, p in enumerate(wanted):
        if len(p.words) == 1 and not p.first:
            rows = index.filter(F.col("term").startswith(p.words[0]) if p.prefix else F.col("term") == p.words[0]).groupBy("id").agg(F.sum("tf").alias("tf"))
        else:
            rows = occurrences(index, p).groupBy("id").agg(F.count("*").alias("tf"))
        parts.append(rows.withColumn("phrase", F.lit(i)))
    tf = reduce(lambda a, b: a.unionByName(b), parts)
    df = tf.groupBy("phrase").agg(F.count("*").alias("df"))  # a row for each phrase of the query
    rows = tf.join(found, "id", "left_semi").join(dl, "id").join(F.broadcast(df), "phrase").join(F.broadcast(stats.withColumn("one", F.lit(1))), F.lit(1) == F.col("one"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    return rows.groupBy("id").agg((-F.sum(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))).alias("score"))


# ------------------------------------------------------------ snippets

_TERM_HERE = re.compile("(?:[^\\W_]|[\uE000-\uF8FF\U000F0000-\U000FFFFD\U00100000-\U0010FFFD])+")
#: What a window gains: a phrase the first time, each time after, and by where it begins: fixed values.
NEW_PHRASE, SAME_PHRASE, AT_SENTENCE, AT_BEGINNING = 1000, 1, 100, 120


def _tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, folded term) of the terms of a text, by its own characters."""
    if text.isascii():
        return [(m.start(), m.end(), m[0].lower()) for m in _TERM_HERE.finditer(text)]
    low = text.lower()
    chars = low if len(low) == len(text) else text
    plain, source = [], []
    for i, c in enumerate(chars):
        for x in folded(c):
            plain.append(x)
            source.append(i)
    source.append(len(text))
    return [(source[m.start()], source[m.end()], m[0]) for m in _TERM_HERE.finditer("".join(plain))]


def instances(terms: list[str], phrases: list[Phrase]) -> list[tuple[int, int, int]]:
    """(place, phrase, length) of every occurrence of the phrases among terms, in order."""
    out = []
    for k, p in enumerate(phrases):
        *head, last = p.words
        for at in range(1 if p.first else len(terms) - len(head)):
            here = terms[at + len(head)] if at + len(head) < len(terms) else None
            if here is not None and terms[at : at + len(head)] == head and (here.startswith(last) if p.prefix else here == last):
                out.append((at, k, len(p.words)))
    return sorted(out)


def best_window(n: int, found: list[tuple[int, int, int]], sentences: list[int], size: int) -> int:
    """Where the window of `size` terms with the best score begins, the first of equals.

    A window is tried at each instance, then moved so that what it holds stands in its
    middle, and at the beginning of the instance's sentence if the text is longer."""
    best, start = -1, 0
    low = high = sentence = 0
    for i, (at, _, _) in enumerate(found):
        high = max(high, i)
        while high < len(found) and found[high][0] < at + size:
            high += 1
        while found[low][0] < at:
            low += 1
        score = _window(found[low:high])
        if score > best:
            first, last = found[low][0], found[high - 1][0] + found[high - 1][2]
            best, start = score, max(0, min(first - max(0, size - (last - first)) // 2, n - size))
        while sentence < len(sentences) and sentences[sentence] < at:
            sentence += 1
        if n > size and sentence:
            begin = sentences[sentence - 1]
            own = [x for x in found if begin <= x[0] < begin + size]
            score = _window(own) + (AT_SENTENCE if begin else AT_BEGINNING)
            if score > best:
                best, start = score, begin
    return start


def _window(own: list[tuple[int, int, int]]) -> int:
    kinds = len({k for _, k, _ in own})
    return kinds * NEW_PHRASE + (len(own) - kinds) * SAME_PHRASE


def marked(text: str | None, phrases: list[Phrase], size: int, mark: tuple[str, str], dots: str) -> str:
    """The best window of a text, its instances marked."""
    tokens = _tokens(text or "")
    found = instances([t for _, _, t in tokens], phrases)
    n = len(tokens)
    if not n:
        return text or ""
    sentences = [i for i, (at, _, _) in enumerate(tokens) if i == 0 or text[:at].rstrip(" \t\n\r")[-1:] in (".", ":")] if n > size and found else []
    start = best_window(n, found, sentences, size)
    stop = min(n, start + size)
    spans: list[list[int]] = []
    for at, _, length in found:
        if spans and at < spans[-1][1]:  # instances that overlap are marked as one
            spans[-1][1] = max(spans[-1][1], at + length)
        else:
            spans.append([at, at + length])
    out, at = [dots if start else ""], tokens[start][0] if start else 0
    for a, b in spans:
        if start <= a < stop:
            begin, end = tokens[a][0], tokens[min(b, stop) - 1][1]
            out += [text[at:begin], mark[0], text[begin:end], mark[1]]
            at = end
    out += [text[at : tokens[stop - 1][1] if stop < n else len(text)], dots if stop < n else ""]
    return "".join(out)


def snippet(body: Column, tree, size: int = 50, mark: tuple[str, str] = ("<mark>", "</mark>"), dots: str = "...") -> Column:
    """The window of at most `size` words that holds the most phrases of an expression, with
    their occurrences marked. A null body gives ''."""
    phrases = [p for p in dict.fromkeys(_phrases(tree)) if p.words]

    def shown(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda text: marked(text, phrases, size, mark, dots))

    return F.pandas_udf(shown, "string")(body)


def search(documents: DataFrame, text: str, limit: int = 100, index=None, dl: DataFrame | None = None) -> DataFrame:
    """Rows of documents(id, address, contact_name, body, date) that match, best first.
    An empty expression gives no rows; one that does not parse is a QueryError. index is
    a kept one (`postings.Index`), or postings with their lengths dl; without it the
    postings of all rows are made first."""
    tree = parse(text) if text else None
    shape = documents.select("id", "address", F.coalesce("contact_name", F.lit("")).alias("contact_name"), "body", "date")
    if tree is None:
        return shape.withColumns({"snippet": F.lit(""), "score": F.lit(0.0)}).limit(0)
    if hasattr(index, "top"):
        ranked = index.top(tree, limit)
    else:
        index = postings(documents) if index is None else index
        dl = lengths(documents) if dl is None else dl
        ranked = scores(index, dl, matches(index, tree), tree).orderBy("score", "id").limit(limit)
    return shape.join(ranked, "id").withColumn("snippet", snippet(F.col("body"), tree)).orderBy("score", "id")
