"""Full-text search inside `contains [[...]]`, compiled to array expressions.

A text becomes an array of words; a search node becomes an expression for the array of word
positions that it matches, and a row is in the set if that array is not empty. Operators pass on the
positions they matched, so `a < b < c` chains. Everything is built-in expressions. Proximity looks
up the windows around positions in a hashed intersection, so it is linear in the positions, and a
substring test on the raw text keeps rows that cannot match from being split into words at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

NEAR = 10
_TOKEN = re.compile(r"""\s*(?:(?P<number>\[\s*\d+\s*\])|(?P<word>[A-Za-z0-9'*]?[A-Za-z0-9][A-Za-z0-9'*]*)|(?P<symbol>[&|<>~()"-]))""")


class SearchError(ValueError):
    """A search that cannot be read."""


@dataclass(frozen=True)
class Word:
    text: str  # without apostrophes, in capitals; may hold *


@dataclass(frozen=True)
class AnyOf:
    parts: tuple


@dataclass(frozen=True)
class Join:
    op: str  # & &- < > ~
    left: Any
    right: Any
    near: int = NEAR


@dataclass(frozen=True)
class Phrase:
    parts: tuple


def parse(text: str) -> Any:
    tokens: list[tuple[str, str]] = []
    pos = 0
    while text[pos:].strip():
        m = _TOKEN.match(text, pos)
        if not m:
            raise SearchError(f"cannot read search at {text[pos : pos + 20]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        pos = m.end()
    tokens.append(("end", ""))
    at = 0

    def peek() -> str:
        return tokens[at][1] if tokens[at][0] in ("symbol", "end") else ""

    def alternatives() -> Any:
        nonlocal at
        parts = [joined()]
        while peek() == "|":
            at += 1
            parts.append(joined())
        return parts[0] if len(parts) == 1 else AnyOf(tuple(parts))

    def joined() -> Any:
        nonlocal at
        left = phrase()
        while True:
            kind, v = tokens[at]
            if kind == "end" or v in ("|", ")"):
                return left
            near = NEAR
            op = "&"
            if v in ("<", ">", "~"):
                op = v
                at += 1
                if tokens[at][0] == "number":
                    near = int(tokens[at][1].strip("[] "))
                    at += 1
            else:
                if v == "&":
                    at += 1
                if peek() == "-":
                    op = "&-"
                    at += 1
            left = Join(op, left, phrase(), near)

    def phrase() -> Any:
        nonlocal at
        if peek() != '"':
            return term()
        at += 1
        parts = []
        while peek() != '"':
            parts.append(term())
        at += 1
        if not parts:
            raise SearchError("empty phrase")
        return Phrase(tuple(parts))

    def term() -> Any:
        nonlocal at
        kind, v = tokens[at]
        at += 1
        if kind == "word":
            return Word(v.replace("'", "").upper())
        if v == "(":
            inner = alternatives()
            if peek() != ")":
                raise SearchError(f"missing ) in {text!r}")
            at += 1
            return inner
        raise SearchError(f"expected a word but found {v!r} in {text!r}")

    tree = alternatives()
    if tokens[at][0] != "end":
        raise SearchError(f"unexpected {tokens[at][1]!r} in {text!r}")
    return tree


def unparse(node: Any) -> str:
    if isinstance(node, Word):
        return node.text
    if isinstance(node, AnyOf):
        return "(" + " | ".join(map(unparse, node.parts)) + ")"
    if isinstance(node, Phrase):
        return '"' + " ".join(map(unparse, node.parts)) + '"'
    near = f"[{node.near}]" if node.op in "<>~" else ""
    return f"({unparse(node.left)} {node.op}{near} {unparse(node.right)})"


def words(text: Column) -> Column:
    """The words of a text, of two characters or more, in capitals and without apostrophes."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9][A-Za-z0-9']+"), F.lit(0))
    return F.coalesce(F.transform(found, lambda w: F.upper(F.replace(w, F.lit("'"), F.lit("")))), F.array().cast("array<string>"))


def _pattern(word: str) -> str:
    return "^" + ".*".join(map(re.escape, word.split("*"))) + "$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def positions(node: Any, tokens: Column | dict[str, Column]) -> Column:
    """The array of positions that a node matches; empty if it does not match.

    tokens: the array of a text's words, or the array of positions of each word of the search.
    """
    if isinstance(node, Word) and isinstance(tokens, dict):
        return tokens[node.text]
    if isinstance(node, Word):
        hit = (lambda w: w.rlike(_pattern(node.text))) if "*" in node.text else (lambda w: w == node.text)
        return F.array_compact(F.transform(tokens, lambda w, i: F.when(hit(w), i)))
    if isinstance(node, AnyOf):
        out = positions(node.parts[0], tokens)
        for p in node.parts[1:]:
            out = F.array_union(out, positions(p, tokens))
        return out
    if isinstance(node, Phrase):
        out = positions(node.parts[0], tokens)
        for p in node.parts[1:]:
            out = _chain(out, positions(p, tokens))
        return out
    return _let(positions(node.left, tokens), lambda left: _let(positions(node.right, tokens), lambda right: _joined(node, left, right)))


def _chain(before: Column, after: Column) -> Column:
    return _let(before, lambda left: _let(after, lambda right: _follow(left, right)))


def _follow(left: Column, right: Column) -> Column:
    """Positions of pairs in which right comes just after left."""
    return F.array_union(F.array_intersect(left, F.transform(right, lambda x: x - 1)), F.array_intersect(right, F.transform(left, lambda x: x + 1)))


def _joined(node: Join, left: Column, right: Column) -> Column:
    none = F.array().cast("array<int>")
    if node.op == "&":
        return F.when((F.size(left) > 0) & (F.size(right) > 0), F.array_union(left, right)).otherwise(none)
    if node.op == "&-":
        return F.when(F.size(right) == 0, left).otherwise(none)
    window = lambda of, low, high: F.flatten(F.transform(of, lambda x: F.sequence(x + low, x + high)))
    out = None
    for before in ([True] if node.op == "<" else [False] if node.op == ">" else [True, False]):
        n = node.near if before else -node.near
        low, high = sorted((0, n))
        part = F.array_union(F.array_intersect(left, window(right, -high, -low)), F.array_intersect(right, window(left, low, high)))
        out = part if out is None else F.array_union(out, part)
    return out


def _possible(node: Any, flat: Column) -> Column:
    """A condition on the text in capitals, without apostrophes, that every match meets."""
    if isinstance(node, Word):
        longest = max(node.text.split("*"), key=len)
        return flat.contains(longest) if longest else F.lit(True)
    if isinstance(node, (AnyOf, Phrase)):
        out = _possible(node.parts[0], flat)
        for p in node.parts[1:]:
            out = out | _possible(p, flat) if isinstance(node, AnyOf) else out & _possible(p, flat)
        return out
    left = _possible(node.left, flat)
    return left if node.op == "&-" else left & _possible(node.right, flat)


def matches(node: Any, text: Column) -> Column:
    """True or false, never null: whether the search finds anything in a text."""
    flat = F.upper(F.replace(text, F.lit("'"), F.lit("")))
    return F.coalesce(_possible(node, flat) & _let(words(text), lambda tokens: F.size(positions(node, tokens)) > 0), F.lit(False))


def search_words(node: Any) -> list[str]:
    if isinstance(node, Word):
        return [node.text]
    if isinstance(node, Join):
        return search_words(node.left) + ([] if node.op == "&-" else search_words(node.right))
    return [w for p in node.parts for w in search_words(p)]


def highlight(node: Any, text: Column, before: str = "<b>", after: str = "</b>") -> Column:
    """The text with every word of the search marked."""
    one = lambda w: "'?".join("[A-Z0-9']*" if c == "*" else re.escape(c) for c in w)
    either = "|".join(one(w) for w in search_words(node))
    mark = lambda s: s.replace("\\", "\\\\").replace("$", r"\$")
    return F.regexp_replace(text, rf"(?i)(?<![A-Z0-9'])({either})(?![A-Z0-9'])", f"{mark(before)}$1{mark(after)}")


# -- a word index on disk
#: Buckets of words; a search without wildcards reads the buckets of its words only.
BUCKETS = 256


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """bucket, word, the key and positions (ascending) of every word in every text; null and empty texts have none.

    Words of a text are grouped with their text, so a word that all texts have is no group of its own.
    """
    k = F.col(f"`{key}`")
    each = df.select(k.alias("__key"), F.posexplode(words(F.col(f"`{text}`"))).alias("__at", "word"))
    grouped = each.groupBy("__key", "word").agg(F.array_sort(F.collect_list("__at")).alias("positions"))
    return grouped.select(_bucket(F.col("word")).alias("bucket"), "word", F.col("__key").alias(key), "positions")


def write_postings(df: DataFrame, key: str, text: str, path: str, parts: int = 8) -> None:
    """Write the word index of a column of texts: a folder per bucket, sorted by word; a bucket goes to `parts` tasks."""
    index = postings(df, key, text)
    spread = index.repartition(F.col("bucket"), F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(parts)))
    spread.sortWithinPartitions("bucket", "word", F.col(f"`{key}`")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def search_postings(index: DataFrame, key: str, node: Any) -> DataFrame:
    """The keys of the texts that a search matches, by the word index alone; each once, null keys none."""
    leaves = sorted(set(_all_words(node)))
    match = {w: F.col("word").rlike(_pattern(w)) & (F.col("word").startswith(w[: w.index("*")])) if "*" in w else F.col("word") == w for w in leaves}
    wanted = reduce(lambda a, b: a | b, match.values())
    if not any("*" in w for w in leaves):
        wanted = wanted & F.col("bucket").isin([r[0] for r in index.sparkSession.createDataFrame([(w,) for w in leaves], "word string").select(_bucket(F.col("word"))).collect()])
    names = {w: f"__w{i}" for i, w in enumerate(leaves)}
    gathered = [F.array_sort(F.flatten(F.collect_list(F.when(match[w], F.col("positions"))))).alias(n) for w, n in names.items()]
    per_text = index.where(wanted).groupBy(F.col(f"`{key}`").alias("__key")).agg(*gathered)
    hits = positions(node, {w: F.col(n) for w, n in names.items()})
    return per_text.where(F.col("__key").isNotNull() & (F.size(hits) > 0)).select(F.col("__key").alias(key))


def _all_words(node: Any) -> list[str]:
    if isinstance(node, Word):
        return [node.text]
    if isinstance(node, Join):
        return _all_words(node.left) + _all_words(node.right)
    return [w for p in node.parts for w in _all_words(p)]
