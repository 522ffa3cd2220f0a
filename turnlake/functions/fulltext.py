"""Tokens, phrases and boolean text queries as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Combining marks; they are dropped, so that decomposed letters are folded as well.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def _plain_letters() -> dict[str, str]:
    """Lower-case letters of the Latin blocks that decompose to an ASCII letter and marks, with that letter."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        first, *rest = unicodedata.normalize("NFD", chr(code))
        if rest and first.isascii() and first.islower() and all(unicodedata.combining(c) for c in rest):
            found[chr(code)] = first
    return found


_PLAIN = _plain_letters()
ACCENTED, PLAIN = "".join(_PLAIN), "".join(_PLAIN.values())


def folded(text: Column) -> Column:
    """Lower case without accents; null counts as empty."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED + MARKS, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def _fold(word: str) -> str:
    return word.lower().translate(str.maketrans(ACCENTED, PLAIN, MARKS))


class Phrase(NamedTuple):
    words: tuple[str, ...]


class Near(NamedTuple):
    """Phrases that all begin within a window: each at most ``gap`` tokens, besides its own, before the last one."""

    phrases: tuple[Phrase, ...]
    gap: int


class Both(NamedTuple):
    left: Node
    right: Node


class Either(NamedTuple):
    left: Node
    right: Node


class Without(NamedTuple):
    inner: Node


Node = Phrase | Near | Both | Either | Without

_PART = re.compile(r'NEAR\s*\(([^()]*)\)|"[^"]*"|[()]|[^\s()"]+')
#: Fixed value: tokens between the phrases of NEAR where no number is given.
NEAR_GAP = 10


def _phrase_of(part: str) -> Phrase | None:
    words = re.findall(r"[^\W_]+", _fold(part))
    return Phrase(tuple(words)) if words else None


def _near_of(inside: str) -> Node | None:
    body, comma, last = inside.rpartition(",")
    number = last.strip()
    gap = int(number) if comma and number.isdigit() else NEAR_GAP
    text = body if comma and number.isdigit() else inside
    found = [p for p in map(_phrase_of, re.findall(r'"[^"]*"|[^\s"]+', text)) if p]
    return Near(tuple(found), gap) if len(found) > 1 else found[0] if found else None


def parse_text(query: str) -> Node | None:
    """The tree of a text query, or None if it has no terms.

    Bare words must all occur; ``"a b"`` and words with inner punctuation are
    phrases; ``NEAR(a "b c", n)`` wants its phrases close together; AND, OR and
    NOT (upper case) and parentheses combine them, NOT before AND before OR.
    What cannot be read as syntax is read as words.
    """
    parts = [(m.group(0), m.group(1)) for m in _PART.finditer(query)]
    at = 0

    def peek() -> str | None:
        return parts[at][0] if at < len(parts) else None

    def join(left: Node | None, right: Node | None, how: type) -> Node | None:
        return how(left, right) if left and right else left or right

    def either() -> Node | None:
        nonlocal at
        left = both()
        while peek() == "OR":
            at += 1
            left = join(left, both(), Either)
        return left

    def both() -> Node | None:
        nonlocal at
        left = one()
        while peek() not in (None, "OR", ")"):
            negative = False
            while peek() in ("AND", "NOT"):
                negative |= peek() == "NOT"
                at += 1
            right = one()
            left = join(left, Without(right) if negative and right else right, Both)
        return left

    def one() -> Node | None:
        nonlocal at
        if peek() in (None, ")"):
            return None
        part, near = parts[at]
        at += 1
        if part == "(":
            inner = either()
            at += peek() == ")"
            return inner
        if part == "NOT":
            inner = one()
            return Without(inner) if inner else None
        return _phrase_of(part) if near is None else _near_of(near)

    found = None
    while at < len(parts):
        found = join(found, either(), Both)
        at += peek() == ")"
    return found


def evaluated(node: Node, leaf: Callable[[Phrase | Near], Any]) -> Any:
    """The tree with a value for each leaf, combined by &, | and ~."""
    if isinstance(node, (Phrase, Near)):
        return leaf(node)
    if isinstance(node, Without):
        return ~evaluated(node.inner, leaf)
    left, right = evaluated(node.left, leaf), evaluated(node.right, leaf)
    return left & right if isinstance(node, Both) else left | right


def words_of(node: Node) -> list[str]:
    """Distinct words of a tree, in order."""
    if isinstance(node, Phrase):
        found = list(node.words)
    elif isinstance(node, Near):
        found = [w for p in node.phrases for w in p.words]
    elif isinstance(node, Without):
        found = words_of(node.inner)
    else:
        found = words_of(node.left) + words_of(node.right)
    return list(dict.fromkeys(found))


def _moved(places: Column, back: int) -> Column:
    return F.transform(places, lambda p: p - back)


def _tagged(places: Column, which: int) -> Column:
    return F.transform(places, lambda at: F.struct(at.cast("int").alias("at"), F.lit(which).alias("which")))


def phrase_starts(phrase: Phrase, places: Callable[[str], Column]) -> Column:
    """Where a phrase begins, given the sorted positions of each word."""
    found = places(phrase.words[0])
    for k, word in enumerate(phrase.words[1:], 1):
        found = F.array_intersect(found, _moved(places(word), k))
    return found


def near_matches(near: Near, places: Callable[[str], Column]) -> Column:
    """Whether the phrases of NEAR occur in one window, by one pass over all their starts in order.

    After each start, the latest start of every phrase is known; a phrase of n
    words may begin n + gap tokens before it.
    """
    events = F.array_sort(F.flatten(F.array(*[_tagged(phrase_starts(p, places), k) for k, p in enumerate(near.phrases)])))
    never = -(1 << 31)
    begin = F.struct(*[F.lit(never).cast("int").alias(f"p{k}") for k in range(len(near.phrases))], F.lit(False).alias("hit"))

    def step(state: Column, event: Column) -> Column:
        last = [F.when(event["which"] == k, event["at"]).otherwise(state[f"p{k}"]) for k in range(len(near.phrases))]
        hit = state["hit"]
        inside = F.lit(True)
        for p, at in zip(near.phrases, last, strict=True):
            inside = inside & (at.cast("long") >= event["at"].cast("long") - len(p.words) - near.gap)
        return F.struct(*[at.alias(f"p{k}") for k, at in enumerate(last)], (hit | inside).alias("hit"))

    return F.aggregate(events, begin, step, lambda s: s["hit"])


#: An element between two texts of one token array, and how far positions leap over it.
BORDER, LEAP = "\0", 1 << 30


def positions(tokens_: Column, word: str) -> Column:
    """Sorted positions of a word in a token array, from 0; those beyond a border lie far from all others."""
    border = F.array_position(tokens_, BORDER)
    at = lambda k: k + F.when((border > 0) & (k >= border), LEAP).otherwise(0)
    return F.filter(F.transform(tokens_, lambda t, k: F.when(t == word, at(k))), lambda p: p.isNotNull())


def compile_text(query: str):
    """A predicate over a token array for the query, or None if it has no terms."""
    tree = parse_text(query)
    if tree is None:
        return None

    def match(t: Column) -> Column:
        def leaf(node: Phrase | Near) -> Column:
            if isinstance(node, Near):
                return near_matches(node, lambda word: positions(t, word))
            if len(node.words) == 1:
                return F.array_contains(t, node.words[0])
            return F.contains(F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")), F.lit(" " + " ".join(node.words) + " "))

        return evaluated(tree, leaf)

    return match


def terms_of(query: str) -> list[str]:
    """Distinct plain words of a query, in order, for ranking."""
    tree = parse_text(query)
    return words_of(tree) if tree else []


def snippet(content: Column, term: str, width: int = 150) -> Column:
    """Up to ``width`` characters from 50 before the first match, spaces collapsed, dots where cut."""
    text = F.coalesce(content, F.lit(""))
    found = F.instr(F.lower(text), F.lit(term.lower())) if term else F.lit(0)
    start = F.when(found > 1, F.greatest(found - 1 - 50, F.lit(0))).otherwise(F.lit(0))
    cut = F.substring(text, start + 1, F.lit(width))
    whole = F.concat(
        F.when(start > 0, F.lit("...")).otherwise(F.lit("")), cut,
        F.when(start + width < F.length(text), F.lit("...")).otherwise(F.lit("")),
    )
    return F.trim(F.regexp_replace(whole, r"\s+", " "))


#: Written words: as the tokens, with their marks and in their own case.
WRITTEN = r"[\u0300-\u036f]*[\p{L}\p{N}][\p{L}\p{N}\u0300-\u036f]*"


def best_window(content: Column, words: list[str], size: int = 24) -> Column:
    """(distinct, matches, text): the ``size`` tokens that hold most distinct words, then most matches, then come first.

    Windows begin at a match; the one taken is moved so that its first and last
    match lie in its middle, as far as the text reaches. Its written words are
    joined by spaces, with dots where more text precedes or follows. Meant for
    the rows of a page: the windows of a text are compared match by match.
    """
    own = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(WRITTEN), F.lit(0))
    listed = F.array(*[F.lit(w) for w in words])
    matches = F.filter(
        F.transform(tokens(content), lambda t, k: F.struct(k.cast("int").alias("at"), F.array_position(listed, t).cast("int").alias("which"))), lambda m: m["which"] > 0
    )
    inside = lambda first: F.filter(matches, lambda m: (m["at"] >= first["at"]) & (m["at"] < first["at"] + size))
    windows = F.transform(
        matches,
        lambda first: F.struct(
            F.size(F.array_distinct(F.transform(inside(first), lambda m: m["which"]))).alias("distinct"), F.size(inside(first)).alias("matches"),
            (-first["at"]).alias("before"), F.element_at(inside(first), -1)["at"].alias("last"),
        ),
    )
    best = F.array_max(windows)
    first, total = -best["before"], F.size(own)
    start = F.greatest(F.lit(0), F.least(first - F.floor((size - (best["last"] - first + 1)) / 2).cast("int"), total - size))
    text = F.concat(
        F.when(start > 0, "\u2026").otherwise(""), F.array_join(F.slice(own, start + 1, F.lit(size)), " "), F.when(start + size < total, "\u2026").otherwise("")
    )
    return F.when(F.size(matches) > 0, F.struct(best["distinct"].alias("distinct"), best["matches"].alias("matches"), text.alias("text")))


def best_snippet(columns: list[Column], words: list[str], size: int = 24) -> Column:
    """The best window of several texts of a row; the first of equals."""
    found = [best_window(c, words, size) for c in columns]
    out = found[0]
    score = lambda w: F.struct(w["distinct"], w["matches"])
    for other in found[1:]:
        out = F.when(out.isNull() | (score(other) > score(out)), other).otherwise(out)
    return out["text"]
