"""Line-first quality rules in built-in functions only: no Python, no shuffle, no state.

Each line is judged by rules on its punctuation (symbols, a long line without any mark), on
navigation (pipes and bullets; runs of short lines that end in no mark, as menus of one item a line
have) and on boilerplate (phrases, as many as the line's length asks for; shouting; few letters; one
word again and again). Failing lines are removed; a document is rejected when the base rules fail or
when too large a share of its characters was removed. ``Rules`` holds every threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, unused

#: White space that separates words.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[^#*$%&|<>]+"
#: Lines with one of these phrases are boilerplate (fixed values); each phrase holds one of the keys, so a text without one needs no search.
PHRASE_KEYS = ["rights reserved", "licensed under", "terms of", "privacy policy", "cookie", "sign in", "sign up", "log in", "login", "subscribe", "newsletter", "click here", "read more", "share this", "javascript"]
BOILERPLATE = r"(?i)\b(all rights reserved|licensed under|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies|sign (in|up)|log ?in|subscribe|newsletter|click here|read more|share this|javascript)\b"
#: Marks that end a sentence or a line, and marks that stand in one (fixed values).
ENDS = ".!?…:;。！？؟।\"»”’')]"
BLANKS = " \t\n\x0b\x0c\r"
MARKED = r"[.,!?…:;。、，！？؟।\"»”’')\]]"
WINDOW = 8
MIN_WORDS = 20


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules, and the share of characters in failing lines that a document may lose."""

    max_lost: float = 0.5
    #: A line fails if one character in so many or more is a symbol, or a pipe or bullet.
    symbol_in: int = 20
    pipe_in: int = 40
    #: From so many letters on (characters for the second), a line of mostly capitals (hardly any letters) fails.
    least_letters: int = 12
    #: A line fails from so many words on if fewer than one in ``few_in`` differ, or if it holds no mark at all.
    few_words: int = 8
    few_in: int = 4
    unmarked_words: int = 25
    #: A line fails if it holds a boilerplate phrase for each so many characters.
    phrase_chars: int = 200
    #: Lines of at most so many words without an end mark fail in runs of three or more.
    menu_words: int = 4


RULES = Rules()


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words covered by the windows of eight words that occur twice or more.

    Windows are hashed once each. Only if two hashes are equal are (hash, place) pairs sorted, so
    that equal windows become neighbours; the places of those are sorted again and the lengths of
    their union summed: O(n log n) for a document of n words, also where all windows are equal.
    """
    places = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["x"] == F.get(s, b)["x"], F.lit(False))
        marks = F.transform(s, lambda e, k: F.when(same(k - 1, k) | same(k, k + 1), e["i"]))
        return F.array_sort(F.filter(marks, lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(places(h), repeated), covered))

    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return let(words, lambda w: F.when(F.size(w) >= WINDOW, let(hashes(w), count)).otherwise(F.lit(0).cast("long")))


def line_fails(line: Column, phrases: Column, rules: Rules = RULES) -> Column:
    """Whether a line of words fails by itself; ``phrases`` says if boilerplate has to be looked for."""
    chars = F.length(line)
    symbols = chars - F.length(F.regexp_replace(line, r"[#*$%&|<>~^_=+]+", ""))
    pipes = chars - F.length(F.regexp_replace(line, r"[|>»•·]+", ""))
    letters = F.length(F.regexp_replace(line, r"\P{L}+", ""))
    upper = F.length(F.regexp_replace(line, r"\P{Lu}+", ""))
    found = F.size(F.regexp_extract_all(line, F.lit(BOILERPLATE), F.lit(0)))

    def monotone(w: Column) -> Column:
        return ((F.size(w) >= rules.few_words) & (F.size(F.array_distinct(w)) * rules.few_in < F.size(w))) | ((F.size(w) >= rules.unmarked_words) & ~line.rlike(MARKED))

    return (
        F.coalesce((symbols * rules.symbol_in > chars), F.lit(False))
        | (pipes * rules.pipe_in > chars)
        | let(letters, lambda n: ((n * 2 < chars) & (chars >= rules.least_letters)) | ((n >= rules.least_letters) & (upper * 2 > n)))
        | (phrases & let(found, lambda n: (n > 0) & (n * rules.phrase_chars >= chars)))
        | let(F.split(line, SPACE + "+"), monotone)
    )


def clean_lines(text: Column, rules: Rules = RULES) -> Column:
    """The text without failing lines; lines without a word stay as they are, and end a run of short lines."""
    bare = lambda x: F.length(F.trim(x, F.lit(BLANKS))) == 0
    ended = lambda x: F.contains(F.lit(ENDS), F.right(F.rtrim(x, F.lit(BLANKS)), F.lit(1)))
    item = lambda x: ~ended(x) & (F.size(words_of(x)) <= rules.menu_words)
    low = lambda t: let(F.lower(t), lambda x: F.exists(F.array(*map(F.lit, PHRASE_KEYS)), lambda k: F.contains(x, k)))

    def judged(x: Column, phrases: Column) -> Column:
        no = F.lit(False)
        return F.when(bare(x), F.struct(no.alias("fails"), no.alias("item"))).otherwise(F.struct(line_fails(x, phrases, rules).alias("fails"), item(x).alias("item")))

    def rest(lines: Column, found: Column) -> Column:
        at = lambda i: F.coalesce(F.get(found, i)["item"], F.lit(False))
        menu = lambda i: at(i) & ((at(i - 1) & at(i - 2)) | (at(i - 1) & at(i + 1)) | (at(i + 1) & at(i + 2)))
        return F.array_join(F.filter(lines, lambda x, i: ~F.get(found, i)["fails"] & ~menu(i)), "\n")

    return let(F.struct(F.split(text, "\n").alias("a"), low(text).alias("p")), lambda s: let(F.transform(s["a"], lambda x: judged(x, s["p"])), lambda found: rest(s["a"], found)))


def quality_rules(docs: DataFrame, text: str = "text", rules: Rules = RULES) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``clean_text``, ``lost_share`` and ``kept``.

    A null text counts as empty: no words, so it fails the base rules. Texts of any length are judged
    whole, repeated rows each on their own. An empty table gives an empty result; columns named like
    a result column are replaced, others pass through. Windows of words are compared by 64-bit hashes.
    """
    both = unused(docs, "words")[0]
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rest = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "lost_share", "kept")]
    found = docs.select(
        *rest,
        let(words_of(raw), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))).alias(both),
        F.length(F.regexp_replace(raw, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(raw, SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        clean_lines(raw, rules).alias("clean_text"),
    )
    n, r = F.col(both)["n"], F.col(both)["r"]
    failed = (n < MIN_WORDS) | (100 * r > 30 * n)
    lost = F.when(F.col("word_chars") == 0, F.lit(1.0)).otherwise(1 - F.length(F.regexp_replace("clean_text", SPACE + "+", "")) / F.col("word_chars"))
    return found.select(
        *rest, n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"),
        failed.alias("base_failed"), "clean_text", lost.alias("lost_share"), (~failed & (lost <= rules.max_lost)).alias("kept"),
    )
