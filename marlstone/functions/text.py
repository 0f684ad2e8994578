"""Text and path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that queries leave out (fixed values).
STOP_WORDS = tuple(
    """the a an is are was were be been have has had do does did will would could should may might can shall to
    of in for on with at by from as into about like after before between and or but not no if then than
    what which who whom this that these how when where why all each every it its i me my we our you your
    he she they them his her their so just also very too more most some any other up out over only""".split()
)
#: Path parts that say nothing about a document (fixed values).
PATH_NOISE = ("src", "lib", "data", "docs", "test", "tests", "home", "users", "tmp", "index", "main", "init")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def plural_variants(term: Column) -> Column:
    """Other number of a term of more than three letters: -ies to -y, -s off (not -ss, -us), else -s on."""
    n = F.length(term)
    other = F.when(term.endswith("ies") & (n > 4), F.concat(F.substring(term, F.lit(1), n - 3), F.lit("y"))).when(term.endswith("s") & ~term.endswith("ss") & ~term.endswith("us"), F.substring(term, F.lit(1), n - 1)).otherwise(F.concat(term, F.lit("s")))
    return F.when(n > 3, F.array(other)).otherwise(F.array().cast("array<string>"))


def telling(terms: Column) -> Column:
    """Terms of three characters or more that are no stop words."""
    return F.filter(terms, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def expand_terms(terms: Column) -> Column:
    """Each term with its parts between ``_``, ``-`` and ``/``, then the other numbers of all those; telling ones, each once."""
    forms = lambda t: F.concat(F.array(t), F.filter(F.split(t, r"[_\-/]+"), lambda p: p != ""))
    every = lambda t: F.element_at(F.transform(F.array(forms(t)), lambda c: F.concat(c, F.flatten(F.transform(c, plural_variants)))), 1)
    return F.array_distinct(telling(F.flatten(F.transform(terms, every))))


def query_signals(text: Column) -> Column:
    """(domains, entities) of a query: its first five keywords, and the expanded ones of four characters or more."""
    words = telling(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9_/\-]+)")))
    return F.struct(F.slice(words, 1, 5).alias("domains"), F.filter(expand_terms(words), lambda w: F.length(w) >= 4).alias("entities"))


def signals(text: Column) -> Column:
    """Distinct telling terms, in order of first appearance."""
    return telling(F.array_distinct(tokens(text)))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(F.lower(F.translate(F.coalesce(path, F.lit("")), "\\", "/")), "/"), lambda p: p != "")


def filename_stem(path: Column) -> Column:
    """Last part of a path without its extension; empty for a path that ends in a slash."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.translate(path, "\\", "/")), r"([^/]*)$", 1), r"\.[^.]*$", "")


def path_tokens(path: Column) -> Column:
    """Distinct tokens of a path without noise parts, two characters at least."""
    return F.filter(F.array_distinct(tokens(path)), lambda w: (F.length(w) >= 2) & ~w.isin(*PATH_NOISE))


def normalise_source(path: Column) -> Column:
    """Key under which two spellings of a source are one: trimmed, slashes forward, lower case."""
    return F.lower(F.trim(F.translate(F.coalesce(path, F.lit("")), "\\", "/")))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least for a text that isn't empty."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def term_weight(term: Column) -> Column:
    """Longer terms weigh more: 1 + min(length, 16) / 8."""
    return 1 + F.least(F.length(term), F.lit(16)) / 8


def round6(x: Column) -> Column:
    """Half-even at six decimals, so that sums in any order compare equal."""
    return F.bround(x, 6)
