"""Column functions: coordinates, distances, flags and sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base codes and complements.
BASES = "ACGT"
COMPLEMENTS = "TGCA"


def coordinate(text: Column) -> tuple[Column, Column, Column, Column]:
    """chromosome, start, end and midpoint of ``chr:start-end`` (commas allowed); null where it does not parse."""
    part = lambda i: F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"^([^:]+):([0-9]+)-([0-9]+)$", i)
    number = lambda i: F.nullif(part(i), F.lit("")).cast("long")
    return F.nullif(part(1), F.lit("")), number(2), number(3), (number(2) + number(3)) / 2


def distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance; null if any coordinate is null."""
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def chebyshev(a: list[Column], b: list[Column]) -> Column:
    return F.greatest(*[F.abs(x - y) for x, y in zip(a, b, strict=True)])


def is_on(state: Column, word: str = "on") -> Column:
    """1 if the state holds the word, null if unknown ('' or 'nan'), else 0."""
    return F.when(state.isNull() | state.isin("", "nan"), None).when(state.contains(word), 1).otherwise(0)


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, BASES, COMPLEMENTS))


def share_of(sequence: Column, letters: str = "GC") -> Column:
    """Share of the letters in a sequence; null if it is empty."""
    n = F.length(sequence)
    return F.try_divide((n - F.length(F.translate(sequence, letters, ""))).cast("double"), n.cast("double"))


def longest_run_below(sequence: Column, limit: int) -> Column:
    """Whether no base stands ``limit`` times or more in a row."""
    return ~sequence.rlike("|".join(f"{b}{{{limit},}}" for b in BASES))


def kmers(sequence: Column, k: int) -> Column:
    """All substrings of length k in order, as an array (empty if the sequence is shorter)."""
    # a substring is found by walking the string from its start, so it is cut into smaller and smaller pieces first
    def cut(s: Column, sizes: list[int]) -> Column:
        n = F.length(s) - k
        if not sizes:
            return F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(s, i + 1, F.lit(k)))
        size, rest = sizes[0], sizes[1:]
        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(n / size).cast("int")), lambda i: let(F.substring(s, i * size + 1, F.lit(size + k - 1)), lambda p: cut(p, rest))))

    none = F.array().cast("array<string>")
    return let(sequence, lambda s: F.when(F.length(s) < k, none).otherwise(cut(s, [1 << 18, 1 << 12, 64])))


def kmer_words(sequence: Column, k: int) -> Column:
    """The same substrings without an order (by their place modulo k), cut by one expression a remainder."""
    return let(sequence, lambda s: F.concat(*[F.regexp_extract_all(F.substring(s, i + 1, 1 << 30), F.lit(f"(?s).{{{k}}}"), 0) for i in range(k)]))


def kmer_code(word: Column) -> Column:
    """Base-4 code, A 0, C 1, G 2, T 3; other letters count as 0."""
    digit = lambda c: F.when(c == "C", 1).when(c == "G", 2).when(c == "T", 3).otherwise(0).cast("long")
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: a * 4 + digit(c))


def gaussian(parts: list[tuple[Column, Column, Column]]) -> Column:
    """exp(-1/2 sum of ((x - mean) / sigma)**2)."""
    return F.exp(-0.5 * sum((((x - m) / s) * ((x - m) / s) for x, m, s in parts), F.lit(0.0)))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def median_of(values: Column) -> Column:
    """The median of an array without nulls; null if it is empty."""
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return let(F.array_sort(values), middle)


def mean_of(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values).cast("double"))


def effect_of(a: Column, b: Column, middle) -> Column:
    """(middle(a) - middle(b)) / sqrt(spread a + spread b), a spread being the middle of the squared differences from the middle."""
    spread = lambda v, m: middle(F.transform(v, lambda x: (x - m) * (x - m)))
    both = F.struct(middle(a).alias("a"), middle(b).alias("b"))
    return let(both, lambda m: F.try_divide(m["a"] - m["b"], F.sqrt(spread(a, m["a"]) + spread(b, m["b"]))))


def ks_of(a: Column, b: Column) -> Column:
    """Greatest difference of the cdfs of two arrays, with the sign of median(a) - median(b)."""
    share = lambda v, t: F.size(F.filter(v, lambda x: x <= t)) / F.size(v)
    most = F.array_max(F.transform(F.array_distinct(F.concat(a, b)), lambda t: F.abs(share(a, t) - share(b, t))))
    return most * F.signum(median_of(a) - median_of(b))


def lookup(table: Column, key: Column, default: Column) -> Column:
    """The map's value of the key, or the default."""
    return F.coalesce(F.try_element_at(table, key), default)
