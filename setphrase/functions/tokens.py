"""Column expressions over token arrays: tokenisers, n-grams, candidate phrases, set algebra."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

VAR = "<VAR>"
PUNCT = r"—!-/:-@\[-`{-~"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: str | Column, ignorecase: bool = True) -> Column:
    """Runs of letters, digits and underscores."""
    text = F.lower(_col(text)) if ignorecase else _col(text)
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def blanks(text: str | Column, ignorecase: bool = False) -> Column:
    """Split at every single blank; empty tokens stay."""
    return F.split(F.lower(_col(text)) if ignorecase else _col(text), " ", -1)


def characters(text: str | Column) -> Column:
    """A bare string is a sequence of characters."""
    return F.filter(F.split(_col(text), ""), lambda c: c != "")


def sentences(text: str | Column) -> Column:
    return F.filter(F.split(_col(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def _starts(tokens: Column, width: int) -> Column:
    """Indexes 0 .. size - width; empty if the array is shorter."""
    last = F.size(tokens) - width
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def ngrams(tokens: str | Column, n: int) -> Column:
    """Contiguous n-grams in order."""
    tokens = _col(tokens)
    return F.transform(_starts(tokens, n), lambda i: F.slice(tokens, i + 1, n))


def skip_offsets(n: int, max_skips: int) -> list[tuple[int, ...]]:
    if n < 2:
        raise ValueError("n must be at least 2")
    return [(0, *rest) for rest in combinations(range(1, n + max_skips), n - 1)]


def skip_ngrams(tokens: str | Column, n: int, max_skips: int = 0) -> Column:
    """array<struct<start, terms>>: n-grams with a fixed first element and up to max_skips gaps, by start and offsets."""
    tokens = _col(tokens)
    offsets = F.array(*[F.array(*[F.lit(o) for o in group]) for group in skip_offsets(n, max_skips)])

    def at(start: Column) -> Column:
        fits = F.filter(offsets, lambda o: start + F.element_at(o, -1) < F.size(tokens))
        return F.transform(fits, lambda o: F.struct(start.alias("start"), F.transform(o, lambda k: F.get(tokens, start + k)).alias("terms")))

    return F.flatten(F.transform(_starts(tokens, n), at))


def rendered(terms: str | Column) -> Column:
    """Terms joined by blanks, open slots written as <VAR>."""
    return F.array_join(_col(terms), " ", VAR)


def candidate_list(phrase: str | Column) -> Column:
    return F.split(_col(phrase), " ", -1)


def laid_out(tokens: str | Column) -> Column:
    """A string of tokens (structs with n and char_index), each at its character index."""
    ordered = _col(tokens)
    pad = lambda acc, t: F.concat(F.rpad(acc, F.greatest(F.length(acc), t["char_index"]), " "), t["n"])
    return F.aggregate(ordered, F.lit(""), pad)


def variable_terms(terms: str | Column, span: str | Column) -> Column:
    """The document's tokens at the open slots of a phrase."""
    terms, span = _col(terms), _col(span)
    both = F.filter(F.transform(terms, lambda t, i: F.struct(t.alias("t"), F.get(span, i).alias("s"))), lambda x: x["t"].isNull() | (x["t"] == VAR))
    return F.transform(both, lambda x: x["s"])


def is_punct(s: str | Column) -> Column:
    return _col(s).rlike(f"^[{PUNCT}]*$")


def has_punct(s: str | Column) -> Column:
    return _col(s).rlike(f"[{PUNCT}]")


def is_multi_term(s: str | Column) -> Column:
    return F.trim(_col(s)).contains(" ")


def token_terms(s: str | Column) -> Column:
    return F.split(F.trim(_col(s)), r"\s+")


def slots_numbered(tokens: str | Column, selected: str | Column) -> Column:
    """Tokens outside the selection become <VAR-i>, i their index."""
    tokens, selected = _col(tokens), _col(selected)
    return F.transform(tokens, lambda w, i: F.when(F.array_contains(selected, w), w).otherwise(F.concat(F.lit("<VAR-"), i.cast("string"), F.lit(">"))))


def positions_of(tokens: str | Column, pattern: Sequence[str]) -> Column:
    """0-based starts of all (also overlapping) occurrences of a pattern."""
    tokens, want = _col(tokens), F.array(*[F.lit(p) for p in pattern])
    return F.filter(_starts(tokens, len(pattern)), lambda i: F.slice(tokens, i + 1, len(pattern)) == want)


def multiset_overlap(a: str | Column, b: str | Column) -> Column:
    """Elements of a in order, each as often as b holds it at most."""
    a, b = _col(a), _col(b)
    seen = lambda x, i: F.size(F.filter(F.slice(a, 1, i + 1), lambda y: y == x))
    return F.filter(a, lambda x, i: seen(x, i) <= F.size(F.filter(b, lambda y: y == x)))


def set_overlap(a: str | Column, b: str | Column) -> Column:
    """The distinct elements that both arrays hold, sorted."""
    return F.array_sort(F.array_intersect(_col(a), _col(b)))


def set_contains(a: str | Column, b: str | Column) -> Column:
    """Whether a holds every element of b, however often."""
    return F.size(F.array_except(_col(b), _col(a))) == 0


def set_equal(a: str | Column, b: str | Column) -> Column:
    return set_key(a) == set_key(b)


def set_key(ids: str | Column) -> Column:
    """The sorted distinct elements: equal for all orderings of a set."""
    return F.array_sort(F.array_distinct(_col(ids)))


def filled(phrase: str | Column, term: str | Column) -> Column:
    """The first slots of a phrase filled with a term's words, from the left."""
    put = lambda acc, w: F.when(acc.contains(VAR), F.concat(F.substring_index(acc, VAR, 1), w, F.substr(acc, F.locate(VAR, acc) + len(VAR)))).otherwise(acc)
    return F.aggregate(F.split(_col(term), " ", -1), _col(phrase), put)


def partial_overlap(p1: str | Column, p2: str | Column, min_overlap: int = 3) -> Column:
    """The shared phrase: an equal or contained one, else the longest run of words that ends one and starts the other; null if shorter than min_overlap."""
    p1, p2 = _col(p1), _col(p2)
    a, b = F.split(p1, " ", -1), F.split(p2, " ", -1)
    most = F.least(F.size(a), F.size(b))
    sizes = F.when(most >= min_overlap, F.sequence(most, F.lit(min_overlap), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    tail = lambda x, n: F.slice(x, F.size(x) - n + 1, n)
    hit = lambda n: F.when(tail(a, n) == F.slice(b, 1, n), F.array_join(tail(a, n), " ")).when(tail(b, n) == F.slice(a, 1, n), F.array_join(tail(b, n), " "))
    run = F.get(F.filter(F.transform(sizes, hit), lambda x: x.isNotNull()), F.lit(0))
    return F.when(p2.contains(p1), p1).when(p1.contains(p2), p2).otherwise(run)


def key_phrase(context: str | Column, keys: Sequence[str], direction: str) -> Column:
    """A context cut at its furthest key token: post keeps what leads up to the last, pre what follows the first; null without any."""
    if direction not in ("pre", "post"):
        raise ValueError('direction must be "pre" or "post"')
    tokens = F.split(_col(context), " ", -1)
    found = F.filter(F.array(*[F.array_position(tokens, F.lit(k)) for k in keys]), lambda i: i > 0)
    at = (F.array_max(found) if direction == "post" else F.array_min(found)).cast("int")
    part = F.slice(tokens, F.lit(1), at) if direction == "post" else F.slice(tokens, at, F.size(tokens) - at + 1)
    return F.when(at.isNotNull(), F.array_join(part, " "))
