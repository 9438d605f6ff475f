"""Secrets in texts: known forms, and passages of high entropy.

Known forms (``assign``, ``access``, ``hex``) are patterns. Beside them, strings of key-like
characters are candidates, and a window of ``WINDOW`` characters slides over each. The window keeps a count
for each character of the alphabet and one for each class (digits, letters a-f and g-z of either case, signs);
a step adds the character that enters and removes the one that leaves, and changes the window's sum of
``c * log2(c)`` by the difference of these two counts alone. Entropy is ``log2(WINDOW)`` less that sum over
``WINDOW``. A window is suspicious if its entropy reaches the threshold of its class (hexadecimal, letters and digits,
or all signs) and it holds digits and letters. Suspicious windows that touch an allow-listed passage (identifiers of
standard form, placeholders, alphabets in order) do not count; the others are joined to spans of kind
``entropy``, given where no known form covers them.

Sums are whole numbers of 2**-30 bits, so adding and removing are exact and a window's
value hangs on its characters alone. DataFrame functions only, no shuffle: a text is scanned within its row, and a
candidate in blocks of 64 windows whose marks are the bits of one number.

Defined cases: null text is empty and has no spans; positions are code points, ends exclusive; rows with the
same or no doc_id are separate; a table without rows gives none; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 24
#: Bits of entropy from which a window of a class is suspicious.
HEX_BITS, ALNUM_BITS, SIGNS_BITS = 3.0, 3.8, 3.9
#: Digits a suspicious window holds at least.
DIGITS = 2

# The patterns of the known forms. Runs are maximal, so the least length can stand in the pattern, but for
# assignments, where a failing match takes its characters with it.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Characters of candidates, class by class: digits, a-f, g-z, A-F, G-Z, signs.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_=-")
ALPHABET = "".join(CLASSES)
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Passages that look random but are none: UUIDs, digests of published files, placeholders, alphabets in order.
ALLOWED = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"sha(?:256|384|512)-[A-Za-z0-9+/]+=*",
    r"(?i)example|changeme|placeholder|dummy|x{6,}|abcdefgh|0123456789",
)

SPAN = "struct<start: int, rank: int, end: int>"
_UNIT = 1 << 30
_BLOCK = 64
_PREFIX = 128
#: Counts of up to 31 lie side by side in 64-bit numbers, those of a class in numbers of their own.
_BITS = 5
_COUNTS = 12


def _scaled(x: float) -> int:
    return round(x * _UNIT)


#: What one more of a character that stands ``c`` times in the window adds to the sum of ``c * log2(c)``, in units.
STEPS = [_scaled((c + 1) * math.log2(c + 1)) - (_scaled(c * math.log2(c)) if c else 0) for c in range(WINDOW)]


def most_sum(bits: float) -> int:
    """The largest sum of ``c * log2(c)`` with which a window has the given entropy."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * _UNIT)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(values: Column, together: Callable[[Column, Column], Column]) -> Column:
    """All earlier entries put together, for each entry (0 for the first); parts of ``_PREFIX`` entries keep it from being quadratic."""
    total = lambda xs: F.reduce(xs, F.lit(0), together)
    parts = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _PREFIX).cast("int")), lambda p: F.slice(xs, p * _PREFIX + 1, _PREFIX))

    def within(parts: Column) -> Column:
        totals = F.transform(parts, total)
        return let(totals, lambda s: F.flatten(F.transform(parts, lambda part, i: let(total(F.slice(s, F.lit(1), i)), lambda first: F.transform(part, lambda _, j: together(first, total(F.slice(part, F.lit(1), j))))))))

    return let(values, lambda xs: F.when(F.size(xs) > 0, let(parts(xs), within)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str) -> Column:
    """Start and string of the leftmost matches that do not overlap, in order."""

    def placed(found: Column) -> Column:
        # what stands between the matches, and the matches, make the text
        between = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
        steps = lambda gaps: let(
            before(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: g + F.char_length(m)), lambda a, x: a + x),
            lambda sums: F.transform(found, lambda m, k: F.struct((F.get(sums, k) + F.get(gaps, k)).alias("start"), m.alias("found"))),
        )
        return F.when(F.size(found) > 0, let(between, steps)).otherwise(F.array().cast("array<struct<start: int, found: string>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def span(start: Column, rank: int, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"))


def known(text: Column) -> list[Column]:
    """Spans of each known form."""
    assigned = F.filter(matches(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m.found, ASSIGN, 1)) >= ASSIGN_LEAST)

    def spans(form: Column, rank: int) -> Column:
        return F.transform(form, lambda m: span(m.start, rank, m.start + F.char_length(m.found)))

    return [spans(form, rank) for rank, form in enumerate((assigned, matches(text, ACCESS), matches(text, HEX)))]


def _places() -> list[tuple[int, int]]:
    """For each character of the alphabet where its count is kept (64 times the number, plus the bit) and where that of its class is."""
    places, numbers = [], 0
    for i, letters in enumerate(CLASSES):
        for k in range(len(letters)):
            places.append((64 * (numbers + k // _COUNTS) + _BITS * (k % _COUNTS), _BITS * i))
        numbers += -(-len(letters) // _COUNTS)
    return places


def _at(counts: Column, bit: Column | int) -> Column:
    """The count that begins at a bit of a number (a shift takes its distance modulo 64)."""
    return F.call_function("shiftrightunsigned", counts, F.lit(bit) if isinstance(bit, int) else bit).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def suspicious(total: Column, kinds: Column) -> Column:
    """Whether a window with this sum of ``c * log2(c)`` and these counts of the classes is a finding."""
    digits, low_hex, low, high_hex, high, signs = (_at(kinds, _BITS * i) for i in range(len(CLASSES)))
    hexadecimal = (low + high + signs == 0) & ((low_hex == 0) | (high_hex == 0))
    most = F.when(hexadecimal, F.lit(most_sum(HEX_BITS))).when(signs == 0, F.lit(most_sum(ALNUM_BITS))).otherwise(F.lit(most_sum(SIGNS_BITS)))
    return (total <= most) & (digits >= DIGITS) & (digits + signs < WINDOW)


def _marks(letters: Column) -> Column:
    """A bit for each suspicious window over some characters (at most ``_BLOCK`` windows), the first the lowest."""
    steps = F.array(*[F.lit(s).cast("long") for s in STEPS])
    none = F.lit(0).cast("long")
    numbers = sum(-(-len(c) // _COUNTS) for c in CLASSES)
    start = F.struct(F.array_repeat(none, numbers).alias("counts"), none.alias("kinds"), none.alias("total"), F.lit(0).alias("at"), none.alias("marks"))

    def moved(s: Column, letter: Column, by: int) -> Column:
        """The window with one character more (``by`` 1) or less (-1)."""
        number = F.shiftright(letter["place"], 6)
        counts = F.concat(F.slice(s.counts, F.lit(1), number), F.array(F.get(s.counts, number) + by * _one(letter["place"])), F.slice(s.counts, number + 2, numbers))
        step = F.get(steps, _at(F.get(s.counts, number), letter["place"]) - (0 if by > 0 else 1))
        total = (s.total + step) if by > 0 else (s.total - step)
        kinds = s.kinds + by * _one(letter["kind"])
        return F.struct(counts.alias("counts"), kinds.alias("kinds"), total.alias("total"), (s.at + max(by, 0)).alias("at"), s.marks.alias("marks"))

    def marked(s: Column) -> Column:
        marks = F.when((s.at >= WINDOW) & suspicious(s.total, s.kinds), s.marks.bitwiseOR(_one(s.at - WINDOW))).otherwise(s.marks)
        return F.struct(s.counts.alias("counts"), s.kinds.alias("kinds"), s.total.alias("total"), s.at.alias("at"), marks.alias("marks"))

    def step(s: Column, letter: Column) -> Column:
        left = F.when(s.at >= WINDOW, moved(s, F.get(letters, s.at - WINDOW), -1)).otherwise(s)
        return let(let(left, lambda x: moved(x, letter, 1)), marked)

    return F.reduce(letters, start, step, lambda s: s.marks)


def windows(candidate: Column) -> Column:
    """Starts of the suspicious windows of a candidate, in order."""
    places = F.array(*[F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind")) for place, kind in _places()])
    letters = F.transform(F.split(candidate, ""), lambda c: F.get(places, F.instr(F.lit(ALPHABET), c) - 1))

    def of(letters: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(letters) - WINDOW) / _BLOCK).cast("int"))
        marked = lambda b: let(
            let(F.slice(letters, b * _BLOCK + 1, _BLOCK + WINDOW - 1), _marks),
            lambda bits: F.transform(F.filter(F.sequence(F.lit(0), F.lit(_BLOCK - 1)), lambda k: F.getbit(bits, k) == 1), lambda k: b * _BLOCK + k),
        )
        return F.flatten(F.transform(blocks, marked))

    return let(letters, of)


def entropy_spans(text: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Maximal spans of suspicious windows of all candidates."""
    listed = "|".join(f"(?:{p})" for p in allowed)

    def clear(candidate: Column) -> Column:
        found = windows(candidate)
        if not allowed:
            return found
        return let(matches(candidate, listed), lambda a: F.filter(found, lambda w: ~F.exists(a, lambda m: (m.start < w + WINDOW) & (m.start + F.char_length(m.found) > w))))

    def joined(offset: Column, starts: Column) -> Column:
        # a window that begins after the end of the one before it begins a span
        first = F.filter(starts, lambda w, i: (i == 0) | (w > F.get(starts, i - 1) + WINDOW))
        last = F.filter(starts, lambda w, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) > w + WINDOW))
        return F.zip_with(first, last, lambda a, b: span(offset + a, 3, offset + b + WINDOW))

    return F.flatten(F.transform(matches(text, CANDIDATE), lambda m: let(clear(m.found), lambda starts: joined(m.start, starts))))


def find(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``doc_id, text, base, spans`` of every row: spans of the known forms, and those with the further ones of high entropy.

    Both are in order of start, then kind (``rank``, a place in ``KINDS``).
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("base", F.array_sort(F.concat(*known(F.col("text")))))
    found = F.array_sort(F.concat("base", entropy_spans(F.col("text"), allowed)))
    # how far the known forms that begin no later reach; at the same start they come first
    reach = lambda spans: before(F.transform(spans, lambda s: F.when(s.rank < 3, s.end).otherwise(0)), lambda a, x: F.greatest(a, x))
    uncovered = lambda spans: let(reach(spans), lambda ends: F.filter(spans, lambda s, i: (s.rank < 3) | (F.get(ends, i) < s.end)))
    return rows.withColumn("spans", let(found, uncovered))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    kind = lambda s: F.get(F.array(*map(F.lit, KINDS)), s.rank)
    return F.array_join(F.transform(spans, lambda s: F.concat(kind(s), F.lit(":"), s.start.cast("string"), F.lit(":"), s.end.cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts and a digest of the known forms, and all spans, of every row."""

    def many(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s.rank == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    return find(docs).select("doc_id", *map(many, range(3)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
