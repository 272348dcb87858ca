"""Secrets in text: known forms, and tokens that a battery of randomness tests singles out.

Known forms are assignments to secret names, access keys and long hexadecimal runs.  Other long tokens are tested.
The null hypothesis is a *structured* token (word, identifier, number) over the token's inferred encoding:

* chi-squared alphabet uniformity: the statistic is the index of coincidence (its linear function); a structured
  token repeats characters as a skewed alphabet does, a secret as a uniform one;
* runs: changes between letters, digits and marks are as many as chance has them for a secret, a third for structure;
* serial correlation: neighbouring codes of a secret are uncorrelated, of structure correlated by ``SERIAL`` or more.

Tokens are runs of the base64 characters, and runs of the base64url characters with ``-`` or ``_`` in them, as wholes and
by their base64 parts; of chosen tokens within each other the longest is the span.  Words can be joined by such marks, and
a token that slashes cut into three or more short segments may be a path, so the tests see both without the marks between
their segments.  A random identifier in groups, such as a UUID, counts as its digits.

The three normal scores are added (Stouffer).  False discoveries are held to ``ALPHA`` by the Benjamini-Hochberg step
over all tokens of the table, weighted by length: a longer token, whose tests have more power, gets a larger share.
P-values are rounded up to 1/20 of a decade, so the step needs one count per bin, a few hundred numbers.

Offsets are code points, an end is exclusive.  A span is the whole match.  Defined results: null text is the empty
text, without spans; equal rows give equal rows; without tested tokens no threshold is needed; texts are read whole;
spans of one start are ordered as the kinds are listed; input columns travel in the struct ``row``, so no name can
clash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodework.llm.common import whole_text
from lodework.llm.rules import let
from lodework.session import stage

# The known forms (kind, pattern, least length, which group has it), in order.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    ("access", r"AKIA[A-Z0-9]{14,}", 18, 0),  # as runs of any length of which the shorter are dropped
    ("hex", r"[0-9a-f]{16,}", 16, 0),
)
RANDOM = "random"
#: Shortest token that is tested; what a token consists of, with what is before it.
SHORTEST = 20
TOKEN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{%d,}={0,2}" % SHORTEST
URL_TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9]*[_-])[A-Za-z0-9_-]{%d,}={0,2}" % SHORTEST
PATH = r"^(?:[^/]*/){3}(?:[^/]{0,19}/)*[^/]{0,19}$"
#: Fewest characters that the tests are taken over.
TESTED = 8
#: (encoding, pattern, alphabet size, coincidence index of structured tokens), the first that fits; no index: no secret.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", 10, None),
    ("hex", r"^(?:[0-9A-F]+|[0-9a-f]+)$", 16, 0.125),
    ("base32", r"^[A-Z2-7]+=*$", 32, 0.09),
    ("base36", r"^(?:[a-z0-9]+|[A-Z0-9]+)$", 36, 0.08),
    ("letters", r"^[A-Za-z]+$", 52, 0.075),
    ("base64", r"", 64, 0.065),
)
SERIAL, ALPHA = 0.3, 0.01
#: Bins of -log10 p, 20 a decade, and the length from which on weights no longer grow.
BINS, PER_DECADE, LONG = 400, 20, 64
CHUNK = 256


def running(sizes: Column) -> Column:
    """For each of an array of integers the sum of those before it, in two levels of short arrays."""
    grow = lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v)
    total = lambda chunk: F.aggregate(chunk, F.lit(0).cast("bigint"), lambda a, v: a + v)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda c: F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK)))
    inner = lambda chunk, first: F.slice(F.aggregate(chunk, F.array(first), grow), 1, F.size(chunk))
    placed = let(chunks, lambda cs: let(F.aggregate(F.transform(cs, total), F.array(F.lit(0).cast("bigint")), grow),
                                        lambda starts: F.flatten(F.transform(cs, lambda chunk, i: inner(chunk, starts[i])))))
    return F.when(F.size(sizes) > 0, placed).otherwise(F.array().cast("array<bigint>"))


def located(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches, as structs of ``s``, ``e`` and the matched ``m``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")

    def place(matches: Column) -> Column:
        sizes = F.flatten(F.zip_with(gaps, matches, lambda g, m: F.array(F.length(g).cast("bigint"), F.coalesce(F.length(m), F.lit(0)).cast("bigint"))))
        return let(running_of(sizes), lambda at: F.transform(matches, lambda m, i: F.struct(at[2 * i + 1].alias("s"), (at[2 * i + 1] + F.length(m)).alias("e"), m.alias("m"))))

    return let(found, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(empty))


def running_of(sizes: Column) -> Column:
    return let(sizes, running)


def _known(text: Column, k: int) -> Column:
    """Spans of one known form; short matches are dropped after the search, as they take their characters with them."""
    _, pattern, least, group = KINDS[k]
    if group:
        found = F.filter(located(text, pattern), lambda x: F.length(F.regexp_extract(x.m, pattern, group)) >= least)
    else:
        found = F.filter(located(text, pattern), lambda x: F.length(x.m) >= least)
    return F.transform(found, lambda x: F.struct(x.s.alias("s"), F.lit(k).alias("k"), x.e.alias("e")))


def known_spans(text: Column) -> Column:
    """Known forms as sorted structs of ``s``, ``k`` (number of the kind) and ``e``."""
    return F.array_sort(F.concat(*[_known(text, k) for k in range(len(KINDS))]))


def upper_tail(z: Column) -> Column:
    """Share of a normal distribution above ``z``, within about a hundredth of itself."""
    a = F.greatest(F.abs(z), F.lit(1e-6))
    tail = (1 - F.exp(-1.4 * a)) * F.exp(-a * a / 2) / (1.135 * 2.5066282746310002 * a)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def pairs_of(values: Column, value: Column | int) -> Column:
    """Ordered pairs of places that have this value."""
    return let(F.size(F.filter(values, lambda x: x == value)).cast("double"), lambda o: o * (o - 1))


def score(token: Column) -> Column:
    """Sum of the three tests' scores for a token, null if its encoding is no secret's."""
    coincidence = F.lit(None).cast("double")
    for _, pattern, _, index in reversed(ENCODINGS):
        coincidence = F.when(token.rlike(pattern), F.lit(index).cast("double")).otherwise(coincidence) if pattern else F.lit(index)
    body = F.regexp_replace(token, "=+$", "")

    def tests(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        pairs = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + pairs_of(chars, c))
        kappa = coincidence
        spread = F.sqrt(2 * kappa * (1 - kappa) / (n * (n - 1)) + 1.6 * kappa * kappa / n)
        uniform = (kappa - pairs / (n * (n - 1))) / spread

        kinds = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 0).when(c.rlike("[A-Za-z]"), 1).otherwise(2))

        def runs(ks: Column) -> Column:
            same = pairs_of(ks, 0) + pairs_of(ks, 1) + pairs_of(ks, 2)
            expected = (1 - same / (n * (n - 1))) / 3
            changes = F.size(F.filter(F.zip_with(ks, F.slice(ks, 2, F.size(ks)), lambda a, b: a != b), lambda x: x)).cast("double")
            return F.when(expected > 0, (changes - (n - 1) * expected) / F.sqrt((n - 1) * expected * (1 - expected))).otherwise(0.0)

        codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))

        def serial(cs: Column) -> Column:
            mean = F.aggregate(cs, F.lit(0.0), lambda a, v: a + v) / n

            def ratio(d: Column) -> Column:
                power = F.aggregate(d, F.lit(0.0), lambda a, v: a + v * v)
                lagged = F.aggregate(F.zip_with(d, F.slice(d, 2, F.size(d)), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
                r = F.when(power > 0, F.least(F.abs(lagged / power), F.lit(0.999999))).otherwise(0.999999)
                return (F.atanh(F.lit(SERIAL)) - F.atanh(r)) * F.sqrt(n - 3)

            return let(mean, lambda m: let(F.transform(cs, lambda v: v - m), ratio))

        return (uniform + let(kinds, runs) + let(codes, serial)) / F.sqrt(F.lit(3.0))

    return F.when(coincidence.isNotNull(), let(F.split(body, ""), tests))


def tested_tokens(text: Column, known: Column) -> Column:
    """Tokens outside the known spans with a score: structs of ``s``, ``e``, ``z``."""
    free = F.filter(F.concat(located(text, TOKEN), located(text, URL_TOKEN)),
                    lambda x: ~x.m.rlike("^[0-9a-f]+$") & ~F.exists(known, lambda b: (b.s < x.e) & (b.e > x.s)))
    judged = F.transform(free, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), F.when(x.m.rlike(PATH) | x.m.rlike("[_-]"), F.translate(x.m, "/_-", "")).otherwise(x.m).alias("m")))
    long = F.filter(judged, lambda x: F.length(F.regexp_replace(x.m, "=+$", "")) >= TESTED)
    return F.filter(F.transform(long, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), score(x.m).alias("z"))), lambda x: x.z.isNotNull())


def _bin(z: Column, length: Column, mean: float) -> Column:
    """Bin of a weighted p-value, rounded so that the p-value is never understated."""
    p = upper_tail(z) * mean / F.least(length, F.lit(LONG))
    return F.greatest(F.least(F.floor(-PER_DECADE * F.log10(F.greatest(p, F.lit(1e-300)))), F.lit(BINS)), F.lit(0)).cast("int")


def threshold(tokens: DataFrame, alpha: float = ALPHA) -> tuple[float, int]:
    """(mean weight, least bin that is a discovery) for tokens ``s``, ``e``, ``z``; numbers per bin come to the driver."""
    length = F.col("e") - F.col("s")
    mean = tokens.agg(F.avg(F.least(length, F.lit(LONG))).alias("mean")).first().mean
    if mean is None:
        return 1.0, BINS + 1
    counts = {r.bin: r.n for r in tokens.groupBy(_bin(F.col("z"), length, mean).alias("bin")).agg(F.count("*").alias("n")).collect()}
    total, above, least = sum(counts.values()), 0, BINS + 1
    for b in sorted(counts, reverse=True):
        above += counts[b]
        if 10 ** (-b / PER_DECADE) <= alpha * above / total:
            least = b
    return mean, least


def scan(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA, keep: tuple[str, ...] | None = None) -> DataFrame:
    """A row per document: its columns (those in ``keep``, else all) in the struct ``row``, ``known`` and ``spans``, both
    sorted arrays of structs ``s``, ``k``, ``e`` where ``k`` numbers the kinds, the tested ones last."""
    row = F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row")
    text = whole_text(docs, text_col)
    found = docs.select(row, text.alias("text"), known_spans(text).alias("known"))
    found = stage(found.select("row", "known", tested_tokens(F.col("text"), F.col("known")).alias("tokens")), "secrets-found")
    mean, least = threshold(found.select(F.explode("tokens").alias("t")).select("t.*"), alpha)
    found_ones = F.filter("tokens", lambda t: _bin(t.z, t.e - t.s, mean) >= least)
    chosen = let(found_ones, lambda c: F.filter(c, lambda t: ~F.exists(c, lambda o: (o.s <= t.s) & (o.e >= t.e) & (o.e - o.s > t.e - t.s))))
    more = F.transform(chosen, lambda t: F.struct(t.s.alias("s"), F.lit(len(KINDS)).alias("k"), t.e.alias("e")))
    return found.select("row", "known", F.array_sort(F.concat("known", more)).alias("spans"))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit(RANDOM))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x.k], x.s.cast("string"), x.e.cast("string"))), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """Counts by known kind, the digest of the known spans, and all spans as text, one row per document."""
    found = scan(docs, text_col, alpha, keep=(id_col,))
    of_kind = lambda k: F.size(F.filter("known", lambda x: x.k == k)).cast("bigint")
    counts = [of_kind(k).alias(f"n_{kind[0]}") for k, kind in enumerate(KINDS)]
    n_random = (F.size("spans") - F.size("known")).cast("bigint").alias("n_random")
    return found.select(F.col("row")[id_col].alias("doc_id"), *counts, F.sha2(as_text(F.col("known")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), n_random)


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by ``mask``."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = lambda a, b: text.substr((a + 1).cast("int"), (b - a).cast("int"))

    def add(acc: Column, x: Column) -> Column:
        parts = F.when(x.s >= acc.at, F.concat(acc.parts, F.array(cut(acc.at, x.s), F.lit(mask)))).otherwise(acc.parts)
        return F.struct(F.greatest(acc.at, x.e).alias("at"), parts.alias("parts"))

    whole = let(F.aggregate(spans, start, add), lambda acc: F.concat(F.array_join(acc.parts, ""), cut(acc.at, F.length(text).cast("bigint"))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
