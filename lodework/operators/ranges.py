"""Containment, prefix, band and overlap joins as plain equi-joins.

An integer range [lo, hi] is the disjoint union of at most two aligned blocks per power
of two.  A point lies in exactly one aligned block per size.  Joining points with the
blocks of ranges on (size, block number) therefore gives every matching pair once and no
false candidates: the work follows the size of the answer, whatever the skew of the data.
Adaptive execution splits a block that holds much of the point side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodework.session import stage

MAX_LEVEL = 62
#: Right rows of a key that every left row of the key is held against.
FEW = 64
#: Addresses of a block, and networks of a block, that meet as one row.
PAGE = 256


def range_blocks(lo: Column, hi: Column, max_level: int = MAX_LEVEL) -> Column:
    """array<struct<level, block>> of the aligned blocks that make up [lo, hi]; empty if hi < lo."""

    def at_level(k: Column) -> Column:
        left = -F.call_function("shiftright", -lo, k)          # ceil(lo / 2^k)
        right = F.call_function("shiftright", hi + 1, k)       # floor((hi + 1) / 2^k)
        inside = left < right
        return F.array(
            F.when(inside & (F.pmod(left, F.lit(2)) == 1), F.struct(k.alias("level"), left.alias("block"))),
            F.when(inside & (F.pmod(right, F.lit(2)) == 1), F.struct(k.alias("level"), (right - 1).alias("block"))))

    # no block is larger than the range; one spare level covers rounding of the logarithm
    top = F.least(F.floor(F.log2((hi - lo + 1).cast("double"))).cast("int") + 1, F.lit(max_level))
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top), at_level)), lambda b: b.isNotNull())


def _filed(ranges: DataFrame, lo: str, hi: str, by: list[str], max_level: int) -> tuple[DataFrame, list[int]]:
    """The ranges beside each block ``_rb`` of level ``_rl`` they are made of, ``by`` renamed; the levels in use, at most 63."""
    cut = ranges.withColumn("_b", F.explode(range_blocks(F.col(lo).cast("long"), F.col(hi).cast("long"), max_level)))
    cut = cut.select(*[F.col(c).alias(f"_by_{c}") if c in by else F.col(c) for c in ranges.columns],
                     F.col("_b.level").alias("_rl"), F.col("_b.block").alias("_rb"))
    return cut, sorted(r[0] for r in cut.select("_rl").distinct().collect())


def range_join(points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str,
               by: list[str] | None = None, how: str = "inner", max_level: int = MAX_LEVEL) -> DataFrame:
    """Pairs with ``lo <= point <= hi`` (integer columns) and equal ``by`` columns.

    ``how`` is inner, or left_semi / left_anti on the points.  The ranges may carry other names for
    ``by``: columns must be named alike on both sides; the right copy is dropped.
    """
    by = by or []
    cut, levels = _filed(ranges, lo, hi, by, max_level)
    spread = points.withColumn("_p", F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"), F.shiftright(F.col(point).cast("long"), k).alias("block"))
        for k in levels]) if levels else F.expr("array()"))) if how == "inner" else None
    if how == "inner":
        if not levels:
            return points.join(ranges.drop(*by), F.lit(False))
        spread = spread.select(*points.columns, F.col("_p.level").alias("_pl"), F.col("_p.block").alias("_pb"))
        on = (F.col("_pl") == F.col("_rl")) & (F.col("_pb") == F.col("_rb"))
        for c in by:
            on = on & (F.col(c) == F.col(f"_by_{c}"))
        return spread.join(cut, on).drop("_pl", "_pb", "_rl", "_rb", *[f"_by_{c}" for c in by])
    hits = range_join(points.select(point, *by).distinct(), ranges.select(lo, hi, *by), point, lo, hi, by,
                      "inner", max_level).select(point, *by).distinct()
    return points.join(hits, [point, *by], how)


def address_number(text: Column) -> Column:
    """Dotted IPv4 text as an integer; NULL when it is not one."""
    parts = F.split(text, r"\.")
    ok = text.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.|$)){4}$") & ~text.endswith(".")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + F.try_to_number(x, F.lit("999")).cast("long"))
    return F.when(ok, number)


def cidr_bounds(cidr: Column) -> Column:
    """struct(lo, hi) of an IPv4 network or single address text."""
    base = address_number(F.split_part(cidr, F.lit("/"), F.lit(1)))
    bits = F.coalesce(F.regexp_extract(cidr, r"/(\d+)$", 1).try_cast("int"), F.lit(32))
    base = F.when(bits <= 32, base)
    bits = F.least(bits, F.lit(32))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - bits)
    lo = base - F.pmod(base, size)
    return F.struct(lo.alias("lo"), (lo + size - 1).alias("hi"))


def _pages(rows: DataFrame, columns: list[str], out: str, levels: list[int] | None = None) -> DataFrame:
    """(level, block, ``out``): rows of a task that lie in one block, at most ``PAGE`` together; nothing is shuffled.

    ``rows`` are ``columns`` followed by level and block or, with ``levels``, by a number that lies in a block of each.
    """
    width, size = len(columns), PAGE

    def pack(batches):
        for batch in batches:
            fields = [batch.schema.field(i) for i in range(width)]
            held = pa.StructArray.from_arrays([batch.column(i) for i in range(width)], fields=fields)
            kind = pa.list_(pa.field("element", held.type, nullable=False))
            last = batch.column(batch.num_columns - 1).to_numpy()
            filed = [(batch.column(width).to_numpy(), last)] if levels is None else [(np.full(len(last), k), last >> k) for k in levels]
            for level, block in filed if len(last) else ():
                new = np.flatnonzero((np.diff(level) != 0) | (np.diff(block) != 0)) + 1
                starts = np.union1d(new, np.arange(0, len(last), size))
                ends = pa.array(np.append(starts, len(last)), pa.int32())
                pages = pa.ListArray.from_arrays(ends, held, type=kind)
                yield pa.RecordBatch.from_arrays([pa.array(level[starts], pa.int32()), pa.array(block[starts], pa.int64()), pages], ["level", "block", out])

    schema = T.StructType().add("level", "integer").add("block", "long").add(out, T.ArrayType(rows.select(*columns).schema, containsNull=False))
    return rows.sortWithinPartitions(*rows.columns[width:]).mapInArrow(pack, schema)


def cidr_join(addresses: DataFrame, networks: DataFrame, address: str = "ip", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(address row, network row) for each address inside a network, given as integers.

    A crowded block gives as many rows as its addresses times its networks.  They are therefore joined page by page, and
    the rows of two pages follow each other: an address comes in a run, the networks of the page come again with the next
    address.  However many a block has, files then hold a row in a fraction of its bytes.
    """
    cut, levels = _filed(networks, lo, hi, [], 32)
    if not levels:
        return addresses.join(networks, F.lit(False))
    placed = addresses.withColumn("_at", F.col(address).cast("long")).where("_at IS NOT NULL")
    # the networks of a block in few pages; the number lets a crowded block span several tasks
    cut = cut.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("_rl", "_rb", "_tie").drop("_tie")
    met = _pages(placed, addresses.columns, "_addresses", levels).join(_pages(cut, networks.columns, "_networks"), ["level", "block"])
    # a function that is not compiled takes addresses one by one: compiled loops keep all rows they make of a row
    one_by_one = F.filter("_addresses", lambda row: F.lit(True))
    return met.select(F.inline(one_by_one), "_networks").select(*addresses.columns, F.inline("_networks"))


def network_overlap_join(left: DataFrame, right: DataFrame, l_lo: str, l_hi: str, r_lo: str, r_hi: str) -> DataFrame:
    """Pairs of address ranges (integers, ends included, names unlike) that share an address, each pair once."""
    inside = range_join(left, right, l_lo, r_lo, r_hi, max_level=32)
    after = range_join(right, left.withColumn("_after", F.col(l_lo) + 1), r_lo, "_after", l_hi, max_level=32)
    columns = [*left.columns, *right.columns]
    return inside.select(*columns).unionByName(after.select(*columns))


def ipv6_hex(text: Column) -> Column:
    """IPv6 text (``::`` and a dotted end allowed, a ``/length`` left out) as 32 hexadecimal digits; else anything else or NULL."""
    bare = F.lower(F.split_part(text, F.lit("/"), F.lit(1)))
    dotted = F.regexp_extract(bare, r":(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    byte = lambda i: F.split_part(dotted, F.lit("."), F.lit(i)).try_cast("int")
    pair = lambda i: F.lower(F.hex(byte(i) * 256 + byte(i + 1)))
    plain = F.when(F.contains(bare, F.lit(".")), F.concat(F.left(bare, F.length(bare) - F.length(dotted)), pair(1), F.lit(":"), pair(3))).otherwise(bare)
    halves = F.split(plain, "::")
    groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")
    none = F.array().cast("array<string>")
    head = groups(halves.getItem(0))
    tail = F.when(F.size(halves) > 1, groups(F.get(halves, F.lit(1)))).otherwise(none)
    gap = F.when(F.size(halves) > 1, F.array_repeat(F.lit("0"), F.lit(8) - F.size(head) - F.size(tail))).otherwise(none)
    digits = F.array_join(F.transform(F.concat(head, gap, tail), lambda g: F.when(F.length(g) <= 4, F.lpad(g, 4, "0")).otherwise("?")), "")
    return F.when(F.size(halves) <= 2, digits)


def with_ipv6_words(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Rows whose ``text`` is an IPv6 address, with ``out``, struct<hi, lo> of its two 64-bit words.

    The generator keeps the digits from being made anew for each word.
    """
    cut = rows.withColumn("_digits", F.explode(F.array(ipv6_hex(F.col(text))))).where(F.col("_digits").rlike("^[0-9a-f]{32}$"))
    quarter = lambda i: F.conv(F.substring("_digits", 1 + 8 * i, 8), 16, 10).cast("long")
    word = lambda i: F.shiftleft(quarter(i), 32).bitwiseOR(quarter(i + 1))
    words = F.explode(F.array(F.struct(word(0).alias("hi"), word(2).alias("lo"))))
    return cut.withColumn(out, words).drop("_digits")


def _masks(length: int) -> tuple[int, int]:
    """The two words, signed, that keep the first ``length`` bits."""
    keep = ((1 << length) - 1) << (128 - length)
    return tuple(w - (1 << 64) if w >> 63 else w for w in (keep >> 64, keep & ((1 << 64) - 1)))


def _masked(words: Column, length: int) -> Column:
    hi, lo = _masks(length)
    return F.struct(F.lit(length).alias("length"), words["hi"].bitwiseAND(F.lit(hi)).alias("hi"), words["lo"].bitwiseAND(F.lit(lo)).alias("lo"))


def _limbs(words: Column) -> Column:
    """An address as array of four limbs of 32 bits."""
    return F.array(*[F.shiftrightunsigned(words[w], k).bitwiseAND(F.lit(0xFFFFFFFF)) for w in ("hi", "lo") for k in (32, 0)])


def _masked_at(words: Column, length: Column) -> Column:
    """``_masked`` for a length that differs from row to row."""
    low = lambda n: F.call_function("shiftleft", F.lit(-1).cast("long"), n)
    hi = F.when(length >= 64, F.lit(-1).cast("long")).when(length == 0, F.lit(0).cast("long")).otherwise(low(64 - length))
    lo = F.when(length <= 64, F.lit(0).cast("long")).otherwise(low(128 - length))
    return F.struct(length.alias("length"), words["hi"].bitwiseAND(hi).alias("hi"), words["lo"].bitwiseAND(lo).alias("lo"))


def _not_after(a: Column, b: Column) -> Column:
    """a <= b for addresses as two words, which count without sign."""
    flip = F.lit(-(1 << 63))
    up = lambda words, w: words[w].bitwiseXOR(flip)
    return (up(a, "hi") < up(b, "hi")) | ((a["hi"] == b["hi"]) & (up(a, "lo") <= up(b, "lo")))


def _blocks_join(addresses: DataFrame, cut: DataFrame, address: str, within: tuple[str, str] | None = None) -> DataFrame:
    """Addresses beside the rows of ``cut`` whose block ``_b`` holds them: an equi-join by (length, first address).

    ``within`` names the words of the first and last address that are tested too.
    """
    # at most 129 lengths
    lengths = sorted(r[0] for r in cut.select("_b.length").distinct().collect() if r[0] is not None)
    if not lengths:
        return addresses.join(cut.drop("_b"), F.lit(False))
    own = with_ipv6_words(addresses, address, "_w")
    own = own.withColumn("_a", F.explode(F.array(*[_masked(F.col("_w"), n) for n in lengths])))
    if within is None:
        own = own.drop("_w")
    on = (F.col("_a.length") == F.col("_b.length")) & (F.col("_a.hi") == F.col("_b.hi")) & (F.col("_a.lo") == F.col("_b.lo"))
    if within is not None:
        on = on & _not_after(F.col(within[0]), F.col("_w")) & _not_after(F.col("_w"), F.col(within[1]))
    return own.join(cut, on).drop("_a", "_b", "_w")


def ipv6_join(addresses: DataFrame, networks: DataFrame, address: str, network: str) -> DataFrame:
    """(address row, network row) for each IPv6 address inside a network ``text/length``; without a length, the address."""
    length = F.split_part(F.col(network), F.lit("/"), F.lit(2))
    n = with_ipv6_words(networks, network, "_n").withColumn("_length", F.when(length == "", 128).otherwise(length.try_cast("int")))
    n = n.where("_length BETWEEN 0 AND 128")
    lengths = sorted(r[0] for r in n.select("_length").distinct().collect())
    block = F.coalesce(*[F.when(F.col("_length") == k, _masked(F.col("_n"), k)) for k in lengths]) if lengths else F.lit(None)
    if not lengths:
        return addresses.join(networks, F.lit(False))
    return _blocks_join(addresses, n.withColumn("_b", block).drop("_n", "_length"), address)


def ipv6_range_join(addresses: DataFrame, spans: DataFrame, address: str, first: str, last: str) -> DataFrame:
    """(address row, span row) for each IPv6 address between two addresses, both included; spans need not be networks.

    A span is filed under the length whose blocks are at least as large as it is, so it lies in one or two of them however
    long it is; addresses are looked up once per length in use, and the ends decide.
    """
    # generators keep what they give from being written out anew wherever it is used
    ends = with_ipv6_words(with_ipv6_words(spans, first, "_f"), last, "_e")
    limbs = ends.withColumn("_l", F.explode(F.array(F.struct(_limbs(F.col("_f")).alias("a"), _limbs(F.col("_e")).alias("b")))))
    # exact where limbs cancel, and never off by more than the room left below
    gap = F.aggregate(F.zip_with("_l.b", "_l.a", lambda b, a: (b - a).cast("double")), F.lit(0.0), lambda acc, d: acc * float(1 << 32) + d)
    sized = limbs.withColumn("_g", F.explode(F.array(gap))).where("_g >= 0")
    level = F.when(F.col("_g") < 1, 0).otherwise(F.least(F.floor(F.log2(F.col("_g") * (1 + 1e-9))).cast("int") + 1, F.lit(128)))
    filed = sized.withColumn("_n", F.explode(F.array(F.lit(128) - level)))
    both = F.array_distinct(F.array(_masked_at(F.col("_f"), F.col("_n")), _masked_at(F.col("_e"), F.col("_n"))))
    cut = filed.withColumn("_b", F.explode(both)).drop("_l", "_g", "_n")
    return _blocks_join(addresses, cut, address, ("_f", "_e")).drop("_f", "_e")


def ranges_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return (lo1 <= hi2) & (lo2 <= hi1)


def ipv6_bits(text: Column) -> Column:
    """IPv6 text (with or without ``::``) as 128 characters 0/1, so that prefixes are text prefixes."""
    bare = F.split_part(text, F.lit("/"), F.lit(1))
    halves = F.split(bare, "::")

    def groups(half: Column) -> Column:
        return F.filter(F.split(half, ":"), lambda g: g != "")

    head = groups(halves.getItem(0))
    tail = F.when(F.size(halves) > 1, groups(F.element_at(halves, 2))).otherwise(F.array().cast("array<string>"))
    gap = F.array_repeat(F.lit("0"), F.lit(8) - F.size(head) - F.size(tail))
    full = F.concat(head, gap, tail)
    return F.array_join(F.transform(full, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")


def prefix_join(numbers: DataFrame, prefixes: DataFrame, number: str, prefix: str, longest: bool = True) -> DataFrame:
    """Prefixes that begin each number: the longest one, or all of them.

    Distinct numbers are cut at the lengths that occur among the prefixes, so equal numbers cost
    one lookup; the answer joins back to all rows.  Numbers without a match are left out.
    """
    # one row per prefix length in use
    lengths = sorted(r[0] for r in prefixes.select(F.length(prefix)).distinct().collect() if r[0] is not None)
    cuts = F.array(*[F.when(F.length(number) >= n, F.substring(number, 1, n)) for n in lengths])
    if not lengths:
        return numbers.join(prefixes, F.lit(False))
    distinct = numbers.select(number).distinct()
    spread = distinct.select(number, F.explode(F.filter(cuts, lambda c: c.isNotNull())).alias("_cut"))
    if not longest:
        found = spread.join(prefixes, F.col("_cut") == F.col(prefix)).drop("_cut")
    else:
        known = prefixes.dropDuplicates([prefix])
        best = (spread.join(known.select(F.col(prefix).alias("_prefix")), F.col("_cut") == F.col("_prefix"))
                .groupBy(number).agg(F.max_by("_prefix", F.length("_prefix")).alias(prefix)))
        found = best.join(prefixes, prefix)  # all rows of that prefix
    return numbers.join(found, number)


def interval_join(left: DataFrame, right: DataFrame, l_from: str, l_to: str, r_from: str, r_to: str,
                  by: list[str] | None = None, micros: bool = False) -> DataFrame:
    """Pairs of half-open periods that share an instant, each pair once.

    Either the left start lies in the right period, or the right start lies inside the left period
    after its start; both cases are containment joins.  A NULL end is open.  Dates count in days;
    ``micros`` is for timestamps.  Columns of the two sides other than ``by`` have different names.

    Rows of a ``by`` key that has at most ``FEW`` right rows meet all of these; blocks are for the other keys.
    """
    by = by or []
    number = (lambda c: F.unix_micros(F.col(c).cast("timestamp"))) if micros else (lambda c: F.unix_date(c).cast("long"))
    far = F.lit(2 ** (60 if micros else 30)).cast("long")

    def bounded(df, start, end, tag):
        # empty and inverted periods share no instant with anything
        return (df.withColumn(f"_{tag}s", number(start)).withColumn(f"_{tag}e", F.coalesce(number(end), far) - 1)
                .where(F.col(f"_{tag}s") <= F.col(f"_{tag}e")))

    lhs, rhs = bounded(left, l_from, l_to, "l"), bounded(right, r_from, r_to, "r")
    columns = [*left.columns, *[c for c in right.columns if c not in by]]
    if by:
        crowded = stage(rhs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select(*by), "crowded-keys")
        few = (side.join(crowded, by, "left_anti") for side in (lhs, rhs))
        pairs = next(few).join(next(few), by).where(ranges_overlap(F.col("_ls"), F.col("_le"), F.col("_rs"), F.col("_re"))).select(*columns)
        if crowded.isEmpty():
            return pairs
        lhs, rhs = (side.join(crowded, by, "left_semi") for side in (lhs, rhs))
    level = 60 if micros else 31
    first = range_join(lhs, rhs, "_ls", "_rs", "_re", by, max_level=level)
    later = range_join(rhs, lhs.withColumn("_l1", F.col("_ls") + 1), "_rs", "_l1", "_le", by, max_level=level)
    met = first.select(*columns).unionByName(later.select(*columns))
    return pairs.unionByName(met) if by else met


def band_join(left: DataFrame, right: DataFrame, value: str, lo: Column, hi: Column, scale: int = 0) -> DataFrame:
    """Non-equi join ``lo <= value < hi`` on numbers.

    Blocks are found at ``scale`` decimal digits, rounded outwards; the bounds themselves are tested on the pairs.
    """
    factor = 10 ** scale
    points = left.withColumn("_v", F.floor(F.col(value) * factor).cast("long"))
    bands = (right.withColumn("_from", lo).withColumn("_to", hi).where("_from < _to")
             .withColumn("_lo", F.floor(F.col("_from") * factor).cast("long")).withColumn("_hi", F.floor(F.col("_to") * factor).cast("long")))
    pairs = range_join(points, bands, "_v", "_lo", "_hi")
    return pairs.where((F.col(value) >= F.col("_from")) & (F.col(value) < F.col("_to"))).drop("_v", "_lo", "_hi", "_from", "_to")
