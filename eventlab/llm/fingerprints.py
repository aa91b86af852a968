"""Fingerprints of whole texts by one-permutation MinHash, in DataFrame expressions only.

A text's shingles are hashed once. The top bits of a hash choose one of `BINS` bins, and a bin keeps
its least hash. A bin without a shingle borrows from another one by optimal densification: every
bin has a fixed random order of all bins, and takes the first of them that has a shingle. The
fingerprint keeps the low `BITS` bits of every bin. Two different values agree in these by chance,
which `likeness` corrects for.

All of it happens inside a row: the hashes are sorted together with one mark per bin, the largest
hash a bin may hold, so the first entry of a bin is its least hash or the mark of an empty bin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import number_sorted
from .tables import stored

SHINGLE = 5
BIN_BITS = 9
BINS = 1 << BIN_BITS
BITS = 4
#: Bins that an empty one tries in turn, before all full ones are ranked for it.
PROBES = 32

_BELOW = 64 - BIN_BITS
#: Lowest bit of each group of `BITS` bits of a long.
_LOWEST = sum(1 << (BITS * i) for i in range(64 // BITS))
_WHITE = "\t\n\x0b\x0c\r"

KEY = ["_none", "_doc", "_tag"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once for the row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    none = F.array().cast("array<string>")
    plain = F.btrim(F.translate(F.coalesce(text, F.lit("")), _WHITE, " " * len(_WHITE)))
    return _let(plain, lambda t: F.when(t == "", none).otherwise(F.split(t, " +")))


def _hashes(words: Column) -> Column:
    """One hash for each shingle of `SHINGLE` words; a shorter text is one shingle."""
    n = F.size(words)

    def shingle(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])

    many = F.transform(F.sequence(F.lit(0), n - SHINGLE), shingle)
    few = F.when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n >= SHINGLE, many).otherwise(few)


def _bin(value: Column) -> Column:
    return (F.shiftright(value, _BELOW) + BINS // 2).cast("int")


def _is_mark(value: Column) -> Column:
    return value.bitwiseAND(F.lit((1 << _BELOW) - 1)) == (1 << _BELOW) - 1


def _minima(hashes: Column) -> Column:
    """The least hash of each bin, in the order of the bins; empty bins have their mark."""
    marks = F.array(*[F.lit(((b - BINS // 2) << _BELOW) + (1 << _BELOW) - 1) for b in range(BINS)])

    def firsts(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(ordered, i - 1))))

    return _let(F.sort_array(F.concat(hashes, marks)), firsts)


def _densified(minima: Column) -> Column:
    """The minima, with every empty bin filled by the first full bin of its own order."""

    def fill(full: Column) -> Column:
        def borrowed(b: Column) -> Column:
            tried = [F.get(minima, F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
            # The bins beyond the probes come in the order of a hash.
            ranked = F.array_min(F.transform(full, lambda x: F.struct(F.xxhash64(b, _bin(x)).alias("rank"), x.alias("x"))))["x"]
            return F.coalesce(*[_let(x, lambda v: F.when(~_is_mark(v), v)) for x in tried], ranked)

        return F.transform(minima, lambda x, b: F.when(_is_mark(x), borrowed(b)).otherwise(x))

    return _let(F.filter(minima, lambda x: ~_is_mark(x)), fill)


def _packed_bits(values: Column) -> Column:
    """The low bits of all bins, 64 / `BITS` of them in each long."""
    each = 64 // BITS

    def long(w: Column) -> Column:
        own = F.slice(values, w * each + 1, each)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1))))

    return F.transform(F.sequence(F.lit(0), F.lit(BINS // each - 1)), long)


def packed(text: Column) -> Column:
    """The fingerprint as an array of longs, empty for a text without words."""

    def pack(hashes: Column) -> Column:
        made = _let(_minima(hashes), lambda minima: _let(_densified(minima), _packed_bits))
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(made)

    return _let(_words(text), lambda words: _let(_hashes(words), pack))


def as_text(fingerprint: Column) -> Column:
    """The fingerprint as lower-case hexadecimal digits, one for each bin."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingles, from 0 to 1.

    A share ``c = 2 ** -BITS`` of different values has the same low bits, so the share ``s`` of equal
    bins stands for ``(s - c) / (1 - c)``. Two texts without words are alike, one of them is not.
    """

    def differing(x: Column) -> Column:
        any_bit = x
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(any_bit.bitwiseAND(F.lit(_LOWEST)))

    bits = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    unequal = F.aggregate(bits, F.lit(0), lambda n, x: n + differing(x))
    chance = 2.0**-BITS
    share = (1 - unequal / F.lit(float(BINS)) - chance) / (1 - chance)
    wordless = (F.size(a) == 0).cast("int") + (F.size(b) == 0).cast("int")
    return F.when(wordless == 2, 1.0).when(wordless == 1, 0.0).otherwise(F.greatest(share, F.lit(0.0)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_chars, fingerprint``. A missing text is an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.char_length(text).cast("bigint").alias("n_chars"), packed(text).alias("_packed"))
    return rows.select("doc_id", "n_chars", as_text(F.col("_packed")).alias("fingerprint"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts under a key without nulls; rows that agree in it are copies of each other."""
    doc_id = F.col("doc_id").cast("bigint")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_id.isNull().alias("_none"), F.coalesce(doc_id, F.lit(0)).alias("_doc"), F.xxhash64(text).alias("_tag"), text.alias("_text"))


def _links(sketches: DataFrame) -> DataFrame:
    """For each key the one before it by descending id (before the first: the last), and the code points that this one lacks."""
    slim = sketches.select(*KEY, "_chars", F.expr("~_doc").alias("_down"))
    numbered = stored(number_sorted(slim, [], ["_none", "_down", "_tag"], "_place", [*KEY, "_chars"]), "links")
    last = numbered.orderBy(F.desc("_place")).limit(1).select(F.struct(*KEY, "_chars").alias("last")).collect()
    if not last:
        return numbered.select(*KEY, F.lit(0).alias("_wants"), *[F.col(k).alias(f"_to{k}") for k in KEY])
    end = last[0]["last"]
    wrapped = F.struct(F.lit(end["_none"]).alias("_none"), F.lit(end["_doc"]).alias("_doc"), F.lit(end["_tag"]).alias("_tag"), F.lit(end["_chars"]).alias("_chars"))
    before = numbered.withColumn("_before", F.coalesce("prev", wrapped.cast(numbered.schema["prev"].dataType)))
    wants = F.floor(F.col("_before._chars") / 2).cast("int").alias("_wants")
    return before.select(*KEY, wants, *[F.col(f"_before.{k}").alias(f"_to{k}") for k in KEY])


def compare_edited(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside that of its edited text, and beside the next document's.

    The edited text has the last half of the code points replaced by as many from the start of the
    next document (all of it, if it is shorter). Documents follow each other by descending ``doc_id``,
    those without an id last, the ones that share an id by a hash of their text; the first follows the
    last. Repeated rows follow each other, so all but one of them take their own text. Returns one row per
    document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. Other columns are ignored; an empty table gives no rows.

    Texts move once, summed up to one row per key in every task, and starts of texts once more to
    the document before.
    """
    rows = _keyed(docs)
    measured = rows.select(*KEY, F.char_length("_text").alias("_chars"), packed(F.col("_text")).alias("_own"))
    grouped = measured.groupBy(*KEY).agg(F.count("*").alias("_copies"), F.first("_chars").alias("_chars"), F.first("_own").alias("_own"))
    sketches = stored(grouped, "sketches")
    links = _links(sketches).join(sketches.select(*KEY, F.col("_own").alias("_next")), KEY)
    texts = rows.groupBy(*KEY).agg(F.first("_text").alias("_text"))

    starts = texts.join(links, KEY).select(*[F.col(f"_to{k}").alias(k) for k in KEY], F.expr("left(_text, _wants)").alias("_start"), "_next")
    both = texts.join(starts, KEY).join(sketches, KEY)
    half = F.floor(F.col("_chars") / 2).cast("int")
    own = F.struct(F.lit(1).cast("bigint").alias("times"), F.col("_start").alias("start"), F.col("_next").alias("next"))
    copy = F.struct((F.col("_copies") - 1).alias("times"), F.left("_text", half).alias("start"), F.col("_own").alias("next"))
    follow = F.explode(F.when(F.col("_copies") > 1, F.array(own, copy)).otherwise(F.array(own)))
    cases = both.withColumn("_follow", follow).select(
        *KEY, "_chars", "_own", F.concat(F.left("_text", F.col("_chars") - half), "_follow.start").alias("_edited"), "_follow.next", "_follow.times"
    )
    done = cases.select(*KEY, "_chars", "_own", "next", "times", F.sha2("_edited", 256).alias("edited_sha256"), packed(F.col("_edited")).alias("_changed"))
    shown = done.select(
        F.when(~F.col("_none"), F.col("_doc")).alias("doc_id"),
        F.col("_chars").cast("bigint").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_changed")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_changed")).alias("near_edited"),
        likeness(F.col("_own"), F.col("next")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("_copy"),
    )
    return shown.drop("_copy")
