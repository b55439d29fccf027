"""Document fingerprints: I-Match over randomised lexicon subsets, in DataFrame functions only.

Terms are hashed to VOCABULARY ids. The lexicon holds the ids whose inverse document frequency lies in a
band: not in most documents, not in one alone. It is a map of one bit an id, of a size that does not grow
with the corpus. A hash deals each lexicon id to one of the subsets or to none; a text's distinct terms in
a subset are sorted and hashed together, and the hashes of all subsets that hold a term of the text are the
fingerprint. Subsets come in tiers, each keeping a quarter of what the one before keeps, so that texts of
any length meet subsets that keep a term or two of them: those tell how alike two texts are. Likeness is the
share of equal hashes among the subsets of the finer tiers that keep something of either text.

Cases. Null is the empty text. A text without a term in any subset has a fingerprint of its own hash, like
only to itself. Equal texts have equal fingerprints. Other columns are ignored unless carried.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VOCABULARY = 1 << 21
#: Subsets of a tier, and for each tier how many of 4096 hash values a subset keeps.
SUBSETS, KEPT = 32, (64, 16, 4, 1)
#: Blocks of neighbouring ids: at most so many, so what is collected of them is bounded.
QUANTILES, PARTS = 256, 256
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def term_ids(text: Column) -> Column:
    """Distinct term ids of a text (the empty string at its ends counts as a term that all texts have)."""
    return F.array_distinct(F.transform(F.split(F.lower(text), _SPLIT), lambda w: F.xxhash64(w).bitwiseAND(VOCABULARY - 1)))


def lexicon(docs: DataFrame, *, text_col: str = "text", at_most: float = 0.1, at_least: int = 2) -> bytes:
    """One bit for each id: 1 if its documents are at least `at_least` and at most the share `at_most` of all (2 at least)."""
    total = docs.count()
    counts = docs.select(F.explode(term_ids(F.col(text_col))).alias("id")).groupBy("id").count()
    band = counts.where((F.col("count") >= at_least) & (F.col("count") <= max(at_most * total, 2.0)))
    # a bitmap for each 32768 ids, so VOCABULARY bits at most come to the driver
    place = F.col("id") + 1
    maps = band.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = bytearray(VOCABULARY // 8)
    for row in maps:
        out[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = row["bits"]
    return bytes(out)


def subset_of(v: Column) -> Column:
    """The subset (tier by tier) that keeps hash value v of 4096, -1 for none."""
    out, base = F.lit(-1), 0
    rules = []
    for t, kept in enumerate(KEPT):
        rules.append((base, base + kept * SUBSETS, t * SUBSETS, kept))
        base += kept * SUBSETS
    for low, high, first, kept in reversed(rules):
        out = F.when(v < high, F.lit(first) + F.shiftright(v - low, kept.bit_length() - 1)).otherwise(out)
    return out


class Fingerprints:
    def __init__(self, known: bytes):
        # one array of longs: plans show it in a quarter of a megabyte, and a bit is read without a copy
        self.known = F.split(F.lit(",".join(map(str, struct.unpack(f"<{len(known) // 8}q", known)))), ",").cast("array<bigint>")

    def add(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """The column `out`: for each subset that holds a term of the column `text`, its number and hash in hex (two and four digits)."""
        inside = lambda i: F.getbit(F.get(self.known, F.shiftright(i, 6).cast("int")), i.bitwiseAND(63).cast("int")) == 1
        keep = df.columns

        def packed(i: Column) -> Column:
            h = F.xxhash64(i, F.lit(77))
            return F.shiftleft(subset_of(h.bitwiseAND(4095).cast("int")).cast("long"), 48).bitwiseOR(F.shiftrightunsigned(h, 16))

        # by subset, then by term; -1 << 48 makes the terms of no subset negative
        df = df.select(*keep, F.array_sort(F.filter(F.transform(F.filter(term_ids(F.col(text)), inside), packed), lambda x: x >= 0)).alias("~terms"))
        token = lambda s: F.concat(F.lpad(F.hex(s["subset"]), 2, "0"), F.substring(F.lpad(F.hex(s["hash"]), 16, "0"), 1, 4))
        push = lambda s: F.when(s["subset"] >= 0, F.concat(s["out"], F.array(token(s)))).otherwise(s["out"])

        def step(s: Column, x: Column) -> Column:
            subset = F.shiftright(x, 48)
            same = subset == s["subset"]
            return F.struct(subset.alias("subset"), F.when(same, F.xxhash64(s["hash"], x)).otherwise(F.xxhash64(x)).alias("hash"), F.when(same, s["out"]).otherwise(push(s)).alias("out"))

        start = F.struct(F.lit(-1).cast("long").alias("subset"), F.lit(0).cast("long").alias("hash"), F.array().cast("array<string>").alias("out"))
        return df.select(*keep, F.aggregate("~terms", start, step, push).alias(out))


def joined(codes: Column, text: Column) -> Column:
    """The fingerprint as a string."""
    return F.when(F.size(codes) > 0, F.array_join(codes, "")).otherwise(F.concat(F.lit("text:"), F.sha2(text, 256)))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Share of equal hashes among the subsets that keep something of either text, of the tiers in which some keep nothing.

    In coarser tiers one changed term changes nearly every hash. same: whether the fingerprints are equal.
    """
    equal, either = F.lit(0), F.lit(0)
    bound = lambda t: f"{t * SUBSETS:02X}"
    for t in reversed(range(len(KEPT))):
        own = lambda c, t=t: F.filter(c, lambda x: (x >= bound(t)) & (x < bound(t + 1)))
        x, y = own(a), own(b)
        both = F.size(F.array_intersect(x, y))
        subsets = lambda c: F.transform(c, lambda v: F.substring(v, 1, 2))
        n = F.size(F.array_union(subsets(x), subsets(y)))
        use = (n * 4 <= 3 * SUBSETS) | (either == 0)
        equal = equal + F.when(use, both).otherwise(0)
        either = either + F.when(use, n).otherwise(0)
    return F.when(same, F.lit(1.0)).when(either == 0, F.lit(0.0)).otherwise(equal / either)


def with_next(docs: DataFrame, columns: dict[str, str], *, id_col: str) -> DataFrame:
    """Adds columns of the next row in descending order of the id, of the first row after the last; a null id is the least.

    Equal ids follow each other by a hash of these columns. Rows fall into blocks of neighbouring ids, and each block is ordered by itself. The row after a block's last
    is the first of the next block that has any; it is handed to this block as a guest. So rows move once, and
    no task sees more than a block.
    """
    spark = docs.sparkSession
    own = docs.withColumn("~id", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
    total, bounds = own.agg(F.count("*"), F.percentile_approx("~id", [i / QUANTILES for i in range(1, QUANTILES)], 10_000)).first()
    if not total:
        return own.select(*docs.columns, *(F.col(c).alias(name) for c, name in columns.items()))
    bounds = sorted(set(bounds))
    parts = min(PARTS, total // (QUANTILES * 500) + 1)
    cuts = F.array(*(F.lit(b).cast("long") for b in bounds))
    quantile = F.size(F.filter(cuts, lambda b: b <= F.col("~id")))
    low, high = F.get(cuts, F.col("~q") - 1), F.get(cuts, F.col("~q"))
    part = F.coalesce(F.width_bucket(F.col("~id").cast("double"), low.cast("double"), high.cast("double"), F.lit(parts).cast("long")), F.lit(0)) if parts > 1 else F.lit(0)
    own = own.withColumn("~q", quantile).withColumn("~block", (F.col("~q") * (PARTS + 2) + part).cast("int")).drop("~q")
    heads = sorted(own.groupBy("~block").agg(F.max("~id").alias("head")).collect())  # QUANTILES * (PARTS + 2) pairs at most
    guests = [(head, heads[(i + 1) % len(heads)][0]) for i, (_, head) in enumerate(heads)]
    guests = F.broadcast(spark.createDataFrame(guests, "`~id` long, `~to` int"))
    dealt = own.join(guests, "~id", "left").withColumn("~at", F.explode(F.array_compact(F.array(F.struct(F.col("~block").alias("b"), F.lit(False).alias("g")), F.when(F.col("~to").isNotNull(), F.struct(F.col("~to").alias("b"), F.lit(True).alias("g")))))))
    dealt = dealt.select(*docs.columns, "~id", F.col("~at.b").alias("~b"), F.col("~at.g").alias("~g"))
    order = Window.partitionBy("~b").orderBy("~g", F.desc("~id"), F.xxhash64(*columns))
    return dealt.select(*docs.columns, "~g", *(F.lead(c).over(order).alias(name) for c, name in columns.items())).where(~F.col("~g")).drop("~g")


def fingerprints_of_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited versions (the last half replaced by the start of the next document)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = Fingerprints(lexicon(rows))
    rows = prints.add(rows, "text", "codes")
    rows = with_next(rows, {"text": "next_text", "codes": "next_codes"}, id_col="doc_id")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    rows = rows.select("doc_id", "text", "codes", "next_codes", n.cast("long").alias("n_chars"), edited.alias("edited"), joined(F.col("codes"), F.col("text")).alias("fingerprint"), joined(F.col("next_codes"), F.col("next_text")).alias("next_fingerprint"))
    rows = prints.add(rows, "edited", "edited_codes")
    rows = rows.withColumn("edited_fingerprint", joined(F.col("edited_codes"), F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("codes"), F.col("edited_codes"), F.col("fingerprint") == F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes"), F.col("fingerprint") == F.col("next_fingerprint")).alias("near_next"),
    )
